"""Queries of the whole page check and content filter, and of embedded urls in them."""

from __future__ import annotations

from pyspark.sql import functions as F

from sieveline.functions import text as X
from sieveline.operators import labels as LB
from sieveline.operators import phrases as P
from sieveline.operators.contentfilter import check_pages, content_filter
from sieveline.plans import content as C
from sieveline.plans import inline as I
from sieveline.plans.registry import QuerySet
from sieveline.session import table
from sieveline.sources.config import MainOptions
from sieveline.sources.lists import BANNED, EXCEPTION, WEIGHTED, Phrase, PhraseBase

Q = QuerySet()

_LIMITS = "service string, label string, max_level int"


def _limits(spark):
    return I.inline(spark, LB.limits_rows(2), _LIMITS)


@Q.add("c02_verdict", f"WITH {C._weighed_sql()}")
def c02_verdict(spark, d):
    """Outcome, score, reason and categories of every document: labels, phrases and embedded urls."""
    return check_pages(table(spark, d, "documents"), "doc_id", "text", I.phrase_base(), C.LIMIT, label_limits=_limits(spark), links=C._page_links(spark, d))


_PLAIN = r'''regexp_extract_all(text, '(?i)((?:https?|ftp)://[^ \t\r\n"''<>]*[^ \t\r\n"''<>.,;:!?)\]])', 1)'''
#: Links and plain urls of documents, each once, numbered.
_NAMED = f"SELECT row_number() OVER (ORDER BY doc_id, url) AS log_id, doc_id, url FROM (SELECT log_id // 1000000 AS doc_id, url FROM {C._LINKS} WHERE url IS NOT NULL UNION SELECT doc_id, unnest({_PLAIN}) FROM documents)"


@Q.add("j14_embedded_hits", f"WITH {C._linked_sql().replace(C._LINKS, '(' + _NAMED + ')')} SELECT doc_id, url, list_name, item FROM lk JOIN links USING (log_id)")
def j14_embedded_hits(spark, d):
    """Urls of a document, linked or in its text, that the banned site list or else the banned url list holds."""
    linked = F.transform(C.page_links(F.col("text"), C._base()), lambda x: x["url"])
    urls = F.array_distinct(F.concat(linked, C.plain_urls(F.col("text"))))
    links = table(spark, d, "documents").select("doc_id", F.explode_outer(urls).alias("url")).filter("url IS NOT NULL")
    return C.banned_links(links, ["doc_id", "url"], "url", table(spark, d, "rules_item")).select("doc_id", "url", "list_name", "item")


@Q.add("a07_embedded_weight", f"WITH {C._linked_sql()} SELECT log_id // 1000000 AS doc_id, CAST(count(*) * 10 AS BIGINT) AS weight FROM lk GROUP BY 1")
def a07_embedded_weight(spark, d):
    """Weights of documents' banned links, 10 each; c02_verdict adds them to the scores."""
    return C._page_links(spark, d).select("doc_id", F.col("weight").cast("long").alias("weight"))


_DECODED = "coalesce(url_decode(regexp_replace(replace(text, '+', '%2B'), '%([^0-9A-Fa-f]|[0-9A-Fa-f][^0-9A-Fa-f]|[0-9A-Fa-f]?$)', '%25\\1', 'g')), text)"


@Q.add("c01_pass_scores", f"WITH hd AS (SELECT doc_id, replace(replace(text, '%', ''), ' ', '%20') AS text FROM documents), dd AS (SELECT doc_id, {_DECODED} AS text FROM hd), {C._CONTRIB.replace('FROM documents', 'FROM dd')} SELECT doc_id, pass, CAST(coalesce(sum(weight) FILTER (kind = 1), 0) AS BIGINT) AS score, max(label) FILTER (kind = -1 AND NOT is_combi) IS NOT NULL AS has_exception FROM f GROUP BY ALL")
def c01_pass_scores(spark, d):
    """Every pass of every document, its blanks coded as %20 and decoded again, judged on its own."""
    coded = F.replace(F.replace(F.col("text"), F.lit("%"), F.lit("")), F.lit(" "), F.lit("%20"))
    parts = table(spark, d, "documents").select("doc_id", F.inline(X.passes(X.percent_decode(coded), 2, 0)))
    found = P.contributions(P.phrase_hits(parts, ["doc_id", "pass"], "text", I.phrase_base().needles()), ["doc_id", "pass"], I.phrase_base())
    return found.groupBy("doc_id", "pass").agg(
        F.coalesce(F.sum(F.when(F.col("kind") == WEIGHTED, F.col("weight"))), F.lit(0).cast("long")).alias("score"), F.coalesce(F.max((F.col("kind") == EXCEPTION) & ~F.col("is_combi")), F.lit(False)).alias("has_exception")
    )


_PICS = '<meta http-equiv="pics-label" content="weburbia r (s {})">'
_PAGES = [
    (1, _PICS.format(3) + " fine", None, "label", 0, "weburbia s 3"), (2, _PICS.format(2) + " win", None, "clean", 30, ""), (3, "w%69n w%69n", None, "weighted", 60, "50 : 60 (win)"), (4, "b%61d %", None, "banned", 0, "bad"), (5, "bad fine", None, "exception", 0, "fine"),
    (6, "<b>w</b>in", None, "clean", 0, ""), (7, 'win "http://bad.example/" "http://bad.example/2" "http://bad.example/3"', "s.example", "weighted", 60, "50 : 60 ([bad.example bad.example bad.example]+win)"), (8, None, None, "clean", 0, ""), (9, "", None, "clean", 0, ""),
]


@Q.add("c01_check_fixture", f"SELECT id, outcome, score, reason FROM {I.values_sql([(r[0], *r[3:]) for r in _PAGES], 'id, outcome, score, reason')}")
def c01_check_fixture(spark, d):
    """Pages for each step of the check: labels, decoding, phrases in raw and stripped texts, embedded urls."""
    base = PhraseBase([Phrase(("win",), WEIGHTED, 30), Phrase(("bad",), BANNED), Phrase(("fine",), EXCEPTION)])
    # what links name isn't to be found as phrases here
    df = I.inline(spark, [r[:3] for r in _PAGES], "id int, html string, site string").withColumn("text", F.replace("html", F.lit("bad.example"), F.lit("b.example")))
    links = C.link_weights(df, "id", F.col("html"), C._base(), I.inline(spark, C._LINK_RULES, "list_name string, item string, category string"), 10)
    out = check_pages(df, "id", "text", base, 50, hex_decode=True, label_limits=_limits(spark), links=links)
    return out.select("id", "outcome", F.col("score").cast("int").alias("score"), "reason")


_REWRITTEN = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '(https?)://([a-z0-9.-]+)', '[\2|\1]', 'gi'), 'filter group', 'group', 'gi'), '\bgroup (\w+)', 'group <\1>', 'gi'), 'jackpot', '', 'gi')"


@Q.add("c06_content_filter", f"""SELECT doc_id, CASE WHEN coalesce(octet_length(encode(text)), 0) = 0 THEN 'passed' WHEN octet_length(encode(text)) <= 20480000 AND contains(text, 'jackpot') THEN 'infected' WHEN octet_length(encode(text)) > 262144 THEN 'passed'
 WHEN outcome IN ('banned combination', 'banned', 'weighted') THEN 'banned' WHEN outcome IN ('combination exception', 'exception') THEN 'exception' WHEN {_REWRITTEN} <> text THEN 'rewritten' ELSE 'checked' END AS stage
 FROM documents JOIN (WITH {C._weighed_sql()}) USING (doc_id)""")
def c06_content_filter(spark, d):
    """All stages of the content filter with its default limits: size gates, scanner, labels, phrases, embedded urls, rewriting."""
    df = table(spark, d, "documents")
    return content_filter(df, "doc_id", "text", I.phrase_base(), C.LIMIT, (("jackpot", "J"),), I.REWRITES, label_limits=_limits(spark), links=C._page_links(spark, d))


_SIZES = [(1, 1023, "checked"), (2, 1024, "checked"), (3, 1025, "passed"), (4, 0, "passed")]


@Q.add("f14_size_limit", f"SELECT id, stage FROM {I.values_sql([(k, s) for k, _, s in _SIZES], 'id, stage')}")
def f14_size_limit(spark, d):
    """Texts at, below and above a size limit of 1 KiB."""
    df = I.inline(spark, [(k, "x" * n) for k, n, _ in _SIZES], "id int, t string")
    return content_filter(df, "id", "t", PhraseBase([Phrase(("bad",), BANNED)]), 50, (), [], MainOptions(maxcontentfiltersize=1)).select("id", "stage")
