"""Queries over the documents: normalisation, phrases, scores, verdicts and rewriting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.functions import text as X
from sieveline.operators import phrases as P
from sieveline.operators.match import banned_links, link_weights, page_links, plain_urls
from sieveline.plans import inline as I
from sieveline.plans.registry import QuerySet
from sieveline.session import table

Q = QuerySet()

LIMIT = 60


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


_FOLD = f"translate(text, '{X.FOLD_UPPER}' || chr(9) || chr(10) || chr(13), '{X.FOLD_LOWER}   ')"
_STRIP = "(' ' || ltrim(regexp_replace(translate(regexp_replace(regexp_replace({0}, '<[^>]*>', ' ', 'g'), '<[^>]*$', '', 'g'), '>', ' '), ' +', ' ', 'g'), ' '))"
_SMART = _STRIP.format(_FOLD)

_SQL = f"SELECT doc_id, md5(t) AS t, length(t) AS n FROM (SELECT doc_id, {{0}} AS t FROM documents)"


def _digest(df: DataFrame, c) -> DataFrame:
    return df.select("doc_id", F.md5(c).alias("t"), F.length(c).cast("long").alias("n"))


@Q.add("p02_fold", _SQL.format(_FOLD))
def p02_fold(spark, d):
    return _digest(_documents(spark, d), X.fold(F.col("text")))


@Q.add("p03_smart_strip", _SQL.format(_SMART))
def p03_smart_strip(spark, d):
    return _digest(_documents(spark, d), X.smart_strip(X.fold(F.col("text"))))


_HEAD = f"CASE WHEN contains(f, '</head') THEN split_part(f, '</head', 1) ELSE split_part(f, '<body', 1) END"


@Q.add("p04_meta_title", f"""SELECT doc_id, trim(regexp_replace(translate(array_to_string(regexp_extract_all({_HEAD}, '<(?:meta |title>)([^<>]*)', 1), ' '), ',="''().', '       '), ' +', ' ', 'g'), ' ') AS t
 FROM (SELECT doc_id, '<meta name="x" content="' || replace({_FOLD}, '"', '') || '"><title>' || coalesce(lower(lang), '') || '</title></head><body>' AS f FROM documents)""")  # fmt: skip
def p04_meta_title(spark, d):
    """Meta and title text of pages made of each document's text and language."""
    df = table(spark, d, "documents")
    page = F.concat(F.lit('<meta name="x" content="'), F.translate(X.fold(F.col("text")), '"', ""), F.lit('"><title>'), F.coalesce(F.lower("lang"), F.lit("")), F.lit("</title></head><body>"))
    return df.select("doc_id", X.meta_title(page).alias("t"))


@Q.add("p05_passes", f"""WITH b AS (SELECT doc_id, {_FOLD} AS f, translate(text, chr(9) || chr(10) || chr(13), '   ') AS k FROM documents),
 p AS (SELECT doc_id, 'folded_raw' AS pass, f AS t FROM b UNION ALL SELECT doc_id, 'folded_smart', {_STRIP.format('f')} FROM b UNION ALL SELECT doc_id, 'kept_raw', k FROM b UNION ALL SELECT doc_id, 'kept_smart', {_STRIP.format('k')} FROM b)
 SELECT doc_id, pass, length(t) AS n, md5(t) AS h FROM p""")  # fmt: skip
def p05_passes(spark, d):
    df = _documents(spark, d).select("doc_id", F.inline(X.passes(F.col("text"), 2, 2)))
    return df.select("doc_id", "pass", F.length("text").cast("long").alias("n"), F.md5("text").alias("h"))


@Q.add("p01_hex_decode", "SELECT doc_id, md5(coalesce(url_decode(regexp_replace(replace(t, '+', '%2B'), '%([^0-9A-Fa-f]|[0-9A-Fa-f][^0-9A-Fa-f]|[0-9A-Fa-f]?$)', '%25\\1', 'g')), t)) AS h FROM (SELECT doc_id, replace(replace(text, '%', ''), ' ', '%20') AS t FROM documents)")
def p01_hex_decode(spark, d):
    """Texts with every blank as %20 decoded again."""
    coded = F.replace(F.replace(F.col("text"), F.lit("%"), F.lit("")), F.lit(" "), F.lit("%20"))
    return _documents(spark, d).select("doc_id", F.md5(X.percent_decode(coded)).alias("h"))


# phrases whose occurrences can't overlap each other, so that plain replacement counts them
_HITS = f"""h AS (SELECT doc_id, pass, phrase, CAST((length(t) - length(replace(t, phrase, ''))) / length(phrase) AS BIGINT) AS n
 FROM (SELECT doc_id, 'folded_raw' AS pass, {_FOLD} AS t FROM documents UNION ALL SELECT doc_id, 'folded_smart', {_SMART} FROM documents), {I.needle_sql()} WHERE contains(t, phrase))"""
_CONTRIB = f"""{_HITS}, cp AS (SELECT h.doc_id, h.pass, p.combi_id, count(*) AS k, min(n) AS n FROM h JOIN {I.part_sql()} p USING (phrase) GROUP BY ALL),
 ch AS (SELECT cp.doc_id, cp.pass, cp.combi_id, cp.n, c.label, c.kind, c.w, c.category FROM cp JOIN {I.combi_sql()} c USING (combi_id) WHERE cp.k = c.n_parts),
 f AS (SELECT doc_id, pass, phrase AS label, kind, false AS is_combi, CAST(w * n AS BIGINT) AS weight, category FROM h JOIN {I.single_sql()} s USING (phrase)
 UNION ALL SELECT doc_id, pass, label, kind, true, CAST(w * n AS BIGINT), category FROM ch)"""


def _hits(spark, d, few: int = P.FEW) -> DataFrame:
    parts = _documents(spark, d).select("doc_id", F.inline(X.passes(F.col("text"), 2, 0)))
    return P.phrase_hits(parts, ["doc_id", "pass"], "text", I.phrase_base().needles(), few)


def _found(spark, d, mode: int = 1) -> DataFrame:
    return P.contributions(_hits(spark, d), ["doc_id", "pass"], I.phrase_base(), mode)


@Q.add("j10_phrase_hits", f"WITH {_HITS} SELECT DISTINCT doc_id, phrase FROM h WHERE pass = 'folded_raw'")
def j10_phrase_hits(spark, d):
    return _hits(spark, d).filter("pass = 'folded_raw'").select("doc_id", "phrase")


@Q.add("a01_phrase_count", f"WITH {_HITS} SELECT doc_id, pass, phrase, n FROM h")
def a01_phrase_count(spark, d):
    """Counts by the automaton that long lists use."""
    return _hits(spark, d, few=0)


@Q.add("a01_phrase_count_builtin", f"WITH {_HITS} SELECT doc_id, phrase, n FROM h WHERE pass = 'folded_raw'")
def a01_phrase_count_builtin(spark, d):
    """The same counts by built-in functions only."""
    folded = _documents(spark, d).select("doc_id", X.fold(F.col("text")).alias("text"))
    return P.phrase_hits(folded, ["doc_id"], "text", I.phrase_base().needles(), few=1000)


@Q.add("a01_overlapping_count", "WITH d AS (SELECT doc_id, replace(text, ' ', '  ') AS t FROM documents) SELECT doc_id, CAST((length(t) - length(replace(t, ' the ', ''))) / 5 AS BIGINT) AS n FROM d WHERE contains(t, ' the ')")
def a01_overlapping_count(spark, d):
    """A word between blanks, where neighbours share a blank."""
    return P.phrase_hits(_documents(spark, d), ["doc_id"], "text", [" the "]).select("doc_id", "n")


@Q.add("j11_combi", f"WITH {_CONTRIB} SELECT doc_id, pass, combi_id, n FROM ch")
def j11_combi(spark, d):
    return P.combi_hits(_hits(spark, d), ["doc_id", "pass"], I.phrase_base())


@Q.add("a03_combi_score", f"WITH {_CONTRIB} SELECT doc_id, CAST(sum(weight) AS BIGINT) AS score FROM f WHERE is_combi AND pass = 'folded_raw' GROUP BY doc_id")
def a03_combi_score(spark, d):
    return _found(spark, d).filter("is_combi AND pass = 'folded_raw'").groupBy("doc_id").agg(F.sum("weight").alias("score"))


@Q.add("a02_score_m1", f"WITH {_CONTRIB} SELECT doc_id, pass, CAST(sum(weight) AS BIGINT) AS score FROM f WHERE kind = 1 GROUP BY ALL")
def a02_score_m1(spark, d):
    return _found(spark, d).filter("kind = 1").groupBy("doc_id", "pass").agg(F.sum("weight").alias("score"))


@Q.add("a02_score_m2", f"WITH {_CONTRIB.replace('w * n', 'w')} SELECT doc_id, pass, CAST(sum(weight) AS BIGINT) AS score FROM f WHERE kind = 1 GROUP BY ALL")
def a02_score_m2(spark, d):
    return _found(spark, d, 2).filter("kind = 1").groupBy("doc_id", "pass").agg(F.sum("weight").alias("score"))


_CAT = f"{_CONTRIB}, c AS (SELECT doc_id, category, CAST(sum(weight) AS BIGINT) AS score FROM f WHERE kind = 1 AND weight > 0 AND category IS NOT NULL AND pass = 'folded_raw' GROUP BY ALL)"


def _categories(spark, d) -> DataFrame:
    return P.category_scores(_found(spark, d).filter("pass = 'folded_raw'"), ["doc_id"])


@Q.add("a04_category_score", f"WITH {_CAT} SELECT * FROM c")
def a04_category_score(spark, d):
    return _categories(spark, d)


@Q.add("w01_category_rank", f"WITH {_CAT} SELECT doc_id, category, score, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, category) AS rank FROM c")
def w01_category_rank(spark, d):
    return P.ranked_categories(_categories(spark, d), ["doc_id"])


@Q.add("w02_top_category", f"WITH {_CAT} SELECT doc_id, category, score FROM c QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, category) = 1")
def w02_top_category(spark, d):
    return P.ranked_categories(_categories(spark, d), ["doc_id"]).filter("rank = 1").drop("rank")


@Q.add("w03_category_threshold", f"WITH {_CAT} SELECT doc_id, string_agg(category, ', ' ORDER BY score DESC, category) AS categories FROM c WHERE score >= 40 GROUP BY doc_id")
def w03_category_threshold(spark, d):
    return P.category_text(_categories(spark, d), ["doc_id"], 40)


@Q.add("a12_category_string", f"WITH {_CAT} SELECT doc_id, string_agg(category, ', ' ORDER BY score DESC, category) AS categories FROM c GROUP BY doc_id")
def a12_category_string(spark, d):
    return P.category_text(_categories(spark, d), ["doc_id"])


@Q.add("a05_over_limit", f"WITH {_CONTRIB}, s AS (SELECT doc_id, pass, sum(weight) AS score FROM f WHERE kind = 1 GROUP BY ALL) SELECT DISTINCT doc_id FROM s WHERE score > {LIMIT}")
def a05_over_limit(spark, d):
    """Documents of which a pass is above the limit."""
    return a02_score_m1(spark, d).filter(F.col("score") > LIMIT).select("doc_id").distinct()


@Q.add("a06_merged_score", f"WITH {_CONTRIB}, s AS (SELECT doc_id, pass, CAST(sum(weight) AS BIGINT) AS score FROM f WHERE kind = 1 GROUP BY ALL) SELECT doc_id, coalesce(max(score) FILTER (score > 0), min(score)) AS score FROM s GROUP BY doc_id")
def a06_merged_score(spark, d):
    return a02_score_m1(spark, d).groupBy("doc_id").agg(P.merged_score(F.col("score")).alias("score"))


@Q.add("a10_duplicate_phrases", f"SELECT phrase, kind, w FROM {I.single_sql()}")
def a10_duplicate_phrases(spark, d):
    """The phrase base after its repeats are resolved."""
    return I.inline(spark, [(p.parts[0], p.kind, p.weight) for p in I.phrase_base().single()], "phrase string, kind int, w int")


@Q.add("a11_reason", f"WITH {_CONTRIB} SELECT doc_id, string_agg(CASE WHEN weight < 0 THEN '-' || label ELSE label END, '+' ORDER BY is_combi, CASE WHEN weight < 0 THEN '-' || label ELSE label END) AS reason FROM f WHERE kind = 1 AND pass = 'folded_raw' GROUP BY doc_id")
def a11_reason(spark, d):
    label = F.struct("is_combi", F.when(F.col("weight") < 0, F.concat(F.lit("-"), "label")).otherwise(F.col("label")).alias("l"))
    rows = _found(spark, d).filter("kind = 1 AND pass = 'folded_raw'").groupBy("doc_id").agg(F.array_sort(F.collect_list(label)).alias("a"))
    return rows.select("doc_id", F.array_join(F.transform("a", lambda x: x["l"]), "+").alias("reason"))


@Q.add("a13_banned_phrase", f"WITH {_CONTRIB} SELECT doc_id, max(label) AS phrase FROM f WHERE kind = 0 AND NOT is_combi GROUP BY doc_id")
def a13_banned_phrase(spark, d):
    return _found(spark, d).filter("kind = 0 AND NOT is_combi").groupBy("doc_id").agg(F.max("label").alias("phrase"))


@Q.add("j13_exception_anti", f"WITH {_CONTRIB} SELECT DISTINCT doc_id FROM f WHERE kind >= 0 AND doc_id NOT IN (SELECT doc_id FROM f WHERE kind = -1)")
def j13_exception_anti(spark, d):
    """Documents with hits and without an exception."""
    found = _found(spark, d).select("doc_id", "kind")
    return found.groupBy("doc_id").agg(F.min("kind").alias("k")).filter("k >= 0").select("doc_id")


_VERDICT = f"""{_CONTRIB}, v AS (SELECT doc_id, pass, max(label) FILTER (kind = -1 AND is_combi) AS ce, max(label) FILTER (kind = -1 AND NOT is_combi) AS e, max(label) FILTER (kind = 0 AND is_combi) AS cb,
 max(label) FILTER (kind = 0 AND NOT is_combi) AS b, CAST(coalesce(sum(weight) FILTER (kind = 1), 0) AS BIGINT) AS score,
 coalesce(string_agg(CASE WHEN weight < 0 THEN '-' || label ELSE label END, '+' ORDER BY is_combi, CASE WHEN weight < 0 THEN '-' || label ELSE label END) FILTER (kind = 1), '') AS w FROM f GROUP BY ALL),
 r AS (SELECT doc_id, pass, score, CASE WHEN ce IS NOT NULL THEN 1 WHEN e IS NOT NULL THEN 2 WHEN cb IS NOT NULL THEN 3 WHEN b IS NOT NULL THEN 4 WHEN score > {LIMIT} THEN 5 ELSE 6 END AS o,
 coalesce(ce, e, cb, b, CASE WHEN score > {LIMIT} THEN '{LIMIT} : ' || score || ' (' || w || ')' END, '') AS reason FROM v),
 k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY o, score DESC, pass) AS rn FROM r),
 m AS (SELECT doc_id, coalesce(max(score) FILTER (score > 0), min(score)) AS score FROM r GROUP BY doc_id),
 cs AS (SELECT doc_id, pass, category, sum(weight) AS s FROM f WHERE kind = 1 AND weight > 0 AND category IS NOT NULL GROUP BY ALL),
 ct AS (SELECT doc_id, pass, string_agg(category, ', ' ORDER BY s DESC, category) AS categories FROM cs GROUP BY ALL)
 SELECT d.doc_id, coalesce(['combination exception', 'exception', 'banned combination', 'banned', 'weighted', 'clean'][k.o], 'clean') AS outcome, coalesce(m.score, 0) AS score, coalesce(k.reason, '') AS reason, coalesce(ct.categories, '') AS categories
 FROM documents d LEFT JOIN k ON k.doc_id = d.doc_id AND k.rn = 1 LEFT JOIN m ON m.doc_id = d.doc_id LEFT JOIN ct ON ct.doc_id = k.doc_id AND ct.pass = k.pass"""


@Q.add("c02_phrases", f"WITH {_VERDICT}")
def c02_phrases(spark, d):
    """Outcome, score, reason and categories of every document by its phrases alone."""
    return P.score_texts(_documents(spark, d), "doc_id", "text", I.phrase_base(), LIMIT)


#: Links of documents as (log_id, url), the id made of the document's and the link's place, for the look-ups' SQL.
_LINKS = """(SELECT doc_id * 1000000 + i AS log_id, CASE WHEN regexp_matches(l[i], '(?i)^(?:https?|ftp)://') THEN l[i] WHEN starts_with(l[i], '/') THEN 'http://' || site || l[i] ELSE 'http://' || site || '/' || l[i] END AS url FROM
 (SELECT doc_id, site, list_concat(regexp_extract_all(text, '(?i)["'']((?:https?|ftp)://[^"'']*)["'']', 1), list_filter(regexp_extract_all(text, '(?i)(?:href|src)\\s*=\\s*["'']([^"'']*)["'']', 1), lambda x: NOT contains(x, '://'))) AS l FROM documents), unnest(generate_series(1, len(l))) g(i))"""


def _linked_sql() -> str:
    """CTEs of the links that lists ban: lk (log_id, list_name, item)."""
    from sieveline.plans import urls as R

    within = lambda sql: sql.replace(R._U, "links")
    return f"""links AS {_LINKS}, lb AS (SELECT log_id, 'bannedsite' AS list_name, item, category FROM {within(R._site_list('bannedsite'))} UNION ALL SELECT log_id, 'bannedurl', item, category FROM {within(R._URL_HITS('bannedurl'))}),
 lk AS (SELECT log_id, list_name, item FROM lb WHERE NOT coalesce(contains(category, 'ADs'), false) QUALIFY row_number() OVER (PARTITION BY log_id ORDER BY list_name) = 1)"""


def _weighed_sql() -> str:
    """The verdict with embedded urls, 10 for each, in the contributions of every pass."""
    weights = "lw AS (SELECT log_id // 1000000 AS doc_id, CAST(count(*) * 10 AS BIGINT) AS weight, '[' || string_agg(item, ' ' ORDER BY log_id, item) || ']' AS label FROM lk GROUP BY 1)"
    both = f"{_linked_sql()}, {weights}, f AS (SELECT * FROM f0 UNION ALL SELECT doc_id, pass, label, 1, false, weight, 'Embedded URLs' FROM lw, (VALUES ('folded_raw'), ('folded_smart')) p(pass))"
    return _VERDICT.replace(" f AS (SELECT doc_id, pass, phrase", " f0 AS (SELECT doc_id, pass, phrase").replace(", v AS (SELECT doc_id, pass, max(label)", f", {both}, v AS (SELECT doc_id, pass, max(label)")


def _page_links(spark, d, mode: int = 1) -> DataFrame:
    return link_weights(table(spark, d, "documents"), "doc_id", F.col("text"), _base(), table(spark, d, "rules_item"), 10, mode)


def _base() -> Column:
    return F.concat(F.lit("http://"), F.col("site"), F.lit("/"))


_LINKED_PAGES = [(1, '<a href="http://bad.example/x">', "a.example"), (2, "'http://shop.example/' <img src=\"/part/1\">", "y.example"), (3, '"http://bad.example/" "http://bad.example/2" <a href="part/2">', "y.example"), (4, "http://bad.example/", "a.example"), (5, None, None)]
_LINK_RULES = [("bannedsite", "bad.example", "B"), ("bannedsite", "shop.example", "ADs"), ("bannedurl", "y.example/part", None)]


@Q.add("a07_link_modes", f"SELECT id, weight, weight_2, label_2 FROM {I.values_sql([(1, 10, 10, '[bad.example]'), (2, 10, 10, '[y.example/part]'), (3, 30, 20, '[bad.example y.example/part]')], 'id, weight, weight_2, label_2')}")
def a07_link_modes(spark, d):
    """Weights of embedded urls for each hit, and in mode 2 for each different item; those of advertisements have none."""
    df = I.inline(spark, _LINKED_PAGES, "id int, html string, site string")
    rules = I.inline(spark, _LINK_RULES, "list_name string, item string, category string")
    one, two = (link_weights(df, "id", F.col("html"), _base(), rules, 10, mode) for mode in (1, 2))
    int_of = lambda c, n: F.col(c).cast("int").alias(n)
    return one.select("id", int_of("weight", "weight")).join(two.select("id", int_of("weight", "weight_2"), F.col("label").alias("label_2")), "id")


@Q.add("sf12_rewrite", """SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '(https?)://([a-z0-9.-]+)', '[\\2|\\1]', 'gi'), 'filter group', 'group', 'gi'), '\\bgroup (\\w+)', 'group <\\1>', 'gi'), 'jackpot', '', 'gi')) AS h FROM documents""")
def sf12_rewrite(spark, d):
    """Ordered replacements, each on the result of the one before."""
    return _documents(spark, d).select("doc_id", F.md5(X.rewrite(F.col("text"), I.REWRITES)).alias("h"))
