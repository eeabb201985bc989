"""Further queries: operators by what is their own in code that they share with others."""

from __future__ import annotations

import zlib
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sieveline.functions import logfields as L
from sieveline.functions import text as X
from sieveline.functions import url as U
from sieveline.operators import match as M
from sieveline.operators import phrases as P
from sieveline.operators import verdict as V
from sieveline.plans import access, files, logs, pages, streams, urls
from sieveline.plans import inline as I
from sieveline.plans.access import log_once
from sieveline.plans.registry import QuerySet
from sieveline.session import table
from sieveline.sources import http as H
from sieveline.sources.lists import BANNED, EXCEPTION, WEIGHTED, Phrase, PhraseBase

Q = QuerySet()


_ORDER = [(1, "clean", "nothing"), (2, "weighted", "win win"), (3, "banned", "win win bad"), (4, "banned combination", "b1 bad b2"), (5, "exception", "b1 bad b2 fine"), (6, "combination exception", "fine e1 bad e2")]


@Q.add("c03_precedence", f"SELECT id, outcome FROM {I.values_sql([r[:2] for r in _ORDER], 'id, outcome')}")
def c03_precedence(spark, d):
    """The order in which findings decide."""
    base = PhraseBase([Phrase(("win",), WEIGHTED, 30), Phrase(("bad",), BANNED), Phrase(("b1", "b2"), BANNED), Phrase(("fine",), EXCEPTION), Phrase(("e1", "e2"), EXCEPTION)])
    rows = I.inline(spark, [(i, t) for i, _, t in _ORDER], "id int, t string")
    return P.score_texts(rows, "id", "t", base, 50).select("id", "outcome")


@Q.add("f10_exceptions", f"SELECT log_id, code FROM ({urls.Q.sql['c05_request_verdict']}) WHERE verdict = 'exception'")
def f10_exceptions(spark, d):
    """Requests that an exception lets pass, and by which."""
    return urls.c05_request_verdict(spark, d).filter("verdict = 'exception'").select("log_id", "code")


@Q.add("c05_timed_sites", f"""SELECT DISTINCT log_id FROM {urls._SUFFIX} s JOIN (SELECT lower(trim(item)) AS item, tl FROM rules_item WHERE list_name = 'bannedsite') r ON r.item = s.suffix
 JOIN (SELECT log_id, start_ts FROM {access._ONCE}) o USING (log_id) WHERE coalesce({logs._IN_TIME}, false)""")
def c05_timed_sites(spark, d):
    """Requests that a site rule bans at their own time: the verdict with time limits."""
    sites = table(spark, d, "rules_item").filter("list_name = 'bannedsite'")
    requests = urls._urls(spark, d, "ip", "client_host", "start_ts")
    out = V.request_verdicts(requests, "log_id", sites, table(spark, d, "rules_ip").filter(F.lit(False)), ts="start_ts")
    return out.filter("code = 500").select("log_id")


@Q.add("f17_grey_override", f"SELECT DISTINCT log_id FROM {urls._SUFFIX} s JOIN {urls._RULES('bannedsite')} r ON r.item = s.suffix WHERE log_id IN (SELECT log_id FROM {urls._SUFFIX} s JOIN {urls._RULES('greysite')} r ON r.item = s.suffix)")
def f17_grey_override(spark, d):
    """Requests whose banned site is on the grey list too."""
    rules = table(spark, d, "rules_item").filter("list_name IN ('bannedsite', 'greysite')")
    keyed = M.site_keys(urls._urls(spark, d), ["log_id"], L.site_key(F.col("url")))
    return V.hits_by_list(keyed, ["log_id"], rules).groupBy("log_id").agg(F.count(F.lit(1)).alias("n")).filter("n = 2").select("log_id")


@Q.add("j06_subnet_join", f"SELECT DISTINCT log_id, list_name FROM {urls._IPS} JOIN rules_ip ON kind = 'subnet' AND n & mask = lo & mask")
def j06_subnet_join(spark, d):
    """Subnets by their masks, as ranges."""
    rules = table(spark, d, "rules_ip").filter("kind = 'subnet'")
    low = F.col("lo").bitwiseAND(F.col("mask"))
    ranges = rules.select("list_name", low.alias("lo"), (low + (F.lit(0xFFFFFFFF) - F.col("mask"))).alias("hi"))
    return M.ip_hits(urls._addresses(spark, d), ["log_id"], U.ip_number(F.col("ip")), ranges, ["list_name"])


@Q.add("j12_regex_pairs", " UNION ALL ".join(f"SELECT log_id, {r.ord} AS ord FROM {urls._KEYED} WHERE regexp_matches(key, '(?is){r.pattern}')" for r in I.URL_REGEXES))
def j12_regex_pairs(spark, d):
    """Every pattern that a url matches; patterns stay literals, so no join is made and each is compiled once."""
    tests = [F.when(F.col("key").rlike("(?is)" + r.pattern), F.lit(r.ord)) for r in I.URL_REGEXES]
    keyed = urls._urls(spark, d).select("log_id", U.list_key(F.col("url")).alias("key"))
    return keyed.select("log_id", F.explode(F.array(*tests)).alias("ord")).filter("ord IS NOT NULL")


@Q.add("p09_hex_decode_url", f"SELECT log_id, url_decode(replace(url, '+', '%2B')) AS u FROM {urls._U}")
def p09_hex_decode_url(spark, d):
    return urls._urls(spark, d).select("log_id", X.percent_decode(F.col("url")).alias("u"))


@Q.add("p14_accept_encoding", f"SELECT id, enc FROM {I.values_sql([(1, 'gzip, deflate'), (2, 'identity'), (3, 'identity'), (4, 'gzip')], 'id, enc')}")
def p14_accept_encoding(spark, d):
    rows = [(1, "br, gzip;q=0.5, deflate"), (2, "br"), (3, None), (4, "GZIP")]
    return I.inline(spark, rows, "id int, a string").select("id", H.readable_encodings(F.col("a")).alias("enc"))


@Q.add("p15_one_host", f"SELECT id, names, first_line FROM {I.values_sql([(1, '-,Host,X-Ignored-Host,A', 'GET / HTTP/1.0'), (2, '-,A', 'GET / HTTP/1.0')], 'id, names, first_line')}")
def p15_one_host(spark, d):
    rows = [(1, "GET / HTTP/1.1\r\nHost: a\r\nHOST: b\r\nA: HTTP/1.1\r\n"), (2, "GET / HTTP/1.0\r\nA: x\r\n")]
    h = H.one_host(H.header_lines(F.col("block")))
    names = F.array_join(F.transform(h, lambda x: F.coalesce(x["name"], F.lit("-"))), ",")
    return I.inline(spark, rows, "id int, block string").select("id", names.alias("names"), F.get(h, F.lit(0))["value"].alias("first_line"))


@Q.add("p17_base64_user", "SELECT log_id, nullif(split_part(user_name, ':', 1), '') AS usr FROM " + access._ONCE)
def p17_base64_user(spark, d):
    """Users put in basic authorisation and read out again."""
    df = log_once(spark, d, "user_name")
    coded = F.concat(F.lit("Basic "), F.base64(F.encode(F.concat("user_name", F.lit(":pw")), "UTF-8")))
    line = F.array(F.struct(F.lit("Proxy-Authorization").alias("name"), coded.alias("value")))
    return df.select("log_id", H.basic_user(line).alias("usr"))


@Q.add("u01_list_union", "SELECT item FROM rules_item WHERE list_name = 'bannedsite' UNION SELECT item FROM rules_item WHERE list_name = 'greysite'")
def u01_list_union(spark, d):
    """Lists put together as includes are."""
    rules = table(spark, d, "rules_item")
    parts = [rules.filter(F.col("list_name") == n).select("item") for n in ("bannedsite", "greysite")]
    return reduce(DataFrame.unionByName, parts).distinct()


def _shown(name: str, columns: str, wanted: list[tuple]):
    """Registers a query over made rows with what it must give."""
    return Q.add(name, f"SELECT {columns} FROM {I.values_sql(wanted, columns)}" if wanted else None)


@Q.add("c10_content_rewrite", f"SELECT doc_id, {pages._REWRITTEN} <> text AS content_mod, octet_length(encode({pages._REWRITTEN})) AS n FROM documents WHERE text IS NOT NULL")
def c10_content_rewrite(spark, d):
    """Whether the replacements change a text, as the log tells, and the length that its header is set to."""
    new = X.rewrite(F.col("text"), I.REWRITES)
    df = table(spark, d, "documents").filter("text IS NOT NULL").select("doc_id", "text", new.alias("new"))
    return df.select("doc_id", (F.col("new") != F.col("text")).alias("content_mod"), F.octet_length("new").cast("long").alias("n"))


@_shown("f05_extension_in_list", "id, item", [(1, ".tar.gz"), (2, ".exe"), (4, ".gz"), (5, ".exe")])
def f05_extension_in_list(spark, d):
    """Extensions of disposition names before those of urls, the longest item first, urls with a query by their type."""
    rows = [(1, "http://h/a.TAR.GZ", None, None), (2, "http://h/a.gz", "Setup.EXE", None), (3, "http://h/a.exe?x", None, "text/html"), (4, "http://h/b.gz#top", None, None), (5, "http://h/a.exe?x", None, "application/x"), (6, "http://h/exe", None, None), (7, None, None, None)]
    df = I.inline(spark, rows, "id int, url string, disposition string, mimetype string")
    rules = I.inline(spark, [(".gz", None), (".tar.gz", None), (".exe", None)], "item string, category string")
    return M.extension_hits(df, ["id"], U.extension_source(F.col("url"), F.col("disposition"), F.col("mimetype")), rules).select("id", "item")


@_shown("f06_mime_in_list", "id, item", [(1, "text/html"), (2, "application/zip")])
def f06_mime_in_list(spark, d):
    """Types of header lines, without their parameters and case."""
    rows = [(1, "Content-Type: Text/HTML; charset=utf-8"), (2, "content-type: application/zip"), (3, "Content-Type: text/plain"), (4, "Host: text/html"), (5, None)]
    df = I.inline(spark, rows, "id int, block string")
    rules = I.inline(spark, [("text/html", None), ("APPLICATION/ZIP", None)], "item string, category string")
    return M.exact_hits(df, ["id"], H.content_type(H.header_lines(F.col("block"))), rules).select("id", "item")


@_shown("f18_bypass_token", "id, holds", [(1, True), (2, False), (3, False), (4, False), (5, False), (6, True), (7, True), (8, False), (9, False)])
def f18_bypass_token(spark, d):
    """Links and cookies that hold, and those of another address, url, time or domain."""
    from sieveline.operators import identity as ID

    ip, now = F.lit("10.0.0.1"), F.lit(100)
    url = F.lit("http://h.example/a?b=1")
    link = ID.bypass_token(url, "m", ip, F.lit(100))
    cookie = ID.bypass_cookie(F.lit("h.example"), "m", ip, F.lit(100))
    tests = [
        ID.bypass_holds(link, "m", ip, now), ID.bypass_holds(link, "m", F.lit("10.0.0.2"), now), ID.bypass_holds(F.replace(link, F.lit("b=1"), F.lit("b=2")), "m", ip, now), ID.bypass_holds(link, "m", ip, F.lit(101)), ID.bypass_holds(link, "n", ip, now),
        ID.cookie_holds(cookie, F.lit("h.example"), "m", ip, now), ID.cookie_holds(cookie, F.lit("www.h.example"), "m", ip, now), ID.cookie_holds(cookie, F.lit("g.example"), "m", ip, now), ID.cookie_holds(cookie, F.lit("h.example"), "m", ip, F.lit(101)),
    ]
    return spark.range(1).select(F.posexplode(F.array(*tests)).alias("id", "holds")).select((F.col("id") + 1).alias("id"), "holds")


@Q.add("sf15_cookies", f"SELECT log_id, upper(md5({access._SITE} || 'magic' || a || '1700000000')) || '1700000000' AS cookie, true AS holds FROM (SELECT *, {access._IP} AS a FROM {urls._U}) WHERE a IS NOT NULL AND {access._SITE} IS NOT NULL")
def sf15_cookies(spark, d):
    """Bypass cookies of every request's site."""
    from sieveline.operators import identity as ID

    df = log_once(spark, d, L.raw_value(F.col("url")).alias("url"), L.ip_key(F.col("ip")).alias("a")).withColumn("site", L.site_key(F.col("url"))).filter("a IS NOT NULL AND site IS NOT NULL")
    df = df.withColumn("cookie", ID.bypass_cookie(F.col("site"), "magic", F.col("a"), F.lit(1700000000)))
    return df.select("log_id", "cookie", ID.cookie_holds(F.col("cookie"), F.col("site"), "magic", F.col("a"), F.lit(1700000000)).alias("holds"))


@Q.add("sf15_scan_links", f"SELECT log_id, upper(md5(a || url || 'tf1' || coalesce(mimetype, '') || 'x%20y' || 'magic')) AS hash, true AS holds, false AS other FROM (SELECT *, {access._IP} AS a FROM {urls._U}) WHERE a IS NOT NULL")
def sf15_scan_links(spark, d):
    """Links to scanned downloads, held against their own and another address."""
    from sieveline.operators import identity as ID

    df = urls._urls(spark, d, L.ip_key(F.col("ip")).alias("a"), "mimetype").filter("a IS NOT NULL")
    df = df.withColumn("link", ID.scan_link(F.col("url"), "magic", F.col("a"), F.lit("tf1"), F.coalesce("mimetype", F.lit("")), F.lit("x y")))
    return df.select("log_id", F.regexp_extract("link", "GSBYPASS=([0-9A-F]{32})", 1).alias("hash"), ID.scan_link_holds(F.col("link"), "magic", F.col("a")).alias("holds"), ID.scan_link_holds(F.col("link"), "magic", F.lit("0.0.0.1")).alias("other"))


@Q.add("t06_token_expiry", f"SELECT log_id, log_id % 600 <= 300 AS alive FROM (SELECT log_id, {access._WHEN} AS s FROM {access._ONCE}) WHERE s IS NOT NULL AND log_id IS NOT NULL")
def t06_token_expiry(spark, d):
    """Tokens that carry their own expiry, 300 s after each request, looked at up to 600 s later."""
    from sieveline.streaming.state import token_alive

    s = L.epoch_seconds(F.col("when_txt"))
    df = log_once(spark, d, s.alias("s")).filter("s IS NOT NULL AND log_id IS NOT NULL")
    return df.select("log_id", token_alive(F.col("s") + 300, F.col("s") + F.col("log_id") % 600).alias("alive"))


@Q.add("f19_scan_gates", f"SELECT log_id, CASE WHEN size <= 2048000 THEN 'ram' WHEN size <= 20480000 THEN 'disk' ELSE 'unscanned' END AS gate FROM (SELECT log_id, size * 1000 AS size FROM {access._ONCE}) WHERE size IS NOT NULL")
def f19_scan_gates(spark, d):
    """Where bodies a thousand times the logged sizes are held for a scan, by the default limits."""
    df = log_once(spark, d, "size").filter("size IS NOT NULL")
    return df.select("log_id", V.scan_gate(F.col("size") * 1000).alias("gate"))


@_shown("f21_ads_exemption", "id, logged, linked", [(1, True, True), (2, False, False), (3, True, False), (4, False, False)])
def f21_ads_exemption(spark, d):
    """Advertisements are neither logged nor looked at as embedded urls."""
    from sieveline.sinks import log as K

    rows = [(1, "News", "http://news.example/"), (2, "ADs", "http://ads.example/"), (3, None, "http://none.example/"), (4, "ADs, News", "http://ads.example/x")]
    df = I.inline(spark, rows, "id int, category string, url string")
    rules = I.inline(spark, [("bannedsite", "news.example", "News"), ("bannedsite", "ads.example", "ADs")], "list_name string, item string, category string")
    linked = M.banned_links(df, ["id"], "url", rules).select("id", F.lit(True).alias("linked"))
    logged = K.admitted(3, F.lit(False), F.lit(False), F.col("category"), F.lit("text/html"))
    return df.select("id", logged.alias("logged")).join(linked, "id", "left").select("id", "logged", F.coalesce("linked", F.lit(False)).alias("linked"))


@_shown("f22_label_limits", "id, label, value", [(2, "s", 3), (3, "v", 9), (5, "s", 4)])
def f22_label_limits(spark, d):
    """Labels at and above the limits of a file, the first value of a label, and services that aren't the label's."""
    from sieveline.operators import labels as LB
    from sieveline.sources.lists import read_label_limits

    limits = read_label_limits(spark, files.files(spark, limits="# limits\nRSACsex = 2\nRSACviolence = 8 # high\n")["limits"])
    rows = [("rsac", label, limits.get(f"RSAC{name}", 99)) for label, name in (("s", "sex"), ("v", "violence"))]
    tag = lambda t: f'<meta http-equiv="pics-label" content=\'{t}\'>'
    page = [(1, tag('"http://www.rsac.org/" r (s 2 v 8)')), (2, tag('"http://www.rsac.org/" r (s 3 v 0)')), (3, tag('"http://www.rsac.org/" r (v 9)')), (4, tag('"http://www.icra.org/" r (s 9)')), (5, tag('rsac r (s 4) ') + tag("rsac r (v 1)")), (6, None)]
    out = LB.exceeded(I.inline(spark, page, "id int, html string"), "id", "html", I.inline(spark, rows, "service string, label string, max_level int"))
    return out.select("id", "label", "value")


@Q.add("k12_list_cache", "SELECT list_name, count(*) AS n, min(item) AS first FROM rules_item GROUP BY 1")
def k12_list_cache(spark, d):
    """Long lists written processed and read back, short ones read as they are: the same items."""
    from sieveline.plans.streams import shared_folder
    from sieveline.sources.lists import cached_items

    rules, root = table(spark, d, "rules_item").select("list_name", "item"), shared_folder(spark)
    names = ("bannedsite", "bannedurl", "greysite", "exceptionsite", "logsite", "logurl", "bannedextension", "bannedmimetype")
    parts = [cached_items(spark, rules.filter(F.col("list_name") == n), f"{root}/{n}", least=150) for n in names]
    rest = rules.filter(~F.col("list_name").isin(*names))
    return reduce(DataFrame.unionByName, [*parts, rest]).groupBy("list_name").agg(F.count(F.lit(1)).alias("n"), F.min("item").alias("first"))


@_shown("k14_replacement", "level, id, action", [(0, 1, "text"), (0, 2, "text"), (0, 3, "text"), (2, 1, "redirect"), (2, 2, "redirect"), (2, 3, "redirect"), (3, 1, "image"), (3, 2, "movie"), (3, 3, "page")])
def k14_replacement(spark, d):
    """Images and movies are replaced at the level of pages only."""
    from sieveline.sinks import log as K

    df = I.inline(spark, [(1, "image/GIF"), (2, "application/x-shockwave-flash"), (3, "text/html")], "id int, m string")
    each = [df.select(F.lit(level).alias("level"), "id", K.denial(level, F.col("m"), F.lit("p"), F.lit("r"))["action"].alias("action")) for level in (0, 2, 3)]
    return reduce(DataFrame.unionByName, each)


@_shown("s02_nested_include", "item, category, start_hour", [("top.example", "Top", 8), ("one.example", "One", None), ("two.example", None, 20)])
def s02_nested_include(spark, d):
    """Included lists keep their own category and time, and include others."""
    from sieveline.sources.lists import read_items

    p = files.files(spark, two="#time: 20 0 22 0 56\ntwo.example\n", one='#listcategory: "One"\none.example\n.Include<@two>\n', top='#listcategory: "Top"\n#time: 8 0 9 0 0\n.Include<@one>\ntop.example\n')
    return read_items(spark, p["top"], "bannedsite")[0].select("item", "category", F.col("tl.sth").alias("start_hour"))


@_shown("s03_phrase_list", "phrase, type, weight, category, start_hour", [("one", 1, 5, "A", None), ("Two", 0, 0, "A", 9), ("inner", 1, -3, "A", 9), ("last", 0, 0, "B", 9)])
def s03_phrase_list(spark, d):
    """A phrase list's lines in order: case up to a mark, category and time from theirs on, an include that inherits them."""
    from sieveline.sources.lists import read_phrases

    p = files.files(spark, inner="<INNER><-3>\n", main='#listcategory:"A"\n<ONE><5>\nno phrase\n#noconvert\n#time: 9 0 10 0 0\n<Two>\n.Include<@inner>\n#listcategory:"B"\n<last>\n')
    rows = [(x.parts[0], x.kind, x.weight, x.category, x.tl and x.tl[0]) for x in read_phrases(spark, p["main"]).phrases]
    return I.inline(spark, rows, "phrase string, type int, weight int, category string, start_hour int")


@_shown("s14_group_options", "name, value", [("naughtynesslimit", "50"), ("groupmode", "1"), ("embeddedurlweight", "7"), ("bad", "ConfigError")])
def s14_group_options(spark, d):
    """A group's options: the first line of a key, defaults, and values out of their range."""
    from sieveline.sources import config as C

    p = files.files(spark, group="naughtynesslimit = 50\nnaughtynesslimit = 60\nembeddedurlweight = '7'\n", bad="groupmode = 99\n")
    g = C.read_group(spark, p["group"])
    try:
        bad = str(C.read_group(spark, p["bad"]).groupmode)
    except C.ConfigError as e:
        bad = type(e).__name__
    rows = [(n, str(getattr(g, n))) for n in ("naughtynesslimit", "groupmode", "embeddedurlweight")]
    return I.inline(spark, [*rows, ("bad", bad)], "name string, value string")


@_shown("s15_plugin_options", "key, value", [("plugname", "clamd"), ("socket", "/run/s = x"), ("last", "2")])
def s15_plugin_options(spark, d):
    """A plugin's options: quotes, comments, delimiters within values, the last line of a key."""
    from sieveline.sources import config as C
    from sieveline.sources.lists import lines

    p = files.files(spark, plugin="# c = d\nplugname = 'clamd'\nsocket = \"/run/s = x\"\nlast = 1\nlast = 2\nnothing\n")
    return I.inline(spark, list(C.parse_plugin(lines(spark, p["plugin"])).items()), "key string, value string")


@_shown("s18_template", "id, page", [(1, "<h1>a&lt;b&gt;</h1>\n<p>why &amp; how</p> -OTHER-"), (2, "<h1></h1>\n<p></p> -OTHER-")])
def s18_template(spark, d):
    """A template file whose places are filled; unknown places stay, and nulls leave theirs empty."""
    from sieveline.sinks import log as K
    from sieveline.sources.lists import lines

    template = "\n".join(lines(spark, files.files(spark, page="<h1>-URL-</h1>\n<p>-REASON-</p> -OTHER-")["page"]))
    df = I.inline(spark, [(1, "a<b>", "why & how"), (2, None, None)], "id int, u string, r string")
    return df.select("id", K.block_page(template, URL=F.col("u"), REASON=F.col("r")).alias("page"))


@_shown("s19_header_lines", "pos, name, value", [(0, None, "GET / HTTP/1.0"), (1, "Host", "h:80"), (2, "X-Empty", ""), (3, "Cookie", "a=1; b: 2")])
def s19_header_lines(spark, d):
    """Lines of a header block: the first has no name, values keep their colons."""
    df = I.inline(spark, [("GET / HTTP/1.0\r\nHost: h:80\r\nX-Empty:\r\nCookie: a=1; b: 2\r\n",)], "block string")
    return df.select(F.posexplode(H.header_lines(F.col("block"))).alias("pos", "h")).select("pos", "h.name", "h.value")


@Q.add("sf06_replace_all", "SELECT doc_id, md5(replace(replace(text, '.', '$1'), '$1 ', '[\\.]')) AS h FROM documents")
def sf06_replace_all(spark, d):
    """Literal replacement, of marks that mean something in patterns too."""
    return table(spark, d, "documents").select("doc_id", F.md5(F.replace(F.replace("text", F.lit("."), F.lit("$1")), F.lit("$1 "), F.lit("[\\.]"))).alias("h"))


@Q.add("sf10_url_functions", f"SELECT log_id, regexp_replace(url_decode(replace(url, '+', '%2B')), '^(?:http|https|ftp)://', '') AS bare, split_part(regexp_extract(url_decode(replace(url, '+', '%2B')), '^(?:[^:/?#]*://)?(?:[^/@]*@)?([^/]*)', 1), ':', 1) AS name FROM {urls._U}")
def sf10_url_functions(spark, d):
    """Decoding, then protocol and host, one on the other."""
    u = X.percent_decode(F.col("url"))
    return urls._urls(spark, d).select("log_id", U.strip_protocol(u).alias("bare"), F.substring_index(U.host_name(u), ":", 1).alias("name"))


@Q.add("sf13_quick_search", "SELECT doc_id, strpos(text, 'proxy') AS at, CAST((length(text) - length(replace(text, 'proxy', ''))) / 5 AS BIGINT) AS n FROM documents WHERE text IS NOT NULL")
def sf13_quick_search(spark, d):
    """First place and number of one phrase in each text."""
    df = table(spark, d, "documents").filter("text IS NOT NULL")
    return df.select("doc_id", F.instr("text", "proxy").cast("long").alias("at"), X.overlapping_count(F.col("text"), "proxy").cast("long").alias("n"))


@_shown("t10_rule_freshness", "id, item", [(1, "old.example"), (4, "new.example")])
def t10_rule_freshness(spark, d):
    """A stream whose rules change between two batches: each is judged by the rules as they are when it comes."""
    from sieveline.plans.streams import shared_folder
    from sieveline.sources.lists import read_items
    from sieveline.streaming import streams as S

    root = shared_folder(spark)
    put = lambda path, rows, schema: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").format("text" if schema == "value string" else "parquet").save(path)
    rules = S.Rules([f"{root}/rules"], lambda s: {"sites": read_items(s, f"{root}/rules", "bannedsite")[0]})
    judge = lambda batch, t: M.site_hits(batch, ["id"], F.col("host"), t["sites"]).select("id", "item")

    def run() -> None:
        stream = spark.readStream.schema("id int, host string").parquet(f"{root}/in")
        S.judged(stream, rules, judge, f"{root}/out", f"{root}/state").awaitTermination()

    put(f"{root}/rules", [("old.example",)], "value string")
    put(f"{root}/in", [(1, "old.example"), (2, "new.example")], "id int, host string")
    run()
    spark.createDataFrame([("new.example",)], "value string").coalesce(1).write.mode("overwrite").text(f"{root}/rules")
    put(f"{root}/in", [(3, "old.example"), (4, "new.example")], "id int, host string")
    run()
    if rules.loads != 2:
        raise RuntimeError("the rules were read otherwise than once for each of their versions")
    return spark.read.parquet(f"{root}/out").select("id", "item")


@_shown("u02_phrase_union", "kind, n", [(-1, 2), (0, 1), (1, 2)])
def u02_phrase_union(spark, d):
    """Three phrase files in one base: a phrase on several lists counts once, as the strictest."""
    from sieveline.sources.lists import phrase_frame, read_phrase_base

    p = files.files(spark, good="<fine>\n<both>\n", bad="<bad>\n<both>\n", weighted="<bad><9>\n<w1><1>\n<w2><2>\n")
    return phrase_frame(spark, read_phrase_base(spark, p["good"], p["bad"], p["weighted"])).groupBy(F.col("type").alias("kind")).agg(F.count(F.lit(1)).cast("int").alias("n"))


@Q.add("u04_combi_intersect", "SELECT doc_id FROM documents WHERE contains(text, 'proxy') INTERSECT SELECT doc_id FROM documents WHERE contains(text, 'filter') INTERSECT SELECT doc_id FROM documents WHERE contains(text, 'group')")
def u04_combi_intersect(spark, d):
    """Documents that have all three parts: the set of a combination, by counts of its parts in one pass."""
    base = PhraseBase([Phrase(("proxy", "filter", "group"), BANNED)])
    hits = P.phrase_hits(table(spark, d, "documents").select("doc_id", "text"), ["doc_id"], "text", base.needles())
    return P.combi_hits(hits, ["doc_id"], base).select("doc_id")


@Q.add("w04_first_match", f"SELECT log_id, CASE WHEN regexp_matches(key, 'img') THEN 0 WHEN regexp_matches(key, '[.]js') THEN 1 WHEN regexp_matches(key, '/') THEN 2 END AS a, CASE WHEN regexp_matches(key, '/') THEN 2 WHEN regexp_matches(key, '[.]js') THEN 1 WHEN regexp_matches(key, 'img') THEN 0 END AS z FROM {urls._KEYED}")
def w04_first_match(spark, d):
    """Of several patterns that match, the one that comes first in the list: the same list in two orders."""
    key = U.list_key(F.col("url"))
    patterns = ["img", "[.]js", "/"]
    rules = [I.Regex(k, p) for k, p in enumerate(patterns)]
    back = [I.Regex(len(patterns) - 1 - k, p) for k, p in enumerate(patterns)]
    return urls._urls(spark, d).select("log_id", M.first_regex(key, rules).alias("a"), (len(patterns) - 1 - M.first_regex(key, back)).alias("z"))


@_shown("x07_plugins", "kind, name, answer", [("scanner", "clamd", "1"), ("scanner", "signature", "0"), ("auth", "proxy-basic", "user"), ("auth", "ident", "stjohns"), ("none", "nothing", "KeyError")])
def x07_plugins(spark, d):
    """Plugins of several kinds by the names that option files give them."""
    from sieveline.operators.plugins import configured
    from sieveline.sources.config import parse_plugin

    named = lambda kind, name: configured(kind, parse_plugin([f"plugname = '{name}'"]))
    lines = H.header_lines(F.lit("Proxy-Authorization: Basic dXNlcjpwdw=="))
    answers = [
        ("scanner", "clamd", named("scanner", "clamd")(F.lit("/tf1: Test-V FOUND"))["code"].cast("string")), ("scanner", "signature", named("scanner", "signature")(F.lit("nothing"))["code"].cast("string")),
        ("auth", "proxy-basic", named("auth", "proxy-basic")(lines)), ("auth", "ident", named("auth", "ident")(F.lit("6193, 23 : USERID : UNIX : stjohns"))),
    ]
    try:
        named("scanner", "nothing")
    except KeyError as e:
        answers.append(("none", "nothing", F.lit(type(e).__name__)))
    each = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(n).alias("name"), a.alias("answer")) for k, n, a in answers])
    return spark.range(1).select(F.inline(each))


_REPLIES = [
    (1, "clamd", "/a/tf1: Eicar-Test FOUND\n"), (2, "clamd", "/a/tf1: OK"), (3, "clamd", "/a/tf1: lstat() failed. ERROR"), (4, "avastd", "/a\t[+]\r\n/b\t[L]\tV1\r\n/c\t[L]\tV2\r\n\r\n"), (5, "avastd", "/a\t[+]\r\n\r\n"), (6, "avastd", "/a\t[E]\tzip\r\n\r\n"),
    (7, "avastd", "/a\t[+]\r\n"), (8, "avastd", "no status\r\n\r\n"), (9, "kavd", "200 clean\r\n"), (10, "kavd", "322-V1 x\r\n322-V2 y\r\n201 end\r\n"), (11, "kavd", "500 error"), (12, "clamd", None), (13, "avastd", None), (14, "kavd", None),
]


@_shown("x04_daemon_replies", "id, code, name", [(1, 1, "Eicar-Test"), (2, 0, None), (3, -1, None), (4, 1, "V1 V2"), (5, 0, None), (6, 3, "Encrypted"), (7, -1, None), (8, -1, None), (9, 0, None), (10, 1, "V1 V2"), (11, -1, None), (12, -1, None), (13, -1, None), (14, -1, None)])
def x04_daemon_replies(spark, d):
    """Recorded replies of three scanner daemons as results."""
    from sieveline.operators import scanners as SC

    df = I.inline(spark, _REPLIES, "id int, kind string, reply string")
    each = [df.filter(F.col("kind") == k).select("id", SC.scanner(k)(F.col("reply")).alias("r")) for k in ("clamd", "avastd", "kavd")]
    return reduce(DataFrame.unionByName, each).select("id", "r.code", "r.name")


@Q.add("x01_signatures", "SELECT doc_id, CASE WHEN contains(text, 'jackpot') THEN 'J' WHEN contains(text, 'proxy') THEN 'P' WHEN contains(text, 'raffle') THEN 'R' END AS name FROM documents WHERE contains(text, 'jackpot') OR contains(text, 'proxy') OR contains(text, 'raffle')")
def x01_signatures(spark, d):
    """The first of several signatures that a text has, by a scanner from the registry."""
    from sieveline.operators import scanners as SC

    scan = SC.scanner("signature")
    found = scan(F.col("text"), (("jackpot", "J"), ("proxy", "P"), ("raffle", "R")))
    return table(spark, d, "documents").select("doc_id", found.alias("r")).filter(F.col("r.code") == SC.INFECTED).select("doc_id", "r.name")


def _ntlm(user: str) -> str:
    import base64
    import struct

    raw = user.encode("utf-16-le")
    head = b"NTLMSSP\0" + struct.pack("<I", 3) + b"\0" * 24 + struct.pack("<HHI", len(raw), len(raw), 72) + b"\0" * 16 + struct.pack("<I", 1)
    return base64.b64encode(head.ljust(72, b"\0") + raw).decode()


@_shown("x05_auth_users", "id, usr", [(1, "user"), (2, "mufasa"), (3, None), (4, None), (5, "Zoë"), (6, None), (7, None)])
def x05_auth_users(spark, d):
    """Users of basic, digest and NTLM authorisation."""
    rows = [
        (1, "Proxy-Authorization: Basic dXNlcjpwdw=="), (2, 'Proxy-Authorization: Digest username="mufasa", realm="x"'), (3, "Host: h"), (4, "Proxy-Authorization: Basic !!"), (5, "Proxy-Authorization: NTLM " + _ntlm("Zoë")),
        (6, "Proxy-Authorization: NTLM TlRMTVNTUAABAAAA"), (7, None),
    ]
    h = H.header_lines(F.col("block"))
    return I.inline(spark, rows, "id int, block string").select("id", F.coalesce(H.basic_user(h), H.digest_user(h), H.ntlm_user(h)).alias("usr"))


@_shown("x05_ident_users", "id, usr", [(1, "stjohns"), (2, None), (3, "a b"), (4, None)])
def x05_ident_users(spark, d):
    """Users of recorded ident replies."""
    rows = [(1, "6193, 23 : USERID : UNIX : stjohns\r\n"), (2, "6195, 23 : ERROR : NO-USER"), (3, "1,2:USERID:OTHER: a b "), (4, None)]
    return I.inline(spark, rows, "id int, reply string").select("id", H.ident_user(F.col("reply")).alias("usr"))


@Q.add("sf17_reverse_dns", f"""WITH n AS (SELECT {access._IP} AS ip, min(lower(client_host)) AS host FROM {access._ONCE} WHERE {access._TRIM('client_host')} NOT IN ('', '-') GROUP BY 1 HAVING ip IS NOT NULL)
 SELECT log_id, coalesce(lower(client_host), host) AS client FROM (SELECT log_id, CASE WHEN {access._TRIM('client_host')} NOT IN ('', '-') THEN client_host END AS client_host, {access._IP} AS ip FROM {access._ONCE}) LEFT JOIN n USING (ip)""")
def sf17_reverse_dns(spark, d):
    """Names of clients without one by a table of addresses, here of what the log knows of each."""
    from sieveline.operators.identity import reverse_names

    log = log_once(spark, d, L.ip_key(F.col("ip")).alias("ip"), L.raw_value(F.col("client_host")).alias("client_host"))
    dns = log.filter("client_host IS NOT NULL").groupBy("ip").agg(F.min(F.lower("client_host")).alias("host"))
    named = reverse_names(log.filter("client_host IS NULL"), ["log_id"], F.col("ip"), dns)
    return log.join(named, "log_id", "left").select("log_id", F.coalesce(F.lower("client_host"), "name").alias("client"))


@_shown("sf17_reverse_sites", "id, item", [(1, "bad.example"), (3, "bad.example")])
def sf17_reverse_sites(spark, d):
    """Sites asked for by their address, looked up by all names that a table gives it."""
    from sieveline.operators.identity import reverse_names

    df = I.inline(spark, [(1, "http://10.0.0.1/x"), (2, "http://10.0.0.2/"), (3, "http://www.bad.example/"), (4, "http://10.0.0.9/")], "id int, url string").withColumn("host", L.site_key(F.col("url")))
    dns = I.inline(spark, [("10.0.0.1", "Other.example."), ("10.0.0.1", "a.Bad.example"), ("10.0.0.2", "fine.example"), (None, "bad.example")], "ip string, host string")
    names = df.select("id", "host").unionByName(reverse_names(df, ["id"], F.col("host"), dns).withColumnRenamed("name", "host"))
    rules = I.inline(spark, [("bad.example", None)], "item string, category string")
    return M.site_hits(names, ["id"], F.col("host"), rules).select("id", "item")


@Q.add("s21_default_manager", f"""SELECT log_id, CASE WHEN size <= 2048000 THEN 'ram' WHEN size <= 20480000 THEN 'disk' ELSE 'unscanned' END AS held, size <= 262144 AS filtered, size > 2048000 AND size <= 20480000 AS spilled FROM (SELECT log_id, size * 300 AS size FROM {access._ONCE}) WHERE size IS NOT NULL""")
def s21_default_manager(spark, d):
    """What the default manager does with bodies of 300 times the logged sizes: where they are held, and whether they are filtered."""
    from sieveline.sources.config import MainOptions

    o, size = MainOptions(), F.col("size") * 300
    held = V.scan_gate(size, o.maxcontentramcachescansize, o.maxcontentfilecachescansize)
    df = log_once(spark, d, "size").filter("size IS NOT NULL")
    return df.select("log_id", held.alias("held"), (size <= o.maxcontentfiltersize * 1024).alias("filtered"), (held == "disk").alias("spilled"))


@Q.add("s20_body_scan", "SELECT doc_id, CASE WHEN lang = 'en' THEN 'fancy' ELSE 'default' END AS manager, md5(text) AS h FROM documents WHERE text IS NOT NULL")
def s20_body_scan(spark, d):
    """Bodies sent compressed, read by the first manager that takes them, the last one by default."""
    @F.pandas_udf(T.BinaryType())
    def sent(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: zlib.compress(t.encode("utf-8")))

    managers = [("fancy", "^browser", ["lang/en"], []), ("default", None, [], [])]
    df = table(spark, d, "documents").filter("text IS NOT NULL").select("doc_id", F.concat(F.lit("lang/"), F.coalesce("lang", F.lit("none"))).alias("mimetype"), sent("text").alias("b"))
    manager = M.first_manager(F.lit("browser 1"), F.when(F.col("mimetype") == "lang/en", F.col("mimetype")).otherwise(F.lit("other/x")), F.lit(None).cast("string"), managers)
    return df.select("doc_id", manager.alias("manager"), F.md5(H.inflate("b", F.lit("deflate"))).alias("h"))


@Q.add("k13_alert_reports", f"""WITH v AS (SELECT u, s, log_id, url, row_number() OVER (PARTITION BY u ORDER BY s, log_id) AS k FROM (SELECT {access._USER} AS u, s, log_id, url FROM {streams._REQ} WHERE is_naughty) WHERE u IS NOT NULL)
 SELECT u, min(s) AS first, max(s) AS last, string_agg(coalesce(url, '-'), chr(10) ORDER BY k) AS report FROM v GROUP BY u, (k - 1) // 3 HAVING count(*) = 3 AND max(s) - min(s) <= 86400""")
def k13_alert_reports(spark, d):
    """A report for each alert of a09_violations, with the denied urls that made it; no mail is sent."""
    from sieveline.streaming.state import violation_reports

    df = log_once(spark, d, L.user_key(F.col("user_name")).alias("u"), L.epoch_seconds(F.col("when_txt")).alias("s"), "is_naughty", "url").filter("is_naughty AND s IS NOT NULL")
    return violation_reports(df, "u", "s", ["log_id"], F.coalesce("url", F.lit("-")), 3, 86_400)
