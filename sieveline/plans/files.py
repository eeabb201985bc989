"""Queries over list and option files, written by the query itself to the shared folder, and small functions."""

from __future__ import annotations


from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from sieveline.functions import logfields as L
from sieveline.functions import text as X
from sieveline.functions import url as U
from sieveline.operators import match as M
from sieveline.operators import scanners as SC
from sieveline.operators import verdict as V
from sieveline.operators.packed import split_packed
from sieveline.plans import inline as I
from sieveline.plans.access import _ONCE, _SITE, _TRIM, _values_sql, DENIED, log_once
from sieveline.plans.registry import QuerySet
from sieveline.plans.streams import shared_folder
from sieveline.plans.urls import _U, _urls
from sieveline.session import ship, table
from sieveline.sinks import log as K
from sieveline.sources import config as C
from sieveline.sources import http as H
from sieveline.sources import lists as S

Q = QuerySet()


def files(spark: SparkSession, **texts: str) -> dict[str, str]:
    """Paths of files with these texts; "@name" in a text stands for the path of a file named before."""
    ship(spark)
    root, paths = shared_folder(spark), {}
    for name, text in texts.items():
        for other, path in paths.items():
            text = text.replace("@" + other, path)
        paths[name] = f"{root}/{name}"
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(paths[name])
    return paths


_SITES = '#listcategory: "Ads"\n#time: 8 0 18 0 01234\nAds.Example.com  # why\nftp://files.example/\n# note\nx\nhttp://h.example:8080/a/\n**s\n.Include<@more>\n'
_MORE = 'more.example\n#listcategory:"More"\n'
_ITEMS = [("ads.example.com", "Ads", 8), ("files.example", "Ads", 8), ("h.example:8080/a", "Ads", 8), ("more.example", "More", None)]


@Q.add("s01_item_list", f"SELECT item, category, start_hour FROM {I.values_sql(_ITEMS, 'item, category, start_hour')}")
def s01_item_list(spark, d):
    """An item list with category, time limit, comments and an included list."""
    df, _ = S.read_items(spark, files(spark, more=_MORE, sites=_SITES)["sites"], "bannedsite")
    return df.select("item", "category", F.col("tl.sth").alias("start_hour"))


@Q.add("f02_blanket_flags", f"SELECT log_id, CASE WHEN starts_with(lower(url), 'https') AND NOT regexp_matches({_SITE}, '[a-zA-Z|]') THEN '*ips' END AS flag FROM {_U} WHERE {_SITE} IS NOT NULL")
def f02_blanket_flags(spark, d):
    """Requests that a list's flags ban as a whole."""
    _, flags = S.read_items(spark, files(spark, sites="*ips\nsome.example\n")["sites"], "bannedsite")
    host = L.site_key(F.col("url"))
    df = _urls(spark, d).filter(host.isNotNull())
    return df.select("log_id", M.blanket(flags, U.is_ip_host(host), F.lower("url").startswith("https")).alias("flag"))


_WEIGHTED = '#listcategory:"Games"\n<Raffle><10>\n<raffle><30>\n<a>,<b><5>\n<free>\n.Include<@inner>\n'
_INNER = "<inner><7>\n"


@Q.add("s05_phrase_base", f"SELECT phrase, type, weight, category FROM {I.values_sql([('fine', -1, 0, None), ('bad', 0, 0, None), ('free', 0, 0, 'Games'), ('raffle', 1, 30, 'Games'), ('inner', 1, 7, 'Games')], 'phrase, type, weight, category')}")
def s05_phrase_base(spark, d):
    """Phrase files of three kinds in one base, includes inheriting the category."""
    p = files(spark, inner=_INNER, weighted=_WEIGHTED, banned="<bad>\n", good="<fine>\n")
    return S.phrase_frame(spark, S.read_phrase_base(spark, p["good"], p["banned"], p["weighted"])).drop("ord")


@Q.add("s05_combi_base", f"SELECT combi_id, p1, p2, type, weight FROM {I.values_sql([(0, 'a', 'b', 12, 5)], 'combi_id, p1, p2, type, weight')}")
def s05_combi_base(spark, d):
    p = files(spark, inner=_INNER, weighted=_WEIGHTED)
    df = S.combi_frame(spark, S.read_phrase_base(spark, None, None, p["weighted"]))
    return df.select("combi_id", F.get("parts", F.lit(0)).alias("p1"), F.get("parts", F.lit(1)).alias("p2"), "type", "weight")


@Q.add("s04_phrase_lines", r"""WITH l AS (SELECT doc_id, i AS line, v[i] AS v FROM (SELECT doc_id, string_split_regex(text, '\r?\n') AS v FROM documents WHERE text IS NOT NULL), unnest(generate_series(1, len(v))) g(i)),
 m AS (SELECT *, CASE WHEN v LIKE '#%' THEN regexp_extract(v, '^#listcategory:\s*"([^"]*)"', 1) END AS c FROM l WHERE v LIKE '<%' OR v LIKE '#listcategory:%'),
 p AS (SELECT *, nullif(trim(last_value(c IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line)), '') AS category FROM m),
 e AS (SELECT doc_id, line, category, list_filter(regexp_extract_all(lower(regexp_extract(v, '^((?:<[^>]*>\s*,\s*)*<[^>]*>)', 1)), '<([^>]*)>', 1), lambda x: x <> '') AS parts,
 coalesce(TRY_CAST(regexp_extract(v, '^((?:<[^>]*>\s*,\s*)*<[^>]*>)(?:<\s*([+-]?\d+)\s*>)?', 2) AS INTEGER), 0) AS weight FROM p WHERE v LIKE '<%')
 SELECT doc_id, CAST(line AS INTEGER) AS line, list_transform(parts, lambda x: left(x, 126)) AS parts, weight, CASE WHEN weight = 0 THEN 0 ELSE 1 END AS kind, category FROM e WHERE len(parts) > 0""")
def s04_phrase_lines(spark, d):
    """Phrase lines of all list files among the documents, parsed where they lie."""
    return S.parse_list_texts(table(spark, d, "documents").select("doc_id", "text"), "doc_id", "text")


@Q.add("s06_processed_cache", "SELECT count(*) AS n, count(DISTINCT item) AS d FROM rules_item")
def s06_processed_cache(spark, d):
    """A long list written as Parquet and read back."""
    df = S.cached_items(spark, table(spark, d, "rules_item"), shared_folder(spark))
    return df.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("item").alias("d"))


@Q.add("s07_regex_list", f"SELECT ord, pattern, category FROM {I.values_sql([(0, 'first', None), (1, '(?#c)a|b', 'R'), (2, 'C+', 'R')], 'ord, pattern, category')}")
def s07_regex_list(spark, d):
    p = files(spark, one="first\n", main='#listcategory:"R"\n(?#c)a|b\n# note\nC+\n.Include<@one>\n')
    return I.inline(spark, [(r.ord, r.pattern, r.category) for r in S.read_regexes(spark, p["main"])], "ord int, pattern string, category string")


@Q.add("s08_replacement_list", f"SELECT ord, pattern, replacement FROM {I.values_sql([(0, '(a)b', '$1'), (1, 'c', '')], 'ord, pattern, replacement')}")
def s08_replacement_list(spark, d):
    p = files(spark, main='# rules\n"(a)b"->"$1"\n"c"->""\n')
    return I.inline(spark, [(r.ord, r.pattern, r.replacement) for r in S.read_regexes(spark, p["main"], True)], "ord int, pattern string, replacement string")


_IPS_OUT = [("ip", 167772161, 167772161, None), ("subnet", 167772160, 167772415, None), ("subnet", 167772160, 167776255, None), ("range", 167772161, 167772169, None), ("host", None, None, "pc.example")]


@Q.add("s09_ip_list", f"SELECT kind, lo, hi, host FROM {I.values_sql(_IPS_OUT, 'kind, lo, hi, host')}")
def s09_ip_list(spark, d):
    p = files(spark, main="10.0.0.1 # a\n10.0.0.0/255.255.255.0\n10.0.0.0/20\n10.0.0.1-10.0.0.9\nPC.example\n\n")
    return S.read_ips(spark, p["main"], "bannedip").select("kind", "lo", "hi", "host")


@Q.add("s10_ip_groups", f"SELECT kind, lo, grp FROM {I.values_sql([('ip', 167772161, 2), ('range', 167772162, 3)], 'kind, lo, grp')}")
def s10_ip_groups(spark, d):
    p = files(spark, main="# x\n10.0.0.1 = filter2\n10.0.0.2-10.0.0.9=filter3\nnonsense\n")
    return S.read_ip_groups(spark, p["main"]).select("kind", "lo", "grp")


@Q.add("s11_user_groups", f"SELECT user_name, grp FROM {I.values_sql([('anna', 2), ('bo', 1)], 'user_name, grp')}")
def s11_user_groups(spark, d):
    return S.read_user_groups(spark, files(spark, main="Anna=filter2\n#c=filter9\nbo=filter1\n")["main"])


@Q.add("s12_rooms", f"SELECT room, lo FROM {I.values_sql([('Hall', 167772161), ('Lab', 167772170), ('Lab', 167772171)], 'room, lo')}")
def s12_rooms(spark, d):
    p = files(spark, **{"rooms/a": "#Hall\n10.0.0.1\n", "rooms/b": "#Lab\n10.0.0.10\n10.0.0.11\n", "rooms/c": "10.0.0.12\n"})
    return S.read_rooms(spark, p["rooms/a"].removesuffix("a") + "*").select("room", "lo")


@Q.add("s13_options", f"SELECT loglevel, reportinglevel, urlcacheage, naughtynesslimit, plugname FROM {I.values_sql([(2, -1, 900, 160, 'scan')], 'loglevel, reportinglevel, urlcacheage, naughtynesslimit, plugname')}")
def s13_options(spark, d):
    """Main, group and plugin options with defaults, quotes and comments."""
    p = files(spark, main="loglevel = 2 # c\nloglevel = 3\nreportinglevel = '-1'\n", group="naughtynesslimit = 160\n", plugin="plugname = 'scan'\n")
    m, g, x = C.read_main(spark, p["main"]), C.read_group(spark, p["group"]), C.parse_plugin(S.lines(spark, p["plugin"]))
    return I.inline(spark, [(m.loglevel, m.reportinglevel, m.urlcacheage, g.naughtynesslimit, x["plugname"])], "loglevel int, reportinglevel int, urlcacheage int, naughtynesslimit int, plugname string")


@Q.add("s16_label_limits", f"SELECT name, n FROM {I.values_sql([('RSACsex', 2), ('Vancouversafety', -1)], 'name, n')}")
def s16_label_limits(spark, d):
    limits = S.read_label_limits(spark, files(spark, main="# l\nRSACsex = 2\nVancouversafety = -1  # -2 to 2\n")["main"])
    return I.inline(spark, list(limits.items()), "name string, n int")


@Q.add("s17_messages", f"SELECT key, text FROM {I.values_sql([(1, 'Access Denied'), (-5, '')], 'key, text')}")
def s17_messages(spark, d):
    """A message catalogue, and its look-up by key."""
    return S.read_messages(spark, files(spark, main='"1","Access Denied"\n"-5",""\nnothing\n')["main"])


@Q.add("j18_message_lookup", "SELECT log_id, CASE WHEN code = 403 THEN 'Access Denied' END AS text FROM " + _ONCE)
def j18_message_lookup(spark, d):
    messages = S.read_messages(spark, files(spark, main='"403","Access Denied"\n')["main"])
    return log_once(spark, d, "code").join(messages.withColumnRenamed("key", "code"), "code", "left").select("log_id", "text")


@Q.add("j16_category_ids", f"""WITH d AS (SELECT block_id, list_filter({_values_sql("url_decode(replace(categories, '+', '%2B'))")}, lambda x: x <> 'N/A') AS v FROM deny_redirects WHERE {_TRIM('categories')} NOT IN ('', '-')),
 e AS (SELECT block_id, CAST(unnest(generate_series(1, len(v))) AS INTEGER) AS pos, unnest(v) AS val FROM d WHERE len(v) > 0)
 SELECT block_id, pos, cat_id FROM e JOIN (SELECT category, min(cat_id) AS cat_id FROM category_names GROUP BY 1) ON val = category""")
def j16_category_ids(spark, d):
    """Ids of all known categories that a field packs, with their places in it."""
    names = table(spark, d, "category_names").groupBy("category").agg(F.min("cat_id").alias("cat_id"))
    denied = table(spark, d, "deny_redirects").select("block_id", "categories").filter(L.has_value(F.col("categories")))
    values = split_packed(denied, "categories", ["block_id"], DENIED, val="category")
    return values.join(names, "category").select("block_id", "pos", "cat_id")


@Q.add("s24_download_manager", f"""SELECT log_id, CASE WHEN lower(mimetype) IN ('video/mp4', 'application/zip') AND coalesce(regexp_matches(user_agent, 'Larkview'), false) THEN 'fancy' WHEN lower(mimetype) = 'image/png' THEN 'trickle' ELSE 'default' END AS manager FROM {_ONCE}""")
def s24_download_manager(spark, d):
    """The first manager that takes a download."""
    managers = [("fancy", "Larkview", ["video/mp4", "application/zip"], []), ("trickle", None, ["image/png"], [".iso"]), ("default", None, [], [])]
    df = log_once(spark, d, "user_agent", "mimetype")
    return df.select("log_id", M.first_manager(F.col("user_agent"), F.col("mimetype"), F.lit(None).cast("string"), managers).alias("manager"))


@Q.add("f09_own_server", f"SELECT log_id, starts_with(regexp_extract(lower(trim(url, ' ')), '^(?:[a-z]+://)?([^/]*)', 1), 'cdn.') AS own FROM {_U}")
def f09_own_server(spark, d):
    return _urls(spark, d).select("log_id", M.own_server(F.col("url"), "cdn.", 1).alias("own"))


@Q.add("f16_scan_exempt", f"SELECT log_id FROM {_ONCE} WHERE NOT coalesce(lower(mimetype) IN ('text/css', 'image/gif'), false) AND NOT coalesce(ends_with({_SITE}, '.invalid'), false)")
def f16_scan_exempt(spark, d):
    """Responses that are scanned: neither their site nor their type is on an exception list."""
    df = log_once(spark, d, "mimetype", L.site_key(F.col("url")).alias("site"))
    wants = SC.wants_scan(F.col("site").endswith(".invalid"), F.lit(False), F.lower("mimetype").isin("text/css", "image/gif"), F.lit(False))
    return df.filter(wants).select("log_id")


@Q.add("sf01_case", "SELECT doc_id, md5(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS l, md5(translate(text, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ')) AS u FROM documents")
def sf01_case(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(X.ascii_lower(F.col("text"))).alias("l"), F.md5(X.ascii_upper(F.col("text"))).alias("u"))


@Q.add("sf02_after_before", f"SELECT log_id, substr(url, strpos(url, '://') + 3) AS a, CASE WHEN contains(url, '?') THEN split_part(url, '?', 1) ELSE '' END AS b FROM {_U}")
def sf02_after_before(spark, d):
    return _urls(spark, d).select("log_id", X.after(F.col("url"), "://").alias("a"), X.before(F.col("url"), "?").alias("b"))


@Q.add("sf03_search", f"SELECT log_id, contains(url, 'img') AS c, strpos(url, '/') - 1 AS i, starts_with(lower(url), 'https') AS s, ends_with(url, '.js') AS e FROM {_U}")
def sf03_search(spark, d):
    u = F.col("url")
    return _urls(spark, d).select("log_id", u.contains("img").alias("c"), (F.instr(u, "/") - 1).cast("long").alias("i"), F.lower(u).startswith("https").alias("s"), u.endswith(".js").alias("e"))


@Q.add("sf04_white_space", "SELECT log_id, CASE WHEN trim(user_name, ' ' || chr(9) || chr(10) || chr(13)) = '' THEN user_name ELSE trim(user_name, ' ' || chr(9) || chr(10) || chr(13)) END AS u FROM " + _ONCE)
def sf04_white_space(spark, d):
    return log_once(spark, d, "user_name").select("log_id", X.remove_white_space(F.col("user_name")).alias("u"))


@Q.add("sf05_collapse", "SELECT doc_id, md5(regexp_replace(replace(text, 'the', 'a'), ' +', ' ', 'g')) AS h FROM documents")
def sf05_collapse(spark, d):
    """Runs of a character, and literal replacement (SF06)."""
    return table(spark, d, "documents").select("doc_id", F.md5(X.collapse(F.replace("text", F.lit("the"), F.lit("a")), " ")).alias("h"))


@Q.add("sf07_chop_lop", f"SELECT log_id, left(url, length(url) - 1) AS a, substr(url, 2) AS b, left(url, 10) AS c FROM {_U}")
def sf07_chop_lop(spark, d):
    return _urls(spark, d).select("log_id", X.chop(F.col("url")).alias("a"), X.lop(F.col("url")).alias("b"), F.left("url", F.lit(10)).alias("c"))


@Q.add("sf08_to_integer", "SELECT log_id, coalesce(TRY_CAST(regexp_extract(params, '^\\s*([+-]?\\d+)', 1) AS INTEGER), 0) AS n FROM (SELECT * FROM " + _ONCE + ") WHERE params IS NOT NULL")
def sf08_to_integer(spark, d):
    return log_once(spark, d, "params").filter("params IS NOT NULL").select("log_id", X.to_int(F.col("params")).alias("n"))


@Q.add("sf08_hex", f"SELECT log_id, CAST('0x' || h AS BIGINT) AS n FROM (SELECT log_id, regexp_extract(url, '[?&]s=([0-9a-f]+)', 1) AS h FROM {_U}) WHERE h <> ''")
def sf08_hex(spark, d):
    h = F.regexp_extract("url", "[?&]s=([0-9a-f]+)", 1)
    return _urls(spark, d).select("log_id", h.alias("h")).filter("h <> ''").select("log_id", X.hex_to_int(F.col("h")).alias("n"))


@Q.add("sf11_regex_groups", f"SELECT log_id, unnest(regexp_extract_all(url, '([?&])([a-z]+)=', 2)) AS name FROM {_U}")
def sf11_regex_groups(spark, d):
    """All matches of an expression's group."""
    return _urls(spark, d).select("log_id", F.explode_outer(F.regexp_extract_all("url", F.lit("(?is)([?&])([a-z]+)="), F.lit(2))).alias("name")).filter("name IS NOT NULL")


@Q.add("k11_store_blocked", f"SELECT naughty_type, count(*) AS n FROM {_ONCE} WHERE is_naughty GROUP BY 1")
def k11_store_blocked(spark, d):
    """Blocked rows written by kind and read back."""
    path = shared_folder(spark)
    K.store_blocked(log_once(spark, d, "naughty_type", "is_naughty", "url").filter("is_naughty"), path, "naughty_type")
    return spark.read.schema("log_id long, is_naughty boolean, url string, naughty_type int").parquet(path).groupBy("naughty_type").agg(F.count(F.lit(1)).alias("n"))
