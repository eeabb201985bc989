"""Queries over urls: parts, checks, list look-ups, verdicts on requests and downloads, rewriting."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.functions import logfields as L
from sieveline.functions import text as X
from sieveline.functions import url as U
from sieveline.operators import match as M
from sieveline.operators import verdict as V
from sieveline.operators.identity import bypass_holds, bypass_token
from sieveline.plans import inline as I
from sieveline.plans.access import _IP, _ONCE, _SITE, _TRIM, log_once
from sieveline.plans.registry import QuerySet
from sieveline.session import table
from sieveline.sinks.log import params_column
from sieveline.sources import http as H
from sieveline.sources.lists import WEIGHTED, Phrase, PhraseBase

Q = QuerySet()


def _urls(spark: SparkSession, d: str, *more: str) -> DataFrame:
    """(log_id, url) of the log's records with a url."""
    return log_once(spark, d, "url", *more).filter(L.has_value(F.col("url")))


_U = f"(SELECT * FROM {_ONCE} WHERE {_TRIM('url')} NOT IN ('', '-'))"
_HOST7 = r"regexp_extract(url, '^(?:[^:/?#]*://)?(?:[^/@]*@)?([^/]*)', 1)"


@Q.add("p06_hostname", f"SELECT log_id, {_HOST7} AS host FROM {_U}")
def p06_hostname(spark, d):
    return _urls(spark, d).select("log_id", U.host_name(F.col("url")).alias("host"))


@Q.add("p07_strip_protocol", f"SELECT log_id, regexp_replace(url, '^(?:http|https|ftp)://', '') AS u FROM {_U}")
def p07_strip_protocol(spark, d):
    return _urls(spark, d).select("log_id", U.strip_protocol(F.col("url")).alias("u"))


_PATHS = [("/a/./b",), ("/a/../b/",), ("//x//y",), ("/../..",), ("/plain/path",), ("/a/b/../../c/.",), ("a/b/..",), ("",), ("/",), ("/x/..%2e/y",), ("/...",)]
_REAL = [("/a/./b", "/a/b"), ("/a/../b/", "/b/"), ("//x//y", "/x/y"), ("/../..", "/"), ("/plain/path", "/plain/path"), ("/a/b/../../c/.", "/c/"), ("a/b/..", "a/"), ("", ""), ("/", "/"), ("/x/..%2e/y", "/x/..%2e/y"), ("/...", "/...")]


@Q.add("p08_real_path", f"SELECT path, real FROM {I.values_sql(_REAL, 'path, real')}")
def p08_real_path(spark, d):
    """Paths with dots and doubled slashes resolved."""
    return I.inline(spark, _PATHS, "path string").select("path", U.real_path(F.col("path")).alias("real"))


_KEY = r"""regexp_replace(regexp_replace(regexp_replace(regexp_extract(k, '^([^/?]*)', 1), ':\d*$', ''), '\.$', '') || url_decode(replace(replace(regexp_extract(regexp_extract(k, '^[^/?]*(.*)$', 1), '^([^?]*)', 1), '+', '%2B'), '//', '/')) || regexp_extract(k, '^[^?]*(.*)$', 1), '/+$', '')"""
_KEYED = f"(SELECT *, {_KEY} AS key FROM (SELECT *, regexp_replace(regexp_replace(lower({_TRIM('url')}), '^(?:http|https|ftp)://', ''), '^[^/@]*@', '') AS k FROM {_U}))"


@Q.add("p12_url_key", f"SELECT log_id, key FROM {_KEYED}")
def p12_url_key(spark, d):
    return _urls(spark, d).select("log_id", U.list_key(F.col("url")).alias("key"))


_REQUESTS = [
    (1, "GET", "/a/b", "Host.Example"), (2, "GET", "http://h.example.:80/x", None), (3, "CONNECT", "s.example:443", None), (4, "GET", "http://u:p@h.example:8080/x", None), (5, "GET", "http://h.example", None), (6, "POST", "/p", "h.example:80"),
]
_CANON = [(1, "http://Host.Example/a/b"), (2, "http://h.example/x"), (3, "https://s.example/"), (4, "http://u:p@h.example:8080/x"), (5, "http://h.example/"), (6, "http://h.example/p")]


@Q.add("p11_canonical_url", f"SELECT req_id, url FROM {I.values_sql(_CANON, 'req_id, url')}")
def p11_canonical_url(spark, d):
    """The url of each form of request line."""
    df = I.inline(spark, _REQUESTS, "req_id int, method string, target string, host string")
    return df.select("req_id", U.canonical(F.col("target"), F.col("host"), F.col("method")).alias("url"))


_CODED = [(1, "%41%2d%7A%30"), (2, "%%341"), (3, "a%2Fb%20c%"), (4, "%4"), (5, "plain"), (6, "%2541"), (7, "%C3%A9%61"), (8, "")]
_SAFE = ["A-z0", "%41", "a%2Fb%20c%", "%4", "plain", "%2541", "%C3%A9a", ""]


@Q.add("p10_safe_fixture", f"SELECT id, u FROM {I.values_sql([(k, v) for (k, _), v in zip(_CODED, _SAFE)], 'id, u')}")
def p10_safe_fixture(spark, d):
    """Codes of letters, digits and hyphens only, each decoded once."""
    return I.inline(spark, _CODED, "id int, t string").select("id", X.safe_decode(F.col("t")).alias("u"))


# codes one by one in the order of their places, each looked at once
@Q.add("p10_decode_safe", f"""SELECT log_id, array_to_string(list_transform(regexp_extract_all(url, '(?i)%(?:3[0-9]|4[1-9a-f]|5[0-9a]|6[1-9a-f]|7[0-9a]|2d)|%|[^%]+', 0), lambda x: CASE WHEN length(x) = 3 AND starts_with(x, '%') THEN url_decode(x) ELSE x END), '') AS u FROM {_U}""")
def p10_decode_safe(spark, d):
    """Only letters, digits and hyphens decoded; other codes stay."""
    return _urls(spark, d).select("log_id", X.safe_decode(F.col("url")).alias("u"))


@Q.add("p16_extension", rf"""SELECT log_id, nullif(regexp_extract(lower(split_part(split_part(url, '?', 1), '#', 1)), '^[^:]*://[^/]+/.*?(\.[^./?]+)$', 1), '') AS ext FROM {_U}
 WHERE NOT contains(url, '?') OR contains(lower(mimetype), 'application/')""")
def p16_extension(spark, d):
    """Extension that a response is judged by, where there is a source for it."""
    df = _urls(spark, d, "mimetype").withColumn("name", U.extension_source(F.col("url"), F.lit(None).cast("string"), F.col("mimetype")))
    return df.filter("name IS NOT NULL").select("log_id", U.extension(F.col("name")).alias("ext"))


@Q.add("p18_display_url", f"SELECT log_id, CASE WHEN length(url) > 40 THEN left(url, 40) || '...' ELSE url END AS shown FROM {_U}")
def p18_display_url(spark, d):
    return _urls(spark, d).select("log_id", X.display_url(F.col("url")).alias("shown"))


@Q.add("f03_ip_host", f"SELECT log_id, NOT regexp_matches({_SITE}, '[a-zA-Z|]') AS is_ip FROM {_U} WHERE {_SITE} IS NOT NULL")
def f03_ip_host(spark, d):
    host = L.site_key(F.col("url"))
    return _urls(spark, d).filter(host.isNotNull()).select("log_id", U.is_ip_host(host).alias("is_ip"))


_BAD = [
    (1, "http://0x7f.0.0.1/", True), (2, "http://0300.168.1.1/", True), (3, "http://192.168.1.300/", True), (4, "http://a..b/", True), (5, "http://host.example./", True), (6, "http://ho st/", True), (7, "http://h/", True),
    (8, "http://3232235777/", True), (9, "http://192.168.1.1:80/", False), (10, "http://host.example:8080/x", False), (11, "http://face.example/", False), (12, "http://under_score.example/", False), (13, "http://0xcafe.beef/", False),
]


@Q.add("f04_malformed_fixture", f"SELECT id, bad FROM {I.values_sql(_BAD, 'id, url, bad')}")
def f04_malformed_fixture(spark, d):
    return I.inline(spark, [r[:2] for r in _BAD], "id int, url string").select("id", U.malformed(F.col("url")).alias("bad"))


@Q.add("f04_malformed", rf"""SELECT log_id, length(full_) < 2 OR contains(h, '..') OR h LIKE '%.' OR regexp_matches(h, '[^A-Za-z0-9._-]') AS bad
 FROM (SELECT log_id, regexp_extract(url, '://([^/]*)', 1) AS full_, regexp_extract(regexp_extract(url, '://([^/]*)', 1), '^([^:]*)', 1) AS h FROM {_U})""")
def f04_malformed(spark, d):
    return _urls(spark, d).select("log_id", U.malformed(F.col("url")).alias("bad"))


_RULES = lambda n: f"(SELECT lower(trim(item)) AS item, min(category) AS category FROM rules_item WHERE list_name = '{n}' GROUP BY 1)"
_SUFFIX = f"""(SELECT log_id, i, array_to_string(string_split(h, '.')[i:], '.') AS suffix FROM (SELECT log_id, {_SITE} AS h FROM {_U}), unnest(generate_series(1, len(string_split(h, '.')))) g(i))"""


_REGEX_SQL = lambda rules: "coalesce(" + ", ".join(f"CASE WHEN regexp_matches(key, '(?is){r.pattern}') THEN {r.ord} END" for r in rules) + ")"


@Q.add("j01_mime_in_list", f"SELECT log_id, item, category FROM (SELECT log_id, lower(mimetype) AS item FROM {_ONCE}) JOIN {_RULES('bannedmimetype')} USING (item)")
def j01_mime_in_list(spark, d):
    """Exact look-up of types."""
    rules = table(spark, d, "rules_item").filter("list_name = 'bannedmimetype'")
    return M.exact_hits(log_once(spark, d, "mimetype"), ["log_id"], F.col("mimetype"), rules)


@Q.add("j02_site_suffix_join", f"SELECT log_id, item, category FROM {_SUFFIX} s JOIN {_RULES('bannedsite')} r ON r.item = s.suffix QUALIFY row_number() OVER (PARTITION BY log_id ORDER BY i) = 1")
def j02_site_suffix_join(spark, d):
    rules = table(spark, d, "rules_item").filter("list_name = 'bannedsite'")
    return M.site_hits(_urls(spark, d), ["log_id"], L.site_key(F.col("url")), rules)


# an item holds if the key, cut to a parent domain, begins with it and goes on with a separator or ends
_URL_HITS = lambda n: f"""(SELECT log_id, item, category FROM (SELECT log_id, key, generate_subscripts(string_split(split_part(split_part(key, '/', 1), '?', 1), '.'), 1) AS i FROM {_KEYED}) k
 JOIN {_RULES(n)} r ON contains(item, '/') OR contains(item, '?') WHERE i <= greatest(len(string_split(split_part(split_part(key, '/', 1), '?', 1), '.')) - 1, 1)
 AND (array_to_string(string_split(key, '.')[i:], '.') = item OR (starts_with(array_to_string(string_split(key, '.')[i:], '.'), item) AND array_to_string(string_split(key, '.')[i:], '.')[length(item) + 1] IN ('/', '?', '&', '=')))
 QUALIFY row_number() OVER (PARTITION BY log_id ORDER BY i, length(item)) = 1)"""  # noqa: E731


@Q.add("j03_url_prefix_join", f"SELECT * FROM {_URL_HITS('bannedurl')}")
def j03_url_prefix_join(spark, d):
    rules = table(spark, d, "rules_item").filter("list_name = 'bannedurl'")
    return M.url_hits(_urls(spark, d), ["log_id"], U.list_key(F.col("url")), rules)


@Q.add("j04_extension_join", rf"""SELECT log_id, item, category FROM (SELECT log_id, regexp_extract(lower(split_part(split_part(url, '?', 1), '#', 1)), '([^/]*)$', 1) AS name FROM {_U} WHERE NOT contains(url, '?'))
 JOIN {_RULES('bannedextension')} ON ends_with(name, item) QUALIFY row_number() OVER (PARTITION BY log_id ORDER BY length(item) DESC) = 1""")
def j04_extension_join(spark, d):
    """Extensions of urls without query."""
    rules = table(spark, d, "rules_item").filter("list_name = 'bannedextension'")
    return M.extension_hits(_urls(spark, d).filter(~F.col("url").contains("?")), ["log_id"], F.lower(F.substring_index("url", "#", 1)), rules)


@Q.add("f07_regex_url", f"SELECT log_id, {_REGEX_SQL(I.URL_REGEXES)} AS ord FROM {_KEYED} WHERE ord IS NOT NULL")
def f07_regex_url(spark, d):
    """The first pattern that a url matches."""
    found = M.first_regex(U.list_key(F.col("url")), I.URL_REGEXES)
    return _urls(spark, d).select("log_id", found.alias("ord")).filter("ord IS NOT NULL")


@Q.add("f08_regex_header", f"SELECT log_id, CASE WHEN regexp_matches('User-Agent: ' || coalesce(user_agent, ''), '(?i)^user-agent: larkview/4') THEN 0 WHEN regexp_matches('How: ' || how, '(?i)connect') THEN 1 END AS ord FROM {_ONCE}")
def f08_regex_header(spark, d):
    lines = F.array(F.struct(F.lit("User-Agent").alias("name"), F.coalesce("user_agent", F.lit("")).alias("value")), F.struct(F.lit("How").alias("name"), F.col("how").alias("value")))
    rules = [I.Regex(0, "^user-agent: larkview/4"), I.Regex(1, "^how: .*connect")]
    return log_once(spark, d, "user_agent", "how").select("log_id", M.first_header_regex(lines, rules).alias("ord"))


_IPN = "(CAST(split_part(a, '.', 1) AS BIGINT) * 16777216 + CAST(split_part(a, '.', 2) AS BIGINT) * 65536 + CAST(split_part(a, '.', 3) AS BIGINT) * 256 + CAST(split_part(a, '.', 4) AS BIGINT))"
_IPS = f"(SELECT log_id, client_host, a, {_IPN} AS n FROM (SELECT log_id, client_host, {_IP} AS a FROM {_ONCE}) WHERE a IS NOT NULL)"


def _addresses(spark, d) -> DataFrame:
    return log_once(spark, d, L.ip_key(F.col("ip")).alias("ip"), "client_host")


@Q.add("sf16_ip_number", f"SELECT log_id, n FROM {_IPS}")
def sf16_ip_number(spark, d):
    return _addresses(spark, d).filter("ip IS NOT NULL").select("log_id", U.ip_number(F.col("ip")).alias("n"))


@Q.add("j05_ip_range_join", f"SELECT DISTINCT log_id, list_name, kind FROM {_IPS} JOIN rules_ip ON n BETWEEN lo AND hi")
def j05_ip_range_join(spark, d):
    """Every kind of rule that an address meets on every list."""
    rules = table(spark, d, "rules_ip").filter("kind <> 'host'")
    return M.ip_hits(_addresses(spark, d), ["log_id"], U.ip_number(F.col("ip")), rules, ["list_name", "kind"])


@Q.add("j17_log_category", f"""WITH s AS (SELECT log_id, category FROM {_SUFFIX} s JOIN {_RULES('logsite')} r ON r.item = s.suffix QUALIFY row_number() OVER (PARTITION BY log_id ORDER BY i) = 1),
 u AS (SELECT log_id, category FROM {_URL_HITS('logurl')}),
 r AS (SELECT log_id, {_REGEX_SQL(I.URL_REGEXES)} AS br FROM {_KEYED})
 SELECT log_id, coalesce(s.category, u.category, CASE br {' '.join(f"WHEN {r.ord} THEN '{r.category}'" for r in I.URL_REGEXES)} END) AS category FROM r LEFT JOIN s USING (log_id) LEFT JOIN u USING (log_id)
 WHERE coalesce(s.category, u.category) IS NOT NULL OR br IS NOT NULL""")
def j17_log_category(spark, d):
    """Category of the lists for logging: by site, else by url, else by expression."""
    return M.categorised(_urls(spark, d), ["log_id"], L.site_key(F.col("url")), U.list_key(F.col("url")), table(spark, d, "rules_item"), I.URL_REGEXES)


@Q.add("u03_banned_not_excepted", f"""SELECT DISTINCT log_id FROM {_SUFFIX} s JOIN {_RULES('bannedsite')} r ON r.item = s.suffix
 WHERE log_id NOT IN (SELECT log_id FROM {_SUFFIX} s JOIN {_RULES('exceptionsite')} r ON r.item = s.suffix)""")
def u03_banned_not_excepted(spark, d):
    rules, urls = table(spark, d, "rules_item"), _urls(spark, d)
    hits = V.hits_by_list(M.site_keys(urls, ["log_id"], L.site_key(F.col("url"))), ["log_id"], rules.filter("list_name IN ('bannedsite', 'exceptionsite')"))
    return hits.groupBy("log_id").agg(F.max("list_name").alias("most")).filter("most = 'bannedsite'").select("log_id")


_DEEP = [(1, "http://h.example/x?u=http://b.example/y"), (2, "https://h.example/a"), (3, "http://h.example/?u=http%3A%2F%2Fc.example%2F&v=ftp://d.example/z"), (4, "http://h.example:8080/p")]
_DEEP_OUT = [(1, "b.example/y"), (3, "c.example/&v=ftp://d.example/z"), (3, "d.example/z"), (4, "8080/p")]


@Q.add("j15_deep_urls", f"SELECT id, deep FROM {I.values_sql(_DEEP_OUT, 'id, deep')}")
def j15_deep_urls(spark, d):
    """Urls within urls; j15_deep_hits looks those of the log up."""
    return I.inline(spark, _DEEP, "id int, url string").select("id", F.explode(M.deep_urls(F.col("url"))).alias("deep"))


def _ip_list(n: str) -> str:
    return f"(SELECT DISTINCT log_id FROM {_IPS} JOIN rules_ip r ON r.list_name = '{n}' AND r.kind <> 'host' AND n BETWEEN lo AND hi UNION SELECT log_id FROM {_ONCE} a JOIN rules_ip r ON r.list_name = '{n}' AND r.kind = 'host' AND lower(a.client_host) = lower(r.host))"


def _site_list(n: str) -> str:
    return f"(SELECT log_id, item, category FROM {_SUFFIX} s JOIN {_RULES(n)} r ON r.item = s.suffix QUALIFY row_number() OVER (PARTITION BY log_id ORDER BY i) = 1)"


#: Options of the request chain that its queries use: search terms, header expressions, blanket flags, group modes, own server.
SEARCH = V.Search(tuple(I.SEARCH_PATTERNS), PhraseBase([Phrase(("score",), WEIGHTED, 30, "Games")]), 25)
HEADER_REGEXES = [I.Regex(0, "^user-agent: larkview/3[.]2", None, "Old clients"), I.Regex(1, "^x-none:", None, None)]
FLAGS = {"bannedurl": ["*ips"], "greysite": ["*ip"]}
_TERMS = f"(SELECT log_id, translate(url_decode(replace(regexp_extract(url, '(?i)[?&]q=([^&]*)', 1), '+', ' ')), chr(9) || ',;', '   ') AS t FROM {_U} WHERE regexp_matches(url, '(?i)[?&]q='))"
_DU = f"""(SELECT log_id * 1000 + i AS log_id, 'http://' || regexp_replace(array_to_string(string_split(r, ':')[i:], ':'), '^[:/]+', '') AS url
 FROM (SELECT log_id, url_decode(replace(substr(url, strpos(url, '://') + 3), '+', '%2B')) AS r FROM {_U}), unnest(generate_series(2, len(string_split(r, ':')))) g(i) WHERE regexp_replace(array_to_string(string_split(r, ':')[i:], ':'), '^[:/]+', '') <> '')"""


def _inner(sql: str) -> str:
    return sql.replace(_U, _DU)


@Q.add("j15_deep_hits", f"""WITH dh AS (SELECT log_id, 'bannedsite' AS list_name, item FROM {_inner(_site_list('bannedsite'))} UNION ALL SELECT log_id, 'bannedurl', item FROM {_inner(_URL_HITS('bannedurl'))}),
 df AS (SELECT log_id FROM {_inner(_site_list('greysite'))} UNION SELECT log_id FROM {_inner(_site_list('exceptionsite'))}),
 o AS (SELECT log_id, row_number() OVER (PARTITION BY log_id // 1000 ORDER BY log_id) - 1 AS pos, substr(url, 8) AS deep FROM {_DU})
 SELECT log_id // 1000 AS log_id, CAST(pos AS INTEGER) AS pos, deep, list_name, item FROM dh JOIN o USING (log_id) WHERE log_id NOT IN (SELECT log_id FROM df) QUALIFY row_number() OVER (PARTITION BY log_id // 1000 ORDER BY dh.log_id, list_name) = 1""")
def j15_deep_hits(spark, d):
    """Requests with a banned url within their url, and the first of them."""
    return M.deep_hits(_urls(spark, d), "log_id", F.col("url"), table(spark, d, "rules_item"))


@Q.add("c05_request_verdict", f"""WITH k AS (SELECT log_id, key, how, {_REGEX_SQL(I.URL_REGEXES)} AS br, {_REGEX_SQL(I.EXCEPTION_REGEXES)} AS er, CASE WHEN starts_with(lower('User-Agent: ' || coalesce(user_agent, '')), 'user-agent: larkview/3.2') THEN 0 END AS hr,
 coalesce(NOT regexp_matches({_SITE}, '[a-zA-Z|]'), false) AS is_ip, how IS NOT DISTINCT FROM 'CONNECT' AS ssl, CASE filter_group WHEN 3 THEN 0 WHEN 4 THEN 2 ELSE 1 END AS mode, starts_with(regexp_extract(lower(trim(url, ' ')), '^(?:[a-z]+://)?([^/]*)', 1), 'cdn.brightloaf.example') AS own FROM {_KEYED}),
 bs AS {_site_list('bannedsite')}, gs AS {_site_list('greysite')}, es AS {_site_list('exceptionsite')}, bu AS {_URL_HITS('bannedurl')}, bi AS {_ip_list('bannedip')}, ei AS {_ip_list('exceptionip')},
 st AS (SELECT log_id, (length(t) - length(replace(lower(t), 'score', ''))) // 5 * 30 AS score FROM {_TERMS}),
 dh AS (SELECT log_id, 0 AS o, item FROM {_inner(_site_list('bannedsite'))} UNION ALL SELECT log_id, 1, item FROM {_inner(_URL_HITS('bannedurl'))}),
 df AS (SELECT log_id FROM {_inner(_site_list('greysite'))} UNION SELECT log_id FROM {_inner(_site_list('exceptionsite'))}),
 du AS (SELECT log_id // 1000 AS log_id, o, item FROM dh WHERE log_id NOT IN (SELECT log_id FROM df) QUALIFY row_number() OVER (PARTITION BY log_id // 1000 ORDER BY dh.log_id DESC, o) = 1),
 v AS (SELECT k.log_id, CASE WHEN bi.log_id IS NOT NULL THEN 100 WHEN mode = 0 THEN 102 WHEN own THEN 1 WHEN mode = 2 THEN 601 WHEN ei.log_id IS NOT NULL THEN 600 WHEN es.log_id IS NOT NULL THEN 602 WHEN er IS NOT NULL THEN 609
 WHEN score > 25 AND NOT ssl THEN 400 WHEN gs.log_id IS NOT NULL OR is_ip THEN 0 WHEN bs.log_id IS NOT NULL THEN 500 WHEN ssl AND is_ip THEN 5010 WHEN bu.log_id IS NOT NULL THEN 501 WHEN br IS NOT NULL THEN 503 WHEN hr IS NOT NULL THEN 508
 WHEN o = 0 THEN 5000 WHEN o = 1 THEN 5011 ELSE 0 END AS code, es.item AS ei_, bs.item AS bi_, bu.item AS bu_, er, br, hr, score, du.item AS di
 FROM k LEFT JOIN bs USING (log_id) LEFT JOIN gs USING (log_id) LEFT JOIN es USING (log_id) LEFT JOIN bu USING (log_id) LEFT JOIN bi USING (log_id) LEFT JOIN ei USING (log_id) LEFT JOIN st USING (log_id) LEFT JOIN du USING (log_id))
 SELECT log_id, CASE WHEN code = 0 THEN 'clean' WHEN code = 1 THEN 'own' WHEN code BETWEEN 600 AND 699 THEN 'exception' ELSE 'banned' END AS verdict, CAST(CASE WHEN code >= 5000 THEN code // 10 WHEN code = 1 THEN 0 ELSE code END AS INTEGER) AS code,
 CASE code WHEN 602 THEN ei_ WHEN 500 THEN bi_ WHEN 501 THEN bu_ WHEN 503 THEN CAST(br AS VARCHAR) WHEN 508 THEN CAST(hr AS VARCHAR) WHEN 609 THEN CAST(er AS VARCHAR) WHEN 400 THEN '25 : ' || score || ' (score)' WHEN 5000 THEN di WHEN 5011 THEN di WHEN 5010 THEN '*ips' END AS item FROM v""")
def c05_request_verdict(spark, d):
    """Verdict of every request by the whole chain: clients, users, own server, exceptions, search terms, grey lists, sites, urls, expressions, headers and urls within."""
    df = _urls(spark, d, "ip", "client_host", "how", "user_agent", "filter_group")
    mode = F.when(F.col("filter_group") == 3, 0).when(F.col("filter_group") == 4, 2).otherwise(1)
    headers = F.array(F.struct(F.lit("User-Agent").alias("name"), F.coalesce("user_agent", F.lit("")).alias("value")))
    out = V.request_verdicts(
        df, "log_id", table(spark, d, "rules_item"), table(spark, d, "rules_ip"), I.URL_REGEXES, I.EXCEPTION_REGEXES, group_mode=mode, is_ssl=F.col("how") == "CONNECT", headers=headers,
        header_regexes=HEADER_REGEXES, flags=FLAGS, search=SEARCH, deep=True, own=M.own_server(F.col("url"), "cdn.brightloaf.example", 1),
    )
    return out.select("log_id", "verdict", "code", "item")


_CHAIN = [
    (1, "http://bad.example/", "10.0.0.1", "GET", 1), (2, "http://good.example/", "10.0.0.1", "GET", 2), (3, "http://good.example/", "10.0.0.9", "GET", 0), (4, "http://own.example/x", "10.0.0.9", "GET", 1), (5, "http://good.example/", "10.0.0.9", "GET", 1),
    (6, "http://grey.bad.example/?q=bad+word", "10.0.0.9", "GET", 1), (7, "https://grey.bad.example/?q=bad+word", "10.0.0.9", "CONNECT", 1), (8, "http://x.example/?u=http://bad.example/a", "10.0.0.9", "GET", 1), (9, "http://grey.bad.example/?u=http://bad.example/a", "10.0.0.9", "GET", 1),
    (10, "http://x.example/?u=http://bad.example/&v=http://good.example/", "10.0.0.9", "GET", 1), (11, "http://x.example/?u=http://good.example/&v=ftp://y.example/part/1", "10.0.0.9", "GET", 1), (12, "https://192.0.2.1/", "10.0.0.9", "CONNECT", 1), (13, "http://192.0.2.1/", "10.0.0.9", "GET", 1),
    (14, "http://x.example/tool", "10.0.0.9", "POST", 1), (15, "http://x.example/hidden", "10.0.0.9", "GET", 1), (16, None, None, None, None),
]
_CHAIN_OUT = [
    (1, "banned", 100, None), (2, "banned", 100, None), (3, "banned", 102, None), (4, "own", 0, None), (5, "exception", 602, "good.example"), (6, "banned", 400, "10 : 20 (bad word)"), (7, "clean", 0, None), (8, "banned", 500, "bad.example"), (9, "clean", 0, None),
    (10, "banned", 500, "bad.example"), (11, "banned", 501, "y.example/part"), (12, "banned", 500, "*ips"), (13, "clean", 0, None), (14, "banned", 508, "0"), (15, "banned", 503, "0"), (16, "clean", 0, None),
]


@Q.add("c05_chain_fixture", f"SELECT id, verdict, code, item FROM {I.values_sql(_CHAIN_OUT, 'id, verdict, code, item')}")
def c05_chain_fixture(spark, d):
    """Requests for each step of the chain, and where steps meet: a banned address at an exception site, grey sites with search terms, urls within."""
    df = I.inline(spark, _CHAIN, "id int, url string, ip string, how string, mode int").withColumn("client_host", F.lit(None).cast("string"))
    items = [("bannedsite", "bad.example", "B"), ("greysite", "grey.bad.example", None), ("exceptionsite", "good.example", None), ("bannedurl", "y.example/part", None)]
    ips = [("bannedip", "ip", 167772161, 167772161, None, None)]
    headers = F.array(F.struct(F.lit("How").alias("name"), F.coalesce("how", F.lit("")).alias("value")))
    out = V.request_verdicts(
        df, "id", I.inline(spark, items, "list_name string, item string, category string"), I.inline(spark, ips, "list_name string, kind string, lo long, hi long, host string, room string"), [I.Regex(0, "/hidden", None, "H")],
        group_mode=F.col("mode"), is_ssl=F.col("how") == "CONNECT", headers=headers, header_regexes=[I.Regex(0, "^how: post")], flags={"bannedsite": ["*ips"]}, deep=True, own=M.own_server(F.col("url"), "own.example", 1),
        search=V.Search(tuple(I.SEARCH_PATTERNS), PhraseBase([Phrase(("bad word",), WEIGHTED, 20)]), 10),
    )
    return out.select("id", "verdict", "code", "item")


_EXT = rf"""(SELECT log_id, item FROM (SELECT log_id, regexp_extract(lower(split_part(split_part(url, '?', 1), '#', 1)), '([^/]*)$', 1) AS name FROM {_U} WHERE NOT contains(url, '?') OR contains(lower(mimetype), 'application/'))
 JOIN {_RULES('bannedextension')} ON ends_with(name, item) QUALIFY row_number() OVER (PARTITION BY log_id ORDER BY length(item) DESC) = 1)"""


@Q.add("f13_download_verdict", f"""WITH e AS {_EXT}, m AS (SELECT log_id, item FROM (SELECT log_id, lower(mimetype) AS item FROM {_U}) JOIN {_RULES('bannedmimetype')} USING (item)),
 v AS (SELECT log_id, CASE WHEN (code BETWEEN 300 AND 399 AND code <> 304) OR code IN (401, 407) THEN 0 WHEN e.item IS NOT NULL THEN 900 WHEN m.item IS NOT NULL THEN 800 ELSE 0 END AS k, e.item AS ei, m.item AS mi FROM {_U} LEFT JOIN e USING (log_id) LEFT JOIN m USING (log_id))
 SELECT log_id, CASE WHEN k > 0 THEN 'banned' ELSE 'clean' END AS verdict, k AS code, CASE k WHEN 900 THEN ei WHEN 800 THEN mi END AS item FROM v""")
def f13_download_verdict(spark, d):
    df = _urls(spark, d, "mimetype", "code").withColumn("disposition", F.lit(None).cast("string"))
    return V.download_verdicts(df, "log_id", table(spark, d, "rules_item"))


@Q.add("c08_url_rewrite", f"SELECT log_id, regexp_replace(regexp_replace(regexp_replace(url, '^http://', 'https://', 'gi'), '([?&])s=[0-9a-f]+', '\\1s=0', 'gi'), ':3128/', '/', 'gi') AS u FROM {_U}")
def c08_url_rewrite(spark, d):
    return _urls(spark, d).select("log_id", X.rewrite(F.col("url"), I.URL_REWRITES).alias("u"))


_NEW = "regexp_replace(regexp_replace(regexp_replace(url, '^http://', 'https://', 'gi'), '([?&])s=[0-9a-f]+', '\\1s=0', 'gi'), ':3128/', '/', 'gi')"


@Q.add("c08_rechecked_urls", f"""WITH n AS (SELECT log_id, {_NEW} AS url FROM {_U} WHERE {_NEW} <> url), es AS {_site_list('exceptionsite').replace(_U, 'n')}, er AS (SELECT log_id, {_REGEX_SQL(I.EXCEPTION_REGEXES)} AS er FROM {_KEYED.replace(_U, 'n')}), bi AS {_ip_list('bannedip')}
 SELECT n.log_id, n.url, CASE WHEN bi.log_id IS NOT NULL THEN 0 WHEN es.log_id IS NOT NULL THEN 602 WHEN er IS NOT NULL THEN 609 ELSE 0 END AS code FROM n LEFT JOIN es USING (log_id) LEFT JOIN er USING (log_id) LEFT JOIN bi USING (log_id)""")
def c08_rechecked_urls(spark, d):
    """Urls that the replacements change, and the exceptions that hold for the new ones."""
    df = _urls(spark, d, "ip", "client_host")
    return V.rechecked(df, "log_id", I.URL_REWRITES, table(spark, d, "rules_item"), table(spark, d, "rules_ip"), I.EXCEPTION_REGEXES)


@Q.add("c09_header_rewrite", f"SELECT log_id, regexp_replace('User-Agent: ' || user_agent, '^(user-agent: larkview)/[\\d.]+', '\\1/1', 'gi') AS line FROM {_ONCE} WHERE user_agent IS NOT NULL")
def c09_header_rewrite(spark, d):
    lines = F.array(F.concat(F.lit("User-Agent: "), "user_agent"))
    df = log_once(spark, d, "user_agent").filter("user_agent IS NOT NULL")
    return df.select("log_id", F.get(F.transform(lines, lambda x: X.rewrite(x, I.HEADER_REWRITES)), F.lit(0)).alias("line"))


@Q.add("sf18_search_terms", f"SELECT log_id, t AS terms, CASE WHEN t <> '' THEN '0=' || t || ';' ELSE '' END AS params FROM {_TERMS}")
def sf18_search_terms(spark, d):
    terms = U.search_terms(F.col("url"), I.SEARCH_PATTERNS)
    return _urls(spark, d).select("log_id", terms.alias("terms")).filter("terms IS NOT NULL").select("log_id", "terms", params_column(F.col("terms")).alias("params"))


@Q.add("c07_search_filter", f"SELECT log_id, CAST((length(' ' || lower(t) || ' ') - length(replace(' ' || lower(t) || ' ', 'score', ''))) / 5 * 30 AS BIGINT) AS score FROM {_TERMS} WHERE contains(lower(t), 'score')")
def c07_search_filter(spark, d):
    """Search terms judged as texts of their own: padded with blanks, raw only, with a list and limit of their own."""
    return V.search_verdicts(_urls(spark, d), "log_id", SEARCH).filter("outcome = 'weighted'").select("log_id", "score")


@Q.add("s26_urlencoded", f"SELECT log_id, url_decode(replace(' ' || array_to_string(list_transform(string_split(split_part(url, '?', 2), '&'), lambda x: CASE WHEN contains(x, '=') THEN substr(x, strpos(x, '=') + 1) ELSE x END), ' ') || ' ', '+', ' ')) AS v FROM {_U} WHERE contains(url, '?')")
def s26_urlencoded(spark, d):
    """Values of query strings, read as posted forms."""
    df = _urls(spark, d).filter("contains(url, '?')")
    return df.select("log_id", H.form_values(F.get(F.split("url", r"\?"), F.lit(1))).alias("v"))


@Q.add("sf09_md5", f"SELECT log_id, upper(md5(url || 'salt')) AS h FROM {_U}")
def sf09_md5(spark, d):
    return _urls(spark, d).select("log_id", X.md5_upper(F.col("url"), F.lit("salt")).alias("h"))


@Q.add("sf15_bypass", f"SELECT log_id, url || CASE WHEN contains(url, '?') THEN '&GBYPASS=' ELSE '?GBYPASS=' END || upper(md5(url || 'magic' || a || '1700000000')) || '1700000000' AS link, true AS alive, false AS late FROM (SELECT *, {_IP} AS a FROM {_U}) WHERE a IS NOT NULL")
def sf15_bypass(spark, d):
    """Bypass links, held against the clock before and after they expire."""
    df = _urls(spark, d, L.ip_key(F.col("ip")).alias("a")).filter("a IS NOT NULL")
    df = df.withColumn("link", bypass_token(F.col("url"), "magic", F.col("a"), F.lit(1700000000)))
    holds = lambda now: bypass_holds(F.col("link"), "magic", F.col("a"), F.lit(now))
    return df.select("log_id", "link", holds(1699999999).alias("alive"), holds(1700000001).alias("late"))


@Q.add("sf14_mini_url_encode", f"SELECT block_id, array_to_string(list_transform(string_split(reason, ''), lambda x: CASE WHEN regexp_matches(x, '^[A-Za-z0-9]$') THEN x ELSE lower(regexp_replace(hex(encode(x)), '(..)', '%\\1', 'g')) END), '') AS r FROM deny_redirects WHERE reason IS NOT NULL AND reason <> ''")
def sf14_mini_url_encode(spark, d):
    df = table(spark, d, "deny_redirects").filter("reason IS NOT NULL AND reason <> ''")
    return df.select("block_id", X.mini_url_encode(F.col("reason")).alias("r"))
