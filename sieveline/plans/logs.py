"""Queries over the log: time limits, identity, entries and lines, denial, state, scanners, labels and posts."""

from __future__ import annotations

import zlib

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sieveline.functions import logfields as L
from sieveline.functions import text as X
from sieveline.functions import url as U
from sieveline.operators import identity as ID
from sieveline.operators import labels as LB
from sieveline.operators import scanners as SC
from sieveline.operators import verdict as V
from sieveline.operators.match import site_keys
from sieveline.plans import inline as I
from sieveline.plans.access import _IP, _ONCE, _SITE, _TRIM, _USER, _WHEN, log_once
from sieveline.plans.registry import QuerySet
from sieveline.plans.streams import _ALERTS, _ENTRIES, _HITS, _REQ
from sieveline.plans.urls import _IPS, _SUFFIX
from sieveline.session import table
from sieveline.sinks import log as K
from sieveline.sources import http as H
from sieveline.sources.lists import in_time
from sieveline.streaming import state as S

Q = QuerySet()

_IN_TIME = "(tl IS NULL OR (contains(tl.days, CAST(isodow(start_ts) - 1 AS VARCHAR)) AND hour(start_ts) * 60 + minute(start_ts) BETWEEN tl.sth * 60 + tl.stm AND tl.enh * 60 + tl.enm))"


@Q.add("f01_time_window", f"SELECT DISTINCT log_id, item FROM {_SUFFIX} s JOIN (SELECT lower(trim(item)) AS item, tl FROM rules_item WHERE list_name = 'bannedsite') r ON suffix = item JOIN (SELECT log_id, start_ts FROM {_ONCE} WHERE start_ts IS NOT NULL) USING (log_id) WHERE {_IN_TIME}")
def f01_time_window(spark, d):
    """Banned sites, and domains below them, by rules that hold at the request's own time."""
    log = log_once(spark, d, L.site_key(F.col("url")).alias("host"), "start_ts").filter("start_ts IS NOT NULL")
    keys = site_keys(log, ["log_id", "start_ts"], F.col("host")).select("log_id", "start_ts", F.posexplode_outer("__keys").alias("pos", "item"))
    rules = table(spark, d, "rules_item").filter("list_name = 'bannedsite'").select(F.lower(F.trim("item")).alias("item"), "tl")
    return keys.join(rules, "item").filter(in_time(F.col("tl"), F.col("start_ts"))).select("log_id", "item").distinct()


_GROUPS = "(SELECT DISTINCT ON (log_id) log_id, grp FROM {0} JOIN rules_ip ON n BETWEEN lo AND hi WHERE grp IS NOT NULL AND kind <> 'host' ORDER BY log_id, CASE kind WHEN 'ip' THEN 0 WHEN 'subnet' THEN 1 ELSE 2 END, grp)"


@Q.add("j07_ip_group", f"SELECT log_id, grp FROM {_GROUPS.format(_IPS)}")
def j07_ip_group(spark, d):
    log = log_once(spark, d, L.ip_key(F.col("ip")).alias("ip"))
    return ID.ip_groups(log, ["log_id"], U.ip_number(F.col("ip")), table(spark, d, "rules_ip"))


_UG = f"(SELECT {_USER} AS u, min(grp) AS grp FROM user_group WHERE grp IS NOT NULL GROUP BY 1 HAVING u IS NOT NULL)"


@Q.add("j08_user_group", f"SELECT log_id, coalesce(grp - 1, 0) AS filter_group FROM (SELECT log_id, {_USER} AS u FROM {_ONCE}) LEFT JOIN {_UG} USING (u)")
def j08_user_group(spark, d):
    groups = table(spark, d, "user_group").select(L.user_key(F.col("user_name")).alias("user_name"), "grp")
    log = log_once(spark, d, L.user_key(F.col("user_name")).alias("u"))
    return ID.user_groups(log, ["log_id"], F.col("u"), groups)


@Q.add("c13_resolved_group", f"""SELECT log_id, coalesce(g.grp, i.grp, 1) AS grp FROM (SELECT log_id, {_USER} AS u FROM {_ONCE}) a LEFT JOIN {_UG} g USING (u) LEFT JOIN {_GROUPS.format(_IPS)} i USING (log_id)""")
def c13_resolved_group(spark, d):
    """The group by user, else by address, else the first."""
    log = log_once(spark, d, L.user_key(F.col("user_name")).alias("u"), L.ip_key(F.col("ip")).alias("ip"))
    named = table(spark, d, "user_group").filter("grp IS NOT NULL").groupBy(L.user_key(F.col("user_name")).alias("u")).agg(F.min("grp").alias("ug")).filter("u IS NOT NULL")
    return ID.groups_by_user_or_address(log, "log_id", "u", U.ip_number(F.col("ip")), named, table(spark, d, "rules_ip"), 1)


_ROOMS = f"""(SELECT log_id, min(room) AS room FROM (SELECT log_id, room FROM {_IPS} JOIN rules_ip ON list_name = 'rooms' AND kind <> 'host' AND n BETWEEN lo AND hi
 UNION ALL SELECT log_id, room FROM {_ONCE} a JOIN rules_ip r ON list_name = 'rooms' AND kind = 'host' AND lower(client_host) = lower(r.host)) GROUP BY log_id)"""


@Q.add("j09_room", f"SELECT log_id, room FROM {_ROOMS}")
def j09_room(spark, d):
    log = log_once(spark, d, L.ip_key(F.col("ip")).alias("ip"), "client_host")
    return ID.rooms(log, ["log_id"], U.ip_number(F.col("ip")), F.col("client_host"), table(spark, d, "rules_ip").filter("list_name = 'rooms'"))


@Q.add("f11_banned_client", f"""SELECT log_id FROM {_IPS} JOIN rules_ip ON list_name = 'bannedip' AND kind <> 'host' AND n BETWEEN lo AND hi
 UNION SELECT log_id FROM {_ONCE} a JOIN rules_ip r ON list_name = 'bannedip' AND kind = 'host' AND lower(client_host) = lower(r.host)""")
def f11_banned_client(spark, d):
    log = log_once(spark, d, L.ip_key(F.col("ip")).alias("ip"), "client_host")
    return ID.listed_clients(log, ["log_id"], U.ip_number(F.col("ip")), F.col("client_host"), table(spark, d, "rules_ip").filter("list_name = 'bannedip'"))


_FLAGS = ("is_naughty", "is_exception", "infected", "scanned", "content_mod", "url_mod", "header_mod")
_DECOR = """CASE WHEN header_mod THEN '*HEADERMOD* ' ELSE '' END || CASE WHEN url_mod THEN '*URLMOD* ' ELSE '' END || CASE WHEN content_mod THEN '*CONTENTMOD* ' ELSE '' END ||
 CASE WHEN infected THEN '*INFECTED' || p || '* ' WHEN scanned THEN '*SCANNED* ' ELSE '' END || CASE WHEN is_naughty THEN '*DENIED' || p || '* ' WHEN is_exception THEN '*EXCEPTION* ' ELSE '' END || coalesce(what, '')"""
_PART = f"(SELECT *, CASE naughty_type WHEN 1 THEN '-POST' WHEN 2 THEN '-PARAMS' ELSE '' END AS p FROM {_ONCE})"


@Q.add("k02_decorate", f"SELECT log_id, {_DECOR} AS what FROM {_PART}")
def k02_decorate(spark, d):
    df = log_once(spark, d, "what", "naughty_type", *_FLAGS)
    return df.select("log_id", K.decorated(F.col("what"), F.col("naughty_type"), **{k: F.col(k) for k in _FLAGS}).alias("what"))


_PORT = "CASE WHEN port IS NULL OR port IN (0, 80) THEN url ELSE regexp_replace(url, '^([a-zA-Z]+://(?:[^/@]*@)?[^/:?]+)([/?]|$)', '\\1:' || port || '\\2') END"


@Q.add("k03_port", f"SELECT log_id, {_PORT} AS url FROM {_ONCE} WHERE url IS NOT NULL")
def k03_port(spark, d):
    return log_once(spark, d, "url", "port").filter("url IS NOT NULL").select("log_id", K.with_port(F.col("url"), F.col("port")).alias("url"))


@Q.add("k04_anonymise", f"SELECT log_id, '' AS user_name, '0.0.0.0' AS ip, '' AS client_host, size FROM {_ONCE}")
def k04_anonymise(spark, d):
    return K.anonymised(log_once(spark, d, "user_name", "ip", "client_host", "size"))


@Q.add("k05_squid", f"SELECT log_id, CASE WHEN code = 403 THEN 'TCP_DENIED/403' WHEN cache_hit THEN 'TCP_HIT/' || code ELSE 'TCP_MISS/' || code END AS hit, CASE WHEN length(size::VARCHAR) < 6 THEN lpad(size::VARCHAR, 6, ' ') ELSE size::VARCHAR END AS ms FROM {_ONCE}")
def k05_squid(spark, d):
    return log_once(spark, d, "code", "cache_hit", "size").select("log_id", K.squid_code(F.col("code"), F.col("cache_hit")).alias("hit"), K.squid_duration(F.col("size")).alias("ms"))


@Q.add("k06_admission", f"SELECT log_id FROM {_ONCE} WHERE (coalesce(is_naughty, false) OR coalesce(lower(mimetype) LIKE 'text%', false)) AND NOT coalesce(contains(category, 'ADs'), false) AND NOT coalesce(is_exception, false)")
def k06_admission(spark, d):
    df = log_once(spark, d, "is_naughty", "is_exception", "category", "mimetype")
    return df.filter(K.admitted(2, F.col("is_naughty"), F.col("is_exception"), F.col("category"), F.col("mimetype"), exception_hits=0)).select("log_id")


_LINE = f"""coalesce(strftime(start_ts, '%Y.%-m.%-d %-H:%M:%S'), ''), coalesce(user_name, '-'), coalesce(ip, ''), left(coalesce({_PORT}, ''), 400), left({_DECOR}, 400), coalesce(how, ''), coalesce(size::VARCHAR, '0'), coalesce(weight::VARCHAR, '0'), left(coalesce(category, ''), 400),
 coalesce((filter_group + 1)::VARCHAR, ''), coalesce(code::VARCHAR, ''), coalesce(mimetype, '-'), coalesce(client_host, ''), 'all', coalesce(user_agent, ''), coalesce(params, ''), '', '', coalesce(post, '')"""
_COLUMNS = ("start_ts", "user_name", "ip", "url", "port", "what", "naughty_type", *_FLAGS, "how", "size", "weight", "category", "filter_group", "code", "mimetype", "client_host", "user_agent", "params", "post", "cache_hit", "recv_ts")


def _lines(fmt: int):
    def query(spark: SparkSession, d: str) -> DataFrame:
        df = table(spark, d, "access_log")
        from sieveline.operators.dedupe import once_per_id

        once = once_per_id(df.select("log_id", *_COLUMNS), "log_id", ["recv_ts"])
        return K.log_lines(once, fmt, limit=400, group_name="all", keep=["log_id"])

    query.__doc__ = f"Log lines in format {fmt}."
    return query


Q.add("k01_log_line_1", f"SELECT log_id, concat_ws(' ', {_LINE}) AS line FROM {_PART}")(_lines(1))
Q.add("k01_log_line_2", f"SELECT log_id, '\"' || concat_ws('\",\"', {_LINE}) || '\"' AS line FROM {_PART}")(_lines(2))
Q.add("k01_log_line_4", f"SELECT log_id, concat_ws(chr(9), {_LINE}) AS line FROM {_PART}")(_lines(4))
Q.add("k01_log_line_3", f"""SELECT log_id, concat_ws(' ', (epoch_us(recv_ts) // 1000000) || '.' || lpad(((epoch_us(recv_ts) // 1000) % 1000)::VARCHAR, 3, '0'),
 CASE WHEN length(ms) < 6 THEN lpad(ms, 6, ' ') ELSE ms END, CASE WHEN length(client_host) > 0 THEN client_host ELSE coalesce(ip, '') END,
 CASE WHEN code = 403 THEN 'TCP_DENIED/403' WHEN cache_hit THEN 'TCP_HIT/' || code ELSE 'TCP_MISS/' || code END, coalesce(size::VARCHAR, ''), coalesce(how, ''), left(coalesce({_PORT}, ''), 400), coalesce(user_name, '-'), 'DEFAULT_PARENT/127.0.0.1', coalesce(mimetype, '-')) AS line
 FROM (SELECT *, (epoch_us(recv_ts) // 1000 - epoch_us(start_ts) // 1000)::VARCHAR AS ms FROM {_ONCE})""")(_lines(3))  # fmt: skip

_POSTS = [(1, "image/png", "a b,c.png", 10, False, "", 99), (1, "text/plain", None, 5, True, "x;y", 40), (2, "application/zip", "z.zip", 7, False, "s", 1)]


@Q.add("k07_post_column", f"SELECT req_id, post FROM {I.values_sql([(1, 'image/png,a_b_c.png,10,0,,99;text/plain,,5,1,x_y,40;'), (2, 'application/zip,z.zip,7,0,s,1;')], 'req_id, post')}")
def k07_post_column(spark, d):
    df = I.inline(spark, _POSTS, "req_id int, mimetype string, filename string, size long, blocked boolean, storedname string, bodyoffset long")
    parts = F.sort_array(F.collect_list(F.struct("mimetype", "filename", "size", "blocked", "storedname", "bodyoffset")))
    return df.groupBy("req_id").agg(K.post_column(parts).alias("post"))


@Q.add("k09_block_page", f"SELECT block_id, '<p>' || replace(replace(replace(coalesce(denied_url, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</p>' || replace(replace(replace(coalesce(CASE WHEN length(denied_url) > 40 THEN left(denied_url, 40) || '...' ELSE denied_url END, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || ' ' || replace(replace(replace(coalesce(reason, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS page FROM deny_redirects")
def k09_block_page(spark, d):
    df = table(spark, d, "deny_redirects")
    return df.select("block_id", K.block_page("<p>-URL-</p>-SHORTURL- -REASON-", URL=F.col("denied_url"), REASON=F.col("reason")).alias("page"))


_ENC = lambda c: f"coalesce(array_to_string(list_transform(string_split({c}, ''), lambda x: CASE WHEN regexp_matches(x, '^[A-Za-z0-9]$') THEN x WHEN x = '' THEN '' ELSE lower(regexp_replace(hex(encode(x)), '(..)', '%\\1', 'g')) END), ''), '')"


@Q.add("k10_redirect_url", f"SELECT block_id, 'http://deny.example/?DENIEDURL==' || {_ENC('denied_url')} || '::IP==' || {_ENC('ip')} || '::USER==' || {_ENC('user_name')} || '::CATEGORIES==' || {_ENC('categories')} || '::REASON==' || {_ENC('reason')} AS link FROM deny_redirects")
def k10_redirect_url(spark, d):
    df = table(spark, d, "deny_redirects")
    c = lambda n: F.coalesce(F.col(n), F.lit(""))
    return df.select("block_id", K.redirect_url("http://deny.example/", c("denied_url"), c("ip"), c("user_name"), c("categories"), c("reason"), custom=True).alias("link"))


@Q.add("c12_denial", f"SELECT log_id, CASE WHEN lower(mimetype) LIKE 'image/%' THEN 'image' ELSE 'page' END AS action FROM {_ONCE} WHERE is_naughty AND mimetype IS NOT NULL")
def c12_denial(spark, d):
    """What is sent for denied requests (K14 for images)."""
    df = log_once(spark, d, "mimetype", "is_naughty", "url").filter("is_naughty AND mimetype IS NOT NULL")
    return df.select("log_id", K.denial(3, F.col("mimetype"), F.col("url"), F.col("url"))["action"].alias("action"))


@Q.add("f12_upload_limit", f"SELECT log_id, how = 'POST' AND size > 20000 AS blocked FROM {_ONCE} WHERE size IS NOT NULL AND how IS NOT NULL")
def f12_upload_limit(spark, d):
    df = log_once(spark, d, "how", "size").filter("size IS NOT NULL AND how IS NOT NULL")
    return df.select("log_id", V.upload_blocked(F.col("how") == "POST", F.col("size"), 20_000).alias("blocked"))


@Q.add("f15_text_only", f"SELECT log_id, coalesce(mimetype LIKE 'text%' OR mimetype = '-', true) AS is_text, CASE WHEN size <= 20480 THEN 'ram' WHEN size <= 40960 THEN 'disk' ELSE 'unscanned' END AS gate FROM {_ONCE}")
def f15_text_only(spark, d):
    """Text types (F15) and where a body of a size is held."""
    df = log_once(spark, d, "mimetype", "size")
    return df.select("log_id", V.is_text(F.col("mimetype")).alias("is_text"), V.scan_gate(F.col("size"), 20, 40).alias("gate"))


@Q.add("f20_cacheable", f"SELECT log_id FROM {_ONCE} WHERE NOT is_naughty AND NOT is_exception AND coalesce(mimetype LIKE 'text%' OR mimetype = '-', true) AND how = 'GET' AND code = 200")
def f20_cacheable(spark, d):
    df = log_once(spark, d, "is_naughty", "is_exception", "mimetype", "how", "code")
    return df.filter(V.cacheable(F.col("is_naughty"), F.col("is_exception"), F.col("mimetype"), F.col("how"), F.col("code"))).select("log_id")


@Q.add("sf19_log_time", f"SELECT log_id, strftime(start_ts, '%Y.%-m.%-d %-H:%M:%S') AS t FROM {_ONCE}")
def sf19_log_time(spark, d):
    return log_once(spark, d, "start_ts").select("log_id", K.log_time(F.col("start_ts")).alias("t"))


@Q.add("sf20_sizes", f"SELECT log_id, CASE WHEN size < 1024 THEN size || ' bytes' WHEN size < 1048576 THEN (size * 20 + 1024) // 2048 // 10 || '.' || (size * 20 + 1024) // 2048 % 10 || ' KiB' ELSE (size * 20 + 1048576) // 2097152 // 10 || '.' || (size * 20 + 1048576) // 2097152 % 10 || ' MiB' END AS s, printf('%d:%02d:%02d', size // 3600, size // 60 % 60, size % 60) AS t FROM {_ONCE} WHERE size IS NOT NULL")
def sf20_sizes(spark, d):
    df = log_once(spark, d, "size").filter("size IS NOT NULL")
    return df.select("log_id", X.byte_size(F.col("size")).alias("s"), X.duration(F.col("size")).alias("t"))


def _requests(spark: SparkSession, d: str, *more) -> DataFrame:
    return log_once(spark, d, L.raw_value(F.col("url")).alias("url"), "filter_group", L.epoch_seconds(F.col("when_txt")).alias("s"), *more)



@Q.add("t01_clean_cache", f"SELECT log_id, is_hit FROM ({_HITS})")
def t01_clean_cache(spark, d):
    """Requests that find their url clean in their group within 900 s."""
    df = _requests(spark, d, "is_naughty").filter("url IS NOT NULL AND s IS NOT NULL AND filter_group IS NOT NULL AND NOT is_naughty")
    return S.cache_hits(df, ["url", "filter_group"], "s", ["log_id"]).select("log_id", "is_hit")


#: Requests of a ring of three places, the flush at 9 apart, and what the ring holds in the end, worked out by hand:
#: d takes the place of a at 5, a that of b at 6, b that of c at 7, c that of d at 8, d that of a at 10.
_RING = [(1, "a"), (2, "b"), (3, "c"), (4, "a"), (5, "d"), (6, "a"), (7, "b"), (8, "c"), (9, "c"), (10, "d")]


@Q.add("w07_ring", f"SELECT url, s FROM {I.values_sql([('b', 7), ('c', 9), ('d', 10)], 'url, s')}")
def w07_ring(spark, d):
    """A small ring with overwritten keys that come back, in chunks of three requests."""
    rows = I.inline(spark, _RING, "s long, url string")
    return S.ring_entries(rows, "url", "s", [], 3, chunk_rows=3).select("url", F.col("s").cast("int").alias("s"))


@Q.add("t03_flush", f"SELECT url, s FROM {I.values_sql([('b', 0), ('c', 9), ('d', 10)], 'url, s')}")
def t03_flush(spark, d):
    """The same with a flush before the last two: entries get old, and keep their places."""
    rows = I.inline(spark, [(s, int(s == 9), u, False) for s, u in _RING] + [(9, 0, None, True)], "s long, o int, url string, flush boolean")
    return S.ring_entries(rows, "url", "s", ["o"], 3, "flush", chunk_rows=3).select("url", F.col("s").cast("int").alias("s"))


@Q.add("t02_newest_entries")
def t02_newest_entries(spark, d):
    """What a cache of 1000 places holds after the log's requests; its size is the feature."""
    df = _requests(spark, d, "is_naughty").filter("url IS NOT NULL AND s IS NOT NULL AND NOT is_naughty")
    return S.ring_entries(df, "url", "s", ["log_id", "url"], 1000)


@Q.add("t01_cache_entries", _ENTRIES)
def t01_cache_entries(spark, d):
    """Entries of the cache of clean urls: when each was put in, when it was last found, and how often."""
    df = _requests(spark, d, "is_naughty").filter("url IS NOT NULL AND s IS NOT NULL AND filter_group IS NOT NULL AND NOT is_naughty")
    return S.cache_entries(df, ["url", "filter_group"], "s")


@Q.add("u05_groups_per_url", f"SELECT url, list_sort(list(DISTINCT filter_group)) AS groups FROM {_ONCE} WHERE {_TRIM('url')} NOT IN ('', '-') AND filter_group IS NOT NULL AND NOT is_naughty GROUP BY url")
def u05_groups_per_url(spark, d):
    df = log_once(spark, d, L.raw_value(F.col("url")).alias("url"), "filter_group", "is_naughty").filter("url IS NOT NULL AND filter_group IS NOT NULL AND NOT is_naughty")
    return df.groupBy("url").agg(F.sort_array(F.collect_set("filter_group")).alias("groups"))


#: Requests for two slots that are freed after more than 500 s at ticks of 100 s, and the slots in the end: 10.0.0.3
#: is refused at 30 and 540; both others are freed at 600 (10.0.0.1 at 0, 10.0.0.2 at 10), so it gets one at 620.
_SLOTS = [(0, "10.0.0.1"), (10, "10.0.0.2"), (30, "10.0.0.3"), (540, "10.0.0.3"), (620, "10.0.0.3"), (630, "10.0.0.1"), (640, "10.0.0.2"), (1100, "10.0.0.3"), (1210, "10.0.0.2")]


@Q.add("t05_slot_purge", f"SELECT ip, last_s FROM {I.values_sql([('10.0.0.3', 1100), ('10.0.0.2', 1210)], 'ip, last_s')}")
def t05_slot_purge(spark, d):
    """Slots that are freed when they weren't used for long, in chunks of two requests."""
    rows = I.inline(spark, _SLOTS, "s long, ip string")
    return S.ip_slots(rows, "ip", "s", 2, 500, 100, chunk_rows=2).select("ip", F.col("last_s").cast("int").alias("last_s"))


@Q.add("t04_ip_slots")
def t04_ip_slots(spark, d):
    """Addresses that hold 200 slots after the log's requests, freed after a day; the number of slots is the feature."""
    df = log_once(spark, d, L.ip_key(F.col("ip")).alias("ip"), L.epoch_seconds(F.col("when_txt")).alias("s")).filter("s IS NOT NULL")
    return S.ip_slots(df, "ip", "s", 200, expire_s=86_400)


@Q.add("t09_identity_memo", f"""WITH k AS (SELECT ip, s, arg_max(u, log_id) FILTER (u IS NOT NULL) AS v FROM (SELECT {_IP} AS ip, {_USER} AS u, s, log_id FROM {_REQ}) WHERE ip IS NOT NULL GROUP BY ALL),
 m AS (SELECT ip, s, last_value(v IGNORE NULLS) OVER (PARTITION BY ip ORDER BY s) AS carried FROM k)
 SELECT log_id, coalesce(u, carried) AS usr FROM (SELECT {_IP} AS ip, {_USER} AS u, s, log_id FROM {_REQ}) LEFT JOIN m USING (ip, s)""")
def t09_identity_memo(spark, d):
    """User of every request: its own, else the last one known of its address."""
    df = log_once(spark, d, L.ip_key(F.col("ip")).alias("ip"), L.user_key(F.col("user_name")).alias("u"), L.epoch_seconds(F.col("when_txt")).alias("s")).filter("s IS NOT NULL")
    memo = S.carried_values(df.filter("ip IS NOT NULL"), ["ip"], "s", "u", "log_id")
    return df.join(memo, ["ip", "s"], "left").select("log_id", F.coalesce("u", "carried").alias("usr"))


@Q.add("a08_active_ips", f"""WITH e AS (SELECT DISTINCT {_IP} AS ip, s FROM {_REQ}), m AS (SELECT ip, s, CASE WHEN s - lag(s) OVER w <= 86399 THEN 0 ELSE 1 END AS o FROM e WHERE ip IS NOT NULL WINDOW w AS (PARTITION BY ip ORDER BY s)),
 k AS (SELECT ip, s, sum(o) OVER (PARTITION BY ip ORDER BY s ROWS UNBOUNDED PRECEDING) AS k FROM m), p AS (SELECT min(s) AS a, max(s) AS b FROM k GROUP BY ip, k),
 c AS (SELECT (a + 179) // 180 * 180 AS tick_s, 1 AS x FROM p UNION ALL SELECT (b + 86400 + 179) // 180 * 180, -1 FROM p), t AS (SELECT tick_s, sum(x) AS x FROM c GROUP BY 1 HAVING sum(x) <> 0),
 r AS (SELECT tick_s, sum(x) OVER (ORDER BY tick_s) AS current FROM t)
 SELECT tick_s, CAST(current AS BIGINT) AS current, CAST(max(current) OVER (ORDER BY tick_s) AS BIGINT) AS peak FROM r""")
def a08_active_ips(spark, d):
    """Addresses active within a day, now and at most, at each tick with a change."""
    df = log_once(spark, d, L.ip_key(F.col("ip")).alias("ip"), L.epoch_seconds(F.col("when_txt")).alias("s"))
    return S.active_clients(df, "ip", "s", expire_s=86_399)


@Q.add("a09_violations", _ALERTS)
def a09_violations(spark, d):
    """Users with three denials within a day, the counter starting anew after each three."""
    df = log_once(spark, d, L.user_key(F.col("user_name")).alias("u"), L.epoch_seconds(F.col("when_txt")).alias("s"), "is_naughty").filter("is_naughty AND s IS NOT NULL")
    return S.violation_alerts(df, "u", "s", 3, 86_400)


@Q.add("x02_scanner_results", f"SELECT log_id, CASE WHEN regexp_matches(what, 'phrase') THEN 1 WHEN code IN (200, 304) THEN 0 WHEN code = 500 THEN 1 ELSE -1 END AS code, true AS scanned FROM {_ONCE}")
def x02_scanner_results(spark, d):
    """Recorded results of scanner programs as verdicts (X02), through the chain (C11)."""
    df = log_once(spark, d, "what", "code")
    one = SC.command_line_result(F.coalesce("what", F.lit("")), F.col("code"), "(phrase)", (200, 304), (500,), "error")
    v = SC.chain([one])
    return df.select("log_id", v["code"].alias("code"), v["scanned"].alias("scanned"))


_CHAIN = [(1, 0, 0), (2, 3, 0), (3, 0, 1), (4, 3, 4), (5, -1, 1), (6, 1, 3)]


@Q.add("c11_scanner_chain", f"SELECT id, code, scanned FROM {I.values_sql([(1, 0, True), (2, 0, False), (3, 1, True), (4, 4, False), (5, -1, True), (6, 1, True)], 'id, code, scanned')}")
def c11_scanner_chain(spark, d):
    df = I.inline(spark, _CHAIN, "id int, a int, b int")
    r = lambda c: F.struct(F.col(c).alias("code"), F.col(c).cast("string").alias("name"))
    return df.select("id", SC.chain([r("a"), r("b")]).alias("v")).select("id", "v.code", "v.scanned")


@Q.add("x03_icap_results", f"SELECT id, code FROM {I.values_sql([(1, 0), (2, 1), (3, 0), (4, -1)], 'id, code')}")
def x03_icap_results(spark, d):
    df = I.inline(spark, [(1, 204, None), (2, 200, "Type=0; Threat=Eicar;"), (3, 200, None), (4, 404, None)], "id int, status int, found string")
    return df.select("id", SC.icap_result(F.col("status"), F.col("found"))["code"].alias("code"))


_PICS = [
    (1, '<meta http-equiv="pics-label" content=\'(pics-1.1 "http://www.icra.org/" l r (ca 1 nz 1 va 0 vb 1) "http://www.rsac.org/" l r (n 2 s 3 v 0 l 4))\'>'),
    (2, '<meta name="PICS-Label" content="(x safesurf ratings (SS~~000 3 004 5))">'), (3, "<p>nothing</p>"), (4, '<meta http-equiv="pics-label" content="weburbia r (s 2)">'),
]
_PICS_OUT = [(1, "icra", "vb", 1), (1, "rsac", "s", 3), (1, "rsac", "l", 4), (2, "safesurf", "004", 5), (2, "safesurf", "000", 3)]


@Q.add("c04_labels", f"SELECT id, service, label, value FROM {I.values_sql(_PICS_OUT, 'id, service, label, value')}")
def c04_labels(spark, d):
    """Labels above their limits (F22): equal ones are allowed, unknown ones ignored."""
    limits = LB.limits_rows(2, {("icra", x): 0 for x in LB.SERVICES["icra"].split() if x != "ca"} | {("icra", "ca"): 1})
    out = LB.exceeded(I.inline(spark, _PICS, "id int, html string"), "id", "html", I.inline(spark, limits, "service string, label string, max_level int"))
    return out.select("id", "service", "label", "value")


_BODY = '--B1\r\nContent-Disposition: form-data; name="f"; filename="a.txt"\r\nContent-Type: text/css\r\n\r\nhello\r\n--B1\r\nContent-Disposition: form-data; name="g"\r\n\r\nwörld\r\nx\r\n--B1--\r\nrest'


@Q.add("s25_multipart", f"SELECT id, pos, mimetype, filename, size FROM {I.values_sql([(1, 0, 'text/css', 'a.txt', 5), (1, 1, 'text/plain', None, 9)], 'id, pos, mimetype, filename, size')}")
def s25_multipart(spark, d):
    """Parts of a multipart post; a body without boundary has none."""
    df = I.inline(spark, [(1, _BODY, "B1"), (2, _BODY, None), (3, None, "B1"), (4, "no parts", "B1")], "id int, body string, mark string")
    return df.select("id", F.posexplode(H.multipart(F.col("body"), F.col("mark"))).alias("pos", "p")).select("id", "pos", "p.mimetype", "p.filename", "p.size")


_HEADERS = 'POST http://h/ HTTP/1.1\r\nHost: a.example\r\nhost: b.example\r\nContent-Type: Multipart/Form-Data; boundary="XX"; q=1\r\nContent-Length: 12\r\nCookie: a=1; GBYPASS=tok\r\nAccept-Encoding: br, gzip;q=0.5, deflate\r\nProxy-Authorization: Basic dXNlcjpwdw==\r\nContent-Disposition: attachment; filename="x y.zip"\r\n'


@Q.add("p13_headers", f"SELECT * FROM {I.values_sql([('multipart/form-data', 12, 'x y.zip', 'XX', 'tok', None, 'user', 'gzip, deflate', 'a.example', 'X-Ignored-Host', 'POST http://h/ HTTP/1.0')], 'ctype, clen, fname, mark, tok, absent, usr, enc, host, second, first_line')}")
def p13_headers(spark, d):
    """Header accessors (P13, P17), encodings (P14) and repeated hosts."""
    df = I.inline(spark, [(_HEADERS,)], "block string").select(H.header_lines(F.col("block")).alias("h"))
    h = F.col("h")
    one = H.one_host(h)
    return df.select(
        H.content_type(h).alias("ctype"), H.content_length(h).cast("int").alias("clen"), H.file_name(h).alias("fname"), H.boundary(h).alias("mark"), H.cookie(h, "GBYPASS").alias("tok"), H.cookie(h, "none").alias("absent"),
        H.basic_user(h).alias("usr"), H.readable_encodings(H.header(h, "accept-encoding")).alias("enc"), H.header(one, "host").alias("host"), F.get(one, F.lit(2))["name"].alias("second"), F.get(one, F.lit(0))["value"].alias("first_line"),
    )


@Q.add("s27_inflate", "SELECT doc_id, md5(text) AS h FROM documents WHERE text IS NOT NULL")
def s27_inflate(spark, d):
    """Texts deflated and inflated again."""
    @F.pandas_udf(T.BinaryType())
    def deflate(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: zlib.compress(t.encode("utf-8")))

    df = table(spark, d, "documents").filter("text IS NOT NULL").select("doc_id", deflate("text").alias("b"))
    return df.select("doc_id", F.md5(H.inflate("b", F.lit("deflate"))).alias("h"))


@Q.add("r01_log_rollup", f"SELECT filter_group, code, CAST(grouping(filter_group) + grouping(code) AS INTEGER) AS level, count(*) AS n, CAST(sum(size) AS BIGINT) AS bytes FROM {_ONCE} GROUP BY ROLLUP (filter_group, code)")
def r01_log_rollup(spark, d):
    """Requests and bytes by group and code with subtotals: an extension of the log reports."""
    df = log_once(spark, d, "filter_group", "code", "size")
    return df.rollup("filter_group", "code").agg((F.grouping("filter_group").cast("int") + F.grouping("code").cast("int")).alias("level"), F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"))
