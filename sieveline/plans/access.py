"""The access log read for analysis, and the queries of problems 3, 4 and 5."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.functions import logfields as L
from sieveline.operators.balance import balanced_aggregate, balanced_join
from sieveline.operators.dedupe import once_per_id
from sieveline.operators.packed import Packing, split_packed
from sieveline.operators.sessions import sessions
from sieveline.plans.registry import QuerySet
from sieveline.session import cut, table

Q = QuerySet()

LOGGED = Packing(no_values=())
DENIED = Packing(no_values=("N/A",), decode="percent")

#: Character class of white space for the oracle's regular expressions.
_WS = r"[\s\x{0b}\x{85}\p{Z}]"
_TRIM = lambda c: f"regexp_replace(regexp_replace({c}, '^{_WS}+', ''), '{_WS}+$', '')"
_ONCE = "(SELECT * FROM access_log QUALIFY log_id IS NULL OR row_number() OVER (PARTITION BY log_id ORDER BY recv_ts) = 1)"
_USER = f"nullif(nullif(regexp_replace(lower({_TRIM('user_name')}), '^.*\\\\', ''), ''), '-')"
_IP = f"nullif(nullif(nullif(regexp_replace(lower({_TRIM('ip')}), '^::ffff:', ''), ''), '-'), '0.0.0.0')"
_SITE = f"nullif(regexp_replace(regexp_extract(lower({_TRIM('url')}), '//(?:[^/?#]*@)?([^/?#:]*)', 1), '\\.$', ''), '')"
_WHEN = f"""CASE WHEN regexp_matches({_TRIM('when_txt')}, '^\\d+(\\.\\d*)?$') THEN CAST(split_part({_TRIM('when_txt')}, '.', 1) AS BIGINT)
 ELSE CAST(epoch(try_strptime(replace(replace(regexp_extract({_TRIM('when_txt')}, '^\\d{{4}}[-.]\\d+[-.]\\d+[ T]\\d+:\\d+:\\d+'), '-', '.'), 'T', ' '), '%Y.%m.%d %H:%M:%S')) AS BIGINT) END"""


def log_once(spark: SparkSession, sf_dir: str, *columns: str | Column) -> DataFrame:
    """Columns of access_log with each log_id once, however often it was delivered.

    Expressions are evaluated before the shuffle, once a row, and only their results are shuffled.
    """
    df = table(spark, sf_dir, "access_log").select("log_id", *columns)
    return once_per_id(df, "log_id")


_SPLIT = r"""regexp_extract_all({0}, '"(?:[^"]|"")*"|''[^'']*''|[^,;|\t\s\p{{Z}}\x{{85}}][^,;|\t]*')"""
_UNQUOTE = """list_filter(list_transform({0}, lambda x: {1}), lambda x: x <> '')"""
_ONE = f"CASE WHEN x LIKE '\"%\"' AND length(x) > 1 THEN replace(x[2:-2], '\"\"', '\"') WHEN x LIKE '''%''' AND length(x) > 1 THEN x[2:-2] ELSE {_TRIM('x')} END"


def _values_sql(field: str) -> str:
    return _UNQUOTE.format(_SPLIT.format(field), _ONE)


@Q.add(
    "p3_found",
    f"""WITH a AS (SELECT 'access_log' AS tbl, log_id AS rec_id, {_values_sql('category')} AS v FROM {_ONCE} WHERE {_TRIM('category')} NOT IN ('', '-')),
 d AS (SELECT 'deny_redirects' AS tbl, block_id AS rec_id, list_filter({_values_sql("url_decode(replace(categories, '+', '%2B'))")}, lambda x: x <> 'N/A') AS v
 FROM deny_redirects WHERE {_TRIM('categories')} NOT IN ('', '-')),
 b AS (SELECT * FROM a UNION ALL SELECT * FROM d)
 SELECT tbl, rec_id, CAST(unnest(generate_series(1, len(v))) AS INTEGER) AS pos, unnest(v) AS val FROM b WHERE len(v) > 0""",
)
def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every value packed in the category fields, with its place."""
    logged = log_once(spark, sf_dir, "category").filter(L.has_value(F.col("category")))
    denied = table(spark, sf_dir, "deny_redirects").select("block_id", "categories").filter(L.has_value(F.col("categories")))
    a = split_packed(logged, "category", ["log_id"], LOGGED).select(F.lit("access_log").alias("tbl"), F.col("log_id").alias("rec_id"), "pos", "val")
    d = split_packed(denied, "categories", ["block_id"], DENIED).select(F.lit("deny_redirects").alias("tbl"), F.col("block_id").alias("rec_id"), "pos", "val")
    return a.unionByName(d)


def item_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests and bytes of every site and every address of the log, by balanced fragments.

    The loads and the totals are taken from one shuffle of the same columns, so the log is read once.
    """
    once = log_once(spark, sf_dir, L.site_key(F.col("url")).alias("url"), L.ip_key(F.col("ip")).alias("ip"), "size")
    pairs = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("item")) for c in ("url", "ip")])
    rows = once.select("log_id", "size", F.explode(pairs).alias("p")).select("p.field", "p.item", "log_id", "size").filter("item IS NOT NULL")
    partial = {"n": F.count(F.lit(1)), "b": F.sum("size"), "most": F.max("size")}
    final = {"n_requests": F.sum("n"), "n_bytes": F.sum("b"), "largest": F.max("most")}
    return balanced_aggregate(rows, ["field", "item"], partial, final, spread=["log_id"])


_ITEMS = f"SELECT 'url' AS field, {_SITE} AS item, size FROM {_ONCE} UNION ALL SELECT 'ip', {_IP}, size FROM {_ONCE}"


@Q.add(
    "p4_totals",
    f"SELECT field, item, count(*) AS n_requests, CAST(sum(size) AS BIGINT) AS n_bytes, max(size) AS largest FROM ({_ITEMS}) WHERE item IS NOT NULL GROUP BY ALL",
)
def p4_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return item_totals(spark, sf_dir)


@Q.add(
    "p4_found",
    f"""WITH t AS (SELECT field, item, count(*) AS n FROM ({_ITEMS}) WHERE item IS NOT NULL GROUP BY ALL)
 SELECT field, item FROM t QUALIFY n >= 0.01 * sum(n) OVER (PARTITION BY field)""",
)
def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sites and addresses held by at least 1 % of the records with a value of that field.

    The totals, a row for each item with its requests and bytes, are written down whole and then read twice.
    """
    totals = cut(item_totals(spark, sf_dir))
    sums = totals.groupBy("field").agg(F.sum("n_requests").alias("n_field"))
    # one row for each of the two fields
    return totals.join(F.broadcast(sums), "field").filter(F.col("n_requests") >= 0.01 * F.col("n_field")).select("field", "item")


@Q.add(
    "p4_user_groups",
    f"""WITH g AS (SELECT {_USER} AS u, min(grp) AS grp FROM user_group GROUP BY 1 HAVING u IS NOT NULL),
 r AS (SELECT {_USER} AS u, size FROM {_ONCE})
 SELECT coalesce(grp, 0) AS grp, count(*) AS n_requests, CAST(sum(size) AS BIGINT) AS n_bytes FROM r LEFT JOIN g USING (u) WHERE u IS NOT NULL GROUP BY 1""",
)
def p4_user_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests and bytes of each group: the log's skewed users joined with the group map, hot users split.

    A user of contradicting groups has the lowest; one without any has group 0.
    """
    log = log_once(spark, sf_dir, L.user_key(F.col("user_name")).alias("u"), "size").filter("u IS NOT NULL")
    groups = table(spark, sf_dir, "user_group").groupBy(L.user_key(F.col("user_name")).alias("u")).agg(F.min("grp").alias("grp")).filter("u IS NOT NULL")
    joined = balanced_join(log, groups, ["u"], "left", spread=["log_id"])
    return joined.groupBy(F.coalesce("grp", F.lit(0)).alias("grp")).agg(F.count(F.lit(1)).alias("n_requests"), F.sum("size").alias("n_bytes"))


def log_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of the log's actors: users, or addresses where no user is known."""
    user, ip = L.user_key(F.col("user_name")), L.ip_key(F.col("ip"))
    actor = F.coalesce(F.concat(F.lit("user:"), user), F.concat(F.lit("ip:"), ip))
    events = log_once(spark, sf_dir, actor.alias("actor"), L.epoch_seconds(F.col("when_txt")).alias("s"))
    return sessions(events, "actor", "s", gap_s=1800)


_SESSIONS = f"""WITH e AS (SELECT coalesce('user:' || {_USER}, 'ip:' || {_IP}) AS actor, {_WHEN} AS s FROM {_ONCE}),
 g AS (SELECT actor, s, count(*) AS n FROM e WHERE actor IS NOT NULL AND s IS NOT NULL GROUP BY ALL),
 m AS (SELECT actor, s, n, CASE WHEN s - lag(s) OVER (PARTITION BY actor ORDER BY s) <= 1800 THEN 0 ELSE 1 END AS o FROM g),
 k AS (SELECT actor, s, n, sum(o) OVER (PARTITION BY actor ORDER BY s ROWS UNBOUNDED PRECEDING) AS k FROM m)"""


@Q.add("p5_found", f"{_SESSIONS} SELECT actor, min(s) AS start_s, max(s) AS end_s FROM k GROUP BY actor, k")
def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log_sessions(spark, sf_dir).select("actor", "start_s", "end_s")


@Q.add("p5_sessions", f"{_SESSIONS} SELECT actor, min(s) AS start_s, max(s) AS end_s, max(s) - min(s) AS duration_s, CAST(sum(n) AS BIGINT) AS n_events FROM k GROUP BY actor, k")
def p5_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log_sessions(spark, sf_dir)
