"""Queries that run a stream over the log to its end and read what it wrote."""

from __future__ import annotations

import contextlib
import datetime
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.functions import logfields as L
from sieveline.operators.verdict import hits_by_list
from sieveline.operators.match import site_keys
from sieveline.plans.access import _IP, _ONCE, _TRIM, _USER, _WHEN, log_once
from sieveline.plans.access import Q as _ACCESS
from sieveline.plans.registry import QuerySet
from sieveline.session import table
from sieveline.streaming import streams as S

Q = QuerySet()

#: How far a record may lie behind the newest one before it and still count, where nothing else is said; one that
#: comes later still is an error, never a row less. Queries over a log ask it for its own (limits).
LATE = "10 days"

#: Time of the row that closes a stream: later than any record by more than every limit of time, and one that pandas holds.
END = datetime.datetime(2200, 1, 1, tzinfo=datetime.timezone.utc)


_P5 = _ACCESS.sql["p5_sessions"]
_REQ = f"(SELECT * FROM (SELECT *, {_WHEN} AS s FROM {_ONCE}) WHERE s IS NOT NULL)"
_CLEAN = f"{_REQ} WHERE {_TRIM('url')} NOT IN ('', '-') AND filter_group IS NOT NULL AND NOT is_naughty"
#: SQL of the batch queries that streams give the rows of.
_HITS = f"SELECT log_id, url, filter_group, s, coalesce(s - lag(s) OVER (PARTITION BY url, filter_group ORDER BY s, log_id) <= 900, false) AS is_hit FROM {_CLEAN}"
_ENTRIES = f"""WITH m AS (SELECT url, filter_group, s, count(*) AS n FROM {_CLEAN} GROUP BY ALL),
 o AS (SELECT *, CASE WHEN s - lag(s) OVER w <= 900 THEN 0 ELSE 1 END AS o FROM m WINDOW w AS (PARTITION BY url, filter_group ORDER BY s)),
 k AS (SELECT *, sum(o) OVER (PARTITION BY url, filter_group ORDER BY s ROWS UNBOUNDED PRECEDING) AS k FROM o)
 SELECT url, filter_group, min(s) AS put_s, max(s) AS last_s, CAST(sum(n) - 1 AS BIGINT) AS n_hits FROM k GROUP BY url, filter_group, k"""
_ALERTS = f"""WITH v AS (SELECT {_USER} AS u, s, row_number() OVER (PARTITION BY {_USER} ORDER BY s, log_id) AS k FROM {_REQ} WHERE is_naughty)
 SELECT u, min(s) AS first, max(s) AS last, count(*) AS n FROM v WHERE u IS NOT NULL GROUP BY u, (k - 1) // 3 HAVING count(*) = 3 AND max(s) - min(s) <= 86400"""


def shared_folder(spark: SparkSession) -> str:
    """A new folder below the one that the cluster shares; a local one only where none is set and Spark is local."""
    root = spark.conf.get("spark.checkpoint.dir", "")
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="sieveline-stream-")
    return f"{root}/stream-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Removes a folder from whatever file system it lies in."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@contextlib.contextmanager
def state_on_disk(spark: SparkSession) -> Iterator[None]:
    """Streams started within keep their state in RocksDB, in bounded memory, and only the versions they may resume from.

    A commit writes what changed; whole states are written in the background.
    """
    store = "spark.sql.streaming.stateStore"
    wanted = {
        f"{store}.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        f"{store}.rocksdb.boundedMemoryUsage": "true",
        f"{store}.rocksdb.maxMemoryUsageMB": "256",
        f"{store}.rocksdb.changelogCheckpointing.enabled": "true",
        f"{store}.rocksdb.trackTotalNumberOfRows": "false",
        "spark.sql.streaming.minBatchesToRetain": "2",
    }
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def limits(spark: SparkSession, d: str) -> tuple[str, datetime.datetime]:
    """How late records of the log come at most, however its files follow each other, and a time that closes all.

    The stream takes files by their time of change, and files of the same time in any order. So a record lies behind
    the newest one of all files that may come before its own. The driver gets a row for each time of change; the
    stream's source holds one for each file as well.
    """
    read = table(spark, d, "access_log").select(L.epoch_seconds(F.col("when_txt")).alias("s"), F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_modification_time").alias("at"))
    files = read.filter("s IS NOT NULL").groupBy("at", "path").agg(F.min("s").alias("first"), F.max("s").alias("last"))
    times = files.groupBy("at").agg(F.count(F.lit(1)).alias("n"), F.min("first").alias("first"), F.max("last").alias("last")).orderBy("at").collect()
    most, newest = 0, None
    for r in times:
        if r["n"] > 1:  # any of them may be the last
            newest = r["last"] if newest is None else max(newest, r["last"])
        if newest is not None:
            most = max(most, newest - r["first"])
        newest = r["last"] if newest is None else max(newest, r["last"])
    last = datetime.datetime.fromtimestamp((newest or 0) + most, tz=datetime.timezone.utc) + datetime.timedelta(days=10)
    return f"{most + 1} seconds", max(END, last)


def log_stream(spark: SparkSession, d: str) -> DataFrame:
    """The log as a stream of files; ts is the logged time."""
    df = table(spark, d, "access_log")
    path, reader = f"{d}/access_log.parquet", spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 16)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory():
        stream = reader.parquet(path)
    else:  # a stream reads folders: the table is a single file of its folder
        stream = reader.option("pathGlobFilter", "access_log.parquet").parquet(d)
    seconds = L.epoch_seconds(F.col("when_txt"))
    return stream.withColumn("ts", F.timestamp_seconds(seconds)).filter("ts IS NOT NULL")


def finished(stream: DataFrame) -> DataFrame:
    """Runs a stream over what there is and reads its rows."""
    at = shared_folder(stream.sparkSession)
    query = stream.writeStream.format("parquet").option("path", f"{at}/rows").option("checkpointLocation", f"{at}/state").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    remove(stream.sparkSession, f"{at}/state")
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{at}/rows")


def closed(log: DataFrame, operator: Callable[[DataFrame], DataFrame], late: str = LATE, end: datetime.datetime = END) -> DataFrame:
    """Runs an operator over the log's records, each id once, to the end, and reads its rows.

    log: log_id, ts and other columns. When the log is read, the query is resumed for one more row at end, which
    takes the watermark past all windows and times that are still open. That row itself stays behind in the state.
    A record beyond late would be missing in the result, so it raises RuntimeError.
    """
    spark, at = log.sparkSession, shared_folder(log.sparkSession)
    schema = log.schema
    spark.createDataFrame([], schema).write.parquet(f"{at}/closing")
    with_end = log.unionByName(spark.readStream.schema(schema).parquet(f"{at}/closing"))
    # records without an id can't be told apart: each is one of its own
    marked = with_end.withWatermark("ts", late).withColumn("__own", F.when(F.col("log_id").isNull(), F.uuid()))
    out = operator(marked.dropDuplicatesWithinWatermark(["log_id", "__own"]).drop("__own"))

    def run() -> None:
        query = out.writeStream.format("parquet").option("path", f"{at}/rows").option("checkpointLocation", f"{at}/state").outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
        lost = sum(o["numRowsDroppedByWatermark"] for p in query.recentProgress for o in p["stateOperators"])
        if lost:
            raise RuntimeError(f"at least {lost} records came more than {late} late")

    with state_on_disk(spark):
        run()
    # the values only have to pass filters for nulls
    blank = {"string": "", "timestamp": end}
    row = tuple(None if f.name == "log_id" else blank.get(f.dataType.simpleString(), 0) for f in schema.fields)
    spark.createDataFrame([row], schema).write.mode("append").parquet(f"{at}/closing")
    with state_on_disk(spark):
        run()
    remove(spark, f"{at}/state")
    return spark.read.schema(out.schema).parquet(f"{at}/rows")


@Q.add("t01_clean_cache_stream", f"SELECT url, CAST(filter_group AS BIGINT) AS grp, s AS t_s, is_hit FROM ({_HITS})")
def t01_clean_cache_stream(spark, d):
    """Requests of t01_clean_cache, as a stream."""
    df = log_stream(spark, d).withColumn("url", L.raw_value(F.col("url"))).filter("url IS NOT NULL AND filter_group IS NOT NULL AND NOT is_naughty")
    return closed(df.select("log_id", "url", "filter_group", "ts"), lambda s: S.clean_cache(s, "url", "filter_group", "ts"))


@Q.add("t01_cache_entries_stream", f"SELECT url, CAST(filter_group AS BIGINT) AS grp, put_s, last_s, n_hits FROM ({_ENTRIES})")
def t01_cache_entries_stream(spark, d):
    """Entries of t01_cache_entries, as a stream."""
    df = log_stream(spark, d).withColumn("url", L.raw_value(F.col("url"))).filter("url IS NOT NULL AND filter_group IS NOT NULL AND NOT is_naughty")
    return closed(df.select("log_id", "url", "filter_group", "ts"), lambda s: S.cache_entries(s, "url", "filter_group", "ts"), *limits(spark, d))


@Q.add("t05_deliver_once_stream", "SELECT DISTINCT log_id FROM access_log WHERE regexp_matches(coalesce(when_txt, ''), '[0-9]')")
def t05_deliver_once_stream(spark, d):
    return finished(S.once(log_stream(spark, d).select("log_id", "ts"), "log_id", "ts", "40 days").select("log_id"))


@Q.add("t07_violations_stream", f"SELECT u AS key, first, last, n FROM ({_ALERTS})")
def t07_violations_stream(spark, d):
    """Alerts of a09_violations, as a stream."""
    df = log_stream(spark, d).filter("is_naughty").withColumn("u", L.user_key(F.col("user_name"))).filter("u IS NOT NULL")
    return closed(df.select("log_id", "u", "ts"), lambda s: S.violation_alerts(s, "u", "ts", 3, 86_400), *limits(spark, d))


@Q.add("t08_reloaded_rules_stream", """SELECT DISTINCT log_id FROM (SELECT log_id, regexp_replace(regexp_extract(lower(trim(url)), '//(?:[^/?#]*@)?([^/?#:]*)', 1), '\\.$', '') AS h FROM access_log WHERE regexp_matches(coalesce(when_txt, ''), '[0-9]'))
 JOIN (SELECT DISTINCT lower(trim(item)) AS item FROM rules_item WHERE list_name = 'bannedsite') ON h = item OR ends_with(h, '.' || item)""")
def t08_reloaded_rules_stream(spark, d):
    """Every batch judged by the rules as they are when it comes."""
    at = shared_folder(spark)
    rules = S.Rules([f"{d}/rules_item.parquet"], lambda s: {"sites": s.read.parquet(f"{d}/rules_item.parquet").filter("list_name = 'bannedsite'")})

    def judge(batch: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
        return hits_by_list(site_keys(batch, ["log_id"], F.col("site")), ["log_id"], tables["sites"]).select("log_id")

    stream = log_stream(spark, d).select("log_id", L.site_key(F.col("url")).alias("site"))
    S.judged(stream, rules, judge, f"{at}/verdicts", f"{at}/state").awaitTermination()
    return spark.read.parquet(f"{at}/verdicts").select("log_id").distinct()


@Q.add("k08_active_stream", f"SELECT s // 180 * 180 AS start_s, CAST(count(DISTINCT a) AS BIGINT) AS n, true AS is_near FROM (SELECT {_IP} AS a, {_WHEN} AS s FROM {_ONCE}) WHERE a IS NOT NULL AND s IS NOT NULL GROUP BY 1")
def k08_active_stream(spark, d):
    """Addresses with requests in each tick, by the stream, held against the number of the log.

    is_near: the two differ by at most 15 % or by one; both are exact. a08_active_ips tells the
    addresses of the day before each tick, exactly.
    """
    df = log_stream(spark, d).withColumn("a", L.ip_key(F.col("ip"))).filter("a IS NOT NULL")
    ticks = closed(df.select("log_id", "a", "ts"), lambda s: S.active_clients(s, "a", "ts", late=None), *limits(spark, d)).select(F.unix_timestamp("start").alias("start_s"), F.col("n").alias("about"))
    log = log_once(spark, d, L.ip_key(F.col("ip")).alias("a"), L.epoch_seconds(F.col("when_txt")).alias("s")).filter("a IS NOT NULL AND s IS NOT NULL")
    exact = log.groupBy((F.floor(F.col("s") / 180) * 180).cast("long").alias("start_s")).agg(F.countDistinct("a").alias("n"))
    near = F.abs(F.col("about") - F.col("n")) <= F.greatest(F.lit(1.0), 0.15 * F.col("n"))
    return exact.join(ticks, "start_s", "full").select("start_s", "n", F.coalesce(near, F.lit(False)).alias("is_near"))


@Q.add("t_sessions_stream", f"SELECT actor, start_s, end_s, n_events FROM ({_P5})")
def t_sessions_stream(spark, d):
    """Sessions of p5_sessions, as a stream: of users, or of addresses where no user is known."""
    actor = F.coalesce(F.concat(F.lit("user:"), L.user_key(F.col("user_name"))), F.concat(F.lit("ip:"), L.ip_key(F.col("ip"))))
    df = log_stream(spark, d).withColumn("actor", actor).filter("actor IS NOT NULL")
    out = closed(df.select("log_id", "actor", "ts"), lambda s: S.sessions(s, F.col("actor"), "ts", late=None), *limits(spark, d))
    return out.select("actor", F.unix_timestamp("start").alias("start_s"), (F.unix_timestamp("end") - 1800).alias("end_s"), F.col("n").alias("n_events"))
