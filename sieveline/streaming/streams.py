"""The same state in Structured Streaming: keyed state with a time limit, watermarked windows, reloaded rules."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


#: Stands for "none yet" where a state holds a time.
_NEVER = -(1 << 62)


def _due(parts: Iterator[pd.DataFrame], state: GroupState, pending: str) -> tuple[list[int], list[int]]:
    """Times that no later row can come before any more, in order, and those that still have to wait.

    Rows up to the watermark can't come any more, so what a key has up to it is complete.
    """
    times = sorted([*map(int, pending.split()), *(t for p in parts for t in p["t_s"].tolist())])
    mark = state.getCurrentWatermarkMs()
    n = sum(t * 1000 <= mark for t in times)
    return times[:n], times[n:]


def _texts(times: list[int]) -> str:
    return " ".join(map(str, times))


def clean_cache(stream: DataFrame, url: str, group: str, t: str, ttl_s: int = 900) -> DataFrame:
    """(url, grp, t_s, is_hit) of a stream's requests; the stream must have a watermark on t.

    A request comes out when the watermark has reached it, so requests of a key are judged in order of their
    time, however they come. State: the last time of each url and group, dropped ttl_s after it in event time,
    and the times the watermark hasn't reached. A global limit of entries would need one task for all keys, so
    there is none.
    """

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, pending = state.get if state.exists else (_NEVER, "")
        due, waiting = _due(parts, state, pending)
        hits = []
        for s in due:
            hits.append(s - last <= ttl_s)
            last = s
        mark = state.getCurrentWatermarkMs()
        if waiting or (last + ttl_s) * 1000 > mark:
            state.update((last, _texts(waiting)))
            state.setTimeoutTimestamp(waiting[0] * 1000 if waiting else (last + ttl_s) * 1000)
        elif state.exists:
            state.remove()
        yield pd.DataFrame({"url": key[0], "grp": key[1], "t_s": pd.Series(due, dtype="int64"), "is_hit": pd.Series(hits, dtype="bool")})

    keyed = stream.select(F.col(url).alias("url"), F.col(group).cast("long").alias("grp"), F.col(t), F.unix_timestamp(t).alias("t_s"))
    return keyed.groupBy("url", "grp").applyInPandasWithState(step, "url string, grp long, t_s long, is_hit boolean", "last long, pending string", "append", GroupStateTimeout.EventTimeTimeout)


def cache_entries(stream: DataFrame, url: str, group: str, t: str, ttl_s: int = 900) -> DataFrame:
    """(url, grp, put_s, last_s, n_hits) of a stream with a watermark on t: each entry of the cache of clean urls.

    An entry lives until its url wasn't asked for in its group for more than ttl_s, so it is a session: its first
    request put it in, all others were hits. State is one row for each entry that lives, and all of it is native;
    clean_cache judges request by request, in Python.
    """
    named = stream.select(F.col(url).alias("url"), F.col(group).cast("long").alias("grp"), F.col(t), F.unix_timestamp(t).alias("t_s"))
    entries = named.groupBy("url", "grp", F.session_window(t, f"{ttl_s} seconds")).agg(F.min("t_s").alias("put_s"), F.max("t_s").alias("last_s"), (F.count(F.lit(1)) - 1).alias("n_hits"))
    return entries.select("url", "grp", "put_s", "last_s", "n_hits")


def violation_alerts(stream: DataFrame, key: str, t: str, violations: int, threshold_s: int = 0) -> DataFrame:
    """(key, first, last, n) as a stream with a watermark on t.

    State: the counter and the first time of each key, which no time limits, and the times that the watermark
    hasn't reached; those are counted in order of time once it has.
    """

    def step(name: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        first, n, pending = state.get if state.exists else (0, 0, "")
        due, waiting = _due(parts, state, pending)
        out = []
        for s in due:
            first, n = (s if n == 0 else first), n + 1
            if n == violations:
                if not threshold_s or s - first <= threshold_s:
                    out.append((name[0], first, s, n))
                first, n = 0, 0
        state.update((first, n, _texts(waiting)))
        if waiting:
            state.setTimeoutTimestamp(waiting[0] * 1000)
        yield pd.DataFrame(out, columns=["key", "first", "last", "n"])

    keyed = stream.select(F.col(key).alias("key"), F.col(t), F.unix_timestamp(t).alias("t_s")).filter("key IS NOT NULL")
    return keyed.groupBy("key").applyInPandasWithState(step, "key string, first long, last long, n long", "first long, n long, pending string", "append", GroupStateTimeout.EventTimeTimeout)


def active_clients(stream: DataFrame, client: str, t: str, late: str | None = "1 day", every: str = "180 seconds") -> DataFrame:
    """(start, n): different clients of each tick, late rows counted up to the watermark.

    State: a row for each tick and client, and the number of each tick, until the watermark has passed the tick.
    late: None where the stream has a watermark on t of its own.
    """
    marked = stream.withWatermark(t, late) if late else stream
    pairs = marked.filter(F.col(client).isNotNull()).select(F.window(t, every).alias("window"), F.col(client).alias("client")).dropDuplicates(["window", "client"])
    return pairs.groupBy("window").agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), "n")


def sessions(stream: DataFrame, actor: Column, t: str, gap: str = "1800 seconds", late: str | None = "3 days") -> DataFrame:
    """(actor, start, end, n) of a stream's sessions; end is the last event plus the gap.

    late: None where the stream has a watermark on t of its own.
    """
    named = (stream.withWatermark(t, late) if late else stream).withColumn("actor", actor).filter("actor IS NOT NULL")
    return named.groupBy("actor", F.session_window(t, gap)).agg(F.count(F.lit(1)).alias("n")).select("actor", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def once(stream: DataFrame, id_col: str, t: str, late: str = "7 days") -> DataFrame:
    """Records of a stream that is delivered more than once, each once as long as repeats come within the limit."""
    return stream.withWatermark(t, late).dropDuplicatesWithinWatermark([id_col])


class Rules:
    """Rule tables that are read again when a file's time of change has changed.

    Times are asked of the file system that a path names, so lists in HDFS or an object store are seen too; that
    of a folder is the latest of its own and its files'. A path that isn't there has none, and appears later as
    a change.
    """

    def __init__(self, paths: list[str], load: Callable[[SparkSession], dict[str, DataFrame]]) -> None:
        self.paths, self.load = paths, load
        self.times: tuple = ()
        self.tables: dict[str, DataFrame] = {}
        self.loads = 0

    def _times(self, spark: SparkSession) -> tuple:
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        out = []
        for p in self.paths:
            at = jvm.org.apache.hadoop.fs.Path(p)
            fs = at.getFileSystem(conf)
            if not fs.exists(at):
                out.append(None)
                continue
            own = fs.getFileStatus(at)
            files = fs.listStatus(at) if own.isDirectory() else []
            out.append((max([own.getModificationTime(), *(f.getModificationTime() for f in files)]), len(files), own.getLen()))
        return tuple(out)

    def now(self, spark: SparkSession) -> dict[str, DataFrame]:
        times = self._times(spark)
        if times != self.times:
            self.tables, self.times = self.load(spark), times
            self.loads += 1
        return self.tables


def judged(stream: DataFrame, rules: Rules, judge: Callable[[DataFrame, dict[str, DataFrame]], DataFrame], path: str, checkpoint: str):
    """Starts a query that judges every batch by the rules as they are then, and appends the verdicts as Parquet.

    A batch's verdicts lie in a folder of its number, written over if the batch runs again: each counts once.
    """

    def write(batch: DataFrame, number: int) -> None:
        judge(batch, rules.now(batch.sparkSession)).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
