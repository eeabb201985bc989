"""Streams run to their end give what the batch operators give, with repeats, late records and several batches."""

import os
import shutil

import duckdb
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from sieveline.plans import access, logs
from sieveline.plans import streams as P
from sieveline.streaming import state as ST

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    """The smallest tables with the log in 40 files, so that it comes in three batches."""
    d = tmp_path_factory.mktemp("streams")
    for f in os.listdir(SF):
        if f != "access_log.parquet":
            shutil.copy(f"{SF}/{f}", d / f)
    t = pq.read_table(f"{SF}/access_log.parquet")
    os.makedirs(d / "access_log.parquet")
    n = -(-t.num_rows // 40)
    for k in range(40):
        path = d / "access_log.parquet" / f"part-{k:05}.parquet"
        pq.write_table(t.slice(k * n, n), path)
        os.utime(path, (1_700_000_000 + k, 1_700_000_000 + k))
    return str(d)


@pytest.fixture(scope="module")
def late(tmp_path_factory):
    """The smallest log in two batches, and its records once more, 40 days older under other ids, in a third one.

    A batch's late rows are told by the watermark of the batch before the last.
    """
    d = tmp_path_factory.mktemp("late")
    for f in os.listdir(SF):
        if f != "access_log.parquet":
            shutil.copy(f"{SF}/{f}", d / f)
    t = pq.read_table(f"{SF}/access_log.parquet")
    old = duckdb.sql(f"SELECT * REPLACE (log_id + 1000000 AS log_id, CAST({access._WHEN} - 40 * 86400 AS VARCHAR) AS when_txt) FROM t").to_arrow_table().cast(t.schema)
    os.makedirs(d / "access_log.parquet")
    n = -(-t.num_rows // 32)
    for k, part in enumerate([*(t.slice(k * n, n) for k in range(32)), old]):
        path = d / "access_log.parquet" / f"part-{k:05}.parquet"
        pq.write_table(part, path)
        os.utime(path, (1_700_000_000 + k, 1_700_000_000 + k))
    return str(d)


def rows(df):
    return sorted(map(tuple, df.collect()))


@pytest.fixture(params=["one file", "three batches"])
def d(request, folder):
    return SF if request.param == "one file" else folder


def test_sessions(spark, d):
    assert rows(P.t_sessions_stream(spark, d)) == rows(access.p5_sessions(spark, d).select("actor", "start_s", "end_s", "n_events"))


def test_violations(spark, d):
    want = rows(logs.a09_violations(spark, d).select("u", "first", "last", "n"))
    assert want and rows(P.t07_violations_stream(spark, d)) == want


def test_clean_cache(spark, d):
    df = logs._requests(spark, d, "is_naughty").filter("url IS NOT NULL AND s IS NOT NULL AND filter_group IS NOT NULL AND NOT is_naughty")
    want = ST.cache_hits(df, ["url", "filter_group"], "s", ["log_id"]).select("url", F.col("filter_group").cast("long"), "s", "is_hit")
    assert rows(logs.t01_clean_cache(spark, d).groupBy("is_hit").count()) == rows(want.groupBy("is_hit").count())
    assert rows(P.t01_clean_cache_stream(spark, d)) == rows(want)


def test_cache_entries(spark, d):
    df = logs.t01_cache_entries(spark, d)
    assert rows(P.t01_cache_entries_stream(spark, d)) == rows(df.select("url", F.col("filter_group").cast("long"), "put_s", "last_s", "n_hits"))


def test_active_clients(spark, d):
    """Every tick is there, and the sketch is near the exact number."""
    got = P.k08_active_stream(spark, d).collect()
    assert got and all(r["is_near"] for r in got)


def test_active_clients_of_records_that_come_weeks_late(spark, late):
    got, today = P.k08_active_stream(spark, late).collect(), P.k08_active_stream(spark, SF).count()
    assert len(got) == 2 * today and all(r["is_near"] for r in got)


def test_cache_entries_of_records_that_come_weeks_late(spark, late):
    want = rows(logs.t01_cache_entries(spark, late).select("url", F.col("filter_group").cast("long"), "put_s", "last_s", "n_hits"))
    assert len(want) == 2 * logs.t01_cache_entries(spark, SF).count() and rows(P.t01_cache_entries_stream(spark, late)) == want


def test_violations_of_records_that_come_weeks_late(spark, late):
    want = rows(logs.a09_violations(spark, late).select("u", "first", "last", "n"))
    assert want and rows(P.t07_violations_stream(spark, late)) == want


def test_active_clients_of_many_ticks_are_exact(spark, tmp_path):
    """Each of 3,000 ticks has 13 clients: a sketch puts some of them off by two."""
    at = str(tmp_path / "many")
    spark.range(78_000).selectExpr("concat('a', id div 2) AS a", "timestamp_seconds(id div 26 * 180) AS ts").coalesce(1).write.parquet(at)
    got = P.S.active_clients(spark.read.parquet(at), "a", "ts")
    assert got.filter("n <> 13").count() == 0 and got.count() == 3000


def test_sessions_of_records_that_come_weeks_late(spark, late):
    want = rows(access.p5_sessions(spark, late).select("actor", "start_s", "end_s", "n_events"))
    assert len(want) == 2 * access.p5_sessions(spark, SF).count() and rows(P.t_sessions_stream(spark, late)) == want


def test_records_without_id_are_kept_and_too_late_ones_raise(spark, tmp_path):
    def log(name, batches):
        at = tmp_path / name
        os.makedirs(at)
        for k, b in enumerate(batches):
            spark.createDataFrame(b, "log_id long, actor string, s long").selectExpr("log_id", "actor", "timestamp_seconds(s) AS ts").coalesce(1).write.parquet(str(at / str(k)))
            for f in (at / str(k)).glob("*.parquet"):
                os.utime(f, (1_700_000_000 + k, 1_700_000_000 + k))
        return spark.readStream.schema("log_id long, actor string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(f"{at}/*")

    run = lambda df: P.closed(df, lambda s: P.S.sessions(s, F.col("actor"), "ts", late=None)).select("actor", "n")
    assert rows(run(log("kept", [[(None, "a", 100), (None, "a", 100), (7, "a", 200)], [(7, "a", 200), (8, "b", 5_000_000)]]))) == [("a", 3), ("b", 1)]
    with pytest.raises(RuntimeError, match="late"):
        run(log("late", [[(1, "a", 10_000_000)], [(2, "a", 9_000_000)], [(3, "a", 100)], [(4, "b", 100)]]))
