"""State over the order of events against plain Python, in chunks and whole, with ties, nulls and hot keys."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from sieveline.streaming import state as S
from sieveline.plans import logs

SF = "/root/testdata/sf0.001"


def events(n, keys, seed, top=400_000):
    rng = random.Random(seed)
    return [(i if rng.random() > 0.02 else None, rng.choice(keys), rng.randrange(0, top, rng.choice([1, 50_000]))) for i in range(n)]


def ring(rows, n):
    held = {}
    for t, key, flush in rows:
        if flush:
            held = dict.fromkeys(held, 0)
            continue
        if key not in held and len(held) == n:
            del held[next(iter(held))]
        held[key] = t
    return sorted(held.items())


@pytest.mark.parametrize("chunk_rows", [40, 150, 10_000])
def test_ring(spark, chunk_rows):
    data = sorted((t, i, k) for i, k, t in events(500, [f"k{x}" for x in range(30)], 1) if i is not None)
    df = spark.createDataFrame([(t, i, k, i % 97 == 5) for t, i, k in data], "t long, i long, k string, f boolean").repartition(5)
    got = S.ring_entries(df, "k", "t", ["i"], 7, "f", chunk_rows).collect()
    assert sorted(map(tuple, got)) == ring([(t, k, i % 97 == 5) for t, i, k in data], 7)
    assert S.ring_entries(df.limit(0), "k", "t", ["i"], 7).collect() == []


@pytest.mark.parametrize("chunk_rows", [50, 10_000])
def test_slots(spark, chunk_rows):
    data = sorted((t, k) for _, k, t in events(400, [f"c{x}" for x in range(25)], 2, 60_000))
    df = spark.createDataFrame([*data, (5, None)], "t long, c string")
    slots, tick = {}, 0
    for t, c in data:
        if t // 100 > tick:
            tick = t // 100
            slots = {x: s for x, s in slots.items() if tick * 100 - s <= 3000}
        if c in slots or len(slots) < 6:
            slots[c] = t
    assert sorted(map(tuple, S.ip_slots(df, "c", "t", 6, 3000, 100, chunk_rows).collect())) == sorted(slots.items())
    assert S.ip_slots(df.limit(0), "c", "t", 6).collect() == []


def test_cache_hits_and_entries(spark):
    rows = [(i, k, t) for i, k, t in events(600, ["hot"] * 8 + ["a", "b"], 3, 200_000)]
    rows += [(None, "hot", 77_777)] * 3 + [(5, "a", 99_999)] * 2
    df = spark.createDataFrame([(k, 1, t, i) for i, k, t in rows], "k string, g int, t long, i long")
    by = defaultdict(list)
    for i, k, t in rows:
        by[k].append((t, -1 if i is None else i))
    want, entries = [], []
    for k, ts in by.items():
        last = None
        for t, i in sorted(ts):
            hit = last is not None and t - last <= 900
            want.append((k, t, i, hit))
            if hit:
                entries[-1][2:] = [t, entries[-1][3] + 1]
            else:
                entries.append([k, t, t, 0])
            last = t
    got = S.cache_hits(df, ["k", "g"], "t", ["i"]).select("k", "t", F.coalesce("i", F.lit(-1)), "is_hit")
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert sorted(map(tuple, S.cache_entries(df, ["k", "g"], "t").select("k", "put_s", "last_s", "n_hits").collect())) == sorted(map(tuple, entries))


@pytest.mark.parametrize("violations,threshold", [(1, 0), (3, 0), (3, 50_000), (4, 5000)])
def test_violations(spark, violations, threshold):
    rows = [(k, t) for _, k, t in events(300, ["hot"] * 5 + ["a", None], 4)] + [("burst", 86_400)] * 25
    by, want = defaultdict(list), []
    for k, t in rows:
        if k:
            by[k].append(t)
    for k, ts in by.items():
        ts.sort()
        for at in range(0, len(ts) - violations + 1, violations):
            first, last = ts[at], ts[at + violations - 1]
            if not threshold or last - first <= threshold:
                want.append((k, first, last, violations))
    df = spark.createDataFrame(rows, "k string, t long")
    assert sorted(map(tuple, S.violation_alerts(df, "k", "t", violations, threshold).collect())) == sorted(want)


def test_no_rows_of_a_hot_key_meet_before_they_are_counted(spark):
    """What is partitioned by a key and its day is counts by second, never rows."""
    df = spark.createDataFrame([("a", 1)], "k string, t long")
    plan = S.by_second(df, ["k"], "t")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Window") < plan.index("Aggregate", plan.index("Window"))
    assert df.count() == 1 and "collect_list" not in plan


def test_log_ring_and_slots_by_plain_python(spark):
    df = logs._requests(spark, SF, "is_naughty").filter("url IS NOT NULL AND s IS NOT NULL AND NOT is_naughty")
    data = sorted((r["s"], -1 if r["log_id"] is None else r["log_id"], r["url"]) for r in df.collect())
    assert sorted(map(tuple, logs.t02_newest_entries(spark, SF).collect())) == ring([(s, u, False) for s, _, u in data], 1000)
    assert sorted(map(tuple, S.ring_entries(df, "url", "s", ["log_id", "url"], 100, chunk_rows=300).collect())) == ring([(s, u, False) for s, _, u in data], 100)
