"""Packed fields, balance, sessions, dedupe and log fields against brute force."""

import random
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sieveline.functions import logfields as L
from sieveline.operators.balance import balanced_aggregate, balanced_join, key_loads, load_plan, pack
from sieveline.operators.dedupe import once_per_id, repeated
from sieveline.operators.packed import Packing, split_packed, tokenize
from sieveline.operators.sessions import sessions


@pytest.mark.parametrize(
    "text,values",
    [
        (None, []), ("", []), (" \t ,;|", []), ("a", ["a"]), (" a b ,c", ["a b", "c"]), ('"a, b";c', ["a, b", "c"]),
        ("'x|y' | z", ["x|y", "z"]), ("Kids' Pages, O'Neil", ["Kids' Pages", "O'Neil"]), ('"Jokes ""A""", b', ['Jokes "A"', "b"]),
        ('"open, b', ['"open', "b"]), ("'a,'b", ["a,", "b"]), ('"", b', ["b"]), (" a ;b", ["a", "b"]), ("a,a", ["a", "a"]),
        ('say "x, y"', ['say "x', 'y"']), ("''", []), ("'a''b'", ["a", "b"]),
    ],
)
def test_tokenize(text, values):
    assert tokenize(text) == values


def test_tokenize_nesting_and_escapes():
    how = Packing(brackets="()[]", escape="\\")
    assert tokenize("f(a, b), [c; [d, e]], g", how) == ["f(a, b)", "[c; [d, e]]", "g"]
    assert tokenize("a\\, b, c", how) == ["a, b", "c"]
    assert tokenize('"a\\" b", c', how) == ['a" b', "c"]
    assert tokenize("open(a, b, c", how) == ["open(a", "b", "c"]
    assert tokenize("N/A, x", Packing(no_values=("N/A",))) == ["x"]
    assert tokenize("a%2Cb+c%20d%ZZ", Packing(decode="percent")) == ["a", "b+c d%ZZ"]


def test_tokenize_long_text_is_quick():
    assert len(tokenize("'a, " * 50_000)) > 10_000
    assert len(tokenize('"x' * 100_000)) >= 1


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="ab,;|'\" é", min_size=1, max_size=8), max_size=6))
def test_quoted_values_come_back(values):
    values = [v for v in values if v.strip(L.WHITE)]
    text = ",".join('"' + v.replace('"', '""') + '"' for v in values)
    assert tokenize(text) == values


def test_split_packed_rows(spark):
    df = spark.createDataFrame([(1, "a, b", 5), (1, "a, b", 5), (None, "c", 1), (2, None, 1), (3, "", 1)], "id long, f string, pos int")
    got = sorted(map(tuple, split_packed(df, "f", ["id"]).collect()), key=repr)
    assert got == sorted([(1, 1, "a"), (1, 2, "b"), (1, 1, "a"), (1, 2, "b"), (None, 1, "c")], key=repr)
    some = split_packed(df, "f", ["id"], only=F.col("pos") == 5).collect()
    assert sorted(map(tuple, some), key=repr) == sorted([(1, 1, "a"), (1, 2, "b"), (1, 1, "a"), (1, 2, "b"), (None, 1, "c")], key=repr)
    none = split_packed(df, "f", ["id"], only=F.lit(None).cast("boolean")).collect()
    assert sorted(map(tuple, none), key=repr) == sorted([(1, 1, "a, b"), (1, 1, "a, b"), (None, 1, "c")], key=repr)
    with pytest.raises(ValueError):
        split_packed(df, "f", ["pos"])
    assert split_packed(df.limit(0), "f", ["id"]).collect() == []


def test_pack_is_even():
    tasks = pack([1000, 300, 100], 2000, 8)
    load = defaultdict(float)
    for n, t in zip([1000, 300, 100], tasks):
        for x in t:
            load[x] += n / len(t)
    assert max(load.values()) + 600 / 8 < 1.3 * 2000 / 8


def rows_with_hot_key(n=3000):
    rng = random.Random(3)
    return [(rng.choice(["hot"] * 20 + [None, "a", "b", "c"] + [f"k{i}" for i in range(30)]), i, rng.randrange(100)) for i in range(n)]


def test_key_loads_find_hot_keys(spark):
    df = spark.createDataFrame(rows_with_hot_key(), "k string, id long, v long").repartition(3)
    loads = {r["k0"]: r["load"] for r in key_loads(df, ["k"], summary=10).collect() if not r["is_total"]}
    true = sum(r[0] == "hot" for r in rows_with_hot_key())
    assert true - 3000 / 10 <= loads["hot"] <= true
    plan = load_plan(df, ["k"], 4).collect()
    assert any(r["k0"] == "hot" and len(r["tasks"]) > 1 for r in plan)


def test_balanced_aggregate(spark):
    rows = rows_with_hot_key()
    df = spark.createDataFrame(rows, "k string, id long, v long")
    got = balanced_aggregate(df, ["k"], {"n": F.count(F.lit(1)), "s": F.sum("v")}, {"n": F.sum("n"), "s": F.sum("s")}, n_tasks=6)
    want = defaultdict(lambda: [0, 0])
    for k, _, v in rows:
        want[k][0] += 1
        want[k][1] += v
    assert {r["k"]: [r["n"], r["s"]] for r in got.collect()} == dict(want)
    assert balanced_aggregate(df.limit(0), ["k"], {"n": F.count(F.lit(1))}, {"n": F.sum("n")}).collect() == []
    with pytest.raises(ValueError):
        balanced_aggregate(df, ["k"], {"k": F.count(F.lit(1))}, {})


def test_balanced_join(spark):
    rows = rows_with_hot_key(800)
    left = spark.createDataFrame(rows, "k string, id long, v long")
    right = spark.createDataFrame([("hot", "x"), ("hot", "y"), ("a", "z"), (None, "n"), ("none", "q")], "k string, w string")
    for how in ("inner", "left", "left_semi", "left_anti"):
        got = balanced_join(left, right, ["k"], how, n_tasks=5)
        assert sorted(map(repr, got.collect())) == sorted(map(repr, left.join(right, ["k"], how).select(got.columns).collect()))
    with pytest.raises(ValueError):
        balanced_join(left, right.withColumn("v", F.lit(1)), ["k"])


def exchanges(df):
    """Kinds of the shuffles of a plan, with broadcasts off."""
    import re

    return re.findall(r"Exchange (\w+)\(", df._jdf.queryExecution().executedPlan().toString())


def test_fragments_stay_where_the_plan_put_them(spark):
    """No shuffle stands between the placement and the join or the fragments' aggregates."""
    left = spark.createDataFrame(rows_with_hot_key(100), "k string, id long, v long")
    right = spark.createDataFrame([("hot", "x")], "k string, w string")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kinds = exchanges(balanced_join(left, right, ["k"], "left", n_tasks=5))
        assert kinds.count("shufflepartitionidpassthrough") == 2
        plan = balanced_join(left, right, ["k"], "left", n_tasks=5)._jdf.queryExecution().executedPlan().toString()
        assert plan.split("Join ")[1].split("Exchange ")[1].startswith("shufflepartitionidpassthrough")
        total = balanced_aggregate(left, ["k"], {"n": F.count(F.lit(1))}, {"n": F.sum("n")}, n_tasks=5)._jdf.queryExecution().executedPlan().toString()
        last, before_it = total.split("Exchange ")[1:3]
        assert last.startswith("hashpartitioning(k#") and "__task" not in last.split(")")[0] and before_it.startswith("shufflepartitionidpassthrough")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_as_many_large_keys_as_tasks_are_found(spark):
    """8,000 keys of one task's mean load each, 8,000 tasks, one input partition, in the worst order."""
    df = spark.range(8000 * 12, numPartitions=1).select((F.col("id") % 8000).alias("k"))
    assert load_plan(df, ["k"], 8000).count() == 8000
    assert all(len(r["tasks"]) >= 1 for r in load_plan(df, ["k"], 100).collect())


def brute_sessions(events, gap):
    by, out = defaultdict(list), []
    for a, t in events:
        if a is not None and t is not None:
            by[a].append(t)
    for a, ts in by.items():
        ts.sort()
        start = last = ts[0]
        n = 0
        for t in ts:
            if t - last > gap:
                out.append((a, start, last, last - start, n))
                start, n = t, 0
            last, n = t, n + 1
        out.append((a, start, last, last - start, n))
    return sorted(out)


@pytest.mark.parametrize("gap,chunk", [(10, 30), (10, 7), (0, 5), (100, 25), (3, 1)])
def test_sessions(spark, gap, chunk):
    rng = random.Random(gap)
    events = [(rng.choice("aab") if rng.random() > 0.05 else None, rng.randrange(-300, 700) if rng.random() > 0.05 else None) for _ in range(300)]
    events += events[:20] + [("one", 5)]
    df = spark.createDataFrame(events, "actor string, s long")
    assert sorted(map(tuple, sessions(df, "actor", "s", gap, chunk).collect())) == brute_sessions(events, gap)
    assert sessions(df.limit(0), "actor", "s").collect() == []


def test_once_per_id(spark):
    df = spark.createDataFrame([(1, "b", 2), (1, "a", 1), (None, "x", 1), (None, "x", 1), (2, None, None)], "id long, v string, t int")
    got = sorted(map(repr, once_per_id(df, "id", ["t"]).collect()))
    assert len(got) == 4 and sum("id=1," in r and "v='a'" in r for r in got) == 1


def test_repeated(spark):
    df = spark.createDataFrame([("a", 3), ("b", 0), ("c", 25_001), (None, 1), ("d", None)], "k string, n long")
    got = repeated(df, "n", "i").groupBy("k").agg(F.count(F.lit(1)), F.min("i"), F.max("i"), F.countDistinct("i")).collect()
    assert sorted(map(tuple, got), key=str) == sorted([("a", 3, 1, 3, 3), ("c", 25_001, 1, 25_001, 25_001), (None, 1, 1, 1, 1)], key=str)


def test_log_fields(spark):
    users = {"A\\Bob ": "bob", " -": None, "": None, None: None, "annex\\": None, "x": "x", " Z": "z"}
    ips = {"::FFFF:10.0.0.1": "10.0.0.1", " 10.0.0.1 ": "10.0.0.1", "0.0.0.0": None, "-": None, "1.2.3.256": None, "fe80::1": None, None: None}
    urls = {"http://u:p@Host.Ex.:80/a@b": "host.ex", "HTTPS://h?x=/": "h", "//h/": "h", "": None, "-": None, "nonsense": None, "http://[::1]:8/": "[::1]"}
    times = {
        "2023.1.2 1:00:00": 1672621200, "2023.01.02 01:00:00 1672621200.8": 1672621200, "1672621200.9": 1672621200, "1672621200": 1672621200,
        "2023-01-02T01:00:00Z": 1672621200, "2023.2.30 1:00:00": None, "2023.1.2 25:00:00": None, "-": None, "soon": None,
    }
    for f, cases in ((L.user_key, users), (L.ip_key, ips), (L.site_key, urls), (L.epoch_seconds, times)):
        df = spark.createDataFrame([(k,) for k in cases], "c string")
        got = {r[0]: r[1] for r in df.select("c", f(F.col("c"))).collect()}
        assert got == cases, f.__name__
    assert spark.range(1).select(L.log_day(F.lit(1672621200))).first()[0] == "2023-01-02"
