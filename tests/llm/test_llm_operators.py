"""Training-data operators against brute force, round trips and a library."""

import base64
import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sieveline.llm import bpe
from sieveline.llm.distinct import as_partials, decode_run, distinct_counts, encode_run, hash_runs, merge_runs, union_runs
from sieveline.llm.frequent import Sketch, exact_counts, frequent_values
from sieveline.llm.mixing import mix, mix_shares, mix_violations, source_key, source_rates
from sieveline.llm.splitting import NONE, StrongestCut, piece_violations, split_documents, split_text


@pytest.fixture(scope="module")
def data():
    return open(bpe.VOCABULARY, "rb").read()


@pytest.fixture(scope="module")
def encoder(data):
    return bpe.Encoder(data)


@pytest.fixture(scope="module")
def library(data):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}
    return tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})


PARTS = ["a", " ", "  ", "\n", "\r\n", "'s", "'ll", "é", "日本語", "x" * 90, "-" * 130, "<|endoftext|>", "3.14", "😀", "ing", " The", "\t", " ", "\x1c", "﻿", "ﬁ", "²"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.sampled_from(PARTS), st.text(max_size=6)), max_size=30).map("".join))
def test_ids_equal_the_library(encoder, library, text):
    assert encoder.encode(text) == library.encode_ordinary(text)
    assert encoder.count(text) == len(encoder.encode(text))
    assert encoder.decode(encoder.encode(text)) == text


def test_pieces_equal_the_merges(encoder):
    rng = random.Random(1)
    for _ in range(300):
        piece = "".join(rng.choice("abcdefghij tion-") for _ in range(rng.randint(1, 60)))
        assert [encoder.tokens[i] for i in encoder.encode_bytes(piece)] == encoder.merged(piece)


def test_full_memo_changes_nothing(data, library, monkeypatch):
    monkeypatch.setattr(bpe, "MEMO", 3)
    small, text = bpe.Encoder(data), "ten words of text that fill and clear the little memo, unquestionably"
    assert small.encode(text) == library.encode_ordinary(text) and len(small.memo) <= 3


def test_encode_texts(spark, library, monkeypatch):
    texts = [None, "", " ", "a b", "a b", "x" * 20_000, "<|endoftext|>", "日本\n\n"]
    df = spark.createDataFrame([(i if i else None, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, ids int")
    got = {r["doc_id"]: r["ids"] for r in bpe.encode_texts(df).collect()}
    assert got == {i if i else None: library.encode_ordinary(t or "") for i, t in enumerate(texts)}
    assert bpe.encode_texts(df.limit(0)).collect() == []
    with pytest.raises(ValueError):
        bpe.encode_texts(df, "ids")
    counts = {r["doc_id"]: r["n_tokens"] for r in bpe.count_tokens(df).collect()}
    assert counts == {k: len(v) for k, v in got.items()}


def test_sketch_is_never_low():
    rng = np.random.default_rng(1)
    sketch, true = Sketch(3, 6), Counter()
    hashes = rng.integers(-(2**63), 2**63, 500)
    for _ in range(50):
        some = np.unique(rng.choice(hashes, 40))
        counts = rng.integers(1, 9, len(some))
        estimates = sketch.add(some, counts)
        true.update(dict(zip(some.tolist(), counts.tolist())))
        assert all(e >= true[h] for h, e in zip(some.tolist(), estimates))


def test_candidates_stay_few_and_lose_none():
    import pyarrow as pa

    from sieveline.llm.frequent import Candidates

    rng, heavy, true = random.Random(8), Candidates(0.05), Counter()
    for k in range(2000):
        counts = Counter(rng.choice(["hot"] * 9 + ["warm"] * 2 + [f"v{k}-{rng.randrange(50)}"] * 9) for _ in range(40))
        true.update(counts)
        names = list(counts)
        heavy.offer(pa.array(names), np.array([true[x] for x in names]), 40)
        assert len(heavy.heap) <= 64 + 2 * len(heavy.held) and len(heavy.held) <= 20 + 40 * (k < 20)
    assert {x: n for x, n in true.items() if n >= 0.05 * heavy.total} == {x: n for x, n in heavy.held.items() if n >= 0.05 * heavy.total}


def test_frequent_values(spark):
    rng = random.Random(5)
    values = ["hot"] * 4000 + ["warm"] * 300 + ["tie1"] * 200 + ["tie2"] * 200 + [f"v{rng.randrange(10**6)}" for _ in range(5000)] + [None] * 900 + [""] * 150
    rng.shuffle(values)
    df = spark.createDataFrame([(v, 1) for v in values], "value string, n long").repartition(5)
    true, total = Counter(v for v in values if v is not None), sum(v is not None for v in values)
    got = {r["value"]: r for r in frequent_values(df, "value", 0.01).collect()}
    assert {v for v, n in true.items() if n >= 0.01 * total} <= set(got)
    assert all(true[v] <= r["n_estimate"] <= true[v] + r["max_error"] and r["n_total"] == total for v, r in got.items())
    assert got["hot"]["n_estimate"] == 4000
    assert frequent_values(df.limit(0), "value", 0.1).collect() == []
    counted = {r["value"]: r["n"] for r in exact_counts(df, "value", frequent_values(df, "value", 0.01)).collect()}
    assert counted == {v: true[v] for v in got}
    for share, bits in ((0, None), (0.01, 8), (1e-6, None)):
        with pytest.raises(ValueError):
            frequent_values(df, "value", share, width_bits=bits)


def test_candidates_are_bounded_below_the_noise(spark):
    """A share that a narrow sketch can't tell from noise is refused, or told with a width that holds it."""
    df = spark.range(3_000_000, numPartitions=4).select(F.col("id").cast("string").alias("value"))
    with pytest.raises(ValueError, match="width_bits"):
        frequent_values(df, "value", 4e-5, width_bits=8)
    with pytest.raises(ValueError, match="min_share"):
        frequent_values(df, "value", 4e-6)
    assert frequent_values(df, "value", 1e-5).count() <= 2 / 1e-5
    from sieveline.llm.frequent import Candidates

    import pyarrow as pa

    heavy = Candidates(0.5)
    with pytest.raises(RuntimeError, match="narrow"):
        heavy.offer(pa.array(list(map(str, range(100)))), np.full(100, 60), 100)


def test_streams_are_sketched_once(spark):
    df = spark.range(1000).select((F.col("id") % 10).cast("string").alias("value"))
    found = frequent_values(df, "value", 0.05)
    assert len(found.collect()) == 10
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "ReusedExchange" in plan


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sets(st.integers(0, 2**64 - 1), max_size=30), min_size=1, max_size=5))
def test_runs(sets):
    runs = [np.array(sorted(s), np.uint64) for s in sets]
    for r in runs:
        assert (decode_run(encode_run(r)) == r).all()
    assert union_runs(runs).tolist() == sorted(set().union(*sets))


@pytest.mark.parametrize("most", [4_000_000, 25, 1])
def test_distinct_counts_merge(spark, most):
    rng = random.Random(2)
    rows = [(rng.choice(["d1", "d2", None]), rng.choice([0, 1, None, -1]), rng.choice([None, *map(str, range(60))])) for _ in range(1500)]
    df = spark.createDataFrame(rows, "day string, grp int, v string")
    cells = ["day", "grp"]
    halves = [hash_runs(df.filter(f"pmod(xxhash64(v), 2) = {k}"), cells, F.col("v")) for k in (0, 1)]
    again = hash_runs(df, cells, F.col("v"))  # the same values once more change only n_values
    once = merge_runs(halves[0].unionByName(halves[1]), cells, keep_runs=True, most=7)
    merged = merge_runs(as_partials(once, cells).unionByName(again), cells, over="grp", most=most)
    got = {(r["day"], r["grp"], r["grouping_id"]): (r["n_values"], r["n_distinct"]) for r in distinct_counts(merged, cells).collect()}
    want = defaultdict(list)
    for day, grp, v in rows:
        if v is not None:
            want[day, grp, 0].append(v)
            want[day, None, 1].append(v)
    assert got == {k: (2 * len(v), len(set(v))) for k, v in want.items()}
    assert distinct_counts(merge_runs(hash_runs(df.limit(0), cells, F.col("v")), cells), cells).collect() == []


@pytest.mark.parametrize("most", [4_000_000, 20])
def test_distinct_counts_of_combinations(spark, most):
    rng = random.Random(3)
    rows = [(rng.choice("xy"), rng.choice([1, 2, None]), rng.choice([True, None]), str(rng.randrange(80))) for _ in range(600)]
    df = spark.createDataFrame(rows, "a string, b int, c boolean, v string")
    for over in (["b", "c"], ["a", "b", "c"]):
        cells = ["a", "b", "c"]
        got = {(r["a"], r["b"], r["c"], r["grouping_id"]): r["n_distinct"] for r in distinct_counts(merge_runs(hash_runs(df, cells, F.col("v")), cells, over, most=most), cells).collect()}
        want = defaultdict(set)
        for *cell, v in rows:
            for level in range(1 << len(over)):
                gone = {c for i, c in enumerate(over) if level >> (len(over) - 1 - i) & 1}
                want[(*(None if c in gone else x for c, x in zip(cells, cell)), level)].add(v)
        assert got == {k: len(v) for k, v in want.items()}


def test_runs_follow_the_cells_and_not_the_partitions(spark):
    """A cell below the limit is one range however many partitions there are; a larger one is cut by its size."""
    df = spark.range(40_000, numPartitions=4).select((F.col("id") % 4).alias("c"), F.col("id").alias("v"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2000")
    try:
        runs = hash_runs(df, ["c"], F.col("v"))
        assert {r["n_hashes"] for r in runs.collect()} == {2500}
        assert {r["range"] for r in merge_runs(runs, ["c"]).collect()} == {0}
        cut = merge_runs(runs, ["c"], most=1500).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert {r["range"] for r in cut} == set(range(8)) and all(1000 < r["n_distinct"] < 1500 for r in cut)


def test_collision_bound(spark):
    df = spark.range(1).select(F.lit(1).alias("c"), F.lit(0).alias("grouping_id"), F.lit(10).alias("n_values"), F.lit(4_000_000_000).alias("n_distinct"))
    r = distinct_counts(df, ["c"]).first()
    assert 0.43 < r["lost_expected"] < 0.44


def test_mix(spark):
    rng = random.Random(4)
    docs = [(i, rng.choice(["a", "a", "a", "b", None]), rng.randrange(50, 150)) for i in range(4000)] + [(5000, "tiny", 10)]
    sizes = spark.createDataFrame(docs, "doc_id long, source string, n_tokens long")
    targets = [("m", 1.0, " A", 1.0, 3), ("m", 1.0, "b", 1.0, 3), ("m", 1.0, "tiny", 0.5, 4), ("m", 1.0, "absent", 0.1, 2), ("z", 0.5, "b", 0.0, 1), ("n", 0.1, "a", None, None)]
    rates = source_rates(sizes, spark.createDataFrame(targets, "mix_name string, size_ratio double, source string, weight double, max_copies int"))
    by = {(r["mix_name"], r["source"]): r for r in rates.collect()}
    total = sum(d[2] for d in docs)
    assert abs(by["m", "a"]["target_tokens"] - total / 2.6) < 1
    assert {k for k, r in by.items() if r["is_short"]} == {("m", "tiny"), ("m", "absent")}
    assert by["z", "b"]["rate"] == 0
    picked = mix(sizes, rates)
    rows = picked.collect()
    assert rows == picked.repartition(7).sort("mix_name", "source", "doc_id", "copy").collect() or Counter(map(tuple, rows)) == Counter(map(tuple, picked.repartition(7).collect()))
    copies = Counter((r["mix_name"], r["doc_id"]) for r in rows)
    assert max(copies.values()) <= 4 and copies["m", 5000] == 4
    shares = {(r["mix_name"], r["source"]): r for r in mix_shares(picked, rates).collect()}
    for s in "ab":
        assert abs(shares["m", s]["tokens"] / shares["m", s]["target_tokens"] - 1) < 0.05
        assert abs(shares["m", s]["tokens"] - shares["m", s]["target_tokens"]) < 4 * shares["m", s]["draw_sd"]
    assert shares["m", "absent"]["tokens"] == 0 and shares["m", "tiny"]["draw_sd"] == 0
    assert mix_violations(picked, sizes, rates).collect() == []
    wrong = picked.filter("NOT (mix_name = 'm' AND doc_id = 5000 AND copy = 2)").unionByName(picked.filter("mix_name = 'm' AND doc_id < 5000").limit(1))
    assert {(r["mix_name"], r["doc_id"] == 5000) for r in mix_violations(wrong, sizes, rates).collect()} == {("m", True), ("m", False)}
    keys = spark.createDataFrame([(" Crawl-Pages ",), ("",), (None,)], "s string").select(source_key(F.col("s"))).collect()
    assert [r[0] for r in keys] == ["crawl_pages", None, None]


def test_strongest_cut():
    rng = np.random.default_rng(7)
    s = rng.integers(0, 5, 97)
    cut = StrongestCut(s)
    for a in range(97):
        for b in range(a, 97):
            assert cut.at(a, b) == max(range(a, b + 1), key=lambda k: (s[k], k))


def check_pieces(text, encoder, most, overlap):
    pieces = split_text(text, encoder, most, overlap)
    n = encoder.count(text)
    if not text:
        assert pieces == []
        return
    assert pieces[0][0] == pieces[0][2] == 0 and pieces[-1][1] == n and pieces[-1][3] == len(text)
    for a, b in zip(pieces, pieces[1:]):
        assert a[0] < b[0] <= a[1] and a[2] < b[2] <= a[3]
        if a[1] - a[0] > overlap + 3:
            assert a[1] - overlap - 3 <= b[0] <= a[1] - overlap
    for p in pieces:
        assert p[1] - p[0] <= most + 3 and encoder.count(text[p[2] : p[3]]) <= most
    assert (len(pieces) > 1) == (n > most)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from([*PARTS, "word ", "End. ", "\n\n", "日" * 30, "''ll", "'" * 9]), max_size=120).map("".join), st.sampled_from([(16, 2), (32, 5), (10, 4)]))
def test_pieces(encoder, text, sizes):
    check_pieces(text, encoder, *sizes)


def test_pieces_prefer_paragraphs(encoder):
    text = ("one two three four. five six seven\neight nine ten\n\n" * 12)[:-2]
    for p in split_text(text, encoder, 32, 4)[:-1]:
        assert text[: p[3]].endswith("\n\n")
    assert split_text("word " * 40, encoder, 300, 2) == [(0, encoder.count("word " * 40), 0, 200)]
    with pytest.raises(ValueError):
        split_text("a", encoder, 10, 6)


@pytest.mark.parametrize(
    "end,weaker",
    [("\n \t\n", "\n"), ("\r\n\u3000\r\n", "\r\n"), ("\u2029\u2029", "\u2028"), ("\u2028", ". "), ("\x85", "! "), ("\u3002", "\uff0c"), ("\uff1f", "\u3001"), ("\u061f ", "\u060c "), ("\uff0c", " "), (".\u00a0", ",\u00a0")],
)
def test_pieces_end_at_the_stronger_of_two_kinds(encoder, end, weaker):
    """Code points decide, not bytes: other scripts' sentence, clause and line ends, and empty lines with blanks."""
    text = (("ab cd" + weaker) * 2 + "ab cd" + end) * 30
    for p in split_text(text, encoder, 60, 4)[:-1]:
        assert text[: p[3]].rstrip(" \u00a0").endswith(end.rstrip(" \u00a0")), repr(text[p[2] : p[3]])


def test_piece_violations(spark):
    texts = ["word " * 3000, "short", "\u65e5\u672c\u3002\n \n" * 900, None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    lengths = df.select("doc_id", F.length("text").alias("n_chars"))
    pieces = split_documents(df)
    assert piece_violations(pieces, lengths).collect() == []
    kinds = lambda p, **k: {r["problem"] for r in piece_violations(p, lengths, **k).collect()}
    assert kinds(pieces, most=500) == {"too large"} and "other overlap" in kinds(pieces, overlap=99)
    assert kinds(pieces.filter("piece <> 2")) == {"gap"} and kinds(pieces.withColumn("text", F.lit("x"))) == {"other text"}
    longer = lengths.withColumn("n_chars", F.col("n_chars") + 1)
    assert {r["problem"] for r in piece_violations(pieces, longer).collect()} == {"early end"}


def test_split_documents(spark, encoder):
    texts = [None, "", "short", "word " * 3000, "日本" * 3000, "a" * 9000]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, piece string")
    rows = split_documents(df).collect()
    by = defaultdict(list)
    for r in rows:
        assert encoder.count(r["text"]) <= 1024 and r["text"] == texts[r["doc_id"]][r["first_char"] : r["end_char"]]
        by[r["doc_id"]].append(r)
    assert sorted(by) == [2, 3, 4, 5] and all([r["piece"] for r in rs] == list(range(1, len(rs) + 1)) for rs in by.values())
    only = {r["doc_id"] for r in split_documents(df, only_split=True).collect()}
    assert only == {i for i, t in enumerate(texts) if t and encoder.count(t) > 1024}
    assert split_documents(df.limit(0)).collect() == [] and NONE == 0


def test_found_documents_hold_more_than_the_limit(spark, library):
    import __spark_entry__ as entry

    d = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()
    n = {r[0]: len(library.encode_ordinary(r[1] or "")) for r in rows}
    assert {r[0] for r in entry.queries()["p8_found"](spark, d).collect()} == {k for k, v in n.items() if v > 1024}
    ids = {r[0]: hashlib.sha1(repr(r[1]).encode()).digest() for r in entry.queries()["p6_ids"](spark, d).collect()}
    assert ids == {r[0]: hashlib.sha1(repr(library.encode_ordinary(r[1] or "")).encode()).digest() for r in rows}
