"""Training-data queries against their SQL, and without it that they run."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from compare import rows
from sieveline.llm import query_sets

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", [n for s in query_sets() for n in s.queries])
def test_query(spark, name):
    df = entry.queries()[name](spark, SF)
    got = rows(df.columns, df.collect())
    assert got or name == "p2_found" or name.endswith("_violations")
    if sql := entry.oracle_sql().get(name):
        db = duckdb.connect()
        for f in os.listdir(SF):
            db.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
        rel = db.sql(sql)
        assert got == rows(rel.columns, rel.fetchall())


def test_found_sources_by_brute_force(spark):
    from collections import defaultdict

    from sieveline.llm import bpe

    encoder = bpe.Encoder(open(bpe.VOCABULARY, "rb").read())
    sizes = defaultdict(int)
    for r in spark.read.parquet(f"{SF}/documents.parquet").select("source", "text").collect():
        key = (r["source"] or "").strip().lower().replace("-", "_")
        sizes[key] += len(encoder.encode(r["text"]))
    targets = spark.read.parquet(f"{SF}/mix_targets.parquet").collect()
    weights = defaultdict(float)
    for t in targets:
        weights[t["mix_name"]] += t["weight"]
    want = {
        (t["mix_name"], t["source"])
        for t in targets
        if sizes.get(t["source"], 0) * t["max_copies"] < t["size_ratio"] * sum(sizes.values()) * t["weight"] / weights[t["mix_name"]]
    }
    assert {tuple(r) for r in entry.queries()["p7_found"](spark, SF).collect()} == want


def test_nothing_else_imports_this_package():
    import pathlib
    import re

    root = pathlib.Path(entry.__file__).parent / "sieveline"
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert not re.search(r"sieveline\.llm|from \.+llm|import llm", p.read_text()), p
