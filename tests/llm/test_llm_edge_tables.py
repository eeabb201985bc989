"""Training-data queries over tables without rows and rows without values."""

import pytest

import __spark_entry__ as entry
from edge import edge_tables

EMPTY = ["p1_found", "p1_urls", "p2_found", "p2_counts", "p6_ids", "p7_found", "p7_mix", "p7_shares", "p8_found", "p8_pieces"]


@pytest.fixture(scope="module")
def folders(tmp_path_factory):
    return edge_tables(tmp_path_factory.mktemp("edge"))


@pytest.mark.parametrize("kind", ["empty", "null"])
@pytest.mark.parametrize("name", EMPTY)
def test_query(spark, folders, kind, name):
    got = entry.queries()[name](spark, folders[kind]).collect()
    if name == "p6_ids" and kind == "null":
        assert [tuple(r) for r in got] == [(None, [])] * 5
    else:
        assert got == []


def test_cell_names_of_the_result_are_refused(spark):
    from pyspark.sql import functions as F

    from sieveline.llm.distinct import hash_runs

    with pytest.raises(ValueError):
        hash_runs(spark.createDataFrame([(1, "a")], "range int, v string"), ["range"], F.col("v"))
