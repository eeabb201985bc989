"""One row for each delivered record."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def once_per_id(df: DataFrame, id_col: str, order_by: list[str] | None = None) -> DataFrame:
    """Keeps one row of each id: the first by order_by, ties broken by the row's content.

    Rows with a null id can't be told apart and are all kept; they are spread by their content, so many of
    them make no hot task. An empty table stays empty. One shuffle on the id, no aggregation buffers.
    """
    for c in ("__null", "__rn"):
        if c in df.columns:
            raise ValueError(f"column name {c} is reserved")
    content = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])
    key = F.col(f"`{id_col}`")
    order = [F.col(f"`{c}`").asc_nulls_last() for c in order_by or []]
    w = Window.partitionBy(key, F.col("__null")).orderBy(*order, content)
    return (
        df.withColumn("__null", F.when(key.isNull(), content))
        .withColumn("__rn", F.row_number().over(w))
        .filter((F.col("__rn") == 1) | key.isNull())
        .drop("__null", "__rn")
    )


def repeated(df: DataFrame, n: str, number: str) -> DataFrame:
    """Each row as often as its column n says, numbered from 1; n is dropped, and rows with n below 1 don't come out.

    In two steps, so that a row that is repeated very often makes no array of that length.
    """
    top = F.greatest(F.col(n).cast("long"), F.lit(0))
    some = df.filter(top > 0).withColumn("__lo", F.explode(F.sequence(F.lit(1).cast("long"), top, F.lit(10_000).cast("long"))))
    return some.withColumn(number, F.explode(F.sequence("__lo", F.least(F.col("__lo") + 9_999, top)))).drop("__lo", n)
