"""Per-key work without hot tasks: fragment and replicate by estimated load.

Loads are estimated over all rows, keys with a large load are split into proportionate shards, the shards are
bin-packed to tasks, and the rows of the other keys are hashed over all tasks. A matching side is replicated
only to the shards of its key.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A key is large from this share of a task's mean load on; a shard holds at most this share.
LARGE = 0.25
#: How far below its true load a key of that share may be estimated, as a share of that load.
SHORT = 0.25
#: Keys that each input partition's load summary holds at least.
SUMMARY = 4096


def summary_size(n_tasks: int) -> int:
    """Keys of a load summary: so many that a key of LARGE of a task's mean load is short of it by SHORT at most."""
    return max(SUMMARY, int(-(-n_tasks // (LARGE * SHORT))))


def _col(name: str) -> Column:
    return F.col(f"`{name}`")


def key_loads(df: DataFrame, keys: list[str], summary: int = SUMMARY) -> DataFrame:
    """Estimated rows of the frequent keys in `load`, and a row with `is_total` true for all rows together.

    Each input partition keeps a frequent-items summary of at most `summary` keys: when it grows beyond that,
    all counts are lowered by that of the first key too many. An estimate is therefore short of the truth by
    at most a partition's rows / summary in each partition, all rows / summary together, and only keys rarer
    than that can be missing. A null is a key like others.
    """
    names = [f"k{i}" for i in range(len(keys))]
    fields = [T.StructField(n, df.schema[k].dataType) for n, k in zip(names, keys)]
    schema = T.StructType([*fields, T.StructField("load", T.LongType()), T.StructField("is_total", T.BooleanType())])
    at = [df.columns.index(k) for k in keys]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        total = 0
        for b in batches:
            total += b.num_rows
            t = pa.table([*(b.column(i) for i in at), pa.array(np.ones(b.num_rows, np.int64))], names=[*names, "load"])
            t = t.group_by(names).aggregate([("load", "sum")]).rename_columns([*names, "load"])
            if held is not None:
                t = pa.concat_tables([held, t]).group_by(names).aggregate([("load", "sum")]).rename_columns([*names, "load"])
            if t.num_rows > summary:
                loads = t["load"].to_numpy()
                less = int(np.partition(loads, -summary - 1)[-summary - 1])
                t = t.set_column(len(names), "load", pc.subtract(t["load"], less)).filter(pc.greater(t["load"], less))
            held = t.combine_chunks()
        if held is not None:
            kinds = [held.schema.field(n).type for n in names]
            yield from held.append_column("is_total", pa.array(np.zeros(held.num_rows, bool))).to_batches()
            yield pa.RecordBatch.from_arrays([*(pa.nulls(1, k) for k in kinds), pa.array([total], pa.int64()), pa.array([True])], names=schema.names)

    # is_total leaves as an aggregate, so that no filter on it gets below the shuffle: both kinds of rows are
    # taken from one shuffle and df is read once
    return (
        df.mapInArrow(run, schema).groupBy(*names, F.col("is_total").alias("t")).agg(F.sum("load").alias("load"), F.max("is_total").alias("is_total")).drop("t")
    )


def pack(loads: list[int], total: int, n_tasks: int) -> list[list[int]]:
    """The tasks of each key's shards: largest shard first, each to the task with the least load so far.

    The rows of all other keys count as spread evenly over the tasks.
    """
    target = LARGE * total / n_tasks
    shards = [max(1, min(n_tasks, int(-(-load // max(target, 1))))) for load in loads]
    rest = max(0, total - sum(loads)) / n_tasks
    tasks: list[list[int]] = [[] for _ in loads]
    bins = [(rest, t) for t in range(n_tasks)]
    for _, key, n in sorted(((load / n, k, n) for k, (load, n) in enumerate(zip(loads, shards))), reverse=True):
        for _ in range(n):
            load, t = heapq.heappop(bins)
            tasks[key].append(t)
            heapq.heappush(bins, (load + loads[key] / n, t))
    return tasks


def load_plan(df: DataFrame, keys: list[str], n_tasks: int, summary: int | None = None) -> DataFrame:
    """k0, k1 ... and `tasks`, the task of each shard, for every large key.

    A key is large from LARGE of a task's mean load on. By summary_size its estimate is at least 1 - SHORT of
    that, which is where the line is drawn, so none is missed: there are at most n_tasks / (LARGE (1 - SHORT))
    large keys. The plan is small whatever the data, which makes its packing in one task and its broadcast safe.
    """
    names = [f"k{i}" for i in range(len(keys))]
    loads = key_loads(df, keys, summary or summary_size(n_tasks))
    total = loads.filter("is_total").agg(F.sum("load")).scalar()
    large = loads.filter((~F.col("is_total")) & (F.col("load") >= F.lit(LARGE * (1 - SHORT) / n_tasks) * total)).withColumn("total", total)
    schema = T.StructType([T.StructField(n, df.schema[k].dataType) for n, k in zip(names, keys)] + [T.StructField("tasks", T.ArrayType(T.IntegerType()))])

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = [p for p in parts if len(p)]
        if rows:
            p = pd.concat(rows).sort_values("load", ascending=False, kind="stable")
            yield p[names].assign(tasks=pack(p["load"].tolist(), int(p["total"].iloc[0]), n_tasks))

    return large.repartition(1).mapInPandas(run, schema)


def _on_plan(df: DataFrame, keys: list[str], plan: DataFrame, n_tasks: int) -> DataFrame:
    """df with __tasks, the task of each shard of its key: for a key that isn't large the task of the key's hash."""
    on = None
    for i, k in enumerate(keys):
        same = _col(k).eqNullSafe(F.col(f"__k{i}"))
        on = same if on is None else on & same
    named = plan.select(*[F.col(f"k{i}").alias(f"__k{i}") for i in range(len(keys))], F.col("tasks").alias("__planned"))
    own = F.array(F.pmod(F.xxhash64(*[_col(k) for k in keys]), F.lit(n_tasks)).cast("int"))
    joined = df.join(F.broadcast(named), on, "left").drop(*[f"__k{i}" for i in range(len(keys))])
    return joined.withColumn("__tasks", F.coalesce("__planned", own)).drop("__planned")


def fragment(df: DataFrame, keys: list[str], plan: DataFrame, n_tasks: int, spread: list[str] | None = None) -> DataFrame:
    """df with __shard and __task, each row placed in its shard's task.

    Rows of a large key go to its shards by the hash of the `spread` columns (all columns by default); other
    rows go to the task of their key's hash, as shard 0. What is grouped or joined by columns that include
    __task needs no further shuffle.
    """
    by = F.xxhash64(*[_col(c) for c in spread or df.columns])
    placed = _on_plan(df, keys, plan, n_tasks).withColumn("__shard", F.pmod(by, F.size("__tasks")).cast("int"))
    return placed.withColumn("__task", F.get("__tasks", F.col("__shard"))).drop("__tasks").repartitionById(n_tasks, "__task")


def balanced_aggregate(df: DataFrame, keys: list[str], partial: dict[str, Column], final: dict[str, Column], n_tasks: int | None = None, spread: list[str] | None = None) -> DataFrame:
    """Per-key aggregates: `partial` over each fragment, `final` over the partial columns.

    df is read twice, once for the loads; equal shuffles below it are reused. Null keys make a group of their
    own; an empty table gives no rows; repeated rows count each. Key names in `partial` or `final` raise ValueError.
    """
    if (set(partial) | set(final)) & set(keys):
        raise ValueError("an aggregate has the name of a key")
    n = n_tasks or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = fragment(df, keys, load_plan(df, keys, n), n, spread)
    by = [_col(k) for k in keys]
    return parts.groupBy(*by, "__shard", "__task").agg(*[c.alias(k) for k, c in partial.items()]).groupBy(*by).agg(*[c.alias(k) for k, c in final.items()])


def balanced_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner", n_tasks: int | None = None, spread: list[str] | None = None) -> DataFrame:
    """Joins on equal keys; a large key's left rows are split and its right rows replicated to those shards.

    how: inner, left, left_semi or left_anti (in the others a replicated row could come out more than once).
    Null keys match nothing. Columns of the right that the left has too, other than keys, raise ValueError for
    inner and left. Both sides are placed by the plan, and the join takes place where they lie.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"balanced_join can't do {how}")
    if how in ("inner", "left") and (clash := set(left.columns) & set(right.columns) - set(keys)):
        raise ValueError(f"columns on both sides: {sorted(clash)}")
    n = n_tasks or int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    plan = load_plan(left, keys, n)
    parts = fragment(left, keys, plan, n, spread)
    copies = _on_plan(right, keys, plan, n).select(*right.columns, F.posexplode("__tasks").alias("__shard", "__task")).repartitionById(n, "__task")
    return parts.join(copies, [*keys, "__shard", "__task"], how).drop("__shard", "__task")
