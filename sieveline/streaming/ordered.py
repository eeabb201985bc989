"""State that every row may change, in the order of all rows: folded chunk by chunk at once, and again where a guess was wrong.

A ring of places or a limited number of slots has no key to be cut by. The rows are therefore cut into chunks of the
whole order, and each chunk is folded from a guessed state, at first that of nothing. What a chunk ends with is then
held against what the next one began with; chunks that began otherwise are folded again, until none is left. The
result is that of one pass over all rows: a chunk's state is right once that of the chunk before it is. Rings forget
what they began with after a turn or two, so a few rounds do, and rounds after the first read few chunks.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sieveline.session import cut

#: Rows of a chunk, about: what one task folds at once.
CHUNK = 1_000_000

#: A fold takes a state that JSON holds (null at first) and a chunk's rows as tuples in order, and gives the new state.
Fold = Callable[[object, list[tuple]], object]


def folded(df: DataFrame, order: list[str], fold: Fold, chunk_rows: int = CHUNK) -> DataFrame:
    """(state STRING): the state, as JSON, after all rows of df in the order of `order`; no row for an empty table.

    order: columns of df that tell rows apart where they differ in effect; rows that are equal in all of them are
    folded one after the other. The driver holds counts only; states go from round to round in checkpoints.
    """
    rows = cut(df)
    n = rows.count()
    if not n:
        return df.sparkSession.createDataFrame([], "state string")
    n_chunks = math.ceil(n / chunk_rows)
    names = [c for c in df.columns if c not in order]
    placed = rows.select(*order, *names).repartitionByRange(n_chunks, *[F.col(c).asc_nulls_first() for c in order]).withColumn("__chunk", F.spark_partition_id())
    placed = cut(placed) if n_chunks > 1 else placed
    out = T.StructType([T.StructField("chunk", T.IntegerType()), T.StructField("start", T.StringType()), T.StructField("end", T.StringType())])
    n_order = len(order)

    def run(chunk: pa.Table, begin: pa.Table) -> pa.Table:
        start = begin["start"][0].as_py()
        data = chunk.drop_columns(["__chunk"]).sort_by([(c, "ascending") for c in chunk.column_names[:n_order]])
        state = fold(json.loads(start), list(zip(*[c.to_pylist() for c in data.columns])))
        number = begin["chunk"].slice(0, 1)
        return pa.table({"chunk": number, "start": pa.array([start], pa.string()), "end": pa.array([json.dumps(state)], pa.string())})

    def again(begins: DataFrame) -> DataFrame:
        some = placed.join(begins.select(F.col("chunk").alias("__chunk")), "__chunk", "left_semi").select(*order, *names, "__chunk")
        return some.groupBy("__chunk").cogroup(begins.groupBy("chunk")).applyInArrow(run, out)

    chunks = placed.select(F.col("__chunk").alias("chunk")).distinct()
    done = cut(again(chunks.select("chunk", F.lit("null").alias("start"))))
    # chunks may be empty, so the chunk before one is the last that has rows
    while n_chunks > 1:
        # the window is over the chunks' numbers only; states are joined by them
        last = done.select("chunk", F.lag("chunk").over(Window.orderBy("chunk")).alias("__last"))
        ends = done.select(F.col("chunk").alias("__last"), F.col("end").alias("due"))
        before = done.join(last, "chunk").join(ends, "__last", "left").select("chunk", "start", "end", "due")
        wrong = before.filter(F.coalesce("due", F.lit("null")) != F.col("start"))
        if wrong.isEmpty():
            break
        fixed = again(wrong.select("chunk", F.col("due").alias("start")))
        done = cut(fixed.unionByName(done.join(wrong.select("chunk"), "chunk", "left_anti").select("chunk", "start", "end")))
    return done.groupBy().agg(F.max_by("end", "chunk").alias("state")).filter("state IS NOT NULL")


def ring_fold(n: int) -> Fold:
    """Fold of a ring of n places over (t, key, flush): entries [key, t] from the oldest place to the newest.

    A key that has a place refreshes its time; another takes the place that was filled first. A flush makes all
    entries old (time 0) and leaves them in their places.
    """

    def fold(state: list | None, rows: list[tuple]) -> list:
        held = {k: t for k, t in state or []}  # in order of insertion
        for t, key, flush in rows:
            if flush:
                held = dict.fromkeys(held, 0)
            elif key in held:
                held[key] = t
            else:
                if len(held) >= n:
                    del held[next(iter(held))]
                held[key] = t
        return [[k, t] for k, t in held.items()]

    return fold


def slot_fold(n: int, expire_s: int, tick_s: int) -> Fold:
    """Fold of n slots over (t, client): {slots: {client: last time}, tick, admitted, refused}.

    A client in a slot stamps it; another takes a free one, or is refused while there is none. At each tick slots
    whose stamp is more than expire_s old are freed. admitted and refused count requests.
    """

    def fold(state: dict | None, rows: list[tuple]) -> dict:
        s = state or {"slots": {}, "tick": 0, "admitted": 0, "refused": 0}
        slots, tick, admitted, refused = s["slots"], s["tick"], s["admitted"], s["refused"]
        for t, client in rows:
            if t // tick_s > tick:
                tick = t // tick_s
                slots = {c: last for c, last in slots.items() if tick * tick_s - last <= expire_s}
            if client in slots or len(slots) < n:
                slots[client] = t
                admitted += 1
            else:
                refused += 1
        return {"slots": dict(sorted(slots.items())), "tick": tick, "admitted": admitted, "refused": refused}

    return fold
