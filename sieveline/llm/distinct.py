"""Distinct counts over huge identifier sets: sorted runs of 64-bit hashes, delta-coded, merged by union."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Hashes that a task gathers before it writes runs.
GATHER = 1_000_000
#: Hashes above which what is merged together is cut into ranges: about so many are in one task's hands at once.
MOST = 4_000_000
#: Cells above MOST up to which their list is broadcast; a longer list is joined by a shuffle.
LISTED = 100_000


def encode_run(hashes: np.ndarray) -> bytes:
    """A sorted array of different unsigned hashes as their differences: a width in bytes, then each difference."""
    if not len(hashes):
        return b""
    d = np.diff(hashes, prepend=np.uint64(0))
    width = max(1, (int(d.max()).bit_length() + 7) // 8)
    return bytes([width]) + d.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - width :].tobytes()


def decode_run(data: bytes) -> np.ndarray:
    if not data:
        return np.zeros(0, np.uint64)
    width = data[0]
    d = np.zeros(((len(data) - 1) // width, 8), np.uint8)
    d[:, 8 - width :] = np.frombuffer(data, np.uint8, offset=1).reshape(-1, width)
    return np.cumsum(d.reshape(-1).view(">u8").astype(np.uint64), dtype=np.uint64)


def union_runs(runs: list[np.ndarray]) -> np.ndarray:
    """Union of sorted runs; the stable sort finds the runs and merges them k ways, it doesn't sort anew."""
    if len(runs) == 1:
        return runs[0]
    h = np.sort(np.concatenate(runs), kind="stable")
    return h[np.concatenate([[True], h[1:] != h[:-1]])] if len(h) else h


def hash_runs(df: DataFrame, cells: list[str], value: Column) -> DataFrame:
    """Partial results: (the cell columns, n_values, n_hashes, run) for each task's GATHER values and cell.

    value is hashed to 64 bits by xxhash64; rows in which it is null are left out, rows with null cell columns
    make cells of their own. Equal hashes within a task are joined before anything is shuffled. A run is a set of
    hashes that stands for itself, whatever made it: partial results of different inputs can be put together with
    unionByName and merged with merge_runs.
    """
    if clash := {"n_values", "n_hashes", "n_distinct", "grouping_id", "range", "run"} & set(cells):
        raise ValueError(f"cell columns have names of the result: {sorted(clash)}")
    rows = df.select(*[F.col(f"`{c}`") for c in cells], F.when(value.isNotNull(), F.xxhash64(value)).alias("__h")).filter("__h IS NOT NULL")
    schema = T.StructType([*(df.schema[c] for c in cells), *_PARTIAL])

    def flush(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held).combine_chunks()
        code = np.zeros(t.num_rows, np.int64)
        for c in range(len(cells)):
            column = t.column(c).combine_chunks()
            d = column.dictionary_encode(null_encoding="encode")
            code = np.unique(code * len(d.dictionary) + d.indices.to_numpy(zero_copy_only=False), return_inverse=True)[1].astype(np.int64)
        h = t.column(len(cells)).to_numpy().view(np.uint64)
        order = np.lexsort((h, code))
        h, code = h[order], code[order]
        starts = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
        ends = np.append(starts[1:], len(h))
        new = np.concatenate([[True], (h[1:] != h[:-1]) | (code[1:] != code[:-1])])
        runs = [h[s:e][new[s:e]] for s, e in zip(starts.tolist(), ends.tolist())]
        at = pa.array(order[starts])
        return pa.RecordBatch.from_arrays(
            [*(t.column(c).combine_chunks().take(at) for c in range(len(cells))), pa.array(ends - starts, pa.int64()), pa.array(list(map(len, runs)), pa.int64()), pa.array(list(map(encode_run, runs)), pa.binary())],
            names=schema.names,
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            if b.num_rows:
                held.append(b)
                n += b.num_rows
            if n >= GATHER:
                yield flush(held)
                held, n = [], 0
        if held:
            yield flush(held)

    return rows.mapInArrow(run, schema)


_PARTIAL = [T.StructField("n_values", T.LongType()), T.StructField("n_hashes", T.LongType()), T.StructField("run", T.BinaryType())]


def _ranged(partials: DataFrame, rest: list[str], most: int) -> DataFrame:
    """partials with their range: runs of what is above `most` hashes are cut into equal ranges of hashes.

    Only such cells are listed, at most one for each `most` hashes of all; all others are one range, 0, and keep
    their runs whole. The number of ranges follows from the hashes to be merged, not from the number of tasks.
    """
    sums = partials.groupBy(*[F.col(f"`{c}`") for c in rest]).agg(F.sum("n_hashes").alias("__n")).filter(F.col("__n") > most)
    # 40 bits of ranges are more than there can be runs for
    bits = F.least(F.ceil(F.log2(F.col("__n") / most)), F.lit(40)).cast("int").alias("__bits")
    large = sums.select(*[F.col(f"`{c}`").alias(f"__{i}") for i, c in enumerate(rest)], bits)
    n_large = large.limit(LISTED + 1).count()
    if not n_large:
        return partials.withColumn("range", F.lit(0).cast("long"))
    on = reduce(lambda a, b: a & b, [F.col(f"`{c}`").eqNullSafe(F.col(f"__{i}")) for i, c in enumerate(rest)], F.lit(True))
    listed = F.broadcast(large) if n_large <= LISTED else large
    rows = partials.join(listed, on, "left").select(*partials.columns, F.coalesce("__bits", F.lit(0)).alias("__bits"))
    schema = T.StructType([*partials.schema.fields, T.StructField("range", T.LongType())])
    run_at, hash_at, value_at = (partials.columns.index(c) for c in ("run", "n_hashes", "n_values"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, ranges, runs, sizes, values = [], [], [], [], []
            for k, (bits, data, n, v) in enumerate(zip(b.column(b.num_columns - 1).to_pylist(), b.column(run_at).to_pylist(), b.column(hash_at).to_pylist(), b.column(value_at).to_pylist())):
                if not bits:
                    pieces = [(0, data, n)]
                else:
                    h = decode_run(data)
                    part = h >> np.uint64(64 - bits)
                    starts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(h) else []
                    pieces = [(int(part[s]), encode_run(h[s:e]), e - s) for s, e in zip(starts, [*starts[1:], len(h)])]
                for i, (place, piece, size) in enumerate(pieces):
                    rows.append(k)
                    ranges.append(place)
                    runs.append(piece)
                    sizes.append(size)
                    values.append(0 if i else v)
            out = pa.Table.from_batches([b]).drop_columns(["__bits"]).take(pa.array(rows, pa.int32()))
            for at, name, column in ((run_at, "run", pa.array(runs, pa.binary())), (hash_at, "n_hashes", pa.array(sizes, pa.int64())), (value_at, "n_values", pa.array(values, pa.int64()))):
                out = out.set_column(at, name, column)
            yield from out.append_column("range", pa.array(ranges, pa.int64())).combine_chunks().to_batches()

    return rows.mapInArrow(run, schema)


def merge_runs(partials: DataFrame, cells: list[str], over: str | list[str] = (), keep_runs: bool = False, most: int = MOST) -> DataFrame:
    """(the cell columns, grouping_id, range, n_values, n_distinct[, run]) merged by k-way union.

    over: cell columns, one or several; besides each cell, the unions over all values (nulls included) of each
    combination of them come out, with those columns null. grouping_id tells which: the bits of the columns that
    are totalled, the last one's lowest, 0 for plain cells, as SQL's grouping() counts.

    One shuffle, on the other cell columns and the range: the runs of a cell and those of its unions meet in
    one task. Where more than `most` hashes would meet they are cut into ranges, so a task holds about that many at
    once; distinct_counts adds ranges up. partials is read twice, so it should be written down (session.cut).
    """
    over = [over] if isinstance(over, str) else list(over)
    rest = [c for c in cells if c not in over]
    fields = [*(partials.schema[c] for c in cells), T.StructField("grouping_id", T.IntegerType()), T.StructField("range", T.LongType()), T.StructField("n_values", T.LongType()), T.StructField("n_distinct", T.LongType())]
    schema = T.StructType(fields + ([T.StructField("run", T.BinaryType())] if keep_runs else []))
    totals = [set(c) for n in range(1, len(over) + 1) for c in combinations(range(len(over)), n)]

    def merge(t: pa.Table) -> pa.Table:
        by: dict = {}
        values = zip(*[t[c].to_pylist() for c in over]) if over else iter([()] * t.num_rows)
        for v, n, r in zip(values, t["n_values"].to_pylist(), t["run"]):
            cell = by.setdefault(v, [0, []])
            cell[0] += n
            cell[1].append(decode_run(r.as_py()))
        plain = [(v, 0, n, union_runs(runs)) for v, (n, runs) in by.items()]
        out = list(plain)
        for left_out in totals:
            sums: dict = {}
            for v, _, n, run in plain:
                cell = sums.setdefault(tuple(None if i in left_out else x for i, x in enumerate(v)), [0, []])
                cell[0] += n
                cell[1].append(run)
            level = sum(1 << (len(over) - 1 - i) for i in left_out)
            out += [(v, level, n, union_runs(runs)) for v, (n, runs) in sums.items()]
        columns = {c: pa.array([t[c][0].as_py()] * len(out), t.schema.field(c).type) for c in rest}
        columns |= {c: pa.array([x[0][i] for x in out], t.schema.field(c).type) for i, c in enumerate(over)}
        columns |= {
            "grouping_id": pa.array([x[1] for x in out], pa.int32()),
            "range": pa.array([t["range"][0].as_py()] * len(out), pa.int64()),
            "n_values": pa.array([x[2] for x in out], pa.int64()),
            "n_distinct": pa.array([len(x[3]) for x in out], pa.int64()),
        }
        if keep_runs:
            columns["run"] = pa.array([encode_run(x[3]) for x in out], pa.binary())
        return pa.table(columns).select(schema.names)

    return _ranged(partials, rest, most).groupBy(*[F.col(f"`{c}`") for c in rest], "range").applyInArrow(merge, schema)


def as_partials(merged: DataFrame, cells: list[str]) -> DataFrame:
    """Merged runs, of merge_runs with keep_runs, as partial results that can be merged with others."""
    return merged.filter("grouping_id = 0").select(*[F.col(f"`{c}`") for c in cells], "n_values", F.col("n_distinct").alias("n_hashes"), "run")


def distinct_counts(merged: DataFrame, cells: list[str]) -> DataFrame:
    """(the cell columns, grouping_id, n_values, n_distinct, lost_expected, lost_share): counts of whole cells.

    Different values are lost only where their 64-bit hashes are equal: for n of them n (n - 1) / 2^65 are
    expected to be (the birthday bound), which is lost_expected; lost_share is that over n.
    """
    n = F.col("n_distinct").cast("double")
    return (
        merged.groupBy(*[F.col(f"`{c}`") for c in cells], "grouping_id")
        .agg(F.sum("n_values").alias("n_values"), F.sum("n_distinct").alias("n_distinct"))
        .withColumn("lost_expected", n * (n - 1) / F.lit(2.0**65))
        .withColumn("lost_share", F.col("lost_expected") / n)
    )
