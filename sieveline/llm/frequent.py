"""Most frequent values of a column: count-min sketches over hash-partitioned streams."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of the sketch, and the largest number of cells in a row as a power of two (4 rows of it are 128 MB).
DEPTH, MOST_BITS = 4, 22
#: The error that the sketch's width leaves, as a part of the share asked for.
NOISE = 0.1
#: Candidates that a heap may hold, as a multiple of the values that can have the share.
HELD = 4
#: Rows that a task gathers before it counts equal values together.
GATHER = 200_000
#: Odd multipliers of the rows' hashes. Fixed values.
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53], np.uint64)


def width_for(min_share: float) -> int:
    """Width bits of a sketch whose error is at most NOISE of a share of the stream: e / width <= NOISE x min_share.

    A share that would take more than MOST_BITS raises ValueError: below the sketch's noise every value would pass
    for a frequent one, and the candidates would grow with the number of different values.
    """
    bits = max(4, math.ceil(math.log2(math.e / (NOISE * min_share))))
    if bits > MOST_BITS:
        raise ValueError(f"min_share is below {math.e / (NOISE * (1 << MOST_BITS)):.2g}, the least that {MOST_BITS} width bits hold")
    return bits


class Sketch:
    """Count-min sketch with conservative update; estimates are never too low."""

    def __init__(self, depth: int = DEPTH, width_bits: int = 16) -> None:
        if not (1 <= depth <= len(_ODD) and 4 <= width_bits <= MOST_BITS):
            raise ValueError(f"depth must be 1 to {len(_ODD)} and width_bits 4 to {MOST_BITS}")
        self.cells = np.zeros((depth, 1 << width_bits), np.int64)
        self.shift = np.uint64(64 - width_bits)

    def add(self, hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Adds different values by their 64-bit hashes; their estimates after that.

        Only cells below a value's new estimate are raised, to that estimate: every cell of a value stays at
        or above its true count, also when values of one call share cells.
        """
        h = hashes.view(np.uint64)
        at = [((h * odd) >> self.shift).astype(np.int64) for odd in _ODD[: len(self.cells)]]
        new = np.minimum.reduce([row[i] for row, i in zip(self.cells, at)]) + counts
        for row, i in zip(self.cells, at):
            np.maximum.at(row, i, new)
        return new


class Candidates:
    """The values whose estimate is at least a share of what the stream held so far, in a heap by estimate.

    A value with that share of the whole stream has it at its last occurrence at the latest, is admitted
    there and never dropped after, so none is lost. At most 1 / share values can have the share; a heap that
    comes to hold HELD times as many means a sketch too narrow for its stream, and raises RuntimeError.
    """

    def __init__(self, share: float) -> None:
        self.share, self.total = share, 0
        self.most = 64 + math.ceil(HELD / share)
        self.held: dict[str, int] = {}
        self.heap: list[tuple[int, str]] = []

    def offer(self, values: pa.Array, estimates: np.ndarray, n: int) -> None:
        self.total += n
        least = self.share * self.total
        for k in np.flatnonzero(estimates >= least).tolist():
            value, estimate = values[k].as_py(), int(estimates[k])
            self.held[value] = estimate
            heapq.heappush(self.heap, (estimate, value))
        while self.heap and self.heap[0][0] < least:
            estimate, value = heapq.heappop(self.heap)
            if self.held.get(value) == estimate:
                del self.held[value]
        if len(self.held) > self.most:
            raise RuntimeError(f"more than {self.most} candidates for a share of {self.share}: the sketch is too narrow")
        if len(self.heap) > 64 + 2 * len(self.held):  # most entries are earlier estimates of values still held
            self.heap = [(e, v) for v, e in self.held.items()]
            heapq.heapify(self.heap)


def frequent_values(df: DataFrame, column: str, min_share: float, depth: int = DEPTH, width_bits: int | None = None) -> DataFrame:
    """(value STRING, n_estimate, n_total, max_error): the values held by at least min_share of the rows with a value.

    n_estimate is never below the true count; with probability 1 - exp(-depth) it is at most max_error above
    it (e / 2^width_bits of the rows), so values just below the share can come out too, none above it is
    missing. width_bits follows from min_share (width_for), so that the error is a tenth of it at most; a
    narrower one, or a share too small for the widest, raises ValueError. Nulls are no value; empty texts are.
    Ties all come out; repeated rows count each; an empty table gives no rows; other columns aren't read, so
    their names can't clash.

    Each task counts equal values of some 200,000 rows together before the shuffle, so a hot value reaches its
    partition as a few rows. Values are partitioned by hash; each partition has a sketch of fixed size and
    its candidates, at most HELD / min_share. Candidates of partitions are disjoint, so they are merged by
    putting them together, with the rows of each partition beside them, in one small shuffle.
    """
    if not 0 < min_share <= 1:
        raise ValueError("min_share must be above 0 and at most 1")
    if width_bits is None:
        width_bits = width_for(min_share)
    elif width_bits < width_for(min_share):
        raise ValueError(f"width_bits must be at least {width_for(min_share)} for this share")
    values = df.select(F.col(f"`{column}`").cast("string").alias("value")).filter("value IS NOT NULL")

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(held: list[pa.RecordBatch]) -> list[pa.RecordBatch]:
            t = pa.Table.from_batches(held).group_by("value").aggregate([([], "count_all")])
            return t.rename_columns(["value", "n"]).combine_chunks().to_batches()

        held, n = [], 0
        for b in batches:
            held.append(b)
            n += b.num_rows
            if n >= GATHER:
                yield from flush(held)
                held, n = [], 0
        if held:
            yield from flush(held)

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch, heavy = Sketch(depth, width_bits), Candidates(min_share)
        for b in batches:
            t = pa.Table.from_batches([b]).group_by("value").aggregate([("n", "sum"), ("h", "min")]).combine_chunks()
            counts = t["n_sum"].to_numpy()
            estimates = sketch.add(t["h_min"].to_numpy(), counts)
            heavy.offer(t["value"], estimates, int(counts.sum()))
        if heavy.total:
            names, estimates = list(heavy.held), list(heavy.held.values())
            yield pa.RecordBatch.from_arrays(
                [pa.array([*names, None], pa.string()), pa.array([*estimates, heavy.total], pa.int64()), pa.array([False] * len(names) + [True])], names=["value", "n", "is_total"]
            )

    partial = values.mapInArrow(combine, "value string, n long").repartition("value")
    # candidates and totals leave as one aggregate, whose columns are all used by both of its readers below: the
    # shuffle is reused and the streams are sketched once
    merged = (
        partial.withColumn("h", F.xxhash64("value")).mapInArrow(stream, "value string, n long, is_total boolean").groupBy("value").agg(F.sum("n").alias("n"), F.max("is_total").alias("is_total"))
    )
    total = merged.agg(F.sum(F.when(F.col("is_total"), F.col("n")))).scalar()
    return (
        merged.filter("NOT is_total")
        .select("value", F.col("n").alias("n_estimate"), total.alias("n_total"))
        .filter(F.col("n_estimate") >= min_share * F.col("n_total"))
        .withColumn("max_error", F.ceil(F.col("n_total") * (np.e / (1 << width_bits))))
    )


def exact_counts(df: DataFrame, column: str, found: DataFrame) -> DataFrame:
    """found, of frequent_values, with n, each value's true number of rows.

    A second pass over the column. found is bounded by the share it was asked with (a value for each share, and
    those that the error lets in), so it is broadcast, and rows are counted before they are shuffled.
    """
    values = df.select(F.col(f"`{column}`").cast("string").alias("value"))
    counts = values.join(F.broadcast(found.select("value")), "value", "left_semi").groupBy("value").agg(F.count(F.lit(1)).alias("n"))
    return found.join(counts, "value")
