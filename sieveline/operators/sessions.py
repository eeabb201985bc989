"""Sessions separated by inactivity, built chunk by chunk of time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def sessions(df: DataFrame, actor: str, seconds: str, gap_s: int = 1800, chunk_s: int = 86_400) -> DataFrame:
    """(actor, start_s, end_s, duration_s, n_events) of every session of every actor.

    A session goes on while the pause is at most gap_s. Rows with a null actor or time are left out; repeated
    rows count as events of their own; equal times fall into one session; an empty table gives none.

    Method: events are first counted for each actor and second, partially before the shuffle, so one actor's
    chunk has at most chunk_s rows however many events it has. Local sessions are built in each chunk; those
    that touch neither the first nor the last event of their chunk are whole, the rest (at most two a chunk)
    are merged with their neighbours where the pause between them is at most gap_s. No task ever holds more
    than a chunk of an actor, or two rows for each of its chunks.
    """
    if gap_s < 0 or chunk_s < 1:
        raise ValueError("gap_s must be 0 or more and chunk_s 1 or more")
    t = F.col("t")
    counted = (
        df.select(F.col(f"`{actor}`").alias("actor"), F.col(f"`{seconds}`").cast("long").alias("t"))
        .filter(F.col("actor").isNotNull() & t.isNotNull())
        .groupBy("actor", F.floor(t / chunk_s).alias("chunk"), "t")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    chunk = Window.partitionBy("actor", "chunk")
    ordered = chunk.orderBy("t")
    local = (
        counted.withColumn("opens", F.coalesce((t - F.lag("t").over(ordered) > gap_s).cast("int"), F.lit(0)))
        .withColumn("k", F.sum("opens").over(ordered.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("last_k", F.sum("opens").over(chunk))
        .groupBy("actor", "chunk", "k", "last_k")
        .agg(F.min("t").alias("start_s"), F.max("t").alias("end_s"), F.sum("n").alias("n_events"))
        .withColumn("edge", (F.col("k") == 0) | (F.col("k") == F.col("last_k")))
        .select("actor", "chunk", "start_s", "end_s", "n_events", "edge")
    )
    # An inner session lies between the edges of its chunk, so edges of one chunk are never merged with each
    # other unless they are the same session: the pause to the inner ones is already above gap_s. Inner sessions go
    # through the same window, each chunk's apart from the actor's edges, so that no stage is worked out twice.
    place = local.withColumn("place", F.when(~F.col("edge"), F.col("chunk"))).drop("edge", "chunk")
    neighbours = Window.partitionBy("actor", "place").orderBy("start_s")
    merged = (
        place.withColumn("opens", F.coalesce((F.col("start_s") - F.lag("end_s").over(neighbours) > gap_s).cast("int"), F.lit(0)))
        .withColumn("k", F.sum("opens").over(neighbours.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy("actor", "place", "k")
        .agg(F.min("start_s").alias("start_s"), F.max("end_s").alias("end_s"), F.sum("n_events").alias("n_events"))
    )
    return merged.select("actor", "start_s", "end_s", (F.col("end_s") - F.col("start_s")).alias("duration_s"), "n_events")
