"""State over event order, in batch: by seconds and days of a key, or by chunks of the order, so no key is one task's load."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sieveline.operators.dedupe import repeated
from sieveline.operators.sessions import sessions
from sieveline.streaming import ordered

#: Seconds after which an address no longer counts as active, and between two statistics. Fixed values.
ACTIVE_S, STATS_S = 604_799, 180


def by_second(df: DataFrame, keys: list[str], t: str) -> DataFrame:
    """(keys, t, n, before, earlier): the different seconds of each key, and how many rows it has in them.

    before: the key's last second before this one, null for its first; earlier: its rows before this second. t is in
    whole seconds. Rows are counted partially before the shuffle, so a day of a key is at most 86,400 rows, however
    many it had; windows run within a day, and days are joined by what each ends with.
    """
    day = F.floor(F.col(t) / 86_400)
    counted = df.groupBy(*keys, day.alias("__day"), t).agg(F.count(F.lit(1)).alias("n"))
    own = Window.partitionBy(*keys, "__day").orderBy(t)
    looked = counted.select("*", F.lag(t).over(own).alias("__before"), (F.sum("n").over(own) - F.col("n")).alias("__earlier"))
    days = looked.groupBy(*keys, "__day").agg(F.max(t).alias("__last"), F.sum("n").alias("__n"))
    past = Window.partitionBy(*keys).orderBy("__day")
    carried = days.select(*keys, "__day", F.lag("__last").over(past).alias("__day_before"), (F.sum("__n").over(past) - F.col("__n")).alias("__days_earlier"))
    joined = looked.join(carried, [*keys, "__day"])
    return joined.select(*keys, t, "n", F.coalesce("__before", "__day_before").alias("before"), (F.col("__earlier") + F.col("__days_earlier")).alias("earlier"))


def cache_hits(df: DataFrame, keys: list[str], t: str, order: list[str], ttl_s: int = 900) -> DataFrame:
    """(keys, t, order, is_hit) of each row: whether the key was asked for at most ttl_s before, or earlier in its second.

    t is in whole seconds; within one, rows follow `order`, and rows that are equal in it too are one hit less
    than their number. Each request refreshes its entry. Null keys are no entries and have to be filtered out
    before; an empty table stays empty. Rows are spread by all of these columns, so no key is one task's load.
    """
    rows = df.groupBy(*keys, t, *order).agg(F.count(F.lit(1)).alias("__n"))
    first = F.min(F.struct(*[F.col(c) for c in order])).alias("__first")
    gone = by_second(df, keys, t).filter(F.col("before").isNull() | (F.col(t) - F.col("before") > ttl_s)).select(*keys, t)
    missed = rows.groupBy(*keys, t).agg(first).join(gone, [*keys, t], "left_semi")
    missed = missed.select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate([*keys, t])], *[F.col(f"__first.{c}").alias(f"__o{i}") for i, c in enumerate(order)], F.lit(True).alias("__missed"))
    same = [F.col(c).eqNullSafe(F.col(f"__k{i}")) for i, c in enumerate([*keys, t])] + [F.col(c).eqNullSafe(F.col(f"__o{i}")) for i, c in enumerate(order)]
    joined = rows.join(missed, reduce(lambda a, b: a & b, same), "left")
    each = repeated(joined.select(*keys, t, *order, "__missed", "__n"), "__n", "__copy")
    return each.select(*keys, t, *order, (F.col("__missed").isNull() | (F.col("__copy") > 1)).alias("is_hit"))


def cache_entries(df: DataFrame, keys: list[str], t: str, ttl_s: int = 900) -> DataFrame:
    """(keys, put_s, last_s, n_hits): each entry of the cache, from the request that put it in to its last hit."""
    named = df.select(F.to_json(F.struct(*keys)).alias("__key"), *keys, t)
    found = sessions(named, "__key", t, gap_s=ttl_s)
    read = F.from_json("actor", T.StructType([df.schema[k] for k in keys]))
    return found.select(read.alias("k"), F.col("start_s").alias("put_s"), F.col("end_s").alias("last_s"), (F.col("n_events") - 1).alias("n_hits")).select("k.*", "put_s", "last_s", "n_hits")


def ring_entries(df: DataFrame, key: str, t: str, order: list[str], n: int, flush: str | None = None, chunk_rows: int = ordered.CHUNK) -> DataFrame:
    """(key STRING, t) of what a ring of n places holds in the end, with each entry's last time.

    Requests come in order of t, then of `order`. A key that has a place refreshes its time and keeps its place; one
    that has none, or has lost it, takes the place that was filled first. flush: a boolean column of rows that make
    all entries old (time 0) instead.
    """
    rows = df.select(F.col(t).cast("long").alias("__t"), *order, F.col(key).cast("string").alias("__key"), (F.col(flush) if flush else F.lit(False)).alias("__flush"))
    fold, skip = ordered.ring_fold(n), len(order)
    state = ordered.folded(rows, ["__t", *order], lambda s, data: fold(s, [(r[0], *r[1 + skip :]) for r in data]), chunk_rows)
    each = F.explode(F.from_json("state", "array<array<string>>")).alias("e")
    return state.select(each).select(F.get("e", F.lit(0)).alias(key), F.get("e", F.lit(1)).cast("long").alias(t))


def ip_slots(df: DataFrame, client: str, t: str, most: int, expire_s: int = ACTIVE_S, tick_s: int = STATS_S, chunk_rows: int = ordered.CHUNK) -> DataFrame:
    """(client STRING, last_s): who holds one of `most` slots after the last request, and since when unused.

    A client without a slot takes a free one or is refused; slots unused for more than expire_s are freed at each
    tick. Of a client's requests within a tick the first decides and the last is its stamp, so only these are
    folded, in order of time and name. Null clients ask for none.
    """
    tick = F.floor(F.col(t) / tick_s)
    asked = df.filter(F.col(client).isNotNull()).groupBy(F.col(client).alias("__c"), tick.alias("__tick")).agg(F.min(t).alias("a"), F.max(t).alias("b"))
    rows = asked.select(F.explode(F.array_distinct(F.array("a", "b"))).alias("__t"), F.col("__c").cast("string").alias("__c"))
    state = ordered.folded(rows, ["__t", "__c"], ordered.slot_fold(most, expire_s, tick_s), chunk_rows)
    slots = F.from_json(F.get_json_object("state", "$.slots"), "map<string,bigint>")
    return state.select(F.explode(slots).alias(client, "last_s"))


def carried_values(df: DataFrame, keys: list[str], t: str, value: str, order: str) -> DataFrame:
    """(keys, t, carried): for each second of a key the last value known up to its end, null before the first one.

    It is what a memo by connection tells a request that brings no value of its own. Of several values in a second
    that of the largest `order` holds. Days of a key are at most 86,400 rows, joined by what each ends with.
    """
    known = F.max_by(F.when(F.col(value).isNotNull(), F.col(value)), F.when(F.col(value).isNotNull(), F.col(order)))
    seconds = df.groupBy(*keys, F.floor(F.col(t) / 86_400).alias("__day"), t).agg(known.alias("__v"))
    own = Window.partitionBy(*keys, "__day").orderBy(t).rowsBetween(Window.unboundedPreceding, 0)
    looked = seconds.select("*", F.last("__v", ignorenulls=True).over(own).alias("__own"))
    days = seconds.groupBy(*keys, "__day").agg(F.max_by("__v", F.when(F.col("__v").isNotNull(), F.col(t))).alias("__d"))
    past = Window.partitionBy(*keys).orderBy("__day").rowsBetween(Window.unboundedPreceding, -1)
    carried = days.select(*keys, "__day", F.last("__d", ignorenulls=True).over(past).alias("__past"))
    return looked.join(carried, [*keys, "__day"]).select(*keys, t, F.coalesce("__own", "__past").alias("carried"))


def active_clients(df: DataFrame, client: str, seconds: str, expire_s: int = ACTIVE_S, tick_s: int = STATS_S) -> DataFrame:
    """(tick_s, current, peak): clients active at each tick with a change, and the most so far.

    A client is active from a request to expire_s after its last one, so its active times are sessions with
    that gap. Only changes by tick, bounded by the time covered, are summed in order.
    """
    spans = sessions(df, client, seconds, gap_s=expire_s)
    up = lambda c: (F.ceil(c / tick_s) * tick_s).cast("long")
    changes = spans.select(F.inline(F.array(F.struct(up(F.col("start_s")).alias("tick_s"), F.lit(1).alias("d")), F.struct(up(F.col("end_s") + expire_s + 1).alias("tick_s"), F.lit(-1).alias("d")))))
    ticks = changes.groupBy("tick_s").agg(F.sum("d").alias("d")).filter("d <> 0")
    running = Window.orderBy("tick_s").rowsBetween(Window.unboundedPreceding, 0)
    return ticks.withColumn("current", F.sum("d").over(running)).withColumn("peak", F.max("current").over(running)).drop("d")


def violation_alerts(df: DataFrame, key: str, t: str, violations: int, threshold_s: int = 0) -> DataFrame:
    """(key, first, last, n): every run of `violations` rows of a key, if it took at most threshold_s (0: any time).

    The counter starts anew after each run, alerted or not. Null keys don't count. t is in whole seconds, and rows
    are counted by second, so a key with most rows is no task's whole load.
    """
    if violations < 1:
        raise ValueError("violations must be 1 or more")
    v = F.lit(violations)
    seconds = by_second(df.filter(F.col(key).isNotNull()), [key], t)
    # a second has the rows earlier + 1 to earlier + n; run r begins with row r v + 1 and ends with row (r + 1) v
    begins = F.struct(F.ceil(F.col("earlier") / v).cast("long").alias("lo"), F.floor((F.col("earlier") + F.col("n") - 1) / v).cast("long").alias("hi"), F.lit(True).alias("opens"))
    ends = F.struct(F.floor(F.col("earlier") / v).cast("long").alias("lo"), (F.floor((F.col("earlier") + F.col("n")) / v) - 1).cast("long").alias("hi"), F.lit(False).alias("opens"))
    spans = seconds.select(key, t, F.inline(F.array(begins, ends))).filter("lo <= hi")
    runs = repeated(spans.withColumn("__n", F.col("hi") - F.col("lo") + 1), "__n", "__at").select(key, t, "opens", (F.col("lo") + F.col("__at") - 1).alias("__run"))
    both = runs.groupBy(key, "__run").agg(F.min(F.when(F.col("opens"), F.col(t))).alias("first"), F.max(F.when(~F.col("opens"), F.col(t))).alias("last"))
    quick = (F.col("last") - F.col("first") <= threshold_s) if threshold_s else F.lit(True)
    return both.filter(F.col("last").isNotNull() & quick).select(key, "first", "last", v.cast("long").alias("n"))


def violation_reports(df: DataFrame, key: str, t: str, order: list[str], line: Column, violations: int, threshold_s: int = 0) -> DataFrame:
    """(key, first, last, report): each alert of violation_alerts with the lines of the rows that made it, in order.

    A row's number is what came before its second and its place within it, so only rows of one second are ordered
    together. A report has `violations` lines.
    """
    rows = df.filter(F.col(key).isNotNull()).select(key, t, *order, line.alias("__line"))
    seconds = by_second(rows, [key], t).select(key, t, "earlier")
    within = F.row_number().over(Window.partitionBy(key, t).orderBy(*order))
    numbered = rows.withColumn("__k", within).join(seconds, [key, t]).withColumn("__k", F.col("__k") + F.col("earlier"))
    runs = numbered.groupBy(key, F.floor((F.col("__k") - 1) / violations).alias("__run")).agg(
        F.min(t).alias("first"), F.max(t).alias("last"), F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.struct("__k", "__line"))).alias("__lines")
    )
    quick = (F.col("last") - F.col("first") <= threshold_s) if threshold_s else F.lit(True)
    return runs.filter((F.col("n") == violations) & quick).select(key, "first", "last", F.array_join(F.transform("__lines", lambda x: x["__line"]), "\n").alias("report"))


def token_alive(expires: Column, now: Column) -> Column:
    """A token carries its own expiry: no state is needed."""
    return F.coalesce(now <= expires, F.lit(False))
