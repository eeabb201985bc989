"""Mixing sources to target shares of tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveline.session import small_join


def source_key(c: Column) -> Column:
    """Sources are compared in lower case, trimmed, with "_" for "-"; blank ones are none."""
    from sieveline.functions.logfields import WHITE

    v = F.replace(F.lower(F.btrim(c, F.lit(WHITE))), F.lit("-"), F.lit("_"))
    return F.when(v != "", v)


def source_rates(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """(mix_name, source, target_tokens, source_tokens, max_copies, rate, is_short, draw_sd) for each target.

    sizes: (source, n_tokens) of every document, without source too. targets: (mix_name, size_ratio, source,
    weight, max_copies). The target is size_ratio x tokens of all documents x weight / sum of the mix's
    weights; null or negative weights count as 0, a mix whose weights sum to 0 has targets of 0; a null
    max_copies means no cap. rate: copies of each document that meet the target, at most max_copies. is_short:
    even max_copies of each text hold fewer tokens than the target. draw_sd: the standard deviation of the tokens
    that `mix` draws, since whole texts are drawn: of fraction f of the rate, the root of f (1 - f) x the sum of
    the texts' squared tokens. A source without documents has 0 tokens; targets without source are left out.
    Repeated (mix, source) targets are summed, with the largest of their max_copies.
    """
    # "" stands for no source: with nulls the two uses below would be filtered differently, and texts counted twice
    each = sizes.groupBy(F.coalesce("source", F.lit("")).alias("source")).agg(F.sum("n_tokens").alias("source_tokens"), F.sum(F.col("n_tokens").cast("double") * F.col("n_tokens")).alias("squares"))
    total = F.coalesce(each.agg(F.sum("source_tokens")).scalar(), F.lit(0))
    weight = F.greatest(F.coalesce(F.col("weight"), F.lit(0.0)), F.lit(0.0))
    wanted = targets.select("mix_name", "size_ratio", source_key(F.col("source")).alias("source"), weight.alias("weight"), "max_copies").filter("source IS NOT NULL")
    mixes = wanted.groupBy("mix_name").agg(F.sum("weight").alias("mix_weight"))
    wanted = wanted.groupBy("mix_name", "size_ratio", "source").agg(F.sum("weight").alias("weight"), F.max("max_copies").alias("max_copies"))
    tokens, target, most = F.col("source_tokens"), F.col("target_tokens"), F.col("max_copies").cast("double")
    return (
        wanted.join(mixes, "mix_name")
        .join(each, "source", "left")
        .withColumn("source_tokens", F.coalesce(tokens, F.lit(0)))
        .withColumn("target_tokens", F.coalesce(F.try_divide(F.col("size_ratio") * F.col("weight"), F.col("mix_weight")), F.lit(0.0)) * total)
        .withColumn("is_short", F.coalesce(tokens * most < target, tokens == 0) & (target > 0))
        .withColumn("rate", F.when(tokens > 0, F.least(target / F.nullif(tokens, F.lit(0)), most)).otherwise(0.0))
        .withColumn("f", F.col("rate") - F.floor("rate"))
        .withColumn("draw_sd", F.sqrt(F.col("f") * (1 - F.col("f")) * F.coalesce("squares", F.lit(0.0))))
        .select("mix_name", "source", "target_tokens", "source_tokens", "max_copies", "rate", "is_short", "draw_sd")
    )


def mix(documents: DataFrame, rates: DataFrame, id_col: str = "doc_id", seed: int = 17) -> DataFrame:
    """(mix_name, source, id, n_tokens, copy): each document floor(rate) times, and once more by chance.

    The chance is the fraction of the rate; it is drawn from a hash of seed, mix and id, so a rerun, another
    partitioning or a lost executor give the same selection. documents: (id, source, n_tokens), those without
    source are in no mix. Documents with a null id share one draw; repeated rows are selected each. The rates
    are a few rows and are broadcast behind a count of them, so hot sources need no shuffle. That count runs what
    the rates are made of, so sizes should be written down before (session.cut), lest texts are encoded twice.
    """
    wanted = rates.filter("rate > 0").select("mix_name", "source", "rate")
    rows = documents.select(F.col(f"`{id_col}`").alias("__id"), "source", "n_tokens").filter("source IS NOT NULL")
    draw = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("mix_name"), F.col("__id")), 11) * F.lit(2.0**-53)
    whole = F.floor("rate")
    copies = (whole + F.when(draw < F.col("rate") - whole, 1).otherwise(0)).cast("int")
    return (
        small_join(rows, wanted, ["source"], "inner")
        .withColumn("copies", copies)
        .filter("copies > 0")
        .select("mix_name", "source", F.col("__id").alias(id_col), "n_tokens", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
    )


def mix_shares(selection: DataFrame, rates: DataFrame) -> DataFrame:
    """What each source holds of its mix: target and reached tokens and shares, for sources with nothing too.

    Reached tokens differ from the target by what short sources lack, and else by the draw, draw_sd on average;
    shares are of what the mix holds, so a source that lacks something raises those of the others.
    """
    got = selection.groupBy("mix_name", "source").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("n_copies"))
    sums = got.groupBy("mix_name").agg(F.sum("tokens").alias("mix_tokens"))
    wanted = rates.groupBy("mix_name").agg(F.sum("target_tokens").alias("mix_target"))
    return (
        rates.join(got, ["mix_name", "source"], "left")
        .join(wanted, "mix_name")
        .join(sums, "mix_name", "left")
        .select(
            "mix_name", "source", "target_tokens", "source_tokens", "max_copies", "rate", "is_short", "draw_sd",
            F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("n_copies", F.lit(0)).alias("n_copies"),
            F.try_divide("target_tokens", "mix_target").alias("target_share"), F.coalesce(F.try_divide("tokens", "mix_tokens"), F.lit(0.0)).alias("share"),
        )
    )


def mix_violations(selection: DataFrame, documents: DataFrame, rates: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(mix_name, source, id, copies) of documents used otherwise than their rate says; no rows if all is right.

    Each document of a source must be used floor(rate) or ceil(rate) times, at most max_copies, its copies counted
    from 1. Ids must tell documents apart.
    """
    used = selection.groupBy("mix_name", F.col(f"`{id_col}`").alias("__id")).agg(F.count(F.lit(1)).alias("n"), F.max("copy").alias("last"))
    due = small_join(documents.select(F.col(f"`{id_col}`").alias("__id"), "source"), rates.select("mix_name", "source", "rate", "max_copies"), ["source"], "inner")
    n = F.coalesce("n", F.lit(0))
    wrong = (n < F.floor("rate")) | (n > F.ceil("rate")) | F.coalesce(n > F.col("max_copies"), F.lit(False)) | (F.coalesce("last", F.lit(0)) != n)
    return due.join(used, ["mix_name", "__id"], "left").filter(wrong).select("mix_name", "source", F.col("__id").alias(id_col), n.alias("copies"))
