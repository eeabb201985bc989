"""Phrases in texts: hits, combinations, scores, categories, reasons and verdicts."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sieveline.functions import text as X
from sieveline.sources.lists import BANNED, EXCEPTION, WEIGHTED, PhraseBase

#: Up to so many phrases are searched for by built-in functions, more by an automaton.
FEW = 4

#: Category of scores of embedded urls.
EMBEDDED = "Embedded URLs"

OUTCOMES = ("combination exception", "exception", "banned combination", "banned", "weighted", "clean")


def _builtin_hits(df: DataFrame, keys: list[str], text: str, needles: list[str]) -> DataFrame:
    counts = F.array(*[F.struct(F.lit(p).alias("phrase"), X.overlapping_count(F.col(text), p).cast("long").alias("n")) for p in needles])
    # outer: else the optimizer would count once more, to test for hits before they are put in rows
    return df.select(*keys, F.inline_outer(F.filter(counts, lambda h: h["n"] > 0))).filter("phrase IS NOT NULL")


def _automaton_hits(df: DataFrame, keys: list[str], text: str, needles: list[str]) -> DataFrame:
    schema = T.StructType([*(df.schema[k] for k in keys), T.StructField("phrase", T.StringType()), T.StructField("n", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        a = ahocorasick.Automaton()
        for p in needles:
            a.add_word(p, p)
        a.make_automaton()
        for b in batches:
            rows, phrases, counts = [], [], []
            for k, t in enumerate(b.column(b.num_columns - 1)):
                t = t.as_py()
                for p, n in Counter(p for _, p in a.iter(t)).items() if t else ():
                    rows.append(k)
                    phrases.append(p)
                    counts.append(n)
            if rows:
                at = pa.array(rows, pa.int32())
                yield pa.RecordBatch.from_arrays([*(b.column(i).take(at) for i in range(len(keys))), pa.array(phrases, pa.string()), pa.array(counts, pa.int64())], names=schema.names)

    return df.select(*keys, text).mapInArrow(run, schema)


def phrase_hits(df: DataFrame, keys: list[str], text: str, needles: list[str], few: int = FEW) -> DataFrame:
    """(keys, phrase, n): occurrences of each phrase in each row's text, overlapping ones too; whole texts.

    Few phrases are counted by built-in functions, more in one pass by an Aho-Corasick automaton in Arrow
    batches. Null and empty texts and empty phrases have no hits; rows aren't joined, so repeated ones repeat.
    """
    needles = sorted({p for p in needles if p})
    if not needles:
        return df.select(*keys, F.lit(None).cast("string").alias("phrase"), F.lit(0).cast("long").alias("n")).filter(F.lit(False))
    return (_builtin_hits if len(needles) <= few else _automaton_hits)(df, keys, text, needles)


#: Rules up to which a base is broadcast.
BROADCAST_RULES = 1_000_000


def _literals(df: DataFrame, rows: list[tuple], schema: str) -> DataFrame:
    """A rule base on the driver as a table, broadcast up to BROADCAST_RULES; a larger one is left to a shuffle."""
    rules = df.sparkSession.createDataFrame(rows, schema)
    return F.broadcast(rules) if len(rows) <= BROADCAST_RULES else rules


def combi_hits(hits: DataFrame, keys: list[str], base: PhraseBase) -> DataFrame:
    """(keys, combi_id, n): combinations of which all parts are hit; n is the fewest occurrences of a part."""
    parts = [(i, x, len(set(p.parts))) for i, p in enumerate(base.combined()) for x in sorted(set(p.parts))]
    named = _literals(hits, parts, "combi_id int, phrase string, n_parts int")
    return hits.join(named, "phrase").groupBy(*keys, "combi_id", "n_parts").agg(F.count(F.lit(1)).alias("k"), F.min("n").alias("n")).filter("k = n_parts").select(*keys, "combi_id", "n")


def contributions(hits: DataFrame, keys: list[str], base: PhraseBase, mode: int = 1, by: list[str] | None = None) -> DataFrame:
    """(keys, label, kind, is_combi, weight, category): what each phrase and combination found adds.

    mode 1 counts every occurrence (a combination its fewest), mode 2 each phrase once. A single phrase is a
    rule of one part, so texts are searched once for both. Hits are shuffled once, by some of the keys (all by
    default); what is later grouped by these or more columns needs no further shuffle.
    """
    if mode not in (1, 2):
        raise ValueError("mode must be 1 or 2")
    singles = [((p.parts[0],), p, p.parts[0]) for p in base.single()]
    combis = [(tuple(sorted(set(p.parts))), p, "(" + ", ".join(p.parts) + ")") for p in base.combined()]
    rules = [(i, part, len(parts), label, p.kind, len(p.parts) > 1, p.weight, p.category) for i, (parts, p, label) in enumerate(singles + combis) for part in parts]
    named = _literals(hits, rules, "rule int, phrase string, n_parts int, label string, kind int, is_combi boolean, w int, category string")
    rule = ["rule", "n_parts", "label", "kind", "is_combi", "w", "category"]
    each = hits.repartition(*(by or keys)).join(named, "phrase").groupBy(*keys, *rule).agg(F.count(F.lit(1)).alias("k"), F.min("n").alias("n"))
    times = F.col("n") if mode == 1 else F.lit(1).cast("long")
    return each.filter("k = n_parts").select(*keys, "label", "kind", "is_combi", (F.col("w") * times).alias("weight"), "category")


def category_scores(found: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, category, score): positive weights by category."""
    return found.filter((F.col("kind") == WEIGHTED) & (F.col("weight") > 0) & F.col("category").isNotNull()).groupBy(*keys, "category").agg(F.sum("weight").alias("score"))


def ranked_categories(scores: DataFrame, keys: list[str]) -> DataFrame:
    """Category scores with their rank: highest score first, then by name."""
    w = Window.partitionBy(*keys).orderBy(F.desc("score"), "category")
    return scores.withColumn("rank", F.row_number().over(w))


def category_text(scores: DataFrame, keys: list[str], threshold: int = 0) -> DataFrame:
    """(keys, categories): names by falling score, joined by ", ".

    threshold above 0 leaves out lower scores, below 0 keeps the first only, 0 all.
    """
    each = F.collect_list(F.struct((-F.col("score")).alias("s"), F.col("category").alias("c")))
    return scores.groupBy(*keys).agg(_names(each, threshold).alias("categories")).filter("categories <> ''")


def _names(scored: Column, threshold: int) -> Column:
    """Categories from an array of (minus score, category)."""
    kept = F.filter(scored, lambda x: -x["s"] >= threshold) if threshold > 0 else scored
    names = F.transform(F.array_sort(kept), lambda x: x["c"])
    return F.coalesce(F.get(names, F.lit(0)), F.lit("")) if threshold < 0 else F.array_join(names, ", ")


def merged_score(scores: Column) -> Column:
    """Over the passes: the highest positive score, else the lowest."""
    return F.coalesce(F.max(F.when(scores > 0, scores)), F.min(scores), F.lit(0).cast("long"))


def verdicts(found: DataFrame, keys: list[str], limit: int, threshold: int = 0) -> DataFrame:
    """(keys, score, outcome, reason, categories) of each row with anything found.

    Combination exceptions come before phrase exceptions, these before banned combinations, banned phrases and
    a score above the limit. reason: the deciding phrase (the last in byte order), or "limit : score (a+b+-c)".
    What a row can collect is bounded by the rule base.
    """
    kind, combi = F.col("kind"), F.col("is_combi")
    last = lambda k, c: F.max(F.when((kind == k) & (combi == F.lit(c)), F.col("label")))
    weighted = F.when(kind == WEIGHTED, F.struct(combi, F.when(F.col("weight") < 0, F.concat(F.lit("-"), F.col("label"))).otherwise(F.col("label")).alias("l")))
    named = F.when((kind == WEIGHTED) & (F.col("weight") > 0) & F.col("category").isNotNull(), F.struct(F.col("category").alias("c"), F.col("weight").alias("w")))
    each = found.groupBy(*keys).agg(
        last(EXCEPTION, True).alias("ce"), last(EXCEPTION, False).alias("e"), last(BANNED, True).alias("cb"), last(BANNED, False).alias("b"),
        F.coalesce(F.sum(F.when(kind == WEIGHTED, F.col("weight"))), F.lit(0).cast("long")).alias("score"),
        F.array_join(F.transform(F.array_sort(F.collect_list(weighted)), lambda x: x["l"]), "+").alias("w"), F.collect_list(named).alias("named"),
    )
    over, named = F.col("score") > limit, F.col("named")
    outcome = F.when(F.col("ce").isNotNull(), OUTCOMES[0]).when(F.col("e").isNotNull(), OUTCOMES[1]).when(F.col("cb").isNotNull(), OUTCOMES[2]).when(F.col("b").isNotNull(), OUTCOMES[3]).when(over, OUTCOMES[4]).otherwise(OUTCOMES[5])
    reason = F.coalesce("ce", "e", "cb", "b", F.when(over, F.concat(F.lit(f"{limit} : "), F.col("score").cast("string"), F.lit(" ("), F.col("w"), F.lit(")"))), F.lit(""))
    total = lambda c: F.aggregate(F.filter(named, lambda x: x["c"] == c), F.lit(0).cast("long"), lambda a, x: a - x["w"])
    scored = F.transform(F.array_distinct(F.transform(named, lambda x: x["c"])), lambda c: F.struct(total(c).alias("s"), c.alias("c")))
    return each.select(*keys, "score", outcome.alias("outcome"), reason.alias("reason"), _names(scored, threshold).alias("categories"))


def score_texts(df: DataFrame, id_col: str, text: str, base: PhraseBase, limit: int, mode: int = 1, filter_mode: int = 2, preserve_case: int = 0, threshold: int = 0, links: DataFrame | None = None) -> DataFrame:
    """(id, outcome, score, reason, categories) of every row, by the strictest of its passes.

    The passes are raw and stripped texts; each is judged against the limit on its own. A row without hits is
    clean with score 0. Null texts are clean. links: (id, weight, label) of embedded urls, as link_weights gives
    them; they add to the score of every pass.
    """
    parts = df.select(id_col, F.inline(X.passes(F.col(text), filter_mode, preserve_case)))
    found = contributions(phrase_hits(parts, [id_col, "pass"], "text", base.needles()), [id_col, "pass"], base, mode, by=[id_col])
    if links is not None:
        names = F.array(*[F.lit(n) for n in X.pass_names(filter_mode, preserve_case)])
        found = found.unionByName(links.select(id_col, F.explode(names).alias("pass"), "label", F.lit(WEIGHTED).alias("kind"), F.lit(False).alias("is_combi"), F.col("weight").cast("long").alias("weight"), F.lit(EMBEDDED).alias("category")))
    each = verdicts(found, [id_col, "pass"], limit, threshold)
    rank = F.array_position(F.array(*[F.lit(x) for x in OUTCOMES]), F.col("outcome"))
    best = each.groupBy(id_col).agg(
        F.min(F.struct(rank.alias("r"), (-F.col("score")).alias("s"), F.col("pass"), F.col("outcome"), F.col("reason"), F.col("categories"))).alias("v"), merged_score(F.col("score")).alias("score")
    )
    rows = df.select(id_col).join(best, id_col, "left")
    return rows.select(id_col, F.coalesce("v.outcome", F.lit("clean")).alias("outcome"), F.coalesce("score", F.lit(0).cast("long")).alias("score"), F.coalesce("v.reason", F.lit("")).alias("reason"), F.coalesce("v.categories", F.lit("")).alias("categories"))
