"""Pages: labels, decoding, phrases and embedded urls as one check; and the filter of size gates, scanners, check and rewriting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveline.functions import text as X
from sieveline.operators import scanners as SC
from sieveline.operators.labels import exceeded
from sieveline.operators.phrases import OUTCOMES, score_texts
from sieveline.operators.verdict import scan_gate
from sieveline.sources.config import MainOptions
from sieveline.sources.lists import PhraseBase

#: Outcome and category of a page that labels itself above the limits.
LABEL, RATED = "label", "PICS"


def check_pages(df: DataFrame, id_col: str, text: str, base: PhraseBase, limit: int, mode: int = 1, filter_mode: int = 2, preserve_case: int = 0, threshold: int = 0, hex_decode: bool = False, label_limits: DataFrame | None = None, links: DataFrame | None = None) -> DataFrame:
    """(id, outcome, score, reason, categories) of every page; ids must be unique.

    A label above its limit bans at once: outcome "label", reason "service label value" of the first by name, score 0.
    Else the text, with %XX decoded where hex_decode says so, is scored in its passes, the weights of embedded
    urls (links: id, weight, label, as link_weights gives them) added to each. Null texts are clean.
    """
    scored = df.select(id_col, (X.percent_decode(F.col(text)) if hex_decode else F.col(text)).alias(text))
    out = score_texts(scored, id_col, text, base, limit, mode, filter_mode, preserve_case, threshold, links)
    if label_limits is None:
        return out
    first = F.min(F.struct("service", "label", "value"))
    rated = exceeded(df, id_col, text, label_limits).groupBy(id_col).agg(first.alias("__l"))
    why = F.concat_ws(" ", "__l.service", "__l.label", F.col("__l.value").cast("string"))
    by = lambda own, other: F.when(F.col("__l").isNotNull(), own).otherwise(F.col(other)).alias(other)
    return out.join(rated, id_col, "left").select(id_col, by(F.lit(LABEL), "outcome"), by(F.lit(0).cast("long"), "score"), by(why, "reason"), by(F.lit(RATED), "categories"))


def content_filter(df: DataFrame, id_col: str, text: str, base: PhraseBase, limit: int, signatures: tuple[tuple[str, str], ...], rewrites: list[tuple[str, str]], options: MainOptions = MainOptions(), keep: tuple[Column, ...] = (), **check) -> DataFrame:
    """(id, stage, the kept columns) of every text. Ids must be unique.

    stage: "infected" by a scanner (texts within the scan limits); "banned" or "exception" by its phrases;
    "rewritten" if clean and changed by the replacements; "checked" if clean; "passed" if empty or null, or above
    maxcontentfiltersize, where phrases and replacements aren't tried. Texts aren't shuffled, only what is found.
    check: further options of check_pages, such as labels and embedded urls.
    """
    size = F.octet_length(text)
    bad = SC.chain([SC.signature_scan(F.col(text), signatures)])["code"] != SC.CLEAN
    held = scan_gate(size, options.maxcontentramcachescansize, options.maxcontentfilecachescansize) != "unscanned"
    first = F.when(F.coalesce(size, F.lit(0)) == 0, "passed").when(held & bad, "infected").when(size > options.maxcontentfiltersize * 1024, "passed")
    staged = df.withColumn("__first", first)
    outcomes = check_pages(staged.filter("__first IS NULL"), id_col, text, base, limit, **check).select(id_col, "outcome")
    changed = F.when(F.col("__first").isNull(), X.rewrite(F.col(text), rewrites) != F.col(text))
    facts = staged.select(id_col, "__first", changed.alias("__changed"), *keep).join(outcomes, id_col, "left")
    outcome = F.col("outcome")
    stage = F.coalesce(F.col("__first"), F.when(outcome.isin(LABEL, *OUTCOMES[2:5]), "banned").when(outcome.isin(*OUTCOMES[:2]), "exception").when(F.col("__changed"), "rewritten").otherwise("checked"))
    return facts.withColumn("__stage", stage).drop("__first", "__changed", "outcome").withColumnRenamed("__stage", "stage")
