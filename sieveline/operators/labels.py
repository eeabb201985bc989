"""Self-rating labels in pages: each label's value against the limit of its service."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveline.session import small_join

#: The rating services and their labels. Fixed values.
SERVICES = {
    "evaluweb": "rating",
    "weburbia": "s",
    "microsys": "sex other",
    "icec": "y",
    "safenet": "n s v l i h",
    "rsac": "v s n l",
    "vancouver": "mc edu env tol v s p sf can com gam",
    "safesurf": "000 001 002 003 004 005 006 007 008 009 00a",
    "icra": "la ca cb lb lc na nb nc nd ne nf ng nh ni nr ns nt oa ob oc od oe of og oh va vb vc vd ve vf vg vh vi vj vk vr vs vt vu",
}


def limits_rows(default: int = 0, limits: dict[tuple[str, str], int] | None = None) -> list[tuple[str, str, int]]:
    """(service, label, limit) of every label."""
    limits = limits or {}
    return [(s, x, limits.get((s, x), default)) for s, labels in SERVICES.items() for x in labels.split()]


def ratings(html: Column) -> Column:
    """ARRAY<STRUCT<service, rating>>: in each label tag, the text in brackets after r or ratings, and what precedes it."""
    tags = F.regexp_extract_all(F.lower(html), F.lit("pics-label[\"'][ \\t]*content=[\"']([^>]*)[\"']"), F.lit(1))
    one = lambda tag: F.transform(
        F.regexp_extract_all(tag, F.lit("(.*?(?:^|[^a-z])(?:r|ratings)\\s*\\([^)]*\\))"), F.lit(1)),
        lambda x: F.struct(F.regexp_replace(x, "\\([^()]*\\)$", "").alias("service"), F.regexp_extract(x, "\\(([^()]*)\\)$", 1).alias("rating")),
    )
    return F.flatten(F.transform(tags, one))


def exceeded(pages: DataFrame, id_col: str, html: str, limits: DataFrame) -> DataFrame:
    """(id, service, label, value, max_level) of every label above its limit; equal to it is allowed.

    limits: (service, label, max_level). Pages without labels give no rows. Labels are words of their own in
    the rating; the first value of a label holds, and one that isn't a number counts as 0.
    """
    each = pages.select(id_col, F.explode(ratings(F.col(html))).alias("r")).select(id_col, "r.service", "r.rating")
    pairs = F.regexp_extract_all("rating", F.lit("([a-z0-9]+ -?[0-9]+)"), F.lit(1))
    named = each.select(id_col, F.col("service").alias("text"), F.explode(pairs).alias("p")).select(id_col, "text", F.substring_index("p", " ", 1).alias("label"), F.substring_index("p", " ", -1).cast("int").alias("value"))
    return (
        small_join(named, limits, ["label"], "inner")
        .filter(F.col("text").contains(F.col("service")) & (F.col("value") > F.col("max_level")))
        .select(id_col, "service", "label", "value", "max_level")
    )
