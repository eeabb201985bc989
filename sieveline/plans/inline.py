"""Small inline tables that Spark and the oracle read alike, and the rules that queries use."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sieveline.sources.lists import BANNED, EXCEPTION, WEIGHTED, Phrase, PhraseBase, Regex


def literal(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v).upper()
    return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)


def values_sql(rows: list[tuple], names: str) -> str:
    """VALUES as a table for DuckDB."""
    return "(SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(literal, r)) + ")" for r in rows) + f") v({names}))"


def inline(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


_PHRASES = [
    ("raffle", WEIGHTED, 30, "Gambling"), ("lotto", WEIGHTED, 25, "Gambling"), ("free spins", WEIGHTED, 40, "Gambling"), ("jackpot", WEIGHTED, 20, "Gambling"),
    ("loan offer", WEIGHTED, 15, "Finance"), ("tarot night", WEIGHTED, 10, "Occult"), ("spell book", WEIGHTED, 12, "Occult"), ("crack code", WEIGHTED, 35, "Warez"),
    ("library", WEIGHTED, -5, "Education"), ("win big", WEIGHTED, 18, None), ("proxy", WEIGHTED, 2, "Proxies"), ("raffle", WEIGHTED, 9, "Gambling"),
    ("map tile", BANNED, 0, "Maps"), ("study room", EXCEPTION, 0, None),
]
_COMBIS = [
    (("raffle", "proxy"), WEIGHTED, 7, "Gambling"), (("jackpot", "lotto", "free spins"), WEIGHTED, 50, "Gambling"), (("crack code", "proxy"), BANNED, 0, "Warez"),
    (("spell book", "library"), EXCEPTION, 0, None), (("loan offer", "never there"), BANNED, 0, "Finance"),
]


def phrase_base() -> PhraseBase:
    """Weighted, banned and exception phrases, a repeated one, and combinations of two and three parts."""
    singles = [Phrase((p,), k, w, c, None, i) for i, (p, k, w, c) in enumerate(_PHRASES)]
    combis = [Phrase(p, k, w, c, None, len(_PHRASES) + i) for i, (p, k, w, c) in enumerate(_COMBIS)]
    return PhraseBase(singles + combis)


def single_sql() -> str:
    return values_sql([(p.parts[0], p.kind, p.weight, p.category) for p in phrase_base().single()], "phrase, kind, w, category")


def needle_sql() -> str:
    return values_sql([(x,) for x in phrase_base().needles()], "phrase")


def combi_sql() -> str:
    return values_sql([(i, "(" + ", ".join(p.parts) + ")", p.kind, p.weight, p.category, len(p.parts)) for i, p in enumerate(phrase_base().combined())], "combi_id, label, kind, w, category, n_parts")


def part_sql() -> str:
    return values_sql([(i, x) for i, p in enumerate(phrase_base().combined()) for x in p.parts], "combi_id, phrase")


URL_REGEXES = [Regex(0, r"/(?:download|assets)/[^?]*\.(?:zip|php)$", None, "Downloads"), Regex(1, r"[?&]q=[^&]*score", None, "Scores"), Regex(2, r"^cdn\.", None, "Delivery")]
EXCEPTION_REGEXES = [Regex(0, r"/help/", None, None), Regex(1, r"^updates\.", None, None)]
REWRITES = [(r"(https?)://([a-z0-9.-]+)", r"[$2|\1]"), ("filter group", "group"), (r"\bgroup (\w+)", r"group <$1>"), ("jackpot", "")]
URL_REWRITES = [(r"^http://", "https://"), (r"([?&])s=[0-9a-f]+", r"\1s=0"), (r":3128/", "/")]
HEADER_REWRITES = [(r"^(user-agent: larkview)/[\d.]+", r"$1/1"), (r"^(x-forwarded-for: ).*$", r"\1hidden")]
SEARCH_PATTERNS = [r"[?&]q=([^&]*)", r"/find/([^/?]*)"]
