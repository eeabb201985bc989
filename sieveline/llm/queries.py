"""Queries of problems 1, 2, 6, 7 and 8."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.functions import logfields as L
from sieveline.llm.bpe import count_tokens, encode_texts
from sieveline.llm.distinct import distinct_counts, hash_runs, merge_runs
from sieveline.llm.frequent import exact_counts, frequent_values
from sieveline.llm.mixing import mix, mix_shares, mix_violations, source_key, source_rates
from sieveline.llm.splitting import piece_violations, split_documents
from sieveline.operators.packed import split_packed
from sieveline.plans.access import _IP, _ONCE, _TRIM, _USER, _WHEN, LOGGED, _values_sql, log_once
from sieveline.plans.registry import QuerySet
from sieveline.session import cut, table

Q = QuerySet()


def logged_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log_once(spark, sf_dir, "url").select(L.raw_value(F.col("url")).alias("url"))


_URLS = f"(SELECT url, count(*) AS n FROM {_ONCE} WHERE {_TRIM('url')} NOT IN ('', '-') GROUP BY url)"


@Q.add("p1_found", f"SELECT url FROM {_URLS} QUALIFY n >= 0.003 * sum(n) OVER ()")
def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Urls held by at least 0.3 % of the records that have one."""
    return frequent_values(logged_urls(spark, sf_dir), "url", 0.003).select(F.col("value").alias("url"))


@Q.add("p1_urls", f"SELECT url, n, true AS within_error FROM (SELECT url, n, CAST(sum(n) OVER () AS BIGINT) AS n_total FROM {_URLS}) WHERE n >= 0.001 * n_total")
def p1_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Urls of at least 0.1 %, counted exactly in a second pass, and whether their estimates keep the error bound."""
    urls = logged_urls(spark, sf_dir)
    n = F.col("n")
    found = exact_counts(urls, "url", frequent_values(urls, "url", 0.001)).filter(n >= 0.001 * F.col("n_total"))
    return found.select(F.col("value").alias("url"), "n", F.col("n_estimate").between(n, n + F.col("max_error")).alias("within_error"))


def day_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Partial distinct sets of each log day, filter group and field."""
    seconds = L.epoch_seconds(F.col("when_txt"))
    category = F.when(L.has_value(F.col("category")), F.col("category"))
    once = log_once(
        spark, sf_dir, L.log_day(seconds).alias("log_day"), F.col("filter_group").cast("int").alias("filter_group"),
        L.user_key(F.col("user_name")).alias("user_name"), L.ip_key(F.col("ip")).alias("ip"), category.alias("category"),
    ).filter("log_day IS NOT NULL")
    fields = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("text")) for c in ("user_name", "ip", "category")])
    rows = once.select("log_day", "filter_group", F.explode(fields).alias("f")).select("log_day", "filter_group", "f.field", "f.text")
    cell = ["log_day", "filter_group", "field"]
    values = split_packed(rows, "text", cell, LOGGED, only=F.col("field") == "category")
    return hash_runs(values, cell, F.col("val"))


def day_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of each log day, filter group and field, and of all groups of a day together as group -1."""
    cells = ["log_day", "filter_group", "field"]
    runs = cut(day_runs(spark, sf_dir))  # the partial results are what is kept and joined with those of other days
    counts = distinct_counts(merge_runs(runs, cells, over="filter_group"), cells)
    whole = F.col("grouping_id") > 0
    return counts.filter(whole | F.col("filter_group").isNotNull()).withColumn("filter_group", F.when(whole, F.lit(-1)).otherwise(F.col("filter_group")))


_CELLS = f"""WITH o AS (SELECT *, {_WHEN} AS s FROM {_ONCE}),
 l AS (SELECT *, strftime(to_timestamp(s) AT TIME ZONE 'UTC', '%Y-%m-%d') AS log_day FROM o WHERE s IS NOT NULL),
 v AS (SELECT log_day, filter_group, 'user_name' AS field, {_USER} AS val FROM l
 UNION ALL SELECT log_day, filter_group, 'ip', {_IP} FROM l
 UNION ALL SELECT log_day, filter_group, 'category', unnest({_values_sql('category')}) FROM l WHERE {_TRIM('category')} NOT IN ('', '-')),
 w AS (SELECT * FROM v WHERE val IS NOT NULL),
 x AS (SELECT log_day, filter_group, field, val FROM w WHERE filter_group IS NOT NULL UNION ALL SELECT log_day, -1, field, val FROM w),
 c AS (SELECT log_day, filter_group, field, count(*) AS n_values, count(DISTINCT val) AS n_distinct FROM x GROUP BY ALL)"""


@Q.add("p2_found", f"{_CELLS} SELECT log_day, filter_group, field FROM c WHERE n_values >= 150 AND n_distinct >= 0.35 * n_values")
def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells with at least 150 values of which at least 35 % are different."""
    return day_counts(spark, sf_dir).filter((F.col("n_values") >= 150) & (F.col("n_distinct") >= 0.35 * F.col("n_values"))).select("log_day", "filter_group", "field")


@Q.add("p2_counts", f"""{_CELLS} SELECT log_day, filter_group, field, n_values, n_distinct, lost_expected, lost_expected / n_distinct AS lost_share
 FROM (SELECT *, CAST(n_distinct AS DOUBLE) * (CAST(n_distinct AS DOUBLE) - 1) / 36893488147419103232.0::DOUBLE AS lost_expected FROM c)""")
def p2_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every cell's count with its error: the values expected to be lost to equal hashes, and their share."""
    return day_counts(spark, sf_dir).select("log_day", "filter_group", "field", "n_values", "n_distinct", "lost_expected", "lost_share")


@Q.add("p2_combinations", f"""SELECT filter_group, how, cache_hit, CAST(grouping(filter_group, how, cache_hit) AS INTEGER) AS grouping_id, count(*) AS n_values, count(DISTINCT a) AS n_distinct
 FROM (SELECT filter_group, how, cache_hit, {_IP} AS a FROM {_ONCE}) WHERE a IS NOT NULL GROUP BY CUBE (filter_group, how, cache_hit)""")
def p2_combinations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Different addresses of each filter group, method and cache state, and of every combination of these."""
    cells = ["filter_group", "how", "cache_hit"]
    once = log_once(spark, sf_dir, "filter_group", "how", "cache_hit", L.ip_key(F.col("ip")).alias("a"))
    runs = cut(hash_runs(once, cells, F.col("a")))
    return distinct_counts(merge_runs(runs, cells, over=cells), cells).drop("lost_expected", "lost_share")


@Q.add("p6_ids")
def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document's text by byte_bpe_50k."""
    return encode_texts(table(spark, sf_dir, "documents"))


def _sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", source_key(F.col("source")).alias("source"), "text")
    return count_tokens(documents, "text", ["doc_id", "source"])


def _mixed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The selection of every mix, the rates and the documents' sizes."""
    sizes = cut(_sizes(spark, sf_dir))  # ids and counts only; texts are encoded once
    rates = source_rates(sizes, table(spark, sf_dir, "mix_targets"))
    return mix(sizes, rates), rates, sizes


@Q.add("p7_found")
def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources too small for their target share, by the mixes as they are drawn.

    Such a source has given all it may, each text max_copies times, and still holds less than its target.
    """
    shares = mix_shares(*_mixed(spark, sf_dir)[:2])
    spent = F.col("tokens") == F.col("source_tokens") * F.coalesce("max_copies", F.lit(0))
    return shares.filter(F.col("is_short") & spent & (F.col("tokens") < F.col("target_tokens"))).select("mix_name", "source")


@Q.add("p7_mix")
def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The selection of every mix, a row for each copy."""
    return _mixed(spark, sf_dir)[0]


@Q.add("p7_shares")
def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares reached in every mix."""
    return mix_shares(*_mixed(spark, sf_dir)[:2])


@Q.add("p7_violations", "SELECT mix_name, source, CAST(NULL AS BIGINT) AS doc_id, 0 AS copies FROM mix_targets WHERE false")
def p7_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that a mix uses more or less often than their rate and cap say: none."""
    picked, rates, sizes = _mixed(spark, sf_dir)
    return mix_violations(picked, sizes, rates)


@Q.add("p8_found")
def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that had to be split."""
    pieces = split_documents(table(spark, sf_dir, "documents"), only_split=True)
    return pieces.filter("piece = 1").select("doc_id")


@Q.add("p8_pieces")
def p8_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of every document that had to be split."""
    return split_documents(table(spark, sf_dir, "documents"), only_split=True)


@Q.add("p8_violations", "SELECT doc_id, 0 AS piece, '' AS problem FROM documents WHERE false")
def p8_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces that are too large, leave a gap, or overlap otherwise than they should: none."""
    lengths = table(spark, sf_dir, "documents").select("doc_id", F.length("text").alias("n_chars"))
    return piece_violations(p8_pieces(spark, sf_dir), lengths)
