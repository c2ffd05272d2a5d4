"""Dataset metrics and issue counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamis.dataset import Dataset
from tamis.functions.text import token_count
from tamis.issues import category_dimension


def token_stats(dataset: Dataset) -> DataFrame:
    """One row: record count and mean (half to even), min and max tokens."""
    return token_summary(dataset.df.select(token_count(dataset.content.text()).alias("tokens")))


def token_summary(counts: DataFrame) -> DataFrame:
    """The same of counts at hand, in a column ``tokens``."""
    zero = F.lit(0)
    return counts.agg(
        F.count(F.lit(1)).alias("record_count"),
        F.coalesce(
            F.bround(F.sum("tokens") / F.count(F.lit(1)), 0).cast("bigint"), zero
        ).alias("mean_tokens"),
        F.coalesce(F.min("tokens"), zero).cast("bigint").alias("min_tokens"),
        F.coalesce(F.max("tokens"), zero).cast("bigint").alias("max_tokens"),
    )


def flagged_ords(records: DataFrame, issues: DataFrame) -> DataFrame:
    """Distinct ``rec_ord`` of the records (rec_ord, loc) that at least one issue points to.

    A record-level issue carries the ``rec_ord`` of its record. One that has a location alone, as an
    extra detector may give it, is matched with the record at that place; several issues of a place
    are one before the join.
    """
    known = issues.filter("loc is not null and rec_ord is not null").select("rec_ord").distinct()
    placed = issues.filter("loc is not null and rec_ord is null and category <> 'parse_error'").select("loc").distinct()
    if placed.isEmpty():
        return known
    at = placed.select(F.xxhash64("loc").alias("at"), F.col("loc").alias("issue_loc"))
    found = records.select("rec_ord", "loc", F.xxhash64("loc").alias("at")).join(at, "at")
    found = found.filter(F.to_json("loc") == F.to_json("issue_loc"))
    return known.unionByName(found.select("rec_ord")).distinct()


def flagged_records(dataset: Dataset, issues: DataFrame) -> DataFrame:
    """Records at least one issue points to."""
    return dataset.df.join(flagged_ords(dataset.df, issues), "rec_ord", "left_semi")


def compute_metrics(dataset: Dataset, issues: DataFrame, scan: DataFrame | None = None) -> DataFrame:
    """One row of metrics; all zero for an empty dataset.

    ``scan``: staged records (rec_ord, loc, tokens), where token counts are known.
    """
    records = dataset.df if scan is None else scan
    flagged = flagged_ords(records, issues).agg(F.count(F.lit(1)).alias("flagged"))
    tokens = token_stats(dataset) if scan is None else token_summary(scan)
    both = tokens.unionByName(flagged, allowMissingColumns=True)
    both = both.agg(*[F.max(c).alias(c) for c in both.columns])  # two rows into one
    share = F.when(F.col("record_count") == 0, F.lit(0.0)).otherwise(
        F.col("flagged") / F.col("record_count")
    )
    score = F.when(F.col("record_count") == 0, F.lit(0.0)).otherwise(1 - share)
    return both.select(
        "record_count",
        "mean_tokens",
        "min_tokens",
        "max_tokens",
        share.alias("issue_record_proportion"),
        score.alias("quality_score"),
    )


def category_counts(issues: DataFrame) -> DataFrame:
    """Issue count of each of the thirteen categories, zero included."""
    counts = issues.groupBy("category").agg(F.count(F.lit(1)).alias("n"))
    dimension = category_dimension(issues.sparkSession)
    return dimension.join(F.broadcast(counts), "category", "left").select(
        "category_ord", "category", F.coalesce("n", F.lit(0)).alias("n_issues")
    )
