"""Exact and near duplicates."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamis import fixed
from tamis.config import checked_threshold
from tamis.dataset import Dataset
from tamis.functions.text import three_decimals
from tamis.issues import DUPLICATES, issue, literal_issues, order_key
from tamis.operators.numbering import record_positions
from tamis.operators.similarity import similar_pairs, similarity_column
from tamis.operators.skew import attach_by_key, crowded_keys, join_in_blocks
from tamis.staging import stage_table

FIRST = -(2**63)


def scan_records(dataset: Dataset, threshold: float, **more: Column) -> DataFrame:
    """Staged ``rec_ord, loc, key`` of each record, ``sig`` for the similarity join, and more columns.

    All that needs the records' contents, so they are read once.
    """
    sig = similarity_column(dataset, threshold)
    columns = {"key": dataset.content.key(), **({} if sig is None else {"sig": sig}), **more}
    return stage_table(dataset.df.select("rec_ord", "loc", *[c.alias(n) for n, c in columns.items()]), "scan")


def duplicate_features(dataset: Dataset, scan: DataFrame | None = None) -> DataFrame:
    """What duplicate issues need of each record: ``rec_ord, loc, key, rec_idx``, staged."""
    rows = scan_records(dataset, 0) if scan is None else scan
    return stage_table(record_positions(rows.select("rec_ord", "loc", "key")), "features")


def exact_groups(dataset: Dataset) -> DataFrame:
    """Per distinct content: ``key``, first ``rec_ord`` and number of records.

    Partial aggregation merges copies before the shuffle, so content repeated in
    a third of all records costs one row per task.
    """
    return (
        dataset.df.select(dataset.content.key().alias("key"), "rec_ord")
        .groupBy("key")
        .agg(F.min("rec_ord").alias("first_ord"), F.count(F.lit(1)).alias("n_records"))
    )


def exact_copies(dataset: Dataset) -> DataFrame:
    """Records equal to an earlier one: ``rec_ord``, ``first_ord``, ``n_records``."""
    groups = exact_groups(dataset).filter("n_records > 1")
    rows = dataset.df.select(dataset.content.key().alias("key"), "rec_ord")
    found = attach_by_key(rows, groups, "key", "n_records", "rec_ord")
    return found.filter("first_ord is not null and rec_ord <> first_ord").drop("key")


def located_copies(features: DataFrame) -> DataFrame:
    """Copies with position and location of their own and of the first record."""
    groups = (
        features.groupBy("key")
        .agg(
            F.min("rec_ord").alias("first_ord"),
            F.count(F.lit(1)).alias("n_records"),
            F.min_by(F.struct("rec_idx", "loc"), "rec_ord").alias("first"),
        )
        .filter("n_records > 1")
        .select(
            "key", "first_ord", "n_records", F.col("first.rec_idx").alias("first_idx"),
            F.col("first.loc").alias("first_loc"),
        )
    )
    groups = stage_table(groups, "groups")
    found = attach_by_key(features, groups, "key", "n_records", "rec_ord")
    return found.filter("first_ord is not null and rec_ord <> first_ord").drop("key")


def exact_duplicate_issues(dataset: Dataset, copies: DataFrame | None = None) -> DataFrame:
    """One issue per record whose content occurred before, pointing at the first."""
    copies = located_copies(duplicate_features(dataset)) if copies is None else copies
    return copies.select(
        issue(
            "duplicate",
            order_key(DUPLICATES, F.col("rec_ord"), F.col("first_ord")),
            loc=F.col("loc"),
            related_loc=F.col("first_loc"),
            detail=F.format_string(fixed.DETAIL_DUPLICATE, "rec_idx", "first_idx"),
            rec_ord=F.col("rec_ord"),
        ).alias("issue")
    ).select("issue.*")


def near_duplicate_pairs(
    dataset: Dataset, threshold: float, copies: DataFrame | None = None, scan: DataFrame | None = None
) -> DataFrame:
    """Staged pairs ``(rec_ord, other_ord, score)`` of similar records.

    ``rec_ord`` is always a first occurrence; ``other_ord`` is any earlier record
    with different content, so a copy of similar content counts again.
    """
    pairs = stage_table(similar_pairs(dataset, threshold, scan), "pairs")
    firsts = pairs.select(
        F.col("later_ord").alias("rec_ord"), F.col("earlier_ord").alias("other_ord"), "score"
    )
    copies = exact_copies(dataset) if copies is None else copies
    copies = copies.select(
        F.col("first_ord").alias("earlier_ord"), F.col("rec_ord").alias("other_ord")
    )
    crowded = crowded_keys(pairs, copies, "earlier_ord")
    repeats = (
        join_in_blocks(pairs, copies, "earlier_ord", crowded, "later_ord", "other_ord")
        .filter("other_ord < later_ord")
        .select(F.col("later_ord").alias("rec_ord"), "other_ord", "score")
    )
    return stage_table(firsts.unionByName(repeats), "near_pairs")


def near_duplicate_issues(
    dataset: Dataset,
    threshold: float,
    copies: DataFrame | None = None,
    features: DataFrame | None = None,
    scan: DataFrame | None = None,
) -> DataFrame:
    if features is None:
        scan = scan_records(dataset, threshold)
        features = duplicate_features(dataset, scan)
    if copies is None:
        copies = stage_table(located_copies(features), "copies")
    if threshold == 0 or scan is None or "sig" not in scan.columns:
        scan = None
    pairs = near_duplicate_pairs(dataset, threshold, copies, scan)
    own = features.select("rec_ord", "rec_idx", "loc")
    other = features.select(
        F.col("rec_ord").alias("other_ord"), F.col("rec_idx").alias("other_idx"), F.col("loc").alias("other_loc")
    )
    placed = join_in_blocks(pairs, own, "rec_ord", crowded_keys(pairs, None, "rec_ord"), "other_ord", "rec_ord")
    crowded = crowded_keys(pairs, None, "other_ord")
    placed = join_in_blocks(placed, other, "other_ord", crowded, "rec_ord", "other_ord")
    return placed.select(
        issue(
            "near_duplicate",
            order_key(DUPLICATES, F.col("rec_ord"), F.col("other_ord")),
            loc=F.col("loc"),
            related_loc=F.col("other_loc"),
            detail=F.format_string(
                fixed.DETAIL_NEAR_DUPLICATE,
                "rec_idx",
                "other_idx",
                three_decimals(F.col("score")),
                F.lit(f"{threshold:.3f}"),
            ),
            score=F.col("score"),
            rec_ord=F.col("rec_ord"),
        ).alias("issue")
    ).select("issue.*")


def similarity_threshold(threshold: Any):
    """The threshold in force, and what is wrong with the given one."""
    return checked_threshold("similarity_threshold", threshold, fixed.DEFAULT_SIMILARITY_THRESHOLD)


def detect_duplicates(
    dataset: Dataset, threshold: Any = fixed.DEFAULT_SIMILARITY_THRESHOLD, scan: DataFrame | None = None
) -> DataFrame:
    """Exact and near duplicate issues; a bad threshold adds one config issue.

    ``scan``: from ``scan_records`` with the threshold that ``similarity_threshold`` gives, if there is one.
    """
    effective, rejected = similarity_threshold(threshold)
    if scan is None:
        scan = scan_records(dataset, effective)
    features = duplicate_features(dataset, scan)
    copies = stage_table(located_copies(features), "copies")
    found = exact_duplicate_issues(dataset, copies).unionByName(
        near_duplicate_issues(dataset, effective, copies, features, scan)
    )
    if rejected:
        found = found.unionByName(
            literal_issues(
                dataset.df.sparkSession,
                [
                    {
                        "category": "config_error",
                        "field_name": rejected.parameter,
                        "detail": rejected.detail,
                        "issue_ord": (DUPLICATES, FIRST, 0, 0),
                    }
                ],
            )
        )
    return found
