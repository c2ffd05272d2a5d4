"""Whether two datasets hold the same records in the same order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamis.dataset import Dataset, TypedContent
from tamis.operators.numbering import record_positions
from tamis.sources.parquet_files import tagged_fields


def _comparable(dataset: Dataset) -> Column:
    """Name-sorted ``(name, type, value)``; nested values as normalised JSON."""
    content = dataset.content
    fields = (
        tagged_fields(content.schema, list(content.names))
        if isinstance(content, TypedContent)
        else F.col("fields")
    )
    return F.array_sort(
        F.transform(
            fields,
            lambda f: F.struct(
                f["name"].alias("name"),
                f["type"].alias("type"),
                F.when(f["type"] == "string", f["str"])
                .when(
                    f["type"].isin("list", "object"),
                    F.coalesce(F.to_json(F.try_parse_json(f["json"])), f["json"]),
                )
                .otherwise(f["json"])
                .alias("value"),
            ),
        )
    )


def differing_records(left: Dataset, right: Dataset) -> DataFrame:
    """Positions at which the datasets differ, or only one has a record."""

    def numbered(dataset: Dataset, name: str) -> DataFrame:
        keyed = dataset.df.select("rec_ord", _comparable(dataset).alias(name))
        return record_positions(keyed).select("rec_idx", name)

    both = numbered(left, "left").join(numbered(right, "right"), "rec_idx", "full_outer")
    return both.filter(~F.col("left").eqNullSafe(F.col("right"))).select("rec_idx")


def equivalent(left: Dataset, right: Dataset) -> bool:
    return differing_records(left, right).isEmpty()
