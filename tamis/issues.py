"""The issue row: its columns, its order, and a builder for issue structs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tamis import fixed

LOC_DDL = (
    "struct<source_file:string,line_number:bigint,array_index:bigint,"
    "row_group:int,row_index:bigint>"
)
ORDER_DDL = "struct<stage:int,rec_ord:bigint,a:bigint,b:bigint>"

# Stages of the report order: parse, duplicates, per record, schema.
PARSE, DUPLICATES, PER_RECORD, CONFORMANCE = range(4)

ISSUE_TYPES = {
    "category": "string",
    "loc": LOC_DDL,
    "field_name": "string",
    "related_loc": LOC_DDL,
    "detail": "string",
    "pii_category": "string",
    "span": "struct<start:int,end:int>",
    "score": "double",
    "rec_ord": "bigint",
    "issue_ord": ORDER_DDL,
}
ISSUE_DDL = "struct<" + ",".join(f"{n}:{t}" for n, t in ISSUE_TYPES.items()) + ">"
ISSUE_SCHEMA = ",".join(f"{n} {t}" for n, t in ISSUE_TYPES.items())


def order_key(stage: int, rec_ord, a=0, b=0) -> Column:
    def as_long(value):
        column = value if isinstance(value, Column) else F.lit(value)
        return column.cast("bigint")

    return F.struct(
        F.lit(stage).alias("stage"),
        as_long(rec_ord).alias("rec_ord"),
        as_long(a).alias("a"),
        as_long(b).alias("b"),
    )


def issue(category: str | Column, issue_ord: Column, **values: Column) -> Column:
    """One issue as a struct column; parts not given are null."""
    category = category if isinstance(category, Column) else F.lit(category)
    values = {"category": category, "issue_ord": issue_ord, **values}
    return F.struct(
        *[
            values.get(name, F.lit(None)).cast(ddl).alias(name)
            for name, ddl in ISSUE_TYPES.items()
        ]
    )


def explode_issues(df: DataFrame, issues: Column) -> DataFrame:
    """One row per non-null issue of an array column, in one pass over ``df``.

    ``explode`` would filter on the array's size first and so compute it twice.
    """
    exploded = df.select(F.explode_outer(issues).alias("issue"))
    return exploded.filter("issue is not null").select("issue.*")


def literal_issues(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """Issues known on the driver, such as rejected settings."""
    schema = T.StructType.fromDDL(ISSUE_SCHEMA)
    return spark.createDataFrame(
        [tuple(row.get(name) for name in ISSUE_TYPES) for row in rows], schema
    )


def category_dimension(spark: SparkSession) -> DataFrame:
    """All thirteen categories with their report position."""
    return spark.createDataFrame(
        list(enumerate(fixed.ISSUE_CATEGORIES)), "category_ord int, category string"
    )


def category_position(category: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, fixed.ISSUE_CATEGORIES)), category) - 1
