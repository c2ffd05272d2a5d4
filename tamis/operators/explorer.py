"""Search, filter, page and annotate records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamis import fixed
from tamis.dataset import Dataset
from tamis.functions.pii import redact
from tamis.issues import category_position
from tamis.operators.numbering import record_positions


def search(dataset: Dataset, query: str) -> Dataset:
    """Records with a field whose text contains the trimmed query, ignoring case."""
    wanted = query.lower().strip()
    if not wanted:
        return dataset
    hit = F.exists(
        dataset.content.display(),
        lambda f: F.coalesce(F.contains(F.lower(f["text"]), F.lit(wanted)), F.lit(False)),
    )
    return _with(dataset, dataset.df.filter(hit))


def filter_by_issues(dataset: Dataset, issues: DataFrame, which: str) -> Dataset:
    """``all``, ``issues``, ``clean``, or the records with one issue category."""
    located = issues.filter("loc is not null and rec_ord is not null")
    if which == "all":
        return dataset
    if which not in ("issues", "clean"):
        located = located.filter(F.col("category") == which)
    how = "left_anti" if which == "clean" else "left_semi"
    return _with(dataset, dataset.df.join(located.select("rec_ord").distinct(), "rec_ord", how))


def _with(dataset: Dataset, df: DataFrame) -> Dataset:
    return Dataset(
        df,
        dataset.content,
        dataset.source_files,
        dataset.skipped_files,
        dataset.oversize_files,
        dataset.parse_issues,
    )


def page(dataset: Dataset, number: int = 1, size: int = fixed.PAGE_SIZE) -> DataFrame:
    """One page of records in order; pages count from 1.

    The page is a range of positions, so a late page costs no more than an early one.
    """
    first = size * (number - 1)
    wanted = (
        record_positions(dataset.df.select("rec_ord"))
        .filter(F.col("rec_idx").between(first, first + size - 1))
        .select("rec_ord")
    )
    return dataset.df.join(F.broadcast(wanted), "rec_ord", "left_semi").orderBy("rec_ord")


def page_count(dataset: Dataset, size: int = fixed.PAGE_SIZE) -> DataFrame:
    return dataset.df.agg(F.ceil(F.count(F.lit(1)) / size).cast("bigint").alias("pages"))


def preview(dataset: Dataset) -> Column:
    """First string field, or the fields as JSON, cut to 80 characters."""
    strings = F.filter(
        dataset.content.display(),
        lambda f: (f["type"] == "string") & f["text"].isNotNull(),
    )
    text = F.coalesce(F.try_element_at(strings, F.lit(1))["text"], dataset.content.fields_json())
    return F.when(
        F.length(text) > fixed.PREVIEW_CHARS,
        F.concat(F.substring(text, 1, fixed.PREVIEW_CHARS), F.lit("...")),
    ).otherwise(text)


def location_label(loc: Column, rec_idx: Column) -> Column:
    return (
        F.when(loc["line_number"].isNotNull(), F.format_string("Line %d", loc["line_number"]))
        .when(loc["array_index"].isNotNull(), F.format_string("Index %d", loc["array_index"]))
        .when(
            loc["row_index"].isNotNull(),
            F.format_string("Group %d, Row %d", loc["row_group"], loc["row_index"]),
        )
        .otherwise(F.format_string("Row %d", rec_idx + 1))
    )


def record_categories(issues: DataFrame) -> DataFrame:
    """Distinct issue categories of each record, in report order."""
    pairs = issues.filter("loc is not null and rec_ord is not null").select(
        "rec_ord", F.struct(category_position(F.col("category")).alias("o"), "category").alias("c")
    )
    return (
        pairs.groupBy("rec_ord")
        .agg(F.array_sort(F.collect_set("c")).alias("c"))
        .select("rec_ord", F.col("c.category").alias("categories"))
    )


def record_issues(issues: DataFrame) -> DataFrame:
    """The issues that point to a record, as rows keyed by ``rec_ord``; ``issue_ord`` orders them."""
    return issues.filter("loc is not null and rec_ord is not null")


def annotate(dataset: Dataset, issues: DataFrame) -> DataFrame:
    """Every record, one row each: position, number and categories of its issues, redacted fields.

    ``redacted`` is null unless the record has personal data. The issues stay rows of their own
    (``record_issues``), since a near-duplicate of very many others has as many of them.
    """
    summary = (
        record_issues(issues)
        .groupBy("rec_ord")
        .agg(
            F.count(F.lit(1)).alias("n_issues"),
            F.collect_set("category").alias("found"),
            F.max(F.col("category") == "pii").alias("has_pii"),
        )
    )
    ordered = F.filter(
        F.array(*map(F.lit, fixed.ISSUE_CATEGORIES)),
        lambda c: F.coalesce(F.array_contains("found", c), F.lit(False)),
    )
    positions = record_positions(dataset.df.select("rec_ord"))
    found = dataset.df.join(positions, "rec_ord").join(summary, "rec_ord", "left")
    return found.select(
        F.col("rec_idx").alias("index"),
        "rec_ord",
        "loc",
        *dataset.content.columns,
        F.when(F.col("has_pii"), dataset.content.redacted_struct(redact)).alias("redacted"),
        F.coalesce("n_issues", F.lit(0)).alias("n_issues"),
        ordered.alias("categories"),
    )


def display_spans(spans: Column) -> Column:
    """Spans to highlight: from the right, dropping any that overlap a kept one."""
    backwards = F.reverse(F.array_sort(spans))
    start = F.struct(
        F.lit(2**31 - 1).alias("limit"), F.array().cast("array<struct<start:int,end:int>>").alias("kept")
    )

    def keep(acc: Column, span: Column) -> Column:
        one = F.struct(span["start"].alias("start"), span["end"].alias("end"))
        return F.when(
            span["end"] <= acc["limit"],
            F.struct(span["start"].alias("limit"), F.concat(acc["kept"], F.array(one)).alias("kept")),
        ).otherwise(acc)

    return F.aggregate(backwards, start, keep, lambda acc: acc["kept"])
