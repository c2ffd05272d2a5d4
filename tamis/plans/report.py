"""The report: metrics, totals, category counts and issues, as ordered lines.

A report is a DataFrame of lines with sort keys. It is written by many tasks as
part files whose names sort in document order, so no task ever holds all issues.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamis import fixed
from tamis.errors import ReportFailed, UnsupportedFormat
from tamis.issues import ORDER_DDL, category_position
from tamis.operators.metrics import category_counts
from tamis.plans.analysis import Analysis
from tamis.sinks.files import write_lines

_ISSUE_FIELDS = ("category", "location", "field_name", "related_location", "detail",
                 "pii_category", "span", "score")


@dataclass(frozen=True)
class Report:
    metrics: DataFrame  # one row
    counts: DataFrame  # thirteen rows
    issues: DataFrame

    def totals(self) -> DataFrame:
        """One row: total records and total issues."""
        records = self.metrics.select(F.col("record_count").alias("total_records"))
        issues = self.counts.agg(F.sum("n_issues").alias("total_issues"))
        both = records.unionByName(issues, allowMissingColumns=True)
        return both.agg(*[F.max(c).alias(c) for c in both.columns])  # two rows into one


def build_report(analysis: Analysis) -> Report:
    return Report(analysis.metrics, category_counts(analysis.issues), analysis.issues)


def report_format(requested: object) -> str:
    """``json`` or ``markdown``, whatever the letter case."""
    if isinstance(requested, str) and requested.lower() in fixed.REPORT_FORMATS:
        return requested.lower()
    raise UnsupportedFormat(requested)


def issue_json(relative_names: bool = False) -> Column:
    """One issue row as a JSON object; absent parts are null.

    ``relative_names`` cuts source files to their base name.
    """
    def location(name: str) -> Column:
        loc = F.col(name)
        if not relative_names:
            return loc
        base = F.element_at(F.split(loc["source_file"], "/"), -1)
        return F.when(loc.isNotNull(), loc.withField("source_file", base))

    values = {"location": location("loc"), "related_location": location("related_loc")}
    return F.to_json(
        F.struct(*[values.get(n, F.col(n)).alias(n) for n in _ISSUE_FIELDS]),
        {"ignoreNullFields": "false"},
    )


def _text_of(value: object) -> str:
    return repr(value) if isinstance(value, float) else str(value)


def _head_lines(report: Report, fmt: str) -> list[tuple[int, int, str]]:
    """Lines that depend on counts only: ``(category or -1, place, line)``."""
    metrics = report.metrics.first().asDict()
    counts = {r.category: r.n_issues for r in report.counts.collect()}
    bad = [n for n in fixed.METRIC_NAMES if not math.isfinite(metrics[n])]
    total = sum(counts.values())
    categories = list(enumerate(fixed.ISSUE_CATEGORIES))
    if fmt == "markdown":
        lines = [fixed.MD_TITLE, "", fixed.MD_SUMMARY,
                 f"- Total records: {metrics['record_count']}", f"- Total issues: {total}", "",
                 fixed.MD_METRICS]
        lines += [f"- {n}: {_text_of(metrics[n])}" for n in fixed.METRIC_NAMES]
        lines += ["", fixed.MD_CATEGORIES]
        placed = [(-1, i, line) for i, line in enumerate(lines)]
        for i, name in categories:
            placed.append((i, 0, f"### {name} (count: {counts[name]})"))
            if counts[name] == 0:
                placed.append((i, 1, fixed.MD_NO_ISSUES))
            if i < len(categories) - 1:
                placed.append((i, 3, ""))
        return placed
    if bad:
        raise ReportFailed(fmt, f"metric {bad[0]} is not a finite number")
    lines = ["{", '"metrics": {']
    lines += [f'"{n}": {_text_of(metrics[n])}' + ("," if n != fixed.METRIC_NAMES[-1] else "")
              for n in fixed.METRIC_NAMES]
    lines += ["},", f'"summary": {{"total_records": {metrics["record_count"]}, '
              f'"total_issues": {total}}},', '"issues_by_category": {']
    placed = [(-1, i, line) for i, line in enumerate(lines)]
    for i, name in categories:
        placed.append((i, 0, f'"{name}": {{"count": {counts[name]}, "issues": ['))
        placed.append((i, 3, "]}," if i < len(categories) - 1 else "]}}}"))
    return placed


def report_lines(report: Report, fmt: str) -> DataFrame:
    """``category_ord, place, issue_ord, line``: the document in sort order."""
    fmt = report_format(fmt)
    head = report.issues.sparkSession.createDataFrame(
        _head_lines(report, fmt), "category_ord int, place int, line string"
    ).select("category_ord", "place", F.lit(None).cast(ORDER_DDL).alias("issue_ord"), "line")
    issues = report.issues.withColumn(
        "category_ord", category_position(F.col("category")).cast("int")
    )
    if fmt == "markdown":
        line = F.concat(
            F.lit("- "), F.coalesce(F.nullif("detail", F.lit("")), F.lit(fixed.MD_NO_DETAIL))
        )
    else:
        first = issues.groupBy("category_ord").agg(F.min("issue_ord").alias("first"))
        issues = issues.join(F.broadcast(first), "category_ord")
        line = F.concat(
            F.when(F.col("issue_ord") == F.col("first"), F.lit("")).otherwise(F.lit(",")),
            issue_json(),
        )
    body = issues.select("category_ord", F.lit(2).alias("place"), "issue_ord", line.alias("line"))
    return head.unionByName(body)


def write_report(report: Report, fmt: str, path: str) -> None:
    """Write the report to the folder ``path``; nothing is written on an error."""
    fmt = report_format(fmt)
    extension = "md" if fmt == "markdown" else "json"
    write_lines(
        report_lines(report, fmt), ["category_ord", "place", "issue_ord"], path, extension
    )
