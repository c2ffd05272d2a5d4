"""Personal data issues and redaction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamis import fixed
from tamis.dataset import Dataset
from tamis.functions.pii import pii_spans, redact
from tamis.issues import ISSUE_DDL, PER_RECORD, explode_issues, issue, order_key

STEP = 0
_FIELD_SHIFT = 32  # field position above the span start in the order key


def pii_issue_array(dataset: Dataset) -> Column:
    """One issue per span of every top-level string field."""

    def field_issues(pos: Column, name: Column, value: Column) -> Column:
        return F.transform(
            F.coalesce(pii_spans(value), F.array()),
            lambda span: issue(
                "pii",
                order_key(
                    PER_RECORD,
                    F.col("rec_ord"),
                    STEP,
                    F.shiftleft(pos.cast("bigint"), _FIELD_SHIFT) + span["start"],
                ),
                loc=F.col("loc"),
                field_name=name,
                detail=F.format_string(fixed.DETAIL_PII, span["category"], name),
                pii_category=span["category"],
                span=F.struct(span["start"].alias("start"), span["end"].alias("end")),
                rec_ord=F.col("rec_ord"),
            ),
        )

    found = dataset.content.map_strings(field_issues)
    return F.array().cast(f"array<{ISSUE_DDL}>") if found is None else found


def detect_pii(dataset: Dataset) -> DataFrame:
    return explode_issues(dataset.df, pii_issue_array(dataset))


def redact_records(dataset: Dataset) -> Dataset:
    """The same records with every span replaced by its ``[CATEGORY]`` mark."""
    return dataset.redacted(redact)
