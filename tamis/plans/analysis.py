"""All detectors over one dataset."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamis import fixed
from tamis.config import AnalysisConfig, Schema, checked_threshold
from tamis.dataset import Dataset
from tamis.errors import UnknownCategory
from tamis.functions.text import token_count
from tamis.issues import ISSUE_DDL, explode_issues
from tamis.operators.conformance import conformance_issue_array, resolve_schema
from tamis.operators.duplicates import detect_duplicates, scan_records, similarity_threshold
from tamis.operators.metrics import compute_metrics
from tamis.operators.personal_data import pii_issue_array
from tamis.operators.quality import quality_issue_array
from tamis.operators.toxicity import Model, toxicity_issue_array, toxicity_score
from tamis.staging import stage_table

# An extra detector gets the dataset and the settings and returns issue rows.
Detector = Callable[[Dataset, AnalysisConfig], DataFrame]


@dataclass(frozen=True)
class Analysis:
    dataset: Dataset
    issues: DataFrame
    metrics: DataFrame

    def ordered_issues(self) -> DataFrame:
        return self.issues.orderBy("issue_ord")


def record_issue_array(
    dataset: Dataset, config: AnalysisConfig, score: Column, schema: Schema | None, conforming: Column
) -> Column:
    """All per-record issues (including schema conformance) of a record, some of them null."""
    threshold, rejected = checked_threshold(
        "toxicity_threshold", config.toxicity_threshold, fixed.DEFAULT_TOXICITY_THRESHOLD
    )
    arrays = [
        pii_issue_array(dataset),
        toxicity_issue_array(score, threshold, rejected),
        quality_issue_array(dataset, config.quality),
    ]
    if schema is not None:
        none = F.array().cast(f"array<{ISSUE_DDL}>")
        arrays.append(
            F.when(conforming, conformance_issue_array(dataset, schema)).otherwise(none)
        )
    return F.concat(*arrays)


def analyze(
    dataset: Dataset,
    config: AnalysisConfig | None = None,
    model: Model | None = None,
    extra_detectors: Sequence[Detector] = (),
    parse_issues: DataFrame | None = None,
    keep: bool = True,
) -> Analysis:
    """Run every detector and compute metrics.

    Records are scanned once: content keys, signatures for the similarity join, token counts and
    per-record issues are staged and read by everything else. Texts are read again only to compare
    candidates of near duplicates. The issues, far smaller, are read by metrics, counts and reports,
    so with ``keep`` they are staged too. An extra detector may only use the known categories;
    another one raises UnknownCategory.
    """
    config = config or AnalysisConfig()
    schema, conforming, failure = resolve_schema(dataset, config.schema)
    scored = replace(dataset, df=dataset.df.withColumn("_score", toxicity_score(dataset, model)))
    scan = scan_records(
        scored,
        similarity_threshold(config.similarity_threshold)[0],
        tokens=token_count(dataset.content.text()),
        found=record_issue_array(dataset, config, F.col("_score"), schema, conforming),
    )
    found = [
        parse_issues if parse_issues is not None else dataset.parse_issues,
        detect_duplicates(dataset, config.similarity_threshold, scan),
        explode_issues(scan, F.col("found")),
        failure,
        *[detector(dataset, config) for detector in extra_detectors],
    ]
    streams = [issues for issues in found if issues is not None]
    issues = streams[0]
    for more in streams[1:]:
        issues = issues.unionByName(more)
    issues = stage_table(issues, "issues") if keep else issues
    if extra_detectors:
        known = F.col("category").isin(*fixed.ISSUE_CATEGORIES)
        other = issues.filter(~F.coalesce(known, F.lit(False))).select("category").first()
        if other is not None:
            raise UnknownCategory(other.category)
    return Analysis(dataset, issues, compute_metrics(dataset, issues, scan))
