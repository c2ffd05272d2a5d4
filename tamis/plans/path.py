"""From a path to a report and annotated records in one call."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from tamis.config import AnalysisConfig
from tamis.errors import UnsupportedFormat
from tamis.operators.explorer import annotate
from tamis.operators.toxicity import Model
from tamis.plans.analysis import Analysis, analyze
from tamis.plans.report import Report, build_report
from tamis.sources.ingest import read_records


@dataclass(frozen=True)
class PathAnalysis:
    analysis: Analysis
    report: Report
    records: DataFrame  # each record with what its issues are and, if any, its redactions


def analyze_path(
    spark: SparkSession,
    path: str,
    config: AnalysisConfig | None = None,
    model: Model | None = None,
    max_file_bytes: int | None = None,
) -> PathAnalysis:
    """Read, analyze and report a file or folder.

    A single file of an unsupported format is an error; in a folder such files
    are skipped.
    """
    dataset = read_records(spark, path, max_file_bytes)
    if dataset.skipped_files == [path]:
        raise UnsupportedFormat(path)
    analysis = analyze(dataset, config, model)
    return PathAnalysis(
        analysis, build_report(analysis), annotate(dataset, analysis.issues)
    )
