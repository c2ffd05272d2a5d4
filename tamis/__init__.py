"""Quality inspection of text training data as Spark jobs."""

import sys

from pyspark import cloudpickle

# Python workers need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

from tamis.config import AnalysisConfig, FieldSpec, QualityConfig, Schema  # noqa: E402
from tamis.dataset import Dataset, records_from_table  # noqa: E402
from tamis.operators.conformance import infer_schema, validate_schema  # noqa: E402
from tamis.operators.duplicates import detect_duplicates  # noqa: E402
from tamis.operators.equivalence import equivalent  # noqa: E402
from tamis.operators.metrics import category_counts, compute_metrics  # noqa: E402
from tamis.operators.personal_data import detect_pii, redact_records  # noqa: E402
from tamis.operators.quality import detect_quality  # noqa: E402
from tamis.operators.toxicity import StubModel, detect_toxicity  # noqa: E402
from tamis.plans.analysis import Analysis, analyze  # noqa: E402
from tamis.plans.path import analyze_path  # noqa: E402
from tamis.plans.report import build_report, write_report  # noqa: E402
from tamis.sinks.exports import export_records  # noqa: E402
from tamis.sources.ingest import read_records  # noqa: E402
from tamis.sources.tables import read_table  # noqa: E402

__all__ = [
    "Analysis", "AnalysisConfig", "Dataset", "FieldSpec", "QualityConfig", "Schema", "StubModel",
    "analyze", "analyze_path", "build_report", "category_counts", "compute_metrics", "detect_duplicates",
    "detect_pii", "detect_quality", "detect_toxicity", "equivalent", "export_records",
    "infer_schema", "read_records", "read_table", "records_from_table", "redact_records",
    "validate_schema", "write_report",
]
