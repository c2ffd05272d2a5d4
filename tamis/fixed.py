"""Every constant whose exact value is part of a result.

Category names, default thresholds, bounds, regular expressions and message
templates live here together, as plain text, so that results can be compared
value by value. Nothing in this module computes anything.
"""

# Issue categories. The order is the report order.
ISSUE_CATEGORIES = (
    "parse_error",
    "duplicate",
    "near_duplicate",
    "pii",
    "toxicity",
    "low_quality_short",
    "low_quality_gibberish",
    "empty_record",
    "missing_required_field",
    "field_type_mismatch",
    "schema_inference_failed",
    "analysis_failure",
    "config_error",
)

# Canonical field types.
FIELD_TYPES = ("string", "integer", "float", "boolean", "null", "list", "object")

# File extensions and the format each one stands for.
EXTENSION_FORMATS = {".json": "json", ".jsonl": "jsonl", ".csv": "csv", ".parquet": "parquet"}

# Report formats.
REPORT_FORMATS = ("json", "markdown")

# Detector defaults and bounds.
DEFAULT_SIMILARITY_THRESHOLD = 0.9
DEFAULT_TOXICITY_THRESHOLD = 0.8
DEFAULT_MIN_TOKENS = 3
DEFAULT_GIBBERISH_THRESHOLD = 0.5
MIN_TOKENS_BOUNDS = (1, 1_000_000)

# Explorer: records per page and preview length in characters.
PAGE_SIZE = 12
PREVIEW_CHARS = 80

# Character classes in Java regex syntax. WHITESPACE is what a Unicode-aware
# "\s" accepts, WORD_CHAR what a Unicode-aware "\w" accepts.
WHITESPACE = r"[\s\x1c-\x1f\x85\p{Z}]"
NON_WHITESPACE = r"[^\s\x1c-\x1f\x85\p{Z}]"
WORD_CHAR = r"[\p{L}\p{N}_]"
ALPHANUMERIC = r"[\p{L}\p{N}]"
WORD_START = r"(?<![\p{L}\p{N}_])"
WORD_END = r"(?![\p{L}\p{N}_])"

# Personal data categories and patterns; on equal spans the earlier one wins.
# The e-mail pattern may only start at the left edge of a run of local-part
# characters (or right after the previous match), which finds the same matches
# as an unanchored one without rescanning long runs.
STREET_SUFFIXES = ("Street", "Avenue", "Road", "Boulevard", "Lane", "Drive")
PII_PATTERNS = {
    "email": (
        r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++"
        r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"
    ),
    "government_id": WORD_START + r"\p{Nd}{3}-\p{Nd}{2}-\p{Nd}{4}" + WORD_END,
    "phone": WORD_START + r"\p{Nd}{3}-\p{Nd}{3}-\p{Nd}{4}" + WORD_END,
    "physical_address": (
        WORD_START + r"\p{Nd}{1,6}" + WHITESPACE + r"+[A-Z][a-zA-Z]*" + WHITESPACE + r"+"
        r"(?:Street|Avenue|Road|Boulevard|Lane|Drive)" + WORD_END
    ),
    "credit_card": WORD_START + r"\p{Nd}{13,19}" + WORD_END,
}

# Message templates, in printf syntax.
DETAIL_DUPLICATE = "Record at index %d is byte-for-byte identical to the record at index %d"
DETAIL_NEAR_DUPLICATE = (
    "Record at index %d is a near-duplicate of the record at index %d "
    "(similarity %s >= threshold %s)"
)
DETAIL_PII = "%s detected in field '%s'"
DETAIL_TOXICITY = "Toxicity score %s >= threshold %s"
DETAIL_UNSCORED = "Toxicity scoring failed; record left unscored"
DETAIL_SHORT = (
    "Record has %d whitespace-delimited token(s), fewer than the minimum threshold of %d"
)
DETAIL_GIBBERISH = (
    "Non-alphanumeric proportion %s meets or exceeds the gibberish threshold of %s"
)
DETAIL_EMPTY = "Every required field is zero-length or whitespace-only"
DETAIL_MISSING = "Required field '%s' is %s"
DETAIL_MISMATCH = "Field '%s' has type %s, expected %s"
DETAIL_NO_RECORDS = "Schema inference could not be performed: the dataset is empty"
DETAIL_NO_FIELDS = (
    "Schema inference could not be performed: the first record contains no fields"
)
DETAIL_CONFIG = "Invalid configuration for {!r}: {!r}; retaining default {!r}"
DETAIL_JSON_MALFORMED = "Malformed JSON payload: {}"
DETAIL_JSON_NOT_ARRAY = "JSON top-level structure is not an array (found {})"
DETAIL_JSON_NOT_OBJECT = "JSON array element is not an object (found {})"
DETAIL_JSONL_MALFORMED = "Malformed JSON on line {}: {}"
DETAIL_JSONL_NOT_OBJECT = "JSONL line is not an object (found {})"
DETAIL_JSONL_BYTES = "Malformed JSONL payload: {}"
DETAIL_CSV_BYTES = "Malformed CSV payload: {}"
DETAIL_CSV_MALFORMED = "Malformed CSV on line {}: {}"
DETAIL_CSV_NO_HEADER = "CSV file has no header row"
DETAIL_CSV_REPEATED = "CSV header contains duplicate field names: {}"
DETAIL_CSV_WIDTH = "CSV row on line {} has {} fields but the header declares {}"
DETAIL_PARQUET_FILE = "Malformed Parquet file: {}"
DETAIL_PARQUET_GROUP = "Unreadable Parquet row group {}: {}"

# Error messages.
ERROR_PATH = "Path does not exist: {!r}"
ERROR_NO_FILES = "No supported files found in directory: {!r}"
ERROR_SIZE = "File {!r} exceeds the configured size limit of {} bytes (file is {} bytes)"
ERROR_VALUE = "Value of field {!r} in record at index {} cannot be represented in format {!r}"
ERROR_REPORT = "Failed to serialize report to format {!r}: {}"
ERROR_FORMAT = "Unsupported output format: {!r}"

# Markdown report layout.
MD_TITLE = "# Data Quality Report"
MD_SUMMARY = "## Summary"
MD_METRICS = "## Metrics"
MD_CATEGORIES = "## Issues by Category"
MD_NO_ISSUES = "_No issues._"
MD_NO_DETAIL = "(no detail)"
METRIC_NAMES = (
    "record_count",
    "mean_tokens",
    "min_tokens",
    "max_tokens",
    "issue_record_proportion",
    "quality_score",
)
