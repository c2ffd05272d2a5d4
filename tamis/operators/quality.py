"""Too short, gibberish and empty records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamis import fixed
from tamis.config import QualityConfig
from tamis.dataset import Dataset
from tamis.functions import text as tx
from tamis.issues import PER_RECORD, explode_issues, issue, order_key

STEP = 2  # after personal data and toxicity in the per-record order


def is_empty(dataset: Dataset, config: QualityConfig) -> Column:
    """All required fields blank; an absent field is blank."""
    if config.required_fields is None:
        return dataset.content.all_blank()
    empty = F.lit(True)
    for name in config.required_fields:
        empty = empty & dataset.content.blank(name)
    return empty


def quality_issue_array(dataset: Dataset, config: QualityConfig) -> Column:
    """Array with one slot per check, null where the check passes."""
    text = dataset.content.text()
    tokens, ratio = tx.token_count(text), tx.non_alnum_ratio(text)

    def one(category: str, slot: int, detail: Column, score: Column | None = None) -> Column:
        return issue(
            category,
            order_key(PER_RECORD, F.col("rec_ord"), STEP, slot),
            loc=F.col("loc"),
            detail=detail,
            rec_ord=F.col("rec_ord"),
            **({} if score is None else {"score": score}),
        )

    short = one(
        "low_quality_short",
        0,
        F.format_string(fixed.DETAIL_SHORT, tokens, F.lit(config.min_tokens)),
        tokens.cast("double"),
    )
    gibberish = one(
        "low_quality_gibberish",
        1,
        F.format_string(
            fixed.DETAIL_GIBBERISH,
            tx.three_decimals(ratio),
            F.lit(str(config.gibberish_threshold)),
        ),
        ratio,
    )
    empty = one("empty_record", 2, F.lit(fixed.DETAIL_EMPTY))
    return F.array(
        F.when(tokens < config.min_tokens, short),
        F.when(ratio >= config.gibberish_threshold, gibberish),
        F.when(is_empty(dataset, config), empty),
    )


def detect_quality(dataset: Dataset, config: QualityConfig | None = None) -> DataFrame:
    return explode_issues(dataset.df, quality_issue_array(dataset, config or QualityConfig()))
