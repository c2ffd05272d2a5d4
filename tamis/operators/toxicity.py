"""Toxicity flags from a pluggable scoring model.

A model is a function from a text column to a score column, or an object with
``score(text) -> float | None`` or ``score_batch(texts)``, which runs in Arrow batches. A score that is
null, not a number or not finite leaves the record unscored.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamis import fixed
from tamis.config import Rejected, checked_threshold
from tamis.dataset import Dataset
from tamis.functions.text import three_decimals
from tamis.issues import PER_RECORD, explode_issues, issue, order_key

STEP = 1
Model = Callable[[Column], Column] | Any


class StubModel:
    """A model without a model: one score for every text, a Column of the text, or no score at all."""

    def __init__(
        self, score: float = 0.0, expression: Callable[[Column], Column] | None = None, unscored: bool = False
    ):
        fixed_score = F.lit(None if unscored else score).cast("double")
        self._of = (lambda text: fixed_score) if expression is None or unscored else expression

    def __call__(self, text: Column) -> Column:
        return self._of(text)


def _python_scores(model: Any):
    """The model's raw scores, null where it fails on a text or gives no number."""

    def one(text: str):
        try:
            return model.score(text)
        except Exception:  # a failing record must not fail the job
            return None

    def batch(texts: list[str]) -> list:
        if hasattr(model, "score_batch"):
            try:
                return list(model.score_batch(texts))
            except Exception:  # then each text by itself, where that is possible
                if not hasattr(model, "score"):
                    return [None] * len(texts)
        return [one(t) for t in texts]

    @F.arrow_udf("double")
    def scores(texts: pa.Array) -> pa.Array:
        raw = batch(texts.to_pylist())
        numbers = [v if isinstance(v, (int, float)) and not isinstance(v, bool) else None for v in raw]
        return pa.array(numbers, pa.float64())

    return scores.asNondeterministic()  # so that the model runs once per record


def toxicity_score(dataset: Dataset, model: Model | None = None) -> Column:
    """Score in [0, 1] of the record's string fields; null when unscored."""
    model = StubModel() if model is None else model
    text = dataset.content.string_text()
    in_python = hasattr(model, "score") or hasattr(model, "score_batch")
    raw = (_python_scores(model) if in_python else model)(text).cast("double")

    def usable(value: Column) -> Column:
        finite = value.isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf"))
        return F.when(finite, F.greatest(F.lit(0.0), F.least(F.lit(1.0), value)))

    # By way of an array, so that a model's expression stands in the plan once.
    return F.get(F.transform(F.array(raw), usable), F.lit(0))


def toxicity_issue_array(score: Column, threshold: float, rejected: Rejected | None) -> Column:
    def one(category: str, slot: int, **values: Column) -> Column:
        return issue(category, order_key(PER_RECORD, F.col("rec_ord"), STEP, slot), **values)

    failed = one(
        "analysis_failure",
        1,
        loc=F.col("loc"),
        detail=F.lit(fixed.DETAIL_UNSCORED),
        rec_ord=F.col("rec_ord"),
    )
    toxic = one(
        "toxicity",
        1,
        loc=F.col("loc"),
        score=score,
        detail=F.format_string(
            fixed.DETAIL_TOXICITY, three_decimals(score), F.lit(f"{threshold:.3f}")
        ),
        rec_ord=F.col("rec_ord"),
    )
    slots = [F.when(score.isNull(), failed).when(score >= threshold, toxic)]
    if rejected:  # reported once per record, because each record is checked on its own
        slots.insert(
            0,
            one(
                "config_error",
                0,
                field_name=F.lit(rejected.parameter),
                detail=F.lit(rejected.detail),
            ),
        )
    return F.array(*slots)


def detect_toxicity(
    dataset: Dataset,
    model: Model | None = None,
    threshold: Any = fixed.DEFAULT_TOXICITY_THRESHOLD,
) -> DataFrame:
    effective, rejected = checked_threshold(
        "toxicity_threshold", threshold, fixed.DEFAULT_TOXICITY_THRESHOLD
    )
    scored = dataset.df.withColumn("_score", toxicity_score(dataset, model))
    return explode_issues(scored, toxicity_issue_array(F.col("_score"), effective, rejected))
