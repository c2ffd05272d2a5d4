"""Settings, their validation, and declared schemas. Driver side only."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, replace
from numbers import Real
from typing import Any

from tamis import fixed
from tamis.errors import InvalidSchema


@dataclass(frozen=True)
class Rejected:
    """One rejected setting: its name, the bad value and the value kept instead."""

    parameter: str
    value: Any
    kept: Any

    @property
    def detail(self) -> str:
        return fixed.DETAIL_CONFIG.format(self.parameter, self.value, self.kept)


def _is_number(value: Any) -> bool:
    return isinstance(value, (int, float)) and not isinstance(value, bool)


def _in_unit_range(value: Any) -> bool:
    return _is_number(value) and 0.0 <= value <= 1.0  # NaN compares false


def checked_threshold(name: str, value: Any, default: float) -> tuple[float, Rejected | None]:
    """A threshold in [0, 1], or ``default`` plus the rejection."""
    if _in_unit_range(value):
        return float(value), None
    return default, Rejected(name, value, default)


@dataclass(frozen=True)
class QualityConfig:
    """Thresholds of the quality checks. ``required_fields=None`` means all fields."""

    min_tokens: int = fixed.DEFAULT_MIN_TOKENS
    gibberish_threshold: float = fixed.DEFAULT_GIBBERISH_THRESHOLD
    required_fields: tuple[str, ...] | None = None

    def updated(
        self,
        min_tokens: Any = fixed.DEFAULT_MIN_TOKENS,
        gibberish_threshold: Any = fixed.DEFAULT_GIBBERISH_THRESHOLD,
        required_fields: tuple[str, ...] | None = None,
    ) -> tuple["QualityConfig", list[Rejected]]:
        """This config with new values; a value out of range keeps the present one."""
        changes: dict[str, Any] = {}
        rejected = []
        low, high = fixed.MIN_TOKENS_BOUNDS
        if isinstance(min_tokens, int) and _is_number(min_tokens) and low <= min_tokens <= high:
            changes["min_tokens"] = min_tokens
        else:
            rejected.append(Rejected("min_token_threshold", min_tokens, self.min_tokens))
        if _in_unit_range(gibberish_threshold):
            changes["gibberish_threshold"] = float(gibberish_threshold)
        else:
            rejected.append(
                Rejected("gibberish_threshold", gibberish_threshold, self.gibberish_threshold)
            )
        if required_fields is not None:
            changes["required_fields"] = tuple(required_fields)
        return replace(self, **changes), rejected


@dataclass(frozen=True)
class FieldSpec:
    name: str
    type: str
    required: bool = False

    def __post_init__(self):
        if self.type not in fixed.FIELD_TYPES:
            raise InvalidSchema(f"unknown field type {self.type!r}")


@dataclass(frozen=True)
class Schema:
    fields: tuple[FieldSpec, ...]
    inferred: bool = False

    @classmethod
    def of(cls, *specs: tuple) -> "Schema":
        """``Schema.of(("id", "integer", True), ("note", "string"))``"""
        return cls(tuple(FieldSpec(*spec) for spec in specs))

    @classmethod
    def from_json(cls, text: str) -> "Schema":
        """Read ``{"fields": [{"name", "type", "required"?}]}``."""
        try:
            specs = json.loads(text).get("fields", [])
            return cls(
                tuple(FieldSpec(s["name"], s["type"], s.get("required", False)) for s in specs)
            )
        except InvalidSchema:
            raise
        except Exception as exc:
            raise InvalidSchema(str(exc)) from exc


@dataclass(frozen=True)
class AnalysisConfig:
    similarity_threshold: Any = fixed.DEFAULT_SIMILARITY_THRESHOLD
    toxicity_threshold: Any = fixed.DEFAULT_TOXICITY_THRESHOLD
    quality: QualityConfig = field(default_factory=QualityConfig)
    schema: Schema | None = None


def effective_file_limit(configured: Real | None) -> int | None:
    """The file size limit in force: the configured one, else none."""
    return None if configured is None else max(int(configured), 0)
