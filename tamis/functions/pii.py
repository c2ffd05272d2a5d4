"""Personal data spans, native: one pass per pattern, only where a cheap test passes."""

from __future__ import annotations

import sys
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from tamis import fixed

SPAN_DDL = "struct<start:int,end:int,category:string>"
_FOUND_DDL = "array<struct<start:int,neg_length:int,rank:int,category:string>>"

# Every decimal digit outside ASCII and the ASCII digit of the same value.
_OTHER_DIGITS = [
    c for c in map(chr, range(128, sys.maxunicode + 1)) if unicodedata.category(c) == "Nd"
]
_OTHER_VALUES = [str(unicodedata.decimal(c)) for c in _OTHER_DIGITS]


def luhn_valid(number: Column) -> Column:
    """Luhn check of a digit string, whatever script its digits are in."""
    ascii_digits = F.translate(number, "".join(_OTHER_DIGITS), "".join(_OTHER_VALUES))
    return F.coalesce(F.call_function("luhn_check", ascii_digits), F.lit(False))


def _maybe(text: Column, category: str) -> Column:
    """A cheap necessary condition for a match of ``category``."""
    if category == "email":
        return F.contains(text, F.lit("@"))
    if category == "physical_address":
        found = F.lit(False)
        for suffix in fixed.STREET_SUFFIXES:
            found = found | F.contains(text, F.lit(suffix))
        return found
    if category == "credit_card":
        return text.rlike(r"\p{Nd}{13}")
    return text.rlike(r"\p{Nd}-\p{Nd}{2,3}-\p{Nd}")


def _located(text: Column, category: str, rank: int) -> Column:
    """Matches of one pattern with their offsets.

    The pieces between matches and the matches themselves alternate, so running
    sums of their lengths give code point offsets.
    """
    pattern = fixed.PII_PATTERNS[category]
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(matches))
    steps = F.arrays_zip(gaps.alias("gap"), matches.alias("hit"))

    def advance(acc: Column, step: Column) -> Column:
        start = acc["at"] + F.length(step["gap"])
        size = F.length(step["hit"])
        one = F.struct(
            start.alias("start"),
            (-size).alias("neg_length"),
            F.lit(rank).alias("rank"),
            F.lit(category).alias("category"),
        )
        found = F.array(one)
        if category == "credit_card":
            found = F.when(luhn_valid(step["hit"]), found).otherwise(F.array().cast(_FOUND_DDL))
        return F.struct(
            (start + size).alias("at"),
            F.concat(acc["found"], found.cast(_FOUND_DDL)).alias("found"),
        )

    start = F.struct(F.lit(0).alias("at"), F.array().cast(_FOUND_DDL).alias("found"))
    return F.aggregate(steps, start, advance, lambda acc: acc["found"])


def pii_spans(text: Column) -> Column:
    """Array of non-overlapping ``(start, end, category)``, sorted by start.

    Of overlapping candidates the one that starts first wins, then the longer
    one, then the earlier pattern. Text without candidates costs five cheap tests.
    """
    none = F.array().cast(_FOUND_DDL)
    candidates = F.concat(
        *[
            F.when(_maybe(text, category), _located(text, category, rank)).otherwise(none)
            for rank, category in enumerate(fixed.PII_PATTERNS)
        ]
    )

    def keep_free(acc: Column, c: Column) -> Column:
        end = c["start"] - c["neg_length"]
        span = F.struct(c["start"].alias("start"), end.alias("end"), c["category"].alias("category"))
        return F.when(
            c["start"] >= acc["until"],
            F.struct(
                end.alias("until"), F.concat(acc["spans"], F.array(span)).alias("spans")
            ),
        ).otherwise(acc)

    start = F.struct(
        F.lit(0).alias("until"), F.array().cast(f"array<{SPAN_DDL}>").alias("spans")
    )
    any_candidate = F.lit(False)
    for category in fixed.PII_PATTERNS:
        any_candidate = any_candidate | _maybe(text, category)
    return F.when(
        any_candidate,
        F.aggregate(F.array_sort(candidates), start, keep_free, lambda acc: acc["spans"]),
    ).otherwise(F.array().cast(f"array<{SPAN_DDL}>"))


def redact(text: Column) -> Column:
    """``text`` with each span replaced by its category in brackets."""
    spans = pii_spans(text)
    start = F.struct(
        F.lit(0).alias("at"), F.array().cast("array<string>").alias("pieces")
    )

    def replace_span(acc: Column, span: Column) -> Column:
        kept = F.substr(text, acc["at"] + 1, span["start"] - acc["at"])
        mark = F.concat(F.lit("["), F.upper(span["category"]), F.lit("]"))
        return F.struct(
            span["end"].alias("at"), F.concat(acc["pieces"], F.array(kept, mark)).alias("pieces")
        )

    def finish(acc: Column) -> Column:
        return F.concat(F.array_join(acc["pieces"], ""), F.substr(text, acc["at"] + 1))

    return F.when(F.size(spans) == 0, text).otherwise(
        F.aggregate(spans, start, replace_span, finish)
    )
