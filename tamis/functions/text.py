"""Text statistics as native Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tamis import fixed


def token_count(text: Column) -> Column:
    """Number of whitespace-delimited tokens."""
    return F.size(F.filter(F.split(text, fixed.WHITESPACE + "+"), lambda t: t != ""))


def word_set(text: Column) -> Column:
    """Distinct lower-cased word tokens, in order of appearance."""
    return F.array_distinct(
        F.regexp_extract_all(F.lower(text), F.lit(fixed.WORD_CHAR + "+"), F.lit(0))
    )


def jaccard(left: Column, right: Column) -> Column:
    """Similarity of two sets held as arrays without repeats; 0.0 if both are empty."""
    sizes = F.size(left) + F.size(right)
    # One-element transform: names the intersection so that it is computed once.
    scores = F.transform(
        F.array(F.size(F.array_intersect(left, right))),
        lambda shared: F.when(sizes == 0, F.lit(0.0)).otherwise(shared / (sizes - shared)),
    )
    return F.element_at(scores, 1)


def non_alnum_ratio(text: Column) -> Column:
    """Share of characters that are neither letters nor numbers; 0.0 for empty text."""
    total = F.length(text)
    other = F.length(F.regexp_replace(text, fixed.ALPHANUMERIC + "+", ""))
    return F.when(total == 0, F.lit(0.0)).otherwise(other / total)


def is_blank(text: Column) -> Column:
    """Null, empty, or whitespace only."""
    return text.isNull() | ~text.rlike(fixed.NON_WHITESPACE)


def three_decimals(value: Column) -> Column:
    """A value >= 0 with three decimals: the exact binary value, half to even.

    Number formatting in the JVM rounds the shortest decimal form instead, which
    differs for values such as 0.0005. Here ``below`` is the value in thousandths,
    rounded down, and ``over`` the exact sign of what is left minus a half: the
    products of the two parts of the value with 2000 have no rounding error.
    """
    below = F.floor(value * 1000)
    head = value.cast("float").cast("double")
    over = (head * 2000 - (below * 2 + 1)) + (value - head) * 2000
    rounded = (
        F.when(over > 0, below + 1).when(over < 0, below).otherwise(below + F.pmod(below, F.lit(2)))
    )
    whole = F.floor(rounded / 1000).cast("string")
    return F.concat(whole, F.lit("."), F.lpad(F.pmod(rounded, F.lit(1000)).cast("string"), 3, "0"))
