"""Shortest round-trip text of floating point columns."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.arrow_udf(T.StringType())
def _repr_text(values: pa.Array) -> pa.Array:
    return pa.array([None if v is None else repr(v) for v in values.to_pylist()], pa.string())


@F.arrow_udf(T.ArrayType(T.StringType()))
def _repr_texts(arrays: pa.Array) -> pa.Array:
    return pa.array(
        [
            None if array is None else [repr(v) for v in array if v is not None]
            for array in arrays.to_pylist()
        ],
        pa.list_(pa.string()),
    )


def float_text(value: Column) -> Column:
    """Text such as ``0.1``, ``1e-05``, ``1e+16``, ``nan`` or ``-inf``.

    A magnitude from 1e-4 to 1e9 that is an exact six-decimal number has at most
    15 significant digits, so its decimal form is the shortest one and stays in
    the JVM. Only the other values (the rest of the column is sent as null) take
    the Arrow path.
    """
    value = value.cast("double")
    decimal = value.cast("decimal(18,6)")
    size = F.abs(value)
    plain = (size >= 1e-4) & (size < 1e9) & (decimal.cast("double") == value)
    trimmed = F.regexp_replace(decimal.cast("string"), r"(\.\d+?)0+$", "$1")
    other = _repr_text(F.when(~F.coalesce(plain, F.lit(False)), value))
    return F.when(plain, trimmed).when(F.isnan(value), F.lit("nan")).otherwise(other)


def float_array_texts(values: Column) -> Column:
    """The text of each non-null element of a floating point array."""
    return _repr_texts(values.cast("array<double>"))


def nested_texts(value: Column, dtype: T.DataType) -> Column:
    """The texts of all strings and numbers in a nested value, in order; null for null."""

    def texts(v, kind: T.DataType):
        if v is None:
            return
        if isinstance(kind, T.ArrayType):
            for element in v:
                yield from texts(element, kind.elementType)
        elif isinstance(kind, T.StructType):
            for f in kind.fields:
                yield from texts(v[f.name], f.dataType)
        elif isinstance(kind, (T.FloatType, T.DoubleType)):
            yield repr(float(v))
        elif isinstance(kind, (T.StringType, T.IntegralType)):
            yield str(v)

    @F.arrow_udf(T.ArrayType(T.StringType()))
    def all_texts(values: pa.Array) -> pa.Array:
        return pa.array(
            [None if v is None else list(texts(v, dtype)) for v in values.to_pylist()], pa.list_(pa.string())
        )

    return all_texts(value)
