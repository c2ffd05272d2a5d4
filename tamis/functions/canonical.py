"""One text for each value, equal exactly for equal values, whatever format the value came from.

Fixed notation: ``n`` for null, ``t`` and ``f``, ``i12;`` and ``d0.5;`` for numbers, ``s`` with the length in
bytes for strings (``s2:ab``), ``a`` with the length for lists, ``o`` with the length and members sorted by
name for objects, and ``x`` with a length and text for bytes, times and decimals. A map is a sorted list of
pairs.
"""

from __future__ import annotations

import base64
import datetime as dt
from typing import Any

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tamis.functions.numbers import float_text


def storable(text: str) -> str:
    """Text that can be stored as UTF-8; lone surrogates become escapes."""
    try:
        text.encode("utf-8")
        return text
    except UnicodeEncodeError:
        return text.encode("utf-8", "backslashreplace").decode("utf-8")


def _sized(text: str) -> str:
    text = storable(text)
    return f"{len(text.encode())}:{text}"


def _other(value: Any) -> str:
    if isinstance(value, (bytes, bytearray)):
        return base64.b64encode(value).decode()
    if isinstance(value, dt.datetime):
        if value.tzinfo is not None:
            value = value.astimezone(dt.timezone.utc)
        return value.strftime("%Y-%m-%d %H:%M:%S.%f")
    return str(value)


def canonical_text(value: Any) -> str:
    """The text of a decoded value."""
    if value is None:
        return "n"
    if isinstance(value, bool):
        return "t" if value else "f"
    if isinstance(value, int):
        return f"i{value};"
    if isinstance(value, float):
        return f"d{value!r};"
    if isinstance(value, str):
        return "s" + _sized(value)
    if isinstance(value, (list, tuple)):
        members = list(map(canonical_text, value))
        if members and isinstance(value[0], tuple):  # a map, as Arrow gives it
            members.sort()
        return f"a{len(value)}:" + "".join(members)
    if isinstance(value, dict):
        members = sorted((storable(name), canonical_text(member)) for name, member in value.items())
        return f"o{len(members)}:" + "".join(_sized(name) + member for name, member in members)
    return "x" + _sized(_other(value))


def sized(text: Column) -> Column:
    """Text behind its length in bytes, so that joined parts cannot run into each other."""
    return F.concat(F.octet_length(text).cast("string"), F.lit(":"), text)


def _holds_floats(dtype: T.DataType) -> bool:
    if isinstance(dtype, T.ArrayType):
        return _holds_floats(dtype.elementType)
    if isinstance(dtype, T.MapType):
        return _holds_floats(dtype.keyType) or _holds_floats(dtype.valueType)
    if isinstance(dtype, T.StructType):
        return any(_holds_floats(f.dataType) for f in dtype.fields)
    return isinstance(dtype, (T.FloatType, T.DoubleType))


@F.arrow_udf(T.StringType())
def _of_values(values: pa.Array) -> pa.Array:
    return pa.array([canonical_text(v) for v in values.to_pylist()], pa.string())


def canonical(value: Column, dtype: T.DataType) -> Column:
    """The same text of a typed column, never null. Only floats inside of nested values take the Arrow path."""
    if isinstance(dtype, (T.ArrayType, T.MapType, T.StructType)) and _holds_floats(dtype):
        return _of_values(value)
    if isinstance(dtype, (T.StringType, T.CharType, T.VarcharType)):
        text = F.concat(F.lit("s"), sized(value))
    elif isinstance(dtype, T.BooleanType):
        text = F.when(value, "t").otherwise("f")
    elif isinstance(dtype, T.IntegralType):
        text = F.concat(F.lit("i"), value.cast("string"), F.lit(";"))
    elif isinstance(dtype, (T.FloatType, T.DoubleType)):
        text = F.concat(F.lit("d"), float_text(value), F.lit(";"))
    elif isinstance(dtype, T.ArrayType):
        members = F.transform(value, lambda v: canonical(v, dtype.elementType))
        text = F.concat(F.lit("a"), F.size(value).cast("string"), F.lit(":"), F.array_join(members, ""))
    elif isinstance(dtype, T.MapType):
        members = F.transform(
            F.map_entries(value),
            lambda e: F.concat(F.lit("a2:"), canonical(e["key"], dtype.keyType), canonical(e["value"], dtype.valueType)),
        )
        text = F.concat(F.lit("a"), F.size(value).cast("string"), F.lit(":"), F.array_join(F.array_sort(members), ""))
    elif isinstance(dtype, T.StructType):
        fields = sorted(dtype.fields, key=lambda f: f.name)
        members = [F.concat(F.lit(_sized(f.name)), canonical(value[f.name], f.dataType)) for f in fields]
        text = F.concat(F.lit(f"o{len(fields)}:"), *members)
    elif isinstance(dtype, T.BinaryType):
        text = F.concat(F.lit("x"), sized(F.regexp_replace(F.base64(value), r"\s", "")))
    elif isinstance(dtype, T.TimestampType):
        utc = F.to_utc_timestamp(value, F.current_timezone())
        text = F.concat(F.lit("x"), sized(F.date_format(utc, "yyyy-MM-dd HH:mm:ss.SSSSSS")))
    elif isinstance(dtype, T.TimestampNTZType):
        text = F.concat(F.lit("x"), sized(F.date_format(value, "yyyy-MM-dd HH:mm:ss.SSSSSS")))
    elif isinstance(dtype, T.NullType):
        text = F.lit("n")
    else:
        text = F.concat(F.lit("x"), sized(value.cast("string")))
    return F.when(value.isNull(), "n").otherwise(text)


def content_key(parts: list[Column]) -> Column:
    """Digest of the parts (sized name and canonical value of each field, sorted by name)."""
    return F.unhex(F.sha2(F.concat(F.lit(""), *parts), 256))
