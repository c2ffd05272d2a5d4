"""Datasets: a DataFrame of records plus how to read each record's fields.

A dataset's DataFrame has ``rec_ord`` (a unique BIGINT that sorts records into
dataset order; gaps are allowed), ``loc`` (where the record came from) and the
record's content. Content is either a set of typed columns or, for files without
a schema, an array of tagged fields. Both offer the same questions as Column
expressions, so every detector is written once and typed input keeps its column
pruning.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tamis.functions import text as tx
from tamis.functions.canonical import canonical, content_key, sized
from tamis.functions.numbers import float_array_texts, float_text, nested_texts
from tamis.issues import LOC_DDL

_INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_FLOATS = (T.FloatType, T.DoubleType)
_STRINGS = (T.StringType, T.CharType, T.VarcharType)

# One schemaless field. ``str`` is set for strings only. Every other type has its
# JSON text in ``json`` (key order kept), the text it contributes in ``parts``,
# and in ``canon`` its canonical text, which equal values share in all formats.
FIELD_DDL = (
    "struct<name:string,type:string,str:string,json:string,canon:string,finite:boolean,"
    "parts:array<string>>"
)


def type_tag(dtype: T.DataType) -> str:
    """Canonical type of a column's non-null values."""
    if isinstance(dtype, _STRINGS):
        return "string"
    if isinstance(dtype, T.BooleanType):
        return "boolean"
    if isinstance(dtype, _INTEGERS):
        return "integer"
    if isinstance(dtype, _FLOATS):
        return "float"
    if isinstance(dtype, T.NullType):
        return "null"
    if isinstance(dtype, (T.ArrayType, T.MapType)):
        return "list"
    return "object"


def _widened(dtype: T.DataType) -> T.DataType:
    """The type with every FLOAT inside it replaced by DOUBLE."""
    if isinstance(dtype, T.FloatType):
        return T.DoubleType()
    if isinstance(dtype, T.ArrayType):
        return T.ArrayType(_widened(dtype.elementType), dtype.containsNull)
    if isinstance(dtype, T.StructType):
        return T.StructType([T.StructField(f.name, _widened(f.dataType)) for f in dtype.fields])
    return dtype


def _holds_floats(dtype: T.DataType) -> bool:
    if isinstance(dtype, T.ArrayType):
        return _holds_floats(dtype.elementType)
    if isinstance(dtype, T.StructType):
        return any(_holds_floats(f.dataType) for f in dtype.fields)
    return isinstance(dtype, _FLOATS)


def _text_parts(value: Column, dtype: T.DataType) -> Column | None:
    """The text a value contributes (string or string array), None for no text."""
    if isinstance(dtype, _STRINGS):
        return value
    if isinstance(dtype, _INTEGERS):
        return value.cast("string")
    if isinstance(dtype, _FLOATS):
        return float_text(value)
    if isinstance(dtype, T.ArrayType):
        element = dtype.elementType
        if isinstance(element, _FLOATS):
            return float_array_texts(value)
        if _holds_floats(element):
            return nested_texts(value, dtype)
        if _text_parts(F.lit(None), element) is None:
            return None
        parts = F.transform(value, lambda v: _text_parts(v, element))
        if isinstance(element, (T.ArrayType, T.StructType)):
            parts = F.flatten(F.filter(parts, lambda p: p.isNotNull()))
        return F.filter(parts, lambda p: p.isNotNull())
    if isinstance(dtype, T.StructType):
        children = [_text_parts(value[f.name], f.dataType) for f in dtype.fields]
        arrays = [
            F.when(c.isNull(), F.array().cast("array<string>")).otherwise(c)
            if isinstance(f.dataType, (T.ArrayType, T.StructType))
            else F.array(c)
            for c, f in zip(children, dtype.fields)
            if c is not None
        ]
        return F.array_compact(F.concat(*arrays)) if arrays else None
    return None


@dataclass(frozen=True)
class TypedContent:
    """Record fields held as the typed columns of a table."""

    schema: T.StructType
    names: tuple[str, ...]

    @property
    def columns(self) -> list[Column]:
        return [F.col(f"`{n}`") for n in self.names]

    def _typed(self):
        return [(F.col(f"`{n}`"), self.schema[n].dataType) for n in self.names]

    def text(self) -> Column:
        """All text of the record, parts joined by one space."""
        parts = [p for p in (_text_parts(c, t) for c, t in self._typed()) if p is not None]
        return F.concat_ws(" ", *parts) if parts else F.lit("")

    def parts_array(self, name: str) -> Column:
        """The text one field contributes, as an array."""
        dtype = self.schema[name].dataType
        parts = _text_parts(F.col(f"`{name}`"), dtype)
        if parts is None:
            return F.array().cast("array<string>")
        return parts if isinstance(dtype, (T.ArrayType, T.StructType)) else F.array(parts)

    def string_text(self) -> Column:
        """Text of the top-level string fields only."""
        strings = [c for c, t in self._typed() if isinstance(t, _STRINGS)]
        return F.concat_ws(" ", *strings) if strings else F.lit("")

    def key(self) -> Column:
        """Binary digest equal for two records exactly when their content is equal."""
        parts = [
            F.concat(sized(F.lit(n)), canonical(F.col(f"`{n}`"), self.schema[n].dataType)) for n in sorted(self.names)
        ]
        return content_key(parts)

    def blank(self, name: str) -> Column:
        if name not in self.names:
            return F.lit(True)
        value, dtype = F.col(f"`{name}`"), self.schema[name].dataType
        if isinstance(dtype, _STRINGS):
            return tx.is_blank(value)
        if isinstance(dtype, (T.ArrayType, T.MapType)):
            return value.isNull() | (F.size(value) == 0)
        if isinstance(dtype, T.StructType) and not dtype.fields:
            return F.lit(True)
        return value.isNull()

    def all_blank(self) -> Column:
        blank = F.lit(True)
        for name in self.names:
            blank = blank & self.blank(name)
        return blank

    def map_strings(self, fn: Callable[[Column, Column, Column], Column]) -> Column:
        """Concatenated arrays of ``fn(position, name, value)`` over string fields."""
        arrays = [
            fn(F.lit(pos), F.lit(name), F.col(f"`{name}`"))
            for pos, name in enumerate(self.names)
            if isinstance(self.schema[name].dataType, _STRINGS)
        ]
        return F.concat(*arrays) if arrays else None

    def replace_strings(self, df: DataFrame, fn: Callable[[Column], Column]) -> DataFrame:
        return df.withColumns(
            {
                n: fn(F.col(f"`{n}`"))
                for n in self.names
                if isinstance(self.schema[n].dataType, _STRINGS)
            }
        )

    def redacted_struct(self, fn: Callable[[Column], Column]) -> Column:
        """All fields as one struct, strings passed through ``fn``."""
        return F.struct(
            *[
                (fn(c) if isinstance(t, _STRINGS) else c).alias(n)
                for n, (c, t) in zip(self.names, self._typed())
            ]
        )

    def field_types(self) -> Column:
        """Array of ``(name, type)``, type ``null`` for null values."""
        return F.array(
            *[
                F.struct(
                    F.lit(n).alias("name"),
                    F.when(F.col(f"`{n}`").isNull(), F.lit("null"))
                    .otherwise(F.lit(type_tag(self.schema[n].dataType)))
                    .alias("type"),
                )
                for n in self.names
            ]
        )

    def display(self) -> Column:
        """Array of ``(name, type, text)`` for search and preview."""
        def shown(value: Column, dtype: T.DataType) -> Column:
            if isinstance(dtype, (T.ArrayType, T.StructType, T.MapType)):
                return F.to_json(value)
            if isinstance(dtype, _FLOATS):
                return float_text(value)
            return value.cast("string")

        return F.array(
            *[
                F.struct(
                    F.lit(n).alias("name"),
                    F.lit(type_tag(t)).alias("type"),
                    shown(c, t).alias("text"),
                )
                for n, (c, t) in zip(self.names, self._typed())
            ]
        )

    def fields_json(self) -> Column:
        """The record as a JSON object; single precision floats are widened."""
        values = [c.cast(_widened(t)).alias(n) for n, (c, t) in zip(self.names, self._typed())]
        return F.to_json(F.struct(*values), {"ignoreNullFields": "false"})


@dataclass(frozen=True)
class TaggedContent:
    """Record fields held in an array column ``fields`` of tagged values."""

    names: tuple[str, ...] = ()

    @property
    def columns(self) -> list[Column]:
        return [F.col("fields")]

    def text(self) -> Column:
        parts = F.transform(
            "fields", lambda f: F.when(f["type"] == "string", F.array(f["str"])).otherwise(f["parts"])
        )
        return F.array_join(F.flatten(parts), " ")

    def string_text(self) -> Column:
        strings = F.filter("fields", lambda f: f["type"] == "string")
        return F.array_join(F.transform(strings, lambda f: f["str"]), " ")

    def key(self) -> Column:
        parts = F.transform(
            "fields",
            lambda f: F.struct(
                f["name"].alias("name"),
                F.when(f["type"] == "string", F.concat(F.lit("s"), sized(f["str"]))).otherwise(f["canon"]).alias("value"),
            ),
        )
        return content_key([F.array_join(F.transform(F.array_sort(parts), lambda p: F.concat(sized(p["name"]), p["value"])), "")])

    @staticmethod
    def _field_blank(f: Column) -> Column:
        return (
            F.when(f["type"] == "string", tx.is_blank(f["str"]))
            .when(f["type"].isin("list", "object"), f["json"].isin("[]", "{}"))
            .otherwise(f["type"] == "null")
        )

    def blank(self, name: str) -> Column:
        return ~F.exists("fields", lambda f: (f["name"] == name) & ~self._field_blank(f))

    def all_blank(self) -> Column:
        return F.forall("fields", self._field_blank)

    def map_strings(self, fn: Callable[[Column, Column, Column], Column]) -> Column:
        placed = F.transform("fields", lambda f, i: F.struct(f.alias("f"), i.alias("pos")))
        strings = F.filter(placed, lambda p: p["f"]["type"] == "string")
        return F.flatten(
            F.transform(strings, lambda p: fn(p["pos"], p["f"]["name"], p["f"]["str"]))
        )

    def redacted_struct(self, fn: Callable[[Column], Column]) -> Column:
        """The field array, strings passed through ``fn``."""
        return F.transform(
            "fields",
            lambda f: F.when(f["type"] == "string", f.withField("str", fn(f["str"]))).otherwise(f),
        )

    def replace_strings(self, df: DataFrame, fn: Callable[[Column], Column]) -> DataFrame:
        return df.withColumn("fields", self.redacted_struct(fn))

    def field_types(self) -> Column:
        return F.transform(
            "fields", lambda f: F.struct(f["name"].alias("name"), f["type"].alias("type"))
        )

    def display(self) -> Column:
        return F.transform(
            "fields",
            lambda f: F.struct(
                f["name"].alias("name"),
                f["type"].alias("type"),
                F.when(f["type"] == "string", f["str"])
                .when(f["type"] != "null", f["json"])
                .alias("text"),
            ),
        )

    def fields_json(self) -> Column:
        members = F.transform(
            "fields",
            lambda f: F.concat(
                json_string(f["name"]), F.lit(": "), F.coalesce(f["json"], json_string(f["str"]))
            ),
        )
        return F.concat(F.lit("{"), F.array_join(members, ", "), F.lit("}"))


def json_string(text: Column) -> Column:
    """``text`` as a JSON string literal."""
    wrapped = F.to_json(F.array(text))  # ["..."]
    return F.regexp_replace(wrapped, r"^\[|\]$", "")


Content = TypedContent | TaggedContent


@dataclass(frozen=True)
class Dataset:
    """Records in order, how to read them, and what was found while reading."""

    df: DataFrame
    content: Content
    source_files: list[str] = field(default_factory=list)
    skipped_files: list[str] = field(default_factory=list)
    oversize_files: list[str] = field(default_factory=list)
    parse_issues: DataFrame | None = None

    def redacted(self, fn: Callable[[Column], Column]) -> "Dataset":
        return replace(self, df=self.content.replace_strings(self.df, fn))


def records_from_table(
    df: DataFrame,
    content: Sequence[str],
    order: str | Column,
    source: str = "table",
    metadata: Sequence[str] = (),
) -> Dataset:
    """Treat the rows of a typed DataFrame as records.

    ``content`` names the fields, ``order`` is a unique integer that sorts the
    records, ``metadata`` columns are carried along and never inspected. The
    order value is also the record's ``row_index``, so that finding a record's
    location never needs a join.
    """
    taken = {"rec_ord", "loc"} & {*content, *metadata}
    if taken:
        raise ValueError(f"column names reserved for records: {sorted(taken)}")
    rec_ord = (F.col(order) if isinstance(order, str) else order).cast("bigint")
    selected = df.select(
        rec_ord.alias("rec_ord"), *[F.col(f"`{n}`") for n in (*content, *metadata)]
    )
    selected = selected.withColumn("loc", table_location(source, F.col("rec_ord")))
    return Dataset(selected, TypedContent(selected.schema, tuple(content)), [source])


def table_location(source: str, row_index: Column) -> Column:
    return F.struct(
        F.lit(source).alias("source_file"),
        F.lit(None).cast("bigint").alias("line_number"),
        F.lit(None).cast("bigint").alias("array_index"),
        F.lit(0).alias("row_group"),
        row_index.alias("row_index"),
    ).cast(LOC_DDL)
