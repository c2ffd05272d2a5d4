"""Write records as JSON, JSONL, CSV or Parquet, in order, by many tasks.

An export is a folder of part files whose names sort in record order. Every part
is a complete document of its format (a JSON part is a whole array, a CSV part
has its header), so reading the folder back gives the same records.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tamis.dataset import Dataset, TypedContent
from tamis.errors import MixedTypes, UnrepresentableValue, UnsupportedFormat
from tamis.functions.numbers import float_text
from tamis.sinks.files import name_parts

FORMATS = ("json", "jsonl", "csv", "parquet")


def _not_finite(value: Column, dtype: T.DataType) -> Column | None:
    """Whether a typed value has a NaN or infinity anywhere, None if it cannot."""
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return F.isnan(value) | (F.abs(value) == float("inf"))
    if isinstance(dtype, T.ArrayType):
        if _not_finite(F.lit(None), dtype.elementType) is None:
            return None
        return F.exists(value, lambda v: _not_finite(v, dtype.elementType))
    if isinstance(dtype, T.MapType):
        return _not_finite(F.map_values(value), T.ArrayType(dtype.valueType))
    if isinstance(dtype, T.StructType):
        found = [_not_finite(value[f.name], f.dataType) for f in dtype.fields]
        found = [F.coalesce(f, F.lit(False)) for f in found if f is not None]
        return F.array_contains(F.array(*found), True) if found else None
    return None


def _offenders(dataset: Dataset, fmt: str) -> Column | None:
    """Names of the fields a format cannot hold, in field order."""
    content = dataset.content
    if fmt == "parquet":
        return None
    if not isinstance(content, TypedContent):
        if fmt == "csv":
            bad = F.filter("fields", lambda f: f["type"].isin("list", "object"))
        else:
            bad = F.filter("fields", lambda f: ~f["finite"])
        return F.transform(bad, lambda f: f["name"])
    tests = []
    for name in content.names:
        value, dtype = F.col(f"`{name}`"), content.schema[name].dataType
        if fmt == "csv":
            nested = isinstance(dtype, (T.ArrayType, T.MapType, T.StructType))
            bad = value.isNotNull() if nested else None
        else:
            bad = _not_finite(value, dtype)
        if bad is not None:
            tests.append(F.when(bad, F.lit(name)))
    return F.array_compact(F.array(*tests)) if tests else None


def first_unrepresentable(dataset: Dataset, fmt: str) -> tuple[int, str] | None:
    """Position of the first record, and its first field, that ``fmt`` cannot hold."""
    offenders = _offenders(dataset, fmt)
    if offenders is None:
        return None
    named = dataset.df.select("rec_ord", offenders.alias("names")).filter(F.size("names") > 0)
    first = named.agg(F.min(F.struct("rec_ord", F.col("names")[0].alias("name"))).alias("f"))
    found = first.first().f
    if found is None:
        return None
    return dataset.df.filter(F.col("rec_ord") < found.rec_ord).count(), found.name


def field_names(dataset: Dataset) -> DataFrame:
    """Field names in order of first appearance, with the types each one has.

    Columns: ``name``, ``first`` (record and position), ``types``.
    """
    fields = dataset.df.select(
        "rec_ord", F.posexplode(dataset.content.field_types()).alias("pos", "f")
    )
    return (
        fields.groupBy(F.col("f.name").alias("name"))
        .agg(
            F.min(F.struct("rec_ord", "pos")).alias("first"),
            F.array_sort(F.collect_set("f.type")).alias("types"),
        )
        .orderBy("first")
    )


def _csv_cell(value: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, T.BooleanType):
        return F.initcap(value.cast("string"))
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return float_text(value)
    return value.cast("string")


def _field(name: str) -> Column:
    return F.try_element_at(F.filter("fields", lambda f: f["name"] == name), F.lit(1))


def _csv_columns(dataset: Dataset) -> list[Column]:
    content = dataset.content
    if isinstance(content, TypedContent):
        cells = {n: _csv_cell(F.col(f"`{n}`"), content.schema[n].dataType) for n in content.names}
    else:
        cells = {}
        for row in field_names(dataset).select("name").collect():  # the header
            f = _field(row.name)
            cells[row.name] = (
                F.when(f["type"] == "string", f["str"])
                .when(f["type"] == "boolean", F.initcap(f["json"]))
                .when(f["type"] != "null", f["parts"][0])
            )
    return [F.coalesce(cell, F.lit("")).alias(name) for name, cell in cells.items()]


def _column_type(name: str, merged: str) -> str:
    """Column type that holds all list or object values of a field, from their merged variant schema."""
    if "VARIANT" in merged:
        raise MixedTypes(f"field {name!r} holds values of different types")
    merged = re.sub(r"DECIMAL\(\d+,\d+\)", "DOUBLE", merged.replace("OBJECT", "STRUCT"))
    return re.sub(r"\bVOID\b", "STRING", merged)


def _tagged_types(dataset: Dataset) -> list[Row]:
    """Of each field, in order of first appearance: its types, the merged schema of its nested values, and
    the first record with an integer beyond 64 bits. One job; tasks merge what they see of a field."""
    fields = dataset.df.select("rec_ord", F.posexplode("fields").alias("pos", "f"))
    nested = F.when(F.col("f.type").isin("list", "object"), F.col("f.json"))
    wide = (F.col("f.type") == "integer") & F.col("f.json").try_cast("bigint").isNull()
    return (
        fields.groupBy(F.col("f.name").alias("name"))
        .agg(
            F.min(F.struct("rec_ord", "pos")).alias("first"),
            F.array_sort(F.collect_set("f.type")).alias("types"),
            F.schema_of_variant_agg(F.try_parse_json(nested)).alias("merged"),
            F.min(F.when(wide, F.col("rec_ord"))).alias("wide"),
        )
        .orderBy("first")
        .collect()
    )  # one row per field


_PARQUET_TYPES = {"integer": "bigint", "float": "double", "boolean": "boolean"}


def _parquet_columns(types: list[Row]) -> list[Column]:
    columns = []
    for row in types:
        f, kinds = _field(row.name), [t for t in row.types if t != "null"]
        if len(kinds) > 1:
            raise MixedTypes(f"field {row.name!r} holds {', '.join(kinds)}")
        kind = kinds[0] if kinds else "string"
        if kind == "string":
            value = f["str"]
        elif kind in _PARQUET_TYPES:
            text = F.when(f["type"] != "null", f["json"])
            value = text.cast(_PARQUET_TYPES[kind])
        else:
            value = F.from_json(
                F.when(f["type"] != "null", f["json"]), _column_type(row.name, row.merged)
            )
        columns.append(value.alias(row.name))
    return columns


def _framed(batches):
    """Join the lines of one part into a JSON array."""
    opened = False
    for batch in batches:
        lines = batch.column(0).to_pylist()
        framed = [("," if opened or i else "[") + line for i, line in enumerate(lines)]
        opened = opened or bool(lines)
        yield pa.RecordBatch.from_pydict({"value": pa.array(framed, pa.string())})
    if opened:
        yield pa.RecordBatch.from_pydict({"value": pa.array(["]"], pa.string())})


def _first_beyond_64_bits(dataset: Dataset, types: list[Row]) -> tuple[int, str] | None:
    """Position and field of the first integer that a Parquet column cannot hold."""
    wide = [(row.wide, row.name) for row in types if row.wide is not None]
    if not wide:
        return None
    rec_ord, name = min(wide)
    return dataset.df.filter(F.col("rec_ord") < rec_ord).count(), name


def export_records(dataset: Dataset, fmt: str, path: str) -> list[str]:
    """Write the records to the folder ``path`` and list the part files.

    A value the format cannot hold stops the export before anything is written.
    """
    if fmt not in FORMATS:
        raise UnsupportedFormat(fmt)
    offence = first_unrepresentable(dataset, fmt)
    types = None
    if fmt == "parquet" and not isinstance(dataset.content, TypedContent):
        types = _tagged_types(dataset)
        offence = offence or _first_beyond_64_bits(dataset, types)
    if offence:
        raise UnrepresentableValue(*offence, fmt)
    spark = dataset.df.sparkSession
    if fmt != "parquet" and dataset.df.isEmpty():
        text = [("[]",)] if fmt == "json" else []
        spark.createDataFrame(text, "value string").coalesce(1).write.text(path)
        return name_parts(spark, path, fmt)
    ordered = dataset.df.orderBy("rec_ord")
    if fmt == "parquet":
        columns = dataset.content.columns if types is None else _parquet_columns(types)
        ordered.select(*columns).write.parquet(path)
    elif fmt == "csv":
        ordered.select(*_csv_columns(dataset)).write.csv(
            path, header=True, quoteAll=True, quote='"', escape='"', lineSep="\n",
            ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False,
        )
    else:
        lines = ordered.select(dataset.content.fields_json().alias("value"))
        if fmt == "json":
            lines = lines.mapInArrow(_framed, "value string")
        lines.write.text(path)
    return name_parts(spark, path, fmt)
