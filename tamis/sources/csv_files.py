"""CSV with a header row; every cell is a string.

A file without quotes has one row per line, so its lines are split natively. The
splits of files with quotes are parsed in parallel too (see quoted_csv). Only
files that Spark's reader cannot read as they are (hidden names, byte order
marks) are streamed by the csv module, one task per file.
"""

from __future__ import annotations

import csv
import io
from collections import Counter
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tamis import fixed
from tamis.dataset import FIELD_DDL
from tamis.operators.skew import attach_by_key
from tamis.sources.decode import open_file, safe
from tamis.sources.json_array import scan_whole_files
from tamis.sources.lines import bytes_problem, numbered_lines, split_lines, void_file_rows
from tamis.sources.manifest import Manifest, SourceFile
from tamis.sources.quoted_csv import quoted_rows, unlimited
from tamis.staging import stage

# Names, paths and headers of files are broadcast if they have so many bytes at most.
BROADCAST_BYTES = 32_000_000


def _string_field(name: str, value: str) -> dict:
    return {"name": safe(name), "type": "string", "str": safe(value), "json": None,
            "canon": None, "finite": True, "parts": None}


def _header_problem(header: list[str] | None) -> tuple[str, str | None, int | None] | None:
    """``(detail, field_name, line_number)`` if the header voids the file."""
    if not header:
        return fixed.DETAIL_CSV_NO_HEADER, None, None
    repeated = sorted(name for name, times in Counter(header).items() if times > 1)
    if repeated:
        shown = ", ".join(map(repr, repeated))
        return fixed.DETAIL_CSV_REPEATED.format(shown), repeated[0], 1
    return None


def _file_rows(file_ord: int, path: str, uri: str):
    def row(pos, line_number=None, fields=None, detail=None, field_name=None):
        return {
            "file_ord": file_ord, "path": path, "pos": pos, "line_number": line_number,
            "array_index": None, "fields": fields, "field_name": field_name,
            "detail": None if detail is None else safe(detail),
        }

    if bytes_problem(uri):
        yield from void_file_rows(fixed.DETAIL_CSV_BYTES)(file_ord, path, uri)
        return
    unlimited()
    with open_file(uri) as stream:
        reader = csv.reader(io.TextIOWrapper(stream, encoding="utf-8", newline="\n"))
        header, broken = None, None
        try:
            header = next(reader, None)
        except csv.Error as exc:
            broken = exc
        problem = _header_problem(header) if broken is None else (fixed.DETAIL_CSV_NO_HEADER, None, None)
        while broken is None:
            try:
                cells = next(reader)
            except StopIteration:
                break
            except csv.Error as exc:
                broken = exc
                break
            if problem or not cells:
                continue
            number = reader.line_num
            if len(cells) == len(header):
                fields = [_string_field(n, c) for n, c in zip(header, cells)]
                yield row(number, number, fields)
            else:
                detail = fixed.DETAIL_CSV_WIDTH.format(number, len(cells), len(header))
                yield row(number, number, detail=detail)
        if broken is not None:  # listed before the file's other issues
            detail = fixed.DETAIL_CSV_MALFORMED.format(reader.line_num, broken)
            yield row(-1, reader.line_num, detail=detail)
        if problem:
            detail, name, line = problem
            yield row(0, line, detail=detail, field_name=name)


_HEADER_DDL = "file_ord int, path string, length long, header array<string>, line long, field_name string, detail string"


def _headers(files: DataFrame, cells: DataFrame) -> DataFrame:
    """One row per file: its header, or in ``detail`` what voids the file."""
    first = cells.where("first_line = 1").select("file_ord", "cells")
    known = files.select("file_ord", "path", "length").join(first, "file_ord", "left")
    schema = to_arrow_schema(StructType.fromDDL(_HEADER_DDL))

    def run(batches):
        for batch in batches:
            rows = []
            for file in batch.to_pylist():
                header = file.pop("cells")
                detail, field_name, line = _header_problem(header) or (None, None, None)
                rows.append({**file, "header": header if detail is None else None, "line": line,
                             "field_name": field_name, "detail": None if detail is None else safe(detail)})
            yield pa.RecordBatch.from_pylist(rows, schema)

    return known.mapInArrow(run, _HEADER_DDL)


def _with_header(rows: DataFrame, headers: DataFrame) -> DataFrame:
    """Rows of files with a good header, with that header."""
    good = headers.where("detail IS NULL").select("file_ord", "header", "length")
    size = good.agg(F.sum(F.length(F.to_json("header")) + 16)).first()[0] or 0
    if size <= BROADCAST_BYTES:
        return rows.join(F.broadcast(good.drop("length")), "file_ord")
    return attach_by_key(rows, good, "file_ord", "length", "line_number").where("header IS NOT NULL").drop("length")


def _decoded(cells: DataFrame, files: DataFrame, problems: DataFrame | None) -> DataFrame:
    """Decoded rows of ``cells`` (file_ord, path, first_line, line_number, cells) and the files' issues."""
    headers = stage(_headers(files, cells))  # one narrow row per file
    rows = _with_header(cells.where((F.col("first_line") > 1) & (F.size("cells") > 0)), headers)
    fits = F.size("cells") == F.size("header")
    field = F.zip_with(
        "header",
        "cells",
        lambda name, cell: F.struct(
            name.alias("name"),
            F.lit("string").alias("type"),
            cell.alias("str"),
            F.lit(None).cast("string").alias("json"),
            F.lit(None).cast("string").alias("canon"),
            F.lit(True).alias("finite"),
            F.lit(None).cast("array<string>").alias("parts"),
        ),
    )
    width = F.format_string(
        fixed.DETAIL_CSV_WIDTH.replace("{}", "%d"), "line_number", F.size("cells"), F.size("header")
    )
    none = F.lit(None).cast("long")
    decoded = rows.select(
        "file_ord", "path", F.col("line_number").alias("pos"), "line_number", none.alias("array_index"),
        F.when(fits, field).cast(f"array<{FIELD_DDL}>").alias("fields"),
        F.lit(None).cast("string").alias("field_name"), F.when(~fits, width).alias("detail"),
    )
    nothing = F.lit(None).cast(f"array<{FIELD_DDL}>").alias("fields")
    void = headers.where("detail IS NOT NULL").select(
        "file_ord", "path", F.lit(0).cast("long").alias("pos"), F.col("line").alias("line_number"),
        none.alias("array_index"), nothing, "field_name", "detail",
    )
    decoded = decoded.unionByName(void)
    if problems is None:
        return decoded
    malformed = F.format_string(fixed.DETAIL_CSV_MALFORMED.replace("{}", "%s"), "line_number", "detail")
    return decoded.unionByName(problems.select(  # listed before the file's other issues
        "file_ord", "path", F.lit(-1).cast("long").alias("pos"), "line_number", none.alias("array_index"), nothing,
        F.lit(None).cast("string").alias("field_name"), malformed.alias("detail"),
    ))


def scan_csv(spark: SparkSession, manifest: Manifest, files: list[SourceFile]) -> DataFrame:
    lines = numbered_lines(spark, manifest, [f for f in files if f.length], csv=True)
    value = F.regexp_replace("value", "\r$", "")
    cells = lines.frame.select(
        "file_ord", "path", F.col("line_number").alias("first_line"), "line_number",
        F.when(value != "", F.split(value, ",", -1)).otherwise(F.array().cast("array<string>")).alias("cells"),
    )
    known, problems = [*lines.plain, *(f for f in files if not f.length)], None
    if lines.quoted:
        placed = manifest.frame(spark, lines.quoted).select("file_ord", "path", "name")
        rows, problems = quoted_rows(split_lines(spark, lines.quoted))
        rows, problems = _placed(rows, placed), _placed(problems, placed)
        cells = cells.unionByName(rows) if lines.plain else rows
        known += lines.quoted
    parts = []
    if known:
        parts.append(_decoded(cells, manifest.frame(spark, known), problems))
    if lines.bad_bytes:
        void = void_file_rows(fixed.DETAIL_CSV_BYTES)
        parts.append(scan_whole_files(spark, manifest, lines.bad_bytes, void))
    if lines.apart:
        parts.append(scan_whole_files(spark, manifest, lines.apart, _file_rows))
    return reduce(DataFrame.unionByName, parts)


def _placed(rows: DataFrame, files: DataFrame) -> DataFrame:
    """Rows with file_ord and path in place of the name."""
    size = files.agg(F.sum(F.length("path") + F.length("name") + 32)).first()[0] or 0
    if size <= BROADCAST_BYTES:
        return rows.join(F.broadcast(files), "name").drop("name")
    weighed = files.join(rows.groupBy("name").agg(F.count(F.lit(1)).alias("weight")), "name")
    return attach_by_key(rows, weighed, "name", "weight", "line_number").drop("name", "weight")
