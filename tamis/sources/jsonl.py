"""One JSON object per line."""

from __future__ import annotations

import io

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tamis import fixed
from tamis.sources.decode import DECODED_DDL, jsonl_row, open_file, text_slices
from tamis.sources.json_array import scan_whole_files
from tamis.sources.lines import bytes_problem, numbered_lines, void_file_rows
from tamis.sources.manifest import Manifest, SourceFile


def _decoded(file_ord: int, path: str, number: int, line: str) -> dict | None:
    found = jsonl_row(line)
    if found is None:
        return None
    fields, problem, malformed = found
    if malformed:
        problem = fixed.DETAIL_JSONL_MALFORMED.format(number, problem)
    return {
        "file_ord": file_ord, "path": path, "pos": number, "line_number": number,
        "array_index": None, "fields": fields, "field_name": None, "detail": problem,
    }


def _file_rows(file_ord: int, path: str, uri: str):
    """Rows of a file read on its own, line by line."""
    problem = bytes_problem(uri)
    if problem:
        yield from void_file_rows(fixed.DETAIL_JSONL_BYTES)(file_ord, path, uri)
        return
    with open_file(uri) as stream:
        lines = io.TextIOWrapper(stream, encoding="utf-8", newline="\n")
        for number, line in enumerate(lines, start=1):
            row = _decoded(file_ord, path, number, line.removesuffix("\n"))
            if row:
                yield row


def scan_jsonl(spark: SparkSession, manifest: Manifest, files: list[SourceFile]) -> DataFrame:
    lines = numbered_lines(spark, manifest, files, csv=False)
    schema = to_arrow_schema(StructType.fromDDL(DECODED_DDL))

    def decode(batches):
        for part in (part for batch in batches for part in text_slices(batch, "value")):
            rows = []
            for line in part.to_pylist():
                row = _decoded(line["file_ord"], line["path"], line["line_number"], line["value"])
                if row:
                    rows.append(row)
            yield pa.RecordBatch.from_pylist(rows, schema)

    decoded = lines.frame.mapInArrow(decode, DECODED_DDL)
    if lines.bad_bytes:
        void = void_file_rows(fixed.DETAIL_JSONL_BYTES)
        decoded = decoded.unionByName(scan_whole_files(spark, manifest, lines.bad_bytes, void))
    if lines.apart:  # hidden names and byte order marks
        decoded = decoded.unionByName(scan_whole_files(spark, manifest, lines.apart, _file_rows))
    return decoded
