"""Helpers that run inside tasks: open a file, turn a value into a tagged field."""

from __future__ import annotations

import codecs
import json
import math
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
import pyarrow.compute

from tamis import fixed
from tamis.functions.canonical import canonical_text
from tamis.functions.canonical import storable as safe

CHUNK = 1 << 20

DECODED_DDL = (
    "file_ord int, path string, pos long, line_number long, array_index long, "
    "fields array<struct<name:string,type:string,str:string,json:string,canon:string,"
    "finite:boolean,parts:array<string>>>, field_name string, detail string"
)


# Text that a task decodes at a time; decoded values take many times as much.
SLICE_BYTES = 2_000_000


def text_slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that the texts of a slice hold about ``limit`` bytes."""
    start, held = 0, 0
    for i, n in enumerate(pa.compute.binary_length(batch.column(column)).to_pylist()):
        if held and held + (n or 0) > limit:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n or 0
    if start < batch.num_rows:
        yield batch.slice(start)


def open_file(uri: str):
    """A binary stream of a local file or of any file system Arrow knows."""
    if uri.startswith("file:"):
        return open("/" + uri[5:].lstrip("/"), "rb")
    from pyarrow import fs

    filesystem, path = fs.FileSystem.from_uri(uri)
    return filesystem.open_input_stream(path)


def text_chunks(stream) -> Iterator[str]:
    """Decode UTF-8 piece by piece; errors carry whole-file byte positions."""
    decoder = codecs.getincrementaldecoder("utf-8")()
    read = 0
    while True:
        data = stream.read(CHUNK)
        held = len(decoder.getstate()[0])
        try:
            text = decoder.decode(data, final=not data)
        except UnicodeDecodeError as exc:
            raise BadBytes(exc, read - held) from None
        read += len(data)
        if text:
            yield text
        if not data:
            return


class BadBytes(ValueError):
    """A UTF-8 error, worded with positions in the whole file."""

    def __init__(self, exc: UnicodeDecodeError, base: int):
        start, end = exc.start + base, exc.end + base
        if exc.end - exc.start == 1:
            where = f"byte 0x{exc.object[exc.start]:02x} in position {start}"
        else:
            where = f"bytes in position {start}-{end - 1}"
        super().__init__(f"'utf-8' codec can't decode {where}: {exc.reason}")


def _flatten(value: Any, parts: list[str]) -> bool:
    """Collect the text of a decoded value; tells whether all its numbers are finite."""
    if isinstance(value, str):
        parts.append(safe(value))
        return True
    if value is None or isinstance(value, bool):
        return True
    if isinstance(value, (int, float)):
        parts.append(str(value))
        return math.isfinite(value) if isinstance(value, float) else True
    if not isinstance(value, (dict, list)):
        return True  # dates, decimals and bytes from Parquet carry no text
    members = value.values() if isinstance(value, dict) else value
    return all([_flatten(member, parts) for member in members])


_TAGS = {str: "string", bool: "boolean", int: "integer", float: "float", type(None): "null",
         list: "list", dict: "object"}


def tagged_field(name: str, value: Any) -> dict:
    """One field in the shape of the ``fields`` array."""
    tag = _TAGS.get(type(value), "object")
    field = {"name": safe(name), "type": tag, "str": None, "json": None, "canon": None,
             "finite": True, "parts": None}
    if tag == "string":
        field["str"] = safe(value)
        return field
    field["parts"] = []
    field["finite"] = _flatten(value, field["parts"])
    field["json"] = safe(json.dumps(value, ensure_ascii=False, default=repr))
    field["canon"] = canonical_text(value)
    return field


def tagged_record(decoded: dict) -> list[dict]:
    return [tagged_field(name, value) for name, value in decoded.items()]


def decode_json(text: str) -> Any:
    """Strict JSON; nesting too deep to decode counts as malformed."""
    try:
        return json.loads(text)
    except RecursionError as exc:
        raise ValueError(str(exc)) from None


def jsonl_row(line: str) -> tuple[list[dict] | None, str | None, bool] | None:
    """``(fields, problem, malformed)`` of one line, None for a blank line."""
    line = line.removesuffix("\r")
    if not line.strip():
        return None
    try:
        decoded = decode_json(line)
    except ValueError as exc:
        return None, safe(str(exc)), True
    if isinstance(decoded, dict):
        return tagged_record(decoded), None, False
    found = type(decoded).__name__
    return None, fixed.DETAIL_JSONL_NOT_OBJECT.format(found), False
