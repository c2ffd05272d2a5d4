"""Files whose top level is a JSON array, decoded element by element.

The format cannot be split, so each file is one task. The file is read twice in
bounded memory: once to check it as a whole, since one bad byte or token voids
the file, and once to emit its elements.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

from tamis import fixed
from tamis.sources.decode import (
    DECODED_DDL,
    decode_json,
    open_file,
    safe,
    tagged_record,
    text_chunks,
)
from tamis.sources.manifest import Manifest, SourceFile

BATCH = 500
_EDGE = 16  # longer than any literal or escape
_SPACE = re.compile(r"[ \t\n\r]*")


class _Text:
    """A sliding window over the text of one file."""

    def __init__(self, stream):
        self.chunks = text_chunks(stream)
        self.buffer, self.at, self.done = "", 0, False
        self.offset, self.lines, self.line_start = 0, 0, 0

    def more(self) -> bool:
        """Drop what was consumed and append a chunk."""
        chunk = next(self.chunks, None)
        if chunk is None:
            self.done = True
            return False
        used = self.buffer[: self.at]
        breaks = used.count("\n")
        if breaks:
            self.lines += breaks
            self.line_start = self.offset + used.rindex("\n") + 1
        self.offset += self.at
        self.buffer, self.at = self.buffer[self.at :] + chunk, 0
        return True

    def peek(self) -> str:
        """The next character that is not white space, empty at the end."""
        while True:
            self.at = _SPACE.match(self.buffer, self.at).end()
            if self.at < len(self.buffer):
                return self.buffer[self.at]
            if not self.more():
                return ""

    def last(self, char: str) -> int:
        """Position of the latest ``char`` in the window, its start if it slid out."""
        return max(self.buffer.rfind(char, 0, self.at), 0)

    def fail(self, message: str, pos: int | None = None):
        pos = self.at if pos is None else pos
        before = self.buffer[:pos]
        line = self.lines + before.count("\n") + 1
        start = self.line_start if "\n" not in before else self.offset + before.rindex("\n") + 1
        char = self.offset + pos
        raise ValueError(f"{message}: line {line} column {char - start + 1} (char {char})")

    def value(self):
        """Decode one value, reading on while it may be cut off by the window."""
        decoder = json.JSONDecoder()
        while True:
            try:
                value, end = decoder.raw_decode(self.buffer, self.at)
            except RecursionError as exc:
                raise ValueError(str(exc)) from None
            except json.JSONDecodeError as exc:
                # Only an error at the edge, or an open string, can be due to the cut.
                cut = exc.msg.startswith("Unterminated") or exc.pos > len(self.buffer) - _EDGE
                if not (cut and self._grow(len(self.buffer) * 2)):
                    self.fail(exc.msg, exc.pos)
                continue
            # A number or literal that touches the edge may go on.
            if end < len(self.buffer) or not self._grow(len(self.buffer) + 1):
                self.at = end
                return value

    def _grow(self, wanted: int) -> bool:
        grew = False
        while len(self.buffer) < wanted and not self.done:
            grew = self.more() or grew
        return grew


def array_elements(stream) -> Iterator:
    """Yield the elements of a top-level array; ``ValueError`` if not one."""
    text = _Text(stream)
    if text.peek() == "\ufeff":
        text.fail("Unexpected UTF-8 BOM (decode using utf-8-sig)", 0)
    if text.peek() != "[":
        raise _NotArray
    text.at += 1
    if text.peek() == "]":
        text.at += 1
    else:
        while True:
            text.peek()
            yield text.value()
            following = text.peek()
            if following == "]":
                text.at += 1
                break
            if following != ",":
                text.fail("Expecting ',' delimiter")
            text.at += 1
            if text.peek() == "]":
                text.fail("Illegal trailing comma before end of array", text.last(","))
    if text.peek():
        text.fail("Extra data")


class _NotArray(Exception):
    pass


def _drain(stream) -> None:
    """Read on to the end, so that bad bytes take precedence over bad syntax."""
    for _ in text_chunks(stream):
        pass


def file_problem(uri: str) -> str | None:
    """What voids the whole file, None if its top level is a good array."""
    try:
        with open_file(uri) as stream:
            _drain(stream)
        with open_file(uri) as stream:
            for _ in array_elements(stream):
                pass
    except _NotArray:
        with open_file(uri) as stream:
            try:
                found = decode_json("".join(text_chunks(stream)))
            except ValueError as exc:
                return fixed.DETAIL_JSON_MALFORMED.format(exc)
        return fixed.DETAIL_JSON_NOT_ARRAY.format(type(found).__name__)
    except ValueError as exc:
        return fixed.DETAIL_JSON_MALFORMED.format(exc)
    return None


def _rows(file_ord: int, path: str, uri: str) -> Iterator[dict]:
    base = {"file_ord": file_ord, "path": path, "line_number": None, "field_name": None}
    problem = file_problem(uri)
    if problem:
        yield {**base, "pos": 0, "array_index": None, "fields": None, "detail": safe(problem)}
        return
    with open_file(uri) as stream:
        for index, element in enumerate(array_elements(stream)):
            row = {**base, "pos": index, "array_index": index, "fields": None, "detail": None}
            if isinstance(element, dict):
                row["fields"] = tagged_record(element)
            else:
                row["detail"] = fixed.DETAIL_JSON_NOT_OBJECT.format(type(element).__name__)
            yield row


def scan_json(spark: SparkSession, manifest: Manifest, files: list[SourceFile]) -> DataFrame:
    return scan_whole_files(spark, manifest, files, _rows)


def scan_whole_files(spark: SparkSession, manifest: Manifest, files, rows) -> DataFrame:
    """One task per file: ``rows(file_ord, path, uri)`` yields decoded rows."""
    import pyarrow as pa

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL(DECODED_DDL))

    def decode(batches):
        for batch in batches:
            for file in batch.to_pylist():
                held = []
                for row in rows(file["file_ord"], file["path"], file["uri"]):
                    held.append(row)
                    if len(held) == BATCH:
                        yield pa.RecordBatch.from_pylist(held, schema)
                        held = []
                if held:
                    yield pa.RecordBatch.from_pylist(held, schema)

    chosen = manifest.frame(spark, files).select("file_ord", "path", "uri")
    return chosen.mapInArrow(decode, DECODED_DDL)
