"""Rows of CSV files with quotes, split across tasks.

Whether a line begins inside a quoted cell depends on all lines before it. For the two possible beginnings
of a line, its end is one of the same two states, so a line, and a whole split, is a map of two states. Maps
compose; the state at the beginning of each split follows from the splits before it by window sums over a
few numbers per split. With that known, each split is parsed on its own. A row that crosses splits comes as
pieces, which meet by the number of the row's first line.
"""

from __future__ import annotations

import csv
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tamis.staging import stage, stage_table

BROADCAST_SPLITS = 2_000_000
_CLOSING = '"\n'
CELLS_DDL = "name string, first_line long, line_number long, cells array<string>"
_MAP_DDL = (
    "name string, split long, n long, bytes long, length long, "
    + ", ".join(f"end{s} int, open{s} long, wrong{s} long, detail{s} string" for s in (0, 1))
)


def unlimited() -> None:
    csv.field_size_limit(2**31 - 1)  # a cell may be as long as a string


def _line(line: str, inside: bool) -> tuple[bool, str | None]:
    """Whether the next line begins inside a cell, and the csv module's complaint about this one.

    A closing line is put behind; if the row reaches into it, the cell was still open.
    """
    if '"' not in line and (inside or "\r" not in line):
        return inside, None
    reader = csv.reader(iter([('"' if inside else "") + line + "\n", _CLOSING]))
    try:
        next(reader)
    except csv.Error as exc:
        return False, str(exc)
    return reader.line_num == 2, None


class _Beginning:
    """What a split looks like if it begins in a given state."""

    def __init__(self, inside: bool):
        self.inside = inside
        self.open: int | None = None  # first line of the row that is open now, if it began here
        self.wrong: int | None = None
        self.detail: str | None = None

    def read(self, number: int, line: str) -> None:
        before = self.inside
        self.inside, detail = _line(line, before)
        if detail is not None and self.wrong is None:
            self.wrong, self.detail = number, detail
        if self.inside and not before:
            self.open = number
        elif not self.inside:
            self.open = None


def _by_split(batches: Iterator[pa.RecordBatch], *extra: str) -> Iterator[tuple]:
    """(name, split, line, *extra) of the rows, which come split by split in order."""
    for batch in batches:
        yield from zip(*(batch.column(c).to_pylist() for c in ("name", "split", "value", *extra)), strict=True)


def _maps(text: DataFrame) -> DataFrame:
    """Per split the map of its beginning to its end, and where rows stay open or go wrong."""
    names = [part.split()[0] for part in _MAP_DDL.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unlimited()
        at, n, size, whole, both = None, 0, 0, 0, ()

        def done() -> pa.RecordBatch:
            row = [*at, n, size, whole]
            for b in both:
                row += [int(b.inside), b.open, b.wrong, b.detail]
            types = [pa.string(), *[pa.int64()] * 4] + [pa.int32(), pa.int64(), pa.int64(), pa.string()] * 2
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types, strict=True)], names=names)

        for name, split, line, length in _by_split(batches, "length"):
            if at != (name, split):
                if at:
                    yield done()
                at, n, size, whole, both = (name, split), 0, 0, length, (_Beginning(False), _Beginning(True))
            n += 1
            size += len(line.encode()) + 1
            for b in both:
                b.read(n, line)
        if at:
            yield done()

    return text.select("name", "split", "value", "length").mapInArrow(run, _MAP_DDL)


def _scanned(maps: DataFrame) -> DataFrame:
    """Per split: inside (how it begins), base (lines before), open_line (of the row that is open before).

    Constant maps fix the state behind them; of the others only those that swap the states matter.
    """
    order = Window.partitionBy("name").orderBy("split")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    here = order.rowsBetween(Window.unboundedPreceding, 0)
    swaps = F.sum(F.when((F.col("end0") == 1) & (F.col("end1") == 0), 1).otherwise(0))
    constant = F.when(F.col("end0") == F.col("end1"), F.struct("end0", F.col("swapped").alias("at")))
    steps = maps.withColumns({"swapped": swaps.over(here), "earlier": F.coalesce(swaps.over(before), F.lit(0))})
    fixed = F.last(constant, ignorenulls=True).over(before)
    inside = F.pmod(F.coalesce(fixed["end0"] - fixed["at"], F.lit(0)) + F.col("earlier"), F.lit(2)) == 1
    own = lambda name: F.when(F.col("inside"), F.col(f"{name}1")).otherwise(F.col(f"{name}0"))
    placed = steps.withColumns({"inside": inside, "base": F.coalesce(F.sum("n").over(before), F.lit(0))})
    placed = placed.withColumns(
        {"opened": F.col("base") + own("open"), "wrong": F.col("base") + own("wrong"), "detail": own("detail")}
    )
    return placed.select(
        "name", "split", "inside", "base", F.last("opened", ignorenulls=True).over(before).alias("open_line"),
        "n", "bytes", "length", "wrong", "detail",
    )


def _cells(lines: list[str], endless: bool = False) -> list[str] | None:
    """The cells of a row's lines, None if they are not readable. endless: the last one has no line end."""
    if len(lines) == 1 and '"' not in lines[0] and "\r" not in lines[0]:
        return lines[0].split(",") if lines[0] else []
    try:
        ended = [line + "\n" for line in lines]
        return next(csv.reader(iter([*ended[:-1], lines[-1]] if endless else ended)), [])
    except csv.Error:
        return None  # the first of these is an issue, nothing behind it is read


_PARSED_DDL = "name string, open_line long, first_line long, line_number long, cells array<string>, piece string"


def _parsed(lines: DataFrame) -> DataFrame:
    """The rows that lie in one split, and pieces (with ``open_line``) of those that do not."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unlimited()
        rows: list[tuple] = []

        def flushed() -> pa.RecordBatch:
            columns = zip(*rows, strict=True)
            types = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.string()]
            names = [part.split()[0] for part in _PARSED_DDL.split(", ")]
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)
            rows.clear()
            return batch

        at, number, inside, start, held, size = None, 0, False, 0, [], 0
        outer = False  # whether the row at hand began in an earlier split

        def piece() -> tuple:
            return (at[0], start, number - len(held) + 1, number, None, "\n".join(held))

        for name, split, line, begins, base, open_line, last in _by_split(batches, "inside", "base", "open_line", "last"):
            if at != (name, split):
                if held:
                    rows.append(piece())
                at, number, inside, held = (name, split), base, begins, []
                start, outer = (open_line, True) if begins else (0, False)
            number += 1
            if last is not None and number >= last:
                held = []
                continue
            if not inside:
                start, outer = number, False
            held.append(line)
            inside, _ = _line(line, inside)
            if not inside:
                rows.append(piece() if outer else (name, None, start, number, _cells(held), None))
                held, outer = [], False
            size += len(line) + 100
            if rows and size > 4_000_000:
                yield flushed()
                size = 0
        if held:
            rows.append(piece())
        if rows:
            yield flushed()

    return lines.select("name", "split", "value", "inside", "base", "open_line", "last").mapInArrow(run, _PARSED_DDL)


def _joined(pieces: DataFrame, files: DataFrame) -> DataFrame:
    """Rows whose pieces lie in several splits, or that are open where the file ends."""
    whole = pieces.groupBy("name", "open_line").agg(
        F.array_sort(F.collect_list(F.struct("first_line", "line_number", "piece"))).alias("pieces"),
        F.max("line_number").alias("line_number"),
    ).join(files.select("name", "endless"), "name")
    endless = F.col("endless") == F.col("line_number")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unlimited()
        for batch in batches:
            rows = batch.to_pylist()
            for row in rows:
                row["cells"] = _cells([line for p in row["pieces"] for line in p["piece"].split("\n")], row["endless"])
            yield pa.RecordBatch.from_arrays(
                [batch.column("name"), batch.column("open_line"), batch.column("line_number"),
                 pa.array([r["cells"] for r in rows], pa.list_(pa.string()))],
                names=["name", "first_line", "line_number", "cells"],
            )

    return whole.withColumn("endless", F.coalesce(endless, F.lit(False))).mapInArrow(run, CELLS_DDL)


def quoted_rows(text: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(rows, problems)`` of the lines of CSV files, read by Spark's text reader split by split.

    ``text`` has name, split (where it begins), value (the line) and length (of the file in bytes). Rows
    have name, first_line, line_number (the last line) and cells, also empty ones of blank lines. Problems
    have name, line_number and detail: what the csv module says of the first line that it cannot read;
    nothing from that line on is read.
    """
    scanned = stage(_scanned(_maps(text)))  # a few numbers per split
    files = scanned.groupBy("name").agg(
        F.min(F.when(F.col("wrong").isNotNull(), F.struct("wrong", "detail"))).alias("first"),
        F.when(F.sum("bytes") > F.max("length"), F.sum("n")).alias("endless"),
    )
    problems = files.where("first IS NOT NULL").select("name", F.col("first.wrong").alias("line_number"), "first.detail")
    splits = scanned.join(files.select("name", F.col("first.wrong").alias("last")), "name").select(
        "name", "split", "inside", "base", "open_line", "last"
    )
    if splits.count() <= BROADCAST_SPLITS:
        lines = text.join(F.broadcast(splits), ["name", "split"])
    else:
        lines = text.withColumn("at", F.monotonically_increasing_id()).join(splits, ["name", "split"])
        lines = lines.sortWithinPartitions("name", "split", "at")
    parsed = stage_table(_parsed(lines), "csv_rows")
    rows = parsed.where("piece IS NULL").select("name", "first_line", "line_number", "cells").unionByName(
        _joined(parsed.where("piece IS NOT NULL"), files)
    )
    return rows.where("cells IS NOT NULL"), problems
