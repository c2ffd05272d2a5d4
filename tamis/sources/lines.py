"""Numbered lines of many text files, split across tasks.

Spark's text reader splits large files but does not number lines. Splits are
counted once; prefix sums over the splits of a file give each split's first line
number, and the number of splits bounds what is broadcast.
"""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tamis.sources.decode import BadBytes, open_file, text_chunks
from tamis.sources.manifest import Manifest, SourceFile
from tamis.staging import stage

BROADCAST_SPLITS = 2_000_000
LINE_DDL = "file_ord int, path string, line_number long, value string"


@dataclass(frozen=True)
class Lines:
    """``frame``: file_ord, path, line_number, value of the plain files. ``quoted``: files whose lines
    are not rows; ``bad_bytes`` and ``apart``: files to be read one by one."""

    frame: DataFrame
    plain: list[SourceFile]
    bad_bytes: list[SourceFile]
    quoted: list[SourceFile]
    apart: list[SourceFile]


def split_lines(spark: SparkSession, files: list[SourceFile]) -> DataFrame:
    """name, split (where it begins), length (of the file) and value of each line, in order in a split."""
    return spark.read.option("lineSep", "\n").text([f.uri for f in files]).select(
        "value",
        F.col("_metadata.file_name").alias("name"),
        F.col("_metadata.file_block_start").alias("split"),
        F.col("_metadata.file_size").alias("length"),
    )


def _marked_files(spark: SparkSession, manifest: Manifest, files: list[SourceFile]) -> set[int]:
    """Files that start with a byte order mark, which Spark's reader would remove."""

    def heads(batches):
        for batch in batches:
            kept = []
            for file in batch.to_pylist():
                with open_file(file["uri"]) as stream:
                    if stream.read(3) == b"\xef\xbb\xbf":
                        kept.append(file["file_ord"])
            yield pa.RecordBatch.from_pydict({"file_ord": pa.array(kept, pa.int32())})

    chosen = manifest.frame(spark, files).select("file_ord", "uri")
    return {r.file_ord for r in chosen.mapInArrow(heads, "file_ord int").collect()}


def numbered_lines(
    spark: SparkSession, manifest: Manifest, files: list[SourceFile], csv: bool
) -> Lines:
    """Lines of ``files`` with 1-based physical numbers.

    Set apart, to be read file by file: files with hidden names or a byte order
    mark. Of CSV files, those whose lines are not rows (quotes, inner carriage
    returns) are ``quoted``. Files with bytes that are not UTF-8 are void.
    """
    none = spark.createDataFrame([], LINE_DDL)
    marked = _marked_files(spark, manifest, files) if files else set()
    apart = [f for f in files if f.hidden or f.file_ord in marked]
    usual = [f for f in files if f not in apart]
    if not usual:
        return Lines(none, [], [], [], apart)
    text = split_lines(spark, usual).withColumn("at", F.monotonically_increasing_id())
    # Quotes, and carriage returns before the end.
    odd = F.col("value").rlike("\"|\r[\\s\\S]")
    splits = text.groupBy("name", "split").agg(
        F.count(F.lit(1)).alias("n"),
        F.min("at").alias("first_at"),
        F.max(~F.is_valid_utf8("value")).alias("bad"),
        F.max(odd if csv else F.lit(False)).alias("odd"),
    )
    before = Window.partitionBy("name").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    starts = splits.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0)))
    starts = stage(starts)  # a few numbers per split, read three times
    flags = starts.groupBy("name").agg(F.max("bad").alias("bad"), F.max("odd").alias("odd"))
    flagged = {r.name: r for r in flags.filter("bad or odd").collect()}  # at most one per file
    bad = [f for f in usual if f.name in flagged and flagged[f.name].bad]
    quoted = [f for f in usual if f.name in flagged and f not in bad]
    plain = [f for f in usual if f.name not in flagged]
    if not plain:
        return Lines(none, [], bad, quoted, apart)
    placed = starts.select("name", "split", "first_at", "base").join(
        F.broadcast(manifest.frame(spark, plain).select("file_ord", "path", "name")), "name"
    )
    if placed.count() <= BROADCAST_SPLITS:
        placed = F.broadcast(placed)
    lines = text.join(placed, ["name", "split"]).select(
        "file_ord",
        "path",
        (F.col("base") + F.col("at") - F.col("first_at") + 1).alias("line_number"),
        "value",
    )
    return Lines(lines, plain, bad, quoted, apart)


def bytes_problem(uri: str) -> str | None:
    """The first UTF-8 error of a file."""
    with open_file(uri) as stream:
        try:
            for _ in text_chunks(stream):
                pass
        except BadBytes as exc:
            return str(exc)
    return None


def void_file_rows(template: str):
    """Row function for files that are void because of bad bytes."""

    def rows(file_ord: int, path: str, uri: str):
        yield {
            "file_ord": file_ord, "path": path, "pos": 0, "line_number": None,
            "array_index": None, "fields": None, "field_name": None,
            "detail": template.format(bytes_problem(uri)),
        }

    return rows
