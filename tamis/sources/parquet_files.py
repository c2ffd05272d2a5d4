"""Parquet files through Spark's reader, with row group coordinates.

Footers are read in tasks, one small read per file. They show which files are
corrupt and where row groups start, and let files of one schema share one scan.
Row groups are then read ahead, each by a task of its own, to find those that
cannot be read; the readable groups of such files are decoded group by group,
since Spark's reader would fail on the whole scan.
"""

from __future__ import annotations

from collections import defaultdict

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tamis import fixed
from tamis.dataset import FIELD_DDL, TypedContent, type_tag
from tamis.functions.canonical import canonical
from tamis.functions.numbers import float_text
from tamis.sources.decode import DECODED_DDL, safe, tagged_record
from tamis.operators.skew import attach_by_key
from tamis.sources.manifest import Manifest, SourceFile
from tamis.staging import stage

ORDER_BITS = 40
# The row group starts of all files are broadcast if they have so many bytes at most.
BROADCAST_BYTES = 32_000_000
MAX_TASKS = 10_000
BATCH_ROWS = 8192
_BAD_DDL = "file_ord int, row_group int, detail string"
_FOOTER_DDL = (
    "file_ord int, name string, row_group int, first_row long, n_rows long, "
    "schema string, detail string"
)


def _open_parquet(uri: str) -> pq.ParquetFile:
    if uri.startswith("file:"):
        return pq.ParquetFile("/" + uri[5:].lstrip("/"))
    from pyarrow import fs

    filesystem, path = fs.FileSystem.from_uri(uri)
    return pq.ParquetFile(filesystem.open_input_file(path))


def footers(spark: SparkSession, manifest: Manifest, files: list[SourceFile]) -> DataFrame:
    """One row per row group, or per corrupt file."""

    def read(file: dict):
        base = {"file_ord": file["file_ord"], "name": file["name"]}
        try:
            parquet = _open_parquet(file["uri"])
            meta, schema = parquet.metadata, parquet.schema_arrow.remove_metadata().to_string()
        except Exception as exc:
            yield {**base, "detail": safe(fixed.DETAIL_PARQUET_FILE.format(exc))}
            return
        first = 0
        for group in range(meta.num_row_groups):
            n_rows = meta.row_group(group).num_rows
            yield {**base, "row_group": group, "first_row": first, "n_rows": n_rows, "schema": schema}
            first += n_rows

    fields = T.StructType.fromDDL(_FOOTER_DDL)
    names = fields.names

    def decode(batches):
        for batch in batches:
            for file in batch.to_pylist():
                rows = [{n: r.get(n) for n in names} for r in read(file)]
                yield pa.RecordBatch.from_pylist(rows, to_arrow_schema(fields))

    chosen = manifest.frame(spark, files).select("file_ord", "name", "uri")
    return chosen.mapInArrow(decode, _FOOTER_DDL)


def _spread(groups: DataFrame) -> DataFrame:
    """Row groups in tasks of a few groups each."""
    number = groups.count()
    return groups.repartition(max(1, min(number, MAX_TASKS)), "file_ord", "row_group")


def checked_groups(groups: DataFrame) -> DataFrame:
    """Row groups (file_ord, uri, row_group) that cannot be read: file_ord, row_group, detail.

    Every page is decoded, some thousand rows at a time, and dropped.
    """
    schema = to_arrow_schema(T.StructType.fromDDL(_BAD_DDL))

    def run(batches):
        for batch in batches:
            bad = []
            for row in batch.to_pylist():
                try:
                    for _ in _open_parquet(row["uri"]).iter_batches(BATCH_ROWS, [row["row_group"]], use_threads=False):
                        pass
                except Exception as exc:
                    detail = safe(fixed.DETAIL_PARQUET_GROUP.format(row["row_group"], exc))
                    bad.append({"file_ord": row["file_ord"], "row_group": row["row_group"], "detail": detail})
            yield pa.RecordBatch.from_pylist(bad, schema)

    return _spread(groups).mapInArrow(run, _BAD_DDL)


def tagged_fields(schema: T.StructType, names: list[str]) -> Column:
    """Typed columns as the ``fields`` array of schemaless records."""
    parts_of = TypedContent(schema, tuple(names))

    def one(name: str) -> Column:
        value, dtype = F.col(f"`{name}`"), schema[name].dataType
        tag = type_tag(dtype)
        none = F.lit(None).cast("string")
        if tag == "string":
            string, json = value, none
            parts, finite = F.lit(None).cast("array<string>"), F.lit(True)
        else:
            string = none
            if tag == "float":
                json, finite = float_text(value), ~F.coalesce(
                    F.isnan(value) | (F.abs(value) == float("inf")), F.lit(False)
                )
            elif tag == "integer" or tag == "boolean":
                json, finite = value.cast("string"), F.lit(True)
            elif isinstance(dtype, (T.ArrayType, T.MapType, T.StructType)):
                json = F.to_json(value, {"ignoreNullFields": "false"})
                finite = F.lit(True)
            else:
                json, finite = F.to_json(F.array(value.cast("string"))), F.lit(True)
                json = F.regexp_replace(json, r"^\[|\]$", "")
            text = parts_of.parts_array(name)
            parts = F.coalesce(text, F.array().cast("array<string>"))
        null = value.isNull()
        return F.struct(
            F.lit(name).alias("name"),
            F.when(null, F.lit("null")).otherwise(F.lit(tag)).alias("type"),
            string.alias("str"),
            F.when(null, F.lit("null")).otherwise(json).alias("json"),
            F.when(F.lit(tag != "string"), canonical(value, dtype)).alias("canon"),
            finite.alias("finite"),
            F.when(null, F.array().cast("array<string>")).otherwise(parts).alias("parts"),
        ).cast(FIELD_DDL)

    return F.array(*[one(n) for n in names])


def _group_rows(groups: DataFrame) -> DataFrame:
    """Rows of readable groups (file_ord, path, uri, row_group, first_row) of files that Spark cannot read as
    they are, because of unreadable groups or a name that it ignores."""
    schema = to_arrow_schema(T.StructType.fromDDL(DECODED_DDL))

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                index = 0
                base = {"file_ord": row["file_ord"], "path": row["path"], "array_index": row["row_group"],
                        "field_name": None, "detail": None}
                for part in _open_parquet(row["uri"]).iter_batches(BATCH_ROWS, [row["row_group"]], use_threads=False):
                    rows = [
                        {**base, "pos": row["first_row"] + index + i, "line_number": index + i, "fields": tagged_record(r)}
                        for i, r in enumerate(part.to_pylist())
                    ]
                    index += len(rows)
                    yield pa.RecordBatch.from_pylist(rows, schema)

    return _spread(groups).mapInArrow(run, DECODED_DDL)


def _last_start(starts: Column, at: Column, most: int) -> Column:
    """The place of the last of at most ``most`` sorted starts that is not behind ``at``.

    A binary search from the largest power of two downwards, as a column expression.
    """
    steps = F.array(*[F.lit(1 << b) for b in reversed(range(max(most - 1, 1).bit_length()))])

    def step(found: Column, width: Column) -> Column:
        return F.when(F.get(starts, found + width) <= at, found + width).otherwise(found)

    return F.aggregate(steps, F.lit(0), step)


def scan_parquet(
    spark: SparkSession, manifest: Manifest, files: list[SourceFile], check: bool = True
) -> tuple[list[tuple[DataFrame, list[str]]], DataFrame | None, DataFrame]:
    """``(typed scans, rows of files read apart, footers)``.

    A typed scan has the file columns plus ``_file_ord``, ``_path``,
    ``_row_group``, ``_row_index`` and ``_pos``.
    """
    found = stage(footers(spark, manifest, files))
    placed_files = manifest.frame(spark, files).select("file_ord", "path", "uri")
    if check:
        groups = found.filter("schema is not null").select("file_ord", "row_group").join(placed_files, "file_ord")
        bad = checked_groups(groups)
        found = stage(
            found.join(bad.withColumnRenamed("detail", "unreadable"), ["file_ord", "row_group"], "left")
            .withColumn("detail", F.coalesce("detail", "unreadable")).drop("unreadable")
        )
    per_file = {
        r.file_ord: r
        for r in found.groupBy("file_ord")
        .agg(
            F.max("schema").alias("schema"),
            F.max(F.col("detail").isNotNull()).alias("broken"),
        )
        .collect()
    }  # one row per file
    groups, apart = defaultdict(list), []
    for file in files:
        seen = per_file.get(file.file_ord)
        if seen is None or seen.schema is None:
            continue  # corrupt, or no row groups
        if seen.broken or file.hidden:
            apart.append(file)
        else:
            groups[seen.schema].append(file)
    # One row per file: where its row groups start, in order.
    starts = (
        found.filter("schema is not null").groupBy("file_ord", "name")
        .agg(
            F.array_sort(F.collect_list("first_row")).alias("_starts"),
            F.sum("n_rows").alias("_rows"),
            F.count(F.lit(1)).alias("_groups"),
        )
        .join(manifest.frame(spark, files).select("file_ord", "path"), "file_ord")
        .select(F.col("file_ord").alias("_file_ord"), F.col("path").alias("_path"), F.col("name").alias("_name"),
                "_starts", "_rows", "_groups")
    )
    starts = stage(starts)
    held, most = starts.agg(
        F.sum(8 * F.col("_groups") + F.length("_path") + F.length("_name") + 64), F.max("_groups")
    ).first()
    scans = []
    for same in groups.values():
        df = spark.read.parquet(*[f.uri for f in same])
        names = df.columns
        placed = df.withColumns(
            {"_name": F.col("_metadata.file_name"), "_at": F.col("_metadata.row_index")}
        )
        if held <= BROADCAST_BYTES:
            located = placed.join(F.broadcast(starts.drop("_rows", "_groups")), "_name")
        else:
            located = attach_by_key(placed, starts, "_name", "_rows", "_at")
        group = _last_start(F.col("_starts"), F.col("_at"), int(most))
        located = located.withColumn("_row_group", group).select(
            *[F.col(f"`{n}`") for n in names],
            "_file_ord",
            "_path",
            "_row_group",
            (F.col("_at") - F.get("_starts", F.col("_row_group"))).alias("_row_index"),
            F.col("_at").alias("_pos"),
        )
        scans.append((located, names))
    rows = None
    if apart:
        chosen = manifest.frame(spark, apart).select("file_ord", "path", "uri")
        good = found.filter("schema is not null and detail is null").select("file_ord", "row_group", "first_row")
        rows = _group_rows(good.join(chosen, "file_ord"))
    return scans, rows, found
