"""From a path to a dataset: every readable file, in name order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tamis import fixed
from tamis.dataset import FIELD_DDL, Dataset, TaggedContent, TypedContent
from tamis.issues import LOC_DDL, PARSE, issue, literal_issues, order_key
from tamis.sources.csv_files import scan_csv
from tamis.sources.json_array import scan_json
from tamis.sources.jsonl import scan_jsonl
from tamis.sources.manifest import OVERSIZE, READABLE, SKIPPED, list_files
from tamis.sources.parquet_files import ORDER_BITS, scan_parquet, tagged_fields
from tamis.staging import stage_table


def _location(path: Column, line=None, index=None, group=None, row=None) -> Column:
    none = F.lit(None)
    return F.struct(
        path.alias("source_file"),
        (none if line is None else line).cast("bigint").alias("line_number"),
        (none if index is None else index).cast("bigint").alias("array_index"),
        (none if group is None else group).cast("int").alias("row_group"),
        (none if row is None else row).cast("bigint").alias("row_index"),
    ).cast(LOC_DDL)


def _record_order(file_ord: Column, pos: Column) -> Column:
    return F.shiftleft(file_ord.cast("bigint"), ORDER_BITS) + pos


def _parse_issues(rows: DataFrame, loc: Column, pos: Column) -> DataFrame:
    return rows.select(
        issue(
            "parse_error",
            order_key(PARSE, _record_order(F.col("file_ord"), F.lit(0)), pos),
            loc=loc,
            field_name=F.col("field_name"),
            detail=F.col("detail"),
        ).alias("issue")
    ).select("issue.*")


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def read_records(
    spark: SparkSession,
    path: str,
    max_file_bytes: int | None = None,
    check_row_groups: bool = True,
    keep: bool = True,
) -> Dataset:
    """Read a file, or the direct files of a folder, as one dataset.

    Parquet of a single schema stays typed. JSON and CSV are decoded in Python,
    so with ``keep`` the decoded rows are staged once instead of being decoded
    by every operator. Unreadable Parquet row groups are issues; finding them reads
    the data ahead, a task per row group. Without ``check_row_groups`` it is read
    once, and an unreadable group fails the first job that meets it.
    """
    manifest = list_files(spark, path, max_file_bytes)
    decoded, issues, records = [], [], []
    for fmt, scan in (("json", scan_json), ("jsonl", scan_jsonl), ("csv", scan_csv)):
        files = manifest.readable(fmt)
        if files:
            decoded.append(scan(spark, manifest, files))
    if decoded:
        rows = _union(decoded)
        rows = stage_table(rows, "decoded") if keep else rows
        pos = F.col("pos")
        loc = _location(F.col("path"), F.col("line_number"), F.col("array_index"))
        records.append(
            rows.filter("fields is not null").select(
                _record_order(F.col("file_ord"), pos).alias("rec_ord"), loc.alias("loc"), "fields"
            )
        )
        issues.append(_parse_issues(rows.filter("detail is not null"), loc, pos))
    content = TaggedContent()
    files = manifest.readable("parquet")
    if files:
        scans, apart, found = scan_parquet(spark, manifest, files, check_row_groups)
        group = F.col("row_group")
        issues.append(
            _parse_issues(
                found.filter("detail is not null").withColumn("field_name", F.lit(None)),
                _location(_path_of(manifest), group=group),
                F.coalesce("first_row", F.lit(0)),
            )
        )
        order = _record_order(F.col("_file_ord"), F.col("_pos")).alias("rec_ord")
        place = _location(
            F.col("_path"), group=F.col("_row_group"), row=F.col("_row_index")
        ).alias("loc")
        if len(scans) == 1 and not records and apart is None:
            scan, names = scans[0]
            df = scan.select(order, place, *[F.col(f"`{n}`") for n in names])
            content = TypedContent(df.schema, tuple(names))
            records.append(df)
        else:
            for scan, names in scans:
                fields = tagged_fields(scan.schema, names).alias("fields")
                records.append(scan.select(order, place, fields))
            if apart is not None:
                loc = _location(F.col("path"), group=F.col("array_index"), row=F.col("line_number"))
                records.append(
                    apart.select(
                        _record_order(F.col("file_ord"), F.col("pos")).alias("rec_ord"),
                        loc.alias("loc"),
                        "fields",
                    )
                )
    oversize = [
        {
            "category": "parse_error",
            "loc": (f.path, None, None, None, None),
            "detail": fixed.ERROR_SIZE.format(f.path, max_file_bytes, f.length),
            "issue_ord": (PARSE, f.file_ord << ORDER_BITS, 0, 0),
        }
        for f in manifest.with_status(OVERSIZE)
    ]
    if oversize:
        issues.append(literal_issues(spark, oversize))
    if not records:
        empty = "rec_ord long, loc " + LOC_DDL + ", fields array<" + FIELD_DDL + ">"
        records.append(spark.createDataFrame([], empty))
    return Dataset(
        _union(records),
        content,
        [f.path for f in manifest.with_status(READABLE)],
        [f.path for f in manifest.with_status(SKIPPED)],
        [f.path for f in manifest.with_status(OVERSIZE)],
        _union(issues) if issues else literal_issues(spark, []),
    )


def _path_of(manifest) -> Column:
    """Path of a footer row, by its file name within the folder."""
    folder = manifest.files[0].path[: -len(manifest.files[0].name)]
    return F.concat(F.lit(folder), F.col("name"))
