"""Which files a path stands for: format, size and status of each."""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from tamis import fixed
from tamis.config import effective_file_limit
from tamis.errors import FileTooLarge, NoSupportedFiles, PathNotFound
from tamis.sinks.files import hadoop_path

MAX_TASKS = 10_000
READABLE, SKIPPED, OVERSIZE = "readable", "skipped", "oversize"


def detect_format(path: str) -> str | None:
    """Format named by the final extension, ignoring case."""
    return fixed.EXTENSION_FORMATS.get(os.path.splitext(path)[1].lower())


@dataclass(frozen=True)
class SourceFile:
    file_ord: int
    path: str  # as the caller would write it
    uri: str  # with scheme, for opening on executors
    name: str
    length: int
    format: str | None
    status: str

    @property
    def hidden(self) -> bool:
        """Names that Spark's own readers ignore."""
        return self.name.startswith(("_", "."))


MANIFEST_DDL = (
    "file_ord int, path string, uri string, name string, length long, format string, status string"
)


@dataclass(frozen=True)
class Manifest:
    files: tuple[SourceFile, ...]

    def with_status(self, status: str) -> list[SourceFile]:
        return [f for f in self.files if f.status == status]

    def readable(self, fmt: str) -> list[SourceFile]:
        return [f for f in self.with_status(READABLE) if f.format == fmt]

    def frame(self, spark: SparkSession, files: list[SourceFile] | None = None) -> DataFrame:
        """The listed files as a table, about one file per partition."""
        chosen = list(self.files) if files is None else files
        rows = [
            (f.file_ord, f.path, f.uri, f.name, f.length, f.format, f.status) for f in chosen
        ]
        df = spark.createDataFrame(rows, MANIFEST_DDL)
        return df.repartition(min(len(rows), MAX_TASKS), "file_ord") if len(rows) > 1 else df


def list_files(
    spark: SparkSession, path: str, max_file_bytes: int | None = None
) -> Manifest:
    """Resolve a file, or the direct files of a folder in name order.

    A missing path, a folder without any file of a supported format, and a
    single file over the limit are errors. In a folder, files of other formats
    are skipped and ones over the limit, if there is one, set aside; each of them is an issue.
    """
    limit = effective_file_limit(max_file_bytes)
    target, fs = hadoop_path(spark, path)
    if not fs.exists(target):
        raise PathNotFound(path)
    single = not fs.getFileStatus(target).isDirectory()
    # Through the raw file system, since checksumming ones hide ".crc" files.
    raw = fs.getRawFileSystem() if hasattr(fs, "getRawFileSystem") else fs
    statuses = [fs.getFileStatus(target)] if single else list(raw.listStatus(target))
    entries = sorted(
        (s.getPath().getName(), s.getLen(), s.getPath().toString())
        for s in statuses
        if not s.isDirectory()
    )
    files = []
    for number, (name, length, uri) in enumerate(entries):
        fmt = detect_format(name)
        status = SKIPPED if fmt is None else OVERSIZE if limit is not None and length > limit else READABLE
        shown = path if single else os.path.join(path, name)
        if single and status == OVERSIZE:
            raise FileTooLarge(path, limit, length)
        files.append(SourceFile(number, shown, uri, name, length, fmt, status))
    if not single and all(f.status == SKIPPED for f in files):
        raise NoSupportedFiles(path)
    return Manifest(tuple(files))
