"""Ordered text output."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def hadoop_path(spark: SparkSession, path: str):
    """A Hadoop path and its file system."""
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    return hadoop, hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def name_parts(spark: SparkSession, path: str, extension: str) -> list[str]:
    """Give the part files of a finished write short names that sort in order."""
    folder, fs = hadoop_path(spark, path)
    parts = sorted(
        s.getPath().getName()
        for s in fs.listStatus(folder)
        if s.getPath().getName().startswith("part-")
    )
    named = []
    for number, part in enumerate(parts):
        target = f"part-{number:06d}.{extension}"
        source, _ = hadoop_path(spark, f"{path}/{part}")
        renamed, _ = hadoop_path(spark, f"{path}/{target}")
        fs.rename(source, renamed)
        named.append(f"{path}/{target}")
    return named


def write_lines(lines: DataFrame, order: list[str], path: str, extension: str) -> list[str]:
    """Write the ``line`` column sorted by ``order``; part names sort the same way."""
    lines.orderBy(*order).select("line").write.text(path)
    return name_parts(lines.sparkSession, path, extension)
