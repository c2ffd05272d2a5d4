"""Small helpers that several operators share."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tamis.staging import give_back, new_folder

# A task works on texts in slices of about this many bytes, so its memory does not follow the table.
SLICE_BYTES = 4_000_000


def partitions_for(spark: SparkSession, rows: int, rows_each: int = 1_000_000) -> int:
    """The session's number of shuffle partitions, or more where each would hold too many rows."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // rows_each))


def row_keys(doc_id: str, text: str) -> list[Column]:
    """Two columns that identify a row by id and text; rows that agree in both are the same row."""
    return [
        F.xxhash64(F.col(doc_id), F.col(text)).alias("row_key"),
        F.hash(F.col(text), F.col(doc_id)).alias("row_key2"),
    ]


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """Column names like the wanted ones that ``df`` does not have yet."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def rows_in(docs: DataFrame, keys: DataFrame, doc_id: str, text: str, how: str = "left_semi") -> DataFrame:
    """The rows of docs whose row keys are (``left_semi``) or are not (``left_anti``) in ``keys``
    (row_key, row_key2). No column of docs is touched, whatever its name."""
    names = free_names(docs, "row_key", "row_key2", "key", "key2")
    key, key2 = row_keys(doc_id, text)
    keyed = docs.withColumn(names[0], key).withColumn(names[1], key2)
    other = keys.select(F.col("row_key").alias(names[2]), F.col("row_key2").alias(names[3])).distinct()
    match = (F.col(names[0]) == F.col(names[2])) & (F.col(names[1]) == F.col(names[3]))
    return keyed.join(other, match, how).drop(*names[:2])


def map_batches(
    df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema
) -> DataFrame:
    """``df.mapInArrow``, whose tasks give back at their end what they have used."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return df.mapInArrow(task, schema)


def text_slices(
    batches: Iterator[pa.RecordBatch], text: str, limit: int = SLICE_BYTES
) -> Iterator[pa.Table]:
    """Cut record batches so that the texts of a slice hold about ``limit`` bytes.

    After each batch the memory of those before is given back.
    """
    for batch in batches:
        give_back()
        sizes = pa.compute.binary_length(batch.column(text)).to_pylist()
        start, held = 0, 0
        for i, n in enumerate(sizes):
            if held and held + (n or 0) > limit:
                yield pa.Table.from_batches([batch.slice(start, i - start)])
                start, held = i, 0
            held += n or 0
        if start < batch.num_rows:
            yield pa.Table.from_batches([batch.slice(start)])
        del batch
    give_back()


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def stage_for_now(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """As stage_table, with the folder for ``discard``."""
    folder = new_folder(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder), folder


def discard(spark: SparkSession, *folders: str) -> None:
    """Remove staged tables that no later step reads, and shuffle files of finished jobs.

    Spark removes those when the driver's garbage is collected, which may be long after the next
    large shuffle.
    """
    for folder in folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    gc.collect()  # the Python side holds Java objects
    spark._jvm.System.gc()
