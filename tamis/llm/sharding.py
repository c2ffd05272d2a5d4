"""Contiguous shards of nearly equal bytes, by global prefix sums. DataFrame functions only.

Each range partition of the documents is summed by itself; the sums of the partitions before it
give every document its place in the whole byte sequence, which is cut at equal targets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamis.llm.prefix import running_sums
from tamis.staging import stage_table

ROW_OVERHEAD = 16


def shard_of(shards: int, total: int) -> Column:
    """The shard that holds the middle of a row's bytes, from its columns ``_before`` and ``size``.

    Whole-number division: a quotient of limited digits would round up to the next shard.
    """
    return F.expr(
        f"((2 * cast(_before AS decimal(38, 0)) + size) * {shards} div cast({2 * total} AS decimal(38, 0)))"
    ).cast("int")


def shard_by_bytes(
    docs: DataFrame, shards: int, doc_id: str = "doc_id", text: str = "text",
    overhead: int = ROW_OVERHEAD,
) -> DataFrame:
    """Deal documents, in the order of their ids, to ``shards`` runs of nearly equal size.

    A row's size is its text's UTF-8 bytes plus ``overhead``. A row goes to the shard that holds the
    middle of its bytes, so a shard is off its target by less than one row on either side. Columns:
    doc_id, size, text_crc32, shard (from 0), slot (place in the shard, gapless from 0).

    Null and empty texts have the overhead alone as size and checksum 0; null ids come first; rows
    with equal ids follow each other by checksum and size; identical rows each get a slot. A row
    larger than a target leaves shards empty. Other columns are not read. No rows give no rows.
    """
    if shards < 1 or overhead < 1:
        raise ValueError("shards and overhead must be positive")
    narrow = stage_table(
        docs.select(
            F.col(doc_id).alias("doc_id"),
            (F.coalesce(F.octet_length(text), F.lit(0)) + F.lit(overhead)).cast("long").alias("size"),
            F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32"),
            F.monotonically_increasing_id().alias("_tie"),
            F.lit(1).cast("long").alias("_one"),
        ),
        "sizes",
    )
    total = narrow.agg(F.sum("size")).first()[0] or 1
    placed = running_sums(
        narrow, ["doc_id", "text_crc32", "size", "_tie"], {"_before": "size", "_row": "_one"}
    )
    placed = stage_table(
        placed.withColumn("shard", shard_of(shards, total)).select("doc_id", "size", "text_crc32", "shard", "_row"),
        "placed",
    )
    first = placed.groupBy("shard").agg(F.min("_row").alias("_first"))  # at most ``shards`` rows
    return placed.join(F.broadcast(first), "shard").select(
        "doc_id", "size", "text_crc32", "shard", (F.col("_row") - F.col("_first")).alias("slot")
    )
