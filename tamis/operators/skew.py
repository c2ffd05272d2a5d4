"""Joins on a key of which one value may hold a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamis.staging import stage

HOT_KEYS = 1000
HOT_WEIGHT = 10_000
_SALTS = 1 << 30


def attach_by_key(
    rows: DataFrame, table: DataFrame, key: str, weight: str, spread: str | Column
) -> DataFrame:
    """Left join ``rows`` with ``table`` (one row per key), safe for hot keys.

    ``weight`` says how many rows have each key. The heaviest keys, at most
    ``HOT_KEYS`` of them, are broadcast; any other key then has at most one
    thousandth of all rows (or under ``HOT_WEIGHT``) and goes through the
    shuffle. Rows already served by the broadcast are spread over all shuffle
    partitions by a salt that matches nothing, so they never meet in one task.
    """
    payload = [c for c in table.columns if c != key]
    hot = (
        table.filter(F.col(weight) >= HOT_WEIGHT)
        .orderBy(F.col(weight).desc(), F.col(key))
        .limit(HOT_KEYS)
        .select(key, F.struct(*payload).alias("_hot"))
    )
    cold = table.select(key, F.lit(-1).alias("_salt"), F.struct(*payload).alias("_cold"))
    salt = F.when(F.col("_hot").isNull(), F.lit(-1)).otherwise(
        F.pmod(F.xxhash64(spread), F.lit(_SALTS)).cast("int")
    )
    joined = (
        rows.join(F.broadcast(hot), key, "left")
        .withColumn("_salt", salt)
        .join(cold, [key, "_salt"], "left")
    )
    found = F.coalesce("_hot", "_cold")
    return joined.select(*rows.columns, *[found[c].alias(c) for c in payload])


BLOCK_ROWS = 4096
BROADCAST_KEYS = 1_000_000


def in_blocks(rows: DataFrame, key: str, spread: str) -> DataFrame:
    """Prepare a self-join on ``key`` so that no task compares a whole hot group.

    A group of n rows is cut into ``n / BLOCK_ROWS`` blocks by a hash of
    ``spread`` and every pair of its blocks becomes a join key of its own: rows
    gain ``_block`` and the pair ``_lo, _hi``, one copy per pair. Groups of up to
    ``BLOCK_ROWS`` rows stay as they are. Join on ``block_keys`` and keep
    ``met_once``. ``rows`` should be staged, as it is read to count and to join.
    """
    sizes = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter(
        F.col("_n") > BLOCK_ROWS
    )
    hot = stage(sizes.select(key, F.ceil(F.col("_n") / BLOCK_ROWS).cast("int").alias("_blocks")))
    known = hot.count()
    if known == 0:
        zero = F.lit(0)
        return rows.withColumns({"_block": zero, "_lo": zero, "_hi": zero})
    joined = rows.join(F.broadcast(hot) if known <= BROADCAST_KEYS else hot, key, "left")
    blocks = F.coalesce("_blocks", F.lit(1))
    placed = joined.withColumn("_block", F.pmod(F.xxhash64(spread), blocks).cast("int"))
    paired = placed.withColumn("_other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    return paired.withColumns(
        {"_lo": F.least("_block", "_other"), "_hi": F.greatest("_block", "_other")}
    ).drop("_blocks", "_other")


def block_keys(left: str, right: str, key: str) -> Column:
    """Equality of the join key and of the block pair."""
    same = F.lit(True)
    for name in (key, "_lo", "_hi"):
        same = same & (F.col(f"{left}.{name}") == F.col(f"{right}.{name}"))
    return same


def met_once(left: str, right: str) -> Column:
    """Two rows of one block meet under many block pairs; keep only their own."""
    return (F.col(f"{left}._block") != F.col(f"{right}._block")) | (
        F.col(f"{left}._lo") == F.col(f"{left}._hi")
    )


def crowded_keys(left: DataFrame, right: DataFrame | None, key: str) -> DataFrame | None:
    """Keys with more than ``BLOCK_ROWS`` rows on a side that meet, with the blocks of both sides.

    ``right`` is None where it has one row per key. None if there is no such key, as usual.
    """
    counts = left.groupBy(key).agg(F.count(F.lit(1)).alias("_l"))
    if right is None:
        counts = counts.filter(F.col("_l") > BLOCK_ROWS).withColumn("_r", F.lit(1))
    else:
        others = right.groupBy(key).agg(F.count(F.lit(1)).alias("_r"))
        counts = counts.join(others, key).filter(F.greatest("_l", "_r") > BLOCK_ROWS)
    crowded = stage(
        counts.select(
            key,
            F.ceil(F.col("_l") / BLOCK_ROWS).cast("int").alias("_l_blocks"),
            F.ceil(F.col("_r") / BLOCK_ROWS).cast("int").alias("_r_blocks"),
            F.greatest("_l", "_r").alias("_weight"),
        )
    )
    return None if crowded.isEmpty() else crowded


def join_in_blocks(
    left: DataFrame, right: DataFrame, key: str, crowded: DataFrame | None, left_spread: str, right_spread: str
) -> DataFrame:
    """Inner join on ``key`` where many rows of both sides may share a value.

    Both sides of a crowded key (see ``crowded_keys``) are cut into blocks by a hash of their spread
    columns, and every pair of blocks is a join key of its own, so no task joins a whole hot key.
    """
    if crowded is None:
        return left.join(right, key)

    def placed(rows: DataFrame, own: str, other: str, spread: str, mine: str, theirs: str) -> DataFrame:
        known = attach_by_key(rows, crowded, key, "_weight", spread)
        block = F.pmod(F.xxhash64(spread), F.coalesce(own, F.lit(1))).cast("int")
        copies = F.explode(F.sequence(F.lit(0), F.coalesce(other, F.lit(1)) - 1))
        return known.withColumn(mine, block).withColumn(theirs, copies).drop("_l_blocks", "_r_blocks", "_weight")

    x = placed(left, "_l_blocks", "_r_blocks", left_spread, "_l_block", "_r_block")
    y = placed(right, "_r_blocks", "_l_blocks", right_spread, "_r_block", "_l_block")
    return x.join(y, [key, "_l_block", "_r_block"]).drop("_l_block", "_r_block")
