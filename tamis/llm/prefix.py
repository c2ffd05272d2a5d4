"""Running sums in a global order, without ever putting a whole group into one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tamis.llm.common import partitions_for
from tamis.staging import stage_table


def running_sums(
    df: DataFrame, order: list[str], values: dict[str, str], groups: list[str] | None = None,
    ranges: list[str] | None = None,
) -> DataFrame:
    """Add, per name in ``values``, the sum of its column over the rows before each row.

    Rows are ordered by ``order`` (nulls first), within equal ``groups`` columns if any are given.
    The table is range partitioned by ``ranges`` (default: ``groups`` and ``order``), each partition
    is summed by itself, and the sums of the partitions before it are added. No task holds more than
    a range partition, however large a group is. ``order`` should tell rows apart; rows it ties
    come in any order. An empty table gives an empty result.
    """
    spark = df.sparkSession
    groups = groups or []
    ranges = ranges or [*groups, *order]
    parts = partitions_for(spark, df.count())
    ranged = stage_table(
        df.repartitionByRange(parts, *ranges).withColumn("_part", F.spark_partition_id()), "ranged"
    )
    totals = ranged.groupBy(*groups, "_part").agg(
        *[F.sum(column).alias(f"_total_{name}") for name, column in values.items()]
    )
    # One row per partition (and per group that has rows in it).
    earlier = Window.partitionBy(*groups).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select(
        *[F.col(g).alias(f"_g{i}") for i, g in enumerate(groups)],
        F.col("_part").alias("_base_part"),
        *[F.coalesce(F.sum(f"_total_{n}").over(earlier), F.lit(0)).alias(f"_base_{n}") for n in values],
    )
    match = F.col("_part") == F.col("_base_part")
    for i, g in enumerate(groups):
        match &= F.col(g).eqNullSafe(F.col(f"_g{i}"))
    inside = (
        Window.partitionBy(*groups, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    )
    sums = [
        (F.col(f"_base_{n}") + F.coalesce(F.sum(c).over(inside), F.lit(0))).alias(n)
        for n, c in values.items()
    ]
    joined = ranged.join(F.broadcast(bases) if not groups else bases, match)
    return joined.select(*df.columns, *sums)
