"""Dense record positions without a global sort."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Bits of an order value below each level of counting. A group of any level has at most 2**16 members.
LEVELS = (16, 32, 48)


def record_positions(df: DataFrame) -> DataFrame:
    """``df`` (with a unique ``rec_ord``) plus ``rec_idx``, its 0-based position.

    The leading bits of ``rec_ord`` split records into leaves, leaves into groups and these into
    others. Order values are unique, so a leaf holds at most 2**16 records and every group at most
    2**16 members, whatever the table's size; counting by levels replaces one global window. Only
    ``rec_ord`` is shuffled for it.
    """
    keys = df.select("rec_ord", F.shiftright("rec_ord", LEVELS[0]).alias("l0"))
    counts = [keys.groupBy("l0").agg(F.count(F.lit(1)).alias("n"))]
    for i, (below, bits) in enumerate(zip(LEVELS, LEVELS[1:], strict=False), 1):
        grouped = counts[-1].withColumn(f"l{i}", F.shiftright(f"l{i - 1}", bits - below))
        counts[-1] = grouped
        counts.append(grouped.groupBy(f"l{i}").agg(F.sum("n").alias("n")))
    before = (Window.unboundedPreceding, -1)
    last = len(LEVELS) - 1
    whole = Window.partitionBy(F.lit(0)).orderBy(f"l{last}").rowsBetween(*before)
    starts = counts[last].select(f"l{last}", F.coalesce(F.sum("n").over(whole), F.lit(0)).alias("start"))
    for i in range(last - 1, -1, -1):
        inside = Window.partitionBy(f"l{i + 1}").orderBy(f"l{i}").rowsBetween(*before)
        starts = counts[i].join(starts, f"l{i + 1}").select(
            f"l{i}", (F.col("start") + F.coalesce(F.sum("n").over(inside), F.lit(0))).alias("start")
        )
    within = Window.partitionBy("l0").orderBy("rec_ord")
    numbered = keys.withColumn("in_leaf", F.row_number().over(within) - 1)
    positions = numbered.join(starts, "l0").select(
        "rec_ord", (F.col("start") + F.col("in_leaf")).alias("rec_idx")
    )
    return positions if df.columns == ["rec_ord"] else df.join(positions, "rec_ord")
