"""Connected components by minimum labels and pointer jumping, as DataFrame jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamis.staging import stage_table


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b: long) to (node, label): the smallest node that is reachable.

    Nodes without edges are not in the result. Repeated edges and loops are allowed.
    """
    both = stage_table(
        edges.select("a", "b").union(edges.select("b", "a")).where(F.col("a") != F.col("b")).distinct(), "edges"
    )
    labels = stage_table(
        both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least"))
        .select("node", F.least("node", "least").alias("label")),
        "labels",
    )
    while True:
        offered = (
            both.join(labels, F.col("b") == F.col("node")).groupBy(F.col("a").alias("to"))
            .agg(F.min("label").alias("offer"))
        )
        lower = labels.join(offered, F.col("node") == F.col("to"), "left").select(
            "node", F.least("label", "offer").alias("label"), F.col("label").alias("before")
        )
        # A label's own label is one too.
        after = stage_table(
            lower.join(
                lower.select(F.col("node").alias("of"), F.col("label").alias("theirs")),
                F.col("label") == F.col("of"), "left",
            ).select("node", F.least("label", "theirs").alias("label"), "before"),
            "labels",
        )
        labels = after.select("node", "label")
        if after.where("label <> before").isEmpty():
            return labels
