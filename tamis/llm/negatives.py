"""Hard negatives: rows of another label that score nearly as high as an anchor's positives.

Each positive of an anchor opens a window of scores, from a lower to an upper share of its own score, and
asks for the highest rows in it. The upper limits of an anchor's positives split the scores into slots that
do not overlap. Tasks and the shuffle's combiners keep the best k rows of each slot only. Merged from the
lowest slot upwards, the best k of slot j and all slots below it are the best rows up to the window's upper
limit; what lies below its lower limit is cut off. So overlapping windows share one pass over the rows and
one bounded list.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tamis.llm.stripes import Candidates, against_all, best, in_parts, matrix, whole_components
from tamis.staging import stage_table

SCALE = 256
POSITIVES = 5
K = 10
LEAST, MOST = 30, 90  # per cent of the positive's score


def _by_label(table: pa.Table) -> tuple[pa.Table, np.ndarray, dict[int, slice]]:
    """The rows sorted by label, their ids, and the place of each label."""
    table = table.sort_by("label")
    labels = table["label"].to_numpy()
    values, starts = np.unique(labels, return_index=True)
    ends = [*starts[1:].tolist(), len(labels)]
    places = {int(x): slice(a, b) for x, a, b in zip(values, starts.tolist(), ends, strict=True)}
    return table, table["id"].to_numpy(), places


def _emitted(found: list[tuple], names: tuple[str, ...]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(
        {n: np.concatenate(c).astype(np.int64) for n, c in zip(names, zip(*found, strict=True), strict=True)}
    )


def _positives(vectors: DataFrame, anchors: DataFrame, number: int) -> DataFrame:
    """q, positives: the best other rows of the anchor's label, as (score, id), in order."""

    def work(stripe: pa.Table, queries: Iterator[pa.Table]) -> Iterator[pa.RecordBatch]:
        stripe, ids, places = _by_label(stripe)
        held, nothing = Candidates(matrix(stripe["v"])), slice(0, 0)
        for batch in queries:
            for part in in_parts(batch.sort_by("label"), len(ids)):
                labels, asked = part["label"].to_numpy(), matrix(part["v"])
                found = []
                for label in np.unique(labels):
                    mine, at = np.flatnonzero(labels == label), places.get(int(label), nothing)
                    scores = held.scores(asked[mine], at)
                    for row, q in enumerate(mine):
                        others = np.flatnonzero(ids[at] != part["id"][int(q)].as_py())
                        top = others[best(scores[row][others], ids[at][others], number)]
                        found.append((np.full(len(top), part["q"][int(q)].as_py()), ids[at][top], scores[row][top]))
                if found:
                    yield _emitted(found, ("q", "id", "score"))

    found = against_all(vectors, anchors, work, "q long, id long, score long")
    order = Window.partitionBy("q").orderBy(F.desc("score"), "id")  # tasks keep the first rows before the shuffle
    ranked = found.withColumn("at", F.row_number().over(order)).where(F.col("at") <= number)
    listed = F.array_sort(F.collect_list(F.struct("at", "score", "id")))
    return ranked.groupBy("q").agg(listed.alias("positives"))


def _share(score: Column, percent: int, up: bool) -> Column:
    """percent * score / 100 as a whole number, rounded up or down."""
    exact = score.cast("decimal(20,0)") * F.lit(percent) / F.lit(100)
    return (F.ceil(exact) if up else F.floor(exact)).cast("long")


def _slots(vectors: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """q, found: the best k rows of another label in each slot, as (slot, less, id); less orders the other way (~score).

    Slot j holds the scores up to the j-th upper limit and above the next; rows below every window are
    left out.
    """

    def work(stripe: pa.Table, queries: Iterator[pa.Table]) -> Iterator[pa.RecordBatch]:
        stripe, ids, places = _by_label(stripe)
        held = Candidates(matrix(stripe["v"]))
        for batch in queries:
            for part in in_parts(batch, len(ids)):
                scores, found = held.scores(matrix(part["v"])), []
                for row, query in enumerate(part.drop_columns("v").to_pylist()):
                    own = places.get(query["label"], slice(0, 0))
                    other = scores[row].copy()
                    uppers, floor = query["uppers"], query["least"]
                    inside = (other <= uppers[0]) & (other >= floor)
                    inside[own] = False
                    at = np.flatnonzero(inside)
                    other = other[at]
                    for slot, upper in enumerate(uppers):
                        below = uppers[slot + 1] if slot + 1 < len(uppers) else floor - 1
                        here = np.flatnonzero((other <= upper) & (other > below))
                        top = here[best(other[here], ids[at][here], k)]
                        if len(top):
                            found.append(
                                (np.full(len(top), query["q"]), np.full(len(top), slot), ids[at][top], other[top])
                            )
                if found:
                    yield _emitted(found, ("q", "slot", "id", "score"))

    found = against_all(vectors, asked, work, "q long, slot long, id long, score long")
    order = Window.partitionBy("q", "slot").orderBy(F.desc("score"), "id")
    kept = found.withColumn("at", F.row_number().over(order)).where(F.col("at") <= k)
    return kept.groupBy("q").agg(  # at most k rows a slot, and a slot for each positive at most
        F.collect_list(F.struct("slot", F.bitwise_not("score").alias("less"), "id")).alias("found")
    )


def hard_negatives(
    vectors: DataFrame, anchors: DataFrame, k: int = K, positives: int = POSITIVES, least: int = LEAST,
    most: int = MOST, scale: int = SCALE, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label",
) -> DataFrame:
    """anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score.

    Scores are integer inner products with the anchor of components floor(scale * x); higher ones come
    first, ties by smaller id. An anchor's positives are its first rows of the same label and of other ids.
    A positive's negatives are the first k rows of other labels whose scores lie between ``least`` and
    ``most`` per cent of the positive's; a window without rows gives none.

    Rows with a null id, label or vector, or with a null or non-finite component, take no part, as anchors
    or otherwise. Missing components of shorter vectors count as 0. Components and scores beyond 64 bits
    are held to the nearest such number. Every anchor row answers for itself, also if its id occurs again;
    repeated rows are rows of their own, as positives and as negatives. Other columns are not read. Empty
    tables give no rows.
    """

    def usable(df: DataFrame) -> DataFrame:
        rows = df.select(
            F.col(vec_id).cast("long").alias("id"), F.col(label).cast("long").alias("label"),
            whole_components(F.col(embedding), scale).alias("v"),
        )
        return rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull())

    held = stage_table(usable(vectors).select(F.struct("id", "label").alias("row"), "v"), "candidates")
    asked = usable(anchors).withColumn("q", F.monotonically_increasing_id())
    asked = stage_table(asked.select(F.struct("q", "id", "label").alias("row"), "v"), "anchors")
    first = _positives(held, asked, positives)
    upper = lambda p: _share(p["score"], most, up=False)
    lower = lambda p: _share(p["score"], least, up=True)
    windows = first.select(
        "q", "positives",
        F.reverse(F.array_sort(F.array_distinct(F.transform("positives", upper)))).alias("uppers"),
        F.array_min(F.transform("positives", lower)).alias("least"),
    )
    opened = stage_table(
        asked.select("row.*", "v").join(windows, "q").select("q", "id", "label", "positives", "uppers", "least", "v"),
        "windows",
    )
    found = _slots(held, opened.select(F.struct("q", "label", "uppers", "least").alias("row"), "v"), k)
    # From the lowest slot upwards: element j of the result is the best k of slot j and all below.
    entry = "struct<slot: bigint, less: bigint, id: bigint>"
    merged = F.aggregate(
        F.sequence(F.size("uppers") - 1, F.lit(0), F.lit(-1)),
        F.array().cast(f"array<array<{entry}>>"),
        lambda done, slot: F.concat(
            F.array(F.slice(F.array_sort(F.transform(
                F.concat(
                    F.filter("found", lambda x: x["slot"] == slot),
                    F.coalesce(F.get(done, F.lit(0)), F.array().cast(f"array<{entry}>")),
                ),
                lambda x: F.struct(F.lit(0).cast("bigint").alias("slot"), x["less"].alias("less"), x["id"].alias("id")),
            )), 1, k)),
            done,
        ),
    )
    answered = opened.drop("v").join(found, "q").withColumn("merged", merged)
    each = answered.select("id", "uppers", "merged", F.explode("positives").alias("p"))
    reach = F.get("merged", F.array_position("uppers", upper(F.col("p"))).cast("int") - 1)
    inside = F.filter(reach, lambda x: F.bitwise_not(x["less"]) >= lower(F.col("p")))
    return each.select("id", "p", F.posexplode(inside).alias("place", "negative")).select(
        F.col("id").alias("anchor_id"), F.col("p.id").alias("positive_id"), (F.col("place") + 1).alias("rank"),
        F.col("negative.id").alias("negative_id"), F.col("p.score").alias("positive_score"),
        F.bitwise_not("negative.less").alias("negative_score"),
    )
