"""A stated set of queries against all rows, without a pair of rows in any shuffle.

Candidate vectors are dealt evenly into stripes, one task each, that hold a bounded number of components.
The queries visit every stripe as a stream behind its candidates: a task reads its candidates into one
matrix and then scores batch after batch of queries. So the candidates move once, the queries once per
stripe, and no task's memory follows the table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamis.llm.common import partitions_for

# Components that a stripe holds (64 MB), and scores that a task holds at a time (16 MB).
STRIPE_COMPONENTS = 8_000_000
HELD_SCORES = 2_000_000
_LONG = 2**63 - 1


def whole_components(embedding: Column, scale: int) -> Column:
    """floor(scale * x) of each component, or null if there is no vector or one component is no number."""
    usable = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.when(usable, F.transform(embedding, lambda x: F.floor(x.cast("double") * scale)))


def matrix(vectors: pa.Array, width: int | None = None) -> np.ndarray:
    """Lists of numbers as the rows of a matrix; missing components are 0."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    sizes = np.diff(vectors.offsets.to_numpy()) if len(vectors) else np.zeros(0, np.int64)
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False)
    widest = int(sizes.max(initial=0))
    out = np.zeros((len(vectors), max(width or 0, widest)), np.int64)
    if len(sizes) and (sizes == widest).all():
        out[:, :widest] = flat.reshape(len(vectors), widest)
    else:
        row = np.repeat(np.arange(len(sizes)), sizes)
        out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


class Candidates:
    """The vectors of a stripe, ready for exact inner products."""

    def __init__(self, values: np.ndarray):
        self.values = values
        self.largest = int(max(values.max(initial=0), -int(values.min(initial=0))))
        self.floats = values.T.astype(np.float64)

    def scores(self, queries: np.ndarray, at: slice = slice(None)) -> np.ndarray:
        """Inner products of all queries with the candidates at ``at``, held to 64 bits."""
        width = min(queries.shape[1], self.values.shape[1])
        queries = queries[:, :width]
        largest = int(max(queries.max(initial=0), -int(queries.min(initial=0)))) * self.largest * max(width, 1)
        if largest < 2**53:  # every partial sum is a whole number that a double holds
            return (queries.astype(np.float64) @ self.floats[:width, at]).astype(np.int64)
        if largest < 2**63:
            return queries @ self.values[at, :width].T
        exact = queries.astype(object) @ self.values[at, :width].T.astype(object)
        return np.clip(exact, -_LONG - 1, _LONG).astype(np.int64)


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to smaller ids, in that order."""
    at = np.arange(len(scores))
    if len(scores) > k:
        at = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    return at[np.lexsort((ids[at], ~scores[at]))][:k]


def against_all(
    candidates: DataFrame, queries: DataFrame,
    work: Callable[[pa.Table, Iterator[pa.Table]], Iterator[pa.RecordBatch]], schema: str,
) -> DataFrame:
    """Run ``work`` on each stripe of ``candidates`` with a stream of all ``queries``.

    Both tables are staged ones with a column ``v`` (array of long) and a like-named struct of other
    columns each, ``row``. ``work`` gets a stripe's candidates and the batches of queries.
    """
    total = candidates.agg(F.sum(F.size("v") + 1)).first()[0] or 0
    stripes = partitions_for(candidates.sparkSession, total, STRIPE_COMPONENTS)
    # Rows are dealt by their place in the staged files, so no repeated row or value makes a stripe larger.
    dealt = candidates.select(
        F.pmod(F.monotonically_increasing_id(), F.lit(stripes)).cast("int").alias("stripe"), F.lit(0).alias("side"),
        F.col("row").alias("candidate"), F.lit(None).cast(queries.schema["row"].dataType).alias("query"), "v",
    )
    asked = queries.select(
        F.explode(F.sequence(F.lit(0), F.lit(stripes - 1))).alias("stripe"), F.lit(1).alias("side"),
        F.lit(None).cast(candidates.schema["row"].dataType).alias("candidate"), F.col("row").alias("query"), "v",
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        waiting: list[pa.RecordBatch] = []
        for batch in batches:
            first = int(np.searchsorted(batch.column("side").to_numpy(), 1))
            if first:
                held.append(batch.slice(0, first))
            if first < batch.num_rows:
                waiting.append(batch.slice(first))
                break
        if not held or not waiting:
            return

        def of(part: pa.RecordBatch, name: str) -> pa.Table:
            columns = part.column(name).flatten()
            names = [f.name for f in part.schema.field(name).type]
            return pa.Table.from_arrays([*columns, part.column("v")], names=[*names, "v"])

        stream = (of(part, "query") for source in (waiting, batches) for part in source)
        yield from work(pa.concat_tables([of(part, "candidate") for part in held]).combine_chunks(), stream)

    together = dealt.unionByName(asked).repartitionById(stripes, "stripe").sortWithinPartitions("side")
    return together.mapInArrow(run, schema)


def in_parts(queries: pa.Table, candidates: int) -> Iterator[pa.Table]:
    """Cut a batch of queries so that its scores against so many candidates stay bounded."""
    step = max(1, HELD_SCORES // max(candidates, 1))
    for start in range(0, queries.num_rows, step):
        yield queries.slice(start, step).combine_chunks()

