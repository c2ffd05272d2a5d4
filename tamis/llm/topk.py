"""Exact top-k inner products by term-at-a-time accumulation.

Vectors are quantised; every dimension is a term. Candidates are dealt into stripes that visiting queries
meet one after another (see stripes). A stripe turns its candidates into posting lists once: the places and
weights that are not zero, per term. For a batch of queries each term's postings are scattered, weighted by
the queries' components, into dense score arrays. A partition selection keeps the best k of the stripe per
query, and the stripes' winners are merged by rank.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tamis.llm.stripes import against_all, best, in_parts, matrix, whole_components
from tamis.staging import stage_table

SCALE = 1024
_LONG = 2**63 - 1


class Postings:
    """The terms of a stripe's candidates: places and weights that are not zero."""

    def __init__(self, values: np.ndarray):
        self.number = len(values)
        self.lists = []
        for term in range(values.shape[1]):
            places = np.flatnonzero(values[:, term])
            whole = len(places) == len(values)  # then the scores are added to as they lie
            self.lists.append((None if whole else places, values[places, term]))
        self.largest = int(max(values.max(initial=0), -int(values.min(initial=0))))

    def scores(self, queries: np.ndarray) -> np.ndarray:
        """Inner products of all queries with all candidates, one term after the other, held to 64 bits."""
        width = min(queries.shape[1], len(self.lists))
        largest = int(max(queries.max(initial=0), -int(queries.min(initial=0)))) * self.largest * max(width, 1)
        # Whole numbers of this size are exact in every step; others take Python's numbers.
        kind = np.float64 if largest < 2**53 else np.int64 if largest < 2**63 else object
        scores = np.zeros((len(queries), self.number), kind)
        added = np.empty_like(scores)
        for term, (places, weights) in enumerate(self.lists[:width]):
            asking = np.flatnonzero(queries[:, term])
            if not len(asking) or not len(weights):
                continue
            components, weights = queries[asking, term].astype(kind), weights.astype(kind)
            if places is None and len(asking) == len(queries):
                np.multiply(components[:, None], weights[None, :], out=added)
                scores += added
            elif places is None:
                scores[asking] += np.multiply.outer(components, weights)
            else:
                scores[np.ix_(asking, places)] += np.multiply.outer(components, weights)
        if kind is object:
            scores = np.clip(scores, -_LONG - 1, _LONG)
        return scores.astype(np.int64)


def top_k(
    vectors: DataFrame, queries: DataFrame, k: int, vec_id: str = "vec_id",
    embedding: str = "embedding", scale: int = SCALE,
) -> DataFrame:
    """The k highest integer inner products of each query with the rows of other ids.

    Columns: query_id, rank (from 1), vec_id, score; ties go to the smaller vec_id. A component x
    counts as floor(scale * x). Rows with a null id, a null vector or a null or non-finite component
    take no part; missing components of shorter vectors count as 0, an empty vector scores 0. Components
    and scores beyond 64 bits are held to the nearest such number. Every query row is answered for itself,
    also if its id occurs again, and a repeated candidate is a candidate of its own. Other columns are not
    read. Fewer than k candidates are all returned; no queries or no candidates give no rows.
    """

    def usable(df: DataFrame) -> DataFrame:
        rows = df.select(F.col(vec_id).cast("long").alias("id"), whole_components(F.col(embedding), scale).alias("v"))
        return rows.where(F.col("id").isNotNull() & F.col("v").isNotNull())

    held = stage_table(usable(vectors).select(F.struct("id").alias("row"), "v"), "candidates")
    asked = usable(queries).withColumn("q", F.monotonically_increasing_id())
    asked = stage_table(asked.select(F.struct("q", "id").alias("row"), "v"), "queries")

    def work(stripe: pa.Table, stream: Iterator[pa.Table]) -> Iterator[pa.RecordBatch]:
        postings, ids = Postings(matrix(stripe["v"])), stripe["id"].to_numpy()
        for batch in stream:
            for part in in_parts(batch, len(ids)):
                scores, found = postings.scores(matrix(part["v"])), []
                for row, (q, query) in enumerate(zip(part["q"].to_pylist(), part["id"].to_pylist(), strict=True)):
                    others = np.flatnonzero(ids != query)
                    top = others[best(scores[row][others], ids[others], k)]
                    found.append((np.full(len(top), q), np.full(len(top), query), ids[top], scores[row][top]))
                columns = (np.concatenate(c).astype(np.int64) for c in zip(*found, strict=True))
                yield pa.RecordBatch.from_pydict(dict(zip(("q", "query_id", "vec_id", "score"), columns, strict=True)))

    found = against_all(held, asked, work, "q long, query_id long, vec_id long, score long")
    # The rank filter keeps k rows per query and task before the shuffle.
    order = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
