"""Quality by regularised quadratic discriminant analysis of document statistics.

A document is described by statistics of its whole text, transformed so that they spread evenly. Each
class has a mean and a covariance, summed up over all labelled rows and shrunk: towards the covariance
that both classes share, and that towards a multiple of the unit matrix. A document's score comes from the
difference of the classes' log densities, that is of squared Mahalanobis distances by Cholesky factors that
are computed once; a logistic curve fitted to labelled rows turns it into a probability.
"""

from __future__ import annotations

import math
import operator
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tamis.llm.common import text_slices
from tamis.staging import stage_table

# The curve is fitted to at most so many labelled rows, those with the smallest hashes.
CURVE_ROWS = 20_000
SHRINK_TO_SHARED = 0.1
SHRINK_TO_UNIT = 0.02
PRIOR_ROWS = 20.0  # rows of the shared covariance that a small class is taken to have besides its own
THRESHOLD = 0.3

STATISTICS = (
    "words", "word_length", "word_spread", "letters", "capitals", "digits", "marks", "signs", "doubled_signs",
    "lone_signs", "capital_words", "variety", "repeats", "top_word", "sentences", "lines", "repeated_lines",
)
_SPACE, _SMALL, _CAPITAL, _DIGIT, _MARK, _SIGN = range(6)
_MARKS = ".,;:!?'\"()-«»„“”‘’¿¡…–—"  # fixed values: signs of ordinary prose


def _kinds() -> np.ndarray:
    """The kind of each character of the basic plane; all others count as the last one's."""
    table = np.full(0x10000, _SIGN, np.uint8)
    for code in range(0x10000):
        c = chr(code)
        if c.isspace():
            table[code] = _SPACE
        elif c.isalpha():
            table[code] = _CAPITAL if c.isupper() else _SMALL
        elif c.isdigit():
            table[code] = _DIGIT
        elif c in _MARKS:
            table[code] = _MARK
    return table


def statistics(text: str, kinds: np.ndarray) -> list[float]:
    """The transformed statistics of a text, in the order of STATISTICS; all 0 without words."""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * len(STATISTICS)
    codes = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    kind = kinds[np.minimum(codes, len(kinds) - 1)]
    of = np.bincount(kind, minlength=6)
    visible = max(1, len(codes) - int(of[_SPACE]))
    letters = max(1, int(of[_SMALL] + of[_CAPITAL]))
    sign = kind >= _MARK
    doubled = int(np.count_nonzero(sign[1:] & (codes[1:] == codes[:-1])))
    space = np.concatenate(([True], kind == _SPACE, [True]))
    lone = int(np.count_nonzero(sign & space[:-2] & space[2:]))
    lengths = np.fromiter(map(len, words), np.float64, n)
    counts = Counter(words)
    lines = [line for line in text.split("\n") if line and not line.isspace()]
    ends = text.count(".") + text.count("!") + text.count("?")
    root = math.sqrt
    return [
        math.log1p(n),
        math.log(lengths.mean()),
        math.log1p(lengths.std()),
        root(1 - (of[_SMALL] + of[_CAPITAL]) / visible),
        root(of[_CAPITAL] / letters),
        root(of[_DIGIT] / visible),
        root(of[_MARK] / visible),
        root(of[_SIGN] / visible),
        root(doubled / n),
        root(lone / n),
        root(sum(map(str.isupper, words)) / n),
        math.log1p(len(counts)) / math.log1p(n),
        root(sum(map(operator.eq, words, words[1:])) / n),
        root((max(counts.values()) - 1) / n),
        math.log((ends + 1) / (n + 10)),
        math.log(len(lines) / n),
        root(1 - len(set(lines)) / len(lines)),
    ]


def document_statistics(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and statistics (array of double) of each row, staged: the texts are read once.

    Null and empty texts and those of white space alone have statistics of 0. Repeated rows are rows of
    their own; null ids are kept; other columns are not read.
    """
    schema = T.StructType(
        [T.StructField("doc_id", docs.schema[doc_id].dataType), T.StructField("statistics", T.ArrayType(T.DoubleType()))]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = _kinds()
        for part in text_slices(batches, "text"):
            values = [statistics(t or "", kinds) for t in part["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [part["doc_id"].combine_chunks(), pa.array(values, pa.list_(pa.float64()))], names=schema.names
            )

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return stage_table(rows.mapInArrow(run, schema), "statistics")


@dataclass
class Density:
    """A normal density: its mean, and the Cholesky factor of its covariance, inverted once."""

    mean: np.ndarray
    whiten: np.ndarray
    log_scale: float

    @classmethod
    def of(cls, mean: np.ndarray, covariance: np.ndarray) -> Density:
        factor = np.linalg.cholesky(covariance)
        return cls(mean, np.linalg.inv(factor), float(np.log(np.diag(factor)).sum()))

    def log(self, x: np.ndarray) -> np.ndarray:
        """The log density of each row, but for a constant."""
        z = (x - self.mean) @ self.whiten.T
        return -0.5 * np.einsum("ij,ij->i", z, z) - self.log_scale


@dataclass
class Classifier:
    low: Density | None = None
    high: Density | None = None
    curve: tuple[float, float] = (0.0, 1.0)
    share: float = 0.5  # the score of all, if a class has no labelled row

    def log_ratio(self, x: np.ndarray) -> np.ndarray:
        """How much likelier the label 1 is, compressed so that far outliers don't rule the curve."""
        if self.low is None or self.high is None:
            return np.zeros(len(x))
        ratio = self.high.log(x) - self.low.log(x)
        return np.sign(ratio) * np.log1p(np.abs(ratio))

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.low is None or self.high is None:
            return np.full(len(x), self.share)
        return 1 / (1 + np.exp(-np.clip(self.curve[0] + self.curve[1] * self.log_ratio(x), -500, 500)))


def _matrix(lists: pa.ChunkedArray) -> np.ndarray:
    return lists.combine_chunks().flatten().to_numpy().reshape(len(lists), len(STATISTICS))


def _class_sums(marked: DataFrame) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """Per label the number of rows, the sum of their statistics and that of their outer products.

    All rows count; each task sends a row per label, and what comes to the driver has fixed size.
    """
    size = len(STATISTICS)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, 1 + size + size * size))
        for batch in batches:
            table = pa.Table.from_batches([batch])
            x, labels = _matrix(table["statistics"]), table["label"].to_numpy()
            for label in (0, 1):
                own = x[labels == label]
                sums[label] += np.concatenate(([len(own)], own.sum(axis=0), (own.T @ own).ravel()))
        yield pa.RecordBatch.from_pydict(
            {"label": pa.array([0, 1], pa.int32()), "sums": pa.array(sums.tolist(), pa.list_(pa.float64()))}
        )

    parts = marked.select("label", "statistics").mapInArrow(partial, "label int, sums array<double>")
    summed = parts.select("label", F.posexplode("sums").alias("at", "value")).groupBy("label", "at").agg(
        F.sum("value").alias("value")
    )
    out = {label: np.zeros(1 + size + size * size) for label in (0, 1)}
    for r in summed.collect():  # two labels, a fixed number of sums
        out[r["label"]][r["at"]] = r["value"]
    return {k: (v[0], v[1 : 1 + size], v[1 + size :].reshape(size, size)) for k, v in out.items()}


def _densities(sums: dict[int, tuple[float, np.ndarray, np.ndarray]], to_shared: float, to_unit: float) -> list[Density]:
    counts = [sums[c][0] for c in (0, 1)]
    means = [sums[c][1] / sums[c][0] for c in (0, 1)]
    scatter = [sums[c][2] - counts[c] * np.outer(means[c], means[c]) for c in (0, 1)]
    shared = (scatter[0] + scatter[1]) / sum(counts)
    spread = np.sqrt(np.maximum(np.diag(shared), 1e-12))  # statistics count in units of their spread
    scale = np.outer(spread, spread)
    out = []
    for c in (0, 1):
        own = (scatter[c] + PRIOR_ROWS * shared) / (counts[c] + PRIOR_ROWS)
        mixed = ((1 - to_shared) * own + to_shared * shared) / scale
        level = max(np.trace(mixed) / len(mixed), 1e-6)
        out.append(Density.of(means[c], ((1 - to_unit) * mixed + to_unit * level * np.eye(len(mixed))) * scale))
    return out


def _fit_curve(x: np.ndarray, y: np.ndarray, ridge: float = 0.1) -> tuple[float, float]:
    """Logistic regression on one variable by Newton's method, a little drawn to a slope of 0."""
    columns, w = np.column_stack([np.ones(len(x)), x]), np.array([0.0, 1.0])
    penalty = np.diag([1e-3 * ridge, ridge])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(columns @ w, -30, 30)))
        slope = (columns * (p * (1 - p))[:, None]).T @ columns + penalty
        w = w - np.clip(np.linalg.solve(slope, columns.T @ (p - y) + penalty @ w), -5, 5)
    return float(w[0]), float(w[1])


def learn(
    described: DataFrame, labels: DataFrame, doc_id: str = "doc_id", label: str = "quality",
    to_shared: float = SHRINK_TO_SHARED, to_unit: float = SHRINK_TO_UNIT, curve_rows: int = CURVE_ROWS,
) -> Classifier:
    """Learn from the described documents (see document_statistics) that ``labels`` marks 0 or 1.

    All labelled rows enter means and covariances; the curve is fitted to at most ``curve_rows`` rows,
    those whose ids have the smallest hashes. Null ids or labels and labels of no document are left out; of
    several labels of a document the largest holds. If a label has no row, every score is the share of
    label 1 (0.5 without any row).
    """
    marks = (
        labels.select(F.col(doc_id).alias("doc_id"), F.col(label).cast("int").alias("label"))
        .where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1))
        .groupBy("doc_id").agg(F.max("label").alias("label"))
    )
    marked = stage_table(described.join(marks, "doc_id"), "marked")
    sums = _class_sums(marked)
    low, high = sums[0][0], sums[1][0]
    if not low or not high:
        return Classifier(share=high / (low + high) if low + high else 0.5)
    out = Classifier(*_densities(sums, to_shared, to_unit))
    rows = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(curve_rows).select("label", "statistics").toArrow()
    x, y = out.log_ratio(_matrix(rows["statistics"])), rows["label"].to_numpy().astype(float)
    order = np.lexsort((y, x))
    out.curve = _fit_curve(x[order], y[order])
    return out


def score(described: DataFrame, classifier: Classifier) -> DataFrame:
    """Per row of document_statistics: doc_id, score (0 to 1, higher: label 1 likelier) and log_ratio.

    Nothing but the text's statistics enters. Repeated rows get equal scores; no rows give no rows.
    """
    schema = T.StructType(
        [described.schema["doc_id"], T.StructField("score", T.DoubleType()), T.StructField("log_ratio", T.DoubleType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(pa.Table.from_batches([batch])["statistics"])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(classifier.score(x)), pa.array(classifier.log_ratio(x))],
                names=schema.names,
            )

    return described.select("doc_id", "statistics").mapInArrow(run, schema)
