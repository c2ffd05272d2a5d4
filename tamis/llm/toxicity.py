"""Toxicity by a weighted lexicon, matched with Aho-Corasick after folding disguises.

The lexicon (words and word beginnings with weights, and exception phrases that cancel them) is learned
from a bounded sample of labelled rows. Texts are folded so that look-alike letters, digits that stand
for letters, accents, spaced-out and stretched words read alike. The sum of weights, by itself and
normalised by the text's length, gives a score through a logistic curve.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tamis.llm.common import map_batches, text_slices
from tamis.staging import stage_table

# The lexicon is learned from at most so many labelled rows, those with the smallest hashes.
SAMPLE_ROWS = 20_000
BEGINNINGS = range(4, 9)  # lengths of word beginnings that may be entries
SUPPORT = 5  # toxic documents that an entry must occur in
LEAST_WEIGHT = 2.0  # logarithm of how much more often toxic texts use an entry
DEVIATIONS = 4.5  # and by so many standard deviations more toxic texts must have it
EXCEPTION_SHARE = 0.25  # toxic texts may have an exception so often, compared with their share of all texts
THRESHOLD = 0.7

# Letters of other scripts that look like Latin ones, and ligatures.
HOMOGLYPHS = {
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t",
    "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "ԁ": "d", "ԛ": "q", "ԝ": "w", "һ": "h", "ӏ": "l",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "μ": "m", "ν": "v", "ο": "o", "ρ": "p",
    "σ": "o", "τ": "t", "υ": "u", "χ": "x", "γ": "y", "ω": "w", "ı": "i", "ɑ": "a", "ɡ": "g", "ʟ": "l",
    "ß": "ss", "æ": "ae", "œ": "oe", "ø": "o", "ł": "l", "đ": "d", "ð": "d",
}
_FOREIGN = str.maketrans(HOMOGLYPHS)
# Signs that stand for letters next to letters. Letters and signs that are mistaken for each other
# (i, l, 1) fold to one.
_SIGNS = bytes.maketrans(b"0123456789@$!|l", b"oizeasgtbgasiii")
_LETTERS = bytes(c if 97 <= c <= 122 else 32 for c in range(256))
_MIXED = re.compile(rb"[0-9@$!|]+(?=[a-z])|(?<=[a-z])[0-9@$]+")
_INVISIBLE = re.compile("[­​-‏⁠﻿]")
_SPACED = re.compile(rb"(?<![a-z])[a-z](?:[ ._*-][a-z]){2,}(?![a-z])")
_STRETCHED = re.compile(rb"([a-z])\1{2,}")


def _joined(spaced: re.Match) -> bytes:
    """Spaced-out letters as a word, and again without the first, which may be a word by itself."""
    word = bytes(c for c in spaced[0] if 97 <= c <= 122)
    return word + b" " + word[1:]


def fold(text: str) -> str:
    """Words of lower-case ASCII letters with single spaces or more between and around them."""
    text = text.lower()
    if not text.isascii():
        text = _INVISIBLE.sub("", text)
        text = unicodedata.normalize("NFKD", text).lower().translate(_FOREIGN)
    raw = text.encode("ascii", "replace") if text.isascii() else "".join(
        c for c in text if not unicodedata.combining(c)
    ).encode("ascii", "replace")
    raw = _MIXED.sub(lambda m: m[0].translate(_SIGNS), raw)
    raw = _SPACED.sub(_joined, raw)
    raw = _STRETCHED.sub(rb"\1", raw)
    return (b" " + raw.translate(_LETTERS).translate(_SIGNS) + b" ").decode("ascii")


def _entries_of(word: str) -> Iterator[str]:
    """What may be an entry for a word: itself, and its beginnings."""
    yield f" {word} "
    for n in BEGINNINGS:
        if n <= len(word):
            yield f" {word[:n]}"


@dataclass
class Lexicon:
    weights: dict[str, float] = field(default_factory=dict)
    exceptions: dict[str, float] = field(default_factory=dict)  # phrases, with the weight they cancel
    curve: list[float] | None = None

    def automaton(self):
        import ahocorasick

        machine = ahocorasick.Automaton()
        for pattern, weight in [*self.weights.items(), *((p, -w) for p, w in self.exceptions.items())]:
            machine.add_word(pattern, (pattern, weight))
        if len(machine):
            machine.make_automaton()
        return machine

    def found(self, machine, folded: str) -> list[tuple[str, float]]:
        return [value for _, value in machine.iter(folded)] if len(machine) else []

    def score(self, weight: float, words: int) -> float:
        if self.curve is None:
            return 0.0
        x = float(np.dot(self.curve, [1.0, *_measures(weight, words)]))
        return 1 / (1 + math.exp(-min(max(x, -500), 500)))


def _measures(weight: float, words: int) -> list[float]:
    """The weight of a text by itself and in proportion to its length (short texts: as if of 30 words)."""
    weight, words = max(weight, 0.0), max(words, 30)
    return [math.log1p(weight), math.log1p(100 * weight / words), weight / math.sqrt(words)]


def _fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> list[float]:
    """Logistic regression by Newton's method."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    penalty = ridge * np.diag([1e-3, *np.ones(x.shape[1] - 1)])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (p - y) + penalty @ w)
    return w.tolist()


_COUNTS = ("t_texts", "c_texts", "toxic", "clean")
# Distinct features that a task counts before it sends them (some 25 MB).
HELD_FEATURES = 100_000


def _count(sample: DataFrame, features) -> DataFrame:
    """Numbers of toxic and clean texts with a feature (t_texts, c_texts), and of its occurrences there.

    ``features()`` makes the function, in the task, that lists a folded text's features. Counted in
    the task, for texts of some ``HELD_FEATURES`` distinct features at a time, and summed up before the shuffle.
    """
    held = HELD_FEATURES

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, counts, texts = features(), (Counter(), Counter()), (Counter(), Counter())

        def counted() -> pa.RecordBatch:
            names = list(counts[0].keys() | counts[1].keys())
            columns = dict(zip(_COUNTS, (texts[1], texts[0], counts[1], counts[0]), strict=True))
            return pa.RecordBatch.from_pydict(
                {"feature": pa.array(names, pa.string()),
                 **{c: pa.array([by[f] for f in names], pa.int64()) for c, by in columns.items()}}
            )

        for part in text_slices(batches, "text"):
            for text, toxic in zip(part["text"].to_pylist(), part["toxic"].to_pylist(), strict=True):
                found = of(fold(text or ""))
                counts[toxic].update(found)
                texts[toxic].update(set(found))
                if len(counts[0]) + len(counts[1]) > held:
                    yield counted()
                    for by in (*counts, *texts):
                        by.clear()
        if counts[0] or counts[1]:
            yield counted()

    partials = map_batches(sample, partial, "feature string, " + ", ".join(f"{c} long" for c in _COUNTS))
    return partials.groupBy("feature").agg(*[F.sum(c).alias(c) for c in _COUNTS])


def _words_and_beginnings():
    return lambda folded: [e for w in folded.split() for e in _entries_of(w)]


def learn(
    docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text",
    label: str = "toxic", sample_rows: int = SAMPLE_ROWS,
) -> Lexicon:
    """Learn a lexicon from the documents that ``labels`` marks 0 or 1.

    At most ``sample_rows`` labelled ids are used, those with the smallest hashes. Null ids or labels
    and labels of no document are left out; of several labels of a document the largest holds. With
    no toxic or no clean text there are no entries, and every score is 0.
    """
    marked = (
        labels.select(F.col(doc_id).alias("doc_id"), F.col(label).cast("int").alias("toxic"))
        .where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1))
        .groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    )
    sample = stage_table(
        docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
        .join(F.broadcast(marked), "doc_id")  # at most sample_rows narrow rows
        .select("text", "toxic").repartition(docs.sparkSession.sparkContext.defaultParallelism),
        "labelled",
    )
    counted = stage_table(_count(sample, _words_and_beginnings), "features")
    texts = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    toxic_texts, clean_texts = texts.get(1, 0), texts.get(0, 0)
    words = counted.where(F.col("feature").endswith(" ")).agg(F.sum("toxic"), F.sum("clean")).first()
    toxic, clean = words[0] or 0, words[1] or 0
    if not toxic or not clean:
        return Lexicon()

    def weight(t: int, c: int) -> float:
        """How much more often toxic texts use it, per word."""
        return math.log((t + 0.5) / toxic) - math.log((c + 2) / clean)

    share = toxic_texts / (toxic_texts + clean_texts)
    expected = (F.col("t_texts") + F.col("c_texts")) * share
    candidates = (  # bounded by the words of the sampled rows, of which few pass
        counted.where(F.col("t_texts") >= SUPPORT)
        # more toxic texts than chance would give, by so many standard deviations
        .where(F.col("t_texts") - expected > DEVIATIONS * F.sqrt(expected))
    ).collect()
    scored = {
        r["feature"]: (w, r["t_texts"], r["toxic"], r["clean"]) for r in candidates
        if (w := weight(r["toxic"], r["clean"])) >= LEAST_WEIGHT
    }
    kept: dict[str, float] = {}
    for feature in sorted(scored, key=lambda f: (len(f.rstrip()), -len(f), f)):
        w, _, uses, _ = scored[feature]
        word = feature.rstrip()
        shorter = [s for k in range(len(word) + 1) if (s := word[:k]) in kept and s != feature]
        # A longer entry takes the place of a shorter one if it is more telling and has most of its
        # uses; otherwise it must tell much more to stand beside it.
        for s in shorter:
            if uses >= 0.7 * scored[s][2] and w > kept[s] + 0.2:
                del kept[s]
        if not any(s in kept and kept[s] >= w - 2 for s in shorter):
            kept[feature] = w
    lexicon = Lexicon({f: kept[f] for f in sorted(kept)})
    lexicon.exceptions = _learn_exceptions(sample, lexicon, {f: scored[f][3] for f in lexicon.weights}, share)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = lexicon.automaton()
        for part in text_slices(batches, "text"):
            folded = [fold(t or "") for t in part["text"].to_pylist()]
            sums = [sum(w for _, w in lexicon.found(machine, f)) for f in folded]
            yield pa.RecordBatch.from_pydict(
                {"toxic": part["toxic"].combine_chunks(), "weight": pa.array(sums, pa.float64()),
                 "words": pa.array([len(f.split()) for f in folded], pa.int64())}
            )

    rows = map_batches(sample, measured, "toxic int, weight double, words long").collect()  # sample_rows
    rows.sort()
    x = np.array([_measures(r["weight"], r["words"]) for r in rows])
    lexicon.curve = _fit(x, np.array([r["toxic"] for r in rows], dtype=float))
    return lexicon


def _learn_exceptions(sample: DataFrame, lexicon: Lexicon, clean: dict[str, int], share: float) -> dict[str, float]:
    """Phrases of an entry's word and a neighbour that make up a fifth or more of what clean texts have
    of the entry (``clean``: its occurrences there), and that toxic texts have much more rarely than
    their ``share`` of all texts would give."""

    def phrases():
        machine = lexicon.automaton()

        def of(folded: str) -> list[str]:
            words, out = folded.split(), []
            for n, word in enumerate(words):
                if lexicon.found(machine, f" {word} "):
                    if n:
                        out.append(f" {words[n - 1]} {word} ")
                    if n + 1 < len(words):
                        out.append(f" {word} {words[n + 1]} ")
            return out

        return of

    rows = (
        _count(sample, phrases).where(F.col("c_texts") >= SUPPORT)
        .where(F.col("t_texts") <= EXCEPTION_SHARE * share * (F.col("t_texts") + F.col("c_texts")))
    ).collect()  # bounded by the phrases of the sampled rows
    machine = lexicon.automaton()
    out = {}
    for r in rows:
        found = lexicon.found(machine, r["feature"])
        if any(5 * r["clean"] >= clean[entry] for entry, _ in found):
            out[r["feature"]] = sum(w for _, w in found)
    return out


def score(docs: DataFrame, lexicon: Lexicon, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, score (0 to 1), n_words, weight and the matched entries and exceptions.

    Nothing but the text is an input of the score. Null and empty texts have no entries and get the
    score of that. Repeated rows get equal scores; other columns are not read; no rows give no rows.
    """
    schema = T.StructType(
        [T.StructField("doc_id", docs.schema[doc_id].dataType), T.StructField("score", T.DoubleType()),
         T.StructField("n_words", T.LongType()), T.StructField("weight", T.DoubleType()),
         T.StructField("found", T.ArrayType(T.StringType()))]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = lexicon.automaton()
        for part in text_slices(batches, "text"):
            rows: tuple[list, list, list, list] = ([], [], [], [])
            for text in part["text"].to_pylist():
                folded = fold(text or "")
                found = lexicon.found(machine, folded)
                weight, words = sum(w for _, w in found), len(folded.split())
                for column, value in zip(
                    rows, (lexicon.score(weight, words), words, weight, [p.strip() for p, _ in found]), strict=True
                ):
                    column.append(value)
            yield pa.RecordBatch.from_arrays(
                [part["doc_id"].combine_chunks(), pa.array(rows[0], pa.float64()), pa.array(rows[1], pa.int64()),
                 pa.array(rows[2], pa.float64()), pa.array(rows[3], pa.list_(pa.string()))],
                names=schema.names,
            )

    return map_batches(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), run, schema)


def kept(
    docs: DataFrame, lexicon: Lexicon, text: str = "text", threshold: float = THRESHOLD
) -> DataFrame:
    """The rows whose score is below the threshold, with all their columns; see score."""
    schema, at = docs.schema, docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = lexicon.automaton()
        for part in text_slices(batches, at):
            clean = []
            for value in part.column(at).to_pylist():
                folded = fold(value or "")
                weight = sum(w for _, w in lexicon.found(machine, folded))
                clean.append(lexicon.score(weight, len(folded.split())) < threshold)
            yield from part.filter(pa.array(clean, pa.bool_())).to_batches()

    return map_batches(docs, run, schema)
