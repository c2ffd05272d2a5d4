"""Benchmark decontamination by winnowing. DataFrame functions only.

A winnowing window of 9 consecutive 5-word hashes covers exactly 13 words and keeps its smallest hash
as a fingerprint, so a document and a benchmark text that share 13 consecutive words share a
fingerprint. Documents with a benchmark fingerprint are looked at again: their 13-word windows are
extended from the fingerprint to the whole window and compared with those of the benchmark.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamis.llm.common import row_keys
from tamis.staging import stage_table

WINDOW = 13  # words
GRAM = 5  # words of a hash; WINDOW - GRAM + 1 hashes form a winnowing window
# A benchmark of at most so many windows is broadcast (some tens of MB); a larger one is shuffled.
BROADCAST_WINDOWS = 500_000

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: str) -> Column:
    """Words of a text, with A-Z (and nothing else) in lower case. Null has none."""
    # lower() is fast and the same for a text of ASCII characters.
    ascii_only = F.octet_length(text) == F.char_length(text)
    lowered = F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))
    return F.array_remove(F.split(F.coalesce(lowered, F.lit("")), BREAKS), "")


def _places(last: Column) -> Column:
    """0 .. last, or nothing where last is negative."""
    return F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))


def _gram_hashes(word_hashes: Column) -> Column:
    at = lambda i, k: F.get(word_hashes, i + k)
    return F.transform(
        _places(F.size(word_hashes) - GRAM), lambda i: F.xxhash64(*[at(i, k) for k in range(GRAM)])
    )


def _minima(grams: Column, window: int) -> Column:
    """The smallest hash of each run of ``window`` of them."""
    return F.transform(
        _places(F.size(grams) - window), lambda i: F.least(*[F.get(grams, i + k) for k in range(window)])
    )


def _with_grams(df: DataFrame) -> DataFrame:
    df = df.withColumn("_h", F.transform("_words", lambda w: F.xxhash64(w)))
    return df.withColumn("_grams", _gram_hashes(F.col("_h")))


def _runs_of(n: int) -> Column:
    """Hashes of all runs of n words."""
    return F.transform(_places(F.size("_words") - n), lambda i: F.xxhash64(F.slice("_h", i + 1, n)))


def _windows(df: DataFrame, keep: list[str], length: int) -> DataFrame:
    """A row per window of ``length`` words: start, fingerprint and two hashes of its words."""
    n = F.size("_words")
    fingerprint = (
        _minima(F.col("_grams"), length - GRAM + 1)
        if length > GRAM
        else F.transform(_places(n - length), lambda i: F.lit(0).cast("long"))
    )
    whole = F.transform(
        _places(n - length),
        lambda i: F.struct(
            F.xxhash64(F.slice("_h", i + 1, length)).alias("whole"),
            F.hash(F.slice("_words", i + 1, length)).alias("whole2"),
        ),
    )
    return df.select(
        *keep,
        F.posexplode(F.arrays_zip(fingerprint.alias("fp"), whole.alias("w"))).alias("start", "_z"),
    ).select(
        *keep, "start", F.lit(length).alias("length"), F.col("_z.fp").alias("fp"),
        F.col("_z.w.whole").alias("whole"), F.col("_z.w.whole2").alias("whole2"),
    )


def _benchmark_windows(benchmark: DataFrame, item_id: str, text: str) -> tuple[DataFrame, list[int]]:
    items = benchmark.select(F.col(item_id).cast("string").alias("item"), words_of(text).alias("_words"))
    items = stage_table(items.where(F.size("_words") > 0), "items")
    short = sorted(
        r[0] for r in items.select(F.size("_words").alias("n")).where(F.col("n") < WINDOW)
        .distinct().collect()  # at most WINDOW - 1 lengths
    )
    found = _windows(_with_grams(items), ["item"], WINDOW)
    for n in short:
        alone = _with_grams(items.where(F.size("_words") == n))
        found = found.unionByName(_windows(alone, ["item"], n))
    found = stage_table(found.drop("start").distinct(), "item_windows")
    return found, short


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_WINDOWS else df


def contamination(
    docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text",
    item_id: str = "item_id", item_text: str = "text", share: int = 20,
) -> DataFrame:
    """Per document row: how much of it consists of benchmark windows.

    Columns: doc_id, n_words, n_hit (words inside an occurrence of a window), items (sorted ids of
    items with an occurring window), contaminated (n_hit > 0 and share * n_hit >= n_words), and the
    row keys ``row_key``, ``row_key2`` of :func:`tamis.llm.common.row_keys`.

    A window is 13 consecutive words of an item; an item with fewer is one window. Null and empty
    texts have no words and are never contaminated; items without words match nothing; a null item
    id is the id "". Repeated documents each get a row, repeated items count once. Other columns are
    not read. An empty table on either side gives zeros or no rows.
    """
    windows, short = _benchmark_windows(benchmark, item_id, item_text)
    windows = windows.fillna({"item": ""})
    long_prints = windows.where(F.col("length") == WINDOW).select("fp").distinct()

    doc = docs.select(F.col(doc_id).alias("doc_id"), *row_keys(doc_id, text), words_of(text).alias("_words"))
    prints = F.array_distinct(_minima(F.col("_grams"), WINDOW - GRAM + 1)).alias("prints")
    shorts = [F.array_distinct(_runs_of(n)).alias(f"short{n}") for n in short]
    prepared = stage_table(
        _with_grams(doc).select(
            "doc_id", "row_key", "row_key2", F.size("_words").alias("n_words"), prints, *shorts
        ),
        "fingerprints",
    )
    keys = ["row_key", "row_key2"]
    touched = (
        prepared.select(*keys, F.explode("prints").alias("fp"))
        .join(_small(long_prints), "fp", "left_semi").select(*keys)
    )
    for n in short:
        wanted = windows.where(F.col("length") == n).select("whole").distinct()
        touched = touched.union(
            prepared.select(*keys, F.explode(f"short{n}").alias("whole"))
            .join(_small(wanted), "whole", "left_semi").select(*keys)
        )
    touched = touched.distinct()

    # Extension: whole windows of the documents that have a fingerprint in common.
    again = _with_grams(
        docs.select(*row_keys(doc_id, text), F.col(text).alias("_text"))
        .join(touched, keys, "left_semi").dropDuplicates(keys)
        .select(*keys, words_of("_text").alias("_words"))
    )
    distinct_windows = stage_table(
        windows.groupBy("length", "fp", "whole", "whole2").agg(F.collect_set("item").alias("items")),
        "windows",
    )
    places = None
    for n in [*short, WINDOW]:
        own = _windows(again, keys, n)
        places = own if places is None else places.unionByName(own)
    hits = places.join(_small(distinct_windows), ["length", "fp", "whole", "whole2"])
    covered = F.aggregate(
        F.array_sort(F.collect_set(F.struct("start", (F.col("start") + F.col("length")).alias("end")))),
        F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n")),
        lambda acc, x: F.struct(
            F.greatest(acc["end"], x["end"]).alias("end"),
            (acc["n"] + F.greatest(F.lit(0), x["end"] - F.greatest(acc["end"], x["start"]))).alias("n"),
        ),
        lambda acc: acc["n"],
    )
    per_doc = hits.groupBy(*keys).agg(
        covered.alias("n_hit"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    )
    joined = prepared.select("doc_id", *keys, F.col("n_words").cast("long").alias("n_words")).join(
        per_doc, keys, "left"
    )
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return joined.select(
        "doc_id", "n_words", n_hit.alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        ((n_hit > 0) & (n_hit * F.lit(share) >= F.col("n_words"))).alias("contaminated"), *keys,
    )
