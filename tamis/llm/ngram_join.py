"""Near duplicates by the Jaccard similarity of word n-grams: a size-aware heavy-light join.

1. Texts with equal sets form one class. A class can have a partner only if enough of its smallest
   hashes (a prefix, by the usual overlap bound) occur in other classes; that removes most classes.
2. The others' n-grams are ordered by rarity. Small sets enumerate the fixed-size subsets (pairs) of
   their prefix; large ones are found by scanning the inverted lists of single prefix n-grams. The size
   where one gives way to the other is the one of least counted cost. Sets just below it are in the
   lists too, since a large set may have a smaller partner.
3. A list of similar sets is not expanded into pairs: each member is compared with a centre of the list,
   and linked ones merge into components, for some rounds. Only what is left of a list, members of
   different components, is compared pairwise, as far as the n-grams after the key's leave it possible.
   So all links between components are found.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema
from pyspark.sql.types import StructType

from tamis.llm.common import free_names, give_back, map_batches, text_slices
from tamis.llm.components import components
from tamis.llm.hashing import shingle_sets
from tamis.staging import stage_table

WORDS = 5
PERCENT = 80  # similarity, in percent
# Postings that a task holds before it sends them (12 bytes each).
HELD_POSTINGS = 2_000_000
# Bytes of texts whose sets a task makes at a time: sets and their hashes take many times the texts' memory.
SET_BYTES = 1_000_000
# Rounds of comparing members with a centre, at most.
ROUNDS = 3
# What an entry of an inverted list costs, a comparison with the list's centre included, in subset keys.
ENTRY_COST = 3
# Class sizes are counted in bins that grow by this factor.
BIN = 1.25


def _overlap(n: int, percent: int) -> int:
    """n-grams that a set of n shares with any partner, at least."""
    return -(-percent * n // 100)


def _evidence(n: int) -> int:
    """Shared prefix n-grams that a set of n asks for; its prefix is as much longer."""
    return max(1, n // 10)


# A record is a document (row to digest) or what a task sends to a bucket: hashes, tags of the sets they
# are from, and rows counted from ``base`` (SHARED: several sets of the task have the hash).
_RECORD = (
    "bucket int, row long, doc_id {id}, text_key long, n long, digest binary, "
    "base long, keys binary, tags binary, refs binary"
)
_FOUND = "row long, doc_id {id}, text_key long, n long, digest binary, shared long"
SHARED = 0xFFFFFFFF


def _schema(ddl: str, docs: DataFrame) -> pa.Schema:
    return to_arrow_schema(StructType.fromDDL(ddl.format(id=docs.schema["doc_id"].dataType.simpleString())))


def _rows(schema: pa.Schema, number: int, /, **columns) -> pa.RecordBatch:
    """A batch of ``number`` rows; columns that are not given are null."""
    return pa.RecordBatch.from_arrays(
        [pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(number, f.type) for f in schema],
        schema=schema,
    )


def _sets_and_postings(docs: DataFrame, words: int, percent: int, buckets: int) -> DataFrame:
    """A row per document (its set's size and digest) and, by bucket, the postings of prefixes.

    A task sends a hash once: with the document that has it, or, if several classes of the task have
    it, just as one that is shared, counting it for these documents itself.
    """
    schema = _schema(_RECORD, docs)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = base = TaskContext.get().partitionId() << 33
        keys: list[np.ndarray] = []
        tags: list[int] = []
        refs: list[int] = []
        digests: set[bytes] = set()

        def emit() -> pa.RecordBatch:
            sizes = [len(k) for k in keys]
            key = np.concatenate(keys)
            keys.clear()
            order = np.argsort(key, kind="stable")
            key = key[order]
            tag = np.repeat(np.array(tags, np.uint32), sizes)[order]
            ref = np.repeat(np.array(refs, np.uint32), sizes)[order]
            del order
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            count = np.diff(np.append(first, len(key)))
            several = np.repeat(count > 1, count)
            own, n = np.unique(ref[several], return_counts=True)
            sent = ~several
            sent[first] = True
            ref = np.where(several, np.uint32(SHARED), ref)[sent]
            key, tag = key[sent], tag[sent]
            to = (key % np.uint64(buckets)).astype(np.int32)
            order = np.argsort(to, kind="stable")
            to, key, tag, ref = to[order], key[order], tag[order], ref[order]
            short = (key // np.uint64(buckets)).astype(np.uint32)  # a chance collision only keeps more
            cuts = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1], [True]])).tolist()
            spans = list(zip(cuts, cuts[1:], strict=False))
            # The last record has no hashes: it is what the task itself has counted.
            return _rows(
                schema, len(spans) + 1,
                bucket=[*(int(to[a]) for a, _ in spans), int(base % buckets)],
                base=[base] * (len(spans) + 1),
                keys=[*(short[a:b].tobytes() for a, b in spans), b""],
                tags=[*(tag[a:b].tobytes() for a, b in spans), n.astype(np.uint32).tobytes()],
                refs=[*(ref[a:b].tobytes() for a, b in spans), own.tobytes()],
            )

        held = 0
        for part in text_slices(batches, "text", SET_BYTES):
            found = shingle_sets(part["text"].to_pylist(), words)
            digest = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in found]
            numbers = np.arange(row, row + len(found))
            yield _rows(
                schema, len(found), bucket=(numbers % buckets).astype(np.int32), row=numbers,
                doc_id=part["doc_id"].combine_chunks(), text_key=part["text_key"].combine_chunks(),
                n=[len(s) for s in found], digest=digest,
            )
            for s, d, number in zip(found, digest, numbers.tolist(), strict=True):
                if len(s) and d not in digests:  # of equal sets one speaks for all
                    digests.add(d)
                    # A copy: a view would hold the whole set until its postings are sent.
                    keys.append(s[: len(s) - _overlap(len(s), percent) + _evidence(len(s))].copy())
                    tags.append(int.from_bytes(d[:4], "little"))
                    refs.append(number - base)
                    held += len(keys[-1])
            row += len(found)
            if held >= HELD_POSTINGS:
                yield emit()
                keys, tags, refs, digests, held, base = [], [], [], set(), 0, row
        if held:
            yield emit()

    return map_batches(docs, build, from_arrow_schema(schema))


def _count_shared(records: DataFrame, docs: DataFrame) -> DataFrame:
    """Document rows as they are, and per document and bucket the number of shared hashes."""
    schema = _schema(_FOUND, docs)

    def counted(rows: pa.Table) -> pa.Table:
        given = rows.filter(rows["row"].is_valid()).select(schema.names[:-1])
        given = given.append_column("shared", pa.nulls(given.num_rows, pa.int64()))
        sent = rows.filter(rows["row"].is_null())
        refs: list[np.ndarray] = []
        counts: list[np.ndarray] = []
        posted = []
        for base, k, t, r in zip(*[sent[c].to_pylist() for c in ("base", "keys", "tags", "refs")], strict=True):
            tag, ref = np.frombuffer(t, np.uint32), np.frombuffer(r, np.uint32)
            at = np.where(ref == SHARED, -1, base + ref.astype(np.int64))
            if k:
                posted.append((np.frombuffer(k, np.uint32), tag, at))
            else:
                refs.append(at)
                counts.append(tag.astype(np.int64))
        if posted:
            key, tag, ref = (np.concatenate(c) for c in zip(*posted, strict=True))
            order = np.lexsort((tag, key))
            key, tag, ref = key[order], tag[order], ref[order]
            same = key[1:] == key[:-1]
            first = np.flatnonzero(np.concatenate([[True], ~same]))
            size = np.diff(np.append(first, len(key)))
            other = np.concatenate([[False], same & (tag[1:] != tag[:-1])]) | (ref < 0)
            shared = np.repeat(np.logical_or.reduceat(other, first), size)
            own, n = np.unique(ref[shared & (ref >= 0)], return_counts=True)
            refs.append(own)
            counts.append(n.astype(np.int64))
        row = np.concatenate(refs) if refs else np.zeros(0, np.int64)
        n = np.concatenate(counts) if counts else np.zeros(0, np.int64)
        return pa.concat_tables(
            [given.cast(schema), pa.Table.from_batches([_rows(schema, len(row), row=row, shared=n)])]
        )

    def count(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        found = counted(rows)
        give_back()
        return found

    return records.groupBy("bucket").applyInArrow(count, from_arrow_schema(schema))


def _full_sets(docs: DataFrame, classes: DataFrame, words: int) -> DataFrame:
    """The sets of the classes' representatives: node, n, grams."""
    named = classes.select(
        F.col("first.doc_id").alias("_id"), F.col("first.text_key").alias("_key"), "node", "digest"
    )
    match = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key"))
    wanted = docs.join(named, match).select("text", "node", "digest")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, "text", SET_BYTES):
            found = shingle_sets(part["text"].to_pylist(), words)
            # Id and key may, by chance, belong to several texts.
            kept = [
                (node, s.view(np.int64))
                for node, digest, s in zip(part["node"].to_pylist(), part["digest"].to_pylist(), found, strict=True)
                if hashlib.blake2b(s.tobytes(), digest_size=16).digest() == digest
            ]
            yield pa.RecordBatch.from_pydict(
                {"node": pa.array([k[0] for k in kept], pa.int64()),
                 "n": pa.array([len(k[1]) for k in kept], pa.int64()),
                 "grams": pa.array([k[1] for k in kept], pa.list_(pa.int64()))}
            )

    return map_batches(wanted, build, "node long, n long, grams array<long>").dropDuplicates(["node"])


def _by_rarity(sets: DataFrame, percent: int) -> DataFrame:
    """Per set the n-grams of its 2-prefix that other sets have too, rarest first: node, n, prefix, room.

    ``room`` is the number of them in the 1-prefix; n-grams of no other set come first in both.
    """
    exploded = sets.select("node", "n", F.explode("grams").alias("gram"))
    counts = exploded.groupBy("gram").agg(F.count("*").alias("df")).where("df > 1")
    shared = exploded.join(counts, "gram").groupBy("node", "n").agg(
        F.array_sort(F.collect_list(F.struct("df", "gram"))).alias("prefix")
    )
    least = F.ceil(F.col("n") * percent / 100)
    room = F.col("n") - least + 1 - (F.col("n") - F.size("prefix"))
    return (
        shared.withColumn("room", room.cast("int")).where("room > 0 AND n > 1")
        .withColumn("prefix", F.slice("prefix", 1, F.col("room") + 1))
    )


def _bin(n: Column) -> Column:
    return F.ceil(F.log(n) / math.log(BIN)).cast("int")


def boundary(prefixes: DataFrame, percent: int) -> int:
    """The set size up to which enumerating subsets costs less than scanning lists.

    Costs are keys made for a small set and list entries made and scanned for a large one, summed over
    all sets by bins of size (some dozens of rows).
    """
    size = F.size("prefix")
    costs = (
        prefixes.groupBy(_bin(F.col("n")).alias("bin"))
        .agg(F.sum(size * (size - 1) / 2).alias("light"), F.sum(ENTRY_COST * F.col("room")).alias("heavy")).collect()
    )
    light = {r["bin"]: float(r["light"]) for r in costs}
    heavy = {r["bin"]: float(r["heavy"]) for r in costs}
    best = (sum(heavy.values()), 0)
    for edge in sorted(light):
        lists = edge - math.ceil(math.log(100 / percent) / math.log(BIN))  # smaller partners of large sets
        cost = sum(c for b, c in light.items() if b <= edge) + sum(c for b, c in heavy.items() if b > lists)
        best = min(best, (cost, math.floor(BIN**edge)))
    return best[1]


def _members(prefixes: DataFrame, edge: int, percent: int) -> DataFrame:
    """List entries (key, node, n, weight, rest): subsets of small sets, single n-grams of the others.

    ``rest`` is the most that the set can share with one whose first common n-grams are the key's: these
    and what comes after them.
    """
    weight = F.aggregate("prefix", F.lit(0).cast("long"), lambda acc, x: acc + x["df"]) / F.col("n")
    least = F.ceil(F.col("n") * percent / 100)
    shared = least - 1 + F.col("room")  # all n-grams of the set that others have, too
    grams = F.transform(
        "prefix", lambda x, i: F.struct(x["gram"].alias("key"), (F.col("shared") - i).alias("rest"))
    )
    both = prefixes.withColumn("shared", shared).select(
        "node", "n", weight.alias("weight"), grams.alias("grams"), "room"
    )
    pairs = F.flatten(
        F.transform(
            "grams",
            lambda x, i: F.transform(
                F.slice("grams", i + 2, F.size("grams")),
                lambda y: F.struct(
                    F.xxhash64(F.least(x["key"], y["key"]), F.greatest(x["key"], y["key"]), F.lit("pair")).alias("key"),
                    (y["rest"] + 1).alias("rest"),
                ),
            ),
        )
    )
    light = both.where(F.col("n") <= edge).select("node", "n", "weight", F.inline(pairs))
    heavy = both.where(F.col("n") * 100 > edge * percent).select(
        "node", "n", "weight", F.inline(F.slice("grams", 1, F.col("room")))
    )
    found = stage_table(light.unionByName(heavy), "entries")
    lists = found.groupBy("key").agg(F.count("*").alias("size")).where("size > 1").select("key")
    return stage_table(found.join(lists, "key"), "members")


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose similarity reaches ``percent``, by their whole sets."""
    own = sets.select(F.col("node").alias("a"), F.col("grams").alias("grams_a"))
    other = sets.select(F.col("node").alias("b"), F.col("grams").alias("grams_b"))
    common = F.size(F.array_intersect("grams_a", "grams_b"))
    union = F.size("grams_a") + F.size("grams_b") - common
    return pairs.join(own, "a").join(other, "b").where(common * 100 >= union * percent).select("a", "b")


def _possible(percent: int) -> Column:
    """Whether sets of n and m, which share at most ``rest`` and ``rest_b``, can be similar."""
    sizes = F.least("n", "m") * 100 >= F.greatest("n", "m") * percent
    return sizes & (F.least("rest", "rest_b") * (100 + percent) >= (F.col("n") + F.col("m")) * percent)


def _components(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """node, comp of all members, after all links between components are found."""
    comps = stage_table(members.select("node").distinct().withColumn("comp", F.col("node")), "comps")
    tested = None
    for turn in range(ROUNDS + 1):
        placed = members.join(comps, "node")
        rank = F.col("weight") if turn == 0 else F.xxhash64("node", F.lit(turn))
        lists = placed.groupBy("key").agg(
            F.max(F.struct(rank.alias("rank"), "node", "n", "comp", "rest")).alias("centre"),
            F.min("comp").alias("low"), F.max("comp").alias("high"),
        ).where("low < high")
        if turn < ROUNDS:
            lists = lists.select(
                "key", F.col("centre.node").alias("b"), F.col("centre.n").alias("m"),
                F.col("centre.comp").alias("comp_b"), F.col("centre.rest").alias("rest_b"),
            )
            pairs = placed.join(lists, "key")
        else:  # what is left: members of different components
            placed = placed.join(lists.select("key"), "key")
            pairs = placed.join(
                placed.select(
                    "key", F.col("node").alias("b"), F.col("n").alias("m"), F.col("comp").alias("comp_b"),
                    F.col("rest").alias("rest_b"),
                ),
                "key",
            )
        pairs = pairs.where((F.col("comp") != F.col("comp_b")) & _possible(percent)).select(
            F.least("node", "b").alias("a"), F.greatest("node", "b").alias("b")
        ).distinct()
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = stage_table(pairs, "pairs")
        if pairs.isEmpty():  # no member can be like its centre; other members may be like each other
            continue
        linked = stage_table(_linked(pairs, sets, percent), "links")
        tested = pairs if tested is None else tested.union(pairs)
        if linked.isEmpty():
            continue
        edges = (
            linked.join(comps.select(F.col("node").alias("a"), F.col("comp").alias("ca")), "a")
            .join(comps.select(F.col("node").alias("b"), F.col("comp").alias("cb")), "b")
            .select(F.col("ca").alias("a"), F.col("cb").alias("b"))
        )
        merged = components(edges)
        comps = stage_table(
            comps.join(merged.withColumnRenamed("node", "comp"), "comp", "left")
            .select("node", F.coalesce("label", "comp").alias("comp")),
            "comps",
        )
    return comps


def near_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT,
) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (the smallest doc_id that links reach, or its own), and
    text_key and first (whether this is the one row of its component that has the smallest id).

    Two texts link if the Jaccard similarity of their sets of runs of ``words`` words is at least
    ``percent`` / 100. A-Z count as lower case; words are separated by ASCII white space; a text of
    fewer words is one run. Null and empty texts have no runs and link with nothing. Equal texts are
    one class (they always link); repeated rows and repeated ids are kept; a null id is never the
    smallest, and a component of null ids alone has a null id. Other columns are not read. No rows
    give no rows.
    """
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    docs = docs.withColumn("text_key", F.xxhash64("text"))
    spark = docs.sparkSession
    buckets = 8 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = stage_table(_count_shared(_sets_and_postings(docs, words, percent, buckets), docs), "sets")
    rows = found.where(F.col("shared").isNull()).drop("shared")
    shared = found.where(F.col("shared").isNotNull()).groupBy("row").agg(F.sum("shared").alias("shared"))
    # Classes of equal sets; every row that stood for its class in a task knows its count.
    enough = F.greatest(F.lit(1), F.floor(F.ceil(F.col("n") * percent / 100) / 10))
    classes = stage_table(
        rows.where("n > 0").join(shared, "row", "left").groupBy("digest", "n").agg(
            F.min("row").alias("node"),
            F.min(F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "row")).alias("least"),
            F.max("shared").alias("shared"), F.min_by(F.struct("doc_id", "text_key"), "row").alias("first"),
        ).withColumn("alive", F.coalesce(F.col("shared") >= enough, F.lit(False))),
        "classes",
    )
    alive = classes.where("alive")
    labels = None
    if not alive.isEmpty():
        sets = stage_table(_full_sets(docs, alive, words), "full_sets")
        prefixes = stage_table(_by_rarity(sets, percent), "prefixes")
        if not prefixes.isEmpty():
            members = _members(prefixes, boundary(prefixes, percent), percent)
            labels = _components(members, sets, percent)
    if labels is None:
        named = classes.select("digest", "least")
    else:
        joined = classes.drop("first", "shared").join(labels, "node", "left")
        joined = joined.withColumn("comp", F.coalesce("comp", "node"))
        least = joined.groupBy("comp").agg(F.min("least").alias("first"))
        named = joined.join(least, "comp").select("digest", F.col("first").alias("least"))
    return rows.join(named, "digest", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("least.doc_id", "doc_id").alias("component_id"),
        "text_key", F.coalesce(F.col("least.row") == F.col("row"), F.lit(True)).alias("first"),
    )


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of docs without near duplicates: of each component the row of the smallest id stays.

    Options and edge cases: see near_duplicates. All rows without words stay.
    """
    i, t, empty = free_names(docs, "kept_id", "kept_text", "kept_empty")
    kept = near_duplicates(docs, doc_id, text, **options).where("first").select(
        F.col("doc_id").alias(i), F.col("text_key").alias(t), (F.col("n_shingles") == 0).alias(empty)
    )
    kept = stage_table(kept, "kept")
    match = F.col(doc_id).eqNullSafe(F.col(i)) & F.xxhash64(text).eqNullSafe(F.col(t))
    out = docs.join(kept.select(i, t).distinct(), match, "left_semi")
    # Rows that agree in id and text are in one component; all but one of them go.
    twice = docs.select(F.col(doc_id).alias(i), F.xxhash64(text).alias(t)).groupBy(i, t).agg(F.count("*").alias(empty))
    if twice.where(F.col(empty) > 1).isEmpty():
        return out
    words = kept.where(~F.col(empty)).select(i, t)
    single = out.join(words, match, "left_semi").dropDuplicates([doc_id, text])
    return single.unionByName(out.join(words, match, "left_anti"))
