"""Alignment of two tokenizations of the same texts, and how often their tokens meet.

Both tokenizers cut a text's bytes into tokens. All tokens of a batch of texts are sorted by their start;
where a start reaches the running maximum of the ends, nothing overlaps the cut, so a group begins. Within
the groups each pair of tokens that overlap is a link. A link counts as often as its pair of ids is linked
in the whole corpus.

Documents are worked on in blocks of bounded size. A block sends each distinct pair once, with its count,
and gets back the pair's count in the corpus; its documents' links are kept as places in that list. So the
shuffles carry distinct pairs of blocks instead of links, no table of pairs is broadcast, and a task holds
one block's list.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tamis.llm.common import partitions_for, text_slices
from tamis.llm.tokenizing import ByteEncoder, tokenizer_file
from tamis.staging import stage_table

BYTE_TOKENIZER = "byte_bpe_50k.json"
BYTE_RANKS = "byte_bpe_50k.tiktoken"
PIECE_TOKENIZER = "piece_bpe_32k.model"
# Texts are aligned in slices of about so many bytes; a block ends with the slice that fills it.
SLICE_BYTES = 1_000_000
BLOCK_BYTES = 8_000_000


def _byte_alphabet() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable Latin-1 signs stand for
    themselves, the others, in order, are moved behind U+0100."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + n): b for n, b in enumerate(others)}


class ByteTokens(ByteEncoder):
    """Byte-level BPE in which strings of special tokens are ordinary text."""

    def __init__(self, name: str, ranks: str | None):
        super().__init__(name, ranks)
        self.exact.encode_special_tokens = True
        self.special = []
        alphabet, vocabulary = _byte_alphabet(), self.exact.get_vocab(with_added_tokens=True)
        self.bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            known = all(c in alphabet for c in token)
            self.bytes[i] = bytes(alphabet[c] for c in token) if known else token.encode()
        self.lengths = np.array([len(b) for b in self.bytes], np.int64)


class PieceTokens:
    """Pieces with byte fallback; a space goes before the text."""

    def __init__(self, name: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=tokenizer_file(name))
        pieces = [self.model.id_to_piece(i) for i in range(self.model.vocab_size())]
        self.bytes = [
            bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode()
            for i, p in enumerate(pieces)
        ]
        self.lengths = np.array([len(b) for b in self.bytes], np.int64)

    def __call__(self, text: str) -> np.ndarray:
        return np.array(self.model.encode(text), np.int64)


@functools.lru_cache(maxsize=2)
def tokenizers(bytes_name: str, ranks: str | None, pieces_name: str) -> tuple[ByteTokens, PieceTokens]:
    return ByteTokens(bytes_name, ranks), PieceTokens(pieces_name)


def coalesce(
    a_start: np.ndarray, a_end: np.ndarray, b_start: np.ndarray, b_end: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """The group of each interval of two lists: groups end where no interval reaches across."""
    start, end = np.concatenate([a_start, b_start]), np.concatenate([a_end, b_end])
    order = np.lexsort((end, start))
    reach = np.maximum.accumulate(end[order])
    begins = np.ones(len(order), bool)
    begins[1:] = start[order[1:]] >= reach[:-1]
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(begins) - 1
    return group[: len(a_start)], group[len(a_start) :]


def overlaps(
    a_start: np.ndarray, a_end: np.ndarray, b_start: np.ndarray, b_end: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of intervals that overlap, by the places in their lists (in order, none empty)."""
    first = np.searchsorted(b_end, a_start, "right")
    number = np.maximum(np.searchsorted(b_start, a_end, "left") - first, 0)
    a = np.repeat(np.arange(len(a_start)), number)
    return a, np.arange(len(a)) - np.repeat(np.cumsum(number) - number - first, number)


class Aligned:
    """Texts as tokens of both tokenizers, one after another over one line of bytes."""

    def __init__(self, texts: list[str | None], byte_tokens: ByteTokens, piece_tokens: PieceTokens):
        none = np.zeros(0, np.int64)
        a_ids, b_ids = [], []
        for text in texts:
            a = b = none
            if text:
                own = " " + text
                whole = own.encode()
                a, b = byte_tokens(own).astype(np.int64), piece_tokens(text)
                for ids, table in ((a, byte_tokens.bytes), (b, piece_tokens.bytes)):
                    if b"".join(map(table.__getitem__, ids.tolist())) != whole:
                        a = b = none
                        break
            a_ids.append(a)
            b_ids.append(b)
        self.n_a, self.n_b = (np.array([len(x) for x in ids], np.int64) for ids in (a_ids, b_ids))
        self.a, self.b = np.concatenate([none, *a_ids]), np.concatenate([none, *b_ids])
        a_end, b_end = np.cumsum(byte_tokens.lengths[self.a]), np.cumsum(piece_tokens.lengths[self.b])
        a_start, b_start = a_end - byte_tokens.lengths[self.a], b_end - piece_tokens.lengths[self.b]
        self.group_a, self.group_b = coalesce(a_start, a_end, b_start, b_end)
        doc_a = np.repeat(np.arange(len(texts)), self.n_a)
        link_a, link_b = overlaps(a_start, a_end, b_start, b_end)
        self.link_doc = doc_a[link_a]
        self.pairs = self.a[link_a] << 32 | self.b[link_b]
        begins = np.diff(self.group_a, prepend=-1) > 0  # each group holds tokens of both
        self.n_groups = np.bincount(doc_a[begins], minlength=len(texts))
        self.n_links = np.bincount(self.link_doc, minlength=len(texts))

    def written(self, names: list[bytes]) -> Iterator[bytes]:
        """Each text's groups as a1,a2|b1;a3|b2,b3. names: of each id, followed by , and | and ;"""
        last_a = np.diff(self.group_a, append=-1) != 0
        last_b = np.diff(self.group_b, append=-1) != 0
        order = np.argsort(np.concatenate([2 * self.group_a, 2 * self.group_b + 1]), kind="stable")
        codes = np.concatenate([3 * self.a + last_a, 3 * self.b + 2 * last_b])[order].tolist()
        at = 0
        for n in (self.n_a + self.n_b).tolist():
            yield b"".join(map(names.__getitem__, codes[at : at + n]))[:-1]
            at += n


def _packed(places: np.ndarray, counts: np.ndarray, squeeze: zstandard.ZstdCompressor) -> bytes:
    """Rising places in a block's list, and how often each occurs."""
    return squeeze.compress(np.concatenate([np.diff(places, prepend=0), counts]).astype("<u4").tobytes())


def _unpacked(packed: bytes, restore: zstandard.ZstdDecompressor) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(restore.decompress(packed), "<u4").astype(np.int64)
    return np.cumsum(both[: len(both) // 2]), both[len(both) // 2 :]


_COUNTS = ("n_a", "n_b", "n_groups", "n_links")


def _blocks(docs: DataFrame, files: tuple[str, str | None, str]) -> DataFrame:
    """A row for each document with its own counts and packed links, and one for each block's pairs."""
    schema = T.StructType(
        [T.StructField("block", T.LongType()), T.StructField("doc_id", docs.schema["doc_id"].dataType),
         *[T.StructField(c, T.LongType()) for c in _COUNTS], T.StructField("groups_sha256", T.StringType()),
         T.StructField("links", T.BinaryType()), T.StructField("pairs", T.ArrayType(T.LongType())),
         T.StructField("counts", T.ArrayType(T.LongType()))]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        byte_tokens, piece_tokens = tokenizers(*files)
        names = [b"%d%s" % (i, end) for i in range(max(len(byte_tokens.bytes), len(piece_tokens.bytes))) for end in (b",", b"|", b";")]
        squeeze = zstandard.ZstdCompressor(level=1)
        block = TaskContext.get().partitionId() << 32
        waiting: list[tuple[pa.Array, Aligned, list[str]]] = []
        held = 0

        def finished() -> Iterator[pa.RecordBatch]:
            nothing = pa.nulls(1, docs_type)
            pairs, at = np.unique(np.concatenate([x.pairs for _, x, _ in waiting]), return_inverse=True)
            counts, done = np.bincount(at, minlength=len(pairs)), 0
            for ids, x, hashes in waiting:
                own = at[done : done + len(x.pairs)]
                done += len(x.pairs)
                # The distinct pairs of each document, in order, with their counts.
                keys, times = np.unique(x.link_doc * len(pairs) + own, return_counts=True)
                ends = np.searchsorted(keys, (np.arange(len(hashes)) + 1) * len(pairs)) if len(pairs) else [0] * len(hashes)
                places, links, begin = keys % max(len(pairs), 1), [], 0
                for end in ends:
                    links.append(_packed(places[begin:end], times[begin:end], squeeze))
                    begin = end
                numbers = [pa.array(getattr(x, c), pa.int64()) for c in _COUNTS]
                n = len(hashes)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, block)), ids, *numbers, pa.array(hashes, pa.string()),
                     pa.array(links, pa.binary()), pa.nulls(n, pa.list_(pa.int64())), pa.nulls(n, pa.list_(pa.int64()))],
                    names=schema.names,
                )
            yield pa.RecordBatch.from_arrays(
                [pa.array([block]), nothing, *[pa.nulls(1, pa.int64())] * len(_COUNTS), pa.nulls(1, pa.string()),
                 pa.nulls(1, pa.binary()), pa.array([pairs], pa.list_(pa.int64())),
                 pa.array([counts], pa.list_(pa.int64()))],
                names=schema.names,
            )

        docs_type = None
        for part in text_slices(batches, "text", SLICE_BYTES):
            ids, texts = part["doc_id"].combine_chunks(), part["text"].to_pylist()
            docs_type = ids.type
            x = Aligned(texts, byte_tokens, piece_tokens)
            hashes = [hashlib.sha256(w).hexdigest() if w else "" for w in x.written(names)]
            x.group_a = x.group_b = x.a = x.b = None  # only pairs are needed from here on
            waiting.append((ids, x, hashes))
            held += sum(len(t or "") for t in texts)
            if held >= BLOCK_BYTES:
                yield from finished()
                waiting.clear()
                block, held = block + 1, 0
        if waiting:
            yield from finished()

    return docs.mapInArrow(run, schema)


def alignments(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", byte_tokenizer: str = BYTE_TOKENIZER,
    byte_ranks: str | None = BYTE_RANKS, piece_tokenizer: str = PIECE_TOKENIZER,
) -> DataFrame:
    """Per row: doc_id, n_a, n_b (tokens), n_groups, n_links, n_best, count_sum, groups_sha256.

    A is the byte-level tokenizer, on a space and the text; B the piece tokenizer on the text, before
    which it puts a space. Special tokens' strings in texts are ordinary text. The groups are the finest
    cuts of the bytes at which tokens of both end; a link is a pair of an A and a B token that overlap.
    n_best counts the links whose pair of ids is linked most often, over all documents, of all pairs with
    that B id (ties included); count_sum adds up the corpus counts of the links' pairs. groups_sha256 is of
    the ids as ``a1,a2|b1;a3|b2,b3``.

    Null and empty texts have no tokens, nor have texts whose tokens don't give back their bytes (B turns
    U+2581 into a space): zeros, and an empty groups_sha256. Very long texts are worked on whole, one at
    a time. Repeated rows are rows of their own and count again; null ids are kept; other columns are not
    read; no rows give no rows.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    made = stage_table(_blocks(rows, (byte_tokenizer, byte_ranks, piece_tokenizer)), "aligned")
    of_blocks = made.where(F.col("pairs").isNotNull()).select(
        "block", F.posexplode(F.arrays_zip("pairs", "counts")).alias("place", "x")
    ).select("block", "place", F.col("x.pairs").alias("pair"), F.col("x.counts").alias("n"))
    piece = F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF))
    # The pairs of a B id are at most as many as A has ids.
    counted = of_blocks.groupBy("pair").agg(F.sum("n").alias("total")).withColumn(
        "best", F.col("total") == F.max("total").over(Window.partitionBy(piece))
    )
    answers = of_blocks.select("block", "place", "pair").join(counted, "pair").select(
        "block", F.lit(0).alias("side"), F.struct("place", "total", "best").alias("answer"),
        F.lit(None).cast(made.drop("block", "pairs", "counts").schema).alias("doc"),
    )
    kept = made.where(F.col("pairs").isNull()).select(
        "block", F.lit(1).alias("side"), F.lit(None).cast(answers.schema["answer"].dataType).alias("answer"),
        F.struct(*[c for c in made.columns if c not in ("block", "pairs", "counts")]).alias("doc"),
    )
    fields = kept.schema["doc"].dataType.names
    schema = T.StructType(
        [made.schema["doc_id"], *[T.StructField(c, T.LongType()) for c in (*_COUNTS, "n_best", "count_sum")],
         T.StructField("groups_sha256", T.StringType())]
    )

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The blocks come one after another, each with its answers before its documents."""
        restore = zstandard.ZstdDecompressor()
        now, totals, best = None, np.zeros(0, np.int64), np.zeros(0, bool)
        parts: list[tuple[np.ndarray, ...]] = []
        for batch in batches:
            blocks, sides = batch.column("block").to_numpy(), batch.column("side").to_numpy()
            cuts = np.flatnonzero(np.diff(blocks * 2 + sides, prepend=-1, append=-1))
            for begin, end in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                if blocks[begin] != now:
                    now, parts, totals = blocks[begin], [], None
                if sides[begin] == 0:
                    answer = batch.column("answer").slice(begin, end - begin)
                    place, total, is_best = answer.flatten()
                    parts.append((place.to_numpy(), total.to_numpy(), is_best.to_numpy(zero_copy_only=False)))
                    continue
                if totals is None:
                    size = sum(len(p) for p, _, _ in parts)
                    totals, best = np.zeros(size, np.int64), np.zeros(size, bool)
                    for place, total, is_best in parts:
                        totals[place], best[place] = total, is_best
                    parts = []
                doc = dict(zip(fields, batch.column("doc").slice(begin, end - begin).flatten(), strict=True))
                n_best, sums = [], []
                for links in doc["links"].to_pylist():
                    places, times = _unpacked(links, restore)
                    n_best.append(int(times[best[places]].sum()))
                    sums.append(int((times * totals[places]).sum()))
                doc |= {"n_best": pa.array(n_best, pa.int64()), "count_sum": pa.array(sums, pa.int64())}
                yield pa.RecordBatch.from_arrays([doc[f.name] for f in schema], names=schema.names)

    tasks = partitions_for(spark, made.where(F.col("pairs").isNotNull()).count(), 16)
    together = answers.unionByName(kept).repartition(tasks, "block").sortWithinPartitions("block", "side")
    return together.mapInArrow(summed, schema)
