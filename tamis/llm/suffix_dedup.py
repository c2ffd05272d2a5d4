"""Removal of repeated byte strings, by a distributed merge sort of suffixes that knows common prefixes.

Sorting every suffix of 100 TB is not affordable, so suffixes are sorted where a repeated string must
show: each string of 100 bytes has an anchor, the place of the smallest hash of its 32-byte grams, and
equal strings have equal anchors. An anchor with the strings that it stands for is one suffix: the bytes
from the anchor on, then those before it.

1. Texts that are whole copies of an earlier one go. Anchors whose gram occurs once are dropped (a
   counting shuffle of hashes).
2. Each task sorts the suffixes of its texts into runs with the lengths of common prefixes. A suffix is
   sent as a prefix that tells most of them apart and a fingerprint of the whole. Runs are front-coded
   (what a suffix has in common with the one before is not sent), cut at sampled splitters and exchanged.
   Loser trees merge the runs; they carry common prefixes along and never compare known ones again. A
   suffix equal to an earlier one has all its strings removed.
3. Suffixes next to a different one with the same gram may share only some strings. These strings, where
   their middle parts occur twice, are compared by themselves.
"""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema
from pyspark.sql.types import StructType

from tamis.llm.common import discard, stage_for_now, text_slices
from tamis.llm.hashing import BYTE_VALUES, mixed
from tamis.llm.prefix import running_sums
from tamis.staging import stage_table

LENGTH = 100  # bytes of a string that is removed where it is repeated
GRAM = 32
GRAMS = LENGTH - GRAM + 1  # in a string
# Window starts of a text that are looked at together; places fit into 24 bits.
PIECE = 1 << 20
HELD_ANCHORS = 2_000_000  # of a task before it sends them
HELD_STRINGS = 2_000_000  # of a task before it sends them
HELD_SUFFIXES = 400_000  # in a sorted run of a task (some 200 bytes each)
PREFIX = 40  # bytes of a suffix that are sent with its fingerprint
SAMPLES = 16  # suffixes per destination from which splitters are taken
SAMPLED = 1024  # of so many anchors one may be a sample
HALF = (GRAMS + 1) // 2  # strings are told apart by anchor offsets below and from here
_MULTIPLIERS = [np.uint64(m) for m in (
    0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]
# What is known of an anchor: row (counted from a base), first string's start, strings, offset in the first.
ANCHOR = np.dtype([("row", "<u4"), ("start", "<u4"), ("n", "u1"), ("offset", "u1")])


def _schema(ddl: str) -> pa.Schema:
    return to_arrow_schema(StructType.fromDDL(ddl))


def _rows(schema: pa.Schema, number: int, /, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(number, f.type) for f in schema],
        schema=schema,
    )


# Anchors


def _hashes(codes: np.ndarray, size_steps: tuple[int, ...]) -> np.ndarray:
    """Hashes of the runs of bytes whose length is 1 plus the steps."""
    h = BYTE_VALUES[codes]
    for step, multiplier in zip(size_steps, _MULTIPLIERS, strict=False):
        h = h[:-step] * multiplier + h[step:]
    return mixed(h)


def anchors(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Gram hash, first string's start, number of strings and the anchor's offset in the first one."""
    out: list[tuple[np.ndarray, ...]] = []
    codes = np.frombuffer(data, dtype=np.uint8)
    for base in range(0, len(codes) - LENGTH + 1, PIECE):
        own = codes[base : base + PIECE + LENGTH - 1]
        hashes = _hashes(own, (1, 2, 4, 8, 16))  # of 32 bytes
        # Equal hashes go by place, so the leftmost is the smallest.
        least = (hashes & ~np.uint64(0xFFFFFF)) | np.arange(len(hashes), dtype=np.uint64)
        for step in (1, 2, 4, 8, 16, 32):
            least = np.minimum(least[:-step], least[step:])
        rest = GRAMS - 64
        least = np.minimum(least[:-rest], least[rest:])
        place = (least & np.uint64(0xFFFFFF)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        at = place[first]
        out.append((hashes[at], first + base, np.diff(np.append(first, len(place))), at - first))
    if not out:
        return (np.zeros(0, np.uint64), *(np.zeros(0, np.int64),) * 3)
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


_POSTED = (
    "bucket int, row long, doc_id long, text_key long, digest binary, n_bytes long, sample binary, "
    "base long, keys binary, anchors binary"
)
_ANCHORED = "row long, doc_id long, text_key long, digest binary, n_bytes long, sample binary, anchors binary"


def _post_anchors(docs: DataFrame, buckets: int) -> DataFrame:
    """Rows of documents, and anchors by bucket of their gram; see the n-gram join for the scheme.

    Grams that a task has several times are known to be shared: their anchors go to their documents
    at once and one hash tells the other tasks.
    """
    schema = _schema(_POSTED)

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = base = TaskContext.get().partitionId() << 33
        keys: list[np.ndarray] = []
        found: list[np.ndarray] = []

        def emit() -> pa.RecordBatch:
            key, anchor = np.concatenate(keys), np.concatenate(found)
            order = np.argsort(key, kind="stable")
            key, anchor = key[order], anchor[order]
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            count = np.diff(np.append(first, len(key)))
            several = np.repeat(count > 1, count)
            known = np.sort(anchor[several], order=["row", "start"])
            spans = _cuts(known["row"])
            rows = [base + int(known["row"][a]) for a, _ in spans]
            to = [r % buckets for r in rows]
            sets = [known[a:b].tobytes() for a, b in spans]
            texts: list[bytes | None] = [None] * len(spans)
            for shared, own, posted in (
                (True, key[first][count > 1], None), (False, key[~several], anchor[~several]),
            ):
                bucket = (own % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                bucket, own = bucket[order], (own[order] // np.uint64(buckets)).astype(np.uint32)
                for a, b in _cuts(bucket):
                    to.append(int(bucket[a]))
                    rows.append(None)
                    texts.append(own[a:b].tobytes())
                    sets.append(None if shared else posted[order[a:b]].tobytes())
            return _rows(schema, len(to), bucket=to, row=rows, base=[base] * len(to), keys=texts, anchors=sets)

        held = 0
        for part in text_slices(batches, "text"):
            numbers = np.arange(row, row + part.num_rows)
            texts = [(t or "").encode() for t in part["text"].to_pylist()]
            yield _rows(
                schema, part.num_rows, bucket=(numbers % buckets).astype(np.int32), row=numbers,
                doc_id=part["doc_id"].combine_chunks(), text_key=part["text_key"].combine_chunks(),
                digest=[hashlib.blake2b(t, digest_size=16).digest() for t in texts], n_bytes=[len(t) for t in texts],
            )
            samples: list[bytes] = []
            for number, data in zip(numbers.tolist(), texts, strict=True):
                key, start, n, offset = anchors(data)
                for i in np.flatnonzero(key % np.uint64(SAMPLED) == 0).tolist():
                    at = int(start[i] + offset[i])
                    samples.append(data[at : at + PREFIX])
                if len(key):
                    anchor = np.zeros(len(key), ANCHOR)
                    anchor["row"], anchor["start"], anchor["n"], anchor["offset"] = number - base, start, n, offset
                    keys.append(key)
                    found.append(anchor)
                    held += len(key)
            if samples:
                yield _rows(schema, len(samples), bucket=[row % buckets] * len(samples), sample=samples)
            row += part.num_rows
            if held >= HELD_ANCHORS:
                yield emit()
                keys, found, held, base = [], [], 0, row
        if held:
            yield emit()

    return docs.mapInArrow(post, from_arrow_schema(schema))


def _shared_anchors(posted: DataFrame) -> DataFrame:
    """Rows of documents and samples as they are, and per document, in parts, its anchors with a shared gram."""
    schema = _schema(_ANCHORED)

    def shared(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        posted = table["keys"].is_valid()
        parts = [table.filter(pa.compute.invert(posted)).select(schema.names).cast(schema)]
        sent = table.filter(posted)
        keys, bases, found = [], [], []
        for base, k, a in zip(sent["base"].to_pylist(), sent["keys"].to_pylist(), sent["anchors"].to_pylist(), strict=True):
            own = np.frombuffer(k, np.uint32)
            keys.append(own)
            bases.append(np.full(len(own), -1 if a is None else base))
            found.append(np.zeros(len(own), ANCHOR) if a is None else np.frombuffer(a, ANCHOR))
        if keys:
            key, base, anchor = np.concatenate(keys), np.concatenate(bases), np.concatenate(found)
            order = np.argsort(key, kind="stable")
            key, base, anchor = key[order], base[order], anchor[order]
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            count = np.diff(np.append(first, len(key)))
            keep = np.repeat(count > 1, count) & (base >= 0)  # a shared hash of one task alone has its own
            rows = base[keep] + anchor["row"][keep].astype(np.int64)
            order = np.argsort(rows, kind="stable")
            rows, anchor = rows[order], anchor[keep][order]
            spans = _cuts(rows)
            parts.append(pa.Table.from_batches([_rows(
                schema, len(spans), row=[int(rows[a]) for a, _ in spans], anchors=[anchor[a:b].tobytes() for a, b in spans]
            )]))
        return pa.concat_tables(parts)

    return posted.groupBy("bucket").applyInArrow(shared, from_arrow_schema(schema))


# Runs


def front_coded(suffixes: list[bytes]) -> tuple[np.ndarray, bytes, np.ndarray]:
    """Common prefix with the suffix before, the rests' lengths, and all rests in one string."""
    common = np.zeros(len(suffixes), np.uint8)
    for i in range(1, len(suffixes)):
        common[i] = prefix_from(suffixes[i - 1], suffixes[i], 0)
    rests = [s[c:] for s, c in zip(suffixes, common.tolist(), strict=True)]
    return common, b"".join(rests), np.array([len(r) for r in rests], np.uint8)


def decoded(common: np.ndarray, rests: bytes, lengths: np.ndarray) -> list[bytes]:
    out, at, before = [], 0, b""
    for c, n in zip(common.tolist(), lengths.tolist(), strict=True):
        before = before[:c] + rests[at : at + n]
        out.append(before)
        at += n
    return out


def prefix_from(a: bytes, b: bytes, known: int) -> int:
    """Length of the common prefix, of which ``known`` bytes need no comparison."""
    end = min(len(a), len(b))
    while known + 16 <= end and a[known : known + 16] == b[known : known + 16]:
        known += 16
    while known < end and a[known] == b[known]:
        known += 1
    return known


def merged(runs: list[tuple[list[bytes], list[int]]]) -> Iterator[tuple[int, int, int]]:
    """Merge sorted runs (suffixes, common prefixes with the one before) by a loser tree.

    Yields (run, place in it, common prefix with the suffix yielded before). Every suffix in the tree
    knows its common prefix with the last winner; where these differ they alone decide, and where they
    agree the comparison begins behind them.
    """
    size = 1
    while size < len(runs):
        size *= 2
    at = [0] * size
    now: list[bytes | None] = [r[0][0] if r[0] else None for r in runs] + [None] * (size - len(runs))
    common = [0] * size
    losers = [0] * size

    def play(a: int, b: int) -> tuple[int, int]:
        """Winner and loser; the loser's common prefix becomes that with the winner."""
        x, y = now[a], now[b]
        if y is None:
            return a, b
        if x is None:
            return b, a
        p, q = common[a], common[b]
        if p > q:
            return a, b
        if p < q:
            return b, a
        h = prefix_from(x, y, p)
        # A prefix of the other is smaller; of equal ones the earlier run wins.
        a_first = h == len(x) and (h < len(y) or a < b) or h < len(x) and h < len(y) and x[h] < y[h]
        if a_first:
            common[b] = h
            return a, b
        common[a] = h
        return b, a

    def build(node: int) -> int:
        if node >= size:
            return node - size
        winner, losers[node] = play(build(2 * node), build(2 * node + 1))
        return winner

    winner = build(1) if size > 1 else 0
    while now[winner] is not None:
        yield winner, at[winner], common[winner]
        at[winner] += 1
        suffixes, prefixes = runs[winner]
        if at[winner] < len(suffixes):
            now[winner], common[winner] = suffixes[at[winner]], prefixes[at[winner]]
        else:
            now[winner] = None
        node, contender = (winner + size) // 2, winner
        while node:
            contender, losers[node] = play(contender, losers[node])
            node //= 2
        winner = contender


# A record is what a run has for a destination, or strings that are removed.
_SENT = "to int, run long, common binary, rests binary, lengths binary, places binary, ord long, start long, end long"
PLACE = np.dtype([("ord", "<i8"), ("start", "<u4"), ("n", "u1"), ("offset", "u1")])


def suffix_of(data: bytes, start: int, n: int, offset: int) -> bytes:
    """The bytes of an anchor's strings, from the anchor on, then those before it, then their shape."""
    at = start + offset
    return data[at : start + n - 1 + LENGTH] + data[start:at] + bytes((n, offset))


def _short(suffix: bytes) -> bytes:
    """A prefix and a fingerprint; equal for equal suffixes alone."""
    return suffix[:PREFIX] + hashlib.blake2b(suffix, digest_size=12).digest()


def _send_runs(texts: DataFrame, splitters: list[bytes]) -> DataFrame:
    """Sorted runs of the suffixes of each task, cut at the splitters; copies within a run are removed.

    ``texts``: ord (the place in the order of documents), text and anchors.
    """
    schema = _schema(_SENT)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = TaskContext.get().partitionId() << 20
        held: list[tuple[bytes, tuple]] = []

        def emit() -> Iterator[pa.RecordBatch]:
            held.sort()
            kept, gone = [], []
            for item in held:  # the earliest of equal suffixes comes first
                (gone if kept and item[0] == kept[-1][0] else kept).append(item)
            suffixes = [s for s, _ in kept]
            cuts = [0, *(bisect.bisect_left(suffixes, s) for s in splitters), len(suffixes)]
            for to, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                if a < b:
                    common, rests, lengths = front_coded(suffixes[a:b])
                    yield _rows(
                        schema, 1, to=[to], run=[run], common=[common.tobytes()], rests=[rests],
                        lengths=[lengths.tobytes()], places=[np.array([p for _, p in kept[a:b]], PLACE).tobytes()],
                    )
            if gone:
                yield _rows(
                    schema, len(gone), to=[i % (len(splitters) + 1) for i in range(len(gone))],
                    ord=[p[0] for _, p in gone], start=[p[1] for _, p in gone],
                    end=[p[1] + p[2] - 1 + LENGTH for _, p in gone],
                )

        for part in text_slices(batches, "text"):
            for order, text, sets in zip(*[part[c].to_pylist() for c in ("ord", "text", "anchors")], strict=True):
                data = text.encode()
                for own in sets:
                    for _, start, n, offset in np.frombuffer(own, ANCHOR).tolist():
                        held.append((_short(suffix_of(data, start, n, offset)), (order, start, n, offset)))
                if len(held) >= HELD_SUFFIXES:
                    yield from emit()
                    held.clear()
                    run += 1
        if held:
            yield from emit()

    return texts.mapInArrow(build, from_arrow_schema(schema))


# A row is a range of bytes that is removed, or a suffix (n is given) that may share some strings.
_MERGED = "ord long, start long, end long, n int, offset int"


def _merge(sent: DataFrame) -> DataFrame:
    schema = _schema(_MERGED)

    def merge(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        local = table["run"].is_null()
        removed = table.filter(local)
        inputs, places = [], []
        for r in table.filter(pa.compute.invert(local)).to_pylist():
            common = np.frombuffer(r["common"], np.uint8)
            inputs.append((decoded(common, r["rests"], np.frombuffer(r["lengths"], np.uint8)), common.tolist()))
            places.append(np.frombuffer(r["places"], PLACE).tolist())
        gone: list[tuple] = []
        kept: list[list] = []  # earliest place, whether a neighbour has its gram
        before = -1
        for run, at, common in merged(inputs) if inputs else ():
            place, size = places[run][at], len(inputs[run][0][at])
            if common == size == before:
                earlier, later = sorted((kept[-1][0], place))
                kept[-1][0] = earlier
                gone.append(later)
                continue
            before = size
            near = bool(kept) and common >= GRAM
            if near:
                kept[-1][1] = True
            kept.append([place, near])
        if kept:  # the neighbours of the ends are elsewhere
            kept[0][1] = kept[-1][1] = True
        rows = [(order, start, start + n - 1 + LENGTH, None, None) for order, start, n, _ in gone]
        rows += [(order, start, None, n, offset) for (order, start, n, offset), near in kept if near]
        rows += zip(*[removed[c].to_pylist() for c in ("ord", "start", "end")], [None] * len(removed), [None] * len(removed), strict=True)
        return pa.table([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)

    return sent.groupBy("to").applyInArrow(merge, from_arrow_schema(schema))


_PART = "ord long, start long, suffix binary"


def _parts(texts: DataFrame) -> DataFrame:
    """The suffixes of the places (``near``) in texts."""
    schema = _schema(_PART)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, "text"):
            rows = [
                (order, p["start"], suffix_of(data, p["start"], p["n"], p["offset"]))
                for order, data, near in zip(
                    part["ord"].to_pylist(), (t.encode() for t in part["text"].to_pylist()), part["near"].to_pylist(), strict=True
                )
                for p in near
            ]
            yield _rows(schema, len(rows), **{c: [r[k] for r in rows] for k, c in enumerate(schema.names)})

    return texts.select("ord", "text", "near").mapInArrow(build, from_arrow_schema(schema))


# Strings of suffixes that are alike in part


_MIDDLE = "middle long, ord long, start long, half int"
# Strings for a bucket, or ranges that are removed.
_STRINGS = "bucket int, strings binary, ord long, start long, end long"
STRING = np.dtype([("hash", "<u8"), ("hash2", "<u4"), ("ord", "<i8"), ("at", "<u4")])


def _matrix(suffixes: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of suffixes in text order (rows of a matrix), their n and offsets."""
    n = np.array([s[-2] for s in suffixes], np.int64)
    offset = np.array([s[-1] for s in suffixes], np.int64)
    width = GRAMS - 1 + LENGTH
    raw = b"".join(
        (s[-2 - o : -2] + s[: -2 - o]).ljust(width, b"\0") for s, o in zip(suffixes, offset.tolist(), strict=True)
    )
    return np.frombuffer(raw, np.uint8).reshape(len(suffixes), width), n, offset


def _cuts(values: np.ndarray) -> list[tuple[int, int]]:
    """Ranges of equal values in a sorted array."""
    if not len(values):
        return []
    edges = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1], [True]])).tolist()
    return list(zip(edges[:-1], edges[1:], strict=True))


def _rolling(matrix: np.ndarray, size: int, salt: int) -> np.ndarray:
    """Hashes of all runs of ``size`` bytes in each row."""
    powers = np.cumprod(np.full(matrix.shape[1], _MULTIPLIERS[salt], np.uint64))
    sums = np.zeros((len(matrix), matrix.shape[1] + 1), np.uint64)
    np.cumsum(BYTE_VALUES[matrix] * powers, axis=1, out=sums[:, 1:])
    # Brought to the same power, so that equal bytes hash alike wherever they stand.
    return mixed((sums[:, size:] - sums[:, :-size]) * powers[::-1][: matrix.shape[1] - size + 1])


def _middles(parts: DataFrame) -> DataFrame:
    """What all strings of a suffix with a low (or high) anchor offset have in common, hashed."""
    schema = _schema(_MIDDLE)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            matrix, n, offset = _matrix(batch.column("suffix").to_pylist())
            size = LENGTH - HALF + 1
            hashes = _rolling(matrix, size, 1)
            order, starts = batch.column("ord").to_numpy(), batch.column("start").to_numpy()
            for half in (0, 1):
                # strings of the half: anchor offsets from half * HALF on, below (half + 1) * HALF
                low = offset - n + 1
                has = (offset >= half * HALF) & (low < (half + 1) * HALF)
                at = np.flatnonzero(has)
                middle = hashes[at, offset[at] - half * HALF] ^ np.uint64(half)
                yield _rows(
                    schema, len(at), middle=middle.view(np.int64), ord=order[at], start=starts[at],
                    half=np.full(len(at), half, np.int32),
                )

    return parts.select("ord", "start", "suffix").mapInArrow(build, from_arrow_schema(schema))


def _firsts(strings: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """The earliest of equal strings, and the ranges (ord, start, end) of all others."""
    strings = np.sort(strings, order=["hash", "hash2", "ord", "at"])
    same = (strings["hash"][1:] == strings["hash"][:-1]) & (strings["hash2"][1:] == strings["hash2"][:-1])
    later = np.concatenate([[False], same])
    gone = np.sort(strings[later], order=["ord", "at"])
    if not len(gone):
        return strings[~later], []
    at = gone["at"].astype(np.int64)
    new = np.concatenate([[True], (gone["ord"][1:] != gone["ord"][:-1]) | (at[1:] > at[:-1] + LENGTH)])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(gone)) - 1
    ranges = zip(gone["ord"][first].tolist(), at[first].tolist(), (at[last] + LENGTH).tolist(), strict=True)
    return strings[~later], list(ranges)


def _send_strings(parts: DataFrame, buckets: int) -> DataFrame:
    """The hashed strings of suffixes with their halves; of a task's equal ones only the earliest."""
    schema = _schema(_STRINGS)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        count = 0

        def emit() -> Iterator[pa.RecordBatch]:
            kept, gone = _firsts(np.concatenate(held))
            to = (kept["hash"] % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(to, kind="stable")
            to, kept = to[order], kept[order]
            spans = _cuts(to)
            yield _rows(
                schema, len(spans), bucket=[int(to[a]) for a, _ in spans], strings=[kept[a:b].tobytes() for a, b in spans]
            )
            if gone:
                columns = {c: [g[k] for g in gone] for k, c in enumerate(("ord", "start", "end"))}
                yield _rows(schema, len(gone), bucket=[g[0] % buckets for g in gone], **columns)

        for batch in batches:
            if not batch.num_rows:
                continue
            matrix, n, offset = _matrix(batch.column("suffix").to_pylist())
            hashes, hashes2 = _rolling(matrix, LENGTH, 2), _rolling(matrix, LENGTH, 3)
            place = np.arange(hashes.shape[1])
            half = batch.column("half").to_numpy()[:, None]
            of = offset[:, None] - place
            at, string = np.nonzero((place < n[:, None]) & (of >= half * HALF) & (of < (half + 1) * HALF))
            own = np.zeros(len(at), STRING)
            own["hash"], own["hash2"] = hashes[at, string], hashes2[at, string] >> np.uint64(32)
            own["ord"] = batch.column("ord").to_numpy()[at]
            own["at"] = batch.column("start").to_numpy()[at] + string
            held.append(own)
            count += len(own)
            if count >= HELD_STRINGS:
                yield from emit()
                held.clear()
                count = 0
        if count:
            yield from emit()

    return parts.select("ord", "start", "suffix", "half").mapInArrow(build, from_arrow_schema(schema))


def _later_strings(sent: DataFrame) -> DataFrame:
    schema = _schema("ord long, start long, end long")

    def later(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        ranges = table.filter(table["ord"].is_valid()).select(schema.names).cast(schema)
        packed = table.filter(table["strings"].is_valid())["strings"].to_pylist()
        gone = _firsts(np.concatenate([np.frombuffer(x, STRING) for x in packed]))[1] if packed else []
        columns = {c: [g[k] for g in gone] for k, c in enumerate(schema.names)}
        return pa.concat_tables([ranges, pa.Table.from_batches([_rows(schema, len(gone), **columns)])])

    return sent.groupBy("bucket").applyInArrow(later, from_arrow_schema(schema))


def _partly_repeated(parts: DataFrame, buckets: int) -> DataFrame:
    """Ranges of strings of these suffixes that also begin earlier: ord, start, end."""
    middles, folder = stage_for_now(_middles(parts), "middles")
    twice = middles.groupBy("middle").agg(F.count("*").alias("n")).where("n > 1").select("middle")
    wanted = middles.join(twice, "middle").select("ord", "start", "half")
    found = stage_table(_later_strings(_send_strings(parts.join(wanted, ["ord", "start"]), buckets)), "later")
    discard(parts.sparkSession, folder)
    return found


_RESULT = "doc_id long, n_bytes long, n_removed long, spans array<struct<start: long, end: long>>, kept binary"


def _union(starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of ranges that touch or overlap."""
    if not len(starts):
        return []
    order = np.argsort(starts, kind="stable")
    starts, reached = starts[order], np.maximum.accumulate(ends[order])
    first = np.flatnonzero(np.concatenate([[True], starts[1:] > reached[:-1]]))
    last = np.append(first[1:], len(starts)) - 1
    return list(zip(starts[first].tolist(), reached[last].tolist(), strict=True))


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Remove every byte that a 100-byte string covers which also begins earlier.

    Earlier means in a document of smaller id, or in the same one further left. Per row: doc_id,
    n_bytes, n_removed, spans (maximal removed runs, in bytes) and kept (the remaining bytes).

    Texts are UTF-8 bytes, null is empty; matches do not cross documents and are judged on the input.
    Ids are taken as long integers, null ids come first; rows of equal id go by the order in which
    they are read, so a repeated row is removed but for its first copy. Texts below 100 bytes stay.
    Other columns are not read. No rows give no rows.
    """
    spark = docs.sparkSession
    docs = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("text_key")
    )
    shuffles = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found, anchors_at = stage_for_now(_shared_anchors(_post_anchors(docs, 2 * shuffles)), "anchors")
    discard(spark)
    rows = found.where(F.col("n_bytes").isNotNull()).select(
        "row", "doc_id", "text_key", "digest", "n_bytes", F.lit(1).cast("long").alias("one")
    )
    # Rows that agree in id and text are told apart by their number.
    same = ["doc_id", "text_key"]
    repeated = not rows.groupBy(*same).count().where("count > 1").isEmpty()
    numbered = lambda df, order: df.withColumn(
        "nth", F.row_number().over(Window.partitionBy(*same).orderBy(order)) if repeated else F.lit(1)
    )
    match = lambda a, b: (
        a["doc_id"].eqNullSafe(b["doc_id"]) & a["text_key"].eqNullSafe(b["text_key"]) & (a["nth"] == b["nth"])
    )
    rows = stage_table(numbered(running_sums(rows, ["doc_id", "row"], {"ord": "one"}), "row").drop("one"), "rows")
    texts = numbered(docs, F.lit(0))
    first = rows.groupBy("digest").agg(F.min("ord").alias("first"))
    rows = rows.join(first, "digest")
    copies = rows.where((F.col("ord") > F.col("first")) & (F.col("n_bytes") >= LENGTH)).select(
        "ord", F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("end")
    )

    sets = found.where(F.col("anchors").isNotNull()).groupBy("row").agg(F.collect_list("anchors").alias("anchors"))
    anchored = rows.where("ord = first").join(sets, "row")
    with_text = texts.join(anchored, match(texts, anchored)).select("ord", "text", "anchors")
    targets = 4 * shuffles
    samples = found.where(F.col("sample").isNotNull()).select("sample")
    share = min(1.0, SAMPLES * targets / max(samples.count(), 1))
    sample = sorted(bytes(r[0]) for r in samples.sample(share, 7).collect())  # bounded
    splitters = sorted({sample[i * len(sample) // targets] for i in range(1, targets)}) if sample else []
    joined = stage_table(_merge(_send_runs(with_text, splitters)), "merged")
    discard(spark, anchors_at)

    places = joined.where(F.col("n").isNotNull()).groupBy("ord").agg(
        F.collect_list(F.struct("start", "n", "offset")).alias("near")
    )
    around = rows.join(places, "ord")
    parts, parts_at = stage_for_now(
        _parts(texts.join(around, match(texts, around)).select("ord", "text", "near")), "parts"
    )
    discard(spark)
    in_part = _partly_repeated(parts, 2 * shuffles)
    discard(spark, parts_at)
    removed = (
        joined.where(F.col("end").isNotNull()).select("ord", "start", "end")
        .union(copies).union(in_part)
    )
    spans = removed.groupBy("ord").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    taken = rows.join(spans, "ord").select("doc_id", "text_key", "nth", "spans")

    schema = _schema(_RESULT)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, "text"):
            spans = part["spans"].combine_chunks()
            starts, ends = (spans.values.field(c).to_numpy(zero_copy_only=False) for c in ("start", "end"))
            bounds = spans.offsets.to_numpy().tolist()
            rows = []
            for doc, text, a, b in zip(
                part["doc_id"].to_pylist(), part["text"].to_pylist(), bounds, bounds[1:], strict=False
            ):
                data = (text or "").encode()
                whole = _union(starts[a:b], ends[a:b])
                edges = [0, *(e for s in whole for e in s), len(data)]
                kept = b"".join(data[x:y] for x, y in zip(edges[::2], edges[1::2], strict=True))
                rows.append((doc, len(data), len(data) - len(kept), [{"start": x, "end": y} for x, y in whole], kept))
            yield _rows(schema, len(rows), **{c: [r[k] for r in rows] for k, c in enumerate(schema.names)})

    result = texts.join(taken, match(texts, taken), "left").select(texts["doc_id"], "text", "spans")
    return result.mapInArrow(apply, from_arrow_schema(schema))
