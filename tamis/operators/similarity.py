"""Exact set-similarity self-join on word sets (no recall loss).

High thresholds use the pigeonhole principle. Two sets with Jaccard similarity
of at least t differ in at most ``h = (1-t)/(1+t) * (|x|+|y|)`` words. If words
are hashed into ``h+1`` parts, at least one part is equal in both sets, so
records are joined on (size band, part number, part content). A part holds many
words at once, so the join key stays selective however common the single words
are, and no word statistics are needed. A 64-bit word parity map travels along
and discards most chance candidates inside the join.

Low thresholds leave too few words per part; there the classic prefix filter on
words ordered from rare to common is used instead. Only the most frequent words
are ranked by frequency, any others count as rare, so tasks order words by a
bounded list and no word is shuffled for it. A 1024-bit word parity map per set
then rules out most candidates before word sets are compared.

Where common words would make too many candidates of that kind, candidates are
no rows at all: sets of like size are stripes, and a task compares two stripes.
It indexes the rare words of one, counts which sets of the other share several
of them, compares maps and then hashes of all words of those that do, and gives
only the pairs that may qualify. That is quadratic in time, but not on disk, and
time goes with the words that sets share, not with all their pairs' maps.

Either way candidates are then checked on the real word sets, in cells of two
groups of sets each, so that a set is sent once to a cell and not once for each
of its pairs. Join keys shared by very many sets are cut into pairs of small
blocks, so that the comparisons of one group are spread over many tasks.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tamis.dataset import Dataset
from tamis.functions import text as tx
from tamis.operators.skew import BROADCAST_KEYS, block_keys, crowded_keys, in_blocks, join_in_blocks, met_once
from tamis.staging import give_back, stage, stage_table

PARTS_FROM = 0.85
BLOCKS = 64
# Words that are ordered by their frequency; the others come before them, ordered by hash.
RANKED_WORDS = 65_536
SLICE_WORDS = 200_000  # words that a task signs at a time, about
MAP_WORDS = 16  # 64-bit words of a parity map
# Candidates per set that the prefix join may shuffle; where there would be more, stripes are compared.
PAIRS_PER_SET = 8
FEW_PAIRS = 200_000  # so many are never too many
STRIPE_WORDS = 16_000_000  # words of a stripe, about
STRIPE_SETS = 512  # sets that a stripe has at least, if there are as many
BAND = 1.05  # ratio of sizes that are counted together
LEAST_SHARED = 4  # rare words that sets have to share before their maps are compared
TILE = 1 << 19  # numbers of a tile of unpacked maps, or meetings of words, that a task holds at a time
# Words and sets of a group of sets that are scored together, about.
CELL_WORDS = 400_000
CELL_SETS = 2048
SMALL_CELL = 1 / 8  # share of these below which groups are put together
TASK_SETS = 1024  # sets for which a task scores, about
_SLACK = 1e-9


def _mix(values: np.ndarray, seed: int) -> np.ndarray:
    """Scramble 64-bit values (splitmix finaliser)."""
    with np.errstate(over="ignore"):
        x = values + np.uint64(seed) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _slices(sets: pa.Array) -> list[pa.Array]:
    """Slices of ``sets`` of about SLICE_WORDS words."""
    words = np.cumsum(sets.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    cuts = np.flatnonzero(np.diff(words // SLICE_WORDS)) + 1
    edges = [0, *cuts.tolist(), len(sets)]
    return [sets.slice(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def _by_slices(sets: pa.Array, work) -> pa.Array:
    """``work`` over slices of ``sets``: its arrays take many times the words' memory."""
    return pa.concat_arrays([work(part) for part in _slices(sets)])


def _difference_share(threshold: float) -> float:
    return (1 - threshold) / (1 + threshold)


def _layout(largest: float, threshold: float) -> tuple[int, int, int]:
    """Parts for sets of up to ``largest`` words: ``(parts, spare, thick)``.

    With ``spare`` parts beyond the largest possible difference, a pair agrees on
    at least ``spare`` parts. So if fewer than ``spare`` of a set's parts are thin
    (have under ``thick`` words), the pair agrees on a part that is not thin, and
    the set need not sign its thin parts, which would match by chance. The
    layout with the thickest parts that usually allows this is taken.
    """
    differ = math.floor(_difference_share(threshold) * 2 * largest + 1e-6)
    best = (differ + 1, 1, 0)
    if differ == 0:
        return best
    tried = range(1, 3 + differ // 3)
    for spare in (s for s in tried if s < 8 or s % (1 + differ // 32) == 0):
        parts = differ + spare
        mean = threshold * threshold * largest / parts
        chance, below, thick = math.exp(-mean), 0.0, 0
        while thick < 6:
            below += chance
            thin = parts * below
            if thin + 3 * math.sqrt(thin) + 1 > spare:
                break
            thick += 1
            chance *= mean / thick
        if thick > best[2]:
            best = (parts, spare, thick)
    return best


def _signatures_udf(threshold: float):
    """Signatures of a word set given as 64-bit word hashes.

    Set sizes fall into bands whose width is the largest size ratio of a
    qualifying pair, so partners sit in the same or in neighbouring bands. A set
    signs up in its own band (``home``) and as a smaller partner in the next one
    (``visit``). ``parity`` is the 64-bit word parity map.
    """
    width = -math.log(threshold) + _SLACK

    def band_signatures(words, row, size, band):
        bands, which = np.unique(band, return_inverse=True)
        largest = np.floor(np.exp((bands + 1) * width) + _SLACK)
        layouts = np.array([_layout(u, threshold) for u in largest], np.int64).reshape(-1, 3)
        parts, spare, thick = layouts[which].T
        parts = np.where(size > 0, parts, 0)
        starts = np.concatenate(([0], np.cumsum(parts)))
        slot = starts[row] + (_mix(words, 1) % parts[row].astype(np.uint64)).astype(np.int64)
        content = np.zeros(starts[-1], np.uint64)
        np.add.at(content, slot, _mix(words, 2))
        filled = np.bincount(slot, minlength=starts[-1])
        owner = np.repeat(np.arange(len(size)), parts)
        place = np.arange(starts[-1]) - starts[owner]
        thin = filled < thick[owner]
        thin_parts = np.bincount(owner, weights=thin, minlength=len(size))
        signed = ~thin | (thin_parts >= spare)[owner]
        key = _mix(content ^ _mix(filled.astype(np.uint64), 3), 4)
        key ^= _mix(band[owner].astype(np.uint64), 5) ^ _mix(place.astype(np.uint64), 6)
        counts = np.bincount(owner[signed], minlength=len(size))
        return pa.ListArray.from_arrays(
            pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32()),
            pa.array(_mix(key[signed], 7).view(np.int64)),
        )

    def signed(hashes: pa.Array) -> pa.Array:
        size = hashes.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        words = hashes.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
        row = np.repeat(np.arange(len(size)), size)
        band = np.floor(np.log(np.maximum(size, 1)) / width).astype(np.int64)
        parity = np.zeros(len(size), np.uint64)
        np.bitwise_xor.at(parity, row, np.uint64(1) << (_mix(words, 8) & np.uint64(63)))
        return pa.StructArray.from_arrays(
            [
                pa.array(size),
                band_signatures(words, row, size, band),
                band_signatures(words, row, size, band + 1),
                pa.array(parity.view(np.int64)),
            ],
            ["n", "home", "visit", "parity"],
        )

    @F.arrow_udf("struct<n:bigint,home:array<bigint>,visit:array<bigint>,parity:bigint>")
    def signatures(hashes: pa.Array) -> pa.Array:
        return _by_slices(hashes, signed)

    # Deterministic in fact; the mark keeps filters on its result from running it twice.
    return signatures.asNondeterministic()


def _word_hashes(dataset: Dataset) -> Column:
    return F.transform(tx.word_set(dataset.content.text()), lambda w: F.xxhash64(w))


def _ordered(left: Column, right: Column) -> tuple[Column, Column]:
    return F.least(left, right).alias("earlier_ord"), F.greatest(left, right).alias("later_ord")


def _distinct_pairs(pairs: DataFrame) -> DataFrame:
    """Distinct pairs, in a fixed number of partitions.

    Pairs are tiny but costly to check, so they must not be coalesced by size.
    """
    count = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return pairs.repartition(count, "earlier_ord", "later_ord").distinct()


def similarity_column(dataset: Dataset, threshold: float) -> Column | None:
    """What the join needs of each record: signatures, or word hashes below ``PARTS_FROM``."""
    if threshold == 0:
        return None
    hashes = _word_hashes(dataset)
    return _signatures_udf(threshold)(hashes) if threshold >= PARTS_FROM else hashes


def _one_each(scan: DataFrame) -> DataFrame:
    """``id, sig`` of each content: its first record's ``rec_ord`` and its signatures.

    Only contents that may be repeated, known by hashes of their keys, are shuffled and staged with their
    signatures. All others are read from ``scan`` as they are, unless the hashes are too many for each task.
    """
    at = F.xxhash64("key").alias("at")
    repeated = stage(scan.groupBy(at).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("at"))
    few = repeated.count() <= BROADCAST_KEYS
    rows = scan.select("rec_ord", "key", "sig", at)
    grouped = rows.join(F.broadcast(repeated), "at", "left_semi") if few else rows
    # Copies have equal signatures, so grouping by both merges them map-side.
    firsts = grouped.groupBy("key", "sig").agg(F.min("rec_ord").alias("id")).select("id", "sig")
    firsts = stage_table(firsts, "signatures")
    if not few:
        return firsts
    alone = rows.join(F.broadcast(repeated), "at", "left_anti")
    return alone.select(F.col("rec_ord").alias("id"), "sig").unionByName(firsts)


def _pairs_by_parts(scan: DataFrame, threshold: float) -> DataFrame:
    """Candidate pairs of distinct contents that share a signature."""
    signed = _one_each(scan).select("id", "sig.*")

    def signs(kind: str, at_home: bool) -> Column:
        return F.transform(kind, lambda s: F.struct(s.alias("s"), F.lit(at_home).alias("at_home")))

    rows = signed.select("id", F.inline(F.concat(signs("home", True), signs("visit", False))))
    # Few signatures are shared. One shuffle of ids alone finds these; only they meet with sizes and maps.
    beside = Window.partitionBy("s")
    shared = rows.withColumns(
        {"known": F.count(F.lit(1)).over(beside), "lead": F.min("id").over(beside)}
    ).filter("known > 1")
    # Near copies share many signatures, and most of those have the same first record. They meet under that
    # record, once, and not under each signature.
    lists = {c: F.collect_set(F.when(F.col("at_home") == (c == "home"), F.col("s"))) for c in ("home", "visit")}
    led = shared.groupBy("lead", "id").agg(*[v.alias(c) for c, v in lists.items()])
    met = stage_table(led.join(signed.select("id", "n", "parity"), "id"), "shared")
    blocked = in_blocks(met, "lead", "id")
    x, y = blocked.alias("x"), blocked.alias("y")
    total = F.col("x.n") + F.col("y.n")
    differing = F.bit_count(F.col("x.parity").bitwiseXOR(F.col("y.parity")))
    agree = (
        F.arrays_overlap("x.home", "y.home") | F.arrays_overlap("x.home", "y.visit")
        | F.arrays_overlap("x.visit", "y.home")
    )
    matches = x.join(
        y,
        block_keys("x", "y", "lead")
        & met_once("x", "y")
        & (F.col("x.id") < F.col("y.id"))
        & (F.least("x.n", "y.n") >= threshold * F.greatest("x.n", "y.n") - _SLACK)
        & (differing <= _difference_share(threshold) * total + 1e-6)
        & agree,
    )
    return _distinct_pairs(matches.select(F.col("x.id").alias("earlier_ord"), F.col("y.id").alias("later_ord")))


def _ranked_words(sets: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The ``RANKED_WORDS`` most frequent words in order of their hashes, and their ranks from 1.

    Any order of the words gives the same pairs; this one makes prefixes rare.
    """
    counts = sets.select(F.explode("words").alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("df"))
    top = counts.filter("df > 1").orderBy(F.desc("df"), "w").limit(RANKED_WORDS).toArrow()  # bounded
    words, df = top["w"].to_numpy(), top["df"].to_numpy()
    rank = np.empty(len(words), np.int64)
    rank[np.lexsort((words, df))] = np.arange(1, len(words) + 1)
    order = np.argsort(words)
    return words[order], rank[order]


def _prefix_udf(threshold: float, words: np.ndarray, rank: np.ndarray):
    """The rarest words of a set, as many as qualifying sets must share one of, and the parity map."""

    @F.arrow_udf("struct<prefix:array<bigint>,bits:array<bigint>>")
    def prefixes(hashes: pa.Array) -> pa.Array:
        size = hashes.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        flat = hashes.flatten().to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(len(size)), size)
        at = np.minimum(np.searchsorted(words, flat), max(len(words) - 1, 0))
        known = words[at] == flat if len(words) else np.zeros(len(flat), bool)
        order = np.lexsort((flat, np.where(known, rank[at] if len(words) else 0, 0), row))
        place = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
        needed = np.where(size > 0, size - np.ceil(threshold * size - _SLACK).astype(np.int64) + 1, 0)
        kept = place < needed[row]
        starts = np.concatenate(([0], np.cumsum(np.minimum(needed, size))))
        bits = np.zeros(len(size) * MAP_WORDS, np.uint64)
        spot = _mix(flat.view(np.uint64), 8) & np.uint64(64 * MAP_WORDS - 1)
        where = row * MAP_WORDS + (spot >> np.uint64(6)).astype(np.int64)
        np.bitwise_xor.at(bits, where, np.uint64(1) << (spot & np.uint64(63)))
        steps = pa.array(np.arange(len(size) + 1) * MAP_WORDS, pa.int32())
        return pa.StructArray.from_arrays(
            [
                pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(flat[order][kept])),
                pa.ListArray.from_arrays(steps, pa.array(bits.view(np.int64))),
            ],
            ["prefix", "bits"],
        )

    return prefixes.asNondeterministic()


def _codes_udf(words: np.ndarray, rank: np.ndarray):
    """The words of a set as sorted 31-bit numbers: rare words by hash, then ranked ones from rare to common.

    Words may share a number; sets then seem to share more than they do, never less.
    """
    first = 2**31 - 1 - len(words)

    def coded(hashes: pa.Array) -> pa.Array:
        size = hashes.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        flat = hashes.flatten().to_numpy(zero_copy_only=False)
        code = ((flat.view(np.uint64) >> np.uint64(32)) * np.uint64(first) >> np.uint64(32)).astype(np.int64)
        if len(words):
            at = np.minimum(np.searchsorted(words, flat), len(words) - 1)
            code = np.where(words[at] == flat, first + rank[at], code)
        code |= np.repeat(np.arange(len(size)), size) << 31
        code.sort()
        starts = pa.array(np.concatenate(([0], np.cumsum(size))), pa.int32())
        return pa.ListArray.from_arrays(starts, pa.array((code & (2**31 - 1)).astype(np.int32)))

    @F.arrow_udf("array<int>")
    def codes(hashes: pa.Array) -> pa.Array:
        return _by_slices(hashes, coded)

    return codes.asNondeterministic()


def _ranked_candidates(coded: DataFrame, ranked: int, threshold: float) -> int:
    """Rows that the join of prefixes would make by ranked words. Tasks count words, so no word is a row."""
    first = 2**31 - 1 - ranked

    def counted(batches):
        counts = np.zeros((2, ranked + 1), np.int64)  # in prefixes, in short prefixes
        for batch in batches:
            for part in _slices(batch.column("codes")):
                sets = _Sets(np.empty(0, np.int64), part)
                for c, least in zip(counts, (threshold, 2 * threshold / (1 + threshold)), strict=True):
                    codes = sets.codes[_taken(sets.start, sets.n - np.ceil(least * sets.n - _SLACK).astype(np.int64) + 1)]
                    c += np.bincount(codes[codes > first] - first, minlength=len(c))
        known = np.flatnonzero(counts[0])
        yield pa.RecordBatch.from_pydict({"w": known, "n": counts[0][known], "m": counts[1][known]})

    counts = coded.select("codes").mapInArrow(counted, "w long, n long, m long").groupBy("w")
    counts = counts.agg(F.sum("n").cast("double").alias("n"), F.sum("m").alias("m"))
    return int(counts.agg(F.sum(F.col("n") * F.col("m"))).first()[0] or 0)


def _map_bits(largest: int, threshold: float) -> int:
    """Bits of the maps of sets of up to ``largest`` words: most of other sets' words get bits of their own."""
    return 1 << max(8, math.ceil(math.log2(max(1, largest) * (2 if threshold >= 0.5 else 8))))


def _taken(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places of ranges, one range after another."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0)


class _Sets:
    """Sets of a cell: ``ids``, sizes ``n``, and codes, those of a set from ``start``."""

    def __init__(self, ids: np.ndarray, lists: pa.Array):
        self.ids, self.codes = ids, lists.flatten().to_numpy(zero_copy_only=False)
        self.n = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        self.start = np.cumsum(self.n) - self.n

    def parts(self, words: int):
        """Slices of the sets, of about so many words."""
        cuts = np.flatnonzero(np.diff(self.start // words)) + 1
        edges = [0, *cuts.tolist(), len(self.n)]
        return [slice(a, b) for a, b in zip(edges, edges[1:], strict=False)]

    def maps(self, at: slice, bits: int) -> np.ndarray:
        """Parity maps of so many bits (a power of two), each a row of 64-bit words."""
        out, step = [np.zeros((0, bits // 64), np.uint64)], max(1, 2 * TILE // bits)
        for i in range(at.start, at.stop, step):
            n = self.n[i : min(i + step, at.stop)]
            codes = self.codes[self.start[i] : self.start[i] + n.sum()].astype(np.uint64)
            spot = (_mix(codes, 8) & np.uint64(bits - 1)).astype(np.int64)
            odd = np.bincount(spot + np.repeat(np.arange(len(n)) * bits, n), minlength=len(n) * bits) & 1
            out.append(np.packbits(odd.astype(np.uint8)).view(np.uint64).reshape(len(n), -1))
        return np.concatenate(out)


def _compare_cells(threshold: float, spans: list[tuple[int, int]]):
    """Pairs of the sets of each cell that qualify by their codes.

    Cells are numbered by their stripes, of the sizes ``spans``. Rows come by cell, those of the first stripe
    (``side`` -1) before those of the second (1); in a cell of one stripe with itself all are 0.

    Qualifying sets share some of their rarest words, ``least`` of those that are rare enough. Such words of the
    first stripe are indexed, and those of the second look up who has them. Sets met so often are compared by
    maps, then by codes. Where words are so common that this takes longer, all maps are compared, tile by tile.
    """
    apart, share = _difference_share(threshold), threshold / (1 + threshold)

    def rarest(n: np.ndarray, partner: np.ndarray, least: int) -> np.ndarray:
        """How many of its rarest words a set has to look at, if partners have so many words at least."""
        return np.clip(n - np.ceil(share * (n + partner) - _SLACK).astype(np.int64) + least, 0, n)

    def indexed(cell: int, y: _Sets):
        (low, _), (smallest, largest) = (spans[i] for i in divmod(cell, len(spans)))
        alone, bits = cell // len(spans) == cell % len(spans), _map_bits(largest, threshold)
        least = max(1, min(LEAST_SHARED, math.ceil(share * (smallest + max(low, threshold * smallest)) - _SLACK)))
        # Partners are not smaller, unless both stripes are of the same sizes.
        other = threshold * y.n if low == smallest and not alone else y.n
        lengths = rarest(y.n, np.maximum(smallest, other), least)
        owner = np.repeat(np.arange(len(lengths)), lengths)
        both = y.codes[_taken(y.start, lengths)].astype(np.int64) << 32 | owner
        both.sort()
        words = (both >> 32).astype(np.int32)
        first = np.flatnonzero(np.diff(words, prepend=np.int32(-1)))
        times = np.diff(first, append=len(words))
        owner = (both & (2**32 - 1)).astype(np.int32)
        return y, low, least, alone, bits, y.maps(slice(0, len(y.n)), bits), (words[first], first, times, owner)

    def met(index, x: _Sets, at: slice, least: int, lengths: np.ndarray, found: np.ndarray, times: np.ndarray):
        """Pairs that share at least so many words: places in ``x`` and in the index, by runs of some words."""
        _, first, _, owner = index
        each = np.concatenate(([0], np.cumsum(times)))[np.concatenate(([0], np.cumsum(lengths)))]
        cuts = np.flatnonzero(np.diff(each[:-1] // TILE)) + 1
        edges = [0, *cuts.tolist(), len(lengths)]
        ends = np.concatenate(([0], np.cumsum(lengths)))
        for a, b in zip(edges, edges[1:], strict=False):
            who = owner[_taken(first[found[ends[a] : ends[b]]], times[ends[a] : ends[b]])]
            runs = each[a : b + 1] - each[a]
            for i, j in zip(runs[:-1].tolist(), runs[1:].tolist(), strict=True):
                who[i:j].sort()
            hits = np.flatnonzero(who[least - 1 :] == who[: max(0, len(who) - least + 1)])
            row = np.searchsorted(runs, hits, "right") - 1
            whole = hits + least <= runs[row + 1]
            row, mine = row[whole], who[hits[whole]]
            new = np.concatenate(([True], (row[1:] != row[:-1]) | (mine[1:] != mine[:-1])))[: len(row)]
            yield at.start + a + row[new], mine[new].astype(np.int64)

    def tiled(y: _Sets, ymaps: np.ndarray, x: _Sets, at: slice, xmaps: np.ndarray, bits: int):
        """Pairs by all maps, as numbers of matrices."""

        def unpacked(maps: np.ndarray) -> np.ndarray:
            return np.unpackbits(maps.view(np.uint8), axis=1).astype(np.float32)

        step = min(2048, max(16, TILE // bits))
        for i in range(0, len(xmaps), step):
            a = unpacked(xmaps[i : i + step])
            # Sets differ in at least as many words as their maps do in bits.
            ua = (a.sum(axis=1) - apart * x.n[at][i : i + step]) / 2
            for j in range(0, len(ymaps), step):
                b = unpacked(ymaps[j : j + step])
                ub = (b.sum(axis=1) - apart * y.n[j : j + step]) / 2
                least = ua[:, None].astype(np.float32) + ub[None, :].astype(np.float32)
                r, c = np.nonzero(a @ b.T >= least - np.float32(0.25))
                yield at.start + i + r, j + c

    def found_pairs(one: np.ndarray, two: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"earlier_ord": np.minimum(one, two), "later_ord": np.maximum(one, two)})

    def qualified(held, x: _Sets, at: slice, xmaps: np.ndarray, r: np.ndarray, c: np.ndarray):
        """Those of the pairs that sizes, maps and codes allow."""
        y, _, _, alone, bits, ymaps, _ = held
        nr, nc = x.n[r], y.n[c]
        kept = np.minimum(nr, nc) >= threshold * np.maximum(nr, nc) - _SLACK
        if alone:  # each pair once
            kept &= (nc < nr) | ((nc == nr) & (y.ids[c] < x.ids[r]))
        r, c = r[kept], c[kept]
        differ, step = np.zeros(len(r), np.int64), max(1, TILE // bits * 8)
        for k in range(0, len(r), step):
            p, q = r[k : k + step], c[k : k + step]
            differ[k : k + step] = np.bitwise_count(xmaps[p - at.start] ^ ymaps[q]).sum(axis=1, dtype=np.int64)
        allowed = apart * (x.n[r] + y.n[c]) + 1e-6
        # Sets whose maps are nearly equal are near copies; they need no look at their codes to be scored.
        sure, maybe = differ <= allowed / 2, (differ > allowed / 2) & (differ <= allowed)
        if sure.any():
            yield found_pairs(x.ids[r[sure]], y.ids[c[sure]])
        r, c = r[maybe], c[maybe]
        if not len(r):
            return
        total = x.n[r] + y.n[c]
        pieces = [0, *(np.flatnonzero(np.diff(np.cumsum(total) // TILE)) + 1).tolist(), len(r)]
        for a, b in zip(pieces, pieces[1:], strict=False):
            p, q = r[a:b], c[a:b]
            pair = np.arange(b - a) << 31
            keys = np.sort(np.concatenate([
                np.repeat(pair, s.n[o]) | s.codes[_taken(s.start[o], s.n[o])] for s, o in ((x, p), (y, q))
            ]))
            shared = np.bincount(keys[1:][keys[1:] == keys[:-1]] >> 31, minlength=b - a)
            kept = shared >= share * total[a:b] - _SLACK
            if kept.any():
                yield found_pairs(x.ids[p[kept]], y.ids[q[kept]])

    def compared(held, x: _Sets):
        y, low, least, _, bits, ymaps, index = held
        for at in x.parts(SLICE_WORDS):
            xmaps, n = x.maps(at, bits), x.n[at]
            lengths = rarest(n, np.maximum(low, threshold * n), least)
            codes = x.codes[_taken(x.start[at], lengths)]
            found = np.minimum(np.searchsorted(index[0], codes), max(0, len(index[0]) - 1))
            times = np.where(index[0][found] == codes, index[2][found], 0) if len(index[0]) else 0 * found
            if times.sum() > len(n) * len(y.n) * (1 + bits / 512):
                pairs = tiled(y, ymaps, x, at, xmaps, bits)
            else:
                pairs = met(index, x, at, least, lengths, found, times)
            for r, c in pairs:
                yield from qualified(held, x, at, xmaps, r, c)

    def run(batches):
        try:
            yield from by_cells(batches)
        finally:
            give_back()

    def by_cells(batches):
        cell, side, ids, lists, held = None, 0, [], [], None

        def own():
            nonlocal ids, lists
            sets = _Sets(np.concatenate(ids), pa.concat_arrays(lists))
            ids, lists = [], []
            index = indexed(cell, sets)
            give_back()
            return index

        for batch in batches:
            cells, sides = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("cell", "side"))
            new = (cells[1:] != cells[:-1]) | (sides[1:] != sides[:-1])
            cuts = [0, *(np.flatnonzero(new) + 1).tolist(), len(cells)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                if cells[a] != cell:
                    if ids and side == 0:
                        held = own()
                        yield from compared(held, held[0])
                    cell, ids, lists, held = int(cells[a]), [], [], None
                side = sides[a]
                part = batch.column("id").slice(a, b - a).to_numpy(zero_copy_only=False)
                codes = batch.column("codes").slice(a, b - a)
                if side <= 0:
                    ids.append(part)
                    lists.append(codes)
                elif held or ids:
                    held = held or own()
                    yield from compared(held, _Sets(part, codes))
        if ids and side == 0:
            held = own()
            yield from compared(held, held[0])

    return run


def _stripes(sizes: list, tasks: int, threshold: float) -> tuple[list[tuple[int, int]], list[tuple]]:
    """Sizes ``(least, most)`` of stripes, and rows (band, first, parts, low, high) from ``sizes``, bands of sizes
    with the number of their sets, all words, least and most.

    Neighbouring bands are a stripe, bands of too many words are several; a stripe meets those from ``low`` to ``high``.
    """
    words, sets = sum(r.words for r in sizes), sum(r.sets for r in sizes)
    count = max(1, math.ceil(words / STRIPE_WORDS), min(math.isqrt(2 * tasks), sets // STRIPE_SETS))
    most, spans, placed, held = words / count, [], [], 0
    for r in sorted(sizes, key=lambda r: r.least):
        parts = max(1, math.ceil(r.words / most))
        if parts > 1 or not spans or held + r.words > most:
            placed.append((r.band, len(spans), parts))
            spans += [(r.least, r.most)] * parts
            held = r.words if parts == 1 else most
        else:
            placed.append((r.band, len(spans) - 1, 1))
            spans[-1] = (spans[-1][0], r.most)
            held += r.words
    rows = []
    for band, first, parts in placed:
        least, largest = spans[first]
        meets = [i for i, (a, b) in enumerate(spans) if min(b, largest) >= threshold * max(a, least) - _SLACK]
        rows.append((band, first, parts, meets[0], meets[-1]))
    return spans, rows


def _pairs_by_stripes(coded: DataFrame, threshold: float) -> DataFrame:
    """Pairs of sets of like size that qualify by codes of their words, compared stripe against stripe.

    Stripes are sets of neighbouring sizes, of like many words; a pair of stripes whose sizes allow it is a cell.
    """
    spark = coded.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sizes = coded.groupBy("band").agg(
        F.count(F.lit(1)).alias("sets"), F.sum("n").alias("words"), F.min("n").alias("least"), F.max("n").alias("most")
    ).collect()  # a row per band, some hundreds
    if not sizes:
        return spark.createDataFrame([], "earlier_ord long, later_ord long")
    spans, rows = _stripes(sizes, tasks, threshold)
    placed = coded.join(
        F.broadcast(spark.createDataFrame(rows, "band int, first int, parts int, low int, high int")), "band"
    ).withColumn("stripe", (F.col("first") + F.pmod(F.xxhash64("id"), F.col("parts"))).cast("int"))
    paired = placed.withColumn("other", F.explode(F.sequence("low", "high")))
    cell = F.least("stripe", "other").cast("long") * len(spans) + F.greatest("stripe", "other")
    side = F.when(F.col("other") < F.col("stripe"), 1).when(F.col("other") > F.col("stripe"), -1).otherwise(0)
    meets = sum({first: parts * (high - low + 1) for _, first, parts, low, high in rows}.values())
    dealt = paired.select(cell.alias("cell"), side.alias("side"), "id", "codes").repartition(
        min((meets + len(spans)) // 2, 8 * tasks), "cell"
    )
    return dealt.sortWithinPartitions("cell", "side").mapInArrow(
        _compare_cells(threshold, spans), "earlier_ord long, later_ord long"
    )


def _candidates_of(prefix: DataFrame) -> int:
    """Rows that the join of prefixes would make at most."""
    counts = prefix.groupBy("w").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("pos") < F.col("short")).alias("m"))
    return int(counts.agg(F.sum(F.col("n").cast("double") * F.col("m"))).first()[0] or 0)


def _pairs_by_prefix(scan: DataFrame, threshold: float) -> DataFrame:
    """Candidate pairs of distinct contents that share a rare-first prefix word."""
    sets = _one_each(scan).filter(F.size("sig") > 0).select("id", F.col("sig").alias("words"))
    ranked = _ranked_words(sets)
    coded = sets.filter("id is not null").select("id", F.size("words").alias("n"), _codes_udf(*ranked)("words").alias("codes"))
    coded = stage_table(coded.withColumn("band", F.floor(F.log("n") / math.log(BAND)).cast("int")), "codes")
    most = max(FEW_PAIRS, PAIRS_PER_SET * coded.count())
    if _ranked_candidates(coded, len(ranked[0]), threshold) > most:
        return _likely(stage(_pairs_by_stripes(coded, threshold)), None, threshold)
    chosen = sets.select("id", F.size("words").alias("n"), _prefix_udf(threshold, *ranked)("words").alias("p"))
    chosen = stage_table(chosen.select("id", "n", "p.*"), "prefixes")
    share = 2 * threshold / (1 + threshold)
    prefix = chosen.select(
        "id", "n", (F.col("n") - F.ceil(share * F.col("n") - _SLACK) + 1).alias("short"),
        F.posexplode("prefix").alias("pos", "w"),
    )
    if _candidates_of(prefix) > most:
        return _likely(stage(_pairs_by_stripes(coded, threshold)), None, threshold)
    blocked = in_blocks(prefix, "w", "id")
    x, y = blocked.alias("x"), blocked.filter("pos < short").alias("y")
    rest = F.least(F.col("x.n") - F.col("x.pos"), F.col("y.n") - F.col("y.pos"))
    candidates = x.join(
        y,
        block_keys("x", "y", "w")
        & met_once("x", "y")
        & (
            (F.col("y.n") < F.col("x.n"))
            | ((F.col("y.n") == F.col("x.n")) & (F.col("y.id") < F.col("x.id")))
        )
        & (F.col("y.n") >= threshold * F.col("x.n") - _SLACK)
        & (rest >= threshold / (1 + threshold) * (F.col("x.n") + F.col("y.n")) - _SLACK),
    )
    pairs = stage(_distinct_pairs(candidates.select(*_ordered(F.col("x.id"), F.col("y.id")))))
    near = stage(_near_maps(pairs, chosen.select("id", "n", "bits"), threshold))
    return _likely(near, sets, threshold)


def _beside(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """Staged pairs with the columns of ``known`` (one row per id) of both records; hot records are spread."""
    both, joined = ("earlier", "later"), pairs
    for side, other in (both, both[::-1]):
        named = known.select(*[F.col(c).alias(f"{side}_{'ord' if c == 'id' else c}") for c in known.columns])
        crowded = crowded_keys(pairs, None, f"{side}_ord")
        joined = join_in_blocks(joined, named, f"{side}_ord", crowded, f"{other}_ord", f"{side}_ord")
    return joined


def _near_maps(pairs: DataFrame, maps: DataFrame, threshold: float) -> DataFrame:
    """Drop pairs whose parity maps differ in more bits than qualifying sets can in words."""
    joined = _beside(pairs, maps)
    differing = F.aggregate(
        F.zip_with("earlier_bits", "later_bits", lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda n, x: n + x
    )
    total = F.col("earlier_n") + F.col("later_n")
    return joined.filter(differing <= _difference_share(threshold) * total + 1e-6).select("earlier_ord", "later_ord")


def _likely(pairs: DataFrame, hashed: DataFrame | None, threshold: float) -> DataFrame:
    """Drop pairs whose word hashes already rule them out; stripes have done so (``hashed`` is None).

    Hashes are far cheaper to intersect than words. Words of one set that share
    a hash (``lost``) can hide at most that many common words, so no pair that
    qualifies is dropped.
    """
    if hashed is None:
        return pairs
    joined = _beside(pairs, hashed.select("id", F.col("words").alias("h")))
    shared = F.size(F.array_intersect("earlier_h", "later_h"))
    lost = F.size("earlier_h") - F.size(F.array_distinct("earlier_h"))
    total = F.size("earlier_h") + F.size("later_h")
    return joined.filter(
        shared + lost >= threshold / (1 + threshold) * total - _SLACK
    ).select("earlier_ord", "later_ord")


def _every_pair(dataset: Dataset) -> DataFrame:
    """All pairs with scores: what a threshold of zero asks for.

    Records go to random blocks and each pair of blocks is one join key, so the
    (inherently quadratic) output is produced evenly by many tasks.
    """
    sets = dataset.df.select(
        dataset.content.key().alias("key"),
        "rec_ord",
        tx.word_set(dataset.content.text()).alias("words"),
    )
    distinct = sets.groupBy("key", "words").agg(F.min("rec_ord").alias("id"))
    block = F.pmod(F.xxhash64("id"), F.lit(BLOCKS)).cast("int")
    placed = distinct.select("id", "words", block.alias("block")).select(
        "*", F.explode(F.sequence(F.lit(0), F.lit(BLOCKS - 1))).alias("other")
    ).select(
        "id",
        "words",
        "block",
        F.least("block", "other").alias("lo"),
        F.greatest("block", "other").alias("hi"),
    )
    x, y = placed.alias("x"), placed.alias("y")
    met_once = (F.col("x.block") != F.col("y.block")) | (F.col("x.lo") == F.col("x.hi"))
    return x.join(
        y,
        (F.col("x.lo") == F.col("y.lo"))
        & (F.col("x.hi") == F.col("y.hi"))
        & (F.col("x.id") < F.col("y.id"))
        & met_once,
    ).select(
        F.col("x.id").alias("earlier_ord"),
        F.col("y.id").alias("later_ord"),
        tx.jaccard(F.col("x.words"), F.col("y.words")).alias("score"),
    )


def _placed_sets(candidates: DataFrame, sizes: DataFrame) -> DataFrame:
    """``id, grp`` of the sets in candidate pairs: groups of sets that are likely to be compared.

    Sets with the same least partner are together, near copies of one record above all. So many that
    their words (``sizes``: id, n) or their number pass a bound are dealt into several groups; those far
    below it are put together, so that pairs without such order are not a cell each.
    """
    ends = F.array(*[
        F.struct(F.col(f"{own}_ord").alias("id"), F.col(f"{other}_ord").alias("other"))
        for own, other in (("earlier", "later"), ("later", "earlier"))
    ])
    leads = candidates.select(F.inline(ends)).groupBy("id").agg(F.least("id", F.min("other")).alias("lead"))
    known = stage(leads.join(sizes.groupBy("id").agg(F.max("n").alias("n")), "id"))
    held = F.greatest(F.sum("n") / CELL_WORDS, F.count(F.lit(1)) / CELL_SETS)
    crowded = known.groupBy("lead").agg(held.alias("held")).filter(F.col("held") > SMALL_CELL)
    crowded = crowded.select("lead", F.ceil("held").alias("groups"))
    words = known.agg(F.sum("n")).first()[0] or 0
    least = int(candidates.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    alone = F.pmod(F.xxhash64("lead"), F.lit(max(least, math.ceil(2 * words / CELL_WORDS))))
    dealt = F.xxhash64("lead", F.pmod(F.xxhash64("id"), F.col("groups")))
    group = F.when(F.col("groups").isNull(), alone).otherwise(dealt)
    return stage(known.join(crowded, "lead", "left").select("id", group.alias("grp")))


def _score_cells(threshold: float):
    """Scores of the pairs of each cell, and its sets: rows come by cell, sets (no ``other``) before pairs."""

    def ready(ids: list[np.ndarray], sets: list[pa.Array]):
        """The sets of a cell: ids and their order, and words as numbers from ``start``, ``size`` of them."""
        words = pa.concat_arrays(sets)
        size = words.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = words.flatten().dictionary_encode()
        codes, mark = coded.indices.to_numpy(zero_copy_only=False), np.zeros(len(coded.dictionary), bool)
        every = np.concatenate(ids)
        return every, np.argsort(every, kind="stable"), codes, np.cumsum(size) - size, size, mark

    def score(held, pairs: tuple[np.ndarray, np.ndarray]):
        ids, order, codes, start, size, mark = held
        first, times = [], []
        for side in pairs:  # of a repeated id, each row is compared
            first.append(np.searchsorted(ids, side, "left", sorter=order))
            times.append(np.searchsorted(ids, side, "right", sorter=order) - first[-1])
        each = times[0] * times[1]
        pair = np.repeat(np.arange(len(each)), each)
        nth = np.arange(len(pair)) - np.repeat(np.cumsum(each) - each, each)
        x = order[first[0][pair] + nth // times[1][pair]]
        y = order[first[1][pair] + nth % times[1][pair]]
        by = np.argsort(x, kind="stable")
        x, y, pair = x[by], y[by], pair[by]
        cuts = np.flatnonzero(np.diff(x, prepend=-1, append=-1)).tolist()
        for a, b in zip(cuts, cuts[1:], strict=False):
            own = codes[start[x[a]] : start[x[a]] + size[x[a]]]
            mark[own] = True
            n = size[y[a:b]]
            ends = np.cumsum(n)
            flat = np.arange(ends[-1]) + np.repeat(start[y[a:b]] - ends + n, n)
            found = np.concatenate(([0], np.cumsum(mark[codes[flat]])))
            mark[own] = False
            common = found[ends] - found[ends - n]
            scores = common / np.maximum(len(own) + n - common, 1)
            kept = scores >= threshold
            at = pair[a:b][kept]
            yield pairs[0][at], pairs[1][at], scores[kept]

    def run(batches):
        ids, sets, held, cell, out = [], [], None, None, []
        for batch in batches:
            cells = batch.column("cell").to_numpy(zero_copy_only=False)
            paired = batch.column("other").is_valid().to_numpy(zero_copy_only=False)
            new = (cells[1:] != cells[:-1]) | (paired[1:] != paired[:-1])
            cuts = [0, *(np.flatnonzero(new) + 1).tolist(), len(cells)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                if cells[a] != cell:
                    ids, sets, held, cell = [], [], None, cells[a]
                own = batch.column("id").slice(a, b - a).to_numpy(zero_copy_only=False)
                if not paired[a]:
                    ids.append(own)
                    sets.append(pa.concat_arrays([batch.column("words").slice(a, b - a)]))
                elif ids:
                    if held is None:
                        held, sets = ready(ids, sets), []
                    other = batch.column("other").slice(a, b - a).to_numpy(zero_copy_only=False)
                    out.extend(score(held, (own, other)))
            if out:
                names = ("earlier_ord", "later_ord", "score")
                yield pa.RecordBatch.from_pydict({c: np.concatenate(v) for c, v in zip(names, zip(*out), strict=True)})
                out = []

    return run


def _cells(dataset: Dataset, candidates: DataFrame, sizes: DataFrame) -> tuple[DataFrame, int]:
    """Rows of cells (cell, id, other, words), sets and staged candidates, and into how many parts to deal them.

    Sets do not travel with each of their pairs: two groups of sets that have candidates are a cell, and a
    set is sent once to each cell that has a pair of it.
    """
    groups = _placed_sets(candidates, sizes)
    known = groups.count()
    if known <= BROADCAST_KEYS:
        grouped = candidates
        for side in ("earlier", "later"):
            named = groups.select(F.col("id").alias(f"{side}_ord"), F.col("grp").alias(f"{side}_grp"))
            grouped = grouped.join(F.broadcast(named), f"{side}_ord")
    else:
        grouped = _beside(candidates, groups)
    cell = F.xxhash64(F.least("earlier_grp", "later_grp"), F.greatest("earlier_grp", "later_grp"))
    tasks = int(candidates.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tasks = min(8 * tasks, max(tasks, known // TASK_SETS))
    pairs = stage(grouped.select(cell.alias("cell"), "earlier_ord", "later_ord").repartition(tasks, "cell"))
    ends = pairs.select("cell", F.explode(F.array("earlier_ord", "later_ord")).alias("rec_ord"))
    members = stage(ends.groupBy("rec_ord").agg(F.collect_set("cell").alias("cells")))
    places = members.agg(F.sum(F.size("cells"))).first()[0] or 0
    if known <= BROADCAST_KEYS and places <= 4 * BROADCAST_KEYS:
        members = F.broadcast(members)
    sets = dataset.df.join(members, "rec_ord").select(
        F.col("rec_ord").alias("id"), tx.word_set(dataset.content.text()).alias("words"), "cells"
    )
    rows = sets.select(F.explode("cells").alias("cell"), "id", F.lit(None).cast("bigint").alias("other"), "words")
    asked = pairs.select(
        "cell", F.col("earlier_ord").alias("id"), F.col("later_ord").alias("other"),
        F.lit(None).cast("array<string>").alias("words"),
    )
    return rows.unionByName(asked), tasks


def _scored(dataset: Dataset, candidates: DataFrame, sizes: DataFrame, threshold: float) -> DataFrame:
    """Staged candidates with their scores, those that reach the threshold."""
    rows, tasks = _cells(dataset, candidates, sizes)
    dealt = rows.repartition(tasks, "cell").sortWithinPartitions("cell", "other")
    return dealt.mapInArrow(_score_cells(threshold), "earlier_ord long, later_ord long, score double")


def similar_pairs(dataset: Dataset, threshold: float, scan: DataFrame | None = None) -> DataFrame:
    """``(earlier_ord, later_ord, score)`` of distinct contents with score >= threshold.

    Each content is represented by the ``rec_ord`` of its first record. ``scan`` is a staged table of
    rec_ord, key and ``similarity_column`` (as ``sig``), where there is one.
    """
    if threshold == 0:
        return _every_pair(dataset)
    if scan is None:
        columns = ["rec_ord", dataset.content.key().alias("key"), similarity_column(dataset, threshold).alias("sig")]
        scan = stage_table(dataset.df.select(*columns), "scan")
    by_parts = threshold >= PARTS_FROM
    candidates = stage((_pairs_by_parts if by_parts else _pairs_by_prefix)(scan, threshold))
    n = F.col("sig.n") if by_parts else F.size("sig")
    return _scored(dataset, candidates, scan.select(F.col("rec_ord").alias("id"), n.alias("n")), threshold)
