from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from tamis.dataset import records_from_table
from tamis.operators import similarity, skew
from tamis.operators.duplicates import detect_duplicates
from tamis.operators.numbering import record_positions


def found(issues_df):
    rows = issues_df.select("category", "issue_ord", "detail", "score").collect()
    return sorted((r.category, r.issue_ord.rec_ord, r.issue_ord.a, r.detail, r.score) for r in rows)


def brute_force(texts: list[str], threshold: float, step: int = 10):
    """All pairs, straight from the definition."""
    sets = [frozenset(re.findall(r"\w+", t.lower())) for t in texts]
    out, first = [], {}
    for i, text in enumerate(texts):
        if text in first:
            j = first[text]
            detail = f"Record at index {i} is byte-for-byte identical to the record at index {j}"
            out.append(("duplicate", i * step, j * step, detail, None))
            continue
        first[text] = i
        for j in range(i):
            union = sets[i] | sets[j]
            score = len(sets[i] & sets[j]) / len(union) if union else 0.0
            if texts[j] != text and score >= threshold:
                detail = (
                    f"Record at index {i} is a near-duplicate of the record at index {j} "
                    f"(similarity {score:.3f} >= threshold {threshold:.3f})"
                )
                out.append(("near_duplicate", i * step, j * step, detail, score))
    return sorted(out)


def corpus(seed: int, count: int) -> list[str]:
    """Families of near copies, exact copies, short and empty texts."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    texts: list[str] = []
    while len(texts) < count:
        kind = rng.random()
        if texts and kind < 0.25:
            texts.append(rng.choice(texts))
        elif texts and kind < 0.7:
            words = rng.choice(texts).split()
            for _ in range(rng.randint(0, max(1, len(words) // 8))):
                if words:
                    words[rng.randrange(len(words))] = rng.choice(vocabulary)
            texts.append(" ".join(words) + rng.choice(["", "", " extra", "!"]))
        else:
            size = rng.choice([0, 1, 2, 5, 9, 10, 11, 20, 60, 150])
            texts.append(" ".join(rng.choices(vocabulary, k=size)))
    return texts


@pytest.mark.parametrize("threshold", [1.0, 0.95, 0.9, 0.85, 0.8, 0.5, 0.25, 0.0])
def test_equal_to_brute_force(dataset, threshold):
    texts = corpus(int(threshold * 100), 160)
    ds = dataset([{"text": t} for t in texts], partitions=3)
    assert found(detect_duplicates(ds, threshold)) == brute_force(texts, threshold)


def test_same_result_for_any_partitioning(dataset):
    texts = corpus(11, 120)
    results = [
        found(detect_duplicates(dataset([{"text": t} for t in texts], partitions=n), 0.9))
        for n in (1, 4, 17)
    ]
    assert results[0] == results[1] == results[2]


def test_hot_content_takes_the_broadcast_path(dataset, monkeypatch):
    monkeypatch.setattr(skew, "HOT_WEIGHT", 3)
    monkeypatch.setattr(skew, "HOT_KEYS", 2)
    texts = corpus(12, 60) + ["the same text again and again"] * 60 + corpus(13, 60)
    for threshold in (0.9, 0.5):
        ds = dataset([{"text": t} for t in texts])
        assert found(detect_duplicates(ds, threshold)) == brute_force(texts, threshold)


def test_sort_merge_join_gives_the_same(spark, dataset):
    texts = corpus(14, 120)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        ds = dataset([{"text": t} for t in texts])
        assert found(detect_duplicates(ds, 0.9)) == brute_force(texts, 0.9)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.mark.parametrize("threshold", [0.9, 0.6])
def test_hot_groups_are_compared_in_blocks(dataset, monkeypatch, threshold):
    """Many records differ in one word and share the rest: few, very hot join keys."""
    monkeypatch.setattr(skew, "BLOCK_ROWS", 7)
    shared = " ".join(f"common{i}" for i in range(11))
    texts = [f"{shared} own{i}" for i in range(60)]
    texts += [t + " " + t for t in texts[:20]] + corpus(15, 60)
    ds = dataset([{"text": t} for t in texts])
    assert found(detect_duplicates(ds, threshold)) == brute_force(texts, threshold)


def test_many_rows_of_both_sides_are_joined_in_blocks(spark, monkeypatch):
    """A key of a third of all rows, on one side or both: the rows of a plain join, in small groups."""
    monkeypatch.setattr(skew, "BLOCK_ROWS", 10)
    left = spark.createDataFrame([(0 if i % 3 else i % 11, i) for i in range(300)], "k long, a long")
    right = spark.createDataFrame([(0 if i % 3 == 0 else i % 13, i) for i in range(150)], "k long, b long")
    one = spark.createDataFrame([(i, 10 * i) for i in range(11)], "k long, b long")
    for other, unique in ((right, False), (one, True)):
        crowded = skew.crowded_keys(left, None if unique else other, "k")
        sizes = {r.k: (r._l_blocks, r._r_blocks) for r in crowded.collect()}
        assert sizes[0] == (21, 1 if unique else 6)
        joined = skew.join_in_blocks(left, other, "k", crowded, "a", "b")
        assert joined.columns == ["k", "a", "b"]
        assert sorted(map(tuple, joined.collect())) == sorted(map(tuple, left.join(other, "k").collect()))
    assert skew.crowded_keys(one, None, "k") is None


def test_parity_maps_leave_few_candidates(dataset, monkeypatch):
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(300)]
    base = [rng.sample(vocabulary, 60) for _ in range(120)]
    texts = [" ".join(b) for b in base] + [" ".join(b[:50] + ["new"]) for b in base[:15]]
    seen = {}
    for name in ("_near_maps", "_likely"):
        def counted(pairs, *args, name=name, run=getattr(similarity, name)):
            seen[name] = pairs.count()
            return run(pairs, *args)

        monkeypatch.setattr(similarity, name, counted)
    assert found(detect_duplicates(dataset([{"text": t} for t in texts]), 0.6)) == brute_force(texts, 0.6)
    assert seen["_likely"] <= 20 < seen["_near_maps"]


@pytest.mark.parametrize("threshold", [0.3, 0.6])
def test_stripes_of_maps_equal_brute_force(dataset, monkeypatch, threshold):
    """common words make no rows of candidates; stripes give the same pairs, almost alone."""
    monkeypatch.setattr(similarity, "FEW_PAIRS", 0)
    monkeypatch.setattr(similarity, "PAIRS_PER_SET", 0)
    monkeypatch.setattr(similarity, "STRIPE_SETS", 8)
    monkeypatch.setattr(similarity, "TILE", 1 << 14)
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(900)]
    texts = corpus(4, 80) + [" ".join(rng.sample(vocabulary, rng.choice([40, 300]))) for _ in range(60)]
    seen = []

    def counted(pairs, *args, run=similarity._likely):
        seen.append((pairs.count(), pairs.distinct().count()))
        return run(pairs, *args)

    monkeypatch.setattr(similarity, "_likely", counted)
    right = brute_force(texts, threshold)
    assert found(detect_duplicates(dataset([{"text": t} for t in texts]), threshold)) == right
    assert seen[0][0] == seen[0][1] < 9_000


def test_block_pairs_meet_once(spark, monkeypatch):
    monkeypatch.setattr(skew, "BLOCK_ROWS", 4)
    rows = spark.createDataFrame([(i, 1 if i < 50 else i % 7 + 2) for i in range(90)], "id long, k long")
    for limit in (0, 1_000_000):
        monkeypatch.setattr(skew, "BROADCAST_KEYS", limit)
        blocked = skew.in_blocks(rows, "k", "id")
        largest = blocked.groupBy("k", "_lo", "_hi").count().agg(F.max("count")).first()[0]
        met = blocked.alias("x").join(
            blocked.alias("y"),
            skew.block_keys("x", "y", "k") & skew.met_once("x", "y") & (F.col("x.id") < F.col("y.id")),
        )
        pairs = sorted((r[0], r[1]) for r in met.select("x.id", "y.id").collect())
        by_key = {r.id: r.k for r in rows.collect()}
        assert pairs == [(a, b) for a in range(90) for b in range(a + 1, 90) if by_key[a] == by_key[b]]
        assert largest < 25


@pytest.mark.parametrize("threshold", [0.85, 0.9, 0.97])
def test_similar_sets_always_share_a_signature(threshold):
    """Recall of the signatures alone, on pairs at and just above the threshold."""
    rng = np.random.default_rng(3)
    sign = similarity._signatures_udf(threshold).func
    lefts, rights = [], []
    for size in [1, 2, 3, 7, 10, 11, 19, 20, 33, 64, 100, 101, 250, 900]:
        for _ in range(60):
            universe = rng.integers(-(2**62), 2**62, size * 2, dtype=np.int64)
            left = universe[:size]
            most = min(size, int(size * (1 - threshold)) + 1)
            drop, add = rng.integers(0, most + 1, 2)
            right = np.concatenate([left[drop:], universe[size : size + add]])
            if len(right) and (size - drop) / (size + add) >= threshold:
                lefts.append(left)
                rights.append(right)
    assert len(lefts) > 200
    a, b = (sign(pa.array(list(map(list, s)), pa.list_(pa.int64()))).to_pylist() for s in (lefts, rights))
    for left, right in zip(a, b):
        home_l, home_r = set(left["home"]), set(right["home"])
        shared = home_l & home_r | home_l & set(right["visit"]) | set(left["visit"]) & home_r
        assert shared
        assert bin((left["parity"] ^ right["parity"]) & (2**64 - 1)).count("1") <= (
            (1 - threshold) / (1 + threshold) * (left["n"] + right["n"]) + 1e-6
        )


def test_key_order_and_types_of_values(dataset):
    def count(a, b):
        return len(found(detect_duplicates(dataset([a, b]), 1.0)))

    assert count({"a": "x", "b": "y"}, {"b": "y", "a": "x"}) == 1
    assert count({"v": True}, {"v": 1}) == 0
    assert count({"v": {"p": 1, "q": [1, 2]}}, {"v": {"q": [1, 2], "p": 1}}) == 1
    assert count({"v": "1"}, {"w": "1"}) == 1  # different names, same words
    assert count({"v": ""}, {"w": ""}) == 0  # no words at all
    assert count({"v": None}, {}) == 0


def test_bad_threshold_keeps_the_default(dataset, issues):
    for bad in (1.5, -0.1, float("nan"), True, "0.5", None):
        got = issues(detect_duplicates(dataset([{"t": "a"}]), bad))
        assert [g["category"] for g in got] == ["config_error"]
        assert got[0]["detail"] == (
            f"Invalid configuration for 'similarity_threshold': {bad!r}; retaining default 0.9"
        )


def test_typed_records_compare_whole_rows(spark):
    rows = [(1, "a", 1, 1.5, [1, 2]), (2, "a", 1, 1.5, [1, 2]), (3, "a", None, 1.5, [1, 2]),
            (4, "a", 1, 2.5, [1, 2]), (5, "a", 1, 1.5, [2, 1]), (6, "a", None, 1.5, [1, 2])]
    df = spark.createDataFrame(rows, "id long, t string, n int, f double, l array<int>")
    ds = records_from_table(df, ["t", "n", "f", "l"], "id")
    exact = [f[1:3] for f in found(detect_duplicates(ds, 1.0)) if f[0] == "duplicate"]
    assert exact == [(2, 1), (6, 3)]


def test_positions_are_dense_for_any_order_values(spark):
    rng = random.Random(1)
    values = {rng.randrange(-(2**62), 2**62) for _ in range(300)}
    values |= {i for i in range(500)} | {(3 << 40) + i for i in range(200)}
    df = spark.createDataFrame([(v,) for v in values], "rec_ord long").repartition(5)
    got = {r.rec_ord: r.rec_idx for r in record_positions(df).collect()}
    assert got == {v: i for i, v in enumerate(sorted(values))}


def test_lookup_by_hot_key(spark, monkeypatch):
    monkeypatch.setattr(skew, "HOT_WEIGHT", 5)
    rows = spark.createDataFrame(
        [(i, 0 if i % 3 == 0 else i % 50) for i in range(600)], "id long, k long"
    )
    table = rows.groupBy("k").agg(F.count("*").alias("n"), F.max("id").alias("top"))
    got = skew.attach_by_key(rows, table, "k", "n", "id").collect()
    tops = {r.k: (r.n, r.top) for r in table.collect()}
    assert sorted((r.id, r.k, r.n, r.top) for r in got) == sorted(
        (r.id, r.k, *tops[r.k]) for r in rows.collect()
    )


def test_signatures_are_made_slice_by_slice(spark, monkeypatch):
    """a task's memory follows SLICE_WORDS, not the batch; sets are the same in any slices."""
    import inspect

    from tamis.operators.similarity import _by_slices

    sets = pa.array([list(range(i % 7)) for i in range(100)], pa.list_(pa.int64()))
    seen = []

    def work(part):
        seen.append(len(part.flatten()))
        return part

    monkeypatch.setattr(similarity, "SLICE_WORDS", 10)
    assert _by_slices(sets, work).to_pylist() == sets.to_pylist()
    assert len(seen) > 10 and max(seen) < 20
    assert _by_slices(sets.slice(0, 0), work).to_pylist() == []
    assert "_by_slices" in inspect.getsource(similarity._signatures_udf)


def test_only_shared_signatures_meet(dataset, monkeypatch):
    """F8, F10 to F17: signatures of one set alone are neither joined nor carried along."""
    rng = random.Random(12)
    vocabulary = [f"w{i}" for i in range(3000)]
    texts = [" ".join(rng.sample(vocabulary, 80)) for _ in range(50)]
    texts.append(texts[0] + " more")
    seen = []

    def counted(rows, *args, run=similarity.in_blocks):
        seen.append(rows.select("id").distinct().count())
        return run(rows, *args)

    monkeypatch.setattr(similarity, "in_blocks", counted)
    assert found(detect_duplicates(dataset([{"text": t} for t in texts]), 0.9)) == brute_force(texts, 0.9)
    assert seen == [2]


def test_sets_meet_once_for_all_their_pairs(dataset, monkeypatch):
    """F11 to F16: neither shared signatures nor candidates multiply the rows and words that travel."""
    rng = random.Random(5)
    base = [f"w{i}" for i in range(200)]
    texts = [" ".join([*base[:k], f"new{k}", *base[k + 1 :]]) for k in rng.sample(range(200), 30)]
    met, made = [], []

    def counted(rows, *args, run=similarity.in_blocks):
        met.append(rows.count())
        return run(rows, *args)

    def seen(*args, run=similarity._cells):
        out = run(*args)
        made.append((out[0].filter("words is not null").count(), out[0].filter("words is null").count()))
        return out

    monkeypatch.setattr(similarity, "in_blocks", counted)
    monkeypatch.setattr(similarity, "_cells", seen)
    assert found(detect_duplicates(dataset([{"text": t} for t in texts]), 0.9)) == brute_force(texts, 0.9)
    assert met[0] <= 3 * len(texts)
    assert made == [(len(texts), len(texts) * (len(texts) - 1) // 2)]


@pytest.mark.parametrize("threshold", [0.9, 0.5])
def test_cells_of_few_sets_give_the_same(dataset, monkeypatch, threshold):
    """F11 to F16: groups of few words or sets, with known places broadcast or shuffled."""
    texts = corpus(21, 120)
    ds = dataset([{"text": t} for t in texts])
    for words, sets, broadcast in ((300, 2048, 1_000_000), (400_000, 3, 0)):
        monkeypatch.setattr(similarity, "CELL_WORDS", words)
        monkeypatch.setattr(similarity, "CELL_SETS", sets)
        monkeypatch.setattr(similarity, "BROADCAST_KEYS", broadcast)
        assert found(detect_duplicates(ds, threshold)) == brute_force(texts, threshold)


def test_each_row_of_a_repeated_order_value_is_scored():
    """F11 to F16: a cell may hold several sets of one id, or none; its rows may come in several batches."""
    ids, other = [1, 1, 2, 1, 1], [None, None, None, 2, 3]
    words = [["a", "b"], ["a", "c"], ["a", "b"], None, None]
    rows = pa.RecordBatch.from_pydict({
        "cell": pa.array([7] * 5, pa.int64()), "id": pa.array(ids, pa.int64()),
        "other": pa.array(other, pa.int64()), "words": pa.array(words, pa.list_(pa.string())),
    })
    for cuts in ([0, 5], [0, 1, 4, 5]):
        batches = [rows.slice(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]
        out = [tuple(r.values()) for b in similarity._score_cells(0.1)(batches) for r in b.to_pylist()]
        assert sorted(out) == [(1, 2, 1 / 3), (1, 2, 1.0)]


@pytest.mark.parametrize("broadcast", [1_000_000, 0])
def test_signatures_of_single_contents_stay_where_they_are(dataset, monkeypatch, broadcast):
    """F12 to F15: only contents that come several times are shuffled and staged again with their signatures."""
    rng = random.Random(8)
    texts = [" ".join(f"w{rng.randrange(3000)}" for _ in range(80)) for _ in range(30)]
    texts += [texts[3], texts[0] + " more", texts[3], texts[3] + " more", texts[7]]
    staged = []

    def counted(df, name, run=similarity.stage_table):
        out = run(df, name)
        if name == "signatures":
            staged.append(out.count())
        return out

    monkeypatch.setattr(similarity, "stage_table", counted)
    monkeypatch.setattr(similarity, "BROADCAST_KEYS", broadcast)
    assert found(detect_duplicates(dataset([{"text": t} for t in texts]), 0.9)) == brute_force(texts, 0.9)
    assert staged == [2 if broadcast else 32]


def cells_compared(sets: list[frozenset], threshold: float, tasks: int = 4):
    """The pairs of ``_compare_cells`` over all cells of the sets (of numbers), dealt as by ``_pairs_by_stripes``."""
    words, times = np.unique(np.concatenate([list(s) for s in sets]), return_counts=True)
    rank = np.empty((times > 1).sum(), np.int64)
    rank[np.argsort(times[times > 1], kind="stable")] = np.arange(1, len(rank) + 1)
    hashes = pa.array([list(s) for s in sets], pa.list_(pa.int64()))
    codes = similarity._codes_udf(words[times > 1], rank).func(hashes)
    bands = {}
    for i, s in enumerate(sets):
        bands.setdefault(int(np.floor(np.log(len(s)) / np.log(similarity.BAND))), []).append(i)
    sizes = []
    for b, at in bands.items():
        n = [len(sets[i]) for i in at]
        sizes.append(Row(band=b, sets=len(n), words=sum(n), least=min(n), most=max(n)))
    spans, rows = similarity._stripes(sizes, tasks, threshold)
    placed = []
    for b, first, parts, low, high in rows:
        for i in bands[b]:
            own = first + i * 7919 % parts
            for other in range(low, high + 1):
                cell = min(own, other) * len(spans) + max(own, other)
                placed.append((cell, (other < own) - (other > own), i))
    placed.sort()
    cell, side, at = (np.array(c) for c in zip(*placed, strict=True))
    table = pa.RecordBatch.from_pydict(
        {"cell": cell, "side": side.astype(np.int32), "id": at, "codes": codes.take(pa.array(at))}
    )
    batches = [table.slice(k, 37) for k in range(0, len(at), 37)]
    out = [tuple(r.values()) for b in similarity._compare_cells(threshold, spans)(batches) for r in b.to_pylist()]
    assert len(out) == len(set(out))
    return set(out), len(spans)


def random_sets(rng: random.Random, count: int, vocabulary: int, sizes: list[int], copies: float = 0.4):
    words = [rng.randrange(-(2**62), 2**62) for _ in range(vocabulary)]
    weights = [1 / (i + 1) for i in range(vocabulary)]
    sets: list[frozenset] = []
    while len(sets) < count:
        if sets and rng.random() < copies:
            kept = [w for w in rng.choice(sets) if rng.random() < 0.85]
            new = frozenset(kept + rng.choices(words, k=rng.randint(0, 1 + len(kept) // 5)))
        else:
            new = frozenset(rng.choices(words, weights, k=rng.choice(sizes)))
        sets += [new] if new else []
    return sets


@pytest.mark.parametrize("threshold", [0.05, 0.3, 0.6, 0.8])
def test_cells_give_all_pairs(spark, monkeypatch, threshold):
    """by rare words or by all maps, in any slices, with one stripe or many of one size."""
    rng = random.Random(f"{threshold}")
    striped = []
    for vocabulary, stripe, tile, tasks in (
        (40, 512, 1 << 21, 4), (400, 8, 1 << 8, 4), (3000, 4, 1 << 14, 200), (3000, 8, 1 << 8, 48)
    ):
        monkeypatch.setattr(similarity, "STRIPE_SETS", stripe)
        monkeypatch.setattr(similarity, "TILE", tile)
        monkeypatch.setattr(similarity, "SLICE_WORDS", rng.choice([50, 200_000]))
        sets = random_sets(rng, 150, vocabulary, [1, 2, 5, 20, 20, 20, 60, 150])
        right = {
            (i, j) for j in range(150) for i in range(j)
            if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= threshold
        }
        got, stripes = cells_compared(sets, threshold, tasks)
        assert right <= got and len(got - right) < 200
        striped.append(stripes)
    assert striped[0] == 1 and max(striped) > 10


@pytest.mark.parametrize("threshold", [0.3, 0.6])
def test_few_maps_are_compared(spark, monkeypatch, threshold):
    """only sets that share several rare words meet; no map is compared with all others."""
    rng, seen = random.Random(2), []

    def counted(maps, run=np.bitwise_count):
        seen.append(len(maps))
        return run(maps)

    monkeypatch.setattr(similarity.np, "bitwise_count", counted)
    monkeypatch.setattr(similarity.np, "unpackbits", None)
    sets = random_sets(rng, 600, 20_000, [60, 150], copies=0.05)
    right = {
        (i, j) for j in range(600) for i in range(j)
        if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= threshold
    }
    assert cells_compared(sets, threshold)[0] == right
    assert sum(seen) < 600 * 599 / 2 / 10


@pytest.mark.parametrize("threshold", [0.3, 0.6])
def test_pairs_of_stripes_are_joined_with_no_sets(dataset, monkeypatch, threshold):
    """F1, F2: pairs leave the stripes compared by codes, so only those that qualify are scored."""
    monkeypatch.setattr(similarity, "FEW_PAIRS", 0)
    monkeypatch.setattr(similarity, "PAIRS_PER_SET", 0)
    monkeypatch.setattr(similarity, "_beside", None)
    seen = []

    def counted(pairs, *args, run=similarity._likely):
        seen.append(pairs.count())
        return run(pairs, *args)

    monkeypatch.setattr(similarity, "_likely", counted)
    texts = list(dict.fromkeys(corpus(31, 120)))
    right = brute_force(texts, threshold)
    assert found(detect_duplicates(dataset([{"text": t} for t in texts]), threshold)) == right
    assert len(right) <= seen[0] <= len(right) + 20


def test_pairs_without_order_are_not_a_cell_each(spark):
    """sets of small groups are put together; pairs by chance have hundreds of first partners."""
    rng = random.Random(3)
    pairs = {tuple(sorted(rng.sample(range(1500), 2))) for _ in range(2000)}
    candidates = spark.createDataFrame(sorted(pairs), "earlier_ord long, later_ord long")
    groups = similarity._placed_sets(candidates, spark.range(1500).withColumn("n", F.lit(5))).collect()
    assert sorted(r.id for r in groups) == sorted({i for p in pairs for i in p})
    assert len({r.grp for r in groups}) <= 4
