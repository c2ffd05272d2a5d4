"""Operators with one right result, against plain versions over awkward documents."""

from __future__ import annotations

import hashlib
import json
import random
import subprocess
import sys
import tracemalloc
import zlib
from collections import Counter
from types import SimpleNamespace

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tamis.llm import common, decontamination, ngram_join, packing, sharding, suffix_dedup, token_counts, topk
from tests.llm.fixtures import LINE, PASSAGE, documents, prose, texts


def rows(df, *columns):
    return Counter(tuple(r[c] for c in columns) for r in df.collect())


# Packing


def test_packing_places_all_ids(spark):
    exact = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    expected = Counter()
    for doc_id, text in texts():
        ids = np.array([*exact.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        head = len(ids) % 64 or 64
        cuts = [0, *range(head, len(ids) + 1, 64)]
        for n, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            expected[doc_id, n, a, b - a, zlib.crc32(ids[a:b].tobytes())] += 1
    placed = packing.packed_documents(documents(spark), capacity=64)
    found = placed.collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found) == expected
    sequences: dict[int, list] = {}
    for r in found:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 64
    total = sum(r.length for r in found)
    assert len(sequences) <= 1.03 * total / 64 + 1


def test_packing_of_sources_one_after_another(spark):
    """Pieces of 1,100 and of 900 tokens, by source, meet each other, over more pieces than a node takes."""
    n = 8_000
    sizes = F.when(F.col("id") < n, 1100).otherwise(900).cast("int")
    placed = packing.pack(spark.range(0, 2 * n, 1, 8).withColumn("length", sizes), node_pieces=2_000)
    assert placed.select("id").distinct().count() == placed.count() == 2 * n
    assert placed.select("sequence_id").distinct().count() <= 1.05 * n


def test_packing_of_nothing(spark):
    assert packing.packed_documents(documents(spark, [])).count() == 0
    with pytest.raises(ValueError, match="sequence_id"):
        packing.pack(spark.createDataFrame([(1, 2)], "length int, sequence_id long"))


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(1, 30), max_size=60))
def test_best_fit_bins(lengths):
    lengths = np.array(lengths, dtype=np.int64)
    bins = packing.best_fit(lengths, 30)
    assert sorted(i for b in bins for i in b) == list(range(len(lengths)))
    fills = sorted(int(lengths[b].sum()) for b in bins)
    assert all(f <= 30 for f in fills)
    assert sum(f <= 15 for f in fills) <= 1  # two half-empty bins would have been one


# Near duplicates


def brute_components(docs: list[tuple[int | None, str | None]]) -> Counter:
    sets = []
    for _, text in docs:
        w = (text or "").encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    parent = list(range(len(docs)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            common = len(a & sets[j])
            if a and 100 * common >= 80 * len(a | sets[j]):
                parent[max(find(i), find(j))] = min(find(i), find(j))
    ids: dict[int, list] = {}
    for i, (doc_id, _) in enumerate(docs):
        ids.setdefault(find(i), []).append(doc_id)
    least = {k: min((x for x in v if x is not None), default=None) for k, v in ids.items()}
    return Counter(
        (doc_id, len(sets[i]), least[find(i)] if sets[i] else doc_id) for i, (doc_id, _) in enumerate(docs)
    )


def families() -> list[tuple[int, str]]:
    """Chains and stars of near copies, short and long, some below the threshold."""
    rnd, out = random.Random(4), []
    for family, size in enumerate([4, 6, 9, 12, 30, 80, 300]):
        base = [rnd.choice("abcdefghijklmnopqrstuvwxyz") + str(rnd.randint(0, 99)) for _ in range(size)]
        last = base
        for k in range(12):
            own = list(base if k % 2 else last)
            for _ in range(rnd.randint(0, max(1, size // 60))):
                own[rnd.randrange(size)] = f"new{k}"
            last = own
            out.append((1000 * family + k, " ".join(own)))
            out.append((1000 * family + 500 + k, " ".join(own[: size - k // 3] + PASSAGE.split()[: k % 4])))
    return out


def test_near_duplicates(spark):
    docs = [*texts(), *families()]
    found = ngram_join.near_duplicates(documents(spark, docs))
    assert rows(found, "doc_id", "n_shingles", "component_id") == brute_components(docs)


def test_members_of_a_list_whose_centre_is_too_large(spark):
    """Two texts link with each other and with nothing else; the centre of their lists holds both."""
    words = [f"w{i}" for i in range(103)]
    own, other = [*words], [*words]
    own[0], other[102] = "a", "b"
    docs = [(1, " ".join(own)), (2, " ".join(other)), (3, " ".join(["a", *words[1:], "b", *(f"z{i}" for i in range(44))]))]
    found = ngram_join.near_duplicates(documents(spark, docs))
    expected = brute_components(docs)
    assert (2, 99, 1) in expected and (3, 144, 3) in expected
    assert rows(found, "doc_id", "n_shingles", "component_id") == expected


def test_light_sets_enumerate_subsets(spark, monkeypatch):
    """Whatever the boundary is, the links are the same."""
    docs = families()
    for edge in (0, 12, 10_000):
        monkeypatch.setattr(ngram_join, "boundary", lambda prefixes, percent, e=edge: e)
        found = ngram_join.near_duplicates(documents(spark, docs if edge < 100 else docs[:120]))
        expected = brute_components(docs if edge < 100 else docs[:120])
        assert rows(found, "doc_id", "n_shingles", "component_id") == expected


def test_one_of_each(spark):
    kept = ngram_join.one_of_each(documents(spark))
    assert kept.columns == documents(spark, []).columns
    ids = Counter(r.doc_id for r in kept.collect())
    assert ids[1] == 1 and not ids[5] and not ids[6] and ids[None] == 1 and ids[20] == 2 and ids[2] == 1
    assert ngram_join.one_of_each(documents(spark, [])).count() == 0


# Shards


def test_shards(spark):
    docs = texts()
    found = sharding.shard_by_bytes(documents(spark), 5).collect()
    sizes = sorted(len((t or "").encode()) + 16 for _, t in docs)
    assert sorted(r["size"] for r in found) == sizes
    assert {zlib.crc32((t or "").encode()) for _, t in docs} == {r.text_crc32 for r in found}
    by: dict[int, list] = {}
    for r in found:
        by.setdefault(r.shard, []).append(r)
    for own in by.values():
        assert sorted(r.slot for r in own) == list(range(len(own)))
    target, largest = sum(sizes) / 5, max(sizes)
    assert all(sum(r["size"] for r in own) <= target + largest for own in by.values())
    order = [r.doc_id for r in sorted(found, key=lambda r: (r.shard, r.slot))]
    assert order == sorted(order, key=lambda x: (x is not None, x))
    assert sharding.shard_by_bytes(documents(spark, []), 5).count() == 0
    same = sharding.shard_by_bytes(documents(spark, [(7, "same")] * 40), 4)  # one key has all rows
    assert rows(same.groupBy("shard").count(), "count") == Counter({(10,): 4})


def test_shards_of_large_tables(spark):
    """Quotients just below a whole number stay below it."""
    near = documents(spark, [(1, ""), (2, "a")])  # 2e9 / (2e9 + 1) and 3 - 2 / (4e9 + 2)
    assert rows(sharding.shard_by_bytes(near, 4, overhead=10**9), "doc_id", "shard") == Counter([(1, 0), (2, 2)])
    for total, size in ((30 * 10**9, 500), (7 * 10**8, 16), (10**14, 10**6)):
        at = [(b, size) for b in (0, total // 40 - size, total // 2 - size, total // 2, total - size)]
        found = spark.createDataFrame(at, "_before long, size long").withColumn("shard", sharding.shard_of(40, total))
        assert rows(found, "_before", "shard") == Counter((b, (2 * b + s) * 40 // (2 * total)) for b, s in at)


# Repeated strings


def brute_repeats(docs: list[tuple[int | None, str | None]]) -> dict:
    seen, out = set(), {}
    for doc_id, text in sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0)):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - 99):
            if data[i : i + 100] in seen:
                gone[i : i + 100] = b"\1" * 100
            seen.add(data[i : i + 100])
        kept = bytes(c for c, g in zip(data, gone, strict=True) if not g)
        spans = sum(1 for i in range(len(gone)) if gone[i] and not (i and gone[i - 1]))
        out.setdefault(doc_id, Counter())[len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest()] += 1
    return out


def check_repeats(spark, docs):
    found: dict = {}
    for r in suffix_dedup.remove_repeats(documents(spark, docs)).collect():
        own = found.setdefault(r.doc_id, Counter())
        own[r.n_bytes, r.n_removed, len(r.spans), hashlib.sha256(r.kept).hexdigest()] += 1
    assert found == brute_repeats(docs)


def test_repeated_strings(spark):
    # Rows of one id and different texts have no order of their own; leave these out.
    docs = [d for n, d in enumerate(texts()) if d[0] != 20]
    check_repeats(spark, docs)
    check_repeats(spark, [])


def test_strings_that_differ_around_a_shared_middle(spark):
    """Lines of 60 to 160 bytes in random surroundings, some at the very ends of texts."""
    rnd = random.Random(8)
    noise = lambda n: "".join(rnd.choice("abcdefgh ") for _ in range(n))
    lines = [noise(n) for n in (60, 90, 98, 99, 100, 101, 130, 160)]
    docs = [(i, noise(rnd.randint(0, 150)) + rnd.choice(lines) + noise(rnd.randint(0, 150))) for i in range(60)]
    docs += [(100 + i, lines[i] + lines[(i + 1) % 8]) for i in range(8)]
    check_repeats(spark, docs)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.binary(max_size=6).map(lambda b: bytes(c & 1 for c in b)), max_size=8), min_size=1, max_size=6))
def test_loser_tree(runs):
    runs = [sorted(set(r)) for r in runs]
    coded = [(r, suffix_dedup.front_coded(r)[0].tolist()) for r in runs]
    out = [(runs[run][at], common) for run, at, common in suffix_dedup.merged(coded)]
    assert [s for s, _ in out] == sorted(s for r in runs for s in r)
    for (a, _), (b, common) in zip(out, out[1:], strict=False):
        assert common == suffix_dedup.prefix_from(a, b, 0)


@settings(max_examples=30, deadline=None)
@given(st.lists(st.binary(max_size=20), max_size=20))
def test_front_coding_round_trip(suffixes):
    suffixes = sorted(suffixes)
    assert suffix_dedup.decoded(*suffix_dedup.front_coded(suffixes)) == suffixes


# Contamination


def split(text: str | None) -> list[str]:
    import re

    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def test_contamination(spark):
    items = [("b1", PASSAGE), ("b2", "word"), ("b3", None), ("b4", ""), ("b5", " ".join(PASSAGE.split()[5:30])),
             ("b6", "Two Words"), ("b6", "Two Words"), (None, prose(20, 30)), ("b7", " ".join(prose(4, 6000).split()[400:413]))]
    benchmark = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id string, text string, fp string")
    expected = Counter()
    wanted = [(i or "", w[k : k + min(13, len(w))]) for i, t in items if (w := split(t)) for k in range(len(w) - min(13, len(w)) + 1)]
    for doc_id, text in texts():
        words, hit, found = split(text), set(), set()
        places: dict[tuple, list[int]] = {}
        for n in {len(w) for _, w in wanted}:
            for i in range(len(words) - n + 1):
                places.setdefault(tuple(words[i : i + n]), []).append(i)
        for item, w in wanted:
            for i in places.get(tuple(w), []):
                hit.update(range(i, i + len(w)))
                found.add(item)
        expected[doc_id, len(words), len(hit), tuple(sorted(found)), bool(hit) and 20 * len(hit) >= len(words)] += 1
    found = decontamination.contamination(documents(spark), benchmark).collect()
    assert Counter((r.doc_id, r.n_words, r.n_hit, tuple(r["items"]), r.contaminated) for r in found) == expected
    none = decontamination.contamination(documents(spark), benchmark.where("false"))
    assert none.where("n_hit > 0 OR contaminated").count() == 0 and none.count() == len(texts())
    assert decontamination.contamination(documents(spark, []), benchmark).count() == 0


def test_decontamination_is_native(spark):
    plan = decontamination.contamination(
        documents(spark), spark.createDataFrame([(1, PASSAGE)], "item_id long, text string")
    )._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan


# Top k


def test_top_k(spark):
    rnd = random.Random(2)
    vectors = [(i, [rnd.uniform(-1, 1) if rnd.random() < 0.6 else 0.0 for _ in range(9)]) for i in range(300)]
    vectors += [(300, None), (301, [1.0, None]), (302, [float("nan")] * 9), (303, [float("inf")] * 9), (304, []),
                (305, [0.5]), (306, [0.25] * 12), (400, vectors[1][1]), (401, vectors[1][1]), (None, [1.0] * 9),
                (500, [3e18, -3e18]), (100, vectors[100][1]), (200, [0.5] * 9), (200, [0.5] * 9)]  # repeated queries
    df = spark.createDataFrame([(i, v, "x") for i, v in vectors], "vec_id long, embedding array<double>, block string")
    held = lambda x: max(-(2**63), min(2**63 - 1, x))
    usable = [
        (i, [held(int(np.floor(1024 * x))) for x in v]) for i, v in vectors
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)
    ]
    expected = Counter()
    for q, a in usable:
        if q % 100 == 0:
            scored = sorted(
                (-held(sum(x * y for x, y in zip(a, b, strict=False))), i)
                for i, b in usable if i != q
            )
            for rank, (score, i) in enumerate(scored[:10], 1):
                expected[q, rank, i, -score] += 1
    got = topk.top_k(df.repartition(4), df.where("vec_id % 100 = 0"), 10)
    assert rows(got, "query_id", "rank", "vec_id", "score") == expected
    assert topk.top_k(df.where("false"), df.where("false"), 10).count() == 0
    assert topk.top_k(df.where("vec_id = 5"), df.where("vec_id = 5"), 10).count() == 0


# Token counts


@pytest.fixture(scope="module")
def counter():
    return token_counts.Transducer("word_bpe_49k.json")


def test_token_counts(spark, counter):
    expected = Counter()
    for doc_id, text in texts():
        n = counter._exactly(text or "")
        expected[doc_id, len((text or "").encode()), n, n > 100] += 1
    found = token_counts.token_counts(documents(spark), limit=100)
    assert rows(found, "doc_id", "n_bytes", "n_tokens", "over_limit") == expected
    assert token_counts.token_counts(documents(spark, [])).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.text(st.one_of(st.sampled_from(list("abe 'strevlmd'!\n\t12é½")), st.characters(max_codepoint=0x4000)), max_size=80))
def test_transducer_counts_like_the_library(counter, text):
    text = text.encode("utf-8", "ignore").decode()
    assert counter.count([text]) == [counter._exactly(text)]


def test_only_rare_words_leave_the_transducer(counter, monkeypatch):
    """Words with characters from U+2E80 on go to the library one by one; their neighbours don't."""
    sent = []
    monkeypatch.setattr(counter, "_exactly", lambda text, own=counter._exactly: sent.append(text) or own(text))
    text = "plain words 漢字 and İstanbul, 😀 it's<|endoftext|>かな! " + PASSAGE
    exact = len(counter.exact.encode(text, add_special_tokens=False).ids)
    assert counter.count([text]) == [exact] and sent == ["漢字", "İstanbul,", "😀", "かな!"]
    # More than a thousand different characters, whatever a worker has read before.
    many = [" ".join(chr(c) * 2 for c in range(low, low + 300) if chr(c).isprintable()) for low in range(0xA1, 0x2000, 300)]
    assert counter.count(many) == [len(counter.exact.encode(t, add_special_tokens=False).ids) for t in many]
    assert len(counter.chars) > 1500
    long = "ab 漢" * 3 + "x y" * 60
    monkeypatch.setattr(token_counts, "PIECE", 64)
    monkeypatch.setattr(token_counts, "CHUNK", 16)
    assert counter.count([long]) == [len(counter.exact.encode(long, add_special_tokens=False).ids)]


def test_chunks_compose(counter, monkeypatch):
    monkeypatch.setattr(token_counts, "CHUNK", 16)
    monkeypatch.setattr(token_counts, "PIECE", 64)
    own = ["ab" * 300, LINE * 9, "it's " * 40, "'" * 100, "a" * 15 + " " + "b" * 33, "<|endoftext|>" * 20, json.dumps(texts()[:3])]
    assert counter.count(own) == [counter._exactly(t) for t in own]


def test_table_can_be_dropped(counter, monkeypatch):
    monkeypatch.setattr(token_counts, "TABLE_BYTES", 1)
    own = [prose(n, 50) for n in range(5)]
    for text in own:
        assert counter.count([text]) == [counter._exactly(text)]


def test_a_task_gives_its_memory_back(monkeypatch):
    """pipeline: what a task has used of Arrow's memory is not kept by the worker for later stages."""
    class Pool:
        released = 0

        def release_unused(self):
            self.released += 1

    pool = Pool()
    monkeypatch.setattr(common.pa, "default_memory_pool", lambda: pool)
    batches = [pa.RecordBatch.from_pydict({"text": ["ab", None, "cd"]}) for _ in range(4)]
    assert sum(part.num_rows for part in common.text_slices(iter(batches), "text", 3)) == 12
    assert pool.released == 5


def test_a_task_gives_back_what_its_last_batch_used(monkeypatch):
    """pipeline: memory goes back when a task ends, after the last rows it has made."""
    events = []
    monkeypatch.setattr(common, "give_back", lambda: events.append("given back"))

    def run(batches):
        events.extend(batches)
        yield "rows"
        events.append("end")

    task = common.map_batches(SimpleNamespace(mapInArrow=lambda work, schema: work), run, "text string")
    assert list(task(iter(["batch"]))) == ["rows"]
    assert events == ["batch", "end", "given back"]


def test_freed_memory_leaves_the_process():
    """pipeline: numpy's freed arrays go back to the system, not just to the C library."""
    script = """
import re
import numpy as np
from tamis.llm.common import give_back
held = lambda: int(re.search(r"VmRSS:\\s+(\\d+)", open("/proc/self/status").read())[1]) / 1024
arrays = [np.ones(12_000) for _ in range(1000)]  # below the C library's threshold for pages of their own
last = np.ones(12_000)
before = held()
del arrays
give_back()
print(before - held())
"""
    done = subprocess.run([sys.executable, "-c", script], capture_output=True, text=True, check=True)
    assert float(done.stdout) > 60


def test_memory_of_sets_does_not_follow_the_batch(spark, monkeypatch):
    """pipeline: sets are made for a slice of texts at a time, and only their prefixes are held."""
    rng = random.Random(3)
    texts = [" ".join(f"{rng.randrange(10**5)}" for _ in range(400)) for _ in range(2000)]
    batch = pa.RecordBatch.from_pydict(
        {"doc_id": pa.array(range(len(texts)), pa.int64()), "text": texts,
         "text_key": pa.array(range(len(texts)), pa.int64())}
    )
    monkeypatch.setattr(ngram_join, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    docs = SimpleNamespace(
        schema=spark.createDataFrame([], "doc_id long, text string").schema, mapInArrow=lambda work, schema: work
    )
    build = ngram_join._sets_and_postings(docs, 5, 80, 64)
    tracemalloc.start()
    try:
        rows = [b.num_rows for b in build(iter([batch]))]
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert sum(rows[:-1]) == len(texts) and rows[-1] == 65
    assert peak < 10 * sum(map(len, texts))
