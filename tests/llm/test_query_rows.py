"""Rows of the registered queries that have no SQL, and of the pipeline, against plain versions.

The tables are written as Parquet files, with awkward texts and columns of the names that operators use.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from tamis.llm import queries, toxicity
from tests.llm.fixtures import LINE, PASSAGE, documents, prose, texts
from tests.llm.test_exact import brute_components, brute_repeats, families, rows
from tests.llm.test_texts import labelled, plain_spans, plain_terms, revealing

# Rows of one id and different texts have no order of their own, which only one operator needs.
TABLE = [r for r in texts() if r[0] != 20] + [(i + 100_000, t) for i, t in revealing()] + families()[:30]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    target = str(tmp_path_factory.mktemp("tables"))
    documents(spark, TABLE).write.parquet(f"{target}/documents.parquet")
    return target


def pieces(table, capacity=2048):
    exact = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    out = Counter()
    for doc_id, text in table:
        ids = np.array([*exact.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        head = len(ids) % capacity or capacity
        cuts = [0, *range(head, len(ids) + 1, capacity)]
        for n, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            out[doc_id, n, a, b - a, zlib.crc32(ids[a:b].tobytes())] += 1
    return out


def test_op2(spark, folder):
    got = queries.op2_residual_packing(spark, folder).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == pieces(TABLE)
    places = sorted((r.sequence_id, r.offset, r.length) for r in got)
    for (s, offset, length), after in zip(places, [*places[1:], (None, 0, 0)], strict=True):
        assert offset + length <= 2048 and (after[1] == offset + length if after[0] == s else after[1] == 0)
    total = sum(r.length for r in got)
    assert len({s for s, _, _ in places}) <= -(-total // 2048) + 1


def test_op3(spark, folder):
    got = queries.op3_heavy_light_ngram_join(spark, folder)
    assert rows(got, "doc_id", "n_shingles", "component_id") == brute_components(TABLE)


def test_op5(spark, folder):
    got: dict = {}
    for r in queries.op5_suffix_merge_dedup(spark, folder).collect():
        got.setdefault(r.doc_id, Counter())[r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256] += 1
    assert got == brute_repeats(TABLE)


def test_op7(spark, folder):
    expected = Counter()
    for (doc_id, text), terms in zip(TABLE, plain_terms(TABLE), strict=True):
        base = plain_spans(text or "")
        counts = tuple(sum(kind == k for k, _, _ in base) for kind in ("email", "ip", "card", "phone"))
        joined = lambda spans: ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        every = [*base, *(("term", a, b) for a, b in terms)]
        expected[doc_id, *counts, hashlib.sha256(joined(base).encode()).hexdigest(), joined(every)] += 1
    got = queries.op7_cooccurrence_sanitising(spark, folder)
    assert rows(got, "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans") == expected
    assert any("term:" in r[-1] for r in expected)


def plain_score(lexicon: toxicity.Lexicon, text: str | None) -> float:
    """Patterns looked up one by one, and the curve by its formula."""
    folded = toxicity.fold(text or "")
    weight = sum(w * len(re.findall(f"(?={re.escape(p)})", folded)) for p, w in lexicon.weights.items())
    weight -= sum(w * len(re.findall(f"(?={re.escape(p)})", folded)) for p, w in lexicon.exceptions.items())
    words, weight = max(len(folded.split()), 30), max(weight, 0.0)
    x = [1.0, math.log1p(weight), math.log1p(100 * weight / words), weight / math.sqrt(words)]
    return 1 / (1 + math.exp(-sum(a * b for a, b in zip(lexicon.curve, x, strict=True))))


def test_op8(spark, tmp_path):
    table, labels = labelled()
    folder = str(tmp_path)
    table = [*table, *((i + 5000 if i is not None else None, t) for i, t in texts())]
    documents(spark, table).write.parquet(f"{folder}/documents.parquet")
    marks = spark.createDataFrame([(i, 1, t) for i, t in labels], "doc_id long, quality int, toxic int")
    marks.write.parquet(f"{folder}/labels.parquet")
    held_out = lambda i: None if i is None else zlib.crc32(str(i).encode()) % 3 == 1
    learned = {i for i, _ in labels if not held_out(i)}
    lexicon = toxicity.learn(documents(spark, table), marks.where(marks.doc_id.isin(learned)))
    got = queries.op8_folded_lexicon_toxicity(spark, folder).collect()
    expected = Counter((i, held_out(i), round(plain_score(lexicon, t), 6)) for i, t in table)
    assert Counter((r.doc_id, r.held_out, round(r.score, 6)) for r in got) == expected
    assert all(r.predicted == int(r.score >= 0.7) for r in got)
    right = [r.predicted == dict(labels)[r.doc_id] for r in got if r.doc_id in dict(labels) and r.held_out]
    assert sum(right) >= 0.95 * len(right)


def test_op10(spark, folder):
    exact = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    expected = Counter()
    for doc_id, text in TABLE:
        n = len(exact.encode(text or "", add_special_tokens=False).ids)
        expected[doc_id, len((text or "").encode()), n, n > 2048] += 1
    got = queries.op10_transducer_token_counts(spark, folder)
    assert rows(got, "doc_id", "n_bytes", "n_tokens", "over_limit") == expected


def plain_contaminated(text: str | None, items: list[str]) -> bool:
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    words, hit = split(text), set()
    for item in map(split, items):
        size = min(13, len(item))
        windows = {tuple(item[i : i + size]) for i in range(len(item) - size + 1)} if size else set()
        for i in range(len(words) - size + 1):
            if tuple(words[i : i + size]) in windows:
                hit.update(range(i, i + size))
    return bool(hit) and 20 * len(hit) >= len(words)


def test_pipeline_rows(spark, tmp_path):
    folder = str(tmp_path)
    table, labels = labelled(n=150)
    extra = [
        (2001, prose(901, 80)), (2002, prose(901, 80)), (2003, prose(902, 200)), (2004, prose(902, 200) + " end"),
        (2005, prose(903, 40) + " " + PASSAGE), (2006, "write to some.one@mail.example.com or 10.0.0.1 now " + LINE),
        (2007, None), (2008, ""), (2009, prose(905, 3000)), (2010, "12345 678"), (2011, PASSAGE),
    ]
    table = [*table, *extra]
    documents(spark, table).write.parquet(f"{folder}/documents.parquet")
    marks = spark.createDataFrame([(i, 1, t) for i, t in labels], "doc_id long, quality int, toxic int")
    marks.write.parquet(f"{folder}/labels.parquet")
    items = [(1, PASSAGE), (2, "a short item"), (3, "")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")

    lexicon = toxicity.learn(documents(spark, table), marks)
    left = [(i, t) for i, t in table if plain_score(lexicon, t) < toxicity.THRESHOLD]
    components = {i: c for i, _, c in brute_components(left)}
    left = [(i, t) for i, t in left if components[i] == i]
    left = [(i, t) for i, t in left if not plain_contaminated(t, [t for _, t in items])]
    assert not any(plain_terms(left))  # so only patterns are replaced
    clean = []
    for i, text in left:
        for kind, a, b in sorted(plain_spans(text or ""), key=lambda s: -s[1]):
            text = f"{text[:a]}[{kind}]{text[b:]}"
        clean.append((i, text))
    assert {2002, 2004, 2005, 2011} & {i for i, _ in clean} == set() and dict(clean)[2006].startswith("write to [email] or [ip]")
    got = corpus_pipeline.run(spark, folder)
    assert rows(got, "doc_id", "piece", "start", "length", "ids_crc32") == pieces(clean)
