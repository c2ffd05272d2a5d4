"""Hard negatives, cross-tokenizer alignment and the quality classifier."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tamis.llm import alignment, negatives, quality, queries, stripes
from tests.llm.fixtures import documents, prose, texts
from tests.llm.test_exact import rows

# Hard negatives

VECTORS = "vec_id long, embedding array<double>, label int, row string, v string, q string, stripe string"


def plain_negatives(table, anchors, k=10, positives=5, least=30, most=90, scale=256):
    held = lambda x: max(-(2**63), min(2**63 - 1, x))

    def usable(rows):
        return [
            (i, label, [held(int(np.floor(scale * x))) for x in v]) for i, v, label in rows
            if i is not None and label is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)
        ]

    out = Counter()
    for anchor, own, a in usable(anchors):
        scored = sorted(
            (-held(sum(x * y for x, y in zip(a, b, strict=False))), i, label)
            for i, label, b in usable(table) if i != anchor
        )
        for p, positive, _ in [s for s in scored if s[2] == own][:positives]:
            inside = [(s, i) for s, i, label in scored if label != own and -least * p <= -100 * s <= -most * p]
            for rank, (s, i) in enumerate(inside[:k], 1):
                out[anchor, positive, rank, i, -p, -s] += 1
    return out


NEGATIVES = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def vectors_table(spark, table):
    return spark.createDataFrame([(*r, "x", "x", "x", "x") for r in table], VECTORS).repartition(3)


def test_hard_negatives(spark, monkeypatch):
    monkeypatch.setattr(stripes, "HELD_SCORES", 700)  # several parts of a batch
    rnd = random.Random(3)
    table = [(i, [rnd.uniform(0, 1) for _ in range(6)], i % 3) for i in range(400)]
    table += [(i, [0.5] * 6, 0) for i in range(400, 430)]  # ties
    table += [(7, table[7][1], 1), (200, table[200][1], 2), (200, table[200][1], 2), (300, [0.1, 0.9], 1)]  # repeated
    table += [(500, None, 1), (600, [1.0, None], 1), (700, [float("nan")], 1), (800, [float("-inf")] * 6, 2),
              (900, [0.3] * 6, None), (None, [0.3] * 6, 1), (1000, [], 2), (1100, [0.4] * 9, 1), (1200, [-0.4] * 6, 1),
              (1300, [0.2], 77)]  # alone with its label
    df = vectors_table(spark, table)
    anchors = [r for r in table if r[0] is not None and r[0] % 100 == 0]
    got = rows(negatives.hard_negatives(df, df.where("vec_id % 100 = 0")), *NEGATIVES)
    assert len(got) > 200 and got == plain_negatives(table, anchors)
    got = rows(negatives.hard_negatives(df, df.where("vec_id % 100 = 0"), k=2, positives=9, least=80, most=130), *NEGATIVES)
    assert got == plain_negatives(table, anchors, 2, 9, 80, 130)


def test_hard_negatives_of_large_numbers(spark):
    table = [(0, [3e18, 1.0], 1), (1, [2e18, 5.0], 1), (2, [1.0, 0.0], 2), (3, [1e-9, 1e18], 2), (4, [-1e18, 1.0], 1)]
    df = vectors_table(spark, table)
    got = rows(negatives.hard_negatives(df, df, scale=1), *NEGATIVES)
    assert got == plain_negatives(table, table, scale=1)


def test_hard_negatives_of_nothing(spark):
    df = vectors_table(spark, [(0, [1.0], 1), (1, [1.0], 1), (2, [0.5], 2)])
    none = df.where("false")
    assert negatives.hard_negatives(none, none).count() == negatives.hard_negatives(df, none).count() == 0
    assert negatives.hard_negatives(none, df).count() == 0


@settings(deadline=None, max_examples=60)
@given(st.lists(st.tuples(st.integers(-5, 5), st.integers(0, 9)), max_size=40), st.integers(1, 6))
def test_best_of_scores(pairs, k):
    scores, ids = np.array([s for s, _ in pairs], np.int64), np.array([i for _, i in pairs], np.int64)
    found = [(-int(scores[p]), int(ids[p])) for p in stripes.best(scores, ids, k)]
    assert found == sorted((-s, i) for s, i in pairs)[:k]


# Quality


def junk(seed: int) -> str:
    rnd = random.Random(seed)
    words = prose(seed, rnd.randint(20, 120)).split()
    return [
        " ".join(w + "###" for w in words), " ".join(f"{w} {w} {w} {w}" for w in words), " | ".join(words),
        " ".join(w.upper() + "!!" for w in words),
    ][seed % 4]


def judged(n=300):
    rows, labels = [], []
    for i in range(n):
        bad = i % 5 == 3
        rows.append((i, junk(i) if bad else prose(i, 20 + i % 100).capitalize() + "."))
        labels.append((i, 0 if bad else 1))
    return rows, labels


def labels_table(spark, labels):
    return spark.createDataFrame(
        [(i, q, 0, "x") for i, q in labels], "doc_id long, quality int, toxic int, statistics string"
    ).repartition(2)


def plain_log_ratios(table, labels):
    """The densities from whole matrices, by determinants and inverses."""
    x = np.array([quality.statistics(t or "", quality._kinds()) for _, t in table])
    marks: dict = {}
    for i, q in labels:
        if i is not None and q in (0, 1):
            marks[i] = max(q, marks.get(i, 0))
    own = [x[[j for j, (i, _) in enumerate(table) if marks.get(i) == c]] for c in (0, 1)]
    scatter = [(o - o.mean(0)).T @ (o - o.mean(0)) for o in own]
    shared = sum(scatter) / sum(map(len, own))
    spread = np.sqrt(np.maximum(np.diag(shared), 1e-12))
    logs = []
    for o, s in zip(own, scatter, strict=True):
        c = (s + quality.PRIOR_ROWS * shared) / (len(o) + quality.PRIOR_ROWS)
        c = (0.9 * c + 0.1 * shared) / np.outer(spread, spread)
        c = (0.98 * c + 0.02 * np.trace(c) / len(c) * np.eye(len(c))) * np.outer(spread, spread)
        d = x - o.mean(0)
        logs.append(-0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(c), d) - 0.5 * np.linalg.slogdet(c)[1])
    ratio = logs[1] - logs[0]
    return np.sign(ratio) * np.log1p(np.abs(ratio))


def test_log_ratios_and_held_out_quality(spark):
    table, labels = judged()
    table += [r for r in texts() if r[0] is None or r[0] > 1000] + [(None, None), (5000, None), (5001, ""), (5001, ""), (5002, prose(1, 9000))]
    marked = [*labels[:200], (0, 0), (1, None), (None, 1), (7777, 0), (2, 5)]
    described = quality.document_statistics(documents(spark, table))
    classifier = quality.learn(described, labels_table(spark, marked))
    got = quality.score(described, classifier).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in table)
    expected = {}
    for (i, t), value in zip(table, plain_log_ratios(table, marked), strict=True):
        expected[i, tuple(quality.statistics(t or "", quality._kinds()))] = value
    by_id = {(i): v for (i, _), v in expected.items() if i is not None}
    for r in got:
        if r.doc_id is not None:
            assert abs(r.log_ratio - by_id[r.doc_id]) < 1e-4
            assert abs(r.score - 1 / (1 + np.exp(-(classifier.curve[0] + classifier.curve[1] * r.log_ratio)))) < 1e-9
    held_out = {r.doc_id: r.score >= quality.THRESHOLD for r in got if r.doc_id is not None and 200 <= r.doc_id < 300}
    right = sum(held_out[i] == (q == 1) for i, q in labels[200:])
    assert right >= 97


def test_quality_of_awkward_documents(spark):
    described = quality.document_statistics(documents(spark))
    for labels in ([], [(1, 1), (4, 1)], [(1, 1), (8, 0)], [(1, 1), (4, 0), (11, 1), (12, 0), (21, 0)]):
        classifier = quality.learn(described, labels_table(spark, labels))
        got = quality.score(described, classifier).collect()
        assert len(got) == len(texts()) and all(0 <= r.score <= 1 for r in got)
        if not labels:
            assert {r.score for r in got} == {0.5}
    empty = quality.document_statistics(documents(spark, []))
    assert quality.score(empty, quality.learn(empty, labels_table(spark, [(1, 1)]))).count() == 0


def test_quality_query(spark, tmp_path):
    """held_out and predicted follow from ids and scores; held-out labels are no input."""
    table, labels = judged(200)
    scores = []
    for n, changed in enumerate((False, True)):
        folder = f"{tmp_path}/{n}"
        documents(spark, table).write.parquet(f"{folder}/documents.parquet")
        out = [zlib.crc32(str(i).encode()) % 5 == 0 for i, _ in labels]
        own = [(i, 1 - q if changed and o else q) for (i, q), o in zip(labels, out, strict=True)]
        labels_table(spark, own).write.parquet(f"{folder}/labels.parquet")
        got = {r.doc_id: r for r in queries.op13_discriminant_quality(spark, folder).collect()}
        assert len(got) == len(table)
        for (i, _), o in zip(labels, out, strict=True):
            assert got[i].held_out == o and got[i].predicted == int(got[i].score >= 0.3)
        scores.append({i: round(r.score, 6) for i, r in got.items()})
    assert scores[0] == scores[1]


# Alignment


def plain_tokens(text):
    """Tokens of both libraries, as (id, bytes)."""
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    exact.encode_special_tokens = True
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    # The byte-level alphabet: bytes without a printable Latin-1 sign are moved behind 255.
    letters, moved = {}, 0
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174:
            letters[chr(b)] = b
        else:
            letters[chr(256 + moved)] = b
            moved += 1
    a = [(i, bytes(letters[c] for c in exact.id_to_token(i))) for i in exact.encode(" " + text, add_special_tokens=False).ids]
    b = []
    for i in model.encode(text):
        piece = model.id_to_piece(i)
        b.append((i, bytes.fromhex(piece[3:5]) if model.is_byte(i) else piece.replace("\u2581", " ").encode()))
    return a, b


def plain_alignment(table):
    aligned = []
    for _, text in table:
        a, b = plain_tokens(text) if text else ([], [])
        whole = (" " + (text or "")).encode()
        if b"".join(x for _, x in a) != whole or b"".join(x for _, x in b) != whole:
            a = b = []
        places = []
        for tokens in (a, b):
            at, own = 0, []
            for i, raw in tokens:
                own.append((at, at + len(raw), i))
                at += len(raw)
            places.append(own)
        both = sorted({e for _, e, _ in places[0]} & {e for _, e, _ in places[1]})
        groups, start = [], 0
        for end in both:
            groups.append("|".join(
                ",".join(str(i) for s, e, i in own if s >= start and e <= end) for own in places
            ))
            start = end
        links, first = [], 0
        for s, e, i in places[0]:
            while first < len(places[1]) and places[1][first][1] <= s:
                first += 1
            for t, u, j in places[1][first:]:
                if t >= e:
                    break
                links.append((i, j))
        aligned.append((places, groups, links))
    totals = Counter(x for _, _, links in aligned for x in links)
    most = {}
    for (_, j), n in totals.items():
        most[j] = max(n, most.get(j, 0))
    return Counter(
        (doc_id, len(p[0]), len(p[1]), len(groups), len(links), sum(totals[x] == most[x[1]] for x in links),
         sum(totals[x] for x in links), hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else "")
        for (doc_id, _), (p, groups, links) in zip(table, aligned, strict=True)
    )


ALIGNED = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
ODD = [
    (700, "a <|endoftext|> b </s> <s> <unk> <0x41>"), (701, "low \u2581 line"), (702, " leading  and   double "),
    (703, "emoji 👩‍👩‍👧 and 漢字かな \u0000 zero \u00a0 \u3000 spaces\r\n\ttab"), (704, "e\u0301 ﬁ ½ Ａ"), (705, "x" * 4000),
    (706, "\n"), (707, " "), (708, "١٢٣ and 𝟘𝟙 don't I'LL"), (709, "\u200b\ufeff soft\u00adhyphen"),
]


def test_alignment(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(alignment, "SLICE_BYTES", 3000)
    monkeypatch.setattr(alignment, "BLOCK_BYTES", 10_000)  # several slices a block, several blocks a task
    table = [*texts(), *ODD]
    documents(spark, table).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op11_interval_alignment(spark, str(tmp_path))
    expected = plain_alignment(table)
    assert sum(1 for r in expected if r[1]) > 30 and any(r[0] == 701 and not r[1] for r in expected)
    assert rows(got, *ALIGNED) == expected
    assert alignment.alignments(documents(spark, [])).count() == 0
    assert rows(alignment.alignments(documents(spark, [(1, None), (2, "")])), *ALIGNED) == plain_alignment([(1, None), (2, "")])


@settings(deadline=None, max_examples=60)
@given(st.lists(st.text(max_size=40), max_size=5))
def test_alignment_of_any_text(parts):
    parts = [p.encode("utf-8", "ignore").decode() for p in parts]
    tokens = alignment.tokenizers(alignment.BYTE_TOKENIZER, alignment.BYTE_RANKS, alignment.PIECE_TOKENIZER)
    x = alignment.Aligned(parts, *tokens)
    for n, text in enumerate(parts):
        (row,) = plain_alignment([(0, text)])
        assert (x.n_a[n], x.n_b[n], x.n_groups[n], x.n_links[n]) == row[1:5]


@settings(deadline=None)
@given(st.lists(st.integers(1, 5), max_size=30), st.lists(st.integers(1, 5), max_size=30))
def test_overlaps_and_groups_of_intervals(a, b):
    ends = [np.cumsum(np.array(x, np.int64)) for x in (a, b)]
    starts = [e - np.array(x, np.int64) for e, x in zip(ends, (a, b), strict=True)]
    args = (starts[0], ends[0], starts[1], ends[1])
    found = list(zip(*(x.tolist() for x in alignment.overlaps(*args)), strict=True))
    assert found == [
        (i, j) for i in range(len(a)) for j in range(len(b)) if starts[0][i] < ends[1][j] and starts[1][j] < ends[0][i]
    ]
    groups = alignment.coalesce(*args)
    cuts = sorted({0, *ends[0].tolist()} & {0, *ends[1].tolist()})
    for own, start in zip(groups, starts, strict=True):
        within = [sum(c <= s for c in cuts) - 1 for s in start.tolist() if s < max(cuts[-1], 0)]
        assert own[: len(within)].tolist() == within
