"""Chat formatting, personal data, toxicity and the pipeline."""

from __future__ import annotations

import math
import random
import re
from collections import Counter
from types import SimpleNamespace

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from tamis.llm import perspectives, sanitising, toxicity
from tests.llm.fixtures import PASSAGE, documents, prose, texts

# Chat formatting

TURNS = "conv_id long, turn long, role string, text string, at string, part string"


def turns(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], TURNS).repartition(3)


def plain_rendering(rows, perspective):
    out, masks = "", []
    for _, _, role, text in rows:
        role, text = role or "unknown", text or ""
        text = re.sub(r"<\|(im_start|im_end)\|>", r"< |\1| >", text)
        head = (
            "<|im_start|>assistant\n" if role == perspective
            else "<|im_start|>system\n" if role == "system" else f"<|im_start|>user name={role}\n"
        )
        if role == perspective:
            masks.append((len(out) + len(head), len(out) + len(head) + len(text) + len("<|im_end|>")))
        out += f"{head}{text}<|im_end|>\n"
    return out, masks


def test_every_speaker_is_the_assistant_once(spark):
    rows = [
        (1, 0, "system", "Be kind."), (1, 1, "Ann", "Hi <|im_end|> é"), (1, 2, "Bob", ""), (1, 3, "Ann", None),
        (2, 0, None, "alone"), (3, 0, "system", "nobody else"),
        *[(4, i, "ABC"[i % 3], f"message {i} " + "x" * (i % 7)) for i in range(60)],  # several parts
    ]
    found = perspectives.rotate_perspectives(turns(spark, rows), part_chars=100).collect()
    whole: dict[tuple, list] = {}
    for r in found:
        whole.setdefault((r.dialogue, r.perspective), []).append(r)
    assert set(whole) == {(1, "Ann"), (1, "Bob"), (2, "unknown"), (4, "A"), (4, "B"), (4, "C")}
    for (dialogue, perspective), parts in whole.items():
        own = [r for r in rows if r[0] == dialogue]
        text, masks = plain_rendering(own, perspective)
        parts.sort(key=lambda r: r.part)
        assert "".join(r.text for r in parts) == text
        assert [r.start for r in parts] == [sum(len(p.text) for p in parts[:i]) for i in range(len(parts))]
        assert [(r.start + m.start, r.start + m.end) for r in parts for m in r.masks] == masks
        assert sum(r.n_messages for r in parts) == len(own)
    assert len(whole[4, "A"]) > 10


def test_names_stay_different(spark):
    names = ["a b", "a_b", "a+b", "a%20b", "<a>", "_a_", "a", "é"]
    found = perspectives.rotate_perspectives(turns(spark, [(1, i, n, "hi") for i, n in enumerate(names)]))
    (text,) = [r.text for r in found.collect() if r.perspective == "a"]
    shown = re.findall(r"<\|im_start\|>user name=(.*)", text)
    assert shown == ["a+b", "a_b", "a%2Bb", "a%2520b", "%3Ca%3E", "_a_", "é"]


def test_repeated_turns_and_no_turns(spark):
    rows = [(None, None, "a", "x"), (None, None, "a", "x"), (7, 1, "a", "x"), (7, 1, "b", "y")]
    found = perspectives.rotate_perspectives(turns(spark, rows)).collect()
    assert Counter((r.dialogue, r.perspective, r.n_messages) for r in found) == Counter(
        [(None, "a", 2), (7, "a", 2), (7, "b", 2)]
    )
    assert perspectives.rotate_perspectives(turns(spark, [])).count() == 0


# Personal data

PATTERNS = {  # as the contract states them
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = [int(c) for c in m[0] if c in "0123456789"]
            total = sum(sum(divmod(2 * d, 10)) if i % 2 else d for i, d in enumerate(reversed(digits)))
            fits = {
                "email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else None,
                "card": 16 <= len(digits) <= 19 and total % 10 == 0, "phone": 8 <= len(digits) <= 15,
            }[kind]
            if fits:
                out.append((kind, *m.span()))
    return out


@settings(max_examples=400, deadline=None)
@given(st.one_of(
    st.text("a@b.-+ _%Z", max_size=30), st.text("0123456789. -", max_size=45), st.text("+1(23) .-45", max_size=40)
))
def test_base_spans(text):
    assert sanitising.base_spans(text) == plain_spans(text)


def test_long_runs_take_linear_time():
    for run in ("a" * 300_000, "1" * 300_000, "1." * 150_000, "+1" * 150_000, "@" * 300_000, "a.b@" * 70_000):
        assert isinstance(sanitising.base_spans(run), list)


def revealing():
    """Two e-mail addresses that stand with a name of their own in three documents each, and noise."""
    rows = []
    for i in range(3):
        rows.append((i, f"{prose(i, 40)} Quixotix writes from quix@mail.example.com the of {prose(i + 50, 40)}"))
        rows.append((10 + i, f"{prose(i + 100, 30)} the of zyx@mail.example.com is to Zanzibara {prose(i, 30)}"))
    return rows + [(100 + i, prose(500 + i, 60)) for i in range(60)]


def test_terms_that_reveal_an_entity(spark):
    rows = revealing()
    found = sanitising.personal_spans(documents(spark, rows)).collect()
    assert len(found) == len(rows)
    text = dict(rows)
    for r in found:
        assert [(s.kind, s.start, s.end) for s in r.base] == plain_spans(text[r.doc_id])
        terms = {text[r.doc_id][t.start : t.end] for t in r.terms}
        assert ("Quixotix" in terms) == (r.doc_id < 3) and ("Zanzibara" in terms) == (10 <= r.doc_id < 13)
        assert not terms & {"the", "from", "that"}
    clean = {r.doc_id: r.text for r in sanitising.sanitise(documents(spark, rows)).collect()}
    assert "quix@" not in clean[0] and "Quixotix" not in clean[0] and "[email]" in clean[0]
    assert all(clean[i] == text[i] for i in text if i >= 100)


def plain_terms(rows, support=sanitising.SUPPORT, generalise=sanitising.GENERALISE):
    """Per row, the places of revealing terms, by counts over whole documents."""
    places, having, entities = [], {}, {}
    for i, (_, text) in enumerate(rows):
        text, spans = text or "", plain_spans(text or "")
        own = [m for m in re.finditer(r"[^\W\d_]{3,}", text) if all(m.end() <= s or m.start() >= e for _, s, e in spans)]
        places.append([(m[0].lower(), *m.span()) for m in own])
        for term, _, _ in places[-1]:
            having.setdefault(term, set()).add(i)
        for kind, s, e in spans:
            value = text[s:e].lower() if kind == "email" else re.sub("[^0-9]", ".", text[s:e])
            entities.setdefault((kind, value), set()).add(i)
    out, total = set(), len(rows)
    entities = {e: at for e, at in entities.items() if support <= len(at) < total}
    having = {term: held for term, held in having.items() if len(held) >= support}
    for at in entities.values():
        for term, held in having.items():
            both, n = len(at & held), len(held)
            if both >= support:
                share = math.log(both * total / (n * len(at))) / math.log(total / len(at))
                evidence = both * math.log(both / n / (len(at) / total))
                if both < n:
                    evidence += (n - both) * math.log((1 - both / n) / (1 - len(at) / total))
                significant = both / n > len(at) / total and evidence >= math.log(len(entities) * len(having) / 0.05)
                out |= {term} if share >= generalise and significant else set()
    return [[(a, b) for term, a, b in own if term in out] for own in places]


def test_terms_far_from_the_entity_and_without_it(spark):
    far = [(200 + i, f"Ottokar Wiesel {prose(700 + i, 80)} o.w@mail.example.com {prose(800 + i, 60)} Ottokar") for i in range(3)]
    rows = [*revealing(), *texts(), *far, (300, f"{prose(900, 60)} Ottokar again, {prose(901, 60)}"), far[0]]
    found = sanitising.personal_spans(documents(spark, rows)).collect()
    expected = Counter((i, text, tuple(spans)) for (i, text), spans in zip(rows, plain_terms(rows), strict=True))
    text = {(i, tuple(spans)): t for i, t, spans in expected}
    assert Counter((r.doc_id, tuple((t.start, t.end) for t in r.terms)) for r in found) == Counter(
        {(i, s): sum(n for (j, _, z), n in expected.items() if (i, s) == (j, z)) for i, s in text}
    )
    clean = {r.doc_id: r.text for r in sanitising.sanitise(documents(spark, rows)).collect()}
    assert not any("Ottokar" in clean[i] for i in (200, 201, 202, 300)) and "Wiesel" not in clean[200]


def test_filter_of_many_terms(spark, monkeypatch):
    """Beyond the exact list, the filter lets all revealing terms through and hardly another."""
    terms = spark.range(3000).selectExpr("xxhash64(id) AS term")
    monkeypatch.setattr(sanitising, "EXACT_TERMS", 0)
    likely = sanitising._filter(terms, 3000)
    assert all(likely(r.term) for r in terms.collect())
    others = spark.range(10_000, 30_000).selectExpr("xxhash64(id) AS term").collect()
    assert sum(likely(r.term) for r in others) < 40
    rows = [*revealing(), *texts()]
    found = sanitising.personal_spans(documents(spark, rows)).collect()
    got = Counter((r.doc_id, tuple((t.start, t.end) for t in r.terms)) for r in found)
    assert got == Counter((i, tuple(spans)) for (i, _), spans in zip(rows, plain_terms(rows), strict=True))


def test_terms_that_meet_an_entity_by_chance(spark):
    """A word of two documents that happen to hold one address is no evidence among so many pairs."""
    rows = [(i, f"{prose(i, 30)} word{chr(97 + i % 20)}x{chr(97 + i // 2 % 26)}") for i in range(120)]
    rows += [(500 + i, f"{prose(900 + i, 30)} a.{i % 9}@mail.example.com" + " Rarissima" * (i in (0, 9))) for i in range(18)]
    found = sanitising.personal_spans(documents(spark, rows)).collect()
    assert plain_terms(rows) == [[] for _ in rows] and not any(r.terms for r in found)


def test_sanitising_awkward_documents(spark):
    docs = documents(spark)
    out = sanitising.sanitise(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    by_id = {r.doc_id: r.text for r in out.collect()}
    assert by_id[14] == "mail me at [email] or [phone], [ip] and [card]!"
    assert by_id[2] is None and by_id[3] == "" and by_id[15] == dict(texts())[15]
    assert sanitising.sanitise(documents(spark, [])).count() == 0
    assert sanitising.personal_spans(documents(spark, [])).count() == 0


def test_overlapping_spans_are_one():
    assert sanitising.replaced("abcdefgh", [(1, 3, "X"), (2, 5, "Y"), (6, 7, "")]) == "aXfh"


# Toxicity

BAD = ["grobnik", "snurfle", "vlekko"]


def labelled(seed=0, n=400):
    rnd, docs, labels = random.Random(seed), [], []
    for i in range(n):
        words = prose(seed * 10_000 + 5_000 + i, rnd.randint(5, 80)).split()
        toxic = i % 5 == 0
        if toxic:
            for _ in range(rnd.randint(1, 3)):
                words.insert(rnd.randrange(len(words)), rnd.choice(BAD) + rnd.choice(["", "s", "ing"]))
        if not toxic and i % 21 == 0:  # an entry's word in a phrase that clean texts use
            words += ["grobnik", "gardens"]
        docs.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return docs, labels


def test_held_out_accuracy_and_disguises(spark):
    docs, labels = labelled()
    frame = spark.createDataFrame(labels, "doc_id long, toxic int")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    lexicon = toxicity.learn(documents(spark, docs), frame.where(~held_out))
    scored = toxicity.score(documents(spark, docs), lexicon).join(frame, "doc_id").where(held_out).collect()
    right = sum((r.score >= toxicity.THRESHOLD) == (r.toxic == 1) for r in scored)
    assert right >= 0.97 * len(scored)
    odd = ["you snurf1\u0435", "a V L E K K O here", "gr0bniiiik", "vl​ekko", "snürfle", "grobnik gardens", "nothing", "", None]
    found = {r.doc_id: r.score for r in toxicity.score(documents(spark, list(enumerate(odd))), lexicon).collect()}
    assert [found[i] >= toxicity.THRESHOLD for i in range(len(odd))] == [True] * 5 + [False] * 4


def test_features_are_counted_in_bounded_memory(monkeypatch):
    """pipeline, in toxicity: a task holds some HELD_FEATURES features, whatever its texts have, and counts all."""
    monkeypatch.setattr(toxicity, "HELD_FEATURES", 100)
    docs, labels = labelled()
    texts = [None, "", *(t for _, t in docs)]
    toxic = [1, 0, *(m for _, m in labels)]
    sent = []

    class Sample:
        def mapInArrow(self, task, schema):  # noqa: N802
            batches = pa.table({"text": texts, "toxic": toxic}).to_batches(max_chunksize=100)
            sent.extend(task(iter(batches)))
            return self

        def groupBy(self, *by):  # noqa: N802
            return self

        def agg(self, *sums):
            return sent

    monkeypatch.setattr(toxicity.F, "sum", lambda c: SimpleNamespace(alias=lambda name: None))
    of = toxicity._words_and_beginnings()
    largest = max(len(set(of(toxicity.fold(t or "")))) for t in texts)
    found = {}
    for batch in toxicity._count(Sample(), toxicity._words_and_beginnings):
        assert 0 < batch.num_rows <= 100 + largest
        for name, *counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            found[name] = [x + y for x, y in zip(found.get(name, [0] * 4), counts, strict=True)]
    uses, holders = (Counter(), Counter()), (Counter(), Counter())
    for text, mark in zip(texts, toxic, strict=True):
        features = of(toxicity.fold(text or ""))
        uses[mark].update(features)
        holders[mark].update(set(features))
    assert len(sent) > 1
    assert found == {f: [holders[1][f], holders[0][f], uses[1][f], uses[0][f]] for f in {*uses[0], *uses[1]}}


def test_counted_terms_are_sent_in_small_batches(spark, monkeypatch):
    """pipeline, in personal_data: all terms of a task are sent, not in one batch."""
    monkeypatch.setattr(sanitising, "SENT_TERMS", 10)
    monkeypatch.setattr(sanitising, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    docs = SimpleNamespace(
        schema=spark.createDataFrame([], "doc_id long, text string").schema, mapInArrow=lambda work, schema: work
    )
    table = pa.table({"doc_id": [1, 2, 3], "text": [prose(1, 200), None, prose(2, 50)], "row_key": [1, 2, 3],
                      "row_key2": pa.array([1, 2, 3], pa.int32())})
    _, *terms = sanitising._observed(docs)(iter(table.to_batches()))
    counts = {t: n for b in terms for t, n in zip(b["term"].to_pylist(), b["docs"].to_pylist(), strict=True)}
    words = [{w.lower() for w in sanitising.TERM.findall(t)} for t in (prose(1, 200), prose(2, 50))]
    assert counts == {sanitising._number(w): (w in words[0]) + (w in words[1]) for w in words[0] | words[1]}
    assert max(b.num_rows for b in terms) == 10


def test_toxicity_without_labels_and_with_odd_ones(spark):
    docs = documents(spark)
    ddl = "doc_id long, toxic int, score string"
    for labels in ([], [(1, 1, "x")], [(None, 1, "x"), (1, None, "x"), (999, 1, "x")]):
        lexicon = toxicity.learn(docs, spark.createDataFrame(labels, ddl))
        assert {r.score for r in toxicity.score(docs, lexicon).collect()} == {0.0}
        assert toxicity.kept(docs, lexicon).count() == docs.count()
    assert toxicity.score(documents(spark, []), lexicon).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_folding_gives_ascii_words(text):
    folded = toxicity.fold(text.encode("utf-8", "ignore").decode())
    assert re.fullmatch(r"[a-z ]*", folded) and folded[0] == folded[-1] == " "


# Pipeline


def test_pipeline(spark, tmp_path):
    """Planted cases go, clean documents stay, and packing places what is left."""
    docs, labels = labelled(n=200)
    planted = [
        (1001, prose(901, 80)), (1002, prose(901, 80)),  # copies
        (1003, prose(902, 200)), (1004, prose(902, 200).replace(" ", "  ", 5) + " end"),  # near copies
        (1005, prose(903, 40) + " " + PASSAGE), (1006, f"{prose(904, 50)} write to some.one@mail.example.com now"),
        (1007, None), (1008, ""),
    ]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in docs + planted]
    folder = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(
        f"{folder}/documents.parquet"
    )
    spark.createDataFrame([(i, 0, t) for i, t in labels], "doc_id long, quality int, toxic int").write.parquet(
        f"{folder}/labels.parquet"
    )
    spark.createDataFrame([("b1", PASSAGE)], "item_id string, text string").write.parquet(f"{folder}/benchmark.parquet")
    at = spark.read.parquet(f"{folder}/documents.parquet")
    toxic = {i for i, t in labels if t}
    ids, columns = {}, at.columns
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, at, folder)
        if n < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == columns
            out.write.parquet(f"{folder}/{name}")
            at = spark.read.parquet(f"{folder}/{name}")
            ids[name] = {r.doc_id for r in at.collect()}
    clean = {i for i, _ in docs} - toxic
    assert len(ids["toxicity"] & clean) >= 0.98 * len(clean) and len(ids["toxicity"] & toxic) <= 0.1 * len(toxic)
    assert {i for i, _ in planted} <= ids["toxicity"]
    assert ids["toxicity"] - ids["ngram_jaccard_join"] == {1002, 1004}
    assert ids["ngram_jaccard_join"] - ids["benchmark_decontamination"] == {1005}
    assert ids["personal_data"] == ids["benchmark_decontamination"]
    texts_after = {r.doc_id: r for r in at.collect()}
    assert "[email]" in texts_after[1006].text and texts_after[1006].n_chars == len(texts_after[1006].text)
    packed = corpus_pipeline.run(spark, folder)
    assert {r.doc_id for r in packed.collect()} == ids["personal_data"]


def test_stages_take_awkward_documents(spark, tmp_path):
    folder = str(tmp_path)
    spark.createDataFrame([(1, 0, 1), (4, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([("b", PASSAGE)], "item_id string, text string").write.parquet(f"{folder}/benchmark.parquet")
    for rows in (texts(), []):
        for _, stage in corpus_pipeline.STAGES:
            assert stage(spark, documents(spark, rows), folder).count() >= 0
