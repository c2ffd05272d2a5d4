from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from tamis.dataset import records_from_table
from tamis.functions.pii import luhn_valid, pii_spans, redact
from tamis.operators.personal_data import detect_pii, redact_records


def luhn(number: str) -> bool:
    digits = [int(c) for c in number][::-1]
    odd = sum(digits[0::2])
    even = sum(sum(divmod(2 * d, 10)) for d in digits[1::2])
    return bool(digits) and (odd + even) % 10 == 0


# The meaning of each category, stated with Python's Unicode-aware classes.
PLAIN = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"),
    ("government_id", r"\b\d{3}-\d{2}-\d{4}\b"),
    ("phone", r"\b\d{3}-\d{3}-\d{4}\b"),
    ("physical_address", r"\b\d{1,6}\s+[A-Z][a-zA-Z]*\s+(?:Street|Avenue|Road|Boulevard|Lane|Drive)\b"),
    ("credit_card", r"\b\d{13,19}\b"),
]


def expected(text: str):
    found = [
        (m.start(), m.start() - m.end(), rank, m.end(), name)
        for rank, (name, pattern) in enumerate(PLAIN)
        for m in re.finditer(pattern, text)
        if name != "credit_card" or luhn(m.group())
    ]
    kept, free = [], 0
    for start, _, _, end, name in sorted(found):
        if start >= free:
            kept.append((start, end, name))
            free = end
    return kept


def spans_of(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    rows = df.select("i", pii_spans(F.col("t")).alias("s")).orderBy("i").collect()
    return [[tuple(s) for s in r.s] for r in rows]


PIECES = [
    "a.b+c@mail.example.org", "x@y.co", "a@b.com%x@y.org", "555-123-4567", "123-45-6789",
    "1234-56-7890", "12 Main Street", "7 Oak Lane", "99 elm Road", "12 Main Streets",
    "4007000000027", "4007000000028", "4111111111111111", "٤٠٠٧٠٠٠٠٠٠٠٢٧", "😀", "é", "ß1", "_",
    " ", " ", ", ", "@", "-", "1", "word", "4111111111111111@card.io", "0000000000000",
]


def test_spans_match_a_plain_statement_on_random_text(spark):
    rng = random.Random(7)
    texts = ["".join(rng.choices(PIECES, k=rng.randint(1, 14))) for _ in range(1500)]
    assert spans_of(spark, texts) == [expected(t) for t in texts]


def test_spans_of_one_long_text(spark):
    text = " ".join(["mail a@b.org or 555-123-4567"] * 2000) + "x" * 50_000
    assert spans_of(spark, [text]) == [expected(text)]


def test_null_and_plain_text(spark):
    assert spans_of(spark, ["nothing here", ""]) == [[], []]


@pytest.mark.parametrize(
    "number", ["4007000000027", "4007000000028", "0" * 13, "", "79927398713", "٤٠٠٧٠٠٠٠٠٠٠٢٧"]
)
def test_luhn(spark, number):
    df = spark.createDataFrame([(number,)], "n string")
    assert df.select(luhn_valid(F.col("n"))).first()[0] is luhn(number)


def test_redaction(spark):
    texts = ["Mail a@b.org, call 555-123-4567.", "clean", "", "4007000000027 at 12 Main Street"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = [r.x for r in df.select("i", redact(F.col("t")).alias("x")).orderBy("i").collect()]
    assert got == ["Mail [EMAIL], call [PHONE].", "clean", "", "[CREDIT_CARD] at [PHYSICAL_ADDRESS]"]


def test_issues_follow_field_then_offset_order(dataset, issues):
    ds = dataset([{"b": "x@y.co 123-45-6789", "n": 5551234567, "a": "z@w.org", "l": ["q@q.org"]}])
    got = issues(detect_pii(ds))
    assert [(g["field_name"], g["pii_category"], tuple(g["span"].values())) for g in got] == [
        ("b", "email", (0, 6)),
        ("b", "government_id", (7, 18)),
        ("a", "email", (0, 7)),
    ]
    assert got[0]["detail"] == "email detected in field 'b'"
    assert got[0]["loc"]["line_number"] == 1


def test_redacted_records_keep_everything_else(spark, dataset):
    ds = redact_records(dataset([{"t": "a@b.org", "n": 1, "l": ["a@b.org"]}]))
    assert ds.df.select(ds.content.fields_json()).first()[0] == (
        '{"t": "[EMAIL]", "n": 1, "l": ["a@b.org"]}'
    )
    typed = records_from_table(
        spark.createDataFrame([(1, "a@b.org", 5)], "i long, t string, n int"), ["t", "n"], "i"
    )
    assert redact_records(typed).df.select("t", "n").first() == ("[EMAIL]", 5)
