from __future__ import annotations

import random

from pyspark.sql import functions as F

from tamis.functions import text as tx
from tamis.functions.numbers import float_text

ALPHABET = list("abcXYZ019 _-.,!\t\n\r\x0b\x1c\x85  　éßÅñ漢字नमस्ते😀²½٣")


def random_texts(seed: int, count: int) -> list[str]:
    rng = random.Random(seed)
    return ["".join(rng.choices(ALPHABET, k=rng.randint(0, 40))) for _ in range(count)]


def evaluate(spark, values, ddl, column):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {ddl}")
    return [r.x for r in df.select("i", column.alias("x")).orderBy("i").collect()]


def test_token_count_matches_python_split(spark):
    texts = random_texts(1, 400) + ["", "   ", "one", "one two  three", "\x1ca\x1fb"]
    assert evaluate(spark, texts, "string", tx.token_count(F.col("v"))) == [
        len(t.split()) for t in texts
    ]


def test_word_set_is_lower_case_and_distinct(spark):
    import re

    texts = random_texts(2, 400) + ["The the THE cat_1", "naïve Naïve"]
    got = evaluate(spark, texts, "string", tx.word_set(F.col("v")))
    assert [set(g) for g in got] == [set(re.findall(r"\w+", t.lower())) for t in texts]
    assert all(len(g) == len(set(g)) for g in got)


def test_non_alnum_ratio(spark):
    texts = random_texts(3, 300) + ["", "!@#", "abc", "a!", "_"]
    got = evaluate(spark, texts, "string", tx.non_alnum_ratio(F.col("v")))
    want = [sum(not c.isalnum() for c in t) / len(t) if t else 0.0 for t in texts]
    assert got == want


def test_blank(spark):
    texts = ["", "  \t\n", " 　", "x", " x ", None, "​"]
    got = evaluate(spark, texts, "string", tx.is_blank(F.col("v")))
    assert got == [t is None or not t.strip() for t in texts]


def test_three_decimals_rounds_half_to_even(spark):
    rng = random.Random(4)
    values = [0.0625, 0.0005, 0.5, 0.0, 1.0, 0.1235, 0.9995] + [rng.random() for _ in range(300)]
    values += [k / 2000 for k in range(2001)] + [k / 64 for k in range(65)]
    values += [k / 2000 * (1 + 2**-52) for k in range(2001)] + [3.0625, 12.3455]
    got = evaluate(spark, values, "double", tx.three_decimals(F.col("v")))
    assert got == [f"{v:.3f}" for v in values]


def test_float_text_is_the_shortest_round_trip(spark):
    rng = random.Random(5)
    values = [0.0, -0.0, 1.5, 1e-4, 9.9e-5, 1e15, 1e16, 2.0**-44, 1e22, 123456789.125]
    values += [float("nan"), float("inf"), -float("inf"), 999999999.999999, 0.1 + 0.2]
    values += [rng.uniform(-1, 1) * 10 ** rng.randint(-12, 20) for _ in range(400)]
    values += [round(rng.uniform(-1e6, 1e6), 2) for _ in range(200)]
    assert evaluate(spark, values, "double", float_text(F.col("v"))) == [repr(v) for v in values]


def test_jaccard(spark):
    df = spark.createDataFrame(
        [(["a", "b"], ["b", "c"]), ([], []), (["a"], ["a"]), ([], ["a"])],
        "l array<string>, r array<string>",
    )
    got = [r.x for r in df.select(tx.jaccard(F.col("l"), F.col("r")).alias("x")).collect()]
    assert got == [1 / 3, 0.0, 1.0, 0.0]
