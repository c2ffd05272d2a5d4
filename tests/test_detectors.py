from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tamis.config import AnalysisConfig, FieldSpec, QualityConfig, Schema, effective_file_limit
from tamis.dataset import Dataset, TaggedContent, records_from_table
from tamis.errors import InvalidSchema, UnknownCategory
from tamis.issues import literal_issues
from tamis.operators.conformance import infer_schema, validate_schema
from tamis.operators.metrics import category_counts, compute_metrics, flagged_records
from tamis.operators.quality import detect_quality
from tamis.operators.toxicity import StubModel, detect_toxicity, toxicity_score
from tamis.plans.analysis import analyze


def categories(issues, df):
    return [i["category"] for i in issues(df)]


# Quality


def test_quality_checks_are_independent(dataset, issues):
    ds = dataset([{"t": "one two"}, {"t": "one two three"}, {"t": "!@#$%^&*()"}, {"t": "  "}])
    got = issues(detect_quality(ds))
    assert [(g["loc"]["line_number"], g["category"]) for g in got] == [
        (1, "low_quality_short"),
        (3, "low_quality_short"),
        (3, "low_quality_gibberish"),
        (4, "low_quality_short"),
        (4, "low_quality_gibberish"),
        (4, "empty_record"),
    ]
    assert got[0]["detail"] == (
        "Record has 2 whitespace-delimited token(s), fewer than the minimum threshold of 3"
    )
    assert got[0]["score"] == 2.0
    assert got[2]["detail"] == (
        "Non-alphanumeric proportion 1.000 meets or exceeds the gibberish threshold of 0.5"
    )


@pytest.mark.parametrize(
    ("record", "empty"),
    [
        ({"a": "", "b": "   ", "c": "\t\n"}, True),
        ({"a": None, "b": "   "}, True),
        ({"a": "", "b": 0}, False),
        ({"a": False}, False),
        ({"a": [], "b": {}}, True),
        ({"a": [None]}, False),
        ({}, True),
    ],
)
def test_empty_records(dataset, issues, record, empty):
    assert ("empty_record" in categories(issues, detect_quality(dataset([record])))) is empty


def test_required_fields_decide_emptiness(dataset, issues):
    ds = dataset([{"a": "text", "b": ""}])
    for required, empty in ((("b",), True), (("b", "x"), True), (("a", "b"), False), ((), True)):
        config = QualityConfig(required_fields=required)
        assert ("empty_record" in categories(issues, detect_quality(ds, config))) is empty


def test_gibberish_counts_spaces_and_underscores(dataset, issues):
    half = dataset([{"t": "ab _"}])
    assert "low_quality_gibberish" in categories(issues, detect_quality(half))
    text_free = dataset([{"t": True}])
    assert "low_quality_gibberish" not in categories(issues, detect_quality(text_free))


def test_quality_config_keeps_prior_values():
    prior, errors = QualityConfig().updated(min_tokens=5, gibberish_threshold=0.25)
    assert (prior.min_tokens, prior.gibberish_threshold, errors) == (5, 0.25, [])
    for bad in (0, 1_000_001, 2.0, True, "3", None):
        kept, errors = prior.updated(min_tokens=bad)
        assert kept.min_tokens == 5
        assert [(e.parameter, e.value, e.kept) for e in errors] == [("min_token_threshold", bad, 5)]
    for bad in (-0.1, 1.1, float("nan"), False, "x"):
        kept, errors = prior.updated(gibberish_threshold=bad)
        assert kept.gibberish_threshold == 0.25
        assert errors[0].parameter == "gibberish_threshold"


# Toxicity


class Words:
    """A model that fails on some texts."""

    def score(self, text):
        if "raise" in text:
            raise RuntimeError
        return {"none": None, "nan": float("nan"), "bool": True, "text": "0.9", "big": 7,
                "low": -3.0, "mid": 0.8}.get(text, 0.1)


def test_unusable_scores_are_failures(dataset, issues):
    texts = ["none", "nan", "bool", "text", "big", "low", "mid", "raise", "other"]
    ds = dataset([{"t": t, "n": 5} for t in texts])
    got = issues(detect_toxicity(ds, Words()))
    by_text = {texts[g["loc"]["line_number"] - 1]: g for g in got}
    assert {t: g["category"] for t, g in by_text.items()} == {
        "none": "analysis_failure", "nan": "analysis_failure", "bool": "analysis_failure",
        "text": "analysis_failure", "raise": "analysis_failure", "big": "toxicity",
        "mid": "toxicity",
    }
    assert by_text["big"]["score"] == 1.0
    assert by_text["mid"]["detail"] == "Toxicity score 0.800 >= threshold 0.800"


def test_stub_and_column_models(dataset, issues):
    ds = dataset([{"t": "aa"}, {"t": "b"}])
    assert issues(detect_toxicity(ds)) == []
    assert categories(issues, detect_toxicity(ds, StubModel(score=2))) == ["toxicity"] * 2
    assert categories(issues, detect_toxicity(ds, StubModel(unscored=True))) == ["analysis_failure"] * 2
    by_length = StubModel(expression=lambda t: F.length(t) / 2)
    assert len(issues(detect_toxicity(ds, by_length, 0.6))) == 1
    column = lambda text: F.length(text) / 2
    assert len(issues(detect_toxicity(ds, column, 0.6))) == 1


def test_score_is_in_range(spark):
    df = spark.createDataFrame([(i, s) for i, s in enumerate([-1.0, 0.5, 9.0])], "i long, s double")
    ds = records_from_table(df, [], "i", metadata=["s"])
    rows = ds.df.select("rec_ord", toxicity_score(ds, lambda t: F.col("s")).alias("x"))
    assert [r.x for r in rows.orderBy("rec_ord").collect()] == [0.0, 0.5, 1.0]


def test_bad_toxicity_threshold_is_reported_per_record(dataset, issues):
    got = issues(detect_toxicity(dataset([{"t": "a"}] * 3), StubModel(score=0.85), 1.5))
    assert [g["category"] for g in got] == ["config_error", "toxicity"] * 3
    assert got[0]["loc"] is None and got[0]["field_name"] == "toxicity_threshold"


# Schema


def test_declared_schema(dataset, issues):
    schema = Schema.of(("a", "string", True), ("b", "integer", True), ("c", "float"))
    ds = dataset(
        [
            {"a": "x", "b": 1, "c": 1.0, "extra": []},
            {"a": None, "c": None},
            {"a": 1, "b": 1.0, "c": 1},
            {"a": [], "b": True, "c": {}},
        ]
    )
    assert [(g["loc"]["line_number"], g["field_name"], g["detail"]) for g in issues(validate_schema(ds, schema))] == [
        (2, "a", "Required field 'a' is null"),
        (2, "b", "Required field 'b' is absent"),
        (3, "a", "Field 'a' has type integer, expected string"),
        (3, "b", "Field 'b' has type float, expected integer"),
        (3, "c", "Field 'c' has type integer, expected float"),
        (4, "a", "Field 'a' has type list, expected string"),
        (4, "b", "Field 'b' has type boolean, expected integer"),
        (4, "c", "Field 'c' has type object, expected float"),
    ]


def test_inferred_schema_skips_the_first_record(dataset, issues):
    ds = dataset([{"a": 1, "z": None}, {"a": 2, "z": None}, {"a": "x", "z": 1}, {"z": None}])
    assert infer_schema(ds).fields == (FieldSpec("a", "integer", True), FieldSpec("z", "null", True))
    assert [(g["loc"]["line_number"], g["detail"]) for g in issues(validate_schema(ds))] == [
        (2, "Required field 'z' is null"),
        (3, "Field 'a' has type string, expected integer"),
        (3, "Field 'z' has type integer, expected null"),
        (4, "Required field 'a' is absent"),
        (4, "Required field 'z' is null"),
    ]


def test_inference_failures(dataset, issues):
    empty = issues(validate_schema(dataset([])))
    assert [(g["category"], g["loc"]) for g in empty] == [("schema_inference_failed", None)]
    assert empty[0]["detail"].endswith("the dataset is empty")
    assert issues(validate_schema(dataset([{}, {"a": 1}])))[0]["detail"].endswith(
        "the first record contains no fields"
    )
    assert issues(validate_schema(dataset([{"a": 1}]), Schema(()))) == []


def test_schema_from_json():
    text = '{"fields": [{"name": "a", "type": "string"}, {"name": "b", "type": "list", "required": true}]}'
    assert Schema.from_json(text) == Schema.of(("a", "string", False), ("b", "list", True))
    for bad in ("{", '{"fields": [{"name": "a", "type": "date"}]}', '{"fields": [{}]}', "[1]"):
        with pytest.raises(InvalidSchema):
            Schema.from_json(bad)


# Metrics and the whole analysis


def test_metrics(dataset):
    ds = dataset([{"t": "a"}, {"t": "a b c d", "n": None}])
    found = detect_quality(ds)
    row = compute_metrics(ds, found).first()
    assert row.asDict() == {
        "record_count": 2, "mean_tokens": 2, "min_tokens": 1, "max_tokens": 4,
        "issue_record_proportion": 0.5, "quality_score": 0.5,
    }
    assert [r.rec_ord for r in flagged_records(ds, found).collect()] == [0]


def test_tokens_count_nested_text_and_numbers(dataset):
    ds = dataset([{"a": "one two", "b": 42, "c": ["x", {"d": "y z"}], "e": True, "f": None}])
    assert compute_metrics(ds, detect_quality(ds)).first().max_tokens == 6


def test_empty_dataset_metrics(dataset):
    ds = dataset([])
    assert list(compute_metrics(ds, detect_quality(ds)).first()) == [0, 0, 0, 0, 0.0, 0.0]


def test_category_counts_cover_all_categories(dataset):
    rows = category_counts(detect_quality(dataset([{"t": "a"}]))).orderBy("category_ord").collect()
    assert len(rows) == 13
    assert [r.category for r in rows if r.n_issues] == ["low_quality_short"]


def test_analysis_order_and_extra_detectors(dataset, issues):
    ds = dataset(
        [
            {"t": "the same words here"},
            {"t": "the same words here"},
            {"t": "mail me at a@b.org"},
            {"t": "hi"},
            {"t": 7},
        ]
    )

    def loud(dataset: Dataset, config: AnalysisConfig):
        return detect_quality(dataset, QualityConfig(min_tokens=2)).filter("category = 'low_quality_short'")

    result = analyze(ds, extra_detectors=[loud])
    assert categories(issues, result.issues) == [
        "duplicate", "pii", "low_quality_short", "low_quality_short",
        "low_quality_short", "low_quality_short", "field_type_mismatch",
    ]
    assert result.metrics.first().issue_record_proportion == 4 / 5


def test_analysis_of_nothing(dataset, issues):
    result = analyze(dataset([]), AnalysisConfig(similarity_threshold=2, toxicity_threshold=2))
    assert categories(issues, result.issues) == ["config_error", "schema_inference_failed"]
    assert result.metrics.first().quality_score == 0.0


def test_file_limit_is_the_configured_one_alone():
    assert [effective_file_limit(v) for v in (None, -5, 0, 7, 1 << 60)] == [None, 0, 0, 7, 1 << 60]


class Callable:
    def score(self, text):
        return 0.9

    def __call__(self, text):
        raise AssertionError("not a function of a column")


class Batches:
    def score_batch(self, texts):
        return [len(t) / 2 for t in texts]


def test_model_objects(dataset, issues):
    ds = dataset([{"t": "aa"}, {"t": "b"}])
    assert categories(issues, detect_toxicity(ds, Callable())) == ["toxicity"] * 2
    assert len(issues(detect_toxicity(ds, Batches(), 0.6))) == 1


def test_unknown_category_of_an_extra_detector(dataset):
    odd = lambda ds, config: literal_issues(
        ds.df.sparkSession, [{"category": "odd", "issue_ord": (2, 0, 0, 0)}]
    )
    with pytest.raises(UnknownCategory, match="odd"):
        analyze(dataset([{"t": "text"}]), extra_detectors=[odd])


def test_nested_values_make_different_keys_and_texts(spark):
    ddl = "i long, a array<timestamp>, b array<array<double>>, c array<struct<x: double, y: string>>, m map<string, int>"
    day = "2024-01-01 00:00:00."
    df = spark.range(1).selectExpr(
        "id AS i", f"array(timestamp'{day}000001') AS a", "array(array(0.5D, null), null) AS b",
        "array(struct(1e-5D AS x, 'w' AS y)) AS c", "map('k', 1, 'l', 2) AS m",
    )
    other = df.selectExpr(f"i + 1 AS i", f"array(timestamp'{day}000002') AS a", "b", "c", "map('l', 2, 'k', 1) AS m")
    third = df.selectExpr("i + 2 AS i", "a", "array(array(0.5D), null, null) AS b", "c", "m")
    names = ["a", "b", "c", "m"]
    ds = records_from_table(df.union(other).union(third).union(df.selectExpr("i + 3 AS i", *names)), names, "i")
    rows = ds.df.select("rec_ord", ds.content.key().alias("k"), ds.content.text().alias("t")).orderBy("rec_ord").collect()
    keys = [bytes(r.k) for r in rows]
    assert len(set(keys)) == 3 and keys[0] == keys[3]
    assert rows[0].t == "0.5 1e-05 w"


def test_per_record_detectors_run_on_a_stream(spark, tmp_path):
    """They are stateless expressions, so a streaming DataFrame needs nothing else."""
    spark.createDataFrame([(1, "a@b.org"), (2, "x")], "i long, t string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("i long, t string").parquet(str(tmp_path / "in"))
    found = detect_quality(records_from_table(stream, ["t"], "i"))
    query = (
        found.select("rec_ord", "category").writeStream.format("memory").queryName("seen")
        .option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    assert sorted(r.rec_ord for r in spark.table("seen").collect()) == [1, 2]
