from __future__ import annotations

import glob
import json

import pytest
from pyspark.sql import functions as F

from tamis.config import AnalysisConfig
from tamis.dataset import records_from_table
from tamis.errors import ReportFailed, UnsupportedFormat
from tamis.functions.pii import pii_spans
from tamis.issues import issue, order_key
from tamis.operators import explorer, metrics
from tamis.operators.metrics import compute_metrics
from tamis.operators.personal_data import detect_pii
from tamis.operators.quality import detect_quality
from tamis.plans.analysis import Analysis, analyze
from tamis.plans.report import Report, build_report, issue_json, report_format, write_report


def document(path: str) -> str:
    return "".join(open(f, encoding="utf-8").read() for f in sorted(glob.glob(f"{path}/part-*")))


@pytest.fixture(scope="module")
def analysis(dataset):
    return analyze(
        dataset(
            [
                {"text": "write to a@b.org or c@d.org today"},
                {"text": "write to a@b.org or c@d.org today"},
                {"text": "häm \"quoted\" text, quite clean"},
                {"text": "short"},
            ]
        )
    )


def test_json_report(analysis, tmp_path):
    write_report(build_report(analysis), "JSON", str(tmp_path / "r"))
    report = json.loads(document(str(tmp_path / "r")))
    assert report["metrics"] == {
        "record_count": 4, "mean_tokens": 4, "min_tokens": 1, "max_tokens": 6,
        "issue_record_proportion": 0.75, "quality_score": 0.25,
    }
    assert report["summary"] == {"total_records": 4, "total_issues": 6}
    groups = report["issues_by_category"]
    assert {k: v["count"] for k, v in groups.items() if v["count"]} == {
        "duplicate": 1, "pii": 4, "low_quality_short": 1,
    }
    assert len(groups) == 13 and all(len(v["issues"]) == v["count"] for v in groups.values())
    assert [tuple(i["span"].values()) for i in groups["pii"]["issues"]] == [(9, 16), (20, 27)] * 2
    assert groups["duplicate"]["issues"][0] == {
        "category": "duplicate",
        "location": {"source_file": "f.jsonl", "line_number": 2, "array_index": None,
                     "row_group": None, "row_index": None},
        "field_name": None,
        "related_location": {"source_file": "f.jsonl", "line_number": 1, "array_index": None,
                             "row_group": None, "row_index": None},
        "detail": "Record at index 1 is byte-for-byte identical to the record at index 0",
        "pii_category": None, "span": None, "score": None,
    }


def test_markdown_report(analysis, tmp_path):
    write_report(build_report(analysis), "markdown", str(tmp_path / "r"))
    lines = document(str(tmp_path / "r")).splitlines()
    assert lines[:8] == ["# Data Quality Report", "", "## Summary", "- Total records: 4",
                         "- Total issues: 6", "", "## Metrics", "- record_count: 4"]
    assert lines[12:20] == ["- quality_score: 0.25", "", "## Issues by Category",
                            "### parse_error (count: 0)", "_No issues._", "",
                            "### duplicate (count: 1)",
                            "- Record at index 1 is byte-for-byte identical to the record at index 0"]
    assert lines[-2:] == ["### config_error (count: 0)", "_No issues._"]


def test_missing_detail(spark, analysis, tmp_path):
    blank = analysis.issues.withColumn("detail", F.lit(""))
    write_report(build_report(Analysis(analysis.dataset, blank, analysis.metrics)), "markdown", str(tmp_path / "r"))
    assert document(str(tmp_path / "r")).count("- (no detail)") == 6


def test_formats_and_failures(analysis, tmp_path):
    assert (report_format("Json"), report_format("MARKDOWN")) == ("json", "markdown")
    for bad in ("xml", "", None, 3):
        with pytest.raises(UnsupportedFormat):
            report_format(bad)
    report = build_report(analysis)
    broken = Report(report.metrics.withColumn("quality_score", F.lit(float("nan"))), report.counts, report.issues)
    with pytest.raises(ReportFailed):
        write_report(broken, "json", str(tmp_path / "r"))
    assert not glob.glob(str(tmp_path / "r"))


def test_empty_report(dataset, tmp_path):
    ds = dataset([])
    found = detect_quality(ds)
    write_report(build_report(Analysis(ds, found, compute_metrics(ds, found))), "json", str(tmp_path / "r"))
    assert json.loads(document(str(tmp_path / "r")))["summary"] == {"total_records": 0, "total_issues": 0}


def test_base_names_in_issue_json(spark, dataset):
    ds = dataset([{"t": "x"}])
    moved = ds.df.withColumn("loc", F.col("loc").withField("source_file", F.lit("/a/b/c.jsonl")))
    found = detect_quality(type(ds)(moved, ds.content)).select(issue_json(relative_names=True)).first()[0]
    assert json.loads(found)["location"]["source_file"] == "c.jsonl"


# Explorer


def ids(df):
    return sorted(r.rec_ord // 10 for r in df.select("rec_ord").collect())


def test_search(dataset):
    ds = dataset([{"a": "Hello World"}, {"a": None, "b": 42}, {"c": ["x", {"y": "Deep"}]}, {"a": "bye"}])
    for query, hits in (("  WORLD ", [0]), ("42", [1]), ("deep", [2]), ("", [0, 1, 2, 3]), ("none", [])):
        assert ids(explorer.search(ds, query).df) == hits


def test_filters(dataset):
    ds = dataset([{"t": "a@b.org is mine"}, {"t": "hi"}, {"t": "three words here"}])
    found = detect_pii(ds).unionByName(detect_quality(ds))
    for which, hits in (("all", [0, 1, 2]), ("issues", [0, 1]), ("clean", [2]), ("pii", [0]), ("toxicity", [])):
        assert ids(explorer.filter_by_issues(ds, found, which).df) == hits


def test_pages_and_preview(dataset):
    ds = dataset([{"n": i, "t": "é" * (78 + i)} for i in range(4)] + [{"n": 5}] * 26)
    assert ids(explorer.page(ds, 3)) == list(range(24, 30))
    assert explorer.page_count(ds).first().pages == 3
    shown = [r[0] for r in ds.df.orderBy("rec_ord").select(explorer.preview(ds)).take(5)]
    assert shown == ["é" * 78, "é" * 79, "é" * 80, "é" * 80 + "...", '{"n": 5}']


def test_location_labels(spark):
    loc = "source_file string, line_number long, array_index long, row_group int, row_index long"
    rows = [("f", 3, None, None, None), ("f", None, 4, None, None), ("f", None, None, 1, 2), ("f",) + (None,) * 4]
    df = spark.createDataFrame([(r, i) for i, r in enumerate(rows)], f"loc struct<{loc.replace(' ', ':').replace(',:', ',')}>, i long")
    got = [r[0] for r in df.orderBy("i").select(explorer.location_label(F.col("loc"), F.col("i"))).collect()]
    assert got == ["Line 3", "Index 4", "Group 1, Row 2", "Row 4"]


def test_annotated_records(analysis):
    rows = explorer.annotate(analysis.dataset, analysis.issues).orderBy("index").collect()
    assert [(r["index"], r.n_issues, r.categories) for r in rows] == [
        (0, 2, ["pii"]), (1, 3, ["duplicate", "pii"]), (2, 0, []), (3, 1, ["low_quality_short"]),
    ]
    assert [r.redacted and r.redacted[0].str for r in rows] == [
        "write to [EMAIL] or [EMAIL] today"] * 2 + [None, None]
    assert [r.categories for r in explorer.record_categories(analysis.issues).orderBy("rec_ord").collect()] == [
        ["pii"], ["duplicate", "pii"], ["low_quality_short"]]
    assert explorer.record_issues(analysis.issues).count() == 6


def test_display_spans(spark):
    df = spark.createDataFrame([(1,)], "i int").select(
        F.from_json(F.lit('[[0,5],[3,8],[8,9],[10,20],[12,14]]'), "array<array<int>>").alias("a")
    )
    spans = F.transform("a", lambda p: F.struct(p[0].alias("start"), p[1].alias("end")))
    got = df.select(explorer.display_spans(spans)).first()[0]
    assert [tuple(s) for s in got] == [(12, 14), (8, 9), (3, 8)]


def test_spans_of_columns_and_redaction_agree(spark):
    df = spark.createDataFrame([("a@b.org",)], "t string")
    assert len(df.select(pii_spans(F.col("t"))).first()[0]) == 1


def test_texts_are_read_a_few_times(spark, tmp_path):
    """Whatever an analysis needs of a text, it comes from one scan and the comparison of candidates."""
    texts = [f"some words of record {i} with mail m{i}@b.org {'!' * (i % 9)}" for i in range(40)] * 2
    spark.createDataFrame(list(enumerate(texts)), "i long, t string").write.parquet(str(tmp_path / "t"))
    reads = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(text):
        reads.add(1)
        return text

    for threshold in (0.9, 0.5):
        before = reads.value
        table = spark.read.parquet(str(tmp_path / "t")).withColumn("t", counted("t"))
        result = analyze(records_from_table(table, ["t"], "i"), AnalysisConfig(similarity_threshold=threshold))
        assert result.metrics.first().record_count == 80 and result.issues.count() > 80
        assert reads.value - before <= 4 * len(texts)


def test_an_issue_with_a_location_alone_counts(dataset):
    ds = dataset([{"t": "three words here"}, {"t": "other words here now"}, {"t": "hi"}, {"t": "more words here"}])

    def detector(data, config):
        at = data.df.filter("rec_ord IN (0, 20)")
        return at.select(issue("toxicity", order_key(2, F.col("rec_ord")), loc=F.col("loc")).alias("i")).select("i.*")

    result = analyze(ds, AnalysisConfig(), extra_detectors=[detector, detector])
    assert result.metrics.first().issue_record_proportion == 0.5  # records 0 and 2, which is short too
    assert ids(metrics.flagged_records(ds, result.issues).orderBy("rec_ord")) == [0, 2]
