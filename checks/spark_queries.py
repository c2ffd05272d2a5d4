"""One query per operator, over whole tables."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tamis.config import AnalysisConfig, QualityConfig, Schema
from tamis.dataset import Dataset, records_from_table
from tamis.functions import text as tx
from tamis.functions.numbers import float_text
from tamis.functions.pii import luhn_valid
from tamis.operators import duplicates, explorer, metrics
from tamis.operators.conformance import infer_schema, validate_schema
from tamis.operators.numbering import record_positions
from tamis.operators.personal_data import detect_pii, redact_records
from tamis.operators.quality import detect_quality
from tamis.operators.toxicity import detect_toxicity, toxicity_score
from tamis.operators.equivalence import differing_records
from tamis.issues import issue, order_key
from tamis.plans.analysis import Analysis, analyze
from tamis.plans.path import analyze_path
from tamis.plans.report import build_report, issue_json, report_lines
from tamis.sinks import exports
from tamis.sinks.exports import export_records
from tamis.sinks.files import name_parts, write_lines
from tamis.sources.ingest import read_records
from tamis.sources.tables import read_table
from tamis.staging import new_folder

EVENT_SCHEMA = Schema.of(
    ("event_id", "integer", True),
    ("ts", "string", True),
    ("value", "integer", True),
    ("event_type", "string", True),
    ("props", "object"),
    ("session", "string", True),
    ("note", "string"),
)


ROWS_PER_FILE = 50_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> Dataset:
    return records_from_table(table(spark, sf_dir, "documents"), ["text"], "doc_id", "documents")


def events(spark: SparkSession, sf_dir: str) -> Dataset:
    columns = ["event_id", "ts", "user_id", "event_type", "value", "props"]
    return records_from_table(table(spark, sf_dir, "events"), columns, F.col("event_id"), "events")


def turns(spark: SparkSession, sf_dir: str) -> Dataset:
    """Conversation turns, ordered by conversation and turn."""
    df = table(spark, sf_dir, "conversations")
    longest = df.agg(F.max("turn")).first()[0] or 0
    order = F.col("conv_id") * (longest + 1) + F.col("turn")
    return records_from_table(df, ["role", "text"], order, "conversations")


def labelled(spark: SparkSession, sf_dir: str) -> Dataset:
    """Documents with their labels, which only some have."""
    joined = table(spark, sf_dir, "documents").join(
        table(spark, sf_dir, "labels"), "doc_id", "left"
    )
    return records_from_table(
        joined, ["text", "lang", "quality", "toxic"], "doc_id", "documents"
    )


def flat(issues: DataFrame) -> DataFrame:
    return issues.select("rec_ord", "category", "field_name", "detail", "score")


def document_analysis(spark: SparkSession, sf_dir: str) -> Analysis:
    return analyze(documents(spark, sf_dir))


# Text statistics


def token_counts(spark, sf_dir):
    ds = documents(spark, sf_dir)
    return ds.df.select(F.col("rec_ord").alias("doc_id"), tx.token_count(ds.content.text()).alias("tokens"))


def token_metrics(spark, sf_dir):
    return metrics.token_stats(documents(spark, sf_dir))


def word_set_sizes(spark, sf_dir):
    ds = documents(spark, sf_dir)
    return ds.df.select(
        F.col("rec_ord").alias("doc_id"), F.size(tx.word_set(ds.content.text())).alias("words")
    )


def record_text(spark, sf_dir):
    ds = events(spark, sf_dir)
    return ds.df.select(
        "rec_ord",
        ds.content.text().alias("text"),
        ds.content.string_text().alias("string_text"),
    )


def non_alnum_ratios(spark, sf_dir):
    ds = documents(spark, sf_dir)
    ratio = tx.non_alnum_ratio(ds.content.text())
    return ds.df.select(
        F.col("rec_ord").alias("doc_id"),
        ratio.alias("ratio"),
        tx.three_decimals(ratio).alias("shown"),
    )


def number_text(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    return orders.select("o_orderkey", float_text(F.col("o_totalprice")).alias("text"))


def field_type_profile(spark, sf_dir):
    ds = labelled(spark, sf_dir)
    return (
        ds.df.select(F.explode(ds.content.field_types()).alias("f"))
        .groupBy(F.col("f.name").alias("name"), F.col("f.type").alias("type"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def blank_fields(spark, sf_dir):
    ds = labelled(spark, sf_dir)
    return ds.df.select(
        "rec_ord",
        ds.content.blank("text").alias("text_blank"),
        ds.content.blank("quality").alias("quality_blank"),
        ds.content.all_blank().alias("all_blank"),
    )


# Quality, personal data, toxicity


def quality_issues(spark, sf_dir):
    return flat(detect_quality(documents(spark, sf_dir)))


def quality_short(spark, sf_dir):
    strict, _ = QualityConfig().updated(min_tokens=50)
    return flat(detect_quality(documents(spark, sf_dir), strict)).filter(
        "category = 'low_quality_short'"
    )


def quality_gibberish(spark, sf_dir):
    strict, _ = QualityConfig().updated(gibberish_threshold=0.2)
    return flat(detect_quality(documents(spark, sf_dir), strict)).filter(
        "category = 'low_quality_gibberish'"
    )


def quality_empty(spark, sf_dir):
    config = QualityConfig(required_fields=("quality", "missing"))
    return flat(detect_quality(labelled(spark, sf_dir), config)).filter(
        "category = 'empty_record'"
    )


def pii_spans(spark, sf_dir):
    return detect_pii(documents(spark, sf_dir)).select(
        F.col("rec_ord").alias("doc_id"),
        "field_name",
        "pii_category",
        F.col("span.start").alias("span_start"),
        F.col("span.end").alias("span_end"),
        "detail",
    )


def pii_contacts(spark, sf_dir):
    """Telephone numbers, addresses and ids, and look-alikes, in letters made of customers' keys."""
    parts = table(spark, sf_dir, "customer").selectExpr(
        "c_custkey",
        "lpad(c_custkey % 1000, 3, '0') AS a", "lpad(c_custkey % 100, 2, '0') AS b", "lpad(c_custkey % 10000, 4, '0') AS c",
        "concat(c_custkey % 100000, ' ', initcap(c_mktsegment), ' ', element_at(array('Street', 'Avenue', 'Road', "
        "'Boulevard', 'Lane', 'Drive', 'Place'), cast(c_custkey % 7 + 1 AS int))) AS address",
    )
    letters = parts.selectExpr(
        "c_custkey", "concat('Ring ', a, '-', a, '-', c, ' or write: ', address, '; no ', a, '-', b, '-', c, "
        "'x, valid ', a, '-', b, '-', c, '.') AS text",
    )
    return detect_pii(records_from_table(letters, ["text"], "c_custkey", "letters")).select(
        F.col("rec_ord").alias("c_custkey"), "pii_category", F.col("span.start").alias("span_start"),
        F.col("span.end").alias("span_end"),
    )


def pii_counts(spark, sf_dir):
    return detect_pii(documents(spark, sf_dir)).groupBy("pii_category").agg(
        F.count(F.lit(1)).alias("n_spans"), F.count_distinct("rec_ord").alias("n_records")
    )


def redacted_documents(spark, sf_dir):
    return redact_records(documents(spark, sf_dir)).df.select(
        F.col("rec_ord").alias("doc_id"), "text"
    )


def luhn_check(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    number = F.concat(
        F.lpad(F.col("o_custkey").cast("string"), 8, "0"),
        F.lpad(F.col("o_orderkey").cast("string"), 8, "0"),
    )
    return orders.select("o_orderkey", luhn_valid(number).alias("valid"))


def toxicity_flags(spark, sf_dir):
    ds = labelled(spark, sf_dir)
    return flat(detect_toxicity(ds, lambda text: F.col("toxic"), 0.5))


def toxicity_scores(spark, sf_dir):
    ds = documents(spark, sf_dir)
    model = lambda text: 1.5 - tx.non_alnum_ratio(text) * 5
    return ds.df.select(
        F.col("rec_ord").alias("doc_id"), toxicity_score(ds, model).alias("score")
    )


def toxicity_bad_threshold(spark, sf_dir):
    return flat(detect_toxicity(documents(spark, sf_dir), None, 1.5))


# Duplicates


def exact_duplicates(spark, sf_dir):
    return flat(duplicates.exact_duplicate_issues(documents(spark, sf_dir)))


def exact_duplicate_labels(spark, sf_dir):
    """Four contents share all records."""
    ds = records_from_table(table(spark, sf_dir, "labels"), ["quality", "toxic"], "doc_id", "labels")
    return flat(duplicates.exact_duplicate_issues(ds))


def first_occurrences(spark, sf_dir):
    return duplicates.exact_groups(documents(spark, sf_dir)).select("first_ord", "n_records")


def repeated_orders(spark, sf_dir):
    """Few distinct contents, each in a large share of all records."""
    ds = records_from_table(
        table(spark, sf_dir, "orders"), ["o_orderstatus", "o_orderpriority"], "o_orderkey", "orders"
    )
    return duplicates.exact_copies(ds).select("rec_ord", "first_ord")


def near_duplicates(spark, sf_dir):
    return flat(duplicates.near_duplicate_issues(documents(spark, sf_dir), 0.9))


def near_duplicates_low(spark, sf_dir):
    return flat(duplicates.near_duplicate_issues(documents(spark, sf_dir), 0.6))


def near_duplicate_turns(spark, sf_dir):
    return flat(duplicates.near_duplicate_issues(turns(spark, sf_dir), 0.3))


def customers(spark: SparkSession, sf_dir: str) -> Dataset:
    return records_from_table(
        table(spark, sf_dir, "customer"), ["c_mktsegment", "c_nationkey"], "c_custkey", "customer"
    )


def exact_duplicate_customers(spark, sf_dir):
    return flat(duplicates.exact_duplicate_issues(customers(spark, sf_dir)))


def near_duplicate_customers(spark, sf_dir):
    """Pairs with one of two words in common, and every earlier copy of the partner."""
    return flat(duplicates.near_duplicate_issues(customers(spark, sf_dir), 0.3))


def duplicate_issues(spark, sf_dir):
    """A rejected threshold: one config issue, and the default in force."""
    return flat(duplicates.detect_duplicates(documents(spark, sf_dir), 7))


# Schema conformance


def schema_declared(spark, sf_dir):
    return flat(validate_schema(events(spark, sf_dir), EVENT_SCHEMA))


def schema_inferred(spark, sf_dir):
    return flat(validate_schema(labelled(spark, sf_dir)))


def inferred_fields(spark, sf_dir):
    """The inferred schema, joined with how many records conform to each field."""
    ds = labelled(spark, sf_dir)
    specs = spark.createDataFrame(
        [(i, s.name, s.type, s.required) for i, s in enumerate(infer_schema(ds).fields)],
        "ord int, name string, type string, required boolean",
    )
    return specs.join(field_type_profile(spark, sf_dir), ["name", "type"], "left").select(
        "ord", "name", "type", "required", "n"
    )


# Whole analysis, metrics and report


def issue_category_counts(spark, sf_dir):
    return metrics.category_counts(document_analysis(spark, sf_dir).issues)


def quality_metrics(spark, sf_dir):
    return document_analysis(spark, sf_dir).metrics


def path_category_counts(spark, sf_dir):
    """From a path to the issues of all detectors: the texts as JSONL files."""
    ds = records_from_table(table(spark, sf_dir, "documents"), ["text"], "doc_id", "documents")
    folder = new_folder(spark, "corpus")
    export_records(ds, "jsonl", folder)
    found = analyze_path(spark, folder)
    return metrics.category_counts(found.analysis.issues)


def extra_detector_records(spark, sf_dir):
    """Issues of a caller's detector, which names locations alone, count like all others."""

    def detector(dataset, config):
        marked = dataset.df.filter(F.length(dataset.content.text()) % 5 == 0)
        return marked.select(
            issue("toxicity", order_key(2, F.col("rec_ord")), loc=F.col("loc")).alias("issue")
        ).select("issue.*")

    analysis = analyze(documents(spark, sf_dir), extra_detectors=[detector])
    return metrics.flagged_records(analysis.dataset, analysis.issues).select(F.col("rec_ord").alias("doc_id"))


def issue_records(spark, sf_dir):
    analysis = document_analysis(spark, sf_dir)
    return metrics.flagged_records(analysis.dataset, analysis.issues).select(
        F.col("rec_ord").alias("doc_id")
    )


def report_totals(spark, sf_dir):
    return build_report(document_analysis(spark, sf_dir)).totals()


def all_issues(spark, sf_dir):
    """Every issue of a full analysis with a toxicity model and a declared schema."""
    schema = Schema.of(("text", "string", True), ("quality", "integer", True), ("lang", "list"))
    config = AnalysisConfig(schema=schema, toxicity_threshold=0.5)
    analysis = analyze(labelled(spark, sf_dir), config, lambda text: F.col("toxic"))
    return analysis.issues.select(
        "rec_ord", "category", "field_name", "pii_category", "detail",
        F.col("issue_ord.stage").alias("stage"),
    )


def report_markdown_lines(spark, sf_dir):
    report = build_report(document_analysis(spark, sf_dir))
    return report_lines(report, "markdown").select(
        "category_ord", "place", F.col("issue_ord.rec_ord").alias("rec_ord"), "line"
    )


def report_json_issues(spark, sf_dir):
    issues = detect_quality(documents(spark, sf_dir), QualityConfig(min_tokens=50))
    return issues.filter("category = 'low_quality_short'").select("rec_ord", issue_json().alias("json"))


# Explorer


def explorer_search(spark, sf_dir):
    return explorer.search(documents(spark, sf_dir), " The ").df.select(
        F.col("rec_ord").alias("doc_id")
    )


def explorer_clean(spark, sf_dir):
    ds = documents(spark, sf_dir)
    return explorer.filter_by_issues(ds, detect_pii(ds), "clean").df.select(
        F.col("rec_ord").alias("doc_id")
    )


def explorer_category(spark, sf_dir):
    ds = documents(spark, sf_dir)
    config = QualityConfig(min_tokens=50)
    return explorer.filter_by_issues(
        ds, detect_quality(ds, config), "low_quality_short"
    ).df.select(F.col("rec_ord").alias("doc_id"))


def explorer_page(spark, sf_dir):
    ds = documents(spark, sf_dir)
    return explorer.page(ds, 3).select(F.col("rec_ord").alias("doc_id"), "text")


def explorer_pages(spark, sf_dir):
    return explorer.page_count(documents(spark, sf_dir))


def explorer_preview(spark, sf_dir):
    ds = documents(spark, sf_dir)
    placed = ds.df.join(record_positions(ds.df.select("rec_ord")), "rec_ord")
    return placed.select(
        F.col("rec_ord").alias("doc_id"),
        explorer.preview(ds).alias("preview"),
        explorer.location_label(F.col("loc"), F.col("rec_idx")).alias("label"),
    )


def record_categories(spark, sf_dir):
    analysis = document_analysis(spark, sf_dir)
    return explorer.record_categories(analysis.issues).select(
        F.col("rec_ord").alias("doc_id"), F.array_join("categories", ",").alias("categories")
    )


def record_issue_nest(spark, sf_dir):
    analysis = document_analysis(spark, sf_dir)
    nested = explorer.annotate(analysis.dataset, analysis.issues)
    return nested.select(
        F.col("index"),
        "n_issues",
        F.array_join("categories", ",").alias("categories"),
        F.col("redacted").isNotNull().alias("is_redacted"),
    )


def record_numbers(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    return record_positions(orders.select((F.col("o_orderkey") * 100_003).alias("rec_ord")))


# Sources and sinks, over exports of whole tables


def _field(name: str) -> Column:
    return F.filter("fields", lambda f: f["name"] == name)[0]


def _round_trip(spark: SparkSession, sf_dir: str, fmt: str) -> Dataset:
    """Documents written in a format and read back."""
    ds = records_from_table(
        table(spark, sf_dir, "documents"), ["doc_id", "text", "lang"], "doc_id", "documents"
    )
    folder = new_folder(spark, fmt)
    export_records(ds, fmt, folder)
    return read_records(spark, folder)


def json_roundtrip(spark, sf_dir):
    return _round_trip(spark, sf_dir, "json").df.select(
        _field("doc_id")["json"].cast("bigint").alias("doc_id"),
        _field("text")["str"].alias("text"),
        _field("lang")["str"].alias("lang"),
    )


def jsonl_roundtrip(spark, sf_dir):
    return _round_trip(spark, sf_dir, "jsonl").df.select(
        _field("doc_id")["json"].cast("bigint").alias("doc_id"),
        _field("text")["str"].alias("text"),
        _field("lang")["str"].alias("lang"),
    )


def csv_roundtrip(spark, sf_dir):
    return _round_trip(spark, sf_dir, "csv").df.select(
        _field("doc_id")["str"].cast("bigint").alias("doc_id"),
        _field("text")["str"].alias("text"),
        _field("lang")["str"].alias("lang"),
    )


def parquet_roundtrip(spark, sf_dir):
    return _round_trip(spark, sf_dir, "parquet").df.select("doc_id", "text", "lang")


def parquet_coordinates(spark, sf_dir):
    """Row group and index of each order in files of many small row groups, against their order by key."""
    orders = table(spark, sf_dir, "orders")
    folder = new_folder(spark, "groups")
    # More rows are more files, not larger ones: tasks and row group lists stay as they are.
    files = max(3, math.ceil(orders.count() / ROWS_PER_FILE))
    orders.repartitionByRange(files, "o_orderkey").sortWithinPartitions("o_orderkey").write.option(
        "parquet.block.size", 20_000
    ).option("parquet.page.row.count.limit", 500).option("parquet.page.size.row.check.min", 100).option(
        "parquet.block.size.row.check.min", 100
    ).parquet(folder)
    found = read_records(spark, folder).df.select("o_orderkey", "loc.*")
    file = Window.partitionBy("source_file").orderBy("o_orderkey")
    group = Window.partitionBy("source_file", "row_group")
    placed = found.withColumn("place", F.row_number().over(file) - 1)
    placed = placed.withColumn("first", F.min("place").over(group))
    right = F.col("row_index") == F.col("place") - F.col("first")
    return placed.agg(
        F.count(F.lit(1)).alias("n_records"), F.count_if(right).alias("n_right"),
        (F.count_distinct("source_file", "row_group") > F.count_distinct("source_file")).alias("several_groups"),
    )


def jsonl_lines(spark, sf_dir):
    """JSON text of each event as one line of JSONL files."""
    lines = table(spark, sf_dir, "events").select("event_id", F.col("props").alias("line"))
    folder = new_folder(spark, "events")
    write_lines(lines, ["event_id"], folder, "jsonl")
    ds = read_records(spark, folder)
    return record_positions(ds.df).select(
        F.col("rec_idx").alias("event_id"), _field("k")["json"].cast("bigint").alias("k")
    )


def csv_lines(spark, sf_dir):
    """Quote-free CSV in several files with headers, whose lines are split and numbered in parallel."""
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string"), "o_orderstatus", "o_orderpriority"
    )
    folder = new_folder(spark, "orders")
    orders.repartitionByRange(8, F.col("o_orderkey").cast("bigint")).sortWithinPartitions(
        F.col("o_orderkey").cast("bigint")
    ).write.csv(folder, header=True)
    name_parts(spark, folder, "csv")
    ds = read_records(spark, folder)
    return ds.df.join(record_positions(ds.df.select("rec_ord")), "rec_ord").select(
        F.col("rec_idx").alias("place"), *[_field(n)["str"].alias(n) for n in orders.columns],
    )


def mixed_folder_contents(spark, sf_dir):
    """Documents as JSONL and again as Parquet in one folder: equal records are one content."""
    ds = records_from_table(
        table(spark, sf_dir, "documents"), ["doc_id", "text", "lang"], "doc_id", "documents"
    )
    folder = new_folder(spark, "mixed")
    export_records(ds, "jsonl", folder)
    table(spark, sf_dir, "documents").select("lang", "text", "doc_id").write.mode("append").parquet(folder)
    mixed = read_records(spark, folder)
    contents = mixed.df.select(mixed.content.key().alias("key"), _field("doc_id")["json"].cast("bigint").alias("doc_id"))
    return contents.groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n_records")).drop("key")


def csv_width_errors(spark, sf_dir):
    """Addresses with one comma or two under a header of two columns: located issues and records."""
    lines = table(spark, sf_dir, "customer").select(
        "c_custkey",
        F.when(F.col("c_custkey") % 3 == 0, F.format_string('"%s, key",%d,x', "c_name", "c_custkey"))
        .otherwise(F.format_string('"%s, key",%d', "c_name", "c_custkey")).alias("line"),
    )
    header = spark.createDataFrame([(-1, "name,key")], "c_custkey long, line string")
    folder = new_folder(spark, "widths")
    write_lines(header.unionByName(lines).coalesce(1), ["c_custkey"], folder, "csv")
    ds = read_records(spark, folder)
    good = ds.df.select(
        F.lit("record").alias("kind"), F.col("loc.line_number").alias("line_number"), _field("name")["str"].alias("detail")
    )
    return good.unionByName(ds.parse_issues.select(
        F.col("category").alias("kind"), F.col("loc.line_number").alias("line_number"), "detail"
    ))


def parse_errors(spark, sf_dir):
    """Plain text lines read as JSONL: each line's parse error, in however many files.

    A detail names the line in its file; here that number gives way to the error's place in the folder.
    """
    lines = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_name").alias("line"))
    folder = new_folder(spark, "names")
    write_lines(lines, ["c_custkey"], folder, "jsonl")
    found = read_records(spark, folder).parse_issues
    # The order key of a parse issue holds its file's place and its line.
    keyed = found.withColumn("rec_ord", F.col("issue_ord.rec_ord") + F.col("issue_ord.a"))
    in_file, in_folder = (
        F.concat(F.lit("Malformed JSON on line "), n.cast("string"), F.lit(":")) for n in (F.col("loc.line_number"), F.col("rec_idx") + 1)
    )
    return record_positions(keyed).withColumn("detail", F.replace("detail", in_file, in_folder)).groupBy(
        "category", "detail"
    ).agg(F.count(F.lit(1)).alias("n"))


def first_unrepresentable_value(spark, sf_dir):
    """The first vector of the label 7 is the first one that a CSV cell cannot hold."""
    vectors = table(spark, sf_dir, "embeddings").withColumn(
        "embedding", F.when(F.col("label") == 7, F.col("embedding"))
    )
    ds = records_from_table(vectors, ["label", "embedding"], "vec_id", "embeddings")
    index, name = exports.first_unrepresentable(ds, "csv") or (None, None)
    counts = vectors.agg(F.count(F.lit(1)).alias("n_records"))
    return counts.select(
        F.lit(index).cast("bigint").alias("record_index"),
        F.lit(name).alias("field_name"),
        "n_records",
    )


def export_field_names(spark, sf_dir):
    ds = labelled(spark, sf_dir)
    return exports.field_names(ds).select(
        F.col("first.pos").alias("pos"), "name", F.array_join("types", ",").alias("types")
    )


def round_trip_differences(spark, sf_dir):
    ds = records_from_table(
        table(spark, sf_dir, "documents"), ["doc_id", "text", "lang"], "doc_id", "documents"
    )
    different = differing_records(ds, _round_trip(spark, sf_dir, "jsonl"))
    return different.agg(F.count(F.lit(1)).alias("n_different"))


QUERIES = {
    f.__name__: f
    for f in (
        token_counts, token_metrics, word_set_sizes, record_text, non_alnum_ratios, number_text,
        field_type_profile, blank_fields, quality_issues, quality_short, quality_gibberish,
        quality_empty, pii_spans, pii_contacts, pii_counts, redacted_documents, luhn_check, toxicity_flags,
        toxicity_scores, toxicity_bad_threshold, exact_duplicates, exact_duplicate_labels,
        first_occurrences, repeated_orders, near_duplicates, near_duplicates_low,
        near_duplicate_turns, duplicate_issues, schema_declared, schema_inferred,
        inferred_fields, issue_category_counts, quality_metrics, path_category_counts,
        extra_detector_records, issue_records, report_totals,
        all_issues, report_markdown_lines, report_json_issues, explorer_search, explorer_clean,
        explorer_category, explorer_page, explorer_pages, explorer_preview, record_categories,
        record_issue_nest, record_numbers, exact_duplicate_customers, near_duplicate_customers,
        json_roundtrip, jsonl_roundtrip, csv_roundtrip, parquet_roundtrip, parquet_coordinates, jsonl_lines, csv_lines, mixed_folder_contents,
        csv_width_errors, parse_errors, first_unrepresentable_value, export_field_names, round_trip_differences,
    )
}
