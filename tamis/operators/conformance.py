"""Schema conformance, against a declared schema or the first record's."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamis import fixed
from tamis.config import FieldSpec, Schema
from tamis.dataset import Dataset, TypedContent, type_tag
from tamis.issues import (
    CONFORMANCE,
    ISSUE_DDL,
    explode_issues,
    issue,
    literal_issues,
    order_key,
)


def first_record(dataset: Dataset) -> tuple[int, list[FieldSpec]] | None:
    """Order and field types of the first record, None for an empty dataset."""
    first = dataset.df.agg(F.min("rec_ord")).first()[0]  # reads one column
    if first is None:
        return None
    row = dataset.df.filter(F.col("rec_ord") == first).select(
        dataset.content.field_types().alias("types")
    ).first()
    return first, [FieldSpec(t.name, t.type, True) for t in row.types]


def infer_schema(dataset: Dataset) -> Schema | None:
    """The schema the first record implies, all fields required; None if it has none."""
    found = first_record(dataset)
    return Schema(tuple(found[1]), inferred=True) if found and found[1] else None


def conformance_issue_array(dataset: Dataset, schema: Schema) -> Column:
    """One issue per field of the schema that the record lacks or mistypes."""
    if not schema.fields:
        return F.array().cast(f"array<{ISSUE_DDL}>")
    specs = F.array(
        *[
            F.struct(
                F.lit(i).alias("pos"),
                F.lit(s.name).alias("name"),
                F.lit(s.type).alias("type"),
                F.lit(s.required).alias("required"),
            )
            for i, s in enumerate(schema.fields)
        ]
    )
    if isinstance(dataset.content, TypedContent):
        return _typed_conformance(dataset.content, schema)
    types = F.map_from_entries(dataset.content.field_types())

    def check(spec: Column) -> Column:
        actual = F.coalesce(F.try_element_at(types, spec["name"]), F.lit("absent"))
        missing = actual.isin("absent", "null")
        return F.when(
            (missing & spec["required"]) | (~missing & (actual != spec["type"])),
            issue(
                F.when(missing, "missing_required_field").otherwise("field_type_mismatch"),
                order_key(CONFORMANCE, F.col("rec_ord"), spec["pos"]),
                loc=F.col("loc"),
                field_name=spec["name"],
                detail=F.when(
                    missing, F.format_string(fixed.DETAIL_MISSING, spec["name"], actual)
                ).otherwise(
                    F.format_string(fixed.DETAIL_MISMATCH, spec["name"], actual, spec["type"])
                ),
                rec_ord=F.col("rec_ord"),
            ),
        )

    return F.filter(F.transform(specs, check), lambda i: i.isNotNull())


def _typed_conformance(content: TypedContent, schema: Schema) -> Column:
    """As above where types are known when the plan is built: only null tests remain."""

    def found(i: int, spec: FieldSpec, category: str, detail: str) -> Column:
        return issue(
            category,
            order_key(CONFORMANCE, F.col("rec_ord"), i),
            loc=F.col("loc"),
            field_name=F.lit(spec.name),
            detail=F.lit(detail),
            rec_ord=F.col("rec_ord"),
        )

    checks = []
    for i, spec in enumerate(schema.fields):
        missing, mismatch = "missing_required_field", "field_type_mismatch"
        absent = fixed.DETAIL_MISSING % (spec.name, "absent")
        if spec.name not in content.names:
            if spec.required:
                checks.append(found(i, spec, missing, absent))
            continue
        null = F.col(f"`{spec.name}`").isNull()
        actual = type_tag(content.schema[spec.name].dataType)
        one = None
        if spec.required:
            one = F.when(null, found(i, spec, missing, fixed.DETAIL_MISSING % (spec.name, "null")))
        if actual != spec.type:
            detail = fixed.DETAIL_MISMATCH % (spec.name, actual, spec.type)
            wrong = found(i, spec, mismatch, detail)
            one = F.when(~null, wrong) if one is None else one.when(~null, wrong)
        if one is not None:
            checks.append(one)
    if not checks:
        return F.array().cast(f"array<{ISSUE_DDL}>")
    return F.array_compact(F.array(*checks))


def inference_failure(dataset: Dataset, empty: bool) -> DataFrame:
    detail = fixed.DETAIL_NO_RECORDS if empty else fixed.DETAIL_NO_FIELDS
    return literal_issues(
        dataset.df.sparkSession,
        [
            {
                "category": "schema_inference_failed",
                "detail": detail,
                "issue_ord": (CONFORMANCE, 0, 0, 0),
            }
        ],
    )


def resolve_schema(
    dataset: Dataset, schema: Schema | None
) -> tuple[Schema | None, Column, DataFrame | None]:
    """The schema to check, which records to check, and a failure to report."""
    if schema is not None:
        return schema, F.lit(True), None
    found = first_record(dataset)
    if not found or not found[1]:
        return None, F.lit(False), inference_failure(dataset, empty=found is None)
    first_ord, specs = found
    return Schema(tuple(specs), inferred=True), F.col("rec_ord") != first_ord, None


def validate_schema(dataset: Dataset, schema: Schema | None = None) -> DataFrame:
    """Conformance issues. Without a schema the first record sets it and is not checked."""
    effective, checked, failure = resolve_schema(dataset, schema)
    if failure is not None:
        return failure
    return explode_issues(
        dataset.df.filter(checked), conformance_issue_array(dataset, effective)
    )
