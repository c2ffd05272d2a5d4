from __future__ import annotations

import pyarrow as pa
import pytest
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tamis.dataset import FIELD_DDL, Dataset, TaggedContent
from tamis.issues import LOC_DDL
from tamis.sources.decode import tagged_record
from tamis.staging import local_session


@pytest.fixture(scope="session")
def spark():
    return local_session(4, shuffle_partitions=4)


@pytest.fixture(scope="session")
def dataset(spark):
    """Build a schemaless dataset from dicts."""

    def build(records: list[dict], partitions: int = 2) -> Dataset:
        ddl = f"rec_ord long, loc {LOC_DDL}, fields array<{FIELD_DDL}>"
        schema = to_arrow_schema(StructType.fromDDL(ddl))
        rows = [
            {
                "rec_ord": i * 10,  # gaps are allowed
                "loc": {"source_file": "f.jsonl", "line_number": i + 1, "array_index": None,
                        "row_group": None, "row_index": None},
                "fields": tagged_record(r),
            }
            for i, r in enumerate(records)
        ]
        table = pa.Table.from_pylist(rows, schema)
        df = spark.createDataFrame(table, ddl).repartition(partitions)
        return Dataset(df, TaggedContent(), ["f.jsonl"])

    return build


@pytest.fixture
def issues():
    """Collect issues in report order as dicts."""

    def collect(df):
        return [r.asDict(recursive=True) for r in df.orderBy("issue_ord", "category").collect()]

    return collect
