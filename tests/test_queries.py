"""Every registered query against its SQL on the smallest tables."""

from __future__ import annotations

import os

import pytest

import __spark_entry__
from checks.compare import compare
from checks.oracle import ORACLE_SQL
from checks.spark_queries import QUERIES

FOLDER = os.environ.get("TAMIS_TEST_DIR", "/root/testdata/sf0.001")


def test_every_query_has_sql():
    assert set(ORACLE_SQL) == set(QUERIES)
    assert set(QUERIES) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", list(QUERIES))
@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_query(spark, name):
    outcome, _, _ = compare(spark, FOLDER, name)
    assert outcome.startswith("ok"), outcome


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 13
