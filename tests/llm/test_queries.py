"""The operators' queries over the smallest tables: against their SQL where there is one."""

from __future__ import annotations

import os

import pytest

from checks.compare import compare
from tamis.llm.queries import LLM_ORACLE_SQL, LLM_QUERIES

FOLDER = os.environ.get("TAMIS_TEST_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", list(LLM_QUERIES))
@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_query(spark, name):
    outcome, _, _ = compare(spark, FOLDER, name)
    assert outcome.startswith("ok" if name in LLM_ORACLE_SQL else "no SQL"), outcome
