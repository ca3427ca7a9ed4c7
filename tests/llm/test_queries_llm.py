"""Each registered query against its SQL in DuckDB, where SQL can express it."""

import os

import pytest

import check
from eventlake.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, monkeypatch, name):
    monkeypatch.setattr(check, "QUERIES", QUERIES)
    monkeypatch.setattr(check, "ORACLES", ORACLES)
    ok, note = check.compare(spark, check.connect(SF), SF, name)
    assert ok is not False, note
