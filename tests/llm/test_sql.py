"""The queries that have SQL twins."""

import oracle
import pytest

from arrpipe.llm.queries import ORACLES, QUERIES

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def connection():
    return oracle.connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, connection, name):
    assert oracle.differences(QUERIES[name](spark, SF_DIR), connection, ORACLES[name]) is None
