"""Every query against its SQL twin."""

import oracle
import pytest

from arrpipe.catalog.oracles import ORACLES
from arrpipe.catalog.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def connection():
    return oracle.connect(SF_DIR)


def test_every_query_has_a_twin():
    assert QUERIES.keys() == ORACLES.keys()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_equals_sql(spark, connection, name):
    df = QUERIES[name](spark, SF_DIR)
    assert oracle.differences(df, connection, ORACLES[name]) is None
