"""Every registered query against its SQL on the smallest tables (``QUERY_SF_DIR`` for others)."""

import os

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tools.check_oracle import compare, connect

SF_DIR = os.environ.get("QUERY_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables are not here")


#: Reports whose threshold no row of the smallest tables may reach.
MAY_BE_EMPTY = {"segment_quarterly", "segment_value_having", "corr_high_pairs"}


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


def test_entry(spark):
    assert entry(spark).count() == 9


def test_oracles_name_queries():
    assert set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, con, name):
    message, rows = compare(spark, con, SF_DIR, name, queries()[name], oracle_sql().get(name))
    assert message.startswith(("ok", "rows=")) and (rows or name in MAY_BE_EMPTY), message
