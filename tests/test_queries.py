"""Every registered query against its SQL."""

from __future__ import annotations

from pathlib import Path

import pytest

from attest.queries import QUERIES, SQL
from tests.compare import difference, duck

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).is_dir(), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, con, name):
    assert difference(spark, con, QUERIES[name], SQL[name], SF) == ""


def test_entry(spark):
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert set(QUERIES) == set(SQL)
    assert __spark_entry__.entry(spark).count() > 0
