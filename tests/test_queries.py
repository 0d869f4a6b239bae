"""Registered queries against their SQL twins; ``ALL_QUERIES=1`` runs every one."""

import os

import pytest

from __spark_entry__ import oracle_sql, queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")
EVERY = os.environ.get("ALL_QUERIES") == "1"
SOME = sorted(oracle_sql())[::5]


@pytest.fixture(scope="module")
def con():
    import check

    return check.duck(SF)


@pytest.mark.parametrize("name", sorted(queries()) if EVERY else SOME)
def test_query(spark, con, name):
    import check

    text, _ = check.compare(spark, con, SF, name)
    assert text.startswith(("ok", "rows only")), text


def test_every_oracle_has_a_query():
    assert set(oracle_sql()) <= set(queries())
