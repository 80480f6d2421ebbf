"""Every query with SQL gives its rows on the smallest tables; the others run."""

from __future__ import annotations

import pytest

from loomgraph.plans.catalogue import QUERIES, SQL
from tests.compare import differs, tables

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    return tables(FOLDER)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    frame = QUERIES[name](spark, FOLDER)
    if name in SQL:
        assert differs(frame, SQL[name], db) == ""
    else:
        assert frame.count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["region", "n"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
