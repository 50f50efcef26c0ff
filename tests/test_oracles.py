"""Every registered query with SQL equals it at the smallest scale; the others return rows."""

import pytest

from momentra.plans import registry

from .oracle import connect, same

FOLDER = "/root/testdata/sf0.001"
QUERIES, SQL = registry.queries(), registry.oracle_sql()
#: Results that are empty at this scale for lack of data, not by mistake.
SPARSE = {"anti_missing", "diff_top1", "except_missing", "filter_video", "select_weak", "run_ingest"}


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, con, name):
    ours, theirs = same(QUERIES[name](spark, FOLDER), con, SQL[name])
    assert ours == theirs
    assert ours or name in SPARSE


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_returns_rows(spark, name):
    assert QUERIES[name](spark, FOLDER).count() > 0
