"""Every registered query against its SQL counterpart, or at least for rows."""

import pytest

import __spark_entry__ as entry
from checks import compare

QUERIES = {n: q for n, q in entry.queries().items() if q.__module__.startswith("mailgrade.plans")}
ORACLE = {n: q for n, q in entry.oracle_sql().items() if n in QUERIES}


@pytest.fixture(scope="module")
def duck(sf_dir):
    return compare.connect(sf_dir)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_as_sql(spark, sf_dir, duck, name):
    assert compare.differences(QUERIES[name](spark, sf_dir), duck, ORACLE[name]) == []


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_gives_rows(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_every_sql_has_a_query():
    assert set(ORACLE) <= set(QUERIES)


def test_entry(spark):
    assert {r["priority_label"] for r in entry.entry(spark).collect()} <= {
        "critical", "high", "normal", "low",
    }
