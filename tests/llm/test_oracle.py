import pytest

from checks import compare
from mailgrade.llm.queries import ORACLE, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_as_sql(spark, sf_dir, name):
    assert compare.differences(QUERIES[name](spark, sf_dir), compare.connect(sf_dir), ORACLE[name]) == []


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_one_row_or_more_per_input_row(spark, sf_dir, name):
    table, key = ("pages", "page_id") if name.startswith(("op1_", "op11_")) else ("documents", "doc_id")
    given = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    got = QUERIES[name](spark, sf_dir)
    assert got.select(key).distinct().count() == given.count()
