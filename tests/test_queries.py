import pytest

import __spark_entry__ as entry
from tests.compare import duck_rows, rows_of
from tomeflow.plans.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_as_sql(spark, small, name):
    assert rows_of(QUERIES[name](spark, small)) == duck_rows(ORACLE_SQL[name], small)


def test_queries_without_sql_run(spark, small):
    for name in set(QUERIES) - set(ORACLE_SQL):
        assert QUERIES[name](spark, small).count() > 0


def test_entry_has_the_expected_chunks(spark, small):
    found = entry.entry(spark)
    assert found.columns == ["chunk_id", "doc_id", "title", "domain", "text", "start", "end"]
    assert found.count() > 0


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
