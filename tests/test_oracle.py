"""Every registered query against its DuckDB oracle on the smallest driver tables."""

import pytest

import __spark_entry__ as E
from conftest import SF_SMALL
from oracle_harness import compare

SQL = E.oracle_sql()
QUERIES = E.queries()


def test_every_query_has_a_callable_and_sql_keys_exist():
    assert set(SQL) <= set(QUERIES)
    assert len(QUERIES) >= 100


TYPES = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_oracle(spark, duck, name):
    df = QUERIES[name](spark, SF_SMALL)
    res = compare(df, duck, SQL[name])
    assert res["ok"], res
    db_types = {d[0]: str(d[1]) for d in duck.execute(SQL[name]).description}
    assert {k: TYPES.get(v, v) for k, v in df.dtypes} == db_types


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_rows_only_queries_run(spark, name):
    assert QUERIES[name](spark, SF_SMALL).count() > 0


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert "chosen_alt" in df.columns
