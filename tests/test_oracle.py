"""Every registered query with an oracle: Spark result == DuckDB SQL result
(row count, columns, order-insensitive value hash) on the smallest scale."""
import pytest

import __spark_entry__ as E
from moundflow.plans.compare import compare, duck_connection

SQLS = E.oracle_sql()
QUERIES = E.queries()


@pytest.fixture(scope="module")
def con(small_dir):
    return duck_connection(small_dir)


@pytest.mark.parametrize("name", sorted(SQLS))
def test_query_matches_oracle(spark, con, small_dir, name):
    got = QUERIES[name](spark, small_dir).toPandas()
    want = con.execute(SQLS[name]).df()
    ok, msg = compare(got, want)
    assert ok, f"{name}: {msg}"


def test_every_query_has_spark_side():
    assert set(SQLS) <= set(QUERIES)


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert "vulnerability_score" in df.columns
