"""Correctness gate: every registered query vs its DuckDB oracle on the sf0.001 tables."""

import pytest

from tests.oracle_harness import compare, duck
from tallyframe.plans.catalog import oracle_queries, spark_queries

SF = "/root/testdata/sf0.001"
QUERIES = spark_queries()
SQLS = oracle_queries()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_every_query_has_an_oracle():
    assert set(QUERIES) - set(SQLS) == set()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, name):
    sp = QUERIES[name](spark, SF).toPandas()
    dk = con.execute(SQLS[name]).df()
    assert compare(sp, dk) is None


def test_entry_contract(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.count() > 0
    assert df.columns == ["venue", "type", "bets", "turnover", "pnl", "players", "avg_bet", "platform_pnl",
                          "hold_pct", "share_pct"]
    assert set(QUERIES) <= set(E.queries()) and set(QUERIES) <= set(E.oracle_sql())
