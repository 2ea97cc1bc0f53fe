"""Every query of the library against DuckDB on the smallest tables."""

import duckdb
import pytest

import __spark_entry__
from sieveline.plans.oracle import ORACLE_SQL
from sieveline.plans.queries import QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "events documents embeddings benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def plain(df):
    fix = lambda v: None if v is None or v != v else round(v, 6) + 0.0 if isinstance(v, float) else str(v)
    return sorted(tuple(map(str, map(fix, r))) for r in df[sorted(df.columns)].itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_equals_duckdb(spark, duck, name):
    got, want = QUERIES[name](spark, DATA).toPandas(), duck.execute(ORACLE_SQL[name]).df()
    assert len(want)  # two empty results would say nothing
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_gives_rows(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", ["rerank_plugin", "rerank_lexical"])
def test_texts_that_were_not_found_are_not_shuffled(spark, name):
    """The short list is what is sent to the documents, whose texts stay where they are read, also where only small tables are sent."""
    key, old = "spark.sql.autoBroadcastJoinThreshold", spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set(key, "128k")
    try:
        plan = QUERIES[name](spark, "/root/testdata/sf0.01")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set(key, old)
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
