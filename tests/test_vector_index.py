"""The stored vector index: recall against the exact search with a tenth of the rows, growth, what is opened, odd rows."""

import numpy as np
import pytest

from sieveline.operators import vector, vector_index


def clustered(spark, n=4000, dims=32, seed=3):
    """Vectors around 80 centres, of which 30 lie close to one another and have a third of all."""
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(80, dims))
    centre[:30] = centre[0] + 0.7 * rng.normal(size=(30, dims))
    own = np.where(rng.random(n) < 1 / 3, rng.integers(0, 30, n), rng.integers(30, 80, n))
    v = centre[own] + 0.35 * rng.normal(size=(n, dims))
    return v, spark.createDataFrame([(i, [float(x) for x in v[i]]) for i in range(n)], "doc_id long, v array<double>").repartition(4)


def pairs(df):
    return {(r.query_id, r.doc_id) for r in df.collect()}


def test_recall_with_a_tenth_of_the_rows(spark, tmp_path):
    _, docs = clustered(spark)
    index = vector_index.built(docs.filter("doc_id % 4 > 0"), str(tmp_path / "index"), cells=200, subs=8, words=64, sample=2000)
    before = {p for p in (tmp_path / "index" / "rows").rglob("*.parquet")}
    index = vector_index.added(index, docs.filter("doc_id % 4 = 0"))
    assert before < {p for p in (tmp_path / "index" / "rows").rglob("*.parquet")}  # files come, none goes
    asked = docs.filter("doc_id % 40 = 0").selectExpr("doc_id as query_id", "doc_id as own", "v")
    exact, counts = pairs(vector.vector_search(docs, asked, 5, skip_self=True)), {}
    found = pairs(vector_index.search(vector_index.opened(spark, str(tmp_path / "index")), asked, 5, share=0.1, skip_self=True, counts=counts))
    assert len(found & exact) >= 0.9 * len(exact)
    assert counts["scored"] <= 0.1 * counts["rows"] and counts["rows"] == 4000 * 100
    few = asked.filter("query_id = 0")
    vector_index.search(index, few, 5, share=0.02, counts=counts)
    assert counts["partitions"] < 40


def test_only_visited_partitions_are_opened(spark, tmp_path):
    _, docs = clustered(spark, 600)
    index = vector_index.built(docs, str(tmp_path / "index"), cells=20, subs=4, words=16)
    plan = index.rows().filter("cell in (3, 5)").select("doc_id", "code", "cell")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [cell" in plan and "ReadSchema: struct<doc_id:bigint,code:binary>" in plan
    assert {r.cell for r in index.rows().filter("cell in (3, 5)").select("cell").distinct().collect()} <= {3, 5}


def test_all_cells_and_a_wide_funnel_are_exact(spark, tmp_path):
    _, docs = clustered(spark, 500)
    index = vector_index.built(docs, str(tmp_path / "index"), cells=10, subs=8, words=256)
    asked = docs.filter("doc_id < 5").withColumnRenamed("doc_id", "query_id")
    rows = lambda df: sorted((r.query_id, r.rank, r.doc_id) for r in df.collect())
    assert rows(vector_index.search(index, asked, 10, share=1.0, refine=50)) == rows(vector.vector_search(docs, asked, 10))


def test_tables_of_whole_numbers():
    rng = np.random.default_rng(1)
    q, books, parts = rng.normal(size=(7, 12)), tuple(rng.normal(size=(9, 4)) for _ in range(3)), tuple(np.array_split(np.arange(12), 3))
    table, step, nought = vector_index.tables(q, books, parts)
    codes = rng.integers(0, 9, (50, 3))
    got = sum(t[:, codes[:, p]] for p, t in enumerate(table)) * step[:, None] + nought[:, None]
    want = sum((q[:, p] @ b.T)[:, codes[:, i]] for i, (p, b) in enumerate(zip(parts, books, strict=True)))
    assert np.abs(got - want).max() <= 3 * step.max()
    assert all(t.dtype == np.int32 and t.min() >= 0 and t.max() <= vector_index.FINE for t in table)


@pytest.mark.parametrize("share", [0.0, 0.3, 1.0])
def test_visits(share):
    near, sizes = np.array([[2, 0, 1, 3], [3, 1, 0, 2]]), np.array([10, 20, 70, 0])
    got = vector_index.visited(near, sizes, share)
    assert got[0].tolist() == {0.0: [True, False, False, False], 0.3: [True, False, False, False], 1.0: [True, True, True, False]}[share]
    assert got[1].tolist() == {0.0: [False, True, False, False], 0.3: [False, True, True, False], 1.0: [False, True, True, True]}[share]


def test_odd_vectors(spark, tmp_path):
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, v array<double>")
    asked = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0])], "query_id long, v array<double>")
    nothing = vector_index.built(frame([]), str(tmp_path / "a"))
    assert vector_index.search(nothing, asked).count() == 0
    index = vector_index.built(frame([(1, [2.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [1.0, 1.0]), (5, [1.0, 1.0])]), str(tmp_path / "b"), cells=2)
    assert [(r.query_id, r.doc_id) for r in vector_index.search(index, asked, 3, share=1.0).orderBy("rank").collect()] == [(1, 1), (1, 4), (1, 5)]
    assert vector_index.search(index, asked.filter("false")).count() == 0


def test_all_cells_are_exact_with_a_narrow_funnel(spark, tmp_path):
    """Without clusters codes say little, and more rows than the funnel holds are the same: still the exact best, ties to the smaller id."""
    rng = np.random.default_rng(11)
    v = rng.normal(size=(600, 24))
    v[200:300] = v[7]
    docs = spark.createDataFrame([(i, [float(np.float32(x)) for x in v[i]]) for i in range(600)] + [(900, [0.0] * 24), (901, None)], "doc_id long, v array<double>").repartition(4)
    index = vector_index.built(docs, str(tmp_path / "index"), cells=10, subs=4, words=8)
    asked = docs.filter("doc_id % 50 = 7 or doc_id >= 900").selectExpr("doc_id as query_id", "doc_id as own", "v")
    rows = lambda df: sorted((r.query_id, r.rank, r.doc_id, round(r.score, 9)) for r in df.collect())
    for own in (False, True):
        assert rows(vector_index.search(index, asked, 10, share=1.0, refine=1, skip_self=own)) == rows(vector.vector_search(docs, asked, 10, skip_self=own))


def test_all_cells_keep_the_funnel_for_each_block_of_rows(spark, tmp_path):
    """With every cell visited no cell is a group of its own, which would hand on all its rows for each query."""
    _, docs = clustered(spark, 500)
    index = vector_index.built(docs, str(tmp_path / "index"), cells=100, subs=4, words=16)
    asked, counts = docs.filter("doc_id % 100 = 0").withColumnRenamed("doc_id", "query_id"), {}
    known = []
    own = vector_index.written
    try:
        vector_index.written = lambda df, what: known.append((what, own(df, what))) or known[-1][1]
        found = vector_index.search(index, asked, 2, share=1.0, refine=3, counts=counts)
    finally:
        vector_index.written = own
    assert dict(known)["probes"].count() == 5  # a row a query, not one for each of its cells
    assert found.count() == 10 and counts["scored"] == counts["rows"] == 500 * 5
