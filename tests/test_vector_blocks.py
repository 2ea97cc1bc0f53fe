"""Vector work in blocks: inverted-file search without a row for each pair, links without a row for each pair of blocks."""

import re

import numpy as np
import pytest

from sieveline.operators import vector


def frame(spark, v, kind="double"):
    return spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], f"doc_id long, v array<{kind}>").repartition(3)


@pytest.mark.parametrize("block", [7, 1 << 14])
def test_ivf_is_exact_in_blocks_of_any_size(spark, monkeypatch, block):
    """Unclustered vectors, and one that forty rows share: ties go to the smaller id. No join makes a row for each pair."""
    rng = np.random.default_rng(5)
    v = rng.normal(size=(260, 12))
    v[100:140] = v[3]
    docs = frame(spark, v).unionByName(spark.createDataFrame([(900, None), (901, [0.0] * 12)], "doc_id long, v array<double>"))
    asked = docs.filter("doc_id % 20 = 3 or doc_id > 899").selectExpr("doc_id as query_id", "v")
    monkeypatch.setattr(vector, "ROW_BLOCK", block)
    monkeypatch.setattr(vector, "QUERY_BLOCK", 5)
    rows = lambda df: sorted((r.query_id, r.rank, r.doc_id, round(r.score, 9)) for r in df.collect())
    found = vector.ivf_search(docs, asked, 10, cells=8, probes=2)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapCoGroups" in plan and "cell#" not in "".join(x for x in plan.split("\n") if "Join" in x)
    assert rows(found) == rows(vector.vector_search(docs, asked, 10, row_block=1 << 14))


def test_slots_hold_all_cells():
    sizes = np.array([3, 0, 5, 25, 2, 9, 10, 1])
    first, parts, n = vector._slots(sizes, 10)
    assert parts.tolist() == [1, 1, 1, 3, 1, 1, 1, 1] and n == first.max() + 1
    held = np.zeros(n)
    for f, p, s in zip(first, parts, sizes, strict=True):
        held[f : f + p] += -(-s // p)
    assert held.max() <= 10


@pytest.mark.parametrize("threshold", [-2.0, 0.3, 0.8, 1.1])
def test_links_of_blocks_equal_the_table(threshold):
    rng = np.random.default_rng(6)
    v = rng.normal(size=(90, 20))
    v[rng.permutation(90)[:30]] = v[0]
    v /= np.linalg.norm(v, axis=1)[:, None]
    order = rng.permutation(90)
    left, right = np.sort(order[:50]), np.sort(order[50:])
    cross = np.zeros((90, 90), bool)
    cross[np.ix_(left, right)] = v[left] @ v[right].T > threshold
    cross |= cross.T
    n, low = vector.block_links(v[left], v[right], (left, right), threshold, step=16)
    assert (n == cross.sum(1)).all() and (low == vector._smallest_reached(cross)).all()
    own = (v @ v.T > threshold) & ~np.eye(90, dtype=bool)
    n, low = vector.block_links(v, None, (np.arange(90), np.zeros(0, np.int64)), threshold, step=16)
    assert (n == own.sum(1)).all() and (low == vector._smallest_reached(own)).all()


def test_links_are_a_row_for_each_row(spark, monkeypatch):
    """Before classes are made: a row for each row with links, however many pairs of blocks met; few edges, though all are linked."""
    rng = np.random.default_rng(7)
    v = 1 + 0.1 * rng.normal(size=(300, 8))
    kept, own = {}, vector.written

    def keeping(df, what):
        out = own(df, what)
        kept.setdefault(what, out)
        return out

    monkeypatch.setattr(vector, "written", keeping)
    got = vector.links_above(frame(spark, v, "float").withColumnRenamed("doc_id", "id"), 0.5, block_rows=25, most_cells=12)
    assert {(r.n_links, r.class_id) for r in got.collect()} == {(299, 0)} and got.count() == 300
    assert kept["links"].count() == 300 and kept["edges"].count() < 300
    assert dict(kept["cells"].dtypes)["v"] == "array<float>"  # vectors are shipped as they come


def test_a_task_holds_few_groups_however_many_there_are(spark):
    rng = np.random.default_rng(9)
    docs = frame(spark, rng.normal(size=(120, 6)))
    asked = docs.filter("doc_id % 10 = 0").selectExpr("doc_id as query_id", "doc_id as own", "v")
    rows = lambda df: [(r.query_id, r.doc_id, r.rank) for r in df.orderBy("query_id", "rank").collect()]
    many, one = vector.vector_search(docs, asked, 4, skip_self=True, row_block=10), vector.vector_search(docs, asked, 4, skip_self=True)
    plan = many._jdf.queryExecution().executedPlan().toString()
    assert re.findall(r"hashpartitioning\(i#\d+, j#\d+, (\d+)\)", plan) == ["24", "24"]
    assert rows(many) == rows(one) and len(rows(many)) == 48
