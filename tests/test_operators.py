"""Small cases with known results."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sieveline.functions.scoring import FACTORS
from sieveline.operators import evaluate, fusion, labels, learn, lexical, plugins, store, vector
from sieveline.operators.ranking import ranked
from sieveline.plans import queries

M1 = dict(zip(FACTORS, (1.2, 1.0, 1.2, 1.0, 1.0, 1.1), strict=True))


def test_bm25_repairs_negative_idf(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "a c"), (3, "a d d")], "doc_id long, text string")
    index = lexical.bm25_index(docs, F.split("text", " "))
    idf = {r.term: r.idf for r in index.terms.collect()}
    raw = {"a": np.log(0.5) - np.log(3.5), **{t: np.log(2.5) - np.log(1.5) for t in "bcd"}}
    assert idf["a"] == pytest.approx(0.25 * np.mean(list(raw.values())))
    assert idf["b"] == pytest.approx(raw["b"])
    asked = spark.createDataFrame([(7, "d d b")], "query_id long, text string")
    best = lexical.bm25_search(index, asked, F.split("text", " ")).collect()
    assert [(r.doc_id, r.rank) for r in best] == [(3, 1), (1, 2)]


def test_ties_go_to_the_smaller_id(spark):
    rows = spark.createDataFrame([(1, d, 0.5) for d in (9, 3, 5)], "query_id long, doc_id long, score double")
    assert [r.doc_id for r in ranked(rows, 2).orderBy("rank").collect()] == [3, 5]


def test_vector_search_matches_numpy(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(60, 8))
    docs = spark.createDataFrame([(i, [float(x) for x in v[i]]) for i in range(60)] + [(99, None)], "doc_id long, v array<double>").repartition(5)
    asked = docs.filter("doc_id < 4").select(F.col("doc_id").alias("query_id"), F.col("doc_id").alias("own"), "v")
    got = vector.vector_search(docs, asked, 5, block=3, row_block=20).collect()
    away = vector.vector_search(docs, asked, 5, "l2", skip_self=True, row_block=7).collect()
    for q in range(4):
        s = v @ v[q] / np.linalg.norm(v, axis=1) / np.linalg.norm(v[q])
        assert [r.doc_id for r in sorted(got, key=lambda r: r.rank) if r.query_id == q] == np.argsort(-s)[:5].tolist()
        far = np.linalg.norm(v - v[q], axis=1)
        assert [r.doc_id for r in sorted(away, key=lambda r: r.rank) if r.query_id == q] == np.argsort(far)[1:6].tolist()


@pytest.mark.parametrize(("alpha", "top"), [(0.7, 10), (0.5, 10), (0.1, 3), (0.9, 400)])
def test_top_of_weighted_fusion_needs_no_complete_rankings(spark, alpha, top):
    """Lists with hundreds of positive scores, a few, none, and negative ones, against both complete rankings."""
    rng = np.random.default_rng(4)
    v = rng.normal(size=(300, 6)) * rng.uniform(0.2, 3, (300, 1))
    docs = spark.createDataFrame([(3 * i, [float(x) for x in v[i]]) for i in range(300)] + [(1000, [0.0] * 6), (1001, None)], "doc_id long, v array<double>").repartition(3)
    asked = docs.filter("doc_id in (0, 300, 600, 900)").unionByName(docs.filter("doc_id in (3, 6)")).select(F.col("doc_id").alias("query_id"), "v")
    lex = [(0, 3 * int(i), float(rng.integers(1, 30))) for i in rng.permutation(300)[:250]] + [(300, 9, 2.0), (300, 30, -1.0), (300, 33, -1.0), (300, 1000, 1.0), (3, 3, -0.5), (3, 0, 0.5), (3, 9999, 7.0)]
    counts = {}
    got = fusion.weighted_rrf_search(docs, asked, spark.createDataFrame(lex, "query_id long, doc_id long, score double"), alpha, top=top, counts=counts).collect()
    ids = [3 * i for i in range(300)] + [1000]
    rows, known = dict(zip(ids, [*v, np.zeros(6)], strict=True)), {(q, i): s for q, i, s in lex}
    want = []
    for q in (0, 300, 3, 6, 600):
        place = lambda score: {i: n for n, i in enumerate(sorted(ids, key=lambda i: (-round(score(i), 9), i)), 1)}
        rv, rl = place(lambda i: float(rows[i] @ rows[q])), place(lambda i: known.get((q, i), 0.0))  # noqa: B023
        best = sorted(((round(alpha / (60 + rv[i]) + (1 - alpha) / (60 + rl[i]), 9), i) for i in ids), key=lambda x: (-x[0], x[1]))[:top]
        want += [(q, n, i, s) for n, (s, i) in enumerate(best, 1)]
    assert sorted((r.query_id, r.rank, r.doc_id, round(r.score, 9)) for r in got) == sorted(want)
    if top < 100:
        assert counts["ranked"] < 0.5 * 5 * len(ids) and counts["rounds"] <= 5


def test_index_is_kept_while_documents_come_and_go(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"a w{i % 7} w{i % 3} x{i}") for i in range(40)], "doc_id long, text string")
    cut = lambda: F.split("text", " ")
    index = lexical.bm25_index(docs.filter("doc_id < 30"), cut())
    index = lexical.changed(index, docs.filter("doc_id >= 30"), cut(), docs.filter("doc_id % 4 = 0"))
    index = lexical.changed(index, docs.filter("doc_id = 5").withColumn("text", F.lit("w1 w1 new")), cut())
    lexical.saved(index, str(tmp_path / "index"))
    now = docs.filter("doc_id >= 30 or (doc_id % 4 <> 0 and doc_id <> 5)").unionByName(spark.createDataFrame([(5, "w1 w1 new")], "doc_id long, text string"))
    asked = spark.createDataFrame([(1, "w1 new a"), (2, "x35 x32 w2")], "query_id long, text string")
    rows = lambda ix: sorted((r.query_id, r.rank, r.doc_id, round(r.score, 9)) for r in lexical.bm25_search(ix, asked, cut()).collect())
    assert rows(index) == rows(lexical.bm25_index(now, cut())) == rows(lexical.loaded(spark, str(tmp_path / "index")))


def test_ivf_recall(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(300, 16)) + 4 * rng.normal(size=(10, 16))[np.arange(300) % 10]
    docs = spark.createDataFrame([(i, [float(x) for x in v[i]]) for i in range(300)], "doc_id long, v array<double>")
    asked = docs.filter("doc_id % 30 = 0").withColumnRenamed("doc_id", "query_id")
    exact = {(r.query_id, r.doc_id) for r in vector.vector_search(docs, asked, 5).collect()}
    found = {(r.query_id, r.doc_id) for r in vector.ivf_search(docs, asked, 5, cells=8, probes=4).collect()}
    assert len(exact & found) >= 0.9 * len(exact)


def test_ivf_query_recall_on_the_given_vectors(spark):
    for sf in ("sf0.001", "sf0.1"):
        d = f"/root/testdata/{sf}"
        exact = {(r.query_id, r.doc_id) for r in vector.vector_search(queries.vectors(spark, d), queries.asked(spark, d), 10).collect()}
        found = {(r.query_id, r.doc_id) for r in queries.ivf_topk(spark, d).collect()}
        assert len(exact & found) >= 0.9 * len(exact), len(exact & found) / len(exact)


def test_product_quantisation_recall_of_every_configuration(spark):
    got = {(r.partitions, r.sub_vectors): r.recall for r in queries.index_sweep(spark, "/root/testdata/sf0.1").collect()}
    assert set(got) == {(16, 16), (32, 16), (64, 32), (128, 64)}
    assert min(got.values()) >= 0.9, got


def test_pairs_above_in_blocks(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(50, 4))
    docs = spark.createDataFrame([(i, [float(x) for x in v[i]]) for i in range(50)], "id long, v array<double>")
    u = v / np.linalg.norm(v, axis=1)[:, None]
    want = {(a, b) for a in range(50) for b in range(a + 1, 50) if u[a] @ u[b] > 0.8}
    assert {(r.a, r.b) for r in vector.pairs_above(docs, 0.8, block_rows=12).collect()} == want
    zero = docs.unionByName(spark.createDataFrame([(90, [0.0] * 4), (91, None)], "id long, v array<double>"))
    assert {(r.a, r.b) for r in vector.pairs_above(zero, 0.8, block_rows=3, most_cells=4).collect()} == want
    assert vector.pairs_above(docs.filter("false"), 0.8).count() == 0


def test_fusion(spark):
    a = spark.createDataFrame([(1, 10, 0.9, 1), (1, 11, 0.8, 2)], "query_id long, doc_id long, score double, rank int")
    b = spark.createDataFrame([(1, 11, 5.0, 1)], "query_id long, doc_id long, score double, rank int")
    one = {r.doc_id: r.score for r in fusion.rrf(a, b).collect()}
    assert one == {10: pytest.approx(1 / 61), 11: pytest.approx(1 / 62 + 1 / 61)}
    zero = {r.doc_id: r.score for r in fusion.rrf(a, b, first=0).collect()}
    assert zero[10] == pytest.approx(1 / 60)
    none = b.filter("false")
    assert {r.score for r in fusion.rrf_or_first(a, none).collect()} == {0.9, 0.8}
    q = spark.createDataFrame([(10, 0.2)], "doc_id long, quality double")
    assert {r.doc_id: r.score for r in fusion.quality_weighted(a, q, half=False, default=0.5).collect()} == {10: pytest.approx(0.18), 11: pytest.approx(0.4)}
    assert fusion.quality_weighted(a, q, floor=0.3).count() == 0


def test_metrics_with_nothing_found(spark):
    ranking = spark.createDataFrame([(1, 5, 1.0, 2), (1, 6, 0.5, 11)], "query_id long, doc_id long, score double, rank int")
    rel = spark.createDataFrame([(1, 5), (1, 6), (2, 7)], "query_id long, doc_id long")
    r = evaluate.recall_mrr(ranking, rel).first()
    assert (r.queries, r.recall_1, r.recall_5, r.mrr) == (2, 0.0, 0.5, 0.25)
    m = evaluate.metric_bundle(ranking, rel).first()
    assert m.recall_10 == pytest.approx(0.25)
    assert m.ndcg_5 == pytest.approx((1 / np.log2(3)) / (1 + 1 / np.log2(3)) / 2)


def test_numbered_and_halves(spark):
    df = spark.range(0, 101).withColumn("k", F.xxhash64("id")).repartition(7)
    got = evaluate.numbered(df, F.col("id")).collect()
    assert all(r.position == r.id for r in got)
    assert evaluate.halves(df, F.col("id")).filter("old").count() == 50


def test_adaptive_golden_values():
    w = np.ones(6)
    m1, m2 = np.array([1.2, 1.0, 1.2, 1.0, 1.0, 1.1]), np.array([0.3, 1.0, 0.8, 1.0, 0.6, 1.0])
    assert learn.predict(w, m1) == 1.0
    assert learn.predict(w, m2) == pytest.approx(0.144)
    w, _ = learn.step(w, m1, 1.0)
    w, _ = learn.step(w, m2, 0.0)
    assert learn.predict(w, m2) == pytest.approx(0.1345, abs=5e-5)
    assert w[0] == pytest.approx(0.9957, abs=5e-5)
    assert w[4] == pytest.approx(0.9914, abs=5e-5)


def test_semi_adaptive_golden_values():
    f, log = np.ones(6), []
    m1, m2 = np.array([1.2, 1.0, 1.2, 1.0, 1.0, 1.1]), np.array([0.3, 1.0, 0.8, 1.0, 0.6, 1.0])
    for n in range(1, 41):
        f, new = learn.careful_step(f, n, m1 if n % 2 else m2, float(n % 2))
        log += new
    assert learn.predict(f, m2) == pytest.approx(0.0915, abs=5e-5)
    assert f[:3] == pytest.approx([0.9722, 0.9074, 0.9259], abs=5e-5)
    assert not log


def test_weights_clamp_and_alias(spark):
    rows = [("a" if i % 2 else "b", i, 0.0, *[2.0] * 6) for i in range(60)]
    df = spark.createDataFrame(rows, "domain string, seq long, feedback double, " + ", ".join(f"{k} double" for k in FACTORS))
    got = {r.domain: r for r in learn.adaptive_weights(df).collect()}
    assert {d: r.events for d, r in got.items()} == {"a": 30, "b": 30}
    assert all(0.1 <= got["a"][k] <= 2.0 for k in FACTORS)
    assert [r.events for r in learn.adaptive_weights(df, alias_domains=True).collect()] == [60]
    log = learn.careful_weights(df, log=True)
    assert learn.pending_reviews(log).filter("not requires_review").count() == 0
    back = learn.rolled_back(learn.careful_weights(df), log.filter("domain = 'a' and feature = 'type'")).filter("domain = 'a'").first()
    assert back["type"] == 1.0


def test_reply_lookup_skips_first_turn_and_far_ones(spark):
    long = "the memory of a paragraph that is long enough to count"
    turns = [(1, 0, "assistant", long), (1, 1, "user", "q1"), (2, 0, "user", "x"), (2, 1, "assistant", long + "\nshort"), (2, 2, "user", "q2"), (2, 3, "user", "q3"), (2, 4, "user", "<t>"), (2, 5, "user", "q5"), (2, 6, "user", "q6")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    got = labels.query_memory_pairs(df)
    assert sorted(r.query for r in got.collect()) == ["q2", "q3", "q5"]
    tasks = labels.label_tasks(got)
    assert sorted(r.task_id for r in tasks.collect()) == ["task_0", "task_1", "task_2"]
    auto = labels.auto_label(tasks.drop("label"), ["Memory", "q2"])
    assert {r.confidence for r in auto.collect()} == {"low"}
    manual = spark.createDataFrame([("task_1", 1)], "task_id string, manual_label int")
    assert [r.task_id for r in labels.merged_labels(auto, manual).collect()] == ["task_1"]
    numbered = tasks.select(F.substring_index("task_id", "_", -1).cast("int").alias("position"), "label")
    assert {r.position: r.label for r in labels.batch_applied(numbered, "01", 1).collect()} == {0: None, 1: 0, 2: 1}


def test_store(spark):
    rows = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "c")], "id long, seq long, x string")
    assert {r.id: r.x for r in store.latest(rows, "id", "seq").collect()} == {1: "b", 2: "c"}
    paths = spark.createDataFrame([("/a/b",), ("/a/c/",)], "path string")
    dirs = {r.path: r.parent for r in store.directories(paths).collect()}
    assert dirs == {"/a": "", "/a/b": "/a", "/a/c": "/a"}
    empty = rows.filter("false").withColumn("q", F.lit(0.5)).withColumn("content", F.lit(""))
    assert store.retention(empty, "q").first().rate == 0.0
    assert store.store_stats(empty).first().total_memories == 0


def test_plugins_fail_softly(spark):
    def broken(*_):
        raise RuntimeError

    df = spark.createDataFrame([("a b", "a"), (None, None)], "q string, d string")
    assert [r.x for r in df.select(plugins.pair_scored(F.col("q"), F.col("d"), broken).alias("x")).collect()] == [0.5, 0.5]
    assert [r.x for r in df.select(plugins.encoded(F.col("q"), broken).alias("x")).collect()] == [None, None]
    assert [r.x for r in df.select(plugins.summarised(F.col("q"), broken, 1).alias("x")).collect()] == ["a", None]
    assert len(df.select(plugins.encoded(F.col("q")).alias("x")).first().x) == 64


@pytest.mark.parametrize(("spread", "threshold"), [(0.05, 0.9), (0.5, 0.6), (5.0, 0.2)])
def test_links_equal_all_pairs(spark, spread, threshold):
    """Tight groups, one with a third of all rows; loose ones; none: counts and classes as from the whole table of pairs."""
    rng = np.random.default_rng(8)
    own = np.where(rng.random(400) < 1 / 3, 0, rng.integers(0, 30, 400))
    v = rng.normal(size=(30, 24))[own] + spread * rng.normal(size=(400, 24))
    rows = [(int(i) * 7, [float(x) for x in v[i]]) for i in range(400)] + [(1, None), (2, [0.0] * 24)]
    got = {r.id: (r.n_links, r.class_id) for r in vector.links_above(spark.createDataFrame(rows, "id long, v array<double>").repartition(3), threshold, block_rows=60, most_cells=6).collect()}
    u = v / np.linalg.norm(v, axis=1)[:, None]
    links = (u @ u.T > threshold) & ~np.eye(400, dtype=bool)
    low = vector._smallest_reached(links)
    assert got == {7 * i: (int(links[i].sum()), 7 * int(low[i])) for i in range(400)} | {1: (0, 1), 2: (0, 2)}


def test_prefix_bounds_leave_out_no_pair():
    rng = np.random.default_rng(2)
    for scale in (0.01, 0.3, 1.0):
        v = rng.normal(size=(200, 64)) * scale ** np.arange(64)[None, :] ** 0.5
        v /= np.linalg.norm(v, axis=1)[:, None]
        for threshold in (0.1, 0.7, 0.999):
            assert (vector.joined_above(v[:120], v[120:], threshold, 8) == (v[:120] @ v[120:].T > threshold)).all()


def test_smallest_reached_on_long_paths(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100 + i, 100 + (i * 7 + 1) % 50) for i in range(50)] + [(205, 201), (203, 205)]
    got = {r.id: r.class_id for r in vector.smallest_reached(spark.createDataFrame(edges, "a long, b long")).collect()}
    up = {x: x for e in edges for x in e}
    for _ in range(300):
        for a, b in edges:
            up[a] = up[b] = min(up[a], up[b])
    assert got == up


def test_relevance_by_label_needs_no_pairs_of_all_rows(spark):
    rng = np.random.default_rng(3)
    rows = spark.createDataFrame([(i, int(rng.integers(0, 4)) if i else 9) for i in range(60)], "doc_id long, label int")
    asked = rows.filter("doc_id % 10 = 0").selectExpr("doc_id div 10 as query_id", "doc_id as own", "label")
    top = spark.createDataFrame([(q, int(i), r + 1, 1.0 / (r + 1)) for q in range(6) for r, i in enumerate(rng.permutation(60)[:12])], "query_id long, doc_id long, rank int, score double")
    every = asked.join(rows, "label").filter("own <> doc_id").select("query_id", "doc_id")
    rel, sizes = evaluate.same_label(top, asked, rows)
    assert rel.count() < every.count()
    assert evaluate.metric_bundle(top, rel, sizes=sizes).first().asDict() == pytest.approx(evaluate.metric_bundle(top, every).first().asDict())
    assert evaluate.recall_mrr(top, rel, queries=sizes).first().asDict() == pytest.approx(evaluate.recall_mrr(top, every).first().asDict())


def test_a_failing_model_loses_single_rows_only(spark):
    def picky(texts):
        if any("bad" in t for t in texts):
            raise ValueError
        return [[float(len(t))] for t in texts]

    rows = spark.createDataFrame([(i, "bad" if i % 5 == 0 else "x" * i) for i in range(20)], "id long, text string").coalesce(1)
    got = {r.id: r.v for r in rows.select("id", plugins.encoded(F.col("text"), picky).alias("v")).collect()}
    assert got == {i: None if i % 5 == 0 else [float(i)] for i in range(20)}


def test_judge(spark):
    rows = spark.createDataFrame([(1, "q", ["aa", "bb"], ["x aa", "bb"]), (2, "q", ["aa", "bb"], ["x aa"]), (3, "q", ["aa"], []), (4, None, None, None), (5, "q", ["yy"], ["x" * 1000 + "yy"])], "id long, q string, e array<string>, f array<string>")
    verdict = lambda judge: {r.id: r.v for r in rows.select("id", queries.X.parsed_verdict(plugins.judged(F.col("q"), F.col("e"), F.col("f"), judge)).alias("v")).collect()}
    assert verdict(plugins.word_judge) == {1: "success", 2: "partial", 3: "fail", 4: "fail", 5: "fail"}

    def broken(*_):
        raise OSError

    assert set(verdict(broken).values()) == {"fail"}


def test_paired_intervals_equal_numpy(spark):
    import hashlib

    rng = np.random.default_rng(5)
    hits = lambda: [(q, int(x) if x else None) for q, x in enumerate(rng.integers(0, 14, 40))]
    a, b = hits(), hits()
    frame = lambda rows: spark.createDataFrame(rows, "query_id long, hit int")
    got = {r.metric: r for r in evaluate.paired_intervals(frame(a), frame(b), lanes=80, seed=3).collect()}
    u = np.array([[int(hashlib.md5(f"3:{q}:{lane}".encode()).hexdigest()[:13], 16) / 16**13 for q in range(40)] for lane in range(80)])
    w = (u[..., None] >= np.array(evaluate.POISSON)).sum(-1)
    assert 0.9 < w.mean() < 1.1 and 0.8 < w.var() < 1.2
    gain = {f"recall_{k}": lambda h, k=k: float(h is not None and h <= k) for k in (1, 5, 10)} | {"mrr": lambda h: 1 / h if h and h <= 10 else 0.0}
    for m, f in gain.items():
        d = np.array([f(y) - f(x) for (_, x), (_, y) in zip(a, b, strict=True)])
        lanes = np.sort(100 * (w * d).sum(1) / w.sum(1))
        assert (got[m].delta, got[m].low, got[m].high) == pytest.approx((100 * d.mean(), lanes[2], lanes[77]))
    assert evaluate.paired_intervals(frame([]), frame([])).count() == 0
