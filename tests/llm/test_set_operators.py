"""Exact and near copies, embeddings, mixing, classifiers, pipeline: against brute force on small tables."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sieveline.llm import embedding_dedup, minhash_dedup, mixing, quality_rules, toxicity
from sieveline.llm.components import components
from sieveline.llm.exact_dedup import exact_dedup
from sieveline.llm.labelled import held_out, training_rows
from sieveline.llm.mixing import pfair_mix, schedule
from sieveline.llm.queries import op3_toxicity, op5_exact_dedup, op6_e8_lattice, op10_quality_rules

DATA = "/root/testdata/sf0.001"
lower = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


@pytest.mark.parametrize(("keep", "slice_rows"), [("min", None), ("max", 3)])
def test_exact_dedup_equals_grouping(spark, keep, slice_rows):
    rnd = random.Random(1)
    texts = [None, "", "ÄB", "äB", "Äb", "hot " * 40, "HOT " * 40, *("x" * 64 + rnd.choice("ab") + "y" * 64 for _ in range(40)), *(rnd.choice(["hot " * 40, "cold", "Cold"]) for _ in range(200))]
    rows = [(i, t, i % 3) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept int").repartition(6)
    got = exact_dedup(docs, keep=keep, slice_rows=slice_rows).collect()
    groups = defaultdict(list)
    for i, t, _ in rows:
        groups[lower(t)].append(i)
    best = min if keep == "min" else max
    assert len(got) == len(rows)
    for r in got:
        own = groups[lower(texts[r.doc_id])]
        assert (r.keep_id, r.group_size, r.kept) == (best(own), len(own), r.doc_id == best(own))


def test_exact_dedup_repeated_rows_and_empty(spark):
    docs = spark.createDataFrame([(1, "a"), (1, "a"), (None, "b"), (None, "a")], "doc_id long, text string")
    got = exact_dedup(docs, keep="min").collect()
    assert sum(r.kept for r in got if r.text == "a") == 1
    assert sum(r.kept for r in got if r.text == "b") == 1
    assert exact_dedup(docs.filter("false")).count() == 0


def test_components_of_long_paths(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100 + i, 100) for i in range(1, 30)] + [(200, 200), (305, 301), (303, 305), (302, 303)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r.id: r.component for r in components(df, "a", "b").collect()}
    assert got == {**dict.fromkeys(range(61), 0), **dict.fromkeys(range(100, 130), 100), **dict.fromkeys([301, 302, 303, 305], 301)}
    assert components(df.filter("false"), "a", "b").count() == 0


def classes_by_force(rows):
    shingler = minhash_dedup.Shingler()
    labels = [(i, shingler.labels(shingler.words(t or ""))) for i, t in rows]
    up = {i: i for i, _ in rows}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for k, (i, a) in enumerate(labels):
        for j, b in labels[:k]:
            if minhash_dedup.similarity(a, b) >= 0.8:
                x, y = sorted((top(i), top(j)))
                up[y] = x
    return {i: top(i) for i, _ in rows}


@pytest.mark.parametrize("block_rows", [400, 7])
def test_near_classes_equal_all_pairs(spark, block_rows):
    rnd = random.Random(2)
    words = [f"w{i}" for i in range(400)]
    rows, n = [(9000, None), (9001, ""), (9002, "a b"), (9003, "A  b"), (9004, "a c")], 0
    for _ in range(12):
        base = [rnd.choice(words) for _ in range(rnd.choice([6, 30, 120, 400]))]
        for _ in range(rnd.randint(1, 8)):
            own = list(base)
            for _ in range(rnd.randint(0, max(1, len(own) // 25))):
                own[rnd.randrange(len(own))] = rnd.choice(words)
            rows.append((n * 2, " ".join(own)))
            n += 1
    rows.append((8000, " ".join(["same"] * 300)))
    rows.append((8001, " ".join(["same"] * 310)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = minhash_dedup.near_classes(docs, block_rows=block_rows).collect()
    assert {r.id: r.class_id for r in got} == classes_by_force(rows)
    assert [r.id == r.class_id for r in got] == [r.stays for r in got]


def test_large_cluster_in_rounds(spark):
    """Two crossing families in one cluster, far beyond a block: what no single text settles is compared in full."""
    rnd = random.Random(21)
    base = [f"w{i}" for i in range(300)]
    other = base[:150] + [f"v{i}" for i in range(150)]
    rows = []
    for k in range(120):
        own = list(base if k % 2 else other)
        for _ in range(rnd.randint(0, 6)):
            own[rnd.randrange(len(own))] = f"x{rnd.randrange(1000)}"
        rows.append((k, " ".join(own)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = classes_by_force(rows)
    assert len(set(want.values())) >= 2
    assert {r.id: r.class_id for r in minhash_dedup.near_classes(docs, block_rows=5).collect()} == want


def test_near_texts_of_null_and_shared_ids(spark):
    a, b = " ".join(f"w{i}" for i in range(80)), " ".join(f"v{i}" for i in range(80))
    near = a + " more"
    rows = [(7, a), (7, b), (9, near), (None, near + " x"), (None, b), (None, "alone"), (None, "alone"), (3, "one two"), (3, "one two"), (None, None), (5, "")]
    docs = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "doc_id long, text string, __i int, __h int, kept int").repartition(3)
    got = minhash_dedup.near_dedup(docs).collect()
    assert len(got) == len(rows)
    assert sorted(str((r.doc_id, r.text, r.class_id)) for r in got) == sorted(str((i, t, {a: 7, b: 7, near: 7, near + " x": 7, "alone": None, "one two": 3, None: 5, "": 5}[t])) for i, t in rows)
    assert sorted((str(r.doc_id), r.text) for r in got if r.kept) == sorted([("7", a), ("7", b), ("None", "alone"), ("3", "one two"), ("5", "")])


def test_order_counts(spark):
    a = [f"w{i}" for i in range(200)]
    docs = spark.createDataFrame([(1, " ".join(a)), (2, " ".join(a[100:] + a[:100])), (None, " ".join(a))], "doc_id long, text string")
    got = minhash_dedup.near_dedup(docs).collect()
    assert {r.doc_id: (r.class_id, r.kept) for r in got} == {1: (1, True), 2: (2, True), None: (1, False)}
    assert minhash_dedup.near_dedup(docs.filter("false")).count() == 0


def test_sketches_find_pairs_at_the_threshold():
    rng = np.random.default_rng(3)
    missed = 0
    for _ in range(300):
        a = rng.integers(1, 1 << 62, 180, dtype=np.uint64)
        b = np.concatenate([a[:160], rng.integers(1, 1 << 62, 20, dtype=np.uint64)])
        assert minhash_dedup.similarity(a, b) == pytest.approx(0.8)
        missed += not (minhash_dedup.sketch(a, minhash_dedup.seeds()) == minhash_dedup.sketch(b, minhash_dedup.seeds())).any()
    assert missed == 0


def test_e8_decoding_is_nearest():
    rng = np.random.default_rng(4)
    x = rng.normal(0, 2, (300, 8))
    p = embedding_dedup.nearest_e8(x)
    assert len(embedding_dedup.NEIGHBOURS) == 240
    assert np.allclose((embedding_dedup.NEIGHBOURS**2).sum(1), 2)
    d = ((x - p) ** 2).sum(1)
    for v in embedding_dedup.NEIGHBOURS:
        assert (((x - p - v) ** 2).sum(1) >= d - 1e-9).all()


def test_lattice_recall():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(3000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    for cos, least in ((0.9, 0.98), (0.95, 0.999)):
        y = rng.normal(size=x.shape)
        y -= (y * x).sum(1)[:, None] * x
        y = cos * x + np.sqrt(1 - cos * cos) * y / np.linalg.norm(y, axis=1)[:, None]
        (h, n), (g, m) = embedding_dedup.lattice_cells(x), embedding_dedup.lattice_cells(y)
        assert ((h == g) | (n == g[:, :, None]).any(2) | (m == h[:, :, None]).any(2)).any(1).mean() >= least


@pytest.mark.parametrize("block_rows", [1000, 20])
def test_embedding_links(spark, block_rows):
    rng = np.random.default_rng(6)
    base = rng.normal(size=(12, 64))
    rows = [(k, [float(x) for x in (base[k % 12] + rng.normal(size=64) * rng.choice([0, 0.1, 0.2])).astype(np.float32)]) for k in range(240)]
    rows += [(5000, None), (5001, [0.0] * 64), (5002, [float("nan")] * 64), (5003, [1.0] * 8), (5004, [2.0] * 8), (5005, []), (5006, [None] + [1.0] * 63)]
    got = {r.id: r for r in embedding_dedup.near_embeddings(spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5), block_rows=block_rows).collect()}
    v = np.array([x for _, x in rows[:240]], np.float64)
    v /= np.linalg.norm(v, axis=1)[:, None]
    s = v @ v.T >= 0.9
    np.fill_diagonal(s, False)
    links = np.array([got[k].n_links for k in range(240)])
    assert (links <= s.sum(1)).all()
    assert links.sum() >= 0.99 * s.sum()
    assert [got[k].component_id for k in range(240)] == [k % 12 for k in range(240)]
    assert [got[k].n_links for k in range(5000, 5007)] == [0, 0, 0, 1, 1, 0, 0]
    assert [got[k].kept for k in (0, 12, 5000, 5003, 5004)] == [True, False, True, True, False]
    assert embedding_dedup.near_embeddings(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def edf_by_force(shares, blocks):
    """Slots of each source's blocks: the released block with the earliest deadline, slot by slot, in whole numbers."""
    total, done, out, t = sum(shares), [0] * len(shares), [[] for _ in shares], 0
    while any(d < m for d, m in zip(done, blocks, strict=True)):
        ready = [(-(-(d + 1) * total // a), i) for i, (a, d, m) in enumerate(zip(shares, done, blocks, strict=True)) if d < m and d * total // a <= t]
        if ready:
            _, i = min(ready)
            out[i].append(t)
            done[i] += 1
        t += 1
    return out


def test_embeddings_of_null_and_shared_ids(spark):
    rng = np.random.default_rng(9)
    v, w = ([float(x) for x in rng.normal(size=64)] for _ in range(2))
    near = [x + 0.01 for x in v]
    rows = [(1, v), (None, v), (2, w), (None, near), (3, near), (3, w), (None, None), (None, [0.0] * 64), (2, w), (None, [-x for x in v]), (4, [None] + v[1:])]
    docs = spark.createDataFrame([(*r, 5) for r in rows], "vec_id long, embedding array<double>, id int").repartition(3)
    got = embedding_dedup.near_embeddings(docs).collect()
    none = lambda x: -1 if x is None else x
    assert sorted((none(r.id), r.n_links, none(r.component_id), r.kept) for r in got) == sorted(
        [(1, 3, 1, True), (-1, 3, 1, False), (2, 2, 2, True), (-1, 3, 1, False), (3, 3, 1, False), (3, 2, 2, False), (-1, 0, -1, True), (-1, 0, -1, True), (2, 2, 2, True), (-1, 0, -1, True), (4, 0, 4, True)]
    )


def test_embedding_query_against_brute_force(spark):
    d = "/root/testdata/sf0.1"
    rows = spark.read.parquet(f"{d}/embeddings.parquet").collect()
    v = np.array([r.embedding for r in rows], np.float64)
    v /= np.linalg.norm(v, axis=1)[:, None]
    s = v @ v.T >= 0.9
    np.fill_diagonal(s, False)
    got = {r.vec_id: r for r in op6_e8_lattice(spark, d).collect()}
    links = np.array([got[r.vec_id].n_links for r in rows])
    assert len(got) == len(rows) and (links <= s.sum(1)).all()
    assert links.sum() >= 0.98 * s.sum()
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())


@pytest.mark.parametrize("piece_rows", [None, 7])
def test_mixture_equals_the_simulation(spark, piece_rows):
    sizes = {None: 60, "a": 400, "b": 100, "c": 3, "d": 9}
    rows = [(i if i % 9 else None, s) for i, s in enumerate(s for s, n in sizes.items() for _ in range(n))]
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, source string, slot int")
    w = spark.createDataFrame([("a", 5.0), ("b", 2.0), (None, 3.0), ("d", float("nan")), ("zz", 4.0)], "source string, weight double")
    got = pfair_mix(docs, w, block_rows=4, piece_rows=piece_rows).collect()
    assert len(got) == len(rows) == len({r.place for r in got})
    slots = defaultdict(set)
    for r in got:
        slots[r.source].add((r.source_block, r.slot))
        assert r.place // 4 == r.slot
    by_source = {k: [s for _, s in sorted(v)] for k, v in slots.items()}
    want = edf_by_force([3, 5, 2], [15, 100, 25])
    assert [by_source[k] for k in (None, "a", "b")] == want
    last = max(max(x) for x in want) + 1
    assert [by_source["c"], by_source["d"]] == [[last], [last + 1, last + 2, last + 3]]
    assert pfair_mix(docs.filter("false")).count() == 0
    assert pfair_mix(docs.drop("slot")).count() == len(rows)


def test_schedule_of_many_sources(spark):
    """64 sources of odd shares, some of which run out early, over several of the states that the fold keeps."""
    shares = [1 + (i * i * 37) % 97 for i in range(64)]
    blocks = [1 + a // (1 + i % 5) for i, a in enumerate(shares)]
    got = defaultdict(dict)
    for r in schedule(spark.createDataFrame([(i, a, m) for i, (a, m) in enumerate(zip(shares, blocks, strict=True))], "idx int, share long, blocks long")).collect():
        got[r.idx][r.nth] = r.slot
    assert [[got[i][k] for k in range(m)] for i, m in enumerate(blocks)] == edf_by_force(shares, blocks)
    assert sum(blocks) > 2 * 512


def test_other_columns_move_nothing(spark):
    """Beside id and text, a column says at most which of two rows that agree in both comes first."""
    docs = spark.createDataFrame([(i % 250, f"text {i % 251}", "ab"[i % 2], i) for i in range(500)], "doc_id long, text string, source string, extra long")
    full, less = ({(r.doc_id, r.text, r.source): r.place for r in pfair_mix(d, block_rows=8, piece_rows=40).collect()} for d in (docs, docs.drop("extra")))
    assert full == less and len(full) == 500
    by_id = docs.filter("extra < 250").drop("text")
    full, less = ({r.doc_id: r.place for r in pfair_mix(d, block_rows=8).collect()} for d in (by_id, by_id.drop("extra")))
    assert full == less


@pytest.mark.parametrize(("weights", "blocks"), [([0.7004, 0.2996], [175_100, 74_900]), ([5.0, 2.5, 0.31, 1.7, 0.0007], [20_000, 10_000, 1240, 6800, 3])])
def test_deviation_stays_below_one_block(spark, weights, blocks):
    """At every slot until a source runs out."""
    sizes = spark.createDataFrame(list(enumerate(blocks)), "source int, n long")
    share = mixing.shares(sizes, spark.createDataFrame(list(enumerate(weights)), "source int, weight double"), 1 << 41).withColumnRenamed("n", "blocks")
    plan = mixing.schedule(share).toPandas()
    assert plan.slot.is_unique
    ends = plan.groupby("idx").slot.max()
    for i, w in enumerate(weights):
        own = np.sort(plan.slot[plan.idx == i].to_numpy())
        assert len(own) == blocks[i]
        x, k = w / sum(weights), np.arange(len(own))
        upto = own <= ends.min()
        assert (k - x * own > -1)[upto].all() and (k + 1 - x * (own + 1) < 1)[upto].all()


def test_held_out_and_bounded_sample(spark):
    ids = spark.range(0, 200).select(F.col("id").alias("doc_id"), F.lit("four").alias("text"))
    got = {r.doc_id: r.h for r in ids.select("doc_id", held_out(F.col("doc_id")).alias("h")).collect()}
    assert got == {i: zlib.crc32(str(i).encode()) % 5 == 0 for i in range(200)}
    labels = ids.select("doc_id", F.when(F.col("doc_id") % 7 == 0, None).otherwise(F.col("doc_id") % 2).alias("toxic"))
    rows = training_rows(ids, labels, "toxic", 30).collect()
    assert len(rows) == 30
    assert not any(got[r.doc_id] or r.doc_id % 7 == 0 for r in rows)
    assert len(training_rows(ids.unionByName(ids), labels, "toxic", 30).collect()) == 30
    assert len(training_rows(ids, labels, "toxic", 30, most_chars=40).collect()) == 10
    long = ids.select("doc_id", F.expr("if(doc_id % 2 = 0, null, repeat(char(65 + doc_id % 26), 1000000))").alias("text"))
    rows = training_rows(long, labels, "toxic", 60, most_chars=9_500_000).groupBy(F.char_length("text").alias("n")).count().collect()
    assert {r.n: r["count"] for r in rows}[1_000_000] == 9 and len(rows) == 2
    same = ids.select(F.when(F.col("doc_id") < 100, 1).otherwise(F.col("doc_id")).alias("doc_id"), F.when(F.col("doc_id") % 2 == 0, F.lit("a")).alias("text"))
    hot = training_rows(same, labels.filter("doc_id = 1"), "toxic", 70).groupBy("doc_id", "text", "__label").count().collect()
    assert sorted((r.doc_id, r.text or "", r["__label"], r["count"]) for r in hot) in ([(1, "", 1, 50), (1, "a", 1, 20)], [(1, "", 1, 20), (1, "a", 1, 50)])


def auc(score, label):
    pairs = sorted(zip(score, label, strict=True))
    below = ahead = 0.0
    for k, (x, y) in enumerate(pairs):
        if y:
            same = [z for s, z in pairs[max(0, k - 50) : k + 50] if s == x]
            ahead += below + (len(same) - sum(same)) / 2 if len(same) > 1 else below
        else:
            below += 1
    return ahead / max(1, below * sum(label))


@pytest.mark.parametrize(("query", "column", "cut", "least"), [(op3_toxicity, "toxic", 0.5, 0.9), (op10_quality_rules, "quality", 0.3, 0.85)])
def test_held_out_labels_are_told_apart(spark, query, column, cut, least):
    """The query itself over sf0.1: only labels that no model has seen are looked at."""
    got = query(spark, "/root/testdata/sf0.1")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").filter(f"{column} in (0, 1)").select(F.col("doc_id").alias("k"), F.col(column).alias("label"))
    rows = got.join(F.broadcast(labels), F.col("doc_id") == F.col("k"), "left").collect()
    assert len(rows) == spark.read.parquet("/root/testdata/sf0.1/documents.parquet").count()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= cut) for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    seen = [r for r in rows if r.held_out and r.label is not None]
    assert auc([r.score for r in seen], [r.label for r in seen]) >= least


def test_toxicity_of_odd_rows(spark):
    clean = [f"the river and the green stone walk {i} " * 4 for i in range(60)]
    model = toxicity.fit(clean + [t + " horribleperson" for t in clean[:30]], [0] * 60 + [1] * 30)
    run = "好" * 500
    texts = [None, "", "  \n", "horribleperson", "river", "river", run, run + "horribleperson" + run, "x" * 300_000, "word " * 100_000]
    docs = spark.createDataFrame([(i % 8, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, score string")
    got = docs.select("doc_id", "text", toxicity.scored(docs, model, F.col("text")).alias("own")).collect()
    assert len(got) == len(texts)
    own = defaultdict(set)
    for r in got:
        own[r.text].add(r.own)
    low = {t: min(v) for t, v in own.items()}
    assert all(len(v) == 1 and 0 <= min(v) <= 1 for v in own.values())
    assert own[None] == own[""] == own["  \n"]
    assert low["horribleperson"] > low["river"]
    assert low[run + "horribleperson" + run] > low[run]  # what stands behind the fortieth character counts
    for t, v in own.items():
        assert model.score(t) == pytest.approx(min(v))
    assert docs.filter("false").select(toxicity.scored(docs, model, F.col("text"))).count() == 0


@pytest.mark.parametrize("n", [1, 39, 40, 41, 75, 76, 500])
def test_pieces_hold_every_ngram(n):
    word = "".join(chr(0x4E00 + i) for i in range(n))
    found = toxicity.words_of(word)
    assert max(map(len, found)) <= toxicity.PIECE
    for size in range(1, toxicity.HIGH + 1):
        for i in range(n - size + 1):
            assert any(word[i : i + size] in p for p in found)


def test_quality_of_odd_rows(spark):
    rows = [(1, None, "a"), (None, "", "b"), (2, "One two three.", "c"), (2, "One two three.", "c"), (3, "x" * 200_000, "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __stats string").withColumn("quality_score", F.lit(5)).withColumn("__base", F.lit(1)).withColumn("__row", F.lit(2))
    rules = quality_rules.Rules([(("log_words", True, 1.0),)], [2.0], -1.0)
    got = quality_rules.quality_scores(docs, rules).collect()
    assert sorted((r["__stats"], r["__base"], round(r.quality_score, 3)) for r in got) == [("a", 1, 0.269), ("b", 1, 0.269), ("c", 1, 0.731), ("c", 1, 0.731), ("d", 1, 0.269)]
    assert quality_rules.quality_scores(docs.filter("false"), rules).count() == 0


def test_toxicity_shares_ngrams():
    rnd = random.Random(7)
    clean = [" ".join(rnd.choice(["the", "and", "river", "stone", "green", "walk"]) for _ in range(60)) for _ in range(200)]
    toxic = [t.replace("stone", "horribleperson", 2) for t in clean[:80]]
    model = toxicity.fit(clean + toxic, [0] * 200 + [1] * 80)
    assert min(model.score(t) for t in toxic) > 0.5 > max(model.score(t) for t in clean)
    assert model.score(clean[0] + " horriblepersn horribleperzon horrribleperson") > 0.5
    assert 0 <= model.score(None) < 0.5
    assert toxicity.fit(["a"], [0]).score("x") < 0.01
    assert toxicity.fit([], []).score("x") < 0.01
    toxicity.fit(["", ""], [0, 1]).score("x")


def test_rules_compile_to_columns(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(400, 3))
    y = ((x[:, 0] > 0.2) & (x[:, 1] <= 0.5)).astype(int)
    rules = quality_rules.fit_rules(x, y, ["p", "q", "r"])
    assert 0 < len(rules.rules) < 200
    df = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)], "i int, p double, q double, r double").select("i", F.struct("p", "q", "r").alias("s"))
    got = np.array([r.z for r in df.select("i", rules.column(F.col("s")).alias("z")).orderBy("i").collect()])
    assert ((got >= 0.5) == y).mean() > 0.97
    assert quality_rules.fit_rules(x, np.ones(400, int), ["p", "q", "r"]).rules == []
    texts = spark.createDataFrame([(1, None), (2, ""), (3, "w " * 50_000)], "doc_id long, text string")
    assert all(0 <= r.quality_score <= 1 for r in quality_rules.quality_scores(texts, quality_rules.Rules([], [], 1.0)).collect())


def test_op5_query_shape(spark):
    assert op5_exact_dedup(spark, DATA).columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]


def test_pipeline_against_brute_force(spark, tmp_path):
    """Every stage on what the one before it kept, read back from Parquet."""
    docs, rows = spark.read.parquet(f"{DATA}/documents.parquet"), {}
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id: r.text for r in docs.collect()}
        out = stage(spark, docs, DATA)
        out.write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        rows[i] = {r.doc_id for r in docs.collect()}
        if i < 4:
            assert tuple(docs.columns) == corpus_pipeline.COLUMNS
        if i == 1:
            first = {}
            for k in sorted(before):
                first.setdefault(lower(before[k]), k)
            assert rows[1] == set(first.values())
        if i == 2:
            assert rows[2] == set(classes_by_force(sorted(before.items())).values())
        if i == 3:
            assert rows[3] == rows[2]
            placed = {r.doc_id: r.place for r in pfair_mix(spark.read.parquet(str(tmp_path / "2")).select("doc_id", "text", "source")).collect()}
            stored = [r.doc_id for f in sorted((tmp_path / "3").glob("part-*")) for r in spark.read.parquet(str(f)).collect()]
            assert [placed[k] for k in stored] == sorted(placed.values())
    assert rows[4] == rows[3]
    assert docs.filter("not round_trip").count() == 0
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    good = [k for k, q in labels.items() if q == 1]
    assert sum(k in rows[0] for k in good) >= 0.98 * len(good)
    assert {r.doc_id for r in corpus_pipeline.run(spark, DATA).collect()} == rows[4]


def test_alignment_of_repeated_lines_equals_longest_common_subsequence(spark):
    def by_force(a, b):
        row = [0] * (len(b) + 1)
        for x in a.tolist():
            row, before = [0], row
            for j, y in enumerate(b.tolist()):
                row.append(before[j] + 1 if x == y else max(before[j + 1], row[j]))
        return row[-1] / (len(a) + len(b) - row[-1])

    rnd, shingler = random.Random(8), minhash_dedup.Shingler()
    shingles = lambda words: shingler.shingles(shingler.words(" ".join(words)))
    linked = 0
    for k in range(150):
        lines = [[f"w{rnd.randrange(40)}" for _ in range(rnd.randint(1, 12))] for _ in range(rnd.randint(1, 5))]
        a = [w for _ in range(rnd.randint(3, 30)) for w in rnd.choice(lines)]
        b = a[len(a) // 15 :] if k % 2 else list(a)
        for _ in range(rnd.randint(0, 3)):
            at = rnd.randrange(len(b))
            b[at : at + rnd.randint(0, 3)] = rnd.choice([[], rnd.choice(lines), ["new"]])
        x, y = shingles(a), shingles(b)
        want, got = by_force(x, y), minhash_dedup.shingle_similarity(x, y)
        assert got == pytest.approx(want) if want >= 0.8 else got < 0.8
        linked += want >= 0.8
    assert 30 < linked < 150
    block = [f"w{i}" for i in range(60)] * 10
    docs = spark.createDataFrame([(1, " ".join(block)), (2, " ".join(block[30:]))], "doc_id long, text string")
    a, b = (shingler.labels(shingler.words(" ".join(t))) for t in (block, block[30:]))
    assert minhash_dedup.similarity(a, b) < 0.8 < by_force(shingles(block), shingles(block[30:]))
    assert {r.class_id for r in minhash_dedup.near_classes(docs).collect()} == {1}


def test_mixing_stage_keeps_each_row_of_null_and_repeated_ids_once(spark):
    ids = [None] * 5 + [7] * 4 + list(range(20, 40))
    rows = [(i, f"text {k}", "en", f"s{k % 3}", 6) for k, i in enumerate(ids)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.text for r in corpus_pipeline.mix(spark, docs, DATA).collect()) == sorted(r[1] for r in rows)


@pytest.mark.parametrize("stage", range(5))
def test_stages_on_odd_rows(spark, stage):
    """Null and repeated ids, null, empty and long texts, equal rows, extra columns, no rows at all."""
    text = " ".join(f"word{i} is here." for i in range(60))
    rows = [(None, text), (None, text + " One more."), (None, None), (4, ""), (4, "short one."), (4, "short one."), (5, "x" * 100_000), (6, "long words. " * 20_000), (7, text.upper())]
    docs = spark.createDataFrame([(i, t, None if k % 3 else "en", None if k % 2 else "s", None if t is None else len(t), 1.0, "e") for k, (i, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long, score double, extra string")
    run = corpus_pipeline.STAGES[stage][1]
    out = run(spark, docs, DATA)
    assert "extra" not in out.columns and "score" not in out.columns
    got = out.collect()
    ids = lambda some: sorted(-1 if i is None else i for i in some)
    if stage == 0:
        rest = list(rows)
        for r in got:  # what stays are rows of the input, none of them twice
            rest.remove((r.doc_id, r.text))
    elif stage == 1:
        assert len(got) == 6
        assert sorted(lower(r.text) for r in got) == sorted({lower(t) for _, t in rows})
    elif stage == 2:
        assert sorted((-1 if r.doc_id is None else r.doc_id, len(r.text or "")) for r in got) == sorted([(7, len(text)), (4, 0), (4, 10), (5, 100_000), (6, 240_000)])
    elif stage == 3:
        assert sorted(str((r.doc_id, r.text)) for r in got) == sorted(map(str, rows))
    else:
        assert ids(r.doc_id for r in got) == ids(i for i, _ in rows) and all(r.round_trip and r.n_tokens == len(r.ids) for r in got)
    assert run(spark, docs.filter("false"), DATA).count() == 0
