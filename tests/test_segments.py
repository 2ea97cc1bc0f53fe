"""The kept index: equal to one built afresh after any changes, little read, one state for every reader."""

import random

import pytest
from pyspark.sql import functions as F

from sieveline.operators import lexical, segments
from sieveline.plans import queries
from sieveline.plans.search import indexed_text

cut = lambda: F.filter(F.split("text", " "), lambda t: t != "")


def rows(found):
    return sorted((r.query_id, r.rank, r.doc_id, round(r.score, 9)) for r in found.collect())


def texts(rnd, ids, size=12):
    return [(i, " ".join(rnd.choice(["the", "of", *(f"w{min(99, int(rnd.expovariate(0.06)))}" for _ in range(3))]) for _ in range(rnd.randrange(size)))) for i in ids]


def test_any_changes_give_the_index_built_afresh(spark, tmp_path):
    """Adds, replacements, removals and merges in random order; old versions stay as they were."""
    rnd = random.Random(6)
    frame = lambda t: spark.createDataFrame(t, "doc_id long, text string")
    asked = spark.createDataFrame([(1, "the w1 w9"), (2, "w2 w2 w30 none"), (3, "of"), (4, ""), (5, "w0 w3 w5 w8 w13 w21 the of")], "query_id long, text string")
    index, now, seen = segments.opened(spark, str(tmp_path)), {}, {}
    assert segments.search(index, asked, cut()).count() == 0
    for step in range(7):
        new = texts(rnd, rnd.sample(range(160), 60 if step == 0 else 25))
        index = segments.added(index, frame(new), cut())
        now |= dict(new)
        if step % 2:
            gone = rnd.sample(range(170), 20)
            index = segments.removed(index, frame([(i, "") for i in gone]))
            now = {k: v for k, v in now.items() if k not in gone}
        if step == 3:
            seen[index.version] = dict(now)
        if step in (2, 5):
            index = segments.merged(index, tuple(rnd.sample(sorted(index.segments), 2)))
    index = segments.compacted(index, 2)
    afresh = lexical.bm25_index(frame(sorted(now.items())), cut())
    again = segments.opened(spark, str(tmp_path))
    assert (again.n, again.version, again.avgdl) == (len(now), index.version, pytest.approx(afresh.avgdl))
    for k in (3, 200):
        assert rows(segments.search(again, asked, cut(), k, first=2, seeds=1)) == rows(lexical.bm25_search(afresh, asked, cut(), k))
    df = {}
    for t in now.values():
        for w in set(t.split()):
            df[w] = df.get(w, 0) + 1
    assert {r.term: r.df for r in segments.vocabulary(again).collect()} == df
    version, then = next(iter(seen.items()))
    assert rows(segments.search(segments.opened(spark, str(tmp_path), version), asked, cut(), 9)) == rows(lexical.bm25_search(lexical.bm25_index(frame(sorted(then.items())), cut()), asked, cut(), 9))
    assert segments.vacuumed(again) > 0
    assert rows(segments.search(segments.opened(spark, str(tmp_path)), asked, cut(), 3)) == rows(lexical.bm25_search(afresh, asked, cut(), 3))


def test_a_small_addition_reads_little(spark, tmp_path):
    """One document in a hundred is added: no table of the large segment but its ids is opened, and nothing in it is written."""
    rnd = random.Random(2)
    frame = lambda t: spark.createDataFrame(t, "doc_id long, text string")
    index = segments.added(segments.opened(spark, str(tmp_path)), frame(texts(rnd, range(2000))), cut())
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "seg-0").rglob("*")}
    (tmp_path / "seg-0" / "postings").rename(tmp_path / "postings")
    (tmp_path / "seg-0" / "terms").rename(tmp_path / "terms")
    index = segments.added(index, frame(texts(rnd, range(2000, 2020))), cut())
    plan = index.live(index.read("seg", "docs", (0,)).select("seg", "doc_id", "dl"))._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id:bigint,dl:bigint>" in plan
    (tmp_path / "postings").rename(tmp_path / "seg-0" / "postings")
    (tmp_path / "terms").rename(tmp_path / "seg-0" / "terms")
    assert before == {p: before[p] if p.name in ("seg-0",) else p.stat().st_mtime_ns for p in before}
    assert (index.n, len(index.segments), index.dead) == (2020, 2, ())
    size = lambda s: sum(p.stat().st_size for p in (tmp_path / s / "postings").glob("*.parquet"))
    assert size("seg-1") < 0.2 * size("seg-0")


def test_merges_are_by_tiers(spark, tmp_path):
    """Twenty additions of ten documents: a document is written again with the logarithm, not with every addition."""
    index, wrote = segments.opened(spark, str(tmp_path)), 0
    for i in range(12):
        index = segments.added(index, spark.createDataFrame([(10 * i + j, f"a w{j}") for j in range(10)], "doc_id long, text string"), cut())
        while seqs := segments.due(index, 3):
            wrote += sum(index.segments[s]["docs"] for s in seqs)
            index = segments.merged(index, seqs)
    assert index.n == 120 and len(index.segments) <= 5 and wrote <= 3 * 120


def test_odd_documents(spark, tmp_path):
    frame = lambda t: spark.createDataFrame(t, "doc_id long, text string, level int, term string")
    index = segments.opened(spark, str(tmp_path / "a"))
    assert segments.added(index, frame([]), cut()) == index
    assert segments.removed(index, frame([(1, "", 0, "")])) == index
    index = segments.added(index, frame([(1, None, 1, "x"), (2, "", 2, "y"), (3, "w " * 100_000 + "z", 3, None)]), cut())
    assert (index.n, index.avgdl) == (3, pytest.approx(100_001 / 3))
    asked = spark.createDataFrame([(1, "z z"), (2, None)], "query_id long, text string")
    assert [(r.query_id, r.doc_id) for r in segments.search(index, asked, cut()).collect()] == [(1, 3)]
    for bad in ([(4, "a", 0, ""), (4, "b", 0, "")], [(None, "a", 0, "")]):
        with pytest.raises(ValueError, match="ids"):
            segments.added(index, frame(bad), cut())
    all_gone = segments.removed(index, frame([(i, "", 0, "") for i in (1, 2, 3, 9)]))
    assert all_gone.n == 0 and segments.search(all_gone, asked, cut()).count() == 0
    assert segments.compacted(all_gone).segments == {}
    with pytest.raises(RuntimeError, match="another writer"):
        segments.added(index, frame([(5, "a", 0, "")]), cut())


def test_cutoffs_leave_less_than_the_threshold():
    rnd = random.Random(9)
    for _ in range(200):
        levels = {}
        for t in range(rnd.randrange(1, 9)):
            w, tops = rnd.random() * 5, sorted((rnd.random() * 2.5 for _ in range(rnd.randrange(1, 9))), reverse=True)
            levels[str(t)] = (w, [(15 - i, rnd.randrange(1, 500), w * x) for i, x in enumerate(tops)])
        done = {t: rnd.choice([16, v[1][0][0]]) for t, v in levels.items()}
        threshold = rnd.random() * 10
        found = segments.cutoffs(levels, done, threshold)
        assert sum(c for _, c in found.values()) < threshold or all(i == len(levels[t][1]) for t, (i, _) in found.items())
        for t, (i, c) in found.items():
            assert c == (levels[t][1][i][2] if i < len(levels[t][1]) else 0) and all(x[0] < done[t] for x in levels[t][1][i:])


def test_blocks_are_skipped(spark, tmp_path):
    """The best 50 of all items over sf0.1: the same as without skipping, from less than a fifth of the postings."""
    d = "/root/testdata/sf0.1"
    index = segments.added(segments.opened(spark, str(tmp_path)), queries.memories(spark, d), queries.X.word_tokens(indexed_text()), "id")
    words, asked = queries.X.word_tokens(F.col("text")), queries.items(spark, d)
    whole = lexical.bm25_index(queries.memories(spark, d), queries.X.word_tokens(indexed_text()), "id")
    for k, part, most in ((50, asked, 0.2), (10, asked.withColumn("text", F.substring_index("text", " ", 5)), 0.1)):
        counts = {}
        got = segments.search(index, part, words, k, counts=counts)
        close = lambda found: sorted((r.query_id, r.rank, r.doc_id, round(r.score, 6)) for r in found.collect())
        assert close(got) == close(lexical.bm25_search(whole, part, words, k))
        assert counts["read"] < most * counts["lists"]
