"""BM25 in blocks: the same as scores of all pairs, with ties over blocks, odd ids, and nothing written per pair or per token."""

import math
import re

import pytest
from pyspark.sql import functions as F

from sieveline.operators import lexical


def brute(docs, asked, k):
    """query -> [(doc_id, score)] of the best k, ties to the smaller id."""
    n, mean = len(docs), sum(len(t.split()) for _, t in docs) / len(docs)
    df = {}
    for _, t in docs:
        for w in set(t.split()):
            df[w] = df.get(w, 0) + 1
    raw = {w: math.log(n - c + 0.5) - math.log(c + 0.5) for w, c in df.items()}
    idf = {w: x if x >= 0 else 0.25 * sum(raw.values()) / len(raw) for w, x in raw.items()}
    out = {}
    for q, text in asked:
        scores = {i: sum(idf.get(w, 0) * t.split().count(w) * 2.5 / (t.split().count(w) + 1.5 * (0.25 + 0.75 * len(t.split()) / mean)) for w in text.split()) for i, t in docs}
        out[q] = sorted(((i, round(s, 9)) for i, s in scores.items() if s > 0), key=lambda x: (-x[1], x[0]))[:k]
    return out


@pytest.mark.parametrize("kind", ["long", "string"])
@pytest.mark.parametrize("k", [3, 500])
def test_blocks_equal_all_pairs(spark, kind, k):
    """A third of the documents are copies of one text, so most ties lie across blocks; some queries find few documents or none."""
    of = (lambda i: i) if kind == "long" else (lambda i: f"d{i:04d}")
    docs = [(of(i * 37 % 211), "a b common common" if i % 3 == 0 else f"common w{i % 5} w{i % 11} x{i}") for i in range(211)]
    asked = [(1, "b a"), (2, "w1 w1 w3 common"), (3, "x7"), (4, "nowhere"), (5, "common"), (6, "w2 x1 x2")]
    table, index = spark.createDataFrame(asked, "query_id long, text string"), lexical.bm25_index(spark.createDataFrame(docs, f"doc_id {kind}, text string").repartition(3), F.split("text", " "))
    got = {q: [] for q, _ in asked}
    for r in lexical.bm25_search(index, table, F.split("text", " "), k, row_block=20, query_block=2).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.doc_id, round(r.score, 9)))
    assert got == brute(docs, asked, k)
    pairs = {(r.query_id, r.doc_id): round(r.score, 9) for r in lexical.bm25_scores(index, table, F.split("text", " ")).collect()}
    assert {(q, i): s for q, v in got.items() for i, s in v}.items() <= pairs.items()


def test_documents_without_tokens_or_id(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None), (3, ""), (None, "a a"), (5, "c")], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "a"), (2, None)], "query_id long, text string")
    cut = F.filter(F.split("text", " "), lambda t: t != "")
    assert [(r.query_id, r.doc_id) for r in lexical.bm25_search(lexical.bm25_index(docs, cut), asked, cut).collect()] == [(1, 1)]
    nothing = lexical.bm25_index(docs.limit(0), cut)
    assert lexical.bm25_search(nothing, asked, cut).count() == 0


def test_a_document_is_one_row_until_the_best_are_known(spark):
    """What is written and shuffled grows with documents and their distinct terms: no row for a token, none for a pair (query, document)."""
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.lit("a b " * 200).alias("text"))
    asked = spark.range(50).select(F.col("id").alias("query_id"), F.lit("a b").alias("text"))
    index = lexical.bm25_index(docs, F.split("text", " "))
    assert index.counted.count() == 300 and index.counted.select(F.max(F.size("terms"))).first()[0] == 3
    plan = lexical.bm25_search(index, asked, F.split("text", " "), 2)._jdf.queryExecution().optimizedPlan().toString()
    below = plan.split("FlatMapCoGroupsInArrow", 1)[1]
    assert not re.search(r"Generate explode\((tokens|terms)|Join.*doc_id", below)


def test_changes_count_no_terms_until_they_are_asked_for(spark, monkeypatch):
    """An index that changes twice is written three times, and its terms are counted once, by the search."""
    names = []
    own = lexical.written
    monkeypatch.setattr(lexical, "written", lambda df, what: names.append(what) or own(df, what))
    docs = spark.createDataFrame([(i, f"a w{i % 3}") for i in range(12)], "doc_id long, text string")
    cut = F.split("text", " ")
    index = lexical.bm25_index(docs.filter("doc_id < 8"), cut)
    index = lexical.changed(index, docs.filter("doc_id >= 8"), cut)
    index = lexical.changed(index, removed=docs.filter("doc_id % 4 = 0"))
    assert names == ["counted"] * 3
    asked = spark.createDataFrame([(1, "w1")], "query_id long, text string")
    assert [r.doc_id for r in lexical.bm25_search(index, asked, cut).orderBy("rank").collect()] == [1, 7, 10]
    assert names == ["counted"] * 3 + ["terms"]


def test_a_task_holds_few_groups_however_many_there_are(spark):
    """More groups than shuffle partitions get partitions of their own, and no further shuffle; the result stays."""
    docs = spark.createDataFrame([(i, f"a w{i % 7}") for i in range(90)], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "w1 w2"), (2, "w3")], "query_id long, text string")
    cut = F.split("text", " ")
    index = lexical.bm25_index(docs, cut)
    rows = lambda df: [tuple(r) for r in df.orderBy("query_id", "rank").collect()]
    many, one = lexical.bm25_search(index, asked, cut, 5, row_block=3), lexical.bm25_search(index, asked, cut, 5)
    plan = many._jdf.queryExecution().executedPlan().toString()
    assert re.findall(r"hashpartitioning\(i#\d+, j#\d+, (\d+)\)", plan) == ["60", "60"]
    assert rows(many) == rows(one) and len(rows(many)) == 10


def test_a_block_without_a_shared_word(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "c c"), (3, "d")], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "c")], "query_id long, text string")
    cut = F.split("text", " ")
    assert [(r.query_id, r.doc_id) for r in lexical.bm25_search(lexical.bm25_index(docs, cut), asked, cut, row_block=1).collect()] == [(1, 2)]
