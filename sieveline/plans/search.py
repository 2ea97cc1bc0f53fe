"""End-to-end searches for all queries at once."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scoring import LONG, SHORT, Additive, with_additive
from ..functions.text import abstract, overview, word_tokens
from ..operators.evaluate import recall_mrr
from ..operators.fusion import funnel, linear_blend, quality_weighted
from ..operators.lexical import bm25_index, bm25_search
from ..operators.ranking import ranked
from ..operators.vector import vector_search
from ..sources.shared import written


def indexed_text(text: str = "content"):
    """What the lexical index reads: abstract, a blank, overview."""
    return F.concat(abstract(F.col(text)), F.lit(" "), overview(F.col(text)))


def quality_of(memories: DataFrame, edition: Additive, found: DataFrame | None = None) -> DataFrame:
    """(doc_id, quality), of the documents in ``found`` only if given."""
    rows = memories.select(F.col("id").alias("doc_id"), "content", "category")
    if found is not None:
        rows = rows.join(found.select("doc_id").distinct(), "doc_id", "left_semi")
    return with_additive(rows, edition=edition).select("doc_id", "quality")


def bm25_quality(memories: DataFrame, queries: DataFrame, k: int = 5, depth: int = 20, least: float = 0.3, edition: Additive = SHORT) -> DataFrame:
    """BM25, then quality weights: (query_id, doc_id, score, quality, rank). memories: id, content, category."""
    index = bm25_index(memories, word_tokens(indexed_text()), "id")
    found = written(bm25_search(index, queries, word_tokens(F.col("text")), depth), "found")
    return ranked(quality_weighted(found.drop("rank"), quality_of(memories, edition, found), least), k)


def hybrid(memories: DataFrame, vectors: DataFrame, queries: DataFrame, asked: DataFrame, k: int = 5, depth: int = 50, least: float = 0.4, edition: Additive = LONG, weighted: bool = True) -> DataFrame:
    """BM25 and vectors, fused, cut, weighted by quality after the cut. asked: (query_id, own, v)."""
    index = bm25_index(memories, word_tokens(indexed_text()), "id")
    lexical = bm25_search(index, queries, word_tokens(F.col("text")), depth)
    near = vector_search(vectors, asked, depth, skip_self=True)
    best = funnel(lexical, near)
    if not weighted:
        return best.filter(F.col("rank") <= k)
    best = written(best, "found")
    return ranked(quality_weighted(best.drop("rank"), quality_of(memories, edition, best), least).select("query_id", "doc_id", "score"), k)


def benchmark(memories: DataFrame, vectors: DataFrame, queries: DataFrame, asked: DataFrame, relevant: DataFrame, kind: str = "hybrid", alpha: float = 0.5, k: int = 10) -> DataFrame:
    """One row: kind, alpha, k, sizes, recall and mrr of a retrieval over all queries at once. kind: vector, bm25 or hybrid."""
    if kind not in ("vector", "bm25", "hybrid"):
        raise ValueError(f"kind is vector, bm25 or hybrid, not {kind}")
    depth = k if kind != "hybrid" else 50
    near = None if kind == "bm25" else vector_search(vectors, asked, depth, skip_self=True)
    lexical = None if kind == "vector" else bm25_search(bm25_index(memories, word_tokens(indexed_text()), "id"), queries, word_tokens(F.col("text")), depth)
    ranking = near if kind == "vector" else lexical if kind == "bm25" else ranked(linear_blend(near, lexical, alpha), k)
    config = {"retrieval_type": F.lit(kind), "alpha": F.lit(alpha), "k": F.lit(k).cast("long"), "corpus_size": F.lit(memories.count()), "query_size": F.lit(queries.count())}
    return recall_mrr(ranking, relevant).withColumns(config)


def timed_benchmark(queries: DataFrame, **setup: object) -> DataFrame:
    """``benchmark`` with total_time and queries_per_second: the whole batch is run once and timed."""
    began = time.perf_counter()
    report = benchmark(queries=queries, **setup).toPandas()
    took = time.perf_counter() - began
    return queries.sparkSession.createDataFrame(report).withColumns({"total_time": F.lit(took), "queries_per_second": F.col("query_size") / F.lit(took)})
