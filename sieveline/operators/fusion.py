"""Fusion of ranked lists, quality weights and reranking."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import written
from .evaluate import numbered
from .ranking import ranked
from .vector import ranks_among, vector_search


def rrf(*lists: DataFrame, k: int = 60, first: int = 1) -> DataFrame:
    """Reciprocal rank fusion: the sum over the lists of 1 / (k + rank), ranks counted from ``first``."""
    every = reduce(DataFrame.unionByName, [x.select("query_id", "doc_id", "rank") for x in lists])
    return every.groupBy("query_id", "doc_id").agg(F.sum(1.0 / (F.lit(k) + F.col("rank") + (first - 1))).alias("score"))


def rrf_or_first(first: DataFrame, second: DataFrame, k: int = 60) -> DataFrame:
    """Fusion with ranks from 0; a query without a second list keeps the first one's scores."""
    has = second.select("query_id").distinct()
    return rrf(first.join(has, "query_id", "left_semi"), second, k=k, first=0).unionByName(first.join(has, "query_id", "left_anti").select("query_id", "doc_id", "score"))


def weighted_rrf(vector: DataFrame, lexical: DataFrame, alpha: float, k: int = 60) -> DataFrame:
    """alpha / (k + rank) + (1 - alpha) / (k + rank) over complete rankings of all documents of a query."""
    both = vector.select("query_id", "doc_id", F.col("rank").alias("rv")).join(lexical.select("query_id", "doc_id", F.col("rank").alias("rl")), ["query_id", "doc_id"])
    return both.select("query_id", "doc_id", (F.lit(alpha) / (k + F.col("rv")) + F.lit(1 - alpha) / (k + F.col("rl"))).alias("score"))


def sparse_top(sparse: DataFrame, universe: DataFrame, queries: DataFrame, depth: int) -> DataFrame:
    """(query_id, doc_id, rank) of the first ``depth`` of a complete ranking of which ``sparse`` holds the scores that aren't 0.

    Documents without a score tie at 0, behind all positive ones, in the order of doc_id. Only queries with fewer than
    ``depth`` positive scores get to them, and then to the first few ids.
    """
    above = sparse.filter("score > 0")
    best = ranked(above, depth).select("query_id", "doc_id", "rank")
    have = queries.select("query_id").join(sparse.groupBy("query_id").agg(F.count(F.when(F.col("score") > 0, 1)).alias("p"), F.count("*").alias("s")), "query_id", "left").fillna(0)
    short = have.filter(F.col("p") < depth)
    most = short.agg(F.max("s")).first()[0]
    if most is None:
        return best
    ids = [r.doc_id for r in universe.select("doc_id").orderBy("doc_id").limit(depth + most).collect()]  # depth, and as many as a short list has
    zeros = short.select("query_id", "p", F.explode(F.array(*[F.lit(i) for i in ids])).alias("doc_id")).join(sparse, ["query_id", "doc_id"], "left_anti")
    zeros = ranked(zeros.withColumn("score", F.lit(0.0)), depth).withColumn("rank", F.col("p") + F.col("rank")).filter(F.col("rank") <= depth)
    return best.unionByName(zeros.select("query_id", "doc_id", "rank"))


def sparse_ranks_among(sparse: DataFrame, universe: DataFrame, wanted: DataFrame, places: int = 9, salts: int = 8) -> DataFrame:
    """(query_id, doc_id, rank) of wanted pairs in that complete ranking, which is never made.

    How many scores come before a wanted one is counted in pieces of each query's list; how many of the documents without a
    score do follows from the place of the id among all ids, less the ids with a score before it.
    """
    pairs = wanted.select("query_id", "doc_id").distinct()
    own = pairs.join(sparse, ["query_id", "doc_id"], "left").select("query_id", "doc_id", F.coalesce("score", F.lit(0.0)).alias("score"))

    def run(rows: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
        s, ids = -rows["score"].round(places).to_numpy(), rows["doc_id"].to_numpy()
        order = np.lexsort((ids, s))
        s, ids, named = s[order], ids[order], np.sort(ids)
        want, who = -asks["score"].round(places).to_numpy(), asks["doc_id"].to_numpy()
        first, last = np.searchsorted(s, want), np.searchsorted(s, want, "right")
        ahead = first + np.array([np.searchsorted(ids[a:b], i) for a, b, i in zip(first, last, who, strict=True)], np.int64)
        return pd.DataFrame({"query_id": asks["query_id"].to_numpy(), "doc_id": who, "score": -want, "ahead": ahead, "named": np.searchsorted(named, who)})

    left = sparse.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)))
    right = own.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    found = left.groupBy("query_id", "salt").cogroup(right.groupBy("query_id", "salt")).applyInPandas(run, "query_id long, doc_id long, score double, ahead long, named long")
    found = found.groupBy("query_id", "doc_id", "score").agg(F.sum("ahead").alias("ahead"), F.sum("named").alias("named"))
    places_of = numbered(universe.select("doc_id"), F.col("doc_id")).join(pairs.select("doc_id").distinct(), "doc_id", "left_semi")
    sizes = sparse.groupBy("query_id").agg(F.count("*").alias("s"))
    n = universe.count()
    rows = found.join(places_of, "doc_id").join(sizes, "query_id", "left").fillna(0, ["s"])
    zeros = F.when(F.col("score") > 0, 0).when(F.col("score") == 0, F.col("position") - F.col("named")).otherwise(F.lit(n) - F.col("s"))
    return rows.select("query_id", "doc_id", (F.col("ahead") + zeros + 1).alias("rank"))


def weighted_rrf_search(docs: DataFrame, queries: DataFrame, lexical: DataFrame, alpha: float, k: int = 60, top: int = 10, metric: str = "dot", counts: dict[str, int] | None = None) -> DataFrame:
    """The best of alpha / (k + rank) by vectors + (1 - alpha) / (k + rank) by BM25, over complete rankings of all documents, without
    making these. docs: (doc_id, v), ids that differ; queries: (query_id, v); lexical: (query_id, doc_id, score) of the documents that share a word.

    A threshold algorithm in rounds. Both lists are read to a depth; what is seen has at least the parts of its known ranks, and at
    most these and a part of the next depth; what isn't seen has 1 / (k + depth + 1) at most. A query is decided when its
    ``top``-th best lower bound is above that; else its depth is doubled. Then only what may still be among the best gets its exact
    ranks, which are counted. The list of the larger weight alone decides by a depth of (k + top) / weight - k, so rounds end.

    Documents without a shared word tie behind all others, by doc_id. Null vectors are no documents. counts takes rounds, rows read from
    the lists, and rows that were ranked exactly.
    """
    docs = docs.filter("v is not null").select("doc_id", "v")
    universe, asks = docs.select("doc_id"), queries.filter("v is not null").select("query_id", "v")
    sparse = lexical.select("query_id", "doc_id", F.round("score", 9).alias("score")).filter("score <> 0")
    sparse = written(sparse.join(universe, "doc_id", "left_semi").join(asks.select("query_id"), "query_id", "left_semi"), "sparse")
    n, depth, wanted, rounds, read = universe.count(), top, [], 0, 0
    while True:
        rounds += 1
        lists = vector_search(docs, asks, depth, metric).select("query_id", "doc_id", F.col("rank").alias("rv"))
        both = lists.join(sparse_top(sparse, universe, asks, depth).select("query_id", "doc_id", F.col("rank").alias("rl")), ["query_id", "doc_id"], "full")
        part = lambda w, r, missing: w / (k + F.coalesce(F.col(r), F.lit(missing)))  # noqa: E731, B023
        both = both.withColumn("low", part(alpha, "rv", float("inf")) + part(1 - alpha, "rl", float("inf"))).withColumn("high", part(alpha, "rv", depth + 1) + part(1 - alpha, "rl", depth + 1))
        seen = written(both, "seen")
        least = ranked(seen.withColumnRenamed("low", "score").select("query_id", "doc_id", "score"), top, places=15).groupBy("query_id").agg(F.min("score").alias("t"), F.count("*").alias("c"))
        decided = least.filter((F.lit(depth) >= n) | ((F.col("c") == top) & (F.col("t") > 1 / (k + depth + 1))))
        wanted.append(seen.join(decided, "query_id").filter(F.col("high") >= F.col("t") - 1e-12).select("query_id", "doc_id"))
        if counts is not None:
            read += seen.count()
        left = written(asks.join(decided, "query_id", "left_anti"), "asks")
        if left.isEmpty() or depth >= n:
            break
        asks, depth = left, 2 * depth
    wanted = written(reduce(DataFrame.unionByName, wanted), "wanted")
    if counts is not None:
        counts.update(rounds=rounds, read=read, ranked=wanted.count())
    exact = weighted_rrf(ranks_among(docs, queries, wanted, metric), sparse_ranks_among(sparse, universe, wanted), alpha, k)
    return ranked(exact, top)


def linear_blend(vector: DataFrame, lexical: DataFrame, alpha: float) -> DataFrame:
    """alpha times the one score and 1 - alpha times the other; a missing score is 0."""
    v = vector.select("query_id", "doc_id", (F.lit(alpha) * F.col("score")).alias("score"))
    x = lexical.select("query_id", "doc_id", (F.lit(1 - alpha) * F.col("score")).alias("score"))
    return v.unionByName(x).groupBy("query_id", "doc_id").agg(F.sum("score").alias("score"))


def quality_weighted(scored: DataFrame, quality: DataFrame, floor: float | None = None, half: bool = True, default: float | None = None) -> DataFrame:
    """Scores times 0.5 + 0.5 quality (``half``) or times quality; rows below ``floor`` go.

    quality: (doc_id, quality). Without a default, documents that have none go; with it they get the default.
    """
    rows = scored.join(quality, "doc_id", "inner" if default is None else "left")
    q = F.col("quality") if default is None else F.coalesce("quality", F.lit(default))
    rows = rows.withColumn("quality", q)
    if floor is not None:
        rows = rows.filter(F.col("quality") >= floor)
    return rows.withColumn("score", F.col("score") * ((0.5 + 0.5 * F.col("quality")) if half else F.col("quality")))


def reranked(candidates: DataFrame, score: Column, k: int, depth: int | None = None) -> DataFrame:
    """The best ``depth`` candidates in the order of another score, cut to k; ``score`` reads the candidates' columns.

    A model is such a column too: a pandas UDF over the (query, document) texts.
    """
    rows = candidates.filter(F.col("rank") <= depth) if depth else candidates
    return ranked(rows.drop("rank").withColumn("score", score), k)


def listwise(candidates: DataFrame, orders: DataFrame, k: int, depth: int = 50) -> DataFrame:
    """orders: (query_id, order) with the places, from 0, of candidates in their new order; the first mention counts."""
    place = orders.select("query_id", F.posexplode("order").alias("to", "at")).groupBy("query_id", "at").agg(F.min("to").alias("to"))
    rows = candidates.filter(F.col("rank") <= depth).withColumn("at", F.col("rank") - 1)
    return ranked(rows.drop("rank", "score").join(place, ["query_id", "at"]).withColumn("score", -F.col("to").cast("double")).drop("at", "to"), k)


def funnel(lexical: DataFrame, vector: DataFrame, fused: int = 20, kept: int = 10) -> DataFrame:
    """Fuse, keep the best 20, then 10: what a search returns is never more."""
    return ranked(ranked(rrf(lexical, vector), fused).drop("rank"), kept)


def cross_reranked(candidates: DataFrame, logit: Column, quality: DataFrame, k: int) -> DataFrame:
    """The best min(3 k, 50) candidates by a pair model's score, times quality, sorted anew. quality is joined by doc_id."""
    best = reranked(candidates, logit, min(3 * k, 50))
    return ranked(quality_weighted(best.drop("rank"), quality, half=False), k)


def unreranked(candidates: DataFrame, k: int = 10) -> DataFrame:
    """The first k, as they are."""
    return candidates.filter(F.col("rank") <= k)
