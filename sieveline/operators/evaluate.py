"""Retrieval metrics, comparisons, duplicates and drift."""

from __future__ import annotations

import math
import time
from collections.abc import Callable
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.shared import written


def first_hits(ranking: DataFrame, qrels: DataFrame, queries: DataFrame | None = None) -> DataFrame:
    """(query_id, hit): the rank of the first relevant document, null if there is none; a row for each query."""
    every = (queries if queries is not None else qrels).select("query_id").distinct()
    hits = ranking.join(qrels.select("query_id", "doc_id").distinct(), ["query_id", "doc_id"]).groupBy("query_id").agg(F.min("rank").alias("hit"))
    return every.join(hits, "query_id", "left")


def same_label(ranking: DataFrame, queries: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What is relevant where rows of a query's label are: (query_id, doc_id) among the ranked pairs only, and (query_id, n), how many there
    are in all, from a count per label. queries: (query_id, own, label), own being a row that isn't its own result; rows: (doc_id, label)."""
    asks = queries.select("query_id", "own", "label")
    pairs = ranking.select("query_id", "doc_id").distinct().join(asks, "query_id").join(rows.select("doc_id", "label"), ["doc_id", "label"]).filter("own <> doc_id")
    sizes = asks.join(rows.groupBy("label").agg(F.count("*").alias("c")), "label").select("query_id", (F.col("c") - 1).alias("n"))
    return pairs.select("query_id", "doc_id"), sizes.filter("n > 0")


def recall_mrr(ranking: DataFrame, qrels: DataFrame, ks: tuple[int, ...] = (1, 5, 10), mrr_at: int = 10, queries: DataFrame | None = None) -> DataFrame:
    """One row: hit rates at each k and the mean reciprocal rank within mrr_at, over the queries given, or those of qrels."""
    hits = first_hits(ranking, qrels, queries)
    rate = lambda k: F.avg(F.coalesce((F.col("hit") <= k).cast("double"), F.lit(0.0)))
    return hits.agg(F.count("*").alias("queries"), *[rate(k).alias(f"recall_{k}") for k in ks], F.avg(F.when(F.col("hit") <= mrr_at, 1.0 / F.col("hit")).otherwise(0.0)).alias("mrr"))


def metric_bundle(ranking: DataFrame, qrels: DataFrame, recall_at: tuple[int, ...] = (1, 5, 10), precise_at: tuple[int, ...] = (5, 10), sizes: DataFrame | None = None) -> DataFrame:
    """One row: hit rate and recall at k, precision and binary NDCG at k, mean reciprocal rank (within 10).

    The ideal DCG has min(k, relevant) hits on top. With sizes, (query_id, n), qrels need only hold ranked pairs.
    """
    relevant = qrels.select("query_id", "doc_id").distinct()
    most = max(*recall_at, *precise_at)
    hits = ranking.filter(F.col("rank") <= most).join(relevant, ["query_id", "doc_id"])
    gains = [F.sum((F.col("rank") <= k).cast("long")).alias(f"h{k}") for k in sorted({*recall_at, *precise_at})]
    dcg = [F.sum(F.when(F.col("rank") <= k, 1.0 / F.log2(F.col("rank") + 1.0)).otherwise(0.0)).alias(f"d{k}") for k in precise_at]
    sizes = relevant.groupBy("query_id").agg(F.count("*").alias("n")) if sizes is None else sizes
    own = sizes.join(hits.groupBy("query_id").agg(F.min("rank").alias("hit"), *gains, *dcg), "query_id", "left")
    got = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    ideal = lambda k: F.aggregate(F.sequence(F.lit(1), F.least(F.col("n"), F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + 1.0 / F.log2(i + 1.0))
    return own.agg(
        F.count("*").alias("queries"),
        *[F.avg((got(f"h{k}") > 0).cast("double")).alias(f"hit_rate_{k}") for k in recall_at],
        *[F.avg(got(f"h{k}") / F.col("n")).alias(f"recall_{k}") for k in recall_at],
        *[F.avg(got(f"h{k}") / k).alias(f"precision_{k}") for k in precise_at],
        *[F.avg(got(f"d{k}") / ideal(k)).alias(f"ndcg_{k}") for k in precise_at],
        F.avg(F.when(F.col("hit") <= 10, 1.0 / F.col("hit")).otherwise(0.0)).alias("mrr"),
    )


def compared(a: DataFrame, b: DataFrame, metrics: tuple[str, ...]) -> DataFrame:
    """(metric, a, b, delta): two one-row reports side by side, the difference in percent points."""
    tall = lambda df, name: df.select(F.explode(F.map_from_arrays(F.array(*[F.lit(m) for m in metrics]), F.array(*[F.col(m).cast("double") for m in metrics]))).alias("metric", name))
    return tall(a, "a").join(tall(b, "b"), "metric").withColumn("delta", (F.col("b") - F.col("a")) * 100)


#: Where a uniform number makes Poisson(1) weights of 1, 2, ..: cumulated probabilities.
POISSON = tuple(np.cumsum([np.exp(-1) / float(math.factorial(k)) for k in range(8)]).round(12).tolist())


def paired_intervals(a: DataFrame, b: DataFrame, lanes: int = 200, level: float = 0.95, seed: int = 1, ks: tuple[int, ...] = (1, 5, 10), mrr_at: int = 10) -> DataFrame:
    """(metric, delta, low, high) in percent points: how far b's metrics are from a's on the same queries, with a bootstrap interval.

    a, b: (query_id, hit), the rank of the first relevant document or null, of the same queries. In each of the lanes a query counts Poisson(1)
    times, by a hash of (seed, query, lane): lanes and metrics are sums of one aggregation, combined before the shuffle, and no
    sample is drawn. Interval ends are order statistics of the lanes; a lane without weight has no difference.
    """
    gain = lambda c: [*[(F.coalesce(F.col(c) <= k, F.lit(False))).cast("double") for k in ks], F.when(F.col(c) <= mrr_at, 1.0 / F.col(c)).otherwise(0.0)]
    names = [*[f"recall_{k}" for k in ks], "mrr"]
    both = a.select("query_id", F.col("hit").alias("ha")).join(b.select("query_id", F.col("hit").alias("hb")), "query_id")
    each = both.select("query_id", *[(y - x).alias(m) for m, x, y in zip(names, gain("ha"), gain("hb"), strict=True)])
    laned = each.withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(lanes))))
    draw = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("query_id").cast("string"), F.col("lane").cast("string"))), 1, 13), 16, 10).cast("double") / float(16**13)
    weight = F.when(F.col("lane") == lanes, F.lit(1)).otherwise(reduce(lambda x, y: x + y, [(draw >= p).cast("int") for p in POISSON]))  # the last lane counts each query once
    sums = laned.withColumn("w", weight).groupBy("lane").agg(F.sum("w").alias("w"), *[F.sum(F.col("w") * F.col(m)).alias(m) for m in names])
    rate = lambda m: F.coalesce(F.try_divide(F.col(m), F.col("w")), F.lit(0.0)) * 100
    cut = int(lanes * (1 - level) / 2)
    tall = sums.select("lane", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), rate(m).alias("d")) for m in names])).alias("e")).select("lane", "e.*")
    order = F.array_sort(F.collect_list(F.when(F.col("lane") < lanes, F.col("d"))))
    out = tall.groupBy("metric").agg(F.max(F.when(F.col("lane") == lanes, F.col("d"))).alias("delta"), order.alias("all"))
    return out.select("metric", "delta", F.col("all")[cut].alias("low"), F.col("all")[lanes - 1 - cut].alias("high"))


def sweep(reports: dict[float, DataFrame], metric: str) -> DataFrame:
    """(parameter, value, best): a report for each parameter; the best one is the first with the highest value."""
    rows = reduce(DataFrame.unionByName, [r.select(F.lit(float(p)).alias("parameter"), F.col(metric).alias("value")) for p, r in reports.items()])
    order = Window.orderBy(F.desc(F.round("value", 9)), "parameter")  # as many rows as parameters
    return rows.withColumn("best", F.row_number().over(order) == 1)


def text_match(retrieved: DataFrame, expected: DataFrame) -> DataFrame:
    """Recall and reciprocal rank by equal text in any case. retrieved: (query_id, rank, text); expected: (query_id, text)."""
    want = expected.select("query_id", F.lower("text").alias("t")).distinct()
    got = retrieved.select("query_id", F.lower("text").alias("t"), "rank").groupBy("query_id", "t").agg(F.min("rank").alias("rank"))
    each = want.join(got, ["query_id", "t"], "left").groupBy("query_id").agg(F.avg(F.col("rank").isNotNull().cast("double")).alias("recall"), F.min("rank").alias("first"))
    return each.agg(F.count("*").alias("queries"), F.avg("recall").alias("recall"), F.avg(F.coalesce(1.0 / F.col("first"), F.lit(0.0))).alias("mrr"))


def linked_ratio(links: DataFrame) -> DataFrame:
    """The same row as ``duplicate_ratio`` from (id, n_links, ..): each pair is a link of both its rows."""
    inside = F.count(F.when(F.col("n_links") > 0, 1))
    one = links.agg(inside.alias("duplicates"), F.count("*").alias("total"), F.coalesce(F.floor(F.sum("n_links") / 2), F.lit(0)).cast("long").alias("pairs"))
    return one.withColumn("ratio", F.coalesce(F.try_divide("duplicates", "total"), F.lit(0.0)))


def duplicate_ratio(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """One row: pairs, rows that are in any, and their share of all rows."""
    inside = pairs.select(F.explode(F.array("a", "b")).alias("id")).agg(F.countDistinct("id").alias("duplicates"))
    n, p = rows.agg(F.count("*").alias("total")), pairs.agg(F.count("*").alias("pairs"))
    one = inside.withColumn("k", F.lit(1)).join(n.withColumn("k", F.lit(1)), "k").join(p.withColumn("k", F.lit(1)), "k").drop("k")
    return one.withColumn("ratio", F.coalesce(F.try_divide("duplicates", "total"), F.lit(0.0)))


def numbered(rows: DataFrame, *order: Column) -> DataFrame:
    """Adds position, from 0 in the given total order, without one task that sees all rows.

    Rows are dealt by sampled ranges of the order; a window numbers them inside a range, and the sizes of the ranges before
    it, as many as there are partitions, are added. The dealt rows are written once: a second dealing could sample otherwise.
    """
    keys = [f"__o{i}" for i in range(len(order))]
    dealt = rows.withColumns(dict(zip(keys, order, strict=True))).repartitionByRange(*keys).withColumn("__p", F.spark_partition_id())
    dealt = written(dealt, "ranges")
    sizes = dealt.groupBy("__p").agg(F.count("*").alias("__n"))
    before = sizes.withColumn("__b", F.sum("__n").over(Window.orderBy("__p")) - F.col("__n")).drop("__n")
    inside = F.row_number().over(Window.partitionBy("__p").orderBy(*keys)) - 1
    return dealt.withColumn("__i", inside).join(F.broadcast(before), "__p").withColumn("position", (F.col("__b") + F.col("__i")).cast("long")).drop("__p", "__b", "__i", *keys)


def halves(rows: DataFrame, *order: Column) -> DataFrame:
    """Adds old: whether a row is in the first half by ``order``; of an odd number the old half is the smaller."""
    return numbered(rows, *order).withColumn("old", F.col("position") < rows.count() // 2).drop("position")


def drift(rows: DataFrame) -> DataFrame:
    """One row of statistics of vectors (old, v): norms, centroids of the halves, means and variances of all elements."""
    from ..functions.vectors import norm

    one = rows.agg(F.count("*").alias("total"), F.avg(norm(F.col("v"))).alias("mean_norm"), F.stddev_pop(norm(F.col("v"))).alias("std_norm"))
    parts = rows.select("old", F.posexplode("v").alias("i", "x")).withColumn("x", F.col("x").cast("double"))
    c = parts.groupBy("i").agg(F.avg("x").alias("c"), F.avg(F.when(F.col("old"), F.col("x"))).alias("a"), F.avg(F.when(~F.col("old"), F.col("x"))).alias("b"))
    centroid = c.agg(
        F.sqrt(F.sum(F.col("c") * F.col("c"))).alias("centroid_norm"),
        F.sqrt(F.sum((F.col("a") - F.col("b")) * (F.col("a") - F.col("b")))).alias("centroid_shift"),
        F.try_divide(F.sum(F.col("a") * F.col("b")), F.sqrt(F.sum(F.col("a") * F.col("a"))) * F.sqrt(F.sum(F.col("b") * F.col("b")))).alias("centroid_cosine"),
    )
    new, old = F.when(~F.col("old"), F.col("x")), F.when(F.col("old"), F.col("x"))
    elements = parts.agg((F.avg(new) - F.avg(old)).alias("mean_change"), (F.var_pop(new) - F.var_pop(old)).alias("variance_change"))
    out = one.withColumn("k", F.lit(1)).join(centroid.withColumn("k", F.lit(1)), "k").join(elements.withColumn("k", F.lit(1)), "k").drop("k")
    return out.withColumn("level", F.when(F.col("centroid_cosine") < 0.95, "HIGH").when(F.col("centroid_cosine") < 0.98, "MODERATE").otherwise("LOW"))


def scale_sweep(runs: dict[str, Callable[[], DataFrame]]) -> DataFrame:
    """The reports of several scales, each with its name and the seconds it took; scales run one after the other, as the timing asks."""
    out = []
    for scale, run in runs.items():
        began = time.perf_counter()
        row = run().first()
        out.append((scale, time.perf_counter() - began, *row))
        names = row.__fields__
    kinds = ", ".join(f"`{k}` {'long' if isinstance(v, int) else 'double'}" for k, v in zip(names, row, strict=True))
    return SparkSession.active().createDataFrame(out, f"scale string, seconds double, {kinds}")


def duplicate_samples(pairs: DataFrame, texts: DataFrame, n: int = 20, most: int = 100) -> DataFrame:
    """The first pairs (a, b) with the beginnings of their texts (id, text)."""
    some = pairs.orderBy("a", "b").limit(n)
    cut = lambda side: texts.select(F.col("id").alias(side), F.substr("text", F.lit(1), F.lit(most)).alias(f"text_{side}"))
    return some.join(cut("a"), "a", "left").join(cut("b"), "b", "left")
