"""Ranked lists: (query_id, doc_id, score, rank), rank from 1, ties by rounded score to the smaller doc_id."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def ranked(scored: DataFrame, k: int | None = None, places: int = 9, by: str = "query_id", ident: str = "doc_id") -> DataFrame:
    """Adds rank. With k, Spark keeps the best k of each query before it shuffles (WindowGroupLimit)."""
    order = Window.partitionBy(by).orderBy(F.desc(F.round("score", places)), F.asc(ident))
    out = scored.withColumn("rank", F.row_number().over(order))
    return out.filter(F.col("rank") <= k) if k is not None else out
