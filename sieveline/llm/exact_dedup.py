"""Exact duplicate removal by content sort.

Rows are range-partitioned on their normalised content (Spark samples the splitters), sorted externally inside each
range, and the window operator compares every row with its neighbour in full, so that equal texts form one run.

The splitters look at a 64-character content prefix and at a 64-bit fingerprint of prefix, suffix and length, never at whole
texts: what the driver samples stays small. A text with more copies than one slice holds would fill a range alone. Such
texts are counted first (fingerprint, then hash of the whole text); there are at most ``rows / slice_rows`` of them, which
bounds what is broadcast. Their copies are cut into slices by doc_id; each slice is a run of its own, and the runs of one text
are put together by their SHA-256. Distinct texts with one fingerprint (templates) are cut by their hash, copies together.

Defined cases: a null text counts as empty; empty texts are equal to one another; rows that repeat both text and
``doc_id`` count one by one and exactly one of them stays; a null ``doc_id`` stays only when all ids of its group are
null; an empty table gives an empty result. Columns beside id and text pass through, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, drop_names, shuffle_partitions

RESULT = ("keep_id", "group_size", "kept", "text_sha256")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min", slice_rows: int | None = None) -> DataFrame:
    """Adds keep_id, group_size, kept and text_sha256 to every row of ``docs``.

    keep: "min" or "max", the identifier that stays. slice_rows: the most copies of one text in one run; by default half of
    what a shuffle partition holds on average, 256 at least.
    """
    spark, best = docs.sparkSession, {"min": F.min, "max": F.max}[keep]
    docs = drop_names(docs, *RESULT)
    cols = docs.columns
    if slice_rows is None:
        slice_rows = max(256, docs.count() // (2 * shuffle_partitions(spark)))
    text = F.coalesce(F.col("__r")[text_col], F.lit(""))
    norm, ident = ascii_lower(text), F.col("__r")[id_col]
    base = docs.select(F.struct(*[F.col(f"`{c}`") for c in cols]).alias("__r"))
    base = base.withColumn("__k", ascii_lower(F.left(text, F.lit(64))))
    base = base.withColumn("__f", F.xxhash64("__k", ascii_lower(F.right(text, F.lit(64))), F.char_length(text)))

    often = base.groupBy("__f").agg(F.count("*").alias("__nf")).filter(F.col("__nf") > slice_rows)
    hashed = base.join(F.broadcast(often), "__f").withColumn("__h", F.xxhash64(norm))
    hot = hashed.groupBy("__h").agg(F.count("*").alias("__nh")).filter(F.col("__nh") > slice_rows)
    hot_rows = hot.count()  # at most rows / slice_rows
    pieces = lambda n: F.ceil(F.col(n) / slice_rows)

    def runs(rows: DataFrame) -> DataFrame:
        """One run for each slice of a text."""
        placed = rows.withColumn(
            "__slice",
            F.when(F.col("__nh").isNotNull(), F.pmod(F.xxhash64(ident), pieces("__nh"))).when(F.col("__nf").isNotNull(), F.pmod("__h", pieces("__nf"))).otherwise(F.lit(0)),
        )
        placed = placed.withColumn("__hot", F.col("__nh").isNotNull()).drop("__h", "__nf", "__nh")
        placed = placed.repartitionByRange(shuffle_partitions(spark), "__k", "__f", "__slice").withColumn("__t", norm)
        run = Window.partitionBy("__k", "__f", "__slice", "__t")
        first = run.orderBy(F.asc_nulls_last("__id") if keep == "min" else F.desc_nulls_last("__id"))
        return (
            placed.withColumn("__id", ident)
            .withColumn("__sha", F.sha2("__t", 256))
            .select("__r", "__id", "__hot", "__sha", F.row_number().over(first).alias("__n"), best("__id").over(run).alias("__keep"), F.count("*").over(run).alias("__size"))
        )

    marked = base.join(F.broadcast(often), "__f", "left")
    marked = marked.withColumn("__h", F.when(F.col("__nf").isNotNull(), F.xxhash64(norm)))
    if hot_rows:
        hot = F.broadcast(hot)
        whole = (
            runs(base.join(F.broadcast(often), "__f").withColumn("__h", F.xxhash64(norm)).join(hot, "__h"))
            .filter(F.col("__n") == 1)
            .groupBy("__sha")
            .agg(best("__keep").alias("__keep_all"), F.sum("__size").alias("__size_all"))
            .filter(F.col("__size_all") > slice_rows)  # a colliding hash only; so the bound on what is broadcast holds
        )
        out = runs(marked.join(hot, "__h", "left")).join(F.broadcast(whole.withColumn("__hot", F.lit(True))), ["__hot", "__sha"], "left")
        group, size = F.coalesce("__keep_all", "__keep"), F.coalesce("__size_all", "__size")
    else:
        out = runs(marked.withColumn("__nh", F.lit(None).cast("long")))
        group, size = F.col("__keep"), F.col("__size")
    kept = (F.col("__n") == 1) & F.col("__id").eqNullSafe(group)
    return out.select(*[F.col("__r")[c].alias(c) for c in cols], group.alias("keep_id"), size.alias("group_size"), kept.alias("kept"), F.col("__sha").alias("text_sha256"))
