"""Labelled rows for the classifiers: never the held-out fifth, and a bounded sample of the rest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, most: int, id_col: str = "doc_id", text_col: str = "text", most_chars: int = 1 << 26) -> DataFrame:
    """``docs`` joined with at most ``most`` of the labelled rows that aren't held out, as column __label.

    The sample is the rows with the lowest hash of the id: the same at every run, and of a size that doesn't grow, so it
    is broadcast and each row of ``docs`` is looked up in it. Of rows that share an id all are met, so they are counted again
    here; rows beyond ``most``, or ``most_chars`` characters of whole texts, are left out, in the order of the hash.
    Both bounds are settled on ids, lengths and hashes; texts are fetched, and only those that stay, once that is done. An id with
    conflicting labels has 1. Returned are the id, the text and __label, a row for each row that stays, equal ones too.
    """
    known = labels.select(F.col(id_col).alias("__id"), F.col(label).cast("int").alias("__label"))
    known = known.filter(F.col("__id").isNotNull() & F.col("__label").isin(0, 1) & ~held_out(F.col("__id")))
    known = known.groupBy("__id").agg(F.max("__label").alias("__label"))
    known = known.withColumn("__h", F.xxhash64(F.lit(11), "__id")).orderBy("__h", "__id").limit(most)
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    met = rows.join(F.broadcast(known), "__id").select("__id", "__label", "__h", F.coalesce(F.char_length("__text"), F.lit(0)).cast("long").alias("__chars"), F.xxhash64("__text").alias("__t"))
    met = met.orderBy("__h", "__id", "__t").limit(most)  # numbers of a bounded count of rows, so one window may go over them
    upto = F.sum("__chars").over(Window.orderBy("__h", "__id", "__t").rowsBetween(Window.unboundedPreceding, 0))
    kept = met.withColumn("__upto", upto).filter(F.col("__upto") <= most_chars).groupBy("__id", "__t", "__chars", "__label").agg(F.count("*").alias("__n"))
    length = F.coalesce(F.char_length("__text"), F.lit(0)).cast("long")
    texts = rows.withColumn("__t", F.xxhash64("__text")).withColumn("__chars", length).join(F.broadcast(kept), ["__id", "__t", "__chars"])
    #: Rows equal in id and text are merged before they are shuffled, and come back as often as they stay.
    texts = texts.groupBy("__id", "__t", "__chars", "__label", "__n").agg(F.min("__text").alias("__text"))
    texts = texts.withColumn("__k", F.explode(F.sequence(F.lit(1), F.col("__n").cast("int"))))
    return texts.select(F.col("__id").alias(id_col), F.col("__text").alias(text_col), "__label")
