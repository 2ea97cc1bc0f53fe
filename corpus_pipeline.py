"""A training corpus from ``documents``: five stages, each over all that the one before it kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's docs. All but the last keep the columns of documents. The mixing stage decides the order: its rows are dealt by ranges
of their place and sorted, so the written files, read in the order of their names, are the interleaved corpus.

Defined cases, for every stage: a null or empty text counts as empty (the classifier scores it like any other, empty texts are copies
of one another, they have no tokens); null and repeated ids are rows of their own, and no stage multiplies them; of rows that are
equal in all, the exact stage keeps one, and every other stage treats each of them alike but for the near stage, which
keeps one too; an empty table gives an empty one; columns beside those of documents are dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.llm.bpe import bpe_round_trip, read_ranks
from sieveline.llm.common import forget, free_name, shuffle_partitions, table, written
from sieveline.llm.exact_dedup import exact_dedup
from sieveline.llm.minhash_dedup import near_dedup
from sieveline.llm.mixing import pfair_mix
from sieveline.llm.quality_rules import fit_quality, quality_scores
from sieveline.llm.queries import LABELLED_QUALITY, VOCABULARY, public_tokenizers

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble scores below 0.3 go."""
    rules = fit_quality(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"), most=LABELLED_QUALITY)
    score = free_name(docs, "score")
    return quality_scores(docs, rules, out_col=score).filter(F.col(score) >= 0.3).select(*COLUMNS)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the smallest doc_id stays."""
    return exact_dedup(docs, keep="min").filter("kept").select(*COLUMNS)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies one document stays."""
    return near_dedup(docs).filter("kept").select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order of the mixture."""
    ordered = pfair_mix(docs)
    return ordered.repartitionByRange(shuffle_partitions(spark), "place").sortWithinPartitions("place").select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of every text, and whether they decode to it."""
    ranks = read_ranks(VOCABULARY)
    out = bpe_round_trip(docs, ranks, public_tokenizers.PATTERN)
    same = F.col("decoded") == F.coalesce("text", F.lit(""))
    return out.select("doc_id", "lang", "source", "n_chars", "ids", F.size("ids").cast("long").alias("n_tokens"), same.alias("round_trip"))


STAGES = [
    ("quality classifier", quality),
    ("exact dedup", exact),
    ("MinHash near-dedup", near),
    ("mixing sources", mix),
    ("byte-level BPE", tokens),
]

#: The classifier, the sketches and the alignment can't be written in SQL; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            out = written(out, name.replace(" ", "-"))
            if i:
                forget(docs)
        docs = out
    return docs
