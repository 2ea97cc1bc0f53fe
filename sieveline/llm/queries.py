"""The queries of this folder and, where SQL can express them, their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import bpe_round_trip, read_ranks
from .chat_format import chat_examples, conversation_digest
from .common import table
from .conversation_repair import damaged, repair
from .exact_dedup import exact_dedup
from .embedding_dedup import near_embeddings
from .labelled import held_out, training_rows
from .minhash_dedup import near_dedup
from .mixing import pfair_mix
from .pii_crf import KINDS, find_pii, fit_crf, labelled_table
from .quality_rules import fit_quality, quality_scores
from .repair_sql import CRC_TABLE, OP13_SQL, crc32
from .spelling import variants
from .suffix_dedup import remove_passages
from .toxicity import fit, scored
from .warc import archived


def _written_out(spans: Column) -> Column:
    """kind:start:end of the spans, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _of_kind(spans: Column, kind: int) -> Column:
    return F.filter(spans, lambda s: s["kind"] == kind)


def op1_pii_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_pii(docs, fit_crf(labelled_table()), keep_text=False)
    base = F.filter("pii", lambda s: s["base"])
    counts = [F.size(_of_kind(base, i)).cast("long").alias(f"n_{k}") for i, k in enumerate(KINDS)]
    added = F.size("pii").cast("long") - F.size(base)
    return found.select("doc_id", *counts, F.sha2(_written_out(base), 256).alias("base_sha256"), _written_out(F.col("pii")).alias("spans"), added.alias("n_added"))


def op2_suffix_radix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_passages(docs).drop("kept").withColumnRenamed("id", "doc_id")


#: Windows are cut from chunks of 256 bytes and their overlap, as SQL functions walk a long text from its start.
OP2_SQL = """
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS raw FROM documents),
h AS (SELECT doc_id, octet_length(raw) AS n, hex(raw) AS hx FROM d),
k AS (SELECT doc_id, n, hx, unnest(range((n + 255) // 256)) AS k FROM h),
p AS (SELECT doc_id, n, k, substr(hx, 512 * k + 1, 712) AS part FROM k),
w AS (SELECT doc_id, n, k, part, unnest(range(least(256, n - 256 * k))) AS j FROM p),
b AS (SELECT doc_id, 256 * k + j AS i, substr(part, 2 * j + 1, 2) AS byte, CASE WHEN 256 * k + j + 100 <= n THEN substr(part, 2 * j + 1, 200) END AS win FROM w),
f AS (SELECT doc_id, i, byte, win IS NOT NULL AND row_number() OVER (PARTITION BY win ORDER BY doc_id, i) > 1 AS later FROM b),
c AS (SELECT doc_id, i, byte, max(CASE WHEN later THEN i END) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 99 PRECEDING AND CURRENT ROW) IS NOT NULL AS gone FROM f),
g AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), false) AS opens FROM c)
SELECT h.doc_id, h.n AS n_bytes, count(*) FILTER (gone) AS n_removed, count(*) FILTER (opens) AS n_spans,
       sha256(unhex(coalesce(string_agg(byte, '' ORDER BY i) FILTER (NOT gone), ''))) AS kept_sha256
FROM h LEFT JOIN g USING (doc_id) GROUP BY h.doc_id, h.n
"""


#: Labelled rows that a classifier is fitted on, at most.
LABELLED_TOXIC, LABELLED_QUALITY = 6000, 8000


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    rows = training_rows(docs, labels, "toxic", LABELLED_TOXIC).select("doc_id", "text", "__label").toPandas().sort_values(["doc_id", "text"], kind="stable")
    model = fit([t or "" for t in rows["text"]], rows["__label"].tolist())
    out = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), scored(docs, model, F.col("text")).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def bpe_digest(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, n_tokens and the digests of ids and decoded text."""
    ranks = read_ranks(vocabulary)
    return bpe_round_trip(docs.select("doc_id", "text"), ranks, public_tokenizers.PATTERN, keep_text=False, raw=True).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digest(table(spark, sf_dir, "documents"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return exact_dedup(docs, keep="max").select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP5_SQL = """
WITH n AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM n WINDOW w AS (PARTITION BY text_sha256)
"""


def op6_e8_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_embeddings(table(spark, sf_dir, "embeddings").select("vec_id", "embedding")).withColumnRenamed("id", "vec_id")


def op7_pfair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return pfair_mix(docs).select("doc_id", "source", "source_block", "slot", "place")


#: Turns that hold the template's own control strings and its escape character.
PROBE = [(-7, 0, "user", "\\### Assistant: </turn> ok"), (-7, 1, "assistant", "\\### Assistant: </turn> ok")]


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame(PROBE, "conv_id long, turn long, role string, text string")
    return conversation_digest(chat_examples(turns.unionByName(probe)))


OP8_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
n AS (
  SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY conv_id) AS m,
         14 + length(role) + 4 * (length(role) - length(replace(role, '&', ''))) + 3 * (length(role) - length(replace(role, '<', '')))
            + 4 * (length(role) - length(replace(role, '#', ''))) + 6 * (length(role) - length(replace(role, ':', '')))
            + 3 * (length(role) - length(replace(role, chr(10), '')))
            + length(text) + 4 * (length(text) - length(replace(text, '&', ''))) + 3 * (length(text) - length(replace(text, '<', '')))
            + 4 * (length(text) - length(replace(text, '#', ''))) AS size
  FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
p AS (SELECT *, sum(size) OVER (PARTITION BY conv_id ORDER BY i) AS upto FROM n),
g AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY i) AS flat,
         coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '') AS loss,
         sum(upto) FILTER (role = 'assistant' OR i = m) AS formatted_chars
  FROM p GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(flat) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256,
       formatted_chars::BIGINT AS formatted_chars FROM g
""".replace("\\\\", "\\")


def op9_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_dedup(docs).select("doc_id", "class_id", "kept")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rules = fit_quality(docs, table(spark, sf_dir, "labels"), most=LABELLED_QUALITY)
    out = quality_scores(docs, rules, out_col="score")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(table(spark, sf_dir, "documents").select("doc_id", "text"))


#: Near words by what is left when a letter goes: the same at the same place, or the shorter word itself.
OP11_SQL = f"""
WITH RECURSIVE {CRC_TABLE},
runs AS (SELECT doc_id, translate(r, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS r, count(*) AS n
         FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\u00C0-\u00FF]{{7,}}')) AS r FROM documents) GROUP BY 1, 2),
bytes AS (SELECT r, n, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || r)) AS hx FROM runs),
hashed AS (SELECT r, n, {crc32("hx", "length(hx) // 2")} AS h FROM bytes, crc),
cut AS (SELECT CASE WHEN h % 31 = 0 THEN substr(r, 1, h % length(r)) || substr(r, h % length(r) + 2) ELSE r END AS word, n FROM hashed),
v AS (SELECT word, sum(n)::BIGINT AS n FROM cut WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
d AS (SELECT word, n, p, substr(word, 1, p) || substr(word, p + 2) AS rest FROM (SELECT word, n, unnest(range(length(word))) AS p FROM v)),
near AS (
  SELECT a.word, b.word AS other, b.n FROM d a JOIN d b ON a.rest = b.rest AND a.p = b.p AND a.word <> b.word
  UNION SELECT d.word, v.word, v.n FROM d JOIN v ON d.rest = v.word
  UNION SELECT v.word, d.word, d.n FROM d JOIN v ON d.rest = v.word),
best AS (SELECT word, count(*) AS n_near, arg_min(other, (-n, other)) AS other, max(n) AS top FROM near GROUP BY word),
formed AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN top >= 10 * v.n THEN other END AS form, CASE WHEN top >= 10 * v.n THEN top END AS form_n FROM v LEFT JOIN best USING (word)),
walk AS (SELECT word, word AS stop, 0 AS k FROM formed UNION ALL SELECT w.word, f.form, k + 1 FROM walk w JOIN formed f ON f.word = w.stop WHERE f.form IS NOT NULL),
roots AS (SELECT word, arg_max(stop, k) AS root FROM walk GROUP BY word)
SELECT f.word, f.form, r.root, f.n, f.n_near, f.form_n FROM formed f JOIN roots r USING (word)
"""


def op12_warc_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = archived(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: Base32 of 160 bits: eight times twenty bits, each four letters.
_BASE32 = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(s, {5 * i + 1}, 5))::INT >> {b}) & 31) + 1, 1)" for i in range(8) for b in (15, 10, 5, 0))
OP12_SQL = f"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
g AS (SELECT page_id, octet_length(b) AS payload_bytes, sha1(b) AS s, min(page_id) OVER (PARTITION BY b) AS first FROM p)
SELECT page_id, payload_bytes, {_BASE32} AS payload_digest, CASE WHEN page_id IS NOT DISTINCT FROM first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM g
"""


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(damaged(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii_crf": op1_pii_crf,
    "op2_suffix_radix": op2_suffix_radix,
    "op3_toxicity": op3_toxicity,
    "op4_byte_bpe": op4_byte_bpe,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_e8_lattice": op6_e8_lattice,
    "op7_pfair_mix": op7_pfair_mix,
    "op8_chat_format": op8_chat_format,
    "op9_order_minhash": op9_order_minhash,
    "op10_quality_rules": op10_quality_rules,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_warc_merge": op12_warc_merge,
    "op13_conversation_repair": op13_conversation_repair,
}

ORACLE_SQL: dict[str, str] = {
    "op2_suffix_radix": OP2_SQL, "op5_exact_dedup": OP5_SQL, "op8_chat_format": OP8_SQL,
    "op11_spelling_variants": OP11_SQL, "op12_warc_merge": OP12_SQL, "op13_conversation_repair": OP13_SQL,
}
