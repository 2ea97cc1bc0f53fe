"""One query for each operator over the driver's tables.

Documents stand for memories: category and type follow from doc_id, every third has no person, every second no metadata.
All benchmark items are the lexical queries; every vector whose id is divisible by 100 is a vector query, and vector 100 n belongs to
benchmark item n. What is relevant to an item contains its first 60 characters; to a vector, the same label.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import scoring as S
from ..functions import text as X
from ..functions.scoring import FACTORS
from ..operators import evaluate, fusion, labels, learn, lexical, plugins, segments, store, vector, vector_index
from ..operators.ranking import ranked
from ..sources import tables
from ..sources.shared import scratch, shared_dir, written
from ..sources.tables import table
from ..streaming import ordered
from .search import benchmark, bm25_quality, hybrid, indexed_text, quality_of

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

CATEGORIES = tuple(fixed.CATEGORY_LONG)
TYPES = ("code", "knowledge", "event", "conversation", "noise")
#: Words of the invented texts that stand for keywords, topics and the trigger.
KEYWORDS = ["nation", "tion", "ing", "die", "que"]
TOPICS = {"north": ["tion", "ing"], "south": ["que", "los"], "east": ["ver", "schaft"]}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def memories(spark: SparkSession, d: str) -> DataFrame:
    pick = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), (F.col("doc_id") % len(values) + 1).cast("int"))
    person = F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.col("source"))
    rows = tables.spread(table(spark, d, "documents").select("doc_id", "text", "lang", "source"), "doc_id")
    return rows.select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("content"), "lang", "source", pick(CATEGORIES).alias("category"), pick(TYPES).alias("type"), person.alias("person"), (F.col("doc_id") % 2 == 0).alias("has_metadata"))


def items(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("v"), "label")


def asked(spark: SparkSession, d: str) -> DataFrame:
    """(query_id, own, v, label): own is the query's vector itself, which a search leaves out."""
    return vectors(spark, d).filter(F.col("doc_id") % 100 == 0).select((F.col("doc_id") / 100).cast("long").alias("query_id"), F.col("doc_id").alias("own"), "v", "label")


def item_qrels(spark: SparkSession, d: str) -> DataFrame:
    """Documents that contain the first 60 characters of an item.

    Ids meet through the rarest word of those characters: words of documents are cut to the words of items, and counted, before
    anything is joined. Texts are compared for the pairs that are left. Characters without a word between blanks (one or two words, a
    script without blanks, none at all) have nothing to meet by: they are looked for in each text.
    """
    head = F.substr("text", F.lit(1), F.lit(60))
    inner = F.regexp_extract_all(head, F.lit(r"(?<=\s)\S+(?=\s)"), F.lit(0))
    heads = written(items(spark, d).select("query_id", head.alias("head"), F.array_distinct(inner).alias("words")), "heads")  # a table whose size is known
    own = heads.select("query_id", "head", F.explode("words").alias("word"))
    docs = memories(spark, d).select(F.col("id").alias("doc_id"), "content")
    words = docs.select("doc_id", F.explode(F.array_distinct(F.split("content", r"\s+"))).alias("word")).join(own.select("word").distinct(), "word", "left_semi")
    words = written(words, "words")
    often = words.groupBy("word").agg(F.count("*").alias("n"))
    rare = own.join(often, "word").groupBy("query_id", "head").agg(F.min_by("word", F.struct("n", "word")).alias("word"))
    pairs = rare.join(words, "word").select("query_id", F.col("doc_id").alias("own"), "head")
    out = pairs.join(docs, F.expr("own <=> doc_id")).filter(F.contains("content", F.col("head"))).select("query_id", "doc_id")
    rest = heads.filter(F.size("words") == 0).select("query_id", "head")
    if not rest.isEmpty():  # else the texts would be read for nothing
        out = out.unionByName(docs.join(rest, F.contains("content", F.col("head"))).select("query_id", "doc_id"))
    return out.distinct()


def same_label(spark: SparkSession, d: str, ranking: DataFrame) -> tuple[DataFrame, DataFrame]:
    return evaluate.same_label(ranking, asked(spark, d), vectors(spark, d))


def lexical_top(spark: SparkSession, d: str, k: int = 50) -> DataFrame:
    """The k best of each item, written: a short table, which is worked out once and which texts are joined to as they are read."""
    index = lexical.bm25_index(memories(spark, d), X.word_tokens(indexed_text()), "id")
    return written(lexical.bm25_search(index, items(spark, d), X.word_tokens(F.col("text")), k), "lexical")


def with_texts(spark: SparkSession, d: str, found: DataFrame) -> DataFrame:
    """found, a short written table, with the texts of item and document. It meets the documents first, while its size is known, so no text that
    wasn't found is shuffled."""
    return found.join(memories(spark, d).select(F.col("id").alias("doc_id"), "content"), "doc_id").join(items(spark, d), "query_id")


def vector_top(spark: SparkSession, d: str, k: int = 50) -> DataFrame:
    """The k best of each vector that is asked for, written, as several steps read them."""
    return written(vector.vector_search(vectors(spark, d), asked(spark, d), k, skip_self=True), "near")


def six(df: DataFrame) -> DataFrame:
    """Doubles to six places."""
    return df.withColumns({c: F.round(c, 6) + F.lit(0.0) for c, t in df.dtypes if t == "double"}).withColumns({c: F.col(c).cast("long") for c, t in df.dtypes if t == "int"})


# --- Search -----------------------------------------------------------------------------------------------------------


@query
def search_bm25_quality(spark: SparkSession, d: str) -> DataFrame:
    return six(bm25_quality(memories(spark, d), items(spark, d)))


@query
def hybrid_search(spark: SparkSession, d: str) -> DataFrame:
    return six(hybrid(memories(spark, d), vectors(spark, d), items(spark, d), asked(spark, d), weighted=False))


@query
def hybrid_search_quality(spark: SparkSession, d: str) -> DataFrame:
    return six(hybrid(memories(spark, d), vectors(spark, d), items(spark, d), asked(spark, d), least=0.85))


@query
def bm25_word_top50(spark: SparkSession, d: str) -> DataFrame:
    return six(lexical_top(spark, d))


@query
def bm25_char_top20(spark: SparkSession, d: str) -> DataFrame:
    index = lexical.bm25_index(memories(spark, d), X.char_tokens(indexed_text()), "id")
    return six(lexical.bm25_search(index, items(spark, d), X.char_tokens(F.col("text")), 20))


@query
def keyword_overlap(spark: SparkSession, d: str) -> DataFrame:
    docs = memories(spark, d).select(F.col("id").alias("doc_id"), F.concat(F.lit("/"), "category").alias("path"), X.overview(F.col("content")).alias("text"))
    asks = items(spark, d).withColumn("text", F.concat(F.lit("memory skill "), "text"))
    return six(lexical.keyword_search(docs, asks).withColumn("rank", F.col("rank").cast("long")))


@query
def intent_routing(spark: SparkSession, d: str) -> DataFrame:
    word = F.element_at(F.array(*[F.lit(w) for w in ("preference", "skill of a project", "Project memory", "history", "")]), (F.col("query_id") % 5 + 1).cast("int"))
    return six(items(spark, d).select("query_id", F.posexplode(lexical.routes(F.concat(word, F.lit(" "), "text"))).alias("place", "path")))


@query
def substring_search(spark: SparkSession, d: str) -> DataFrame:
    return lexical.substring_search(memories(spark, d), "THAT", 20, "content", "id").select("id", X.preview(F.col("content")).alias("preview"))


@query
def like_search(spark: SparkSession, d: str) -> DataFrame:
    return lexical.like_search(memories(spark, d), "tion", 20, "content", "id").select("id", "score")


@query
def cosine_topk(spark: SparkSession, d: str) -> DataFrame:
    return six(vector_top(spark, d))


@query
def dot_topk(spark: SparkSession, d: str) -> DataFrame:
    return six(vector.vector_search(vectors(spark, d), asked(spark, d), 10, "dot"))


@query
def l2_topk(spark: SparkSession, d: str) -> DataFrame:
    return six(vector.vector_search(vectors(spark, d), asked(spark, d), 10, "l2"))


@query
def ivf_topk(spark: SparkSession, d: str) -> DataFrame:
    return six(vector.ivf_search(vectors(spark, d), asked(spark, d)))


@query
def vector_index_topk(spark: SparkSession, d: str) -> DataFrame:
    """A stored index that two thirds of the vectors are built into and a third is added to, asked for all cells and a wide funnel."""
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}-vectors-{uuid4().hex}"
    rows = vectors(spark, d).select("doc_id", "v")
    index = vector_index.added(vector_index.built(rows.filter("doc_id % 3 > 0"), path), rows.filter("doc_id % 3 = 0"))
    return six(vector_index.search(index, asked(spark, d), share=1.0, refine=40))


@query
def index_sweep(spark: SparkSession, d: str) -> DataFrame:
    return six(vector.index_sweep(vectors(spark, d), asked(spark, d)))


@query
def rrf_one_based(spark: SparkSession, d: str) -> DataFrame:
    return six(ranked(fusion.rrf(lexical_top(spark, d), vector_top(spark, d)), 20))


@query
def rrf_zero_based(spark: SparkSession, d: str) -> DataFrame:
    return six(ranked(fusion.rrf(lexical_top(spark, d), vector_top(spark, d), first=0), 20))


@query
def rrf_or_vector(spark: SparkSession, d: str) -> DataFrame:
    return six(ranked(fusion.rrf_or_first(vector_top(spark, d), lexical_top(spark, d)), 10))


@query
def rrf_weighted_full(spark: SparkSession, d: str) -> DataFrame:
    """Of the memories that have a vector, all of them ranked by vector and by BM25."""
    docs = vectors(spark, d).join(memories(spark, d).select(F.col("id").alias("doc_id")), "doc_id", "left_semi")
    own = memories(spark, d).join(docs.select(F.col("doc_id").alias("id")), "id", "left_semi")
    asks = items(spark, d).join(asked(spark, d).select("query_id"), "query_id", "left_semi")
    lex = lexical.bm25_scores(lexical.bm25_index(own, X.word_tokens(indexed_text()), "id"), asks, X.word_tokens(F.col("text")))
    found = fusion.weighted_rrf_search(docs, asked(spark, d), lex, 0.7)
    return six(found.withColumn("score", F.round("score", 12) + F.lit(1e-10)))  # sums that end in 5 at the seventh place go up


@query
def linear_blend(spark: SparkSession, d: str) -> DataFrame:
    return six(ranked(fusion.linear_blend(vector_top(spark, d), lexical_top(spark, d), 0.6), 10))


@query
def rerank_embedding_quality(spark: SparkSession, d: str) -> DataFrame:
    m = memories(spark, d)
    q = m.select(F.col("id").alias("doc_id"), S.multiplicative_score(F.col("content"), F.col("type"), F.col("has_metadata")).alias("quality"))
    return six(ranked(fusion.quality_weighted(vector_top(spark, d, 20).drop("rank"), q, half=False, default=0.5), 10))


@query
def rerank_lexical(spark: SparkSession, d: str) -> DataFrame:
    texts = with_texts(spark, d, lexical_top(spark, d, 20))
    return six(fusion.reranked(texts, lexical.overlap_score(F.col("text"), F.substr("content", F.lit(1), F.lit(1000))), 10).select("query_id", "doc_id", "score", "rank"))


@query
def rerank_listwise(spark: SparkSession, d: str) -> DataFrame:
    reply = F.concat(F.lit("best: ["), F.col("query_id") % 5, F.lit(", 3, 99, 1]"))
    orders = items(spark, d).select("query_id", X.parsed_order(reply, F.lit(20)).alias("order"))
    return six(fusion.listwise(lexical_top(spark, d, 20), orders, 10).select("query_id", "doc_id", "score", "rank"))


@query
def rerank_plugin(spark: SparkSession, d: str) -> DataFrame:
    def shared(queries: list[str], docs: list[str]) -> list[float]:
        return [len(set(q.split()) & set(x.split())) / max(len(set(q.split())), 1) for q, x in zip(queries, docs, strict=True)]

    texts = with_texts(spark, d, lexical_top(spark, d, 20))
    return six(fusion.reranked(texts, plugins.pair_scored(F.col("text"), F.col("content"), shared), 10).select("query_id", "doc_id", "score", "rank"))


@query
def rerank_cross_quality(spark: SparkSession, d: str) -> DataFrame:
    """A pair model's score (here shared words) of the lexical best 50, times quality."""

    def shared(queries: list[str], docs: list[str]) -> list[float]:
        return [len(set(q.split()) & set(x.split())) / max(len(set(q.split())), 1) for q, x in zip(queries, docs, strict=True)]

    found = lexical_top(spark, d)
    m = memories(spark, d).join(found.select(F.col("doc_id").alias("id")).distinct(), "id", "left_semi")
    texts = found.join(items(spark, d), "query_id").join(m.select(F.col("id").alias("doc_id"), "content"), "doc_id")
    quality = m.select(F.col("id").alias("doc_id"), S.multiplicative_score(F.col("content"), F.col("type"), F.col("has_metadata")).alias("quality"))
    return six(fusion.cross_reranked(texts, plugins.pair_scored(F.col("text"), F.col("content"), shared), quality, 10).select("query_id", "doc_id", "score", "quality", "rank"))


@query
def rerank_none(spark: SparkSession, d: str) -> DataFrame:
    return six(fusion.unreranked(lexical_top(spark, d)))


@query
def formatted_results(spark: SparkSession, d: str) -> DataFrame:
    """What a search hands out: id, overview, score, tokens of the overview, category."""
    own = memories(spark, d).select(F.col("id").alias("doc_id"), "category", X.overview(F.col("content")).alias("content"))
    found = lexical_top(spark, d, 5).join(own, "doc_id")
    return six(found.select("query_id", F.col("doc_id").alias("id"), F.md5("content").alias("content"), "score", X.token_estimate(F.col("content")).alias("tokens"), "category"))


@query
def encode_plugin(spark: SparkSession, d: str) -> DataFrame:
    """The length of every text's vector, a digest of its elements to six places, and how many differ from 0: at most as many as words."""
    v = written(memories(spark, d).select("id", plugins.encoded(F.col("content")).alias("v")), "encoded")
    return v.select("id", F.size("v").cast("long").alias("dim"), F.sha2(F.array_join(F.transform("v", lambda x: F.format_string("%.6f", x)), ","), 256).alias("digest"), F.size(F.filter("v", lambda x: x != 0)).cast("long").alias("filled"))


# --- Text and layers --------------------------------------------------------------------------------------------------


@query
def layers(spark: SparkSession, d: str) -> DataFrame:
    parts = X.layered(F.col("content"))
    return memories(spark, d).select("id", *[F.sha2(c, 256).alias(k) for k, c in parts.items()], F.char_length(parts["l0"]).cast("long").alias("n0"), F.char_length(parts["l1"]).cast("long").alias("n1"), F.sha2(X.abstract(F.col("content"), "。"), 256).alias("l0_base"))


@query
def layer_selected(spark: SparkSession, d: str) -> DataFrame:
    parts = X.layered(F.col("content"))
    own = F.when(F.col("id") % 3 == 0, X.layer("l0", parts)).when(F.col("id") % 3 == 1, X.layer("l1", parts)).otherwise(X.layer("any", parts))
    return memories(spark, d).select("id", F.md5(own).alias("md5"))


@query
def token_stats(spark: SparkSession, d: str) -> DataFrame:
    parts = X.layered(F.col("content"))
    return memories(spark, d).select("id", *[X.token_estimate(c).alias(k) for k, c in parts.items()], X.token_estimate(*parts.values()).alias("total"))


@query
def tokenizers(spark: SparkSession, d: str) -> DataFrame:
    kinds = {"words": X.word_tokens, "chars": X.char_tokens, "raw_chars": X.raw_char_tokens, "blanks": X.blank_tokens}
    each = [c for k, f in kinds.items() for c in (F.size(f(F.col("content"))).cast("long").alias(k), F.md5(F.array_join(f(F.col("content")), "|")).alias(f"{k}_md5"))]
    return memories(spark, d).select("id", *each)


@query
def previews(spark: SparkSession, d: str) -> DataFrame:
    return memories(spark, d).select("id", X.preview(F.col("content")).alias("preview"))


@query
def compress(spark: SparkSession, d: str) -> DataFrame:
    rows = memories(spark, d).withColumns({**{k: c for k, c in X.layered(F.col("content")).items() if k != "l2"}, "compressed": F.col("id") % 4 == 0})
    return store.compressed(rows).select("id", "done", "compressed", F.md5("l0").alias("l0"), F.md5("l1").alias("l1"))


@query
def text_features(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("content")
    return six(memories(spark, d).select("id", *[F.regexp_count(t, F.lit(p)).cast("long").alias(k) for k, p in X.ENTITIES.items()], X.capitalised_count(t).cast("long").alias("capitalised"), X.count_of(t, fixed.ENTITY_WORDS).cast("long").alias("entity_words"), S.stop_share(F.lower(t), "etaoin").alias("share")))


@query
def parsers(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("item_id")
    reply = F.concat(F.lit("score: "), (n % 13).cast("string"), F.when(n % 2 == 0, "").otherwise(".25"), F.lit(" of 10"))
    verdict = F.concat(F.when(n % 4 == 0, "是 ").when(n % 4 == 1, "部分 是 ").otherwise("否 "), (n * 7 % 100).cast("string"), F.lit(" 分"))
    order = F.when(n % 3 == 0, F.lit("none")).otherwise(F.concat(F.lit("take [2, "), (n % 8).cast("string"), F.lit(", 0]")))
    return six(table(spark, d, "benchmark").select("item_id", X.parsed_score(reply).alias("score"), X.parsed_verdict(verdict).alias("verdict"), F.array_join(X.parsed_order(order, F.lit(5)).cast("array<string>"), ",").alias("order")))


@query
def judged_retrieval(spark: SparkSession, d: str) -> DataFrame:
    """The judge's reply and verdict on the best five of every item, by the first three long words of its text."""
    asks = items(spark, d).select("query_id", "text", F.slice(F.filter(F.split("text", " "), lambda w: F.char_length(w) >= 6), 1, 3).alias("expected"))
    own = lexical_top(spark, d, 5).join(memories(spark, d).select(F.col("id").alias("doc_id"), "content"), "doc_id")
    texts = own.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "content"))), lambda x: x["content"]).alias("found"))
    replies = asks.join(texts, "query_id", "left").select("query_id", plugins.judged(F.col("text"), F.col("expected"), F.coalesce("found", F.array().cast("array<string>"))).alias("reply"))
    replies = written(replies, "replies")  # the judge is asked once
    return replies.select("query_id", "reply", X.parsed_verdict(F.col("reply")).alias("verdict"))


@query
def store_stats(spark: SparkSession, d: str) -> DataFrame:
    return six(store.store_stats(S.with_additive(memories(spark, d), out="q"), quality="q"))


@query
def store_stats_all(spark: SparkSession, d: str) -> DataFrame:
    return six(store.store_stats(memories(spark, d), of_all=True))


@query
def type_distribution(spark: SparkSession, d: str) -> DataFrame:
    m = memories(spark, d)
    return six(store.top_counts(m, "type", 5).withColumn("what", F.lit("type")).unionByName(store.top_counts(m.filter("person <> ''"), "person", 5).withColumn("what", F.lit("person"))))


# --- Quality and noise ------------------------------------------------------------------------------------------------


def _additive(spark: SparkSession, d: str, edition: S.Additive) -> DataFrame:
    rows = S.with_additive(memories(spark, d).select("id", "content", "category"), edition=edition, dimensions=True)
    return six(rows.drop("content", "category"))


@query
def quality_additive_pro(spark: SparkSession, d: str) -> DataFrame:
    return _additive(spark, d, S.LONG)


@query
def quality_additive_full(spark: SparkSession, d: str) -> DataFrame:
    return _additive(spark, d, S.SHORT)


@query
def quality_stub(spark: SparkSession, d: str) -> DataFrame:
    return memories(spark, d).groupBy(S.stub_score(F.col("content")).alias("quality")).agg(F.count("*").alias("n"))


def _multiplied(spark: SparkSession, d: str) -> DataFrame:
    return memories(spark, d).withColumn("quality", S.multiplicative_score(F.col("content"), F.col("type"), F.col("has_metadata")))


@query
def quality_multiplicative(spark: SparkSession, d: str) -> DataFrame:
    return six(_multiplied(spark, d).select("id", "quality"))


@query
def quality_by_type(spark: SparkSession, d: str) -> DataFrame:
    return six(_multiplied(spark, d).groupBy("type").agg(F.count("*").alias("n"), F.avg("quality").alias("mean"), F.min("quality").alias("least"), F.max("quality").alias("most"), F.stddev_pop("quality").alias("std")))


@query
def quality_bands(spark: SparkSession, d: str) -> DataFrame:
    q = _additive(spark, d, S.LONG)
    return q.groupBy(S.quality_band(F.col("quality"), 0.93, 0.9).alias("band")).agg(F.count("*").alias("n"))


@query
def quality_predict(spark: SparkSession, d: str) -> DataFrame:
    f = S.learner_features(F.col("content"), F.col("type"), F.col("person"), F.col("has_metadata"))
    return six(memories(spark, d).select("id", S.predicted_quality(f, {"type": 0.9, "length": 0.95}).alias("quality")))


@query
def threshold_retention(spark: SparkSession, d: str) -> DataFrame:
    return six(store.retention(_multiplied(spark, d), "quality"))


@query
def cleanup_noise(spark: SparkSession, d: str) -> DataFrame:
    return store.cleaned(S.with_additive(memories(spark, d).select("id", "content", "category"), out="q"), "q", 0.9).groupBy("category").agg(F.count("*").alias("kept"))


@query
def noise_flags(spark: SparkSession, d: str) -> DataFrame:
    rows = memories(spark, d).select("id", F.explode(F.array(S.noise_counts(F.col("content")))).alias("n"))  # both tests read one count
    return rows.select("id", S.noisy(F.col("n")).alias("noise"), S.noisy(F.col("n"), 60, 0.05).alias("noise_strict"))


@query
def noise_ratio(spark: SparkSession, d: str) -> DataFrame:
    return six(memories(spark, d).select(S.is_noise(F.col("content")).alias("noise")).agg(F.count("*").alias("total"), F.count_if("noise").alias("noisy"), F.avg(F.col("noise").cast("double")).alias("ratio")))


@query
def noise_examples(spark: SparkSession, d: str) -> DataFrame:
    """The first ten noisy memories."""
    return memories(spark, d).filter(S.is_noise(F.col("content"), 60, 0.05)).orderBy("id").limit(10).select("id", X.preview(F.col("content")).alias("preview"))


@query
def percentages(spark: SparkSession, d: str) -> DataFrame:
    q = _multiplied(spark, d).groupBy("type").agg(F.count("*").alias("n"), F.avg((F.col("quality") >= 0.9).cast("double")).alias("share"))
    return q.select("type", X.percent(F.floor(F.col("share") * 100) / 100).alias("kept"))


@query
def scored_jsonl(spark: SparkSession, d: str) -> DataFrame:
    """Scored memories as JSON lines, read back."""
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}-scored-{uuid4().hex}"
    rows = memories(spark, d)
    tables.write_scored(rows.select("id", "content", "type", "has_metadata"), S.multiplicative_score(F.col("content"), F.col("type"), F.col("has_metadata")), path)
    return six(spark.read.schema("id long, type string, quality_score double, content string").json(path).select("id", "type", F.md5("content").alias("content"), "quality_score"))


@query
def embedding_cache(spark: SparkSession, d: str) -> DataFrame:
    """The cache saved and loaded again."""
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}-cache-{uuid4().hex}"
    own = vectors(spark, d).select(F.md5(F.col("doc_id").cast("string")).alias("key"), F.col("v").alias("embedding"), F.lit("2024-01-01").cast("timestamp").alias("cached_at"))
    tables.save_cache(own, path)
    got = tables.load_cache(spark, path)
    return six(got.select("key", F.size("embedding").cast("long").alias("dim"), F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double")).alias("total")))


@query
def dataset_conversion(spark: SparkSession, d: str) -> DataFrame:
    """A scale written as JSON lines, and one that isn't there: the counts of what was converted."""
    top = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}-scales-{uuid4().hex}"
    rows = memories(spark, d).select(F.col("id").cast("string").alias("id"), "content", "type")
    rows.write.json(f"{top}/in/small/memories.json")
    return tables.convert_scales(spark, f"{top}/in", f"{top}/out", ("small", "missing"), array=False)


@query
def batch_insert(spark: SparkSession, d: str) -> DataFrame:
    """Memories with the vector of their id; rows without one are left out of a batch."""
    own = vectors(spark, d).select(F.col("doc_id").alias("id"), F.col("v").alias("embedding"))
    return store.with_vectors(memories(spark, d).select("id", "category").join(own, "id", "left")).select("id", "category", F.size("embedding").cast("long").alias("dim"))


@query
def noise_accuracy(spark: SparkSession, d: str) -> DataFrame:
    truth = table(spark, d, "labels").select(F.col("doc_id").alias("id"), (F.col("quality") == 0).alias("noise"))
    q = S.with_additive(memories(spark, d).select("id", "content", "category").join(truth, "id")).withColumn("predicted", F.col("quality") < 0.9)
    return six(q.agg(F.count("*").alias("n"), F.avg((F.col("predicted") == F.col("noise")).cast("double")).alias("accuracy")))


# --- Evaluation -------------------------------------------------------------------------------------------------------


@query
def recall_mrr(spark: SparkSession, d: str) -> DataFrame:
    index = lexical.bm25_index(memories(spark, d), X.word_tokens(indexed_text()), "id")
    return six(evaluate.recall_mrr(lexical.bm25_search(index, items(spark, d), X.word_tokens(F.col("text")), 10), item_qrels(spark, d)))


@query
def precision_ndcg(spark: SparkSession, d: str) -> DataFrame:
    top = vector_top(spark, d, 10)
    rel, sizes = same_label(spark, d, top)
    return six(evaluate.metric_bundle(top, rel, sizes=sizes))


@query
def ab_quality_delta(spark: SparkSession, d: str) -> DataFrame:
    q = _multiplied(spark, d).select(F.col("id").alias("doc_id"), "quality")
    plain = vector_top(spark, d, 50)
    rel, sizes = same_label(spark, d, plain)
    better = ranked(fusion.quality_weighted(plain.drop("rank"), q, half=False, default=0.5).select("query_id", "doc_id", "score"), 10)
    names = ("recall_1", "recall_5", "recall_10", "mrr")
    return six(evaluate.compared(evaluate.recall_mrr(plain, rel, queries=sizes), evaluate.recall_mrr(better, rel, queries=sizes), names))


@query
def ab_quality_interval(spark: SparkSession, d: str) -> DataFrame:
    """The differences of ab_quality_delta with intervals over two hundred resamplings of the queries."""
    q = _multiplied(spark, d).select(F.col("id").alias("doc_id"), "quality")
    plain = vector_top(spark, d, 50)
    rel, sizes = same_label(spark, d, plain)
    better = ranked(fusion.quality_weighted(plain.drop("rank"), q, half=False, default=0.5).select("query_id", "doc_id", "score"), 10)
    return six(evaluate.paired_intervals(evaluate.first_hits(plain, rel, sizes), evaluate.first_hits(better, rel, sizes)))


@query
def alpha_sweep(spark: SparkSession, d: str) -> DataFrame:
    v, x = vector_top(spark, d), lexical_top(spark, d)
    rel, sizes = same_label(spark, d, v.unionByName(x))
    reports = {a: evaluate.recall_mrr(ranked(fusion.linear_blend(v, x, a), 10), rel, queries=sizes) for a in (0.0, 0.5, 1.0)}
    return six(evaluate.sweep(reports, "recall_5"))


@query
def near_duplicates(spark: SparkSession, d: str) -> DataFrame:
    return six(vector.pairs_above(vectors(spark, d).select(F.col("doc_id").alias("id"), "v"), 0.4))


@query
def duplicate_classes(spark: SparkSession, d: str) -> DataFrame:
    """How many near copies every vector has, and the class that it belongs to; no list of pairs."""
    return vector.links_above(vectors(spark, d).select(F.col("doc_id").alias("id"), "v"), 0.4)


@query
def duplicate_ratio(spark: SparkSession, d: str) -> DataFrame:
    return six(evaluate.linked_ratio(vector.links_above(vectors(spark, d).select(F.col("doc_id").alias("id"), "v"), 0.4)))


@query
def duplicate_samples(spark: SparkSession, d: str) -> DataFrame:
    """The first twenty pairs, with the beginnings of their texts."""
    pairs = vector.pairs_above(vectors(spark, d).select(F.col("doc_id").alias("id"), "v"), 0.4)
    return six(evaluate.duplicate_samples(pairs, memories(spark, d).select("id", F.col("content").alias("text"))))


@query
def benchmark_runs(spark: SparkSession, d: str) -> DataFrame:
    """All three kinds of retrieval over all items."""
    rel = written(item_qrels(spark, d), "relevant")
    runs = [benchmark(memories(spark, d), vectors(spark, d), items(spark, d), asked(spark, d), rel, kind) for kind in ("vector", "bm25", "hybrid")]
    return six(reduce(DataFrame.unionByName, runs))


@query
def bm25_incremental(spark: SparkSession, d: str) -> DataFrame:
    """An index that takes up a third of the documents later and then loses a seventh; only what is added is cut into tokens."""
    m = memories(spark, d)
    cut = X.char_tokens(indexed_text())
    index = lexical.bm25_index(m.filter("id % 3 > 0"), cut, "id")
    index = lexical.changed(index, m.filter("id % 3 = 0"), cut, ident="id")
    index = lexical.changed(index, removed=m.filter("id % 7 = 0").select("id"), ident="id")
    return six(lexical.bm25_search(index, items(spark, d), X.char_tokens(F.col("text")), 20))


def new_index(spark: SparkSession, m: DataFrame) -> segments.Segments:
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}-index-{uuid4().hex}"
    return segments.added(segments.opened(spark, path), m, X.word_tokens(indexed_text()), "id")


def grown_index(spark: SparkSession, d: str) -> segments.Segments:
    """An index through its life: half of the documents; four small additions, one of which replaces some of the first; a removal of
    every eleventh; a merge of what is due; a last removal. What is left: id % 11 > 0 and id % 13 > 0, where every 16th id has its lines
    in reverse."""
    m, cut = memories(spark, d), X.word_tokens(indexed_text())
    index = new_index(spark, m.filter("id % 8 < 4"))
    turned = m.filter("id % 16 = 0").withColumn("content", F.array_join(F.reverse(F.split("content", "\n")), "\n"))
    for part in (m.filter("id % 8 = 4"), m.filter("id % 8 = 5").unionByName(turned), m.filter("id % 8 = 6"), m.filter("id % 8 = 7")):
        index = segments.added(index, part, cut, "id")
    index = segments.removed(index, m.filter("id % 11 = 0"), "id")
    index = segments.merged(index, tuple(index.segments)[1:4])
    return segments.removed(index, m.filter("id % 13 = 0"), "id")


@query
def bm25_block_max(spark: SparkSession, d: str) -> DataFrame:
    """The same best 50 as bm25_word_top50, from an index whose blocks are skipped where they can't matter."""
    return six(segments.search(new_index(spark, memories(spark, d)), items(spark, d), X.word_tokens(F.col("text"))))


@query
def bm25_segments(spark: SparkSession, d: str) -> DataFrame:
    return six(segments.search(grown_index(spark, d), items(spark, d), X.word_tokens(F.col("text")), 20))


@query
def index_vocabulary(spark: SparkSession, d: str) -> DataFrame:
    """Every term of the index after its changes, and in how many live documents it is; n and mean length as columns."""
    index = grown_index(spark, d)
    return six(segments.vocabulary(index).withColumns({"n": F.lit(index.n).cast("long"), "avgdl": F.lit(index.avgdl)}))


@query
def embedding_drift(spark: SparkSession, d: str) -> DataFrame:
    return six(evaluate.drift(evaluate.halves(vectors(spark, d), F.col("doc_id"))))


@query
def text_match(spark: SparkSession, d: str) -> DataFrame:
    docs = memories(spark, d).select(F.col("id").alias("doc_id"), F.md5("content").alias("text"))
    got = lexical_top(spark, d, 10).join(docs, "doc_id").select("query_id", "rank", "text")
    want = got.filter("rank in (2, 5)").select("query_id", F.upper("text").alias("text")).unionByName(items(spark, d))
    return six(evaluate.text_match(got, want))


@query
def category_rollup(spark: SparkSession, d: str) -> DataFrame:
    m = memories(spark, d).withColumn("s", F.col("id") * 7 % 100)
    ok, some = F.count_if(F.col("s") >= 80), F.count_if(F.expr("s >= 50 and s < 80"))
    return six(m.groupBy("category").agg(F.count("*").alias("total"), ok.alias("success"), some.alias("partial"), ((ok + 0.5 * some) / F.count("*")).alias("rate")))


@query
def combined_score(spark: SparkSession, d: str) -> DataFrame:
    r, n = recall_mrr(spark, d).select(F.lit(1).alias("k"), "recall_1"), noise_accuracy(spark, d).select(F.lit(1).alias("k"), "accuracy")
    total = (F.col("recall_1") * 100 + F.col("accuracy") * 100) / 2
    return six(r.join(n, "k").select(total.alias("score"), F.when(total >= 80, "good").when(total >= 60, "fair").otherwise("poor").alias("band")))


# --- Labels -----------------------------------------------------------------------------------------------------------


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    return labels.query_memory_pairs(table(spark, d, "conversations"), F.contains(F.lower("reply"), F.lit("the")))


@query
def query_memory_pairs(spark: SparkSession, d: str) -> DataFrame:
    return six(_pairs(spark, d).select("conv_id", "turn", "place", F.md5("query").alias("query"), F.md5("memory").alias("memory")))


@query
def user_queries(spark: SparkSession, d: str) -> DataFrame:
    own = labels.user_queries(table(spark, d, "conversations"), ("<", "System:", "[cron:", "The "))
    return own.select("conv_id", "turn", F.md5(F.substr("text", F.lit(1), F.lit(300))).alias("query")).orderBy("conv_id", "turn").limit(100)


@query
def label_tasks(spark: SparkSession, d: str) -> DataFrame:
    return labels.label_tasks(_pairs(spark, d)).select("task_id", "conv_id", "turn", F.col("place").cast("long").alias("place"))


@query
def auto_label(spark: SparkSession, d: str) -> DataFrame:
    out = labels.auto_label(_pairs(spark, d), KEYWORDS)
    return six(out.select("conv_id", "turn", "place", F.array_join("shared", ",").alias("shared"), "auto_label", "confidence"))


@query
def topic_label(spark: SparkSession, d: str) -> DataFrame:
    out = labels.topic_label(_pairs(spark, d), TOPICS)
    return six(out.select("conv_id", "turn", "place", F.array_join("common", ",").alias("common"), "topic_label"))


def _merged(spark: SparkSession, d: str) -> DataFrame:
    auto = labels.auto_label(labels.label_tasks(_pairs(spark, d)), KEYWORDS).drop("label")
    manual = auto.filter(F.col("conv_id") % 3 == 0).select("task_id", (F.col("turn") % 2).cast("int").alias("manual_label"))
    return labels.merged_labels(auto, manual)


@query
def merge_labels(spark: SparkSession, d: str) -> DataFrame:
    return six(_merged(spark, d).select("task_id", "label"))


@query
def label_counts(spark: SparkSession, d: str) -> DataFrame:
    return six(labels.label_counts(_merged(spark, d)))


# --- Store ------------------------------------------------------------------------------------------------------------


@query
def latest_upsert(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("user_id", "event_id", "event_type", F.round("value", 6).alias("value"))
    half = F.col("event_id") % 2 == 0
    return store.upserted(e.filter(half), e.filter(~half), "user_id", "event_id")


@query
def access_counts(spark: SparkSession, d: str) -> DataFrame:
    reads = table(spark, d, "events").filter(F.col("event_type") == "view").select(F.col("user_id").alias("id"), "ts")
    return store.accessed(memories(spark, d).select("id", "category"), reads).select("id", "access_count", F.date_format("updated_at", "yyyy-MM-dd HH:mm:ss").alias("updated_at"))


@query
def cache_evict(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    last = e.agg(F.max("ts").alias("now")).first().now
    return store.cache_kept(e, F.lit(last), 7 * 86400, 50, "event_id", "ts").select("event_id")


@query
def directory_listing(spark: SparkSession, d: str) -> DataFrame:
    own = store.placed(memories(spark, d))
    return store.listing(store.directories(own, fixed.STANDARD_DIRECTORIES), own)


@query
def trajectory_counts(spark: SparkSession, d: str) -> DataFrame:
    x, v = lexical_top(spark, d), vector_top(spark, d)
    fused = written(ranked(fusion.rrf(x, v), 20), "fused")
    kept = fusion.quality_weighted(fused, quality_of(memories(spark, d), S.LONG, fused), 0.85)
    return six(store.stage_counts({"bm25": x, "vector": v, "fusion": fused, "quality": kept}))


@query
def last_entries(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("user_id", "event_id")
    return store.last_entries(e, 3, "user_id", "event_id")


# --- Learners ---------------------------------------------------------------------------------------------------------


def _events(spark: SparkSession, d: str) -> DataFrame:
    """Labels as feedback, in order of doc_id; the language is the domain."""
    f = S.learner_features(F.col("content"), F.col("type"), F.col("person"), F.col("has_metadata"))
    m = memories(spark, d).select("id", F.col("lang").alias("domain"), *[c.alias(k) for k, c in f.items()])
    return m.join(table(spark, d, "labels").select(F.col("doc_id").alias("id"), F.col("quality").cast("double").alias("feedback")), "id").withColumnRenamed("id", "seq")


@query
def adaptive_weights(spark: SparkSession, d: str) -> DataFrame:
    return six(learn.adaptive_weights(_events(spark, d)))


@query
def ordered_stream_weights(spark: SparkSession, d: str) -> DataFrame:
    """The events as a stream that comes out of order: four parts, each with some of the events of its neighbours' time."""
    at = scratch(spark, "stream")
    e = written(_events(spark, d), "events")
    span = e.agg(F.min("seq").alias("a"), F.max("seq").alias("b")).first()
    first, part = span.a or 0, max(1, -(-((span.b or 0) - (span.a or 0) + 1) // 4))
    e = e.withColumn("ts", F.timestamp_seconds(F.col("seq") - first + 1))
    place = F.col("seq") - first + F.pmod(F.xxhash64("seq"), F.lit(part)) - part // 2
    deal = F.least(F.greatest(F.floor(place / part), F.lit(0)), F.lit(3))
    end = e.select(F.timestamp_seconds(F.lit(12 * part)).alias("ts"), "domain", "seq", F.lit(None).cast("double").alias("feedback"), *FACTORS).limit(1)
    for k in range(5):
        (e.filter(deal == k).select(end.columns) if k < 4 else end).write.parquet(f"{at}/in/p{k}")
        stream = spark.readStream.schema(end.schema).parquet(f"{at}/in/*")
        ordered.run_ordered(stream, f"{at}/out", f"{at}/state", late=f"{3 * part} seconds", every_ms=1000 * part).awaitTermination()
    return six(ordered.latest_weights(spark, f"{at}/out"))


@query
def semi_adaptive_weights(spark: SparkSession, d: str) -> DataFrame:
    return six(learn.careful_weights(_events(spark, d)))


@query
def adjustment_log(spark: SparkSession, d: str) -> DataFrame:
    return six(learn.careful_weights(_events(spark, d), log=True).groupBy("domain", "feature").agg(F.count("*").alias("n"), F.sum("change").alias("change"), F.count_if("requires_review").alias("reviews")))


@query
def weights_resumed(spark: SparkSession, d: str) -> DataFrame:
    """Feedback in two parts, with the weights saved after the first one and loaded for the second: as if it were one."""
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}-weights-{uuid4().hex}"
    e = _events(spark, d)
    half = e.agg(F.percentile_approx("seq", 0.5).alias("m")).first().m
    learn.saved_weights(learn.adaptive_weights(e.filter(F.col("seq") <= half)), path)
    return six(learn.adaptive_weights(e.filter(F.col("seq") > half), start=learn.loaded_weights(spark, path)))


@query
def batch_update_weights(spark: SparkSession, d: str) -> DataFrame:
    """Batch feedback knows neither type, nor entities, nor metadata."""
    return six(learn.adaptive_weights(_events(spark, d).withColumns({"type": F.lit(1.0), "entity": F.lit(0.8), "metadata": F.lit(1.0)})))


@query
def learner_report(spark: SparkSession, d: str) -> DataFrame:
    e = _events(spark, d)
    return six(learn.learner_report(learn.careful_weights(e), learn.careful_weights(e, log=True), {"type": 0.9, "length": 1.1}))


@query
def effective_weights(spark: SparkSession, d: str) -> DataFrame:
    return six(learn.effective(learn.careful_weights(_events(spark, d)), {"type": 0.9, "length": 1.1}))
