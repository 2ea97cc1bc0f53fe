"""Lexical retrieval for all queries at once: BM25, keyword overlap with routing, substrings."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import any_of, blank_tokens, overlap
from ..sources.shared import written
from ..sources.tables import dealt
from .ranking import ranked

# Okapi BM25.
K1, B, EPSILON = 1.5, 0.75, 0.25


#: Documents and queries of a group.
ROW_BLOCK, QUERY_BLOCK = 1 << 13, 256


@dataclass
class Bm25Index:
    """counted: (doc_id, dl, terms, tfs), a written table: a document's distinct terms, and how often it has each. What follows from it is
    worked out when it is first asked for, so an index that changes several times counts its terms once."""

    counted: DataFrame

    @cached_property
    def size(self) -> tuple[int, float]:
        one = self.counted.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl")).first()
        return one.n, one.avgdl or 0.0

    @property
    def n(self) -> int:
        return self.size[0]

    @property
    def avgdl(self) -> float:
        return self.size[1]

    @cached_property
    def terms(self) -> DataFrame:
        """(term, idf), distributed. A negative idf (a term of more than half the documents) becomes EPSILON times the mean idf before the repair."""
        df = self.counted.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
        terms = written(df.select("term", (F.log(F.lit(self.n) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("raw")), "terms")
        mean = terms.agg(F.avg("raw").alias("m")).first().m or 0.0
        return terms.select("term", F.when(F.col("raw") < 0, F.lit(EPSILON * mean)).otherwise(F.col("raw")).alias("idf"))


def counted(docs: DataFrame, tokens: Column, ident: str = "doc_id") -> DataFrame:
    """(doc_id, dl, terms, tfs): a document's terms are counted in its row, by a sort of its tokens; no token is a row of its own."""
    rows = docs.select(F.col(ident).alias("doc_id"), F.sort_array(tokens).alias("ts"))
    ends = "filter(transform(ts, (t, i) -> if(i + 1 = size(ts) or ts[i + 1] <> t, i, null)), i -> i is not null)"
    rows = rows.select("doc_id", F.size("ts").alias("dl"), "ts", F.expr(ends).alias("ends"))
    return rows.select("doc_id", "dl", F.expr("transform(ends, e -> ts[e])").alias("terms"), F.expr("transform(ends, (e, k) -> e - if(k = 0, -1, ends[k - 1]))").alias("tfs"))


def bm25_index(docs: DataFrame, tokens: Column, ident: str = "doc_id") -> Bm25Index:
    """Texts are cut into tokens once; frequencies and scores read the written counts."""
    return Bm25Index(written(counted(docs, tokens, ident), "counted"))


def changed(index: Bm25Index, added: DataFrame | None = None, tokens: Column | None = None, removed: DataFrame | None = None, ident: str = "doc_id") -> Bm25Index:
    """The index without the ``removed`` ids, then with the ``added`` documents; only these are cut into tokens.

    An id that is there already is replaced: its old tokens go.
    """
    rows = index.counted if removed is None else index.counted.join(removed.select(F.col(ident).alias("doc_id")).distinct(), "doc_id", "left_anti")
    if added is not None:
        rows = rows.join(added.select(F.col(ident).alias("doc_id")).distinct(), "doc_id", "left_anti").unionByName(counted(added, tokens, ident))
    return Bm25Index(written(rows, "counted"))


def saved(index: Bm25Index, path: str) -> None:
    """The counts as a Parquet table, from which ``loaded`` makes the index again."""
    index.counted.write.mode("overwrite").parquet(path)


def loaded(spark: SparkSession, path: str) -> Bm25Index:
    return Bm25Index(spark.read.parquet(path))


def weights(index: Bm25Index, queries: DataFrame, tokens: Column, ident: str = "query_id") -> DataFrame:
    """(query_id, term, w): idf times how often the query has the term."""
    asked = queries.select(F.col(ident).alias("query_id"), F.explode(tokens).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times"))
    return asked.join(index.terms, "term").select("query_id", "term", (F.col("idf") * F.col("times")).alias("w"))


def bm25_scores(index: Bm25Index, queries: DataFrame, tokens: Column, ident: str = "query_id") -> DataFrame:
    """(query_id, doc_id, score) of all documents that share a term with the query; repeated query terms count again."""
    each = index.counted.select("doc_id", "dl", F.explode(F.arrays_zip("terms", "tfs")).alias("e")).select("doc_id", "dl", F.col("e.terms").alias("term"), F.col("e.tfs").alias("tf"))
    length = F.lit(1 - B) + F.lit(B) * F.col("dl") / F.lit(index.avgdl or 1.0)
    part = F.col("w") * F.col("tf") * F.lit(K1 + 1) / (F.col("tf") + F.lit(K1) * length)
    return each.join(weights(index, queries, tokens, ident), "term").groupBy("query_id", "doc_id").agg(F.sum(part).alias("score"))


def bm25_search(index: Bm25Index, queries: DataFrame, tokens: Column, k: int = 50, row_block: int = ROW_BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """The exact best k of each query, of positive scores: (query_id, doc_id, score, rank).

    Blocks of documents meet blocks of queries, each pair in one group of bounded size, which scores its documents and returns its own
    best k of a query; only those go on. No pair (query, document) is a row before that.
    """
    w = weights(index, queries, tokens).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("term", "w"))).alias("q"))  # a query's own terms
    rows, asks = max(1, -(-index.n // row_block)), max(1, -(-queries.count() // query_block))
    right = w.select("query_id", F.col("q.term").alias("term"), F.col("q.w").alias("w"), F.pmod(F.xxhash64("query_id"), F.lit(asks)).cast("int").alias("j")).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(rows - 1))))
    left = index.counted.filter("doc_id is not null and size(terms) > 0").withColumn("i", F.pmod(F.xxhash64("doc_id"), F.lit(rows)).cast("int")).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(asks - 1))))
    kinds = dict(left.dtypes)["doc_id"], dict(right.dtypes)["query_id"]
    left, right = dealt(left, right, rows * asks, "i", "j")
    mean = index.avgdl or 1.0

    def run(docs: pa.Table, asked: pa.Table) -> pa.Table:
        place, row, scores = block_best(docs, asked, mean, k) if len(docs) and len(asked) else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        return pa.table({"query_id": asked["query_id"].take(pa.array(place)), "doc_id": docs["doc_id"].take(pa.array(row)), "score": pa.array(scores)})

    found = left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInArrow(run, f"query_id {kinds[1]}, doc_id {kinds[0]}, score double")
    return ranked(found, k)


def block_best(docs: pa.Table, asked: pa.Table, mean: float, k: int, places: int = 9) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The best k of each query in a block: places of queries, rows of documents, scores. docs: (doc_id, dl, terms, tfs); asked: (query_id, term, w)."""
    flat = lambda column: column.combine_chunks().flatten()
    sizes = lambda column: pc.list_value_length(column).to_numpy()
    names = pc.unique(flat(asked["term"]))
    code = pc.fill_null(pc.index_in(flat(docs["terms"]), value_set=names), -1).to_numpy()
    known = np.flatnonzero(code >= 0)
    known = known[np.argsort(code[known], kind="stable")]  # postings of a term together
    row = np.repeat(np.arange(len(docs)), sizes(docs["terms"]))[known]
    tf, dl = flat(docs["tfs"]).to_numpy()[known].astype(np.float64), docs["dl"].to_numpy()[row]
    part = tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / mean))
    first = np.searchsorted(code[known], np.arange(len(names) + 1))
    _, some, of = np.unique(docs["doc_id"].to_numpy(), return_index=True, return_inverse=True)  # in the order of ids
    of = of[row]
    ends = np.concatenate([[0], np.cumsum(sizes(asked["term"]))])
    term, w = pc.index_in(flat(asked["term"]), value_set=names).to_numpy(), flat(asked["w"]).to_numpy()
    out = []
    for n, (a, b) in enumerate(zip(ends[:-1], ends[1:], strict=True)):
        lists = [(slice(first[t], first[t + 1]), x) for t, x in zip(term[a:b], w[a:b], strict=True)]
        s = np.bincount(np.concatenate([of[x] for x, _ in lists]), np.concatenate([part[x] * y for x, y in lists]), len(some)).astype(np.float64)  # whole numbers where nothing is counted
        at = np.flatnonzero(s > 0)
        r = np.round(s[at], places)
        if len(at) > k:
            keep = r >= np.partition(r, len(r) - k)[len(r) - k]
            at, r = at[keep], r[keep]
        at = at[np.lexsort((at, -r))[:k]]
        out.append((np.full(len(at), n), some[at], s[at]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def routes(query: Column) -> Column:
    """The directories that a query leads to, in order."""
    low = F.lower(query)
    some = F.array_compact(F.array(*[F.when(any_of(low, parts), F.lit(path)) for path, parts in fixed.ROUTES]))
    return F.when(F.size(some) == 0, F.array(F.lit(fixed.ROUTE_ELSE))).otherwise(some)


def keyword_search(docs: DataFrame, queries: DataFrame, k: int = 10, least: float = 0.05) -> DataFrame:
    """docs: (doc_id, path, text); queries: (query_id, text). Only the directories that a query leads to are searched.

    Scores are rounded to three places before the sort; ties go by the place of the directory, then by doc_id. Documents meet
    queries through shared tokens, so nothing is compared that can't score.
    """
    asked = queries.select("query_id", F.array_distinct(blank_tokens(F.col("text"))).alias("q"), F.posexplode(routes(F.col("text"))).alias("dir_pos", "path"))
    own = docs.select("doc_id", "path", F.array_distinct(blank_tokens(F.col("text"))).alias("d"))
    hits = asked.select("query_id", "path", "dir_pos", F.size("q").alias("n"), F.explode("q").alias("token")).join(own.select("doc_id", "path", F.explode("d").alias("token")), ["path", "token"])
    shared = hits.groupBy("query_id", "doc_id", "path", "dir_pos", "n").agg(F.count("*").alias("c"))
    scored = shared.withColumn("raw", F.col("c") / F.greatest(F.col("n"), F.lit(1))).filter(F.col("raw") > least)
    scored = scored.select("query_id", "doc_id", "path", "dir_pos", F.round("raw", 3).alias("score"))
    order = ranked(scored.withColumn("place", F.col("dir_pos").cast("long") * F.lit(1 << 48) + F.col("doc_id")), k, ident="place")
    return order.drop("place", "dir_pos")


def overlap_score(query: Column, doc: Column) -> Column:
    return overlap(blank_tokens(query), blank_tokens(doc))


def substring_search(docs: DataFrame, word: str, limit: int, text: str = "text", ident: str = "doc_id") -> DataFrame:
    """The first rows, by id, that contain the word in any case."""
    return docs.filter(F.contains(F.lower(F.col(text)), F.lit(word.lower()))).orderBy(ident).limit(limit)


def like_search(docs: DataFrame, word: str, limit: int, text: str = "text", ident: str = "doc_id") -> DataFrame:
    """The same with case, and the constant score 0.5; the word is a value, never a part of a statement."""
    return docs.filter(F.contains(F.col(text), F.lit(word))).orderBy(ident).limit(limit).withColumn("score", F.lit(0.5))
