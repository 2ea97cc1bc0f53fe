"""A stored vector index: cells as Parquet partitions, residual codes, integer tables.

Layout: ``model`` (centres and code words, bounded by parameters), ``rows/cell=7`` (doc_id, code, off, v). Centres and code words are fitted on at
most ``sample`` rows; every row is in the cell of its nearest centre, and its code names, for each of ``subs`` parts of what it differs
from that centre, the nearest of ``words`` code words; off is the length of what the code leaves out. Rows that come later are coded with the same model and are files beside the others.

A search opens the partitions of the cells that its queries visit and no others, and of these the codes first. Queries visit
cells, nearest first, until these hold ``share`` of all rows. What a code word adds to a query's score is a table of whole numbers;
a group is a block of a cell's rows with a block of the queries that visit it, so no group grows with either. The best
``refine * k`` of a query by code are compared exactly, from the same partitions. With a share of 1 the search is exact: a row's cosine is at
most what its code says and ``off``, and each row for which that reaches the k-th best so far is compared too.

Defined cases: null vectors aren't indexed, and null queries find nothing; a zero vector has no cosine; ids are taken to differ; an empty
table gives an index in which nothing is found.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import cosine
from ..sources.shared import written
from .ranking import ranked
from .vector import OPEN, _best, _doubles, _means

#: Rows and queries of a group.
ROW_BLOCK, QUERY_BLOCK = 1 << 14, 256
#: Table entries lie between 0 and this, so that sums over all parts stay whole numbers of 32 bits.
FINE = (1 << 15) - 1


def _unit(v: np.ndarray) -> np.ndarray:
    return v / np.maximum(np.linalg.norm(v, axis=1), 1e-300)[:, None]


@dataclass(frozen=True)
class VectorIndex:
    """centres: a row a cell; books: code words of each part; parts: dimensions of each part; sizes: rows of each cell."""

    spark: SparkSession
    path: str
    centres: np.ndarray
    books: tuple[np.ndarray, ...]
    parts: tuple[np.ndarray, ...]
    sizes: np.ndarray

    def rows(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/rows")


def _append(index: VectorIndex, docs: DataFrame) -> VectorIndex:
    centres, books, parts = index.centres, index.books, index.parts

    def coded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                v = _unit(_doubles(pdf["v"]))
                cell = (v @ centres.T * 2 - (centres**2).sum(1)).argmax(1)
                rest = v - centres[cell]
                codes = np.stack([((b**2).sum(1)[None, :] - 2 * rest[:, p] @ b.T).argmin(1) for p, b in zip(parts, books, strict=True)], 1).astype(np.uint8)
                for i, (p, b) in enumerate(zip(parts, books, strict=True)):
                    rest[:, p] -= b[codes[:, i]]
                yield pdf.assign(code=[c.tobytes() for c in codes], off=np.linalg.norm(rest, axis=1), cell=cell.astype(np.int32))

    rows = docs.filter("v is not null").select("doc_id", F.col("v").cast("array<float>").alias("v"))
    salts = max(1, rows.count() >> 20)  # a cell with most rows is many files
    rows.mapInPandas(coded, f"doc_id {dict(rows.dtypes)['doc_id']}, v array<float>, code binary, off double, cell int").repartition("cell", F.pmod(F.xxhash64("doc_id"), F.lit(salts))).sortWithinPartitions("doc_id").write.partitionBy("cell").mode("append").parquet(f"{index.path}/rows")
    return opened(index.spark, index.path)


def built(docs: DataFrame, path: str, cells: int | None = None, subs: int = 16, words: int = 256, sample: int = 20_000, seed: int = 1) -> VectorIndex:
    """An index over (doc_id, v) at a new path. cells: by default twice the root of the rows, 16 at least and 4096 at most."""
    spark, path = docs.sparkSession, path.rstrip("/")
    known = docs.filter("v is not null")
    n = known.count()
    cells = cells or int(min(4096, max(16, 2 * n**0.5)))
    drawn = known.orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").limit(sample).select("v").toPandas()
    x = _unit(_doubles(drawn["v"])) if len(drawn) else np.zeros((1, 1))
    rng = np.random.default_rng(seed)
    centres = _means(x, min(cells, len(x)), rng)
    near = (x @ centres.T * 2 - (centres**2).sum(1)).argmax(1)
    parts = np.array_split(np.arange(x.shape[1]), min(subs, x.shape[1]))
    books = [_means((x - centres[near])[:, p], min(words, 256, len(x)), rng) for p in parts]
    model = [(-1, i, c.tolist()) for i, c in enumerate(centres)] + [(p, i, w.tolist()) for p, b in enumerate(books) for i, w in enumerate(b)]
    spark.createDataFrame(model, "part int, i int, v array<double>").coalesce(1).write.parquet(f"{path}/model")
    return _append(VectorIndex(spark, path, centres, tuple(books), tuple(parts), np.zeros(len(centres), np.int64)), docs)


def opened(spark: SparkSession, path: str) -> VectorIndex:
    """Reads the model, which parameters bound, and how many rows each cell has."""
    path = path.rstrip("/")
    model = spark.read.parquet(f"{path}/model").toPandas().sort_values(["part", "i"])
    centres = _doubles(model[model.part == -1]["v"])
    books = tuple(_doubles(b["v"]) for p, b in model.groupby("part") if p >= 0)
    sizes = np.zeros(len(centres), np.int64)
    rows = spark.read.schema("doc_id long, cell int").parquet(f"{path}/rows")
    for r in rows.groupBy("cell").count().collect():
        sizes[r.cell] = r["count"]
    return VectorIndex(spark, path, centres, books, tuple(np.array_split(np.arange(centres.shape[1]), len(books))), sizes)


def added(index: VectorIndex, docs: DataFrame) -> VectorIndex:
    """With more rows (doc_id, v): new files in the partitions they belong to; nothing there is read or written again."""
    return _append(index, docs)


def visited(near: np.ndarray, sizes: np.ndarray, share: float) -> np.ndarray:
    """Cells of each query, nearest first: whether it is visited. The first is, and others while all hold at most ``share`` of the rows."""
    held = np.cumsum(sizes[near], axis=1)
    out = held <= share * sizes.sum()
    out[np.arange(len(near)), (sizes[near] > 0).argmax(1)] = True  # the first that isn't empty
    return out & (sizes[near] > 0)


def tables(q: np.ndarray, books: tuple[np.ndarray, ...], parts: tuple[np.ndarray, ...]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """For unit queries: per part a table (query, word) of whole numbers, and what a step of them and nought are worth."""
    raw = [q[:, p] @ b.T for p, b in zip(parts, books, strict=True)]
    low = [t.min(1) for t in raw]
    step = np.maximum(np.max([t.max(1) - m for t, m in zip(raw, low, strict=True)], axis=0), 1e-12) / FINE
    return [np.rint((t - m[:, None]) / step[:, None]).astype(np.int32) for t, m in zip(raw, low, strict=True)], step, np.sum(low, axis=0)


def search(index: VectorIndex, queries: DataFrame, k: int = 10, share: float = 0.1, refine: int = 8, skip_self: bool = False, counts: dict[str, int] | None = None) -> DataFrame:
    """The best k by cosine of (query_id, v), with skip_self also own, the doc_id that a query leaves out: (query_id, doc_id, score, rank).
    With a share of 1 these are the exact best, ties to the smaller doc_id.

    counts takes the rows of the index, the rows scored by code (over all queries), and the partitions opened.
    """
    spark, centres, books, parts, sizes = index.spark, index.centres, index.books, index.parts, index.sizes
    queries = queries.filter("v is not null").select("query_id", F.col("v").cast("array<double>").alias("v"), (F.col("own") if skip_self else F.lit(None).cast("long")).alias("own"))
    empty = queries.select("query_id", F.lit(None).cast("long").alias("doc_id"), F.lit(0.0).alias("score")).limit(0)
    m = queries.count()
    if not m or not sizes.sum():
        return ranked(empty, k)

    whole = share >= 1  # every query visits all: a block of rows is of any cells then, and a query is one row

    def probing(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                v = _unit(_doubles(pdf["v"]))
                if whole:
                    yield pd.DataFrame({"query_id": pdf["query_id"], "q": list(v), "cell": np.int32(-1)})
                    continue
                near = np.argsort(-(v @ centres.T), axis=1, kind="stable")
                r, c = np.nonzero(visited(near, sizes, share))
                yield pd.DataFrame({"query_id": pdf["query_id"].to_numpy()[r], "q": list(v[r]), "cell": near[r, c].astype(np.int32)})

    asks = written(queries.mapInPandas(probing, "query_id long, q array<double>, cell int"), "probes")
    cells = np.flatnonzero(sizes).tolist() if whole else [r.cell for r in asks.select("cell").distinct().collect()]  # at most as many as there are centres
    if counts is not None:
        probed = asks.groupBy("cell").count().collect()
        counts.update(rows=int(sizes.sum()) * m, scored=int(sum((sizes.sum() if whole else sizes[r.cell]) * r["count"] for r in probed)), partitions=len(cells))
    opened_rows = index.rows() if whole else index.rows().filter(F.col("cell").isin(cells))
    codes = opened_rows.select("doc_id", "code", "cell", (F.lit(-1) if whole else F.col("cell")).alias("g"))
    asks = asks.withColumnRenamed("cell", "g")
    row_blocks = F.lit(max(1, -(-int(sizes.sum()) // ROW_BLOCK))) if whole else F.element_at(F.array(*[F.lit(max(1, -(-int(s) // ROW_BLOCK))) for s in sizes]), F.col("g") + 1)
    query_blocks = max(1, -(-m // QUERY_BLOCK))
    left = codes.withColumn("i", F.pmod(F.xxhash64("doc_id"), row_blocks)).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))
    right = asks.withColumn("j", F.pmod(F.xxhash64("query_id"), F.lit(query_blocks)).cast("int")).withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), row_blocks.cast("long") - 1)))

    def scored(rows: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
        if rows.empty or asks.empty:
            return pd.DataFrame({"query_id": [], "doc_id": [], "score": []}).astype({"query_id": "int64", "doc_id": "int64"})
        own, ids, q = np.frombuffer(b"".join(rows["code"]), np.uint8).reshape(len(rows), -1), rows["doc_id"].to_numpy(), _doubles(asks["q"])
        table, step, nought = tables(q, books, parts)
        kinds, cell = np.unique(rows["cell"].to_numpy(), return_inverse=True)
        at_centre, out = q @ centres[kinds].T, []
        for a in range(0, len(q), 16):  # what is held is 16 times a block's rows
            sums = np.zeros((len(q[a : a + 16]), len(own)), np.int32)
            for p, t in enumerate(table):
                sums += t[a : a + 16][:, own[:, p]]
            n = min(refine * k + skip_self, len(own))
            score = sums * step[a : a + 16, None] + nought[a : a + 16, None] + at_centre[a : a + 16][:, cell]
            best = np.argpartition(-score, n - 1, axis=1)[:, :n]
            score = np.take_along_axis(score, best, 1)
            out.append(pd.DataFrame({"query_id": np.repeat(asks["query_id"].to_numpy()[a : a + 16], n), "doc_id": ids[best].ravel(), "score": score.ravel()}))
        return pd.concat(out)

    best = left.groupBy("g", "i", "j").cogroup(right.groupBy("g", "i", "j")).applyInPandas(scored, "query_id long, doc_id long, score double")
    best = written(ranked(best, refine * k + skip_self).select("query_id", "doc_id"), "coded")
    vectors = opened_rows.select("doc_id", "v")
    pairs = best.join(vectors, "doc_id").join(queries.withColumnRenamed("v", "q"), "query_id").filter(F.col("own").isNull() | (F.col("own") != F.col("doc_id")))
    found = ranked(pairs.select("query_id", "doc_id", cosine(F.col("q"), F.col("v")).alias("score")).filter("score is not null"), k)
    return found if share < 1 else _completed(index, queries, written(found, "found"), m, k)


def _completed(index: VectorIndex, queries: DataFrame, found: DataFrame, m: int, k: int) -> DataFrame:
    """The exact best k. found: the best k of some rows, whose k-th score says which others have to be compared.

    Blocks of rows meet blocks of queries, each pair in one group of bounded size, which returns its own best k of a query from what is
    not ruled out by code.
    """
    centres, books, parts = index.centres, index.books, index.parts
    blocks, query_blocks = max(1, -(-int(index.sizes.sum()) // ROW_BLOCK)), max(1, -(-m // QUERY_BLOCK))
    kth = found.groupBy("query_id").agg(F.when(F.count("*") == k, F.min("score")).alias("kth"))
    left = index.rows().withColumn("i", F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).cast("int")).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))
    right = queries.join(kth, "query_id", "left").withColumn("j", F.pmod(F.xxhash64("query_id"), F.lit(query_blocks)).cast("int")).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def run(rows: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"query_id": [], "doc_id": [], "score": []}).astype({"query_id": "int64", "doc_id": "int64"})]
        if len(rows) and len(asks):
            ids, cell, off, v, q = rows["doc_id"].to_numpy(), rows["cell"].to_numpy(), rows["off"].to_numpy(), _doubles(rows["v"]), _doubles(asks["v"])
            codes = np.frombuffer(b"".join(rows["code"]), np.uint8).reshape(len(rows), -1)
            own, least = asks["own"].to_numpy(), np.nan_to_num(asks["kth"].to_numpy(np.float64), nan=-np.inf) - 1e-8
            norm = np.linalg.norm(v, axis=1)
            q, v = _unit(q), v / np.where(norm > 0, norm, np.nan)[:, None]
            q[(q == 0).all(1)] = np.nan  # a zero vector has no cosine
            table, step, nought = tables(np.nan_to_num(q), books, parts)
            for a in range(0, len(q), 16):  # what is held is 16 times a block's rows
                some = slice(a, a + 16)
                sums = np.zeros((len(q[some]), len(ids)), np.int32)
                for p, t in enumerate(table):
                    sums += t[some][:, codes[:, p]]
                at_centre = np.nan_to_num(q[some]) @ centres.T
                most = sums * step[some, None] + (nought + len(parts) * step)[some, None] + at_centre[:, cell] + off[None, :]
                maybe = (most >= least[some, None]) & (own[some, None] != ids[None, :])
                score = np.full(maybe.shape, np.nan)
                if maybe.mean() > OPEN:
                    score = np.where(maybe, q[some] @ v.T, np.nan)
                else:
                    x, y = np.nonzero(maybe)
                    score[x, y] = (q[some][x] * v[y]).sum(1)
                x, y = _best(score, ids, k, 9)
                out.append(pd.DataFrame({"query_id": asks["query_id"].to_numpy()[some][x], "doc_id": ids[y], "score": score[x, y]}))
        return pd.concat(out)

    rest = left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInPandas(run, "query_id long, doc_id long, score double")
    return ranked(rest, k)
