"""Vector retrieval: a stated set of queries against all rows, in blocks; ranks without rankings; an inverted-file index; pairs above a threshold."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import cosine, dot, squared_distance
from ..sources.shared import written
from ..sources.tables import dealt
from .ranking import ranked

METRICS = ("cosine", "dot", "l2")


def _scores(q: np.ndarray, d: np.ndarray, metric: str) -> np.ndarray:
    """Higher is better: for l2 the negative distance. A zero vector has no cosine."""
    s = q @ d.T
    if metric == "l2":
        return -np.sqrt(np.maximum((q**2).sum(1)[:, None] + (d**2).sum(1)[None, :] - 2 * s, 0))
    if metric == "cosine":
        with np.errstate(divide="ignore", invalid="ignore"):
            s = s / np.linalg.norm(q, axis=1)[:, None] / np.linalg.norm(d, axis=1)[None, :]
    return s


def _exact(q: np.ndarray, d: np.ndarray, s: np.ndarray, metric: str) -> np.ndarray:
    """Scores of pairs of rows; the expanded square of a small distance is coarse, so distances are taken again."""
    return -np.sqrt(((q - d) ** 2).sum(1)) if metric == "l2" else s


def _doubles(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64)


#: Queries of a group, rows of a group, and rows that are scored at a time.
QUERY_BLOCK, ROW_BLOCK, STEP = 1024, 1 << 14, 2048


def _blocks(docs: DataFrame, queries: DataFrame, query_block: int, row_block: int) -> tuple[DataFrame, DataFrame]:
    """Both sides dealt to groups (i, j): a block of rows and a block of the stated queries."""
    docs, queries = docs.filter("v is not null"), queries.filter("v is not null")
    n, m = docs.count(), queries.count()
    rows, asks = max(1, -(-n // row_block)), max(1, -(-m // query_block))
    left = docs.select("doc_id", F.col("v").cast("array<double>").alias("v"), F.pmod(F.xxhash64("doc_id"), F.lit(rows)).cast("int").alias("i")).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(asks - 1))))
    right = queries.withColumn("v", F.col("v").cast("array<double>")).withColumn("j", F.pmod(F.xxhash64("query_id"), F.lit(asks)).cast("int")).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(rows - 1))))
    return dealt(left, right, rows * asks, "i", "j")


def _best(s: np.ndarray, ids: np.ndarray, k: int, places: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (query, row) of the best k of each query by rounded score, then id; scores that are not numbers don't count."""
    r = np.where(np.isnan(s), -np.inf, np.round(s, places))
    n = r.shape[1]
    least = np.partition(r, n - k, axis=1)[:, n - k] if k < n else np.full(len(r), -np.inf)
    q, d = np.nonzero((r >= least[:, None]) & (r > -np.inf))
    order = np.lexsort((ids[d], -r[q, d], q))
    q, d = q[order], d[order]
    nth = np.arange(len(q)) - np.searchsorted(q, q)
    return q[nth < k], d[nth < k]


def vector_search(docs: DataFrame, queries: DataFrame, k: int = 50, metric: str = "cosine", skip_self: bool = False, block: int = QUERY_BLOCK, row_block: int = ROW_BLOCK, places: int = 9) -> DataFrame:
    """docs: (doc_id, v); queries: (query_id, v), with skip_self also own, the doc_id that a query leaves out. The exact best k of each.

    The queries are a stated set, held against all rows: blocks of queries meet blocks of rows, each pair in one group of
    bounded size, which returns its own best k of a query; only those go on. Nothing passes through the driver. Null vectors are
    skipped.
    """
    queries = queries.select("query_id", "v", "own") if skip_self else queries.select("query_id", "v")
    left, right = _blocks(docs, queries, block, row_block)

    def run(rows: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
        best = pd.DataFrame({"query_id": [], "doc_id": [], "score": []}).astype({"query_id": "int64", "doc_id": "int64"})
        if rows.empty or asks.empty:
            return best
        q = _doubles(asks["v"])
        for at in range(0, len(rows), STEP):
            some = rows.iloc[at : at + STEP]
            ids, d = some["doc_id"].to_numpy(), _doubles(some["v"])
            s = _scores(q, d, metric)
            if skip_self:
                s[asks["own"].to_numpy()[:, None] == ids[None, :]] = np.nan
            x, y = _best(s, ids, k + 16, places - 2)  # some more, as expanded squares are coarse
            new = pd.DataFrame({"query_id": asks["query_id"].to_numpy()[x], "doc_id": ids[y], "score": _exact(q[x], d[y], s[x, y], metric)})
            best = pd.concat([best, new])
            best["r"] = best["score"].round(places)
            best = best.sort_values(["query_id", "r", "doc_id"], ascending=[True, False, True]).groupby("query_id").head(k)
        return best[["query_id", "doc_id", "score"]]

    found = left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInPandas(run, "query_id long, doc_id long, score double")
    return ranked(found, k, places)


def ranks_among(docs: DataFrame, queries: DataFrame, wanted: DataFrame, metric: str, places: int = 9) -> DataFrame:
    """(query_id, doc_id, rank) of the wanted pairs (query_id, doc_id) in the complete ranking of all rows, which is never made.

    Each group of a block of rows counts how many of them come before a wanted one; the counts add up. Pairs without a score
    have no rank.
    """
    pair = wanted.select("query_id", "doc_id").distinct().join(queries.select("query_id", F.col("v").alias("q")), "query_id").join(docs.select("doc_id", "v"), "doc_id")
    score = cosine(F.col("q"), F.col("v")) if metric == "cosine" else dot(F.col("q"), F.col("v")) if metric == "dot" else -F.sqrt(squared_distance(F.col("q"), F.col("v")))
    pair = pair.select("query_id", "doc_id", score.alias("score")).filter("score is not null")
    asks = pair.groupBy("query_id").agg(F.collect_list("doc_id").alias("ids"), F.collect_list("score").alias("scores"))  # as many as are wanted of a query
    left, right = _blocks(docs, queries.select("query_id", "v").join(asks, "query_id"), QUERY_BLOCK // 8, ROW_BLOCK)

    def run(rows: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(rows) and len(asks):
            ids, d = rows["doc_id"].to_numpy(), _doubles(rows["v"])
            for query_id, v, own, scores in zip(asks["query_id"], asks["v"], asks["ids"], asks["scores"], strict=True):
                q, own = np.array(v, np.float64)[None, :], np.array(own, np.int64)
                s = np.round(_exact(q, d, _scores(q, d, metric)[0], metric), places)
                s, names = s[~np.isnan(s)], ids[~np.isnan(s)]
                order = np.lexsort((names, -s))
                s, names, r = -s[order], names[order], -np.round(np.array(scores), places)
                first, last = np.searchsorted(s, r), np.searchsorted(s, r, "right")
                ahead = first + [int((names[a:b] < i).sum()) for a, b, i in zip(first, last, own, strict=True)]
                out.append(pd.DataFrame({"query_id": query_id, "doc_id": own, "ahead": ahead}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "doc_id": [], "ahead": []}).astype("int64")

    counts = left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInPandas(run, "query_id long, doc_id long, ahead long")
    return counts.groupBy("query_id", "doc_id").agg((F.sum("ahead") + 1).alias("rank"))


def ivf_search(docs: DataFrame, queries: DataFrame, k: int = 10, cells: int | None = None, probes: int = 4, sample: int = 20_000, seed: int = 1) -> DataFrame:
    """The exact best k by cosine: k-means cells are fitted on a bounded sample, every row is put in a cell, and a query looks
    into its ``probes`` nearest cells, then into each other cell that may hold a better row than its k-th so far.

    The angle between a query and any row of a cell is at least that to the centre less that of the cell's farthest row. cells:
    by default the root of the number of rows, 16 at least and 1024 at most. Null and zero vectors have no cosine.
    """
    cells = cells or int(min(1024, max(16, docs.count() ** 0.5)))
    unit = lambda df, i: df.filter("v is not null").filter(F.exists("v", lambda x: x != 0)).select(i, F.transform("v", lambda x: x.cast("double")).alias("v")).withColumn("f", array_to_vector("v"))
    rows = unit(docs, "doc_id")
    drawn = rows.orderBy(F.xxhash64(F.lit(seed), "doc_id")).limit(sample)
    model = KMeans(k=cells, seed=seed, featuresCol="f", predictionCol="cell", distanceMeasure="cosine", maxIter=10).fit(drawn)
    centres = np.array(model.clusterCenters())
    placed = written(model.transform(rows).select("doc_id", "v", "cell"), "placed")
    table = docs.sparkSession.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "cell int, c array<double>")
    reach, sizes = np.zeros(len(centres)), np.zeros(len(centres), np.int64)
    for r in placed.join(F.broadcast(table), "cell").groupBy("cell").agg(F.min(cosine(F.col("c"), F.col("v"))).alias("least"), F.count("*").alias("n")).collect():
        reach[r.cell], sizes[r.cell] = np.pi if r.least is None else np.arccos(np.clip(r.least, -1, 1)), r.n
    first, parts, slots = _slots(sizes, ROW_BLOCK)
    of = lambda x: F.element_at(F.array(*[F.lit(int(i)) for i in x]), F.col("cell") + 1)
    left = placed.withColumn("i", (of(first) + F.pmod(F.xxhash64("doc_id"), of(parts))).cast("int"))
    asked = unit(queries, "query_id").select("query_id", "v")
    blocks = max(1, -(-asked.count() // QUERY_BLOCK))

    def hits(asks: DataFrame, again: bool) -> DataFrame:
        """Blocks of cells with blocks of queries, each pair in one group, which returns its own best k of a query from the cells that the
        query looks into: its nearest, or (``again``) the others that may hold a better row than its k-th so far."""

        def run(rows: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
            best = [pd.DataFrame({"query_id": [], "doc_id": [], "score": []}).astype({"query_id": "int64", "doc_id": "int64"})]
            if len(rows) and len(asks):
                q, v, ids, cell, who = _doubles(asks["v"]), _doubles(rows["v"]), rows["doc_id"].to_numpy(), rows["cell"].to_numpy(), asks["query_id"].to_numpy()
                s = np.nan_to_num(_scores(q, centres, "cosine"), nan=-1.0)
                look = np.zeros(s.shape, bool)
                np.put_along_axis(look, np.argsort(-s, axis=1, kind="stable")[:, :probes], True, 1)
                if again:
                    kth = asks["kth"].to_numpy(np.float64)[:, None]
                    look = ~look & (np.isnan(kth) | (np.cos(np.maximum(np.arccos(np.clip(s, -1, 1)) - reach, 0)) >= kth - 1e-6))
                for c in np.unique(cell):
                    own, some = np.flatnonzero(cell == c), np.flatnonzero(look[:, c])
                    for at in range(0, len(own) if len(some) else 0, STEP):
                        near = own[at : at + STEP]
                        t = _scores(q[some], v[near], "cosine")
                        x, y = _best(t, ids[near], k, 9)
                        best.append(pd.DataFrame({"query_id": who[some[x]], "doc_id": ids[near[y]], "score": t[x, y]}))
            found = pd.concat(best)
            found["r"] = found["score"].round(9)
            return found.sort_values(["query_id", "r", "doc_id"], ascending=[True, False, True]).groupby("query_id").head(k)[["query_id", "doc_id", "score"]]

        right = asks.withColumn("j", F.pmod(F.xxhash64("query_id"), F.lit(blocks))).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(slots - 1))))
        dealt = left.withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
        return dealt.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInPandas(run, "query_id long, doc_id long, score double")

    best = written(ranked(hits(asked, False), k).drop("rank"), "nearest")
    kth = best.groupBy("query_id").agg(F.when(F.count("*") == k, F.min("score")).alias("kth"))
    return ranked(best.unionByName(hits(asked.join(kth, "query_id", "left"), True)), k)


def _slots(sizes: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Cells dealt to slots of about ``block`` rows: each cell's first slot and how many it takes, and how many slots there are. Small cells share one."""
    first, parts, slot, held = np.zeros(len(sizes), np.int64), np.maximum(1, -(-sizes // block)), 0, 0
    for c, n in enumerate(sizes.tolist()):
        if held and held + n > block:
            slot, held = slot + 1, 0
        first[c] = slot
        held += n
        if parts[c] > 1:
            slot, held = slot + int(parts[c]), 0
    return first, parts, slot + 1


def _means(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    """k means of a bounded sample; a mean that nothing is nearest to stays where it is."""
    c = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        near = ((c**2).sum(1)[None, :] - 2 * x @ c.T).argmin(1)
        n = np.bincount(near, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        c[n > 0] = total[n > 0] / n[n > 0, None]
    return c


def pq_search(docs: DataFrame, queries: DataFrame, k: int = 10, cells: int = 64, subs: int = 32, probes: int | None = None, refine: int = 8, sample: int = 20_000, words: int = 64, seed: int = 1) -> DataFrame:
    """The best k by cosine through product quantisation: a row is the number of its cell and, for each of ``subs`` parts of what it
    differs from the cell's centre, the number of the nearest of ``words`` code words.

    Centres and code words are fitted on at most ``sample`` rows; every row is coded. A query adds up table entries for the rows
    of its ``probes`` nearest cells (three quarters of them by default), and the best ``refine * k`` are compared exactly.
    """
    unit = lambda v: v / np.maximum(np.linalg.norm(v, axis=1), 1e-300)[:, None]
    docs, queries = docs.filter("v is not null").select("doc_id", F.col("v").cast("array<double>").alias("v")), queries.filter("v is not null").select("query_id", F.col("v").cast("array<double>").alias("v"))
    drawn = [r.v for r in docs.orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").limit(sample).collect()]
    if not drawn:
        return ranked(docs.select(F.col("doc_id").alias("query_id"), "doc_id", F.lit(0.0).alias("score")).limit(0), k)
    rng, x = np.random.default_rng(seed), unit(np.array(drawn))
    centres = _means(x, cells, rng)
    near = (x @ centres.T * 2 - (centres**2).sum(1)).argmax(1)
    parts = np.array_split(np.arange(x.shape[1]), min(subs, x.shape[1]))
    books = [_means((x - centres[near])[:, p], words, rng) for p in parts]
    probes = probes or max(1, cells * 3 // 4)
    blocks = max(1, -(-docs.count() // (cells * ROW_BLOCK)))

    def coded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                v = unit(_doubles(pdf["v"]))
                cell = (v @ centres.T * 2 - (centres**2).sum(1)).argmax(1)
                rest = v - centres[cell]
                codes = np.stack([((b**2).sum(1)[None, :] - 2 * rest[:, p] @ b.T).argmin(1) for p, b in zip(parts, books, strict=True)], 1).astype(np.uint8)
                yield pd.DataFrame({"doc_id": pdf["doc_id"], "cell": cell.astype(np.int32), "code": [c.tobytes() for c in codes]})

    def probing(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                v = unit(_doubles(pdf["v"]))
                cell = np.argsort(-(v @ centres.T), axis=1, kind="stable")[:, :probes]
                n = cell.shape[1]
                yield pd.DataFrame({"query_id": np.repeat(pdf["query_id"].to_numpy(), n), "q": [list(r) for r in np.repeat(v, n, 0)], "cell": cell.ravel().astype(np.int32)})

    def scored(rows: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(rows) and len(asks):
            codes, ids = np.frombuffer(b"".join(rows["code"]), np.uint8).reshape(len(rows), -1), rows["doc_id"].to_numpy()
            for query_id, q in zip(asks["query_id"], asks["q"], strict=True):
                q = np.array(q)
                s = q @ centres[rows["cell"].iloc[0]] + sum((b @ q[p])[codes[:, i]] for i, (p, b) in enumerate(zip(parts, books, strict=True)))
                best = np.argpartition(-s, min(refine * k, len(s)) - 1)[: refine * k]
                out.append(pd.DataFrame({"query_id": query_id, "doc_id": ids[best], "score": s[best]}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "doc_id": [], "score": []}).astype({"query_id": "int64", "doc_id": "int64"})

    rows = docs.mapInPandas(coded, "doc_id long, cell int, code binary").withColumn("block", F.pmod(F.xxhash64("doc_id"), F.lit(blocks)))
    asks = queries.mapInPandas(probing, "query_id long, q array<double>, cell int").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    best = ranked(rows.groupBy("cell", "block").cogroup(asks.groupBy("cell", "block")).applyInPandas(scored, "query_id long, doc_id long, score double"), refine * k)
    pairs = best.select("query_id", "doc_id").join(docs, "doc_id").join(queries.withColumnRenamed("v", "q"), "query_id")
    return ranked(pairs.select("query_id", "doc_id", cosine(F.col("q"), F.col("v")).alias("score")).filter("score is not null"), k)


def index_sweep(docs: DataFrame, queries: DataFrame, configs: tuple[tuple[int, int], ...] = ((16, 16), (32, 16), (64, 32), (128, 64)), k: int = 5) -> DataFrame:
    """(partitions, sub_vectors, recall): the share of the exact best k that each configuration of the index finds."""
    exact = written(vector_search(docs, queries, k).select("query_id", "doc_id"), "exact")
    runs = []
    for cells, subs in configs:
        hits = exact.join(pq_search(docs, queries, k, cells, subs).select("query_id", "doc_id", F.lit(1).alias("hit")), ["query_id", "doc_id"], "left")
        runs.append(hits.agg(F.avg(F.coalesce("hit", F.lit(0)).cast("double")).alias("recall")).select(F.lit(cells).alias("partitions"), F.lit(subs).alias("sub_vectors"), "recall"))
    return reduce(DataFrame.unionByName, runs)


def _met(rows: DataFrame, threshold: float, block_rows: int, most_cells: int) -> DataFrame | None:
    """Rows (id, v) dealt to the pairs of blocks (i, j) that may hold a pair above the threshold: (id, v, own, i, j); None without rows.

    Rows belong to the cell of the nearest of some of them (those of the lowest hash). A row meets another cell only if its
    angle to the cell's centre, less that of the cell's farthest row, allows a cosine above the threshold; what is left out can't
    hold a pair. Cells beyond ``block_rows`` are cut, and each pair of blocks that meets is one group. Centres, which the driver
    sees, are ``most_cells`` at most.
    """
    kind = "array<float>" if dict(rows.dtypes)["v"] == "array<float>" else "array<double>"
    rows = rows.filter("v is not null").select("id", F.col("v").cast(kind).alias("v")).filter(F.exists("v", lambda x: x != 0))
    cells = min(most_cells, max(1, -(-rows.count() // block_rows)))
    limit = float(np.arccos(np.clip(threshold, -1, 1))) + 1e-9
    chosen = [r.v for r in rows.orderBy(F.xxhash64(F.lit(3), "id"), "id").limit(cells).collect()]
    if not chosen:
        return None
    centres = np.array(chosen)

    def angles(v: np.ndarray) -> np.ndarray:
        return np.arccos(np.clip(_scores(v, centres, "cosine"), -1, 1))

    def assigned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                own = angles(_doubles(pdf["v"]))
                yield pdf.assign(cell=own.argmin(1).astype("int32"), angle=own.min(1))

    placed = written(rows.mapInPandas(assigned, f"id long, v {kind}, cell int, angle double"), "cells")
    reach, parts = np.zeros(len(centres)), np.ones(len(centres), np.int64)
    for r in placed.groupBy("cell").agg(F.max("angle").alias("reach"), F.count("*").alias("n")).collect():
        reach[r.cell], parts[r.cell] = r.reach, -(-r.n // block_rows)
    first = np.concatenate([[0], np.cumsum(parts)])  # of each cell's blocks

    def dealt(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), 256):
                some = pdf.iloc[at : at + 256]
                own = angles(_doubles(some["v"])) - reach[None, :] <= limit
                cell = some["cell"].to_numpy()
                own[np.arange(len(some)), cell] = True
                block = first[cell] + some["part"].to_numpy() % parts[cell]
                meets = [np.concatenate([np.arange(first[x], first[x + 1]) for x in np.flatnonzero(o)]) for o in own]
                yield pd.DataFrame({"id": some["id"].to_numpy(), "v": some["v"].to_numpy(), "own": block, "meets": meets})

    dealt_rows = placed.select("id", "v", "cell", F.pmod(F.xxhash64("id"), F.lit(1 << 30)).alias("part")).mapInPandas(dealt, f"id long, v {kind}, own long, meets array<long>")
    return dealt_rows.select("id", "v", "own", F.explode("meets").alias("other")).select("id", "v", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))


def pairs_above(rows: DataFrame, threshold: float, block_rows: int = 2000, most_cells: int = 1024) -> DataFrame:
    """(a, b, similarity), a < b, of all pairs of rows (id, v) with a cosine above the threshold. Exact. Groups of copies give all their
    pairs: ``links_above`` gives what is usually asked for, a row for each row."""
    work = _met(rows, threshold, block_rows, most_cells)
    if work is None:
        return rows.select(F.col("id").alias("a"), F.col("id").alias("b"), F.lit(0.0).alias("similarity")).limit(0)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        same = pdf["i"].iloc[0] == pdf["j"].iloc[0]
        left, right = (pdf, pdf) if same else (pdf[pdf.own == pdf.i], pdf[pdf.own == pdf.j])
        if left.empty or right.empty:
            return pd.DataFrame({"a": [], "b": [], "similarity": []}).astype({"a": "int64", "b": "int64"})
        s = _scores(_doubles(left["v"]), _doubles(right["v"]), "cosine")
        x, y = np.nonzero(s > threshold)
        a, b = left["id"].to_numpy()[x], right["id"].to_numpy()[y]
        keep = a < b if same else np.ones(len(a), bool)
        return pd.DataFrame({"a": np.minimum(a, b)[keep], "b": np.maximum(a, b)[keep], "similarity": s[x, y][keep]})

    return work.groupBy("i", "j").applyInPandas(run, "a long, b long, similarity double")


#: Dimensions in front after the rotation, and the share of pairs that their bound may leave open before whole products are cheaper.
PREFIX, OPEN = 16, 0.05


def rotation(rows: DataFrame, sample: int = 4000) -> np.ndarray:
    """Orthogonal: the directions in which a bounded sample of (id, v), as unit vectors, is longest come first."""
    drawn = rows.orderBy(F.xxhash64(F.lit(5), "id"), "id").limit(sample).select("v").toPandas()
    x = _doubles(drawn["v"])
    x = x / np.maximum(np.linalg.norm(x, axis=1), 1e-300)[:, None]
    return np.linalg.eigh(x.T @ x)[1][:, ::-1].copy()


def joined_above(a: np.ndarray, b: np.ndarray, threshold: float, prefix: int = PREFIX) -> np.ndarray:
    """Which pairs of rotated unit vectors have a product above the threshold.

    The product of the first dimensions, and that of the norms of the rest, bound it; what the bound leaves open is worked out.
    """
    if a.shape[1] > prefix:
        rest = lambda v: np.linalg.norm(v[:, prefix:], axis=1)
        maybe = a[:, :prefix] @ b[:, :prefix].T + rest(a)[:, None] * rest(b)[None, :] > threshold - 1e-9
        x, y = np.nonzero(maybe)
        if len(x) <= OPEN * maybe.size:
            for at in range(0, len(x), 1 << 16):
                x_, y_ = x[at : at + (1 << 16)], y[at : at + (1 << 16)]
                maybe[x_, y_] = (a[x_] * b[y_]).sum(1) > threshold
            return maybe
    return a @ b.T > threshold


def _smallest_reached(links: np.ndarray) -> np.ndarray:
    """For a symmetric table of links: the smallest place that each place reaches."""
    low = np.arange(len(links))
    while True:
        near = np.where(links, low[None, :], len(links)).min(1, initial=len(links))
        new = np.minimum(low, near)
        new = new[new]
        if (new == low).all():
            return low
        low = new


def _joined(low: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """low, the smallest place that each place reaches so far, after the links (a, b)."""
    while True:
        p, q = low[a], low[b]
        apart = p != q
        if not apart.any():
            return low
        a, b, p, q = a[apart], b[apart], p[apart], q[apart]
        to = np.arange(len(low))
        np.minimum.at(to, np.maximum(p, q), np.minimum(p, q))
        while (to[to] != to).any():
            to = to[to]
        low = to[low]


def block_links(left: np.ndarray, right: np.ndarray | None, places: tuple[np.ndarray, np.ndarray], threshold: float, step: int = STEP) -> tuple[np.ndarray, np.ndarray]:
    """(links of each place, smallest place it reaches) of rotated unit vectors; without ``right`` the left ones among themselves.

    places: which place each row has. Products are made ``step`` by ``step`` rows at a time, so memory holds one such table.
    """
    n = np.zeros(sum(map(len, places)), np.int64)
    low, other, same = np.arange(len(n)), left if right is None else right, right is None
    bounded = left.shape[1] > PREFIX and _left_open(left[:256], other[-256:], threshold) <= OPEN
    for a in range(0, len(left), step):
        for b in range(a if same else 0, len(other), step):
            x, y = left[a : a + step], other[b : b + step]
            x, y = np.nonzero(joined_above(x, y, threshold) if bounded else x @ y.T > threshold)
            x, y = x + a, y + b
            if same:
                x, y = x[x < y], y[x < y]
            x, y = places[0][x], places[0 if same else 1][y]
            n += np.bincount(x, minlength=len(n)) + np.bincount(y, minlength=len(n))
            low = _joined(low, x, y)
    return n, low


def _left_open(a: np.ndarray, b: np.ndarray, threshold: float, prefix: int = PREFIX) -> float:
    """The share of pairs that the bound of the first dimensions leaves open."""
    rest = lambda v: np.linalg.norm(v[:, prefix:], axis=1)
    return float((a[:, :prefix] @ b[:, :prefix].T + rest(a)[:, None] * rest(b)[None, :] > threshold - 1e-9).mean())


def links_above(rows: DataFrame, threshold: float, block_rows: int = 1 << 13, most_cells: int = 1024) -> DataFrame:
    """(id, n_links, class_id) for every row of (id, v), ids that differ: how many others have a cosine above the threshold, and the
    smallest id that is reached through such links. Exact, and without a list of pairs.

    A pair of blocks gives each of its rows a count and the smallest row that it reaches inside the two. A row belongs to the class of
    the smallest of these, so classes are made of edges between such smallest rows only. Null and zero vectors link with nothing.
    """
    known = rows.select("id", "v")
    work = _met(known, threshold, block_rows, most_cells)
    if work is None:
        return known.select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("class_id"))
    turned = rotation(known.filter("v is not null").filter(F.exists("v", lambda x: x != 0)))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        i, j = pdf["i"].iloc[0], pdf["j"].iloc[0]
        v, ids, own = _doubles(pdf["v"]), pdf["id"].to_numpy(), pdf["own"].to_numpy()
        v = v / np.linalg.norm(v, axis=1)[:, None] @ turned
        left, right = np.flatnonzero(own == i), np.flatnonzero(own == j) if i != j else np.zeros(0, np.int64)
        n, low = block_links(v[left], v[right] if i != j else None, (left, right), threshold)
        some = n > 0
        return pd.DataFrame({"id": ids[some], "n": n[some], "low": ids[low[some]]})

    found = work.groupBy("i", "j").applyInPandas(run, "id long, n long, low long")
    each = written(found.groupBy("id").agg(F.sum("n").alias("n_links"), F.min("low").alias("least"), F.collect_set("low").alias("lows")), "links")  # as many as blocks at most
    between = each.select(F.col("least").alias("a"), F.explode("lows").alias("b")).filter("a <> b").distinct()
    classes = smallest_reached(between).withColumnRenamed("id", "least")
    out = known.select("id").join(each.select("id", "n_links", "least"), "id", "left").join(classes, "least", "left")
    return out.select("id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("class_id", "least", "id").alias("class_id"))


def smallest_reached(edges: DataFrame) -> DataFrame:
    """(id, class_id) of every end of the edges (a, b): the smallest id reachable.

    Each id points to the smallest id known to be reachable. A round hands pointers on along the edges, then follows them once, so
    the rounds grow with the logarithm of the longest path; it ends when nothing moves.
    """
    both = written(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    now = written(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("to")), "pointers")
    while True:
        handed = both.join(now.withColumnRenamed("id", "b"), "b").groupBy("a").agg(F.min("to").alias("m"))
        nearer = now.join(handed.withColumnRenamed("a", "id"), "id").select("id", "to", F.least("to", "m").alias("near"))
        # Who points at a row learns what the row has learnt.
        hooked = nearer.groupBy("to").agg(F.min("near").alias("m"))
        best = written(nearer.join(hooked, "to").select("id", F.col("to").alias("was"), F.least("near", "m").alias("to")), "nearer")
        jumped = best.join(best.select(F.col("id").alias("to"), F.col("to").alias("up")), "to", "left")
        nxt = written(jumped.select("id", "was", F.coalesce("up", "to").alias("to")), "pointers")
        if nxt.filter("`to` <> was").isEmpty():
            return nxt.select("id", F.col("to").alias("class_id"))
        now = nxt.select("id", "to")
