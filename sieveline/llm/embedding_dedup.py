"""Near-duplicate embeddings by lattice hashing.

In each of several tables a unit vector is projected to eight random directions, scaled, shifted and decoded to the nearest
point of the E8 lattice, which is its home cell; the ``probes`` next nearest lattice neighbours are cells it probes. Two
vectors meet where one's home is the other's home or probe, and those that meet are compared by cosine in double precision.

Each pair counts once, in the first table and way in which it meets; cells are recomputed from the vectors to decide that, so no
list of pairs is kept. A cell beyond ``block_rows`` vectors is cut into blocks, and each pair of blocks is one group of work.
A group returns sums of links and a forest of its links: as many rows as vectors, not as pairs. Copies of a vector are
put together first, by ranges of their digest, and counted with their number.

At a cosine of exactly 0.9 a pair of 64-dimensional vectors meets with a probability of 0.995, at 0.95 practically always
(measured in the tests). The scale suits up to some ten million vectors; for more, raise ``scale`` and ``tables`` together.

Defined cases: vectors that are null, zero, empty or hold null or non-finite components link with nothing; vectors of different
lengths don't link; copies link with one another; rows that share an id, null or not, are vectors of their own, told apart by a hash
of the vector (64 bits), and each has its own links; a null id doesn't count for the smallest id, and a component of null ids
alone has a null component_id and keeps all its rows; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  pa.compute
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, group_bounds, grouped, in_ranges, shuffle_partitions, written
from .components import components

TABLES, PROBES, SCALE, COSINE = 10, 6, 0.3, 0.9


def _neighbours() -> np.ndarray:
    """The 240 shortest vectors of E8."""
    pairs = [np.eye(8)[i] * a + np.eye(8)[j] * b for i in range(8) for j in range(i) for a in (1, -1) for b in (1, -1)]
    halves = [np.where([(k >> i) & 1 for i in range(8)], -0.5, 0.5) for k in range(256) if bin(k).count("1") % 2 == 0]
    return np.array([*pairs, *halves])


NEIGHBOURS = _neighbours()


def _nearest_even(x: np.ndarray) -> np.ndarray:
    """Nearest whole points with an even sum: where the sum of the rounded is odd, the worst coordinate goes the other way."""
    p = np.rint(x)
    odd = np.flatnonzero(p.sum(1) % 2 != 0)
    off = x[odd] - p[odd]
    worst = np.abs(off).argmax(1)
    p[odd, worst] += np.where(off[np.arange(len(odd)), worst] >= 0, 1, -1)
    return p


def nearest_e8(x: np.ndarray) -> np.ndarray:
    """E8 is the even whole points and those shifted by a half."""
    a, b = _nearest_even(x), _nearest_even(x - 0.5) + 0.5
    return np.where((((x - a) ** 2).sum(1) <= ((x - b) ** 2).sum(1))[:, None], a, b)


@lru_cache(maxsize=64)
def _table(dim: int, t: int, scale: float) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng([dim, t, 6])
    return rng.normal(0, scale, (dim, 8)) * np.sqrt(8.0), rng.uniform(0, 1, 8)


def _packed(points: np.ndarray, dim: int, t: int) -> np.ndarray:
    whole = np.ascontiguousarray((2 * points).astype(np.int8)).view(np.uint64).reshape(points.shape[:-1])
    key = (whole ^ np.uint64((dim << 16 | t) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) * np.uint64(0xBF58476D1CE4E5B9)
    return (key ^ key >> np.uint64(29)).view(np.int64)


def lattice_cells(unit: np.ndarray, tables: int = TABLES, probes: int = PROBES, scale: float = SCALE) -> tuple[np.ndarray, np.ndarray]:
    """Home cells (vector, table) and probed cells (vector, table, probe)."""
    n, dim = unit.shape
    home, near = np.empty((n, tables), np.int64), np.empty((n, tables, probes), np.int64)
    for t in range(tables):
        p, shift = _table(dim, t, scale)
        x = unit @ p + shift
        at = nearest_e8(x)
        close = np.argsort(-((x - at) @ NEIGHBOURS.T), axis=1, kind="stable")[:, :probes]
        home[:, t] = _packed(at, dim, t)
        near[:, t] = _packed(at[:, None] + NEIGHBOURS[close], dim, t)
    return home, near


def _vectors(batch: pa.RecordBatch, column: str) -> list[np.ndarray | None]:
    """Unit vectors in double precision; None for what links with nothing."""
    out: list[np.ndarray | None] = []
    for row in batch.column(batch.schema.names.index(column)):
        v = np.array(row.values.to_numpy(zero_copy_only=False), np.float64) if row.is_valid else np.empty(0)
        norm = float(np.linalg.norm(v / top)) * top if len(v) and np.isfinite(v).all() and (top := float(np.abs(v).max())) > 0 else 0.0
        out.append(v / norm if norm > 0 and np.isfinite(norm) else None)
    return out


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, h, vector) to (id, h, d1, d2, unit) of what can link."""
    for batch in batches:
        units = _vectors(batch, "v")
        got = [r for r, u in enumerate(units) if u is not None]
        d = np.array([[x >> 64, x & (1 << 64) - 1] for x in (xxhash.xxh3_128_intdigest(units[r].tobytes()) for r in got)], np.uint64).reshape(-1, 2).view(np.int64)
        rows = pa.array(got, pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(d[:, 0]), pa.array(d[:, 1]), pa.array([units[r] for r in got], pa.list_(pa.float64()))], ["id", "h", "d1", "d2", "unit"])


def _copies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by digest: a number for each digest of this range; its first row keeps the vector."""
    before: tuple | None = None
    seen = TaskContext.get().partitionId() << 36
    for batch in batches:
        if not batch.num_rows:
            continue
        d1, d2 = (batch.column(i).to_numpy() for i in (2, 3))
        bounds = group_bounds(d1, d2)
        number, fresh = np.arange(len(bounds) - 1) + seen + 1, bounds[:-1]
        if before == (d1[0], d2[0]):
            number, fresh = number - 1, fresh[1:]
        before, seen = (d1[-1], d2[-1]), int(number[-1])
        stands = np.zeros(batch.num_rows, bool)
        stands[fresh] = True
        units = pa.compute.if_else(pa.array(stands), batch.column(4), pa.scalar(None, batch.column(4).type))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.repeat(number, np.diff(bounds))), units], ["id", "h", "rep", "unit"])


def _matrix(column: pa.ChunkedArray | pa.Array, n: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy().reshape(n, -1)


def _celled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, unit) to (cell, t, probing, id): where each vector lives and looks."""
    for batch in batches:
        lengths = batch.column(1).value_lengths().to_numpy()
        for dim in np.unique(lengths):
            rows = np.flatnonzero(lengths == dim)
            ids = batch.column(0).to_numpy()[rows]
            home, near = lattice_cells(_matrix(batch.column(1).take(pa.array(rows)), len(rows)))
            cells = np.concatenate([home[:, :, None], near], axis=2)
            n, t, k = cells.shape
            yield pa.RecordBatch.from_arrays(
                [pa.array(cells.ravel()), pa.array(np.tile(np.repeat(np.arange(t, dtype=np.int32), k), n)), pa.array(np.tile(np.arange(k) > 0, n * t)), pa.array(np.repeat(ids, t * k))], ["cell", "t", "probing", "id"]
            )


def _first_meeting(a: np.ndarray, b: np.ndarray, home: np.ndarray, near: np.ndarray, ids: np.ndarray, t: int) -> np.ndarray:
    """The way, 3 t + 0 (homes), 1 (the lower id probes) or 2, in which each pair of rows first meets, up to table t."""
    low, high = np.where(ids[a] < ids[b], a, b), np.where(ids[a] < ids[b], b, a)
    way = np.full(len(a), 1 << 30)
    for u in range(t, -1, -1):
        way[(near[high, u] == home[low, u, None]).any(1)] = 3 * u + 2
        way[(near[low, u] == home[high, u, None]).any(1)] = 3 * u + 1
        way[home[low, u] == home[high, u]] = 3 * u
    return way


def cell_links(ids: np.ndarray, unit: np.ndarray, mult: np.ndarray, probing: np.ndarray, side: np.ndarray, t: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Links of each row that count here, and the row of its component here."""
    links, root = np.zeros(len(ids), np.int64), np.arange(len(ids))
    if probing.all() or len(ids) < 2:
        return links, root
    meet = ~(probing[:, None] & probing[None, :]) & (ids[:, None] != ids[None, :])
    if side[0] >= 0 or side[-1] >= 0:
        meet &= side[:, None] != side[None, :]
    a, b = np.nonzero(np.triu(meet & (unit @ unit.T >= least), 1))
    if not len(a):
        return links, root
    rows, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    home, near = lattice_cells(unit[rows])
    for k in range(0, len(a), 50_000):
        x, y = a[k : k + 50_000], b[k : k + 50_000]
        way = _first_meeting(at[: len(a)][k : k + 50_000], at[len(a) :][k : k + 50_000], home, near, ids[rows], t)
        prober = np.where(probing[x], ids[x], ids[y])
        here = 3 * t + np.where(probing[x] == probing[y], 0, np.where(prober == np.minimum(ids[x], ids[y]), 1, 2))
        first = way == here
        np.add.at(links, x[first], mult[y[first]])
        np.add.at(links, y[first], mult[x[first]])
    changed = True
    while changed:  # the smallest row among the neighbours, again and again
        new = root.copy()
        np.minimum.at(new, a, root[b])
        np.minimum.at(new, b, root[a])
        new = new[new]
        changed = bool((new != root).any())
        root = new
    return links, root


def near_embeddings(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", least: float = COSINE, block_rows: int = 1000) -> DataFrame:
    """(id, n_links, component_id, kept), a row for each of ``rows``."""
    p = shuffle_partitions(rows.sparkSession)
    v = F.col(vec_col)
    every = rows.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(v, F.size(v), F.exists(v, lambda x: x.isNull())).alias("h"), v.alias("v"))
    base = written(every.mapInArrow(_digested, "id long, h long, d1 long, d2 long, unit array<double>"), "units")
    copies = written(in_ranges(base, "d1", "d2", "id", "h").mapInArrow(_copies, "id long, h long, rep long, unit array<double>"), "copies")
    forget(base)
    of_copies = copies.groupBy("rep").agg(F.count("*").alias("mult"), F.min("id").alias("own"))
    distinct = written(copies.filter("unit is not null").select("rep", "unit").join(of_copies, "rep").select(F.col("rep").alias("id"), "mult", "own", "unit"), "distinct")
    cells = written(distinct.select("id", "unit").mapInArrow(_celled, "cell long, t int, probing boolean, id long"), "cells")
    size = cells.groupBy("cell", "t").agg(F.count("*").alias("n"), F.sum((~F.col("probing")).cast("long")).alias("homes"))
    size = written(size.filter("homes > 0 and n > 1").select("cell", "t", F.ceil(F.col("n") / block_rows).cast("int").alias("blocks")), "sizes")
    work = cells.join(size, ["cell", "t"]).join(distinct.select("id", "mult", "unit"), "id").withColumn("block", F.pmod(F.xxhash64("id"), "blocks").cast("int"))
    work = work.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    work = work.select("cell", "t", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "probing", "id", "mult", "unit")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in grouped(batches, "cell", "t", "i", "j"):
            cell, t, i, j, block, probing, ids, mult = (table[k].to_numpy() for k in ("cell", "t", "i", "j", "block", "probing", "id", "mult"))
            units = table["unit"].combine_chunks()
            bounds = group_bounds(cell, t, i, j)
            out = []
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                side = np.where(i[a:b] == j[a:b], -1, (block[a:b] == j[a:b]).astype(int))
                links, root = cell_links(ids[a:b], _matrix(units.slice(a, b - a), b - a), mult[a:b], probing[a:b], side, int(t[a]), least)
                got = np.flatnonzero((links > 0) | (root != np.arange(b - a)))
                out.append((ids[a:b][got], links[got], ids[a:b][root[got]]))
            ids, links, roots = (np.concatenate(x) for x in zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(links), pa.array(roots)], ["id", "links", "root"])

    found = written(work.repartition(p, "cell", "t", "i", "j").sortWithinPartitions("cell", "t", "i", "j", "id").mapInArrow(run, "id long, links long, root long"), "links")
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    linked = components(found.select("id", "root"), "id", "root").withColumnRenamed("component", "least")
    of_rep = distinct.select(F.col("id").alias("rep"), "mult", "own").join(links.withColumnRenamed("id", "rep"), "rep", "left").join(linked.withColumnRenamed("id", "rep"), "rep", "left")
    of_rep = written(of_rep.select("rep", (F.coalesce("links", F.lit(0)) + F.col("mult") - 1).alias("n_links"), F.coalesce("least", "rep").alias("least"), "own"), "result")
    least_id = of_rep.groupBy("least").agg(F.min("own").alias("component_id"))
    of_rep = of_rep.join(least_id, "least").select("rep", "n_links", "component_id")
    named = lambda df: df.withColumn("ident", F.coalesce("id", F.lit(-(1 << 63))))
    own = named(copies.join(of_rep, "rep")).select("ident", "h", "n_links", "component_id", F.lit(True).alias("known")).distinct()
    out = named(every.select("id", "h")).join(own, ["ident", "h"], "left")
    component = F.when(F.col("known"), F.col("component_id")).otherwise(F.col("id"))
    return out.select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))
