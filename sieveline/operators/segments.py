"""A BM25 index that is kept: immutable segments, a log of versions, tombstones, tiered merges, and a search that skips blocks.

Layout, under one folder::

    log/v000000000007.json   the segments of a version and their sizes; a version is never changed, the highest one counts
    seg-12/docs              doc_id, dl, terms (term, tf): what exact scores are read from
    seg-12/postings          blocks: term, level, n, top, postings (doc_id, tf, dl)
    seg-12/terms             term, df
    dead-13/docs, /terms     copies that a later change removed (seg, doc_id, dl), and what their terms lose (seg, term, df)

Adding documents writes one segment of them alone, and looks at the ids of the others; only copies that are replaced are read. A
merge puts together ``fan`` segments of about the same size, from their term counts (nothing is cut into tokens again), and leaves out what
is dead; so a document is written again some log(n) times. Readers hold a version and see one state. One writer at a time: a
second one that commits the same version fails.

Postings are ordered by impact: the level of a posting is its saturated frequency (tf and length, without idf) in sixteenths of the
highest possible, so no list is ever sorted. A level of a term is cut into blocks of some ``BLOCK`` postings, each with its highest
saturated frequency. A segment's levels are made with its own mean length; where the mean of all is larger, highest values are
scaled by their ratio, which they can't pass.

The search is exact. (1) The top levels of every term give each query some candidates; their exact scores give a threshold, the k-th
best. (2) Per query, cutoffs are chosen: with levels unread below them, the highest parts of all terms add up to less than the
threshold, so a document in none of the levels read can't win. Levels are given up for the fewest postings a unit of score. (3) What
was read bounds every candidate: its parts, and the cutoffs of the other terms. Only those that reach the threshold are scored.

Defined cases: ids are unique in what is added (else an error), null ids are an error; an id that is there is replaced; removing
an unknown id does nothing; an empty index finds nothing; null texts have no tokens and count as documents.
"""

from __future__ import annotations

import heapq
import json
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import written
from .lexical import B, EPSILON, K1
from .ranking import ranked

#: Levels of impact, postings of a block, segments of a size before they are merged.
LEVELS, BLOCK, FAN = 16, 256, 4
#: Postings of a term, about, that the first step reads, and candidates a wanted result that it scores.
FIRST, SEEDS = 100, 4
_POSTING = "array<struct<doc_id:{i},tf:bigint,dl:bigint>>"


def saturated(tf: Column, dl: Column, mean: float) -> Column:
    """The part of a term in a document's score, without idf: below K1 + 1, and larger with a larger mean length."""
    return tf * F.lit(K1 + 1) / (tf + F.lit(K1) * (F.lit(1 - B) + F.lit(B) * dl / F.lit(mean or 1.0)))


# --- The log of versions ---


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _versions(spark: SparkSession, path: str) -> list[int]:
    files, at = _fs(spark, f"{path}/log")
    names = [s.getPath().getName() for s in files.listStatus(at)] if files.exists(at) else []
    return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))


@dataclass(frozen=True)
class Segments:
    """One version of an index. segments: seq -> docs, length (tokens), dead, dead_length; dead: seqs of removals."""

    spark: SparkSession
    path: str
    version: int = 0
    next_seq: int = 0
    segments: dict[int, dict[str, int]] = field(default_factory=dict)
    dead: tuple[int, ...] = ()

    @property
    def n(self) -> int:
        return sum(s["docs"] - s["dead"] for s in self.segments.values())

    @property
    def avgdl(self) -> float:
        return sum(s["length"] - s["dead_length"] for s in self.segments.values()) / self.n if self.n else 0.0

    def committed(self, **changes: object) -> Segments:
        """The next version, in the log."""
        new = replace(self, version=self.version + 1, **changes)
        body = json.dumps({"next_seq": new.next_seq, "segments": new.segments, "dead": new.dead})
        files, at = _fs(self.spark, f"{self.path}/log/v{new.version:012d}.json")
        draft = _fs(self.spark, f"{self.path}/log/draft-{uuid.uuid4().hex}")[1]
        out = files.create(draft, False)
        out.write(bytearray(body.encode()))
        out.close()
        if files.exists(at) or not files.rename(draft, at):
            files.delete(draft, False)
            raise RuntimeError(f"version {new.version} of {self.path} was committed by another writer")
        return new

    def read(self, kind: str, what: str, seqs: tuple[int, ...] | None = None) -> DataFrame | None:
        """A table of all segments (or all removals), with seg, the segment it is about."""
        tables = []
        for seq in seqs if seqs is not None else self.segments if kind == "seg" else self.dead:
            t = self.spark.read.parquet(f"{self.path}/{kind}-{seq}/{what}")
            tables.append(t.withColumn("seg", F.lit(seq).cast("long")) if kind == "seg" else t)
        return reduce(DataFrame.unionByName, tables) if tables else None

    def live(self, rows: DataFrame) -> DataFrame:
        """Rows (seg, doc_id, ..) without dead copies."""
        if not any(s["dead"] for s in self.segments.values()):
            return rows
        return rows.join(self.read("dead", "docs").select("seg", "doc_id"), ["seg", "doc_id"], "left_anti")


def opened(spark: SparkSession, path: str, version: int | None = None) -> Segments:
    """The highest version, or the one asked for; a new index if there is none."""
    path = path.rstrip("/")
    known = _versions(spark, path)
    if not known or version == 0:
        return Segments(spark, path)
    version = known[-1] if version is None else version
    body = json.loads("".join(r.value for r in spark.read.text(f"{path}/log/v{version:012d}.json").collect()))  # a line
    return Segments(spark, path, version, body["next_seq"], {int(k): v for k, v in body["segments"].items()}, tuple(body["dead"]))


# --- Changes ---


def _counted(docs: DataFrame, tokens: Column, ident: str) -> DataFrame:
    """(doc_id, dl, terms): a document's own terms are counted in the row, by a sort of its tokens."""
    rows = docs.select(F.col(ident).alias("doc_id"), F.array_sort(F.coalesce(tokens, F.array().cast("array<string>"))).alias("ts"))
    ends = "filter(transform(ts, (t, i) -> if(i + 1 = size(ts) or ts[i + 1] <> t, i, null)), i -> i is not null)"
    rows = rows.select("doc_id", F.size("ts").cast("long").alias("dl"), "ts", F.expr(ends).alias("ends"))
    return rows.select("doc_id", "dl", F.expr("transform(ends, (e, k) -> named_struct('term', ts[e], 'tf', cast(e - if(k = 0, -1, ends[k - 1]) as bigint)))").alias("terms"))


def _segment(index: Segments, seq: int, docs: DataFrame) -> dict[str, int]:
    """Writes a segment of (doc_id, dl, terms); its sizes."""
    at = f"{index.path}/seg-{seq}"
    docs.write.mode("overwrite").parquet(f"{at}/docs")
    docs = index.spark.read.parquet(f"{at}/docs")
    size = docs.agg(F.count("*").alias("n"), F.count("doc_id").alias("ids"), F.sum("dl").alias("length")).first()
    if size.ids < size.n or docs.groupBy("doc_id").count().filter("count > 1").limit(1).count():
        raise ValueError("ids must be there and differ")
    mean = (size.length or 0) / size.n if size.n else 0.0
    each = docs.select("doc_id", "dl", F.explode("terms").alias("e")).select("e.term", "doc_id", "e.tf", "dl")
    part = saturated(F.col("tf"), F.col("dl"), mean)
    each = each.withColumn("part", part).withColumn("level", F.least(F.lit(LEVELS - 1), F.floor(F.col("part") / F.lit((K1 + 1) / LEVELS))).cast("int"))
    counts = written(each.groupBy("term", "level").agg(F.count("*").alias("c")), "counts")
    counts.groupBy("term").agg(F.sum("c").alias("df")).write.mode("overwrite").parquet(f"{at}/terms")
    large = counts.filter(F.col("c") > BLOCK).select("term", "level", F.ceil(F.col("c") / BLOCK).alias("chunks"))
    each = each.join(large, ["term", "level"], "left").withColumn("chunk", F.pmod(F.xxhash64("doc_id"), F.coalesce("chunks", F.lit(1))))
    blocks = each.groupBy("term", "level", "chunk").agg(F.count("*").alias("n"), F.max("part").alias("top"), F.collect_list(F.struct("doc_id", "tf", "dl")).alias("postings"))
    blocks.drop("chunk").sortWithinPartitions("term", "level").write.mode("overwrite").parquet(f"{at}/postings")
    return {"docs": size.n, "length": size.length or 0, "dead": 0, "dead_length": 0}


def _removed(index: Segments, ids: DataFrame, seq: int) -> tuple[dict[int, dict[str, int]], tuple[int, ...]]:
    """Tombstones for the live copies of (doc_id); the segments' new sizes and the removals. Only ids and lengths of others are read."""
    if not index.segments:
        return index.segments, index.dead
    gone = index.live(index.read("seg", "docs").select("seg", "doc_id", "dl")).join(ids.select("doc_id").distinct(), "doc_id", "left_semi")
    at = f"{index.path}/dead-{seq}"
    gone.select("seg", "doc_id", "dl").write.mode("overwrite").parquet(f"{at}/docs")
    gone = index.spark.read.parquet(f"{at}/docs")
    sizes = {r.seg: r for r in gone.groupBy("seg").agg(F.count("*").alias("n"), F.sum("dl").alias("length")).collect()}  # a row a segment
    if not sizes:
        return index.segments, index.dead
    lost = index.read("seg", "docs", tuple(sizes)).join(gone.select("seg", "doc_id"), ["seg", "doc_id"], "left_semi").select("seg", F.explode("terms.term").alias("term"))
    lost.groupBy("seg", "term").agg(F.count("*").alias("df")).write.mode("overwrite").parquet(f"{at}/terms")
    segments = {k: s | ({"dead": s["dead"] + sizes[k].n, "dead_length": s["dead_length"] + sizes[k].length} if k in sizes else {}) for k, s in index.segments.items()}
    return segments, (*index.dead, seq)


def _kept(segments: dict[int, dict[str, int]], dead: tuple[int, ...]) -> tuple[int, ...]:
    """Removals that still matter: without dead copies none does."""
    return dead if any(s["dead"] for s in segments.values()) else ()


def added(index: Segments, docs: DataFrame, tokens: Column, ident: str = "doc_id") -> Segments:
    """With these documents, each in the place of the copy that was there."""
    seq = index.next_seq
    size = _segment(index, seq, _counted(docs, tokens, ident))
    if not size["docs"]:
        return index
    segments, dead = _removed(index, index.spark.read.parquet(f"{index.path}/seg-{seq}/docs"), seq)
    return index.committed(next_seq=seq + 1, segments=segments | {seq: size}, dead=dead)


def removed(index: Segments, ids: DataFrame, ident: str = "doc_id") -> Segments:
    segments, dead = _removed(index, ids.select(F.col(ident).alias("doc_id")), index.next_seq)
    return index if dead == index.dead else index.committed(next_seq=index.next_seq + 1, segments=segments, dead=dead)


def _tier(live: int, fan: int) -> int:
    tier = 0
    while live >= fan:
        live, tier = live // fan, tier + 1
    return tier


def due(index: Segments, fan: int = FAN) -> tuple[int, ...]:
    """Segments to merge next: ``fan`` or more of one tier (sizes within a factor of ``fan``), or one that is half dead; () if none."""
    tiers: dict[int, list[int]] = {}
    for seq, s in index.segments.items():
        if 2 * s["dead"] > s["docs"]:
            return (seq,)
        tiers.setdefault(_tier(s["docs"] - s["dead"], fan), []).append(seq)
    return next((tuple(t) for _, t in sorted(tiers.items()) if len(t) >= fan), ())


def merged(index: Segments, seqs: tuple[int, ...]) -> Segments:
    """These segments as one, without what is dead in them."""
    seq = index.next_seq
    size = _segment(index, seq, index.live(index.read("seg", "docs", seqs)).drop("seg"))
    segments = {k: s for k, s in index.segments.items() if k not in seqs} | ({seq: size} if size["docs"] else {})
    return index.committed(next_seq=seq + 1, segments=segments, dead=_kept(segments, index.dead))


def compacted(index: Segments, fan: int = FAN) -> Segments:
    while seqs := due(index, fan):
        index = merged(index, seqs)
    return index


def vacuumed(index: Segments) -> int:
    """Deletes older versions, and segments and removals that this one doesn't name; how many folders went. Older readers end."""
    files, at = _fs(index.spark, index.path)
    keep = {f"seg-{s}" for s in index.segments} | {f"dead-{s}" for s in index.dead} | {"log"}
    old = [s.getPath() for s in files.listStatus(at) if s.getPath().getName() not in keep]
    for version in _versions(index.spark, index.path):
        if version < index.version:
            files.delete(_fs(index.spark, f"{index.path}/log/v{version:012d}.json")[1], False)
    for p in old:
        files.delete(p, True)
    return len(old)


# --- Search ---


def vocabulary(index: Segments) -> DataFrame:
    """(term, df) of live documents: what segments add, less what removals of copies in them take."""
    rows = index.read("seg", "terms").select("term", "df")
    if index.dead:
        lost = index.read("dead", "terms").filter(F.col("seg").isin([*index.segments]))
        rows = rows.unionByName(lost.select("term", (-F.col("df")).alias("df")))
    return rows.groupBy("term").agg(F.sum("df").alias("df")).filter("df > 0")


def weights(index: Segments, asked: DataFrame) -> DataFrame:
    """(query_id, term, w): idf, negative ones repaired as ``lexical.indexed`` does, times how often the query has the term."""
    raw = F.log(F.lit(index.n) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
    terms = vocabulary(index).select("term", raw.alias("raw"))
    mean = terms.agg(F.avg("raw").alias("m")).first().m or 0.0
    idf = F.when(F.col("raw") < 0, F.lit(EPSILON * mean)).otherwise(F.col("raw"))
    return asked.join(terms, "term").select("query_id", "term", (idf * F.col("times")).alias("w"))


def _blocks(index: Segments) -> DataFrame:
    """Blocks of all segments; top as it can be at most with the mean length of all."""
    rows = []
    for seq, s in index.segments.items():
        own = s["length"] / s["docs"] or 1.0
        rows.append(index.spark.read.parquet(f"{index.path}/seg-{seq}/postings").withColumns({"seg": F.lit(seq).cast("long"), "top": F.col("top") * F.lit(max(1.0, index.avgdl / own))}))
    return reduce(DataFrame.unionByName, rows)


def _levels_of(pdf: pd.DataFrame) -> dict[str, tuple[float, list[tuple[int, int, float]]]]:
    """term -> (w, [(level, n, highest part)]), highest level first; parts never rise as levels fall."""
    out: dict[str, tuple[float, list[tuple[int, int, float]]]] = {}
    for term, own in pdf.sort_values("level", ascending=False).groupby("term", sort=True):
        w = float(own["w"].iloc[0])
        parts = (own["top"].to_numpy() * w).tolist()
        for i in range(len(parts) - 2, -1, -1):  # a bound of a level holds for all below it
            parts[i] = max(parts[i], parts[i + 1])
        out[term] = (w, list(zip(own["level"].tolist(), own["n"].tolist(), parts, strict=True)))
    return out


def _first_levels(first: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for term, (w, levels) in _levels_of(pdf).items():
            upto = read = 0
            while upto < len(levels) and (not upto or read + levels[upto][1] <= first):
                read += levels[upto][1]
                upto += 1
            rows.append((pdf["query_id"].iloc[0], term, w, levels[upto - 1][0]))
        return pd.DataFrame(rows, columns=["query_id", "term", "w", "least"])

    return run


def cutoffs(levels: dict[str, tuple[float, list[tuple[int, int, float]]]], done: dict[str, int], threshold: float) -> dict[str, tuple[int, float]]:
    """term -> (how many levels to read, the most that an unread posting adds); what is unread adds up to less than the threshold.

    A step takes a term down one level or more; the cheapest in postings a unit of score goes first.
    """
    at = {t: next((i for i, x in enumerate(v) if x[0] < done[t]), len(v)) for t, (_, v) in levels.items()}
    part = lambda t, i: levels[t][1][i][2] if i < len(levels[t][1]) else 0.0
    left = sum(part(t, i) for t, i in at.items())

    def step(t: str) -> tuple[float, str, int]:
        n, best = 0, (float("inf"), t, at[t] + 1)
        for i in range(at[t], len(levels[t][1])):
            n += levels[t][1][i][1]
            gain = part(t, at[t]) - part(t, i + 1)
            if gain > 0 and n / gain < best[0]:
                best = (n / gain, t, i + 1)
        return best

    heap = [step(t) for t in levels if at[t] < len(levels[t][1])]
    heapq.heapify(heap)
    while heap and left >= threshold - 1e-6:
        _, t, to = heapq.heappop(heap)
        left -= part(t, at[t]) - part(t, to)
        at[t] = to
        if to < len(levels[t][1]):
            heapq.heappush(heap, step(t))
    return {t: (i, part(t, i)) for t, i in at.items()}


def _cut(key: tuple, levels: pd.DataFrame, plan: pd.DataFrame) -> pd.DataFrame:
    """Per term: levels still to be read (least <= level < done), the cutoff, and the cutoffs' sum."""
    if levels.empty:
        return pd.DataFrame({"query_id": [], "term": [], "w": [], "done": [], "least": [], "cut": [], "rest": []})
    own = _levels_of(levels)
    done = dict(zip(plan["term"], plan["least"], strict=True))
    found = cutoffs(own, done, float(plan["threshold"].iloc[0]))
    rest = sum(c for _, c in found.values())
    rows = [(key[0], t, own[t][0], done[t], own[t][1][i - 1][0] if i else LEVELS, c, rest) for t, (i, c) in found.items()]
    return pd.DataFrame(rows, columns=["query_id", "term", "w", "done", "least", "cut", "rest"])


def _read(index: Segments, blocks: DataFrame, wanted: DataFrame, bound: Column) -> DataFrame:
    """(query_id, term, doc_id, part) of the postings of wanted blocks. wanted: (query_id, term, w, least, ..)."""
    hits = blocks.join(wanted, (blocks["term"] == wanted["term"]) & bound).select(wanted["query_id"], wanted["term"], "w", "seg", F.explode("postings").alias("p"))
    hits = index.live(hits.select("query_id", "term", "w", "seg", "p.*"))
    return hits.select("query_id", "term", "doc_id", (F.col("w") * saturated(F.col("tf"), F.col("dl"), index.avgdl)).alias("part"))


def _exact(index: Segments, pairs: DataFrame, w: DataFrame) -> DataFrame:
    """(query_id, doc_id, score) of the pairs, from the documents' own terms."""
    docs = index.live(index.read("seg", "docs").join(pairs.select("doc_id").distinct(), "doc_id", "left_semi"))
    each = docs.select("doc_id", "dl", F.explode("terms").alias("e")).select("doc_id", "dl", "e.*").join(w, "term").join(pairs, ["query_id", "doc_id"], "left_semi")
    return each.groupBy("query_id", "doc_id").agg(F.sum(F.col("w") * saturated(F.col("tf"), F.col("dl"), index.avgdl)).alias("score"))


def search(index: Segments, queries: DataFrame, tokens: Column, k: int = 50, ident: str = "query_id", first: int = FIRST, seeds: int = SEEDS, counts: dict[str, int] | None = None) -> DataFrame:
    """The exact best k by BM25, as ``lexical.bm25_search`` finds them: (query_id, doc_id, score, rank).

    counts: a dict that takes how many postings all lists of the queries hold, how many were read, and how many pairs were scored.
    """
    spark = index.spark
    asked = queries.select(F.col(ident).alias("query_id"), F.explode(tokens).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times"))
    kind = dict(asked.dtypes)["query_id"]
    if not index.n:
        return ranked(asked.select("query_id", F.lit(None).cast("long").alias("doc_id"), F.lit(0.0).alias("score")).limit(0), k)
    w = written(weights(index, asked), "weights")
    blocks = _blocks(index)
    heads = blocks.join(w.select("term").distinct(), "term", "left_semi").groupBy("term", "level").agg(F.sum("n").alias("n"), F.max("top").alias("top"))
    levels = written(w.filter("w > 0").join(heads, "term").select("query_id", "term", "w", "level", "n", "top"), "levels")
    plan = written(levels.groupBy("query_id").applyInPandas(_first_levels(first), f"query_id {kind}, term string, w double, least int"), "plan")
    top = written(_read(index, blocks, plan, F.col("level") >= F.col("least")), "top")
    best = top.groupBy("query_id", "doc_id").agg(F.sum("part").alias("score"))
    seeded = written(ranked(best, seeds * k).select("query_id", "doc_id"), "seeded")
    scored = written(ranked(_exact(index, seeded, w), k), "seeds")
    threshold = scored.groupBy("query_id").agg(F.when(F.count("*") == k, F.min("score")).alias("t"))
    plan = plan.join(threshold, "query_id", "left").select("query_id", "term", "least", F.coalesce("t", F.lit(0.0)).alias("threshold"))
    cut_ddl = f"query_id {kind}, term string, w double, done int, least int, cut double, rest double"
    cut = written(levels.groupBy("query_id").cogroup(plan.groupBy("query_id")).applyInPandas(_cut, cut_ddl), "cutoffs")
    more = _read(index, blocks, cut.filter("least < done"), (F.col("level") >= F.col("least")) & (F.col("level") < F.col("done")))
    if counts is not None:
        counts["lists"] = levels.agg(F.sum("n")).first()[0] or 0
        more = written(more, "more")
        counts["read"] = top.count() + more.count()
    bounds = cut.select("query_id", "term", "cut", "rest")
    part = top.unionByName(more).join(bounds, ["query_id", "term"])
    held = part.groupBy("query_id", "doc_id").agg((F.max("rest") + F.sum(F.col("part") - F.col("cut"))).alias("most"))
    rest = written(held.join(threshold, "query_id", "left").filter(F.col("t").isNull() | (F.col("most") >= F.col("t") - 1e-6)).select("query_id", "doc_id"), "rest")
    if counts is not None:
        counts["scored"] = rest.count()
    return ranked(_exact(index, rest, w).filter("score > 0"), k)
