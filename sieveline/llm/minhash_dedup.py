"""Near-duplicate removal by order MinHash, verified by banded alignment.

A text is the sequence of its word shingles (five lower-cased words; a shorter text is one shingle). The i-th occurrence of
a shingle is labelled with i, so labels are unique in a text. A sketch takes, for each of ``sketches`` hash functions, the
``minima`` labels of lowest value and writes them in the order of the text: two texts agree on it only if they share these
shingles in the same order. Texts that agree on one sketch are candidates. At a similarity of 0.8 each of 24 sketches of 4
minima agrees with a probability of 0.8 ** 4, so a pair is missed with (1 - 0.41) ** 24, or 3 in a million.

Similarity is that of the best alignment of the two shingle sequences, matched / (matched + unmatched of both), and 0.8 or
more links. Matches farther from the diagonal than (n + m) / 9 can't belong to such an alignment, which is the band. Labels
are matched first: the longest increasing run of equal ones is an alignment. Where it is too short and a shingle is repeated,
equal shingles may be matched across their numbers, and the longest common subsequence in the band decides.

Copies (equal word sequences) are put together first, by ranges of their digest, and one of them stands for all. Candidates are
gathered in clusters, and a cluster is one group of work. One beyond ``block_rows`` or 16 million characters is taken in rounds.
The first compares the texts of each block; what is joined there is a class. In the next ones a class sends one text for each
sketch that other classes have too, so that large groups of near copies come together through few texts. Once these fit into a
block, or don't get fewer, all texts with a sketch that several classes still share are compared, block by block. In a group, pairs that are joined
already are skipped. So a large group of near copies costs texts in proportion to its size, and only what agrees on sketches
without being similar is compared in full.

A pair of long texts at a similarity of 0.8 is missed 3 times in a million, as said; order counts, so of two texts whose agreeing
shingles stand in another order fewer sketches agree, but there the alignment, and so the similarity, is lower too. Short
texts have few shingles: 4 against 5 share a sketch only where it takes the 4 common ones, and about one pair in 200 is missed.

Defined cases: null counts as empty; texts without words are copies of one another; the smallest id of a class stays, and of
rows that share it the one whose text has the lower hash, of equal rows one; rows that share an id, null or not, are texts of their
own, told apart by a hash of their text (64 bits); null ids come last, and a class of null ids alone has a null class_id; an empty
table gives no rows; other columns pass through, those with the name of an output column are replaced.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  pa.compute
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_names, forget, free_name, group_bounds, grouped, in_ranges, shuffle_partitions, written
from .components import SMALL, components

SHINGLE, MINIMA, SKETCHES, SIMILARITY = 5, 4, 24, 0.8
_MIX = np.uint64(0x9E3779B97F4A7C15)
RESULT = ("class_id", "kept")
#: A block of a cluster holds so many characters or so, and texts are held against so many labels in one step.
BLOCK_CHARS, LABELS_AT_ONCE = 16 << 20, 1 << 20
#: Bits of the masks that an alignment of shingles holds at a time (32 MB).
MASK_BITS = 1 << 28


def _scrambled(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


#: Longer words are hashed anew.
REMEMBERED = 64


class Shingler:
    """Texts to label sequences; hashes of words seen before come from a memo, bounded in words and in their length."""

    def __init__(self, width: int = SHINGLE):
        self.width, self.memo = width, {}

    def _word(self, word: str) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= REMEMBERED:
            if len(self.memo) > 150_000:
                self.memo.clear()
            self.memo[word] = h
        return h

    def words(self, text: str) -> np.ndarray:
        words = text.lower().split()
        try:
            return np.fromiter(map(self.memo.__getitem__, words), np.uint64, len(words))
        except KeyError:
            memo = self.memo
            return np.fromiter([memo[w] if w in memo else self._word(w) for w in words], np.uint64, len(words))

    def shingles(self, words: np.ndarray) -> np.ndarray:
        """The hash of every shingle, in the order of the text."""
        if not len(words):
            return words
        width = min(self.width, len(words))
        h = np.zeros(len(words) - width + 1, np.uint64)
        for i in range(width):
            h = _scrambled(h * _MIX + words[i : i + len(h)])
        return h

    def labels(self, words: np.ndarray) -> np.ndarray:
        """A label for every shingle, in the order of the text."""
        return numbered(self.shingles(words))


def numbered(h: np.ndarray) -> np.ndarray:
    """Shingles with their occurrences told apart; ``h`` itself if none is repeated."""
    if not len(h):
        return h
    order = np.argsort(h, kind="stable")
    s = h[order]
    fresh = np.append(True, s[1:] != s[:-1])
    if fresh.all():
        return h
    at = np.arange(len(s))
    nth = np.empty(len(s), np.uint64)
    nth[order] = at - np.maximum.accumulate(np.where(fresh, at, 0))
    return h + nth * np.uint64(0xD6E8FEB86659FD93)


def sketch(labels: np.ndarray, seeds: np.ndarray, minima: int = MINIMA) -> np.ndarray:
    """One key for each seed: the lowest labels, in the order of the text."""
    value = (labels[None, :] ^ seeds[:, None]) * _MIX
    value ^= value >> np.uint64(32)
    k = min(minima, len(labels))
    lowest = np.sort(np.argpartition(value, k - 1, axis=1)[:, :k], axis=1)
    key = seeds.copy()
    for i in range(k):
        key = _scrambled(key * _MIX + labels[lowest[:, i]])
    return key.view(np.int64)


def seeds(n: int = SKETCHES) -> np.ndarray:
    return np.random.default_rng(17).integers(1, 1 << 63, n, dtype=np.uint64)


def similarity(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> float:
    """Of two label sequences; 0 where it is certain to be below ``least``."""
    n, m = len(a), len(b)
    if not n or not m:
        return float(n == m)
    if min(n, m) < least * max(n, m):
        return 0.0
    _, pa_, pb_ = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    if len(pa_) < least * (n + m - len(pa_)):
        return 0.0
    near = np.abs(pa_ - pb_) <= (n + m) * (1 - least) / (1 + least) + 1e-9
    pa_, pb_ = pa_[near], pb_[near]
    run: list[int] = []
    for x in pb_[np.argsort(pa_)].tolist():
        if not run or x > run[-1]:
            run.append(x)
        else:
            run[bisect_left(run, x)] = x
    return len(run) / (n + m - len(run))


def common(a: np.ndarray, b: np.ndarray, band: int) -> int:
    """Length of the longest common subsequence whose matches lie within ``band`` of the diagonal (some farther ones may count).

    Bit-parallel: bit j is 0 where the length grows at b[j]. The window of bits follows the band, in steps of some elements of a;
    bits that it leaves behind don't change any more, those ahead are 1.
    """
    n, m = len(a), len(b)
    least = min(n, m)
    differ = np.flatnonzero(a[:least] != b[:least])
    head = int(differ[0]) if len(differ) else least
    a, b = a[head:], b[head:]
    least = min(len(a), len(b))
    differ = np.flatnonzero(a[::-1][:least] != b[::-1][:least])
    tail = int(differ[0]) if len(differ) else least
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    n, m = len(a), len(b)
    grown, bits, lo, hi = head + tail, 0, 0, 0
    step = max(1, min(max(64, band // 2), MASK_BITS // (3 * band + 64)))
    for i in range(0, n, step):
        rows = a[i : i + step]
        left, right = min(m, max(0, i - band)), min(m, i + len(rows) + band)
        grown += left - lo - (bits & (1 << left - lo) - 1).bit_count()
        bits = bits >> left - lo | ((1 << right - hi) - 1) << hi - left
        lo, hi = left, right
        order = np.argsort(b[lo:hi], kind="stable")
        s, full, masks = b[lo:hi][order], (1 << hi - lo) - 1, {}
        for x, y in zip(np.searchsorted(s, rows).tolist(), np.searchsorted(s, rows, "right").tolist(), strict=True):
            if x == y:
                continue
            if x not in masks:
                if y - x == 1:
                    masks[x] = 1 << int(order[x])
                else:
                    at = np.zeros(hi - lo, np.uint8)
                    at[order[x:y]] = 1
                    masks[x] = int.from_bytes(np.packbits(at, bitorder="little").tobytes(), "little")
            hit = bits & masks[x]
            bits = (bits + hit | bits - hit) & full
    return grown + hi - lo - bits.bit_count()


def shingle_similarity(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> float:
    """Of two shingle sequences, with repeats; right where it is ``least`` or more, else some value below."""
    n, m = len(a), len(b)
    if not n or not m:
        return float(n == m)
    run = common(a, b, int((n + m) * (1 - least) / (1 + least) + 1e-9))
    return run / (n + m - run)


def _named(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, ident, h, text): ident and h name a text."""
    own, text = F.col(id_col).cast("long"), F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(own.alias("id"), F.coalesce(own, F.lit(-(1 << 63))).alias("ident"), F.xxhash64(text).alias("h"), text.alias("text"))


def _sketched(rows: DataFrame) -> DataFrame:
    """(id, h, d1, d2, keys, chars): a digest of the word sequence, the sketches, the length of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, own = Shingler(), seeds()
        for batch in batches:
            keys, digests, sizes = [], [], []
            for value in batch.column(2):
                text = value.as_py()
                words = shingler.words(text)
                sizes.append(len(text))
                digests.append(xxhash.xxh3_128_intdigest(words.tobytes()))
                keys.append(sketch(shingler.labels(words), own) if len(words) else np.zeros(len(own), np.int64))
            d = np.array([[x >> 64, x & (1 << 64) - 1] for x in digests], np.uint64).reshape(-1, 2).view(np.int64)
            ends = np.concatenate([[0], np.cumsum([len(k) for k in keys])])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([*keys, np.empty(0, np.int64)]), pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(d[:, 0]), pa.array(d[:, 1]), lists, pa.array(sizes, pa.int64())], ["id", "h", "d1", "d2", "keys", "chars"])

    return rows.select("id", "h", "text").mapInArrow(run, "id long, h long, d1 long, d2 long, keys array<long>, chars long")


_UNITS = "id long, h long, unit long, keys array<long>, chars long"


def _copies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by digest: a number for each digest of this range; its first row keeps the sketches."""
    before: tuple | None = None
    seen = TaskContext.get().partitionId() << 36
    for batch in batches:
        if not batch.num_rows:
            continue
        d1, d2 = (batch.column(i).to_numpy() for i in (2, 3))
        bounds = group_bounds(d1, d2)
        first = np.arange(len(bounds) - 1) + seen + 1
        fresh = bounds[:-1]
        if before == (d1[0], d2[0]):
            first, fresh = first - 1, fresh[1:]
        before, seen = (d1[-1], d2[-1]), int(first[-1])
        stands = np.zeros(batch.num_rows, bool)
        stands[fresh] = True
        keys = pa.compute.if_else(pa.array(stands), batch.column(4), pa.scalar(None, batch.column(4).type))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.repeat(first, np.diff(bounds))), keys, batch.column(5)], ["id", "h", "unit", "keys", "chars"])


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, unit) sorted: an edge from each row to the first of its key here; the ends of the range as edges to stitch."""
    before: tuple | None = None
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        key, unit = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        bounds = group_bounds(key)
        hub = np.repeat(unit[bounds[:-1]], np.diff(bounds))
        if before and before[0] == key[0]:
            hub[: bounds[1]] = before[1]
        if before is None:
            yield pa.RecordBatch.from_arrays([pa.array(key[:1]), pa.array(unit[:1]), pa.array([None], pa.int64())], ["key", "a", "b"])
        before, last = (key[-1], hub[-1]), (key[-1:], hub[-1:])
        edge = hub != unit
        yield pa.RecordBatch.from_arrays([pa.array(key[edge]), pa.array(hub[edge]), pa.array(unit[edge])], ["key", "a", "b"])
    if last:
        yield pa.RecordBatch.from_arrays([pa.array(last[0]), pa.array(last[1]), pa.array([None], pa.int64())], ["key", "a", "b"])


def verified_links(ids: np.ndarray, texts: list[str], keys: np.ndarray, side: np.ndarray, classes: np.ndarray, shingler: Shingler) -> np.ndarray:
    """The class of each text once texts that agree on a key and are similar are joined; pairs that are joined already are skipped.

    side: texts of sides 0 and 1 are compared with the other side only (two blocks); -1 with all. classes: what is joined at first.
    """
    labels, repeats = [], []
    for t in texts:
        h = shingler.shingles(shingler.words(t))
        labels.append(numbered(h))
        repeats.append(labels[-1] is not h)

    def alike(x: int, y: int) -> bool:
        if similarity(labels[x], labels[y]) >= SIMILARITY:
            return True
        return (repeats[x] or repeats[y]) and shingle_similarity(*(shingler.shingles(shingler.words(texts[i])) for i in (x, y))) >= SIMILARITY

    order = [np.sort(x) for x in labels]
    size = np.array([len(x) for x in labels])
    flat, place = np.concatenate(order), np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    #: The texts that agree with a text on a key: those of its groups in each column of keys.
    groups = []
    for c in range(keys.shape[1]):
        by = np.argsort(keys[:, c], kind="stable")
        bounds = group_bounds(keys[by, c])
        groups.append((by, bounds, np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))[np.argsort(by, kind="stable")]))
    joined = classes.copy()
    for x in range(len(ids)):
        near = [by[bounds[g[x]] : bounds[g[x] + 1]] for by, bounds, g in groups if bounds[g[x] + 1] - bounds[g[x]] > 1]
        if not near:
            continue
        near = np.unique(np.concatenate(near))
        near = near[(near > x) & ((side[near] != side[x]) | (side[x] < 0)) & (joined[near] != joined[x])]
        near = near[np.minimum(size[near], size[x]) >= SIMILARITY * np.maximum(size[near], size[x])]
        if not len(near):
            continue
        if not size[x]:
            joined[np.isin(joined, joined[near])] = joined[x]
            continue
        #: Shared labels bound the similarity from above; they are counted for so many labels at a time.
        upto = np.cumsum(size[near])
        likely = []
        for some in np.split(near, np.flatnonzero(np.diff(upto // LABELS_AT_ONCE)) + 1):
            whole = np.concatenate([flat[place[y] : place[y + 1]] for y in some])
            at = np.minimum(np.searchsorted(order[x], whole), size[x] - 1)
            shared = np.add.reduceat((order[x][at] == whole).astype(np.int64), np.cumsum(size[some]) - size[some])
            likely += some[shared >= SIMILARITY * (size[some] + size[x] - shared) - 1e-9].tolist()
        for y in likely:
            if joined[x] != joined[y] and alike(x, y):
                joined[joined == joined[y]] = joined[x]
    return joined


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What each group joins, as edges from its lowest text to one text of every class that came to it."""
    shingler = Shingler()
    for table in grouped(batches, "cluster", "i", "j"):
        c, i, j, block, ids, classes = (table[k].to_numpy() for k in ("cluster", "i", "j", "block", "unit", "class"))
        keys = np.array(table["keys"].combine_chunks().flatten()).reshape(len(ids), -1)
        bounds = group_bounds(c, i, j)
        out: list[tuple[np.ndarray, np.ndarray]] = []
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            side = np.where(i[a:b] == j[a:b], -1, (block[a:b] == j[a:b]).astype(int))
            joined = verified_links(ids[a:b], table["text"].slice(a, b - a).to_pylist(), keys[a:b], side, classes[a:b], shingler)
            own = classes[a:b][np.unique(classes[a:b], return_index=True)[1]]  # each class by its number, which is the lowest text's
            to = joined[np.unique(classes[a:b], return_index=True)[1]]
            _, first, of = np.unique(to, return_index=True, return_inverse=True)
            root = own[first][of]
            out.append((root[root != own], own[root != own]))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([x[k] for x in out]), pa.int64()) for k in (0, 1)], ["a", "b"])


def _compared(work: DataFrame, across: bool = False) -> DataFrame:
    """Links of (cluster, blocks, unit, class, keys, text): within blocks, or across all pairs of blocks too."""
    p = shuffle_partitions(work.sparkSession)
    work = work.withColumn("block", F.pmod(F.xxhash64("unit"), "blocks").cast("int"))
    work = work.withColumn("other", F.explode(F.sequence(F.lit(0), (F.col("blocks") - 1).cast("int"))) if across else F.col("block"))
    work = work.select("cluster", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "unit", "class", "keys", "text")
    return written(work.repartition(p, "cluster", "i", "j").sortWithinPartitions("cluster", "i", "j", "unit").mapInArrow(_links, "a long, b long"), "links")


def _large_links(large: DataFrame, first: DataFrame, block_rows: int, few: bool) -> list[DataFrame]:
    """The links of clusters beyond one block. large: (cluster, unit, keys, chars, text); first: links within their blocks; few: one
    partition is enough for what is known of these texts."""
    links, rows, left = [first], None, False
    while True:
        label = components(reduce(DataFrame.unionByName, links), "a", "b").select(F.col("id").alias("unit"), "component")
        now = written(large.drop("text").join(label, "unit", "left").select("cluster", "unit", "keys", "chars", F.coalesce("component", "unit").alias("class")), "labelled")
        table, now = now, now.coalesce(1) if few else now
        hits = now.select("unit", "class", F.explode("keys").alias("key"))
        shared = hits.groupBy("key").agg(F.min("class").alias("lo"), F.max("class").alias("hi")).filter("lo < hi").select("key")
        hits = hits.join(shared, "key")
        #: One text for each class and sketch that other classes have too, while that brings them down to a block; then all texts.
        while True:
            some = hits.select("unit") if left else hits.groupBy("key", "class").agg(F.min("unit").alias("unit")).select("unit")
            chosen = written(now.join(some.distinct(), "unit"), "chosen")
            size = _blocked(chosen, block_rows)
            state = size.agg(F.sum("rows").alias("rows"), F.max("blocks").alias("blocks")).first()
            if left or not state.rows or rows is None or 2 * state.rows <= rows:
                break
            left = True  # no progress by one text each
        if not state.rows:
            return links
        links.append(_compared(chosen.join(size, "cluster").join(large.select("unit", "text"), "unit"), across=left))
        forget(table, chosen)
        if left:
            return links
        rows, left = state.rows, state.blocks == 1


def _blocked(rows: DataFrame, block_rows: int) -> DataFrame:
    """(cluster, rows, blocks): of bounded size in rows and characters."""
    return rows.groupBy("cluster").agg(F.count("*").alias("rows"), F.ceil(F.greatest(F.count("*") / block_rows, F.sum("chars") / BLOCK_CHARS)).alias("blocks"))


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_rows: int = 800) -> DataFrame:
    """(id, h, class_id, stays) for every text: h is the hash of the text that tells rows of one id apart, class_id the smallest id of
    the class, stays whether the row is the one of its class that stays (rows equal in id and text are one here)."""
    rows = _named(docs, id_col, text_col)
    raw = written(_sketched(rows), "sketches")
    copies = written(in_ranges(raw, "d1", "d2", "id", "h").mapInArrow(_copies, _UNITS), "copies")
    forget(raw)
    distinct = copies.filter("keys is not null")
    hits = written(distinct.select(F.explode("keys").alias("key"), "unit"), "keys")
    stars = written(in_ranges(hits, "key", "unit").mapInArrow(_stars, "key long, a long, b long"), "stars")
    ends = stars.filter("b is null").select("key", "a")
    stitch = ends.groupBy("key").agg(F.min("a").alias("b"), F.collect_set("a").alias("all")).select(F.explode("all").alias("a"), "b")
    clusters = components(stars.filter("b is not null").select("a", "b").unionByName(stitch), "a", "b")
    clusters = written(distinct.join(clusters.select(F.col("id").alias("unit"), F.col("component").alias("cluster")), "unit"), "clusters")
    forget(hits, stars)

    size = _blocked(clusters, block_rows)
    members = clusters.join(size, "cluster").select("cluster", "blocks", "unit", F.col("unit").alias("class"), F.coalesce("id", F.lit(-(1 << 63))).alias("ident"), "h", "keys", "chars")
    texts = rows.select("ident", "h", "text").join(members.select("ident", "h"), ["ident", "h"], "left_semi").dropDuplicates(["ident", "h"])
    whole = members.join(texts, ["ident", "h"]).drop("ident", "h")
    large = None
    beyond = size.filter("blocks > 1").agg(F.sum("rows").alias("rows")).first().rows
    if beyond:
        whole = written(whole, "members")
        large = whole.filter("blocks > 1").select("cluster", "unit", "keys", "chars", "text")
    links = [_compared(whole)]
    if large is not None:
        inside = links[0].join(large.select(F.col("unit").alias("a")), "a", "left_semi")
        links += _large_links(large, inside, block_rows, beyond <= SMALL)[1:]
        forget(whole)
    #: Copies whose digest was cut by a range boundary stand for themselves on each side; they agree on everything, and are linked above.
    of_unit = components(reduce(DataFrame.unionByName, links), "a", "b").select(F.col("id").alias("unit"), "component")
    least = copies.groupBy("unit").agg(F.min(F.struct(F.col("id").isNull().alias("last"), "id", "h")).alias("least"))
    least = least.join(of_unit, "unit", "left").withColumn("component", F.coalesce("component", "unit"))
    least = written(least, "least")
    first = least.groupBy("component").agg(F.min("least").alias("first"))
    of_unit = least.join(first, "component").select("unit", "first")
    own = F.struct(F.col("id").isNull().alias("last"), "id", "h")
    return copies.join(of_unit, "unit").select("id", "h", F.col("first.id").alias("class_id"), (own == F.col("first")).alias("stays")).distinct()


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with class_id and kept: of each class one row stays."""
    docs = drop_names(docs, *RESULT)
    i, h, n = (free_name(docs, k) for k in ("__i", "__h", "__n"))
    ident = F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(-(1 << 63)))
    classes = near_classes(docs, id_col, text_col).select(F.coalesce("id", F.lit(-(1 << 63))).alias(i), F.col("h").alias(h), "class_id", "stays")
    rows = docs.withColumns({i: ident, h: F.xxhash64(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")))})
    rows = rows.withColumn(n, F.row_number().over(Window.partitionBy(i, h).orderBy(i)))
    kept = classes["stays"] & (rows[n] == 1)
    return rows.join(classes, (rows[i] == classes[i]) & (rows[h] == classes[h])).select(*[rows[f"`{c}`"] for c in docs.columns], classes["class_id"], kept.alias("kept"))
