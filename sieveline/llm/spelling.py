"""Spelling variants: words one edit apart, through a positional q-gram index, and the form that the frequent one gives.

A pair one edit apart, the longer word of m characters, agrees in a prefix or a suffix of about m / 2: these are the positional grams
that deal words to blocks. In a block the agreeing part is known and the rest, which holds the edit, is cut the same way: what
agrees is in its first or in its last half. A block with more than ``most`` words (a hot gram) is cut by that longer gram, until
every block is small; the counts that decide it are combined before they are shuffled. A pair belongs to the first half whenever
it agrees there, and to the last half otherwise, so it is met in exactly one block, and nothing has to be removed twice.

In a block, words are in an inverted index of positional grams of two characters (those that the block's own key fixes are
the same for all and left out). Each word merges the postings of its grams, those of the same length at the same place, those of
words one shorter at the same place or one before; a merge is a sort of the sorted lists, for very many words at once, and in
bounded steps. One edit changes at most two grams, so a pair with fewer in common than the longer word has grams, less two, goes;
the others are verified letter by letter. Only sums leave a block: the number of near words, and the best of them.

Forms are followed by pointer doubling: a form is ten times as frequent, so paths are short.

Defined cases: a null text has no words, a null id is empty in the hash; a word of any length is a word; rows that share an id, and
repeated rows, count each; ties of n go to the smaller word in code points; an empty table gives an empty one; columns beside id and text
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, forget, group_bounds, grouped, shuffle_partitions, written

LETTERS = "A-Za-z\\u00C0-\\u00FF"
#: Words of a block, at most, and characters of all of them; steps of the merge, in postings met.
MOST, MOST_CHARS, STEP = 1024, 1 << 22, 1 << 21
#: Deepest a path can go: halves of the longest word.
FOREVER = 1 << 30


def words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = 7, least_count: int = 2, modulus: int = 31) -> DataFrame:
    """(word, n): runs of letters of at least ``least_length``, lower-cased in A-Z, some with a letter less, that occur often enough.

    Runs that are too short to give a word are never cut out of the text. A run's letter h % length goes where the modulus divides
    h = crc32(id:run).
    """
    runs = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(F.col(text_col), F.lit(f"[{LETTERS}]{{{least_length},}}"), F.lit(0))).alias("run"))
    runs = runs.select("id", ascii_lower(F.col("run")).alias("run"))
    h = runs.withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")))
    at = F.pmod("h", F.char_length("run").cast("long")).cast("int")
    less = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.char_length("run")))
    word = F.when(F.pmod("h", F.lit(modulus)) == 0, less).otherwise(F.col("run"))
    return h.select(word.alias("word")).filter(F.char_length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least_count)


def _key(i: Column, j: Column, cap: Column) -> Column:
    """What the words of a block share; a collision joins two blocks, which costs time only, as pairs are verified."""
    head = F.substring("word", F.lit(1), i)
    tail = F.when(j > 0, F.substring("word", F.char_length("word") - j + 1, j)).otherwise(F.lit(""))
    return F.xxhash64("m", i, j, cap, head, tail)


def _halves(rows: DataFrame) -> DataFrame:
    """Blocks (m, i, j, cap) cut in two: i and j characters agree in front and behind, and pairs of the block agree in fewer than cap in front."""
    rest = F.col("m") - F.col("i") - F.col("j")
    first = F.ceil(rest / 2).cast("int")
    left = F.struct((F.col("i") + first).alias("i"), F.col("j").alias("j"), F.col("cap").alias("cap"))
    right = F.struct(F.col("i").alias("i"), (F.col("j") + rest - first).alias("j"), F.least("cap", F.col("i") + first).alias("cap"))
    cut = rows.select("word", "n", "m", F.explode(F.array(left, right)).alias("b")).select("word", "n", "m", "b.*")
    cut = cut.filter((F.col("i") < F.col("cap")) & (F.col("i") + F.col("j") <= F.char_length("word")))
    return cut.withColumn("key", _key(F.col("i"), F.col("j"), F.col("cap")))


def blocks(vocabulary: DataFrame, most: int = MOST) -> DataFrame:
    """(word, n, m, i, j, cap, key): every word in the blocks of its length and of one more, each of at most ``most`` words unless
    nothing is left to cut, in which case it holds words that differ in one letter at one place."""
    length = F.char_length("word")
    rows = vocabulary.select("word", "n", F.explode(F.array(length, length + 1)).alias("m"), F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(FOREVER).alias("cap"))
    rows, done = _halves(rows), []
    while True:
        counts = rows.groupBy("key").agg(F.count("*").alias("c"), F.max("m").alias("m"), F.max(F.col("m") - F.col("i") - F.col("j")).alias("rest"))
        bound = F.least(F.lit(most), F.greatest(F.lit(128), F.floor(F.lit(MOST_CHARS) / F.col("m"))))
        hot = written(counts.filter((F.col("c") > bound) & (F.col("rest") > 1)).select("key"), "hot-grams")
        if hot.isEmpty():
            break
        done.append(rows.join(hot, "key", "left_anti"))
        rows = written(_halves(rows.join(hot, "key", "left_semi").drop("key")), "blocks")
    for other in done:
        rows = rows.unionByName(other)
    return rows


def _letters(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All code points (latin letters) one after the other, where each word starts, and lengths."""
    text = column.to_pylist()
    flat = np.frombuffer("".join(text).encode("latin-1"), np.uint8).astype(np.int32)
    size = np.array([len(t) for t in text], np.int64)
    return flat, np.cumsum(size) - size, size


def _agree(flat: np.ndarray, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> np.ndarray:
    """How many of the n characters from a on equal those from b on, before the first that doesn't."""
    count, live, k = np.zeros(len(a), np.int64), np.flatnonzero(n > 0), 0
    while len(live):
        live = live[flat[a[live] + k] == flat[b[live] + k]]
        count[live] += 1
        k += 1
        live = live[n[live] > k]
    return count


def _spread(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For ranges lo..hi: which range, and the places in it."""
    size = hi - lo
    which = np.repeat(np.arange(len(lo)), size)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(lo, size)


def _near(block: np.ndarray, m: np.ndarray, i: np.ndarray, j: np.ndarray, cap: np.ndarray, letters: tuple[np.ndarray, np.ndarray, np.ndarray], step: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (x, y) of rows of the same block one edit apart, x of m characters, y of m (then x < y) or one less."""
    flat, start, size = letters
    full = np.flatnonzero(size == m)
    # Grams that touch what the key leaves open, of the long words: places i - 1 .. m - j - 1.
    first, last = np.maximum(i - 1, 0), np.minimum(m - j - 1, m - 2)
    open_ = np.maximum(last - first + 1, 0)
    gram = lambda rows, at: (flat[start[rows] + at] << 8) | flat[start[rows] + at + 1]
    # Postings: (block, place, gram) of all rows, sorted; words one shorter are lists of their own.
    short = (size < m).astype(np.int64)
    row, at = _spread(first, np.minimum(last, size - 2) + 1)
    places = int(at.max(initial=0)) + 2
    name = lambda rows, at, short, gram: (((block[rows] * places + at) * 2 + short) << 16) | gram
    post = name(row, at, short[row], gram(row, at))
    order = np.argsort(post, kind="stable")
    post, row = post[order], row[order]
    # What each long word asks for: its own grams among long words, and among short ones at the same place and one before.
    q, at = _spread(first[full], last[full] + 1)
    q = full[q]
    g = gram(q, at)
    asks, who = [name(q, at, 0, g), name(q, at, 1, g)], [q, q]
    before = at > first[q]
    asks.append(name(q[before], at[before] - 1, 1, g[before]))
    who.append(q[before])
    asks, who = np.concatenate(asks), np.concatenate(who)
    order = np.argsort(who, kind="stable")
    asks, who = asks[order], who[order]
    lo, hi = np.searchsorted(post, asks), np.searchsorted(post, asks, "right")
    # Where two grams or fewer are open, the bound allows all words of the block.
    free = full[open_[full] <= 2]
    if len(free):
        bounds = np.append(np.flatnonzero(np.append(True, block[1:] != block[:-1])), len(block)) if len(block) else np.zeros(1, np.int64)
        own = np.searchsorted(bounds, free, "right") - 1
        which, y = _spread(bounds[own], bounds[own + 1])
        yield from _verified(free[which], y, i, j, cap, m, letters)
    if not len(who):
        return
    met = np.cumsum(hi - lo)
    ends = np.append(np.flatnonzero(who[1:] != who[:-1]) + 1, len(who))  # a word's lists stay together
    filled = met[ends - 1] // step
    edges = np.concatenate([[0], ends[:-1][filled[1:] != filled[:-1]], [len(who)]])
    for a, b in zip(edges, edges[1:], strict=False):
        which, p = _spread(lo[a:b], hi[a:b])
        if len(which):
            pairs = np.sort(who[a:b][which] * len(size) + row[p])  # the merge
            new = np.flatnonzero(np.append(True, pairs[1:] != pairs[:-1]))
            common = np.diff(np.append(new, len(pairs)))
            x, y = np.divmod(pairs[new], len(size))
            enough = (common >= open_[x] - 2) & (open_[x] > 2)
            yield from _verified(x[enough], y[enough], i, j, cap, m, letters)


def _verified(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray, cap: np.ndarray, m: np.ndarray, letters: tuple[np.ndarray, np.ndarray, np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of the pairs, those exactly one edit apart that belong to their block."""
    flat, start, size = letters
    keep = (size[y] < m[x]) | (x < y)
    x, y = x[keep], y[keep]
    same = _agree(flat, start[x], start[y], size[y])
    keep = (same >= i[x]) & (same < cap[x]) & (same < size[x])
    x, y, same = x[keep], y[keep], same[keep]
    rest = size[x] - same - 1
    keep = _agree(flat, start[x] + same + 1, start[y] + same + (size[y] == size[x]), rest) == rest
    keep &= rest >= j[x]
    yield x[keep], y[keep]


_OUT = pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("best_n", pa.int64()), ("best", pa.string())])


def _links(step: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in grouped(batches, "key"):
            t = t.combine_chunks()
            column = lambda c: t.column(c).to_numpy()  # noqa: E731, B023
            key, n = column("key"), column("n")
            bounds = group_bounds(key)
            # Many small blocks at a time.
            at = 0
            while at < len(bounds) - 1:
                to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + (1 << 15), "right")) - 1)
                a, b = int(bounds[at]), int(bounds[to])
                at = to
                word = t.column("word").slice(a, b - a)
                m, i, j, cap = (column(c)[a:b].astype(np.int64) for c in ("m", "i", "j", "cap"))
                block = np.repeat(np.arange(to), np.diff(bounds[: to + 1]))[a:b]
                block = block - block[0]
                found = list(_near(block, m, i, j, cap, _letters(word), step))
                x, y = (np.concatenate([p[k] for p in found]) if found else np.zeros(0, np.int64) for k in (0, 1))
                if not len(x):
                    continue
                own, other = np.concatenate([x, y]), np.concatenate([y, x])
                text = np.array(word.to_pylist(), object)
                rank = np.empty(len(text), np.int64)
                rank[np.argsort(text, kind="stable")] = np.arange(len(text))
                weight = n[a:b]
                order = np.lexsort((rank[other], -weight[other], own))
                own, other = own[order], other[order]
                first = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
                best = other[first]
                yield pa.RecordBatch.from_arrays([pa.array(text[own[first]], pa.string()), pa.array(np.diff(np.append(first, len(own)))), pa.array(weight[best]), pa.array(text[best], pa.string())], schema=_OUT)

    return run


def near_words(vocabulary: DataFrame, most: int = MOST, step: int = STEP) -> DataFrame:
    """(word, n) to (word, n_near, best_n, best), for words that have a near one: how many, and the most frequent of them."""
    dealt = blocks(vocabulary, most).repartition(shuffle_partitions(vocabulary.sparkSession), "key").sortWithinPartitions("key")
    part = dealt.select("key", "word", "n", "m", "i", "j", "cap").mapInArrow(_links(step), "word string, n_near long, best_n long, best string")
    top = F.min(F.struct((-F.col("best_n")).alias("least"), F.col("best").alias("best"))).alias("top")
    return part.groupBy("word").agg(F.sum("n_near").alias("n_near"), top).select("word", "n_near", (-F.col("top.least")).alias("best_n"), "top.best")


def followed(forms: DataFrame) -> DataFrame:
    """(word, form) to (word, root) by pointer doubling; words without a form are not among the rows, unless as a form."""
    now = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        up = now.select(F.col("word").alias("root"), F.col("root").alias("up"))
        jumped = now.join(up, "root", "left").select("word", F.coalesce("up", "root").alias("root"), F.col("up").isNotNull().alias("moved"))
        nxt = written(jumped, "roots")
        forget(now)
        if not nxt.agg(F.max("moved").alias("m")).first().m:
            return nxt.select("word", "root")
        now = nxt.select("word", "root")
        now.written_to = nxt.written_to


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", times: int = 10, least_length: int = 7, least_count: int = 2, most: int = MOST, step: int = STEP) -> DataFrame:
    """(word, form, root, n, n_near, form_n): a word's form is its near word of largest n, where that is ``times`` its own or more."""
    vocabulary = written(words(docs, id_col, text_col, least_length, least_count), "words")
    near = near_words(vocabulary, most, step)
    known = vocabulary.join(near, "word", "left")
    led = F.col("best_n") >= times * F.col("n")
    out = written(known.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(led, F.col("best")).alias("form"), F.when(led, F.col("best_n")).alias("form_n")), "variants")
    roots = followed(out.filter("form is not null"))
    return out.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
