"""Toxicity by subword-bag embeddings and a linear softmax, trained jointly in numpy.

A word is the bag of its character n-grams (with its ends marked), each hashed to one of ``buckets`` embedding rows; a bag is
averaged and goes through a linear layer and a softmax over the two classes. Embeddings and layer are trained together by
Adagrad, so a misspelling that was never seen shares the vectors of the n-grams it keeps. A run of word characters beyond
``PIECE`` (a script without blanks, words glued together) is read as several words, pieces that overlap by all but one
character of the longest n-gram: each of its n-grams is in one of them, whatever the length of the run.

A few insults in a long text vanish in the average over all of it. So the bag that is averaged is a window of ``window``
words (a shorter last window is filled up with zeros), and a document is as toxic as its three most toxic windows are on
average. Training alternates: the present model picks for each document of class 1 the windows it finds most toxic, and for
class 0 the hardest ones and some at random; those are the next examples. The odds of n-grams pick the first ones. A document
of class 1 whose odds are those of class 0 may carry a wrong label: it is kept, with the weight ``DOUBTFUL``, and counts in full
where the cut is chosen.

The layer is linear, so a word's share of its window's logit is computed once for each distinct word (a bounded memo). A
batch of texts is flattened to word numbers; windows are sums of slices, and the best windows of each text are found by one
sort of the batch.

Defined cases: null and empty texts, and texts without a word, get the share of class 1 among the labelled rows; texts and words of
any length are scored whole; labels that are null or other than 0 and 1 are not used; without labelled rows of both classes the
score is the share of class 1 among those there are, 0 if none; repeated rows are scored alike, and of rows that share an id each
is scored by its own text; an empty table gives no rows; columns of the input pass through untouched, as the score is a column.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_RUNS = re.compile(r"\w+").findall
LOW, HIGH = 3, 6
#: Characters of a word, at most; longer runs are cut into overlapping pieces of so many.
PIECE = 40
#: Weight of training documents of class 1 that look like class 0.
DOUBTFUL = 0.25
#: Characters of a batch that is scored at once; a longer text stands alone.
BATCH_CHARS = 1 << 20


def words_of(text: str) -> list[str]:
    """Lower-cased runs of word characters, long ones in pieces."""
    runs = _RUNS(text.lower())
    if not runs or max(map(len, runs)) <= PIECE:
        return runs
    return [piece for run in runs for piece in ((run,) if len(run) <= PIECE else pieces(run))]


def pieces(run: str) -> list[str]:
    step = PIECE - (HIGH - 1)
    return [run[i : i + PIECE] for i in range(0, len(run) - (HIGH - 1), step)]


def grams(word: str, buckets: int, low: int = LOW, high: int = HIGH) -> list[int]:
    """Rows of the word's n-grams, and of the word itself."""
    marked = f"<{word}>"
    found = {marked, *(marked[i : i + n] for n in range(low, high + 1) for i in range(len(marked) - n + 1))}
    return sorted({xxhash.xxh32_intdigest(g) % buckets for g in found})


#: So many of a document's most toxic windows make its score.
POOL = 3


def window_logits(words: np.ndarray, counts: np.ndarray, window: int, bias: float, wordless: float) -> tuple[np.ndarray, np.ndarray]:
    """From the logits that the words of texts add, with the number of words of each text: the logit of every window, and where the
    windows of each text end. A text without words has one window."""
    sizes = np.maximum(-(-counts // window), 1)
    ends = np.cumsum(sizes)
    out = np.full(int(ends[-1]) if len(ends) else 0, wordless)
    if len(words):
        some = counts > 0
        of = np.repeat(np.flatnonzero(some), sizes[some])
        nth = np.arange(len(of)) - np.repeat(np.cumsum(sizes[some]) - sizes[some], sizes[some])
        begin = (np.cumsum(counts) - counts)[of] + nth * window
        out[(ends - sizes)[of] + nth] = np.add.reduceat(words, begin) + bias
    return out, ends


def pooled(logits: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The mean of the POOL highest windows of each text."""
    sizes = np.diff(ends, prepend=0)
    of = np.repeat(np.arange(len(ends)), sizes)
    best = logits[np.lexsort((-logits, of))]
    nth = np.arange(len(best)) - np.repeat(ends - sizes, sizes)
    best = np.where(nth < POOL, best, 0.0)
    return np.add.reduceat(best, ends - sizes) / np.minimum(sizes, POOL) if len(ends) else np.empty(0)


class _Memo(dict):
    """What each word adds, learnt when it is asked for."""

    def __init__(self, weight: np.ndarray):
        super().__init__()
        self.weight = weight

    def __missing__(self, word: str) -> float:
        known = self[word] = float(self.weight[grams(word, len(self.weight))].mean())
        return known


@dataclass
class SubwordModel:
    """The trained layer over the trained embeddings, folded: what each n-gram adds to the logit of class 1."""

    weight: np.ndarray
    bias: float
    window: int = 8
    wordless: float = 0.0
    memo: _Memo | None = field(default=None, repr=False)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"memo": None}

    def logits(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if self.memo is None or len(self.memo) > 400_000:
            self.memo = _Memo(self.weight)
        read = [words_of(t) for t in texts]
        counts = np.fromiter(map(len, read), np.int64, len(read))
        each = np.fromiter(map(self.memo.__getitem__, chain.from_iterable(read)), np.float64, int(counts.sum()))
        return window_logits(each, counts, self.window, self.bias, self.wordless)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(pooled(*self.logits([t or "" for t in texts])), -30, 30)))

    def score(self, text: str | None) -> float:
        return float(self.scores([text])[0])


class _Bags:
    """The training texts as windows of word numbers, and each word's n-gram rows, flat."""

    def __init__(self, texts: list[str], window: int, buckets: int):
        number: dict[str, int] = {}
        self.window = window
        self.words = [np.array([number.setdefault(w, len(number)) for w in words_of(t)], np.int64) for t in texts]
        rows = [grams(w, buckets) for w in number]
        self.size = np.array([len(r) for r in rows], np.int64)
        self.begin = np.concatenate([[0], np.cumsum(self.size)]).astype(np.int64)
        self.flat = np.fromiter((x for r in rows for x in r), np.int64)

    def rows(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The n-gram rows of the words, and for each the place of its word."""
        size = self.size[words]
        at = np.repeat(np.arange(len(words)), size)
        first = np.concatenate([[0], np.cumsum(size)[:-1]]).astype(np.int64) if len(words) else size
        return self.flat[np.arange(len(at)) - np.repeat(first, size) + np.repeat(self.begin[words], size)], at

    def logits(self, weight: np.ndarray, bias: float) -> list[np.ndarray]:
        """Of every window of every text."""
        word = np.add.reduceat(weight[self.flat], self.begin[:-1]) / self.size if len(self.flat) else np.empty(0)
        return [window_logits(word[w], np.array([len(w)]), self.window, bias, bias)[0] for w in self.words]


def fit(texts: list[str], labels: list[int], window: int = 8, dim: int = 8, buckets: int = 1 << 18, rounds: int = 4, epochs: int = 2, rate: float = 0.2, decay: float = 1e-3, seed: int = 5) -> SubwordModel:
    """Trains on whole texts with a label each. Deterministic for a given order of the rows."""
    rng = np.random.default_rng(seed)
    y = np.array(labels, np.int64)
    if len(set(labels)) < 2 or not any(map(_RUNS, texts)):
        share = min(max(float(y.mean()) if len(y) else 0.0, 1e-9), 1 - 1e-9)
        return SubwordModel(np.zeros(1), math.log(share / (1 - share)), window, math.log(share / (1 - share)))
    bags = _Bags(texts, window, buckets)
    emb = rng.normal(0, 0.1, (buckets, dim))
    layer, bias = rng.normal(0, 0.3, (dim, 2)), np.zeros(2)
    sum_emb, sum_layer, sum_bias = np.full(buckets, 1e-2), np.full((dim, 2), 1e-2), np.full(2, 1e-2)

    #: Odds of n-grams between the classes, shrunk where there are few, choose the windows of the first round.
    in_class = np.full((2, buckets), 0.5)
    for words, label in zip(bags.words, y, strict=True):
        in_class[label, np.unique(bags.rows(np.unique(words))[0])] += 1
    seen = in_class.sum(0) - 1
    odds = (np.log(in_class[1] / (y.sum() + 1)) - np.log(in_class[0] / (len(y) - y.sum() + 1))) * seen / (seen + 5)
    each = bags.logits(odds, 0.0)
    top = best_windows(each)
    trust = np.where((y == 1) & (top <= np.median(top[y == 0])), DOUBTFUL, 1.0)
    for _ in range(rounds):
        examples: list[tuple[np.ndarray, int, float]] = []
        for i in range(len(y)):
            order = np.argsort(-each[i], kind="stable")[:POOL]
            if y[i]:
                order = order[each[i][order] > each[i][order[0]] - 3]
            else:
                order = np.unique(np.concatenate([order, rng.integers(0, len(each[i]), 2)]))
            examples += [(bags.words[i][j * window : (j + 1) * window], int(y[i]), 2.0 * trust[i] if y[i] else 1.0) for j in order]
        target, worth = np.array([label for _, label, _ in examples]), np.array([x for *_, x in examples])
        for _ in range(epochs):
            for chunk in np.array_split(rng.permutation(len(examples)), max(1, len(examples) // 64)):
                words = [examples[i][0] for i in chunk]
                rows, place = bags.rows(np.concatenate(words))
                at = np.repeat(np.arange(len(words)), [len(w) for w in words])[place]
                part = 1 / bags.size[np.concatenate(words)][place]
                hidden = np.stack([np.bincount(at, emb[rows, d] * part, len(words)) for d in range(dim)], 1)
                z = hidden @ layer + bias
                p = np.exp(z - z.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                error = p - np.eye(2)[target[chunk]]
                error *= worth[chunk][:, None]
                g_layer, g_bias = hidden.T @ error / len(chunk) + decay * layer, error.mean(0)
                g = (error @ layer.T)[at] * part[:, None] + decay * emb[rows]
                sum_layer += g_layer**2
                sum_bias += g_bias**2
                layer -= rate * g_layer / np.sqrt(sum_layer)
                bias -= rate * g_bias / np.sqrt(sum_bias)
                sum_emb += np.bincount(rows, (g**2).mean(1), buckets)
                np.subtract.at(emb, rows, rate * g / np.sqrt(sum_emb[rows])[:, None])
        weight = emb @ (layer[:, 1] - layer[:, 0])
        each = bags.logits(weight, float(bias[1] - bias[0]))
    model = SubwordModel(weight, float(bias[1] - bias[0]), window, math.log(y.sum() / (len(y) - y.sum())))
    model.bias -= _best_cut(best_windows(each), y)
    return model


def best_windows(each: list[np.ndarray]) -> np.ndarray:
    """The pooled logit of each text."""
    return pooled(np.concatenate(each), np.cumsum([len(x) for x in each]))


def _best_cut(top: np.ndarray, y: np.ndarray) -> float:
    """Where most of the training documents fall on their own side, both classes counting alike."""
    order = np.unique(top)
    cuts = np.concatenate([[order[0] - 1], (order[1:] + order[:-1]) / 2, [order[-1] + 1]])
    ones, zeros = np.sort(top[y == 1]), np.sort(top[y == 0])
    right = (len(ones) - np.searchsorted(ones, cuts)) / len(ones) + np.searchsorted(zeros, cuts) / len(zeros)
    best = cuts[right >= right.max() - 1e-12]
    return float(best[len(best) // 2])


def scored(docs: DataFrame, model: SubwordModel, text: Column) -> Column:
    """The score of each whole text, as a column. The model has a fixed size and is broadcast."""
    spread = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(T.DoubleType())
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = spread.value
        for series in batches:
            texts, out, k = series.tolist(), [], 0
            while k < len(texts):
                end, size = k, 0
                while end < len(texts) and (size < BATCH_CHARS or end == k):
                    size += len(texts[end] or "")
                    end += 1
                out.append(own.scores(texts[k:end]))
                k = end
            yield pd.Series(np.concatenate([*out, np.empty(0)]))

    return score(text)
