"""Models as plug-ins: encoders, scorers and summarisers over batches, each with a deterministic default."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

Encoder = Callable[[list[str]], list[list[float]]]
Scorer = Callable[[list[str], list[str]], list[float]]
Summariser = Callable[[list[str]], list[str]]
#: Queries, expected texts and found texts to replies.
Judge = Callable[[list[str], list[list[str]], list[list[str]]], list[str]]


def hashing_encoder(dim: int = 64) -> Encoder:
    """Signed counts of hashed words, scaled to length one: for tests and for runs without a model."""

    def encode(texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), dim))
        for i, text in enumerate(texts):
            for w in text.lower().split():
                h = xxhash.xxh3_64_intdigest(w)
                out[i, h % dim] += 1 if h >> 32 & 1 else -1
            out[i] /= np.linalg.norm(out[i]) or 1.0
        return out.tolist()

    return encode


def encoded(text: Column, encoder: Encoder | None = None) -> Column:
    """The vector of each text. Where the encoder fails on a batch its texts are tried one by one, and those it fails on get null."""
    own = encoder or hashing_encoder()

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            texts = [t or "" for t in texts]
            try:
                yield pd.Series(own(texts))
            except Exception:  # noqa: BLE001  a service that fails is part of the contract
                yield pd.Series([one(t) for t in texts], dtype=object)

    def one(text: str) -> list[float] | None:
        try:
            return own([text])[0]
        except Exception:  # noqa: BLE001
            return None

    return run(text)


def word_judge(queries: list[str], expected: list[list[str]], found: list[list[str]]) -> list[str]:
    """Answers as a model is asked to: whether all expected words are in the texts found, some, or none, and their share in percent."""
    out = []
    for want, texts in zip(expected, found, strict=True):
        hits = sum(any(w in t for t in texts) for w in want)
        out.append(f"{'是' if want and hits == len(want) else '部分' if hits else '否'} {100 * hits // max(len(want), 1)} 分")
    return out


def judged(query: Column, expected: Column, found: Column, judge: Judge = word_judge, most: int = 1000) -> Column:
    """A judge's reply on what a search found, to be read by ``parsed_verdict``: expected and found are arrays of texts, each cut before it
    is sent; where the judge fails the reply is empty, which counts as a failure."""

    @F.pandas_udf(T.StringType())
    def run(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        lists = lambda s: [[x or "" for x in v] if v is not None else [] for v in s]
        for q, e, f in batches:
            try:
                yield pd.Series(judge(q.fillna("").tolist(), lists(e), lists(f)), dtype=object)
            except Exception:  # noqa: BLE001
                yield pd.Series([""] * len(q), dtype=object)

    return run(query, expected, F.transform(found, lambda t: F.substr(t, F.lit(1), F.lit(most))))


def pair_scored(query: Column, doc: Column, scorer: Scorer, most: int = 500, default: float = 0.5) -> Column:
    """A model's score of (query, document); texts are cut before they are sent, and a batch that fails gets the default."""

    @F.pandas_udf(T.DoubleType())
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for q, d in batches:
            try:
                yield pd.Series(scorer(q.fillna("").tolist(), d.fillna("").tolist()), dtype="float64")
            except Exception:  # noqa: BLE001
                yield pd.Series([default] * len(q), dtype="float64")

    return run(query, F.substr(doc, F.lit(1), F.lit(most)))


def summarised(text: Column, summariser: Summariser, most: int) -> Column:
    """A model's summary, cut; where it fails the beginning of the text."""

    @F.pandas_udf(T.StringType())
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            try:
                yield pd.Series(summariser(texts.fillna("").tolist()))
            except Exception:  # noqa: BLE001
                yield pd.Series([None] * len(texts))

    return F.substr(F.coalesce(run(text), text), F.lit(1), F.lit(most))
