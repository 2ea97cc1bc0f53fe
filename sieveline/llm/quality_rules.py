"""Quality by a sparse ensemble of rules over text statistics.

Statistics of every whole text are Spark column expressions. Shallow trees are grown in numpy on random halves of a bounded
sample of labelled rows; every path from a root is a rule, a conjunction of comparisons of statistics with thresholds. A
logistic model over the rules is fitted with an L1 penalty, which leaves few of them, and what is left is compiled back into
one Spark column: the sigmoid of a sum of CASE terms. Scoring needs no Python and no shuffle.

Defined cases: null counts as empty; an empty text has zero for every statistic and is scored by the rules like any other;
texts of any length are measured whole; labels that are null or other than 0 and 1 are not used; without labelled rows of
both classes the score is the share of class 1 among those there are, 1 if there are none (nothing is rejected without
evidence); repeated rows are scored alike; columns of the input pass through, whatever their names, and one with the name of the
score is replaced; an empty table gives no rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_names, free_name
from .labelled import training_rows


def statistics(text: Column, base_col: str = "__base") -> dict[str, Column]:
    t = F.coalesce(text, F.lit(""))
    words = F.array_remove(F.split(t, r"\s+"), "")
    lines = F.array_remove(F.split(t, "\n"), "")
    per = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    base = F.struct(
        F.char_length(t).alias("n"),
        F.size(words).alias("words"),
        F.size(F.array_distinct(words)).alias("kinds"),
        F.size(lines).alias("lines"),
        F.size(F.array_distinct(lines)).alias("line_kinds"),
        F.char_length(F.regexp_replace(t, r"\P{L}+", "")).alias("letters"),
        F.regexp_count(t, F.lit(r"\p{Lu}")).alias("upper"),
        F.regexp_count(t, F.lit(r"[^\p{L}\p{N}\s.,;:?'\"()-]")).alias("symbols"),
        F.regexp_count(t, F.lit("[0-9]")).alias("digits"),
        F.regexp_count(t, F.lit("[.?!]")).alias("ends"),
    )
    b = F.col(base_col)
    return {
        "__base": base,
        "log_words": F.ln(F.lit(1.0) + b.words),
        "word_kinds": per(b.kinds, b.words),
        "word_kinds_root": per(b.kinds, F.sqrt(b.words.cast("double"))),
        "line_kinds": per(b.line_kinds, b.lines),
        "words_per_line": per(b.words, b.lines),
        "word_length": per(b.letters, b.words),
        "letters": per(b.letters, b.n),
        "upper": per(b.upper, b.letters),
        "symbols": per(b.symbols, b.n),
        "symbols_per_word": per(b.symbols, b.words),
        "digits": per(b.digits, b.n),
        "ends_per_word": per(b.ends, b.words),
    }


def measured(docs: DataFrame, text_col: str = "text", out_col: str = "__stats") -> DataFrame:
    """``docs`` with a struct of the statistics.

    Each struct is given out by a generator of one row: a filter on what follows from it can't be pushed below, where Spark
    would put a copy of every expression into each of the rules.
    """
    between = free_name(docs, "__base")
    stats = statistics(F.col(text_col), between)
    rows = docs.select("*", F.explode(F.array(stats.pop("__base"))).alias(between))
    return rows.select("*", F.explode(F.array(F.struct(*[c.cast("double").alias(k) for k, c in stats.items()]))).alias(out_col)).drop(between)


@dataclass
class Rules:
    """names[feature] <= or > threshold, in conjunction; a weight for each rule."""

    rules: list[tuple[tuple[str, bool, float], ...]]
    weights: list[float]
    bias: float

    def column(self, stats: Column) -> Column:
        total = F.lit(self.bias)
        for rule, w in zip(self.rules, self.weights, strict=True):
            holds = F.lit(True)
            for name, above, cut in rule:
                holds = holds & ((stats[name] > cut) if above else (stats[name] <= cut))
            total = total + F.when(holds, F.lit(w)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def _paths(x: np.ndarray, y: np.ndarray, rows: np.ndarray, depth: int, features: np.ndarray, least: int, path: tuple = ()) -> list[tuple]:
    """Every path of a tree grown on the rows, by Gini impurity over quantiles."""
    best = None
    n, ones = len(rows), y[rows].sum()
    if depth and n >= 2 * least and 0 < ones < n:
        for f in features:
            v = x[rows, f]
            order = np.sort(v)
            cuts = np.unique((order[np.linspace(0, n - 2, 24).astype(int)] + order[np.linspace(1, n - 1, 24).astype(int)]) / 2)
            left = v[None, :] <= cuts[:, None]
            a = left.sum(1)
            a1 = left @ y[rows]
            ok = (a >= least) & (n - a >= least)
            if ok.any():
                gini = np.where(ok, a1 * (a - a1) / np.maximum(a, 1) + (ones - a1) * (n - a - ones + a1) / np.maximum(n - a, 1), np.inf)
                k = int(gini.argmin())
                if best is None or gini[k] < best[0] - 1e-12:
                    best = (gini[k], int(f), float(cuts[k]))
    own = [path] if path else []
    if best is None:
        return own
    _, f, cut = best
    below = x[rows, f] <= cut
    return own + _paths(x, y, rows[below], depth - 1, features, least, (*path, (f, False, cut))) + _paths(x, y, rows[~below], depth - 1, features, least, (*path, (f, True, cut)))


def _lasso(z: np.ndarray, y: np.ndarray, penalty: float, steps: int = 600) -> tuple[np.ndarray, float]:
    """Logistic weights with an L1 penalty on all but the bias, by accelerated proximal gradient steps."""
    z1 = np.column_stack([z, np.ones(len(z))])
    w = np.zeros(z1.shape[1])
    v, t = w.copy(), 1.0
    step = 4 * len(z) / max(np.linalg.norm(z1, 2) ** 2, 1e-9)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z1 @ v, -30, 30)))
        new = v - step * (z1.T @ (p - y)) / len(z)
        new[:-1] = np.sign(new[:-1]) * np.maximum(np.abs(new[:-1]) - step * penalty, 0)
        t_new = (1 + math.sqrt(1 + 4 * t * t)) / 2
        v, w, t = new + (t - 1) / t_new * (new - w), new, t_new
    return w[:-1], float(w[-1])


def fit_rules(x: np.ndarray, y: np.ndarray, names: list[str], trees: int = 48, depth: int = 3, penalty: float = 0.003, seed: int = 3) -> Rules:
    """Deterministic for a given order of the rows."""
    if len(set(y.tolist())) < 2:
        share = min(max(float(y.mean()) if len(y) else 1.0, 1e-6), 1 - 1e-6)
        return Rules([], [], math.log(share / (1 - share)))
    rng = np.random.default_rng(seed)
    found: dict[tuple, None] = {}
    for _ in range(trees):
        rows = np.sort(rng.permutation(len(y))[: max(20, len(y) // 2)])
        features = np.sort(rng.permutation(len(names))[: max(4, len(names) // 2)])
        for path in _paths(x, y, rows, depth, features, max(4, len(y) // 200)):
            found.setdefault(path)
    rules = list(found)
    holds = np.column_stack([np.logical_and.reduce([(x[:, f] > cut) == above for f, above, cut in rule]) for rule in rules]) if rules else np.zeros((len(y), 0))
    _, first = np.unique(holds, axis=1, return_index=True)  # of rules that agree on all rows the first one
    first = np.sort(first)
    weights, bias = _lasso(holds[:, first].astype(float), y.astype(float), penalty)
    kept = [(rules[i], float(w)) for i, w in zip(first, weights, strict=True) if abs(w) > 1e-9]
    return Rules([tuple((names[f], above, cut) for f, above, cut in rule) for rule, _ in kept], [w for _, w in kept], bias)


def fit_quality(docs: DataFrame, labels: DataFrame, text_col: str = "text", most: int = 8000) -> Rules:
    """Fits on at most ``most`` labelled rows; only their statistics reach the driver."""
    rows = measured(training_rows(docs.select("doc_id", text_col), labels, "quality", most, text_col=text_col), text_col)
    names = [k for k in statistics(F.lit("")) if k != "__base"]
    got = rows.select("doc_id", "__label", *[F.col("__stats")[k].alias(k) for k in names]).toPandas().sort_values(["doc_id", *names], kind="stable")
    return fit_rules(got[names].to_numpy(float), got["__label"].to_numpy(int), names)


def quality_scores(docs: DataFrame, rules: Rules, text_col: str = "text", out_col: str = "quality_score") -> DataFrame:
    """``docs`` with the score of every row."""
    docs = drop_names(docs, out_col)
    stats = free_name(docs, "__stats")
    return measured(docs, text_col, stats).withColumn(out_col, rules.column(F.col(stats))).drop(stats)
