"""Learners that follow feedback in order: plain and semi-adaptive weights.

The update is not associative, so events of one domain are folded one after the other. They are dealt by domain, sorted by
sequence outside memory, and a task holds no more than the present weights of the domain it is at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scoring import FACTORS

# Rates, limits, and the numbers of events and changes that count.
RATE, LOWEST, HIGHEST = 0.1, 0.1, 2.0
CAREFUL_RATE, LEAST_FACTOR, MOST_FACTOR, WARM_UP, LOGGED, REVIEWED = 0.05, 0.8, 1.2, 10, 0.01, 0.1


def predict(weights: np.ndarray, features: np.ndarray) -> float:
    return min(1.0, max(0.0, float(np.multiply.reduce(weights * features))))


def step(weights: np.ndarray, features: np.ndarray, feedback: float) -> tuple[np.ndarray, float]:
    """The weights after one event, and its error."""
    error = feedback - predict(weights, features)
    return np.clip(weights + RATE * error * features, LOWEST, HIGHEST), error


def careful_step(factors: np.ndarray, seen: int, features: np.ndarray, feedback: float) -> tuple[np.ndarray, list[tuple[int, float, float, float, bool]]]:
    """The adjustments after event number ``seen``, and what is logged: factor, old, new, change, whether it needs a review."""
    if seen < WARM_UP:
        return factors, []
    error = feedback - predict(factors, features)
    new = np.clip(factors + CAREFUL_RATE * error * features, LEAST_FACTOR, MOST_FACTOR)
    change = (new - factors) / factors
    return new, [(i, float(factors[i]), float(new[i]), float(change[i]), bool(abs(change[i]) > REVIEWED)) for i in np.flatnonzero(np.abs(change) > LOGGED)]


def _dealt(events: DataFrame, alias_domains: bool) -> DataFrame:
    rows = events.withColumn("domain", F.lit("all")) if alias_domains else events
    return rows.select("domain", "seq", "feedback", *FACTORS).repartition("domain").sortWithinPartitions("domain", "seq")


def adaptive_weights(events: DataFrame, alias_domains: bool = False, start: DataFrame | None = None) -> DataFrame:
    """(domain, events, the six weights) after all events (domain, seq, feedback, the six features).

    alias_domains: all domains share one set of weights, as where an unseen domain starts with the general one by reference;
    the fold is then one sequence by definition. start: such rows from before, as ``loaded_weights`` gives them; a domain goes on
    from its own, and one without new events stays as it was.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        domain, weights, n = None, np.ones(len(FACTORS)), 0
        out = []
        for pdf in batches:
            x, y = pdf[list(FACTORS)].to_numpy(float), pdf["feedback"].to_numpy(float)
            before = pdf[["b_events", *(f"b_{k}" for k in FACTORS)]].to_numpy(float)
            for i, d in enumerate(pdf["domain"]):
                if d != domain:
                    if n:
                        out.append((domain, n, *weights))
                    domain, weights, n = d, before[i, 1:], int(before[i, 0])
                if y[i] == y[i]:
                    weights, _ = step(weights, x[i], y[i])
                    n += 1
        if n:
            out.append((domain, n, *weights))
        yield pd.DataFrame(out, columns=["domain", "events", *FACTORS])

    rows = _dealt(events, alias_domains)
    if start is None:
        rows = rows.select("*", F.lit(0).alias("b_events"), *[F.lit(1.0).alias(f"b_{k}") for k in FACTORS])
    else:
        #: A row without feedback brings each known domain in, ahead of its events.
        known = start.select("domain", F.lit(None).cast("long").alias("seq"), F.lit(None).cast("double").alias("feedback"), *[F.lit(0.0).alias(k) for k in FACTORS], F.col("events").alias("b_events"), *[F.col(k).alias(f"b_{k}") for k in FACTORS])
        rows = rows.select("*", F.lit(0).cast("long").alias("b_events"), *[F.lit(1.0).alias(f"b_{k}") for k in FACTORS])
        rows = rows.unionByName(known).repartition("domain").sortWithinPartitions("domain", F.asc_nulls_first("seq"))
    return rows.mapInPandas(run, "domain string, events long, " + ", ".join(f"{k} double" for k in FACTORS))


def saved_weights(weights: DataFrame, path: str) -> None:
    """(domain, events, the six) as JSON; the history itself isn't kept, only its length."""
    weights.write.mode("overwrite").json(path)


def loaded_weights(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("domain string, events long, " + ", ".join(f"{k} double" for k in FACTORS)).json(path)


def effective(factors: DataFrame, base: dict[str, float] | None = None) -> DataFrame:
    """Base weights times the adjustments of each domain."""
    own = dict.fromkeys(FACTORS, 1.0) | (base or {})
    return factors.select("domain", "events", *[(F.lit(own[k]) * F.col(k)).alias(k) for k in FACTORS])


def learner_report(factors: DataFrame, log: DataFrame, base: dict[str, float] | None = None, last: int = 20, reviewed: int = 100) -> DataFrame:
    """A row for each domain: base, adjustment and effective weights, numbers of events and logged changes, the last entries of the
    log, and how many of the last ``reviewed`` need a review."""
    own = dict.fromkeys(FACTORS, 1.0) | (base or {})
    order = Window.partitionBy("domain").orderBy(F.desc("seq"), "feature")
    entry = F.concat_ws(":", F.col("seq").cast("string"), "feature")
    recent = log.withColumn("r", F.row_number().over(order))
    logs = recent.groupBy("domain").agg(
        F.count("*").alias("changes"), F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("r") <= last, F.struct("r", entry.alias("e"))))), lambda x: x["e"]), ",").alias("last_changes"), F.count_if((F.col("r") <= reviewed) & F.col("requires_review")).alias("pending")
    )
    sets = [c for k in FACTORS for c in (F.lit(own[k]).alias(f"base_{k}"), F.col(k).alias(f"adjustment_{k}"), (F.lit(own[k]) * F.col(k)).alias(f"effective_{k}"))]
    rows = factors.join(logs, "domain", "left")
    return rows.select("domain", "events", *sets, F.coalesce("changes", F.lit(0)).alias("changes"), F.coalesce("last_changes", F.lit("")).alias("last_changes"), F.coalesce("pending", F.lit(0)).alias("pending"))


def careful_weights(events: DataFrame, log: bool = False) -> DataFrame:
    """Semi-adaptive adjustments of one general set: (domain, events, the six factors), or the log of changes above 1 %.

    Each domain has a set of its own here, and counts its own events up to the warm-up.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        domain, factors, n = None, np.ones(len(FACTORS)), 0
        out = []
        for pdf in batches:
            x, y = pdf[list(FACTORS)].to_numpy(float), pdf["feedback"].to_numpy(float)
            for i, (d, seq) in enumerate(zip(pdf["domain"], pdf["seq"], strict=True)):
                if d != domain:
                    if n and not log:
                        out.append((domain, n, *factors))
                    domain, factors, n = d, np.ones(len(FACTORS)), 0
                n += 1
                factors, changes = careful_step(factors, n, x[i], y[i])
                if log:
                    out += [(d, seq, FACTORS[c[0]], *c[1:]) for c in changes]
            if log:
                yield pd.DataFrame(out, columns=["domain", "seq", "feature", "old_value", "new_value", "change", "requires_review"])
                out = []
        if n and not log:
            out.append((domain, n, *factors))
        if not log:
            yield pd.DataFrame(out, columns=["domain", "events", *FACTORS])

    kept = "domain string, seq long, feature string, old_value double, new_value double, change double, requires_review boolean" if log else "domain string, events long, " + ", ".join(f"{k} double" for k in FACTORS)
    return _dealt(events, False).mapInPandas(run, kept)


def pending_reviews(log: DataFrame, last: int = 100) -> DataFrame:
    """Of the last entries those that need a review."""
    return log.orderBy(F.desc("seq"), "feature").limit(last).filter("requires_review")


def rolled_back(weights: DataFrame, rejected: DataFrame) -> DataFrame:
    """Old values of rejected changes (domain, feature, old_value, seq) put back; of several the earliest counts."""
    old = rejected.groupBy("domain").pivot("feature", list(FACTORS)).agg(F.min_by("old_value", "seq"))
    old = old.select("domain", *[F.col(k).alias(f"old_{k}") for k in FACTORS])
    return weights.join(old, "domain", "left").select("domain", "events", *[F.coalesce(f"old_{k}", k).alias(k) for k in FACTORS])
