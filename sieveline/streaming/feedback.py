"""Feedback as a stream: the plain learner with a state for each domain, and windowed counts."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.scoring import FACTORS
from ..operators.learn import step

_STATE = "events long, " + ", ".join(f"{k} double" for k in FACTORS)


def _folded(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    n, *weights = state.get if state.exists else (0, *[1.0] * len(FACTORS))
    w = np.array(weights)
    rows: list[Any] = [pdf for pdf in batches if len(pdf)]
    if rows:
        for r in pd.concat(rows).sort_values("seq").itertuples():
            w, _ = step(w, np.array([getattr(r, k) for k in FACTORS], float), float(r.feedback))
            n += 1
    state.update((n, *w.tolist()))
    yield pd.DataFrame([(key[0], n, *w)], columns=["domain", "events", *FACTORS])


def streaming_weights(events: DataFrame) -> DataFrame:
    """The weights of each domain after each micro-batch. Within a batch events go by seq; across batches by arrival."""
    return events.groupBy("domain").applyInPandasWithState(_folded, "domain string, " + _STATE, _STATE, "update", GroupStateTimeout.NoTimeout)


def feedback_windows(events: DataFrame, late: str = "10 minutes", width: str = "5 minutes", slide: str | None = None) -> DataFrame:
    """Counts and means of feedback (ts, domain, feedback) in windows; later events than ``late`` are dropped."""
    span = F.window("ts", width, slide) if slide else F.window("ts", width)
    out = events.withWatermark("ts", late).groupBy(span.alias("w"), "domain").agg(F.count("*").alias("events"), F.avg("feedback").alias("feedback"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "domain", "events", "feedback")
