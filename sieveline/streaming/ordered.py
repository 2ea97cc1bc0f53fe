"""The plain learner over a stream that arrives out of order: the weights of the batch, whatever the order of arrival.

Events wait in a list per domain until the watermark has passed them, then they are folded in the order of (ts, seq). A task
holds the events of a domain that are still waiting, which the allowed lateness bounds, never its history.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions.scoring import FACTORS
from ..operators.learn import step

_SIX = ", ".join(f"{k} double" for k in FACTORS)
_EVENT = f"at long, seq long, feedback double, {_SIX}"
_MODEL = f"at long, seq long, events long, {_SIX}"
_RESULT = f"domain string, events long, {_SIX}"
#: State with lists and timers is kept by this provider only.
PROVIDER = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class OrderedLearner(StatefulProcessor):
    """Two states a domain: the events that wait, and the weights with the place (at, seq) of the last event in them."""

    def __init__(self, every: int) -> None:
        self.every = every  # milliseconds between two timers

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", _EVENT)
        self.model = handle.getValueState("model", _MODEL)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        last = tuple(self.model.get()[:2]) if self.model.exists() else None
        timers: set[int] = set()
        for pdf in rows:
            got = pdf[pdf["feedback"].notna()]
            #: What has been folded isn't folded again, so an event that comes twice changes nothing.
            new = [(int(r.at), int(r.seq), float(r.feedback), *(float(getattr(r, k)) for k in FACTORS)) for r in got.itertuples() if last is None or (r.at, r.seq) > last]
            if new:
                self.waiting.appendList(new)
                timers |= {(r[0] // self.every + 1) * self.every for r in new}
        for t in timers:
            self.handle.registerTimer(t)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        passed = timerValues.getCurrentWatermarkInMs()
        waiting = [tuple(r) for r in self.waiting.get()] if self.waiting.exists() else []
        due = sorted({r[:2]: r for r in waiting if r[0] <= passed}.items())
        if not due:
            return
        at, seq, n, *weights = self.model.get() if self.model.exists() else (0, 0, 0, *[1.0] * len(FACTORS))
        w = np.array(weights, float)
        for (at, seq), r in due:
            w, _ = step(w, np.array(r[3:], float), r[2])
            n += 1
        rest = [r for r in waiting if r[0] > passed]
        if rest:
            self.waiting.put(rest)
        else:
            self.waiting.clear()
        self.model.update((at, seq, n, *w.tolist()))
        yield pd.DataFrame([(key[0], n, *w)], columns=["domain", "events", *FACTORS])

    def close(self) -> None:
        pass


def ordered_weights(events: DataFrame, late: str = "10 minutes", every_ms: int = 60_000) -> DataFrame:
    """(domain, events, the six weights), a row whenever the watermark has let further events of a domain into its weights.

    events: a stream of (ts, domain, seq, feedback, the six features); (ts, seq) is an event's place in its domain, and says which it is: of two
    events with the same place one counts. Events arriving more than ``late`` behind the newest ts are dropped, and so are
    those up to the epoch, where Spark's watermark starts. An event with a
    null feedback teaches nothing but moves the watermark, so a source can let out what waits; one with a null ts is left out.
    A null domain is a domain of its own. The query has to run with the state provider that ``PROVIDER`` names; see ``run_ordered``.
    """
    rows = events.filter(F.col("ts").isNotNull()).withWatermark("ts", late)
    rows = rows.select("ts", "domain", "seq", "feedback", *FACTORS, F.unix_millis("ts").alias("at"))
    return rows.groupBy("domain").transformWithStateInPandas(OrderedLearner(every_ms), _RESULT, "Append", "EventTime")


def run_ordered(events: DataFrame, out: str, checkpoint: str, late: str = "10 minutes", every_ms: int = 60_000) -> StreamingQuery:
    """Starts ``ordered_weights`` over all that is there now, into Parquet files at ``out``; started again, it goes on from ``checkpoint``."""
    spark = events.sparkSession
    before = spark.conf.get(PROVIDER[0], None)
    spark.conf.set(*PROVIDER)
    try:
        return ordered_weights(events, late, every_ms).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    finally:
        if before is None:
            spark.conf.unset(PROVIDER[0])
        else:
            spark.conf.set(PROVIDER[0], before)


def latest_weights(spark: SparkSession, out: str) -> DataFrame:
    """The last weights of each domain in the files that ``run_ordered`` has written."""
    rows = spark.read.schema(_RESULT).parquet(out)
    best = rows.groupBy("domain").agg(F.max_by(F.struct("events", *FACTORS), "events").alias("r"))
    return best.select("domain", "r.*")
