"""Events out of order, twice, and over restarts give the weights of the batch."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from sieveline.functions.scoring import FACTORS
from sieveline.operators.learn import adaptive_weights
from sieveline.streaming.ordered import latest_weights, run_ordered

SCHEMA = "ts timestamp, domain string, seq long, feedback double, " + ", ".join(f"{k} double" for k in FACTORS)


def test_out_of_order_twice_and_restarted(spark, tmp_path):
    rng = np.random.default_rng(5)
    rows = [(60 * (i + 1), ["a", "b", None][i % 3] if i % 7 else "a", i, float(rng.random()), *rng.random(6).tolist()) for i in range(90)]
    cols = ["secs", "domain", "seq", "feedback", *FACTORS]
    #: Up to fifteen minutes of disorder, and what has been seen comes again in every batch after the first.
    arrival = sorted(rows, key=lambda r: r[0] + float(rng.integers(0, 900)))
    parts = [arrival[:30], arrival[30:60] + arrival[:5], arrival[60:] + arrival[55:60] * 2, [(10**6, "a", 10**6, None, *[0.0] * 6)]]

    def stream():
        return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))

    for i, part in enumerate(parts):  # a query of its own for each file: every one is a restart
        df = spark.createDataFrame(part, "secs long, domain string, seq long, feedback double, " + ", ".join(f"{k} double" for k in FACTORS))
        df.select(F.timestamp_seconds("secs").alias("ts"), *cols[1:]).coalesce(1).write.parquet(str(tmp_path / f"in/p{i}"))
        q = run_ordered(stream(), str(tmp_path / "out"), str(tmp_path / "state"), late="30 minutes")
        assert q.awaitTermination(120)
    key = lambda r: (r.domain or "", r.events)
    got = sorted(latest_weights(spark, str(tmp_path / "out")).collect(), key=key)
    batch = adaptive_weights(spark.createDataFrame(rows, "secs long, domain string, seq long, feedback double, " + ", ".join(f"{k} double" for k in FACTORS)))
    want = sorted(batch.collect(), key=key)
    assert [(r.domain, r.events) for r in got] == [(r.domain, r.events) for r in want] and sum(r.events for r in got) == 90
    for a, b in zip(got, want, strict=True):
        assert np.allclose([a[k] for k in FACTORS], [b[k] for k in FACTORS], atol=0, rtol=0)
