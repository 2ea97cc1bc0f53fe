"""Connected components of a graph given by its edges, on Spark, without a vertex list on the driver.

Every edge is kept as (hi, lo), hi > lo. A round looks at each vertex from above only: its smallest lower neighbour becomes its
parent, and its other lower neighbours are joined to that one (union by minimum). Lower ends are then replaced by their own
parents, which halves paths. What has one lower neighbour for every vertex and that neighbour has none is a forest of depth
one: the result. Rounds go on until it is reached, which takes about the logarithm of the longest path. Minima are combined
before they are shuffled, whatever the degree of a vertex; the lookups are joins, which Spark splits when a key is hot. A graph of
``SMALL`` edges or fewer is one partition, which spares its many short rounds the shuffles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, written

SMALL = 100_000


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(id, component) for every vertex that has an edge to another one; component is the smallest id reachable."""
    now = written(edges.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).filter("hi <> lo").distinct(), "edges")
    few = now.count() <= SMALL
    while True:
        written_now, now = now, now.coalesce(1) if few else now
        low = now.groupBy("hi").agg(F.min("lo").alias("m"))
        pairs = now.join(low, "hi").select(F.explode(F.array(F.struct("hi", F.col("m").alias("lo")), F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo")))).alias("e")).select("e.hi", "e.lo").filter("hi <> lo").distinct()
        #: Both uses of the pairs read one exchange.
        parents = pairs.groupBy("hi").agg(F.min("lo").alias("up")).select(F.col("hi").alias("lo"), "up")
        jumped = pairs.join(parents, "lo", "left").select("hi", F.coalesce("up", "lo").alias("lo"), F.col("up").isNotNull().alias("moved"))
        nxt = written(jumped.groupBy("hi", "lo").agg(F.max("moved").alias("moved")), "edges")
        forget(written_now)
        now = nxt.coalesce(1) if few else nxt
        state = now.groupBy("hi").agg(F.count("*").alias("n"), F.max("moved").alias("moved")).agg(F.max("n").alias("n"), F.max("moved").alias("moved")).first()
        now = nxt
        if not state.moved and (state.n or 1) == 1:
            return now.select(F.col("hi").alias("id"), F.col("lo").alias("component")).unionByName(now.select(F.col("lo").alias("id"), F.col("lo").alias("component")).distinct())
