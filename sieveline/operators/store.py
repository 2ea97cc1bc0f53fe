"""The store of memories: upserts, access, cache, statistics, directories, logs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scoring import quality_band
from ..functions.text import layered, token_estimate


def latest(rows: DataFrame, key: str, seq: str) -> DataFrame:
    """The last row of each key; of equal sequences any one, as they are the same write."""
    cols = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*cols), seq).alias("r")).select(key, *[F.col("r")[c].alias(c) for c in cols])


def upserted(store: DataFrame, new: DataFrame, key: str, seq: str) -> DataFrame:
    return latest(store.unionByName(new), key, seq)


def with_vectors(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    """What a batch insert keeps: rows whose embedding succeeded."""
    return rows.filter(F.col(vector).isNotNull())


def accessed(store: DataFrame, reads: DataFrame, key: str = "id") -> DataFrame:
    """store with access_count and updated_at from a log of reads (id, ts)."""
    seen = reads.groupBy(key).agg(F.count("*").alias("__n"), F.max("ts").alias("__ts"))
    return store.join(seen, key, "left").withColumn("access_count", F.coalesce("__n", F.lit(0))).withColumn("updated_at", F.col("__ts")).drop("__n", "__ts")


def cache_kept(cache: DataFrame, now: Column, ttl_seconds: int, most: int, key: str = "key", at: str = "cached_at") -> DataFrame:
    """Entries younger than the lifetime, and of these the newest ``most``; reading an entry doesn't refresh it."""
    fresh = cache.filter(F.unix_timestamp(now) - F.unix_timestamp(F.col(at)) < ttl_seconds)
    return fresh.orderBy(F.desc(at), key).limit(most)


def compressed(rows: DataFrame, text: str = "content", flag: str = "compressed") -> DataFrame:
    """Layers cut from the whole text where that wasn't done before; done says whether it was now."""
    cut = lambda n: F.substr(F.col(text), F.lit(1), F.lit(n))
    return rows.withColumn("done", ~F.col(flag)).withColumn("l0", F.when(F.col("done"), cut(400)).otherwise(F.col("l0"))).withColumn("l1", F.when(F.col("done"), cut(8000)).otherwise(F.col("l1"))).withColumn(flag, F.lit(True))


def store_stats(rows: DataFrame, text: str = "content", quality: str | None = None, of_all: bool = False) -> DataFrame:
    """One row: token estimates of the layers and what the upper ones save, of the whole text or (``of_all``) of all layers."""
    parts = layered(F.col(text))
    sums = [F.sum(token_estimate(c)).alias(f"{k}_tokens") for k, c in parts.items()]
    more = [] if quality is None else [F.avg(quality).alias("avg_quality"), F.count_if(quality_band(F.col(quality)) == "high").alias("high_quality"), F.count_if(quality_band(F.col(quality)) == "low").alias("low_quality")]
    out = rows.agg(F.count("*").alias("total_memories"), *sums, *more)
    whole = F.col("l0_tokens") + F.col("l1_tokens") + F.col("l2_tokens") if of_all else F.col("l2_tokens")
    saves = [(F.coalesce(1 - F.try_divide(F.col(f"{k}_tokens"), whole), F.lit(0.0))).alias(f"{k}_savings") for k in ("l0", "l1")]
    return out.select("*", *saves, whole.alias("total_tokens"))


def cleaned(rows: DataFrame, quality: str, least: float = 0.4) -> DataFrame:
    """What stays when rows of low quality are deleted."""
    return rows.filter(F.col(quality) >= least)


def retention(rows: DataFrame, quality: str, threshold: float = 0.5) -> DataFrame:
    """One row: rows, rows at or above the threshold (missing counts as 0), and their share."""
    kept = F.count_if(F.coalesce(F.col(quality), F.lit(0.0)) >= threshold)
    return rows.agg(F.count("*").alias("total"), kept.alias("retained")).withColumn("rate", F.coalesce(F.try_divide("retained", "total"), F.lit(0.0)))


def top_counts(rows: DataFrame, column: str, n: int) -> DataFrame:
    """The most frequent values and their share, of all rows; ties by value."""
    total = rows.count()
    return rows.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value").limit(n).withColumn("share", F.col("n") / F.lit(max(total, 1)))


def placed(rows: DataFrame, category: str = "category", custom: str | None = None) -> DataFrame:
    """Adds path: a given one, else /agent/ and the category."""
    own = F.concat(F.lit("/agent/"), F.col(category))
    return rows.withColumn("path", F.coalesce(F.nullif(F.col(custom), F.lit("")), own) if custom else own)


def directories(paths: DataFrame, standard: tuple[str, ...] = ()) -> DataFrame:
    """(path, parent, name) of every directory on the way to the given paths; the root is the empty path."""
    rows = paths.select("path").distinct()
    if standard:
        rows = rows.unionByName(paths.sparkSession.createDataFrame([(p,) for p in standard], "path string")).distinct()
    parts = F.filter(F.split(F.col("path"), "/"), lambda p: p != "")
    steps = rows.select(parts.alias("parts")).filter(F.size("parts") > 0).select(F.explode(F.transform(F.sequence(F.lit(1), F.size("parts")), lambda i: F.slice("parts", 1, i))).alias("p"))
    join = lambda a: F.when(F.size(a) == 0, F.lit("")).otherwise(F.concat(F.lit("/"), F.array_join(a, "/")))
    return steps.select(join(F.col("p")).alias("path"), join(F.slice("p", 1, F.size("p") - 1)).alias("parent"), F.element_at("p", -1).alias("name")).distinct()


def listing(dirs: DataFrame, members: DataFrame) -> DataFrame:
    """(path, children, memories): how many directories and memories stand directly in each directory."""
    kids = dirs.groupBy(F.col("parent").alias("path")).agg(F.count("*").alias("children"))
    own = members.groupBy("path").agg(F.count("*").alias("memories"))
    out = dirs.select("path").join(kids, "path", "left").join(own, "path", "left")
    return out.select("path", F.coalesce("children", F.lit(0)).alias("children"), F.coalesce("memories", F.lit(0)).alias("memories"))


def stage_counts(stages: dict[str, DataFrame]) -> DataFrame:
    """(query_id, step, stage, rows): what a search kept after each stage, for its log."""
    rows = [df.groupBy("query_id").agg(F.count("*").alias("rows")).select("query_id", F.lit(i).alias("step"), F.lit(name).alias("stage"), "rows") for i, (name, df) in enumerate(stages.items(), 1)]
    return reduce(DataFrame.unionByName, rows)


def last_entries(log: DataFrame, n: int, by: str | None = None, seq: str = "seq") -> DataFrame:
    """The last n entries, of each key where one is given."""
    if by is None:
        return log.orderBy(F.desc(seq)).limit(n)
    return log.withColumn("__r", F.row_number().over(Window.partitionBy(by).orderBy(F.desc(seq)))).filter(F.col("__r") <= n).drop("__r")
