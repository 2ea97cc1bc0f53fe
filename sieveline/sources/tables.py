"""Readers and writers: tables, JSON lines, JSON arrays, sessions, reports, the embedding cache."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Missing keys become these values, not null.
MEMORY = T.StructType([T.StructField(k, T.StringType()) for k in ("id", "content", "text", "type", "timestamp")] + [T.StructField("metadata", T.MapType(T.StringType(), T.StringType())), T.StructField("quality_score", T.DoubleType())])
QUERY = T.StructType([T.StructField(k, T.StringType()) for k in ("id", "query", "type", "target_memory_id", "target_memory_content")] + [T.StructField("expected_keywords", T.ArrayType(T.StringType())), T.StructField("relevant_ids", T.ArrayType(T.StringType()))])
SESSION = T.StructType([T.StructField("type", T.StringType()), T.StructField("message", T.StructType([T.StructField("role", T.StringType()), T.StructField("content", T.ArrayType(T.StructType([T.StructField("text", T.StringType())])))]))])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """A table that comes in fewer pieces than there are cores, dealt by its keys: one row group is one task otherwise. Larger tables stay as they come."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores, *keys) if rows.rdd.getNumPartitions() < cores else rows


def dealt(left: DataFrame, right: DataFrame, groups: int, *keys: str) -> tuple[DataFrame, DataFrame]:
    """Both sides of groups that meet by their keys. Where there are more groups than shuffle partitions, these are two for a group, so that a
    task holds a few groups however many there are; else Spark deals them as it is set."""
    if groups <= int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        return left, right
    return left.repartition(2 * groups, *keys), right.repartition(2 * groups, *keys)


def read_json(spark: SparkSession, path: str | list[str], schema: T.StructType, array: bool = False) -> DataFrame:
    """JSON lines, or files that are one array each; a bad line ends the job."""
    return spark.read.schema(schema).option("mode", "FAILFAST").option("multiLine", array).json(path)


def memories(rows: DataFrame) -> DataFrame:
    """Rows of MEMORY with the defaults of missing keys; content comes before text."""
    text = F.coalesce(F.nullif("content", F.lit("")), F.col("text"), F.lit(""))
    empty = F.create_map().cast("map<string,string>")
    return rows.select("id", text.alias("content"), F.coalesce("type", F.lit("unknown")).alias("type"), F.coalesce("timestamp", F.lit("")).alias("timestamp"), F.coalesce("metadata", empty).alias("metadata"), F.coalesce("quality_score", F.lit(0.5)).alias("quality_score"))


def qrels(queries: DataFrame) -> DataFrame:
    """(query_id, doc_id) from queries with one target or with several relevant ids."""
    ids = F.concat(F.coalesce("relevant_ids", F.array().cast("array<string>")), F.array_compact(F.array("target_memory_id")))
    return queries.select(F.col("id").alias("query_id"), F.explode(F.array_distinct(ids)).alias("doc_id"))


def read_sessions(spark: SparkSession, path: str, newest: int = 50, more_than: int = 10) -> DataFrame:
    """(file, turn, role, text) of the newest session files with enough messages; bad lines are skipped.

    The newest files are taken first and names of deleted, reset or locked ones dropped after that. Turns number the
    messages of a file, whose lines are read in order.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "modificationTime").orderBy(F.desc("modificationTime"), "path").limit(newest)
    names = [r.path for r in files.collect() if not any(x in r.path.rsplit("/", 1)[-1] for x in (".deleted", ".reset", ".lock"))]
    lines = spark.read.text(names, wholetext=True) if names else spark.createDataFrame([], "value string")
    lines = lines.select(F.col("_metadata.file_path").alias("file"), F.posexplode(F.split("value", "\n")).alias("line", "value")) if names else lines.select(F.lit("").alias("file"), F.lit(0).alias("line"), "value")
    each = lines.withColumn("j", F.from_json("value", SESSION)).filter(F.col("j.type") == "message")
    each = each.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("line", "j"))).alias("m")).filter(F.size("m") > more_than)
    turns = each.select("file", F.posexplode("m").alias("turn", "m"))
    return turns.select("file", "turn", F.col("m.j.message.role").alias("role"), F.coalesce(F.get("m.j.message.content", F.lit(0))["text"], F.lit("")).alias("text"))


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def write_report(report: DataFrame, path: str) -> None:
    """A one-row report as a file of its own."""
    report.limit(1).coalesce(1).write.mode("overwrite").json(path)


def write_vectors(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Vector tables are Parquet: create or replace by overwrite, add by append."""
    if mode not in ("overwrite", "append"):
        raise ValueError(f"mode is overwrite or append, not {mode}")
    rows.write.mode(mode).parquet(path)


def create_vectors(spark: SparkSession, path: str, schema: str = "id long, embedding array<float>") -> bool:
    """An empty vector table unless there is one; whether it was made."""
    if _exists(spark, path):
        return False
    spark.createDataFrame([], schema).write.parquet(path)
    return True


def drop_vectors(spark: SparkSession, path: str) -> bool:
    """Deletes a vector table; whether there was one."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True))


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at))


def save_cache(cache: DataFrame, path: str) -> None:
    """The embedding cache (key, embedding, cached_at) as a Parquet table."""
    cache.select("key", "embedding", "cached_at").write.mode("overwrite").parquet(path)


def load_cache(spark: SparkSession, path: str) -> DataFrame:
    """What ``save_cache`` left, or an empty cache."""
    schema = "key string, embedding array<float>, cached_at timestamp"
    return spark.read.schema(schema).parquet(path) if _exists(spark, path) else spark.createDataFrame([], schema)


def write_scored(rows: DataFrame, score: Column, path: str) -> None:
    """Rows with their quality_score as JSON lines."""
    rows.withColumn("quality_score", score).write.mode("overwrite").json(path)


def convert_scales(spark: SparkSession, source: str, target: str, scales: tuple[str, ...], array: bool = True) -> DataFrame:
    """Converts source/<scale>/memories.json (an array each, or JSON lines) to JSON lines in target/<scale>; (scale, memories) of what
    was there.

    Missing files are skipped. The counts are also written, as target/stats.
    """
    counts = []
    for scale in scales:
        if _exists(spark, f"{source}/{scale}/memories.json"):
            converted(read_json(spark, f"{source}/{scale}/memories.json", MEMORY, array), scale).write.mode("overwrite").json(f"{target}/{scale}")
            counts.append((scale, spark.read.schema("id string").json(f"{target}/{scale}").count()))
    stats = spark.createDataFrame(counts, "scale string, memories long")
    stats.coalesce(1).write.mode("overwrite").json(f"{target}/stats")
    return stats


def without(rows: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """Rows whose key isn't among the deleted ones."""
    return rows.join(ids.select(key).distinct(), key, "left_anti")


def converted(rows: DataFrame, scale: str) -> DataFrame:
    """Memories of one scale as a dataset: content renamed to text."""
    m = memories(rows)
    return m.select("id", F.col("content").alias("text"), "type", "timestamp", "metadata", F.lit(scale).alias("scale"))
