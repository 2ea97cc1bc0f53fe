"""Helpers that the operators of this folder share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from tempfile import gettempdir

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Only a local master, as in tests, has a default."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = f"{gettempdir()}/sieveline-checkpoints"
    return path.rstrip("/")


def folder(spark: SparkSession, what: str, made: bool = False) -> str:
    """The path of a new folder in the shared one; if ``made``, it is there, and goes when the application ends."""
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}-{what}-{uuid.uuid4().hex}"
    if made:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        files = at.getFileSystem(spark._jsc.hadoopConfiguration())
        files.mkdirs(at)
        files.deleteOnExit(at)
    return path


def written(df: DataFrame, what: str, by: str | None = None, codec: str | None = None) -> DataFrame:
    """``df`` as a table in the shared folder, read back: lineage ends there, and lost executors cost nothing.

    The table goes when the application ends, or before with ``forget``. by: a column whose values get folders of their own.
    """
    spark = df.sparkSession
    path = folder(spark, what)
    (df.write.partitionBy(by) if by else df.write).parquet(path, compression=codec)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def tidied(df: DataFrame, what: str, by: str | None = None, codec: str | None = None) -> DataFrame:
    """``written``, and the files that this shuffled go at once, not when the driver happens to collect its garbage."""
    key, conf = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", df.sparkSession.conf
    before = conf.get(key, "false")
    conf.set(key, "true")
    try:
        return written(df, what, by, codec)
    finally:
        conf.set(key, before)


def forget(*tables: DataFrame, part: str = "") -> None:
    """Deletes written tables, or a part of them (column=value), that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        at = spark._jvm.org.apache.hadoop.fs.Path(f"{df.written_to}/{part}" if part else df.written_to)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z only. ``lower`` does the same for pure ASCII, and much faster than ``translate``."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, UPPER.lower()))


def drop_names(df: DataFrame, *names: str) -> DataFrame:
    """Without the given columns, matched as Spark does (case does not count)."""
    low = {n.lower() for n in names}
    return df.select([F.col(f"`{c}`") for c in df.columns if c.lower() not in low])


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores as it takes to differ from every column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def grouped(batches: Iterator[pa.RecordBatch], *keys: str) -> Iterator[pa.Table]:
    """Runs of whole groups from rows that are sorted by the keys: what is held is a batch and the group it breaks off in."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        last = [batch.column(batch.schema.names.index(k))[batch.num_rows - 1].as_py() for k in keys]
        same = np.ones(batch.num_rows, bool)
        for k, v in zip(keys, last, strict=True):
            column = batch.column(batch.schema.names.index(k))
            same &= pc.equal(column, pa.scalar(v, column.type)).to_numpy(zero_copy_only=False)
        cut = batch.num_rows - int(same.sum())  # sorted: the rows of the last group stand at the end
        if cut or (held and [held[-1].column(held[-1].schema.names.index(k))[held[-1].num_rows - 1].as_py() for k in keys] != last):
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = []
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held)


def group_bounds(*columns: np.ndarray) -> np.ndarray:
    """Where groups of equal neighbouring rows begin, and the number of rows at the end."""
    n = len(columns[0])
    new = np.zeros(n, bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.append(np.flatnonzero(new), n)


def in_ranges(df: DataFrame, *keys: str) -> DataFrame:
    """Dealt by sampled ranges of the keys and sorted: a key with many rows is cut where the later keys differ.

    ``df`` should be cheap to read twice (a written table): Spark samples it first.
    """
    return df.repartitionByRange(shuffle_partitions(df.sparkSession), *keys).sortWithinPartitions(*keys)
