"""From conversations to labelled pairs of query and memory."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import any_of, stripped
from .evaluate import numbered


def user_queries(turns: DataFrame, skip: tuple[str, ...] = ("<", "System:")) -> DataFrame:
    """User turns with text that no tool wrote."""
    starts = F.lit(False)
    for p in skip:
        starts = starts | F.startswith(F.col("text"), F.lit(p))
    return turns.filter((F.col("role") == "user") & (F.col("text") != "") & ~starts)


def query_memory_pairs(turns: DataFrame, trigger: Column | None = None, look_back: int = 4, paragraphs: int = 10, most: int = 5) -> DataFrame:
    """(conv_id, turn, query, place, memory): paragraphs of the last reply before a query that speaks of memories.

    The reply is looked for in the turns before, not further back than ``look_back`` and never in the first turn.
    """
    said = F.when((F.col("role") == "assistant") & (F.col("turn") >= 1), F.struct("text"))
    back = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(-look_back, -1)
    asked = user_queries(turns.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text")).withColumn("reply", F.last(said, ignorenulls=True).over(back)["text"]))
    trigger = trigger if trigger is not None else F.contains(F.col("reply"), F.lit("记忆")) | F.contains(F.lower("reply"), F.lit("memory"))
    lines = F.slice(F.split("reply", "\n"), 1, paragraphs)
    good = F.slice(F.filter(lines, lambda p: (F.char_length(p) > 30) & (F.char_length(p) < 300)), 1, most)
    rows = asked.filter(F.col("reply").isNotNull() & trigger).select("conv_id", "turn", F.substr("text", F.lit(1), F.lit(200)).alias("query"), F.posexplode(good).alias("place", "memory"))
    return rows.withColumn("memory", stripped(F.col("memory")))


def label_tasks(pairs: DataFrame) -> DataFrame:
    """Pairs with sequential ids, in order of conversation, turn and place."""
    rows = numbered(pairs, F.col("conv_id"), F.col("turn"), F.col("place"))
    return rows.withColumn("task_id", F.concat(F.lit("task_"), F.col("position").cast("string"))).drop("position").withColumn("label", F.lit(None).cast("int"))


def keywords(text: Column, words: list[str]) -> Column:
    """Of the words those that occur, in any case."""
    low = F.lower(text)
    return F.array_compact(F.array(*[F.when(F.contains(low, F.lit(w.lower())), F.lit(w)) for w in dict.fromkeys(words)]))


def auto_label(pairs: DataFrame, words: list[str]) -> DataFrame:
    """1 with high confidence where query and memory share a keyword, else 0 with low confidence."""
    shared = F.array_intersect(keywords(F.col("query"), words), keywords(F.col("memory"), words))
    hit = F.size("shared") > 0
    return pairs.withColumn("shared", shared).withColumn("auto_label", hit.cast("int")).withColumn("confidence", F.when(hit, "high").otherwise("low"))


def topics(text: Column, words: dict[str, list[str]]) -> Column:
    """Topics one of whose words occurs, in any case."""
    low = F.lower(text)
    return F.array_compact(F.array(*[F.when(any_of(low, [w.lower() for w in ws]), F.lit(topic)) for topic, ws in words.items()]))


def topic_label(pairs: DataFrame, words: dict[str, list[str]]) -> DataFrame:
    """1 where query and memory share a topic."""
    shared = F.array_intersect(topics(F.col("query"), words), topics(F.col("memory"), words))
    return pairs.withColumn("common", shared).withColumn("topic_label", (F.size("common") > 0).cast("int"))


def merged_labels(auto: DataFrame, manual: DataFrame, key: str = "task_id") -> DataFrame:
    """Sure automatic labels and all manual ones, which override; unsure rows that nobody saw are dropped."""
    both = auto.join(manual.select(key, "manual_label"), key, "left")
    label = F.coalesce("manual_label", F.when(F.col("confidence") == "high", F.col("auto_label")))
    return both.withColumn("label", label).filter(F.col("label").isNotNull())


def label_counts(labelled: DataFrame) -> DataFrame:
    return labelled.filter(F.col("label").isNotNull()).groupBy("label").agg(F.count("*").alias("n"))


def batch_applied(tasks: DataFrame, answers: str, first: int) -> DataFrame:
    """A string of 0 and 1 as the labels of tasks from position ``first`` on (tasks: position, label)."""
    at = F.col("position") - first
    mine = (at >= 0) & (at < len(answers))
    return tasks.withColumn("label", F.when(mine, F.substr(F.lit(answers), (at + 1).cast("int"), F.lit(1)).cast("int")).otherwise(F.col("label")))
