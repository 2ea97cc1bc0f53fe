"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it are context, and the loss covers its reply alone. A
conversation that doesn't end with an assistant turn gets one more example without a target, so that no turn is lost.

A turn is written as ``### role:`` newline text ``</turn>`` newline. Inside roles and texts ``&``, ``<``, ``#``, ``:`` (roles
only) and newlines (roles only) are written as named references, so control strings can't occur in them; reading
undoes that exactly. An example holds its whole context, so a conversation has to fit into one row.

Defined cases: null text and null role are empty; null turns come first; rows with equal turns are ordered by role and text;
repeated rows are turns of their own; rows with a null conversation form one conversation; an empty table gives no rows;
extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_END = "</turn>\n"


def escape(c: Column, role: bool = False) -> Column:
    pairs = [("&", "&amp;"), ("<", "&lt;"), ("#", "&num;")] + ([(":", "&colon;"), ("\n", "&nl;")] if role else [])
    for raw, name in pairs:
        c = F.replace(c, F.lit(raw), F.lit(name))
    return c


def unescape(c: Column) -> Column:
    for raw, name in (("\n", "&nl;"), (":", "&colon;"), ("#", "&num;"), ("<", "&lt;"), ("&", "&amp;")):
        c = F.replace(c, F.lit(name), F.lit(raw))
    return c


def chat_examples(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, example, text, loss_start, loss_end): the loss covers code points loss_start up to loss_end."""
    role, text = F.coalesce(F.col(role_col), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    head = F.concat(F.lit("### "), escape(role, True), F.lit(":\n"))
    rows = turns.select(
        F.col(conv_col).alias("conv_id"),
        F.struct(F.col(turn_col).alias("turn"), role.alias("role"), text.alias("text"), (role == "assistant").alias("target"), F.char_length(head).alias("skip"), F.concat(head, escape(text), F.lit(_END)).alias("part")).alias("t"),
    )
    convs = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    convs = convs.withColumn("at", F.expr("filter(sequence(0, size(ts) - 1), i -> ts[i].target or i = size(ts) - 1)"))
    each = convs.select("conv_id", "ts", F.posexplode("at").alias("example", "i"))
    each = each.select(
        "conv_id",
        "example",
        F.expr("array_join(transform(slice(ts, 1, i + 1), x -> x.part), '')").alias("text"),
        F.expr("ts[i].target").alias("target"),
        F.expr("char_length(ts[i].part) - ts[i].skip").alias("tail"),
    )
    size = F.char_length("text")
    start = F.when(F.col("target"), size - F.col("tail")).otherwise(size)
    end = F.when(F.col("target"), size - len(_END)).otherwise(size)
    return each.select("conv_id", "example", "text", start.alias("loss_start"), end.alias("loss_end"))


def read_turns(text: Column) -> Column:
    """The (role, text) pairs of an example's text."""
    parts = F.split(text, _END)
    parts = F.slice(parts, 1, F.size(parts) - 1)

    def turn(part: Column) -> Column:
        colon = F.locate(":\n", part)
        role = F.substr(part, F.lit(5), colon - 5)
        return F.struct(unescape(role).alias("role"), unescape(F.substr(part, colon + 2)).alias("text"))

    return F.transform(parts, turn)


def conversation_digest(examples: DataFrame) -> DataFrame:
    """What the contract asks for, read back from the examples: a row for each conversation."""
    loss = unescape(F.substr("text", F.col("loss_start") + 1, F.col("loss_end") - F.col("loss_start")))
    last = examples.groupBy("conv_id").agg(
        F.max_by("text", "example").alias("whole"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("example", loss.alias("loss")))), lambda x: x["loss"]), "").alias("loss"),
        F.sum(F.char_length("text")).cast("long").alias("formatted_chars"),
    )
    turns = read_turns(F.col("whole"))
    flat = F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return last.select(
        "conv_id",
        F.size(turns).cast("long").alias("n_turns"),
        F.sha2(flat, 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
    )
