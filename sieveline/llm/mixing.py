"""Mixing sources to target weights by Pfair scheduling.

Rows of a source are cut into blocks. Weights are kept as whole numbers over their sum (given whole numbers as they are, others to
2 ** -43 or finer), so nothing is rounded to a frame. With w = share / total, block i of a source is released at floor(i / w) and due at
ceil((i + 1) / w). Slots are dealt to the released block with the earliest deadline. As the shares add up to one, every deadline
is met: after any t slots a source that lasts has had t * w blocks, give or take less than one.

Slots follow from one another, so their order is one fold; what it walks over are blocks, of which there are ``most_blocks`` at
most, whatever the size of the corpus: ``block_rows`` grows instead. The fold keeps its state every ``STRIDE`` blocks, and
the slots between two states are worked out from there in parallel.

Rows are numbered inside their source in the order of a seeded hash of id and text (if there is one). A source is counted in pieces of bounded size (a
window for each piece, then a running sum over the pieces), so no task holds a whole source. Slots of a source that has
run out stay idle; no row is dropped or repeated.

Defined cases: a null source is a source of its own; sources without a weight, or with a weight that is null, not finite or not
above zero, have no share and come after all others, one after the other; where no source has a weight all have the same; rows
that share an id, null or not, each get a place; of equal rows, which are interchangeable, each gets one too; an empty table gives an empty
schedule; columns of the input pass through, those with the name of an output column are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_names, shuffle_partitions

RESULT = ("source_block", "slot", "place")
#: States that the fold keeps lie so many blocks apart. Sources beyond BROADCAST are joined, not broadcast.
STRIDE, BROADCAST = 512, 100_000
#: Weights that aren't whole numbers are taken to this part of their sum, or less where blocks times shares would pass 62 bits.
FINE = 1 << 50


def tempered(docs: DataFrame, source_col: str = "source", alpha: float = 0.7) -> DataFrame:
    """Weights in proportion to rows ** alpha: (source, weight), a row for each source."""
    return docs.groupBy(F.col(source_col).alias("source")).agg(F.count("*").alias("__n")).select("source", F.pow("__n", F.lit(alpha)).alias("weight"))


def shares(sizes: DataFrame, weights: DataFrame, fine: int = FINE) -> DataFrame:
    """(source, n) and (source, weight) to (source, n, idx, share): whole shares, 0 for a source without a weight."""
    every = Window.partitionBy(F.lit(1))
    order = every.orderBy(F.asc_nulls_first("source"))
    w = F.col("weight").cast("double")
    sound = F.when((w > 0) & (w < float("inf")), w).otherwise(F.lit(0.0))
    given = weights.groupBy("source").agg(F.max(sound).alias("w"))
    known = sizes.alias("n").join(given.alias("g"), F.col("n.source").eqNullSafe(F.col("g.source")), "left").select("n.source", "n.n", F.coalesce("g.w", F.lit(0.0)).alias("w"))
    known = known.withColumn("w", F.when(F.max("w").over(every) > 0, F.col("w")).otherwise(F.lit(1.0))).withColumn("total", F.sum("w").over(every))
    whole = (F.min((F.col("w") == F.floor("w")).cast("int")).over(every) == 1) & (F.col("total") <= fine)
    parts = F.when(F.col("w") > 0, F.greatest(F.round(F.col("w") / F.col("total") * fine).cast("long"), F.lit(1))).otherwise(F.lit(0))
    return known.select("source", "n", (F.row_number().over(order) - 1).alias("idx"), F.when(whole, F.col("w").cast("long")).otherwise(parts).alias("share"))


#: The block with the earliest deadline of those released by time {at}, of sources that have blocks left; ties go to the lower index.
_NEXT = "array_min(transform(s.done, (d, i) -> if(d < m[i] and d * total div a[i] <= {at}, struct(((d + 1) * total + a[i] - 1) div a[i] as due, i as i, {at} as at), null)))"
#: When nothing is released yet, time moves on to the next release; most steps don't have to look for it. {more} keeps what the
#: caller wants to see of the chosen x. Names are given by an inner ``aggregate``: a ``transform`` would copy all that was seen at every step.
_FOLD = f"""
aggregate(sequence(1L, {{steps}}), {{start}}, (s, k) -> aggregate(array(coalesce(
    {_NEXT.format(at="s.t")},
    {_NEXT.format(at="array_min(transform(s.done, (d, i) -> if(d < m[i], d * total div a[i], null)))")})), s, (same, x) ->
    named_struct('t', x.at + 1, 'done', transform(s.done, (d, i) -> if(i = x.i, d + 1, d)), 'seen', {{more}})), s -> s.seen)
"""
_STATE = "array<struct<t:bigint,done:array<bigint>>>"
_SLOTS = "array<struct<i:int,nth:bigint,slot:bigint>>"


def schedule(blocks: DataFrame, spread: int = 8) -> DataFrame:
    """(idx, share, blocks) to (idx, nth, slot): a row for each block of a source with a share."""
    one = blocks.filter("share > 0 and blocks > 0").groupBy().agg(F.array_sort(F.collect_list(F.struct("idx", F.col("share").cast("long").alias("share"), F.col("blocks").cast("long").alias("blocks")))).alias("s")).filter(F.size("s") > 0)
    one = one.select(F.expr("transform(s, x -> x.idx)").alias("ids"), F.expr("transform(s, x -> x.share)").alias("a"), F.expr("transform(s, x -> x.blocks)").alias("m"))
    one = one.withColumn("total", F.expr("aggregate(a, 0L, (x, y) -> x + y)")).withColumn("steps", F.expr("aggregate(m, 0L, (x, y) -> x + y)"))
    keep = f"if(k % {STRIDE} = 0, concat(s.seen, array(struct(x.at + 1 as t, transform(s.done, (d, i) -> if(i = x.i, d + 1, d)) as done))), s.seen)"
    nought = "transform(a, x -> 0L)"
    start = f"named_struct('t', 0L, 'done', {nought}, 'seen', cast(array(struct(0L as t, {nought} as done)) as {_STATE}))"
    states = one.withColumn("states", F.expr(_FOLD.format(steps="steps", start=start, more=keep)))
    #: Neither list is ever empty. A plain explode would filter by its size first, and Spark would work out the fold for that filter once more,
    #: with the lists of shares made anew for every number it reads.
    each = states.select("ids", "a", "m", "total", "steps", F.posexplode_outer("states").alias("nr", "state")).filter(F.col("nr") * STRIDE < F.col("steps")).repartition(spread, "nr")
    start = f"named_struct('t', state.t, 'done', state.done, 'seen', cast(array() as {_SLOTS}))"
    own = "concat(s.seen, array(struct(x.i as i, s.done[x.i] as nth, x.at as slot)))"
    seen = each.select("ids", F.explode_outer(F.expr(_FOLD.format(steps=f"least({STRIDE}L, steps - nr * {STRIDE}L)", start=start, more=own))).alias("e"))
    return seen.select(F.col("ids")[F.col("e.i")].alias("idx"), "e.nth", "e.slot")


def pfair_mix(
    docs: DataFrame, weights: DataFrame | None = None, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", block_rows: int | None = None, most_blocks: int = 200_000, seed: int = 7, piece_rows: int | None = None
) -> DataFrame:
    """``docs`` with source_block, slot and place (the order of the mixture: slot, then the row's place in its block).

    weights: (source, weight), ``tempered(docs)`` by default. block_rows: rows of a block, by default 32, or more where there would
    be over ``most_blocks`` blocks. The number of sources must stay small: the fold looks at each of them for each block.
    Rows go by id and, where there is a column ``text_col``, text: other columns change no place, save between rows that agree in both.
    piece_rows: rows numbered by one window.
    """
    spark = docs.sparkSession
    docs = drop_names(docs, *RESULT)
    cols = docs.columns
    #: Id and text say where a row goes; the other columns only break ties of those, so one more of them moves nothing.
    own = [F.col(f"`{c}`") for c in cols if c.lower() == text_col.lower()]
    rest_cols = [F.col(f"`{c}`") for c, t in docs.dtypes if "map<" not in t and "variant" not in t]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in cols]).alias("__r"), F.col(source_col).alias("__s"), F.xxhash64(F.lit(seed), F.col(id_col), *own).alias("__o"), F.xxhash64(*rest_cols).alias("__t"))
    sizes = docs.groupBy(F.col(source_col).alias("source")).agg(F.count("*").alias("n"))
    total = sizes.agg(F.sum("n").alias("n"), F.count("*").alias("sources")).first()
    count, sources = total.n or 0, total.sources
    block_rows = block_rows or max(32, -(-count // most_blocks))
    piece_rows = piece_rows or max(256, count // (2 * shuffle_partitions(spark)))
    small = F.broadcast if sources <= BROADCAST else lambda df: df
    fine = min(FINE, (1 << 61) // (count // block_rows + 2))
    share = shares(sizes, weights if weights is not None else tempered(docs, source_col), fine).withColumn("blocks", F.ceil(F.col("n") / block_rows))
    plan = schedule(share, shuffle_partitions(spark))
    #: Sources without a share follow the last slot, each in one go.
    rest = share.filter("share = 0").withColumn("first", F.sum("blocks").over(Window.partitionBy(F.lit(1)).orderBy("idx")) - F.col("blocks")).select("idx", "first")
    last = plan.agg((F.coalesce(F.max("slot"), F.lit(-1)) + 1).alias("last"))
    src = share.join(rest, "idx", "left").crossJoin(F.broadcast(last))  # one row
    src = src.select(F.col("source").alias("__src"), "idx", (F.col("last") + F.col("first")).alias("__first"), F.ceil(F.col("n") / piece_rows).alias("__m"))
    rows = rows.join(small(src), F.col("__s").eqNullSafe(F.col("__src")))
    #: Pieces cut the range of the hash evenly, so their order is the order of the hash.
    rows = rows.withColumn("__p", F.floor((F.col("__o") / F.lit(2.0**64) + 0.5) * F.col("__m")))
    ahead = rows.groupBy("idx", "__p").agg(F.count("*").alias("__c"))
    ahead = ahead.withColumn("__before", F.sum("__c").over(Window.partitionBy("idx").orderBy("__p")) - F.col("__c")).drop("__c")
    inside = Window.partitionBy("idx", "__p").orderBy("__o", F.col("__r")[id_col], "__t")
    rows = rows.withColumn("__n", F.row_number().over(inside) - 1).join(ahead, ["idx", "__p"])
    n = F.col("__before") + F.col("__n")
    rows = rows.withColumn("nth", F.floor(n / block_rows)).withColumn("__i", F.pmod(n, F.lit(block_rows)))
    rows = rows.join(F.broadcast(plan) if count <= block_rows * most_blocks else plan, ["idx", "nth"], "left")  # a row for each block
    slot = F.coalesce("slot", F.col("__first") + F.col("nth"))
    return rows.select(*[F.col("__r")[c].alias(c) for c in cols], F.col("nth").alias("source_block"), slot.alias("slot"), (slot * block_rows + F.col("__i")).alias("place"))
