"""Mixing sources to target weights (operator 6), in DataFrame operations only.

Each source's documents, in a fixed pseudorandom order, are packed end to end into blocks of ``BLOCK`` words. The mix is a
sequence of slots, ``SHARD`` to an output shard. Every slot of a shard draws its source with the sources' shares of the slots as
probabilities, so a shard's counts are a multinomial draw; a source's total has a relative deviation of about one over the root
of its number of slots. A source's n-th slot of all shards takes pass n div B of its B blocks and in it the place that a
pseudorandom permutation of the indices gives n mod B; slots and blocks meet in a join by (source, block). Everything is a
function of seed, ids and sizes, so reruns agree.

Weights repeat ``WEIGHTS`` over the sources by code point, null last. Targets share the total by weight; none exceeds
``MOST_PASSES`` times its source's size, and the excess is shared again by weight until none does. A slot beyond the last
allowed pass takes nothing, so no document is taken more than ``MOST_PASSES`` times.

Running totals over documents and shards go through sums of groups, of a size that grows with the root of their number, so that
neither a group nor the sums of a source with a third of all rows are much for one task; slots are counted per shard before
they are shuffled, and find their source by an equi-join on a bin of the unit interval, whose side is broadcast up to
``MOST_BROADCAST`` sources and merged beyond. Targets are one sort over a row for each source (it spills, if need be).

Defined cases: null and empty texts have size 0 and are taken 0 times; a null source is a source of its own; a null id is
allowed; repeated rows are documents of their own; a text of any length is a run of blocks; sources of size 0 get target 0; an
empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

BLOCK, SHARD, MOST_PASSES = 32, 512, 3
WEIGHTS = (1, 2, 3)
#: Documents in one group of a running total, shards in one group (at least; both grow with the root), bins of the unit interval.
GROUP_ROWS, GROUP_SHARDS, BINS = 1000, 1024, 4096
#: Sources up to which the table of bins is broadcast.
MOST_BROADCAST = 100_000
SEED = 20_240_601


def word_count(text: Column) -> Column:
    """Number of maximal runs of characters other than 0x20 and 0x09-0x0D."""
    return F.coalesce(F.regexp_count(text, F.lit("[^ \\t-\\r]++")), F.lit(0)).cast("long")


def _unit(*parts) -> Column:
    """A pseudorandom double in [0, 1) of the parts."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11).cast("double") / float(1 << 53)


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_PASSES) -> DataFrame:
    """(src, known, source_size, target) from (src, known, source_size), one row a source; there are few of them.

    Sources in the order of most * size / weight: a prefix is capped, and the others share the rest by weight. The prefix is
    the shortest after which no share exceeds its cap, which is where sharing the excess again and again ends.
    """
    by_name = Window.orderBy(F.col("known").desc(), "src")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    rows = sizes.withColumn("w", w).withColumn("cap", F.lit(float(most)) * F.col("source_size"))
    every = Window.partitionBy()
    order = Window.orderBy(F.col("cap") / F.col("w"), F.col("known").desc(), "src")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = (
        rows.withColumn("total", F.sum("source_size").over(every).cast("double"))
        .withColumn("capped", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("left_w", F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
        .withColumn("rate", (F.col("total") - F.col("capped")) / F.col("left_w"))
        .withColumn("place", F.row_number().over(order))
        .withColumn("final", F.min(F.when(F.col("rate") * F.col("w") <= F.col("cap"), F.struct("place", "rate"))).over(every)["rate"])
    )
    return rows.select("src", "known", "source_size", F.least("cap", F.coalesce(F.col("final") * F.col("w"), F.col("cap"))).alias("target"), (F.row_number().over(by_name) - 1).cast("long").alias("s"))


#: Primes, no size of a source being a multiple of all three (fixed values).
PRIMES = (1_000_003, 999_983, 1_299_709)


def permuted(df: DataFrame, n: str, size: str, source: str, turn: str, out: str, seed: int, rounds: int = 4) -> DataFrame:
    """``df`` with ``out``, the place of index n < size under the permutation of this source and pass.

    Rounds of an affine map modulo size, whose factor is a prime that does not divide size, and of turning a pseudorandom
    prefix round; both are bijections of the indices. Each step is a column of its own, so that the expressions stay small.
    """
    factor = F.when(F.col(size) % PRIMES[0] != 0, PRIMES[0]).when(F.col(size) % PRIMES[1] != 0, PRIMES[1]).otherwise(PRIMES[2])
    df = df.withColumn("_factor", factor).withColumn(out, F.col(n))
    for r in range(rounds):
        df = df.withColumn(out, F.pmod(F.col(out) * F.col("_factor") + F.pmod(F.xxhash64(source, turn, F.lit(seed + r)), F.col(size)), F.col(size)))
        df = df.withColumn("_cut", F.pmod(F.xxhash64(source, turn, F.lit(seed + 100 + r)), F.col(size)) + 1)
        df = df.withColumn(out, F.when(F.col(out) < F.col("_cut"), F.col("_cut") - 1 - F.col(out)).otherwise(F.col(out)))
    return df.drop("_factor", "_cut")


def _documents(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int) -> DataFrame:
    """(doc_id, src, known, size, at): ``at`` is the document's first word in its source's stream."""
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{source_col}`"), F.lit("")).alias("src"), F.col(f"`{source_col}`").isNotNull().alias("known"), word_count(F.col(f"`{text_col}`")).alias("size"))
    rows = common.stored(rows, name="mix-sizes")
    n = rows.count()
    groups = max(1, n // max(GROUP_ROWS, math.isqrt(n)))
    order = F.xxhash64("doc_id", F.lit(seed))
    rows = rows.withColumn("o", order).withColumn("g", F.pmod(F.col("o"), F.lit(groups)))
    return common.running_total(rows, ["src", "known"], "g", ["o", "doc_id", "size"], "size", "at")


def _plan(docs: DataFrame, block: int, shard: int, most: int, weights: tuple[int, ...]) -> DataFrame:
    """One row a source: number, size, target, blocks, expected slots and part of the unit interval; with the numbers of shards."""
    sizes = docs.groupBy("src", "known").agg(F.sum("size").alias("source_size"))
    rows = targets(sizes, weights, most).withColumn("blocks", F.ceil(F.col("source_size") / block).cast("long"))
    # slots that the target takes, as blocks hold source_size / blocks words on average
    rows = rows.withColumn("slots", F.when(F.col("blocks") > 0, F.col("target") * F.col("blocks") / F.col("source_size")).otherwise(F.lit(0.0)))
    every = Window.partitionBy()
    by = Window.orderBy("s").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("sum", F.sum("slots").over(every)).withColumn("hi", F.try_divide(F.sum("slots").over(by), F.col("sum")))
    rows = rows.withColumn("lo", F.coalesce(F.lag("hi").over(Window.orderBy("s")), F.lit(0.0)))
    # sources without slots may follow the last that has some
    rows = rows.withColumn("hi", F.when(F.col("s") == F.max(F.when(F.col("slots") > 0, F.col("s"))).over(every), F.lit(1.0)).otherwise(F.col("hi")))
    rows = rows.withColumn("all_slots", F.round("sum").cast("long")).withColumn("shards", F.ceil(F.col("all_slots") / shard).cast("long"))
    return rows.withColumn("shard_slots", F.lit(shard)).withColumn("group_shards", F.greatest(F.lit(GROUP_SHARDS), F.ceil(F.sqrt("shards"))).cast("long"))


def draws(plan: DataFrame, seed: int = SEED) -> DataFrame:
    """(shard, group, s, number): each shard's multinomial draw, counted by source."""
    spark = plan.sparkSession
    parts = plan.filter("slots > 0")
    bins = parts.select("s", "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") * BINS), F.least(F.floor(F.col("hi") * BINS), F.lit(BINS - 1).cast("long")))).alias("bin"))
    one = parts.agg(*[F.max(c).alias(c) for c in ("all_slots", "shards", "shard_slots", "group_shards")]).filter("shards > 0")
    groups = one.withColumn("group", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("shards") - 1) / F.col("group_shards"))))).repartition(common.tasks(spark), "group")
    shards = groups.withColumn("shard", F.explode(F.sequence(F.col("group") * F.col("group_shards"), F.least((F.col("group") + 1) * F.col("group_shards"), F.col("shards")) - 1)))
    number = F.least(F.col("shard_slots"), F.col("all_slots") - F.col("shard") * F.col("shard_slots"))
    slots = shards.select("shard", "group", F.explode(F.sequence(F.lit(1).cast("long"), number)).alias("k"))
    drawn = slots.select("shard", "group", _unit("shard", "k", F.lit(seed + 2)).alias("u")).withColumn("bin", F.floor(F.col("u") * BINS))
    few = plan.count() <= MOST_BROADCAST
    found = drawn.join(F.broadcast(bins) if few else bins.hint("merge"), "bin").filter("u >= lo and u < hi")
    return found.groupBy("shard", "group", "s").agg(F.count("*").alias("number"))


def slots(plan: DataFrame, seed: int = SEED, most: int = MOST_PASSES) -> DataFrame:
    """The mix: (shard, s, n, block), a row for each slot; joined with a source's blocks by (s, block) it is the output.

    A slot whose number n is beyond the last allowed pass over its source is left out.
    """
    numbered = common.running_total(draws(plan, seed), ["s"], "group", ["shard"], "number", "first").join(plan.select("s", "blocks"), "s")
    # counts are few bytes, and AQE would leave them to few tasks, which then make all the slots
    numbered = numbered.repartition(common.tasks(plan.sparkSession), "s", "shard")
    out = numbered.select("shard", "s", "blocks", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("number") - 1)).alias("n")).filter(F.col("n") < F.col("blocks") * most)
    out = out.withColumn("turn", F.floor(F.col("n") / F.col("blocks")).cast("long")).withColumn("i", F.col("n") - F.col("turn") * F.col("blocks"))
    return permuted(out, "i", "blocks", "s", "turn", "block", seed).select("shard", "s", "n", "block")


def _parts(placed: DataFrame, block: int, *more: str) -> DataFrame:
    """(s, block, at, words, …): the words of each document in each block it touches, from ``at`` in its source's stream."""
    cut = F.explode_outer(F.when(F.col("size") > 0, F.sequence(F.floor(F.col("at") / block), F.floor((F.col("at") + F.col("size") - 1) / block))))
    parts = placed.filter("size > 0").select("s", "at", "size", cut.alias("block"), *more)
    words = F.least(F.col("at") + F.col("size"), (F.col("block") + 1) * block) - F.greatest(F.col("at"), F.col("block") * block)
    return parts.select("s", "block", "at", words.alias("words"), *more)


def blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block: int = BLOCK, shard: int = SHARD, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_PASSES, seed: int = SEED) -> DataFrame:
    """The mixed blocks: (shard, source, n, doc_id, first, words), a row for each piece of a document in each slot of the mix.

    ``first`` is the piece's first word in the document, from 0. A slot is named by its source and its number n there; the pieces
    of a slot follow the order of the source's stream (``doc_order``).
    """
    rows = common.stored(_documents(docs, id_col, text_col, source_col, seed), name="mix-documents")
    plan = common.stored(_plan(rows, block, shard, most, weights), name="mix-plan")
    placed = rows.join(plan.select("src", "known", "s"), ["src", "known"])
    parts = _parts(placed, block, "doc_id", "src", "known")
    out = slots(plan, seed, most).hint("merge").join(parts, ["s", "block"])
    first = F.greatest(F.col("block") * block - F.col("at"), F.lit(0))
    return out.select("shard", F.when(F.col("known"), F.col("src")).alias("source"), "n", "doc_id", first.alias("first"), "words", F.col("at").alias("doc_order"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block: int = BLOCK, shard: int = SHARD, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_PASSES, seed: int = SEED) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken), one row per input row."""
    with common.scratch(docs.sparkSession) as keep:
        rows = keep(common.stored(_documents(docs, id_col, text_col, source_col, seed), name="mix-documents"))
    plan = common.stored(_plan(rows, block, shard, most, weights), name="mix-plan")
    # a table of its own: one plan for the draws and another for the documents
    drawn = common.stored(slots(plan, seed, most).groupBy("s", "block").agg(F.count("*").alias("times")), name="mix-blocks")
    placed = rows.join(plan.select("src", "known", "s", "source_size", "target"), ["src", "known"])
    parts = _parts(placed, block)
    taken = parts.join(drawn.hint("merge"), ["s", "block"]).groupBy("s", "at").agg(F.sum(F.col("words") * F.col("times")).alias("taken"))
    # words are numbered within a source, so (s, at) names a document with words
    out = placed.filter("size > 0").join(taken.hint("merge"), ["s", "at"], "left").unionByName(placed.filter("size = 0").withColumn("taken", F.lit(0).cast("long")))
    return out.select("doc_id", F.when(F.col("known"), F.col("src")).alias("source"), "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
