"""Joins of texts with the needles they contain, for dictionaries of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let

#: Needles up to which their side is broadcast and every pair is tested.
FEW = 20_000
#: Characters of the piece of a needle that a join is made on.
GRAM = 4


def dictionary(rows: DataFrame, few: int = FEW) -> DataFrame:
    """The small side of an equi-join with text: broadcast up to a checked number of rows, else both sides are shuffled.

    Rows made in the driver have no statistics, and Spark would take the other side, made of all texts, for the smaller one
    and broadcast that.
    """
    return F.broadcast(rows) if rows.limit(few + 1).count() <= few else rows.hint("merge")


def grams(c: Column, n: int) -> Column:
    """Distinct runs of n characters."""
    runs = lambda t: F.transform(F.sequence(F.lit(1), F.length(t) - (n - 1)), lambda i: F.substr(t, i, F.lit(n)))
    return let(c, lambda t: F.when(F.length(t) >= n, F.array_distinct(runs(t))).otherwise(F.array().cast("array<string>")))


def contained(texts: DataFrame, text: str, needles: DataFrame, needle: str, few: int = FEW) -> DataFrame:
    """All columns of both sides for every pair of rows whose text contains the needle; null and empty needles match nothing.

    Up to a checked number of needles their side is broadcast. Beyond that a needle is joined by one of its pieces of ``GRAM``
    characters (the whole of a shorter needle), the one that fewest needles have; texts give their distinct pieces, and the
    pairs that meet are tested. Spark takes pieces for no larger than the texts they are of, so these joins shuffle both sides.
    Columns of the two sides must differ in name.
    """
    needles = needles.filter(F.col(needle) != "")
    test = F.contains(F.col(text), F.col(needle))
    if needles.limit(few + 1).count() <= few:
        return texts.join(F.broadcast(needles), test)
    pieces = needles.select(F.col(needle).alias("_of")).distinct().select("_of", F.explode(_sized(F.col("_of"))).alias("_g"))
    rare = pieces.groupBy("_g").agg(F.count("*").alias("_c"))
    chosen = pieces.join(rare.hint("merge"), "_g").groupBy("_of").agg(F.min(F.struct("_c", "_g")).alias("_b")).select("_of", F.col("_b._g").alias("_g"))
    keyed = needles.join(chosen.hint("merge"), F.col(needle) == F.col("_of")).drop("_of")
    own = texts.withColumn("_g", F.explode(F.concat(*[grams(F.col(text), n) for n in range(1, GRAM + 1)])))
    return own.join(keyed.hint("merge"), "_g").filter(test).drop("_g")


def _sized(c: Column) -> Column:
    """The pieces of a needle: its runs of GRAM characters, or itself where it is shorter."""
    return F.when(F.length(c) >= GRAM, grams(c, GRAM)).otherwise(F.array(c))
