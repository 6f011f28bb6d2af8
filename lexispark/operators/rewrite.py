"""Query rewriting from alias, symptom and unit dictionaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from . import substrings


def _word_grams(queries: DataFrame, qid: str, text: str, most: int) -> DataFrame:
    """n-grams of words as the rewriter sees them, with their position."""
    words = F.filter(F.split(tx.rewrite_norm(F.col(text)), " "), lambda w: w != "")
    return queries.select(F.col(qid).alias("qid"), F.explode(F.array_distinct(tx.ngrams(words, 1, most))).alias("gram"))


def _longest(rows: DataFrame, gram: str = "gram") -> int:
    """Words of the longest entry: n-grams are made up to it."""
    return rows.agg(F.max(F.size(F.split(gram, " "))).alias("n")).first().n or 1


def alias_hits(queries: DataFrame, aliases: DataFrame, qid: str = "qid", text: str = "text") -> DataFrame:
    """(qid, ord, alias, target, type): aliases of any length that occur as whole words; an equi-join on normalised n-grams.

    ``aliases`` has (ord, alias, target, type); of one alias the first row counts.
    """
    first = aliases.withColumn("gram", tx.rewrite_norm(F.col("alias"))).filter("gram <> ''")
    first = first.withColumn("_n", F.row_number().over(Window.partitionBy("gram").orderBy("ord"))).filter("_n = 1").drop("_n")
    return _word_grams(queries, qid, text, _longest(first)).join(substrings.dictionary(first), "gram").select("qid", "ord", "alias", "target", "type")


def rewrite(queries: DataFrame, aliases: DataFrame, qid: str = "qid", text: str = "text", most: int = 3) -> DataFrame:
    """(qid, raw, rewritten, applied): targets of aliases that are no targets themselves (type inn), in dictionary order,
    not yet in the query, at most ``most``, appended."""
    hits = alias_hits(queries, aliases, qid, text).filter("type <> 'inn'").groupBy("qid", "target").agg(F.min("ord").alias("ord"))
    listed = hits.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "target"))), lambda x: x["target"]).alias("applied"))
    base = queries.select(F.col(qid).alias("qid"), F.col(text).alias("raw")).join(listed, "qid", "left").withColumn("applied", F.coalesce("applied", F.array().cast("array<string>")))
    add = tx.let(tx.rewrite_norm(F.col("raw")), lambda norm: F.slice(F.filter("applied", lambda t: ~F.contains(norm, t)), 1, most))
    return base.withColumn("_add", add).select("qid", "raw", F.when(F.size("_add") > 0, F.concat_ws(" ", "raw", F.array_join("_add", " "))).otherwise(F.col("raw")).alias("rewritten"), "applied")


def symptom_hits(queries: DataFrame, symptoms: DataFrame, qid: str = "qid", text: str = "text") -> DataFrame:
    """(qid, canon, intent_hint) from rows (canon, aliases separated by |, intent_hint)."""
    rows = symptoms.select("canon", "intent_hint", F.explode(F.split("aliases", r"\|")).alias("a")).withColumn("gram", tx.rewrite_norm(F.col("a"))).filter("gram <> ''")
    return _word_grams(queries, qid, text, _longest(rows)).join(substrings.dictionary(rows), "gram").select("qid", "canon", "intent_hint").distinct()


def unit_hits(queries: DataFrame, units: DataFrame, qid: str = "qid", text: str = "text") -> DataFrame:
    """(qid, raw, canon) of unit spellings that are tokens of the query."""
    words = queries.select(F.col(qid).alias("qid"), F.explode(F.array_distinct(F.split(F.lower(F.col(text)), r"\s+"))).alias("raw"))
    return words.join(substrings.dictionary(units.select(F.lower("raw").alias("raw"), "canon")), "raw").select("qid", "raw", "canon")


def contains_hits(queries: DataFrame, aliases: DataFrame, qid: str = "qid", text: str = "text", few: int = substrings.FEW) -> DataFrame:
    """(qid, alias, target) of aliases that occur anywhere in the query, inside words too."""
    q = queries.select(F.col(qid).alias("qid"), F.lower(F.col(text)).alias("_q"))
    return substrings.contained(q, "_q", aliases.withColumn("_alias", F.lower("alias")), "_alias", few).select("qid", "alias", "target")


def expand(queries: DataFrame, aliases: DataFrame, qid: str = "qid", text: str = "text", most: int = 8) -> DataFrame:
    """(qid, terms): distinct canonical terms of the aliases in the query, sorted, at most ``most``."""
    hits = contains_hits(queries, aliases, qid, text).groupBy("qid").agg(F.slice(F.sort_array(F.collect_set("target")), 1, most).alias("terms"))
    return queries.select(F.col(qid).alias("qid")).join(hits, "qid", "left").select("qid", F.coalesce("terms", F.array().cast("array<string>")).alias("terms"))
