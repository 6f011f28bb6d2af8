"""Condition detection from phrase lexicons (condition, kind, phrase), document biases, condition indexes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from . import substrings


def lexicon(rows: DataFrame) -> DataFrame:
    """(condition, kind, norm) of distinct normalised phrases from raw lines: quotes stripped, blank and # lines out."""
    line = F.trim(F.regexp_replace(tx.basic_norm(F.col("phrase")), "^[\"' ]+|[\"' ]+$", ""))
    return rows.withColumn("_l", line).filter("_l <> '' and not startswith(_l, '#')").select("condition", "kind", tx.normalize_phrase(F.col("_l")).alias("norm")).filter("norm <> ''").distinct()


#: Distinct first words of a lexicon up to which they are a literal set in the scan.
MOST_FIRST_WORDS = 20_000


def _grams(df: DataFrame, key: str, text: str, lex: DataFrame) -> DataFrame:
    """(key, norm): n-grams of each text that begin with a word some phrase begins with.

    First words, fetched from the lexicon up to a checked number of them, are tested in the scan, so that only the few places
    where a phrase can start become rows; a larger lexicon takes all n-grams.
    """
    first = lex.select(F.split_part("norm", F.lit(" "), F.lit(1)).alias("w")).distinct().limit(MOST_FIRST_WORDS + 1).collect()
    longest = lex.agg(F.max(F.size(F.split("norm", " "))).alias("n")).first().n or 1
    words = df.select(F.col(key), tx.stemmed(F.col(text)).alias("_w"))
    if len(first) > MOST_FIRST_WORDS:
        return words.select(F.col(key), F.explode(F.array_distinct(tx.ngrams(F.col("_w"), 1, longest))).alias("norm"))

    def of(w: Column) -> Column:
        places = F.filter(F.sequence(F.lit(1), F.size(w)), lambda i: F.get(w, i - 1).isin([r.w for r in first]))
        return F.flatten(F.transform(places, lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(longest), F.size(w) - i + 1)), lambda n: F.array_join(F.slice(w, i, n), " "))))

    found = F.when(F.size("_w") > 0, tx.let(F.col("_w"), of)).otherwise(F.array().cast("array<string>"))
    return words.select(F.col(key), F.explode(F.array_distinct(found)).alias("norm"))


def matches(df: DataFrame, lex: DataFrame, key: str, text: str, kinds: list[str] | None = None) -> DataFrame:
    """(key, condition, kind, norm): lexicon phrases among the n-grams of each text; an equi-join on the phrase."""
    some = lex.filter(F.col("kind").isin(kinds)) if kinds else lex
    return _grams(df, key, text, some).join(substrings.dictionary(some), "norm").select(key, "condition", "kind", "norm").distinct()


def detect(queries: DataFrame, lex: DataFrame, key: str = "qid", text: str = "text") -> DataFrame:
    """(key, condition) of conditions with a trigger in the text."""
    return matches(queries, lex, key, text, ["trigger"]).select(key, "condition").distinct()


def condition_index(docs: DataFrame, lex: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(condition, doc_id) of documents with a trigger of the condition."""
    return matches(docs, lex, doc_id, text, ["trigger"]).select("condition", doc_id).distinct()


def bias(candidates: DataFrame, docs: DataFrame, conditions: DataFrame, lex: DataFrame, positive: float = 0.15, penalty: float = 0.20, text: str = "text") -> DataFrame:
    """(qid, doc_id, bias): +positive with any positive phrase of the query's conditions in the document, -penalty with any
    penalty phrase; both may apply. A condition named * holds for every query that has one."""
    wanted = candidates.select("qid", "doc_id").distinct()
    texts = docs.join(wanted.select("doc_id").distinct(), "doc_id", "left_semi")
    found = matches(texts, lex, "doc_id", text, ["positive", "penalty"]).select("doc_id", "condition", "kind").distinct()
    every = conditions.select("qid").distinct().withColumn("condition", F.lit("*"))
    hit = wanted.join(conditions.select("qid", "condition").unionByName(every), "qid").join(found, ["doc_id", "condition"]).groupBy("qid", "doc_id").agg(F.max((F.col("kind") == "positive").cast("int")).alias("pos"), F.max((F.col("kind") == "penalty").cast("int")).alias("pen"))
    return wanted.join(hit, ["qid", "doc_id"], "left").select("qid", "doc_id", (F.coalesce("pos", F.lit(0)) * float(positive) - F.coalesce("pen", F.lit(0)) * float(penalty)).alias("bias"))


def bias_keys(candidates: DataFrame, docs: DataFrame, conditions: DataFrame, lex: DataFrame, text: str = "text") -> DataFrame:
    """(qid, doc_id, global_penalties, positives, penalties): the sorted phrases of the query's conditions, and of the global
    penalty (condition *, which holds for every query), whose normal form the document's normal form contains, inside words too."""
    wanted = candidates.select("qid", "doc_id").distinct()
    phrases = lex.filter(F.col("kind").isin("positive", "penalty")).select("condition", "kind", "norm").distinct()
    normal = docs.join(wanted.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", tx.normalize_phrase(F.col(text)).alias("_n"))
    found = substrings.contained(normal, "_n", phrases, "norm").select("doc_id", "condition", "kind", "norm")
    general = wanted.join(found.filter("condition = '*' and kind = 'penalty'"), "doc_id").select("qid", "doc_id", F.lit("g").alias("k"), "norm")
    own = wanted.join(conditions.select("qid", "condition").distinct(), "qid").join(found.filter("condition <> '*'"), ["doc_id", "condition"]).select("qid", "doc_id", F.when(F.col("kind") == "positive", "p").otherwise("n").alias("k"), "norm")
    lists = general.unionByName(own).groupBy("qid", "doc_id").agg(*[F.sort_array(F.collect_set(F.when(F.col("k") == k, F.col("norm")))).alias(n) for k, n in (("g", "global_penalties"), ("p", "positives"), ("n", "penalties"))])
    none = F.array().cast("array<string>")
    return wanted.join(lists, ["qid", "doc_id"], "left").select("qid", "doc_id", *[F.coalesce(c, none).alias(c) for c in ("global_penalties", "positives", "penalties")])


def condition_patterns(df: DataFrame, key: str, text: str, patterns: list[tuple[str, str]]) -> DataFrame:
    """(key, condition, ord): conditions whose pattern matches, in the order of the list."""
    rows = F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(c).alias("condition"), F.lit(p).alias("p")) for i, (c, p) in enumerate(patterns)])
    t = F.coalesce(F.col(text), F.lit(""))
    return df.select(key, F.explode(F.filter(rows, lambda r: F.rlike(t, r["p"]))).alias("r")).select(key, "r.condition", "r.ord")
