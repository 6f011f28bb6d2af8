"""Data-quality profiles: each is one aggregation over the table, unpivoted to rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import norms
from ..functions import text as tx


def nulls(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(field, n, nulls, rate); blank strings count as null."""
    columns = columns or df.columns
    kinds = dict(df.dtypes)
    absent = lambda c: F.nullif(F.trim(F.col(c)), F.lit("")).isNull() if kinds[c] == "string" else F.col(c).isNull()
    one = df.agg(F.count("*").alias("n"), *[F.count_if(absent(c)).alias(c) for c in columns])
    return one.unpivot(["n"], columns, "field", "nulls").select("field", "n", "nulls", F.try_divide(F.col("nulls"), F.col("n")).alias("rate"))


#: What is neither word character, white space nor common punctuation (fixed value).
SPECIAL = r"""(?U)[^\w\s\-.,;:()\[\]{}«»"]"""


def completeness(df: DataFrame, columns: list[str]) -> DataFrame:
    """(field, nulls, blank, very_short, meaningful, html, special_density, avg_length), most complete first by ``meaningful``;
    the density of special characters is of the meaningful values."""
    t = lambda c: F.trim(F.col(c).cast("string"))
    size = lambda c: F.length(t(c))
    parts = F.array(
        *[
            F.struct(
                F.lit(c).alias("field"),
                t(c).isNull().cast("int").alias("null"),
                F.coalesce((size(c) == 0).cast("int"), F.lit(0)).alias("blank"),
                F.coalesce(size(c).between(1, 5).cast("int"), F.lit(0)).alias("short"),
                F.coalesce((size(c) > 10).cast("int"), F.lit(0)).alias("long"),
                F.coalesce(F.rlike(t(c), F.lit("<[^>]+>")).cast("int"), F.lit(0)).alias("html"),
                F.when(size(c) > 10, F.regexp_count(t(c), F.lit(SPECIAL)) / size(c)).alias("special"),
                size(c).alias("size"),
            )
            for c in columns
        ]
    )
    rows = df.select(F.explode(parts).alias("p")).select("p.*")
    return rows.groupBy("field").agg(F.sum("null").alias("nulls"), F.sum("blank").alias("blank"), F.sum("short").alias("very_short"), F.sum("long").alias("meaningful"), F.sum("html").alias("html"), F.avg("special").alias("special_density"), F.avg("size").alias("avg_length"))


def lengths(df: DataFrame, text: str, by: list[str] | None = None) -> DataFrame:
    """Count, min, mean, median, p95, p99 and max of the text length (linear interpolation)."""
    n = F.length(F.col(text))
    p = F.percentile(n, F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99)))
    g = df.groupBy(*(by or [])).agg(F.count(n).alias("n"), F.min(n).alias("min_len"), F.avg(n).alias("mean_len"), p.alias("p"), F.max(n).alias("max_len"))
    return g.select(*(by or []), "n", "min_len", "mean_len", F.col("p")[0].alias("median_len"), F.col("p")[1].alias("p95_len"), F.col("p")[2].alias("p99_len"), "max_len")


def complexity(df: DataFrame, text: str, dimensions: int = 768) -> DataFrame:
    """One row about the non-empty texts: mean, median, p95 and largest length, mean words, sentences and words per sentence,
    tokens (characters / 4), the size of as many vectors in MB, and a score of the work (mean length * texts / 10000)."""
    t = F.col(text)
    words = F.size(F.filter(F.split(t, r"\s+"), lambda w: w != ""))
    marks = F.regexp_count(t, F.lit("[.!?]+"))
    rows = df.filter(F.length(t) > 0).select(F.length(t).alias("c"), words.alias("w"), marks.alias("s"))
    g = rows.agg(
        F.count("*").alias("texts"),
        F.avg("c").alias("avg_chars"),
        F.percentile("c", F.array(F.lit(0.5), F.lit(0.95))).alias("p"),
        F.max("c").alias("max_chars"),
        F.avg("w").alias("avg_words"),
        F.avg("s").alias("avg_sentences"),
        F.avg(F.col("w") / F.greatest("s", F.lit(1))).alias("words_per_sentence"),
        (F.sum("c") / 4).alias("tokens"),
    )
    size = F.col("tokens") * dimensions * 4 / 1024**2
    return g.select("texts", "avg_chars", F.col("p")[0].alias("median_chars"), F.col("p")[1].alias("p95_chars"), "max_chars", "avg_words", "avg_sentences", "words_per_sentence", "tokens", size.alias("vectors_mb"), (F.col("avg_chars") * F.col("texts") / 10000).alias("work"))


def duplicates(df: DataFrame, keys: list[Column]) -> DataFrame:
    """Groups of more than one row by the keys."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def value_counts(df: DataFrame, column: str, top: int | None = None) -> DataFrame:
    out = df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    return out.orderBy(F.desc("n"), "value").limit(top) if top else out


def top_phrases(df: DataFrame, text: str, k: int, least: int = 3) -> DataFrame:
    """The k most frequent pieces between punctuation marks."""
    pieces = df.select(F.explode(F.split(F.lower(tx.clean_html(F.col(text))), r"[.,;:!?()\n]+")).alias("phrase")).select(F.trim("phrase").alias("phrase")).filter(F.length("phrase") >= least)
    return pieces.groupBy("phrase").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "phrase").limit(k)


#: Ids of several rows up to which they are broadcast.
FEW_REPEATED = 100_000


def ngram_frequency(df: DataFrame, doc: str, text: str, low: int = 1, high: int = 3, min_df: int = 5, stop: list[str] | None = None, few: int = FEW_REPEATED) -> DataFrame:
    """(ngram, n, docs) of n-grams in at least ``min_df`` documents; a row without an id belongs to none.

    The first occurrence in a row stands for its document, so tasks add up occurrences and documents at once and shuffle each of
    their n-grams once, without ids. Only ids of several rows are counted by id and n-gram first; where these are more than a
    checked number, all are.
    """
    tokens = tx.tokenize(F.col(text))
    if stop:
        tokens = F.filter(tokens, lambda w: ~w.isin(stop))
    own = df.select(F.col(doc).alias("d"), tokens.alias("w"))
    repeated = df.select(F.col(doc).alias("d")).filter("d is not null").groupBy("d").agg(F.count("*").alias("c")).filter("c > 1").select("d")
    some = repeated.limit(few + 1).count()
    grams = tx.ngrams(F.col("w"), low, high)
    if some > few:
        counts = _by_document(own.select("d", F.explode(grams).alias("ngram")))
    else:
        lone = own.join(F.broadcast(repeated), "d", "left_anti") if some else own
        first = lambda s: F.transform(s, lambda g, i: F.struct(g.alias("ngram"), (F.coalesce(F.get(s, i - 1) != g, F.lit(True)) & F.col("d").isNotNull()).cast("long").alias("docs")))
        counts = lone.select("d", F.explode(tx.let(F.array_sort(grams), first)).alias("g")).select("g.ngram", F.lit(1).cast("long").alias("n"), "g.docs")
        if some:
            counts = counts.unionByName(_by_document(own.join(F.broadcast(repeated), "d", "left_semi").select("d", F.explode(grams).alias("ngram"))))
    return counts.groupBy("ngram").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")).filter(F.col("docs") >= min_df)


def _by_document(grams: DataFrame) -> DataFrame:
    """(ngram, n, docs) of n-grams and documents, from (d, ngram)."""
    return grams.groupBy("ngram", "d").agg(F.count("*").alias("n")).select("ngram", "n", F.col("d").isNotNull().cast("long").alias("docs"))


def pattern_counts(df: DataFrame, text: str, patterns: dict[str, str]) -> DataFrame:
    """(name, mentions, texts): matches of each pattern, and texts with one."""
    t = F.coalesce(F.col(text), F.lit(""))
    parts = F.array(*[F.struct(F.lit(k).alias("name"), F.regexp_count(t, F.lit(p)).alias("c")) for k, p in patterns.items()])
    return df.select(F.explode(parts).alias("p")).groupBy(F.col("p.name").alias("name")).agg(F.sum("p.c").alias("mentions"), F.count_if(F.col("p.c") > 0).alias("texts"))


def coverage(df: DataFrame, text: str, patterns: dict[str, str], per_hit: int = 4) -> DataFrame:
    """(name, hits, share, potential) of the texts that each pattern matches."""
    t = F.coalesce(F.col(text), F.lit(""))
    parts = F.array(*[F.struct(F.lit(k).alias("name"), F.rlike(t, F.lit(p)).cast("int").alias("hit")) for k, p in patterns.items()])
    g = df.select(F.explode(parts).alias("p")).groupBy(F.col("p.name").alias("name")).agg(F.sum("p.hit").alias("hits"), F.count("*").alias("n"))
    return g.select("name", "hits", (F.col("hits") / F.col("n")).alias("share"), (F.col("hits") * per_hit).alias("potential"))


def combinations(df: DataFrame, combos: dict[str, list[str]]) -> DataFrame:
    """(combo, rows, mean and p95 length) of rows in which all columns of a combination are filled."""
    parts = []
    for name, cols in combos.items():
        ok = None
        for c in cols:
            f = tx.filled(F.col(c).cast("string")).isNotNull()
            ok = f if ok is None else ok & f
        parts.append(F.when(ok, F.struct(F.lit(name).alias("combo"), F.length(F.concat_ws(" ", *cols)).alias("len"))))
    rows = df.select(F.explode(F.array_compact(F.array(*parts))).alias("p")).select("p.*")
    return rows.groupBy("combo").agg(F.count("*").alias("n"), F.avg("len").alias("mean_len"), F.percentile("len", 0.95).alias("p95_len"))


def query_checks(queries: DataFrame, qid: str, text: str, gold: str | None = None) -> DataFrame:
    """Counts of rows, missing gold, ids used twice and texts used twice."""
    q = queries.select(F.col(qid).alias("q"), F.lower(F.trim(text)).alias("t"), (F.size(F.col(gold)) if gold else F.lit(1)).alias("g"))
    ids = q.groupBy("q").agg(F.count("*").alias("n")).agg(F.count_if(F.col("n") > 1).alias("duplicate_ids"))
    texts = q.groupBy("t").agg(F.count("*").alias("n")).agg(F.count_if(F.col("n") > 1).alias("duplicate_texts"))
    return q.agg(F.count("*").alias("rows"), F.count_if(F.coalesce("g", F.lit(0)) <= 0).alias("missing_gold"), F.count_if(F.coalesce("t", F.lit("")) == "").alias("blank_texts")).join(F.broadcast(ids)).join(F.broadcast(texts))


def recommendations(stats: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """(rule, advice) of the rules (name, SQL condition over the one row of ``stats``, advice) that hold."""
    parts = F.array(*[F.when(F.expr(cond), F.struct(F.lit(name).alias("rule"), F.lit(advice).alias("advice"))) for name, cond, advice in rules])
    return stats.select(F.explode(F.array_compact(parts)).alias("r")).select("r.*")


def preflight(df: DataFrame, required: list[str], key: str) -> DataFrame:
    """One row: missing columns, null keys, and names that repeat but for case."""
    missing = [c for c in required if c not in df.columns]
    if key not in df.columns:
        return df.limit(0).agg(F.count("*").alias("n")).select(F.lit(",".join(missing)).alias("missing"), "n", F.lit(None).cast("long").alias("null_keys"), F.lit(None).cast("long").alias("repeated"))
    k = F.lower(F.trim(F.col(key).cast("string")))
    g = df.groupBy(k.alias("k")).agg(F.count("*").alias("c"))
    return g.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.when(F.col("k").isNull(), F.col("c"))), F.lit(0)).alias("null_keys"), F.count_if(F.col("k").isNotNull() & (F.col("c") > 1)).alias("repeated")).select(F.lit(",".join(missing)).alias("missing"), "n", "null_keys", "repeated")


def name_frequency(df: DataFrame, name: str) -> DataFrame:
    """(alias, n): how many rows have each name in its ``brand`` form."""
    return df.filter(F.col(name).isNotNull()).groupBy(norms.normalize(F.col(name), "brand").alias("alias")).agg(F.count("*").alias("n"))


def discovered(df: DataFrame, keywords: dict[str, list[str]]) -> dict[str, list[str]]:
    """The columns whose name contains a keyword of each kind."""
    return {kind: [c for c in df.columns if any(w.lower() in c.lower() for w in words)] for kind, words in keywords.items()}


def scan_report(df: DataFrame, keywords: dict[str, list[str]]) -> DataFrame:
    """(field, kinds, n, filled, share, min_len, mean_len, median_len, max_len) of every column: kinds are those whose keywords
    its name contains, and lengths are of the values as text. One pass over the table."""
    kinds = discovered(df, keywords)
    own = lambda c: ",".join(k for k, cs in kinds.items() if c in cs)
    value = lambda c: tx.filled(F.col(f"`{c}`").cast("string"))
    parts = F.array(*[F.struct(F.lit(c).alias("field"), F.lit(own(c)).alias("kinds"), F.length(value(c)).alias("len")) for c in df.columns])
    rows = df.select(F.explode(parts).alias("p")).select("p.*")
    g = rows.groupBy("field", "kinds").agg(F.count("*").alias("n"), F.count("len").alias("filled"), F.min("len").alias("min_len"), F.avg("len").alias("mean_len"), F.percentile("len", 0.5).alias("median_len"), F.max("len").alias("max_len"))
    return g.select("field", "kinds", "n", "filled", (F.col("filled") / F.col("n")).alias("share"), "min_len", "mean_len", "median_len", "max_len")


def potential(df: DataFrame, text: str, group: str, per_item: int = 7, top: int = 10) -> DataFrame:
    """(part, label, value): rows, rows with a text, queries expected of them, mean and median length; and the ``top`` groups."""
    n = F.length(tx.filled(F.col(text)))
    one = df.agg(F.count("*").cast("double").alias("rows"), F.count(n).cast("double").alias("with_text"), (F.count(n) * per_item).cast("double").alias("queries"), F.avg(n).alias("mean_length"), F.percentile(n, 0.5).alias("median_length"))
    totals = one.unpivot([], one.columns, "label", "value").select(F.lit("total").alias("part"), "label", "value")
    groups = value_counts(df.filter(F.col(group).isNotNull()), group, top).select(F.lit("group").alias("part"), F.col("value").cast("string").alias("label"), F.col("n").cast("double").alias("value"))
    return totals.unionByName(groups)
