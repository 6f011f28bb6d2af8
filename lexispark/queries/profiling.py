"""Data-quality profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import profile
from ..registry import Tables, query
from .retrieval import TOK


@query("null_profile", "WITH p AS (SELECT nullif(trim(p_name), '') AS a, CASE WHEN p_size > 40 THEN NULL ELSE p_size END AS b, CASE WHEN p_brand LIKE '%1' THEN '' ELSE p_brand END AS c FROM part) SELECT 'a' AS field, count(*) AS n, count(*) - count(a) AS nulls, round((count(*) - count(a)) / count(*), 6) AS rate FROM p UNION ALL SELECT 'b', count(*), count(*) - count(b), round((count(*) - count(b)) / count(*), 6) FROM p UNION ALL SELECT 'c', count(*), count(*) - count(nullif(c, '')), round((count(*) - count(nullif(c, ''))) / count(*), 6) FROM p")
def null_profile(t: Tables) -> DataFrame:
    p = t.part.select(F.col("p_name").alias("a"), F.when(F.col("p_size") <= 40, F.col("p_size")).alias("b"), F.when(F.col("p_brand").endswith("1"), "").otherwise(F.col("p_brand")).alias("c"))
    return profile.nulls(p).withColumn("rate", F.round("rate", 6))


SPECIAL = r"""[^\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}\s\-.,;:()\[\]{}«»"]"""
COMPLETE = "SELECT '{0}' AS field, count(*) FILTER (WHERE {0} IS NULL) AS nulls, count(*) FILTER (WHERE length(trim({0})) = 0) AS blank, count(*) FILTER (WHERE length(trim({0})) BETWEEN 1 AND 5) AS very_short, count(*) FILTER (WHERE length(trim({0})) > 10) AS meaningful, count(*) FILTER (WHERE regexp_matches({0}, '<[^>]+>')) AS html, round(avg(len(regexp_extract_all(trim({0}), '{2}')) / length(trim({0}))) FILTER (WHERE length(trim({0})) > 10), 6) AS special_density, round(avg(length(trim({0}))), 6) AS avg_length FROM {1}"


@query("completeness", " UNION ALL ".join(COMPLETE.format(c, "pages", SPECIAL) for c in ("url", "html")))
def completeness(t: Tables) -> DataFrame:
    return profile.completeness(t.pages, ["url", "html"]).withColumns({c: F.round(c, 6) for c in ("avg_length", "special_density")})


@query("length_percentiles", "SELECT lang, count(text) AS n, CAST(min(length(text)) AS INTEGER) AS min_len, round(avg(length(text)), 6) AS mean_len, round(quantile_cont(length(text), 0.5), 6) AS median_len, round(quantile_cont(length(text), 0.95), 6) AS p95_len, round(quantile_cont(length(text), 0.99), 6) AS p99_len, CAST(max(length(text)) AS INTEGER) AS max_len FROM documents GROUP BY lang")
def length_percentiles(t: Tables) -> DataFrame:
    df = profile.lengths(t.documents, "text", ["lang"])
    return df.select("lang", "n", "min_len", *[F.round(c, 6).alias(c) for c in ("mean_len", "median_len", "p95_len", "p99_len")], "max_len")


@query(
    "text_complexity",
    r"""WITH d AS (SELECT length(text) AS c, len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')) AS w, len(regexp_extract_all(text, '[.!?]+')) AS s FROM documents WHERE length(text) > 0)
SELECT count(*) AS texts, round(avg(c), 6) AS avg_chars, round(quantile_cont(c, 0.5), 6) AS median_chars, round(quantile_cont(c, 0.95), 6) AS p95_chars, CAST(max(c) AS INTEGER) AS max_chars, round(avg(w), 6) AS avg_words, round(avg(s), 6) AS avg_sentences,
  round(avg(w / greatest(s, 1)), 6) AS words_per_sentence, round(sum(c) / 4, 6) AS tokens, round(sum(c) / 4 * 768 * 4 / 1048576, 6) AS vectors_mb, round(avg(c) * count(*) / 10000, 6) AS work FROM d""",
)
def text_complexity(t: Tables) -> DataFrame:
    df = profile.complexity(t.documents, "text")
    return df.select(*[F.round(c, 6).alias(c) if k == "double" else F.col(c) for c, k in df.dtypes])


@query("dup_groups", "SELECT md5(text) AS digest, lang, count(*) AS n FROM documents GROUP BY 1, 2 HAVING count(*) > 1")
def dup_groups(t: Tables) -> DataFrame:
    return profile.duplicates(t.documents, [F.md5(F.encode("text", "UTF-8")).alias("digest"), F.col("lang")])


@query("top_phrases", r"WITH p AS (SELECT trim(unnest(regexp_split_to_array(lower(trim(regexp_replace(translate(regexp_replace(text, '<[^>]+>', ' ', 'g'), '™®© ', '    '), '\s+', ' ', 'g'))), '[.,;:!?()\n]+'))) AS phrase FROM documents) SELECT phrase, count(*) AS n FROM p WHERE length(phrase) >= 3 GROUP BY 1 ORDER BY n DESC, phrase LIMIT 40")
def top_phrases(t: Tables) -> DataFrame:
    return profile.top_phrases(t.documents, "text", 40)


@query(
    "ngram_min_df",
    f"""WITH d AS (SELECT doc_id, {TOK.format("text")} AS w FROM documents),
g AS (SELECT doc_id, array_to_string(w[i:i + k - 1], ' ') AS ngram FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT unnest([1, 2, 3]) AS k) WHERE len(w) >= k))
SELECT ngram, count(*) AS n, count(DISTINCT doc_id) AS docs FROM g GROUP BY 1 HAVING count(DISTINCT doc_id) >= 5""",
)
def ngram_min_df(t: Tables) -> DataFrame:
    return profile.ngram_frequency(t.documents, "doc_id", "text")


@query("value_counts", "SELECT event_type AS value, count(*) AS n FROM events GROUP BY 1")
def value_counts(t: Tables) -> DataFrame:
    return profile.value_counts(t.events, "event_type")


PATTERNS = {"numbers": "[0-9]+", "email": "[a-z0-9.]+@[a-z]+", "shouting": "[A-Z]{4,}", "symbols": "[$%#&*]{3}"}


@query("regex_counts", " UNION ALL ".join(f"SELECT '{k}' AS name, CAST(sum(len(regexp_extract_all(text, '{p}'))) AS BIGINT) AS mentions, count(*) FILTER (WHERE regexp_matches(text, '{p}')) AS texts FROM documents" for k, p in PATTERNS.items()))
def regex_counts(t: Tables) -> DataFrame:
    return profile.pattern_counts(t.documents, "text", PATTERNS)


@query("condition_coverage", " UNION ALL ".join(f"SELECT '{k}' AS name, count(*) FILTER (WHERE regexp_matches(text, '{p}')) AS hits, round(avg(CASE WHEN regexp_matches(text, '{p}') THEN 1.0 ELSE 0 END), 6) AS share, count(*) FILTER (WHERE regexp_matches(text, '{p}')) * 4 AS potential FROM documents" for k, p in PATTERNS.items()))
def condition_coverage(t: Tables) -> DataFrame:
    return profile.coverage(t.documents, "text", PATTERNS).withColumn("share", F.round("share", 6))


@query(
    "combo_availability",
    "SELECT 'name+brand' AS combo, count(*) AS n, round(avg(length(concat_ws(' ', p_name, p_brand))), 6) AS mean_len, round(quantile_cont(length(concat_ws(' ', p_name, p_brand)), 0.95), 6) AS p95_len FROM part UNION ALL SELECT 'brand+type', count(*), round(avg(length(concat_ws(' ', p_brand, p_type))), 6), round(quantile_cont(length(concat_ws(' ', p_brand, p_type)), 0.95), 6) FROM part",
)
def combo_availability(t: Tables) -> DataFrame:
    df = profile.combinations(t.part, {"name+brand": ["p_name", "p_brand"], "brand+type": ["p_brand", "p_type"]})
    return df.select("combo", "n", F.round("mean_len", 6).alias("mean_len"), F.round("p95_len", 6).alias("p95_len"))


@query("query_qc", "WITH q AS (SELECT conv_id AS q, lower(trim(text)) AS t FROM conversations WHERE role = 'user') SELECT count(*) AS rows, 0::BIGINT AS missing_gold, count(*) FILTER (WHERE coalesce(t, '') = '') AS blank_texts, (SELECT count(*) FROM (SELECT q FROM q GROUP BY q HAVING count(*) > 1)) AS duplicate_ids, (SELECT count(*) FROM (SELECT t FROM q GROUP BY t HAVING count(*) > 1)) AS duplicate_texts FROM q")
def query_qc(t: Tables) -> DataFrame:
    return profile.query_checks(t.conversations.filter("role = 'user'"), "conv_id", "text")


@query("preflight", "SELECT 'p_gone' AS missing, count(*) AS n, count(*) FILTER (WHERE p_name IS NULL) AS null_keys, (SELECT count(*) FROM (SELECT lower(trim(p_name)) FROM part WHERE p_name IS NOT NULL GROUP BY 1 HAVING count(*) > 1)) AS repeated FROM part")
def preflight(t: Tables) -> DataFrame:
    return profile.preflight(t.part, ["p_name", "p_gone", "p_type"], "p_name")


@query("recommendations", "WITH s AS (SELECT avg(CASE WHEN length(text) > 2000 THEN 1.0 ELSE 0 END) AS long_share, count(*) AS n FROM documents) SELECT 'chunk' AS rule, 'split long texts' AS advice FROM s WHERE long_share > 0.05 UNION ALL SELECT 'grow', 'gather more' FROM s WHERE n < 20000")
def recommendations(t: Tables) -> DataFrame:
    s = t.documents.agg(F.avg((F.length("text") > 2000).cast("double")).alias("long_share"), F.count("*").alias("n"))
    return profile.recommendations(s, [("chunk", "long_share > 0.05", "split long texts"), ("grow", "n < 20000", "gather more"), ("never", "n < 0", "nothing")])


@query("latency_by_stage", "SELECT event_type AS stage, count(*) AS n, round(avg(value), 6) AS avg_value, round(avg(avg_value), 6) AS mean_running FROM (SELECT event_type, value, avg(value) OVER (PARTITION BY event_type, user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS avg_value FROM events) GROUP BY 1")
def latency_by_stage(t: Tables) -> DataFrame:
    from ..operators import trace

    out = trace.latency(t.events, "event_type", "value", ["user_id"], ["ts", "event_id"])
    return out.select("stage", "n", F.round("avg_value", 6).alias("avg_value"), F.round("mean_running", 6).alias("mean_running"))


SCAN = "SELECT '{0}' AS field, '{1}' AS kinds, count(*) AS n, count(x) AS filled, round(count(x) / count(*), 6) AS share, CAST(min(length(x)) AS INTEGER) AS min_len, round(avg(length(x)), 6) AS mean_len, round(quantile_cont(length(x), 0.5), 6) AS median_len, CAST(max(length(x)) AS INTEGER) AS max_len FROM (SELECT nullif(trim({0}::VARCHAR), '') AS x FROM part)"


@query("scan_report", " UNION ALL ".join(SCAN.format(c, k) for c, k in {"p_partkey": "part,key", "p_name": "text", "p_brand": "", "p_type": "text", "p_size": ""}.items()))
def scan_report(t: Tables) -> DataFrame:
    df = profile.scan_report(t.part.drop("p_retailprice"), {"part": ["PARTKEY"], "key": ["key"], "text": ["name", "type"]})
    return df.select("field", "kinds", "n", "filled", F.round("share", 6).alias("share"), "min_len", F.round("mean_len", 6).alias("mean_len"), F.round("median_len", 6).alias("median_len"), "max_len")


@query(
    "training_potential",
    """WITH x AS (SELECT length(nullif(trim(CASE WHEN p_size > 10 THEN p_name END), '')) AS n, p_brand FROM part), g AS (SELECT p_brand, count(*) AS k FROM x GROUP BY 1 ORDER BY k DESC, p_brand LIMIT 10)
SELECT 'total' AS part, 'rows' AS label, count(*)::DOUBLE AS value FROM x UNION ALL SELECT 'total', 'with_text', count(n) FROM x UNION ALL SELECT 'total', 'queries', count(n) * 7 FROM x UNION ALL SELECT 'total', 'mean_length', round(avg(n), 6) FROM x
UNION ALL SELECT 'total', 'median_length', quantile_cont(n, 0.5) FROM x UNION ALL SELECT 'group', p_brand, k FROM g""",
)
def training_potential(t: Tables) -> DataFrame:
    rows = t.part.select(F.when(F.col("p_size") > 10, F.col("p_name")).alias("text"), "p_brand")
    return profile.potential(rows, "text", "p_brand").withColumn("value", F.round("value", 6))
