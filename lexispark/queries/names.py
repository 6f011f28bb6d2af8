"""Normalisation profiles, tokenisers, canonical names, and what is built on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import norms
from ..functions import text as tx
from ..operators import curation, documents, filters, profile
from ..registry import Tables, query
from .retrieval import HITS, one_list


def digest(c: Column) -> Column:
    return F.md5(F.encode(c, "UTF-8"))


def squeezed(sql: str) -> str:
    return rf"trim(regexp_replace({sql}, '\s+', ' ', 'g'))"


PLAIN = "replace(coalesce(text, ''), chr(160), ' ')"
#: Anything but letters, marks, numbers and connectors.
NON_WORD = r"[^\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}\x{0400}-\x{04FF}]+"
PROFILES = {
    "evaluation": rf"""regexp_replace(lower({PLAIN}), '[®™©’‘''`“”«»()\[\]{{}};,]', ' ', 'g')""",
    "alias": f"regexp_replace(lower({PLAIN}), '[®™©’‘`“”]', ' ', 'g')",
    "query": f"regexp_replace(lower({PLAIN}), '[®™©“”«»''’`]+', ' ', 'g')",
    "triage": rf"regexp_replace(lower({PLAIN}), '[®™©’‘´`“”«»(){{}}\[\];,]', ' ', 'g')",
    "gold": rf"""regexp_replace(lower({PLAIN}), '[®™©()«»"''\-]', ' ', 'g')""",
    "title": f"regexp_replace(lower({PLAIN}), '{NON_WORD}', ' ', 'g')",
    "spaces": f"lower({PLAIN})",
    "pattern": rf"regexp_replace(replace(lower({PLAIN}), '’', ''''), '[^0-9a-zа-яіїєґ+\-''’\s]+', ' ', 'g')",
    "brand": f"regexp_replace(regexp_replace(regexp_replace(lower({PLAIN}), '[’‘`'']', '', 'g'), '[-‐‑‒–—]', ' ', 'g'), '[®™©“”«»]', ' ', 'g')",
}


@query("norm_profiles", "SELECT doc_id, " + ", ".join(f"md5({squeezed(s)}) AS {p}" for p, s in PROFILES.items()) + " FROM documents")
def norm_profiles(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", *[digest(norms.normalize(F.col("text"), p, unicode=False)).alias(p) for p in PROFILES])


def words(sql: str) -> str:
    return rf"list_filter(regexp_split_to_array({sql}, '\s+'), lambda w: w <> '')"


TOKENISERS = {
    "space": words("coalesce(text, '')"),
    "lower_space": words("lower(coalesce(text, ''))"),
    "hyphen": "list_filter(" + words(rf"regexp_replace(lower(coalesce(text, '')), '[^\p{{L}}\p{{M}}\p{{Nd}}\p{{Nl}}\p{{Pc}}\s-]', ' ', 'g')") + ", lambda w: length(w) > 2)",
    "word": words(f"regexp_replace({PROFILES['evaluation']}, '{NON_WORD}', ' ', 'g')"),
    "title": words(PROFILES["title"]),
    "long_word": "list_filter(" + words(f"regexp_replace(lower(coalesce(text, '')), '{NON_WORD}', ' ', 'g')") + ", lambda w: length(w) >= 2)",
}


@query("tokenizer_profiles", "SELECT doc_id, " + ", ".join(f"md5(array_to_string({s}, ' ')) AS {p}" for p, s in TOKENISERS.items()) + " FROM documents")
def tokenizer_profiles(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", *[digest(F.array_join(norms.tokenize(F.col("text"), p, unicode=False), " ")).alias(p) for p in TOKENISERS])


@query("canon_name", "SELECT p_partkey, 'nouvelle иод ' || p_name || ' ' || lower(p_type) || ' ібупрофен лоперамід d''or' AS canon FROM part")
def canon_name(t: Tables) -> DataFrame:
    raw = F.concat(F.lit(" Nouvélle Йод "), "p_name", F.lit(" "), "p_size", F.lit(",5 ["), "p_type", F.lit("] FORTE; Ibuprofen + імодіум d’or сироп"))
    return t.part.select("p_partkey", norms.canon_name(raw).alias("canon"))


@query("substance_set", "SELECT p_partkey, array_to_string(list_sort(['brand', lower(p_type) || ' мг', p_name, 'лоперамід']), '|') AS inns FROM part")
def substance_set(t: Tables) -> DataFrame:
    made = F.concat("p_type", F.lit(" 500 мг; Loperamide+"), "p_brand", F.lit(" / мг"))
    return t.part.select("p_partkey", F.array_join(norms.substance_set(F.col("p_name"), made), "|").alias("inns"))


@query("brand_index", "SELECT p_name AS name, array_to_string(list_sort(list_distinct(list_concat(list(lower(p_type)), [any_value(p_name)]))), '|') AS inns FROM part GROUP BY 1")
def brand_index(t: Tables) -> DataFrame:
    return curation.brand_index(t.part, "p_name", "p_type").select("name", F.array_join("inns", "|").alias("inns"))


#: Names with the substances of one part in forty.
FEW_INNS = "i AS (SELECT p_name AS name, list_distinct(list_concat(list(CASE WHEN p_partkey % 40 = 0 THEN lower(p_type) ELSE p_name END), [any_value(p_name)])) AS inns FROM part GROUP BY 1)"


def few_inns(t: Tables) -> DataFrame:
    rows = t.part.withColumn("made", F.when(F.col("p_partkey") % 40 == 0, F.col("p_type")).otherwise(""))
    return curation.brand_index(rows, "p_name", "made")


@query(
    "hits_by_name",
    f"""WITH {HITS}, {FEW_INNS}, p AS (SELECT qid, doc_id, rank, p_name AS name, inns FROM hits JOIN part ON p_partkey = doc_id JOIN i ON i.name = p_name WHERE source = 'bm25'),
g AS (SELECT DISTINCT qid, name, inns FROM (SELECT qid, CASE WHEN rank = 1 THEN split_part(p_name, ' ', 2) ELSE p_name END AS name FROM hits JOIN part ON p_partkey = doc_id WHERE source = 'dense' AND rank <= 2) LEFT JOIN i USING (name))
SELECT qid, doc_id, CAST(rank AS BIGINT) AS rank FROM p WHERE EXISTS (SELECT 1 FROM g WHERE g.qid = p.qid AND (g.name = p.name OR len(list_intersect(coalesce(g.inns, []), p.inns)) > 0 OR contains(g.name, p.name) OR contains(p.name, g.name)))""",
)
def hits_by_name(t: Tables) -> DataFrame:
    part = t.part.select(F.col("p_partkey").alias("doc_id"), norms.canon_name(F.col("p_name")).alias("name"))
    p = one_list(t).join(part, "doc_id").select("qid", "doc_id", "rank", "name")
    g = one_list(t, "dense").filter("rank <= 2").join(part, "doc_id").select("qid", F.when(F.col("rank") == 1, F.split_part("name", F.lit(" "), F.lit(2))).otherwise(F.col("name")).alias("name"))
    return curation.hits_by_name(p, g, few_inns(t)).select("qid", "doc_id", F.col("rank").cast("long").alias("rank"))


@query(
    "name_match_disjunctive",
    f"""WITH {FEW_INNS}, g AS (SELECT DISTINCT split_part(p_name, ' ', 2) AS g, split_part(p_name, ' ', 2) AS name, []::VARCHAR[] AS inns FROM part UNION ALL SELECT DISTINCT p_type, 'type ' || p_type, [lower(p_type)] FROM part UNION ALL SELECT DISTINCT 'all', string_agg(DISTINCT p_name, ' ' ORDER BY p_name), []::VARCHAR[] FROM part)
SELECT i.name AS p, g.g FROM i JOIN g ON i.name = g.name OR len(list_intersect(i.inns, g.inns)) > 0 OR contains(i.name, g.name) OR contains(g.name, i.name)""",
)
def name_match_disjunctive(t: Tables) -> DataFrame:
    none = F.array().cast("array<string>")
    p = few_inns(t).select(F.col("name").alias("p"), F.col("name").alias("p_name"), F.col("inns").alias("p_set"))
    noun = F.split_part("p_name", F.lit(" "), F.lit(2))
    g = t.part.select(noun.alias("g"), noun.alias("g_name"), none.alias("g_set")).distinct()
    g = g.unionByName(t.part.select(F.col("p_type").alias("g"), F.concat(F.lit("type "), "p_type").alias("g_name"), F.array(F.lower("p_type")).alias("g_set")).distinct())
    g = g.unionByName(t.part.agg(F.array_join(F.array_sort(F.collect_set("p_name")), " ").alias("g_name")).select(F.lit("all").alias("g"), "g_name", none.alias("g_set")))
    return curation.matching_names(p, g)


@query(
    "alias_ids",
    """WITH a AS (SELECT DISTINCT lower(replace(p_brand, '#', ' ')) AS alias, CASE WHEN p_size % 2 = 0 THEN p_name ELSE split_part(p_name, ' ', 1) END AS target FROM part WHERE p_partkey % 7 = 0)
SELECT DISTINCT alias, p_partkey AS id FROM a JOIN part ON CASE WHEN target IN (SELECT p_name FROM part) THEN p_name = target ELSE contains(p_name, target) END""",
)
def alias_ids(t: Tables) -> DataFrame:
    a = t.part.filter("p_partkey % 7 = 0").select(F.col("p_brand").alias("alias"), F.when(F.col("p_size") % 2 == 0, F.upper("p_name")).otherwise(F.split_part("p_name", F.lit(" "), F.lit(1))).alias("target"))
    return curation.alias_ids(a, t.part.select(F.col("p_name").alias("name"), F.col("p_partkey").alias("id")))


@query("cross_references", "SELECT p_partkey, lower(p_type) || ' ' || p_brand AS plain, p_name AS food FROM part")
def cross_references(t: Tables) -> DataFrame:
    text = F.concat(F.lit("Див. РОЗДІЛ «Особливості» "), "p_name", F.lit("; Протипоказання: "), F.lower("p_type"), F.lit(" передозування "), "p_brand", F.lit(". "))
    food = F.concat(F.lit("жири "), "p_name", F.lit(", "), "p_size", F.lit(",5 г —"))
    return t.part.select("p_partkey", norms.without(text, norms.CROSS_REFERENCES).alias("plain"), norms.without(food, norms.FOOD_VALUES).alias("food"))


@query("collapsed_repeats", "SELECT p_partkey, p_name || ' ' || p_brand || ' ' || p_type || '; end' AS text FROM part")
def collapsed_repeats(t: Tables) -> DataFrame:
    piece = F.concat("p_name", F.lit(" "), "p_brand", F.lit(" "), "p_type", F.lit("; "))
    return t.part.select("p_partkey", norms.collapsed(F.concat(F.repeat(piece, (F.col("p_size") % 4 + 1).cast("int")), F.lit("end"))).alias("text"))


@query("slugs", "SELECT c_custkey, lower(replace(c_name, '#', '-')) || '-' || lower(c_mktsegment) AS slug FROM customer")
def slugs(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", norms.slug(F.concat(F.lit(" /"), "c_name", F.lit(" // "), "c_mktsegment", F.lit("! "))).alias("slug"))


INN_CASES = "CASE p_partkey % 7 WHEN 0 THEN p_name WHEN 1 THEN split_part(p_name, ' ', 1) WHEN 2 THEN 'tablet-' || lower(p_type) WHEN 3 THEN '12,5 / 3' WHEN 4 THEN 'ab,,' || p_name WHEN 5 THEN 'component' END"


@query("inn_shapes", f"WITH c AS (SELECT p_partkey, {INN_CASES} AS c FROM part) SELECT p_partkey, c IS NOT NULL AND p_partkey % 7 <= 2 AS valid, coalesce(regexp_matches(c, '^[a-z-]+$') AND NOT contains(c, 'tablet'), false) AS latin, coalesce(regexp_matches(c, '^[a-z -]+$') AND NOT contains(c, 'tablet'), false) AS spaced FROM c")
def inn_shapes(t: Tables) -> DataFrame:
    kind = F.col("p_partkey") % 7
    c = F.when(kind == 0, F.col("p_name")).when(kind == 1, F.split_part("p_name", F.lit(" "), F.lit(1))).when(kind == 2, F.concat(F.lit("tablet-"), F.lower("p_type"))).when(kind == 3, "12,5 / 3").when(kind == 4, F.concat(F.lit("ab,,"), "p_name")).when(kind == 5, "component")
    return t.part.select("p_partkey", filters.valid_name(c).alias("valid"), filters.latin_name(c).alias("latin"), filters.latin_name(c, spaces=True).alias("spaced"))


@query("inventory_masks", "SELECT p_partkey, regexp_matches(p_name || ' ' || p_brand, '(?i)small|red') AND regexp_matches(p_type, '(?i)promo|small') AND NOT regexp_matches(p_type, '(?i)^small$') AS oral, regexp_matches(p_brand, '(?i)#1$') AS other FROM part")
def inventory_masks(t: Tables) -> DataFrame:
    masks = {"oral": (["p_name", "gone", "p_brand"], "small|red", ["p_type"], "promo|small", "^small$"), "other": (["p_brand"], "#1$", [], None, None)}
    return filters.inventory(t.part, masks).select("p_partkey", "oral", "other")


@query("alias_checks", "SELECT count(*) AS rows, count(*) FILTER (WHERE p_partkey % 4 = 0) AS with_parentheses, count(*) FILTER (WHERE p_partkey % 4 <> 0 AND p_partkey % 7 = 0) AS too_long, count(*) FILTER (WHERE p_partkey % 3 <> 0) AS no_substance FROM part")
def alias_checks(t: Tables) -> DataFrame:
    k = F.col("p_partkey")
    alias = F.when(k % 4 == 0, F.concat("p_name", F.lit(" (x)"))).when(k % 7 == 0, F.repeat(F.col("p_name"), F.lit(8))).otherwise(F.col("p_name"))
    return filters.alias_checks(t.part.select(alias.alias("alias"), F.when(k % 3 == 0, F.upper("p_name")).otherwise(F.col("p_brand")).alias("target")))


@query("first_term_rows", "SELECT doc_id AS key, source AS name, CASE WHEN contains(lower(text), 'tion') THEN 'tion' ELSE 'ment' END AS term, md5(left(text, 200) || '...') AS snippet FROM documents WHERE contains(lower(text), 'tion') OR contains(lower(text), 'ment')")
def first_term_rows(t: Tables) -> DataFrame:
    out = filters.first_term_rows(t.documents, "doc_id", "source", "text", ["tion", "ment"])
    return out.select(F.col("doc_id").alias("key"), "name", "term", digest(F.col("snippet")).alias("snippet"))


@query("gold_in_universe", f"WITH {HITS}, g AS (SELECT qid, list(DISTINCT doc_id ORDER BY doc_id) AS gold FROM hits WHERE source = 'dense' AND rank <= 5 AND doc_id IN (SELECT p_partkey FROM part WHERE p_size > 25) GROUP BY 1) SELECT qid, array_to_string(gold, ',') AS gold FROM g WHERE qid % 7 <> 0")
def gold_in_universe(t: Tables) -> DataFrame:
    queries = t.supplier.select(F.col("s_suppkey").alias("qid"), F.when(F.col("s_suppkey") % 7 == 0, "  ").otherwise(F.col("s_name")).alias("text"))
    docs = t.part.filter("p_size > 25").select(F.col("p_partkey").alias("doc_id"))
    return curation.in_universe(one_list(t, "dense").filter("rank <= 5").select("qid", "doc_id"), docs, queries).select("qid", F.array_join("gold", ",").alias("gold"))


@query("name_frequency", "SELECT lower(p_brand) || 's' AS alias, count(*) AS n FROM part GROUP BY 1")
def name_frequency(t: Tables) -> DataFrame:
    return profile.name_frequency(t.part.select(F.concat("p_brand", F.lit("’s - ®")).alias("name")), "name")


@query("separated_docs", "SELECT p_partkey, p_name || ' [SEP] ' || left(p_brand, 6) || ' [SEP] ' || p_type AS doc, p_type || ' [SEP] ' || p_name || ' [SEP] ' || p_brand AS led, p_name || ' | ' || left(p_type, 3) AS pair FROM part")
def separated_docs(t: Tables) -> DataFrame:
    c = documents.capped
    return t.part.select(
        "p_partkey",
        c(t.part, [("p_name", None), ("p_brand", 6), ("absent", 5), ("p_type", 800)]).alias("doc"),
        c(t.part, [("p_name", None), ("p_brand", None), ("p_type", None)], first="p_type").alias("led"),
        c(t.part, [("p_name", None), ("p_type", 3)], " | ").alias("pair"),
    )


@query("embedding_texts", "WITH w AS (SELECT p_partkey, 'Назва: ' || p_name || ' [SEP] p_brand: ' || p_brand || ' [SEP] p_type: ' || p_type AS x FROM part) SELECT p_partkey, CASE WHEN length(x) > 50 THEN left(x, 50) || '...' ELSE x END AS text FROM w")
def embedding_texts(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", documents.embedding_text(t.part, "p_name", ["p_brand", "gone", "p_type"], most=50).alias("text"))


@query("slim_docs", "SELECT p_partkey, 'passage: ' || p_name || CASE WHEN p_partkey % 2 = 0 THEN ' ' || p_type ELSE '' END AS slim, 'query: ' || p_name AS asked, p_name AS plain FROM part")
def slim_docs(t: Tables) -> DataFrame:
    df = t.part.withColumn("more", F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("\n "), "p_type", F.lit("\n"))))
    own = documents.prefixed(F.col("p_name"), "query: ")
    return df.select("p_partkey", documents.slim(df, "p_name", ["more"]).alias("slim"), documents.for_model(own, "query", "auto", "base-E5-small").alias("asked"), documents.for_model(F.col("p_name"), "query", "auto", "other").alias("plain"))


@query(
    "moded_gold",
    """WITH p AS (SELECT * FROM (VALUES ('child', 'small'), ('child', 'red'), ('travel', 'hot gear'), ('core', 'ring'), ('core', 'BOLT!')) v(mode, pattern)),
d AS (SELECT p_partkey AS doc_id, p_name FROM part WHERE NOT contains(p_name, 'anvil')),
h AS (SELECT mode, doc_id, row_number() OVER (PARTITION BY mode, pattern ORDER BY doc_id) AS n FROM p JOIN d ON contains(p_name, trim(replace(lower(pattern), '!', ' ')))),
u AS (SELECT mode, doc_id, row_number() OVER (PARTITION BY mode ORDER BY doc_id) AS n FROM (SELECT DISTINCT mode, doc_id FROM h WHERE n <= 20)),
g AS (SELECT mode, array_to_string(list(doc_id ORDER BY doc_id) FILTER (WHERE n <= 25), ',') AS gold, count(*) AS k FROM u GROUP BY 1)
SELECT c_custkey AS qid, mode, gold FROM (SELECT c_custkey, CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN 'child' WHEN c_mktsegment = 'MACHINERY' THEN 'travel' ELSE 'core' END AS mode FROM customer) JOIN g USING (mode) WHERE k >= 3""",
)
def moded_gold(t: Tables) -> DataFrame:
    patterns = t.spark.createDataFrame([("child", "small"), ("child", "red"), ("travel", "hot gear"), ("core", "ring"), ("core", "BOLT!")], "mode string, pattern string")
    queries = t.customer.select(F.col("c_custkey").alias("qid"), F.col("c_mktsegment").alias("text"))
    docs = t.part.select(F.col("p_partkey").alias("doc_id"), F.col("p_name").alias("name"))
    out = curation.moded_gold(queries, docs, patterns, [("child", ["house"]), ("travel", ["machine"])], "core", ["anvil"], 20, 25, 3)
    return out.select("qid", "mode", F.array_join("gold", ",").alias("gold"))


@query(
    "lexicon_gold",
    r"""WITH d AS (SELECT p_partkey AS doc_id, unnest([p_name, lower(p_type)]) AS s FROM part), m AS (SELECT doc_id, s, ' ' || s || ' ' AS p FROM d)
SELECT DISTINCT topic, doc_id FROM m JOIN (VALUES ('a', 'red', true), ('a', 'mall', true), ('b', 'widge', false), ('b', 'promo', false), ('b', 'omo', true)) v(topic, term, whole) ON CASE WHEN whole THEN contains(p, ' ' || term || ' ') ELSE contains(s, term) END""",
)
def lexicon_gold(t: Tables) -> DataFrame:
    terms = t.spark.createDataFrame([("one", "RED"), ("one", "mall"), ("two", "widge"), ("two", "x"), ("three", "(promo)"), ("three", "omo"), ("none", "blue")], "directory string, term string")
    docs = t.part.select(F.col("p_partkey").alias("doc_id"), "p_name", "p_type")
    return curation.lexicon_gold(docs, terms, ["p_name", "p_type"], {"one": "a", "two": "b", "three": "b"})


GENERATED = "q AS (SELECT p_partkey AS key, unnest(list_distinct(['what is ' || p_name || '?', p_name || ' of ' || p_brand])) AS query FROM part WHERE p_partkey >= 10)"


@query(
    "generated_queries",
    f"""WITH {GENERATED}, n AS (SELECT key, count(*) AS k FROM q GROUP BY 1), b AS (SELECT key, sum(k) OVER (ORDER BY key) - k AS before FROM n)
SELECT key, query FROM q JOIN b USING (key) WHERE before + 10 < 101""",
)
def generated_queries(t: Tables) -> DataFrame:
    q = F.array(F.concat(F.lit(" what is "), "p_name", F.lit("? ")), F.lit("short"), F.concat("p_name", F.lit(" of "), "p_brand"), F.concat(F.lit("what is "), "p_name", F.lit("?")), F.lit(" "))
    key = F.col("p_partkey").alias("key")
    done = t.part.filter("p_partkey < 10").select(key, F.lit("old").alias("query"))
    return curation.generated_queries(t.part.select(key), t.part.select(key, q.alias("queries")), done, "key", 101)


SAMPLED = """n AS (SELECT p_brand, count(*) AS n FROM part GROUP BY 1), quota AS (SELECT p_brand, CASE WHEN n <= 5 THEN n ELSE greatest(5, least(CAST(round_even(n * {0} / (SELECT sum(n) FROM n), 0) AS BIGINT), n)) END AS quota FROM n),
r AS (SELECT p_partkey, p_brand, p_name || ' ' || p_size % 7 AS name, md5('42-' || p_partkey) AS o, row_number() OVER (PARTITION BY p_brand ORDER BY md5('42-' || p_partkey), p_partkey) AS r FROM part), f AS (SELECT * FROM r JOIN quota USING (p_brand) WHERE r <= quota),
s AS (SELECT p_partkey, p_brand, name, o FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY o, p_partkey) AS k FROM f) WHERE k = 1)"""


def clamped(t: Tables, low: int, high: int) -> DataFrame:
    rows = t.part.select("p_partkey", "p_brand", F.concat("p_name", F.lit(" "), F.col("p_size") % 7).alias("name"))
    return curation.clamped_sample(rows, "p_brand", "p_partkey", "name", low, high).select("p_partkey", "p_brand")


@query("clamped_sample", f"WITH {SAMPLED.format(60)} SELECT p_partkey, p_brand FROM s ORDER BY o, p_partkey LIMIT 60")
def clamped_sample(t: Tables) -> DataFrame:
    return clamped(t, 10, 60)


@query(
    "filled_sample",
    f"""WITH {SAMPLED.format(100)}, e AS (SELECT p_partkey, p_brand, name, o FROM r WHERE p_partkey NOT IN (SELECT p_partkey FROM s) ORDER BY o, p_partkey LIMIT (SELECT greatest(0, 180 - count(*)) FROM s)), u AS (SELECT * FROM s UNION ALL SELECT * FROM e)
SELECT p_partkey, p_brand FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY o, p_partkey) AS k FROM u) WHERE k = 1""",
)
def filled_sample(t: Tables) -> DataFrame:
    return clamped(t, 180, 100)


@query("sample_report", f"WITH {SAMPLED.format(60)}, c AS (SELECT p_brand, count(*) AS k FROM (SELECT * FROM s ORDER BY o, p_partkey LIMIT 60) GROUP BY 1) SELECT n.p_brand AS \"group\", n, coalesce(k, 0) AS sampled, round(coalesce(k, 0) / n, 6) AS share FROM n LEFT JOIN c USING (p_brand)")
def sample_report(t: Tables) -> DataFrame:
    return curation.sample_report(t.part, clamped(t, 10, 60), "p_brand").withColumn("share", F.round("share", 6))




@query("unicode_names", "SELECT p_partkey, 'fine IV A' || p_name || ' 1⁄2' AS folded, 'a \"b\" - c''d ' || p_name AS plain FROM part")
def unicode_names(t: Tables) -> DataFrame:
    folded = tx.nfkc(F.concat(F.lit("ﬁne Ⅳ Ａ"), "p_name", F.lit(" ½")))
    return t.part.select("p_partkey", folded.alias("folded"), tx.basic_norm(F.concat(F.lit(" a “b”\t—  c’d  "), "p_name", F.lit(" "))).alias("plain"))
