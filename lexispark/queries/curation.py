"""Joins, dictionary upkeep, sampling, gold building and event intake."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import curation
from ..registry import Tables, query
from ..sources import readers, writers


@query("classification_left", "SELECT o_orderkey, c_mktsegment FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 3 <> 0) ON o_custkey = c_custkey")
def classification_left(t: Tables) -> DataFrame:
    flags = t.customer.filter("c_custkey % 3 <> 0")
    return t.orders.join(flags, F.col("o_custkey") == F.col("c_custkey"), "left").select("o_orderkey", "c_mktsegment")


@query("paired_inner", "SELECT a.l_orderkey AS qid, a.q AS a, b.q AS b FROM (SELECT l_orderkey, sum(l_quantity) AS q FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) a JOIN (SELECT l_orderkey, sum(l_quantity) AS q FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1) b USING (l_orderkey)")
def paired_inner(t: Tables) -> DataFrame:
    side = lambda f, n: t.lineitem.filter(F.col("l_returnflag") == f).groupBy(F.col("l_orderkey").alias("qid")).agg(F.sum("l_quantity").alias(n))
    return side("R", "a").join(side("A", "b"), "qid")


BRANDS = "b AS (SELECT p_name AS alias, 'brand' AS type, min(p_brand) AS target FROM part WHERE p_partkey % 3 <> 0 GROUP BY 1), n AS (SELECT p_name AS alias, 'brand' AS type, max(p_brand) AS target FROM part WHERE p_partkey % 3 <> 1 GROUP BY 1)"


def brands(t: Tables, rest: int, which) -> DataFrame:
    return t.part.filter(F.col("p_partkey") % 3 != rest).groupBy(F.col("p_name").alias("alias"), F.lit("brand").alias("type")).agg(which("p_brand").alias("target"))


@query("alias_upsert", f"WITH {BRANDS} SELECT coalesce(b.alias, n.alias) AS alias, coalesce(n.target, b.target) AS target, CASE WHEN n.alias IS NULL THEN 'kept' WHEN b.alias IS NULL THEN 'added' ELSE 'replaced' END AS change FROM b FULL JOIN n ON b.alias = n.alias AND b.type = n.type")
def alias_upsert(t: Tables) -> DataFrame:
    return curation.upsert(brands(t, 0, F.min), brands(t, 1, F.max), ["alias", "type"], ["target"]).select("alias", "target", "change")


@query("alias_merge_conflicts", f"WITH {BRANDS} SELECT coalesce(b.alias, n.alias) AS key, coalesce(b.target, n.target) AS value, CASE WHEN n.target IS NULL THEN 'base' WHEN b.target IS NULL THEN 'added' WHEN b.target = n.target THEN 'same' ELSE 'conflict' END AS status FROM b FULL JOIN n ON b.alias = n.alias")
def alias_merge_conflicts(t: Tables) -> DataFrame:
    return curation.merge_report(brands(t, 0, F.min), brands(t, 1, F.max), "alias", "target")


@query("alias_repair", "WITH k AS (SELECT p_name AS name, min(p_brand) AS brand FROM part WHERE p_partkey % 2 = 0 GROUP BY 1) SELECT p.p_partkey, coalesce(a.brand, b.brand) AS fixed FROM part p LEFT JOIN k a ON a.name = p.p_name || '!' LEFT JOIN k b ON b.name = p.p_name")
def alias_repair(t: Tables) -> DataFrame:
    table = t.part.filter("p_partkey % 2 = 0").groupBy(F.col("p_name").alias("name")).agg(F.min("p_brand").alias("brand"))
    return curation.repaired(t.part, table, [F.concat("p_name", F.lit("!")), F.col("p_name")], "name", "brand", "fixed").select("p_partkey", "fixed")


@query("resume_anti", "SELECT event_id FROM events WHERE event_id NOT IN (SELECT event_id FROM events WHERE event_id % 3 = 0)")
def resume_anti(t: Tables) -> DataFrame:
    return curation.remaining(t.events, t.events.filter("event_id % 3 = 0"), "event_id").select("event_id")


NAMES = "n AS (SELECT DISTINCT lower(trim(CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE split_part(p_name, ' ', 1) END)) AS name FROM part), t AS (SELECT lower(trim(p_name)) AS title, p_partkey AS target FROM part)"


@query("exact_or_contains", f"WITH {NAMES}, e AS (SELECT name, target FROM n JOIN t ON name = title), c AS (SELECT name, target FROM n JOIN t ON contains(title, name) WHERE name NOT IN (SELECT name FROM e) AND length(name) >= 4) SELECT DISTINCT name, target FROM (SELECT * FROM e UNION ALL SELECT * FROM c)")
def exact_or_contains(t: Tables) -> DataFrame:
    names = t.part.select(F.when(F.col("p_partkey") % 2 == 0, F.col("p_name")).otherwise(F.split_part("p_name", F.lit(" "), F.lit(1))).alias("name"))
    return curation.exact_or_contains(names, t.part, "name", "p_name", "p_partkey")


@query("id_or_text", "WITH p AS (SELECT item_id, lower(trim(text)) AS t, item_id * 10 AS v FROM benchmark) SELECT b.item_id AS id, coalesce(x.v, y.v) AS predicted FROM benchmark b LEFT JOIN (SELECT * FROM p WHERE item_id % 2 = 0) x USING (item_id) LEFT JOIN (SELECT t, max(v) AS v FROM p WHERE item_id % 3 = 0 GROUP BY 1) y ON y.t = lower(trim(b.text))")
def id_or_text(t: Tables) -> DataFrame:
    rows = t.benchmark.select(F.col("item_id").alias("id"), "text", (F.col("item_id") * 10).alias("predicted"))
    some = rows.filter("id % 2 = 0").withColumn("text", F.lit(None).cast("string")).unionByName(rows.filter("id % 3 = 0").withColumn("id", F.lit(None).cast("long")))
    return curation.by_id_or_text(t.benchmark.select(F.col("item_id").alias("id"), "text", F.lit(1).alias("gold")), some).select("id", "predicted")


@query("universe_check", "SELECT (SELECT count(*) FROM (SELECT p_partkey FROM part EXCEPT SELECT l_partkey FROM lineitem)) AS only_a, (SELECT count(*) FROM (SELECT l_partkey FROM lineitem EXCEPT SELECT p_partkey FROM part)) AS only_b, (SELECT count(*) FROM (SELECT p_partkey FROM part EXCEPT SELECT l_partkey FROM lineitem)) + (SELECT count(*) FROM (SELECT l_partkey FROM lineitem EXCEPT SELECT p_partkey FROM part)) = 0 AS equal")
def universe_check(t: Tables) -> DataFrame:
    return curation.same_universe(t.part.select(F.col("p_partkey").alias("id")), t.lineitem.select(F.col("l_partkey").alias("id")), "id")


@query(
    "stratified_sample",
    """WITH n AS (SELECT p_brand, count(*) AS n FROM part GROUP BY 1), q AS (SELECT p_brand, CASE WHEN n <= 5 THEN n ELSE greatest(5, least(CAST(round_even(n * 100 / (SELECT sum(n) FROM n), 0) AS BIGINT), n)) END AS quota FROM n),
r AS (SELECT p_partkey, p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY md5('42-' || p_partkey), p_partkey) AS r FROM part) SELECT p_partkey, p_brand FROM r JOIN q USING (p_brand) WHERE r <= quota""",
)
def stratified_sample(t: Tables) -> DataFrame:
    return curation.stratified_sample(t.part, "p_brand", "p_partkey", 100).select("p_partkey", "p_brand")


NUMBERED = "i AS (SELECT p_partkey AS key, p_brand AS g, row_number() OVER (PARTITION BY p_brand ORDER BY md5('7-' || p_partkey), p_partkey) - 1 AS i, count(*) OVER (PARTITION BY p_brand) AS n FROM part)"
NEGATIVES = f"""{{0}}, {NUMBERED}, x AS (SELECT key, g, (i + d) % n AS i, 'same' AS kind FROM i, (SELECT unnest([1, 2, 3]) AS d) WHERE d < n UNION ALL
  SELECT i.key, ring.next, (i.i + d) % z.n, 'other' FROM i JOIN ring USING (g) JOIN (SELECT g, max(n) AS n FROM i GROUP BY 1) z ON z.g = ring.next, (SELECT unnest([0, 1]) AS d) WHERE ring.next <> i.g AND d < z.n),
neg AS (SELECT x.key, i.key AS negative, kind FROM x JOIN i ON i.g = x.g AND i.i = x.i)"""


def negatives_sql() -> str:
    from .entities import RING

    return NEGATIVES.format(RING.format(7, "p_brand"))


@query("hard_negatives", f"WITH {negatives_sql()} SELECT * FROM neg")
def hard_negatives(t: Tables) -> DataFrame:
    return curation.hard_negatives(t.part, "p_partkey", "p_brand")


@query(
    "negative_pairs",
    f"""WITH {negatives_sql()}, q AS (SELECT p_partkey AS key, unnest(['what is ' || p_name, 'buy ' || p_brand]) AS query FROM part), l AS (SELECT key, string_agg(p_name, '|' ORDER BY kind, negative) AS negatives FROM neg JOIN part ON p_partkey = negative GROUP BY 1)
SELECT left(md5(q.key || '-' || query), 12) AS qid, query, q.key, p_name AS positive, negatives FROM q JOIN part ON p_partkey = q.key JOIN l ON l.key = q.key""",
)
def negative_pairs(t: Tables) -> DataFrame:
    asked = F.explode(F.array(F.concat(F.lit("what is "), "p_name"), F.concat(F.lit(" buy "), "p_brand"), F.concat(F.lit("what is "), "p_name", F.lit(" ")), F.lit(" ")))
    out = curation.negative_pairs(t.part.select("p_partkey", asked.alias("query")), t.part, "p_partkey", "p_brand", "p_name")
    return out.withColumn("negatives", F.array_join("negatives", "|"))


@query(
    "pattern_gold",
    """WITH w AS (SELECT DISTINCT split_part(p_name, ' ', 1) AS pattern FROM part), p AS (SELECT CASE WHEN length(pattern) % 2 = 0 THEN 'even' ELSE 'odd' END AS topic, pattern FROM w),
h AS (SELECT topic, pattern, p_partkey, row_number() OVER (PARTITION BY topic, pattern ORDER BY p_partkey) AS n FROM part JOIN p ON contains(lower(p_name), lower(pattern)))
SELECT DISTINCT q.qid, p_partkey AS doc_id FROM (VALUES (1::BIGINT, 'even'), (2::BIGINT, 'odd')) q(qid, topic) JOIN h USING (topic) WHERE n <= 20""",
)
def pattern_gold(t: Tables) -> DataFrame:
    first = F.split_part("p_name", F.lit(" "), F.lit(1))
    patterns = t.part.select(first.alias("pattern")).distinct().select(F.when(F.length("pattern") % 2 == 0, "even").otherwise("odd").alias("topic"), "pattern")
    queries = t.spark.createDataFrame([(1, "even"), (2, "odd")], "qid long, topic string")
    return curation.pattern_gold(queries, t.part.select(F.col("p_partkey").alias("doc_id"), F.col("p_name").alias("name")), patterns, 20)


@query("silver_gold", "SELECT k AS topic, count(*) AS docs, min(doc_id) AS first_doc FROM documents, (VALUES ('ing', 'ing[ .]'), ('caps', '[A-Z]{5,}')) f(k, p) WHERE regexp_matches(text, p) GROUP BY 1")
def silver_gold(t: Tables) -> DataFrame:
    from ..operators.clinical import condition_patterns

    rows = condition_patterns(t.documents, "doc_id", "text", [("ing", "ing[ .]"), ("caps", "[A-Z]{5,}")])
    return rows.groupBy(F.col("condition").alias("topic")).agg(F.count("*").alias("docs"), F.min("doc_id").alias("first_doc"))


@query("template_queries", "WITH s AS (SELECT DISTINCT p_brand AS subject FROM part), q AS (SELECT subject, replace(x, '{}', subject) AS query FROM s, (SELECT unnest(['what is {}', 'how to use {}', 'is {} safe']) AS x)), r AS (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY md5('1-' || query)) AS n FROM q) SELECT subject, query FROM r WHERE n <= 2")
def template_queries(t: Tables) -> DataFrame:
    return curation.template_queries(t.part.select(F.col("p_brand").alias("s")).distinct(), ["what is {}", "how to use {}", "is {} safe"], "s", 2)


@query("quota_rows", "WITH r AS (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS n FROM part) SELECT p_brand, p_partkey FROM r WHERE n <= 3 ORDER BY p_partkey LIMIT 40")
def quota_rows(t: Tables) -> DataFrame:
    return curation.quota(t.part.select("p_brand", "p_partkey"), "p_brand", 3, 40, ["p_partkey"])


@query("refill_queries", "SELECT id, part FROM (SELECT p_partkey AS id, 0 AS part FROM part WHERE p_partkey % 50 = 0 UNION ALL SELECT p_partkey, 1 FROM part WHERE p_partkey % 50 = 1) ORDER BY part, id LIMIT 30")
def refill_queries(t: Tables) -> DataFrame:
    side = lambda r, p: t.part.filter(F.col("p_partkey") % 50 == r).select(F.col("p_partkey").alias("id"), F.lit(p).alias("part"))
    return curation.refill(side(0, 0), side(1, 1), 30)


@query("gold_id_norm", "SELECT doc_id, coalesce(try_cast(CASE WHEN doc_id % 4 = 0 THEN 'x' ELSE CAST(doc_id AS VARCHAR) END AS BIGINT), doc_id + 1) AS first_gold FROM documents")
def gold_id_norm(t: Tables) -> DataFrame:
    d = t.documents.select("doc_id", F.array(F.when(F.col("doc_id") % 4 == 0, "x").otherwise(F.col("doc_id").cast("string"))).alias("gold"), F.array((F.col("doc_id") + 1).cast("string")).alias("gold_ids"))
    return d.select("doc_id", curation.gold_ids(d, ["gold", "absent", "gold_ids"])[0].alias("first_gold"))


@query("subset_counts", "SELECT 'all' AS subset, count(*) AS n FROM conversations UNION ALL SELECT 'asked', count(*) FROM conversations WHERE role = 'user' UNION ALL SELECT 'long', count(*) FROM conversations WHERE length(text) > 200")
def subset_counts(t: Tables) -> DataFrame:
    return writers.subset_counts(writers.subset_rows(t.conversations, {"asked": F.col("role") == "user", "long": F.length("text") > 200, "none": F.lit(False)}))


@query("long_form", "SELECT p_brand, metric, value FROM (SELECT p_brand, count(*)::VARCHAR AS n, max(p_size)::VARCHAR AS largest FROM part GROUP BY 1) UNPIVOT (value FOR metric IN (n, largest))")
def long_form(t: Tables) -> DataFrame:
    g = t.part.groupBy("p_brand").agg(F.count("*").alias("n"), F.max("p_size").alias("largest"))
    return writers.long_form(g, ["p_brand"]).drop("type")


@query(
    "query_file",
    """WITH t AS (SELECT conv_id * 1000 + turn AS k, trim(text) AS x, role FROM conversations)
SELECT CASE WHEN k % 5 IN (0, 1) THEN k::VARCHAR END AS id, x AS query, CASE WHEN k % 5 = 2 THEN role END AS intent FROM t WHERE k % 5 < 4 AND x <> ''""",
)
def query_file(t: Tables) -> DataFrame:
    k, text = F.col("conv_id") * 1000 + F.col("turn"), F.col("text")
    line = (
        F.when(k % 5 == 0, F.to_json(F.struct(k.cast("string").alias("id"), text.alias("query"))))
        .when(k % 5 == 1, F.to_json(F.struct(k.alias("qid"), F.concat(F.lit(" "), text).alias("q"))))
        .when(k % 5 == 2, F.to_json(F.struct(F.col("role").alias("intent"), text.alias("question"))))
        .when(k % 5 == 3, text)
        .otherwise(F.to_json(F.struct(k.alias("id"))))
    )
    return readers.parsed_queries(t.conversations.select(line.alias("value")))


@query("query_file_lenient", "SELECT conv_id * 1000 + turn AS id, trim(text) AS query FROM conversations WHERE turn % 2 = 0 AND trim(text) <> ''")
def query_file_lenient(t: Tables) -> DataFrame:
    k = F.col("conv_id") * 1000 + F.col("turn")
    whole = F.to_json(F.struct(k.alias("id"), F.col("text").alias("query")))
    line = F.when(F.col("turn") % 2 == 0, whole).otherwise(F.left(whole, F.length(whole) - 2))
    return readers.parsed_queries(t.conversations.select(line.alias("value")), lenient=True).select(F.col("id").cast("long").alias("id"), "query")


@query("prediction_shapes", "SELECT l_orderkey::VARCHAR AS id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS INTEGER) AS rank, l_partkey::VARCHAR AS doc_id FROM lineitem")
def prediction_shapes(t: Tables) -> DataFrame:
    own = t.lineitem.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("x"))
    ids = F.transform("x", lambda x: x["l_partkey"])
    objects = F.transform("x", lambda x: F.struct(x["l_partkey"].alias("doc_id"), x["l_linenumber"].alias("score")))
    named = F.transform("x", lambda x: F.struct(x["l_partkey"].cast("string").alias("id")))
    k = F.col("l_orderkey")
    line = F.when(k % 4 == 0, F.to_json(F.struct(k.alias("qid"), F.transform(ids, lambda i: i.cast("string")).alias("doc_ids")))).when(k % 4 == 1, F.to_json(F.struct(k.cast("string").alias("id"), objects.alias("hits")))).when(k % 4 == 2, F.to_json(F.struct(k.alias("query_id"), ids.alias("pred_ids")))).otherwise(F.to_json(F.struct(k.alias("id"), named.alias("results"))))
    return readers.prediction_ids(own.select(line.alias("value")))


@query("scan_columns", "SELECT l_orderkey, l_quantity FROM lineitem WHERE l_quantity > 45")
def scan_columns(t: Tables) -> DataFrame:
    return readers.table(t.spark, f"{t.sf_dir}/lineitem.parquet", ["l_orderkey", "l_quantity"]).filter("l_quantity > 45")


@query("first_rows", "SELECT p_partkey, p_name FROM part ORDER BY p_name, p_partkey LIMIT 50")
def first_rows(t: Tables) -> DataFrame:
    return readers.first_rows(t.part, 50, ["p_name", "p_partkey"]).select("p_partkey", "p_name")


@query("resolved_column", "SELECT p_partkey AS id, p_name AS title FROM part")
def resolved_column(t: Tables) -> DataFrame:
    return t.part.select(F.col(readers.resolve(t.part, ["id", "doc_id", "p_partkey"])).alias("id"), F.col(readers.resolve(t.part, ["title", "p_name", "name"])).alias("title"))


@query("dictionary_rows", "SELECT p_name AS alias, p_brand AS target FROM part WHERE p_partkey % 3 > 0")
def dictionary_rows(t: Tables) -> DataFrame:
    raw = t.part.select(F.when(F.col("p_partkey") % 3 > 0, F.concat(F.lit(" "), "p_name")).alias("\ufeff Alias"), F.lit(None).cast("string").alias("TARGET"), F.concat("p_brand", F.lit(" ")).alias("canon_inn"))
    return readers.named(raw, {"alias": ["alias", "src"], "target": ["target", "canon", "canon_inn", "inn"]})


@query("sized_vectors", "SELECT vec_id, len(embedding) AS n FROM embeddings")
def sized_vectors(t: Tables) -> DataFrame:
    return readers.sized(t.embeddings, "embedding", 64).select("vec_id", F.size("embedding").cast("long").alias("n"))


@query("event_props", "SELECT event_type, count(*) AS n, count(props) AS with_props, count(DISTINCT user_id) AS users, round(sum(value), 4) AS total FROM events GROUP BY 1")
def event_props(t: Tables) -> DataFrame:
    return t.events.groupBy("event_type").agg(F.count("*").alias("n"), F.count("props").alias("with_props"), F.count_distinct("user_id").alias("users"), F.round(F.sum("value"), 4).alias("total"))


@query("region_orders", "SELECT r_name, c_mktsegment, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2")
def region_orders(t: Tables) -> DataFrame:
    c = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select("c_custkey", "c_mktsegment", "r_name")
    return t.orders.select("o_custkey", "o_totalprice").join(c, F.col("o_custkey") == F.col("c_custkey")).groupBy("r_name", "c_mktsegment").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query(
    "phrase_list_lines",
    "SELECT CASE p_partkey % 5 WHEN 4 THEN '*' ELSE p_type END AS condition, CASE p_partkey % 5 WHEN 0 THEN 'trigger' WHEN 1 THEN 'positive' ELSE 'penalty' END AS kind, p_name AS phrase FROM part WHERE p_partkey % 5 <> 3 AND p_partkey % 7 <> 0",
)
def phrase_list_lines(t: Tables) -> DataFrame:
    k = F.col("p_partkey")
    name = F.when(k % 5 == 0, "x_trigger.txt").when(k % 5 == 1, "x_positive.txt").when(k % 5 == 2, "x_penalty.txt").when(k % 5 == 3, "x_notes.txt").otherwise("penalty_general.txt")
    line = F.when(k % 7 == 0, F.when(k % 2 == 0, "  ").otherwise("# note")).otherwise(F.concat(F.lit(' "'), "p_name", F.lit("'  ")))
    return readers.parsed_phrases(t.part.select(line.alias("value"), F.concat_ws("/", F.lit("file:///dicts"), "p_type", name).alias("path")))


@query("term_lines", "SELECT DISTINCT unnest([p_name, p_type]) AS term FROM part WHERE p_partkey % 3 <> 0")
def term_lines(t: Tables) -> DataFrame:
    line = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("#"), "p_brand")).otherwise(F.concat_ws(" / ", "p_name", "p_type", F.lit("")))
    return readers.parsed_terms(t.part.select(line.alias("value")))


@query(
    "run_log_rows",
    "SELECT l_orderkey::VARCHAR AS query_id, CASE WHEN l_orderkey % 2 = 0 THEN l_linenumber + 10 ELSE CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity) AS INTEGER) END AS rank, l_partkey::VARCHAR AS doc_id, l_quantity AS score, l_linenumber = 1 AS violation FROM lineitem",
)
def run_log_rows(t: Tables) -> DataFrame:
    own = t.lineitem.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_quantity"))).alias("x"))
    even = F.col("l_orderkey") % 2 == 0
    item = F.transform("x", lambda x: F.struct(x["l_partkey"].cast("string").alias("doc_id"), F.when(even, (x["l_linenumber"] + 10).cast("int")).alias("rank"), x["l_quantity"].alias("score"), (x["l_linenumber"] == 1).alias("violation")))
    line = F.when(even, F.to_json(F.struct(F.col("l_orderkey").cast("string").alias("query_id"), item.alias("topk")))).otherwise(F.to_json(F.struct(F.col("l_orderkey").cast("string").alias("query_id"), item.alias("final"), F.array().cast(readers._RUN_ITEM).alias("topk"))))
    return readers.parsed_runs(own.select(F.from_json(line, readers.RUN_LOG).alias("j")).select("j.*"))
