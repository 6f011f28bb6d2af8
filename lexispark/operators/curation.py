"""Joins that keep dictionaries and query sets in order: upserts, merges, lookups with fallbacks, resuming, splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import norms
from ..functions import text as tx
from . import substrings
from .scores import numbered


def upsert(base: DataFrame, patch: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Rows of both by key; the patch wins. ``change`` tells added, replaced and kept rows apart."""
    p = patch.select(*keys, *[F.col(v).alias(f"_p_{v}") for v in values]).dropDuplicates(keys).withColumn("_p", F.lit(True))
    b = base.select(*keys, *values).withColumn("_b", F.lit(True))
    both = b.join(p, keys, "full")
    change = F.when(F.col("_p").isNull(), "kept").when(F.col("_b").isNull(), "added").otherwise("replaced")
    return both.select(*keys, *[F.when(F.col("_p").isNotNull(), F.col(f"_p_{v}")).otherwise(F.col(v)).alias(v) for v in values], change.alias("change"))


def merge_report(base: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value, status): base wins; status is base, added, same or conflict."""
    b = base.select(F.col(key).alias("key"), F.col(value).alias("b"))
    n = new.select(F.col(key).alias("key"), F.col(value).alias("n"))
    s = F.when(F.col("n").isNull(), "base").when(F.col("b").isNull(), "added").when(F.col("b") == F.col("n"), "same").otherwise("conflict")
    return b.join(n, "key", "full").select("key", F.coalesce("b", "n").alias("value"), s.alias("status"))


def repaired(rows: DataFrame, table: DataFrame, keys: list[Column], lookup: str, target: str, out: str) -> DataFrame:
    """Looks up each key expression in turn and takes the first that the table has."""
    for i, k in enumerate(keys):
        t = table.select(F.col(lookup).alias(f"_k{i}"), F.col(target).alias(f"_t{i}")).dropDuplicates([f"_k{i}"])
        rows = rows.withColumn(f"_q{i}", k).join(t, F.col(f"_q{i}") == F.col(f"_k{i}"), "left").drop(f"_k{i}", f"_q{i}")
    found = [f"_t{i}" for i in range(len(keys))]
    return rows.withColumn(out, F.coalesce(*found)).drop(*found)


def remaining(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not among those done."""
    return rows.join(done.select(key).distinct(), key, "left_anti")


def exact_or_contains(names: DataFrame, titles: DataFrame, name: str, title: str, target: str, least: int = 4, few: int = substrings.FEW) -> DataFrame:
    """(name, target): by equal names; a name without any, of ``least`` characters, by titles that contain it."""
    n = names.select(F.lower(F.trim(name)).alias("name")).filter("name <> ''").distinct()
    t = titles.select(F.lower(F.trim(title)).alias("title"), F.col(target).alias("target"))
    exact = n.join(t, n.name == t.title).select("name", "target")
    rest = n.join(exact.select("name").distinct(), "name", "left_anti").filter(F.length("name") >= least)
    loose = substrings.contained(t, "title", rest, "name", few).select("name", "target")
    return exact.unionByName(loose).distinct()


def alias_ids(aliases: DataFrame, names: DataFrame) -> DataFrame:
    """(alias, id) from (alias, target) and (name, id): ids of the name equal to the target, else of every name that contains it."""
    a = aliases.select(tx.name_norm(F.col("alias")).alias("alias"), tx.name_norm(F.col("target")).alias("name")).filter("alias <> '' and name <> ''").distinct()
    found = exact_or_contains(a.select("name"), names.withColumn("title", tx.name_norm(F.col("name"))).drop("name"), "name", "title", "id", least=1)
    return a.join(found, "name").select("alias", F.col("target").alias("id")).distinct()


def matching_names(predicted: DataFrame, gold: DataFrame, few: int = substrings.FEW) -> DataFrame:
    """(p, g) of predicted and gold names, (p, p_name, p_set) and (g, g_name, g_set), that match: equal names, a substance in
    both sets, or one name within the other. Four joins, united; no pair is formed that does not match."""
    p, g = predicted.filter("p_name <> ''"), gold.filter("g_name <> ''")
    equal = p.join(g, p.p_name == g.g_name).select("p", "g")
    side = lambda df, k: df.select(k, F.explode(f"{k}_set").alias("inn")).distinct()
    shared = side(predicted, "p").join(side(gold, "g"), "inn").select("p", "g")
    inside = substrings.contained(p.select("p", "p_name"), "p_name", g.select("g", "g_name"), "g_name", few).select("p", "g")
    around = substrings.contained(g.select("g", "g_name"), "g_name", p.select("p", "p_name"), "p_name", few).select("p", "g")
    return equal.unionByName(shared).unionByName(inside).unionByName(around).distinct()


def hits_by_name(predictions: DataFrame, gold: DataFrame, inns: DataFrame) -> DataFrame:
    """The rows of ``predictions`` (qid, name, …) that match a gold name (qid, name) of their query: equal, with a substance in
    common, or one within the other. ``inns`` is (name, inns) by canonical name; names on both sides are canonical."""
    none = F.array().cast("array<string>")
    p = predictions.join(inns.select("name", F.col("inns").alias("_p")), "name", "left").withColumn("_p", F.coalesce("_p", none)).alias("p")
    g = gold.select("qid", "name").distinct().join(inns.select("name", F.col("inns").alias("_g")), "name", "left").select(F.col("qid").alias("_q"), F.col("name").alias("_n"), F.coalesce("_g", none).alias("_g")).filter("_n <> ''")
    match = (F.col("name") == F.col("_n")) | F.arrays_overlap("_p", "_g") | F.contains("name", F.col("_n")) | F.contains("_n", F.col("name"))
    return p.filter("name <> ''").join(g, (F.col("qid") == F.col("_q")) & match, "left_semi").select(*predictions.columns)


def brand_index(items: DataFrame, name: str, composition: str, unicode: bool = True, **tables) -> DataFrame:
    """(name, inns): canonical names with the substances of all items so named, sorted."""
    rows = items.select(norms.canon_name(F.col(name), unicode, **tables).alias("name"), norms.substance_set(F.col(name), F.col(composition), unicode=unicode, **tables).alias("s")).filter("name <> ''")
    return rows.select("name", F.explode_outer("s").alias("inn")).groupBy("name").agg(F.sort_array(F.collect_set("inn")).alias("inns"))


def by_id_or_text(gold: DataFrame, predictions: DataFrame) -> DataFrame:
    """(id, text, gold, predicted): predictions by id, where there is none by text."""
    by_id = predictions.select("id", F.col("predicted").alias("p1")).dropDuplicates(["id"])
    by_text = predictions.select(F.lower(F.trim("text")).alias("t"), F.col("predicted").alias("p2")).dropDuplicates(["t"])
    g = gold.withColumn("t", F.lower(F.trim("text")))
    return g.join(by_id, "id", "left").join(by_text, "t", "left").select("id", "text", "gold", F.coalesce("p1", "p2").alias("predicted"))


def same_universe(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """One row: ids only in a, only in b, and whether the sets are equal."""
    x, y = a.select(key).distinct().withColumn("in_a", F.lit(1)), b.select(key).distinct().withColumn("in_b", F.lit(1))
    both = x.join(y, key, "full")
    return both.agg(F.count_if(F.col("in_b").isNull()).alias("only_a"), F.count_if(F.col("in_a").isNull()).alias("only_b")).withColumn("equal", (F.col("only_a") == 0) & (F.col("only_b") == 0))


def in_universe(gold: DataFrame, docs: DataFrame, queries: DataFrame, text: str = "text") -> DataFrame:
    """(qid, gold) of the queries with a text and at least one gold id among the documents' ids; the others are left out."""
    known = gold.join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    lists = known.groupBy("qid").agg(F.sort_array(F.collect_set("doc_id")).alias("gold"))
    return queries.filter(F.trim(F.coalesce(F.col(text), F.lit(""))) != "").select("qid").join(lists, "qid")


def stratified_sample(rows: DataFrame, group: str, key: str, target: int, least: int = 5, seed: str = "42") -> DataFrame:
    """Without replacement: groups of at most ``least`` whole, others max(least, min(round(target * share), n)); by seeded MD5."""
    n = rows.groupBy(group).agg(F.count("*").alias("_n"))
    total = n.agg(F.sum("_n").alias("_total"))
    quota = n.join(F.broadcast(total)).withColumn("_quota", F.when(F.col("_n") <= least, F.col("_n")).otherwise(F.greatest(F.lit(least), F.least(F.bround(F.col("_n") * target / F.col("_total")).cast("long"), F.col("_n")))))
    order = F.md5(F.encode(F.concat(F.lit(f"{seed}-"), F.col(key).cast("string")), "UTF-8"))
    ranked = rows.withColumn("_r", F.row_number().over(Window.partitionBy(group).orderBy(order, key)))
    return ranked.join(quota.select(group, "_quota"), group).filter("_r <= _quota").drop("_r", "_quota")


def clamped_sample(rows: DataFrame, group: str, key: str, name: str, low: int, high: int, least: int = 5, seed: str = "42") -> DataFrame:
    """A stratified sample of ``high`` rows with one row of each name; above ``high`` rows it is cut, and below ``low`` filled
    with further rows, by seeded MD5."""
    order = F.md5(F.encode(F.concat(F.lit(f"{seed}-"), F.col(key).cast("string")), "UTF-8"))
    one = Window.partitionBy(name).orderBy(order, key)
    first = lambda df: df.withColumn("_1", F.row_number().over(one)).filter("_1 = 1").drop("_1")
    some = first(stratified_sample(rows, group, key, high, least, seed)).withColumn("_part", F.lit(0))
    rest = rows.join(some.select(key), key, "left_anti").withColumn("_part", F.lit(1))
    n = some.count()
    if n >= low:
        return some.orderBy(order, key).limit(high).drop("_part")
    return first(some.unionByName(rest.orderBy(order, key).limit(low - n)).drop("_part"))


def sample_report(rows: DataFrame, sample: DataFrame, group: str) -> DataFrame:
    """(group, n, sampled, share) of each group."""
    n = rows.groupBy(F.col(group).alias("group")).agg(F.count("*").alias("n"))
    s = sample.groupBy(F.col(group).alias("group")).agg(F.count("*").alias("sampled"))
    return n.join(s, "group", "left").select("group", "n", F.coalesce("sampled", F.lit(0)).alias("sampled"), (F.coalesce("sampled", F.lit(0)) / F.col("n")).alias("share"))


def by_hash(seed: str, key: str) -> Column:
    """A seeded order: the MD5 of seed and key."""
    return F.md5(F.encode(F.concat(F.lit(f"{seed}-"), F.col(key).cast("string")), "UTF-8"))


def ring(groups: DataFrame, group: str, seed: str) -> DataFrame:
    """(group, next): the groups in a seeded ring."""
    g = groups.select(F.col(group).alias("g")).distinct().withColumn("_o", by_hash(seed, "g"))
    n = numbered(g, [], "_o", "g", "i")
    total = n.agg(F.count("*").alias("t"))
    after = n.select(F.col("g").alias("next"), F.col("i").alias("j"))
    return n.join(F.broadcast(total)).withColumn("j", (F.col("i") + 1) % F.col("t")).join(after, "j").select("g", "next")


def hard_negatives(items: DataFrame, key: str, group: str, same: int = 3, other: int = 2, seed: str = "7") -> DataFrame:
    """(key, negative, kind): for each item ``same`` others of its group and ``other`` items of the next group in a ring.

    Items are numbered by a seeded hash within their group (two-level, so a large group is many tasks' work), and the negatives
    are the next ones in the ring: no pairs within a group are formed but those returned.
    """
    i = items.select(F.col(key).alias("key"), F.col(group).alias("g")).withColumn("_o", by_hash(seed, "key"))
    i = numbered(i, ["g"], "_o", "key", "i")
    sizes = i.groupBy("g").agg(F.count("*").alias("n"))
    after = ring(sizes, "g", seed).join(sizes.select(F.col("g").alias("next"), F.col("n").alias("next_n")), "next")
    i = i.join(sizes, "g").join(after, "g")
    a = i.select("key", "g", "n", "i", F.explode(F.sequence(F.lit(1), F.lit(same))).alias("d")).filter("d < n").select("key", "g", ((F.col("i") + F.col("d")) % F.col("n")).alias("i"), F.lit("same").alias("kind"))
    b = i.filter("next <> g").select("key", F.col("next").alias("g"), "next_n", "i", F.explode(F.sequence(F.lit(0), F.lit(other - 1))).alias("d")).filter("d < next_n").select("key", "g", ((F.col("i") + F.col("d")) % F.col("next_n")).alias("i"), F.lit("other").alias("kind"))
    return a.unionByName(b).join(i.select("g", "i", F.col("key").alias("negative")), ["g", "i"]).select("key", "negative", "kind")


def negative_pairs(queries: DataFrame, items: DataFrame, key: str, group: str, text: str, seed: str = "7") -> DataFrame:
    """(qid, query, key, positive, negatives): one row for each distinct query of an item, with the texts of its hard negatives.

    ``queries`` is (key, query); blank and repeated queries of an item are left out. ``qid`` is the MD5 of item and query, so it
    is the same in every run and resuming by it works.
    """
    q = queries.select(F.col(key).alias("key"), F.trim("query").alias("query")).filter("query <> ''").distinct()
    texts = items.select(F.col(key).alias("key"), F.col(text).alias("t"))
    negatives = hard_negatives(items, key, group, seed=seed).join(texts.withColumnRenamed("key", "negative"), "negative")
    lists = negatives.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("kind", "negative", "t"))), lambda x: x["t"]).alias("negatives"))
    qid = F.left(F.md5(F.encode(F.concat_ws("-", F.col("key").cast("string"), "query"), "UTF-8")), F.lit(12))
    return q.join(texts.withColumnRenamed("t", "positive"), "key").join(lists, "key").select(qid.alias("qid"), "query", "key", "positive", "negatives")


def _first_of(hits: DataFrame, keys: list[str], cap: int) -> DataFrame:
    return hits.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy("doc_id"))).filter(F.col("_n") <= cap)


def pattern_gold(queries: DataFrame, docs: DataFrame, patterns: DataFrame, cap: int = 50) -> DataFrame:
    """(qid, doc_id): documents whose name matches a pattern of the query's topic, at most ``cap`` a pattern, by id.

    ``patterns`` is (topic, pattern).
    """
    p = patterns.select("topic", "pattern", F.lower("pattern").alias("_p"))
    hits = substrings.contained(docs.select("doc_id", F.lower("name").alias("_name")), "_name", p, "_p")
    few = _first_of(hits, ["topic", "pattern"], cap)
    return queries.select("qid", "topic").join(few.select("topic", "doc_id").distinct(), "topic").select("qid", "doc_id").distinct()


def moded_gold(queries: DataFrame, docs: DataFrame, patterns: DataFrame, modes: list[tuple[str, list[str]]], default: str, rejected: list[str], per_pattern: int = 50, most: int = 25, least: int = 3) -> DataFrame:
    """(qid, mode, gold): each query gets the documents of its mode, the first of ``modes`` (mode, words) with a word in it.

    ``patterns`` is (mode, pattern); documents of a rejected name never match, each pattern gives its first ``per_pattern``
    documents by id and a mode its first ``most``; a mode of fewer than ``least`` documents gives its queries no row.
    """
    named = docs.select("doc_id", norms.normalize(F.col("name"), "pattern").alias("_name"))
    if rejected:
        named = named.filter(~F.exists(F.array(*[F.lit(r) for r in rejected]), lambda r: F.contains("_name", r)))
    p = patterns.select("mode", norms.normalize(F.col("pattern"), "pattern").alias("_p")).distinct()
    hits = _first_of(substrings.contained(named, "_name", p, "_p"), ["mode", "_p"], per_pattern).select("mode", "doc_id").distinct()
    lists = _first_of(hits, ["mode"], most).groupBy("mode").agg(F.sort_array(F.collect_list("doc_id")).alias("gold"))
    total = hits.groupBy("mode").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    mode = tx.first_match(norms.normalize(F.col("text"), "pattern"), modes, default)
    return queries.select("qid", mode.alias("mode")).join(lists.join(total.select("mode"), "mode"), "mode").select("qid", "mode", "gold")


def lexicon_gold(docs: DataFrame, terms: DataFrame, columns: list[str], topics: dict[str, str], word_up_to: int = 4) -> DataFrame:
    """(topic, doc_id): documents with a term of the topic in one of the columns; terms of up to ``word_up_to`` characters as
    whole words, longer ones anywhere, shorter than two never. ``terms`` is (directory, term), ``topics`` directory -> topic."""
    t = terms.select(F.try_element_at(F.create_map(*[F.lit(x) for kv in topics.items() for x in kv]), F.col("directory")).alias("topic"), norms.normalize(F.col("term"), "gold").alias("term"))
    t = t.filter("topic is not null and length(term) >= 2").distinct()
    texts = docs.select("doc_id", F.explode(F.array(*[norms.normalize(F.col(c), "gold") for c in columns])).alias("_t"))
    long = substrings.contained(texts, "_t", t.filter(F.length("term") > word_up_to), "term").select("topic", "doc_id")
    words = F.array_distinct(F.split(F.regexp_replace("_t", r"(?U)\W+", " "), " "))
    # a short term of several words is tested as it stands
    short = t.filter(F.length("term") <= word_up_to)
    lone = texts.select("doc_id", F.explode(words).alias("term")).join(substrings.dictionary(short.filter(~F.rlike("term", F.lit(r"(?U)\W")))), "term").select("topic", "doc_id")
    odd = short.filter(F.rlike("term", F.lit(r"(?U)\W")))
    rest = substrings.contained(texts, "_t", odd, "term").filter(F.rlike(F.col("_t"), F.concat(F.lit(r"(?U)\b\Q"), F.col("term"), F.lit(r"\E\b")))).select("topic", "doc_id")
    return long.unionByName(lone).unionByName(rest).distinct()


def template_queries(subjects: DataFrame, templates: list[str], subject: str, most: int, seed: str = "1") -> DataFrame:
    """(subject, query): templates with {} filled, distinct by lower case, at most ``most`` a subject by seeded hash."""
    filled = F.transform(F.array(*[F.lit(t) for t in templates]), lambda t: F.replace(t, F.lit("{}"), F.col(subject)))
    rows = subjects.select(F.col(subject).alias("subject"), F.explode(filled).alias("query")).dropDuplicates(["query"])
    order = F.md5(F.encode(F.concat(F.lit(f"{seed}-"), F.col("query")), "UTF-8"))
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy("subject").orderBy(order))).filter(F.col("_n") <= most).select("subject", "query")


def quota(rows: DataFrame, group: str, per_group: int, total: int, order: list[str]) -> DataFrame:
    """First ``per_group`` rows of each group, and of these the first ``total``."""
    some = rows.withColumn("_n", F.row_number().over(Window.partitionBy(group).orderBy(*order))).filter(F.col("_n") <= per_group).drop("_n")
    return some.orderBy(*order).limit(total)


def refill(pending: DataFrame, synthetic: DataFrame, most: int, key: str = "id") -> DataFrame:
    """Pending rows first, then synthetic ones, ``most`` in all."""
    both = pending.withColumn("_part", F.lit(0)).unionByName(synthetic.withColumn("_part", F.lit(1)))
    return both.orderBy("_part", key).limit(most).drop("_part")


def gold_ids(rows: DataFrame, names: list[str]) -> Column:
    """Gold ids as longs from the first of several array columns that has any; what is no number is dropped."""
    parts = [F.filter(F.transform(F.col(n), lambda x: x.try_cast("bigint")), lambda x: x.isNotNull()) for n in names if n in rows.columns]
    return F.coalesce(*[F.when(F.size(p) > 0, p) for p in parts], F.array().cast("array<bigint>"))


def section_queries(sections: DataFrame, templates: dict[str, list[str]], per_doc: int = 4, total: int = 1000, seed: str = "5") -> DataFrame:
    """(doc_id, section, query): the templates of each section with {} the document's name; at most ``per_doc`` a document by
    seeded hash, ``total`` in all by document."""
    filled = None
    for section, some in templates.items():
        q = F.transform(F.array(*[F.lit(t) for t in some]), lambda t: F.replace(t, F.lit("{}"), F.col("name")))
        filled = F.when(F.col("section") == section, q) if filled is None else filled.when(F.col("section") == section, q)
    rows = sections.select("doc_id", "section", F.explode(filled).alias("query"))
    order = F.md5(F.encode(F.concat(F.lit(f"{seed}-"), F.col("doc_id").cast("string"), F.lit("-"), F.col("query")), "UTF-8"))
    few = rows.withColumn("_n", F.row_number().over(Window.partitionBy("doc_id").orderBy(order, "query"))).filter(F.col("_n") <= per_doc)
    return few.orderBy("doc_id", "_n").limit(total).drop("_n")


def augmented(queries: DataFrame, titles: DataFrame, names: list[str], title: str, target: str, broad: list[str], sizes: bool = False) -> DataFrame:
    """(qid, text, <names>…, unmatched, intent, k): each of the named array columns of names as sorted ids (equal titles, else
    titles that contain the name), the names without any, intent and depth.

    Ids are found once for each distinct list of names, and queries take those of their list. With ``sizes`` the columns are
    the numbers of ids: lists of ids grow with the titles for every query.
    """
    plain = [F.array_sort(F.array_distinct(F.array_compact(F.transform(c, lambda n: F.lower(F.trim(n)))))).alias(f"_{c}") for c in names]
    out, lists = queries.select("qid", "text", *plain), None
    for c in names:
        part = out.select(F.lit(c).alias("list"), F.col(f"_{c}").alias("names"))
        lists = part if lists is None else lists.unionByName(part)
    pairs = lists.distinct().select("list", "names", F.explode("names").alias("name"))
    found = exact_or_contains(pairs.select("name"), titles, "name", title, target)
    ids = F.count_distinct("target").cast("int") if sizes else F.sort_array(F.collect_set("target"))
    lost = F.collect_set(F.when(F.col("target").isNull(), F.col("name")))
    each = pairs.join(found, "name", "left").groupBy("list", "names").agg(ids.alias("ids"), lost.alias("lost"))
    none = F.lit(0) if sizes else F.array().cast("array<bigint>")
    no_name = F.array().cast("array<string>")
    for c in names:
        own = each.filter(F.col("list") == c).select(F.col("names").alias(f"_{c}"), F.col("ids").alias(c), F.col("lost").alias(f"_lost_{c}"))
        out = out.join(own, f"_{c}", "left")
    unmatched = F.array_sort(F.array_distinct(F.concat(*[F.coalesce(f"_lost_{c}", no_name) for c in names])))
    return out.select("qid", "text", *[F.coalesce(F.col(c), none).alias(c) for c in names], unmatched.alias("unmatched"), tx.intent(F.col("text")).alias("intent"), tx.depth_for(F.col("text"), broad).alias("k"))


def generated_queries(items: DataFrame, replies: DataFrame, done: DataFrame, key: str, total: int, least_chars: int = 10) -> DataFrame:
    """(key, query) from stored replies of a language model (key, queries array): blank, short and repeated queries of an item
    out, items already done out, and of the others whole items by key until ``total`` queries are reached.

    The quota counts the queries done before, (key, query); an item whose queries begin below it is kept whole.
    """
    asked = items.select(key).distinct().join(done.select(key).distinct(), key, "left_anti")
    text = F.filter(F.array_distinct(F.transform("queries", lambda q: F.trim(q))), lambda q: F.length(q) >= least_chars)
    rows = replies.join(asked, key, "left_semi").groupBy(key).agg(F.flatten(F.collect_list(text)).alias("q")).select(key, F.array_distinct("q").alias("q")).filter(F.size("q") > 0)
    bins = rows.withColumn("_o", F.lpad(F.conv(F.col(key).cast("string"), 10, 16), 16, "0"))
    before = numbered(bins, [], "_o", key, "_before", digits=12, weight=F.size("q"))
    return before.filter(F.col("_before") + done.count() < total).select(key, F.explode("q").alias("query"))
