"""Row classification and gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import GatePolicy
from ..functions import norms
from ..functions.text import let


def contains_any(c: Column, terms: list[str]) -> Column:
    return let(c, lambda x: F.exists(F.array(*[F.lit(t) for t in terms]), lambda t: F.contains(x, t)))


def first_term(c: Column, terms: list[str]) -> Column:
    """The first of ``terms`` that the text contains, null if none."""
    return let(c, lambda x: F.get(F.filter(F.array(*[F.lit(t) for t in terms]), lambda t: F.contains(x, t)), F.lit(0)))


def flags(df: DataFrame, text: str, families: dict[str, list[str]], rest: str) -> DataFrame:
    """A boolean per family (one alternation each); ``rest`` is true where none holds."""
    hits = {f: F.rlike(F.coalesce(F.col(text), F.lit("")), F.lit("(?iuU)" + "|".join(f"(?:{p})" for p in patterns))) for f, patterns in families.items()}
    none = ~F.greatest(*hits.values()) if len(hits) > 1 else ~next(iter(hits.values()))
    return df.withColumns(hits | {rest: none})


def first_type(text: Column, families: dict[str, list[str]], default: str) -> Column:
    """Name of the first family with a match."""
    out = None
    for f, patterns in families.items():
        hit = F.rlike(text, F.lit("(?iuU)" + "|".join(f"(?:{p})" for p in patterns)))
        out = F.when(hit, f) if out is None else out.when(hit, f)
    return out.otherwise(F.lit(default))


def drug_like(name: Column, details: list[Column], rejected: list[str], accepted: list[str]) -> Column:
    """False for a rejected name; true with any detail present or an accepted form in the name; else false."""
    n = F.lower(F.coalesce(name, F.lit("")))
    given = F.coalesce(*[F.nullif(F.trim(d), F.lit("")) for d in details]).isNotNull()
    return F.when(contains_any(n, rejected), False).when(given, True).otherwise(contains_any(n, accepted))


def quality(name: Column, body: Column, least: int = 10) -> Column:
    return (F.length(F.trim(F.coalesce(name, F.lit("")))) > 0) & (F.length(F.trim(F.coalesce(body, F.lit("")))) > least)


#: Words that are no substance (fixed values).
NO_NAMES = ["component", "компонент", "ацелюлярний компонент"]
#: Parts of dosage forms that a substance's name does not have (fixed values).
FORM_PARTS = (
    "tablet tablets capsule capsules syrup solution suspension coated prolonged retard mr sr xr for oral inhalation drops powder infusion "
    "таблет капсул сироп розчин суспензі покрит пролонг ретард для пероральн інгаляц крапл порош"
).split()


def valid_name(c: Column, stop: list[str] | None = None) -> Column:
    """At least three characters, not only digits and punctuation, no doubled or leading comma, no stop word."""
    t = F.trim(F.coalesce(c, F.lit("")))
    bad = F.rlike(t, F.lit(r"^[\d,.\s\-/]+$")) | F.contains(t, F.lit(",,")) | F.contains(t, F.lit(", ,")) | F.startswith(t, F.lit(",")) | t.isin(NO_NAMES if stop is None else stop)
    return (F.length(t) >= 3) & ~bad


def latin_name(c: Column, spaces: bool = False, parts: list[str] | None = None) -> Column:
    """Latin letters and hyphens (and spaces) of a substance's name, 2 to 65 of them, without a part of a dosage form."""
    shape = r"^[a-z][a-z\- ]{1,64}$" if spaces else r"^[a-z][a-z\-]{1,64}$"
    return F.coalesce(F.rlike(c, F.lit(shape)) & ~contains_any(c, FORM_PARTS if parts is None else parts), F.lit(False))


def inventory(df: DataFrame, masks: dict[str, tuple[list[str], str, list[str], str | None, str | None]]) -> DataFrame:
    """A boolean per mask (text columns, pattern, form columns, form pattern or None, rejected form pattern or None): the
    pattern occurs in the texts, the form pattern in the forms, and the rejected one does not."""
    joined = lambda names: F.concat_ws(" ", *[F.coalesce(F.col(n), F.lit("")) for n in names if n in df.columns])
    out = {}
    for name, (texts, pattern, forms, form, rejected) in masks.items():
        ok = F.rlike(joined(texts), F.lit(f"(?iuU){pattern}"))
        if form:
            ok = ok & F.rlike(joined(forms), F.lit(f"(?iuU){form}"))
        if rejected:
            ok = ok & ~F.rlike(joined(forms), F.lit(f"(?iuU){rejected}"))
        out[name] = ok
    return df.withColumns(out)


def alias_checks(aliases: DataFrame, alias: str = "alias", target: str = "target", most: int = 48) -> DataFrame:
    """One row: rows, aliases with parentheses, aliases that are too long, targets that look like no substance."""
    a, t = norms.normalize(F.col(alias), "alias"), norms.normalize(F.col(target), "alias")
    return aliases.agg(F.count("*").alias("rows"), F.count_if(F.rlike(a, F.lit("[()]"))).alias("with_parentheses"), F.count_if(F.length(a) > most).alias("too_long"), F.count_if(~latin_name(t, spaces=True)).alias("no_substance"))


def first_term_rows(df: DataFrame, key: str, name: str, text: str, terms: list[str], most: int = 200) -> DataFrame:
    """(key, name, term, snippet) of the rows whose text contains one of the terms, with the first of them."""
    rows = df.withColumn("term", first_term(F.lower(F.coalesce(F.col(text), F.lit(""))), terms)).filter("term is not null")
    return rows.select(key, F.col(name).alias("name"), "term", F.concat(F.left(text, F.lit(most)), F.lit("...")).alias("snippet"))


def in_corpus(hits: DataFrame, docs: DataFrame) -> DataFrame:
    """Hits whose document exists, ranked anew; a list that was built on another corpus may name others."""
    kept = hits.join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    return kept.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("rank", "doc_id")))


def section_gate(hits: DataFrame, policy: GatePolicy, section: str = "section") -> DataFrame:
    """Ranked passages through the gate; ranks are taken anew.

    ``require`` drops other sections, ``prefer_order`` puts good ones first, ``prefer_score`` multiplies their scores.
    """
    good = F.lower(F.trim(F.col(section))).isin([s.lower() for s in policy.sections])
    w = Window.partitionBy("qid")
    if policy.mode == "require":
        return hits.filter(good).withColumn("rank", F.row_number().over(w.orderBy("rank")))
    if policy.mode == "prefer_order":
        return hits.withColumn("rank", F.row_number().over(w.orderBy(F.when(good, 0).otherwise(1), "rank")))
    if policy.mode == "prefer_score":
        scored = hits.withColumn("score", F.col("score") * F.when(good, policy.factor).otherwise(1.0))
        return scored.withColumn("rank", F.row_number().over(w.orderBy(F.round("score", 6).desc(), "doc_id")))
    return hits


def doc_prefilter(passages: DataFrame, top_docs: DataFrame, sources: list[str] | None = None) -> DataFrame:
    """Passages of each query's own best documents; with ``sources`` only the lists of these are restricted, others pass whole."""
    if sources is not None:
        listed = F.col("source").isin(sources)
        return doc_prefilter(passages.filter(listed), top_docs).unionByName(passages.filter(~listed))
    return passages.join(top_docs.select("qid", "doc_id").distinct(), ["qid", "doc_id"], "left_semi")


def with_fallback(hits: DataFrame, keep: Column, least: int) -> DataFrame:
    """Applies a filter to the queries that keep at least ``least`` rows by it; the others stay as they are."""
    left = F.count_if(keep).over(Window.partitionBy("qid"))
    return hits.withColumn("_left", left).filter((F.col("_left") < least) | keep).drop("_left")


def subsets(query: Column, patterns: dict[str, list[str]], simple: list[str], complex_: list[str]) -> dict[str, Column]:
    """A boolean per subset, and complexity: simple before complex before moderate."""
    q = F.lower(F.coalesce(query, F.lit("")))
    level = F.when(contains_any(q, simple), "simple").when(contains_any(q, complex_), "complex").otherwise("moderate")
    return {k: contains_any(q, v) for k, v in patterns.items()} | {"complexity": level}
