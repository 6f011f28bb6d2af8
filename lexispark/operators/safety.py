"""Rule-based safety of a text of contraindications against a user profile; all expressions stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import UserProfile
from ..functions.text import let

#: Patterns by category, in the order in which they are tried, and the category's risk weight (fixed values).
PATTERNS: dict[str, list[str]] = {
    "age_restrictions": [r"діти до (\d+) років?", r"не застосовувати у дітей", r"протипоказано дітям", r"віком до (\d+)", r"особам старше (\d+) років", r"старше (\d+) років"],
    "pregnancy_restrictions": [r"вагітн\w+", r"період вагітності", r"протипоказано при вагітності", r"не застосовувати вагітним"],
    "breastfeeding_restrictions": [r"годуван\w+ грудд(ю|і)", r"лактац\w+", r"період лактації"],
    "chronic_conditions": [r"серцева недостатність", r"печінкова недостатність", r"ниркова недостатність", r"цукровий діабет", r"артеріальна гіпертензія", r"бронхіальна астма"],
    "allergy_hypersensitivity": [r"гіперчутлив\w+", r"алергічн\w+ реакці\w+", r"алергія на [\w\s-]+"],
}
WEIGHTS = {"age_restrictions": 10, "pregnancy_restrictions": 10, "breastfeeding_restrictions": 8, "chronic_conditions": 6, "allergy_hypersensitivity": 9}
#: Keywords that give a warning of their own.
WARNINGS = ["вагітн", "лактац", "дітям", "дітей", "алкогол", "печінков", "ниркова"]


def _found(text: Column, patterns: list[str]) -> Column:
    """All matches of the first pattern that has any."""
    none = F.array().cast("array<string>")
    found = [let(F.regexp_extract_all(text, F.lit(f"(?iuU){p}"), F.lit(0)), lambda f: F.when(F.size(f) > 0, f)) for p in patterns]
    return F.coalesce(*found, none)


def _conflict(category: str, match: Column, profile: UserProfile) -> Column:
    no = F.lit(False)
    if category == "age_restrictions":
        if profile.age is None:
            return no
        n = F.nullif(F.regexp_extract(match, r"(\d+)", 1), F.lit("")).cast("int")
        under, over = F.lit(profile.age) < n, F.lit(profile.age) > n
        return F.coalesce(F.when(F.contains(match, F.lit("до")), under).when(F.contains(match, F.lit("старше")), over).otherwise(under), no)
    if category == "pregnancy_restrictions":
        return F.lit(profile.pregnancy)
    if category == "breastfeeding_restrictions":
        return F.lit(profile.breastfeeding)
    words = profile.chronic_conditions if category == "chronic_conditions" else profile.allergies
    return F.exists(F.array(*[F.lit(w.lower()) for w in words]), lambda w: F.contains(match, w)) if words else no


def _conflict_in(category: str, profile: UserProfile):
    return lambda match: _conflict(category, match, profile)


def _matches(df: DataFrame, text: str) -> DataFrame:
    """Adds the matches of each category, which do not depend on a profile."""
    low = df.withColumn("_low", F.lower(F.coalesce(F.col(text), F.lit(""))))
    return low.withColumns({f"_{c}": _found(F.col("_low"), patterns) for c, patterns in PATTERNS.items()}).drop("_low")


def _assessment(profile: UserProfile) -> dict[str, Column]:
    """The columns that ``assess`` adds, from the matches."""
    hits = {c: F.exists(F.col(f"_{c}"), _conflict_in(c, profile)) for c in PATTERNS}
    score = sum((F.when(h, WEIGHTS[c]).otherwise(0) for c, h in hits.items()), F.lit(0))
    grave = None
    for c, h in hits.items():
        if WEIGHTS[c] >= 8:
            grave = h if grave is None else grave | h

    def listed(conflict: bool) -> Column:
        def of(c: str) -> Column:
            some = F.filter(F.col(f"_{c}"), lambda m: _conflict(c, m, profile) if conflict else ~_conflict(c, m, profile))
            return F.transform(some, lambda m: F.struct(F.lit(c).alias("category"), m.alias("matched_text"), F.lit(WEIGHTS[c]).alias("weight")))

        return F.concat(*[of(c) for c in PATTERNS])

    level = F.when(score >= 15, "CRITICAL").when(score >= 8, "HIGH").when(score >= 3, "MEDIUM").otherwise("LOW")
    return {"risk_score": score, "risk_level": level, "safe_to_use": ~(grave | (score >= 15)), "warnings": listed(False), "critical_warnings": listed(True)}


def assess(df: DataFrame, text: str, profile: UserProfile | None = None) -> DataFrame:
    """Adds risk_score, risk_level, safe_to_use, warnings and critical_warnings (category, matched_text, weight).

    A category counts once; the level is CRITICAL from 15, HIGH from 8, MEDIUM from 3. Unsafe: a conflict of weight 8 or more,
    or CRITICAL.
    """
    return _matches(df, text).withColumns(_assessment(profile or UserProfile())).drop(*[f"_{c}" for c in PATTERNS])


def assess_each(df: DataFrame, text: str, profiles: dict[str, UserProfile], by: str = "qid") -> DataFrame:
    """``assess`` for several profiles: a row for each row and profile, named in ``by``. The text is searched once."""
    each = [F.struct(F.lit(name).alias(by), *[c.alias(k) for k, c in _assessment(p).items()]) for name, p in profiles.items()]
    return _matches(df, text).select(*df.columns, F.explode(F.array(*each)).alias("_a")).select(*df.columns, "_a.*")


#: Ranks that one task numbers at a time.
RANKS = 1 << 16


def filter_safe(assessed: DataFrame, by: str = "qid", ranks: int = RANKS) -> DataFrame:
    """Drops unsafe rows of level HIGH and CRITICAL; the others by ascending risk, then as they were ranked.

    Rows are numbered within slices of ``ranks`` ranks of one risk, and the slices are summed up, so a query's rows are the work
    of many tasks.
    """
    kept = assessed.filter(F.col("safe_to_use") | F.col("risk_level").isin("LOW", "MEDIUM")).withColumn("_slice", F.floor(F.col("rank") / ranks))
    keys = [by, "risk_score", "_slice"]
    before = Window.partitionBy(by).orderBy("risk_score", "_slice").rowsBetween(Window.unboundedPreceding, -1)
    base = kept.groupBy(*keys).agg(F.count("*").alias("_c")).withColumn("_base", F.coalesce(F.sum("_c").over(before), F.lit(0))).drop("_c")
    own = kept.withColumn("_in", F.row_number().over(Window.partitionBy(*keys).orderBy("rank")))
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    both = own.alias("a").join(base.alias("b"), same)
    return both.select(*[F.col(f"a.`{c}`") for c in assessed.columns], (F.col("_base") + F.col("_in")).cast("int").alias("safe_rank"))


def keyword_warnings(text: Column, keywords: list[str] | None = None) -> Column:
    t = F.lower(F.coalesce(text, F.lit("")))
    return let(t, lambda x: F.filter(F.array(*[F.lit(k) for k in (keywords or WARNINGS)]), lambda k: F.contains(x, k)))
