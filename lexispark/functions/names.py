"""Product and substance names: variants, short aliases, canonical substance and key. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as tx

#: Entries up to which a dictionary is a literal map; a larger one belongs in a join (``operators.curation.repaired``).
MOST_ENTRIES = 10_000


def literal_map(table: dict[str, str]) -> Column:
    if len(table) > MOST_ENTRIES:
        raise ValueError(f"more than {MOST_ENTRIES} entries: join a table instead")
    if not table:
        return F.create_map().cast("map<string,string>")
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])


def variants(name: Column) -> Column:
    """Distinct non-blank forms: normalised, without what stands in parentheses, letters and digits only."""
    n = tx.name_norm(name)
    bare = tx.name_norm(F.regexp_replace(F.coalesce(name, F.lit("")), r"\([^)]*\)", " "))
    plain = F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), r"[^\p{L}\p{N}]+", "")
    return F.array_distinct(F.filter(F.array(n, bare, plain), lambda x: x != ""))


def short_alias(name: Column, forms: list[str]) -> Column:
    """The name up to a parenthesis, without dosage form words."""
    head = tx.squeeze(F.split_part(F.lower(F.coalesce(name, F.lit(""))), F.lit("("), F.lit(1)))
    return F.array_join(F.filter(F.split(head, " "), lambda w: ~w.isin(forms)), " ")


def bracket_name(name: Column, known: dict[str, str] | None = None) -> Column:
    """What stands in the first parentheses, cleaned; else the table's entry for the name; else null."""
    inner = tx.squeeze(F.regexp_replace(F.lower(F.regexp_extract(F.coalesce(name, F.lit("")), r"\(([^)]+)\)", 1)), r"[^\p{L}\s-]+", " "))
    return F.coalesce(F.nullif(inner, F.lit("")), F.element_at(literal_map(known), tx.name_norm(name)) if known else F.lit(None).cast("string"))


def canonical_inn(name: Column, composition: Column, aliases: dict[str, str]) -> Column:
    """The substance: by the whole name, else by the composition's first word (itself if it looks Latin), else by the first
    part of the name that the table has or that looks Latin."""
    table = literal_map(aliases)
    look = lambda k: F.try_element_at(table, k)
    n = tx.name_norm(name)
    word = F.nullif(F.regexp_extract(tx.name_norm(composition), r"^([a-zA-Zа-яіїєґ\-]+)", 1), F.lit(""))
    latin = lambda w: F.when(F.rlike(w, F.lit("^[a-z]{3,}")), w)
    parts = F.filter(F.transform(F.split(n, r"[\s\-–—/]+"), lambda p: F.coalesce(look(p), latin(p))), lambda x: x.isNotNull())
    return F.coalesce(look(n), look(word), latin(word), F.get(parts, F.lit(0)))


def canonical_key(name: Column, composition: Column, form: Column, group: Column, aliases: dict[str, str], mode: str = "inn_route") -> Column:
    """``doc``: the normalised name; ``inn``: the substance, else the name; ``inn_route``: that and the route, or generic."""
    n = tx.name_norm(name)
    if mode == "doc":
        return n
    inn = F.coalesce(canonical_inn(name, composition, aliases), n)
    return inn if mode == "inn" else F.concat_ws("|", inn, F.coalesce(tx.route(name, form, group), F.lit("generic")))


def substances(composition: Column, least: int = 4) -> Column:
    """Distinct substance names of a composition: pieces between , ; / + and dashes, normalised, of at least ``least`` letters."""
    pieces = F.transform(F.split(F.coalesce(composition, F.lit("")), r"[;,/+−–-]"), lambda p: tx.squeeze(F.regexp_replace(F.lower(p), r"[^\p{L}\s]+", " ")))
    return F.array_distinct(F.filter(pieces, lambda p: F.length(p) >= least))
