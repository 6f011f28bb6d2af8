"""Document composition: blobs, cards and section rows from wide tables, and the passage builder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx


def present(df: DataFrame, names: list[str]) -> list[str]:
    """Those of ``names`` that the table has, in their order."""
    return [n for n in names if n in df.columns]


def first_present(df: DataFrame, names: list[str]) -> str | None:
    return next(iter(present(df, names)), None)


def blob(df: DataFrame, names: list[str], sep: str = " \n", most: int | None = None) -> Column:
    """The non-blank columns, trimmed, in order, joined; at most ``most`` characters."""
    out = F.concat_ws(sep, *[tx.filled(F.col(n).cast("string")) for n in present(df, names)])
    return F.left(out, F.lit(most)) if most else out


def labelled(df: DataFrame, fields: list[tuple[str, str, int | None]], sep: str = "\n") -> Column:
    """"label: value" lines of (label, column, most characters), white space squeezed, blank ones left out."""
    parts = []
    for label, name, most in fields:
        if name in df.columns:
            v = tx.filled(tx.squeeze(F.col(name).cast("string")))
            v = tx.truncated(v, most) if most else v
            parts.append(F.when(v.isNotNull(), F.concat(F.lit(f"{label}: "), v) if label else v))
    return F.concat_ws(sep, *parts)


#: Mark between the parts of a document.
SEP = " [SEP] "


def capped(df: DataFrame, parts: list[tuple[str, int | None]], sep: str = SEP, first: str | None = None) -> Column:
    """The non-blank ones of (column, most characters), trimmed and cut, joined in order; ``first``, where it is filled, leads."""
    order = [p for p in parts if p[0] == first] + [p for p in parts if p[0] != first]
    cut = lambda c, n: F.left(c, F.lit(n)) if n else c
    return F.concat_ws(sep, *[cut(tx.filled(tx.squeeze(F.col(c).cast("string"))), n) for c, n in order if c in df.columns])


def embedding_text(df: DataFrame, name: str, sections: list[str], label: str = "Назва", most: int = 8000) -> Column:
    """"label: name" and "section: value" parts with marks between, at most ``most`` characters and then three dots."""
    own = tx.filled(F.col(name).cast("string"))
    parts = [F.when(own.isNotNull(), F.concat(F.lit(f"{label}: "), own))]
    for c in present(df, sections):
        v = tx.filled(F.col(c).cast("string"))
        parts.append(F.when(v.isNotNull(), F.concat(F.lit(f"{c}: "), v)))
    whole = F.concat_ws(SEP, *parts)
    return F.when(F.length(whole) > most, F.concat(F.left(whole, F.lit(most)), F.lit("..."))).otherwise(whole)


def slim(df: DataFrame, name: str, columns: list[str], prefix: str = "passage: ") -> Column:
    """The name and the columns in one line, the name alone where they are blank, with the prefix once."""
    line = tx.squeeze(F.concat_ws(" ", *[tx.filled(F.col(c).cast("string")) for c in present(df, [name, *columns])]))
    return prefixed(F.coalesce(tx.filled(line), F.col(name)), prefix)


def prefixed(c: Column, prefix: str) -> Column:
    """Puts the prefix before text that lacks it."""
    return F.when(F.startswith(c, F.lit(prefix)), c).otherwise(F.concat(F.lit(prefix), c))


def prefix_mode(mode: str, model: str) -> bool:
    """Whether texts for the model take prefixes: ``e5`` always, ``none`` never, ``auto`` where its name says so."""
    if mode not in ("none", "e5", "auto"):
        raise ValueError(f"unknown prefix mode {mode!r}")
    return mode == "e5" or mode == "auto" and "e5" in model.lower()


def for_model(c: Column, kind: str, mode: str, model: str) -> Column:
    """The text of a ``query`` or ``passage`` as the model wants it."""
    return prefixed(c, f"{kind}: ") if prefix_mode(mode, model) else c


def inn_of(composition: Column, most: int = 100) -> Column:
    """What stands before the first full stop, if it is shorter than ``most`` characters; else null."""
    head = tx.filled(F.split_part(F.coalesce(composition, F.lit("")), F.lit("."), F.lit(1)))
    return F.when(F.length(head) < most, head)


def sections(df: DataFrame, key: list[str], names: list[str]) -> DataFrame:
    """(key..., section_ord, section, text): a row per non-blank section column."""
    some = present(df, names)
    rows = df.select(*key, F.explode(F.array(*[F.struct(F.lit(i).alias("section_ord"), F.lit(n).alias("section"), F.trim(F.col(n).cast("string")).alias("text")) for i, n in enumerate(some)])).alias("s"))
    return rows.select(*key, "s.*").filter("text is not null and text <> ''")


def numbered_passages(chunks: DataFrame, doc: str = "doc_id", order: tuple[str, ...] = ("section_ord", "chunk_ord"), most: int = 100) -> DataFrame:
    """A passage number per document in order, at most ``most`` of them."""
    n = F.row_number().over(Window.partitionBy(doc).orderBy(*order)) - 1
    return chunks.withColumn("passage_id", n).filter(F.col("passage_id") < most)


def smart_truncate(df: DataFrame, most: dict[str, int]) -> tuple[DataFrame, DataFrame]:
    """Cuts columns to their limits; and how many values of each were cut."""
    cut = df.select(*[F.left(F.col(c), F.lit(most[c])).alias(c) if c in most else F.col(c) for c in df.columns])
    counts = df.agg(*[F.count_if(F.length(c) > n).alias(c) for c, n in most.items()]).unpivot([], list(most), "field", "truncated")
    return cut, counts


def shaped(hits: DataFrame, docs: DataFrame, title: str, text: str, most: int = 300) -> DataFrame:
    """(qid, top): the ranked documents of each query with title and snippet as one array, in rank order."""
    d = docs.select("doc_id", F.col(title).cast("string").alias("title"), F.when(F.length(text) > most, F.concat(F.left(text, F.lit(most)), F.lit("..."))).otherwise(F.col(text)).alias("snippet"))
    rows = hits.join(d, "doc_id").select("qid", F.struct("rank", "doc_id", "score", "title", "snippet").alias("r"))
    return rows.groupBy("qid").agg(F.array_sort(F.collect_list("r")).alias("top"))


def passages(df: DataFrame, key: str, names: list[str], size: int = 120, overlap: int = 20, most_chars: int = 50_000, least_chars: int = 60, most: int = 100) -> DataFrame:
    """(doc_id, section, passage_id, text): the sections cut into word windows, numbered within a document.

    A section is cut at ``most_chars``; a passage shorter than ``least_chars`` stays only if it is its section's first.
    """
    from .chunking import word_windows

    rows = sections(df.withColumnRenamed(key, "doc_id"), ["doc_id"], names).withColumn("text", F.left("text", F.lit(most_chars)))
    parts = word_windows(rows, ["doc_id", "section_ord", "section"], "text", size, overlap).filter((F.length("chunk") >= least_chars) | (F.col("chunk_ord") == 0))
    return numbered_passages(parts, most=most).select("doc_id", "section", "passage_id", F.concat(F.col("section"), F.lit(": "), F.col("chunk")).alias("text"))


def candidate(df: DataFrame, fields: dict[str, tuple[str, int, str]]) -> Column:
    """A struct of new name -> (column, most characters, default where blank); cut values end in three dots."""
    parts = []
    for new, (name, most, default) in fields.items():
        v = tx.filled(F.col(name).cast("string")) if name in df.columns else F.lit(None).cast("string")
        parts.append(F.coalesce(F.when(F.length(v) > most, F.concat(F.left(v, F.lit(most)), F.lit("..."))).otherwise(v), F.lit(default)).alias(new))
    return F.struct(*parts)
