"""Chunkers: text to (…, chunk_ord, chunk) rows. Windows are column expressions; stateful packing runs in Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx


def word_windows(df: DataFrame, key: list[str], text: str, size: int = 1200, overlap: int = 200) -> DataFrame:
    """Windows of ``size`` words every max(1, size - overlap); windows that only repeat the overlap are kept."""
    step = max(1, size - overlap)
    words = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), r"\s+"), lambda w: w != "")
    rows = df.select(*key, words.alias("_w")).filter(F.size("_w") > 0)
    rows = rows.select(*key, "_w", F.posexplode(F.sequence(F.lit(0), F.size("_w") - 1, F.lit(step))).alias("chunk_ord", "_at"))
    return rows.select(*key, "chunk_ord", F.array_join(F.slice("_w", F.col("_at") + 1, F.lit(size)), " ").alias("chunk"))


def token_blocks(df: DataFrame, key: list[str], text: str, size: int = 128) -> DataFrame:
    """Blocks of ``size`` normalised tokens without overlap."""
    rows = df.select(*key, tx.tokenize(F.col(text)).alias("_w")).filter(F.size("_w") > 0)
    rows = rows.select(*key, "_w", F.posexplode(F.sequence(F.lit(0), F.size("_w") - 1, F.lit(size))).alias("chunk_ord", "_at"))
    return rows.select(*key, "chunk_ord", F.array_join(F.slice("_w", F.col("_at") + 1, F.lit(size)), " ").alias("chunk"))


def section_chunks(df: DataFrame, key: list[str], text: str, headers: list[tuple[str, str]], default: str = "general") -> DataFrame:
    """(key…, section_no, section, chunk): sentences grouped under the header (name, pattern) that last began one."""
    from pyspark.sql import Window

    rows = df.select(*key, F.posexplode(tx.sentences(F.col(text))).alias("n", "s"))
    name, body = F.lit(None).cast("string"), F.col("s")
    for label, pattern in reversed(headers):
        hit = F.rlike(F.col("s"), F.lit(pattern))
        name, body = F.when(hit, label).otherwise(name), F.when(hit, F.trim(F.regexp_replace("s", pattern, ""))).otherwise(body)
    rows = rows.withColumn("_h", name).withColumn("s", body)
    w = Window.partitionBy(*key).orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("section_no", F.sum(F.when(F.col("_h").isNotNull(), 1).otherwise(0)).over(w)).withColumn("section", F.coalesce(F.last("_h", ignorenulls=True).over(w), F.lit(default)))
    parts = rows.filter("s <> ''").groupBy(*key, "section_no", "section").agg(F.array_sort(F.collect_list(F.struct("n", "s"))).alias("p"))
    return parts.select(*key, "section_no", "section", F.array_join(F.transform("p", lambda x: x["s"]), " ").alias("chunk"))


def char_chunks_of(text: str, size: int = 800) -> Iterator[str]:
    """Pieces of at most ``size`` characters, cut at the last space where there is one; always advances."""
    at = 0
    while at < len(text):
        end = min(at + size, len(text))
        if end < len(text):
            space = text.rfind(" ", at + 1, end)
            end = space if space > at else end
        piece = text[at:end].strip()
        if piece:
            yield piece
        at = end


def packed_sentences_of(text: str, most: int = 256, overlap: int = 32, least_chars: int = 60, count: Callable[[str], int] | None = None) -> Iterator[str]:
    """Sentences packed greedily up to ``most`` tokens, each chunk beginning with the tail of the last; no sentence is lost.

    Without a tokenizer a token counts as four characters. A sentence longer than a chunk is cut by words. A chunk has
    ``least_chars`` characters: a shorter one is held until the next sentence makes it long enough (it may then exceed ``most``
    by that sentence), and what is left at the end joins the chunk before; a text that is shorter itself gives none.
    """
    count = count or (lambda s: max(1, len(s) // 4))
    held: list[str] = []
    size = 0

    def tail() -> tuple[list[str], int]:
        kept, n = [], 0
        for s in reversed(held):
            if n + count(s) > overlap:
                break
            kept.insert(0, s)
            n += count(s)
        return kept, n

    waiting = None  # the last chunk, held back as what follows may be too short for one of its own
    new = 0  # sentences of ``held`` that no chunk has yet
    for sentence in (s for s in re.split(r"(?<=[.!?…])\s+|\n+", text) if s.strip()):
        pieces, n = [sentence.strip()], count(sentence.strip())
        if n > most:
            pieces, part = [], []
            for word in sentence.split():
                if part and count(" ".join([*part, word])) > most:
                    pieces.append(" ".join(part))
                    part = []
                part.append(word)
            pieces.append(" ".join(part))
        for piece in pieces:
            n = count(piece)
            if held and size + n > most and len(" ".join(held)) >= least_chars:
                if waiting is not None:
                    yield waiting
                waiting = " ".join(held)
                held, size = tail()
                if size + n > most:
                    held, size = [], 0
                new = 0
            held.append(piece)
            size += n
            new += 1
    if new and len(" ".join(held)) >= least_chars:
        if waiting is not None:
            yield waiting
        waiting = " ".join(held)
    elif new and waiting is not None:
        waiting = " ".join([waiting, *held[-new:]])
    if waiting is not None:
        yield waiting


def by_function(df: DataFrame, key: str, text: str, chunks: Callable[[str], Iterator[str]]) -> DataFrame:
    """(key, chunk_ord, chunk) by a Python chunker, a text at a time within Arrow batches."""
    schema = pa.schema([("key", pa.int64()), ("chunk_ord", pa.int32()), ("chunk", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                keys, orders, out = [], [], []
                some = batch.slice(lo, 256)
                for k, t in zip(some.column(0).to_pylist(), some.column(1).to_pylist()):
                    for i, c in enumerate(chunks(t or "")):
                        keys.append(k)
                        orders.append(i)
                        out.append(c)
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(orders, pa.int32()), pa.array(out, pa.string())], schema=schema)

    return df.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).mapInArrow(run, "key long, chunk_ord int, chunk string")


#: A private-use character that stands for a hidden space.
HIDDEN = "\ue000"


def protected(phrases: list[str], chunks: Callable[[str], Iterator[str]]) -> Callable[[str], Iterator[str]]:
    """Keeps phrases whole through a chunker: as whole words their inner spaces are hidden, longest phrase first, and restored as
    they were."""
    if not phrases:
        return chunks
    pattern = re.compile(r"\b(?:" + "|".join(re.escape(p) for p in sorted(phrases, key=len, reverse=True)) + r")\b", re.I)

    def run(text: str) -> Iterator[str]:
        for c in chunks(pattern.sub(lambda m: m[0].replace(" ", HIDDEN), text)):
            yield c.replace(HIDDEN, " ")

    return run


def token_windows(encode: Callable[[str], list], decode: Callable[[list], str], size: int = 256, overlap: int = 32) -> Callable[[str], Iterator[str]]:
    """Windows over any tokenizer's tokens."""

    def run(text: str) -> Iterator[str]:
        ids = encode(text)
        step = max(1, size - overlap)
        for at in range(0, max(1, len(ids)), step):
            if ids[at : at + size]:
                yield decode(ids[at : at + size])
            if at + size >= len(ids):
                break

    return run
