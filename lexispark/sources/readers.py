"""Readers of query files, dictionaries, phrase lists and prediction logs. Only Spark reads paths, so any store works."""

from __future__ import annotations

import io
import json
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Names under which files keep a query's text, its id and its result lists (fixed values).
QUERY_FIELDS, ID_FIELDS = ("query", "q", "text", "question"), ("id", "qid", "query_id")
RESULT_FIELDS = ("pred_ids", "doc_ids", "candidates", "results", "hits", "passages", "final", "topk")


def table(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """Parquet, CSV (with header) or JSON lines by suffix; only ``columns`` where given."""
    low = path.lower().rstrip("/")
    if low.endswith((".csv", ".tsv")):
        df = spark.read.option("header", True).option("sep", "\t" if low.endswith(".tsv") else ",").csv(path)
    elif low.endswith((".json", ".jsonl")):
        df = spark.read.json(path)
    else:
        df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def first_rows(df: DataFrame, n: int, order: list[str]) -> DataFrame:
    """The first n rows in an explicit order."""
    return df.orderBy(*order).limit(n)


def queries(spark: SparkSession, path: str, strict: bool = False, lenient: bool = False) -> DataFrame:
    """(id, query, intent) from JSON lines: blank lines are skipped and the text may have any of several names.

    A line that is no JSON is itself the query; ``strict`` makes it an error, ``lenient`` skips it.
    """
    return parsed_queries(spark.read.text(path), strict, lenient)


def parsed_queries(lines: DataFrame, strict: bool = False, lenient: bool = False) -> DataFrame:
    kind = T.StructType([T.StructField(n, T.StringType()) for n in (*ID_FIELDS, *QUERY_FIELDS, "intent")])
    rows = lines.select(F.trim("value").alias("value")).filter("value <> ''")
    j = F.from_json("value", kind, {"mode": "FAILFAST" if strict else "PERMISSIVE"})
    rows = rows.withColumn("j", j).withColumn("ok", F.try_parse_json("value").isNotNull() & F.startswith("value", F.lit("{")))
    text = F.coalesce(*[F.nullif(F.trim(F.col(f"j.{n}")), F.lit("")) for n in QUERY_FIELDS], F.lit(None).cast("string") if lenient else F.when(~F.col("ok"), F.col("value")))
    return rows.select(F.coalesce(*[F.col(f"j.{n}") for n in ID_FIELDS]).alias("id"), text.alias("query"), F.col("j.intent").alias("intent")).filter("query is not null")


def json_lines(spark: SparkSession, path: str, schema: T.StructType, lenient: bool = False) -> DataFrame:
    """JSON lines of a schema; a line that cannot be read is an error, or skipped where ``lenient``."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED" if lenient else "FAILFAST").json(path)


def json_any(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A JSON array or JSON lines, told apart by the first character that is no space."""
    first = spark.read.text(path).filter("trim(value) <> ''").limit(1).collect()
    array = bool(first) and first[0].value.lstrip().startswith("[")
    return spark.read.schema(schema).option("multiLine", array).json(path)


#: Separators that a table file may have, the likeliest first.
SEPARATORS = [",", ";", "\t", "|"]


def sniffed(spark: SparkSession, path: str, sample: int = 20) -> tuple[str, list[str]]:
    """(separator, column names) of a CSV file: the separator that most often and most evenly cuts its first lines."""
    lines = [r.value for r in spark.read.text(path).limit(sample).collect()]
    lines = [x for x in lines if x.strip()]
    if not lines:
        return ",", []

    def fit(sep: str) -> tuple[int, int]:
        counts = [sum(1 for _ in _cells(x, sep)) for x in lines]
        return (counts.count(counts[0]) if counts[0] > 1 else 0, counts[0])

    best = max(SEPARATORS, key=lambda s: (*fit(s), -SEPARATORS.index(s)))
    return best, [c.strip().lstrip("\ufeff") for c in _cells(lines[0], best)]


def _cells(line: str, sep: str):
    import csv

    return next(csv.reader([line], delimiter=sep))


def csv_any(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file of any separator, with its header."""
    sep, _ = sniffed(spark, path)
    return spark.read.option("header", True).option("sep", sep).option("escape", '"').csv(path)


def config(spark: SparkSession, path: str) -> dict:
    """A settings file: YAML where the library is installed, else (or by suffix) JSON. Settings are the driver's, not data."""
    whole = "\n".join(r.value for r in spark.read.text(path, wholetext=True).collect())
    if path.lower().endswith(".json"):
        return json.loads(whole)
    try:
        import yaml
    except ImportError:
        return plain_yaml(whole)
    return yaml.safe_load(whole) or {}


def plain_yaml(text: str) -> dict:
    """The part of YAML that settings use: nested mappings by indentation, lists of scalars, and plain or quoted scalars."""

    def scalar(v: str):
        v = v.strip()
        if v[:1] in "'\"" and v[-1:] == v[:1] and len(v) > 1:
            return v[1:-1]
        low = v.lower()
        if low in ("", "null", "~"):
            return None
        if low in ("true", "false"):
            return low == "true"
        for kind in (int, float):
            try:
                return kind(v)
            except ValueError:
                pass
        return [scalar(x) for x in v[1:-1].split(",") if x.strip()] if v[:1] == "[" and v[-1:] == "]" else v

    lines = [(len(x) - len(x.lstrip()), x.strip()) for x in (re.sub(r"(^|\s)#.*$", "", y) for y in text.splitlines()) if x.strip()]

    def block(at: int, depth: int):
        out = [] if at < len(lines) and lines[at][1].startswith("- ") else {}
        while at < len(lines) and lines[at][0] == depth:
            line = lines[at][1]
            at += 1
            if isinstance(out, list):
                out.append(scalar(line[2:]))
                continue
            m = re.match(r"""("[^"]*"|'[^']*'|[^:]+):(?:\s+(.*))?$""", line)
            if not m:
                raise ValueError(f"cannot read {line!r}")
            key, value = str(scalar(m[1])), m[2]
            if value is None and at < len(lines) and (lines[at][0] > depth or lines[at][0] == depth and lines[at][1].startswith("- ")):
                out[key], at = block(at, lines[at][0])
            else:
                out[key] = scalar(value or "")
        return out, at

    return block(0, lines[0][0])[0] if lines else {}


def resolved(base: str, path: str | None) -> str | None:
    """A path of a settings file: as it stands where absolute or with a scheme, else beside the file."""
    if not path or path.startswith("/") or "://" in path:
        return path
    return f"{base.rsplit('/', 1)[0]}/{path}" if "/" in base else path


def vectors(spark: SparkSession, path: str, ids: str | None = None, dimensions: int | None = None) -> DataFrame:
    """(row, doc_id, embedding) of a vector store: Parquet, or raw matrices (.npy), with the ids of its rows in another matrix
    (.npy), in JSON lines (doc_id or id, in order), or the row numbers themselves.

    A vector of other than ``dimensions`` components, or a number of ids other than of vectors, is an error. Matrices are read
    as whole files, each by one task; a large store is a directory of them, numbered in the order of their names.
    """
    if path.endswith(".parquet"):
        rows = spark.read.parquet(path)
    else:
        rows = matrix(spark, path).withColumnRenamed("values", "embedding")
    if ids is not None:
        named = ids_of(spark, ids)
        n, m = rows.count(), named.count()
        if n != m:
            raise ValueError(f"{n} vectors but {m} ids")
        rows = rows.join(named, "row")
    elif "doc_id" not in rows.columns:
        rows = rows.withColumn("doc_id", F.col("row"))
    if dimensions is not None:
        rows = sized(rows, "embedding", dimensions)
    return rows


def sized(df: DataFrame, vector: str, dimensions: int) -> DataFrame:
    """``df``, whose evaluation fails at the first vector of another size."""
    wrong = F.coalesce(F.size(vector), F.lit(-1)) != dimensions
    return df.withColumn(vector, F.when(wrong, F.raise_error(F.concat(F.lit(f"a vector has not {dimensions} components but "), F.size(vector).cast("string"))).cast(df.schema[vector].dataType)).otherwise(F.col(vector)))


def matrix(spark: SparkSession, path: str, whole: bool = False) -> DataFrame:
    """(row, values) of .npy files: floats, or longs where ``whole``."""
    import numpy as np
    import pyarrow as pa

    kind = np.int64 if whole else np.float32

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npy").load(path).select("path", "content")

    def sizes(batches):
        for batch in batches:
            n = [np.load(io.BytesIO(c.as_py())).shape[0] for c in batch.column("content")]
            yield pa.RecordBatch.from_arrays([batch.column("path").cast(pa.string()), pa.array(n, pa.int64())], names=["path", "n"])

    starts, at = {}, 0
    for r in sorted(files.mapInArrow(sizes, "path string, n long").collect()):  # one row a file
        starts[r.path], at = at, at + r.n

    def rows(batches):
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                a = np.load(io.BytesIO(content.as_py()))
                a = a.reshape(len(a), -1)
                for lo in range(0, len(a), 4096):
                    some = np.ascontiguousarray(a[lo : lo + 4096], dtype=kind)
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1, dtype=np.int32) * some.shape[1]), pa.array(some.ravel()))
                    yield pa.RecordBatch.from_arrays([pa.array(starts[name] + lo + np.arange(len(some))), lists], names=["row", "values"])

    return files.mapInArrow(rows, f"row long, values array<{'bigint' if whole else 'float'}>")


def ids_of(spark: SparkSession, path: str) -> DataFrame:
    """(row, doc_id) from a matrix of ids (.npy) or from JSON lines in order."""
    if path.endswith(".npy"):
        return matrix(spark, path, whole=True).select("row", F.col("values")[0].alias("doc_id"))
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split(F.rtrim("value", F.lit("\n")), "\n")).alias("row", "v"))
    value = F.coalesce(F.get_json_object("v", "$.doc_id"), F.get_json_object("v", "$.id"), F.trim("v"))
    return lines.filter("trim(v) <> ''").select(F.col("row").cast("long").alias("row"), value.try_cast("long").alias("doc_id"))


def dictionary(spark: SparkSession, path: str, names: dict[str, list[str]]) -> DataFrame:
    """A CSV dictionary: headers lower-cased and trimmed (a byte order mark too), each column under the first name it has;
    rows without a first column are dropped, and ``ord`` (from 0, not without gaps) keeps the order of the file.

    The order is that of the file's splits and of the rows within them.
    """
    return named(spark.read.option("header", True).option("mode", "PERMISSIVE").csv(path).withColumn("ord", F.monotonically_increasing_id()), names, ["ord"])


def named(df: DataFrame, names: dict[str, list[str]], keep: list[str] | None = None) -> DataFrame:
    have = {c.strip().lstrip("﻿").strip().lower(): c for c in df.columns if c not in (keep or [])}
    out = []
    for new, options in names.items():
        found = [F.trim(F.col(f"`{have[o]}`").cast("string")) for o in options if o in have]
        out.append((F.coalesce(*found) if found else F.lit(None).cast("string")).alias(new))
    first = next(iter(names))
    return df.select(*out, *(keep or [])).filter(F.coalesce(F.col(first), F.lit("")) != "")


def phrase_lists(spark: SparkSession, root: str) -> DataFrame:
    """(condition, kind, phrase) from <root>/<condition>/<condition>_{trigger,positive,penalty}.txt, and the global penalty
    list as condition *. Quotes are stripped; blank lines and # comments skipped."""
    lines = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt").text(root).select("value", F.col("_metadata.file_path").alias("path"))
    return parsed_phrases(lines)


def parsed_phrases(lines: DataFrame) -> DataFrame:
    """``phrase_lists`` of lines (value, path)."""
    name = F.element_at(F.split("path", "/"), -1)
    general = name == "penalty_general.txt"
    kind = F.regexp_extract(name, r"_(trigger|positive|penalty)\.txt$", 1)
    condition = F.when(general, "*").otherwise(F.element_at(F.split("path", "/"), -2))
    rows = lines.select(condition.alias("condition"), F.when(general, "penalty").otherwise(kind).alias("kind"), F.trim(F.regexp_replace(F.trim("value"), "^[\"']+|[\"']+$", "")).alias("phrase"))
    return rows.filter("kind <> '' and phrase <> '' and not startswith(phrase, '#')")


def terms(spark: SparkSession, path: str) -> DataFrame:
    """(term) of a list file whose lines may hold several terms between slashes."""
    return parsed_terms(spark.read.text(path))


def parsed_terms(lines: DataFrame) -> DataFrame:
    """``terms`` of lines (value)."""
    return lines.select(F.explode(F.split("value", "/")).alias("t")).select(F.trim("t").alias("term")).filter("term <> '' and not startswith(term, '#')").distinct()


#: The lists of results that a run log may have, of which the first counts.
_RUN_ITEM = "array<struct<doc_id: string, rank: int, score: double, violation: boolean>>"
RUN_LOG = f"query_id string, final {_RUN_ITEM}, results {_RUN_ITEM}, topk {_RUN_ITEM}"


def run_logs(spark: SparkSession, root: str) -> DataFrame:
    """(query_id, rank, doc_id, score, violation) of all JSON files below ``root`` that have a list of results."""
    return parsed_runs(spark.read.schema(RUN_LOG).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json*").option("multiLine", True).json(root))


def parsed_runs(rows: DataFrame) -> DataFrame:
    """``run_logs`` of rows of the log's schema; a result without a rank has its place in the list."""
    return rows.select("query_id", F.posexplode(F.coalesce("final", "results", "topk")).alias("pos", "r")).select("query_id", F.coalesce("r.rank", F.col("pos") + 1).alias("rank"), "r.doc_id", "r.score", "r.violation")


def prediction_ids(lines: DataFrame) -> DataFrame:
    """(id, rank, doc_id) from JSON lines in any of several shapes: arrays of ids or of objects with an id."""
    plain = [F.transform(F.from_json(F.get_json_object("value", f"$.{n}"), "array<string>"), lambda x: F.coalesce(F.get_json_object(x, "$.doc_id"), F.get_json_object(x, "$.id"), x)) for n in RESULT_FIELDS]
    ids = F.coalesce(*[F.when(F.size(p) > 0, p) for p in plain])
    key = F.coalesce(*[F.get_json_object("value", f"$.{n}") for n in ID_FIELDS])
    return lines.select(key.alias("id"), F.posexplode(ids).alias("pos", "doc_id")).select("id", (F.col("pos") + 1).alias("rank"), "doc_id")


def resolve(df: DataFrame, options: list[str]) -> str:
    """The first of several names that the table has."""
    for n in options:
        if n in df.columns:
            return n
    raise KeyError(f"none of {options} among {df.columns}")


def repaired_json(text: Column) -> Column:
    """A model's JSON reply: fences stripped, cut after the last closing brace, between the first brace and that."""
    plain = F.regexp_replace(text, r"(?s)^\s*```(?:json)?\s*|\s*```\s*$", "")
    return F.regexp_extract(plain, r"(?s)(\{.*\})", 1)
