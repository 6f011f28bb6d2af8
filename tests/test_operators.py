"""Operators that SQL does not express, and intake and sinks."""

import json
import math
import os
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexispark.config import SearchConfig
from lexispark.functions import norms
from lexispark.functions import text as tx
from lexispark.operators import chunking, curation, dense, evaluate, lexical, priors, profile, rerank, rewrite, scores, substrings
from lexispark.plans.search import search
from lexispark.sources import readers, writers
from lexispark.streaming.ingest import ingest_available


def test_char_chunks_lose_nothing_and_end():
    text = "word " * 400 + "x" * 2000 + " tail"
    parts = list(chunking.char_chunks_of(text, 300))
    assert "".join("".join(parts).split()) == "".join(text.split())
    assert max(map(len, parts)) <= 300
    assert list(chunking.char_chunks_of(" " * 50)) == []


@pytest.mark.parametrize("most,overlap", [(20, 0), (20, 6), (5, 2)])
def test_packed_sentences_lose_nothing(most, overlap):
    sentences = [f"Sentence number {i} has {'many ' * (i % 7)}words." for i in range(30)]
    parts = list(chunking.packed_sentences_of(" ".join(sentences), most, overlap))
    joined = " ".join(parts)
    for s in sentences:
        assert all(w in joined for w in s.split())
    if most == 20:
        assert all(s in joined for s in sentences if len(s) // 4 <= most)


@pytest.mark.parametrize("least", [1, 60, 200])
def test_packed_chunks_have_their_least_length(least):
    sentences = [f"No {i} {'long ' * (i % 9)}end." for i in range(40)]
    parts = list(chunking.packed_sentences_of(" ".join(sentences), 30, 5, least))
    assert all(len(p) >= least for p in parts) and all(any(s in p for p in parts) for s in sentences)
    assert list(chunking.packed_sentences_of("too short.", 30, 5, 60)) == []


def test_protected_phrases_and_token_windows():
    hidden = chunking.protected(["two words"], lambda t: iter(t.split(" ")))
    assert list(hidden("a Two Words b")) == ["a", "Two Words", "b"]
    assert list(hidden("atwo words two wordsb")) == ["atwo", "words", "two", "wordsb"]
    assert list(chunking.protected([], lambda t: iter([t]))("x")) == ["x"]
    windows = list(chunking.token_windows(str.split, " ".join, 4, 1)("a b c d e f g"))
    assert windows == ["a b c d", "d e f g"]


def test_unicode_functions(spark):
    df = spark.createDataFrame([("ﬁne Ｆull",), (None,)], "t string")
    assert [r[0] for r in df.select(tx.nfkc("t")).collect()] == ["fine Full", None]
    assert spark.createDataFrame([("éàü й",)], "t string").select(tx.strip_accents("t")).first()[0] == "eau и"
    assert spark.createDataFrame([("діарея",), ("діареєю",), ("дім",)], "t string").select(tx.stem(F.col("t"))).collect()[0][0] == "діаре"


def test_phrase_pattern(spark):
    df = spark.createDataFrame([("гостра діарея", "ГОСТРА,  діарея!"), ("гостра діарея", "гостра діареями")], "p string, t string")
    assert [r[0] for r in df.select(F.rlike("t", tx.phrase_pattern(F.col("p")))).collect()] == [True, False]


def test_bm25_arithmetic(spark):
    docs = spark.createDataFrame([(0, "a b a"), (1, "b c"), (2, ""), (3, None)], "doc_id long, text string")
    queries = spark.createDataFrame([(1, "a a"), (2, "zzz"), (3, "")], "item_id long, text string")
    rows = lexical.bm25(docs, queries).collect()
    idf = math.log((4 - 1 + 0.5) / (1 + 0.5) + 1)
    want = 2 * idf * 2 * 2.5 / (2 + 1.5 * (0.25 + 0.75 * 3 / (5 / 4)) + 1e-9)
    assert [(r.qid, r.doc_id) for r in rows] == [(1, 0)] and rows[0].score == pytest.approx(want)
    assert lexical.bm25(docs.limit(0), queries).count() == 0


@pytest.mark.parametrize("step", [lexical.STEP, 300])
def test_both_forms_of_bm25_agree_on_repeats_and_missing_ids(spark, monkeypatch, step):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    odd = [(9000, "діарею та лікування діареєю"), (9001, None), (1, "лікування apple pie"), (1, "apple pie"), (1, "apple pie"), (None, "apple pie pie"), (None, None)]
    docs = docs.unionByName(spark.createDataFrame(odd, "doc_id long, text string"))
    queries = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").unionByName(spark.createDataFrame([(500, "лікування діареї"), (501, ""), (502, "apple pie apple")], "item_id long, text string"))
    rows = lambda df: [(r.qid, r.doc_id, round(r.score, 6), r["rank"]) for r in df.orderBy("qid", "rank").collect()]
    monkeypatch.setattr(lexical, "STEP", step)
    blocked = rows(lexical.bm25_top(docs, queries, 5))
    assert blocked == rows(lexical.bm25_top(docs, queries, 5, most_entries=0)) and any(r[0] == 500 for r in blocked)
    assert [r[1] for r in blocked if r[0] == 502] == [1]


def test_bm25_counts_repeated_rows_as_documents(spark):
    docs = spark.createDataFrame([(1, "apple pie"), (1, "apple pie")], "doc_id long, text string")
    queries = spark.createDataFrame([(7, "apple")], "item_id long, text string")
    idf = math.log((2 - 2 + 0.5) / (2 + 0.5) + 1)
    for most in (0, 100):
        got = lexical.bm25_top(docs, queries, 5, most_entries=most).collect()
        assert [(r.doc_id, r["rank"]) for r in got] == [(1, 1)] and got[0].score == pytest.approx(idf * 2.5 / (1 + 1.5 + 1e-9))


def test_many_queries_in_two_scans(spark):
    docs = spark.createDataFrame([(i, f"w{i} w{i % 50} common") for i in range(400)], "doc_id long, text string")
    queries = spark.createDataFrame([(q, f"w{q % 400} w{q % 50}") for q in range(10_000)], "item_id long, text string")
    top = lexical.bm25_top(docs, queries, 3)
    assert top._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    got = top.groupBy("qid").count().count()
    assert got == 10_000


@pytest.mark.parametrize("few", [20_000, 0])
def test_phrase_hits_of_both_plans(spark, few):
    docs = spark.createDataFrame([(1, "Red, fox runs"), (2, "fox red"), (3, "a red fox; red fox"), (None, None), (4, "redfox")], "doc_id long, text string")
    phrases = spark.createDataFrame([("red fox",), ("fox runs",), ("",)], "phrase string")
    got = sorted(map(tuple, lexical.phrase_hits(docs, phrases, few=few).collect()))
    assert got == [("fox runs", 1), ("red fox", 1), ("red fox", 3)]


@pytest.mark.parametrize("few", [20_000, 0])
def test_contained_against_every_pair(spark, few):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcde é") for _ in range(rng.randint(1, 9)))
    texts = [(i, " ".join(word() for _ in range(rng.randint(0, 12)))) for i in range(150)] + [(900, None), (901, "")]
    needles = [(i, word()) for i in range(120)] + [(500, ""), (501, None), (502, "ab"), (503, "ab")]
    t, n = spark.createDataFrame(texts, "i long, t string"), spark.createDataFrame(needles, "j long, n string")
    got = sorted((r.i, r.j) for r in substrings.contained(t, "t", n, "n", few).collect())
    assert got == sorted((i, j) for i, a in texts for j, b in needles if a and b and b in a) and got


def test_aliases_of_any_length(spark):
    long = "six words make up this alias"
    aliases = spark.createDataFrame([(0, long, "target", "brand"), (1, "this", "other", "brand")], "ord int, alias string, target string, type string")
    q = spark.createDataFrame([(1, f"take Six words make up this alias, please")], "qid long, text string")
    assert sorted(r.alias for r in rewrite.alias_hits(q, aliases).collect()) == [long, "this"]
    symptoms = spark.createDataFrame([("canon", f"x|{long}", "hint")], "canon string, aliases string, intent_hint string")
    assert [r.canon for r in rewrite.symptom_hits(q, symptoms).collect()] == ["canon"]


@pytest.mark.parametrize("few", [20_000, 0])
def test_priors(spark, few):
    rows = [(0, "a_general", 0.1, ["inn_one"], ["Brand"]), (1, "a_basic", 0.2, ["inn one"], []), (2, "x_zeta_x", 0.4, ["two"], None), (3, "y_zeta", 0.8, ["two"], None)]
    p = spark.createDataFrame(rows, "ord int, id string, boost double, inn array<string>, brands_opt array<string>").withColumn("neg_triggers", F.array(F.lit("Stop")))
    conditions = spark.createDataFrame([(1, "a"), (1, "zeta"), (2, "zeta"), (3, "none")], "qid long, condition string")
    got = sorted(map(tuple, priors.lookup(conditions, p, few=few).collect()))
    assert got == [(1, "a", "a_basic"), (1, "zeta", "x_zeta_x"), (2, "zeta", "x_zeta_x")]
    docs = spark.createDataFrame([(10, "has inn one and TWO", "brand plus"), (11, "two", "bran"), (12, "nothing", "zzz")], "doc_id long, text string, name string")
    index = priors.inn_index(docs, spark.createDataFrame([("inn one",), ("two",)], "inn string"), few=few)
    queries = spark.createDataFrame([(1, "ask"), (2, "please STOP")], "qid long, text string")
    hits = spark.createDataFrame([(1, 10, 1.0)], "qid long, doc_id long, score double")
    boosted = sorted((r.qid, r.doc_id, round(r.score, 6)) for r in priors.boosts(hits, queries, p, index, conditions, 10.0).collect())
    assert boosted == [(1, 10, 7.0), (1, 11, 4.0)]
    assert sorted(map(tuple, priors.brand_docs(p, docs, few=few).collect())) == [("a_general", 10), ("a_general", 11)]


def test_numbering_is_that_of_one_window(spark):
    rows = [(k, i, f"{(i * 2654435761) % 2**32:08x}") for k in "ab" for i in range(300)]
    df = spark.createDataFrame(rows, "k string, i long, o string")
    for keys, digits in ((["k"], 1), (["k"], 3), ([], 2)):
        got = {(r.k, r.i): r.n for r in scores.numbered(df, keys, "o", "i", "n", digits).collect()}
        for group in ({("a",), ("b",)} if keys else {("a", "b")}):
            own = sorted((r for r in rows if r[0] in group), key=lambda r: (r[2], r[1]))
            places = sorted((got[r[0], r[1]], r[2], r[1]) for r in own)
            assert [p[0] for p in places] == list(range(len(own))) and places == sorted(places, key=lambda p: p[1])


def test_dense_ties_nulls_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(dense, "QUERY_BLOCK", 1)
    v = spark.createDataFrame([(5, [1.0, 0.0]), (2, [1.0, 0.0]), (7, None), (9, [0.0, 1.0])], "vec_id long, embedding array<float>")
    got = dense.dense_top(v, v.filter("vec_id in (5, 9)").withColumnRenamed("vec_id", "qid"), 2).orderBy("qid", "rank").collect()
    assert [(r.qid, r.doc_id) for r in got] == [(5, 2), (5, 5), (9, 9), (9, 2)]


def test_plugged_scorer(spark):
    df = spark.createDataFrame([("a b", "b a c"), (None, "x")], "q string, d string")

    def load():
        return lambda q, d: pd.Series([float(len(x)) for x in d])

    assert [r.ce for r in rerank.scored_by(df, load, "q", "d").collect()] == [5.0, 1.0]


def test_hard_negatives(spark):
    rows = [(i, f"g{i % 4}") for i in range(40)] + [(100, "alone")]
    got = curation.hard_negatives(spark.createDataFrame(rows, "id long, g string"), "id", "g").collect()
    group = dict(rows)
    for r in got:
        assert r.key != r.negative and (group[r.key] == group[r.negative]) == (r.kind == "same")
    assert sum(r.kind == "same" for r in got) == 120 and len({(r.key, r.negative) for r in got}) == len(got)


def test_search_pipeline(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["cold fever tablets", "fever syrup for a child", "skin cream", "", None])], "doc_id long, text string")
    queries = spark.createDataFrame([(1, "fever child"), (2, "nothing matches")], "qid long, text string")
    lex = spark.createDataFrame([("fever", "trigger", "fever"), ("fever", "penalty", "tablets"), ("fever", "positive", "syrup")], "condition string, kind string, norm string")
    out = search(docs, queries, SearchConfig(final_k=2), lexicon=lex)
    got = out["result"].orderBy("rank").collect()
    assert [(r.qid, r.doc_id) for r in got] == [(1, 1), (1, 0)]
    assert {r.stage for r in out["trace"].select("stage").distinct().collect()} == {"bm25", "fused", "reranked"}
    held = list(out.held)
    assert held and all(df.is_cached for df in held)
    out.close()
    assert not any(df.storageLevel.useMemory for df in held)


def test_readers(spark, tmp_path):
    root = tmp_path / "lex"
    (root / "flu").mkdir(parents=True)
    (root / "flu" / "flu_trigger.txt").write_text('"cold"\n# note\n\nfever\n')
    (root / "flu" / "flu_penalty.txt").write_text("rash\n")
    (root / "penalty_general.txt").write_text("poison\n")
    got = {tuple(r) for r in readers.phrase_lists(spark, str(root)).collect()}
    assert got == {("flu", "trigger", "cold"), ("flu", "trigger", "fever"), ("flu", "penalty", "rash"), ("*", "penalty", "poison")}
    (tmp_path / "d.csv").write_text("﻿SRC , Canon_INN\nBrand,inn1\n,x\n")
    assert [tuple(r) for r in readers.dictionary(spark, str(tmp_path / "d.csv"), {"alias": ["alias", "src"], "target": ["target", "canon_inn"], "type": ["type"]}).collect()] == [("Brand", "inn1", None, 0)]
    (tmp_path / "a.json").write_text(json.dumps([{"id": 1}, {"id": 2}]))
    (tmp_path / "b.json").write_text('{"id": 1}\n{"id": 2}\n')
    for f in ("a.json", "b.json"):
        assert readers.json_any(spark, str(tmp_path / f), T._parse_datatype_string("id int")).count() == 2
    runs = tmp_path / "runs" / "x"
    runs.mkdir(parents=True)
    (runs / "r.json").write_text(json.dumps({"query_id": "q", "topk": [{"doc_id": "d1", "score": 0.5}, {"doc_id": "d2", "violation": True}]}))
    assert [(r.query_id, r.rank, r.doc_id) for r in readers.run_logs(spark, str(tmp_path / "runs")).collect()] == [("q", 1, "d1"), ("q", 2, "d2")]
    reply = spark.createDataFrame([('```json\n{"a": 1} trailing {"b"',)], "t string")
    assert reply.select(readers.repaired_json(F.col("t"))).first()[0] == '{"a": 1}'


def test_sinks_resume(spark, tmp_path):
    path = str(tmp_path / "sink")
    rows = spark.range(10).withColumn("v", F.col("id") * 2)
    assert writers.append_remaining(rows.filter("id < 4"), path, "id") == 4
    assert writers.append_remaining(rows, path, "id") == 6
    assert writers.append_remaining(rows, path, "id") == 0
    assert spark.read.parquet(path).count() == 10
    counts = {r.subset: r.n for r in writers.subsets(rows, {"even": F.col("id") % 2 == 0}, str(tmp_path / "subsets")).collect()}
    assert counts == {"all": 10, "even": 5} and os.path.isdir(tmp_path / "subsets" / "subset=even")
    assert "| 1 | 2 |" in writers.markdown(rows.orderBy("id"), "t")


def test_incremental_ingest(spark, tmp_path):
    source, sink, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    spark.range(5).write.parquet(source)
    ingest_available(spark, source, sink, check, "id")
    spark.range(3, 9).write.mode("append").parquet(source)
    ingest_available(spark, source, sink, check, "id")
    assert sorted(r.id for r in spark.read.parquet(sink).collect()) == list(range(9))


def test_profiles_of_empty_tables(spark):
    empty = spark.createDataFrame([], "a string, b int")
    assert {r.n for r in profile.nulls(empty).collect()} == {0}
    assert profile.preflight(empty, ["a", "c"], "a").first().missing == "c"
    assert profile.lengths(empty, "a").first().n == 0


def test_separators_settings_and_lenient_lines(spark, tmp_path):
    (tmp_path / "semi.csv").write_text('\ufeffName;Note\n"a;b";x, y\nc;d, e\n', encoding="utf-8")
    assert readers.sniffed(spark, str(tmp_path / "semi.csv")) == (";", ["Name", "Note"])
    assert [tuple(r) for r in readers.csv_any(spark, str(tmp_path / "semi.csv")).collect()] == [("a;b", "x, y"), ("c", "d, e")]
    (tmp_path / "empty.csv").write_text("")
    assert readers.sniffed(spark, str(tmp_path / "empty.csv")) == (",", [])
    text = "a: 1\nb:\n  c: 'x # y'  # note\n  d: [1, two]\nlist:\n  - one\n  - 2.5\nflag: True\nnone:\n"
    want = {"a": 1, "b": {"c": "x # y", "d": [1, "two"]}, "list": ["one", 2.5], "flag": True, "none": None}
    assert readers.plain_yaml("") == {} and readers.plain_yaml(text.replace("'x # y'", "x y")) == want | {"b": {"c": "x y", "d": [1, "two"]}}
    (tmp_path / "c.yaml").write_text("aliases_csv: dicts/a.csv\nmost: 5\n")
    cfg = readers.config(spark, str(tmp_path / "c.yaml"))
    assert cfg == {"aliases_csv": "dicts/a.csv", "most": 5} and readers.resolved("/x/c.yaml", cfg["aliases_csv"]) == "/x/dicts/a.csv" and readers.resolved("/x/c.yaml", "/a") == "/a"
    (tmp_path / "l.jsonl").write_text('{"id": 1}\n{"id": \n{"id": 3}\n')
    schema = T._parse_datatype_string("id int")
    assert sorted(r.id for r in readers.json_lines(spark, str(tmp_path / "l.jsonl"), schema, lenient=True).collect()) == [1, 3]
    with pytest.raises(Exception, match="MALFORMED|FAILFAST|parsing"):
        readers.json_lines(spark, str(tmp_path / "l.jsonl"), schema).collect()


def test_vector_stores(spark, tmp_path):
    a = np.arange(24, dtype=np.float32).reshape(8, 3)
    (tmp_path / "v").mkdir()
    np.save(tmp_path / "v" / "part-0.npy", a[:5])
    np.save(tmp_path / "v" / "part-1.npy", a[5:])
    np.save(tmp_path / "ids.npy", 10**12 + np.arange(8))
    (tmp_path / "ids.jsonl").write_text("".join(f'{{"doc_id": {i}}}\n' for i in range(100, 108)))
    for ids, first in ((None, 0), (tmp_path / "ids.npy", 10**12), (tmp_path / "ids.jsonl", 100)):
        rows = readers.vectors(spark, str(tmp_path / "v"), str(ids) if ids else None, 3).orderBy("row").collect()
        assert [r.doc_id for r in rows] == list(range(first, first + 8)) and np.array([r.embedding for r in rows]).tolist() == a.tolist()
    with pytest.raises(Exception, match="components"):
        readers.vectors(spark, str(tmp_path / "v"), None, 4).collect()
    np.save(tmp_path / "few.npy", np.arange(3))
    with pytest.raises(ValueError, match="8 vectors but 3 ids"):
        readers.vectors(spark, str(tmp_path / "v"), str(tmp_path / "few.npy"))


def test_parts_merge_and_appended_lines(spark, tmp_path):
    path, out = str(tmp_path / "parts"), str(tmp_path / "whole")
    rows = spark.range(10).withColumn("v", F.col("id") * 2)
    for n in (0, 1, 0):  # the first part is written again
        writers.part(rows.filter(f"id % 2 = {n}"), path, n)
    writers.merged(spark, path, out, 1)
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == list(range(10)) and len([f for f in os.listdir(out) if f.endswith(".parquet")]) == 1
    lines = str(tmp_path / "lines")
    assert [writers.append_remaining(rows.filter(f"id < {n}"), lines, "id", "json") for n in (4, 7, 7)] == [4, 3, 0]
    assert sorted(r.id for r in spark.read.json(lines).collect()) == list(range(7))
    writers.trace(spark.createDataFrame([(1, "a"), (1, "b")], "qid long, stage string"), str(tmp_path / "trace"), "r1")
    assert os.path.isdir(tmp_path / "trace" / "run_id=r1" / "stage=a")


def test_ingest_without_a_key_replaces_a_batch_that_runs_again(spark, tmp_path):
    source, sink, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    spark.range(5).write.parquet(source)
    ingest_available(spark, source, sink, check, None)
    ingest_available(spark, source, sink, str(tmp_path / "lost"), None)  # the checkpoint is lost: batch 0 again
    assert sorted(r.id for r in spark.read.parquet(sink).collect()) == list(range(5))


def test_names(spark):
    df = spark.createDataFrame([("Нурофен® (Ibuprofen) 200 мг таблетки, Forte",), ("ﬁne Мезим",), (None,), ("",)], "n string")
    assert [r[0] for r in df.select(norms.canon_name(F.col("n"))).collect()] == ["ібупрофен ібупрофен мг", "fine панкреатин", "", ""]
    assert [r[0] for r in df.select(norms.substance_set(F.col("n"), F.lit("Loperamidex; abc/ - Парацетамол 5,0"))).collect()][2] == ["loperamidex", "лоперамід", "парацетамол"]
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(norms.normalize(F.lit("Ａb (c) ½"), "evaluation")) == "ab c 1⁄2"
    assert one(norms.collapsed(F.lit("abcabcabc xyz"), 3)) == "abc xyz"
    assert one(norms.slug(F.lit(" A/b--C_d! "))) == "a-b-c-d"
    assert one(tx.clean_html(F.lit("a<br>b\u00a0™"))) == "a b"


def test_triage_and_replies_of_any_shape(spark):
    queries = spark.createDataFrame([(1, "q1"), (2, "q2")], "qid long, text string")
    replies = spark.createDataFrame([(1, '{"urgency": "emergency", "red_flags": null}')], "qid long, reply string")
    got = {r.qid: r for r in rerank.triage_frames(queries, replies).collect()}
    assert (got[1].urgency, got[1].error, got[1].original_query) == ("emergency", None, "q1") and got[2].error == "missing"


def test_sample_sizes(spark):
    rows = spark.createDataFrame([(i, f"g{i % 7}", f"n{i % 90}") for i in range(300)], "id long, g string, n string")
    assert curation.clamped_sample(rows, "g", "id", "n", 10, 40).count() <= 40
    got = curation.clamped_sample(rows, "g", "id", "n", 200, 50)
    assert got.count() == got.select("n").distinct().count() > 50
    assert curation.clamped_sample(rows.limit(0), "g", "id", "n", 10, 40).count() == 0


def test_bootstrap_of_a_clear_difference(spark):
    pairs = spark.createDataFrame([(i, 0.1, 0.5 + (i % 5) / 10) for i in range(60)], "qid long, a double, b double")
    r = evaluate.paired_bootstrap(pairs, "a", "b", 300).first()
    assert r.n == 60 and r.ci_low < r.delta < r.ci_high and r.ci_low > 0.5 and r.p_tail == 0 and r.p_one == pytest.approx(1 / 301)
    same = evaluate.paired_bootstrap(pairs.withColumn("b", F.col("a") + (F.col("qid") % 2) - 0.5), "a", "b", 300).first()
    assert same.ci_low < 0 < same.ci_high and same.p_tail > 0.2


def broadcast_sides(df):
    """Sides that the plan's hash joins broadcast."""
    import re

    return set(re.findall(r"BroadcastHashJoin .*?(BuildLeft|BuildRight)", df._jdf.queryExecution().executedPlan().toString()))


def dictionary_case(spark):
    texts = spark.range(50).select(F.col("id").alias("qid"), F.concat(F.lit("Take "), F.when(F.col("id") % 2 == 0, "red Fox").otherwise("mg")).alias("text"))
    return texts, spark.createDataFrame([(0, "red fox", "target", "brand"), (1, "red fox", "later", "brand")], "ord int, alias string, target string, type string")


def test_aliases_are_broadcast_not_the_texts(spark):
    texts, aliases = dictionary_case(spark)
    hits = rewrite.alias_hits(texts, aliases)
    assert broadcast_sides(hits) == {"BuildRight"}
    assert sorted(r.qid for r in hits.collect()) == list(range(0, 50, 2)) and {r.target for r in hits.collect()} == {"target"}


def test_a_large_dictionary_broadcasts_no_side(spark):
    texts, aliases = dictionary_case(spark)
    joined = texts.select("qid", F.lower(F.substring("text", 6, 9)).alias("gram")).join(substrings.dictionary(aliases.withColumnRenamed("alias", "gram"), 1), "gram")
    assert not broadcast_sides(joined) and joined.count() == 50


def test_symptoms_and_units_are_broadcast_not_the_texts(spark):
    texts, _ = dictionary_case(spark)
    symptoms = rewrite.symptom_hits(texts, spark.createDataFrame([("fox", "red fox|blue fox", "hint")], "canon string, aliases string, intent_hint string"))
    units = rewrite.unit_hits(texts, spark.createDataFrame([("MG", "milligram")], "raw string, canon string"))
    assert broadcast_sides(symptoms) == broadcast_sides(units) == {"BuildRight"}
    assert symptoms.count() == units.count() == 25


def test_alias_coverage_broadcasts_no_texts(spark):
    from lexispark import registry
    import lexispark.queries  # noqa: F401

    df = registry.QUERIES["alias_coverage"](spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "rightHint=(strategy=broadcast)" in plan and "leftHint" not in plan


def test_pieces_of_texts_are_never_broadcast(spark):
    from lexispark.operators import clinical

    texts, aliases = dictionary_case(spark)
    needles = aliases.select(F.col("alias").alias("needle"))
    assert not broadcast_sides(substrings.contained(texts, "text", needles, "needle", 0))
    gold = curation.lexicon_gold(texts.withColumnRenamed("qid", "doc_id"), spark.createDataFrame([("one", "red"), ("one", "mg")], "directory string, term string"), ["text"], {"one": "a"})
    assert broadcast_sides(gold) == {"BuildRight"} and gold.count() == 50
    lex = spark.createDataFrame([("c", "trigger", "red fox")], "condition string, kind string, norm string")
    found = clinical.matches(texts, lex, "qid", "text")
    assert broadcast_sides(found) == {"BuildRight"} and found.count() == 25


@pytest.mark.parametrize("few", [20_000, 0])
def test_prior_lookup_broadcasts_no_conditions(spark, few):
    import re

    asked = spark.range(50).select(F.col("id").alias("qid"), F.explode(F.split(F.lit("flu cold ache"), " ")).alias("condition"))
    rows = spark.createDataFrame([("flu", 0), ("cold_basic", 1), ("headache", 2)], "id string, ord int")
    got = priors.lookup(asked, rows, few=few)
    top = re.search(r"(\w+Join) \[.*", got._jdf.queryExecution().executedPlan().toString())[0]
    assert "BuildRight" in top if few else top.startswith("SortMergeJoin")
    assert got.count() == 150 and {(r.condition, r.prior_id) for r in got.collect()} == {("flu", "flu"), ("cold", "cold_basic"), ("ache", "headache")}


def test_numbers_within_a_reply_are_no_refusal(spark):
    texts = [
        (1, '{"candidates": [{"drug_id": 429, "score": 4.29}]}', None),
        (2, '```json\n{"candidates": [{"drug_id": 14290, "safety_label": "no quota"}]}\n```', None),
        (3, '{"candidates": [{"drug_id": 429}, {"drug_id": 1', "invalid"),
        (4, "429 RESOURCE_EXHAUSTED. {'error': {'code': 429}}", "quota"),
        (5, '{"error": {"code": 429}}', "quota"),
        (6, "Rate limit reached", "quota"),
        (7, "HTTP 14290", "invalid"),
        (8, None, "empty"),
    ]
    rows = spark.createDataFrame([t[:2] for t in texts], "qid long, text string")
    got = {r.qid: (r.error, r.reply) for r in rerank.parsed_replies(rows, "text", "candidates array<struct<drug_id: bigint>>").collect()}
    assert {k: v[0] for k, v in got.items()} == {t[0]: t[2] for t in texts}
    assert got[1][1].candidates[0].drug_id == 429 and got[2][1].candidates[0].drug_id == 14290


def test_scores_of_a_reply_about_item_429(spark):
    replies = spark.createDataFrame([(1, '{"candidates": [{"drug_id": 429, "score": 7.0}, {"drug_id": 5, "score": 42.9}]}')], "qid long, text string")
    candidates = spark.createDataFrame([(1, 429), (1, 5)], "qid long, doc_id long")
    assert sorted(map(tuple, rerank.judged_by_replies(candidates, replies).collect())) == [(1, 5, 10.0, "ok"), (1, 429, 7.0, "ok")]


def test_ids_are_found_once_for_equal_lists(spark):
    titles = spark.range(300).select(F.col("id").alias("p"), F.when(F.col("id") % 3 == 0, "red ring").when(F.col("id") % 3 == 1, "Blue ring").otherwise("bolt").alias("name"))
    rows = [(1, "a", ["Red ring "], ["ring", "red ring"]), (2, "b", ["red ring"], None), (3, "c", [], ["none", None, "ring"]), (4, "d", ["Red ring ", "bolt"], [""])]
    q = spark.createDataFrame(rows, "qid long, text string, gold array<string>, more array<string>")
    lists = {r.qid: (r.gold, r.more, r.unmatched) for r in curation.augmented(q, titles, ["gold", "more"], "name", "p", []).collect()}
    red, ring, bolt = list(range(0, 300, 3)), [i for i in range(300) if i % 3 < 2], list(range(2, 300, 3))
    assert lists == {1: (red, ring, []), 2: (red, [], []), 3: ([], ring, ["none"]), 4: (sorted(red + bolt), [], [""])}
    sizes = {r.qid: (r.gold, r.more, r.unmatched) for r in curation.augmented(q, titles, ["gold", "more"], "name", "p", [], sizes=True).collect()}
    assert sizes == {k: (len(a), len(b), c) for k, (a, b, c) in lists.items()}


@pytest.mark.parametrize("step", [1, 150, 10**6])
def test_dense_in_steps_against_every_pair(spark, monkeypatch, step):
    monkeypatch.setattr(dense, "STEP", step)
    rng = np.random.default_rng(3)
    vectors = [(int(i), [float(x) for x in rng.integers(-2, 3, 4)]) for i in rng.permutation(300)]
    v = spark.createDataFrame(vectors, "vec_id long, embedding array<float>")
    got = sorted((r.qid, r["rank"], r.doc_id) for r in dense.dense_top(v, v.filter("vec_id % 60 = 0").withColumnRenamed("vec_id", "qid"), 3).collect())
    best = lambda q: sorted(vectors, key=lambda d: (-np.dot(dict(vectors)[q], d[1]), d[0]))[:3]
    assert got == [(q, i + 1, d[0]) for q in range(0, 300, 60) for i, d in enumerate(best(q))]


def test_ngram_profile_makes_no_row_of_an_ngram(spark):
    texts = ["b a c a ab a a", "one", "", None, "a ab a b", "x x x x x x"]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, text string")
    p = df.select("i", F.explode(tx.ngram_profile(tx.tokenize(F.col("text")))).alias("p")).select("i", "p.*")
    w = [(t or "").split() for t in texts]
    grams = {(i, n): [" ".join(x[j : j + n]) for j in range(len(x) - n + 1)] for i, x in enumerate(w) for n in range(1, 6)}
    assert sorted(map(tuple, p.collect())) == sorted((*k, len(g), min(g)) for k, g in grams.items() if g)


@pytest.mark.parametrize("few", [100_000, 0])
def test_ngrams_of_repeated_and_missing_ids(spark, few):
    rows = [(1, "a b a"), (1, "a b"), (2, "b a b"), (None, "a a"), (None, "a b"), (3, None), (4, "a")]
    got = sorted(map(tuple, profile.ngram_frequency(spark.createDataFrame(rows, "i long, t string"), "i", "t", 1, 2, 2, few=few).collect()))
    grams = [(i, " ".join(w[j : j + n])) for i, t in rows for w in [(t or "").split()] for n in (1, 2) for j in range(len(w) - n + 1)]
    want = {g: (sum(x == g for _, x in grams), len({i for i, x in grams if x == g} - {None})) for _, g in grams}
    assert got == sorted((g, *c) for g, c in want.items() if c[1] >= 2) and got


def test_ngrams_are_shuffled_once_without_ids(spark):
    df = spark.range(20).select("id", F.lit("a b c").alias("t"))
    assert profile.ngram_frequency(df, "id", "t")._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1


def test_safe_ranks_in_slices_and_one_search_for_all_profiles(spark):
    from lexispark.config import UserProfile
    from lexispark.operators import safety

    texts = ["вагітність, період лактації", "діти до 12 років", "цукровий діабет; гіперчутливість", "", None, "особам старше 3 років"]
    df = spark.range(60).select(F.col("id").alias("doc_id"), F.element_at(F.array(*[F.lit(t) for t in texts]), (F.col("id") % 6 + 1).cast("int")).alias("t"))
    profiles = {"child": UserProfile(age=5), "pregnant": UserProfile(age=30, pregnancy=True), "none": UserProfile()}
    each = safety.assess_each(df, "t", profiles)
    alone = [(name, *r) for name, p in profiles.items() for r in safety.assess(df, "t", p).drop("t").collect()]
    assert sorted(map(str, map(tuple, each.select("qid", "doc_id", "risk_score", "risk_level", "safe_to_use", "warnings", "critical_warnings").collect()))) == sorted(map(str, alone))
    ranked = each.withColumn("rank", F.col("doc_id") * 7 % 60 + 1)
    for ranks in (7, 1 << 16):
        got = safety.filter_safe(ranked, ranks=ranks).collect()
        for name in profiles:
            own = sorted((r for r in got if r.qid == name), key=lambda r: r.safe_rank)
            assert [r.safe_rank for r in own] == list(range(1, len(own) + 1)) and own == sorted(own, key=lambda r: (r.risk_score, r["rank"]))


def test_profiles_pass_over_a_text_once(spark):
    df = spark.createDataFrame([(" A®b’s  «x» [y]; (z),\t– Q-1 ´é™\n",)], "t string")
    want = {"evaluation": "a b s x y z – q-1 ´é", "alias": "a b s «x» [y]; (z), – q-1 ´é", "query": "a b s x [y]; (z), – q-1 ´é", "triage": "a b s x y z – q-1 é", "gold": "a b’s x [y]; z , – q 1 ´é", "title": "a b s x y z q 1 é", "spaces": "a®b’s «x» [y]; (z), – q-1 ´é™", "pattern": "a b's x y z q-1", "brand": "a bs x [y]; (z), q 1 ´é"}
    got = df.select(*[norms.normalize(F.col("t"), p, unicode=False).alias(p) for p in want])
    assert got.first().asDict() == want
    plan = got.select("evaluation", "alias", "query", "triage", "gold", "title")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace(") == 6


@pytest.mark.parametrize("repeated", [False, True])
def test_bm25_every_ranks_in_parts(spark, repeated):
    rng = random.Random(5)
    # many ties: documents without a query term, and copies
    docs = [(i, " ".join(rng.choices("abcdefgh", k=rng.randint(0, 4)))) for i in rng.sample(range(-50, 1000), 200)]
    docs += [(None, "a b"), (2000, None)] + ([(docs[0][0], "a a a"), (docs[1][0], "z")] if repeated else [])
    d = spark.createDataFrame(docs, "doc_id int, text string").repartition(3)
    q = spark.createDataFrame([(7, "a b"), (3, "c zz"), (5, None), (9, "none of these"), (None, "a")], "item_id int, text string")
    plain = lexical.bm25_every(d, q, most_entries=0)
    want = sorted(map(str, plain.withColumn("score", F.round("score", 9)).collect()))
    assert len(want) == 5 * 201
    for part in (1000, 9):
        df = lexical.bm25_every(d, q, part=part)
        assert df.dtypes == plain.dtypes
        assert sorted(map(str, df.withColumn("score", F.round("score", 9)).collect())) == want
    assert lexical.bm25_every(d, q.limit(0), part=9).count() == lexical.bm25_every(d.limit(0), q, part=9).count() == 0


def test_bm25_every_shuffles_rows_once_and_cuts_what_a_task_ranks(spark):
    d = spark.createDataFrame([(i, "a " * (i % 3) + "b") for i in range(400)], "doc_id long, text string")
    q = spark.createDataFrame([(1, "a"), (2, "c")], "item_id long, text string")
    df = lexical.bm25_every(d, q, part=20)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
    ends = df.filter("qid = 2").withColumn("task", F.spark_partition_id()).groupBy("task").count().collect()
    assert max(r["count"] for r in ends) < 400


def test_dense_top_holds_a_step_of_scores(spark, monkeypatch):
    import tracemalloc

    import pyarrow as pa

    rng = np.random.default_rng(4)
    v = spark.createDataFrame(pa.table({"vec_id": np.arange(2000), "embedding": list(rng.normal(size=(2000, 8)))}))
    caught, plain = [], type(v).mapInArrow
    monkeypatch.setattr(type(v), "mapInArrow", lambda self, f, schema: caught.append(f) or plain(self, f, schema))
    dense.dense_top(v, v.withColumnRenamed("vec_id", "qid"), 10)
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(10_000)), pa.array(list(rng.normal(size=(10_000, 8))))], names=["doc_id", "embedding"])
    tracemalloc.start()
    rows = sum(b.num_rows for b in caught[0](iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # all scores of the batch at once are 160 MB
    assert rows == 2000 * 10 and peak < 100e6
