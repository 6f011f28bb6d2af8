import collections

import corpus_pipeline as cp
from lexispark.llm.common import stored

from .test_cdc import brute as brute_dedup
from .test_mixing import check as check_mix
from .test_neardup import brute_kept
from .test_winnow import brute as brute_hits

SF = "/root/testdata/sf0.001"


def test_each_stage_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, {r.doc_id: r for r in docs.collect()}
    labels = {r.doc_id: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    for name, stage in cp.STAGES[:-1]:
        docs = stored(stage(spark, docs, SF), name=name)
        assert docs.columns == columns
        rows = docs.collect()
        after = {r.doc_id: r for r in rows}
        assert len(after) == len(rows) and set(after) <= set(before)
        ids = sorted(before)
        if name == "quality_filter":
            good = [i for i in ids if i in labels and labels[i].quality == 1]
            assert sum(i in after for i in good) >= 0.97 * len(good)
            bad = [i for i in ids if i in labels and labels[i].quality == 0]
            assert sum(i in after for i in bad) <= 0.2 * len(bad)
        elif name == "near_dedup":
            assert set(after) == brute_kept([(i, before[i].text) for i in ids])
        elif name == "substring_dedup":
            want = brute_dedup([(i, before[i].text) for i in ids])
            assert {i: r.text for i, r in after.items()} == {i: want[k] for k, i in enumerate(ids)}
            assert all(r.n_chars == len(r.text) for r in rows)
        elif name == "decontaminate":
            hit = {r[0] for r in brute_hits([(i, before[i].text) for i in ids], items) if r[-1]}
            assert set(after) == set(ids) - hit
        if name != "substring_dedup":
            assert all(before[i] == r for i, r in after.items())
        before = after
    check_mix(cp.STAGES[-1][1](spark, docs, SF).collect(), [(i, r.text, r.source) for i, r in before.items()])


def test_run(spark):
    out = cp.run(spark, SF)
    rows = out.collect()
    assert collections.Counter(r.doc_id for r in rows).most_common(1)[0][1] == 1
    assert "taken" in out.columns and "doc_id" in out.columns


ODD = "doc_id long, text string, lang string, source string, n_chars long, score string, predicted int, n_words int, n_chunks int, removed int, fp int, component_id int, size int, contaminated int"


def odd_rows():
    rest = ("s", 1, 2, 3, 4, 5, 6, 7, 8)
    rows = [(i, f"document number {i} has words of its own, namely w{i} x{i * 7} y{i * 3} z{i}", "en", "src", 5, *rest) for i in range(20)]
    rows += [(None, "no id at all here", None, None, None, *rest), (None, None, None, None, None, *rest), (30, None, None, None, None, *rest), (31, "", "fr", None, 0, *rest)]
    return rows + [rows[0], rows[0], rows[20], (40, "long " * 100_000, "en", "src", 1, *rest), (3, "another text under the same id 3", "en", "b", 1, *rest)]


def test_stages_on_nulls_repeats_and_clashing_columns(spark):
    docs = spark.createDataFrame(odd_rows(), ODD)
    for name, stage in cp.STAGES[:-1]:
        before = docs.collect()
        docs = stored(stage(spark, docs, SF), name=name)
        assert docs.schema.names == spark.createDataFrame([], ODD).schema.names
        after = docs.collect()
        assert 0 < len(after) <= len(before)
        assert all(r.score == "s" and r.predicted == 1 and r.contaminated == 8 and r.component_id == 6 for r in after)
        if name == "near_dedup":
            ids = [r.doc_id for r in after if r.doc_id is not None]
            assert len(ids) == len(set(ids)) and sum(r.doc_id is None for r in after) <= 1
    final = cp.STAGES[-1][1](spark, docs, SF)
    assert final.count() == docs.count()


def test_stages_on_empty_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and out.count() == 0
    assert cp.STAGES[-1][1](spark, docs, SF).count() == 0
