import os

import pytest

from lexispark.llm import common


def test_scratch_deletes_what_is_not_kept(spark):
    with common.scratch(spark) as keep:
        a = common.stored(spark.range(3), name="a")
        with common.scratch(spark) as inner:
            b, c = inner(common.stored(spark.range(4), name="b")), common.stored(spark.range(5), name="c")
        keep(a)
        there = [os.path.exists(x.stored_at.removeprefix("file://")) for x in (a, b, c)]
        assert there == [True, True, False]
    there = [os.path.exists(x.stored_at.removeprefix("file://")) for x in (a, b, c)]
    assert there == [True, False, False] and a.count() == 3


def test_a_cluster_must_name_its_folder():
    class Fake:
        master = "spark://host:7077"
        conf = sparkContext = property(lambda self: self)

        def get(self, *_):
            return None

        def getConf(self):
            return self

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        common.shared_dir(Fake())


@pytest.mark.parametrize("n", [1, 2, 200])
def test_components_of_a_path_and_a_star(spark, n):
    edges = [(i, i + 1) for i in range(n)] + [(1000, 1000 + i) for i in range(1, n)] + [(5000, 5000)]
    got = {r.node: r.root for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(n + 1)} | ({1000 + i: 1000 for i in range(n)} if n > 1 else {})


@pytest.mark.parametrize("groups", [1, 7, 64])
def test_running_total(spark, groups):
    rows = [(k, i % groups, i, (i * 7) % 11) for k in "ab" for i in range(500)]
    got = common.running_total(spark.createDataFrame(rows, "k string, g long, i long, v long"), ["k"], "g", ["i"], "v", "before").collect()
    for k in "ab":
        total = 0
        for r in sorted((r for r in got if r.k == k), key=lambda r: (r.g, r.i)):
            assert r.before == total
            total += r.v
