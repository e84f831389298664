import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from quirion.llm import common


@pytest.mark.parametrize("n", [0, 1, 2, 3, 10, 99, 100, 101])
def test_ranges(spark, n):
    rng = random.Random(n)
    bounds = sorted(rng.sample(range(-500, 500), n))
    rows = [(k,) for k in range(-510, 510)] + [(None,)]
    ranges = common.Ranges(bounds)
    at = F.col("x")
    for r in spark.createDataFrame(rows, "x long").select("x", ranges.of(at).alias("own"), ranges.ends(at).alias("end")).collect():
        assert r.own == (0 if r.x is None else sum(b < r.x for b in bounds)) and r.end == (r.x in bounds)


def test_ranks_have_no_gaps(spark):
    rng = random.Random(1)
    rows = [(g, rng.randrange(100), rng.randrange(5)) for g in (1, 2) for _ in range(300 if g == 1 else 7)]
    got = defaultdict(list)
    for r in common.ranked(spark.createDataFrame(rows, "g int, x int, s int"), ["g"], ["x"], "s", "rank").collect():
        got[r.g].append((r.rank, r.s, r.x))
    for g, ranks in got.items():
        assert [k for k, _, _ in sorted(ranks)] == list(range(1, sum(r[0] == g for r in rows) + 1))
        assert [(s, x) for _, s, x in sorted(ranks)] == sorted((s, x) for _, s, x in ranks)


def test_join_hot(spark):
    left = spark.createDataFrame([(k % 7 if k % 2 else 0, k) for k in range(400)], "k long, x long")
    right = left.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.max("x").alias("top"))
    got = sorted(map(tuple, common.join_hot(left, right, "k", "n", 5).select("k", "x", "top").collect()))
    assert got == sorted(map(tuple, left.join(right, "k").select("k", "x", "top").collect()))


def test_cut_survives_in_the_shared_folder(spark):
    df = common.cut(spark.range(10).withColumn("x", F.rand(1)))
    assert df.collect() == df.collect() and common.shared_dir(spark)
