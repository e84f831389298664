import itertools
import random
import zlib

import numpy as np

from quirion.llm.sharding import minimax_cuts, shard, smallest_capacity


def brute_capacity(sizes, shards):
    best = None
    for cuts in itertools.combinations_with_replacement(range(len(sizes) + 1), shards - 1):
        edges = [0, *cuts, len(sizes)]
        most = max(sum(sizes[a:b]) for a, b in itertools.pairwise(edges))
        best = most if best is None else min(best, most)
    return best


def test_minimax_equals_brute_force():
    rng = random.Random(1)
    for _ in range(200):
        sizes = [rng.choice([1, 2, 5, 40]) for _ in range(rng.randrange(1, 9))]
        shards = rng.randrange(1, 5)
        want = brute_capacity(sizes, shards)
        assert smallest_capacity(np.array(sizes), shards) == want
        edges = [0, *minimax_cuts(np.array(sizes), shards), len(sizes)]
        assert edges == sorted(edges) and len(edges) == shards + 1
        assert max(sum(sizes[a:b]) for a, b in itertools.pairwise(edges)) == want


def test_operator(spark):
    rng = random.Random(2)
    texts = [None, "", "é" * 7] + ["same text"] * 900 + ["".join(rng.choice("ab c") for _ in range(rng.randrange(200))) for _ in range(3000)] + ["x" * 50_000]
    rows = [(k, t, "extra") for k, t in enumerate(texts)] + [(5, "same text", "extra"), (None, "none", "extra")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard string")
    got = shard(docs, 16, ["doc_id", "text"]).collect()
    assert sorted(((r.doc_id, r.text) for r in got), key=str) == sorted(((r[0], r[1]) for r in rows), key=str)
    where, slots, bytes_in = {}, {}, [0] * 16
    for r in got:
        t = (r.text or "").encode()
        assert r["size"] == len(t) + 1 and r.text_crc32 == zlib.crc32(t)
        assert where.setdefault(t, r.shard) == r.shard
        slots.setdefault(r.shard, []).append(r.slot)
        bytes_in[r.shard] += r["size"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(bytes_in) <= max(50_001, sum(bytes_in) / 16 + 50_001)
    assert shard(docs.limit(0)).count() == 0


def test_cuts_are_exact_over_groups_of_equal_texts(spark, monkeypatch):
    """With few units, so that a unit holds many texts, the largest shard is as small as it can be."""
    from pyspark.sql import functions as F

    from quirion.llm import sharding

    monkeypatch.setattr(sharding, "UNITS", 1 << 12)
    monkeypatch.setattr(sharding, "UNIT_BITS", 12)
    rng = random.Random(3)
    texts = ["x" * rng.choice([1, 10, 300, 2000]) + str(k) for k in range(20_000)]
    rows = [(k, t) for k, t in enumerate(texts)] + [(k, texts[k]) for k in range(0, 20_000, 9)] + [(None, None), (None, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    groups = docs.groupBy(F.coalesce("text", F.lit("")).alias("t")).agg(F.count(F.lit(1)).alias("n")).select((F.col("n") * (F.octet_length("t") + 1)).alias("size"), F.xxhash64("t").alias("h")).collect()
    order = [r["size"] for r in sorted(groups, key=lambda r: r.h % (1 << 64))]
    for shards in (1, 7, 16):
        held = {r["shard"]: r["n"] for r in shard(docs, shards, ["doc_id"]).groupBy("shard").agg(F.sum("size").alias("n")).collect()}
        assert max(held.values()) == smallest_capacity(np.array(order), shards)


def test_very_long_and_very_common_texts(spark):
    rows = [(None, "hot")] * 3000 + [(k, "y" * 300_000) for k in range(3)] + [(k, f"t{k}") for k in range(500)]
    got = shard(spark.createDataFrame(rows, "doc_id long, text string"), 4).collect()
    where, slots = {}, {}
    for r in got:
        assert where.setdefault(r.text, r.shard) == r.shard
        slots.setdefault(r.shard, []).append(r.slot)
    assert len(got) == len(rows) and all(sorted(s) == list(range(len(s))) for s in slots.values())
