import itertools
import random
import re
from collections import defaultdict

import numpy as np
import pytest

from quirion.llm.mixing import capped_targets, fit_budget, knapsack, mix


def best_sum(lengths, counts, budget):
    sums = {sum(n * x for n, x in zip(ns, lengths, strict=True)) for ns in itertools.product(*(range(c + 1) for c in counts))}
    return max(s for s in sums if s <= budget)


def test_knapsack_equals_brute_force():
    rng = random.Random(4)
    for _ in range(300):
        lengths = rng.sample(range(1, 30), rng.randrange(1, 5))
        counts = [rng.randrange(1, 5) for _ in lengths]
        budget = rng.randrange(1, 120)
        got = knapsack(lengths, counts, budget)
        assert all(0 <= g <= c for g, c in zip(got, counts, strict=True))
        assert sum(g * x for g, x in zip(got, lengths, strict=True)) == best_sum(lengths, counts, budget)


def test_fit_budget_over_a_small_window():
    rng = random.Random(6)
    for _ in range(100):
        lengths = np.array(sorted(rng.sample(range(0, 60), 12)))
        counts = np.array([rng.randrange(1, 400) for _ in lengths])
        budget = rng.randrange(0, int((lengths * counts).sum()) + 50)
        got = fit_budget(lengths, counts, budget, window=256)
        assert (got >= 0).all() and (got <= counts).all()
        left = min(budget, int((lengths * counts).sum())) - int((got * lengths).sum())
        assert 0 <= left < 60


def test_targets():
    assert capped_targets([10, 10], [1, 1], 20, 3) == [10, 10]
    assert capped_targets([1, 99], [2, 1], 100, 3) == [3, 97]
    assert capped_targets([0, 5], [1, 1], 5, 3) == [0, 5]
    assert capped_targets([], [], 0, 3) == []


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    texts = [None, "", "   "] + ["hot copy text here"] * 700 + [" ".join("w" for _ in range(rng.randrange(1, 90))) for _ in range(1500)]
    sources = ["big"] * 6 + ["b", "é", None, "Z"]
    found = [(k, t, rng.choice(sources), k % 7) for k, t in enumerate(texts)]
    return found + [found[5], (None, "one two", "b", 1)]


def test_operator(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, times int")
    got = mix(docs, keep=["doc_id", "source"]).collect()
    again = mix(docs.repartition(3), keep=["doc_id", "source"]).collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, again), key=str)
    assert len(got) == len(rows)
    size_of = defaultdict(int)
    for _, t, s, _ in rows:
        size_of[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    order = sorted(size_of, key=lambda s: (s is None, s or ""))
    want = dict(zip(order, capped_targets([size_of[s] for s in order], [1 + k % 3 for k in range(len(order))], sum(size_of.values()), 3), strict=True))
    taken = defaultdict(int)
    for r in got:
        assert r.source_size == size_of[r.source] and abs(r.target - want[r.source]) < 1e-6
        assert 0 <= r.times <= 3 and (r["size"] or not r.times)
        taken[r.source] += r["size"] * r.times
    for s in order:
        assert abs(taken[s] - want[s]) <= 1, (s, taken[s], want[s])
    assert mix(docs.limit(0)).count() == 0
    clashing = docs.selectExpr("*", "1 AS name", "2 AS code", "3 AS budget", "4 AS n", "5 AS whole")
    assert mix(clashing).columns == ["doc_id", "text", "source", "name", "code", "budget", "n", "whole", "size", "source_size", "target", "times"]
    assert mix(clashing).count() == len(rows)


def test_texts_of_one_id_are_told_apart(spark):
    rows = [(7, f"w{k} b c", "s") for k in range(200)] + [(None, f"x{k} b c", "t") for k in range(40)] + [(None, "long " * 20_000, "t")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    taken = [sorted((r.text, r.times) for r in mix(d, share=0.5).collect()) for d in (docs, docs.repartition(5), docs.orderBy("text"))]
    assert taken[0] == taken[1] == taken[2] and 0 < sum(n for _, n in taken[0])


def test_many_sources(spark, monkeypatch):
    from quirion.llm import mixing

    monkeypatch.setattr(mixing, "BROADCAST", 10)
    rows = [(k, "a b " * (1 + k % 3), None if k == 5 else f"s{k % 60}") for k in range(600)]
    got = mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), keep=["source"]).collect()
    assert len(got) == 600 and len({r.source for r in got}) == 61 and all(r.target <= 3 * r.source_size + 1e-6 for r in got)
