import random
import re

import pytest
import xxhash

from quirion.llm import simhash
from quirion.llm.components import components


def spec_fingerprint(text, words):
    """The contract, bit by bit."""
    found = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    runs = [" ".join(found[k : k + words]) for k in range(len(found) - words + 1)] or ([" ".join(found)] if found else [])
    hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def spec_components(pairs, nodes):
    parent = {n: n for n in nodes}

    def top(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in pairs:
        a, b = sorted((top(a), top(b)))
        parent[b] = a
    return {n: top(n) for n in nodes}


def spec(rows, words=3, threshold=2):
    fps = {i: spec_fingerprint(t, words) for i, t in rows}
    ids = list(fps)
    pairs = [(a, b) for k, a in enumerate(ids) for b in ids[:k] if (fps[a] ^ fps[b]).bit_count() <= threshold]
    of = spec_components(pairs, ids)
    return sorted((i, f"{fps[i]:016x}", of[i]) for i in ids)


def edited(rng, text, n):
    words = text.split(" ")
    for _ in range(n):
        words[rng.randrange(len(words))] = f"new{rng.randrange(99)}"
    return " ".join(words)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdeÉé") for _ in range(rng.randrange(1, 5)))
    base = [" ".join(word() for _ in range(rng.randrange(1, 150))) for _ in range(60)]
    texts = [None, "", " \n", "One", "one two", "ONE TWO", *base, *base[:20]]
    for b in base[:30]:
        texts += [edited(rng, b, k % 3) for k in range(8)]
    long = " ".join(word() for _ in range(400))
    texts += [edited(rng, long, 1 + k % 4) for k in range(150)]
    rng.shuffle(texts)
    return [(3 * k + 1, t) for k, t in enumerate(texts)]


@pytest.mark.parametrize("bucket", [64, 2])
def test_groups_equal_brute_force(spark, rows, monkeypatch, bucket):
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, component_id string")
    got = sorted(map(tuple, simhash.near_duplicates(docs).collect()))
    assert got == spec(rows)


@pytest.mark.parametrize("threshold", [0, 1])
def test_lower_thresholds(spark, rows, monkeypatch, threshold):
    monkeypatch.setattr(simhash, "BUCKET", 3)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, simhash.near_duplicates(docs, threshold=threshold).collect())) == spec(rows, threshold=threshold)


def test_edge_cases(spark):
    docs = spark.createDataFrame([(None, "a b c d"), (4, "a b c d"), (4, "a b c d"), (None, "z " * 30)], "doc_id long, text string")
    got = {(r.doc_id, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    assert got == {(None, 4), (4, 4), (None, None)}
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


@pytest.mark.parametrize("partitions", [2, 3])
def test_probing_alone_finds_every_link(spark, rows, monkeypatch, partitions):
    """With the plan for many or few fingerprints and no bucket counted as crowded, the search itself brings all links."""
    monkeypatch.setattr(simhash, "BUCKET", 1 << 30)
    fps = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in {spec_fingerprint(t, 3) for _, t in rows}], "fp long")
    plan = simhash.planned(fps, 2, partitions)
    assert sorted(map(len, plan.groups)) == ([32, 32] if partitions == 2 else [21, 21, 22])
    found = {(r.a, r.b) for r in simhash.links(fps, 2, partitions).collect()}
    all_fps = [r.fp for r in fps.collect()]
    want = {(min(a, b), max(a, b)) for k, a in enumerate(all_fps) for b in all_fps[:k] if ((a ^ b) & (1 << 64) - 1).bit_count() <= 2}
    assert found == want and len(want) > 50


def test_partitions_follow_the_number_of_fingerprints():
    assert [simhash.partitions_for(n) for n in (0, 10**6, 8 << 20, (8 << 20) + 1, 10**10)] == [3, 3, 3, 2, 2]


@pytest.mark.parametrize("few", [0, 100, 20_000])
def test_components(spark, monkeypatch, few):
    import sys

    monkeypatch.setattr(sys.modules["quirion.llm.components"], "FEW", few)
    rng = random.Random(3)
    edges = [(k, k + 1) for k in range(300)] + [(1000, 1000 + k) for k in range(200)] + [(rng.randrange(2000, 2400), rng.randrange(2000, 2400)) for _ in range(250)] + [(7, 7)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    nodes = {n for a, b in edges if a != b for n in (a, b)}
    want = spec_components(edges, nodes)
    assert set(got) == nodes
    assert len(set(zip(got.values(), map(want.get, got), strict=True))) == len(set(got.values())) == len(set(want.values()))
