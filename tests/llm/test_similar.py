import random
import re
from collections import defaultdict

import numpy as np
import pytest

from quirion.llm import simhash
from quirion.llm import similar as S


def shingles(text, words=5):
    found = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
    return {" ".join(found[k : k + words]) for k in range(max(1, len(found) - words + 1))} if found else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefgé") for _ in range(rng.randrange(2, 6)))
    texts = [" ".join(word() for _ in range(rng.randrange(60, 400))) for _ in range(250)]
    for k in range(120):
        for _ in range(rng.choice([1, 1, 5])):
            words = texts[k].split(" ")
            for _ in range(rng.choice([0, 1, 1, len(words) // 60, len(words) // 8])):
                words[rng.randrange(len(words))] = word()
            texts.append(" ".join(words))
    base = " ".join(word() for _ in range(600))
    for _ in range(120):
        words = base.split(" ")
        for _ in range(rng.randrange(1, 9)):
            words[rng.randrange(600)] = word()
        texts.append(" ".join(words))
    texts += [base, "short one", "Short one", "other", None, "", " \n"]
    rng.shuffle(texts)
    return [(k, t, "x") for k, t in enumerate(texts)]


def test_groups_against_brute_force(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, sig string")
    kept = S.keep_one(docs)
    assert kept.schema == docs.schema
    got = {r.doc_id for r in kept.collect()}
    sets = {i: shingles(t) for i, t, _ in rows}
    ids = sorted(sets)
    strong, weak = {i: i for i in ids}, {i: i for i in ids}
    def top(of, i):
        while of[i] != i:
            i = of[i]
        return i
    for k, a in enumerate(ids):
        for b in ids[:k]:
            j = jaccard(sets[a], sets[b])
            for of, least in ((strong, 0.83), (weak, 0.75)):
                if j >= least:
                    x, y = sorted((top(of, a), top(of, b)))
                    of[y] = x
    must_go = [i for i in ids if top(strong, i) != i]
    must_stay = [i for i in ids if top(weak, i) == i]
    missed = [i for i in must_go if i in got]
    assert len(must_go) > 200 and len(missed) <= 0.03 * len(must_go)
    assert not [i for i in must_stay if i not in got]
    # Something of every group stays.
    assert {top(weak, i) for i in got} == {top(weak, i) for i in ids}


def test_edges(spark):
    docs = spark.createDataFrame([(4, "a b", 1), (4, "a b", 1), (None, "a b", 2), (None, "solo", 3), (7, None, 4), (8, "", 4), (9, "z " * 9000, 5)], "doc_id long, text string, n int")
    assert sorted(map(tuple, S.keep_one(docs).collect()), key=str) == sorted([(4, "a b", 1), (None, "solo", 3), (7, None, 4), (9, "z " * 9000, 5)], key=str)
    assert S.keep_one(docs.limit(0)).count() == 0


def test_short_texts_do_not_coincide(spark):
    rows = [(k, f"word{k} number{7 * k}") for k in range(4000)]
    assert S.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).count() == 4000


def test_similarity_itself_decides(spark):
    rng = random.Random(31)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    rows, alike = [], set()
    for k in range(60):
        words = [word() for _ in range(400)]
        edited = list(words)
        for at in range(20, 20 + 40 * (9 if k < 40 else 8), 40):
            edited[at] = word()
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(edited))]
        if jaccard(shingles(rows[-2][1]), shingles(rows[-1][1])) >= 0.8:
            alike.add(2 * k + 1)
    assert len(alike) == 20
    kept = {r.doc_id for r in S.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    gone = set(range(120)) - kept
    assert gone <= alike
    assert len(alike - gone) <= 1


def grouped(n, edges):
    of = list(range(n))
    for a, b in edges:
        x, y = of[a], of[b]
        of = [x if o == y else o for o in of]
    return {frozenset(i for i in range(n) if of[i] == o) for o in of}


def family(rng, n, least=4, most=14):
    base, sets = rng.integers(0, 1 << 60, 100, dtype=np.uint64), []
    for _ in range(n):
        own = base.copy()
        own[rng.permutation(100)[: rng.integers(least, most)]] = rng.integers(0, 1 << 60, 1, dtype=np.uint64)[0] + np.arange(1, dtype=np.uint64)
        sets.append(np.unique(own))
    return sets


def test_queries_join_what_verified_pairs_join():
    rng = np.random.default_rng(5)
    for n in (9, 60):
        sets = family(rng, n)
        fps = rng.integers(0, 1 << 12, n, dtype=np.uint64)  # distances that tell nothing of the sets
        for most in (3, 12):
            far = np.bitwise_count(fps[:, None] ^ fps)
            real = [(i, j) for i in range(n) for j in range(i) if far[i, j] <= most and jaccard(set(sets[i].tolist()), set(sets[j].tolist())) >= 0.8]
            assert len(real) > 0
            some = real[: len(real) // 3]
            label = {i: min(g) for g in grouped(n, some) for i in g}
            majority = max(grouped(n, some), key=len)
            queries = np.array([i for i in range(n) if i not in majority])
            found = S.linked(fps, sets, [label[i] for i in range(n)], queries, most, 0.8)
            assert grouped(n, some + found) == grouped(n, real)


def test_blocks_of_large_buckets(spark, monkeypatch):
    """All texts in one bucket, blocks of a few texts: groups are those of all pairs that are alike."""
    monkeypatch.setattr(S, "BLOCK", 7)
    rng = np.random.default_rng(6)
    sets = family(rng, 50, 8, 13) + family(rng, 20) + family(rng, 9)
    rng.shuffle(sets)
    n = len(sets)
    name = [bytes([k]) * 16 for k in range(n)]
    members = spark.createDataFrame([(1, bytearray(name[k]), 0, n) for k in range(n)], "key long, node binary, fp long, size long")
    table = spark.createDataFrame([(bytearray(name[k]), sets[k].astype(np.int64).tolist()) for k in range(n)], "node binary, set array<long>")
    real = [(i, j) for i in range(n) for j in range(i) if jaccard(set(sets[i].tolist()), set(sets[j].tolist())) >= 0.8]
    some = real[:40]
    label = {i: min(g) for g in grouped(n, some) for i in g}
    labels = spark.createDataFrame([(bytearray(name[i]), bytearray(name[label[i]])) for i in range(n) if any(i in e for e in some)], "node binary, label binary")
    at = {x: k for k, x in enumerate(name)}
    found = [(at[bytes(r.a)], at[bytes(r.b)]) for r in S._between_groups(members, labels, table, 64, 0.8).collect()]
    assert grouped(n, some + found) == grouped(n, real) and len(grouped(n, real)) >= 3


def test_pairs_at_the_similarity_share_a_bucket():
    rng = np.random.default_rng(7)
    missed, n = 0, 3000
    for _ in range(n):
        base = rng.integers(0, 1 << 63, 330, dtype=np.uint64)
        a, b = np.unique(base[:300]), np.unique(np.r_[base[30:300], base[300:330]])  # 270 of 330: 0.818
        a, b = (a, b) if rng.integers(2) else (b, a)
        (x, y), _ = S.partitions([a, b])
        missed += not (x == y).any()
    assert missed <= 0.006 * n


def test_small_pairs_are_all_near_pairs(spark):
    rng = random.Random(8)
    rows = [(key, bytearray([key % 250, k]), rng.randrange(1 << 8), size) for key in range(400) for size in [rng.randrange(2, 9)] for k in range(size)]
    want = sorted((bytes(a[1]), bytes(b[1])) for a in rows for b in rows if a[0] == b[0] and a[1] < b[1] and (a[2] ^ b[2]).bit_count() <= 3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        df = spark.createDataFrame(rows, "key long, node binary, fp long, size long").coalesce(1)
        got = sorted(tuple(sorted((bytes(r.a), bytes(r.b)))) for r in S._small_pairs(df, 3).collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == want


def test_values_are_searched_by_operator_5(spark, monkeypatch):
    """Buckets are the components of values within two bits, found by its plan's thresholds, whichever of its rules links them."""
    rng = random.Random(9)
    values = [rng.getrandbits(64) for _ in range(300)]
    for _ in range(300):
        x = rng.choice(values)
        for b in rng.sample(range(64), rng.choice([0, 1, 2, 2, 3])):
            x ^= 1 << b
        values.append(x)
    rows = [(x - (1 << 64) if x >> 63 else x, bytearray(k.to_bytes(16, "big")), k, 1 + k % 3) for k, x in enumerate(values)]
    want = grouped(len(values), [(i, j) for i in range(len(values)) for j in range(i) if (values[i] ^ values[j]).bit_count() <= 2])
    want = {g for g in want if len(g) > 1}
    plans = []
    thresholds = simhash.Plan.thresholds
    monkeypatch.setattr(simhash, "planned", lambda *a, made=simhash.planned, **k: plans.append(made(*a, **k)) or plans[-1])
    for bucket in (simhash.BUCKET, 0):
        monkeypatch.setattr(simhash, "BUCKET", bucket)
        got = defaultdict(list)
        for r in S.gathered(spark.createDataFrame(rows, "value long, node binary, fp long, copies long")).collect():
            got[r.key].append(r)
        assert {frozenset(r.fp for r in g) for g in got.values()} == want
        for g in got.values():
            lead = max(g, key=lambda r: (1 + r.fp % 3, bytes(r.node)))
            assert all((r.size, bytes(r.lead), r.lead_fp) == (len(g), bytes(lead.node), lead.fp) for r in g)
    chosen = thresholds(plans[0], np.array(values, np.uint64))
    assert len(plans) == 2 and (chosen.sum(axis=0) + len(chosen) == S.NEAR + 1).all()


def test_edits_in_the_sample_of_every_class(spark):
    """Texts that agree in no partition, but whose fingerprints of all shingles are within two bits."""
    rng = random.Random(10)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(7))
    rows = []
    while len(rows) < 6:
        words = [word() for _ in range(2500)]
        hashes = simhash.shingle_hashes(" ".join(words), 5)
        edited = list(words)
        for c in range(S.PARTS):
            at = np.flatnonzero(hashes % np.uint64(S.PARTS) == c)
            edited[int(at[hashes[at].argmin()]) + 2] = word()
        texts = [" ".join(words), " ".join(edited)]
        sets = [np.unique(simhash.shingle_hashes(t, 5)) for t in texts]
        (x, y), _ = S.partitions(sets)
        far = (simhash.fingerprint(sets[0]) ^ simhash.fingerprint(sets[1])).bit_count()
        if not (x == y).any() and far <= 2:
            assert jaccard(shingles(texts[0]), shingles(texts[1])) > 0.9
            rows += [(len(rows) + k, t) for k, t in enumerate(texts)]
    kept = {r.doc_id for r in S.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == {0, 2, 4}
