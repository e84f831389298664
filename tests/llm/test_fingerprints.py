import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from quirion.llm import fingerprints as P


def shingle_set(text, words=5):
    found = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return {tuple(found[k : k + words]) for k in range(max(1, len(found) - words + 1))} if found else set()


def jaccard(a, b):
    a, b = shingle_set(a), shingle_set(b)
    return len(a & b) / len(a | b) if a | b else 1.0


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgéß") for _ in range(rng.randrange(1, 7)))
    texts = [" ".join(word() for _ in range(rng.choice([1, 3, 6, 40, 200, 900]))) for _ in range(300)]
    for k in range(1, 300, 3):
        words = texts[k - 1].split(" ")
        for _ in range(k % 9):
            words[rng.randrange(len(words))] = word()
        texts[k] = " ".join(words)
    texts += [None, "", "  \n", "solo", " solo\t", "x" * 3001, texts[4], texts[5]]
    ids = rng.sample(range(10_000), len(texts))
    return list(zip(ids, texts, strict=True))


def test_against_brute_force(spark, rows):
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, print string")
    got = {r.doc_id: r for r in P.fingerprint_edits(docs).collect()}
    order = sorted(rows, reverse=True)
    errors, by_text = [], {}
    for (i, text), (_, follows) in zip(order, [*order[1:], order[0]], strict=True):
        text, follows, r = text or "", follows or "", got.pop(i)
        half = len(text) // 2
        edited = text[: len(text) - half] + follows[:half]
        assert r.n_chars == len(text)
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert by_text.setdefault(text, r.fingerprint) == r.fingerprint
        assert len(r.fingerprint) == P.BINS * P.LOW // 4
        for near, other in ((r.near_edited, edited), (r.near_next, follows)):
            assert 0 <= near <= 1
            errors.append(abs(near - jaccard(text, other)))
            if shingle_set(text) == shingle_set(other):
                assert near == 1.0
    assert not got
    assert max(errors) < 0.2 and sum(errors) / len(errors) < 0.03


def test_fingerprint_equals_plain_python(spark, rows):
    """Bins, densification and packing, step by step from the shingle hashes."""
    import xxhash

    signed = lambda n: n - (1 << 64) if n >> 63 else n
    int_hash = lambda values, seed: signed(__import__("functools").reduce(lambda s, v: xxhash.xxh64_intdigest(v.to_bytes(4, "little"), s), values, seed))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    made = docs.select("text", P.shingles(F.coalesce("text", F.lit("")), 5).alias("h"), P.packed(F.coalesce("text", F.lit(""))).alias("p")).collect()
    for r in made[:40] + made[-8:]:
        bins = {}
        for h in r.h:
            b = (h >> 56) + 128
            bins[b] = min(bins.get(b, h), h)
        if not bins:
            assert r.p is None
            continue
        full = []
        for i in range(P.BINS):
            order = [i, *(int_hash((i, t), 42) % P.BINS for t in range(1, P.TRIES + 1)), *sorted(range(P.BINS), key=lambda b: int_hash((i, b), 42))]
            hit = next(b for b in order if b in bins)
            value = bins[hit]
            if hit != i:
                value = xxhash.xxh64_intdigest(i.to_bytes(4, "little"), xxhash.xxh64_intdigest(value.to_bytes(8, "little", signed=True), 42))
            full.append(value & 15)
        want = [int("".join(f"{x:x}" for x in full[k : k + 16]), 16) for k in range(0, P.BINS, 16)]
        assert [x % (1 << 64) for x in r.p] == want


def test_ranges_follow_the_bytes(spark, monkeypatch):
    monkeypatch.setattr(P, "RANGE_BYTES", 1000)
    rows = [(k, f"{k} " * (k % 50)) for k in range(800)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    many = P.fingerprint_edits(docs)
    assert "Window" in many._jdf.queryExecution().toString()
    monkeypatch.undo()
    assert sorted(map(tuple, many.collect())) == sorted(map(tuple, P.fingerprint_edits(docs).collect()))
    with pytest.raises(TypeError, match="whole numbers"):
        P.fingerprint_edits(spark.createDataFrame([("a", "b")], "doc_id string, text string"))


def test_edges(spark):
    one = spark.createDataFrame([(7, "abcd efgh")], "doc_id long, text string")
    r = P.fingerprint_edits(one).first()
    assert r.edited_sha256 == hashlib.sha256(b"abcd abcd").hexdigest() and r.near_next == 1.0
    assert P.fingerprint_edits(one.limit(0)).count() == 0
    odd = spark.createDataFrame([(None, "nn"), (2, "bb"), (2, "aa"), (1, "cc")], "doc_id long, text string")
    got = sorted(r.edited_sha256 for r in P.fingerprint_edits(odd).collect())
    assert got == sorted(hashlib.sha256(x).hexdigest() for x in (b"ab", b"bc", b"cn", b"na"))
    assert P.fingerprint_edits(spark.createDataFrame([(None, "x y")], "doc_id long, text string")).count() == 1


def test_no_python_in_the_plan(spark, rows):
    plan = P.fingerprint_edits(spark.createDataFrame(rows, "doc_id long, text string"))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
