import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from quirion.llm import token_store as S
from quirion.llm.queries import byte_bpe


def test_index_finds_what_it_holds_and_little_else():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 1000, 30_000):
        ids = rng.choice(10 * n + 1, n, replace=False).astype(np.int64) - n
        hashes = S.key_hashes(ids, np.zeros(n, np.int64))
        starts, lengths = rng.integers(0, 1 << 40, n), rng.integers(0, 99, n)
        built = S.Index.build(hashes, starts, lengths)
        assert sorted(built.slots(hashes)) == list(range(n))  # minimal and perfect
        index, width = S.Index.from_bytes(built.to_bytes(2))
        assert width == 2
        at, sizes = index.find(hashes)
        assert (at == starts).all() and (sizes == lengths).all()
        other = S.key_hashes(np.arange(20 * n + 50, 20 * n + 5050), np.zeros(5000, np.int64))
        assert (index.find(other)[1] == -1).mean() > 0.999


def test_keys_of_repeated_and_null_ids():
    ids, numbers = S.numbered(np.array([0, 0, 0, 5, 5, 7]), np.array([True, True, False, False, False, False]))
    assert numbers.tolist() == [-1, -2, 0, 0, 1, 0]
    assert len(set(S.key_hashes(ids, numbers).tolist())) == 6


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdeé漢🙂12'., ") for _ in range(rng.randrange(1, 9)))
    texts = [" ".join(word() for _ in range(rng.randrange(120))) for _ in range(500)] + [None, "", "<|endoftext|> x<|endoftext|>", "z" * 40_000, "  \n\n "]
    rng.shuffle(texts)
    ids = [rng.randrange(-(1 << 62), 0) for _ in range(200)] + list(range(len(texts) - 200))
    return list(zip(ids, texts, strict=True)) + [(3, "again"), (3, "again"), (None, "no id"), (None, None)]


def test_round_trip(spark, rows, monkeypatch):
    monkeypatch.setattr(S, "REMEMBERED", 300)
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    docs = spark.createDataFrame([(*r, 1.5) for r in rows], "doc_id long, text string, start double")
    got = sorted(map(tuple, S.read_store(S.write_store(docs, byte_bpe, end=0), docs).collect()), key=str)
    want, start = [], 0
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == sorted(want, key=str)


def test_empty_and_unknown(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert S.read_store(S.write_store(docs.limit(0), byte_bpe, end=None), docs.limit(0)).count() == 0
    store = S.write_store(docs, byte_bpe, end=None)
    assert [r.n_tokens for r in S.read_store(store, docs).collect()] == [2]
    with pytest.raises(Exception, match="doesn't hold"):
        S.read_store(store, spark.createDataFrame([(99,)], "doc_id long")).collect()


def test_keys_of_one_hash_take_another_seed(monkeypatch):
    real = S.key_hashes
    monkeypatch.setattr(S, "key_hashes", lambda ids, numbers, seed=0: real(ids, numbers, seed) // (np.uint64(1 << 62) if seed < 2 else np.uint64(1)))
    ids, numbers = S.numbered(np.array([4, 4, 4, 5, 5, 7]), np.zeros(6, bool))
    built = S.Index.of_keys(ids, numbers, np.arange(6), np.arange(6))
    index, _ = S.Index.from_bytes(built.to_bytes(4))
    assert index.seed == 2 and index.find(S.key_hashes(ids, numbers, index.seed))[0].tolist() == list(range(6))
    with pytest.raises(ValueError, match="distinct"):
        S.Index.of_keys(np.array([1, 1]), np.array([0, 0]), np.zeros(2), np.zeros(2))


def test_shards_hold_equal_bytes_and_a_task_each(spark):
    rows = [(k, "x" * (10 if k < 3000 else 1000)) for k in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    store = S.Store(spark, "unused", S._cuts(docs, "doc_id", "text", 16), [])
    held = {}
    for i, text in rows:
        shard = sum(c < i for c in store.cuts)
        held[shard] = held.get(shard, 0) + len(text)
    assert 12 <= len(held) <= 20 and max(held.values()) < 2 * sum(held.values()) / len(held)
    placed = store.dealt(docs.withColumnRenamed("doc_id", "id")).selectExpr("shard", "spark_partition_id() AS task").distinct().collect()
    assert sorted(r.shard for r in placed) == sorted(r.task for r in placed) == sorted(held)


def test_ids_that_are_no_numbers(spark):
    docs = spark.createDataFrame([("a", "b")], "doc_id string, text string")
    with pytest.raises(TypeError, match="whole numbers"):
        S.write_store(docs, byte_bpe, end=0)


def test_query_leaves_no_files(spark):
    from pathlib import Path

    from quirion.llm import common, queries

    top = Path(common.shared_dir(spark).removeprefix("file:").replace("//", "/"))
    before = set(top.glob("quirion-tokens-*"))
    queries.op7_token_store(spark, "/root/testdata/sf0.001").count()
    assert set(top.glob("quirion-tokens-*")) == before
