import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quirion.llm import language_id as L

SF = "/root/testdata/sf0.01"


def test_gradients_equal_differences():
    rng = np.random.default_rng(0)
    net = L.Network(["a", "b", "c"], hidden=4)
    net.params = {k: v.astype(np.float64) for k, v in net.params.items()}
    x = rng.integers(0, 256, (5, 7)).astype(np.int16)
    x[1, 4:] = L.PAD
    y = rng.integers(0, 3, 5)
    _, grads = net.gradients(x, y)
    for name, g in grads.items():
        places = np.argwhere(np.abs(g) > 1e-7)
        for at in places[rng.permutation(len(places))[:25]]:
            at = tuple(at)
            if name == "table" and at[1] == L.PAD:
                continue
            kept, step = net.params[name][at], 1e-2
            net.params[name][at] = kept + step
            up = net.gradients(x, y)[0]
            net.params[name][at] = kept - step
            down = net.gradients(x, y)[0]
            net.params[name][at] = kept
            assert abs((up - down) / (2 * step) - g[at]) < 2e-3 * max(1, abs(g[at])), (name, at)


def test_padding_changes_nothing():
    net = L.Network(["a", "b"])
    data = np.arange(40, dtype=np.int16)[None]
    padded = np.concatenate([data, np.full((1, 24), L.PAD, np.int16)], axis=1)
    assert np.allclose(net.probabilities(padded)[:, :40], net.probabilities(data), atol=1e-5)


def test_probabilities_equal_plain_loops():
    """Each position by the equations of a gated recurrent unit, one number at a time."""
    import math

    net = L.Network(["a", "b", "c"], hidden=3, seed=4)
    data = [5, 200, 17, 17, 99, 0, 255]
    p = {k: v.astype(float) for k, v in net.params.items()}
    n, sig = net.hidden, lambda v: 1 / (1 + math.exp(-v))
    states = [[], []]
    for way, order in ((0, data), (1, data[::-1])):
        h = [0.0] * n
        for byte in order:
            row, inside = p["table"][way][byte], [sum(h[i] * p["inner"][way][i][j] for i in range(n)) for j in range(3 * n)]
            z = [sig(row[j] + inside[j]) for j in range(n)]
            r = [sig(row[n + j] + inside[n + j]) for j in range(n)]
            new = [math.tanh(row[2 * n + j] + r[j] * inside[2 * n + j]) for j in range(n)]
            h = [z[j] * h[j] + (1 - z[j]) * new[j] for j in range(n)]
            states[way].append(h)
    want = []
    for ahead, back in zip(states[0], states[1][::-1], strict=True):
        both = ahead + back
        e = [math.exp(sum(both[i] * p["out"][i][k] for i in range(2 * n)) + p["bias"][k]) for k in range(3)]
        want.append([x / sum(e) for x in e])
    assert np.allclose(net.probabilities(np.array([data], np.int16))[0], want, atol=1e-5)


def test_rows_of_equal_or_null_ids_are_learned_from(spark, monkeypatch):
    monkeypatch.setattr(L, "DOCUMENTS", 30)
    for i in (None, 8):
        rows = [(i, f"{'the of and' if k % 2 else 'der und die'} {k}", "en" if k % 2 else "de") for k in range(3000)]
        rows += [(i, "copy of a copy", "en")] * 2000
        net = L.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
        assert net.languages == ["de", "en"] and net.predict(["der und die 7", "the of and 8"])[0] == ["de", "en"]


def test_more_languages_than_are_learned(spark, monkeypatch):
    monkeypatch.setattr(L, "LANGUAGES", 2)
    rows = [(k, f"text {k}", "abbccc"[k % 6]) for k in range(120)]
    assert L.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string")).languages == ["b", "c"]


@pytest.fixture(scope="module")
def learned(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    return docs, L.learn(docs)


def test_held_out_accuracy(learned):
    docs, net = learned
    got = L.predict(docs, net).join(docs.select("doc_id", "lang", "text"), "doc_id").collect()
    assert len(got) == docs.count()
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert r.lang_pred in net.languages and 0 < r.score <= 1
    out = [r for r in got if r.held_out and len(r.text) >= 40]
    assert len(out) > 100 and np.mean([r.lang == r.lang_pred for r in out]) >= 0.98


def test_labels_of_held_out_rows_are_not_learned(spark, learned):
    docs, net = learned
    masked = docs.withColumn("lang", F.when(L.held_out("doc_id"), F.lit("xx")).otherwise(F.col("lang")))
    other = L.learn(masked)
    assert other.languages == net.languages
    assert all(np.array_equal(a, other.params[k]) for k, a in net.params.items())


def test_edges(spark, learned):
    _, net = learned
    rng = random.Random(1)
    texts = [None, "", "123 !! \n", "é", "The thing is that they were on the road. " * 3000, "\U0001f642", "".join(rng.choice("aé漢 ") for _ in range(500))]
    docs = spark.createDataFrame([(k, t, "zz", 0.0) for k, t in enumerate(texts)] + [(None, "the", None, 0.0), (1, "", None, 0.0)], "doc_id long, text string, lang string, score double")
    got = {r.doc_id: r for r in L.predict(docs, net).collect()}
    assert len(got) == 8
    for k in (0, 1, 2, 5):
        assert (got[k].lang_pred, got[k].score) == (L.UNKNOWN, 0.0)
    assert got[3].lang_pred != L.UNKNOWN and got[4].lang_pred in net.languages
    kept = L.keep_known(docs, net, 0.0)
    assert kept.schema == docs.schema and sorted(r.doc_id or -1 for r in kept.collect()) == [-1, 3, 4, 6]
    none = L.learn(docs.limit(0))
    assert {r.lang_pred for r in L.predict(docs, none).collect()} == {L.UNKNOWN}
    assert L.predict(docs.limit(0), net).count() == 0
