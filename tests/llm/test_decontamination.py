import random

import numpy as np
import pytest

from quirion.llm import decontamination as D


def brute_score(item, words):
    """Smith-Waterman, cell by cell, over the whole document."""
    best, row = 0, [0] * (len(words) + 1)
    for a in item:
        new = [0]
        for j, b in enumerate(words, 1):
            new.append(max(0, row[j - 1] + (2 if a == b else -1), row[j] - 1, new[-1] - 1))
        row = new
        best = max(best, max(row))
    return best


def test_alignment_equals_brute_force():
    rng = random.Random(1)
    for _ in range(300):
        a = [rng.randrange(5) for _ in range(rng.randrange(1, 12))]
        b = [rng.randrange(-1, 5) for _ in range(rng.randrange(1, 25))]
        assert D.aligned(np.array(a), np.array(b))[0] == brute_score(a, b)


@pytest.fixture(scope="module")
def data():
    rng = random.Random(9)
    vocabulary = ["".join(rng.choice("abcdeéñ") for _ in range(rng.randrange(2, 6))) for _ in range(400)]
    prose = lambda n: [rng.choice(vocabulary[:30] if rng.random() < 0.5 else vocabulary) for _ in range(n)]
    items = [(k, " ".join(prose(rng.randrange(12, 50)))) for k in range(25)] + [(90, "one two"), (91, None), (92, ""), (93, " ".join(vocabulary[:5]))]
    docs = []
    for k in range(400):
        words = prose(rng.randrange(0, 200))
        if k % 4 == 0:
            copy = items[rng.randrange(25)][1].split(" ")
            for _ in range(rng.choice([0, 0, 2, len(copy) // 6])):
                copy[rng.randrange(len(copy))] = "edit"
            at = rng.randrange(len(words) + 1)
            words[at:at] = copy
        docs.append((k, ", ".join(words).upper() if k % 5 == 0 else " ".join(words), k))
    docs += [(1000, None, 0), (1001, "", 0), (1002, " ".join(vocabulary[:5]), 0), (1003, " ".join(vocabulary[:4]), 0), docs[4]]
    docs += [(2000 + k, "Some say: " + items[3][1] + "!", 0) for k in range(300)]
    return docs, items


def test_equals_brute_force(spark, data):
    docs, items = data
    got = D.find_leaks(spark.createDataFrame(docs, "doc_id long, text string, score int"), spark.createDataFrame(items, "item_id long, text string")).collect()
    want = {}
    for i, text, _ in docs:
        words = D.words_of(text)
        for k, item in items:
            item_words = D.words_of(item)
            if len(item_words) >= 3 and len(set(item_words) & set(words)) >= 2:
                score = brute_score(item_words, words) / (2 * len(item_words))
                if score >= (1 if len(item_words) < 8 else 0.5):
                    want[i, k] = score
    assert {(r.doc_id, r.item_id): r.score for r in got} == pytest.approx(want)
    assert len(got) == len(want) + sum(i == docs[4][0] for i, _ in want)
    texts = {i: t for i, t, _ in docs}
    for r in got:
        if r.doc_id >= 2000:
            assert texts[r.doc_id][r.start : r.end] == items[3][1]


def test_blocks_and_filter(spark, data, monkeypatch):
    docs, items = data
    frame, bench = spark.createDataFrame(docs, "doc_id long, text string, item_id int"), spark.createDataFrame(items, "item_id long, text string")
    whole = {(r.doc_id, r.item_id) for r in D.find_leaks(frame, bench).collect()}
    monkeypatch.setattr(D, "BLOCK", 200)
    assert {(r.doc_id, r.item_id) for r in D.find_leaks(frame, bench).collect()} == whole
    kept = D.decontaminate(frame, bench)
    assert kept.schema == frame.schema
    leaked = {i for i, _ in whole}
    assert sorted(map(tuple, kept.collect()), key=str) == sorted((r for r in docs if r[0] not in leaked), key=str)


def test_empty(spark, data):
    docs, items = data
    frame, bench = spark.createDataFrame(docs[:5], "doc_id long, text string, n int"), spark.createDataFrame(items, "item_id long, text string")
    assert D.find_leaks(frame.limit(0), bench).count() == 0
    assert D.find_leaks(frame, bench.limit(0)).count() == 0
    assert D.decontaminate(frame, bench.limit(0)).count() == 5


def test_edited_copies_against_full_alignment(spark):
    rng = random.Random(20)
    vocabulary = ["".join(rng.choice("abcdefg") for _ in range(4)) for _ in range(900)]
    items = [(k, [rng.choice(vocabulary) for _ in range(40)]) for k in range(12)]
    prose = lambda: [rng.choice(vocabulary) for _ in range(60)]
    docs = []
    for k, item in items:
        exact = rng.randrange(4)  # beside the edited copies, so that broken runs are rarer than some that are left
        docs += [(1000 * k + n, prose() + item + prose()) for n in range(exact)]
        for n, every in enumerate((4, 5)):
            copy = ["edit" if at % every == every - 1 else w for at, w in enumerate(item)]
            docs.append((1000 * k + 10 + n, prose() + copy + prose()))
        for n, share in enumerate((0.2, 0.25)):
            gone = set(rng.sample(range(40), round(40 * share)))
            docs.append((1000 * k + 20 + n, prose() + ["edit" if at in gone else w for at, w in enumerate(item)] + prose()))
        docs.append((1000 * k + 30, prose() + item[:20] + ["more"] * 30 + item[20:] + prose()))
    want = {}
    for i, words in docs:
        for k, item in items:
            score = brute_score(item, words) / 80
            if score >= 0.5:
                want[i, k] = score
    assert len(want) >= 5 * 12
    frame = spark.createDataFrame([(i, " ".join(w)) for i, w in docs], "doc_id long, text string")
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in items], "item_id long, text string")
    assert {(r.doc_id, r.item_id): r.score for r in D.find_leaks(frame, bench).collect()} == pytest.approx(want)
    assert D.decontaminate(frame, bench).count() == len(docs) - len({i for i, _ in want})


def test_short_items_match_in_full(spark):
    items = [(1, "one two"), (2, "solo"), (3, "three in row"), (4, "...")]
    docs = [(1, "x One, two y"), (2, "one x two"), (3, "a solo b"), (4, "soloist three in a row"), (5, "Three in row"), (6, "three in")]
    frame, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id, r.score, r.start, r.end) for r in D.find_leaks(frame, bench).collect()}
    assert got == {(1, 1, 1.0, 2, 10), (3, 2, 1.0, 2, 6), (5, 3, 1.0, 0, 12)}
    assert sorted(r.doc_id for r in D.decontaminate(frame, bench).collect()) == [2, 4, 6]


def test_offsets_are_those_of_the_text(spark):
    item = "Quite a long item with nine words in it"
    docs = [(1, "\u0130" * 6 + " " + item.upper() + " end"), (None, "\u0130stanbul " + item), (None, "\u0130 " + "w " * 30_000 + item + " x" * 30_000)]
    frame, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(7, item), (None, "\u0130stanbul")], "item_id long, text string")
    rows = D.find_leaks(frame, bench).collect()
    texts = {t[r.start : r.end].lower() for r in rows for i, t in docs if r.item_id == 7 and i == r.doc_id and len(t) > r.end}
    assert len(rows) == 4 and item.lower() in texts
    assert [(r.start, r.end) for r in rows if r.doc_id == 1] == [(7, 7 + len(item))]
