import random
import re

import pytest

from quirion.llm import line_dedup as L


def cut(text):
    """(start, end, number of the first word, words) of the clauses of a text, by a loop over its characters."""
    found, at, n, k = [], 0, 0, 0
    while k < len(text):
        end = k + 1
        if text[k] in ".,;:!?":
            while end < len(text) and text[end] in ".,;:!?":
                end += 1
        if text[k] in ".,;:!?\n" or end == len(text):
            stop = k if text[k] == "\n" else end
            words = text[at:stop].lower().split()
            if stop > at:
                found.append((at, stop, n, words))
            n += len(words)
            at = end
        k = end
    return found


def spec(rows, least=L.LEAST, passage=L.PASSAGE, fringe=L.FRINGE):
    """Passages by id and text, with words compared one by one."""
    docs = {}
    for i, text in rows:
        pieces = cut(text or "")
        docs[i, text or ""] = (pieces, [w for p in pieces for w in p[3]])
    hashed = {k: h for k, h in zip(docs, _hashes([t for _, t in docs]), strict=True)}
    rank = lambda k: (k[0] is None, k[0] or 0, hashed[k])
    first = {}
    for k in sorted(docs, key=rank):
        for p in docs[k][0]:
            if len(p[3]) >= least:
                first.setdefault(tuple(p[3]), (k, p))
    out = set()
    for k, (pieces, words) in docs.items():
        runs = []
        for a, b, at, unit in pieces:
            if len(unit) < least or first[tuple(unit)][0] == k and first[tuple(unit)][1][0] == a:
                continue
            source, (fa, _, fat, _) = first[tuple(unit)]
            other, p, q = docs[source][1], 0, 0
            while p < min(fringe, at, fat) and words[at - p - 1] == other[fat - p - 1]:
                p += 1
            end, fend = at + len(unit), fat + len(unit)
            while q < fringe and end + q < len(words) and fend + q < len(other) and words[end + q] == other[fend + q]:
                q += 1
            if runs and at - runs[-1]["stop"] <= runs[-1]["q"] + p:
                runs[-1] |= {"stop": end, "q": q, "b": b, "n": runs[-1]["n"] + 1}
            else:
                runs.append({"source": source, "at": at, "stop": end, "p": p, "q": q, "a": a, "b": b, "n": 1, "first": fa})
        for r in runs:
            size = r["stop"] - r["at"]
            if size + r["p"] + r["q"] >= passage:
                out.add((k, r["a"], r["b"], size, size + r["p"] + r["q"], r["n"], r["source"][0], r["first"]))
    return out


def _hashes(texts):
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    session = SparkSession.getActiveSession()
    if not texts:
        return []
    df = session.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, text string")
    return [r.h for r in df.select("k", F.xxhash64("text").alias("h")).orderBy("k").collect()]


def collected(df):
    return {(r.doc_id, r.start, r.end, r.n_words, r.shared_words, r.n_units, r.first_doc_id, r.first_start) for r in df.collect()}


@pytest.fixture(scope="module")
def words():
    rng = random.Random(2)
    return [("".join(rng.choice("abcdefgé") for _ in range(rng.randrange(1, 6)))) for _ in range(400)]


@pytest.fixture(scope="module")
def rows(words):
    rng = random.Random(2)
    sentence = lambda n: " ".join(rng.choice(words) + rng.choice(["", "", "", "", ","]) for _ in range(n)).capitalize() + rng.choice([".", "!", "?!", "..."])
    passages = [" ".join(sentence(rng.randrange(6, 14)) for _ in range(7)) for _ in range(4)]
    lines = [sentence(3), sentence(5), sentence(12)]
    out = []
    for k in range(300):
        parts = [" ".join(sentence(rng.randrange(1, 12)) for _ in range(rng.randrange(1, 6))) for _ in range(rng.randrange(1, 5))]
        if k % 3 == 0:
            parts.insert(rng.randrange(len(parts) + 1), rng.choice(lines))
        if k % 5 == 0:
            parts.append(f"{rng.choice(words)} {rng.choice(passages)} {sentence(4)}")
        if k % 7 == 0:
            parts.append(rng.choice(passages).upper())
        if k % 11 == 0:
            some = rng.choice(passages).split()
            at = rng.randrange(len(some) - 50) if len(some) > 50 else 0
            parts.append(" ".join([sentence(9)[:-1], *some[at : at + 52], sentence(9)]))
        out.append((k, "\n".join(parts)))
    return out + [(None, passages[0]), (900, None), (901, ""), (902, "\n\n"), out[0], out[15], (903, passages[1].replace(" ", "  ") + "\n" + passages[1])]


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, start int")


def test_equals_brute_force(spark, rows):
    for least, passage, many in ((5, 46, 60), (3, 0, 150), (8, 30, 60)):
        got = collected(L.repeated_passages(frame(spark, rows), least, passage))
        want = {(k[0], *rest) for k, *rest in spec(rows, least, passage)}
        assert got == want and len(want) > many


def test_planted_passages_that_begin_and_end_inside_sentences(spark, words):
    rng = random.Random(3)
    text = lambda n: " ".join(rng.choice(words) + rng.choice(["", "", "", "", "", ",", "."]) for _ in range(n))
    planted, short, out, holders = [text(55) for _ in range(20)], [text(35) for _ in range(20)], [], set()
    for k in range(200):
        own = text(rng.randrange(60, 200)).split()
        if k % 2:
            at = rng.randrange(len(own))
            own[at:at] = planted[k % 20].split()
            holders.add(k)
        elif k % 4:
            at = rng.randrange(len(own))
            own[at:at] = short[k % 20].split()  # a short piece isn't a passage
        out.append((k, " ".join(own)))
    got = {r.doc_id for r in L.repeated_passages(frame(spark, out)).collect()}
    firsts = {min(k for k in holders if k % 20 == p) for p in {k % 20 for k in holders}}
    assert got <= holders and len(got & (holders - firsts)) >= 0.97 * len(holders - firsts)


def test_null_ids_and_texts_of_one_id_are_documents_of_their_own(spark, words):
    rng = random.Random(4)
    text = lambda n: " ".join(rng.choice(words) + rng.choice(["", "", "", "", "."]) for _ in range(n))
    passage = text(70)
    first, alone, second = text(40) + ". " + passage, text(60), passage + ". " + text(40)
    for ids in ((None, None, None), (7, 7, 7)):
        docs = frame(spark, zip(ids, (first, alone, second), strict=True))
        found = L.repeated_passages(docs).collect()
        assert len(found) == 1 and found[0].doc_id == ids[0]
        kept = sorted(r.text for r in L.remove_repeats(docs).collect())
        assert alone in kept and (first in kept) != (second in kept)


def test_texts(spark, rows):
    docs = frame(spark, rows)
    got = L.remove_repeats(docs)
    assert got.columns == docs.columns
    spans = {}
    for k, a, b, *_ in spec(rows):
        spans.setdefault(k, []).append((a, b))
    want = sorted(((i, L.without(t, spans[i, t]) if t is not None and (i, t) in spans else t, 1) for i, t in rows), key=str)
    assert sorted(map(tuple, got.collect()), key=str) == want


def test_very_long_text(spark, words):
    rng = random.Random(5)
    passage = " ".join(rng.choice(words) + rng.choice(["", "", "", "."]) for _ in range(60))
    long = " ".join(rng.choice(words) + rng.choice(["", "", "", "."]) for _ in range(60_000))
    (found,) = L.repeated_passages(frame(spark, [(1, passage), (2, long + " " + passage + " " + long[:100])])).collect()
    assert found.doc_id == 2 and found.first_doc_id == 1 and found.start >= len(long) - 100


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert L.repeated_passages(docs).count() == 0 and L.remove_repeats(docs).count() == 0


def test_without():
    assert L.without("a\nbb\nc", [(2, 4)]) == "a\nc"
    assert L.without("x one. y", [(1, 6)]) == "x y"


def test_units_cover_the_text():
    text = "One two, three...four\nfive; six\n\n seven! "
    assert re.sub(r"\n", "", text) == "".join(text[a:b] for a, b, *_ in cut(text))
    assert [(a, b) for _, a, b, *_ in L.units(text, 1, {})] == [p[:2] for p in cut(text) if p[3]]
