import random
import re

import pytest

from quirion.conf import ChunkOptions, EngineConf
from quirion.operators import chunk
from quirion.providers import HashEmbedder


def spec_paragraphs(pages, least):
    whole, starts = "", []
    for k, (number, text) in enumerate(pages):
        whole += "\n" if k else ""
        starts.append((len(whole), number))
        whole += text
    out, at = [], 0
    for part in re.split(r"(\n{2,})", whole):
        if not re.fullmatch(r"\n{2,}", part) and len(part.strip()) >= least:
            out.append((part.strip(), [n for s, n in starts if s <= at][-1]))
        at += len(part)
    return out


def spec_packed(paras, size, overlap):
    chunks, now = [], []
    for p in paras:
        if now and sum(len(t) for t, _ in now) + len(p[0]) > size:
            chunks.append(now)
            tail, total = [], 0
            for q in reversed(now):
                if overlap and total + len(q[0]) <= overlap:
                    tail.insert(0, q)
                    total += len(q[0])
                else:
                    break
            now = tail
        now = [*now, p]
    return [*chunks, now] if now else chunks


@pytest.fixture(scope="module")
def documents():
    rng = random.Random(4)
    text = lambda: "".join(rng.choice(["ab ", "cdé", "\n", "\n\n", "\n\n\n", "word word", " "]) for _ in range(rng.randrange(0, 40)))
    return {d: [(k + 1, text()) for k in range(rng.randrange(1, 6))] for d in range(60)} | {60: [(1, "")], 61: [(1, "a" * 500), (2, ""), (3, "b" * 20)]}


@pytest.mark.parametrize(("size", "least", "overlap"), [(60, 4, 0), (60, 4, 25), (20, 8, 20), (1000, 4, 0), (30, 4, 100)])
def test_paragraph_chunks_equal_a_plain_loop(spark, documents, size, least, overlap):
    options = ChunkOptions.resolve({"chunk_size": size, "min_chunk_size": least, "chunk_overlap": overlap})
    pages = spark.createDataFrame([(d, n, t) for d, ps in documents.items() for n, t in ps], "doc_id long, page_number int, text string")
    got = {(r.doc_id, r.chunk_index): (r.content, list(r.page_numbers), r.paragraph_count) for r in chunk.paragraph_chunks(pages, options).collect()}
    want = {}
    for d, ps in documents.items():
        for k, c in enumerate(spec_packed(spec_paragraphs(ps, max(1, least // 4)), size, overlap)):
            want[d, k] = ("\n\n".join(t for t, _ in c), sorted({n for _, n in c}), len(c))
    assert got == want


def test_results_do_not_depend_on_partitions_or_order(spark, documents):
    options = ChunkOptions.resolve({"chunk_size": 60, "min_chunk_size": 4})
    rows = [(d, n, t) for d, ps in documents.items() for n, t in ps]
    results = []
    for parts in (1, 7):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        random.Random(parts).shuffle(rows)
        results.append(sorted(map(str, chunk.hybrid_chunks(spark.createDataFrame(rows, "doc_id long, page_number int, text string"), options).collect())))
    spark.conf.set("spark.sql.shuffle.partitions", 8)
    assert results[0] == results[1]


def test_similar_neighbours_share_a_chunk(spark):
    paras = spark.createDataFrame(
        [(1, 1, "aaaa", 1, [1.0, 0.0]), (1, 2, "bbbb", 1, [1.0, 0.1]), (1, 3, "cccc", 2, [0.0, 1.0]), (1, 4, "dddd", 2, [0.0, 0.0]), (1, 5, "eeee", 2, [0.0, 0.0])],
        "doc_id long, seq int, text string, page_number int, embedding array<float>",
    )
    options = ChunkOptions.resolve({"similarity_threshold": 0.7})
    assert [r.content for r in chunk.semantic_groups(paras, options).orderBy("chunk_index").collect()] == ["aaaa\n\nbbbb", "cccc", "dddd", "eeee"]
    # A threshold of zero counts: vectors without length have similarity zero.
    zero = ChunkOptions.resolve({"similarity_threshold": 0.0})
    assert chunk.semantic_groups(paras, zero).count() == 1
    small = ChunkOptions.resolve({"similarity_threshold": 0.0, "chunk_size": 8})
    assert [r.char_count for r in chunk.semantic_groups(paras, small).orderBy("chunk_index").collect()] == [10, 10, 4]


def test_embedder(spark):
    pages = spark.createDataFrame([(1, 1, "same words here\n\nsame words here\n\nquite other stuff")], "doc_id long, page_number int, text string")
    got = chunk.semantic_chunks(pages, ChunkOptions.resolve({"min_chunk_size": 4}), HashEmbedder()).orderBy("chunk_index").collect()
    assert [r.content for r in got] == ["same words here\n\nsame words here", "quite other stuff"]


def test_dispatch(spark, documents, caplog):
    pages = spark.createDataFrame([(1, 1, " one "), (1, 2, "\xa0"), (1, 3, None), (1, 4, "two three")], "doc_id long, page_number int, text string")
    for strategy in (None, "", "PAGE", "unheard of"):
        got = chunk.chunk(pages, ChunkOptions.resolve({"chunk_strategy": strategy})).orderBy("chunk_index").collect()
        assert [(r.content, r.page_numbers, r.word_count, r.char_count) for r in got] == [("one", [1], 1, 3), ("two three", [4], 2, 9)]
    assert "unheard of" in caplog.text
    assert chunk.chunk(pages, ChunkOptions.resolve({"chunk_strategy": "Paragraph", "min_chunk_size": 4})).first().chunking_method == "paragraph"
    assert chunk.chunk(pages.limit(0), ChunkOptions.resolve({"chunk_strategy": "hybrid"})).count() == 0


def test_options():
    o = ChunkOptions.resolve({"chunk_size": 0, "min_chunk_size": None, "similarity_threshold": 0.0}, EngineConf(chunk_size=123))
    assert (o.chunk_size, o.min_chunk_size, o.similarity_threshold, o.min_paragraph, o.strategy) == (123, 200, 0.0, 50, "page")
    with pytest.raises(ValueError, match="None"):
        ChunkOptions.resolve({"similarity_threshold": None})


def test_plan_has_no_python_and_shuffles_by_document_only(spark, documents):
    pages = spark.createDataFrame([(1, 1, "x")], "doc_id long, page_number int, text string")
    plan = chunk.paragraph_chunks(pages, ChunkOptions())._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
    assert set(re.findall(r"hashpartitioning\(([a-z_]+)", plan)) == {"doc_id"}
