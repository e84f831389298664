"""From files to events: decoding, errors, recognition, options."""

import json

import pytest

from quirion.conf import ChunkOptions
from quirion.operators import clean, events, layout
from quirion.plans import pipeline
from quirion.providers import EchoOcr, JsonDecoder, decoded_pages

LONG = "a line of text that is long enough to count as native text of its page"


def block(page, idx, text, y0=100.0):
    return {"page_number": page, "block_idx": idx, "text": text, "x0": 50.0, "x1": 500.0, "y0": y0, "y1": y0 + 20, "font_size": 11.0, "is_bold": False}


@pytest.fixture(scope="module")
def files(spark):
    contents = {
        1: [block(1, 0, LONG), block(1, 1, "more", 200.0), block(2, 0, "short")],
        2: "broken",
        3: [],
        4: None,
        5: [block(1, 0, "tiny")],
    }
    rows = [(k, None if v is None else bytearray(v.encode() if v == "broken" else json.dumps(v).encode())) for k, v in contents.items()]
    return spark.createDataFrame(rows, "doc_id long, content binary")


def test_decoded_pages_keep_errors_apart(files):
    rows = decoded_pages(files, JsonDecoder()).collect()
    by_doc = {k: [r for r in rows if r.doc_id == k] for k in range(1, 6)}
    assert [(r.page_number, r.page_w, r.page_h, len(r.spans), r.image_rects[0].w, r.error) for r in by_doc[1]] == [(1, 595.0, 842.0, 2, 100.0, None), (2, 595.0, 842.0, 1, 100.0, None)]
    assert by_doc[1][0].spans[0].text == LONG and by_doc[1][0].spans[0].y1 == 120.0 and bytes(by_doc[1][1].image_data) == b"ocr 2"
    assert by_doc[3] == []
    assert all(len(by_doc[k]) == 1 and by_doc[k][0].page_number is None and "Expecting value" in by_doc[k][0].error for k in (2, 4))
    assert decoded_pages(files.limit(0), JsonDecoder()).count() == 0


def test_events_of_files(files, tmp_path):
    got = pipeline.file_events(files, JsonDecoder(), ChunkOptions(), EchoOcr(), folder=str(tmp_path / "pages"))
    rows = sorted(((r.doc_id, r.status, r.text, r.total_chunks, r.error_message) for r in events.wire(got).collect()), key=str)
    assert ("COMPLETED", 2) in {(s, n) for k, s, _, n, _ in rows if k == 1}
    assert {t for k, _, t, _, _ in rows if k == 1 and t} == {LONG + "\n\nmore", "ocr 2"}  # the second page is recognised
    assert {t for k, _, t, _, _ in rows if k == 5 and t} == {"ocr 1"}
    assert sorted(k for k, s, *_ in rows if s == "FAILED") == [2, 4] and all("Expecting value" in e for _, s, _, _, e in rows if s == "FAILED")


def test_images_can_be_left_out(spark):
    pages = spark.createDataFrame([(1, 1, "own")], "doc_id long, page_number int, text string")
    blocks = spark.createDataFrame([(1, 1, 0, LONG, 0.0, 1.0, 100.0, 110.0, 12.0, False)], "doc_id long, page_number int, block_idx int, text string, x0 double, x1 double, y0 double, y1 double, font_size double, is_bold boolean")
    seen = spark.createDataFrame([(1, 1, 0, "a chart", True, None, 800, 400)], "doc_id long, page_number int, image_index int, description string, success boolean, error_type string, width int, height int")
    for wanted, many in ((True, 3), (False, 2)):
        options = ChunkOptions.resolve({"detect_images": wanted})
        rows = events.wire(pipeline.process(pages, blocks, options, seen)).collect()
        assert len(rows) == many and any("a chart" in (r.text or "") for r in rows) == wanted
    facts = [json.loads(r.chunk_metadata) for r in events.wire(pipeline.process(pages, blocks, ChunkOptions(), seen)).orderBy("part").collect() if r.chunk_metadata]
    assert facts[0] == {"chunking_method": "image_description", "image_index": 0, "width": 800, "height": 400, "processing_status": "success"}
    assert facts[1]["chunking_method"] == "page" and set(facts[1]) == {"chunking_method", "char_count", "word_count"}


def test_blocks_of_unknown_place_are_kept(spark):
    rows = [(1, 1, k, "left", 50.0, 200.0, 100.0 + k, 120.0) for k in range(4)] + [(1, 1, 4 + k, "right", 400.0, 550.0, 100.0 + k, 120.0) for k in range(4)]
    rows += [(1, 1, 8, "nowhere", None, None, None, None), (1, 1, 9, "half", 400.0, None, 90.0, 95.0), (1, 1, 10, "other half", None, 100.0, 90.0, 95.0)]
    found = layout.reading_order(spark.createDataFrame(rows, "doc_id long, page_number int, block_idx int, text string, x0 double, x1 double, y0 double, y1 double")).collect()
    assert {r.n_columns for r in found} == {2}
    assert {r.block_idx: r.zone for r in found} == {**{k: 0 for k in range(4)}, **{4 + k: 2 for k in range(4)}, 8: 1, 9: 2, 10: 0} and len(found) == 11


def test_noise_in_one_pass_equals_two(spark):
    rows = []
    for doc in range(6):
        for page in range(1, 1 + doc):
            rows += [(doc, page, 0, "Header", 10.0, 20.0), (doc, page, 1, f"body {page % 2}", 300.0, 320.0), (doc, page, 2, f" {page} ", 800.0, 820.0), (doc, page, 3, "Header" if page == 2 else None, 400.0, None), (doc, page, 4, "page foot" if page % 2 else "", None, 800.0)]
    blocks = spark.createDataFrame(rows, "doc_id long, page_number int, block_idx int, text string, y0 double, y1 double")
    counts = spark.createDataFrame([(d, d) for d in range(1, 6)], "doc_id long, n_pages int")
    two = clean.clean_blocks(blocks, clean.noise_texts(blocks, counts))
    one = clean.without_noise(blocks, counts)
    assert one.columns == blocks.columns
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, two.select(*blocks.columns).collect()))
