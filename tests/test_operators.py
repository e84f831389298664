import numpy as np
import pytest

from quirion import providers
from quirion.conf import ChunkOptions, EngineConf, VisionOptions
from quirion.operators import clean, detect, events, extract, images, layout, preprocess, sections
from quirion.plans import pipeline
from quirion.schema import BLOCK, IMAGE, PAGE_STATS, SPAN


def blocks(spark, rows):
    """Rows of (page, idx, text, x0, x1, y0, y1, size, bold), of document 1."""
    return spark.createDataFrame([(1, *r) for r in rows], BLOCK)


def test_areas(spark):
    frame = blocks(spark, [
        (1, 0, "top", 0.0, 9.0, 10.0, 84.0, 12.0, False), (1, 1, "low", 0.0, 9.0, 758.0, 800.0, 12.0, False), (1, 2, "Big", 0.0, 9.0, 100.0, 120.0, 20.0, False),
        (1, 3, "b" * 150, 0.0, 9.0, 130.0, 150.0, 20.0, False), (1, 4, "• item", 0.0, 9.0, 160.0, 170.0, 12.0, False), (1, 5, "2) item", 0.0, 9.0, 180.0, 190.0, 12.0, False),
        (1, 6, "²) item", 0.0, 9.0, 180.0, 190.0, None, None), (1, 7, "1.", 0.0, 9.0, 200.0, 210.0, 0.0, False), (1, 8, None, None, None, None, None, None, None),
    ])
    got = {r.block_idx: r.area_type for r in layout.classify_areas(frame).collect()}
    assert got == {0: "header", 1: "footer", 2: "title", 3: "paragraph", 4: "list", 5: "list", 6: "list", 7: "paragraph", 8: "header"}


def test_two_columns_repeat_what_is_in_both(spark):
    rows = [(1, 0, "L1", 50.0, 250.0, 100.0, 110.0, 12.0, False), (1, 1, "R1", 350.0, 540.0, 90.0, 110.0, 12.0, False), (1, 2, "L2", 50.0, 250.0, 200.0, 210.0, 12.0, False),
            (1, 3, "R2", 350.0, 540.0, 300.0, 310.0, 12.0, False), (1, 4, "mid", 270.0, 325.0, 50.0, 60.0, 12.0, False), (1, 5, "wide", 50.0, 540.0, 400.0, 410.0, 12.0, False)]
    got = [r.text for r in layout.reading_order(blocks(spark, rows)).orderBy("reading_idx").collect()]
    assert got == ["mid", "L1", "L2", "wide", "mid", "R1", "R2"]
    one = [r.text for r in layout.reading_order(blocks(spark, rows[:1] + rows[4:])).orderBy("reading_idx").collect()]
    assert one == ["mid", "L1", "wide"]


def test_page_without_blocks_keeps_its_text(spark):
    pages = spark.createDataFrame([(1, 1, "own"), (1, 2, "own")], "doc_id long, page_number int, text string")
    frame = blocks(spark, [(1, 0, " x ", 0.0, 9.0, 10.0, 20.0, 12.0, False), (1, 1, "\xa0", 0.0, 9.0, 30.0, 40.0, 12.0, False)])
    got = {r.page_number: r.text for r in layout.ordered_text(pages, layout.reading_order(frame)).collect()}
    assert got == {1: " x ", 2: "own"}


def test_noise_is_document_wide_and_by_document(spark):
    rows = []
    for d in (1, 2, 3):
        for p in (1, 2) if d < 3 else (1,):
            rows += [(d, p, 0, " Tribunal ", 0.0, 9.0, 10.0, 20.0, 9.0, False), (d, p, 1, f"body {d} {p}", 0.0, 9.0, 300.0, 310.0, 9.0, False), (d, p, 2, f"- {p} -", 0.0, 9.0, 800.0, 810.0, 9.0, False)]
    rows += [(1, 1, 3, "Tribunal", 0.0, 9.0, 400.0, 410.0, 9.0, False), (2, 2, 3, "Página 7", 0.0, 9.0, 400.0, 410.0, 9.0, False), (2, 2, 4, "ab", 0.0, 9.0, 400.0, 410.0, 9.0, False)]
    frame = spark.createDataFrame(rows, BLOCK)
    counts = spark.createDataFrame([(1, 2), (2, 2), (3, 1)], "doc_id long, n_pages int")
    noise = clean.noise_texts(frame, counts)
    kept = {(r.doc_id, r.page_number, r.text) for r in clean.clean_blocks(frame, noise).collect()}
    assert kept == {(1, 1, "body 1 1"), (1, 2, "body 1 2"), (2, 1, "body 2 1"), (2, 2, "body 2 2"), (3, 1, " Tribunal "), (3, 1, "body 3 1"), (3, 1, "- 1 -")}
    pages = spark.createDataFrame([(1, 1, "x"), (1, 9, "x")], "doc_id long, page_number int, text string")
    assert {r.page_number: r.text for r in clean.clean_pages(pages, clean.clean_blocks(frame, noise)).collect()} == {1: "body 1 1", 9: ""}


@pytest.mark.parametrize(("text", "is_number"), [("12", True), ("Página 3", True), ("págin 3", True), ("Pagina 3", False), ("1 / 22", True), ("- 4 -", True), ("x 4", False), ("12\n", True), ("٣", True)])
def test_page_numbers(spark, text, is_number):
    frame = blocks(spark, [(1, 0, text, 0.0, 9.0, 300.0, 310.0, 9.0, False)])
    assert clean.noise_texts(frame, spark.createDataFrame([(1, 2)], "doc_id long, n_pages int")).count() == is_number


@pytest.mark.parametrize(("text", "size", "kind", "confidence"), [
    ("DOS FATOS", 12.0, "fatos", 0.9), ("RELATÓRIO", 12.0, "fatos", 0.9), ("o relatório diz", 12.0, "fatos", 0.7), ("pede deferimento", 99.0, "pedidos", 0.9),
    ("uma autorização", 12.0, "qualificacao_partes", 0.7), ("nada", 12.0, "custom", 0.3), (" \xa0", 12.0, "custom", 0.0), ("x" * 201 + " ementa", 12.0, "custom", 0.3),
    ("Nº 10 EMENTA", 12.0, "ementa", 0.7), ("art.  5", 12.0, "clausula", 0.7),
])
def test_sections(spark, text, size, kind, confidence):
    frame = blocks(spark, [(1, 0, text, 0.0, 9.0, 1.0, 2.0, size, False), (1, 1, "other", 0.0, 9.0, 1.0, 2.0, 12.0, False), (1, 2, "other", 0.0, 9.0, 1.0, 2.0, 12.0, False)])
    r = sections.classify_sections(frame).filter("block_idx = 0").first()
    assert (r.section_type, r.section_confidence) == (kind, confidence)


def test_section_matches_in_order(spark):
    got = spark.createDataFrame([("Relatório e conclusão",)], "t string").select(sections.section_matches("t")).first()[0]
    assert got == ["fatos", "pedidos", "relatorio"]


def test_types(spark):
    page = lambda d, p, n: (d, p, "x" * n, 10.0, 10.0, [(2.0, 5.0)])
    frame = spark.createDataFrame([page(1, 1, 50), page(1, 2, 60), page(2, 1, 0), page(3, 1, 50), page(3, 2, 49), (4, 1, None, 0.0, 0.0, None)], PAGE_STATS)
    got = {r.doc_id: r for r in detect.document_types(frame).collect()}
    assert {d: (r.pdf_type, r.confidence) for d, r in got.items()} == {1: ("digital", 1.0), 2: ("scanned", 1.0), 3: ("hybrid", 0.8), 4: ("scanned", 1.0)}
    assert (got[3].digital_pages, got[3].scanned_pages, got[1].text_density, got[1].image_density) == ([1], [2], 55.0, 0.1)


def test_spans(spark):
    rows = [(1, 1, 0, 0, 0, 0, "Hello", 10.0, 0), (1, 1, 0, 0, 1, 0, " ", 99.0, 16), (1, 1, 0, 0, 2, 0, "there", None, 20), (1, 1, 0, 1, 0, 0, "next", 14.0, 0), (1, 1, 1, 0, 0, 1, "image", 9.0, 0), (1, 1, 2, 0, 0, 0, "\xa0", 9.0, 0)]
    got = extract.blocks_from_spans(spark.createDataFrame(rows, SPAN)).collect()
    assert [(r.text, r.font_size, r.is_bold) for r in got] == [("Hello there\nnext", 12.0, True)]


def test_images(spark):
    box = lambda y: (0.0, y, 10.0, y + 40)
    rows = [(1, 1, 0, box(10.0), 842.0, 900, 300, b"a", "3", "png"), (1, 1, 1, None, 842.0, 900, 300, b"b", "Gray", "png"), (1, 2, 0, box(400.0), 842.0, 900, 300, b"b", "3", "png"),
            (1, 3, 0, box(400.0), 842.0, 699, 300, b"c", "3", "png"), (2, 1, 0, box(400.0), 842.0, 900, 300, b"b", "3", "png")]
    frame = spark.createDataFrame(rows, IMAGE)
    keys = lambda df: sorted((r.doc_id, r.page_number, r.image_index) for r in df.collect())
    assert keys(images.smart_images(frame)) == [(1, 1, 1), (2, 1, 0)]
    assert keys(images.smart_images(frame, most=2)) == [(1, 1, 1), (1, 2, 0), (2, 1, 0)]
    assert {r.colorspace for r in images.smart_images(frame).collect()} == {"Gray", "rgb"}
    assert len(keys(images.basic_images(frame, spark.createDataFrame([(1,), (1,), (7,)], "page_number int")))) == 6


def test_descriptions(spark):
    frame = spark.createDataFrame([(1, 1, 0, None, 842.0, 900, 300, b"abc", "3", "png")], IMAGE)

    class Broken:
        def describe(self, image, mime, prompt):
            raise RuntimeError("no")

    for provider, kind in ((providers.EchoVision(), None), (object(), "no_vision_support"), (Broken(), "processing_error")):
        r = images.descriptions(providers.described(frame, provider, "", delay=0.0)).first()
        assert r.error_type == kind and r.success == (kind is None)
        assert r.description == "image/jpeg 4" if kind is None else "900x300px" in r.description
    said = images.descriptions(providers.described(frame, providers.EchoVision(), ""))
    assert images.image_chunks(said).first().content == "[IMAGEM 1 - Página 1]: image/jpeg 4"
    pages = spark.createDataFrame([(1, 1, "text"), (1, 2, "other")], "doc_id long, page_number int, text string")
    got = images.enriched_pages(pages, said).orderBy("page_number").collect()
    assert [r.text for r in got] == ["text\n\n[IMAGEM 1 - Página 1]: image/jpeg 4", "other"]
    assert got[0].image_descriptions[0].description == "image/jpeg 4" and got[1].image_descriptions is None


def test_routes_recognise_only_what_they_must(spark):
    rows = [(1, 1, "x" * 60, 1.0, 1.0, [], b"seen 1"), (1, 2, "", 1.0, 1.0, [], b"seen 2"), (2, 1, "y" * 60, 1.0, 1.0, [], b"\xff broken")]
    frame = spark.createDataFrame(rows, PAGE_STATS + ", image_data BINARY")
    got = {(r.doc_id, r.page_number): r.text for r in pipeline.native_or_recognised(frame, detect.document_types(frame), providers.EchoOcr()).collect()}
    assert got == {(1, 1): "x" * 60, (1, 2): "seen 2", (2, 1): "y" * 60}
    errors = providers.recognised(frame.filter("doc_id = 2"), providers.EchoOcr()).first()
    assert errors.ocr_error and errors.text != errors.image_data


def test_events(spark):
    chunks = spark.createDataFrame([(1, 0, "image", [1], "image_description"), (1, 0, "a", [1], "page"), (1, 1, "b", [2], "semantic")], "doc_id long, chunk_index int, content string, page_numbers array<int>, chunking_method string")
    docs = spark.createDataFrame([(1,), (1,), (2,), (3,)], "doc_id long")
    errors = spark.createDataFrame([(3, "broken")], "doc_id long, message string")
    got = events.wire(events.events(chunks, docs, errors)).orderBy("doc_id", "part", "chunk_index").collect()
    assert [(r.doc_id, r.status, r.chunking_method, r.content_source, r.total_chunks, r.error_message) for r in got] == [
        (1, "PROCESSING", "UNSPECIFIED", "LLM_GENERATED", None, None), (1, "PROCESSING", "UNSPECIFIED", "OCR_EXTRACTION", None, None),
        (1, "PROCESSING", "SEMANTIC", "OCR_EXTRACTION", None, None), (1, "COMPLETED", None, None, 2, None), (2, "COMPLETED", None, None, 0, None), (3, "FAILED", None, None, None, "broken"),
    ]


def test_requests():
    assert events.request_options("openai", "", 0.0, -1, "SEMANTIC", "")["chunk_strategy"] == "semantic"
    o = events.request_options("other", "m", 0.5, 9, "X", "k")
    assert (o["llm_provider"], o["llm_model"], o["llm_temperature"], o["llm_max_tokens"], o["chunk_strategy"]) == (None, "m", 0.5, 9, "page")
    v = VisionOptions.resolve({"llm_temperature": 0.0, "llm_max_tokens": 0, "vision_max_width": 0}, EngineConf(llm_model="kept"))
    assert (v.temperature, v.max_tokens, v.max_width, v.max_height, v.model) == (0.0, 8192, 0, 1024, "kept")


def test_settings(spark, monkeypatch):
    monkeypatch.setenv("CHUNK_SIZE", "77")
    spark.conf.set("quirion.llm_model", "from conf")
    found = EngineConf.load(spark)
    spark.conf.unset("quirion.llm_model")
    assert (found.chunk_size, found.llm_model, found.min_chunk_size) == (77, "from conf", 200)
    providers.register_provider("local", object)
    assert "local" in providers.list_providers() and providers.health()["status"] == "HEALTH_SERVING"


def test_pixels(spark):
    grey = np.full((40, 60), 250, np.uint8)
    grey[10:12, 5:55] = 10
    grey[30, 30] = 0  # a speck
    frame = spark.createDataFrame([(60, 40, grey.tobytes())], "width int, height int, pixels binary")
    for full in (True, False):
        r = preprocess.prepared(frame, dpi=150, full=full).first()
        out = np.frombuffer(r.pixels, np.uint8).reshape(r.height, r.width)
        assert (r.width, r.height) == (120, 80) and set(np.unique(out)) <= {0, 255}
        assert out[22, 50] == 0 and out[5, 5] == 255
    assert preprocess.median_filtered(grey)[30, 30] == 250
    tilted = preprocess.turned(np.pad(grey, 40, constant_values=255), 5.0)
    angle, pixels = preprocess.dark_angle(tilted)
    assert pixels > 10 and (abs(angle + 5) < 1.5 or abs(angle + 85) < 1.5)
    assert 10 <= preprocess.otsu_threshold(grey) < 250
    with pytest.raises(providers.MissingProvider):
        preprocess.jpeg(b"not an image")


def test_pipeline_with_images(spark):
    frame = blocks(spark, [(1, 0, "A heading", 0.0, 9.0, 100.0, 120.0, 20.0, False), (1, 1, "some text", 0.0, 9.0, 130.0, 150.0, 12.0, False)])
    pages = spark.createDataFrame([(1, 1, ""), (2, 1, "")], "doc_id long, page_number int, text string")
    said = spark.createDataFrame([(1, 1, 0, "a seal", True, None, 9, 9)], "doc_id long, page_number int, image_index int, description string, success boolean, error_type string, width int, height int")
    got = pipeline.process(pages, frame, ChunkOptions(), said).orderBy("doc_id", "part", "chunk_index").collect()
    assert [(r.doc_id, r.type, r.content, r.total_chunks) for r in got] == [
        (1, "chunk", "[IMAGEM 1 - Página 1]: a seal", None), (1, "chunk", "A heading\n\nsome text\n\n[IMAGEM 1 - Página 1]: a seal", None), (1, "complete", None, 1), (2, "complete", None, 0),
    ]


def test_layout_shuffles_once(spark):
    frame = blocks(spark, [(1, 0, "x", 0.0, 9.0, 1.0, 2.0, 12.0, False)])
    plan = layout.classify_areas(layout.reading_order(frame))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Python" not in plan
