"""The registered queries over the document operators. ``oracles`` has SQL with the same results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirion.conf import ChunkOptions, VisionOptions
from quirion.operators import chunk, clean, detect, events, extract, images, layout, preprocess, sections
from quirion.plans import oracles, pipeline
from quirion.providers import EchoOcr, EchoVision, JsonDecoder, LetterEmbedder, described
from quirion.sources import derived as D
from quirion.sources import objects
from quirion.sources.tables import shared_folder, table
from quirion.streaming.pages import streamed_chunks

#: Options of the chunk queries.
OPTIONS = ChunkOptions.resolve({"chunk_size": oracles.SIZE, "min_chunk_size": oracles.LEAST})
OVERLAPPED = ChunkOptions.resolve({"chunk_size": oracles.SIZE, "min_chunk_size": oracles.LEAST, "chunk_overlap": oracles.OVERLAP})
EMBEDDED = ChunkOptions.resolve({"chunk_size": oracles.SIZE, "min_chunk_size": oracles.LEAST, "similarity_threshold": oracles.ALIKE})
GROUPED = ChunkOptions.resolve({"chunk_size": 1500, "similarity_threshold": 0.1})
Query = Callable[[SparkSession, str], DataFrame]


def _listed(chunks: DataFrame) -> DataFrame:
    """Chunks with their page numbers as text."""
    rest = ("content", "chunking_method", "char_count", "word_count", "paragraph_count")
    return chunks.select("doc_id", "chunk_index", F.array_join("page_numbers", ",").alias("pages"), *rest)


def _sent(rows: DataFrame) -> DataFrame:
    """Events on the wire, with page numbers as text."""
    return events.wire(rows).withColumn("pages", F.array_join("page_numbers", ",")).drop("page_numbers")


def _chunks() -> dict[str, Query]:
    pages = lambda s, d: D.derived(s, d, D.PAGES)
    turns = lambda s, d: D.derived(s, d, D.TURNS)

    def chunk_events(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = turns(spark, sf_dir)
        return _sent(events.events(events.chunk_metadata(chunk.page_chunks(rows)), rows.select("doc_id")))

    return {
        "chunk_page": lambda s, d: _listed(chunk.page_chunks(turns(s, d))),
        "chunk_page_stream": lambda s, d: _listed(streamed_chunks(s, turns(s, d), shared_folder(s, "stream"))),
        "chunk_events": chunk_events,
        "para_split": lambda s, d: chunk.paragraphs(pages(s, d), OPTIONS),
        "chunk_paragraph": lambda s, d: _listed(chunk.paragraph_chunks(pages(s, d), OPTIONS)),
        "chunk_paragraph_overlap": lambda s, d: _listed(chunk.paragraph_chunks(pages(s, d), OVERLAPPED)),
        "chunk_semantic_simple": lambda s, d: _listed(chunk.semantic_chunks(pages(s, d), OPTIONS)),
        "chunk_semantic_embedded": lambda s, d: _listed(chunk.semantic_chunks(pages(s, d), EMBEDDED, LetterEmbedder())),
        "chunk_hybrid": lambda s, d: _listed(chunk.hybrid_chunks(pages(s, d), OVERLAPPED)),
        "semantic_groups": lambda s, d: _listed(chunk.semantic_groups(D.derived(s, d, D.PARAGRAPH_EMBEDDINGS), GROUPED)),
    }


def _blocks() -> dict[str, Query]:
    blocks = lambda s, d: D.derived(s, d, D.SPARK_BLOCKS)
    pages = lambda s, d: D.derived(s, d, D.SPARK_BLOCK_PAGES)
    counts = lambda s, d: pages(s, d).select("doc_id", "n_pages").distinct()
    noise = lambda s, d: clean.noise_texts(blocks(s, d), counts(s, d))
    kept = lambda s, d: clean.without_noise(blocks(s, d), counts(s, d))
    key = ("doc_id", "page_number", "block_idx")

    def pipeline_full(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = images.smart_images(D.derived(spark, sf_dir, D.IMAGES))
        return _sent(pipeline.process(pages(spark, sf_dir), blocks(spark, sf_dir), OPTIONS, images.descriptions(_answered(found))))

    def file_events(spark: SparkSession, sf_dir: str) -> DataFrame:
        block = F.struct("page_number", "block_idx", "text", "x0", "x1", "y0", "y1", "font_size", "is_bold")
        files = blocks(spark, sf_dir).groupBy("doc_id").agg(F.to_json(F.sort_array(F.collect_list(block))).alias("content"))
        content = F.when(F.col("doc_id") % 10 == 3, "broken").otherwise(F.col("content"))
        return _sent(pipeline.file_events(files.withColumn("content", F.encode(content, "UTF-8")), JsonDecoder(), OPTIONS, EchoOcr()))

    return {
        "layout_area": lambda s, d: layout.classify_areas(blocks(s, d)).select(*key, "area_type", F.round("avg_font", 6).alias("avg_font")),
        "detect_titles": lambda s, d: layout.titles(blocks(s, d)).select(*key, "text"),
        "reading_order": lambda s, d: layout.reading_order(blocks(s, d)).select(*key, "n_columns", "zone", "reading_idx"),
        "page_text": lambda s, d: layout.ordered_text(pages(s, d), layout.reading_order(blocks(s, d))).select("doc_id", "page_number", "text"),
        "noise_patterns": noise,
        "noise_removed": lambda s, d: clean.clean_pages(pages(s, d), kept(s, d)).select("doc_id", "page_number", "text"),
        "section_class": lambda s, d: sections.classify_sections(kept(s, d)).select(*key, "section_type", "section_confidence"),
        "section_matches": lambda s, d: blocks(s, d).select(*key, F.array_join(sections.section_matches("text"), ",").alias("sections")),
        "pipeline_full": pipeline_full,
        "file_events": file_events,
    }


def _extraction() -> dict[str, Query]:
    stats = lambda s, d: D.derived(s, d, D.PAGE_STATS)
    spans = lambda s, d: extract.blocks_from_spans(D.derived(s, d, D.SPANS))
    spoken = lambda: F.concat(F.lit("ocr "), F.col("page_number").cast("string"))

    def doc_type(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = detect.document_types(stats(spark, sf_dir))
        lists = {c: F.array_join(c, ",") for c in ("digital_pages", "scanned_pages")}
        return found.withColumns(lists | {c: F.round(c, 6) for c in ("text_density", "image_density")})

    def hybrid_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = stats(spark, sf_dir)
        facts = detect.page_facts(rows).select("doc_id", "page_number", "digital")
        native = rows.filter("page_number % 5 <> 0").select("doc_id", "page_number", "text")
        return extract.hybrid_merge(facts, native, rows.select("doc_id", "page_number", spoken().alias("text")))

    def page_route(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = stats(spark, sf_dir)
        return extract.routed(rows, detect.document_types(rows)).select("doc_id", "page_number", "use_ocr")

    def ocr_words(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = extract.word_rows(D.derived(spark, sf_dir, D.OCR_WORDS))
        return rows.select("doc_id", "level", "text", F.round("confidence", 6).alias("confidence"), "bbox.*", "page_num", "block_num", "par_num", "line_num", "word_num")

    return {
        "doc_type": doc_type,
        "hybrid_merge": hybrid_merge,
        "page_route": page_route,
        "native_else_ocr": lambda s, d: stats(s, d).select("doc_id", "page_number", extract.native_else_recognised(F.col("text"), spoken()).alias("text")),
        "span_assembly": lambda s, d: spans(s, d).withColumn("font_size", F.round("font_size", 6)),
        "span_page_text": lambda s, d: extract.page_text(spans(s, d)),
        "ocr_words": ocr_words,
    }


def _answered(found: DataFrame) -> DataFrame:
    """Images with made-up answers of all three outcomes."""
    outcome = F.when(F.col("doc_id") % 13 == 0, "no_vision_support").when(F.col("doc_id") % 13 == 1, "processing_error").otherwise("success")
    return found.withColumns({"outcome": outcome, "answer": F.concat(F.lit("desc "), F.col("image_index").cast("string"))})


def _images() -> dict[str, Query]:
    all_images = lambda s, d: D.derived(s, d, D.IMAGES)
    smart = lambda s, d: images.smart_images(all_images(s, d), least=(400, 100))
    said = lambda s, d: images.descriptions(_answered(smart(s, d)))
    key = ("doc_id", "page_number", "image_index")

    def image_basic(spark: SparkSession, sf_dir: str) -> DataFrame:
        listed = spark.createDataFrame([(3, 0), (1, 1), (99, 2), (3, 3)], "page_number int, ord int")
        return images.basic_images(all_images(spark, sf_dir), listed).select(*key, "ord", "width", "height", "colorspace")

    def image_enrich(spark: SparkSession, sf_dir: str) -> DataFrame:
        pages = images.enriched_pages(D.derived(spark, sf_dir, D.TURNS), said(spark, sf_dir))
        return pages.select("doc_id", "page_number", "text", F.coalesce(F.size("image_descriptions"), F.lit(0)).alias("n_images"))

    def image_resize(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = table(spark, sf_dir, "documents").selectExpr("doc_id", "CAST(n_chars % 3000 + 1 AS INT) AS width", "CAST(n_chars % 1700 + 1 AS INT) AS height", "CAST(doc_id % 4 * 100 AS INT) AS dpi")
        size = (F.col("width"), F.col("height"))
        rows = rows.select("doc_id", preprocess.vision_size(*size).alias("v"), preprocess.dpi_size(*size, F.col("dpi")).alias("r"))
        return rows.selectExpr("doc_id", "v.width AS vision_width", "v.height AS vision_height", "r.width AS dpi_width", "r.height AS dpi_height")

    def image_skew(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = table(spark, sf_dir, "documents").selectExpr("doc_id", "-(doc_id % 900) / 10D AS angle", "doc_id % 40 AS pixels")
        return rows.select("doc_id", F.round(preprocess.skew_correction(F.col("angle"), F.col("pixels")), 6).alias("turn"))

    def image_binarize(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = table(spark, sf_dir, "documents").selectExpr("doc_id", "transform(sequence(0, 15), k -> CAST((doc_id * 7 + k * 37) % 256 AS INT)) AS pixels")
        return rows.select("doc_id", F.aggregate(preprocess.thresholded(F.col("pixels")), F.lit(0).cast("bigint"), lambda a, p: a + p).alias("white"))

    def image_vision(spark: SparkSession, sf_dir: str) -> DataFrame:
        return described(smart(spark, sf_dir), EchoVision(), VisionOptions.resolve().vision_prompt).select(*key, "outcome", "answer")

    return {
        "image_vision": image_vision,
        "image_basic": image_basic,
        "image_smart": lambda s, d: smart(s, d).select(*key, "width", "height", "colorspace"),
        "image_dedup": lambda s, d: images.first_copies(all_images(s, d)).select(*key, "image_hash"),
        "image_describe": said,
        "image_chunks": lambda s, d: images.image_chunks(said(s, d)).select("doc_id", "chunk_index", "content", "processing_status"),
        "image_enrich": image_enrich,
        "image_resize": image_resize,
        "image_skew": image_skew,
        "image_binarize": image_binarize,
    }


def _service() -> dict[str, Query]:
    def validate_document(spark: SparkSession, sf_dir: str) -> DataFrame:
        suffix = "CASE doc_id % 3 WHEN 0 THEN '.pdf' WHEN 1 THEN '.PDF' ELSE '.txt' END"
        rows = table(spark, sf_dir, "documents").selectExpr("source AS bucket", f"concat(CAST(doc_id AS STRING), {suffix}) AS file_key", "doc_id")
        return objects.validated(rows.select("bucket", "file_key"), rows.filter("doc_id % 4 <> 0"))

    def wire_stage_map(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = spark.createDataFrame([(s,) for s in [*events.STAGES, "LLM_Chunking_Starting", "unknown"]], "stage string")
        return rows.select("stage", events.stage_code(F.col("stage")).alias("code"))

    def wire_language_map(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = spark.createDataFrame([(s,) for s in [*events.LANGUAGES, "KLINGON"]], "language string")
        return rows.select("language", events.language_code(F.col("language")).alias("code"))

    def option_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = [(k, o.strategy, o.chunk_size, o.min_chunk_size, o.chunk_overlap, o.similarity_threshold, o.detect_images) for k, o in enumerate(map(ChunkOptions.resolve, oracles.REQUESTS))]
        return spark.createDataFrame(rows, "request int, strategy string, chunk_size int, min_chunk_size int, chunk_overlap int, similarity_threshold double, detect_images boolean")

    def request_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
        names = ("llm_provider", "llm_model", "llm_temperature", "llm_max_tokens", "chunk_strategy", "llm_api_key")
        rows = [(k, *(o[n] for n in names)) for k, o in enumerate(events.request_options(*r) for r in oracles.WIRE_REQUESTS)]
        return spark.createDataFrame(rows, "request int, provider string, model string, temperature double, max_tokens int, strategy string, api_key string")

    return {"option_resolution": option_resolution, "request_mapping": request_mapping, "validate_document": validate_document, "wire_stage_map": wire_stage_map, "wire_language_map": wire_language_map}


def queries() -> dict[str, Query]:
    return _chunks() | _blocks() | _extraction() | _images() | _service()


def oracle_sql() -> dict[str, str]:
    return oracles.oracle_sql()
