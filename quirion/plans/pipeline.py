"""The whole way from blocks to chunks, as one lazy plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirion.conf import ChunkOptions
from quirion.operators import chunk, clean, detect, events, extract, images, layout, sections
from quirion.providers import Embedder, OcrEngine, PdfDecoder, decoded_pages, recognised
from quirion.sources.tables import shared_folder


def native_or_recognised(pages: DataFrame, types: DataFrame, engine: OcrEngine | None = None, language: str = "por") -> DataFrame:
    """Pages with the text that their route gives. Only pages on the way to recognition are sent to the engine.

    ``pages``: doc_id, page_number, text, page_w, page_h, image_rects and, for recognition, ``image_data``.
    """
    routed = extract.routed(pages, types)
    native = routed.filter(~F.col("use_ocr")).select("doc_id", "page_number", "text")
    if engine is None:
        return native
    read = recognised(routed.filter("use_ocr").select("doc_id", "page_number", "image_data"), engine, language)
    return native.unionByName(read.select("doc_id", "page_number", "text"))


def cleaned(pages: DataFrame, blocks: DataFrame, page_height: float = layout.PAGE_HEIGHT, page_width: float = layout.PAGE_WIDTH) -> tuple[DataFrame, DataFrame]:
    """Pages with cleaned texts, and their blocks with area, order and section.

    Areas and order are found first, then noise over the whole document, then sections among the blocks that are left.
    """
    ordered = layout.reading_order(layout.classify_areas(blocks, page_height), page_width)
    counts = pages.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_pages"))
    kept = clean.without_noise(ordered, counts, page_height)
    return clean.clean_pages(pages, kept, "reading_idx"), sections.classify_sections(kept)


def process(
    pages: DataFrame, blocks: DataFrame, options: ChunkOptions, described: DataFrame | None = None, embedder: Embedder | None = None, errors: DataFrame | None = None
) -> DataFrame:
    """Events of documents: image chunks, text chunks, and the end of each document.

    ``errors`` (``doc_id``, ``message``) are documents that could not be read; they end with an error.
    """
    if not options.detect_images:
        described = None
    texts, _ = cleaned(pages.select("doc_id", "page_number", "text"), blocks)
    if described is not None:
        texts = images.enriched_pages(texts, described)
    facts = ["doc_id", "chunk_index", "page_numbers", "content", "chunking_method", "chunk_metadata"]
    chunks = events.chunk_metadata(chunk.chunk(texts, options, embedder)).select(*facts)
    if described is not None:
        chunks = chunks.unionByName(events.chunk_metadata(images.image_chunks(described)).select(*facts))
    docs = pages.select("doc_id")
    return events.events(chunks, docs if errors is None else docs.union(errors.select("doc_id")), errors)


def file_events(
    files: DataFrame,
    decoder: PdfDecoder,
    options: ChunkOptions,
    engine: OcrEngine | None = None,
    language: str = "por",
    described: DataFrame | None = None,
    embedder: Embedder | None = None,
    folder: str | None = None,
) -> DataFrame:
    """Events of files (``doc_id``, ``content``): decoding, routes, recognition of the pages that need it, and ``process``.

    Decoded pages are written to ``folder`` (one that driver and executors share, by default) and read again, as several
    steps need them. A file that can't be decoded ends with an error.
    """
    spark = files.sparkSession
    folder = folder or shared_folder(spark, "pages")
    decoded_pages(files, decoder).write.parquet(folder)
    read = spark.read.parquet(folder)
    good = read.filter("error IS NULL")
    shown = F.array_join(F.transform(F.filter("spans", lambda s: s["block_type"] == 0), lambda s: F.coalesce(s["text"], F.lit(""))), "\n")
    facts = good.select("doc_id", "page_number", shown.alias("text"), "page_w", "page_h", "image_rects")
    routes = extract.routed(facts, detect.document_types(facts)).select("doc_id", "page_number", "use_ocr")
    routed = good.join(routes, ["doc_id", "page_number"])
    spans = routed.filter("NOT use_ocr").select("doc_id", "page_number", F.explode("spans").alias("s")).select("doc_id", "page_number", "s.*")
    blocks = extract.blocks_from_spans(spans)
    if engine is not None:
        pictures = routed.filter("use_ocr").select("doc_id", "page_number", "page_w", "page_h", "image_data")
        blocks = blocks.unionByName(extract.full_page_block(recognised(pictures, engine, language)))
    errors = read.filter("error IS NOT NULL").select("doc_id", F.col("error").alias("message"))
    return process(facts, blocks, options, described, embedder, errors)
