"""Chunking: by page, by paragraphs packed to a size, by similarity of neighbours, and the hybrid of both.

``pages`` has ``doc_id``, ``page_number``, ``text`` and may have ``seq``, the order of pages in the document (by default
their number). Everything is keyed by the document, so a plan shuffles pages once and the rest is windows and array
expressions over that partition. One document's paragraphs pass through one row.
"""

from __future__ import annotations

import logging

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from quirion.conf import ChunkOptions
from quirion.functions.arrays import cosine, greedy_spans, let
from quirion.functions.text import joined, strip, word_count
from quirion.providers import Embedder, embedded

def _doc() -> WindowSpec:
    return Window.partitionBy("doc_id")


BREAK = r"\n{2,}"


def _ordered_pages(pages: DataFrame) -> DataFrame:
    found = pages if "seq" in pages.columns else pages.withColumn("seq", F.col("page_number"))
    return found.select("doc_id", F.col("seq").cast("int").alias("seq"), F.col("page_number").cast("int").alias("page_number"), F.coalesce("text", F.lit("")).alias("text"))


def _chunk_columns(content: Column, method: str) -> list[Column]:
    return [
        content.alias("content"),
        F.lit(method).alias("chunking_method"),
        F.length(content).cast("int").alias("char_count"),
        word_count(content).alias("word_count"),
    ]


def page_chunks(pages: DataFrame) -> DataFrame:
    """A chunk for each page that isn't blank."""
    rows = _ordered_pages(pages).withColumn("content", strip("text")).filter("content <> ''")
    index = (F.row_number().over(_doc().orderBy("seq", "page_number")) - 1).alias("chunk_index")
    return rows.select("doc_id", index, F.array("page_number").alias("page_numbers"), *_chunk_columns(F.col("content"), "page"), F.lit(None).cast("int").alias("paragraph_count"))


def paragraphs(pages: DataFrame, options: ChunkOptions) -> DataFrame:
    """``doc_id``, ``seq`` (from 1), ``text``, ``page_number`` of the paragraphs that are long enough.

    Pages are joined by one line break, so paragraphs run on over page ends. A paragraph belongs to the page that holds
    the first character of its piece, blank ones included: the last page that starts at or before it. That look-up is a
    running last value over pages and pieces in the order of their places.
    """
    before = _doc().orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    placed = _ordered_pages(pages).withColumn("place", F.coalesce(F.sum(F.length("text") + 1).over(before), F.lit(0)))
    whole = placed.groupBy("doc_id").agg(joined(F.sort_array(F.collect_list(F.struct("seq", "text"))), "text", "\n").alias("all"))
    cut = whole.select("doc_id", F.regexp_extract_all("all", F.lit(f"({BREAK})"), F.lit(1)).alias("gaps"), F.split("all", BREAK, -1).alias("pieces"))
    pieces = cut.select("doc_id", F.posexplode("pieces").alias("at", "piece"), "gaps")
    pieces = pieces.select("doc_id", "at", "piece", F.coalesce(F.length(F.get("gaps", F.col("at"))), F.lit(0)).alias("gap"))
    so_far = _doc().orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.withColumn("place", F.coalesce(F.sum(F.length("piece") + F.col("gap")).over(so_far), F.lit(0)))
    starts = placed.select("doc_id", "place", F.lit(0).alias("kind"), F.lit(None).cast("int").alias("at"), "page_number", F.lit(None).cast("string").alias("piece"))
    both = starts.unionByName(pieces.select("doc_id", "place", F.lit(1).alias("kind"), "at", F.lit(None).cast("int").alias("page_number"), "piece"))
    upto = _doc().orderBy("place", "kind", "at").rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("page_number", F.last("page_number", ignorenulls=True).over(upto)).filter("kind = 1").withColumn("text", strip("piece"))
    kept = both.filter(F.length("text") >= options.min_paragraph)
    return kept.select("doc_id", F.row_number().over(_doc().orderBy("at")).alias("seq"), "text", "page_number")


def packed(paras: DataFrame, size: int, overlap: int, method: str, linked: bool = False) -> DataFrame:
    """Chunks of paragraphs in order, each up to ``size`` characters unless it is a single paragraph.

    With ``linked``, the column of that name tells whether a paragraph may join the one before.
    """
    fields = ["seq", "text", "page_number", *(["linked"] if linked else [])]
    docs = paras.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("rows"))

    def spans(rows: Column) -> Column:
        lengths = F.transform(rows, lambda r: F.length(r["text"]))
        return greedy_spans(lengths, size, overlap, F.transform(rows, lambda r: r["linked"]) if linked else None)

    cut = docs.select("doc_id", "rows", F.posexplode(let(F.col("rows"), spans)).alias("chunk_index", "span"))
    part = F.slice("rows", F.col("span.first"), F.col("span.last") - F.col("span.first") + 1)
    cut = cut.select("doc_id", "chunk_index", part.alias("rows"))
    cut = cut.select("doc_id", "chunk_index", joined(F.col("rows"), "text", "\n\n").alias("content"), F.array_sort(F.array_distinct(F.col("rows.page_number"))).alias("page_numbers"), F.size("rows").alias("paragraph_count"))
    return cut.select("doc_id", "chunk_index", "page_numbers", *_chunk_columns(F.col("content"), method), "paragraph_count")


def paragraph_chunks(pages: DataFrame, options: ChunkOptions) -> DataFrame:
    return packed(paragraphs(pages, options), options.chunk_size, options.chunk_overlap, "paragraph")


def linked_by_similarity(paras: DataFrame, threshold: float) -> DataFrame:
    """Adds ``linked``: whether the cosine to the paragraph before reaches the threshold. Needs ``embedding``."""
    previous = F.lag("embedding").over(_doc().orderBy("seq"))
    return paras.withColumn("__before", previous).withColumn("linked", F.coalesce(cosine(F.col("__before"), F.col("embedding")) >= threshold, F.lit(True))).drop("__before")


def semantic_groups(paras: DataFrame, options: ChunkOptions) -> DataFrame:
    """Chunks of neighbours that are alike. ``paras`` has ``doc_id``, ``seq``, ``text``, ``page_number``, ``embedding``."""
    return packed(linked_by_similarity(paras, options.similarity_threshold), options.chunk_size, 0, "semantic", linked=True)


def semantic_chunks(pages: DataFrame, options: ChunkOptions, embedder: Embedder | None = None) -> DataFrame:
    """Chunks by similarity, or by size alone where there is no embedder."""
    paras = paragraphs(pages, options)
    if embedder is None:
        return packed(paras, options.chunk_size, 0, "semantic")
    return semantic_groups(embedded(paras, embedder), options)


def hybrid_chunks(pages: DataFrame, options: ChunkOptions, embedder: Embedder | None = None) -> DataFrame:
    """Paragraph chunks taken as pages (each by its first page number) and chunked by similarity."""
    first = paragraph_chunks(pages, options)
    again = first.select("doc_id", F.col("chunk_index").alias("seq"), F.element_at("page_numbers", 1).alias("page_number"), F.col("content").alias("text"))
    return semantic_chunks(again, options, embedder)


def chunk(pages: DataFrame, options: ChunkOptions, embedder: Embedder | None = None) -> DataFrame:
    """Chunks by the strategy of the options; an unknown one gives pages."""
    if options.strategy == "paragraph":
        return paragraph_chunks(pages, options)
    if options.strategy == "semantic":
        return semantic_chunks(pages, options, embedder)
    if options.strategy == "hybrid":
        return hybrid_chunks(pages, options, embedder)
    if options.strategy != "page":
        logging.getLogger(__name__).warning("unknown chunking strategy %r; chunking by page", options.strategy)
    return page_chunks(pages)
