"""Assembly of pages and blocks from spans or recognised words, and the choice of native or recognised text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirion.functions.text import is_blank, joined

#: Font size where none is known, and the flag of bold spans.
FONT_SIZE, BOLD = 12.0, 16
BOX = ("x0", "x1", "y0", "y1")


def _ordered(*fields: str) -> Column:
    return F.sort_array(F.collect_list(F.struct(*fields)))


def blocks_from_spans(spans: DataFrame) -> DataFrame:
    """Text blocks: spans joined by a space into lines, lines by a line break into blocks.

    Blank spans, blocks that aren't text (type 0) and blocks that end up blank are dropped. The font size is the mean of
    the spans kept, and a block is bold if any span is. Where spans have the box of their block (``x0``, ``x1``, ``y0``, ``y1``), blocks get it. Spans are dealt by document first, so that lines, blocks and, after
    them, pages are grouped without moving again; text doesn't shrink by being grouped.
    """
    kept = spans.filter((F.col("block_type") == 0) & ~is_blank("text")).repartition("doc_id")
    boxes = [F.min(c).alias(c) for c in BOX if c in spans.columns]
    lines = kept.groupBy("doc_id", "page_number", "block_no", "line_no").agg(
        joined(_ordered("span_no", "text"), "text", " ").alias("text"),
        F.sum(F.coalesce("size", F.lit(FONT_SIZE))).alias("size"),
        F.count(F.lit(1)).alias("n"),
        F.bool_or(F.coalesce("flags", F.lit(0)).bitwiseAND(F.lit(BOLD)) != 0).alias("bold"),
        *boxes,
    )
    blocks = lines.groupBy("doc_id", "page_number", F.col("block_no").alias("block_idx")).agg(
        joined(_ordered("line_no", "text"), "text", "\n").alias("text"), (F.sum("size") / F.sum("n")).alias("font_size"), F.bool_or("bold").alias("is_bold"), *boxes
    )
    return blocks.filter(~is_blank("text"))


def page_text(blocks: DataFrame, order: str = "block_idx") -> DataFrame:
    """Text of each page: its blocks that aren't blank, by a blank line."""
    return blocks.filter(~is_blank("text")).groupBy("doc_id", "page_number").agg(joined(_ordered(order, "text"), "text", "\n\n").alias("text"))


def word_rows(words: DataFrame) -> DataFrame:
    """Recognised words as rows: blank texts and negative or unreadable confidences go, levels are capped at words."""
    conf = F.coalesce(F.expr("try_cast(conf AS DOUBLE)"), F.lit(-1.0))
    right, bottom = F.col("left") + F.col("width"), F.col("top") + F.col("height")
    bbox = F.struct(*(c.cast("double").alias(n) for c, n in ((F.col("left"), "x0"), (F.col("top"), "y0"), (right, "x1"), (bottom, "y1"))))
    return words.filter(~is_blank("text") & (conf >= 0)).select(
        "doc_id", F.least("level", F.lit(5)).alias("level"), "text", (conf / 100).alias("confidence"), bbox.alias("bbox"), "page_num", "block_num", "par_num", "line_num", "word_num"
    )


def full_page_block(pages: DataFrame) -> DataFrame:
    """The single block of a recognised page: all of its text over the whole image."""
    zero = F.lit(0.0)
    return pages.select(
        "doc_id", "page_number", F.lit(0).alias("block_idx"), "text", zero.alias("x0"), F.col("page_w").cast("double").alias("x1"),
        zero.alias("y0"), F.col("page_h").cast("double").alias("y1"), F.lit(FONT_SIZE).alias("font_size"), F.lit(False).alias("is_bold"),
    )


def routed(pages: DataFrame, types: DataFrame) -> DataFrame:
    """Adds ``use_ocr``: whether a page's text is recognised, by its document's type and, in hybrids, by the page.

    ``types`` is the result of ``document_types``; it has a row a document, so the join is on the document key.
    """
    kinds = types.select("doc_id", "pdf_type", "digital_pages")
    by_page = ~F.array_contains("digital_pages", F.col("page_number"))
    ocr = F.when(F.col("pdf_type") == "digital", False).when(F.col("pdf_type") == "scanned", True).otherwise(by_page)
    return pages.join(kinds, "doc_id").withColumn("use_ocr", ocr).drop("digital_pages")


def hybrid_merge(pages: DataFrame, native: DataFrame, recognised: DataFrame) -> DataFrame:
    """Pages by number: native text where the page is digital and has a native page, recognised text otherwise.

    ``pages``: doc_id, page_number, digital. ``native`` and ``recognised``: doc_id, page_number, text.
    """
    key = ["doc_id", "page_number"]
    n = native.withColumnRenamed("text", "native").withColumn("has_native", F.lit(True))
    merged = pages.join(n, key, "left").join(recognised.withColumnRenamed("text", "recognised"), key, "left")
    is_native = F.col("digital") & F.coalesce("has_native", F.lit(False))
    return merged.select(*key, F.when(is_native, F.col("native")).otherwise(F.col("recognised")).alias("text"), F.when(is_native, "native").otherwise("ocr").alias("origin"))


def native_else_recognised(native: Column, recognised: Column) -> Column:
    """The native text unless it is blank."""
    return F.when(is_blank(native), recognised).otherwise(native)
