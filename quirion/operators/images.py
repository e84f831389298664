"""Images of pages: which to keep, what their descriptions say, and how these enter pages and chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirion.functions.text import joined

# Least sizes of the two detectors, zones, and the messages for failures.
BASIC_SIZE, SMART_SIZE = (200, 300), (700, 200)
HEADER_ZONE, FOOTER_ZONE = 0.15, 0.85
NO_VISION = "❌ FALHA NO PROCESSAMENTO - Provider não suporta análise de imagens. Imagem detectada mas não analisada (%dx%dpx)."
FAILED = "❌ FALHA NO PROCESSAMENTO - Erro ao processar imagem (%dx%dpx)."
LABEL = "[IMAGEM %d - Página %d]: %s"


def _large(size: tuple[int, int]) -> Column:
    return (F.col("width") >= size[0]) & (F.col("height") >= size[1])


def colorspace_label(c: Column | str) -> Column:
    """``rgb`` for a colour space given by number, else its name."""
    c = (F.col(c) if isinstance(c, str) else c).cast("string")
    return F.when(c.rlike(r"^-?\d+$"), "rgb").otherwise(c)


def basic_images(images: DataFrame, page_list: DataFrame | None = None, least: tuple[int, int] = BASIC_SIZE) -> DataFrame:
    """Images of at least the size. ``page_list`` (``page_number``, optionally ``ord``) selects pages, from 1.

    A page listed twice gives its images twice, pages that don't exist give none, and ``ord`` keeps the list's order.
    """
    kept = images.filter(_large(least))
    if page_list is not None:
        kept = kept.join(page_list, "page_number")
    return kept.withColumn("colorspace", colorspace_label("colorspace"))


def in_margin(header: float = HEADER_ZONE, footer: float = FOOTER_ZONE) -> Column:
    """Whether an image's centre is in the top or bottom zone of its page; an unknown place isn't."""
    centre = (F.col("bbox.y0") + F.col("bbox.y1")) / 2
    inside = (centre < F.col("page_height") * header) | (centre > F.col("page_height") * footer)
    return F.coalesce(F.col("bbox").isNotNull() & inside, F.lit(False))


def first_copies(images: DataFrame, most: int = 1, content: str = "image_data") -> DataFrame:
    """The first ``most`` images of equal content in each document, by page and index."""
    marked = images.withColumn("image_hash", F.md5(content))
    order = Window.partitionBy("doc_id", "image_hash").orderBy("page_number", "image_index")
    return marked.withColumn("__copy", F.row_number().over(order)).filter(F.col("__copy") <= most).drop("__copy")


def smart_images(images: DataFrame, least: tuple[int, int] = SMART_SIZE, most: int = 1, header: float = HEADER_ZONE, footer: float = FOOTER_ZONE) -> DataFrame:
    """Large images outside of margins, without surplus copies; copies are counted among those that passed."""
    kept = images.filter(~in_margin(header, footer) & _large(least))
    return first_copies(kept, most).withColumn("colorspace", colorspace_label("colorspace"))


def descriptions(answers: DataFrame) -> DataFrame:
    """Description rows from images with ``outcome`` and ``answer``."""
    said = F.col("outcome")
    text = (
        F.when(said == "success", F.col("answer"))
        .when(said == "no_vision_support", F.format_string(NO_VISION, "width", "height"))
        .otherwise(F.format_string(FAILED, "width", "height"))
    )
    return answers.select(
        "doc_id", "page_number", "image_index", text.alias("description"), (said == "success").alias("success"),
        F.when(said == "success", F.lit(None).cast("string")).when(said == "no_vision_support", said).otherwise("processing_error").alias("error_type"),
        "width", "height",
    )


def image_chunks(described: DataFrame) -> DataFrame:
    """A chunk for each description, numbered from 0 in each document."""
    index = F.row_number().over(Window.partitionBy("doc_id").orderBy("page_number", "image_index")) - 1
    content = F.format_string(LABEL, F.col("image_index") + 1, "page_number", "description")
    return described.select(
        "doc_id", index.alias("chunk_index"), content.alias("content"), F.array("page_number").alias("page_numbers"), F.lit("image_description").alias("chunking_method"),
        "image_index", "width", "height", F.when(F.col("success"), "success").otherwise("failed").alias("processing_status"), "error_type",
    )


def enriched_pages(pages: DataFrame, described: DataFrame) -> DataFrame:
    """Pages with their images' descriptions after a blank line, and these as an array; other pages are unchanged."""
    line = F.format_string(LABEL, F.col("image_index") + 1, "page_number", "description").alias("line")
    rows = F.sort_array(F.collect_list(F.struct("image_index", line, "description", "page_number", "width", "height")))
    found = described.groupBy("doc_id", "page_number").agg(rows.alias("__rows"))
    merged = pages.join(found, ["doc_id", "page_number"], "left")
    text = F.when(F.col("__rows").isNull(), F.col("text")).otherwise(F.concat(F.coalesce("text", F.lit("")), F.lit("\n\n"), joined(F.col("__rows"), "line", "\n")))
    return merged.withColumn("text", text).withColumn("image_descriptions", F.transform("__rows", lambda r: r.dropFields("line"))).drop("__rows")
