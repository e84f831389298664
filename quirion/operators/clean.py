"""Removal of repeated headers and footers and of page numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quirion.functions.text import is_blank, joined, strip

# Zones, repetition, least length, and the forms of page numbers.
PAGE_HEIGHT = 842.0
HEADER_ZONE, FOOTER_ZONE = 0.15, 0.85
REPETITION, LEAST_REPEATS = 0.6, 2
LEAST_CHARS = 3
PAGE_NUMBERS = (r"^\s*\d+\s*$", r"^\s*[Pp]ágina?\s+\d+\s*$", r"^\s*\d+\s*/\s*\d+\s*$", r"^\s*-\s*\d+\s*-\s*$")
_PAGE_NUMBER = "(?U)" + "|".join(PAGE_NUMBERS)


def _trimmed(blocks: DataFrame) -> DataFrame:
    return blocks.withColumn("trimmed", strip(F.coalesce("text", F.lit(""))))


def noise_texts(blocks: DataFrame, page_counts: DataFrame, page_height: float = PAGE_HEIGHT) -> DataFrame:
    """``doc_id``, ``zone`` and ``trimmed`` of the texts to remove: repeated in a zone, or page numbers anywhere.

    ``page_counts`` has ``doc_id`` and ``n_pages``, pages without blocks included. Documents of one page have none.
    Everything is grouped by the document's key, so one shuffle serves all.
    """
    centre = (F.coalesce("y0", F.lit(0.0)) + F.coalesce("y1", F.lit(page_height))) / 2
    zone = F.when(centre < page_height * HEADER_ZONE, "header").when(centre > page_height * FOOTER_ZONE, "footer")
    number = F.col("trimmed").rlike(_PAGE_NUMBER)
    own = _trimmed(blocks).select("doc_id", zone.alias("zone"), "trimmed").filter("trimmed <> ''")
    own = own.withColumn("number", number).filter(F.col("zone").isNotNull() | F.col("number"))
    counted = own.groupBy("doc_id", "zone", "trimmed", "number").agg(F.count(F.lit(1)).alias("n"))
    least = F.greatest(F.lit(LEAST_REPEATS), (F.col("n_pages") * REPETITION).cast("int"))
    repeated = F.when(F.col("zone").isNotNull() & (F.col("n") >= least), F.col("zone"))
    zones = F.array_distinct(F.array_compact(F.array(repeated, F.when(F.col("number"), F.lit("footer")))))
    found = counted.join(page_counts.filter("n_pages >= 2"), "doc_id").select("doc_id", F.explode(zones).alias("zone"), "trimmed")
    return found.distinct()


def clean_blocks(blocks: DataFrame, noise: DataFrame) -> DataFrame:
    """Blocks without blank and very short ones, and without those whose text is noise anywhere in their document."""
    kept = _trimmed(blocks).filter(F.length("trimmed") >= LEAST_CHARS)  # blank ones have none
    return kept.join(noise.select("doc_id", "trimmed"), ["doc_id", "trimmed"], "left_anti").drop("trimmed")


def without_noise(blocks: DataFrame, page_counts: DataFrame, page_height: float = PAGE_HEIGHT) -> DataFrame:
    """The same as ``clean_blocks`` by ``noise_texts``, reading the blocks once.

    Counts are windows that share the partition of the document, so blocks move once and stay where they are.
    """
    centre = (F.coalesce("y0", F.lit(0.0)) + F.coalesce("y1", F.lit(page_height))) / 2
    zone = F.when(centre < page_height * HEADER_ZONE, "header").when(centre > page_height * FOOTER_ZONE, "footer")
    rows = _trimmed(blocks).filter("trimmed <> ''").withColumn("__zone", zone).repartition("doc_id")
    rows = rows.join(page_counts.select("doc_id", F.col("n_pages").alias("__pages")), "doc_id", "left")
    least = F.greatest(F.lit(LEAST_REPEATS), (F.col("__pages") * REPETITION).cast("int"))
    same = F.count(F.lit(1)).over(Window.partitionBy("doc_id", "trimmed", "__zone"))
    noise = (F.col("__pages") >= 2) & (F.col("trimmed").rlike(_PAGE_NUMBER) | (F.col("__zone").isNotNull() & (same >= least)))
    rows = rows.withColumn("__noise", F.coalesce(noise, F.lit(False)))
    rows = rows.withColumn("__noise", F.bool_or("__noise").over(Window.partitionBy("doc_id", "trimmed")))
    return rows.filter(~F.col("__noise") & (F.length("trimmed") >= LEAST_CHARS)).drop("trimmed", "__zone", "__pages", "__noise")


def clean_pages(pages: DataFrame, cleaned: DataFrame, order: str = "block_idx") -> DataFrame:
    """Page texts of the blocks kept; pages that lost all of them stay, with an empty text."""
    shown = F.sort_array(F.collect_list(F.when(~is_blank("text"), F.struct(order, "text"))))
    built = cleaned.groupBy("doc_id", "page_number").agg(joined(shown, "text", "\n\n").alias("__built"))
    return pages.join(built, ["doc_id", "page_number"], "left").withColumn("text", F.coalesce("__built", F.lit(""))).drop("__built")
