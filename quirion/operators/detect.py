"""Document type: digital, scanned or hybrid, from what each page holds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirion.functions.text import strip

#: Characters of native text with which a page counts as digital.
DIGITAL_CHARS = 50


def page_facts(pages: DataFrame) -> DataFrame:
    """Per page: stripped characters, page area, area of all image rectangles, and whether it is digital."""
    images = F.aggregate(F.coalesce("image_rects", F.array().cast("array<struct<w:double,h:double>>")), F.lit(0.0), lambda acc, r: acc + r["w"] * r["h"])
    chars = F.length(strip(F.coalesce("text", F.lit(""))))
    return pages.select(
        "doc_id", "page_number", chars.alias("chars"), (F.col("page_w") * F.col("page_h")).alias("page_area"), images.alias("image_area"), (chars >= DIGITAL_CHARS).alias("digital")
    )


def document_types(pages: DataFrame) -> DataFrame:
    """One row per document: type, page lists, densities and confidence."""
    listed = lambda digital: F.sort_array(F.collect_list(F.when(F.col("digital") == digital, F.col("page_number"))))
    n = F.count(F.lit(1))
    facts = page_facts(pages).groupBy("doc_id").agg(
        listed(True).alias("digital_pages"),
        listed(False).alias("scanned_pages"),
        n.cast("int").alias("total_pages"),
        (F.sum("chars") / F.greatest(n, F.lit(1))).alias("text_density"),
        (F.sum("image_area") / F.greatest(F.sum("page_area"), F.lit(1.0))).alias("image_density"),
    )
    scanned, digital = F.size("scanned_pages") == 0, F.size("digital_pages") == 0
    kind = F.when(scanned, "digital").when(digital, "scanned").otherwise("hybrid")
    return facts.withColumn("pdf_type", kind).withColumn("confidence", F.when(scanned | digital, 1.0).otherwise(0.8))
