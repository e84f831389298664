"""Layout: kinds of blocks, columns, and reading order. Windows are per page and share the document's partition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from quirion.functions.text import is_blank, joined, strip

# Page size and thresholds of the classification.
PAGE_HEIGHT, PAGE_WIDTH = 842.0, 595.0
HEADER_SHARE, FOOTER_SHARE = 0.1, 0.9
TITLE_RATIO, TITLE_CHARS = 1.3, 100
FONT_SIZE = 12.0
COLUMN_MARGIN, COLUMN_OVERLAP = 0.4, 0.1
LIST_MARKS = ("-", "•", "*")
#: Digits in the wide sense: decimal ones and superscripts.
DIGIT = r"[\p{Nd}²³¹⁰⁴-⁹]"

def _page() -> WindowSpec:
    return Window.partitionBy("doc_id", "page_number")



def average_font(ignore_zero: bool = True) -> Column:
    """Mean font size of a page; sizes of zero and null don't count, or null counts as the default."""
    size = F.nullif("font_size", F.lit(0.0)) if ignore_zero else F.coalesce("font_size", F.lit(FONT_SIZE))
    return F.coalesce(F.avg(size).over(_page()), F.lit(FONT_SIZE))


def is_list_item(text: Column) -> Column:
    """Starts with a mark, or with a digit and a full stop or bracket."""
    return F.substring(text, 1, 1).isin(*LIST_MARKS) | ((F.length(text) > 2) & text.rlike(rf"^{DIGIT}[.)]"))


def classify_areas(blocks: DataFrame, page_height: float = PAGE_HEIGHT) -> DataFrame:
    """Adds ``avg_font`` and ``area_type``; the first rule that holds decides."""
    text = strip(F.coalesce("text", F.lit("")))
    size = F.coalesce("font_size", F.lit(FONT_SIZE))
    title = (size >= F.col("avg_font") * TITLE_RATIO) & (F.coalesce("is_bold", F.lit(False)) | (F.length(text) < TITLE_CHARS))
    kind = (
        F.when(F.coalesce("y1", F.lit(0.0)) < page_height * HEADER_SHARE, "header")
        .when(F.coalesce("y0", F.lit(0.0)) > page_height * FOOTER_SHARE, "footer")
        .when(title, "title")
        .when(is_list_item(text), "list")
        .otherwise("paragraph")
    )
    return blocks.withColumn("avg_font", average_font()).withColumn("area_type", kind)


def titles(blocks: DataFrame) -> DataFrame:
    """Blocks whose font is well above the page's mean, in which blocks of unknown size count with the default."""
    size = F.coalesce("font_size", F.lit(FONT_SIZE))
    return blocks.withColumn("avg_font", average_font(ignore_zero=False)).filter(size >= F.col("avg_font") * TITLE_RATIO)


def reading_order(blocks: DataFrame, page_width: float = PAGE_WIDTH) -> DataFrame:
    """Adds ``n_columns``, ``zone`` and ``reading_idx`` (from 0).

    On a page of two columns the left one comes first, then what spans both, then the right one. A block that belongs to
    the left and to the right column comes twice, and one whose place isn't known comes with those that span both.
    """
    middle, half = page_width / 2, (F.col("x0") + F.col("x1")) / 2
    least = F.greatest(F.lit(2), F.floor(F.count(F.lit(1)).over(_page()) / 4))
    left = F.count_if(half < middle * (1 - COLUMN_MARGIN)).over(_page())
    right = F.count_if(half > middle * (1 + COLUMN_MARGIN)).over(_page())
    columns = F.when((left >= least) & (right >= least), 2).otherwise(1)
    in_left, in_right = F.col("x1") <= middle * (1 + COLUMN_OVERLAP), F.col("x0") >= middle * (1 - COLUMN_OVERLAP)
    zones = F.filter(F.array(F.when(in_left, 0), F.when(F.coalesce(~in_left & ~in_right, F.lit(True)) & ~F.coalesce(in_left, F.lit(False)) & ~F.coalesce(in_right, F.lit(False)), 1), F.when(in_right, 2)), lambda z: z.isNotNull())
    placed = blocks.withColumn("n_columns", columns).withColumn("zone", F.explode(F.when(F.col("n_columns") == 2, zones).otherwise(F.array(F.lit(0)))))
    return placed.withColumn("reading_idx", F.row_number().over(_page().orderBy("zone", "y0", "x0", "block_idx")) - 1)


def ordered_text(pages: DataFrame, ordered: DataFrame) -> DataFrame:
    """Page texts rebuilt from blocks in reading order; a page without blocks keeps its own text."""
    shown = F.sort_array(F.collect_list(F.when(~is_blank("text"), F.struct("reading_idx", "text"))))
    built = ordered.groupBy("doc_id", "page_number").agg(joined(shown, "text", "\n\n").alias("__built"))
    return pages.join(built, ["doc_id", "page_number"], "left").withColumn("text", F.coalesce("__built", "text")).drop("__built")
