"""Events of a run and their form on the wire."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Names on the wire.
LANGUAGES = {"PORTUGUESE": "por", "ENGLISH": "eng", "SPANISH": "spa", "FRENCH": "fra", "GERMAN": "deu", "ITALIAN": "ita"}
STRATEGIES = {"UNSPECIFIED": "page", "SEMANTIC": "semantic", "PARAGRAPH": "paragraph", "HYBRID": "hybrid"}
PROVIDERS = ("openai", "anthropic")
STAGES = {
    "validating": "VALIDATING", "downloading": "DOWNLOADING", "extracting": "EXTRACTING", "chunking": "CHUNKING", "finished": "FINISHED",
    "download_complete": "DOWNLOADING", "type_detection_complete": "EXTRACTING", "page_extracted": "EXTRACTING", "text_extraction_complete": "EXTRACTING",
    "layout_analysis_complete": "EXTRACTING", "noise_removal_complete": "EXTRACTING", "section_classification_complete": "EXTRACTING",
    "image_detection_complete": "EXTRACTING", "llm_chunking_starting": "CHUNKING", "semantic_chunking_starting": "CHUNKING",
    "paragraph_chunking_starting": "CHUNKING", "chunking_complete": "CHUNKING",
}


def looked_up(key: Column, names: dict[str, str], default: str) -> Column:
    """A name by its key; ``default`` for keys that aren't there."""
    table = F.create_map(*(F.lit(x) for pair in names.items() for x in pair))
    return F.coalesce(F.element_at(table, key), F.lit(default))


def language_code(c: Column) -> Column:
    return looked_up(c, LANGUAGES, "por")


def strategy_name(c: Column) -> Column:
    return looked_up(c, STRATEGIES, "page")


def stage_code(c: Column) -> Column:
    return looked_up(F.lower(c), STAGES, "IDLE")


def method_code(c: Column) -> Column:
    return looked_up(c, {v: k for k, v in STRATEGIES.items()}, "UNSPECIFIED")


def content_source(c: Column) -> Column:
    return F.when(c == "image_description", "LLM_GENERATED").otherwise("OCR_EXTRACTION")


def request_options(provider: str | None, model: str | None, temperature: float, max_tokens: int, strategy: str, api_key: str | None) -> dict:
    """Options of a request from its wire form; values that aren't set become None."""
    return {
        "chunk_strategy": STRATEGIES.get(strategy, "page"),
        "llm_provider": provider if provider in PROVIDERS else None,
        "llm_model": model or None,
        "llm_api_key": api_key or None,
        "llm_temperature": temperature if temperature > 0 else None,
        "llm_max_tokens": max_tokens if max_tokens > 0 else None,
    }


def events(chunks: DataFrame, docs: DataFrame, errors: DataFrame | None = None) -> DataFrame:
    """A row for each chunk, and one that ends each document: complete with its number of chunks, or an error.

    ``docs`` has all ``doc_id``s; ``errors`` has ``doc_id`` and ``message``. Documents with errors have no other end.
    Image chunks in ``chunks`` come before text chunks and don't count in the total.
    """
    none = lambda kind: F.lit(None).cast(kind)
    if "chunk_metadata" not in chunks.columns:
        chunks = chunks.withColumn("chunk_metadata", none("string"))
    picture = F.col("chunking_method") == "image_description"
    rows = chunks.select(
        "doc_id", F.lit("chunk").alias("type"), F.when(picture, 0).otherwise(1).alias("part"), "chunk_index", "page_numbers", "content", "chunking_method",
        "chunk_metadata", none("int").alias("total_chunks"), none("string").alias("message"),
    )
    totals = chunks.filter(~picture).groupBy("doc_id").agg(F.count(F.lit(1)).cast("int").alias("n"))
    failed = errors if errors is not None else docs.select("doc_id", none("string").alias("message")).limit(0)
    ended = docs.select("doc_id").distinct().join(failed, "doc_id", "left").join(totals, "doc_id", "left")
    good = F.col("message").isNull()
    ends = ended.select(
        "doc_id", F.when(good, "complete").otherwise("error").alias("type"), F.lit(2).alias("part"), none("int").alias("chunk_index"), none("array<int>").alias("page_numbers"),
        none("string").alias("content"), none("string").alias("chunking_method"), none("string").alias("chunk_metadata"), F.when(good, F.coalesce("n", F.lit(0))).alias("total_chunks"), "message",
    )
    return rows.unionByName(ends)


def wire(rows: DataFrame) -> DataFrame:
    """Events as messages: status, stage, codes for method and source, and the rest as it is."""
    kind = F.col("type")
    is_chunk = kind == "chunk"
    return rows.select(
        "doc_id", "part", "chunk_index",
        F.when(is_chunk, "PROCESSING").when(kind == "complete", "COMPLETED").otherwise("FAILED").alias("status"),
        F.when(kind == "complete", "FINISHED").alias("stage"), "page_numbers", F.col("content").alias("text"), "chunk_metadata",
        F.when(is_chunk, method_code(F.col("chunking_method"))).alias("chunking_method"), F.when(is_chunk, content_source(F.col("chunking_method"))).alias("content_source"),
        F.lit("").alias("template_used"), "total_chunks", F.col("message").alias("error_message"),
    )


def chunk_metadata(chunks: DataFrame) -> DataFrame:
    """Adds ``chunk_metadata``, the facts of a chunk as JSON with other alphabets kept; facts that it doesn't have are left out."""
    facts = ("chunking_method", "char_count", "word_count", "paragraph_count", "image_index", "width", "height", "processing_status", "error_type")
    return chunks.withColumn("chunk_metadata", F.to_json(F.struct(*(c for c in facts if c in chunks.columns))))
