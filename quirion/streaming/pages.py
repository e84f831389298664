"""Streaming forms: chunks of pages as files arrive, and images without copies across batches.

The page chunker numbers the pages of a document, so a document's pages come in one file, as they do from one request.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from quirion.operators.chunk import page_chunks


def page_stream(spark: SparkSession, path: str, schema: StructType, files_at_once: int = 100) -> DataFrame:
    """Pages from Parquet files as they arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(path)


def chunk_stream(pages: DataFrame, out: str, checkpoint: str, chunker: Callable[[DataFrame], DataFrame] = page_chunks) -> StreamingQuery:
    """Chunks each batch of pages and appends it. A batch that is run again replaces what it wrote before."""

    def write(batch: DataFrame, number: int) -> None:
        chunker(batch).withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(out)

    return pages.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def streamed_chunks(spark: SparkSession, pages: DataFrame, folder: str, files: int = 4) -> DataFrame:
    """The page chunks of a table that is fed through the stream file by file; ``folder`` is shared by all machines."""
    pages.repartition(files, "doc_id").write.mode("overwrite").parquet(f"{folder}/in")
    stream = page_stream(spark, f"{folder}/in", pages.schema, 1)
    chunk_stream(stream, f"{folder}/out", f"{folder}/state").awaitTermination()
    return spark.read.parquet(f"{folder}/out").drop("batch")


def distinct_images(images: DataFrame) -> DataFrame:
    """One image of each content a document, over the whole stream; the state holds a row a document and hash."""
    return images.withColumn("image_hash", F.md5("image_data")).dropDuplicates(["doc_id", "image_hash"])
