"""Documents in an object store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirion.conf import EngineConf
from quirion.providers import PdfDecoder, decoded_spans

SUFFIX = ".pdf"


def configure_store(spark: SparkSession, conf: EngineConf) -> None:
    """Hands the store's endpoint and keys to the file system that reads ``s3a://`` paths."""
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    for key, value in (
        ("fs.s3a.endpoint", conf.storage_endpoint),
        ("fs.s3a.access.key", conf.storage_access_key),
        ("fs.s3a.secret.key", conf.storage_secret_key),
        ("fs.s3a.endpoint.region", conf.storage_region),
    ):
        if value:
            hadoop.set(key, value)


def files(spark: SparkSession, path: str, pattern: str = "*.pdf") -> DataFrame:
    """``path``, ``length``, ``content`` and a ``doc_id`` made from the path. Content is only read where it is used."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return found.select(F.xxhash64("path").alias("doc_id"), "path", "length", "content")


def validated(requests: DataFrame, listing: DataFrame) -> DataFrame:
    """For each request (``bucket``, ``file_key``): whether it exists in the listing (same columns) and is supported."""
    known = listing.select("bucket", "file_key").distinct().withColumn("__known", F.lit(True))
    exists = F.coalesce("__known", F.lit(False))
    supported = F.lower("file_key").endswith(SUFFIX)
    found = requests.join(known, ["bucket", "file_key"], "left")
    return found.select("bucket", "file_key", exists.alias("exists"), supported.alias("supported"), F.when(exists & supported, "OK").otherwise("Documento inválido").alias("message"))


def spans(found: DataFrame, decoder: PdfDecoder) -> DataFrame:
    """Spans of the pages of PDF files, by a decoder."""
    return decoded_spans(found, decoder)
