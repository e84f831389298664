"""The registered queries over the corpus operators, with production parameters over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirion.llm import common, pipeline


def byte_bpe() -> str:
    """The vocabulary file, looked up where it is used."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quirion.llm.decontamination import find_leaks

    return find_leaks(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quirion.llm.token_counts import count_tokens

    return count_tokens(common.table(spark, sf_dir, "documents"), byte_bpe)


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quirion.llm.simhash import near_duplicates

    return near_duplicates(common.table(spark, sf_dir, "documents"), words=3, threshold=2)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quirion.llm.language_id import learn, predict

    docs = common.table(spark, sf_dir, "documents")
    return predict(docs, learn(docs))


def op7_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quirion.llm.token_store import read_store, write_store

    docs = common.table(spark, sf_dir, "documents")
    store = write_store(docs, byte_bpe, end=0)
    found = common.cut(read_store(store, docs))
    store.remove()
    return found


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quirion.llm.line_dedup import repeated_passages

    return repeated_passages(common.table(spark, sf_dir, "documents"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quirion.llm.secret_scan import scan_secrets

    return scan_secrets(common.table(spark, sf_dir, "documents"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quirion.llm.sharding import shard

    placed = shard(common.table(spark, sf_dir, "documents"), 16, ["doc_id"])
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quirion.llm.fingerprints import fingerprint_edits

    return fingerprint_edits(common.table(spark, sf_dir, "documents"), words=5)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quirion.llm.mixing import mix

    mixed = mix(common.table(spark, sf_dir, "documents"), keep=["doc_id"])
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"))


def queries():
    own = (
        op1_decontamination,
        op2_token_counts,
        op3_fingerprints,
        op4_mixing,
        op5_simhash,
        op6_language_id,
        op7_token_store,
        op8_line_dedup,
        op9_secret_scan,
        op10_sharding,
    )
    return {f.__name__: f for f in own} | {"pipeline": pipeline.run}
