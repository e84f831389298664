"""The corpus pipeline: language, near-duplicates, benchmark leaks, mix and shards, over the whole of ``documents``.

Every stage takes the documents that the stage before kept and returns the columns of ``documents``; the last adds
``shard`` and ``slot``. Stages are written as Parquet and read again by the next one.

* language: documents whose language isn't told (``und``) or hardly (a score under ``LEAST_SCORE``, or under ``OVER_CHANCE`` times that of chance where there are many languages) go.
* near_duplicates: of each group of texts with a similarity of five-word shingles of 0.8 or more, found by operator 5's search over several fingerprints of a text, the first stays.
* decontamination: documents that hold a benchmark item go.
* mixing: a document comes as often as the mix takes it, from not at all to three times.
* sharding (columns ``shard`` and ``slot`` of the input are replaced): rows are placed in 16 shards of near equal bytes; copies of a text share a shard, slots have no gaps.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirion.llm import common
from quirion.llm.decontamination import decontaminate
from quirion.llm.language_id import keep_known, learn
from quirion.llm.mixing import mix
from quirion.llm.sharding import shard
from quirion.llm.similar import keep_one

#: A language isn't told if its score is lower than both of these: a limit, and so many times one share of all languages learned.
LEAST_SCORE, OVER_CHANCE = 0.35, 1.4
SHARDS = 16


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    network = learn(docs)
    return keep_known(docs, network, min(LEAST_SCORE, OVER_CHANCE / max(1, len(network.languages))))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one(docs, similarity=0.8, words=5)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate(docs, common.table(spark, sf_dir, "benchmark"))


def _packed(docs: DataFrame) -> DataFrame:
    """The columns that operators look at, and the whole row beside them, so that no name can clash."""
    return docs.select("doc_id", "text", *(["source"] if "source" in docs.columns else []), F.struct("*").alias("__row"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    mixed = mix(_packed(docs), keep=["__row"]).filter("times > 0")
    return mixed.select("__row", F.explode(F.sequence(F.lit(1), F.col("times")))).select("__row.*")


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    placed = shard(_packed(docs.drop("shard", "slot")), SHARDS, keep=["__row"])
    return placed.select("__row.*", "shard", "slot")


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("sharding", sharding),
]

#: Networks, fingerprints and alignments have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that come out of all stages. What a stage wrote is deleted when the next one has written its rows."""
    docs, before = common.table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        if name == STAGES[-1][0]:
            docs, path = common.cut(out), None  # a checkpoint, which goes with its last reference
        else:
            path = common.new_path(spark, name)
            out.write.parquet(path)
            docs = spark.read.parquet(path)
        if before:
            common.remove(spark, before)
        before = path
    return docs
