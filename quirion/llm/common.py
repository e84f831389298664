"""Helpers that the corpus operators share."""

from __future__ import annotations

import math
import re
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from quirion.functions.arrays import let

#: Words of the corpus contracts: runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"
GAPS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where all run in one process."""
    found = spark.conf.get("spark.checkpoint.dir", None) or _checkpoint_dir(spark)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="quirion-shared-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def _checkpoint_dir(spark: SparkSession) -> str | None:
    at = spark.sparkContext._jsc.sc().getCheckpointDir()
    return at.get() if at.isDefined() else None


def new_path(spark: SparkSession, kind: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/quirion-{kind}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder in whatever store it is."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def cut(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a reliable checkpoint in the shared folder; Spark's cleaner removes it with its last reference."""
    spark = df.sparkSession
    if _checkpoint_dir(spark) is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


def pieces(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The rows of Arrow batches in pieces of at most ``rows``, which bounds what is made of a batch at a time."""
    for batch in batches:
        for at in range(0, max(batch.num_rows, 1), rows):
            yield batch.slice(at, rows)


def ranked(df: DataFrame, group: list[str], order: list[str], salt: str, out: str) -> DataFrame:
    """Adds a rank from 1 in each group, by ``salt`` and then ``order``, without bringing a group together.

    ``salt`` is a column of integers that splits a large group evenly. Rows are counted by group and salt, the counts
    are summed up over the salts before, and only rows of one salt are ranked against each other. Neither ``group`` nor
    ``salt`` may hold nulls.
    """
    keys = [*group, salt]
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*group).orderBy(salt).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*keys, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    inside = df.withColumn("__rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return inside.join(starts, keys).select(*df.columns, (F.col("__rank") + F.col("__start")).alias(out))


def id_bounds(docs: DataFrame, id_col: str, parts: int) -> list[int]:
    """At most ``parts - 1`` ids of the table that cut it into parts of about equal row counts, ascending.

    Ids are whole numbers; others raise an error.
    """
    if not isinstance(docs.schema[id_col].dataType, IntegralType):
        raise TypeError(f"{id_col} is {docs.schema[id_col].dataType.simpleString()}; ranges of ids need whole numbers")
    shares = [k / parts for k in range(1, parts)]
    if not shares:
        return []
    found = docs.agg(F.percentile_approx(id_col, shares, max(10_000, 20 * parts)).alias("b")).first()["b"]
    return sorted(set(found or []))


class Ranges:
    """Ranges of whole numbers between ascending bounds; range 0 is below or at the first one, and holds nulls.

    A number's range is found in two looks at about the square root of the bounds each.
    """

    def __init__(self, bounds: list[int]):
        self.bounds = bounds
        self.step = max(1, math.isqrt(max(1, len(bounds)) - 1) + 1)
        self.groups = [bounds[k : k + self.step] for k in range(0, len(bounds), self.step)]

    def of(self, at: Column) -> Column:
        """The number of bounds below ``at``."""
        if not self.bounds:
            return F.lit(0)
        longs = lambda values: F.array(*(F.lit(v).cast("bigint") for v in values))
        below = lambda values: F.size(F.filter(values, lambda b: b < at))
        groups = F.array(*map(longs, self.groups))
        inside = lambda g: F.when(g < len(self.groups), g * self.step + below(F.get(groups, g))).otherwise(len(self.bounds))
        return let(below(longs(g[-1] for g in self.groups)), inside)

    def ends(self, at: Column) -> Column:
        """Whether ``at`` is one of the bounds."""
        return F.coalesce(at.isin(self.bounds), F.lit(False)) if self.bounds else F.lit(False)


def join_hot(left: DataFrame, right: DataFrame, key: str, count: str, most: int, spread: list[str] | None = None) -> DataFrame:
    """Inner join with a table of one row a key, in which ``count`` is the number of left rows with the key.

    Keys with over one ``most``-th of the counted rows, of which there can't be more than ``most``, are split into parts
    by a hash of the ``spread`` columns of the left (all by default), and their rows of the right are repeated for each
    part. The left is read once. ``count`` is dropped.
    """
    total = right.agg(F.sum(count).alias("n")).first()["n"] or 0
    share = max(1, total // most)
    hot = right.filter(F.col(count) > share).select(key, F.ceil(F.col(count) / share).cast("int").alias("__parts"))
    part = F.pmod(F.xxhash64(*(spread or left.columns)), F.coalesce("__parts", F.lit(1))).cast("int")
    dealt = left.join(F.broadcast(hot), key, "left").withColumn("__part", part).drop("__parts")
    parts = F.when(F.col(count) > share, F.ceil(F.col(count) / share).cast("int")).otherwise(1)
    repeated = right.withColumn("__part", F.explode(F.sequence(F.lit(0), parts - 1))).drop(count)
    return dealt.join(repeated, [key, "__part"]).drop("__part")
