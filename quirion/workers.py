"""Lets Python workers import this package wherever the driver was started."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)


def findable(spark: SparkSession) -> None:
    """Puts the package's folder on the search path of workers that start from now on.

    Where executors have no such folder, that does no harm; there the package has to be installed or shipped.
    """
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, ROOT])
