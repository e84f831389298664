"""Where chunks and events go."""

from __future__ import annotations

from pyspark.sql import DataFrame

from quirion.operators.events import wire


def write_events(rows: DataFrame, path: str, form: str = "parquet") -> None:
    """Writes wire messages of events, parted by status, so that readers of chunks skip the ends."""
    wire(rows).write.mode("overwrite").partitionBy("status").format(form).save(path)


def write_chunks(chunks: DataFrame, path: str) -> None:
    chunks.write.mode("overwrite").parquet(path)
