"""Connected components by repeated contraction, with distributed tables only.

In each round every node turns to the neighbour (or itself) that comes first in an order drawn anew for the round, and
edges move to those parents. A round removes a constant share of the nodes on average, whatever the shape, so chains
and stars alike end after a number of rounds in the order of the logarithm of the nodes. The last ``FEW`` edges are
joined by one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirion.llm import common

#: Edges that are left to one task.
FEW = 20_000


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``label`` of every node of ``edges`` (``a``, ``b``: two columns of one type without nulls).

    Nodes have the same label exactly if edges connect them; the label is one of the nodes. Loops and repeated edges do
    no harm; loops alone bring no node. An empty table gives an empty result.
    """
    edges = common.cut(_between(edges.select("a", "b")))
    levels: list[DataFrame] = []
    while left := edges.count():
        if left <= FEW:
            levels.append(common.cut(_joined(edges)))
            break
        salt = F.lit(len(levels))
        order = lambda c: F.struct(F.xxhash64(c, salt).alias("o"), F.col(c).alias("n"))  # noqa: B023, E731
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        first = both.groupBy("a").agg(F.min(order("b")).alias("m"))
        parents = common.cut(first.select(F.col("a").alias("node"), F.least("m", order("a"))["n"].alias("label")))
        levels.append(parents)
        moved = edges.join(parents.select(F.col("node").alias("a"), F.col("label").alias("x")), "a")
        moved = moved.join(parents.select(F.col("node").alias("b"), F.col("label").alias("y")), "b")
        edges = common.cut(_between(moved.select(F.col("x").alias("a"), F.col("y").alias("b"))))
    if not levels:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
    found = levels.pop()
    while levels:
        above = found.select(F.col("node").alias("label"), F.col("label").alias("top"))
        found = levels.pop().join(above, "label", "left").select("node", F.coalesce("top", "label").alias("label"))
    return found


def _joined(edges: DataFrame) -> DataFrame:
    """``node`` and ``label`` by one task's union-find."""
    kind = edges.schema["a"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top: dict = {}

        def find(x):
            while top[x] != x:
                top[x] = x = top[top[x]]
            return x

        types = []
        for batch in batches:
            types.append(batch.schema.field(0).type)
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x, y = find(top.setdefault(a, a)), find(top.setdefault(b, b))
                top[max(x, y)] = min(x, y)
        if types:
            nodes = list(top)
            yield pa.RecordBatch.from_arrays([pa.array(nodes, types[0]), pa.array([find(n) for n in nodes], types[0])], names=["node", "label"])

    return edges.select("a", "b").coalesce(1).mapInArrow(run, f"node {kind}, label {kind}")


def _between(edges: DataFrame) -> DataFrame:
    """Each edge once, without loops."""
    return edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
