"""Array expressions: single evaluation, cosine, and the ordered greedy fold."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over ``value``, which is evaluated once however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors in double precision; 0 if either has no length."""

    def dot(x: Column, y: Column) -> Column:
        products = F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double"))
        return F.aggregate(products, F.lit(0.0), lambda acc, v: acc + v)

    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms == 0, F.lit(0.0)).otherwise(dot(a, b) / norms)


def greedy_spans(sizes: Column, limit: int, overlap: int = 0, linked: Column | None = None) -> Column:
    """Spans (first, last; from 1) of an ordered greedy packing of ``sizes``.

    A span ends before an element that would take its sum over ``limit``, or that isn't linked to the one before; an
    element over the limit is a span of its own. With ``overlap``, the next span starts with the longest tail of
    the one before whose sum is within it. The state holds the running sum and the spans closed so far, so the work grows
    with the elements and not with their square.
    """

    def fold(n: Column) -> Column:
        size = lambda i: F.element_at(n, i)
        start = F.struct(
            F.lit(1).alias("first"), F.lit(0).cast("bigint").alias("sum"), F.array().cast("array<struct<first:int,last:int>>").alias("done")
        )

        def tail(first: Column, i: Column) -> Column:
            """The first element of the tail that is carried over, and the tail's sum."""
            none = F.struct(i.alias("at"), F.lit(0).cast("bigint").alias("sum"), F.lit(True).alias("open"))
            if not overlap:
                return none

            def step(s: Column, k: Column) -> Column:
                fits = s["open"] & (s["sum"] + size(k) <= overlap)
                return F.struct(F.when(fits, k).otherwise(s["at"]).alias("at"), F.when(fits, s["sum"] + size(k)).otherwise(s["sum"]).alias("sum"), fits.alias("open"))

            return F.aggregate(F.sequence(i - 1, first, F.lit(-1)), none, step)

        def step(s: Column, i: Column) -> Column:
            over = s["sum"] + size(i) > limit
            if linked is not None:
                over = over | ~F.element_at(linked, i)
            closed = lambda t: F.struct(
                t["at"].alias("first"),
                (t["sum"] + size(i)).alias("sum"),
                F.concat(s["done"], F.array(F.struct(s["first"].alias("first"), (i - 1).alias("last")))).alias("done"),
            )
            longer = F.struct(s["first"].alias("first"), (s["sum"] + size(i)).alias("sum"), s["done"].alias("done"))
            return F.when((i > s["first"]) & over, let(tail(s["first"], i), closed)).otherwise(longer)

        end = lambda s: F.concat(s["done"], F.array(F.struct(s["first"].alias("first"), F.size(n).alias("last"))))
        return F.when(F.size(n) > 0, F.aggregate(F.sequence(F.lit(1), F.size(n)), start, step, end)).otherwise(F.array().cast("array<struct<first:int,last:int>>"))

    return let(F.transform(sizes, lambda x: x.cast("bigint")), fold)
