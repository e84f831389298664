"""Mixing sources to target weights by subset-sum budget fitting.

Every source gets a target of words. It is taken whole as often as the target allows; the words that remain are made
up of single documents. For those, documents are counted by exact length, a proportional share of each length is
taken, and a bounded-knapsack dynamic programme over the remaining counts fits what is left to the word. Which documents
of a length are taken follows from a seeded hash of their ids and texts.

Only a row for each source reaches the driver; up to ``BROADCAST`` of them are broadcast, more are joined by shuffles. Histograms of lengths stay distributed, one row
per source and length. Hot pairs of source and length are split by hash before they are ranked.

Defined results: a null text has size 0, and documents of size 0 are never taken; a null source is a source of its own,
ordered last; repeated rows are documents of their own; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quirion.llm import common

#: Sources up to which their table is broadcast.
BROADCAST = 10_000
#: Words that the dynamic programme fits; what exceeds them is taken in whole documents before.
WINDOW = 1 << 16
#: A pair of source and length with over this share of all rows is split for ranking; so there are at most as many.
HOT_SHARE = 2000


def capped_targets(sizes: list[int], weights: list[float], total: float, epochs: int) -> list[float]:
    """Shares of ``total`` by weight, none above ``epochs`` times its size; what is cut off is shared again by weight."""
    targets, open_ = [0.0] * len(sizes), [k for k, s in enumerate(sizes) if s > 0]
    left = float(total)
    while open_:
        weight = sum(weights[k] for k in open_)
        over = [k for k in open_ if left * weights[k] / weight > epochs * sizes[k]]
        if not over:
            for k in open_:
                targets[k] = left * weights[k] / weight
            break
        for k in over:
            targets[k] = float(epochs * sizes[k])
            left -= targets[k]
        open_ = [k for k in open_ if k not in set(over)]
    return targets


def knapsack(lengths: list[int], counts: list[int], budget: int) -> list[int]:
    """How many of each length to take, within its count, so that their sum is the largest that the budget holds.

    Sums reached are bits of one integer; each is noted with the step that first reached it.
    """
    reached, mask = 1, (1 << (budget + 1)) - 1
    step_of = np.zeros(budget + 1, np.int64)
    steps: list[tuple[int, int]] = [(0, 0)]
    for k, (length, count) in enumerate(zip(lengths, counts, strict=True)):
        if reached >> budget & 1:
            break
        count, times = min(count, budget // length), 1
        while count > 0:
            n = min(times, count)
            new = (reached << (length * n)) & mask & ~reached
            if new:
                steps.append((k, n))
                bits = np.unpackbits(np.frombuffer(new.to_bytes(budget // 8 + 1, "little"), np.uint8), bitorder="little")
                step_of[np.flatnonzero(bits[: budget + 1])] = len(steps) - 1
                reached |= new
            count, times = count - n, times * 2
    takes, at = [0] * len(lengths), reached.bit_length() - 1
    while at:
        k, n = steps[step_of[at]]
        takes[k] += n
        at -= lengths[k] * n
    return takes


def fit_budget(lengths: np.ndarray, counts: np.ndarray, budget: int, window: int = WINDOW) -> np.ndarray:
    """How many documents of each length make up the budget, to the word where the counts allow it."""
    total = int(sum(int(a) * int(b) for a, b in zip(lengths, counts, strict=True)))
    budget = min(budget, total)
    takes = np.zeros(len(lengths), np.int64)
    if budget <= 0:
        return takes
    order = np.argsort(-lengths, kind="stable")
    order = order[lengths[order] > 0]
    left = budget
    if left > window:
        for k in order:
            takes[k] = int(counts[k]) * (budget - window // 2) // total
        left -= int((takes * lengths).sum())
    while left > window:
        for k in order:
            if left > window and takes[k] < counts[k] and lengths[k] <= left:
                takes[k] += 1
                left -= int(lengths[k])
        if not any(takes[k] < counts[k] and lengths[k] <= left for k in order):
            break
    small = [k for k in order if lengths[k] <= left and takes[k] < counts[k]]
    if left > 0 and small:
        got = knapsack([int(lengths[k]) for k in small], [int(counts[k] - takes[k]) for k in small], min(left, window))
        takes[small] += np.array(got, np.int64)
    return takes


def mix(
    docs: DataFrame,
    weights: tuple[float, ...] = (1, 2, 3),
    share: float = 1.0,
    epochs: int = 3,
    seed: int = 20,
    keep: list[str] | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """The rows with ``keep`` columns (all by default), ``size``, ``source_size``, ``target`` and ``times``.

    ``weights`` go to the sources in code-point order, over and over; the targets add up to ``share`` of all words as
    far as ``epochs`` allows. ``times`` is how often the mix takes the document. Input columns named like the new ones
    are replaced.
    """
    made = ("size", "source_size", "target", "times")
    keep = [c for c in (docs.columns if keep is None else keep) if c not in made]
    rows = docs.select(
        *keep,
        F.col(source_col).alias("__source"),
        F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(common.WORD)).cast("long").alias("size"),
        F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col)).alias("__hash"),
    )
    lengths = common.cut(rows.groupBy("__source", "size").agg(F.count(F.lit(1)).alias("n")))
    totals = lengths.groupBy("__source").agg(F.sum(F.col("size") * F.col("n")).alias("words"), F.sum("n").alias("n"))
    sources = sorted(totals.collect(), key=lambda r: (r["__source"] is None, r["__source"] or ""))
    sizes, n_rows = [r["words"] for r in sources], sum(r["n"] for r in sources)
    targets = capped_targets(sizes, [weights[k % len(weights)] for k in range(len(sizes))], share * sum(sizes), epochs)
    plan = []
    for k, (r, target) in enumerate(zip(sources, targets, strict=True)):
        budget = round(target)
        whole = min(epochs, budget // r["words"]) if r["words"] else 0
        plan.append((r["__source"], k, r["words"], target, whole, 0 if whole == epochs else budget - whole * r["words"]))
    spark = docs.sparkSession
    kind = docs.select(source_col).schema[0].dataType.simpleString()
    table = spark.createDataFrame(plan, f"__name {kind}, __code int, source_size long, target double, __whole int, __budget long")

    def coded(df: DataFrame) -> DataFrame:
        return df.join(F.broadcast(table) if len(plan) <= BROADCAST else table, F.col("__source").eqNullSafe(F.col("__name"))).drop("__source", "__name")

    def fitted(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("size")
        takes = fit_budget(pdf["size"].to_numpy(np.int64), pdf["n"].to_numpy(np.int64), int(pdf["__budget"].iloc[0]))
        return pd.DataFrame({"__code": pdf["__code"], "size": pdf["size"], "__quota": takes})

    pair = ["__code", "size"]
    quotas = coded(lengths).groupBy("__code").applyInPandas(fitted, "__code int, size long, __quota long")
    most = max(1, n_rows // HOT_SHARE)
    hot = coded(lengths.filter(F.col("n") > most)).select(*pair, F.ceil(F.col("n") / most).alias("__parts"))
    # Salts are ranges of the seeded hash, so that ranks by salt and then hash are ranks by hash.
    position = F.shiftrightunsigned("__hash", 33).cast("double") / float(1 << 31)
    salted = coded(rows).join(F.broadcast(hot), pair, "left")
    salted = salted.withColumn("__salt", F.coalesce(F.floor(position * F.col("__parts")), F.lit(0))).drop("__parts", "__budget")
    keys = [*pair, "__salt"]
    before = Window.partitionBy(*pair).orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = salted.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    starts = starts.select(*keys, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    starts = starts.join(quotas, pair).select(*keys, (F.col("__quota") - F.col("__start")).alias("__take"))
    inside = salted.withColumn("__rank", F.row_number().over(Window.partitionBy(*keys).orderBy("__hash")))
    times = F.when(F.col("size") == 0, 0).otherwise(F.col("__whole") + (F.col("__rank") <= F.col("__take")).cast("int"))
    return inside.join(starts, keys).select(*keep, "size", "source_size", "target", times.alias("times"))
