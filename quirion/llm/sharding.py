"""Sharding by minimax contiguous partition.

Documents of equal text form an atomic group, and groups are ordered by the hash of their text. The smallest capacity
with which ``n`` contiguous shards hold all groups is found by binary search with a greedy check, and the cuts are made
for that capacity. The driver holds no row for each group: neighbours share a unit, of which there are ``UNITS`` at most,
and only the units beside a cut are taken apart by further bits of the hash, into ``UNITS`` parts at most each, until no cut
moves to a unit that is still whole. So cuts are exact up to groups that share 32 bits of their hashes. As a
document's shard follows from its text and the cuts, no row is moved to find it; only the slots, which number the rows of a
shard without gaps, need a shuffle, and hot units are split for it.

Defined results: a null text has no bytes and shares a group with the empty text; repeated rows are placed together,
each with a slot of its own; an empty table gives an empty result; columns of the input with clashing names are kept
out by choosing what to ``keep``.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirion.llm import common

#: Atomic units at most; what the driver gathers and broadcasts is bounded by it.
UNITS = 1 << 16
UNIT_BITS = UNITS.bit_length() - 1
#: Times that units beside new cuts are taken apart.
ROUNDS = 4


def fits(ends: np.ndarray, capacity: int, shards: int) -> bool:
    """Greedy check: whether ``shards`` contiguous shards of the capacity hold all sizes; ``ends`` are running sums."""
    filled = 0
    for _ in range(shards):
        k = int(np.searchsorted(ends, filled + capacity, "right"))
        if k == len(ends):
            return True
        filled = int(ends[k - 1]) if k else 0
    return False


def smallest_capacity(sizes: np.ndarray, shards: int) -> int:
    """The least capacity with which contiguous shards hold all sizes."""
    ends = np.cumsum(sizes, dtype=np.int64)
    if not len(ends):
        return 0
    low, high = max(int(sizes.max()), -(-int(ends[-1]) // shards)), int(ends[-1])
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if fits(ends, middle, shards) else (middle + 1, high)
    return low


def minimax_cuts(sizes: np.ndarray, shards: int) -> list[int]:
    """``shards - 1`` ascending positions that cut the sizes into shards none of which exceeds the smallest capacity.

    Of the cuts that keep to that capacity, each is the one nearest to an even share of what is left: not past what
    the shard holds, and not before the point from which the shards behind it can hold the rest.
    """
    n, capacity = len(sizes), smallest_capacity(sizes, shards)
    ends = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    least = [n]  # the earliest start of the last 1, 2, ... shards
    for _ in range(shards - 1):
        least.append(int(np.searchsorted(ends, ends[least[-1]] - capacity, "left")))
    cuts, at = [], 0
    for left in range(shards, 1, -1):
        share = ends[at] + (ends[n] - ends[at]) / left
        even = int(np.searchsorted(ends, share, "right")) - 1
        if even < n and share - ends[even] > ends[even + 1] - share:
            even += 1
        most = int(np.searchsorted(ends, ends[at] + capacity, "right")) - 1
        at = max(at, min(max(even, least[left - 1]), most))
        cuts.append(at)
    return cuts


def _text(col: str) -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def shard(docs: DataFrame, shards: int = 16, keep: list[str] | None = None, text_col: str = "text", tie_col: str = "doc_id") -> DataFrame:
    """The rows with ``keep`` columns (all by default), ``size``, ``text_crc32``, ``shard`` and ``slot``.

    ``size`` is the bytes of the text plus one. Columns of the input named like these four are replaced.
    """
    made = ("size", "text_crc32", "shard", "slot")
    keep = [c for c in (docs.columns if keep is None else keep) if c not in made]
    text = _text(text_col)
    digest = F.xxhash64(text)
    rows = docs.select(
        *keep,
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        digest.alias("__digest"),
        F.shiftrightunsigned(digest, 64 - 2 * UNIT_BITS).alias("__key"),
        F.shiftrightunsigned(digest, 64 - UNIT_BITS).cast("int").alias("__unit"),
        F.xxhash64(F.col(tie_col), F.lit(1)).alias("__spread"),
    )
    pieces = Pieces(rows)
    cuts = pieces.cuts(shards)
    of = np.searchsorted(cuts, pieces.keys, "right")
    # The rows of a unit in a shard: where they start in the shard, and into how many parts they are split for ranking.
    held: dict[tuple[int, int], int] = {}
    for key, shard_, n in zip(pieces.keys.tolist(), of.tolist(), pieces.rows.tolist(), strict=True):
        place = key >> UNIT_BITS, shard_
        held[place] = held.get(place, 0) + n
    total = sum(held.values())
    usual, filled, table = max(1, total // UNITS), [0] * shards, []
    for (unit, shard_), n in held.items():
        table.append((unit, shard_, filled[shard_], max(1, n // max(200, 8 * usual))))
        filled[shard_] += n
    places = docs.sparkSession.createDataFrame(table, "__unit int, shard int, __before long, __parts long")
    own = F.lit(0)
    for cut in cuts.tolist():
        own = own + (F.col("__key") >= cut).cast("int")
    placed = rows.withColumn("shard", own).join(F.broadcast(places), ["__unit", "shard"]).withColumn("__salt", F.pmod(F.col("__spread"), F.col("__parts")))
    found = common.ranked(placed, ["__unit", "shard"], ["__digest", "__spread"], "__salt", "__rank_in_unit")
    return found.select(*keep, "size", "text_crc32", "shard", (F.col("__before") + F.col("__rank_in_unit") - 1).alias("slot"))


class Pieces:
    """Groups of texts by ascending ``keys`` (the first bits of their hashes), with ``bytes`` and ``rows``: units, and parts of some."""

    def __init__(self, rows: DataFrame):
        self.table, self.apart = rows, set()
        self.keys, self.bytes, self.rows = self._sums(rows, F.shiftleft(F.col("__unit").cast("long"), UNIT_BITS))

    def _sums(self, rows: DataFrame, key: Column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        found = rows.groupBy(key.alias("k")).agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows")).toArrow().sort_by("k")
        return tuple(found[c].to_numpy().astype(np.int64) for c in ("k", "bytes", "rows"))

    def _take_apart(self, units: set[int]) -> None:
        parts = self._sums(self.table.filter(F.col("__unit").isin(sorted(units))), F.col("__key"))
        rest = ~np.isin(self.keys >> UNIT_BITS, sorted(units))
        merged = [np.concatenate([own[rest], new]) for own, new in zip((self.keys, self.bytes, self.rows), parts, strict=True)]
        order = np.argsort(merged[0], kind="stable")
        self.keys, self.bytes, self.rows = (m[order] for m in merged)
        self.apart |= units

    def cuts(self, shards: int) -> np.ndarray:
        """The keys at which the shards after the first one start; one past all keys for shards that stay empty."""
        for _ in range(ROUNDS):
            at = minimax_cuts(self.bytes, shards) if len(self.keys) else []
            beside = {int(self.keys[k]) >> UNIT_BITS for c in at for k in (c - 1, c) if 0 <= k < len(self.keys)} - self.apart
            if not beside:
                break
            self._take_apart(beside)
        at = minimax_cuts(self.bytes, shards) if len(self.keys) else [0] * (shards - 1)
        return np.append(self.keys, 1 << 2 * UNIT_BITS)[at]
