"""SimHash near-duplicates by a generalised pigeonhole search.

Fingerprints of 64 bits are gathered once each, whatever number of documents has them. Their bits are grouped so that
correlated bits share a partition. If two fingerprints differ in at most ``t`` bits and the partitions' thresholds plus
one add up to ``t + 1``, some partition differs in no more bits than its threshold; a threshold of -1 leaves a partition
out. Each fingerprint gets its own thresholds: a dynamic programme takes those with the fewest candidates, estimated
from histograms of half partitions. It then probes the buckets of the values within its thresholds, and pairs found are
verified. Connected pairs make the groups.

There are so many partitions that an average bucket has at most ``AVERAGE`` fingerprints: three of 21 or 22 bits up to
8.4 million distinct fingerprints, and two of 32 bits beyond, of which the thresholds are mostly 1 and 0. So at any
size the search brings most links, and only buckets that correlated bits fill have many more.

Buckets with over ``BUCKET`` fingerprints are not paired. Those fingerprints that lie in such a bucket which is probed,
or probe one, are linked exactly by another rule: two fingerprints differ in at most 2 bits if and only if some
value differs in at most one bit from both. Each puts itself under its 65 values, and no value has more than 65, so the
work is in proportion to the fingerprints however they crowd.

Defined results: a null or empty text has no words and fingerprint zero, which links like any other; repeated rows and
equal texts share a group; a null id never becomes a group's id unless all its ids are null; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirion.llm import common
from quirion.llm.components import components

BITS = 64
#: Fingerprints that an average bucket may have.
AVERAGE = 4
#: Fingerprints that a bucket may have to be paired directly.
BUCKET = 64
#: A fingerprint with over this share of all rows counts as hot; so there are at most as many.
HOT = 2000
#: Tasks that sum counters, so that their rows don't grow with the input.
SUMMERS = 512
_WORDS = re.compile(rb"[^\x20\x09-\x0D]+")


def shingle_hashes(text: str, words: int, seed: int = 42) -> np.ndarray:
    """XXH64 of each run of ``words`` words, repeats included; of the whole sequence if it is shorter."""
    found = _WORDS.findall(text.encode("utf-8").lower())  # bytes: only A to Z change
    if not found:
        return np.empty(0, np.uint64)
    runs = map(b" ".join, zip(*(found[k:] for k in range(words)), strict=False)) if len(found) >= words else [b" ".join(found)]
    return np.array(list(map(xxhash.xxh64_intdigest, runs, repeat(seed))), np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes."""
    counts, n = np.zeros(BITS, np.int64), len(hashes)
    for k in range(0, n, 1 << 16):
        part = np.ascontiguousarray(hashes[k : k + (1 << 16)], "<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0]) if n else 0


def fingerprints(docs: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    """``id`` and ``fp`` (signed) of every row."""
    given = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    kind = given.schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.pieces(batches):
            made = np.array([fingerprint(shingle_hashes(t, words)) for t in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made.view(np.int64))], names=["id", "fp"])

    return given.mapInArrow(run, f"id {kind}, fp long")


# --- partitions and thresholds --------------------------------------------------------------------------------------


def partitions_for(n: int) -> int:
    """Partitions for ``n`` distinct fingerprints: three, or two if the buckets of three would be crowded on average."""
    return 3 if n <= AVERAGE << (BITS // 3) else 2


def grouped_bits(together: np.ndarray, ones: np.ndarray, n: int, partitions: int) -> list[list[int]]:
    """Bits in partitions of about equal width, each grown by the bit most correlated with those it has."""
    share = ones / max(n, 1)
    spread = np.sqrt(share * (1 - share))
    with np.errstate(divide="ignore", invalid="ignore"):
        linked = np.abs((together / max(n, 1) - np.outer(share, share)) / np.outer(spread, spread))
    linked = np.nan_to_num(linked, posinf=0, neginf=0)
    np.fill_diagonal(linked, 0)
    free, groups = set(range(BITS)), []
    for k in range(partitions):
        width = (BITS - sum(map(len, groups))) // (partitions - k)
        left = sorted(free)
        group = [max(left, key=lambda b: (linked[b, left].sum(), -b))]
        free.discard(group[0])
        while len(group) < width:
            best = max(sorted(free), key=lambda b: (linked[b, group].sum(), -b))
            group.append(best)
            free.discard(best)
        groups.append(group)
    return groups


def values(fps: np.ndarray, bits: list[int]) -> np.ndarray:
    """The values of some bits of each fingerprint, the first bit lowest."""
    out = np.zeros(len(fps), np.int64)
    for k, b in enumerate(bits):
        out |= ((fps >> np.uint64(b)) & np.uint64(1)).astype(np.int64) << k
    return out


def flips(width: int, radius: int) -> np.ndarray:
    """All patterns of at most ``radius`` set bits."""
    return np.array([sum(1 << b for b in c) for r in range(radius + 1) for c in combinations(range(width), r)], np.int64)


def within(counts: np.ndarray, width: int, radius: int) -> list[np.ndarray]:
    """For 0 to ``radius``, how much of the histogram lies at exactly that distance from each value."""
    at, out = np.arange(len(counts)), []
    for r in range(radius + 1):
        masks = [sum(1 << b for b in c) for c in combinations(range(width), r)]
        out.append(sum(counts[at ^ m] for m in masks))
    return out


class Plan:
    """Partitions, histograms of their halves, and the choice of thresholds."""

    def __init__(self, groups: list[list[int]], halves: list[np.ndarray], n: int, threshold: int):
        self.groups, self.n, self.threshold = groups, n, threshold
        self.near = []
        for k, group in enumerate(groups):
            low = len(group) // 2
            sides = zip(halves[2 * k : 2 * k + 2], (low, len(group) - low), strict=True)
            self.near.append([within(h / max(n, 1), w, threshold) for h, w in sides])
        self.patterns = [[flips(len(g), r) for r in range(threshold + 1)] for g in groups]

    def costs(self, k: int, value: np.ndarray) -> list[np.ndarray]:
        """Estimated work of partition ``k`` with threshold -1, 0, 1, ...: values probed and candidates met."""
        low = len(self.groups[k]) // 2
        a, b = value & ((1 << low) - 1), value >> low
        near_a, near_b = self.near[k]
        out, met = [np.zeros(len(value))], np.zeros(len(value))
        for r in range(self.threshold + 1):
            met = met + self.n * sum(near_a[x][a] * near_b[r - x][b] for x in range(r + 1))
            out.append(met + len(self.patterns[k][r]))
        return out

    def thresholds(self, fps: np.ndarray) -> np.ndarray:
        """The cheapest thresholds of each fingerprint whose sum with one added to each is the threshold plus one."""
        units = self.threshold + 1
        best = [np.zeros(len(fps))] + [np.full(len(fps), np.inf)] * units
        picks = []
        for k, group in enumerate(self.groups):
            costs = self.costs(k, values(fps, group))
            now, pick = [], []
            for total in range(units + 1):
                ways = np.stack([best[total - u] + costs[u] for u in range(total + 1)])
                pick.append(ways.argmin(axis=0))
                now.append(ways.min(axis=0))
            best, picks = now, [*picks, np.stack(pick)]
        out, left = np.empty((len(self.groups), len(fps)), np.int64), np.full(len(fps), units)
        for k in reversed(range(len(self.groups))):
            out[k] = picks[k][left, np.arange(len(fps))] - 1
            left = left - out[k] - 1
        return out


def _summed(df: DataFrame, count, size: int) -> np.ndarray:
    """Sums over all fingerprints of ``size`` counters, which ``count`` gives for an array of fingerprints."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            total += count(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["at", "n"])

    got = df.select("fp").coalesce(SUMMERS).mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(size, np.int64)
    out[got["at"].to_numpy()] = got["n"].to_numpy()
    return out


def planned(fps: DataFrame, threshold: int, partitions: int | None = None, crowd: int = 1) -> Plan:
    """The plan for a table of distinct fingerprints; an average bucket may have ``crowd`` times as many. The driver gets some thousand counters, or 262 144 with two partitions."""

    def pairs(x: np.ndarray) -> np.ndarray:
        bits = np.unpackbits(np.ascontiguousarray(x, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
        return np.concatenate([[len(x)], (bits.T @ bits).astype(np.int64).ravel()])

    got = _summed(fps, pairs, 1 + BITS * BITS)
    n, together = int(got[0]), got[1:].reshape(BITS, BITS)
    groups = grouped_bits(together, np.diag(together), n, partitions or partitions_for(-(-n // crowd)))
    halves = [h for g in groups for h in (g[: len(g) // 2], g[len(g) // 2 :])]
    ends = np.cumsum([0, *(1 << len(h) for h in halves)])

    def histograms(x: np.ndarray) -> np.ndarray:
        return np.concatenate([np.bincount(values(x, h), minlength=1 << len(h)) for h in halves])

    flat = _summed(fps, histograms, int(ends[-1]))
    return Plan(groups, [flat[a:b] for a, b in zip(ends, ends[1:], strict=False)], n, threshold)


# --- links ----------------------------------------------------------------------------------------------------------


def _keyed(fps: DataFrame, plan: Plan, probing: bool) -> DataFrame:
    """``key`` (partition and value) and ``fp``: a fingerprint's own values, or all that it probes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.pieces(batches):
            signed = batch.column(0).to_numpy(zero_copy_only=False)
            x = signed.view(np.uint64)
            chosen = plan.thresholds(x) if probing else np.zeros((len(plan.groups), len(x)), np.int64)
            for k, group in enumerate(plan.groups):
                value = values(x, group) | k << 32
                for r in range(plan.threshold + 1):
                    at = np.flatnonzero(chosen[k] == r)
                    step = max(1, 100_000 // len(plan.patterns[k][r]))
                    for i in range(0, len(at), step):
                        some = at[i : i + step]
                        keys = value[some][:, None] ^ plan.patterns[k][r][None, :]
                        columns = [pa.array(keys.ravel()), pa.array(np.repeat(signed[some], keys.shape[1]))]
                        yield pa.RecordBatch.from_arrays(columns, names=["key", "fp"])

    return fps.select("fp").mapInArrow(run, "key long, fp long")


def links(fps: DataFrame, threshold: int = 2, partitions: int | None = None, crowd: int = 1) -> DataFrame:
    """Edges ``a``, ``b`` whose components are those of all pairs of distinct fingerprints within ``threshold`` bits.

    ``partitions`` is what ``partitions_for`` gives, or another number. Buckets may have ``crowd`` times as many
    fingerprints as operator 5 lets them: more pairs are compared, and fewer rows dealt.
    """
    if not 0 <= threshold <= 2:
        raise ValueError("crowded buckets are resolved for thresholds of 0 to 2 only")
    plan = planned(fps, threshold, partitions, crowd)
    own, probes = _keyed(fps, plan, probing=False), _keyed(fps, plan, probing=True)
    crowded = common.cut(own.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > BUCKET * crowd).select("key"))
    none = crowded.isEmpty()
    sparse = (own if none else own.join(crowded, "key", "left_anti")).withColumnRenamed("fp", "b")
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b")))
    pairs = probes.withColumnRenamed("fp", "a").join(sparse, "key").filter((F.col("a") != F.col("b")) & (near <= threshold))
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    if none:
        return pairs
    met = crowded.join(probes.select("key"), "key", "left_semi")
    left = probes.join(met, "key", "left_semi").union(own.join(met, "key", "left_semi")).select("fp").distinct()
    return pairs.union(_crowded_links(left, threshold))


def _crowded_links(fps: DataFrame, threshold: int) -> DataFrame:
    """Links of distinct fingerprints by values one bit away, of which each has 64."""
    flipped = lambda k: F.col("fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), k))
    turned = F.transform(F.sequence(F.lit(0), F.lit(BITS - 1)), flipped)
    if threshold < 2:
        met = fps.select(F.col("fp").alias("a"), F.explode(turned).alias("b")).join(fps.select(F.col("fp").alias("b")), "b", "left_semi")
        return met.filter(F.lit(threshold == 1)).select("a", "b")
    meet = fps.select("fp", F.explode(F.concat(F.array("fp"), turned)).alias("z")).groupBy("z").agg(F.collect_list("fp").alias("all"))
    return meet.filter(F.size("all") > 1).select(F.array_min("all").alias("a"), F.explode("all").alias("b")).filter("a <> b")


def near_duplicates(docs: DataFrame, words: int = 3, threshold: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of the input: its id, ``fingerprint`` in hex and ``component_id``, the smallest id reachable."""
    marked = common.cut(fingerprints(docs, words, id_col, text_col))
    fps = common.cut(marked.groupBy("fp").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")))
    grouped = common.cut(components(links(fps, threshold)).select(F.col("node").alias("fp"), "label"))
    members = grouped.join(fps, "fp")
    smallest = common.cut(members.groupBy("label").agg(F.min("first").alias("component_id"), F.count(F.lit(1)).alias("n")))
    resolved = common.join_hot(grouped, smallest, "label", "n", HOT, ["fp"]).select("fp", "component_id")
    ids = fps.join(resolved, "fp", "left").select("fp", F.coalesce("component_id", "first").alias("component_id"), "n")
    text = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return common.join_hot(marked, ids, "fp", "n", HOT).select(F.col("id").alias(id_col), text.alias("fingerprint"), "component_id")
