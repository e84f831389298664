"""SimHash near-duplicates by a similarity of shingle sets, for filtering.

Whether two texts are alike is decided by the Jaccard similarity of their sets of shingles. Candidates come from operator
5's search over several SimHash fingerprints of a text: that of all its shingles, and ``PARTS`` partitions of 64 bits
each. The shingles are dealt into as many classes by their hash, and a partition's bits are set by the majority of the
``SAMPLE`` shingles of its class that have the least hashes. So the bits of a partition depend on the same few shingles,
and two texts agree in all of them or in few. The search (``simhash.links``) takes the distinct values of all of these:
it groups their correlated bits, gives each its own thresholds by the dynamic programme, probes, and links those within
``NEAR`` bits. Values linked, directly or through others, make a bucket, and each two texts of it are a candidate pair.

So texts that differ in at most ``NEAR`` bits in any of the fingerprints are found, whatever thresholds are chosen. By
the pigeonhole principle these are all texts that differ in less than ``PARTS * (NEAR + 1)`` bits of the partitions. At a
similarity ``s``, two texts agree in no partition with a chance of about ``(1 - s ** SAMPLE) ** PARTS``: at 0.8, one in
580. Neither number depends on how many texts there are, and a text takes one short row for each fingerprint, which the
search takes for three bits' groups and a probe or more of each. Values of different partitions come from different
shingles; where they link by chance, verification parts them.

Pairs are verified only if the 64 bits of operator 5's fingerprint are near enough. Buckets of at most ``SMALL`` texts
give their pairs. In larger ones each text is paired with the text that has most copies. Where a bucket still has several
groups after that, all texts outside its largest group are held against all of the bucket, in blocks of at most about
``BLOCK`` texts on either side, so that a bucket of any size is spread over many tasks and no pair of it is skipped. This last
work grows with the square of a bucket's texts only as far as these are candidates and yet not alike.

Equal texts are one text throughout. Defined results: a null text is like an empty one, and texts without words are
equal; texts of fewer words than a shingle are one shingle; of a group, the smallest id stays (of its equal texts' ids;
null ids last), and repeated rows of it stay once; an empty table gives an empty result; all columns are kept.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirion.llm import common
from quirion.llm.components import components
from quirion.llm.simhash import BITS, fingerprint, links, shingle_hashes
from quirion.llm.token_store import mixed

#: Partitions of a fingerprint, and shingles that set the bits of one.
PARTS, SAMPLE = 16, 5
#: Bits in which linked values differ at most, and how many times operator 5's number of values a bucket of the search may have.
NEAR, CROWD = 2, 64
#: Members up to which a bucket gives all its pairs, and texts on either side of a block of a larger one.
SMALL, BLOCK = 8, 1024
#: A text or bucket with over this share of all rows is split; so there are at most as many.
HOT = 2000


def differing_share(similarity: float) -> float:
    """Share of bits in which SimHash fingerprints of equally large sets differ at a Jaccard similarity."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def most_differing(similarity: float) -> int:
    """Bits in which operator 5's fingerprints of alike sets differ at most: five standard deviations above the mean."""
    near = differing_share(similarity)
    return round(BITS * near + 5 * math.sqrt(BITS * near * (1 - near)))


def partitions(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The partitions' values of sets of distinct ascending hashes, and whether a set has shingles in the class.

    A set without shingles has value 0 in its first partition.
    """
    picked = np.zeros((len(sets), PARTS, SAMPLE), np.uint64)
    valid = np.zeros((len(sets), PARTS, SAMPLE), bool)
    steps = np.arange(SAMPLE)
    for k, h in enumerate(sets):
        if not len(h):
            continue
        kind = (h % np.uint64(PARTS)).astype(np.int64)
        order = np.argsort(kind, kind="stable")
        ends = np.searchsorted(kind[order], np.arange(PARTS + 1))
        at = ends[:-1, None] + steps
        valid[k] = at < ends[1:, None]
        picked[k] = h[order[np.minimum(at, len(h) - 1)]]
    bits = np.unpackbits(mixed(picked, 17).astype("<u8").view(np.uint8).reshape(len(sets), PARTS, SAMPLE, 8), axis=3, bitorder="little")
    counts = (bits * valid[..., None]).sum(axis=2, dtype=np.int64)
    size = valid.sum(axis=2)
    values = np.packbits(2 * counts > size[..., None], axis=2, bitorder="little").view("<u8")[..., 0].astype(np.uint64)
    present = size > 0
    present[:, 0] |= size.sum(axis=1) == 0
    return values, present


def marked(texts: DataFrame, words: int) -> DataFrame:
    """``digest``, ``id``, ``fp`` and ``parts`` (null where a class has no shingle) of texts (``digest``, ``id``, ``text``)."""
    kind = texts.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.pieces(batches):
            sets = [np.unique(shingle_hashes(t, words)) for t in batch.column(2).to_pylist()]
            values, present = partitions(sets)
            flat = pa.array(values.view(np.int64).ravel(), mask=~present.ravel())
            parts = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, PARTS), pa.int32()), flat)
            fps = np.array([fingerprint(s) for s in sets], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps), parts], names=["digest", "id", "fp", "parts"])

    return texts.select("digest", "id", "text").mapInArrow(run, f"digest binary, id {kind}, fp long, parts array<long>")


def alike(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """Whether the Jaccard similarity of two sets, given as distinct hashes, reaches ``similarity``."""
    if min(len(a), len(b)) < similarity * max(len(a), len(b)) - 1:
        return False
    shared = len(np.intersect1d(a, b, assume_unique=True))
    either = len(a) + len(b) - shared
    return not either or shared / either >= similarity


def _runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """The rows of each run of equal values in the first ``keys`` columns of sorted batches."""
    held: list[pa.RecordBatch] = []

    def key(batch: pa.RecordBatch, at: int) -> list:
        return [batch.column(k)[at].as_py() for k in range(keys)]

    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(keys)]
        changes = np.any([c[1:] != c[:-1] for c in columns], axis=0) if batch.num_rows > 1 else np.empty(0, bool)
        ends = [0, *(np.flatnonzero(changes) + 1).tolist(), batch.num_rows]
        for start, end in zip(ends, ends[1:], strict=False):
            if held and key(held[-1], 0) != key(batch, start):
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(start, end - start))
    if held:
        yield pa.Table.from_batches(held)


def _small_pairs(members: DataFrame, most: int) -> DataFrame:
    """Pairs ``a``, ``b`` of the small buckets whose fingerprints are near. A bucket has ``SMALL`` rows at most."""
    dealt = members.filter(F.col("size") <= SMALL).select("key", "node", "fp").repartition("key").sortWithinPartitions("key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: pa.RecordBatch | None = None
        for batch in batches:
            rows = pa.Table.from_batches([last, batch] if last is not None else [batch]).combine_chunks()
            if not rows.num_rows:
                continue
            key, fp = rows.column("key").to_numpy(), rows.column("fp").to_numpy().view(np.uint64)
            # Rows of the last bucket are kept for the next batch; pairs among those already kept were given.
            fresh = last.num_rows if last is not None else 0
            a, b = [], []
            for step in range(1, SMALL):
                j = np.arange(max(fresh, step), len(key))
                i = j - step
                near = (key[i] == key[j]) & (np.bitwise_count(fp[i] ^ fp[j]) <= most)
                a.append(i[near])
                b.append(j[near])
            node = rows.column("node").combine_chunks()
            a, b = (node.take(pa.array(np.concatenate(x))) for x in (a, b))
            yield pa.RecordBatch.from_arrays([a, b], names=["a", "b"])
            keep = int(np.searchsorted(key, key[-1]))
            last = rows.slice(keep).to_batches()[0]

    return dealt.mapInArrow(run, "a binary, b binary")


def linked(fps: np.ndarray, sets: list[np.ndarray], labels: list, queries: np.ndarray, most: int, similarity: float) -> list[tuple[int, int]]:
    """Edges between groups: of each query with the rows of other labels that are alike, until the labels are joined."""
    names: dict = {}
    label = np.array([names.setdefault(x, len(names)) for x in labels])
    edges = []
    for i in queries.tolist():
        far = np.bitwise_count(fps ^ fps[i])
        near = np.flatnonzero((far <= most) & (label != label[i]))
        for j in near[np.argsort(far[near], kind="stable")].tolist():
            if label[i] != label[j] and alike(sets[i], sets[j], similarity):
                label[label == label[j]] = label[i]
                edges.append((i, j))
    return edges


def _between_groups(members: DataFrame, labels: DataFrame, sets: DataFrame, most: int, similarity: float) -> DataFrame:
    """Pairs of labels ``a``, ``b`` that verified pairs of the large buckets join.

    A pair of different labels has a text outside the largest group; these texts are the queries.
    """
    large = members.filter(F.col("size") > SMALL).select("key", "node", "fp").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    large = common.cut(large)
    groups = large.groupBy("key", "label").agg(F.count(F.lit(1)).alias("n"))
    buckets = groups.groupBy("key").agg(F.max_by("label", F.struct("n", "label")).alias("major"), F.count(F.lit(1)).alias("kinds"), F.sum("n").alias("n"), (F.sum("n") - F.max("n")).alias("minor"))
    open_ = buckets.filter("kinds > 1")
    blocks = lambda n: F.ceil(F.col(n) / BLOCK).cast("int")
    open_ = open_.select("key", "major", blocks("n").alias("rows"), blocks("minor").alias("cols"), "n")
    open_ = common.cut(open_)
    # A text is in PARTS buckets at most, so only the first join meets hot keys.
    with_sets = common.join_hot(large, open_, "key", "n", HOT, ["node"]).join(sets, "node")
    own = lambda salt, of: F.pmod(F.xxhash64("node", F.lit(salt)), F.col(of)).cast("int")
    every = lambda of: F.sequence(F.lit(0), F.col(of) - 1)
    place = lambda row, col, query: F.struct(row.alias("r"), col.alias("c"), F.lit(query).alias("q"))
    as_member = F.transform(every("cols"), lambda c: place(own(1, "rows"), c, False))
    as_query = F.transform(every("rows"), lambda r: place(r, own(2, "cols"), True))
    none = F.array().cast("array<struct<r:int,c:int,q:boolean>>")
    places: Column = F.concat(as_member, F.when(F.col("label") != F.col("major"), as_query).otherwise(none))
    dealt = with_sets.withColumn("__at", F.explode(places)).select("key", F.col("__at.r").alias("r"), F.col("__at.c").alias("c"), F.col("__at.q").alias("q"), "fp", "label", "set")
    dealt = dealt.repartition("key", "r", "c").sortWithinPartitions("key", "r", "c")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _runs(batches, 3):
            label = block.column("label").to_pylist()
            fps = block.column("fp").to_numpy().view(np.uint64)
            lists = block.column("set").combine_chunks()
            flat, ends = lists.values.to_numpy(), lists.offsets.to_numpy()
            own_sets = [flat[a:b] for a, b in zip(ends, ends[1:], strict=False)]
            queries = np.flatnonzero(block.column("q").to_numpy())
            found = linked(fps, own_sets, label, queries, most, similarity)
            yield pa.RecordBatch.from_arrays([pa.array([label[i] for i, _ in found], pa.binary()), pa.array([label[j] for _, j in found], pa.binary())], names=["a", "b"])

    return dealt.mapInArrow(run, "a binary, b binary")


def _sets(own: DataFrame, texts: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """``node`` and ``set`` (its distinct hashes) of the wanted nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.pieces(batches):
            sets = [np.unique(shingle_hashes(t, words)) for t in batch.column(1).to_pylist()]
            ends = np.cumsum([0, *map(len, sets)])
            flat = np.concatenate([np.empty(0, np.uint64), *sets]).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))], names=["node", "set"])

    some = common.cut(texts.select("node", "first", "n").join(wanted, "node", "left_semi"))
    rows = common.join_hot(own.withColumnRenamed("digest", "node"), some, "node", "n", HOT, ["id"]).filter(F.col("id").eqNullSafe(F.col("first")))
    return rows.dropDuplicates(["node"]).select("node", "text").mapInArrow(run, "node binary, set array<long>")


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Pairs whose sets are alike. A text that leads a large bucket is in many pairs; such joins are split as they run."""
    sides = pairs
    for end in ("a", "b"):
        sides = sides.join(sets.select(F.col("node").alias(end), F.col("set").alias(f"set_{end}")), end)

    shared = F.size(F.array_intersect("set_a", "set_b"))
    either = F.size("set_a") + F.size("set_b") - shared
    return sides.filter((either == 0) | (shared / F.nullif(either, F.lit(0)) >= similarity)).select("a", "b")


def gathered(keyed: DataFrame) -> DataFrame:
    """The members ``key``, ``node``, ``fp`` of the buckets of values (``value``, ``node``, ``fp``, ``copies``), with their bucket's ``size``, ``lead`` and ``lead_fp``.

    A bucket holds all values that operator 5's links join. Values without links that one text has are left out.
    """
    values = common.cut(keyed.select(F.col("value").alias("fp")).distinct())
    joined = components(links(values, NEAR, crowd=CROWD)).select(F.col("node").alias("value"), F.col("label").alias("key"))
    held = keyed.groupBy("value").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("copies", "node", "fp")).alias("top"))
    held = common.cut(held.join(joined, "value", "left").filter("n > 1 OR key IS NOT NULL").withColumn("key", F.coalesce("key", "value")))
    buckets = held.groupBy("key").agg(F.sum("n").alias("size"), F.max("top").alias("top"), F.count(F.lit(1)).alias("values"))
    buckets = common.cut(buckets.select("key", "size", F.col("top.node").alias("lead"), F.col("top.fp").alias("lead_fp"), "values"))
    of_value = common.cut(common.join_hot(held.select("value", "key", "n"), buckets, "key", "values", HOT, ["value"]))
    return common.join_hot(keyed.drop("copies"), of_value, "value", "n", HOT, ["node"]).drop("value")


def groups(own: DataFrame, similarity: float, words: int) -> tuple[DataFrame, DataFrame]:
    """The distinct texts (``node``, ``first``, ``n``) of rows (``digest``, ``id``, ``text``), and ``node`` and ``label`` of those in groups."""
    most = most_differing(similarity)
    # Fingerprints are made where the texts are; what moves is a row of some hundred bytes.
    found = marked(own, words).groupBy(F.col("digest").alias("node"))
    texts = common.cut(found.agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"), F.first("fp").alias("fp"), F.first("parts").alias("parts")))
    values = F.array_distinct(F.concat(F.array("fp"), F.array_compact("parts")))
    members = common.cut(gathered(texts.select("node", "fp", F.col("n").alias("copies"), F.explode(values).alias("value"))))
    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("lead_fp"))) <= most
    leads = members.filter((F.col("size") > SMALL) & (F.col("node") != F.col("lead")) & near).select(F.least("lead", "node").alias("a"), F.greatest("lead", "node").alias("b"))
    small = _small_pairs(members, most).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    pairs = common.cut(small.union(leads).filter("a <> b").distinct())
    sets = common.cut(_sets(own, texts, members.select("node").distinct(), words))
    labels = common.cut(components(_verified(pairs, sets, similarity)))
    tops = components(_between_groups(members, labels, sets, most, similarity))
    tops = tops.select(F.col("node").alias("label"), F.col("label").alias("top"))
    every = members.select("node").distinct().join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    return texts, every.join(tops, "label", "left").select("node", F.coalesce("top", "label").alias("label"))


def keep_one(docs: DataFrame, similarity: float = 0.8, words: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of the first document of each group of near-duplicates, unchanged."""
    digest = F.unhex(F.md5(F.coalesce(F.col(text_col), F.lit(""))))
    own = docs.select(digest.alias("digest"), F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    texts, grouped = groups(own, similarity, words)
    place = F.struct(F.col("first").isNull().alias("last"), F.col("first").alias("first"), F.col("node").alias("node"))
    of_group = texts.select("node", "first").join(grouped, "node", "left").withColumn("label", F.coalesce("label", "node"))
    kept = of_group.groupBy("label").agg(F.min(place).alias("m")).select(F.col("m.node").alias("__d"), F.col("m.first").alias("__first"))
    rows = docs.withColumn("__digest", digest).join(kept, (F.col("__digest") == F.col("__d")) & F.col(id_col).eqNullSafe(F.col("__first")), "left_semi")
    return rows.dropDuplicates(["__digest", id_col]).drop("__digest")
