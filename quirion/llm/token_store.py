"""Token ids in binary shards, with a minimal perfect hash index for access by key.

Documents are dealt into shards by ranges of ids with about equal bytes of text, a task each, and encoded in the order of ids. A shard is two files: ``.ids`` holds
the ids of its documents one after another, little-endian, in two bytes each if the vocabulary allows and else four;
``.idx`` is the index. The index maps a key (a document's id, and its number among the rows of that id) to a slot by a
minimal perfect hash: in each level keys are hashed into a bit array of twice their number, those that are alone in
their bit are done, and the rest go on to the next level; a key's slot is the rank of its bit. A slot stores a
fingerprint of its key, by which keys that the shard doesn't hold are told, and the place of its ids. A lookup takes a
few probes, whatever the size of the shard. Should two keys of a shard have the same hash, all are hashed anew with another seed.

    .idx: 8 bytes mark, then as <q: width, seed, keys, levels; for each level its bits; the bit arrays; a running count of set
    bits for each 64-bit word; the fingerprints (<u4), starts and lengths (<u8) by slot

Files go to the folder that driver and executors share, under a temporary name first, so a task that runs twice leaves
the same files as one that runs once.

Defined results: a null text counts as empty and gets the end id only; null ids come first; rows of one id follow each
other by text and are numbered; an empty table gives no shards; other columns are ignored.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirion.llm import common
from quirion.llm.token_counts import MergeCounter, byte_alphabet

MARK = b"QUIRTOK2"
#: Bytes of text in a shard, about, and shards at most; beyond, shards grow.
SHARD_BYTES, SHARDS = 16 << 20, 1 << 14
LEVELS, SEEDS = 40, 100
#: Pieces whose ids a worker remembers, at some 200 bytes each; forgotten together when full.
REMEMBERED = 1_200_000


# --- the index ------------------------------------------------------------------------------------------------------


def mixed(x: np.ndarray, seed: int) -> np.ndarray:
    """A hash of 64-bit numbers that never maps two of them to one."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & (1 << 64) - 1)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def key_hashes(ids: np.ndarray, numbers: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each key; those of number 0 are distinct for distinct ids."""
    return mixed(ids.astype(np.int64).view(np.uint64), 1) ^ np.where(numbers == 0, np.uint64(0), mixed(numbers.astype(np.uint64), 200 + seed))


class Index:
    """The minimal perfect hash of a shard, and what its slots store."""

    def __init__(self, bits: list[np.ndarray], fingerprints: np.ndarray, starts: np.ndarray, lengths: np.ndarray, seed: int = 0):
        self.seed = seed
        self.sizes = [64 * len(b) for b in bits]
        self.words = np.concatenate(bits) if bits else np.empty(0, np.uint64)
        self.offsets = np.cumsum([0, *(len(b) for b in bits)])
        ones = np.bitwise_count(self.words).astype(np.int64)
        self.ranks = np.cumsum(ones) - ones
        self.fingerprints, self.starts, self.lengths = fingerprints, starts, lengths

    @staticmethod
    def of_keys(ids: np.ndarray, numbers: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> Index:
        """The index of distinct keys, with the first seed that gives them distinct hashes."""
        for seed in range(SEEDS):
            hashes = key_hashes(ids, numbers, seed)
            if len(np.unique(hashes)) == len(hashes):
                return Index.build(hashes, starts, lengths, seed)
        raise ValueError("the keys of a shard aren't distinct")

    @staticmethod
    def build(hashes: np.ndarray, starts: np.ndarray, lengths: np.ndarray, seed: int = 0) -> Index:
        bits, left = [], hashes
        for level in range(LEVELS):
            if not len(left):
                break
            words = max(1, -(-2 * len(left) // 64))
            at = mixed(left, 10 + level) % np.uint64(64 * words)
            alone = np.bincount(at.astype(np.int64), minlength=64 * words) == 1
            bits.append(np.packbits(alone, bitorder="little").view("<u8").astype(np.uint64))
            left = left[~alone[at.astype(np.int64)]]
        if len(left):
            raise ValueError("two keys of a shard have the same hash")
        index = Index(bits, *(np.zeros(len(hashes), t) for t in (np.uint32, np.int64, np.int64)), seed)
        slots = index.slots(hashes)
        index.fingerprints[slots] = mixed(hashes, 3).astype(np.uint32)
        index.starts[slots], index.lengths[slots] = starts, lengths
        return index

    def slots(self, hashes: np.ndarray) -> np.ndarray:
        """The slot of each key; -1 where no level has its bit. A key that isn't held may get any slot."""
        out, open_ = np.full(len(hashes), -1, np.int64), np.arange(len(hashes))
        for level, size in enumerate(self.sizes):
            at = mixed(hashes[open_], 10 + level) % np.uint64(size)
            word = self.offsets[level] + (at >> np.uint64(6)).astype(np.int64)
            bit = at & np.uint64(63)
            hit = (self.words[word] >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(self.words[word] & ((np.uint64(1) << bit) - np.uint64(1)))
            out[open_[hit]] = (self.ranks[word] + below)[hit]
            open_ = open_[~hit]
        return out

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and length of each key's ids; length -1 if the shard doesn't hold the key."""
        slots = self.slots(hashes)
        held = slots >= 0
        if len(self.fingerprints):
            held &= self.fingerprints[slots] == mixed(hashes, 3).astype(np.uint32)
            return np.where(held, self.starts[slots], 0), np.where(held, self.lengths[slots], -1)
        return np.zeros(len(hashes), np.int64), np.full(len(hashes), -1, np.int64)

    def to_bytes(self, width: int) -> bytes:
        head = struct.pack(f"<{4 + len(self.sizes)}q", width, self.seed, len(self.fingerprints), len(self.sizes), *self.sizes)
        parts = ((self.words, "<u8"), (self.ranks, "<u8"), (self.fingerprints, "<u4"), (self.starts, "<u8"), (self.lengths, "<u8"))
        return b"".join([MARK, head, *(p.astype(t).tobytes() for p, t in parts)])

    @staticmethod
    def from_bytes(data: bytes) -> tuple[Index, int]:
        if data[:8] != MARK:
            raise ValueError("not an index of token ids")
        width, seed, keys, levels = struct.unpack_from("<4q", data, 8)
        sizes = struct.unpack_from(f"<{levels}q", data, 40)
        at = 40 + 8 * levels

        def take(n: int, kind: str) -> np.ndarray:
            nonlocal at
            part = np.frombuffer(data, kind, n, at)
            at += part.nbytes
            return part

        bits = [take(s // 64, "<u8").astype(np.uint64) for s in sizes]
        take(sum(sizes) // 64, "<u8")
        return Index(bits, take(keys, "<u4"), take(keys, "<u8").astype(np.int64), take(keys, "<u8").astype(np.int64), seed), width


# --- encoding -------------------------------------------------------------------------------------------------------


class Encoder:
    """Ids of whole texts as bytes.

    The library's model encodes each distinct piece of the text once and what it gave is remembered: merges never cross
    pieces, so a text's ids are those of its pieces. Texts with special strings are encoded by the library whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.cutter = MergeCounter(path)
        self.kind = np.dtype("<u2" if self.library.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4")
        self.code = "H" if self.kind.itemsize == 2 else "I"
        self.model, self.letters = self.library.model, byte_alphabet()
        self.known: dict[str, bytes] = {}

    def _library(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, self.kind).tobytes()

    def encode(self, text: str) -> bytes:
        if self.cutter.special and self.cutter.special.search(text):
            return self._library(text)
        pieces, known = self.cutter.pieces(text), self.known
        parts = list(map(known.get, pieces))
        if None not in parts:
            return b"".join(parts)
        if len(known) + len(pieces) > REMEMBERED:
            known.clear()
        for p in pieces:
            if p not in known:
                tokens = self.model.tokenize(p.encode("utf-8").decode("latin-1").translate(self.letters))
                known[p] = struct.pack(f"<{len(tokens)}{self.code}", *[t.id for t in tokens])
        return b"".join(map(known.__getitem__, pieces))


@lru_cache(maxsize=2)
def _encoder(path: str) -> Encoder:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one thread a task
    return Encoder(path)


# --- shards ---------------------------------------------------------------------------------------------------------


def _write(where: fs.FileSystem, path: str, parts: Iterator[bytes]) -> None:
    part = f"{path}.{uuid.uuid4().hex}"
    with where.open_output_stream(part) as out:
        for p in parts:
            out.write(p)
    where.move(part, path)


def _opened(folder: str) -> tuple[fs.FileSystem, str]:
    """A folder by its URI; a path without a scheme, or with one slash after it, is local."""
    if "://" not in folder:
        folder = "file://" + folder.removeprefix("file:")
    return fs.FileSystem.from_uri(folder)


class Store:
    """Shards that have been written: their folder, the ids at which they are cut, and where each starts."""

    def __init__(self, spark: SparkSession, folder: str, cuts: list[int], starts: list[int]):
        self.spark, self.folder, self.cuts, self.starts = spark, folder, cuts, starts

    def shard_of(self, id_col: str) -> F.Column:
        """The shard of an id: that of the first cut that it doesn't exceed. Null ids are in the first."""
        return common.Ranges(self.cuts).of(F.col(id_col))

    def dealt(self, rows: DataFrame) -> DataFrame:
        """Rows with an ``id``, a shard to a task, in the order of ids."""
        return rows.withColumn("shard", self.shard_of("id")).repartitionById(len(self.cuts) + 1, F.col("shard")).sortWithinPartitions("shard", F.asc_nulls_first("id"), "text")

    def remove(self) -> None:
        common.remove(self.spark, self.folder)


def _cuts(docs: DataFrame, id_col: str, text_col: str, least_shards: int) -> list[int]:
    """Ids that cut the documents into shards of about ``SHARD_BYTES``, made of ranges of about equal row counts."""
    size = docs.agg(F.sum(F.octet_length(text_col)).alias("n")).first()["n"] or 0
    shards = min(SHARDS, max(1, least_shards, -(-size // SHARD_BYTES)))
    bounds = common.id_bounds(docs, id_col, min(SHARDS, 4 * shards))
    sizes = docs.groupBy(common.Ranges(bounds).of(F.col(id_col)).alias("r")).agg(F.sum(F.coalesce(F.octet_length(text_col), F.lit(0)) + 1).alias("n"))
    held = {r["r"]: r["n"] for r in sizes.collect()}  # a row a range
    share, cuts, filled = sum(held.values()) / shards, [], 0
    for k, bound in enumerate(bounds):
        filled += held.get(k, 0)
        if filled and filled + held.get(k + 1, 0) / 2 > share:
            cuts.append(bound)
            filled = 0
    return cuts


def write_store(docs: DataFrame, vocabulary: Callable[[], str], end: int | None, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None) -> Store:
    """Encodes the documents into shards. ``end`` is an id that follows each document, if given."""
    spark = docs.sparkSession
    folder = folder or common.new_path(spark, "tokens")
    store = Store(spark, folder, _cuts(docs, id_col, text_col, 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))), [])
    where, path = _opened(folder)
    where.create_dir(path, recursive=True)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = store.dealt(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(vocabulary())
        stop = np.array([] if end is None else [end], encoder.kind).tobytes()
        where, path = _opened(folder)
        for shard, parts in _by_shard(batches):
            name = f"{path}/{shard:06d}"
            ids: list[np.ndarray] = []
            lengths: list[int] = []

            def payload(parts=parts, ids=ids, lengths=lengths) -> Iterator[bytes]:
                for part in parts:
                    column = part.column(0)
                    ids.append(column.fill_null(0).to_numpy(zero_copy_only=False))
                    nulls.append(column.is_null().to_numpy(zero_copy_only=False))
                    data = [encoder.encode(t) + stop for t in part.column(1).to_pylist()]
                    lengths.extend(len(d) // encoder.kind.itemsize for d in data)
                    yield b"".join(data)

            nulls: list[np.ndarray] = []
            _write(where, f"{name}.ids", payload())
            sizes = np.array(lengths, np.int64)
            starts = np.cumsum(sizes) - sizes
            index = Index.of_keys(*numbered(np.concatenate(ids), np.concatenate(nulls)), starts, sizes)
            _write(where, f"{name}.idx", iter([index.to_bytes(encoder.kind.itemsize)]))
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([int(sizes.sum())], pa.int64())], names=["shard", "n"])

    made = rows.mapInArrow(run, "shard int, n long").collect()  # a row a shard
    counts = np.zeros(len(store.cuts) + 1, np.int64)
    for r in made:
        counts[r["shard"]] = r["n"]
    store.starts = (np.cumsum(counts) - counts).tolist()
    return store


def _by_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Iterator[pa.RecordBatch]]]:
    """The runs of equal shards in sorted batches, each as parts that are read once, in order."""
    waiting: list[pa.RecordBatch] = []

    def next_part() -> pa.RecordBatch | None:
        while not waiting:
            batch = next(batches, None)
            if batch is None:
                return None
            if batch.num_rows:
                shard = batch.column(2).to_numpy(zero_copy_only=False)
                edges = [0, *(np.flatnonzero(np.diff(shard)) + 1).tolist(), len(shard)]
                waiting.extend(batch.slice(a, b - a) for a, b in zip(edges, edges[1:], strict=False))
        return waiting.pop(0)

    part = next_part()
    while part is not None:
        shard = part.column(2)[0].as_py()

        def parts() -> Iterator[pa.RecordBatch]:
            nonlocal part
            while part is not None and part.column(2)[0].as_py() == shard:  # noqa: B023
                yield part
                part = next_part()

        yield shard, parts()


def numbered(ids: np.ndarray, nulls: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of sorted rows: ids, and numbers from 0 among the rows of an id. Null ids are numbered from -1 down."""
    if not len(ids):
        return ids, ids
    first = np.ones(len(ids), bool)
    first[1:] = (ids[1:] != ids[:-1]) | (nulls[1:] != nulls[:-1])
    run = np.maximum.accumulate(np.where(first, np.arange(len(ids)), 0))
    number = np.arange(len(ids)) - run
    return ids, np.where(nulls, -1 - number, number)


def read_store(store: Store, keys: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """For each row of ``keys``, from the files: its id, ``start`` over all shards, ``n_tokens`` and ``ids_crc32``.

    The checksum is that of the ids as little-endian 32-bit numbers. Rows of one id get its documents one by one.
    Keys that the store doesn't hold raise an error.
    """
    folder, starts = store.folder, store.starts
    kind = keys.select(id_col).schema[0].dataType.simpleString()
    rows = store.dealt(keys.select(F.col(id_col).cast("long").alias("id"), F.lit("").alias("text")))

    def look_up(shard: int, column: pa.Array) -> pa.RecordBatch:
        where, path = _opened(folder)
        if where.get_file_info(f"{path}/{shard:06d}.idx").type == fs.FileType.NotFound:
            raise KeyError(f"shard {shard} doesn't hold {len(column)} of the keys")
        with where.open_input_file(f"{path}/{shard:06d}.idx") as f:
            index, width = Index.from_bytes(f.read())
        nulls = column.is_null().to_numpy(zero_copy_only=False)
        ids = column.fill_null(0).to_numpy(zero_copy_only=False)
        at, sizes = index.find(key_hashes(*numbered(ids, nulls), index.seed))
        if (sizes < 0).any():
            raise KeyError(f"shard {shard} doesn't hold {(sizes < 0).sum()} of the keys")
        sums = np.empty(len(ids), np.int64)
        with where.open_input_file(f"{path}/{shard:06d}.ids") as f:
            for k in np.argsort(at, kind="stable"):
                data = f.read_at(int(sizes[k]) * width, int(at[k]) * width)
                sums[k] = zlib.crc32(np.frombuffer(data, f"<u{width}").astype("<u4").tobytes())
        return pa.RecordBatch.from_arrays([column, pa.array(at + starts[shard]), pa.array(sizes), pa.array(sums)], names=["id", "start", "n_tokens", "ids_crc32"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, parts in _by_shard(batches):
            yield look_up(shard, pa.concat_arrays([part.column(0) for part in parts]))

    found = rows.mapInArrow(run, "id long, start long, n_tokens long, ids_crc32 long")
    return found.select(F.col("id").cast(kind).alias(id_col), "start", "n_tokens", "ids_crc32")
