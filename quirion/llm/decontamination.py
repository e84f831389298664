"""Benchmark decontamination: n-gram seeds, and Smith-Waterman alignment of what they bring together.

Every run of ``SEED`` words of a benchmark item is a seed, however many documents have it or lack it: an edited copy may
keep any of the item's runs. Where a document has a seed, the words around it, as far as an alignment that reaches the
score can go, are aligned with the item's words; the score is the best local alignment (match 2, mismatch -1, gap -1) as
a share of a full match, so that edited and paraphrased copies score by what they keep. A copy of which no ``SEED``
words in a row are left isn't found, whatever its score. Windows with too few of the item's words are not aligned.

The benchmark is taken in blocks of at most ``BLOCK`` words, each small enough to send to the executors, and all
documents are searched for each block. Documents stay where they are: there is no shuffle of texts.

Items of fewer than ``SEED`` words are their own seeds, and items of fewer than ``SHORT`` words match in full only.

Defined results: a null text or item has no words and matches nothing; repeated documents and items are reported each; empty tables give an
empty result; other columns are ignored or, when filtering, kept.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirion.llm import common

SEED = 3
SHORT = 8
#: Benchmark words that are searched for in one go.
BLOCK = 1_000_000
_WORDS = re.compile(r"\w+")
MATCH, OTHER = 2, -1


def folded(text: str | None) -> str:
    """The text in lower case, each character at the place that it had."""
    text = text or ""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def words_of(text: str | None) -> list[str]:
    return _WORDS.findall(folded(text))


class Items:
    """Benchmark items by the ids of their words, and the positions of their runs of ``SEED`` words."""

    def __init__(self, items: pa.Table):
        self.names = items.column(0).combine_chunks()
        vocabulary: dict[str, int] = {}
        self.words = [np.array([vocabulary.setdefault(w, len(vocabulary)) for w in words_of(text)], np.int64) for text in items.column(1).to_pylist()]
        self.ids = vocabulary
        self.base = max(1, len(vocabulary))
        # For each length of seeds: the runs, where each one's places start, and the places: items and positions.
        self.seeds: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
        for length in sorted({min(len(w), SEED) for w in self.words if len(w)}):
            own = [k for k, w in enumerate(self.words) if min(len(w), SEED) == length]
            codes = [self._codes(self.words[k], length) for k in own]
            flat = np.concatenate(codes)
            order = np.argsort(flat, kind="stable")
            item = np.repeat(np.array(own), [len(c) for c in codes])[order]
            at = np.concatenate([np.arange(len(c)) for c in codes])[order]
            runs, starts = np.unique(flat[order], return_index=True)
            self.seeds[length] = runs, np.r_[starts, len(flat)], item, at

    def _codes(self, ids: np.ndarray, length: int) -> np.ndarray:
        """A number for each run of ``length`` ids; -1 where a word isn't in the benchmark."""
        n = len(ids) - length + 1
        if n <= 0:
            return np.empty(0, np.int64)
        code, known = np.zeros(n, np.int64), np.ones(n, bool)
        for k in range(length):
            part = ids[k : k + n]
            code = code * self.base + part
            known &= part >= 0
        return np.where(known, code, -1)

    def of(self, text: str | None) -> np.ndarray:
        words = words_of(text)
        return np.fromiter(map(self.ids.get, words, repeat(-1)), np.int64, len(words))

    def hits(self, ids: np.ndarray) -> Iterator[tuple[int, int]]:
        """Items, and where they would start in a document, by each seed that the document has."""
        for length, (runs, starts, item, place) in self.seeds.items():
            code = self._codes(ids, length)
            at = np.flatnonzero(code >= 0)
            if not len(at):
                continue
            found = np.minimum(np.searchsorted(runs, code[at]), len(runs) - 1)
            real = runs[found] == code[at]
            for p, r in zip(at[real].tolist(), found[real].tolist(), strict=True):
                a, b = starts[r], starts[r + 1]
                yield from zip(item[a:b].tolist(), (p - place[a:b]).tolist(), strict=True)


def aligned(item: np.ndarray, window: np.ndarray) -> tuple[int, int]:
    """Score of the best local alignment, and the position in the window after its last word.

    A row at a time: gaps along the window are resolved for the whole row by a running maximum.
    """
    steps = np.arange(len(window) + 1)
    row, best, end = np.zeros(len(window) + 1, np.int64), 0, 0
    for word in item:
        new = np.zeros_like(row)
        new[1:] = np.maximum(row[:-1] + np.where(window == word, MATCH, OTHER), row[1:] + OTHER)
        new = np.maximum(new, 0)
        row = np.maximum.accumulate(new - steps * OTHER) + steps * OTHER
        k = int(row.argmax())
        if row[k] > best:
            best, end = int(row[k]), k
    return best, end


class Search:
    """Finds items in documents by their seeds."""

    def __init__(self, items: Items, least: float):
        self.items, self.least = items, least

    def leaks(self, text: str | None) -> list[tuple[int, float, int, int]]:
        """(item, score, first word, after the last word) of the best alignment of each item that reaches the score."""
        ids = self.items.of(text)
        shifts: dict[int, list[int]] = defaultdict(list)
        for k, start in self.items.hits(ids):
            shifts[k].append(start)
        found = []
        for k, starts in shifts.items():
            item = self.items.words[k]
            n, full = len(item), MATCH * len(item)
            need = full if n < SHORT else self.least * full
            # What an alignment may lose and still reach the score is the most words that it can skip in the document.
            wide = int(full - need)
            starts = sorted(set(starts))
            groups = np.split(np.array(starts), np.flatnonzero(np.diff(starts) > n // 2) + 1)
            best = (0, 0, 0)
            for g in groups:
                a, b = max(0, int(g[0]) - wide), min(len(ids), int(g[-1]) + n + wide)
                window = ids[a:b]
                # No alignment matches more words than the two have in common.
                common = np.minimum(np.bincount(item, minlength=self.items.base), np.bincount(window[window >= 0], minlength=self.items.base)).sum()
                if MATCH * common < max(need, best[0] + 1):
                    continue
                score, end = aligned(item, window)
                if score >= need and score > best[0]:
                    _, back = aligned(item[::-1], window[:end][::-1])
                    best = (score, a + end - back, a + end)
            if best[0]:
                found.append((k, best[0] / full, best[1], best[2]))
        return found


def _blocks(benchmark: DataFrame, item_col: str, text_col: str) -> Iterator[pa.Table]:
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(r"\w+")), F.lit(0))
    total = benchmark.agg(F.sum(size).alias("n")).first()["n"] or 0
    n = -(-total // BLOCK)
    for k in range(n):
        block = benchmark.filter(F.pmod(F.xxhash64(item_col, text_col), F.lit(n)) == k)
        yield block.select(item_col, text_col).toArrow()


def _searches(benchmark: DataFrame, least: float, item_col: str, text_col: str) -> Iterator[Broadcast]:
    for block in _blocks(benchmark, item_col, text_col):
        items = Items(block)
        if items.seeds:
            # The driver keeps no block: it is written out, and each worker reads it once.
            yield benchmark.sparkSession.sparkContext.broadcast(Search(items, least))


def find_leaks(docs: DataFrame, benchmark: DataFrame, least: float = 0.5, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """A row for each document and item that it holds: ids, ``score``, and the ``start`` and ``end`` of the passage.

    Offsets are code points, the end exclusive; an item's best passage in a document is given.
    """
    id_type = docs.select(id_col).schema[0].dataType.simpleString()
    item_type = benchmark.select(item_col).schema[0].dataType.simpleString()
    schema = f"id {id_type}, item {item_type}, score double, start long, end long"
    found = docs.sparkSession.createDataFrame([], schema)
    for search in _searches(benchmark, least, item_col, text_col):

        def run(batches: Iterator[pa.RecordBatch], search: Broadcast = search) -> Iterator[pa.RecordBatch]:
            for batch in common.pieces(batches):
                rows: list[tuple] = []
                at: list[int] = []
                for k, text in enumerate(batch.column(1).to_pylist()):
                    leaks = search.value.leaks(text)
                    if leaks:
                        spans = [m.span() for m in _WORDS.finditer(folded(text))]
                        rows += [(i, score, spans[a][0], spans[b - 1][1]) for i, score, a, b in leaks]
                        at += [k] * len(leaks)
                columns = list(zip(*rows, strict=True)) or [[], [], [], []]
                ids = batch.column(0).take(pa.array(at, pa.int64()))
                names = search.value.items.names.take(pa.array(columns[0], pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, names, pa.array(columns[1], pa.float64()), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.int64())], names=["id", "item", "score", "start", "end"])

        found = found.union(docs.select(id_col, text_col).mapInArrow(run, schema))
    return found.withColumnsRenamed({"id": id_col, "item": item_col})


def decontaminate(docs: DataFrame, benchmark: DataFrame, least: float = 0.5, text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """The rows of documents that hold no benchmark item, unchanged."""
    kept = docs
    place = docs.columns.index(text_col)
    for search in _searches(benchmark, least, item_col, text_col):

        def run(batches: Iterator[pa.RecordBatch], search: Broadcast = search) -> Iterator[pa.RecordBatch]:
            for batch in common.pieces(batches):
                yield batch.filter(pa.array([not search.value.leaks(t) for t in batch.column(place).to_pylist()], pa.bool_()))

        kept = kept.mapInArrow(run, docs.schema)
    return kept
