"""Token counts by byte-pair merging over a heap and a linked list; no token ids are produced.

The text is cut as the tokenizer file says (special strings first, then the byte-level pattern). In each piece the
symbols form a linked list, and a heap holds the adjacent pairs that have a merge rank; popping the lowest rank merges a
pair and brings in its new neighbours. A piece of ``n`` bytes after ``m`` merges has ``n - m`` tokens.

Defined results: a null text counts as empty (0 bytes, 0 tokens); repeated rows are counted each; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirion.llm import common

#: The byte-level pattern of the tokenizer files. White space is spelled out: it is the Unicode property.
_WS = r"\t\n\x0B\f\r\x20\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
# No two alternatives start alike but for the contractions, so letters, the most frequent, may come first.
PIECES = regex.compile(rf" ?\p{{L}}+|'s|'t|'re|'ve|'m|'ll|'d| ?\p{{N}}+| ?[^{_WS}\p{{L}}\p{{N}}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+")
#: Characters outside these ranges may be letters in one release of Unicode and unassigned in another; texts with such
#: characters are cut by the library itself, so that the pieces agree with it.
UNSETTLED = regex.compile(r"[^\u0000-\u0557\u1E00-\u206F\u20A0-\u20BF\u2100-\u2BFF\u3000-\u9FEF\uAC00-\uD7A3\uFE00-\uFFEF\U0001F300-\U0001F9FF]")
#: Pieces whose counts a worker remembers; forgotten together when full, so memory is bounded and results are the same.
REMEMBERED = 600_000


def byte_alphabet() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = (b for b in range(256) if b not in set(plain))
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


class MergeCounter:
    """Counts the tokens of texts for a byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab = model["vocab"]
        letters = byte_alphabet()
        self.first = [vocab[letters[b]] for b in range(256)]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merges[vocab[a], vocab[b]] = (rank, vocab[a + b])
        special = sorted((x["content"] for x in spec.get("added_tokens", ())), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.path, self.cutter = path, None
        self.known: dict[str, int] = {}

    def pieces(self, text: str) -> list[str]:
        """The pieces of a text without special strings, in which merges happen."""
        if not UNSETTLED.search(text):
            return PIECES.findall(text)
        if self.cutter is None:
            from tokenizers import Tokenizer

            self.cutter = Tokenizer.from_file(self.path).pre_tokenizer
        return [text[a:b] for _, (a, b) in self.cutter.pre_tokenize_str(text)]

    def merged(self, data: bytes) -> int:
        """Tokens of one piece: its bytes less the merges done."""
        n = len(data)
        if n < 2:
            return n
        merges = self.merges
        symbol = [self.first[b] for b in data]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []
        for i in range(n - 1):
            found = merges.get((symbol[i], symbol[i + 1]))
            if found:
                heap.append((found[0], i, symbol[i], symbol[i + 1], found[1]))
        heapq.heapify(heap)
        done = 0
        while heap:
            _, i, left, right, new = heapq.heappop(heap)
            j = after[i] if symbol[i] == left else n
            if j >= n or symbol[j] != right:
                continue  # one of the two has been merged since
            done += 1
            symbol[i], symbol[j] = new, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if found := merges.get((new, symbol[k])):
                    heapq.heappush(heap, (found[0], i, new, symbol[k], found[1]))
            h = before[i]
            if h >= 0 and (found := merges.get((symbol[h], new))):
                heapq.heappush(heap, (found[0], h, symbol[h], new, found[1]))
        return n - done

    def _plain(self, text: str) -> int:
        pieces = self.pieces(text)
        known = self.known
        try:
            return sum(map(known.__getitem__, pieces))
        except KeyError:
            pass
        total = 0
        for p in pieces:
            n = known.get(p)
            if n is None:
                n = self.merged(p.encode("utf-8"))
                if len(p) <= 64:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    known[p] = n
            total += n
        return total

    def count(self, text: str) -> int:
        """Tokens of a whole text; a special string in it is one token."""
        if not self.special or not self.special.search(text):
            return self._plain(text)
        parts = self.special.split(text)
        return len(parts) - 1 + sum(map(self._plain, parts))


@lru_cache(maxsize=2)
def _counter(path: str) -> MergeCounter:
    return MergeCounter(path)


def count_tokens(docs: DataFrame, vocabulary: Callable[[], str], id_col: str = "doc_id", text_col: str = "text", limit: int = 512) -> DataFrame:
    """One row per document: its id, ``n_bytes``, ``n_tokens`` and ``over_limit``.

    ``vocabulary`` gives the file's path where it is called, on each executor. There is no shuffle.
    """
    given = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    id_type = given.schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(vocabulary())
        for batch in common.pieces(batches):
            column = batch.column(1)
            sizes = pa.compute.binary_length(column).cast(pa.int64())
            counts = pa.array([counter.count(t) for t in column.to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), sizes, counts], names=["id", "n_bytes", "n_tokens"])

    counted = given.mapInArrow(run, f"id {id_type}, n_bytes long, n_tokens long")
    return counted.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
