"""Substring dedup by hashing lines and their clauses.

A text is cut into units that cover it: lines, and inside them the runs up to and including ``. , ; : ! ?``, so that
passages which sit inside longer lines are found as well. Units are normalised (lower case, white space as one space) and
those of ``least`` words or more are hashed. The 128-bit digest of a unit is gathered over all documents; its earliest
occurrence, by document and offset, is kept.

Repeated units that follow each other make a passage. A unit carries 16-bit marks of the ``FRINGE`` words on either side
of it. By these, units are joined into a passage only where the words between them repeat what stands beside their
first occurrences, and the words that a passage shares before its first unit and after its last one count as well: parts of
units that begin or end in other surroundings. Passages of ``passage`` words or more are to be removed; with ``passage`` at 0, that is every
repeated unit. A passage is reported from the start of its first unit to the end of its last one, in offsets of the original text.

Digests are counted with partial sums, and rows of digests that many rows share are split for the join, so no
task gets all rows of one. From there on, a task has what one document repeats.

Defined results: a null or empty text has no units. Documents are told apart by id and text: rows of one id with different
texts are different documents, ranked by a hash of the text, and repeated rows are one, of which all keep what the
first keeps. Null ids rank last; an empty table gives an empty result; other columns are ignored or, when texts are
cut, kept.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirion.llm import common

#: Words that a unit needs, words that a passage needs, and words whose marks a unit carries on either side.
LEAST, PASSAGE, FRINGE = 5, 46, 10
#: A digest with over this share of all repeated units is split; so there are at most as many.
HOT = 2000
_UNITS = re.compile(r"[^.,;:!?\n]*[.,;:!?]+|[^.,;:!?\n]+")


def units(text: str, least: int, marks: dict[str, int] | None) -> Iterator[tuple[bytes, int, int, int, int, bytes, bytes]]:
    """(digest, start, end, number of the first word, words, marks of the words before and after) of each unit.

    ``marks`` remembers the marks of words; without it, units have no marks.
    """
    words: list[str] = []
    places = []
    for m in _UNITS.finditer(text):
        found = m[0].lower().split()
        if len(found) >= least:
            places.append((m.start(), m.end(), len(words), len(found)))
        words += found
    for w in set(words) if places and marks is not None else ():
        if w not in marks:
            marks[w] = zlib.crc32(w.encode("utf-8", "surrogatepass")) & 0xFFFF
    line = b"" if marks is None else np.fromiter(map(marks.__getitem__, words), "<u2", len(words)).tobytes() if places else b""
    for start, end, at, n in places:
        digest = xxhash.xxh128_digest(" ".join(words[at : at + n]).encode("utf-8", "surrogatepass"))
        yield digest, start, end, at, n, line[2 * max(0, at - FRINGE) : 2 * at], line[2 * (at + n) : 2 * (at + n + FRINGE)]


def _hash(text: Column | str) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def unit_table(docs: DataFrame, least: int, id_col: str, text_col: str, fringes: bool = True) -> DataFrame:
    given = docs.select(F.col(id_col).alias("id"), _hash(text_col).alias("doc"), F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    kind = given.schema[0].dataType.simpleString()
    names = ["id", "doc", "digest", "start", "end", "word", "n_words", "before", "after"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks: dict[str, int] | None = {} if fringes else None
        for batch in common.pieces(batches):
            at, rows = [], []
            for k, text in enumerate(batch.column(2).to_pylist()):
                found = list(units(text, least, marks))
                rows += found
                at += [k] * len(found)
            if marks and len(marks) > 1_000_000:
                marks.clear()
            digest, *places, before, after = zip(*rows, strict=True) if rows else [[]] * 7
            own = pa.array(at, pa.int64())
            binary = lambda x: pa.array(x, pa.binary())
            columns = [batch.column(0).take(own), batch.column(1).take(own), binary(digest), *(pa.array(p, pa.int32()) for p in places), binary(before), binary(after)]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return given.mapInArrow(run, f"id {kind}, doc long, digest binary, start int, end int, word int, n_words int, before binary, after binary")


def same_words(a: list[bytes], b: list[bytes], backwards: bool) -> np.ndarray:
    """How many marks two fringes share from the unit on."""

    def rows(fringes: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        sizes = np.array([len(f) // 2 for f in fringes], np.int64)
        size = 2 * FRINGE
        flat = b"".join([f.rjust(size, b"\0") if backwards else f.ljust(size, b"\0") for f in fringes])
        marks = np.frombuffer(flat, "<u2").reshape(len(fringes), FRINGE)
        return (marks[:, ::-1] if backwards else marks), sizes

    (x, n), (y, m) = rows(a), rows(b)
    same = np.cumprod(x == y, axis=1).sum(axis=1) if len(x) else np.empty(0, np.int64)
    return np.minimum(same, np.minimum(n, m))


def _shared(found: DataFrame) -> DataFrame:
    """Replaces the fringes of both places by ``same_before`` and ``same_after``."""
    kept = found.drop("before", "after", "first_before", "first_after")
    columns_kept, fringes = kept.columns, ["before", "after", "first_before", "first_after"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            before, after, first_before, first_after = (batch.column(c).to_pylist() for c in fringes)
            counts = [same_words(before, first_before, True), same_words(after, first_after, False)]
            columns = [batch.column(c) for c in columns_kept] + [pa.array(c, pa.int32()) for c in counts]
            yield pa.RecordBatch.from_arrays(columns, names=[*columns_kept, "same_before", "same_after"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
    return found.select(*columns_kept, *fringes).mapInArrow(run, f"{schema}, same_before int, same_after int")


def repeats(docs: DataFrame, least: int = LEAST, passage: int = PASSAGE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``repeated_passages`` with ``doc``, the hash of the document's text."""
    all_units = unit_table(docs, least, id_col, text_col)
    place = F.struct(F.col("id").isNull().alias("last"), "id", "doc", "start")
    groups = unit_table(docs, least, id_col, text_col, fringes=False).groupBy("digest").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)
    firsts = {f"first_{c}": F.col(f"first.{c}") for c in ("id", "doc", "start")}
    groups = common.cut(groups.select("digest", "n", *(c.alias(name) for name, c in firsts.items())))
    spread = ["id", "doc", "start"]
    found = common.join_hot(all_units, groups, "digest", "n", HOT, spread)
    is_first = F.col("id").eqNullSafe(F.col("first_id")) & (F.col("doc") == F.col("first_doc")) & (F.col("start") == F.col("first_start"))
    # Fringes of first occurrences come from the few rows that are left, and not with all units.
    found = common.cut(found.withColumn("is_first", is_first))
    kept = found.filter("is_first").select("digest", F.col("before").alias("first_before"), F.col("after").alias("first_after")).dropDuplicates(["digest"])
    kept = kept.join(groups.select("digest", "n"), "digest")
    found = common.join_hot(found.filter("NOT is_first"), kept, "digest", "n", HOT, spread)
    found = _shared(found.drop("digest", "is_first", "first_doc"))
    # From here on everything is about one document at a time. Repeated rows give a unit once.
    found = found.repartition("id", "doc").dropDuplicates(["id", "doc", "start"])
    order = Window.partitionBy("id", "doc").orderBy("start")
    before = lambda c: F.lag(c).over(order)
    follows = F.col("word") - before(F.col("word") + F.col("n_words")) <= before("same_after") + F.col("same_before")
    found = found.withColumn("__new", (~F.coalesce(follows, F.lit(False))).cast("int")).withColumn("__run", F.sum("__new").over(order))
    head = F.min_by(F.struct("id", "word", "same_before", "first_id", "first_start"), "start").alias("h")
    tail = F.max_by(F.struct(F.col("end"), (F.col("word") + F.col("n_words")).alias("stop"), "same_after"), "start").alias("t")
    runs = found.groupBy("id", "doc", "__run").agg(head, tail, F.min("start").alias("start"), F.count(F.lit(1)).alias("n_units"))
    shared = F.col("t.stop") + F.col("t.same_after") - F.col("h.word") + F.col("h.same_before")
    return runs.filter(shared >= passage).select(
        F.col("id").alias(id_col),
        "doc",
        F.col("start").cast("long").alias("start"),
        F.col("t.end").cast("long").alias("end"),
        (F.col("t.stop") - F.col("h.word")).cast("long").alias("n_words"),
        shared.cast("long").alias("shared_words"),
        F.col("n_units").cast("long").alias("n_units"),
        F.col("h.first_id").alias(f"first_{id_col}"),
        F.col("h.first_start").cast("long").alias("first_start"),
    )


def repeated_passages(docs: DataFrame, least: int = LEAST, passage: int = PASSAGE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each passage to remove: its document, offsets, words, units, and the place of the first that is kept.

    ``n_words`` are the words from ``start`` to ``end``, ``shared_words`` those with what is shared on either side.
    """
    return repeats(docs, least, passage, id_col, text_col).drop("doc")


def without(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the spans; a line that is removed whole goes with its line break."""
    out, at = [], 0
    for a, b in sorted(spans):
        if a < at:
            continue
        out.append(text[at:a])
        whole = (a == 0 or text[a - 1] == "\n") and text[b : b + 1] == "\n"
        at = b + whole
    return "".join([*out, text[at:]])


def remove_repeats(docs: DataFrame, least: int = LEAST, passage: int = PASSAGE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with repeated passages cut out of their texts; rows, columns and texts without repeats stay."""
    spans = repeats(docs, least, passage, id_col, text_col)
    places = F.sort_array(F.collect_list(F.struct("start", "end")))
    spans = spans.groupBy(F.col(id_col).alias("__id"), F.col("doc").alias("__doc")).agg(places.alias("__spans"))
    spans = spans.select("__id", "__doc", F.col("__spans.start").alias("__starts"), F.col("__spans.end").alias("__ends"))
    cut = F.udf(lambda text, starts, ends: text if starts is None else without(text or "", list(zip(starts, ends, strict=True))), "string", useArrow=True)
    joined = docs.join(spans, F.col(id_col).eqNullSafe(F.col("__id")) & (_hash(text_col) == F.col("__doc")), "left")
    return joined.withColumn(text_col, cut(text_col, "__starts", "__ends")).select(*docs.columns)
