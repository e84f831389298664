"""Document fingerprints by one-permutation MinHash, with DataFrame functions only.

Shingles of words are hashed once. The high bits of a hash are its bin, and each of the ``BINS`` bins keeps its least
hash. An empty bin takes over the value of another bin by optimal densification: it goes through the bins in an order of
its own, the same for all documents, until it meets one that isn't empty. The order starts with the ``TRIES`` bins
that hashes of the bin's number and the attempt give, and goes on with all bins by a hash of the two bins' numbers; as
that rest covers every bin, the search always ends. A value taken over is hashed anew with the number of its new bin; else the few values of a short document
would agree with those of another in all their bins at once. The low ``LOW`` bits of each value are packed into longs. Two fingerprints agree by chance in one
of ``2 ** LOW`` bins, which the likeness corrects for.

A document's words stay in its row as arrays, so fingerprints need no shuffle.

Defined results: a null text counts as empty; texts without words have the fingerprint of zeros, with likeness 1 to each
other and 0 to all else; a text of fewer words than a shingle is one shingle; repeated rows follow each other in the
order of ids, by text; null ids come last; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirion.functions.arrays import let
from quirion.llm import common

#: Bins of a fingerprint, the bits kept of each, and those of a hash that number its bin.
BINS, LOW = 256, 4
BIN_BITS = BINS.bit_length() - 1
PER_LONG = 64 // LOW
TRIES = 12
#: Bytes of text in a range of ids, about, and ranges at most; beyond, ranges grow.
RANGE_BYTES, RANGES = 64 << 20, 1 << 14
_ONES = sum(1 << (LOW * k) for k in range(PER_LONG))


def _bin(value: Column) -> Column:
    """The bin by the high bits, numbered so that bins ascend as the signed values do."""
    return F.shiftright(value, 64 - BIN_BITS).cast("int") + BINS // 2


def shingles(text: Column, words: int) -> Column:
    """A hash of each run of ``words`` words of the text; empty without words."""

    def runs(h: Column) -> Column:
        return F.transform(
            F.slice(h, 1, F.greatest(F.size(h) - words, F.lit(0)) + 1),
            lambda x, k: F.xxhash64(x, *(F.get(h, k + j) for j in range(1, words))),
        )

    def hashed(bare: Column) -> Column:
        found = F.transform(F.split(bare, common.GAP), lambda w: F.xxhash64(w))
        return F.when(bare != "", let(found, runs)).otherwise(F.array().cast("array<bigint>"))

    return let(F.btrim(text, F.lit(common.GAPS)), hashed)


def bins(text: Column, words: int) -> Column:
    """The least hash of each bin that isn't empty, in the order of bins; empty without words."""

    def firsts(s: Column) -> Column:
        return F.filter(s, lambda x, k: (k == 0) | (_bin(x) != _bin(F.get(s, k - 1))))

    return let(F.sort_array(shingles(text, words)), firsts)


def dense(text: Column, words: int) -> Column:
    """All ``BINS`` values, the empty bins filled; null without words."""
    positions = F.sequence(F.lit(0), F.lit(BINS - 1))
    gap = lambda n: F.array_repeat(F.lit(None).cast("bigint"), n)

    def spread(f: Column) -> Column:
        # From one kept value to the next, as many nulls as there are empty bins between.
        until = lambda k: F.coalesce(_bin(F.get(f, k + 1)), F.lit(BINS))
        filled = F.flatten(F.transform(f, lambda x, k: F.concat(F.array(x), gap(until(k) - _bin(x) - 1))))
        return let(F.concat(gap(_bin(F.get(f, F.lit(0)))), filled), lambda v: fill(f, v))

    def fill(f: Column, v: Column) -> Column:
        attempt = lambda i, t: F.get(v, F.pmod(F.xxhash64(i, F.lit(t)), F.lit(BINS)).cast("int"))
        last = lambda i: F.array_min(F.transform(f, lambda x: F.struct(F.xxhash64(i, _bin(x)).alias("o"), x.alias("x"))))["x"]
        borrowed = lambda i: F.coalesce(*(attempt(i, t) for t in range(1, TRIES + 1)), last(i))
        return F.transform(positions, lambda i: F.coalesce(F.get(v, i), F.xxhash64(borrowed(i), i)))

    return let(bins(text, words), lambda f: F.when(F.size(f) == BINS, f).when(F.size(f) > 0, spread(f)))


def packed(text: Column, words: int = 5) -> Column:
    """The fingerprint: ``BINS * LOW / 64`` longs of low bits; null for a text without words."""

    def pack(d: Column) -> Column:
        low = lambda x: x.bitwiseAND(F.lit((1 << LOW) - 1).cast("bigint"))
        one = lambda w: F.aggregate(F.slice(d, w * PER_LONG + 1, PER_LONG), F.lit(0).cast("bigint"), lambda acc, x: F.shiftleft(acc, LOW).bitwiseOR(low(x)))
        return F.when(d.isNotNull(), F.transform(F.sequence(F.lit(0), F.lit(BINS // PER_LONG - 1)), one))

    return let(dense(text, words), pack)


def written(fingerprint: Column) -> Column:
    """The fingerprint as lower-case hex digits."""
    longs = F.coalesce(fingerprint, F.array_repeat(F.lit(0).cast("bigint"), BINS // PER_LONG))
    return F.lower(F.array_join(F.transform(longs, lambda x: F.lpad(F.hex(x), 16, "0")), ""))


def likeness(a: Column, b: Column) -> Column:
    """The estimated Jaccard likeness of the shingles of two fingerprints, corrected for chance agreement, in 0 to 1."""

    def differing(x: Column, y: Column) -> Column:
        d, step = x.bitwiseXOR(y), 1
        while step < LOW:
            d = d.bitwiseOR(F.shiftrightunsigned(d, step))
            step *= 2
        return F.bit_count(d.bitwiseAND(F.lit(_ONES).cast("bigint")))

    off = F.aggregate(F.zip_with(a, b, differing), F.lit(0), lambda acc, n: acc + n)
    chance = 1 / (1 << LOW)
    value = ((1 - off / F.lit(float(BINS))) - chance) / (1 - chance)
    one_sided = F.when(a.isNull() & b.isNull(), 1.0).when(a.isNull() | b.isNull(), 0.0)
    return F.coalesce(one_sided, F.greatest(F.lit(0.0), value))


def with_next(rows: DataFrame, id_col: str, columns: list[str], size: int = 0) -> DataFrame:
    """Adds ``next_<column>``: the value of the row that follows by descending id; the first row follows the last.

    Rows are dealt into ranges of ids, cut at ids that the table has. The rows of a cut id are the first of their range
    and also close the range before as guests, and those of the largest id close the last range, so no range needs
    another. ``columns[0]`` orders rows of one id. ``size`` is the bytes of the rows, if known: a range has about ``RANGE_BYTES``.
    """
    spark = rows.sparkSession
    parts = min(RANGES, max(2, 3 * int(spark.conf.get("spark.sql.shuffle.partitions")), size // RANGE_BYTES))
    cuts = common.id_bounds(rows, id_col, parts)
    top = rows.agg(F.max(id_col)).first()[0]
    at, ranges = F.col(id_col), common.Ranges(sorted({*cuts, top} - {None}))

    # Range 0 holds the smallest ids and the null ones; an id belongs to the first range whose bound it doesn't exceed.
    def places(own: Column) -> Column:
        place = lambda r, guest: F.struct(r.alias("r"), F.lit(guest).alias("g"))
        last = F.lit(True) if top is None else at == F.lit(top)
        seen = F.when(last, F.array(place(own, False), place(F.lit(0), True))).when(ranges.ends(at), F.array(place(own, False), place(own + 1, True)))
        return seen.otherwise(F.array(place(own, False)))

    dealt = rows.withColumn("__place", F.explode(let(ranges.of(at), places))).withColumns({"__range": F.col("__place.r"), "__guest": F.col("__place.g")}).drop("__place")
    order = Window.partitionBy("__range").orderBy("__guest", F.col(id_col).desc_nulls_last(), columns[0])
    follow = {f"next_{c}": F.lead(c).over(order) for c in columns}
    return dealt.withColumns(follow).filter(~F.col("__guest")).drop("__range", "__guest")


def fingerprint_edits(docs: DataFrame, words: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its fingerprint, that of its edited text, and how like they and the next document's are.

    The edited text keeps the first half of the document and goes on with as many characters of the next one.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text")).withColumn("print", packed(F.col("text"), words))
    size = docs.agg(F.sum(F.octet_length(text_col)).alias("n")).first()["n"] or 0
    rows = with_next(rows, "id", ["text", "print"], size)
    n = F.length("text")
    cut = F.floor(n / 2).cast("int")
    edited = F.concat(F.col("text").substr(F.lit(1), n - cut), F.col("next_text").substr(F.lit(1), cut))
    rows = rows.select("id", n.cast("long").alias("n_chars"), edited.alias("edited"), "print", "next_print")
    rows = rows.withColumn("edited_print", packed(F.col("edited"), words))
    return rows.select(
        F.col("id").alias(id_col),
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        written(F.col("print")).alias("fingerprint"),
        written(F.col("edited_print")).alias("edited_fingerprint"),
        likeness(F.col("print"), F.col("edited_print")).alias("near_edited"),
        likeness(F.col("print"), F.col("next_print")).alias("near_next"),
    )
