"""Document fingerprints: one-permutation MinHash with optimal densification, in SQL functions.

A text's words (lower-cased A-Z, cut at ASCII white space) give shingles of five words; a text
of fewer words is one shingle; a text without words has the empty fingerprint. Every shingle is
hashed once; the hash modulo ``bins`` is its bin and the least hash of a bin its value. An empty
bin takes the value of the first filled bin in a pseudo-random order of its own (optimal
densification). ``bits`` low-order bits of every bin are kept, a hexadecimal digit each.

``likeness`` is the share of equal bins with the bias of chance agreement taken out:
(share - c) / (1 - c) with c = 2^-bits, cut to 0..1. Two empty fingerprints are alike (1), an
empty one and another are not (0).

Defined cases: null text is empty; a very long text is one expression over the whole of it; repeated
rows have fingerprints of their own, equal ones; a null doc_id comes last in the order of ids, rows of
one id are in the order of their texts, and the last row's next is the first; the only row of a table
is its own next; an empty table gives no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BINS = 256
BITS = 4
SHINGLE = 5
#: Draws of the pseudo-random order before the filled bins are ranked for it outright.
DRAWS = 10


def draw(bin_: int, attempt: int, bins: int) -> int:
    """The attempt-th bin of an empty bin's order: a fixed integer hash."""
    x = (bin_ * 0x9E3779B1 + attempt * 0x85EBCA77 + 0x165667B1) & 0xFFFFFFFF
    x ^= x >> 15
    x = (x * 0x2C1B3C6D) & 0xFFFFFFFF
    x ^= x >> 12
    x = (x * 0x297A2D39) & 0xFFFFFFFF
    x ^= x >> 15
    return x % bins


def shingle_hashes(text: Column, n: int = SHINGLE) -> Column:
    """Hashes of all word shingles (with repeats), one expression over the whole text."""
    low = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = F.transform(F.filter(F.split(low, r"[\x20\x09-\x0D]+", -1), lambda w: w != ""), lambda w: F.xxhash64(w))

    def of(ws: Column) -> Column:
        return F.when(
            F.size(ws) >= n,
            F.transform(
                F.slice(ws, F.lit(1), F.size(ws) - (n - 1)),
                lambda w, i: F.xxhash64(w, *[F.get(ws, i + j) for j in range(1, n)]),
            ),
        ).when(F.size(ws) > 0, F.array(F.aggregate(ws, F.lit(0).cast("long"), lambda a, w: F.xxhash64(a, w)))).otherwise(F.array().cast("array<bigint>"))

    return _let(words, of)


def _let(value: Column, body) -> Column:
    """body(value) with the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def fingerprint_bins(text: Column, bins: int = BINS, bits: int = BITS, n: int = SHINGLE) -> Column:
    """Array of ``bins`` small integers, or an empty array."""
    # bin in the leading position, so that the first of each run in ascending order is its least hash
    shift = bins.bit_length() - 1
    spread = F.sort_array(shingle_hashes(text, n))

    def least(hs: Column) -> Column:
        top = lambda h: F.shiftrightunsigned(h, 64 - shift)
        firsts = F.filter(hs, lambda h, i: (i == 0) | (top(h) != top(F.get(hs, i - 1))))
        return F.map_from_arrays(F.transform(firsts, lambda h: top(h).cast("int")), F.transform(firsts, lambda h: F.pmod(h, F.lit(1 << bits)).cast("byte")))

    order = F.array(*[F.array(*[F.lit(draw(i, a, bins)) for a in range(DRAWS)]) for i in range(bins)])

    def dense(m: Column) -> Column:
        keys = F.map_keys(m)
        table = _let(F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda i: F.try_element_at(m, i)), lambda t: F.transform(t, lambda v, i: _fill(v, i, t, keys, m)))
        return F.when(F.size(keys) == 0, F.array().cast("array<tinyint>")).otherwise(table)

    def _fill(v: Column, i: Column, t: Column, keys: Column, m: Column) -> Column:
        draws = F.get(order, i)
        last = F.array_min(F.transform(keys, lambda k: F.struct(F.xxhash64(i, k).alias("h"), k.alias("k"))))["k"]
        return F.coalesce(v, *[F.get(t, F.get(draws, F.lit(a))) for a in range(DRAWS)], F.try_element_at(m, last))

    return _let(_let(spread, least), dense)


def packed(bins: Column) -> Column:
    """The bins as hexadecimal digits, one for each 4 bits kept."""
    digits = F.lit("0123456789abcdef")
    return F.array_join(F.transform(bins, lambda b: F.substring(digits, b.cast("int") + 1, F.lit(1))), "")


def likeness(a: Column, b: Column, bits: int = BITS) -> Column:
    c = 2.0**-bits
    same = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    share = same / F.size(a)
    return (
        F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0))
        .when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0))
        .otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (share - c) / (1 - c))))
    )


def fingerprint(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with ``bins`` and ``fingerprint``; null text is empty; existing columns of those names are replaced."""
    own = fingerprint_bins(F.coalesce(F.col(text), F.lit("")))
    return docs.withColumn("bins", own).withColumn("fingerprint", packed(F.col("bins")))


def with_next(docs: DataFrame, value: Column, parts: int) -> DataFrame:
    """doc_id, v, next_v: each row's value beside that of the next by ascending doc_id, cyclically.

    Rows are dealt by id range: quantiles of doc_id are the range starts (``parts`` numbers, the
    only thing that reaches the driver), each range is ordered in one task, and the first rows of
    a range are sent to the range before as well. Rows of one id are in value order; a null id
    comes last.
    """
    ids = docs.select(F.col("doc_id").cast("long").alias("i")).agg(
        F.percentile_approx("i", F.array(*[F.lit(j / parts) for j in range(parts)]), F.lit(10000)).alias("q"), F.min("i").alias("least")
    )
    row = ids.first()
    starts = sorted({row["least"], *row["q"]}) if row["q"] else []
    place = F.lit(0)
    if len(starts) > 1:
        table = F.array(*[F.lit(s).cast("long") for s in starts])
        halvings = F.array(*[F.lit(1 << h) for h in range(len(starts).bit_length() - 1, -1, -1)])
        # binary search: the last start not above the id; a null id is in the last range
        place = F.aggregate(
            halvings,
            F.lit(0),
            lambda at, h: F.when(F.coalesce(F.get(table, at + h) <= F.col("i"), F.col("i").isNull() & (at + h < len(starts))), at + h).otherwise(at),
        )
    n = max(1, len(starts))
    dealt = docs.select(F.col("doc_id").cast("long").alias("i"), value.alias("v")).withColumn("r", place)
    is_start = F.col("i").isin(*starts) if starts else F.col("i").isNull()
    # the cyclic successor of the last range is the first
    guest = F.when(is_start, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    dealt = dealt.withColumn("g", F.explode(guest)).withColumn("r", F.when(F.col("g") == 1, F.pmod(F.col("r") - 1, F.lit(n))).otherwise(F.col("r")))
    along = Window.partitionBy("r").orderBy("g", F.col("i").asc_nulls_last(), "v")
    return dealt.withColumn("next_v", F.lead("v").over(along)).where("g = 0").select(F.col("i").alias("doc_id"), "v", "next_v")


def edited_pairs(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """Fingerprints of every whole text and of its edited text.

    Edited: the last floor(n / 2) code points replaced by the first as many (or all) of the next
    document. Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next.
    """
    parts = parts or max(2, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))
    own = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    own = own.select("doc_id", F.struct(F.col("text"), fingerprint_bins(F.col("text")).alias("bins")).alias("v"))
    pairs = with_next(own, F.col("v"), parts)
    n = F.length("v.text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("v.text", 1, n - half), F.substring(F.coalesce(F.col("next_v.text"), F.lit("")), F.lit(1), half))
    none = F.array().cast("array<tinyint>")
    pairs = pairs.select(
        "doc_id",
        n.cast("long").alias("n_chars"),
        F.col("v.bins").alias("bins"),
        F.coalesce(F.col("next_v.bins"), none).alias("next_bins"),
        edited.alias("edited"),
    ).withColumn("edited_bins", fingerprint_bins(F.col("edited")))
    return pairs.select(
        "doc_id",
        "n_chars",
        F.sha2(F.encode("edited", "utf-8"), 256).alias("edited_sha256"),
        packed(F.col("bins")).alias("fingerprint"),
        packed(F.col("edited_bins")).alias("edited_fingerprint"),
        likeness(F.col("bins"), F.col("edited_bins")).alias("near_edited"),
        likeness(F.col("bins"), F.col("next_bins")).alias("near_next"),
    )
