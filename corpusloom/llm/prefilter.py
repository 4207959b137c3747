"""A bitmap of fixed size in front of a large join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of the bitmap: 2^24 make at most 262,144 words, whatever the number of keys.
BITS = 1 << 24


def may_match(rows: DataFrame, column: str, keys: DataFrame, key: str, bits: int = BITS) -> DataFrame:
    """Rows whose ``column`` may be among ``keys``: all that are, and few others while keys are fewer than bits.

    Only the bitmap is broadcast, and its size has a bound; a join on the keys themselves follows.
    With many more keys than bits it lets everything through, and nothing else changes.
    """
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(bits))
    words = keys.select(place(F.col(key)).alias("_h")).groupBy(F.shiftright("_h", 6).alias("_w")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(_h & 63 as int))")).alias("_bits")
    )
    told = rows.withColumn("_h", place(F.col(column))).withColumn("_w", F.shiftright("_h", 6))
    kept = told.join(F.broadcast(words), "_w").where(F.expr("shiftrightunsigned(_bits, cast(_h & 63 as int)) & 1 = 1"))
    return kept.select(*rows.columns)
