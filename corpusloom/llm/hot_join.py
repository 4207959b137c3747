"""A join with a table of sums or decisions by key, when some keys may hold a large share of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot from one row in so many; there are at most as many hot keys.
HOT = 1000


def with_groups(rows: DataFrame, groups: DataFrame, key: str, count: str, total: int, values: list[str]) -> DataFrame:
    """``rows`` with the ``values`` of their key in ``groups`` (a row a key, ``count`` its rows), null where it has none.

    Hot keys hold at least 1 / HOT of ``total`` rows, so there are at most HOT of them, and they are
    broadcast; their rows don't meet in a task. The rows of other keys are joined by shuffle, where no
    key has more than that share; rows that are done go along under keys of their own. Null keys
    equal nothing; give them a key.
    """
    hot = F.col(count) * HOT >= F.lit(total)
    packed = groups.select(F.col(key).alias("_k"), F.struct(*values).alias("_v"), hot.alias("_hot"))
    first = packed.where("_hot").select(F.col("_k").alias("_hk"), F.col("_v").alias("_hv"))
    rest = packed.where("not _hot").select(F.struct(F.col("_k"), F.lit(0).cast("long").alias("_n")).alias("_rk"), F.col("_v").alias("_rv"))
    told = rows.join(F.broadcast(first), F.col(key) == F.col("_hk"), "left")
    spread = F.when(F.col("_hv").isNotNull(), F.monotonically_increasing_id() + 1).otherwise(F.lit(0).cast("long"))
    told = told.withColumn("_rk0", F.struct(F.col(key).alias("_k"), spread.alias("_n")))
    both = told.join(rest, F.col("_rk0") == F.col("_rk"), "left")
    own = [F.coalesce(F.col("_hv")[v], F.col("_rv")[v]).alias(v) for v in values]
    return both.select(*rows.columns, *own)
