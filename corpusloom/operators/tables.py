"""Keyed tables: latest per key, first seen, upsert, replace, load-or-build, mirrored checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last row of each key; ``order`` ends in a unique column."""
    place = Window.partitionBy(key).orderBy(*[F.desc(c) for c in order])
    return rows.withColumn("_n", F.row_number().over(place)).where("_n = 1").drop("_n")


def first_seen(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    place = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(place)).where("_n = 1").drop("_n")


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of ``new`` in place of those of its keys."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def upsert_vectors(old: DataFrame, new: DataFrame, key: str, vector: str, dim: int) -> DataFrame:
    """As upsert; a missing vector or one of another length is an error."""
    ok = F.col(vector).isNotNull() & (F.size(vector) == dim)
    checked = new.withColumn(vector, F.when(F.assert_true(ok, F.lit(f"{vector} must have {dim} components")).isNull(), F.col(vector)))
    return upsert(old, checked, key)


def replace_one(rows: DataFrame, key: str, row: DataFrame) -> DataFrame:
    return upsert(rows, row, key)


def load_or_build(wanted: DataFrame, loaded: DataFrame, key: str, build) -> DataFrame:
    """Loaded rows, and those of ``build`` for the keys that are not there yet."""
    return loaded.unionByName(build(wanted.join(loaded.select(key), key, "left_anti")))


def one_or_fail(rows: DataFrame, condition: Column, what: str) -> DataFrame:
    found = rows.where(condition)
    if found.isEmpty():
        raise KeyError(f"{what} not found")
    return found


def among(rows: DataFrame, named: DataFrame, key: str) -> DataFrame:
    """The rows whose key another table names, looked out before anything is made of their texts."""
    return rows.join(named.select(key).distinct(), key, "left_semi")
