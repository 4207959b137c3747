"""Readers and writers: JSON lines, CSV manifests, binary files, index rows."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

LISTS = ("topic_tags", "legal_domain", "applicable_subjects", "aliases")
TRUE = ("1", "true", "yes", "y", "是", "include")
UPLOAD_SUFFIXES = (".txt", ".md", ".docx", ".pdf", ".html", ".json")
UPLOAD_LIMIT = 20 * 1024 * 1024


class CorpusError(ValueError):
    """A corpus that is missing, invalid or empty."""


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Rows of a JSON lines file; a missing file is empty, a bad line an error."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def write_jsonl(rows: DataFrame, path: str) -> int:
    """Nulls are left out. Returns the number of rows written."""
    from pyspark.sql import Observation

    seen = Observation()
    rows.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").json(path)
    return seen.get["n"]


def split_list(value: Column) -> Column:
    parts = F.split(F.regexp_replace(F.coalesce(value, F.lit("")), "[；;，,]", ";"), ";")
    return F.filter(F.transform(parts, F.trim), lambda x: x != "")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """A CSV manifest with a header; list columns split, include_in_mvp a boolean, a byte order mark dropped."""
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    raw = raw.toDF(*[c.lstrip("﻿") for c in raw.columns])
    for c in set(LISTS) & set(raw.columns):
        raw = raw.withColumn(c, split_list(F.col(c)))
    if "include_in_mvp" in raw.columns:
        raw = raw.withColumn("include_in_mvp", F.lower(F.trim(F.coalesce("include_in_mvp", F.lit("")))).isin(*TRUE))
    return raw


def write_manifest(rows: DataFrame, path: str) -> None:
    """Every list column joined by semicolons, in schema order."""
    flat = rows.select(*[F.array_join(f.name, ";").alias(f.name) if isinstance(f.dataType, T.ArrayType) else F.col(f.name) for f in rows.schema.fields])
    flat.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def schema_json(schema: T.StructType) -> str:
    return json.dumps(schema.jsonValue(), ensure_ascii=False, indent=2)


def load_corpus(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    if not exists(spark, path):
        raise CorpusError(f"corpus missing: {path}")
    rows = read_jsonl(spark, path, schema)
    try:
        empty = rows.isEmpty()
    except Exception as error:
        raise CorpusError(f"corpus invalid: {path}") from error
    if empty:
        raise CorpusError(f"corpus empty: {path}")
    return rows


def raw_files(spark: SparkSession, folder: str) -> DataFrame:
    """stem, suffix, path, length, sha256, content of every file but sidecars."""
    name = F.element_at(F.split("path", "/"), -1)
    rows = spark.read.format("binaryFile").load(folder).withColumn("name", name).where(~F.endswith("name", F.lit(".meta.json")))
    return rows.select(
        F.regexp_replace("name", r"\.[^.]*$", "").alias("stem"), F.lower(F.regexp_extract("name", r"(\.[^.]*)$", 1)).alias("suffix"), "path", "length", F.sha2("content", 256).alias("sha256"), "modificationTime", "content"
    )


def raw_path(sources: DataFrame, files: DataFrame) -> DataFrame:
    """source_id, path: the file of a source, of the declared suffix if there is one, else the first."""
    both = sources.join(files, sources["source_id"] == files["stem"])
    place = Window.partitionBy("source_id").orderBy(F.desc(F.coalesce(F.col("suffix") == F.col("raw_format"), F.lit(False))), "path")
    return both.withColumn("_n", F.row_number().over(place)).where("_n = 1").select("source_id", "path", "suffix")


def output_suffix(declared: Column, url: Column) -> Column:
    """Declared format, else the URL's suffix, else .txt."""
    own = F.when(F.coalesce(declared, F.lit("")) != "", F.concat(F.lit("."), F.ltrim(declared, F.lit("."))))
    return F.lower(F.coalesce(own, F.nullif(F.regexp_extract(F.regexp_replace(url, r"[?#].*$", ""), r"(\.[A-Za-z0-9]{1,5})$", 1), F.lit("")), F.lit(".txt")))


def usable_uploads(files: DataFrame) -> DataFrame:
    return files.where(F.col("suffix").isin(*UPLOAD_SUFFIXES) & (F.col("length") > 0) & (F.col("length") <= UPLOAD_LIMIT))


def bulk_lines(chunks: DataFrame, index: str) -> DataFrame:
    """An action line and a document line per chunk, one after the other."""
    action = F.to_json(F.struct(F.struct(F.lit(index).alias("_index"), F.col("chunk_id").alias("_id")).alias("index")))
    return chunks.select("chunk_id", F.posexplode(F.array(action, F.to_json(F.struct("*")))).alias("part", "line")).select("line")


def vector_rows(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """Index rows with their embedding, null where there is none."""
    return chunks.join(vectors.select("chunk_id", "embedding"), "chunk_id", "left")


def write_index(rows: DataFrame, path: str, key: str, buckets: int) -> None:
    """A table in ``buckets`` ranges of the key, for reads by key."""
    rows.repartitionByRange(buckets, key).sortWithinPartitions(key).write.mode("overwrite").parquet(path)
