"""Stored tables that change: buckets rewritten where touched, an embedding cache, two targets published together, postings with deltas."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.text import tokens
from corpusloom.operators import bounds
from corpusloom.sources.files import exists
from corpusloom.storage import materialize

BUCKET = "_bucket"


class KeyedStore:
    """A Parquet table in buckets of its key, a folder each; an upsert reads and rewrites the buckets that it touches.

    Overwriting is dynamic: Spark stages the new buckets and puts them in place at the commit, so a failed
    upsert leaves the table as it was, and files of other buckets keep their names. One writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, buckets: int = 64) -> None:
        self.spark, self.path, self.key, self.buckets = spark, path, key, buckets

    def placed(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn(BUCKET, F.pmod(F.xxhash64(F.col(self.key)), F.lit(self.buckets)).cast("int"))

    def _write(self, rows: DataFrame) -> None:
        # a task a bucket and not a file for each task and bucket
        dealt = rows.repartition(self.buckets, BUCKET)
        dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(self.path)

    def read(self) -> DataFrame:
        return self.spark.read.parquet(self.path).drop(BUCKET)

    def upsert(self, new: DataFrame) -> list[int]:
        """Rows of ``new`` in place of those of their keys (of rows of one key, one of the greatest); the buckets touched."""
        own = new.columns
        new = materialize(self.placed(new.groupBy(self.key).agg(F.max(F.struct(*own)).alias("_r")).select("_r.*")), "upsert")
        touched = sorted(r[0] for r in new.select(BUCKET).distinct().collect())  # at most as many as buckets
        if not touched:
            return []
        merged = new
        if exists(self.spark, self.path):
            old = self.spark.read.parquet(self.path).where(F.col(BUCKET).isin(touched))
            merged = old.join(new.select(self.key, BUCKET), [self.key, BUCKET], "left_anti").select(*new.columns).unionByName(new)
        self._write(merged)
        return touched

    def delete(self, keys: DataFrame) -> list[int]:
        """Without the rows of ``keys``; a bucket that loses its last row goes."""
        gone = materialize(self.placed(keys.select(self.key).distinct()), "delete")
        touched = sorted(r[0] for r in gone.select(BUCKET).distinct().collect())
        if not touched or not exists(self.spark, self.path):
            return []
        kept = materialize(self.spark.read.parquet(self.path).where(F.col(BUCKET).isin(touched)).join(gone, [self.key, BUCKET], "left_anti"), "kept")
        left = {r[0] for r in kept.select(BUCKET).distinct().collect()}
        self._write(kept)
        for b in set(touched) - left:
            _delete(self.spark, f"{self.path}/{BUCKET}={b}")
        return touched


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def content_key(model: str, text: str):
    """What a vector is filed under: the model and the text itself."""
    return F.sha2(F.concat(F.lit(model), F.lit("\n"), F.col(text)), 256)


def embed_missing(texts: DataFrame, cache: KeyedStore, model: str, embed: Callable[[list[str]], list[list[float]]], dim: int, batch: int = 16) -> int:
    """Embeds the distinct texts (column text) that the cache hasn't, ``batch`` at a time; how many those were.

    The cache holds content_key, model and embedding. A provider that returns another number of vectors, or
    vectors of another length, fails the job, and the cache stays as it was.
    """
    wanted = texts.where("text is not null").select(content_key(model, "text").alias("content_key"), "text").groupBy("content_key").agg(F.first("text").alias("text"))
    if exists(cache.spark, cache.path):
        wanted = wanted.join(cache.read().select("content_key"), "content_key", "left_anti")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for at in range(0, len(rows), batch):
                part = rows.iloc[at : at + batch]
                vectors = embed(part["text"].tolist())
                if len(vectors) != len(part) or any(len(v) != dim for v in vectors):
                    raise RuntimeError(f"{len(part)} texts gave {len(vectors)} vectors, of lengths {sorted({len(v) for v in vectors})}; {dim} components were expected")
                yield pd.DataFrame({"content_key": part["content_key"], "model": model, "embedding": [[float(x) for x in v] for v in vectors]})

    made = materialize(wanted.mapInPandas(run, "content_key string, model string, embedding array<float>"), "embedded")
    cache.upsert(made)
    return made.count()


def cached_vectors(rows: DataFrame, cache: KeyedStore, model: str) -> DataFrame:
    """rows (with a text) and their embedding, null where the cache has none."""
    return rows.withColumn("content_key", content_key(model, "text")).join(cache.read().select("content_key", "embedding"), "content_key", "left").drop("content_key")


def publish(tables: dict[str, DataFrame], root: str, key: str, vectors: tuple[str, str, int] | None = None) -> dict[str, int]:
    """Several targets of one corpus made visible together or not at all; rows of each.

    All are written below a new version's folder, and checked there: equal numbers of rows and of keys, and with
    ``vectors`` (target, column, dim) no vector that is missing or of another length. Then one rename of a
    pointer file shows the version. Readers of ``published`` see the old version until then.
    """
    spark = next(iter(tables.values())).sparkSession
    version = f"v-{uuid.uuid4().hex}"
    counts = {}
    try:
        for name, rows in tables.items():
            rows.write.parquet(f"{root}/{version}/{name}")
            back = spark.read.parquet(f"{root}/{version}/{name}")
            n, keys = back.agg(F.count("*"), F.count_distinct(key)).first()
            counts[name] = n
            if n != keys:
                raise ValueError(f"{name}: {n} rows of {keys} keys")
            if vectors and vectors[0] == name:
                bad = back.where(F.col(vectors[1]).isNull() | (F.size(vectors[1]) != vectors[2])).count()
                if bad:
                    raise ValueError(f"{name}: {bad} vectors are missing or not of {vectors[2]} components")
        if len(set(counts.values())) > 1:
            raise ValueError(f"targets differ in rows: {counts}")
    except BaseException:
        _delete(spark, f"{root}/{version}")
        raise
    _point(spark, root, version)
    return counts


def _point(spark: SparkSession, root: str, version: str) -> None:
    """Write the pointer beside the current one and rename it over."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = lambda name: jvm.org.apache.hadoop.fs.Path(f"{root}/{name}")
    fs = path("").getFileSystem(conf) if root.endswith("/") else jvm.org.apache.hadoop.fs.Path(root).getFileSystem(conf)
    out = fs.create(path(f"CURRENT-{version}"), True)
    out.write(bytearray(version.encode()))
    out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), conf)
    mode = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    mode[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(fs.makeQualified(path(f"CURRENT-{version}")), fs.makeQualified(path("CURRENT")), mode)


def published(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The visible version of a target."""
    version = spark.read.text(f"{root}/CURRENT").first()[0]
    return spark.read.parquet(f"{root}/{version}/{name}")


def health(tables: dict[str, Callable[[], DataFrame]]) -> dict[str, dict[str, object]]:
    """For each target whether it can be read, and its rows or the error."""
    out: dict[str, dict[str, object]] = {}
    for name, read in tables.items():
        try:
            out[name] = {"ok": True, "rows": read().count(), "error": None}
        except Exception as e:  # a probe reports, whatever is wrong
            out[name] = {"ok": False, "rows": None, "error": str(e).split("\n")[0]}
    return out


class Frequencies(NamedTuple):
    """What BM25 is made of: tf (field, token, chunk_id, len, tf), lengths (chunk_id, field, len), df (field, token, df), stats (field, n_docs, all_len)."""

    tf: DataFrame
    lengths: DataFrame
    df: DataFrame
    stats: DataFrame


def frequencies(corpus: DataFrame, fields: dict[str, str]) -> Frequencies:
    listed = bounds.exploded(corpus, fields, tokens).withColumn("len", F.size("t").cast("long"))
    tf = listed.select("chunk_id", "field", "len", F.explode("t").alias("token")).groupBy("field", "token", "chunk_id", "len").agg(F.count("*").alias("tf"))
    tf, lengths = materialize(tf, "term-frequencies"), materialize(listed.select("chunk_id", "field", "len"), "lengths")
    return Frequencies(tf, lengths, materialize(_df(tf), "document-frequencies"), materialize(_stats(lengths), "field-stats"))


def _df(tf: DataFrame) -> DataFrame:
    return tf.groupBy("field", "token").agg(F.count("*").alias("df"))


def _stats(lengths: DataFrame) -> DataFrame:
    return lengths.groupBy("field").agg(F.count("*").alias("n_docs"), F.sum("len").alias("all_len"))


def changed(base: Frequencies, upserts: DataFrame, deleted: DataFrame, fields: dict[str, str]) -> Frequencies:
    """The frequencies after chunks were put in or replaced (upserts: chunk_id and the fields' columns) and others deleted (chunk_id).

    Only the texts of the upserts are tokenised. Rows of replaced and deleted chunks are taken out by their
    ids (tombstones), and df and length sums change by what comes and goes, not by a new count.
    """
    delta = frequencies(upserts, fields)
    gone = materialize(upserts.select("chunk_id").union(deleted.select("chunk_id")).distinct(), "tombstones")
    out_tf, out_len = base.tf.join(gone, "chunk_id", "left_semi"), base.lengths.join(gone, "chunk_id", "left_semi")
    tf = base.tf.join(gone, "chunk_id", "left_anti").unionByName(delta.tf)
    lengths = base.lengths.join(gone, "chunk_id", "left_anti").unionByName(delta.lengths)
    less = _df(out_tf).withColumn("df", -F.col("df"))
    df = base.df.unionByName(delta.df).unionByName(less).groupBy("field", "token").agg(F.sum("df").alias("df")).where("df > 0")
    fewer = _stats(out_len).select("field", (-F.col("n_docs")).alias("n_docs"), (-F.col("all_len")).alias("all_len"))
    stats = base.stats.unionByName(delta.stats).unionByName(fewer).groupBy("field").agg(F.sum("n_docs").alias("n_docs"), F.sum("all_len").alias("all_len"))
    return Frequencies(materialize(tf, "term-frequencies"), materialize(lengths, "lengths"), materialize(df, "document-frequencies"), materialize(stats, "field-stats"))


def bm25_index(own: Frequencies, k1: float = 1.2, b: float = 0.75) -> bounds.Index:
    """The index for searches, of frequencies however they came about."""
    return bounds.index_of(own.tf, own.df, own.stats, k1, b)
