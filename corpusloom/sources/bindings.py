"""The driver's tables in the shape that the operators take: corpus, queries, facts, gold."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.text import title_of

#: Roles of the sources src0 to src19, by number modulo 5.
ROLES = ("primary_legal_basis", "conditional_local_basis", "conditional_industry_basis", "implementation_reference", "interpretation_auxiliary")
REGIONS = ("CN", "CN-GD", "CN-GD-SZ", "CN-SH")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as chunks: chunk_id, doc_id, source_id, title, text, label, and metadata derived from ids."""
    number = F.regexp_extract("source", r"(\d+)$", 1)
    n = F.when(number == "", F.lit(0)).otherwise(number.cast("int"))
    role = F.get(F.array(*[F.lit(r) for r in ROLES]), F.pmod(n, F.lit(5)))
    region = F.get(F.array(*[F.lit(r) for r in REGIONS]), F.pmod("doc_id", F.lit(4)).cast("int"))
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("chunk_id"), "doc_id", F.col("source").alias("source_id"), title_of(F.col("text")).alias("title"), "text", F.col("source").alias("label"), "lang",
        role.alias("citation_role"), region.alias("applicable_region"),
        F.when(F.pmod("doc_id", F.lit(7)) == 0, F.lit("repealed")).otherwise("effective").alias("law_status"),
        F.when(F.pmod("doc_id", F.lit(3)) == 0, F.concat(F.lit("art"), F.pmod("doc_id", F.lit(9)).cast("string"))).alias("article_no"),
        F.array(F.col("lang"), F.concat(F.lit("t"), F.pmod("doc_id", F.lit(6)).cast("string"))).alias("topic_tags"),
    )


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def semantic_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus with the columns that semantic overlap reads besides."""
    return corpus(spark, sf_dir).withColumns({
        "legal_domain": F.array("lang"), "applicable_subjects": F.array("applicable_region", "law_status"), "heading_path": F.array("title", "source_id"), "citation_label": F.concat("label", F.lit(" "), F.coalesce("article_no", F.lit(""))),
    })
