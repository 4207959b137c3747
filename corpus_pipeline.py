"""The training-data pipeline: toxicity, near-dedup, secrets, mixing, packing.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame.
All but the last return the columns of documents. Between stages the table is written as Parquet
and read again; what a stage has written for itself is deleted then.

Defined cases, for every stage: a null text is an empty one; very long texts are worked on whole; an
empty table gives an empty one; further columns, whatever their names, pass through all stages but
the last. Rows of one doc_id are scored and scanned each; near-dedup leaves one of them, and all rows
without a doc_id. Rows without a source are a source of their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusloom.llm import mixing, near_dedup, packing, secrets, toxicity
from corpusloom.llm.queries import table, tokenizer_paths
from corpusloom.storage import made, materialize, release


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored 0.5 or more for toxicity go; labels of any row may teach."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates stays (five-word shingles, 0.8)."""
    return near_dedup.drop_near_duplicates(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret found is replaced by a mark; all documents stay."""
    return secrets.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the repetitions that their source's target asks for, all of them whole."""
    return mixing.mixed_documents(docs, cut=False)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their sequences."""
    return packing.pack(docs, *tokenizer_paths())


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("secrets", redact_secrets),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: The first two stages learn and search; SQL can't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), made(spark)
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
        release(spark, before, keep=1)
    return STAGES[-1][1](spark, docs, sf_dir)
