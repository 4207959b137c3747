"""Review cases as tables: created from materials, their traces and results, a folder a table and run."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.text import strip_ws
from corpusloom.operators import review

TABLES = ("cases", "traces", "results")

#: Fixed value: the risk level of a result before there is any evidence.
NO_EVIDENCE = "insufficient_evidence"


class Created(NamedTuple):
    cases: DataFrame
    traces: DataFrame
    results: DataFrame
    rejected: DataFrame


def _id(kind: str, run: str) -> Column:
    """An id that the run and the case make; creating a case again in a run gives the same."""
    return F.concat(F.lit(f"{kind}_"), F.substring(F.sha2(F.concat(F.lit(f"{kind}:{run}:"), F.col("case_id").cast("string")), 256), 1, 12))


def create_cases(materials: DataFrame, run: str, planner, dictionary: review.Dictionary | None = None, created_at: Column | None = None, conclusion: str = "") -> Created:
    """Cases with their facts, traces with their planned queries, and placeholder results, of materials (case_id, question, text).

    ``planner``: facts with question and text to queries, as of plan_queries. Rows with a blank question or text are rejected with a reason.
    """
    blank = lambda c: strip_ws(F.coalesce(F.col(c), F.lit(""))) == ""
    reason = F.when(blank("question"), "question must not be blank").when(blank("text"), "material_text must not be blank")
    judged = materials.withColumn("reason", reason)
    good = judged.where("reason is null").select("case_id", strip_ws(F.col("question")).alias("question"), F.col("text").alias("text"))
    at = created_at if created_at is not None else F.current_timestamp()
    facts = review.extract_facts(good, dictionary).drop("text", "has_volume")
    named = good.join(facts, "case_id").withColumns({"review_case_id": _id("review", run), "trace_id": _id("trace", run), "review_result_id": _id("result", run)})
    fact_columns = [c for c in facts.columns if c != "case_id"]
    told = F.struct(*fact_columns).alias("review_facts")
    plan = planner(named.select("case_id", "question", "text", *fact_columns))
    numbered = F.array_sort(F.collect_list(F.struct(F.substring("query_id", 3, 9).cast("int").alias("pos"), "query_id", "query_type", "text")))
    queries = plan.groupBy("case_id").agg(F.transform(numbered, lambda q: q.dropFields("pos")).alias("queries"))
    cases = named.select("case_id", "review_case_id", at.alias("created_at"), "question", F.col("text").alias("material_text"), told, "trace_id", F.col("review_result_id").alias("latest_result_id"))
    traces = named.join(queries, "case_id", "left").select("case_id", "trace_id", "review_case_id", at.alias("created_at"), F.lit("not_checked").alias("self_check_status"), "queries")
    results = named.select("case_id", "review_result_id", "review_case_id", "trace_id", F.lit(NO_EVIDENCE).alias("risk_level"), F.lit(conclusion).alias("conclusion"), told)
    return Created(cases, traces, results, judged.where("reason is not null").select("case_id", "reason"))


def write_run(created: Created, folder: str, run: str) -> None:
    """The three tables of a run below ``folder``, in place of what the run had before; other runs stay."""
    for name in TABLES:
        rows = getattr(created, name).withColumn("run_id", F.lit(run))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(f"{folder}/{name}")


def read_run(spark: SparkSession, folder: str, name: str, run: str | None = None) -> DataFrame:
    """A table of one run, or of all."""
    rows = spark.read.parquet(f"{folder}/{name}")
    return rows if run is None else rows.where(F.col("run_id") == run)
