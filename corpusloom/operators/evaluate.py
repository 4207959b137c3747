"""Evaluation of ranked hits against gold sources: recall, reciprocal rank, taxonomy, aggregates.

hits: case_id, source_id, chunk_id, rank (zero-based). gold: case_id, source_id, must (boolean).
cases: case_id, should_abstain, min_recall, risk_level. Metrics of cases without gold are null
and take no part in means.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.storage import materialize


def recall_at(hits: DataFrame, gold: DataFrame, k: int, name: str) -> DataFrame:
    """case_id, name: distinct gold sources among the first k hits over all gold sources."""
    found = hits.where(F.col("rank") < k).select("case_id", "source_id").distinct().withColumn("_hit", F.lit(1))
    return gold.join(found, ["case_id", "source_id"], "left").groupBy("case_id").agg((F.count("_hit") / F.count("*")).alias(name))


def mrr_at(hits: DataFrame, gold: DataFrame, k: int, name: str) -> DataFrame:
    first = hits.where(F.col("rank") < k).join(gold.select("case_id", "source_id"), ["case_id", "source_id"], "left_semi").groupBy("case_id").agg(F.min("rank").alias("_r"))
    return gold.select("case_id").distinct().join(first, "case_id", "left").select("case_id", F.coalesce(1 / (F.col("_r") + 1), F.lit(0.0)).alias(name))


def missing_at(hits: DataFrame, gold: DataFrame, k: int) -> DataFrame:
    gone = gold.join(hits.where(F.col("rank") < k), ["case_id", "source_id"], "left_anti")
    return gone.groupBy("case_id").agg(F.sort_array(F.collect_set("source_id")).alias("missing_sources"))


def first_seen(hits: DataFrame, key: str) -> DataFrame:
    """Hits whose key is new in the case, ranked anew."""
    once = Window.partitionBy("case_id", key).orderBy("rank")
    left = hits.withColumn("_n", F.row_number().over(once)).where("_n = 1").drop("_n")
    return left.withColumn("rank", F.row_number().over(Window.partitionBy("case_id").orderBy("rank")) - 1)


def by_source(hits: DataFrame) -> DataFrame:
    """case_id, source_id, r (best rank), u (best rank when repeated chunks don't count), p (place among the case's sources), n10 (hits among the first ten).

    A case's hits are as many as its search's top-k.
    """
    once = hits.withColumn("_n", F.row_number().over(Window.partitionBy("case_id", "chunk_id").orderBy("rank")))
    counted = F.sum(F.when(F.col("_n") == 1, 1).otherwise(0)).over(Window.partitionBy("case_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    placed = once.withColumn("u", F.when(F.col("_n") == 1, counted - 1))
    grouped = placed.groupBy("case_id", "source_id").agg(F.min("rank").alias("r"), F.min("u").alias("u"), F.count_if(F.col("rank") < 10).alias("n10"))
    return grouped.withColumn("p", F.row_number().over(Window.partitionBy("case_id").orderBy("r", "source_id")) - 1)


def case_metrics(cases: DataFrame, hits: DataFrame, gold: DataFrame) -> DataFrame:
    """One row per case, metrics rounded to 4 places: one join with the gold sources and one pass over it."""
    sources = materialize(by_source(hits), "case-sources")
    met = gold.join(sources, ["case_id", "source_id"], "left")
    share = lambda found, of=F.lit(True): F.try_divide(F.count_if(found & of), F.count_if(of))
    graded = met.groupBy("case_id").agg(
        share(F.col("r") < 3).alias("recall_at_3"),
        share(F.col("r") < 5).alias("recall_at_5"),
        F.coalesce(1 / (F.min(F.when(F.col("r") < 10, F.col("r"))) + 1), F.lit(0.0)).alias("mrr_at_10"),
        share(F.col("u") < 50).alias("candidate_recall_at_50"),
        share(F.col("p") < 5).alias("distinct_source_recall_at_5"),
        share(F.col("r") < 5, F.col("must")).alias("must_have_recall_at_5"),
        share(F.col("r") < 5, ~F.col("must")).alias("optional_coverage_at_5"),
    )
    repeats = sources.groupBy("case_id").agg((F.sum("n10") - F.count_if(F.col("n10") > 0)).alias("duplicate_sources_at_10"))
    out = cases.join(graded, "case_id", "left").join(repeats, "case_id", "left")
    correct = F.when(F.col("should_abstain"), F.col("risk_level") == "insufficient_evidence").otherwise(F.col("risk_level") != "insufficient_evidence")
    out = out.withColumn("abstention_correct", correct).withColumn("bad_categories", taxonomy())
    rounded = ("recall_at_3", "recall_at_5", "mrr_at_10", "candidate_recall_at_50", "distinct_source_recall_at_5", "must_have_recall_at_5", "optional_coverage_at_5")
    out = out.withColumns({c: F.round(c, 4) for c in rounded})
    return out.withColumn("duplicate_sources_at_10", F.coalesce("duplicate_sources_at_10", F.lit(0))).withColumn("is_bad", F.size("bad_categories") > 0)


def taxonomy() -> Column:
    """Bad-case categories from recall, candidates and abstention."""
    graded = F.col("recall_at_5").isNotNull() & ~F.col("should_abstain")
    return F.array_compact(
        F.array(
            F.when(graded & (F.col("recall_at_5") == 0), F.lit("retrieval_zero_recall")).when(graded & (F.col("recall_at_5") < F.col("min_recall")), F.lit("retrieval_low_recall")),
            F.when(graded & (F.col("candidate_recall_at_50") < F.col("min_recall")), F.lit("candidate_missing")),
            F.when(~F.col("abstention_correct"), F.lit("abstention_error")),
        )
    )


def mode_metrics(metrics: DataFrame, modes: DataFrame | None = None) -> DataFrame:
    """Means over the cases that have the metric, rates and counts, per mode; a mode of ``modes`` without a case has zeros.

    Columns total_latency_ms and retrieval_latency_ms, where there are such, give means over the cases that have one.
    """
    mean = lambda c: F.round(F.avg(c), 4).alias(f"mean_{c}")
    rate = lambda c: F.round(F.avg(F.col(c).cast("int")), 4).alias(f"rate_{c}")
    told = metrics.groupBy("mode").agg(
        F.count("*").alias("n_cases"),
        F.count("recall_at_5").alias("n_graded"),
        *[mean(c) for c in ("recall_at_3", "recall_at_5", "mrr_at_10", "candidate_recall_at_50", "distinct_source_recall_at_5", "must_have_recall_at_5", "optional_coverage_at_5", "duplicate_sources_at_10")],
        rate("abstention_correct"),
        rate("is_bad"),
        *[mean(c) for c in ("total_latency_ms", "retrieval_latency_ms") if c in metrics.columns],
    )
    if modes is None:
        return told
    return modes.select("mode").distinct().join(told, "mode", "left").fillna(0, [c for c in told.columns if c != "mode" and "latency" not in c])


def mode_key(retrieval: Column, review: Column, rerank: Column) -> Column:
    """The name of an evaluation mode; rerank is told only where it is on."""
    return F.concat(F.lit("retrieval="), retrieval, F.lit(",review="), review, F.when(rerank == "off", F.lit("")).otherwise(F.concat(F.lit(",rerank="), rerank)))


def with_failures(metrics: DataFrame, cases: DataFrame, failures: DataFrame) -> DataFrame:
    """Metric rows of all cases: those that failed (case_id, failed_node, failure_reason) are rows without metrics, marked as hard failures."""
    failed = cases.join(failures.select("case_id", "failed_node", "failure_reason"), "case_id").withColumn("workflow_outcome", F.lit("hard_failure"))
    good = metrics.join(failures.select("case_id"), "case_id", "left_anti").withColumn("workflow_outcome", F.lit("clean_success"))
    return good.unionByName(failed, allowMissingColumns=True)


def suite(cases: DataFrame, wanted: list[str]) -> DataFrame:
    """The wanted cases with their place in the list; an unknown id is an error."""
    found = cases.sparkSession.createDataFrame(list(enumerate(wanted)), "place int, case_id string").join(cases, "case_id")
    if found.count() != len(wanted):
        raise KeyError("the suite names unknown cases")
    return found


def taxonomy_counts(metrics: DataFrame) -> DataFrame:
    return metrics.select("mode", F.explode("bad_categories").alias("category")).groupBy("mode", "category").agg(F.count("*").alias("n"))


def span_overlap(gold: DataFrame, windows: DataFrame) -> DataFrame:
    """case_id, doc rank, span rank (from 1) and best overlap of ranked windows with the gold span.

    gold: case_id, doc_id, g_start, g_end. windows: case_id, doc_id, start, end, rank (from 1).
    """
    same = windows.join(gold, ["case_id", "doc_id"])
    shared = F.greatest(F.lit(0), F.least("end", "g_end") - F.greatest("start", "g_start"))
    scored = same.withColumn("overlap", shared / (F.col("g_end") - F.col("g_start")))
    best = scored.groupBy("case_id").agg(
        F.min("rank").alias("doc_rank"), F.min(F.when(F.col("overlap") > 0, F.col("rank"))).alias("span_rank"), F.round(F.max("overlap"), 6).alias("best_overlap")
    )
    out = gold.select("case_id").distinct().join(best, "case_id", "left")
    return out.select(
        "case_id", "doc_rank", "span_rank", F.coalesce("best_overlap", F.lit(0.0)).alias("best_overlap"),
        F.coalesce(F.col("doc_rank") <= 5, F.lit(False)).alias("doc_hit_at_5"), F.coalesce(F.col("span_rank") <= 5, F.lit(False)).alias("span_hit_at_5"),
    )


def retrieval_cases(chunks: DataFrame, limit: int = 60) -> DataFrame:
    """Templated questions for the first chunks in corpus order."""
    question = (
        F.when(F.coalesce("citation_label", F.lit("")) != "", F.concat("citation_label", F.lit("规定了什么？")))
        .when(F.coalesce("article_no", F.lit("")) != "", F.concat("title", "article_no", F.lit("规定了什么？")))
        .otherwise(F.concat("title", F.lit("的核心内容是什么？")))
    )
    first = chunks.orderBy("corpus_pos").limit(limit)
    place = F.row_number().over(Window.orderBy("corpus_pos")) - 1
    return first.select(F.format_string("retrieval_%04d", place).alias("case_id"), question.alias("question"), "doc_id", "chunk_id")


def check_labels(gold: DataFrame) -> DataFrame:
    """Cases whose must-have and optional sources overlap or don't make up the expected ones."""
    lists = gold.select("case_id", "expected", "must", "optional")
    overlap = F.arrays_overlap("must", "optional")
    part = (F.size(F.array_except(F.array_union("must", "optional"), "expected")) > 0) | (F.size(F.array_except("expected", F.array_union("must", "optional"))) > 0)
    return lists.where(overlap | part)


def first_per_group(rows: DataFrame, group: str, order: str, n: int) -> DataFrame:
    """The first n rows of each group."""
    place = Window.partitionBy(group).orderBy(order)
    return rows.withColumn("_n", F.row_number().over(place)).where(F.col("_n") <= n).drop("_n")


#: What case ids of a category begin with, or hold.
CATEGORY_STARTS = {"cross_border": "cross_border", "standard_contract": "standard_contract", "automotive": "automotive", "abstain": "abstention", "sensitive": "sensitive", "classification": "classification", "financial": "classification"}
REGIONAL = ("shanghai", "tianjin", "hainan", "beijing", "zhejiang")


def case_category(case_id: Column) -> Column:
    """The category that a case's id names."""
    name = F.regexp_replace(case_id, "^eval_", "")
    starts = [F.when(F.startswith(name, F.lit(s)), F.lit(c)) for s, c in CATEGORY_STARTS.items()]
    return F.coalesce(*starts, F.when(name.rlike("|".join(REGIONAL)), F.lit("regional")), F.lit("other"))


def radar_dimensions(modes: DataFrame) -> DataFrame:
    """mode, dimension, value (0 to 1) of mode metrics (means of recall@3, recall@5, mrr@10 and abstention, n_cases, n_violations, n_bad)."""
    zero = lambda c: F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0))
    free = lambda c: F.when(F.col("n_cases") > 0, 1 - F.col(c) / F.col("n_cases")).otherwise(F.lit(1.0))
    values = {"r3": zero("mean_recall_at_3"), "r5": zero("mean_recall_at_5"), "mrr": zero("mean_mrr_at_10"), "abst": zero("abstention_accuracy"), "cite": free("n_violations"), "good": free("n_bad")}
    return modes.select("mode", F.explode(F.array(*[F.struct(F.lit(k).alias("dimension"), v.alias("value")) for k, v in values.items()])).alias("d")).select("mode", "d.dimension", "d.value")


def compared_arms(rows: DataFrame, base: str, other: str, metrics: list[str]) -> DataFrame:
    """category, metric, n, base, other, change: means by category of the cases that both arms (mode) have with a value."""
    each = rows.withColumn("category", case_category(F.col("case_id"))).select("case_id", "category", "mode", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])).alias("m"))
    each = each.select("case_id", "category", "mode", "m.metric", "m.value").where(F.col("mode").isin(base, other) & F.col("value").isNotNull())
    value = lambda m: F.max(F.when(F.col("mode") == m, F.col("value")))
    both = each.groupBy("case_id", "category", "metric").agg(value(base).alias("base"), value(other).alias("other")).where("base is not null and other is not null")
    return both.groupBy("category", "metric").agg(F.count("*").alias("n"), F.round(F.avg("base"), 4).alias("base"), F.round(F.avg("other"), 4).alias("other"), F.round(F.avg(F.col("other") - F.col("base")), 4).alias("change"))
