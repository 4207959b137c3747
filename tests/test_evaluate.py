from pyspark.sql import functions as F

from corpusloom.operators import evaluate as E

HITS = [(1, "s1", "a", 0), (1, "s1", "b", 1), (1, "s2", "c", 2), (2, "s9", "d", 0)]
GOLD = [(1, "s1", True), (1, "s2", False), (2, "s3", True)]


def frames(spark):
    return spark.createDataFrame(HITS, "case_id int, source_id string, chunk_id string, rank int"), spark.createDataFrame(GOLD, "case_id int, source_id string, must boolean")


def test_recall_and_mrr(spark):
    h, g = frames(spark)
    assert {r.case_id: r.x for r in E.recall_at(h, g, 2, "x").collect()} == {1: 0.5, 2: 0.0}
    assert {r.case_id: r.x for r in E.recall_at(h, g, 3, "x").collect()} == {1: 1.0, 2: 0.0}
    assert {r.case_id: r.x for r in E.mrr_at(h, g, 10, "x").collect()} == {1: 1.0, 2: 0.0}
    assert {r.case_id: r.missing_sources for r in E.missing_at(h, g, 2).collect()} == {1: ["s2"], 2: ["s3"]}


def test_no_gold_is_null_and_out_of_means(spark):
    h, g = frames(spark)
    cases = spark.createDataFrame([(1, False, 0.5, "low", "m"), (2, False, 0.5, "low", "m"), (3, True, 0.5, "low", "m")], "case_id int, should_abstain boolean, min_recall double, risk_level string, mode string")
    rows = {r.case_id: r for r in E.case_metrics(cases, h, g).collect()}
    assert rows[3].recall_at_5 is None and rows[3].bad_categories == ["abstention_error"]
    assert rows[2].bad_categories == ["retrieval_zero_recall", "candidate_missing"]
    assert rows[1].duplicate_sources_at_10 == 1 and rows[1].bad_categories == []
    mode = E.mode_metrics(E.case_metrics(cases, h, g)).first()
    assert mode.n_cases == 3 and mode.n_graded == 2 and mode.mean_recall_at_5 == 0.5


def test_span_overlap(spark):
    gold = spark.createDataFrame([(1, 7, 20, 40)], "case_id int, doc_id int, g_start int, g_end int")
    w = spark.createDataFrame([(1, 8, 0, 9, 1), (1, 7, 10, 30, 2)], "case_id int, doc_id int, start int, end int, rank int")
    r = E.span_overlap(gold, w).first()
    assert (r.doc_rank, r.span_rank, r.best_overlap, r.doc_hit_at_5) == (2, 2, 0.5, True)


def test_labels_must_make_up_the_gold(spark):
    df = spark.createDataFrame([(1, ["a", "b"], ["a"], ["b"]), (2, ["a", "b"], ["a"], ["a", "b"]), (3, ["a"], [], [])], "case_id int, expected array<string>, must array<string>, optional array<string>")
    assert sorted(r.case_id for r in E.check_labels(df).collect()) == [2, 3]


def test_modes_failures_and_suites(spark):
    cases = spark.createDataFrame([("a", "m"), ("b", "m"), ("c", "n")], "case_id string, mode string")
    names = ["recall_at_3", "recall_at_5", "mrr_at_10", "candidate_recall_at_50", "distinct_source_recall_at_5", "must_have_recall_at_5", "optional_coverage_at_5"]
    schema = "case_id string, mode string, " + ", ".join(f"{n} double" for n in names) + ", duplicate_sources_at_10 long, abstention_correct boolean, is_bad boolean, total_latency_ms double"
    metrics = spark.createDataFrame([("a", "m", *[1.0] * 7, 0, True, False, 10.0), ("b", "m", *[None] * 7, 2, False, True, None)], schema)
    rows = {r["mode"]: r for r in E.mode_metrics(metrics, spark.createDataFrame([("m",), ("x",)], "mode string")).collect()}
    assert rows["m"].mean_recall_at_5 == 1.0 and rows["m"].mean_total_latency_ms == 10.0 and rows["m"].rate_is_bad == 0.5
    assert rows["x"].n_cases == 0 and rows["x"].mean_recall_at_3 == 0.0 and rows["x"].mean_total_latency_ms is None
    failed = spark.createDataFrame([("c", "search", "timeout")], "case_id string, failed_node string, failure_reason string")
    out = {r.case_id: r for r in E.with_failures(metrics, cases, failed).collect()}
    assert out["c"].workflow_outcome == "hard_failure" and out["c"].recall_at_3 is None and out["a"].workflow_outcome == "clean_success"
    assert [r.case_id for r in E.suite(cases, ["c", "a"]).orderBy("place").collect()] == ["c", "a"]
    keys = spark.createDataFrame([("hybrid", "rules", "off"), ("hybrid", "rules", "on")], "a string, b string, c string")
    assert [r[0] for r in keys.select(E.mode_key(F.col("a"), F.col("b"), F.col("c"))).collect()] == ["retrieval=hybrid,review=rules", "retrieval=hybrid,review=rules,rerank=on"]
    try:
        E.suite(cases, ["zz"])
        raise AssertionError
    except KeyError:
        pass
