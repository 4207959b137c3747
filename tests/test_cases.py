import glob
import hashlib
import json

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import cases, evaluate, retrieve, review
from corpusloom.plans import catalogue
from corpusloom.sources import bulk, connector


def test_cases_of_runs(spark, tmp_path):
    rows = [(1, " 能否出境？ ", "向境外传输个人信息"), (2, "  ", "x"), (3, "q", None), (4, "q", "plain")]
    materials = spark.createDataFrame(rows, "case_id long, question string, text string")
    planner = lambda facts: review.plan_queries(facts, catalogue.TEMPLATES, catalogue.WORDS, ("en",), ("th",))
    made = cases.create_cases(materials, "r1", planner, created_at=F.lit("t"))
    assert {r.case_id: r.reason for r in made.rejected.collect()} == {2: "question must not be blank", 3: "material_text must not be blank"}
    folder = str(tmp_path / "runs")
    cases.write_run(made, folder, "r1")
    cases.write_run(cases.create_cases(materials.where("case_id = 4"), "r2", planner, created_at=F.lit("t")), folder, "r2")
    own = {r.case_id: r for r in cases.read_run(spark, folder, "cases", "r1").collect()}
    assert set(own) == {1, 4} and own[1].question == "能否出境？" and own[1].review_facts.cross_border_transfer is True
    trace = {r.case_id: r for r in cases.read_run(spark, folder, "traces", "r1").collect()}
    assert trace[1].trace_id == own[1].trace_id and trace[1].queries[0].query_type == "legal_issue" and [q.query_id for q in trace[1].queries] == [f"q_{i + 1}" for i in range(len(trace[1].queries))]
    result = {r.case_id: r for r in cases.read_run(spark, folder, "results", "r1").collect()}
    assert result[4].risk_level == "insufficient_evidence" and result[4].review_result_id == own[4].latest_result_id
    before = set(glob.glob(f"{folder}/cases/run_id=r2/*"))
    cases.write_run(made, folder, "r1")
    assert set(glob.glob(f"{folder}/cases/run_id=r2/*")) == before and cases.read_run(spark, folder, "cases").count() == 3


def test_hits_of_index_rows(spark):
    rows = spark.createDataFrame([("q", "c", "d", "s", "t", "x", 1.5, 0, None)], "query_id string, chunk_id string, doc_id string, source_id string, title string, text string, score double, rank int, can_cite_clause boolean")
    r = retrieve.project_hits(rows, "service").first()
    assert (r.citation_role, r.can_cite_clause, r.source_url, r.heading_path, r.article_no, r.retriever) == ("interpretation_auxiliary", False, "", [], None, "service")
    with pytest.raises(ValueError, match="no title"):
        retrieve.project_hits(rows.drop("title"), "service")
    with pytest.raises(Exception, match="no title"):
        retrieve.project_hits(rows.withColumn("title", F.lit(None).cast("string")), "service").collect()


def test_analyst_drafts(spark):
    plan = spark.createDataFrame([(c, f"q_{i + 1}", i, t, x) for c in (1, 2) for i, (t, x) in enumerate([("legal_issue", "甲 A"), ("material_fact", "乙")])], "case_id long, query_id string, query_pos int, query_type string, text string")
    issues = [("i1", ["region_condition"], ["  甲 a ", "new one", "New One", "fourth is not looked at"], "high"), ("i2", ["material_fact", "legal_issue"], ["NEW ONE", ""], "low"), ("i3", [], ["third"], "low"), ("i4", ["x"], [], "low"), ("i5", ["y"], ["never"], "low")]
    drafts = spark.createDataFrame([(1, issues)], "case_id long, issues array<struct<question:string,query_types:array<string>,research_queries:array<string>,priority:string>>")
    queries, planned = review.analysed(plan, drafts)
    got = {r.query_id: (r.query_type, r.text, r.initial) for r in queries.where("case_id = 1").collect()}
    assert got == {"q_1": ("legal_issue", "甲 A", True), "q_2": ("material_fact", "乙", True), "q_3": ("region_condition", "new one", False), "q_4": ("legal_issue", "third", False)}
    own = {r.issue_id: r.query_ids for r in planned.where("case_id = 1").collect()}
    assert own == {"issue_1": ["q_3"], "issue_2": ["q_1", "q_2"], "issue_3": ["q_4"], "issue_4": []}
    assert {r.issue_id for r in planned.where("case_id = 2").collect()} and queries.where("case_id = 2 and not initial").count() == 0


def test_categories_and_arms(spark):
    ids = ["eval_cross_border_1", "automotive_2", "eval_abstain_x", "eval_financial_1", "eval_x_shanghai", "eval_other", "sensitive", "standard_contract_9"]
    got = [r.c for r in spark.createDataFrame([(i,) for i in ids], "i string").select(evaluate.case_category(F.col("i")).alias("c")).collect()]
    assert got == ["cross_border", "automotive", "abstention", "classification", "regional", "other", "sensitive", "standard_contract"]
    modes = spark.createDataFrame([("a", 0.5, float("nan"), None, 1.0, 4, 1, 2), ("b", 1.0, 1.0, 1.0, 1.0, 0, 0, 0)], "mode string, mean_recall_at_3 double, mean_recall_at_5 double, mean_mrr_at_10 double, abstention_accuracy double, n_cases int, n_violations int, n_bad int")
    dims = {(r.mode, r.dimension): r.value for r in evaluate.radar_dimensions(modes).collect()}
    assert dims["a", "r5"] == 0 and dims["a", "mrr"] == 0 and dims["a", "cite"] == 0.75 and dims["a", "good"] == 0.5 and dims["b", "cite"] == 1.0
    rows = spark.createDataFrame([("eval_sensitive_1", "x", 0.5), ("eval_sensitive_1", "y", 1.0), ("eval_sensitive_2", "x", 0.25), ("eval_sensitive_2", "y", None)], "case_id string, mode string, recall double")
    assert [tuple(r) for r in evaluate.compared_arms(rows, "x", "y", ["recall"]).collect()] == [("sensitive", "recall", 1, 0.5, 1.0, 0.5)]


def answer(*rows, code=200):
    return json.dumps({"code": code, "rows": list(rows)}, ensure_ascii=False)


def test_search_answers(spark):
    a = answer({"bbbs": "1", "title": "<em>数据</em>安全法", "flxz": "法律", "sxx": 3, "gbrq": "2021", "zdjgName": "人大"}, {"bbbs": "2", "title": "无关条例", "flxz": "行政法规"}, {"bbbs": "", "title": "数据"})
    b = answer({"bbbs": "2", "title": "办法", "xgzlHighLight": "…出境…", "flxz": "地方性条例", "sxx": 1, "office": "<b>厅</b>"}, {"bbbs": "1", "title": "数据安全法 出境", "flxz": "司法解释", "sxx": 2})
    df = spark.createDataFrame([(0, "数据", a), (1, "出境", b)], "term_pos int, term string, payload string")
    got = {r.source_id: r for r in connector.search_sources(df, "site", "db_", "http://d", "http://l").collect()}
    assert set(got) == {"db_1", "db_2"} and got["db_1"].position == (0, 0) and got["db_1"].topic_tags == ["出境", "数据合规"] and got["db_1"].doc_type == "guideline" and got["db_1"].law_status == "amended"
    assert got["db_2"].authority == "local_regulation" and got["db_2"].issuing_body == "厅" and got["db_2"].law_status == "repealed" and got["db_2"].doc_type == "regulation"
    with pytest.raises(Exception, match="search failed"):
        connector.search_sources(spark.createDataFrame([(0, "t", answer(code=500))], df.schema), "s", "p", "d", "l").collect()
    assert [r[0] for r in spark.createDataFrame([("db_9",)], "s string").select(connector.document_id(F.col("s"), "db_")).collect()] == ["9"]


def test_manifests(spark):
    seeds = spark.createDataFrame([("t", i, f"s{i}", i % 2 == 0) for i in range(5)] + [("u", 0, "x", None)], "topic string, position int, source_id string, include_in_mvp boolean")
    assert [r.source_id for r in connector.seed_manifest(seeds, "t", 2).orderBy("position").collect()] == ["s0", "s1"] and connector.seed_manifest(seeds, "t").count() == 5
    with pytest.raises(ValueError):
        connector.seed_manifest(seeds, "none")
    assert tuple(connector.manifest_totals(seeds).first()) == (6, 3)


def test_bulk_sink(spark, tmp_path):
    folder = str(tmp_path / "out")
    rows = spark.range(100).select(F.concat(F.lit("c"), F.col("id").cast("string")).alias("chunk_id"), F.lit("é\n x").alias("text")).repartition(3)
    bulk.write_bulk(rows, folder, "idx", "chunk_id")
    parts = bulk.committed(spark, folder).collect()
    assert sum(p.rows for p in parts) == 100 and {p.file for p in parts} == {f.rsplit("/", 1)[1] for f in glob.glob(f"{folder}/*.ndjson")}
    for p in parts:
        data = open(f"{folder}/{p.file}", "rb").read()
        assert len(data) == p.bytes and hashlib.sha256(data).hexdigest() == p.sha256
        lines = data.decode().splitlines()
        assert all("_index" in json.loads(x)["index"] for x in lines[::2]) and all(json.loads(y)["chunk_id"] == json.loads(x)["index"]["_id"] for x, y in zip(lines[::2], lines[1::2]))
    assert bulk.read_back(spark, folder).count() == 200
    with open(f"{folder}/{parts[0].file}", "ab") as f:
        f.write(b"x\n")
    with pytest.raises(Exception, match="has changed"):
        bulk.read_back(spark, folder).collect()


def test_an_aborted_job_leaves_no_file(spark, tmp_path):
    folder = str(tmp_path / "out")
    bulk.register(spark)
    bad = spark.range(10).repartition(2).select(F.when(F.col("id") == 7, F.raise_error(F.lit("broken"))).otherwise(F.col("id").cast("string")).alias("line"))
    with pytest.raises(Exception):
        bad.write.format(bulk.NAME).mode("append").save(folder)
    assert glob.glob(f"{folder}/*") == []


def test_bulk_stream(spark, tmp_path):
    bulk.register(spark)
    src, folder = str(tmp_path / "in"), str(tmp_path / "out")
    spark.range(20).select(F.col("id").cast("string").alias("line")).write.parquet(src)
    q = spark.readStream.schema("line string").parquet(src).writeStream.format(bulk.NAME).option("path", folder).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(r.line for r in bulk.read_back(spark, folder).collect()) == sorted(map(str, range(20)))


def test_sidecars(spark):
    files = spark.createDataFrame([("s1", "raw/s1.html", b"abc")], "stem string, path string, content binary")
    src = spark.createDataFrame([("s1", "u", None), ("s2", "v", "w")], "source_id string, source_url string, download_url string")
    got = {r.source_id: r for r in bulk.with_sidecars(files, src).collect()}
    assert got["s1"].sidecar == "raw/s1.html.meta.json" and json.loads(got["s1"].meta) == {"source_id": "s1", "source_url": "u", "sha256": hashlib.sha256(b"abc").hexdigest(), "bytes": 3} and not got["s2"].ok and got["s2"].error
