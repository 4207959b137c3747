from pyspark.sql import functions as F

from corpusloom.operators import policy, review as R


def facts(spark, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "case_id int, text string")
    return {r.case_id: r for r in R.extract_facts(df).collect()}


def test_facts(spark):
    f = facts(spark, "我们将客户数据、手机号传输至新加坡用于营销，已取得用户同意，规模100万人", "未取得用户同意。处理一些数据", "", "公司在上海，境内处理汽车数据，提供服务给美国", None)
    assert f[0].data_types == ["客户个人信息", "手机号"] and f[0].overseas_recipient == "新加坡" and f[0].cross_border_transfer and f[0].processing_purpose == "营销"
    assert f[0].legal_basis_or_consent == "用户同意" and f[0].missing_information == []
    assert f[1].legal_basis_or_consent is None and f[1].cross_border_transfer is None
    assert f[2].missing_information == ["legal_basis_or_consent", "processing_purpose", "data_types"]
    assert f[3].region == "上海" and f[3].industry == "汽车" and f[3].cross_border_transfer
    assert f[4].data_types == []


def test_negations_are_of_one_language(spark, tmp_path):
    """A German word of consent behind an English negation, in the queries over facts as in their SQL."""
    import duckdb

    from corpusloom.plans import catalogue

    own = R.Dictionary(consent={"and": "a", "und": "u"}, negations=("not", "no"), unflipped=("und",))
    texts = ["no rund", "no and", "not ab und", "no and, und", "no sand; and", "nor"]
    got = R.extract_facts(spark.createDataFrame(list(enumerate(texts)), "case_id int, text string"), own).orderBy("case_id").collect()
    assert [r.legal_basis_or_consent for r in got] == ["u", None, "u", "u", "a", None]
    turns = [(i, j, role, t) for i, t in enumerate(texts) for j, role in enumerate(("user", "assistant"))] + [(9, 0, "user", "nor"), (9, 1, "assistant", "no bund")]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    for name in ("fact_extraction", "merged_facts", "query_plan", "query_plan_merge", "issue_plan"):
        df, sql = catalogue.queries()[name](spark, str(tmp_path)), con.sql(catalogue.oracle_sql()[name])
        columns = sorted(sql.columns)
        told = lambda names, rows: sorted(tuple(str(r[names.index(c)]) for c in columns) for r in rows)
        assert told(df.columns, df.collect()) == told(sql.columns, sql.fetchall()), name


def test_plan_and_merge(spark):
    df = spark.createDataFrame([(1, "问题")], "case_id int, question string").join(
        R.extract_facts(spark.createDataFrame([(1, "上海自贸区的个人信息出境，汽车行业")], "case_id int, text string")), "case_id"
    )
    words = {"cross_border": "数据出境", "sensitive": "敏感个人信息", "region": "数据出境 负面清单 管理清单 自贸区", "focus_abroad": "数据出境", "focus_home": "数据安全", "industry": "安全管理 合规要求"}
    got = R.plan_queries(df, [(("标准合同",), "x", False, ())], words, ("自贸区",), ("行业",)).orderBy("query_id").collect()
    assert [(r.query_id, r.query_type) for r in got] == [("q_1", "legal_issue"), ("q_2", "material_fact"), ("q_3", "region_condition"), ("q_4", "industry_condition"), ("q_5", "missing_information")]
    plans = spark.createDataFrame([(1, 0, 0, "a", "X  y"), (1, 0, 1, "a", "z"), (1, 1, 0, "a", " x Y ")], "case_id int, plan_pos int, query_pos int, query_type string, text string")
    assert [(r.query_id, r.text) for r in R.merge_plans(plans).orderBy("query_id").collect()] == [("q_1", "X  y"), ("q_2", "z")]


def test_gate_and_risk(spark):
    f = R.extract_facts(spark.createDataFrame([(1, "个人信息出境到美国"), (2, "身份证号用于风控")], "case_id int, text string"))
    schema = "case_id int, citation_role string, can_cite_clause boolean, applicable_region string, subject_words string, title string, text string"
    hits = spark.createDataFrame([(1, "primary_legal_basis", True, "CN", "", "数据出境", "")], schema)
    got = {r.case_id: r for r in R.self_check(f, hits).collect()}
    assert got[1].status == "sufficient" and got[1].issues == ["critical_facts_missing"]
    assert got[2].status == "needs_second_retrieval" and got[2].issues == ["no_primary_legal_basis", "critical_facts_missing"]
    after = R.after_second(R.self_check(f, hits))
    risk = {r.case_id: r.x for r in f.join(after, "case_id").select("case_id", R.risk_level().alias("x")).collect()}
    assert risk == {1: "medium", 2: "insufficient_evidence"}
    plan = sorted(R.second_plan(f, R.self_check(f, hits)).collect(), key=lambda r: int(r.query_id[2:]))
    assert [(r.query_type, r.text, r.top_k) for r in plan][:2] == [("legal_issue", "数据出境安全评估", 20), ("legal_issue", "数据跨境传输", 20)]
    assert plan[-1].text == "身份证号" and plan[-1].query_type == "material_fact" and len(plan) == 11
    other = spark.createDataFrame([(1, ["no_primary_legal_basis", "critical_facts_missing"], "needs_second_retrieval"), (2, ["no_primary_legal_basis", "region_mismatch"], "needs_second_retrieval")], "case_id int, issues array<string>, status string")
    told = {r.case_id: (r.issues, r.status) for r in R.validated_check(other, R.self_check(f, hits)).collect()}
    assert told == {1: (["critical_facts_missing"], "sufficient"), 2: (["no_primary_legal_basis"], "needs_second_retrieval")}


def test_issue_plan_and_selection(spark):
    q = spark.createDataFrame([(1, 1, "q_1", "legal_issue", "a"), (1, 2, "q_2", "missing_information", "b"), (1, 3, "q_3", "material_fact", "c"), (1, 4, "q_4", "region_condition", "d")], "case_id long, query_pos int, query_id string, query_type string, text string")
    plan = R.issue_plan(q)
    got = [(r.issue_id, r.question, r.query_ids, r.priority) for r in plan.orderBy("issue_pos").collect()]
    assert got == [("issue_1", "核心法律问题：a；c", ["q_1", "q_3"], "high"), ("issue_2", "地区适用条件：d", ["q_4"], "medium"), ("issue_3", "关键缺失信息：b", ["q_2"], "medium")]
    hits = spark.createDataFrame([(1, r, 1.0 - r / 10, r, f"s{r % 3}") for r in range(6)], "case_id long, rank int, score double, chunk_id long, source_id string")
    pools = spark.createDataFrame([(1, "issue_1", 0, 0.5, 20, "s0"), (1, "issue_1", 1, 0.9, 21, "s9"), (1, "issue_2", 0, 0.9, 30, "s8"), (1, "issue_3", 0, 0.9, 40, "s7")], "case_id long, issue_id string, rank int, score double, chunk_id long, source_id string")
    pick = lambda k: [r.chunk_id for r in R.select_by_issue(plan, pools, hits, k).orderBy("rank").collect()]
    assert pick(5) == [0, 1, 2, 21, 3] and pick(10) == [0, 1, 2, 21, 3, 4, 5, 20, 30, 40] and pick(2) == [0, 1]


def test_claims(spark):
    texts = spark.createDataFrame([(1, "一。二！三")], "case_id int, text string")
    hits = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (1, 2, "a"), (1, 3, "c"), (1, 4, "d")], "case_id int, rank int, chunk_id string")
    claims = R.rule_claims(texts, hits)
    assert {r.claim: r.support for r in claims.collect()} == {"一。": ["a", "b", "c"], "二！": ["a", "b", "c"], "三": ["a", "b", "c"]}
    ok = R.valid_claims(claims, spark.createDataFrame([(1, "b")], "case_id int, chunk_id string"))
    assert {tuple(r.support) for r in ok.collect()} == {("b",)}


def test_policy(spark):
    df = spark.createDataFrame([("missing_20260702_009",), ("tc260_x",), ("missing_20260702_005",), ("other",)], "s string")
    assert [r[0] for r in df.select(policy.citation_role(F.col("s"))).collect()] == ["primary_legal_basis", "implementation_reference", "conditional_local_basis", "interpretation_auxiliary"]
    bad = policy.violations(spark.createDataFrame([(1, " "), (2, "x"), (3, None)], "id int, t string"), {"blank": F.trim("t") != ""}, "id")
    assert sorted(r.id for r in bad.collect()) == [1, 3]


def test_gated_revisions(spark):
    actions = spark.createDataFrame(
        [(1, 0, "narrow_claim", "i1", "r0", None, []), (1, 1, "add_supported_claim", "i1", "出境评估", "x", ["a"]), (1, 2, "add_supported_claim", "i1", "出境评估", None, ["a", "b"]), (1, 3, "add_supported_claim", "i2", "GDPR 出境", None, ["c"])],
        "case_id int, action_pos int, operation string, issue_id string, reason string, replacement_text string, supporting_chunk_ids array<string>",
    )
    schema = "case_id int, issue_id string, chunk_id string, title string, text string, can_cite_clause boolean"
    hits = spark.createDataFrame([(1, "i1", "a", "出境", "数据出境安全评估 x", True), (1, "i1", "b", "出境", "评估", False), (1, "i2", "c", "出境", "数据出境", True)], schema)
    requests = spark.createDataFrame([(1, 0, "i1", "出境", "评估"), (1, 1, "i2", "出境", "评估"), (1, 2, "i3", "出境", "评估"), (1, 3, "i4", "医疗", "数据")], "case_id int, request_pos int, issue_id string, query string, reason string")
    targeted = spark.createDataFrame([(1, "i3", "d", "t", "数据出境", True), (1, "i4", "e", "t", "数据出境", False)], schema)
    got = [(r.action_pos, r.operation, r.issue_id) for r in R.gated_revisions(actions, requests, hits, targeted).orderBy("action_pos").collect()]
    assert got == [(1, "narrow_claim", "i1"), (2, "add_supported_claim", "i1"), (3, "mark_evidence_gap", "i1"), (4, "mark_evidence_gap", "i2"), (5, "mark_evidence_gap", "i4")]


def test_narrow_plan(spark):
    df = spark.createDataFrame([(1, "材料里的标准合同和自贸区行业", "q", True, ["个人信息"], None, None, "汽车", "上海", ["x"])], "case_id int, text string, question string, cross_border_transfer boolean, data_types array<string>, overseas_recipient string, sensitive_personal_info boolean, industry string, region string, missing_information array<string>")
    words = {"cross_border": "a", "sensitive": "b", "region": "c", "focus_abroad": "d", "focus_home": "e", "industry": "f"}
    plan = lambda narrow: [r.query_type for r in R.plan_queries(df, [(("标准合同",), "x", False, ())], words, ("自贸区",), ("行业",), narrow).orderBy("query_id").collect()]
    assert plan(False) == ["legal_issue", "material_fact", "region_condition", "industry_condition", "legal_issue", "missing_information"]
    assert plan(True) == ["region_condition", "industry_condition", "legal_issue"]


def test_rerank_texts(spark):
    from corpusloom.operators import rank

    df = spark.createDataFrame([("q ", " m" * 600, True, "上海", None, ["a", "b"], ["x", "y"]), ("q", "", None, None, None, [], [])], "question string, text string, cross_border_transfer boolean, region string, industry string, data_types array<string>, queries array<string>")
    one, two = [r[0] for r in df.select(rank.rerank_query()).collect()]
    assert one.startswith("用户问题：q\n业务事实：跨境传输=True；地区=上海；数据类型=a,b\n检索意图：x；y\n材料摘要：m m") and len(one.split("材料摘要：")[1]) == 500
    assert two == "用户问题：q\n业务事实：无明确结构化事实"
    hit = spark.createDataFrame([("t", "r", None, "x" * 2000)], "title string, citation_role string, query_type string, text string").select(rank.rerank_document()).first()[0]
    assert hit.startswith("标题：t\n证据角色：r\n查询类型：unknown\n正文：x") and len(hit) == 1400
