from pyspark.sql import functions as F

from corpusloom.operators import result as R

SCHEMA = "case_id int, cross_border_transfer boolean, sensitive_personal_info boolean, overseas_recipient string, legal_basis_or_consent string, missing_information array<string>, risk_level string, second_pass boolean"


def test_templated_texts(spark):
    rows = [
        (1, True, True, "美国", None, ["data_volume_threshold"], "high", True),
        (2, None, None, None, None, ["overseas_recipient", "x"], "insufficient_evidence", False),
        (3, None, True, None, "同意", [], "medium", False),
        (4, True, None, None, "同意", ["data_types"], "low", False),
        (5, None, None, None, None, [], "low", None),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.case_id: r for r in df.select("case_id", R.conclusion().alias("c"), R.trigger_reasons().alias("t"), R.recommended_actions().alias("a"), R.risk_boundaries().alias("b")).collect()}
    assert got[1].c == "该场景涉及数据出境（境外接收方：美国），存在高风险合规问题，需立即采取整改措施。 注意：关键信息缺失（data_volume_threshold），影响风险判断的准确性。" + R.DISCLAIMER
    assert got[1].t == ["cross_border_transfer", "sensitive_personal_info", "overseas_recipient_identified", "high_risk_triggers", "missing_information"]
    assert len(got[1].a) == 5 and got[1].a[2] == "与境外接收方（美国）签订数据处理协议"
    assert got[2].c == R.UNCLEAR + R.DISCLAIMER and got[2].a == [R.ACTIONS["again"], R.ACTIONS["overseas_recipient"]] and got[2].b[-1] == R.BOUNDARIES["unclear"]
    assert got[3].c == R.SENSITIVE + R.DISCLAIMER and got[3].a == [R.ACTIONS["sensitive"]]
    assert got[4].c == "该场景涉及数据出境，但风险较低。" + R.DISCLAIMER and got[4].a == [] and got[4].b[0] == R.BOUNDARIES["abroad"]
    assert got[5].c == R.LOW + R.DISCLAIMER and got[5].t == [] and got[5].b == [R.BOUNDARIES["clear"]]


def test_markdown_and_phrases(spark):
    texts = ["# A\n## B\n### C\n```py\nx\n```\n**bold** and **odd", "**" + "长" * 60 + "** **短**", "plain", ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(R.sanitized(F.col("t"))).collect()] == ["### A\n### B\n### C\nx\n**bold** and odd", "长" * 60 + " **短**", "plain", ""]
    claims = spark.createDataFrame([("见《甲法》第三条和第四条",), ("第十条",), ("无",)], "t string")
    assert [r[0] for r in claims.select(R.cite_phrase(F.col("t"))).collect()] == ["《甲法》第三条", "第十条", None]


def test_marks():
    report = "依《甲法》**第三条**处理，另见第四条。第三条再说。"
    got = R.with_marks(report, ["甲法 第三条", "第三条", None, "第四条"])
    assert got.index("①") < got.index("处理") and got.index("④") > got.index("第四条") and got.rstrip().endswith("引用说明：③")
    assert got.index("②") > got.index("另见") and R.with_marks("", ["x"]) == "" and R.with_marks("x", []) == "x"


def test_marked_reports_and_rows(spark):
    claims = spark.createDataFrame([(1, 0, "据第三条", ["a"]), (1, 1, "第五条", ["b"])], "case_id int, claim_pos int, claim string, support array<string>")
    chunks = spark.createDataFrame([("a", "甲法 第三条", "第三条"), ("b", None, None)], "chunk_id string, citation_label string, article_no string")
    reports = spark.createDataFrame([(1, "《甲法》第三条与第五条"), (2, "none")], "case_id int, report string")
    got = {r.case_id: r.report for r in R.marked_reports(reports, claims, chunks).collect()}
    assert got[1].count("<sup") == 2 and got[2] == "none"
    cases = spark.createDataFrame([(1, True, None, None, None, [], "medium", False), (2, None, None, None, None, [], "low", False)], SCHEMA)
    cited = spark.createDataFrame([(1, "legal_basis", "a", 0)], "case_id int, usage string, chunk_id string, rank int")
    rows = {r.case_id: r for r in R.review_results(cases, cited, claims).collect()}
    assert [c.claim for c in rows[1].claims] == ["据第三条", "第五条"] and rows[1].citations[0].chunk_id == "a" and rows[2].claims is None
