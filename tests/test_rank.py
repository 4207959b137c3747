from pyspark.sql import functions as F

from corpusloom.operators import rank


def hits(spark, rows):
    return spark.createDataFrame(rows, "case_id int, list_id int, chunk_id string, source_id string, score double")


def test_rrf_is_zero_based_and_ranks_anew(spark):
    rows = [(1, 0, "a", "s", 0.9), (1, 0, "b", "s", 0.95), (1, 0, "c", "s", 0.3), (1, 1, "b", "s", 0.8), (1, 1, "a", "s", 0.4), (1, 1, "d", "s", 0.3)]
    got = [(r.chunk_id, r.score) for r in rank.rrf(hits(spark, rows), 10).orderBy("rank").collect()]
    assert got == [("b", round(2 / 60, 6)), ("a", round(2 / 61, 6)), ("c", round(1 / 62, 6)), ("d", round(1 / 62, 6))]


def test_merge_keeps_the_first_query_on_ties(spark):
    df = spark.createDataFrame([(1, 0, "a", 1.0), (1, 1, "a", 1.0), (1, 1, "b", 2.0)], "case_id int, query_pos int, chunk_id string, score double")
    got = [(r.chunk_id, r.query_pos, r["rank"]) for r in rank.merge_queries(df, 5).orderBy("rank").collect()]
    assert got == [("b", 1, 0), ("a", 0, 1)]


def test_source_fuse_skips_near_duplicates(spark):
    h = spark.createDataFrame(
        [(1, "a1", "A", 0.03, 0, "x"), (1, "a2", "A", 0.029, 1, "x"), (1, "b1", "B", 0.02, 2, "x")], "case_id int, chunk_id string, source_id string, score double, rank int, query_type string"
    )
    schema = "chunk_id string, tokens array<string>, chunk_index int, article_no string, prev_chunk_id string, next_chunk_id string"
    far = spark.createDataFrame([("a1", ["p", "q"], 0, "", None, None), ("a2", ["r"], 5, "", None, None), ("b1", ["s"], 0, "", None, None)], schema)
    score = lambda chunks: {r.source_id: r.score for r in rank.source_fuse(h, chunks, 5).collect()}
    assert score(far) == {"A": round(0.03 + 0.029 * 0.35, 6), "B": 0.02}
    assert score(far.withColumn("tokens", F.array(F.lit("p"))))["A"] == 0.03
    changed = lambda column, value, which: far.withColumn(column, F.when(F.col("chunk_id") == which, F.lit(value)).otherwise(F.col(column)))
    near = round(0.03 + 0.029 * 0.45, 6)
    assert score(changed("chunk_index", 1, "a2"))["A"] == near
    assert score(far.withColumn("article_no", F.lit("1")))["A"] == near
    assert score(changed("next_chunk_id", "a2", "a1"))["A"] == score(changed("prev_chunk_id", "a1", "a2"))["A"] == near


def test_boosts(spark):
    schema = "citation_role string, primary_like boolean, mentions string, applicable_region string, subject_words string, query_type string, cross_border boolean, region string, industry string"
    rows = [
        ("primary_legal_basis", True, "跨境", "CN", "", "legal_issue", True, None, None),
        ("implementation_reference", True, "", "CN", "", "missing_information", False, None, None),
        ("implementation_reference", False, "", "CN", "", "missing_information", False, None, None),
        ("conditional_local_basis", False, "", "CN-GD", "", "legal_issue", False, "广东省", None),
        ("conditional_local_basis", False, "", "CN-SH", "", "legal_issue", False, "广东", None),
        ("conditional_local_basis", False, "", "CN-SH", "", "legal_issue", False, "全国", None),
        ("conditional_industry_basis", False, "", "CN", "汽车", None, False, None, "车联网"),
        ("conditional_industry_basis", False, "", "CN", "金融", None, False, None, "汽车"),
        ("conditional_industry_basis", False, "", "CN", "金融", None, False, None, " None "),
        ("interpretation_auxiliary", False, "", "CN", "", None, False, None, None),
    ]
    got = [round(r[0], 6) for r in spark.createDataFrame(rows, schema).select(rank.boost_factor()).collect()]
    assert got == [1.5, 0.966, 0.805, 1.5, 0.45, 1.0, 1.4, 0.75, 1.0, 0.85]
    facts = spark.createDataFrame([(1, True, "广东", "汽车"), (2, None, None, None)], "case_id int, cross_border boolean, region string, industry string")
    types = spark.createDataFrame([(1, "missing_information")], "case_id int, query_type string")
    told = {r.case_id: r.boosts for r in rank.boost_summary(facts, types).collect()}
    assert told[2] == {"primary_legal_basis": 1.2, "interpretation_auxiliary": 0.85}
    assert len(told[1]) == 9 and told[1]["conditional_local_basis:CN-GD"] == 1.5


def test_rerank_blends_and_keeps_a_constant_as_one(spark):
    h = spark.createDataFrame([(1, "a", 3.0, 0), (1, "b", 2.0, 1), (1, "c", 1.0, 2)], "case_id int, chunk_id string, score double, rank int")
    s = spark.createDataFrame([(1, "c", 0.9), (1, "a", 0.2)], "case_id int, chunk_id string, rerank_score double")
    got = {r.chunk_id: r.score for r in rank.rerank(h, s, 3).collect()}
    assert got == {"a": 0.6, "b": 0.3, "c": 0.4}


def test_neighbors_once_and_not_among_the_top(spark):
    top = spark.createDataFrame([(1, "d:0001", 0), (1, "d:0002", 1)], "case_id int, chunk_id string, rank int")
    chunks = spark.createDataFrame([("d:0001", "d:0000", "d:0002"), ("d:0002", "d:0001", "d:0003")], "chunk_id string, prev_chunk_id string, next_chunk_id string")
    assert [(r.chunk_id, r.side) for r in rank.expand_neighbors(top, chunks).orderBy("pos").collect()] == [("d:0000", -1), ("d:0003", -2)]


def test_regions(spark):
    df = spark.createDataFrame([("深圳",), ("上海自贸区",), ("火星",)], "r string")
    assert [r[0] for r in df.select(rank.region_code(F.col("r"))).collect()] == ["CN-GD-SZ", "CN-SH", "火星"]
    pairs = spark.createDataFrame([("CN-GD", "CN-GD-SZ"), ("CN-GD-SZ", "CN-GD"), ("CN", "CN-GD"), ("CN-SH", "CN-GD")], "a string, b string")
    assert [r[0] for r in pairs.select(rank.region_matches(F.col("a"), F.col("b"))).collect()] == [True, True, False, False]
