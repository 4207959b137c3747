"""Reviews of whole cases with searches given as tables."""

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import rank, review, tables, workflow

FACTS = "case_id long, cross_border_transfer boolean, region string, industry string, data_types array<string>, overseas_recipient string, missing_information array<string>"


@pytest.fixture(scope="module")
def chunks(spark):
    rows = [
        (i, f"s{i // 2}", "primary_legal_basis" if i % 4 == 0 and i < 100 else "implementation_reference", i % 4 == 0 and i < 100, "CN", "标题", "数据出境 安全评估", [f"t{i}", f"u{i}"], i, None, i - 1 if i % 2 else None, None if i % 2 else i + 1)
        for i in range(200)
    ]
    kinds = "chunk_id long, source_id string, citation_role string, can_cite_clause boolean, applicable_region string, title string, text string, tokens array<string>, chunk_index int, article_no string, prev_chunk_id long, next_chunk_id long"
    return spark.createDataFrame(rows, kinds).withColumns({"primary_like": F.col("can_cite_clause"), "mentions": F.lit(""), "subject_words": F.lit("")})


class Recorded:
    """A search that gives every query the chunks from ``first`` on, and keeps what it was asked."""

    def __init__(self, spark, first):
        self.spark, self.first, self.asked = spark, first, []

    def __call__(self, queries, k):
        self.asked.append((k, sorted(r.text for r in queries.collect())))
        return queries.select("query_id", F.explode(F.sequence(F.lit(self.first), F.lit(self.first + k - 1))).alias("chunk_id")).select("query_id", F.col("chunk_id").cast("long"), (F.lit(200.0) - F.col("chunk_id")).alias("score"))


def plan_of(spark):
    rows = [(c, f"q_{i + 1}", i, t, x) for c in (1, 2) for i, (t, x) in enumerate([("legal_issue", "甲"), ("material_fact", "乙"), ("missing_information", "丙")])]
    return spark.createDataFrame(rows, "case_id long, query_id string, query_pos int, query_type string, text string")


def facts_of(spark):
    return spark.createDataFrame([(1, False, None, None, [], None, []), (2, False, None, None, ["数据"], None, [])], FACTS)


def run(spark, chunks, first, **more):
    searches = [Recorded(spark, first), Recorded(spark, first + 1)]
    return workflow.hybrid_retrieval(plan_of(spark), facts_of(spark), chunks, searches, evidence_terms=("安全",), **more), searches


def test_one_pass_where_evidence_suffices(spark, chunks):
    r, searches = run(spark, chunks, 0, k=4)
    rows = r.hits.orderBy("case_id", "rank").collect()
    assert [x["rank"] for x in rows if x.case_id == 1] == [0, 1, 2, 3] and not any(x.second_pass for x in rows)
    assert searches[0].asked[0] == (50, ["丙", "乙", "甲"])
    assert {x.status for x in r.checks.collect()} == {"sufficient"}
    assert len({x.source_id for x in rows if x.case_id == 1}) == 4


def test_second_pass_is_deeper_and_keeps_the_issues(spark, chunks):
    r, searches = run(spark, chunks, 120, k=4)
    depths = [k for k, _ in searches[0].asked]
    assert depths == [50, 50] and set(searches[0].asked[0][1]) < set(searches[0].asked[1][1])
    rows = r.hits.collect()
    assert all(x.second_pass for x in rows) and max(x["rank"] for x in rows) == 19  # max(k, 20) places
    assert {x.status for x in r.checks.collect()} == {"insufficient"}
    assert r.packets.count() == len(rows)


def test_a_large_k_is_kept_in_the_second_pass(spark, chunks):
    r, searches = run(spark, chunks, 110, k=25, by_issue=False)
    assert max(x["rank"] for x in r.hits.collect()) == 24


def test_queries_of_issues_alone_stay_out_of_the_global_list(spark, chunks):
    plan = plan_of(spark).withColumn("initial", F.col("query_pos") < 2)

    def only(q, k):
        base = plan.select("text", F.when(F.col("query_pos") == 2, 90).otherwise(0).alias("base")).distinct()
        own = q.join(base, "text").select("query_id", F.explode(F.sequence(F.col("base"), F.col("base") + 7)).alias("chunk_id"))
        return own.select("query_id", F.col("chunk_id").cast("long"), (200.0 - F.col("chunk_id")).alias("score"))

    r = workflow.hybrid_retrieval(plan, facts_of(spark), chunks, [only], k=3, by_issue=False)
    assert max(x.chunk_id for x in r.candidates.collect()) < 90
    issues = workflow.hybrid_retrieval(plan, facts_of(spark), chunks, [only], k=6).hits.collect()
    assert any(x.chunk_id >= 90 for x in issues)


def test_rerank_neighbours_and_packets(spark, chunks):
    scores = lambda hits: hits.select("case_id", "chunk_id", F.col("chunk_id").cast("double").alias("rerank_score"))
    r, _ = run(spark, chunks, 0, k=4, by_issue=False, rerank_scores=scores, window=10, weight=1.0)
    top = [x.chunk_id for x in r.hits.where("case_id = 1").orderBy("rank").collect()]
    assert top == sorted(top, reverse=True) and min(top) >= 12  # of the ten best sources the four with the highest ids
    near = r.neighbors.where("case_id = 1").collect()
    assert {x.chunk_id for x in near} == {c + 1 if c % 2 == 0 else c - 1 for c in top}
    packs = {x.representative: x for x in r.packets.where("case_id = 1").collect()}
    assert set(packs) == set(top) and all(packs[c].neighbors == [c + 1 if c % 2 == 0 else c - 1] for c in top)
    flat = [x.chunk_id for x in rank.flatten_packets(r.packets.where("case_id = 1")).orderBy("pos").collect()]
    assert flat[0] == top[0] and len(flat) == len(set(flat)) and set(flat) >= {x.chunk_id for x in near}


def test_first_issue_plan_is_the_one_of_the_plan(spark):
    own = {r.issue_id: r.query_ids for r in review.issue_plan(plan_of(spark)).where("case_id = 1").collect()}
    assert sorted(sum(own.values(), [])) == ["q_1", "q_2", "q_3"]


def test_only_chunks_that_searches_found_are_worked_on(spark, chunks):
    """What is made of texts is made of the chunks that some search found, not of the corpus."""
    seen = spark.sparkContext.accumulator(0)

    def counted(tokens):
        seen.add(1)
        return tokens

    more = spark.range(200, 3000).select(F.col("id").alias("chunk_id"))
    wide = chunks.unionByName(more, allowMissingColumns=True).repartition(2)
    of = lambda named: tables.among(wide, named, "chunk_id").withColumn("tokens", F.udf(counted, "array<string>")("tokens"))
    r, _ = run(spark, of, 0, k=4)
    assert r.hits.count() == 8 and 0 < seen.value < 500
