"""Small operators that no registered query reaches."""

from pyspark.sql import functions as F

from corpusloom.functions import rules
from corpusloom.functions.text import strip_tags
from corpusloom.operators import policy, report, review
from corpusloom.sources import files


def test_revision_patch(spark):
    schema = "case_id int, claim_pos int, claim string"
    claims = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (1, 2, "c"), (2, 0, "x")], schema)
    patched = review.apply_patch(claims, claims.where("claim = 'a'"), spark.createDataFrame([(1, 1, "B"), (3, 0, "none")], schema), spark.createDataFrame([(1, 3, "new")], schema))
    assert sorted(map(tuple, patched.collect())) == [(1, 1, "B"), (1, 2, "c"), (1, 3, "new"), (2, 0, "x")]


def test_critic_routing(spark):
    rows = [("high", False), ("medium", False), ("medium", True), ("insufficient_evidence", False)]
    got = [r.c for r in spark.createDataFrame(rows, "risk_level string, second_pass boolean").select(review.needs_critic().alias("c")).collect()]
    assert got == [True, False, True, True]


def test_counts_and_maps(spark):
    rows = spark.createDataFrame([("a", None, {"x": 1}), ("", 2, {"x": 2, "y": 5}), (None, 3, {})], "s string, n int, m map<string,int>")
    assert tuple(report.filled_counts(rows, ["s", "n"]).first()) == (1, 2)
    assert {r.rule: r.n for r in report.merged_maps(rows, "m").collect()} == {"x": 3, "y": 5}


def test_tags_and_policy(spark):
    row = spark.createDataFrame([("<p> a <b>c</b></p> ", "primary_legal_basis", rules.DIRECT_SOURCES[0])], "t string, r string, s string").select(
        strip_tags(F.col("t")).alias("t"), policy.can_cite_source(F.col("r")).alias("c"), policy.direct_reference(F.col("s")).alias("d"), policy.default_retrievable(F.col("s")).alias("e")
    ).first()
    assert (row.t, row.c, row.d, row.e) == ("a c", True, True, True)


def test_index_rows(spark, tmp_path):
    chunks, vectors = spark.createDataFrame([("a", 1), ("b", 2)], "chunk_id string, n int"), spark.createDataFrame([("a", [1.0])], "chunk_id string, embedding array<double>")
    rows = files.vector_rows(chunks, vectors)
    files.write_index(rows, str(tmp_path / "i"), "chunk_id", 2)
    assert {r.chunk_id: r.embedding for r in spark.read.parquet(str(tmp_path / "i")).collect()} == {"a": [1.0], "b": None}
