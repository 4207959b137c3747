import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.operators import tables
from corpusloom.sources import files
from corpusloom.storage import materialize, release
from corpusloom.streaming import ingest

S = T.StructType([T.StructField("chunk_id", T.StringType()), T.StructField("n", T.LongType())])


def test_jsonl(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", None)], S)
    assert files.write_jsonl(df, f"{tmp_path}/x") == 2
    assert sorted(map(tuple, files.read_jsonl(spark, f"{tmp_path}/x", S).collect()), key=str) == [("a", 1), ("b", None)]
    assert files.read_jsonl(spark, f"{tmp_path}/none", S).count() == 0
    with pytest.raises(files.CorpusError):
        files.load_corpus(spark, f"{tmp_path}/none", S)


def test_manifest(spark, tmp_path):
    p = tmp_path / "m.csv"
    p.write_text("﻿source_id,topic_tags,include_in_mvp\na,x；y;，z,是\nb,,no\n", encoding="utf-8")
    rows = {r.source_id: r for r in files.read_manifest(spark, str(p)).collect()}
    assert rows["a"].topic_tags == ["x", "y", "z"] and rows["a"].include_in_mvp and not rows["b"].include_in_mvp and rows["b"].topic_tags == []
    files.write_manifest(files.read_manifest(spark, str(p)), f"{tmp_path}/out")
    assert sorted(r.topic_tags or "" for r in spark.read.option("header", True).csv(f"{tmp_path}/out").collect()) == ["", "x;y;z"]


def test_raw_files(spark, tmp_path):
    d = tmp_path / "raw"
    d.mkdir()
    for name in ("a.html", "a.txt", "a.meta.json", "b.pdf"):
        (d / name).write_text(name)
    src = spark.createDataFrame([("a", ".txt"), ("b", ".docx")], "source_id string, raw_format string")
    got = {r.source_id: r.suffix for r in files.raw_path(src, files.raw_files(spark, str(d))).collect()}
    assert got == {"a": ".txt", "b": ".pdf"}
    df = spark.createDataFrame([(None, "http://x/a.PDF?q=1"), ("docx", "u"), (None, "http://x/y")], "d string, u string")
    assert [r[0] for r in df.select(files.output_suffix(F.col("d"), F.col("u"))).collect()] == [".pdf", ".docx", ".txt"]


def test_bulk_lines(spark):
    rows = [r.line for r in files.bulk_lines(spark.createDataFrame([("a", 1)], S), "i").collect()]
    assert rows == ['{"index":{"_index":"i","_id":"a"}}', '{"chunk_id":"a","n":1}']


def test_keyed_tables(spark):
    old, new = spark.createDataFrame([("a", 1), ("b", 2)], S), spark.createDataFrame([("b", 3), ("c", 4)], S)
    assert sorted(map(tuple, tables.upsert(old, new, "chunk_id").collect())) == [("a", 1), ("b", 3), ("c", 4)]
    v = spark.createDataFrame([("a", [1.0, 2.0])], "chunk_id string, v array<double>")
    assert tables.upsert_vectors(v, v, "chunk_id", "v", 2).count() == 1
    with pytest.raises(Exception, match="components"):
        tables.upsert_vectors(v, v, "chunk_id", "v", 3).collect()
    built = tables.load_or_build(new, old, "chunk_id", lambda df: df.withColumn("n", F.lit(9).cast("long")))
    assert sorted(map(tuple, built.collect())) == [("a", 1), ("b", 2), ("c", 9)]


def test_stream_matches_batch(spark, tmp_path):
    df = spark.createDataFrame([(i, f"t{i % 3}") for i in range(20)], "doc_id int, text string")
    df.repartition(4).write.parquet(f"{tmp_path}/in")
    stream = ingest.document_stream(spark, f"{tmp_path}/in", df.schema, 2)
    q = ingest.run_available(stream, f"{tmp_path}/out", f"{tmp_path}/cp", lambda b: b.withColumn("n", F.length("text")), "doc_id")
    q.awaitTermination(60)
    assert spark.read.parquet(f"{tmp_path}/out").select("doc_id").distinct().count() == 20


def test_release(spark):
    from corpusloom.storage import shared_dir

    release(spark)
    t = materialize(spark.range(3).toDF("n"), "probe")
    path = t.inputFiles()[0].rsplit("/", 1)[0]
    assert path.split("file:")[-1].lstrip("/").startswith(shared_dir(spark).lstrip("/")) and files.exists(spark, path)
    assert release(spark) == 1 and not files.exists(spark, path)
