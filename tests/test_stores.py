import glob
import os
import random

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import bounds, stores

S = "id string, n int"


def files_of(path):
    return {b.split("=")[1]: {os.path.basename(f) for f in glob.glob(f"{b}/*.parquet")} for b in glob.glob(f"{path}/_bucket=*")}


def test_upsert_rewrites_only_what_it_touches(spark, tmp_path):
    store = stores.KeyedStore(spark, str(tmp_path / "t"), "id", 16)
    store.upsert(spark.createDataFrame([(f"k{i}", i) for i in range(200)], S))
    before = files_of(store.path)
    assert len(before) == 16
    touched = store.upsert(spark.createDataFrame([("k5", -5), ("new", 1), ("new", 7)], S))
    after = files_of(store.path)
    assert 1 <= len(touched) <= 2 and all(after[b] == before[b] for b in before if int(b) not in touched) and all(after[str(b)] != before[str(b)] for b in touched)
    got = {r.id: r.n for r in store.read().collect()}
    assert got == {f"k{i}": i for i in range(200)} | {"k5": -5, "new": 7}


def test_deletes_and_empty_changes(spark, tmp_path):
    store = stores.KeyedStore(spark, str(tmp_path / "t"), "id", 4)
    store.upsert(spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], S))
    assert store.upsert(spark.createDataFrame([], S)) == []
    store.delete(spark.createDataFrame([("a",), ("zz",)], "id string"))
    assert {r.id for r in store.read().collect()} == {"b", "c"}


def test_a_failed_upsert_changes_nothing(spark, tmp_path):
    store = stores.KeyedStore(spark, str(tmp_path / "t"), "id", 4)
    store.upsert(spark.createDataFrame([("a", 1), ("b", 2)], S))
    before = files_of(store.path)
    bad = spark.createDataFrame([("a", 5)], S).withColumn("n", F.when(F.col("n") > 0, F.raise_error(F.lit("no")).cast("int")))
    with pytest.raises(Exception):
        store.upsert(bad)
    assert files_of(store.path) == before and {r.n for r in store.read().collect()} == {1, 2}


vector_of = lambda texts: [[float(len(t)), 1.0] for t in texts]  # noqa: E731  tasks get a lambda by value


def test_second_run_embeds_nothing(spark, tmp_path):
    cache = stores.KeyedStore(spark, str(tmp_path / "c"), "content_key", 4)
    texts = spark.createDataFrame([(i, f"text {i % 30}") for i in range(90)] + [(99, None)], "id int, text string")
    assert stores.embed_missing(texts, cache, "m1", vector_of, 2) == 30
    assert stores.embed_missing(texts, cache, "m1", vector_of, 2) == 0
    assert stores.embed_missing(texts.unionByName(spark.createDataFrame([(100, "more")], "id int, text string")), cache, "m1", vector_of, 2) == 1
    assert stores.embed_missing(texts, cache, "m2", vector_of, 2) == 30
    rows = stores.cached_vectors(texts, cache, "m1").collect()
    assert len(rows) == 91 and all(r.embedding is None if r.text is None else r.embedding == [len(r.text), 1.0] for r in rows)


def test_a_provider_that_miscounts_leaves_the_cache(spark, tmp_path):
    cache = stores.KeyedStore(spark, str(tmp_path / "c"), "content_key", 4)
    texts = spark.createDataFrame([("a",), ("b",)], "text string")
    stores.embed_missing(texts.where("text = 'a'"), cache, "m", vector_of, 2)
    for bad in (lambda t: vector_of(t)[1:], lambda t: [[1.0] for _ in t]):
        with pytest.raises(Exception, match="components were expected"):
            stores.embed_missing(texts, cache, "m", bad, 2)
    assert cache.read().count() == 1


def test_both_targets_or_neither(spark, tmp_path):
    root = str(tmp_path / "pub")
    docs = spark.createDataFrame([("a", "x"), ("b", "y")], "chunk_id string, text string")
    vecs = spark.createDataFrame([("a", [1.0, 2.0]), ("b", [0.0, 1.0])], "chunk_id string, embedding array<double>")
    assert stores.publish({"docs": docs, "vectors": vecs}, root, "chunk_id", ("vectors", "embedding", 2)) == {"docs": 2, "vectors": 2}
    more = docs.union(spark.createDataFrame([("c", "z")], docs.schema))
    with pytest.raises(ValueError, match="differ"):
        stores.publish({"docs": more, "vectors": vecs}, root, "chunk_id")
    with pytest.raises(ValueError, match="missing"):
        stores.publish({"docs": more, "vectors": vecs.union(spark.createDataFrame([("c", [1.0])], vecs.schema))}, root, "chunk_id", ("vectors", "embedding", 2))
    assert stores.published(spark, root, "docs").count() == 2 and len(glob.glob(f"{root}/v-*")) == 1
    stores.publish({"docs": more, "vectors": vecs.union(spark.createDataFrame([("c", [1.0, 1.0])], vecs.schema))}, root, "chunk_id", ("vectors", "embedding", 2))
    assert stores.published(spark, root, "docs").count() == stores.published(spark, root, "vectors").count() == 3


def test_health(spark, tmp_path):
    got = stores.health({"good": lambda: spark.range(3), "bad": lambda: spark.read.parquet(str(tmp_path / "none"))})
    assert got["good"] == {"ok": True, "rows": 3, "error": None} and not got["bad"]["ok"] and got["bad"]["error"]


def test_postings_after_changes_equal_a_rebuild(spark):
    rng = random.Random(2)
    schema, fields = "chunk_id long, text string, title string", {"text": "text", "title": "title"}
    text = lambda: " ".join(f"w{int(rng.paretovariate(0.7)) % 60}" for _ in range(rng.randint(0, 20)))
    rows = {i: (i, text(), text()[:12]) for i in range(80)}
    own = stores.frequencies(spark.createDataFrame(list(rows.values()), schema), fields)
    q = spark.createDataFrame([(i, text()) for i in range(15)], "query_id long, text string")
    for step in range(2):
        ups = [(i, text(), text()[:12]) for i in [*rng.sample(sorted(rows), 8), 100 + step, 200 + step]]
        gone = rng.sample(sorted(set(rows) - {u[0] for u in ups}), 6)
        rows |= {u[0]: u for u in ups}
        for i in gone:
            del rows[i]
        own = stores.changed(own, spark.createDataFrame(ups, schema), spark.createDataFrame([(i,) for i in gone], "chunk_id long"), fields)
    new = spark.createDataFrame(list(rows.values()), schema)
    want = bounds.best_fields(bounds.bm25_index(new, fields), q, {"text": 1.0, "title": 2.0}, 10)
    got = bounds.best_fields(stores.bm25_index(own), q, {"text": 1.0, "title": 2.0}, 10)
    key = lambda df: sorted((r.query_id, r.chunk_id, r.score) for r in df.collect())
    assert key(got) == key(want)
    fresh = stores.frequencies(new, fields)
    assert sorted(own.df.collect()) == sorted(fresh.df.collect()) and sorted(own.stats.collect()) == sorted(fresh.stats.collect())
