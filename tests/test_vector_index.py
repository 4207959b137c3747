import numpy as np
from pyspark.sql import functions as F

from corpusloom.operators import vector_index as V
from corpusloom.plans import catalogue

S = "vec_id long, embedding array<float>"


def clustered(rng, n, dims=24, k=30):
    centers = rng.normal(size=(k, dims))
    return [(i, (centers[rng.integers(k)] + 0.4 * rng.normal(size=dims)).astype("float32").tolist()) for i in range(n)]


def brute(rows, queries, k):
    x, at = V.units([v for _, v in rows])
    ids = np.array([i for i, _ in rows])[at]
    out = {}
    for q in queries:
        if q in ids:
            s = x @ x[np.flatnonzero(ids == q)[0]]
            out[q] = [int(i) for i in ids[np.lexsort((ids, -np.round(s, 6)))] if i != q][:k]
    return out


def test_recall_against_all(spark):
    rows = clustered(np.random.default_rng(0), 3000)
    df = spark.createDataFrame(rows, S)
    index = V.build(df, sample=800)
    assert sum(len(r.ids) // 8 for r in index.blocks.collect()) == 3000 and 1 <= index.coarse.probes < len(index.coarse.centroids) / 3
    got = {}
    for r in V.search(index, df.where("vec_id % 20 = 0"), 10).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    want = brute(rows, range(0, 3000, 20), 10)
    share = np.mean([len(set(got[q]) & set(w)) / len(w) for q, w in want.items()])
    assert set(got) == set(want) and share >= 0.9 and all(q not in g for q, g in got.items())


def test_all_lists_probed_is_exact(spark):
    rows = clustered(np.random.default_rng(1), 400)
    df = spark.createDataFrame(rows, S)
    index = V.build(df)
    full = V.VectorIndex(index.coarse._replace(probes=len(index.coarse.centroids)), index.blocks)
    got = {}
    for r in V.search(full, df.where("vec_id % 20 = 0"), 5).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got == brute(rows, range(0, 400, 20), 5)


def test_a_hot_list_is_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(V, "BLOCK", 100)
    df = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(1500)] + [(2000 + i, [0.0, 1.0 + i]) for i in range(50)], S)
    sizes = [len(r.ids) // 8 for r in V.build(df).blocks.collect()]
    assert sum(sizes) == 1550 and max(sizes) < 200


def test_vectors_without_a_direction(spark):
    rows = [(1, [1.0, 0.0]), (2, None), (3, []), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, [1.0, None]), (7, [1.0, 2.0, 3.0]), (8, [1.0, 0.1]), (9, [float("inf"), 0.0]), (None, [1.0, 1.0])]
    df = spark.createDataFrame(rows, S)
    got = sorted((r.query_id, r.vec_id) for r in V.search(V.build(df), df, 5).collect())
    assert got == [(1, 8), (8, 1)]
    none = spark.createDataFrame([], S)
    assert V.search(V.build(none), none, 5).collect() == []


def test_recall_of_the_registered_query(spark):
    r = catalogue.vector_ivf_recall(spark, "/root/testdata/sf0.01").agg(F.sum("n_found"), F.sum("n_exact")).first()
    assert r[0] >= 0.9 * r[1]
