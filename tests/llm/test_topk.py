import math

import numpy as np
from pyspark.sql import functions as F

from corpusloom.llm import topk

S = "vec_id long, embedding array<float>"


def brute(rows, k, scale=1024):
    ok = [(i, [math.floor(scale * float(np.float32(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = {}
    for i, q in ok:
        if i % 100 == 0:
            s = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in ok if j != i)
            out[i] = [(j, -x) for x, j in s[:k]]
    return out


def got(spark, rows, k=10, schema=S):
    df = spark.createDataFrame(rows, schema)
    out = {}
    for r in topk.top_k(df, df.where(F.col("vec_id") % 100 == 0), k, block=64, query_block=4).orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(out[r.query_id])
    return out


def test_against_brute_force(spark):
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(size=40).astype("float32").tolist()) for i in range(700)]
    assert got(spark, rows) == brute(rows, 10)


def test_ties_bad_vectors_and_few_rows(spark):
    rows = [(i, [1.0, 0.5]) for i in range(0, 30)] + [(100, [1.0, 1.0]), (200, None), (300, [float("nan"), 1.0]), (400, [1.0, None]), (None, [1.0, 1.0]), (500, [float("inf"), 0.0])]
    assert got(spark, rows) == brute(rows, 10)
    assert [j for j, _ in got(spark, rows)[100]] == list(range(10))
    few = [(0, [1.0]), (1, [2.0])]
    assert got(spark, few) == {0: [(1, 1024 * 2048)]}
    assert got(spark, []) == {}


def test_large_integers_and_lengths(spark):
    rows = [(0, [3.0e4, 1.0, 2.0]), (1, [3.1e4, -1.0]), (2, [-2.9e4, 5.0, 1.0]), (3, [])]
    out = got(spark, rows)[0]
    v = {i: [math.floor(1024 * float(np.float32(x))) for x in e] for i, e in rows}
    want = sorted(((-sum(a * b for a, b in zip(v[0], v[j])), j) for j in (1, 2, 3)))
    assert out == [(j, -s) for s, j in want]


def test_repeated_rows(spark):
    rows = [(0, [1.0]), (0, [1.0]), (5, [1.0]), (5, [1.0])]
    assert got(spark, rows) == {0: [(5, 1024 * 1024), (5, 1024 * 1024)]}


def test_extra_columns_and_long_vectors(spark):
    rng = np.random.default_rng(8)
    rows = [(i, [float(x) for x in rng.normal(size=3000)], i, "s", b"x") for i in range(95, 130)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, query_id long, score string, mat binary")
    out = {}
    for r in topk.top_k(df, df.where(F.col("vec_id") % 100 == 0), 5, block=8, query_block=2).orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert out == brute([(i, v) for i, v, *_ in rows], 5)


def test_sums_beyond_doubles():
    """Components so large that sums have no exact double; the bounds allow for what rounding takes."""
    rng = np.random.default_rng(9)
    c = rng.integers(-(2**28), 2**28, size=(64, 300))
    q = c[:, :3] + rng.integers(-5, 5, size=(64, 3))
    ids = np.arange(300)
    got = topk.search_block(np.array([1000, 1001, 1002]), q, ids, c, 5)
    for i in range(3):
        scores = [int(sum(int(a) * int(b) for a, b in zip(q[:, i], c[:, j]))) for j in range(300)]
        want = sorted(range(300), key=lambda j: (-scores[j], j))[:5]
        assert [(x[2], x[3]) for x in got if x[0] == i] == [(j, scores[j]) for j in want]
