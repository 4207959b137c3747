import math

import numpy as np
from pyspark.sql import functions as F

from corpusloom.llm import vector_codes as vc
from corpusloom.llm.hot_join import with_groups

S = "vec_id long, embedding array<float>, label int"


def brute(rows, parts=16, entries=64, rounds=2, scale=256):
    """Plain k-means in Python integers."""
    kept = [(i, [math.floor(scale * float(np.float32(x))) for x in v], lab) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = max(1, -(-max((len(v) for _, v, _ in kept), default=0) // parts))
    kept = [(i, v + [0] * (width * parts - len(v)), lab) for i, v, lab in kept]
    start = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    cutp = lambda v, p: v[p * width : (p + 1) * width]
    books = [[cutp(v, p) for _, v, _ in start] for p in range(parts)]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))

    def assign():
        return [[min((dist(cutp(v, p), e), j) for j, e in enumerate(books[p])) for p in range(parts)] for _, v, _ in kept]

    for _ in range(rounds):
        got = assign()
        for p in range(parts):
            for j in range(len(books[p])):
                own = [cutp(v, p) for (_, v, _), g in zip(kept, got) if g[p][1] == j]
                if own:
                    books[p][j] = [sum(c) // len(own) for c in zip(*own)]
    got = assign()
    errors = [sum(d for d, _ in g) for g in got]
    by = {}
    for (_, _, lab), e in zip(kept, errors):
        by[lab] = by.get(lab, 0) + e
    return [(i, lab, "".join(f"{j:02x}" for _, j in g), e, by[lab]) for (i, _, lab), g, e in zip(kept, got, errors)], books


def check(spark, rows, **kw):
    df = spark.createDataFrame(rows, S)
    out, books = vc.compress(df, **kw)
    want, own = brute(rows, **kw)
    key = lambda r: tuple((x is None, x if x is not None else 0) for x in r)
    assert sorted(map(tuple, out.collect()), key=key) == sorted(want, key=key)
    assert books.tolist() == own


def test_against_plain_kmeans(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=32).astype("float32").tolist(), int(rng.integers(0, 4)) if i % 7 else None) for i in range(400)]
    check(spark, rows)
    check(spark, rows, rounds=4, entries=20, parts=8)
    check(spark, rows[:50], rounds=0)


def test_bad_rows_ties_and_lengths(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.integers(-2, 3, 16)], i % 3) for i in range(150)]
    rows += [(200, None, 1), (201, [1.0, None], 1), (202, [float("nan")] * 16, 1), (203, [float("inf")] * 16, None), (204, [float("-inf")], 0)]
    rows += [(-5, [1.0, 2.0], None), (-5, [1.0, 2.0], None), (None, [0.5] * 16, 9), (-7, [], 2), (300, [1e5, -1e5] * 8, 2)]
    check(spark, rows)
    check(spark, rows, rounds=3, parts=5, entries=7)
    check(spark, [(1, [0.1] * 16, None), (2, [0.1] * 16, 4)])
    check(spark, [(i, [0.25] * 16, 0) for i in range(200)])
    check(spark, [(1, [3.0], 1)])


def test_empty_and_extra_columns(spark):
    out, books = vc.compress(spark.createDataFrame([(1, None, 1)], S))
    assert out.collect() == [] and books.shape == (16, 0, 1)
    rows = [(i, [float(i % 5)] * 16, "a" if i % 2 else None, 1, "x", b"") for i in range(80)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string, error int, code string, v binary")
    got, _ = vc.compress(df)
    want, _ = brute([r[:3] for r in rows])
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_values_held_at_the_bound(spark):
    rows = [(i, [1e30 * (i - 2), 1.0], 0) for i in range(5)]
    out, _ = vc.compress(spark.createDataFrame(rows, S))
    assert len(out.collect()) == 5


def test_bounds_never_exceed_distances():
    """After any moves each bound is at most the true distance, whatever was verified, let go or rounded."""
    rng = np.random.default_rng(3)
    v = rng.integers(-100, 100, size=(500, 3))
    e = v[:24].copy()
    error, state = vc.measured(vc.distances(v, e), 5)
    seen = set()
    for t in range(12):
        new = e + rng.integers(-12 // (1 + t // 3), 13 // (1 + t // 3) + 1, size=e.shape)
        moves = np.sqrt(((new - e) ** 2).sum(1)) * (1 + 1e-9)
        near, low, step = vc.packed([state])
        state = vc.unpacked(near, low, step, 1)[0]
        error, state, need = vc.reassigned(v, state, new, moves)
        e = new
        d = vc.distances(v, e)
        assert (d.argmin(1) == state.near[:, 0]).all() and (d.min(1) == error).all()
        b = state.near.shape[1] - 1
        true = np.sqrt(np.take_along_axis(d, state.near[:, 1:], 1))
        assert (state.low[:, :b] <= true + 1e-6).all() and (np.diff(state.low[:, :b], axis=1) >= 0).all()
        for i in range(len(v)):
            rest = [j for j in range(24) if j not in state.near[i]]
            assert not rest or state.low[i, b] <= math.sqrt(d[i, rest].min()) + 1e-6
        seen.add(vc.adapted(need, b))
        state = vc.narrowed(state, vc.adapted(need, b))
    assert len(seen) > 1


def test_large_distances_stay_exact():
    v = np.array([[2**27, -(2**27)], [2**27 - 1, 5]])
    e = np.array([[-(2**27), 2**27], [2**27, 3]])
    assert vc.distances(v, e).tolist() == [[sum((int(a) - int(b)) ** 2 for a, b in zip(x, y)) for y in e] for x in v]


def test_hot_join(spark):
    rows = spark.range(5000).select("id", F.when(F.col("id") < 3000, 0).otherwise(F.col("id")).alias("k"))
    groups = rows.where("id % 2 = 0").groupBy("k").agg(F.count("*").alias("n"), F.max("id").alias("top"))
    got = {r.id: r.top for r in with_groups(rows, groups, "k", "n", 5000, ["top"]).collect()}
    assert got == {i: 2998 if i < 3000 else i if i % 2 == 0 else None for i in range(5000)}
