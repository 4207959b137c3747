import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import quality as Q
from corpusloom.llm import toxicity as T

SF = "/root/testdata/sf0.01"


def test_trees_and_isotonic():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(1500, 4))
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] > 0)).astype(float)
    t = T.Trees.fit(x[:1000], y[:1000], 60, 3)
    t.calibrate(t.raw(x[1000:1250]), y[1000:1250])
    s = t.score(x[1250:])
    assert ((s >= 0.5) == y[1250:]).mean() > 0.93 and s.min() >= 0 and s.max() <= 1
    grid = t.raw(x)
    assert (np.diff(t.score(x)[np.argsort(grid)]) >= -1e-12).all()


def test_disguises():
    assert T.plain("id1ot") == ("idiot", True) and T.plain("IDIOT!") == ("idiot", False) and T.plain("123") == ("123", False)
    f = T.features("you are an id1ot", {"idiot": 5.0})
    assert len(f) == T.FEATURES and f[0] == 1 and f[9] >= 1 and f[15] == 1


def test_chunks_cover_the_text():
    for size in (0, 1, 511, 512, 513, 5000):
        starts = list(Q.chunk_starts(size))
        assert starts[0] == 0 and starts[-1] + Q.CHUNK_BYTES >= size and all(b - a == Q.HOP_BYTES for a, b in zip(starts, starts[1:]))


def test_score_reads_the_whole_text():
    net = Q.Network(np.random.default_rng(1))
    text = "plain words " * 9000
    peaks = net.block_peaks(np.frombuffer(text.encode(), dtype=np.uint8))
    short = net.block_peaks(np.frombuffer(text.encode()[: Q.SEGMENT], dtype=np.uint8))
    assert np.allclose(peaks[: len(short) - 1], short[:-1]) and len(peaks) == -(-len(text) // 64)
    assert net.score(text) != net.score(text + "#$%&" * 200)


@pytest.mark.parametrize("kind", ["quality", "toxic"])
def test_held_out(spark, kind):
    from corpusloom.llm.queries import op3_quality, op10_toxicity

    out = (op3_quality if kind == "quality" else op10_toxicity)(spark, SF)
    rows = out.join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert out.count() == 1000 and out.where("score is null or score < 0 or score > 1").count() == 0
    s, y = rows["score"].to_numpy(), rows[kind].to_numpy()
    pairs = (s[y == 1][:, None] > s[y == 0][None, :]).mean() + 0.5 * (s[y == 1][:, None] == s[y == 0][None, :]).mean()
    assert pairs > (0.95 if kind == "quality" else 0.9)


def tables(spark, n):
    rng = random.Random(0)
    docs = [(i, " ".join(rng.choice(["ab", "cd", "ef"]) for _ in range(30)) + (" vile" if i % 4 == 0 else ""), "x", 1) for i in range(n)]
    labels = [(i, i % 4 == 1, i % 4 == 0) for i in range(n)]
    return spark.createDataFrame(docs, "doc_id long, text string, score string, y int"), spark.createDataFrame([(i, int(a), int(b)) for i, a, b in labels], "doc_id long, quality int, toxic int")


def test_defined_cases(spark):
    docs, labels = tables(spark, 200)
    odd = docs.unionByName(spark.createDataFrame([(None, None, None, None), (900, None, None, None), (901, "", "", 0), (902, "z" * 300_000, "", 0), (902, "z" * 300_000, "", 0)], docs.schema))
    for module, learn in ((T, T.learn), (Q, Q.learn)):
        model = learn(odd, labels.unionByName(spark.createDataFrame([(None, 1, 1), (5000, None, None)], labels.schema)))
        assert module.score(odd, model).where("score between 0 and 1").count() == 205
        assert module.score(docs.where("false"), model).count() == 0
        one = learn(docs, labels.where("toxic = 0 and quality = 0"))
        assert {r.score for r in module.score(docs, one).collect()} == {0.0}
        none = learn(docs, labels.where("false"))
        assert module.score(docs, none).where("score between 0 and 1").count() == 200


def test_rejects_go_and_the_rest_stays(spark):
    docs, labels = tables(spark, 400)
    out = T.drop_toxic(docs, labels)
    assert out.columns == docs.columns
    kept = {r.doc_id for r in out.collect()}
    assert len(kept & {i for i in range(400) if i % 4}) == 300 and len(kept & {i for i in range(400) if i % 4 == 0}) <= 5


def test_held_out_flag(spark):
    import zlib

    df = spark.createDataFrame([(i,) for i in range(50)] + [(None,)], "doc_id long").withColumn("h", T.held_out(3, 1))
    assert all(r.h == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in df.collect())
    assert df.where(F.col("h").isNull()).count() == 0
