from corpusloom.llm import components, prefilter


def test_components_of_a_chain(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7), (None, 3)], "a long, b long")
    got = {r.node: r.component for r in components.connected_components(chain).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}
    assert components.connected_components(chain.where("a < 0")).count() == 0


def test_prefilter(spark):
    rows, keys = spark.range(10_000), spark.range(0, 10_000, 100).withColumnRenamed("id", "k")
    kept = {r.id for r in prefilter.may_match(rows, "id", keys, "k").collect()}
    assert set(range(0, 10_000, 100)) <= kept and len(kept) < 200
    assert len({r.id for r in prefilter.may_match(rows, "id", keys, "k", 64).collect()}) >= 100
