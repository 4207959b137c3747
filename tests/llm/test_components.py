import random

from corpusloom.llm.components import connected_components


def test_shuffled_chain(spark):
    """Long chains of shuffled ids end in one component each, however many rounds that takes."""
    ids = list(range(2400))
    random.Random(1).shuffle(ids)
    one, two = ids[:1200], ids[1200:]
    edges = list(zip(one, one[1:])) + list(zip(two, two[1:])) + list(zip(two, two[2:]))
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: min(one) for i in one} | {i: min(two) for i in two}
