import random
from itertools import combinations

import pytest

from corpusloom.llm import near_dedup as N

S = "doc_id long, text string, component_id long"


def brute(rows, n):
    sets = {}
    for i, t in rows:
        w = N.WORDS.findall((t or "").translate(N.LOWER))
        k = min(n, len(w))
        sets.setdefault(i, []).append(frozenset(tuple(w[a : a + k]) for a in range(len(w) - k + 1)) if w else frozenset())
    label = {i: i for i in sets}
    flat = [(i, s) for i, ss in sets.items() for s in ss if s]

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for (i, a), (j, b) in combinations(flat, 2):
        if i != j and 100 * len(a & b) >= 80 * len(a | b):
            x, y = find(i), find(j)
            label[max(x, y)] = min(x, y)
    return {i: find(i) for i in label}


def families(seed, words=60):
    rng = random.Random(seed)
    rows, i = [], 0
    for _ in range(12):
        base = [f"w{rng.randint(0, 4000)}" for _ in range(rng.randint(5, words))]
        for _ in range(rng.randint(1, 14)):
            own = list(base)
            for _ in range(rng.randint(0, 1 + len(own) // 12)):
                own[rng.randrange(len(own))] = f"e{rng.randint(0, 10**6)}"
            rows.append((i, " ".join(own)))
            i += 1
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("n", [2, 5])
def test_against_brute_force(spark, n):
    rows = families(n)
    got = {r.doc_id: r.component_id for r in N.near_duplicates(spark.createDataFrame([(i, t, 0) for i, t in rows], S), n).collect()}
    assert got == brute(rows, n)


def test_dense_family_is_settled(spark, monkeypatch):
    """Many close copies of one text, and a bridge at the threshold."""
    rng = random.Random(9)
    base = [f"w{k}" for k in range(100)]
    rows = []
    for i in range(160):
        own = list(base)
        for _ in range(rng.randint(0, 9)):
            own[rng.randrange(100)] = f"e{rng.randint(0, 10**6)}"
        rows.append((i, " ".join(own)))
    monkeypatch.setattr(N, "LEFT_BLOCK", 500)
    monkeypatch.setattr(N, "MEMBER_BLOCK", 2000)
    got = {r.doc_id: r.component_id for r in N.near_duplicates(spark.createDataFrame([(i, t, 0) for i, t in rows], S), 2).collect()}
    assert got == brute(rows, 2)


def test_defined_cases(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "One"), (5, "one"), (6, "a b c d e f"), (7, "A B C D E F"), (7, "A B C D E F"), (None, "a b c d e f"), (8, "x " * 30000), (9, "x " * 40000)]
    out = N.near_duplicates(spark.createDataFrame([(i, t, 0) for i, t in rows], S), 5).collect()
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in out}
    assert len(out) == len(rows)
    assert got[1] == (0, 1, True) and got[3] == (0, 3, True) and got[4] == (1, 4, True) and got[5] == (1, 4, False)
    assert got[7] == (2, 6, False) and got[None] == (2, None, True) and got[8] == (1, 8, True) and got[9] == (1, 8, False)
    assert N.near_duplicates(spark.createDataFrame([], S)).count() == 0


def test_one_of_each_class_stays(spark):
    df = spark.createDataFrame([(1, "a b c d e f g", 0), (2, "a b c d e f g", 0), (3, "other words entirely here now", 0), (None, "a b c d e f g", 0)], S)
    out = N.drop_near_duplicates(df)
    assert out.columns == df.columns and sorted((r.doc_id or 0) for r in out.collect()) == [0, 1, 3]


def test_pair_among_lower_ids_that_share_a_part(spark):
    """A pair over the threshold whose regions begin with lower ids, each under REGION with another part of the pair."""
    rng = random.Random(5)
    own = lambda k: [f"u{rng.randint(0, 10**9)}" for _ in range(k)]
    one = own(200)
    rows = [(i, " ".join(rng.sample(one, 124) + own(76))) for i in range(600)]
    rows += [(600, " ".join(one)), (601, " ".join(one[:182] + own(18)))]
    got = {r.doc_id: r.component_id for r in N.near_duplicates(spark.createDataFrame([(i, t, 0) for i, t in rows], S), 1).collect()}
    want = brute(rows, 1)
    assert want == {i: min(i, 600) for i in range(602)} and got == want
