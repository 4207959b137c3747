from collections import defaultdict

from pyspark.sql import functions as F

from corpusloom.llm import mixing as M

S = "doc_id long, text string, source string, n_chars long, size int"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, s, None if t is None else len(t), 7) for i, t, s in rows], S)


def loop(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    """Clamp and reshare until none is above its clamp."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    total, fixed = share * sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in fixed]
        left, ws = total - sum(fixed.values()), sum(w[s] for s in free)
        over = [s for s in free if left * w[s] / ws > most * sizes[s] + 1e-9]
        if not over:
            return fixed | {s: left * w[s] / ws for s in free}
        fixed |= {s: most * sizes[s] for s in over}


def test_targets_and_taken(spark):
    rows = [(i, "w " * (1 + i * 13 % 40), f"s{i % 7}") for i in range(300)] + [(900, None, "s1"), (901, "a b", None), (902, "", "zz")]
    out = M.mix(docs(spark, rows)).collect()
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    want = loop(sizes)
    taken = defaultdict(int)
    for r in out:
        s = None if r.k == "1" else r.k[1:]
        assert abs(r.target - want[s]) < 1e-6 and r.source_size == sizes[s] and r.taken <= 2 * r.size
        taken[s] += r.taken
    assert all(abs(taken[s] - want[s]) <= 1 for s in sizes) and len(out) == len(rows)
    again = {(r.doc_id, r.taken) for r in M.mix(docs(spark, rows[::-1])).collect()}
    assert again == {(r.doc_id, r.taken) for r in out}


def test_empty_and_wordless(spark):
    assert M.mix(docs(spark, [])).count() == 0
    out = M.mix(docs(spark, [(1, None, "a"), (2, " ", "b")])).collect()
    assert [(r.size, r.target, r.taken) for r in out] == [(0, 0.0, 0)] * 2


def test_documents_of_the_mix(spark):
    rows = [(i, f"d{i} " + "w " * (i % 9), f"s{i % 4}") for i in range(60)] + [(7, "d7 w w", "s3"), (7, "d7 w w", "s3"), (None, "n n", "s0")]
    df = docs(spark, rows)
    plan = M.mix(df).collect()
    out = M.mixed_documents(df)
    assert out.columns == df.columns
    words = sum(len((r.text or "").split()) for r in out.collect())
    assert words == sum(r.taken for r in plan)
    texts = defaultdict(set)
    for i, t, _ in rows:
        texts[i].add(" ".join(t.split()))
    for r in out.collect():
        assert any(t.startswith(" ".join(r.text.split())) for t in texts[r.doc_id]) and r.n_chars == len(r.text)


def test_a_part_keeps_the_text_as_it_is(spark):
    text = "x\ny\tz  \nq r\n"
    df = spark.createDataFrame([(text, k) for k in range(1, 6)], "t string, k int")
    got = {r.k: r.p for r in df.select("k", M.leading_words(F.col("t"), F.col("k")).alias("p")).collect()}
    assert got == {1: "x", 2: "x\ny", 3: "x\ny\tz", 4: "x\ny\tz  \nq", 5: "x\ny\tz  \nq r"}


def test_documents_follow_the_plan(spark):
    """Every document comes whole as often as its plan says, and the boundary document in part."""
    rows = [(i, " ".join(f"d{i}w{j}" for j in range(1 + i * 13 % 40)), f"s{i % 4}" if i % 7 else None) for i in range(300)] + [(7, "a b c", "s1")] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for cut in (True, False):
        words = {}
        for r in M.mixed_documents(df, cut=cut).collect():
            words.setdefault(r.doc_id, []).append(len(r.text.split()))
        plan = {}
        for r in M.mix(df).collect():
            part = r.part if cut else (r.size if 2 * r.part >= r.size else 0)
            plan.setdefault(r.doc_id, []).extend([r.size] * r.whole + ([part] if part else []))
        assert {i: sorted(w) for i, w in words.items()} == {i: sorted(w) for i, w in plan.items() if w}


def test_very_long_text(spark):
    df = spark.createDataFrame([(1, "w " * 400_000, "s"), (2, "a b", "s")], "doc_id long, text string, source string")
    got = {r.doc_id: r.size for r in M.mix(df).collect()}
    assert got == {1: 400_000, 2: 2}
