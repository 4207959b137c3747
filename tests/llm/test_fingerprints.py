import hashlib
import random

import xxhash
from pyspark.sql import functions as F

from corpusloom.llm import fingerprints as P

S = "doc_id long, text string, fingerprint string"
MASK = (1 << 64) - 1


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def h_long(v, seed):
    return signed(xxhash.xxh64_intdigest((v & MASK).to_bytes(8, "little"), seed & MASK))


def brute(text, bins=P.BINS, bits=P.BITS):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", low) if w]
    hw = [signed(xxhash.xxh64_intdigest(w.encode(), 42)) for w in words]
    if not hw:
        return []

    def chain(vs):
        s = 42
        for v in vs:
            s = h_long(v, s)
        return s

    if len(hw) < 5:
        a = 0
        for w in hw:
            a = chain([a, w])
        hs = [a]
    else:
        hs = [chain(hw[i : i + 5]) for i in range(len(hw) - 4)]
    least = {}
    for h in sorted(hs):
        least.setdefault((h & MASK) >> (64 - (bins.bit_length() - 1)), h % (1 << bits))
    out = []
    for i in range(bins):
        if i in least:
            out.append(least[i])
            continue
        for a in range(P.DRAWS):
            d = P.draw(i, a, bins)
            if d in least:
                out.append(least[d])
                break
        else:
            ranked = min((signed(xxhash.xxh64_intdigest(k.to_bytes(4, "little"), signed(xxhash.xxh64_intdigest(i.to_bytes(4, "little"), 42)) & MASK)), k) for k in least)
            out.append(least[ranked[1]])
    return out


def test_bins_against_brute_force(spark):
    rng = random.Random(1)
    texts = ["", "  ", "one", "One two", "a b c d e", "x " * 500, "É ü ß 😀 z", " ".join(rng.choice("abcdefghij") * rng.randint(1, 4) for _ in range(900))]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: [b & 15 for b in r.b] for r in df.select("i", P.fingerprint_bins(F.col("t")).alias("b")).collect()}
    assert [got[i] for i in range(len(texts))] == [brute(t) for t in texts]


def test_edited_text_and_successor(spark):
    rng = random.Random(2)
    rows = [(i * 3, "".join(rng.choice("ab c\n😀") for _ in range(rng.randint(0, 60))), "clash") for i in range(90)] + [(1000, None, None)]
    got = {r.doc_id: r for r in P.edited_pairs(spark.createDataFrame(rows[::-1], S).repartition(5), 7).collect()}
    text = [t or "" for _, t, _ in rows]
    for k, (i, _, _) in enumerate(rows):
        own, nxt = text[k], text[(k + 1) % len(rows)]
        half = len(own) // 2
        edited = own[: len(own) - half] + nxt[:half]
        assert got[i].n_chars == len(own) and got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert got[i].fingerprint == "".join(f"{b:x}" for b in brute(own)) and got[i].edited_fingerprint == "".join(f"{b:x}" for b in brute(edited))
        assert 0 <= got[i].near_edited <= 1 and 0 <= got[i].near_next <= 1


def test_likeness_follows_similarity(spark):
    words = [f"w{i}" for i in range(1000)]
    a, b, c = " ".join(words), " ".join(words[:500] + [f"v{i}" for i in range(500)]), " ".join(f"u{i}" for i in range(1000))
    r = spark.createDataFrame([(a, b, c)], "a string, b string, c string").select(*[P.fingerprint_bins(F.col(x)).alias(x) for x in "abc"])
    r = r.select(P.likeness(F.col("a"), F.col("a")).alias("aa"), P.likeness(F.col("a"), F.col("b")).alias("ab"), P.likeness(F.col("a"), F.col("c")).alias("ac")).first()
    assert r.aa == 1.0 and abs(r.ab - 1 / 3) < 0.12 and r.ac < 0.1


def test_few_rows(spark):
    assert P.edited_pairs(spark.createDataFrame([], S)).count() == 0
    one = P.edited_pairs(spark.createDataFrame([(5, "a b c d e f", "")], S)).first()
    assert one.near_next == 1.0 and one.doc_id == 5
    many = spark.createDataFrame([(1, "b", ""), (1, "a", ""), (1, "a", ""), (2, "c", ""), (None, "z", "")], S)
    assert P.edited_pairs(many, 3).count() == 5


def test_the_last_row_is_followed_by_the_first(spark):
    from corpusloom.llm.fingerprints import with_next

    for rows in ([(None, "a"), (None, "b"), (None, "c")], [(None, "b"), (None, "c"), (3, "m"), (1, "a")], [(5, "a")]):
        got = {r.v: r.next_v for r in with_next(spark.createDataFrame(rows, "doc_id long, text string"), F.col("text"), 4).collect()}
        order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        assert got == {order[i][1]: order[(i + 1) % len(order)][1] for i in range(len(order))}
