import math
import random
from collections import Counter, defaultdict

import pytest

from corpusloom.functions import rules
from corpusloom.operators import bounds, phrases, retrieve

S = "chunk_id long, text string, title string"


def corpus_of(rng, n, common=6, rare=400):
    """Texts of a few very frequent tokens and many rare ones, with repeats; some without any."""
    rows = []
    for i in range(n):
        words = [f"c{rng.randint(0, common)}" for _ in range(rng.randint(0, 30))] + [f"r{int(rng.paretovariate(0.6)) % rare}" for _ in range(rng.randint(0, 25))]
        rng.shuffle(words)
        rows.append((i, " ".join(words) if i % 17 else None, " ".join(words[:3]) or None))
    return rows


def queries_of(rng, n):
    return [(i, " ".join([f"c{rng.randint(0, 6)}" for _ in range(rng.randint(0, 6))] + [f"r{int(rng.paretovariate(0.6)) % 400}" for _ in range(rng.randint(0, 6))])) for i in range(n)]


def brute_bm25(rows, queries, fields, k, k1=1.2, b=0.75):
    parts = defaultdict(float)
    for f, w in fields.items():
        docs = {r[0]: (r[1 if f == "text" else 2] or "").split() for r in rows}
        mean = sum(map(len, docs.values())) / len(docs)
        df = Counter(t for d in docs.values() for t in set(d))
        for qi, q in queries:
            for i, d in docs.items():
                tf = Counter(d)
                score = w * sum(math.log(1 + (len(docs) - df[t] + 0.5) / (df[t] + 0.5)) * tf[t] * (k1 + 1) / (tf[t] + k1 * (1 - b + b * len(d) / mean)) for t in set(q.split()) if t in tf)
                if score:
                    parts[qi, i] = max(parts[qi, i], score)
    out = []
    for qi, _ in queries:
        best = sorted((-round(s, 6), i) for (q, i), s in parts.items() if q == qi)[:k]
        out += [(qi, i, r, -s) for r, (s, i) in enumerate(best)]
    return out


@pytest.mark.parametrize("k", [1, 5, 1000])
def test_bm25_equals_scoring_all(spark, k):
    rng = random.Random(k)
    rows, queries = corpus_of(rng, 300), queries_of(rng, 25)
    got = retrieve.bm25(spark.createDataFrame(rows, S), spark.createDataFrame(queries, "query_id long, text string"), k, {"text": "text", "title": "title"}, {"title": 2.0})
    got = sorted((r.query_id, r["rank"], r.chunk_id, r.score) for r in got.collect())
    want = sorted((q, r, i, s) for q, i, r, s in brute_bm25(rows, queries, {"text": 1.0, "title": 2.0}, k))
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert all(abs(g[3] - w[3]) < 2e-6 for g, w in zip(got, want))
    assert sum(g[2] != w[2] for g, w in zip(got, want)) == 0


def test_frequent_bands_are_left_out(spark):
    """A token that all texts have yields no candidates where rarer ones fill the best."""
    rows = [(i, f"all all2 x{i} " + ("rare " if i % 20 == 0 else ""), "") for i in range(1000)]
    index = bounds.bm25_index(spark.createDataFrame(rows, S), {"text": "text"})
    terms = bounds.asked_terms(spark.createDataFrame([(1, "all all2 rare")], "query_id long, text string"), {"text": 1.0}, True, False)
    pairs = bounds.candidates(index, terms, 5)
    assert 50 == pairs.count()


def test_shares_equal_scoring_all(spark):
    rng = random.Random(3)
    rows, queries = corpus_of(rng, 250), queries_of(rng, 30)
    got = retrieve.keyword_search(spark.createDataFrame(rows, S), spark.createDataFrame(queries, "query_id long, text string"), 7, {"body": "text", "title": "title"})
    got = sorted((r.query_id, r["rank"], r.chunk_id, r.score) for r in got.collect())
    want = []
    for qi, q in queries:
        asked, scored = set(q.split()), []
        for i, text, title in rows:
            n = max(len(asked), 1)
            s = len(asked & set((text or "").split())) / n * 1.0 + len(asked & set((title or "").split())) / n * 2.5
            s += 3.0 if len(q) >= 4 and q in (text or "") else 0.0
            if s:
                scored.append((-s, i))
        want += [(qi, r, i, round(-s, 6)) for r, (s, i) in enumerate(sorted(scored)[:7])]
    assert got == sorted(want)


PHRASES = ["xx数据yy", "数据出境", "出境安全评估", "data flow", "ab c", "数据 出境", "é long", "ababab", "xx", "a1b2", "  Data  FLOW ", "数a据"]
TEXTS = ["axx数据yyb 其他内容", "数据出境安全评估办法", "the data flow here", "data, flow", "cab cd", "数据 出境", "abababab", "", "xa1b2y", "数a据", "dataflow", "xx数据", "É LONG"]


def norm(t):
    import re

    return re.sub("[^一-鿿㐀-䶿A-Za-z0-9]+", " ", t).strip().lower()


@pytest.mark.parametrize("most", [10**6, 0])
def test_phrases_against_plain_search(spark, most):
    rng = random.Random(1)
    texts = TEXTS + ["".join(rng.choice("ab c数据出") for _ in range(rng.randint(0, 60))) for _ in range(200)] + [None]
    asked = PHRASES + ["".join(rng.choice("ab c数据出") for _ in range(rng.randint(2, 7))) for _ in range(100)]
    df = spark.createDataFrame(list(enumerate(texts)), "chunk_id long, text string")
    q = spark.createDataFrame(list(enumerate(asked)), "query_id long, text string")
    got = sorted((r.query_id, r.chunk_id) for r in phrases.phrase_pairs(df, q, "text", most).collect())
    want = sorted((i, j) for i, a in enumerate(asked) for j, t in enumerate(texts) if len(norm(a)) >= rules.PHRASE_LEAST and norm(a) in norm(t or ""))
    assert got == want and (0, 0) in got


def test_a_phrase_without_a_whole_token_counts(spark):
    """Latin runs and the last character of a query can all be parts of longer tokens of the text."""
    df = spark.createDataFrame([(1, "axx数据yyb 其他内容", ""), (2, "xx", "")], S)
    q = spark.createDataFrame([(1, "xx数据yy"), (2, "x数y")], "query_id long, text string")
    got = {(r.query_id, r.chunk_id): r.score for r in retrieve.keyword_search(df, q, 5, {"body": "text"}).collect()}
    assert got[1, 1] == 3.25 and got[1, 2] == 0.25
    plain = retrieve.keyword_search(spark.createDataFrame([(1, "aabcdb", "")], S), spark.createDataFrame([(1, "abcd")], "query_id long, text string"), 5, {"body": "text"}).collect()
    assert [r.score for r in plain] == [3.0]


def test_no_nested_loop(spark):
    df, q = spark.createDataFrame([(1, "a b c", "")], S), spark.createDataFrame([(1, "a b c")], "query_id long, text string")
    plan = retrieve.keyword_search(df, q, 5, {"body": "text"})._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_empty(spark):
    none = spark.createDataFrame([], "query_id long, text string")
    assert retrieve.keyword_search(spark.createDataFrame([], S), none, 5, {"body": "text"}).collect() == []
    assert retrieve.bm25(spark.createDataFrame([(1, "a", "")], S), spark.createDataFrame([(1, "")], "query_id long, text string"), 5).collect() == []
