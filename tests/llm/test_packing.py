import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from corpusloom.llm import packing as P

PATH, RANKS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
ODD = ["  a", "a  ", "a \n b", "\n\n  x  y \t z ", " ", "", "a  b  c　 d", "x   \n", "<|endoftext|>  x <|endoftext|> y", "a\x1c b", "tab\t b\t  c", "\u0085 x  y", "don't  stop", "名前 は  何", "x" * 500 + "  y"]


@pytest.mark.parametrize("ranks", [None, RANKS])
def test_ids_equal_the_tokenizer(ranks):
    tok, ids = Tokenizer.from_file(PATH), P.PieceIds(PATH, ranks, most=5)
    for t in ODD * 2:
        assert np.frombuffer(ids.of(t), dtype="<u4").tolist() == tok.encode(t, add_special_tokens=False).ids


def test_a_text_without_special_tokens_is_encoded_whole():
    ids, tok = P.PieceIds(PATH, RANKS), Tokenizer.from_file(PATH)
    text = "words of  a text\n" * 50
    assert np.frombuffer(ids.of(text), dtype="<u4").tolist() == tok.encode(text, add_special_tokens=False).ids
    assert not ids  # no part was looked up
    assert np.frombuffer(ids.of(text + "<|endoftext|> x"), dtype="<u4").tolist() == tok.encode(text + "<|endoftext|> x", add_special_tokens=False).ids


def test_knapsack_against_brute_force():
    sizes, values = np.array([3, 4, 5]), np.array([4.0, 5.5, 7.0])
    best = max(4 * a + 5.5 * b + 7 * c for a in range(6) for b in range(5) for c in range(4) if 3 * a + 4 * b + 5 * c <= 13)
    value, counts = P.knapsack(values, sizes, 13)
    assert value == best and float(counts @ values) == best and int(counts @ sizes) <= 13


def test_plan_uses_up_the_histogram():
    rng = np.random.default_rng(3)
    hist = {int(s): int(n) for s, n in zip(*np.unique(rng.integers(1, 65, 700), return_counts=True))}
    plan = P.plan_patterns(hist, 64)
    used = defaultdict(int)
    for pattern, copies in plan:
        assert sum(s * n for s, n in pattern.items()) <= 64
        for s, n in pattern.items():
            used[s] += n * copies
    assert dict(used) == hist
    assert sum(c for _, c in plan) <= 1.03 * sum(s * n for s, n in hist.items()) / 64 + 1
    assert P.plan_patterns({}, 64) == []


def check(rows, texts, capacity):
    tok = Tokenizer.from_file(PATH)
    by_seq, by_doc = defaultdict(list), defaultdict(list)
    for r in rows:
        by_seq[r.sequence_id].append((r.offset, r.length))
        by_doc[r.doc_id].append(r)
    for parts in by_seq.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    for doc, text in texts.items():
        ids = np.array(tok.encode(text or "", add_special_tokens=False).ids + [1], dtype="<u4")
        at = 0
        for r in sorted(by_doc[doc], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    return len(by_seq)


def test_pieces_and_sequences(spark):
    texts = {i: "word " * (i * 7 % 300) for i in range(120)} | {500: None, 501: "", 502: "long " * 9000}
    df = spark.createDataFrame([(k, v, 1) for k, v in texts.items()], "doc_id long, text string, offset int")
    rows = P.pack(df, PATH, RANKS, capacity=256, unit=8).collect()
    n = check(rows, texts, 256)
    assert n <= 1.06 * sum(r.length for r in rows) / 256 + 2


def test_empty_and_repeated(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert P.pack(none, PATH, RANKS).count() == 0
    twice = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c")], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.length) for r in P.pack(twice, PATH, RANKS).collect()) == [(0, 2), (1, 3), (1, 3)]


def test_capacity_that_the_unit_does_not_divide(spark):
    rows = [(i, 0, n, 7, n) for i, n in enumerate([100, 99, 97, 50, 33, 17, 16, 1, 4, 84] * 3)] + [(None, 0, 1, 7, 1)] * 40
    pieces = spark.createDataFrame(rows, P.PIECES)
    used = defaultdict(list)
    for r in P.pack_pieces(pieces, capacity=100, unit=16).collect():
        used[r.sequence_id].append((r.offset, r.length))
    assert sum(len(v) for v in used.values()) == len(rows)
    for parts in used.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 100
