import hashlib
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom.llm import fill_middle
from corpusloom.llm.queries import op13_fill_middle

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def brute(doc_id, text, unit="token"):
    text = text or ""
    h = hashlib.sha256(f"42:{'null' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[i : i + 8], 16) for i in range(0, 32, 8)]
    units = UNIT.findall(text) if unit == "token" else list(text)
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return n, "plain", None, None, text
    if h[3] % 100 < 80:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


ODD = ["", " ", "\t\n ", "a", " a", "a ", " a b  ", "é", "日本 語　x", "😀 a😀\u0085b c", "x<P>y", "<S", "a <M> b", "<", "<P", "\x00 \x1f z\x0b\x0c", "é   k", "ab " * 5]


def test_against_brute_force(spark):
    rows = [(i, ODD[i % len(ODD)] * (1 + i // len(ODD) % 3)) for i in range(2000)] + [(None, "a b é"), (7, None), (7, "twice"), (7, "twice")]
    rows += [(5000 + i, "wörter 漢字 and plain text\n" * 20_000) for i in range(6)] + [(6000 + i, "ü" * 300_000) for i in range(3)]
    docs = spark.createDataFrame([(i, t, "x", 1, b"") for i, t in rows], "doc_id long, text string, form string, n int, output binary")
    for unit in ("token", "char"):
        out = fill_middle.fill_middle(docs, unit=unit).withColumn("back", fill_middle.restored(F.col("output"), F.col("form")))
        got = sorted((r.doc_id if r.doc_id is not None else -1, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.back) for r in out.collect())
        want = sorted((i if i is not None else -1, *brute(i, t, unit), t or "") for i, t in rows)
        assert len(got) == len(want)
        assert all(g == w for g, w in zip(got, want))
        assert {g[2] for g in got} == {"plain", "spm", "psm"}


def test_empty_table(spark):
    assert fill_middle.fill_middle(spark.createDataFrame([], "doc_id string, text string")).collect() == []


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab \n\tßé€漢😀　")))
def test_exception_index(text):
    raw = text.encode()
    data = np.frombuffer(raw, dtype=np.uint8)
    index = fill_middle.Exceptions.of(data)
    assert len(index.excess) == sum(ord(c) > 127 for c in text)
    points = np.arange(len(text) + 1)
    places = np.array([len(text[:i].encode()) for i in points])
    assert (index.bytes(points) == places).all() and (index.chars(places) == points).all()
    ends = fill_middle.token_ends(data)
    assert [raw[a:b].decode() for a, b in zip([0, *ends[:-1]], ends)] == UNIT.findall(text)


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    text = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    got = op13_fill_middle(spark, sf).collect()
    assert len(got) == len(text)
    for r in got:
        n, form, p, m, out = brute(r.doc_id, text[r.doc_id])
        assert (r.n, r.form, r.prefix_chars, r.middle_chars) == (n, form, p, m)
        assert r.output_sha256 == hashlib.sha256(out.encode()).hexdigest() and r.restored_sha256 == hashlib.sha256(text[r.doc_id].encode()).hexdigest()
