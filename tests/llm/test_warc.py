import gzip
import hashlib
import json
import os
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from corpusloom.llm import warc
from corpusloom.llm.queries import op12_warc

S = "page_id long, url string, html string"


def brute(rows, least=1000):
    top = defaultdict(list)
    for i, _, h in rows:
        top[h or ""].append(-1 if i is None else i)
    out = []
    for i, _, h in rows:
        raw = (h or "").encode()
        big = max(top[h or ""])
        big = None if big == -1 else big
        again = len(raw) >= least and i != big
        out.append((i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if again else "response", big if again else None))
    return sorted(out, key=str)


def back(normal, payload=True):
    return warc.read_records(warc.read_index(normal), payload)


def rows_of(df):
    return sorted(map(tuple, df.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str)


def test_against_brute_force(spark):
    rows = [(i, f"http://x/{i}", "p%d " % (i % 40) * (200 + i % 40)) for i in range(300)]
    rows += [(1000 + i, "http://hot/", "the same page " * 100) for i in range(200)]  # a hot payload
    rows += [(2000, None, None), (2001, "", ""), (2002, "http://é x\r\nEvil: 1", "é" * 499 + "ab"), (2003, "u", "é" * 499 + "ab"), (2004, "u", "a" * 999), (2005, "u", "a" * 999)]
    rows += [(None, "u", "n" * 1500), (5, "u", "n" * 1500), (None, "u", "m" * 1500), (None, "u", "m" * 1500), (7777, "u", "r" * 1200), (7777, "u", "r" * 1200), (7776, "u", "r" * 1200)]
    rows += [(3000, "u", "\r\n\r\nWARC/1.1\r\n" * 200), (3001, "u", "long " * 1_000_000), (3002, "v", "long " * 1_000_000)]
    df = spark.createDataFrame([(*r, "x", 1, b"") for r in rows], S + ", payload string, record_type int, archive binary").repartition(3)
    normal = warc.archive_pages(df, size=200_000)
    out = back(normal)
    assert rows_of(out) == brute(rows)
    texts = {(r.page_id, r.payload_digest): r.payload for r in out.where("record_type = 'response'").collect()}
    assert all(texts[i, hashlib.sha1((h or "").encode()).hexdigest()] == (h or "").encode() for i, _, h in rows if (i, hashlib.sha1((h or "").encode()).hexdigest()) in texts)
    assert out.where("record_type = 'revisit' and payload is not null").count() == 0
    assert out.where("page_id = 2002").first().target == "http://%C3%A9%20x%0D%0AEvil:%201"
    assert normal.count() > 3 and normal.where("error is not null").count() == 0
    assert rows_of(back(normal, payload=False)) == brute(rows)


def test_members_and_sidecar(spark):
    """Every line of the sidecar is a member that inflates by itself; together they are the file; the monolith is one member."""
    df = spark.createDataFrame([(i, f"http://x/{i}", f"page {i} " * 50) for i in range(20)], S).coalesce(1)
    root = warc.folder(spark, "t")
    files = warc.write_archives(warc.decide(df), root + "/a")
    path = files.first().archive
    stream = warc.Inflated(open(path, "rb"))
    whole = b"".join(iter(lambda: stream.until(b"\r\n\r\n") or b"", b""))
    assert whole == gzip.open(path).read() and open(path, "rb").read().count(b"\x1f\x8b\x08") == 1
    made = warc.normalise(files, root + "/b").first()
    data = open(made.archive, "rb").read()
    lines = [json.loads(x) for x in open(made.sidecar)]
    at, text = 0, b""
    for line in lines:
        assert line["offset"] == at
        text += gzip.decompress(data[at : at + line["length"]])
        at += line["length"]
    assert at == len(data) == made.bytes and text == whole and len(lines) == made.records == 21
    assert lines[3]["record_id"] == "<urn:page:2:" + hashlib.sha1(b"page 2 " * 50).hexdigest() + ">"
    again = warc.normalise(spark.createDataFrame([(made.archive,)], "archive string"), root + "/c").first()  # members in, members out
    assert gzip.open(again.archive).read() == whole


def test_damage_is_a_row(spark):
    df = spark.createDataFrame([(i, f"http://x/{i}", f"page {i} " * 5000) for i in range(20)], S).repartition(2)
    root = warc.folder(spark, "t")
    files = warc.write_archives(warc.decide(df), root + "/a")
    first, second = (r.archive for r in files.collect())
    os.truncate(first, os.path.getsize(first) * 2 // 3)
    bad = root + "/a/bad.warc.gz"
    with gzip.open(bad, "wb") as f:
        f.write(b"HTTP/1.1 200\r\n\r\n")
    made = warc.normalise(spark.createDataFrame([(first,), (second,), (bad,)], "archive string"), root + "/b")
    assert sorted(r.error is None for r in made.collect()) == [False, False, True]
    got = back(made).count()
    assert 10 <= got < 20


def test_wrong_payload_raises():
    head, http = warc.page_record(type("R", (), {"page_id": 1, "url": "u", "payload_bytes": 3, "payload_digest": hashlib.sha1(b"abc").hexdigest(), "record_type": "response", "refers_to": None}))
    assert warc.parse_record(head + http + b"abc\r\n\r\n")[-1] == b"abc"
    with pytest.raises(ValueError):
        warc.parse_record(head + http + b"abd\r\n\r\n")


def test_empty_table(spark):
    normal = warc.archive_pages(spark.createDataFrame([], S))
    assert normal.count() == 0 and back(normal).count() == 0


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url", "html").collect()]
    assert rows_of(op12_warc(spark, sf)) == brute(rows)
    assert op12_warc(spark, sf).where(F.col("record_type").isNull()).count() == 0
