"""WARC archives: written as monolithic gzip, normalised to a member a record with an offset index, read back by it.

* ``decide`` tells responses from revisits: of rows with equal payloads of enough bytes the one with
  the largest page_id is the response, the others revisit it. Only hashes cross a shuffle for that.
* ``write_archives`` lets every task write its rows as archives of bounded size, each one gzip stream
  over the whole file, as many tools make them. A revisit holds the HTTP header and no payload.
* ``normalise`` inflates such a stream once, in pieces, writes every record again as a gzip member of
  its own, and a sidecar of JSON lines with offset, length, id, type, target and digest of each.
* ``read_index`` and ``read_records`` turn sidecars into rows, and rows into records, each by a seek.

Files have names of their own for every attempt of a task, and only those that the returned tables list
are read, so a lost or repeated task leaves at most a file that nobody reads. Tables of files are
materialized as soon as the files are written.

Defined cases: a null payload is an empty one; rows of one page_id and payload are repeats of one
record, with one id, and are all of one type; a null page_id is below all others, and a response without
one is referred to by null; null urls leave the target out, and characters that may not stand in a
header are percent-encoded; an empty table writes no archive; very long payloads pass in pieces, but
for the one that is being read back. A damaged archive yields the records in front of the damage
and a row with its error; the others go on.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain
from urllib.parse import quote

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.hot_join import with_groups
from corpusloom.storage import folder, materialize

#: Bytes of records after which a task begins another archive, and bytes inflated at a time.
ARCHIVE, PIECE = 1 << 26, 1 << 20

#: The capture date written where none is known.
DATE = "2000-01-01T00:00:00Z"

_FILES = "archive string, records long, bytes long"
_MADE = "archive string, sidecar string, records long, bytes long, error string"
_INDEX = "archive string, offset long, length long, record_id string, record_type string, target string, payload_digest string"
_RECORD = "archive string, offset long, record_type string, record_id string, page_id long, target string, payload_bytes long, payload_digest string, refers_to long, payload binary"


def _open(path: str):
    """The file system of a path or URI, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), path)


def decide(pages: DataFrame, least: int = 1000) -> DataFrame:
    """page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to of every page."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    told = pages.select(
        F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload"),
        F.sha2(payload, 256).alias("_same"), F.sha1(payload).alias("payload_digest"), F.octet_length(payload).cast("long").alias("payload_bytes"),
    )
    groups = told.where(F.col("payload_bytes") >= least).groupBy("_same").agg(F.max("page_id").alias("_top"), F.count("*").alias("_rows"))
    groups = materialize(groups.where("_rows > 1").withColumn("_held", F.lit(True)), "warc-groups")
    total = int(groups.agg(F.sum("_rows")).first()[0] or 0)
    both = with_groups(told, groups, "_same", "_rows", total, ["_top", "_held"])
    again = F.col("_held") & ~F.col("page_id").eqNullSafe(F.col("_top"))
    kind = F.when(again, "revisit").otherwise("response")
    return both.select("page_id", "url", "payload", "payload_bytes", "payload_digest", kind.alias("record_type"), F.when(again, F.col("_top")).alias("refers_to"))


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}:{digest}>"


def _page_of(record: str) -> int | None:
    own = record.split(":")[2]
    return int(own) if own else None


def record_head(kind: str, body: int, fields: list[tuple[str, str]]) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", *[f"{k}: {v}" for k, v in fields], f"Content-Length: {body}"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode()


def page_record(row, date: str = DATE) -> tuple[bytes, bytes]:
    """WARC header, and the HTTP header that begins its block; a response's payload follows it."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row.payload_bytes}\r\n\r\n".encode()
    fields = [("WARC-Record-ID", record_id(row.page_id, row.payload_digest)), ("WARC-Date", date)]
    if row.url is not None:
        fields.append(("WARC-Target-URI", quote(row.url, safe="%/:=&?~#+!$,;'@()*[]")))
    fields.append(("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(row.payload_digest)).decode()))
    fields.append(("Content-Type", "application/http; msgtype=response"))
    if row.record_type == "revisit":
        fields.append(("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))
        fields.append(("WARC-Refers-To", record_id(row.refers_to, row.payload_digest)))
    body = len(http) + (row.payload_bytes if row.record_type == "response" else 0)
    return record_head(row.record_type, body, fields), http


class _Monolith:
    """An archive under way: one gzip stream over all its records."""

    def __init__(self, root: str, level: int) -> None:
        self.path = f"{root}/{uuid.uuid4().hex}.warc.gz"
        system, own = _open(self.path)
        system.create_dir(own.rsplit("/", 1)[0], recursive=True)
        self.file = system.open_output_stream(own, compression=None)
        self.deflate = zlib.compressobj(level, zlib.DEFLATED, 31)
        self.records = self.size = self.bytes = 0
        about = b"format: WARC File Format 1.1\r\nsoftware: corpusloom\r\n"
        self.put(record_head("warcinfo", len(about), [("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", DATE), ("Content-Type", "application/warc-fields")]), about)

    def put(self, *pieces: bytes) -> None:
        for piece in (*pieces, b"\r\n\r\n"):
            self.size += len(piece)
            self._write(self.deflate.compress(piece))
        self.records += 1

    def _write(self, data: bytes) -> None:
        if data:
            self.bytes += len(data)
            self.file.write(data)

    def close(self) -> tuple[str, int, int]:
        self._write(self.deflate.flush())
        self.file.close()
        return self.path, self.records, self.bytes


def write_archives(decided: DataFrame, root: str, date: str = DATE, size: int = ARCHIVE, level: int = 3) -> DataFrame:
    """Archives below ``root``: archive, records (with the warcinfo record), bytes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        made: list[tuple[str, int, int]] = []
        out = None
        for batch in batches:
            for row in batch.astype({"page_id": "Int64", "refers_to": "Int64"}).astype(object).where(batch.notna(), None).itertuples(index=False):
                if out is None:
                    out = _Monolith(root, level)
                head, http = page_record(row, date)
                out.put(head, http, row.payload if row.record_type == "response" else b"")
                if out.size >= size:
                    made.append(out.close())
                    out = None
        if out is not None:
            made.append(out.close())
        yield pd.DataFrame(made, columns=["archive", "records", "bytes"])

    return materialize(decided.mapInPandas(run, _FILES), "warc-files")


class Inflated:
    """Bytes of a gzip file, one member or many, inflated in pieces."""

    def __init__(self, file) -> None:
        self.file, self.held, self.inflate = file, bytearray(), zlib.decompressobj(31)
        self.raw = b""

    def _more(self) -> bool:
        while True:
            if self.inflate.eof:
                self.raw, self.inflate = self.inflate.unused_data, zlib.decompressobj(31)
                fresh = True
            else:
                fresh = False
            if not self.raw:
                self.raw = self.file.read(PIECE)
            if not self.raw:
                if not fresh and not self.inflate.eof:
                    raise ValueError("the gzip stream ends early")
                return False
            got = self.inflate.decompress(self.raw, PIECE)
            self.raw = self.inflate.unconsumed_tail
            if got:
                self.held += got
                return True

    def until(self, mark: bytes, most: int = 1 << 20) -> bytes | None:
        """All up to and with the mark; None at the end of the file."""
        begin = 0
        while (at := self.held.find(mark, begin)) < 0:
            if len(self.held) > most:
                raise ValueError("a header has no end")
            begin = max(0, len(self.held) - len(mark))
            if not self._more():
                if self.held:
                    raise ValueError("a record ends early")
                return None
        out = bytes(self.held[: at + len(mark)])
        del self.held[: at + len(mark)]
        return out

    def pieces(self, n: int) -> Iterator[bytes]:
        while n:
            if not self.held and not self._more():
                raise ValueError("a record ends early")
            out = bytes(self.held[:n])
            del self.held[:n]
            n -= len(out)
            yield out


def fields_of(head: bytes, first: bytes) -> dict[str, str]:
    """The fields of a header by lower-case name; its first line has to begin as told."""
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not head.startswith(first):
        raise ValueError(f"a header begins with {lines[0][:40]!r}")
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:] if line)}


def _normalise_one(path: str, root: str, level: int) -> tuple[str, str, int, int, str | None]:
    system, own = _open(path)
    out_path = f"{root}/{uuid.uuid4().hex}.warc.gz"
    out_system, out_own = _open(out_path)
    out_system.create_dir(out_own.rsplit("/", 1)[0], recursive=True)
    at = records = 0
    error = None
    with out_system.open_output_stream(out_own, compression=None) as out, out_system.open_output_stream(out_own + ".idx", compression=None) as sidecar:
        try:
            with system.open_input_stream(own, compression=None) as file:
                stream = Inflated(file)
                while (head := stream.until(b"\r\n\r\n")) is not None:
                    told = fields_of(head, b"WARC/1.")
                    member, length = zlib.compressobj(level, zlib.DEFLATED, 31), 0
                    # a member that turns out damaged stays outside the index, and nothing follows it
                    for piece in chain([head], stream.pieces(int(told["content-length"]))):
                        length += out.write(member.compress(piece))
                    if b"".join(stream.pieces(4)) != b"\r\n\r\n":
                        raise ValueError("a record isn't closed")
                    length += out.write(member.compress(b"\r\n\r\n") + member.flush())
                    line = {"offset": at, "length": length, "record_id": told.get("warc-record-id"), "record_type": told.get("warc-type"),
                            "target": told.get("warc-target-uri"), "payload_digest": told.get("warc-payload-digest")}
                    sidecar.write((json.dumps(line) + "\n").encode())
                    at, records = at + length, records + 1
        except (ValueError, KeyError, zlib.error) as e:
            error = f"{type(e).__name__}: {e}"
    return out_path, out_path + ".idx", records, at, error


def _spread(files: DataFrame) -> DataFrame:
    """A task an archive, up to a number that a job can have."""
    return files.repartition(max(1, min(files.count(), 100_000)))


def normalise(files: DataFrame, root: str, level: int = 3) -> DataFrame:
    """archive, sidecar, records, bytes, error: every archive again with a member a record and its index."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([_normalise_one(p, root, level) for p in batch["archive"]], columns=["archive", "sidecar", "records", "bytes", "error"])

    return materialize(_spread(files.select("archive")).mapInPandas(run, _MADE), "warc-normal")


def read_index(normal: DataFrame) -> DataFrame:
    """A row for every record of the archives, from their sidecars."""
    names = ["archive", "offset", "length", "record_id", "record_type", "target", "payload_digest"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for archive, sidecar in zip(batch["archive"], batch["sidecar"]):
                system, own = _open(sidecar)
                with system.open_input_stream(own, compression=None) as file:
                    rows = [json.loads(line) for line in file.read().splitlines()]
                yield pd.DataFrame([{"archive": archive, **r} for r in rows], columns=names)

    return _spread(normal.select("archive", "sidecar")).mapInPandas(run, _INDEX)


def parse_record(raw: bytes) -> tuple:
    """record_type, record_id, page_id, target, payload_bytes, payload_digest, refers_to, payload of an inflated record."""
    end = raw.index(b"\r\n\r\n") + 4
    told = fields_of(raw[:end], b"WARC/1.")
    block = raw[end : end + int(told["content-length"])]
    cut = block.index(b"\r\n\r\n") + 4
    size = int(fields_of(block[:cut], b"HTTP/1.")["content-length"])
    kind, digest = told["warc-type"], base64.b32decode(told["warc-payload-digest"].removeprefix("sha1:")).hex()
    payload = None
    if kind == "response":
        payload = block[cut:]
        if len(payload) != size or hashlib.sha1(payload).hexdigest() != digest:
            raise ValueError(f"{told['warc-record-id']}: the payload isn't what its header says")
    refers = _page_of(told["warc-refers-to"]) if "warc-refers-to" in told else None
    return kind, told["warc-record-id"], _page_of(told["warc-record-id"]), told.get("warc-target-uri"), size, digest, refers, payload


def read_records(index: DataFrame, payload: bool = True) -> DataFrame:
    """The page records that rows of the index name, each read by its offset; payloads are checked against their digests."""
    names = [f.split()[0] for f in _RECORD.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows, size = [], 0
            for archive, own in batch.groupby("archive", sort=False):
                system, path = _open(archive)
                with system.open_input_file(path) as file:
                    for offset, length in zip(own["offset"].tolist(), own["length"].tolist()):
                        file.seek(offset)
                        raw = zlib.decompress(file.read(length), 31)
                        rows.append((archive, offset, *parse_record(raw)))
                        size += len(raw)
                        if not payload:
                            rows[-1] = (*rows[-1][:-1], None)
                        elif size > PIECE << 2:
                            yield _frame(rows, names)
                            rows, size = [], 0
            if rows:
                yield _frame(rows, names)

    pages = index.where(F.col("record_type").isin("response", "revisit")).select("archive", "offset", "length")
    return pages.mapInPandas(run, _RECORD)


def _frame(rows: list[tuple], names: list[str]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=names).astype({"page_id": "Int64", "refers_to": "Int64"})


def archive_pages(pages: DataFrame, least: int = 1000, size: int = ARCHIVE) -> DataFrame:
    """Pages written as monolithic archives, and these normalised: the table of archives and sidecars."""
    spark: SparkSession = pages.sparkSession
    files = write_archives(decide(pages, least), folder(spark, "warc-monolithic"), size=size)
    return normalise(files, folder(spark, "warc-archives"))
