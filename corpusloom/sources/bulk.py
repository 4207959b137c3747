"""Sinks of JSON lines as a Python data source: partitions written apart, counts and digests in the commit, batch and stream.

Every task writes one file under a name of its own attempt and tells its rows, bytes and digest; the commit
checks them and writes one sidecar with their totals, and whatever has no sidecar was never committed. A task that
fails takes its file away, and so does an aborted job. Rows are the lines of a column named ``line``.
The folder is one that driver and executors share, a path or a URI that Arrow's file systems know.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamWriter, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

NAME = "json_lines_bulk"
SIDECAR = ".meta.json"


def _files(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), path)


@dataclass
class Written(WriterCommitMessage):
    path: str
    rows: int
    bytes: int
    sha256: str


def _write(folder: str, lines: Iterator) -> Written:
    path = f"{folder}/part-{uuid.uuid4().hex}.ndjson"
    system, own = _files(path)
    system.create_dir(own.rsplit("/", 1)[0], recursive=True)
    digest, rows, size = hashlib.sha256(), 0, 0
    try:
        with system.open_output_stream(own, compression=None) as out:
            for row in lines:
                data = row["line"].encode() + b"\n"
                out.write(data)
                digest.update(data)
                rows, size = rows + 1, size + len(data)
    except BaseException:
        system.delete_file(own)
        raise
    return Written(path, rows, size, digest.hexdigest())


def _drop(messages: list) -> None:
    for m in messages:
        if m is not None:
            system, own = _files(m.path)
            system.delete_file(own)


def _commit(folder: str, name: str, messages: list[Written]) -> None:
    for m in messages:
        system, own = _files(m.path)
        if system.get_file_info(own).size != m.bytes:
            raise ValueError(f"{m.path} isn't what its task has written")
    system, own = _files(f"{folder}/{name}{SIDECAR}")
    parts = sorted((m.path.rsplit("/", 1)[1], m.rows, m.bytes, m.sha256) for m in messages)
    told = {"rows": sum(p[1] for p in parts), "bytes": sum(p[2] for p in parts), "parts": [dict(zip(("file", "rows", "bytes", "sha256"), p)) for p in parts]}
    system.create_dir(own.rsplit("/", 1)[0], recursive=True)
    with system.open_output_stream(own + ".new", compression=None) as out:
        out.write(json.dumps(told, indent=2).encode())
    system.move(own + ".new", own)


class _Batch(DataSourceWriter):
    def __init__(self, folder: str) -> None:
        self.folder, self.name = folder, f"batch-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator) -> Written:
        return _write(self.folder, iterator)

    def commit(self, messages: list) -> None:
        _commit(self.folder, self.name, messages)

    def abort(self, messages: list) -> None:
        _drop(messages)


class _Stream(DataSourceStreamWriter):
    """A sidecar for each micro-batch; one that is written again replaces its sidecar."""

    def __init__(self, folder: str) -> None:
        self.folder = folder

    def write(self, iterator: Iterator) -> Written:
        return _write(self.folder, iterator)

    def commit(self, messages: list, batchId: int) -> None:  # noqa: N803
        _commit(self.folder, f"stream-{batchId:010d}", messages)

    def abort(self, messages: list, batchId: int) -> None:  # noqa: N803
        _drop(messages)


class JsonLinesBulk(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return "line string"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _Batch(self.options["path"])

    def streamWriter(self, schema: StructType, overwrite: bool) -> DataSourceStreamWriter:  # noqa: N802
        return _Stream(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(JsonLinesBulk)


def index_action(index: str, id_column: str, row: Column) -> Column:
    """An action line and a document line, one after the other."""
    action = F.to_json(F.struct(F.struct(F.lit(index).alias("_index"), F.col(id_column).alias("_id")).alias("index")))
    return F.concat_ws("\n", action, F.to_json(row))


def write_bulk(rows: DataFrame, folder: str, index: str, id_column: str) -> None:
    """Rows as bulk lines in partitioned files with a sidecar; a row's two lines stay together."""
    register(rows.sparkSession)
    rows.select(index_action(index, id_column, F.struct("*")).alias("line")).write.format(NAME).mode("append").save(folder)


def committed(spark: SparkSession, folder: str) -> DataFrame:
    """file, rows, bytes, sha256 of every committed part below ``folder``."""
    sidecars = spark.read.option("multiLine", True).schema("parts array<struct<file:string,rows:long,bytes:long,sha256:string>>").json(f"{folder}/*{SIDECAR}")
    return sidecars.select(F.explode("parts").alias("p")).select("p.*")


def read_back(spark: SparkSession, folder: str) -> DataFrame:
    """The lines of committed parts, each checked against the digest in its sidecar."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.ndjson").load(folder)
    both = raw.withColumn("file", F.element_at(F.split("path", "/"), -1)).join(committed(spark, folder), "file")
    good = F.when(F.assert_true(F.sha2("content", 256) == F.col("sha256"), F.concat(F.col("file"), F.lit(" has changed"))).isNull(), F.col("content").cast("string"))
    return both.select("file", F.explode(F.filter(F.split(good, "\n"), lambda x: x != "")).alias("line"))


def with_sidecars(files: DataFrame, sources: DataFrame) -> DataFrame:
    """A sidecar for each fetched file (stem, path, content): source_id, urls, digest and bytes as JSON; a source without a file is a row with its error."""
    own = sources.join(files.select("stem", "path", "content"), sources["source_id"] == F.col("stem"), "left")
    told = F.struct("source_id", "source_url", "download_url", F.sha2("content", 256).alias("sha256"), F.octet_length("content").alias("bytes"))
    ok = F.col("path").isNotNull()
    return own.select(
        "source_id", F.when(ok, F.concat("path", F.lit(SIDECAR))).alias("sidecar"), ok.alias("ok"), F.when(ok, F.to_json(told)).alias("meta"), F.when(~ok, F.concat(F.lit("no file for "), F.col("source_id"))).alias("error")
    )
