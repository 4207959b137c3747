"""Exact top-k by integer inner product: columnar branch-and-bound over blocks.

Vectors are packed into blocks with one row of numbers per dimension (vertical layout). A task
takes one block of queries against one block of candidates: it adds up the product dimension
block by dimension block, bounds what the remaining dimensions can still add by the product of
the remaining masses (Cauchy-Schwarz), and keeps only candidates whose upper bound reaches the
k-th best lower bound. Every task returns at most k rows a query; a second step merges them.

Defined cases: vectors that are null or hold null or non-finite components take no part, nor do
rows without an id; shorter vectors count as padded with zeros; a query's own rows are those of
its id; repeated query rows of one id and vector are one query; repeated candidates are
candidates of their own; equal scores go to the smaller id. Sums are exact while they stay under
2^53 (in doubles) and under 2^63 (in 64-bit integers) beyond that.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_BLOCK = "ids binary, dims int, width int, kind string, mat binary"


def usable(vectors: DataFrame, scale: int) -> DataFrame:
    """vec_id, v: floor(scale * component) as integers, of the rows that take part."""
    x = F.transform("embedding", lambda c: c.cast("double"))
    bad = F.exists("embedding", lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == F.lit(float("inf"))))
    return vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~F.coalesce(bad, F.lit(True))).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(c * scale)).alias("v")
    )


def blocks(rows: DataFrame, size: int) -> DataFrame:
    """Rows of each task packed into blocks of at most ``size``, dimensions as rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def packed(ids: list[int], vs: list[np.ndarray]) -> pd.DataFrame:
            dims = max((len(v) for v in vs), default=0)
            mat = np.zeros((len(vs), dims), dtype=np.int64)
            for i, v in enumerate(vs):
                mat[i, : len(v)] = v
            most = int(np.abs(mat).max()) if mat.size else 0
            kind = "int16" if most < 2**15 else "int64"
            own = np.ascontiguousarray(mat.T.astype(kind))
            return pd.DataFrame([(np.asarray(ids, dtype=np.int64).tobytes(), dims, len(vs), kind, own.tobytes())], columns=["ids", "dims", "width", "kind", "mat"])

        ids: list[int] = []
        vs: list[np.ndarray] = []
        for batch in batches:
            ids += batch["vec_id"].tolist()
            vs += batch["v"].tolist()
            while len(ids) >= size:
                yield packed(ids[:size], vs[:size])
                ids, vs = ids[size:], vs[size:]
        if ids:
            yield packed(ids, vs)

    return rows.mapInPandas(run, _BLOCK)


def _unpack(ids: bytes, dims: int, width: int, kind: str, mat: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(ids, dtype=np.int64), np.frombuffer(mat, dtype=kind).reshape(dims, width)


def search_block(q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int, step: int = 16) -> list[tuple[int, int, int, int]]:
    """(query row, query id, candidate id, score): the k best of the block for each query."""
    dims = min(len(q), len(c))
    q, c = q[:dims], c[:dims]
    top = (int(np.abs(q.astype(np.int64)).max(initial=0)) + 1) * (int(np.abs(c.astype(np.int64)).max(initial=0)) + 1) * max(dims, 1)
    number = np.float64 if top < 2**52 else np.int64
    q, c = q.astype(number), np.ascontiguousarray(c.astype(number))
    cuts = list(range(0, dims, step)) + [dims]
    mass = lambda m: np.sqrt(np.array([(m[a:].astype(float) ** 2).sum(axis=0) for a in cuts]))
    q_mass, c_mass = mass(q), mass(c)
    first = q[: cuts[min(1, len(cuts) - 1)]].T @ c[: cuts[min(1, len(cuts) - 1)]]
    out = []
    for i in range(q.shape[1]):
        alive = np.flatnonzero(c_ids != q_ids[i])
        part = first[i][alive]
        for b in range(1, len(cuts) - 1):
            if len(alive) > k:
                # above what rounding can take from masses and, beyond 2^53, from sums
                slack = q_mass[b, i] * c_mass[b][alive] * (1 + 1e-9) + 1 + np.abs(part) * 2.0**-50
                least = np.partition(part - slack, len(alive) - k)[len(alive) - k]
                keep = part + slack >= least
                alive, part = alive[keep], part[keep]
            part = part + q[cuts[b] : cuts[b + 1], i] @ c[cuts[b] : cuts[b + 1]][:, alive]
        best = np.lexsort((c_ids[alive], -part))[:k]
        out += [(i, int(q_ids[i]), int(c_ids[alive[j]]), int(part[j])) for j in best.tolist()]
    return out


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, scale: int = 1024, block: int = 4096, query_block: int = 512) -> DataFrame:
    """query_id, rank, vec_id, score: k best of ``vectors`` for every row of ``queries``."""
    ask = usable(queries, scale).dropDuplicates(["vec_id", "v"])
    q = blocks(ask, query_block).select(*[F.col(x).alias(f"q_{x}") for x in ("ids", "dims", "width", "kind", "mat")])
    c = blocks(usable(vectors, scale), block)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                q_ids, q_mat = _unpack(r.q_ids, r.q_dims, r.q_width, r.q_kind, r.q_mat)
                c_ids, c_mat = _unpack(r.ids, r.dims, r.width, r.kind, r.mat)
                rows = search_block(q_ids, q_mat, c_ids, c_mat, k)
                out = pd.DataFrame(rows, columns=["q_row", "query_id", "vec_id", "score"])
                keys = [zlib.crc32(np.trim_zeros(q_mat[:, i].astype(np.int64), "b").tobytes()) for i in range(len(q_ids))]
                out["q_key"] = [keys[i] for i in out["q_row"]]
                yield out[["query_id", "q_key", "vec_id", "score"]]

    # a stated query set against all rows, block against block
    found = c.crossJoin(q).mapInPandas(run, "query_id long, q_key long, vec_id long, score long")
    best = Window.partitionBy("query_id", "q_key").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best).cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

