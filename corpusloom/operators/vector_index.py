"""Approximate cosine search by an inverted file: coarse centroids, a list for every row, probes of the nearest lists.

Centroids are fitted on a bounded sample (at most ``SAMPLE`` rows, those of the least hash of their id); every
row of the table is then assigned to its nearest centroid, and lists are kept as blocks of bounded size,
so a list that holds a third of all rows is many blocks. ``fitted`` also measures on the sample how many
lists have to be probed for the recall asked for. A search assigns each query to its nearest lists and
scores query blocks against blocks of those lists only; inside a list scores are exact.

``retrieve.cosine_search`` is the exact way. Vectors without a direction (null, of no or zero length, with a
component that is null or no finite number) are in no list and are never found; queries without one find nothing.
Vectors of another length than the sample's most frequent one are in no list either.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.storage import materialize

#: Rows of the sample, its queries for measuring recall, rows of a block, queries of a block.
SAMPLE, ASKED, BLOCK, QUERY_BLOCK = 20_000, 400, 4096, 512


class Coarse(NamedTuple):
    """Unit centroids (lists, dims), and how many lists a query probes."""

    centroids: np.ndarray
    probes: int


class VectorIndex(NamedTuple):
    coarse: Coarse
    blocks: DataFrame


def units(vectors: list, dims: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors as rows, and which of the given ones they are; with ``dims``, those of that length."""
    rows, at = [], []
    for i, v in enumerate(vectors):
        if v is None or not len(v) or (dims is not None and len(v) != dims):
            continue
        x = np.array([np.nan if c is None else c for c in v], dtype=np.float64)
        size = math.sqrt(float(x @ x)) if np.isfinite(x).all() else 0.0
        if size > 0 and math.isfinite(size):
            rows.append(x / size)
            at.append(i)
    return np.array(rows).reshape(len(rows), -1 if rows else dims or 0), np.array(at, dtype=np.int64)


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 3) -> np.ndarray:
    """k unit centroids; an empty one takes the row that its own centroid explains least."""
    rng = np.random.default_rng(seed)
    c = x[np.sort(rng.choice(len(x), k, replace=False))]
    for _ in range(rounds):
        score = x @ c.T
        own = score.argmax(1)
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        empty = np.flatnonzero(np.bincount(own, minlength=k) == 0)
        if len(empty):
            sums[empty] = x[np.argsort(score.max(1))[: len(empty)]]
        size = np.sqrt((sums * sums).sum(1, keepdims=True))
        c = np.where(size > 0, sums / np.maximum(size, 1e-300), c)
    return c


def probes_needed(x: np.ndarray, c: np.ndarray, k: int, recall: float) -> int:
    """The least number of lists with which the sample's own queries find that share of their k nearest."""
    lists = (x @ c.T).argmax(1)
    step = max(1, len(x) // ASKED)
    places = []
    for i in range(0, len(x), step):
        near = x @ x[i]
        near[i] = -np.inf
        best = np.argpartition(-near, min(k, len(x) - 1) - 1)[: min(k, len(x) - 1)]
        order = np.empty(len(c), dtype=np.int64)
        order[np.argsort(-(c @ x[i]), kind="stable")] = np.arange(len(c))
        places.append(order[lists[best]])
    told = np.sort(np.concatenate(places)) if places else np.zeros(1, dtype=np.int64)
    return int(told[min(len(told) - 1, math.ceil(recall * len(told)) - 1)]) + 1


def fitted(vectors: DataFrame, k: int = 10, recall: float = 0.96, sample: int = SAMPLE) -> Coarse:
    """Centroids and probes from the sample; about the root of its rows in lists, at most 1,024."""
    rows = vectors.where("vec_id is not null and embedding is not null").orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("embedding").collect()
    lengths = pd.Series([len(r.embedding) for r in rows if len(r.embedding)])
    dims = int(lengths.mode()[0]) if len(lengths) else 0
    x, _ = units([r.embedding for r in rows], dims)
    if not len(x):
        return Coarse(np.zeros((0, dims)), 0)
    n = max(1, min(1024, round(math.sqrt(len(x)))))
    c = spherical_kmeans(x, n)
    return Coarse(c, probes_needed(x, c, k, recall) if len(x) > 1 else 1)


def _packed(keys: str):
    """Rows of (list, salt, vec_id, mat) in order of list and salt as blocks of one list."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: pd.DataFrame | None = None
        for batch in batches:
            rows = batch if held is None else pd.concat([held, batch], ignore_index=True)
            key = list(zip(rows["list"], rows["salt"], strict=True))
            last = key[-1]
            open_ = np.array([x == last for x in key])
            held = rows[open_]
            yield _blocks(rows[~open_])
        if held is not None:
            yield _blocks(held)

    def _blocks(rows: pd.DataFrame) -> pd.DataFrame:
        out = [(lst, np.array(own["vec_id"], dtype=np.int64).tobytes(), b"".join(own["mat"])) for (lst, _), own in rows.groupby(["list", "salt"], sort=False)]
        return pd.DataFrame(out, columns=["list", f"{keys}ids", f"{keys}mat"])

    return run


def _listed(vectors: DataFrame, coarse: Coarse, probes: int) -> DataFrame:
    """list, vec_id, mat (unit vector, doubles): every row with a direction in its ``probes`` nearest lists."""
    c = coarse.centroids

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x, at = units(batch["embedding"].tolist(), c.shape[1])
            if not len(x) or not len(c):
                continue
            near = np.argsort(-(x @ c.T), axis=1, kind="stable")[:, :probes]
            ids = batch["vec_id"].to_numpy(dtype=np.int64)[at]
            yield pd.DataFrame({"list": near.ravel(), "vec_id": np.repeat(ids, near.shape[1]), "mat": [v for v in map(np.ndarray.tobytes, x) for _ in range(near.shape[1])]})

    rows = vectors.where("vec_id is not null").select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    return rows.mapInPandas(run, "list int, vec_id long, mat binary")


def _in_blocks(listed: DataFrame, size: int, keys: str) -> DataFrame:
    """Lists dealt into blocks of about ``size`` rows, however many rows a list has."""
    counts = listed.groupBy("list").agg(F.count("*").alias("n"))  # a row a list, at most 1,024
    salted = listed.join(F.broadcast(counts), "list").withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.ceil(F.col("n") / size)).cast("int"))
    dealt = salted.repartition("list", "salt").sortWithinPartitions("list", "salt", "vec_id")
    return dealt.select("list", "salt", "vec_id", "mat").mapInPandas(_packed(keys), f"list int, {keys}ids binary, {keys}mat binary")


def build(vectors: DataFrame, k: int = 10, recall: float = 0.96, sample: int = SAMPLE) -> VectorIndex:
    """The index of every row of vectors (vec_id, embedding)."""
    coarse = fitted(vectors, k, recall, sample)
    listed = materialize(_listed(vectors, coarse, 1), "vector-lists")
    return VectorIndex(coarse, materialize(_in_blocks(listed, BLOCK, ""), "vector-blocks"))


def search(index: VectorIndex, queries: DataFrame, k: int) -> DataFrame:
    """query_id, vec_id, score, rank (from 0) by cosine, among the lists that a query probes; a query is not its own neighbour."""
    dims = index.coarse.centroids.shape[1]
    asked = _in_blocks(materialize(_listed(queries, index.coarse, index.coarse.probes), "vector-probes"), QUERY_BLOCK, "q_")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                q_ids, ids = np.frombuffer(r.q_ids, dtype=np.int64), np.frombuffer(r.ids, dtype=np.int64)
                scores = np.frombuffer(r.q_mat).reshape(-1, dims) @ np.frombuffer(r.mat).reshape(-1, dims).T
                scores = np.sign(scores) * np.floor(np.abs(scores) * 1e6 + 0.5) / 1e6
                for me, own in zip(q_ids, scores, strict=True):
                    other = np.flatnonzero(ids != me)
                    best = other[np.lexsort((ids[other], -own[other]))[:k]]
                    yield pd.DataFrame({"query_id": np.full(len(best), me), "vec_id": ids[best], "score": own[best]})

    hits = index.blocks.join(asked, "list").select("ids", "mat", "q_ids", "q_mat").mapInPandas(run, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).withColumn("rank", F.col("rank") - 1)


def recall_at_k(found: DataFrame, exact: DataFrame) -> DataFrame:
    """query_id, n_exact, n_found, recall: the share of the exact hits (with a score) that the search has found."""
    known = exact.where(~F.isnan("score")).select("query_id", "vec_id").withColumn("_exact", F.lit(1))
    both = known.join(found.select("query_id", "vec_id").withColumn("_found", F.lit(1)), ["query_id", "vec_id"], "left")
    return both.groupBy("query_id").agg(F.sum("_exact").alias("n_exact"), F.coalesce(F.sum("_found"), F.lit(0)).alias("n_found")).withColumn("recall", F.col("n_found") / F.col("n_exact"))
