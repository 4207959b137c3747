"""Quality classifier: a byte-level convolutional network in numpy.

A filter is a table of one weight per byte and place (a convolution over one-hot bytes). Filters
run over the whole text with ``STRIDE``; their greatest value in every chunk of ``BLOCK * SPAN``
positions (chunks overlap by one block and cover the whole document) goes through a small hidden
layer to a chunk score, and the greatest and the mean chunk score make the document's probability.

Learning takes a bounded sample of labelled rows, whole texts by the least seeded hashes of doc_id: at
most ``Limits.rows`` of them and ``Limits.bytes`` together (a text that would go beyond is passed
over), in ``Limits.steps`` gradient steps whatever their number. Scoring reads every byte. Memory of a task is bounded
by ``SEGMENT`` positions, whatever the length of a text.

Defined cases: a null text is empty and scores as a chunk of padding; rows without a usable label
don't teach, and of rows with one doc_id the shortest does; without two classes every score is the
share of label 1 (0.5 if there are no labels); repeated rows are scored each; an empty table gives no row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.tasks import by_bytes, tidy

WIDTH, STRIDE, FILTERS, HIDDEN = 6, 2, 24, 12
BLOCK, SPAN = 32, 8
CHUNK_BYTES = BLOCK * SPAN * STRIDE
HOP_BYTES = BLOCK * (SPAN - 1) * STRIDE
SEGMENT = 16_384
#: Chunks convolved at a time in learning.
SLICE = 512


@dataclass(frozen=True)
class Limits:
    """Bounds of what learning takes: labelled rows, bytes of their texts, gradient steps."""

    rows: int = 4_000
    bytes: int = 12_000_000
    steps: int = 1_200
    batch: int = 48


def chunk_starts(size: int) -> range:
    """Byte offsets of the chunks that cover a text of ``size`` bytes."""
    return range(0, max(size - (CHUNK_BYTES - HOP_BYTES), 1), HOP_BYTES)


class Network:
    def __init__(self, rng: np.random.Generator):
        self.p = {
            "t": rng.normal(0, 0.25, (WIDTH, 256, FILTERS)).astype(np.float32),
            "tb": np.zeros(FILTERS, dtype=np.float32),
            "u": rng.normal(0, np.sqrt(2 / FILTERS), (FILTERS, HIDDEN)).astype(np.float32),
            "ub": np.zeros(HIDDEN, dtype=np.float32),
            "v": rng.normal(0, np.sqrt(1 / HIDDEN), HIDDEN).astype(np.float32),
            "o": np.array([1.0, 0.5, 0.0], dtype=np.float32),  # greatest, mean, bias
        }

    def convolve(self, data: np.ndarray, positions: int) -> np.ndarray:
        """Filter values at every STRIDE-th byte; data holds WIDTH - 1 bytes more than the positions need."""
        t = self.p["t"]
        out = t[0].take(data[: positions * STRIDE : STRIDE], axis=0)
        for j in range(1, WIDTH):
            out += t[j].take(data[j : j + positions * STRIDE : STRIDE], axis=0)
        return out

    def block_peaks(self, data: np.ndarray) -> np.ndarray:
        """The greatest filter values of every block of a text (padded with zero bytes)."""
        blocks = max(1, -(-len(data) // (BLOCK * STRIDE)))
        padded = np.zeros(blocks * BLOCK * STRIDE + WIDTH, dtype=np.uint8)
        padded[: len(data)] = data
        peaks = []
        for at in range(0, blocks * BLOCK, SEGMENT):
            n = min(SEGMENT, blocks * BLOCK - at)
            peaks.append(self.convolve(padded[at * STRIDE :], n).reshape(-1, BLOCK, FILTERS).max(axis=1))
        return np.concatenate(peaks) + self.p["tb"]

    def head(self, peaks: np.ndarray) -> np.ndarray:
        return np.maximum(np.maximum(peaks, 0) @ self.p["u"] + self.p["ub"], 0) @ self.p["v"]

    def score(self, text: str | None) -> float:
        data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), dtype=np.uint8)
        peaks = self.block_peaks(data)
        starts = [s // (BLOCK * STRIDE) for s in chunk_starts(len(data))]
        chunks = np.stack([peaks[s : s + SPAN].max(axis=0) for s in starts])
        s = self.head(chunks)
        o = self.p["o"]
        return float(1 / (1 + np.exp(-np.clip(o[0] * s.max() + o[1] * s.mean() + o[2], -30, 30))))

    def fit(self, docs: list[np.ndarray], y: np.ndarray, steps: int, batch: int, rng: np.random.Generator, rate: float = 0.004) -> None:
        """docs: (chunks, CHUNK_BYTES + WIDTH) bytes of each; y: 1 for the class the probability stands for. Adam."""
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        s2 = {k: np.zeros_like(v) for k, v in self.p.items()}
        step = 0
        positions = BLOCK * SPAN
        while step < steps:
            order = rng.permutation(len(docs))
            for at in range(0, len(order), batch):
                pace = rate * (1 - 0.9 * step / steps)
                rows = order[at : at + batch]
                data = np.concatenate([docs[i] for i in rows])
                sizes = np.array([len(docs[i]) for i in rows])
                starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
                found = []
                for part in np.split(data, range(SLICE, len(data), SLICE)):  # a long text doesn't take more memory
                    conv = self.p["t"][0].take(part[:, : positions * STRIDE : STRIDE], axis=0)
                    for j in range(1, WIDTH):
                        conv += self.p["t"][j].take(part[:, j : j + positions * STRIDE : STRIDE], axis=0)
                    top = conv.argmax(axis=1)
                    found.append((top, np.take_along_axis(conv, top[:, None, :], axis=1)[:, 0]))
                where = np.concatenate([w for w, _ in found])
                peaks = np.concatenate([v for _, v in found]) + self.p["tb"]
                act = np.maximum(peaks, 0)
                pre = act @ self.p["u"] + self.p["ub"]
                hid = np.maximum(pre, 0)
                s = hid @ self.p["v"]
                top = np.array([a + int(s[a : a + n].argmax()) for a, n in zip(starts, sizes, strict=True)])
                mean = np.add.reduceat(s, starts) / sizes
                o = self.p["o"]
                z = o[0] * s[top] + o[1] * mean + o[2]
                g = ((1 / (1 + np.exp(-np.clip(z, -30, 30)))) - y[rows]) / len(rows)
                grad = {"o": np.array([(g * s[top]).sum(), (g * mean).sum(), g.sum()], dtype=np.float32)}
                gs = np.repeat(g * o[1] / sizes, sizes)
                gs[top] += g * o[0]
                grad["v"] = hid.T @ gs
                gh = gs[:, None] * self.p["v"] * (pre > 0)
                grad["u"], grad["ub"] = act.T @ gh, gh.sum(axis=0)
                ga = (gh @ self.p["u"].T) * (peaks > 0)
                grad["tb"] = ga.sum(axis=0)
                gt = np.zeros((WIDTH, 256 * FILTERS), dtype=np.float32)
                chunk = np.arange(len(data))[:, None]
                for j in range(WIDTH):
                    flat = data[chunk, where * STRIDE + j].astype(np.int64) * FILTERS + np.arange(FILTERS)
                    gt[j] = np.bincount(flat.ravel(), ga.ravel(), 256 * FILTERS)
                grad["t"] = gt.reshape(WIDTH, 256, FILTERS) + 1e-5 * self.p["t"]
                step += 1
                for k, v in grad.items():
                    m[k] = 0.9 * m[k] + 0.1 * v
                    s2[k] = 0.99 * s2[k] + 0.01 * v * v
                    change = pace * (m[k] / (1 - 0.9**step)) / (np.sqrt(s2[k] / (1 - 0.99**step)) + 1e-8)
                    self.p[k] = (self.p[k] - change).astype(np.float32)


def chunks_of(text: str) -> np.ndarray:
    """All chunks of a text, a row each, with the bytes that the last positions need beyond."""
    data = text.encode("utf-8", "surrogatepass")
    starts = chunk_starts(len(data))
    padded = np.frombuffer(data.ljust(starts[-1] + CHUNK_BYTES + WIDTH, b"\0"), dtype=np.uint8)
    return np.stack([padded[s : s + CHUNK_BYTES + WIDTH] for s in starts])


@dataclass
class Model:
    network: Network | None
    share: float

    def of(self, texts: list[str | None]) -> np.ndarray:
        """Probability of label 1."""
        if self.network is None:
            return np.full(len(texts), self.share)
        return np.array([1 - self.network.score(t) for t in texts])


def learn(docs: DataFrame, labels: DataFrame, limits: Limits | None = None, seed: int = 5) -> Model:
    """A model from labelled rows; hand in only the labels that may teach."""
    limits = limits or Limits()
    own = labels.select(F.col("doc_id").cast("long").alias("id"), F.col("quality").cast("int").alias("y")).where("id is not null and y in (0, 1)")
    own = own.groupBy("id").agg(F.max("y").alias("y")).withColumn("h", F.xxhash64(F.col("id"), F.lit(23)))
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    sized = texts.select("id", F.octet_length("text").alias("size")).join(own, "id")
    chosen, room = [], limits.bytes
    for r in sized.orderBy("h", "id", "size").limit(limits.rows).collect():
        if r["size"] <= room:
            chosen.append((r["id"], r["y"]))
            room -= r["size"]
    if len({y for _, y in chosen}) < 2:
        return Model(None, sum(y for _, y in chosen) / len(chosen) if chosen else 0.5)
    named = docs.sparkSession.createDataFrame(sorted(set(chosen)), "id long, y int")
    # of rows with one id, those of the least size taken above
    rows = texts.join(F.broadcast(named), "id").groupBy("id", "y").agg(F.min_by("text", F.struct(F.octet_length("text"), F.xxhash64("text"))).alias("text")).toPandas().sort_values("id")
    data = [chunks_of(t) for t in rows["text"]]
    rng = np.random.default_rng(seed)
    network = Network(rng)
    network.fit(data, 1 - rows["y"].to_numpy(np.float32), limits.steps, limits.batch, rng)
    return Model(network, float(rows["y"].mean()))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every whole text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "score": model.of(batch["text"].tolist())})

    return by_bytes(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).mapInPandas(tidy(run), "doc_id long, score double")
