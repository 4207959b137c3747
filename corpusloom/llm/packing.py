"""Packing documents into sequences of fixed length: cutting stock by column generation.

1. Tasks turn each whole text into token ids and cut them into full pieces of ``capacity`` and
   one tail. Only piece lengths and checksums leave the tasks.
2. Lengths are rounded up to classes of ``unit`` tokens; the histogram over classes (at most
   ``capacity / unit`` rows, whatever the corpus) goes to the driver, where the linear program
   over patterns is solved: a knapsack dynamic program prices columns with the duals, one column
   enters per round, until no column has a reduced cost. Patterns are rounded down; what is left
   (fewer sequences than there are classes) is filled first-fit decreasing.
3. Pieces are ranked inside their class (counts of hash buckets give each bucket its first rank,
   so a hot class is ranked in many tasks) and the rank decides pattern copy and sequence.

Defined cases: a null or empty text is the end id alone; repeated rows are pieces of their own;
an empty table gives no row. Padding is what the rounding to ``unit`` and the last patterns leave.
"""

from __future__ import annotations

import json
import math
import re
import struct
import zlib
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.tasks import by_bytes, tidy
from corpusloom.storage import materialize

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
#: A space between white space and white space (or the end) is no sure token boundary.
_RAGGED = re.compile(r"(?<=\s) (?!\S)")
_BEFORE_WORD = re.compile(r"(?= \S)")


class PieceIds(dict):
    """Ids of a text's parts as little-endian 32-bit bytes, kept for the parts met last.

    The pre-tokenizer always cuts before a space that a visible character follows, so the ids of
    a text are the ids of its parts cut there. Two generations of at most ``most`` parts bound it:
    when the young one is full it becomes the old one, and parts met again move back.

    Where the same vocabulary is given as ranks, a text without special tokens is encoded whole by it
    (equal ids, and less work than to look up its parts). In other texts a part with a special token
    goes to the tokenizer itself, which is not read before.
    """

    def __init__(self, path: str, ranks_path: str | None = None, most: int = 100_000, longest: int = 48):
        super().__init__()
        self.path, self.specials = path, _added_tokens(path)
        self.ranks = _ranked(ranks_path) if ranks_path else None
        self.most, self.longest, self.old = most, longest, {}

    @cached_property
    def tokenizer(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def __missing__(self, part: str) -> bytes:
        ids = self.old.get(part)
        if ids is None:
            ids = struct.pack(f"<{len(own)}I", *own) if (own := self.encode(part)) else b""
        if len(part) <= self.longest:
            if len(self) >= self.most:
                self.old = dict(self)
                self.clear()
            self[part] = ids
        return ids

    def encode(self, part: str) -> list[int]:
        if self.ranks is None or any(s in part for s in self.specials):
            return self.tokenizer.encode(part, add_special_tokens=False).ids
        return self.ranks.encode_ordinary(part)

    def of(self, text: str) -> bytes:
        if not text:
            return b""
        if self.ranks is not None and not any(s in text for s in self.specials):
            return self.ranks.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False).tobytes()
        if _RAGGED.search(text):
            return b"".join([self[p] for p in _BEFORE_WORD.split(text) if p])
        head, *rest = text.split(" ")
        return (self[head] if head else b"") + b"".join([self[" " + p] for p in rest])


def _added_tokens(path: str) -> list[str]:
    """The special tokens that a tokenizer file names, without reading the rest of it as JSON."""
    with open(path, encoding="utf-8") as file:
        text = file.read()
    mark = '"added_tokens":'
    at = text.find(mark)
    if at < 0:
        return []
    return [t["content"] for t in json.JSONDecoder().raw_decode(text[at + len(mark) :].lstrip())[0]]


def _ranked(path: str):
    import base64

    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_pieces(docs: DataFrame, tokenizer_path: str, ranks_path: str | None = None, capacity: int = 2048, end_id: int = 1) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens: full pieces and the tail of every document."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids = PieceIds(tokenizer_path, ranks_path)
        end = int(end_id).to_bytes(4, "little")
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"].tolist(), batch["text"].tolist(), strict=True):
                raw = ids.of(text or "") + end
                total = len(raw) // 4
                for start in range(0, total, capacity):
                    piece = raw[4 * start : 4 * (start + capacity)]
                    rows.append((doc_id, start, len(piece) // 4, zlib.crc32(piece), total))
            out = pd.DataFrame(rows, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])
            yield out.astype({"doc_id": "Int64"})

    return by_bytes(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).mapInPandas(tidy(run), PIECES)


def knapsack(values: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The best value of items (any number of each) in the capacity, and the counts that reach it."""
    best, pick = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    fits = np.searchsorted(sizes, np.arange(capacity + 1), side="right").tolist()
    for room in range(1, capacity + 1):
        fit = fits[room]
        best[room] = best[room - 1]
        if fit:
            gain = best[room - sizes[:fit]] + values[:fit]
            top = int(gain.argmax())
            if gain[top] > best[room] + 1e-12:
                best[room], pick[room] = gain[top], top
    counts, room = np.zeros(len(sizes), dtype=np.int64), capacity
    while room > 0:
        if pick[room] < 0:
            room -= 1
        else:
            counts[pick[room]] += 1
            room -= sizes[pick[room]]
    return float(best[capacity]), counts


def inverted(matrix: np.ndarray) -> np.ndarray:
    """Gauss-Jordan with row exchanges; a few hundred rows, without a threaded library call."""
    m = len(matrix)
    work = np.hstack([matrix.astype(float), np.eye(m)])
    for i in range(m):
        top = i + int(np.abs(work[i:, i]).argmax())
        if top != i:
            work[[i, top]] = work[[top, i]]
        work[i] /= work[i, i]
        factor = work[:, i].copy()
        factor[i] = 0
        hit = np.flatnonzero(factor)
        work[hit] -= factor[hit, None] * work[i]
    return work[:, m:]


def column_generation(sizes: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = 2000, gap: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (a column each) and how often the linear program's last basis uses them.

    sizes ascending, each at most capacity. Any basis covers the demand, so stopping after
    ``rounds`` pivots costs padding only.
    """
    m = len(sizes)
    basis = np.diag((capacity // sizes).astype(float))
    inverse = np.diag(1.0 / np.diag(basis))
    for step in range(rounds):
        if step % 200 == 199:
            inverse = inverted(basis)
        duals = inverse.sum(axis=0)
        value, column = knapsack(duals, sizes, capacity)
        if value <= 1 + gap:  # Farley's bound: the optimum is at least the present value / value
            break
        x, u = (inverse * demand).sum(axis=1), (inverse * column).sum(axis=1)
        ratio = np.full(m, np.inf)
        up = u > 1e-9
        ratio[up] = np.maximum(x[up], 0) / u[up]
        out = int(ratio.argmin())
        basis[:, out] = column
        row = inverse[out] / u[out]
        inverse -= np.outer(u, row)
        inverse[out] = row
    return basis.astype(np.int64), (inverted(basis) * demand).sum(axis=1)


def plan_patterns(histogram: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """(pattern: count by size, copies) that use up the histogram exactly."""
    if not histogram:
        return []
    sizes = np.array(sorted(histogram), dtype=np.int64)
    demand = np.array([histogram[s] for s in sizes.tolist()], dtype=np.int64)
    columns, x = column_generation(sizes, demand.astype(float), capacity)
    left, plan = demand.copy(), []
    for j in np.argsort(-x).tolist():
        used = columns[:, j] > 0
        copies = int(min(np.floor(x[j] + 1e-6), (left[used] // columns[used, j]).min()))
        if copies > 0:
            left = left - copies * columns[:, j]
            plan.append(({int(s): int(a) for s, a in zip(sizes[used], columns[used, j], strict=True)}, copies))
    # the rest, first-fit decreasing
    open_rooms: list[tuple[int, dict[int, int]]] = []
    for i in range(len(sizes) - 1, -1, -1):
        size = int(sizes[i])
        for _ in range(int(left[i])):
            for k, (room, pattern) in enumerate(open_rooms):
                if room >= size:
                    pattern[size] = pattern.get(size, 0) + 1
                    open_rooms[k] = (room - size, pattern)
                    break
            else:
                open_rooms.append((capacity - size, {size: 1}))
    return plan + [(pattern, 1) for _, pattern in open_rooms]


def pack_pieces(pieces: DataFrame, capacity: int = 2048, unit: int = 16, buckets: int = 1024) -> DataFrame:
    """Adds sequence_id and offset to pieces."""
    spark = pieces.sparkSession
    unit = math.gcd(unit, capacity)  # classes have to add up to the capacity
    # a piece's bucket is its place in its task, written with it, so that equal rows don't meet in one bucket
    kept = materialize(pieces.withColumn("_b", F.pmod(F.monotonically_increasing_id(), F.lit(buckets)).cast("int")), "pack-pieces")
    order = ["doc_id", "start", "ids_crc32", "length"]
    rows = kept.withColumn("_c", F.ceil(F.col("length") / unit).cast("int"))
    counts = rows.groupBy("_c", "_b").agg(F.count("*").alias("_n"))
    histogram = {r["_c"]: r["n"] for r in counts.groupBy("_c").agg(F.sum("_n").alias("n")).collect()}
    slots, sequence = [], 0
    used: dict[int, int] = {}
    for pattern, copies in plan_patterns(histogram, capacity // unit):
        for size, each in pattern.items():
            first = used.get(size, 0)
            slots.append((size, first, first + each * copies, each, sequence))
            used[size] = first + each * copies
        sequence += copies
    table = spark.createDataFrame(slots, "_c int, _from long, _to long, _each long, _sequence long")
    before = Window.partitionBy("_c").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0).cast("long"))).drop("_n")
    inside = Window.partitionBy("_c", "_b").orderBy(*order)
    ranked = (
        rows.join(starts, ["_c", "_b"])
        .withColumn("_rank", F.col("_before") + F.row_number().over(inside) - 1)
        .drop("_before", "_b")
    )
    # at most (classes x patterns) rows, whatever the corpus
    placed = ranked.join(
        F.broadcast(table), (ranked["_c"] == table["_c"]) & (F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_to"))
    ).withColumn("sequence_id", F.col("_sequence") + F.floor((F.col("_rank") - F.col("_from")) / F.col("_each")).cast("long"))
    along = Window.partitionBy("sequence_id").orderBy(F.desc("length"), *order).rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(along), F.lit(0).cast("long"))).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"
    )


def pack(docs: DataFrame, tokenizer_path: str, ranks_path: str | None = None, capacity: int = 2048, unit: int = 16, end_id: int = 1) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    return pack_pieces(token_pieces(docs, tokenizer_path, ranks_path, capacity, end_id), capacity, unit)
