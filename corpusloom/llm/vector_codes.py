"""Vector code compression: product codes by k-means that skips distances through Drake-Hamerly bounds.

Vectors of integers are cut into equal parts, and each part position has a codebook. A part's state
persists between rounds: its entry, its ``b`` next closest entries in the order of their lower bounds,
and one outer bound for all other entries. When entries move, each bound falls by its entry's move and
the outer one by the largest move. A part whose entry, at its new distance, is nearer than every bound
keeps it unseen. Otherwise the entries whose bounds reach it are verified in integers, and only where
the outer bound reaches it are all entries measured. ``b`` adapts to each batch: it falls to what nearly
all of its parts needed, and doubles where many reached the outer bound.

Bounds are kept as 16-bit multiples of a row's step, rounded down, so they may be too low but never too
high; every assignment that they don't settle is decided by integer distances, ties to the lower index.
So codes are those of plain k-means.

Defined cases: rows whose vector is null or holds null or non-finite components are left out; a row
without an id starts codebooks last and has its code; rows of one id start by their vectors; with
fewer rows than entries a codebook has as many entries as rows; vectors of other lengths, empty
ones too, count as padded with zeros to the longest, rounded up to whole parts; an entry without parts
stays; equal entries leave the later one unused. Components are exact up to 2^28 / sqrt(width of a
part) after scaling and are held at that beyond it. Further columns are left out.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.hot_join import with_groups
from corpusloom.storage import materialize

#: Bounds kept at first, at least and at most.
START_B, LEAST_B, MOST_B = 4, 2, 16

#: b falls to what this share of a batch's parts needed; it doubles where more than GROW of them reached the outer bound.
ENOUGH, GROW = 0.95, 0.25

_TOP = 65535  # a bound without limit: no entries are left behind it
_UP = 1 + 1e-9


class Plan(NamedTuple):
    """How vectors are cut: parts, components of a part, number type of a stored vector."""

    parts: int
    width: int
    kind: str


class State(NamedTuple):
    """Of n parts: entries (n, 1 + b), the own one first; lower bounds (n, b + 1), the outer one last."""

    near: np.ndarray
    low: np.ndarray


def distances(v: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances of parts (n, width) to entries (k, width)."""
    most = max(int(np.abs(v).max(initial=0)), int(np.abs(entries).max(initial=0)))
    if 4 * most * most * max(v.shape[1], 1) < 2**52:  # whole numbers that doubles hold
        a, e = v.astype(np.float64), entries.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2 * (a @ e.T) + (e * e).sum(1)).astype(np.int64)
    return np.stack([((v - e) ** 2).sum(1) for e in entries], axis=1)


def measured(d: np.ndarray, b: int) -> tuple[np.ndarray, State]:
    """Squared distances to the nearest entry, and the state, from the distances to all."""
    n, k = d.shape
    b = min(b, k - 1)
    own = d.argmin(1)  # the first of equal ones
    error = d[np.arange(n), own]
    rest = np.sqrt(d)
    rest[np.arange(n), own] = np.inf
    order = np.argpartition(rest, b, axis=1)[:, : b + 1] if b + 1 < k else np.argsort(rest, axis=1)[:, : b + 1]
    low = np.take_along_axis(rest, order, 1)
    by = np.argsort(low, axis=1, kind="stable")
    order, low = np.take_along_axis(order, by, 1), np.take_along_axis(low, by, 1)
    if b + 1 >= k:  # nothing is left outside
        low[:, b:] = np.inf
    return error, State(np.column_stack([own, order[:, :b]]), low)


def reassigned(v: np.ndarray, state: State, entries: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, State, np.ndarray]:
    """Squared distances and states after the entries' moves, and how many bounds each part needed (b + 1: the outer one)."""
    near, low = state.near.copy(), state.low.copy()
    n, b = len(near), near.shape[1] - 1
    low[:, :b] -= moves[near[:, 1:]]
    low[:, b] -= moves.max(initial=0)
    error = ((v - entries[near[:, 0]]) ** 2).sum(1)
    reach = np.sqrt(error) * _UP
    open_ = low[:, :b] <= reach[:, None]
    outer = low[:, b] <= reach
    need = np.where(outer, b + 1, open_.sum(1))
    some = np.flatnonzero(~outer & open_.any(1))
    if len(some):
        # verify in integers the entries whose bounds reach the own distance
        at, slot = np.nonzero(open_[some])
        row = some[at]
        entry = near[row, slot + 1]
        d = ((v[row] - entries[entry]) ** 2).sum(1)
        low[row, slot] = np.sqrt(d)
        order = np.lexsort((entry, d, row))
        first = order[np.append(True, np.diff(row[order]) > 0)] if len(order) else order
        r, e, best, s = row[first], entry[first], d[first], slot[first]
        own = near[r, 0]
        wins = (best < error[r]) | ((best == error[r]) & (e < own))
        r, e, best, s, own = r[wins], e[wins], best[wins], s[wins], own[wins]
        near[r, 0], near[r, s + 1], low[r, s] = e, own, np.sqrt(error[r])
        error[r] = best
    if outer.any():
        full = np.flatnonzero(outer)
        error[full], fresh = measured(distances(v[full], entries), b)
        near[full], low[full] = fresh
    by = np.argsort(low[:, :b], axis=1, kind="stable")
    near[:, 1:], low[:, :b] = np.take_along_axis(near[:, 1:], by, 1), np.take_along_axis(low[:, :b], by, 1)
    return error, State(near, low), need


def narrowed(state: State, b: int) -> State:
    """The state with at most b bounds; the outer one covers the entries let go."""
    had = state.near.shape[1] - 1
    if b >= had:
        return state
    outer = state.low[:, b:].min(1)
    return State(state.near[:, : b + 1], np.column_stack([state.low[:, :b], outer]))


def adapted(need: np.ndarray, b: int) -> int:
    """The next b, from what the parts of a batch needed."""
    if (need > b).mean() > GROW:
        return min(2 * b, MOST_B)
    return max(LEAST_B, min(b, int(np.quantile(np.minimum(need, b), ENOUGH, method="higher"))))


def packed(states: list[State]) -> tuple[list[bytes], list[bytes], np.ndarray]:
    """near and low as bytes for each row, and the rows' steps; one state for each part position."""
    near = np.stack([s.near for s in states], axis=1).astype(np.uint8)
    low = np.maximum(np.stack([s.low for s in states], axis=1), 0)
    top = np.where(np.isfinite(low), low, 0).max(axis=(1, 2), initial=0)
    step = np.where(top > 0, top / 65000, 1.0)
    whole = np.where(np.isfinite(low), np.floor(low / step[:, None, None] / _UP), _TOP).astype(np.uint16)
    return [x.tobytes() for x in near], [x.tobytes() for x in whole], step


def unpacked(near: list[bytes], low: list[bytes], step: np.ndarray, parts: int) -> list[State]:
    """The states of rows that keep one number of bounds."""
    e = np.frombuffer(b"".join(near), dtype=np.uint8).reshape(len(near), parts, -1).astype(np.int64)
    whole = np.frombuffer(b"".join(low), dtype=np.uint16).reshape(e.shape)
    bounds = np.where(whole == _TOP, np.inf, whole * (step[:, None, None] / _UP))
    return [State(e[:, p], bounds[:, p]) for p in range(parts)]


def usable(vectors: DataFrame, scale: int) -> DataFrame:
    """vec_id, label, v: floor(scale * component) of the rows that take part."""
    x = F.transform("embedding", lambda c: c.cast("double"))
    bad = F.exists("embedding", lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == F.lit(float("inf"))))
    whole = lambda c: F.floor(F.greatest(F.least(c * scale, F.lit(2.0**28)), F.lit(-(2.0**28))))
    return vectors.where(F.col("embedding").isNotNull() & ~F.coalesce(bad, F.lit(True))).select(F.col("vec_id").cast("long").alias("vec_id"), "label", F.transform(x, whole).alias("v"))


def _matrix(vs: list, plan: Plan) -> np.ndarray:
    most = math.isqrt(2**56 // max(plan.width, 1))
    out = np.zeros((len(vs), plan.parts * plan.width), dtype=np.int64)
    for i, x in enumerate(vs):
        out[i, : len(x)] = x
    return np.clip(out, -most, most).reshape(len(vs), plan.parts, plan.width)


def _vectors(raw: pd.Series, plan: Plan) -> np.ndarray:
    return np.frombuffer(b"".join(raw), dtype=plan.kind).reshape(len(raw), plan.parts, plan.width).astype(np.int64)


_STATE = "vec_id long, label {}, v binary, near binary, low binary, step double"


def _first(rows: DataFrame, plan: Plan, books: np.ndarray, kind: str) -> DataFrame:
    """All distances of all parts, once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            v = _matrix(batch["v"].tolist(), plan)
            states = [measured(distances(v[:, p], books[p]), START_B)[1] for p in range(plan.parts)]
            near, low, step = packed(states)
            own = [x.tobytes() for x in v.astype(plan.kind)]
            yield pd.DataFrame({"vec_id": batch["vec_id"], "label": batch["label"], "v": own, "near": near, "low": low, "step": step})

    return rows.mapInPandas(run, _STATE.format(kind))


def _alike(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows that keep one number of bounds."""
    for batch in batches:
        for _, rows in batch.groupby(batch["near"].map(len), sort=True):
            yield rows


def _again(state: DataFrame, plan: Plan, books: np.ndarray, moves: np.ndarray, kind: str) -> DataFrame:
    """States after a move of the entries, with b adapted to what each batch needed."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in _alike(batches):
            v = _vectors(rows["v"], plan)
            states = unpacked(rows["near"].tolist(), rows["low"].tolist(), rows["step"].to_numpy(), plan.parts)
            done = [reassigned(v[:, p], states[p], books[p], moves[p]) for p in range(plan.parts)]
            had = states[0].near.shape[1] - 1
            b = min(adapted(np.concatenate([d[2] for d in done]), had), books.shape[1] - 1) if had else 0
            if b > had:
                new = [measured(distances(v[:, p], books[p]), b)[1] for p in range(plan.parts)]
            else:
                new = [narrowed(d[1], b) for d in done]
            near, low, step = packed(new)
            yield pd.DataFrame({"vec_id": rows["vec_id"], "label": rows["label"], "v": rows["v"], "near": near, "low": low, "step": step})

    return state.mapInPandas(run, _STATE.format(kind))


def _coded(state: DataFrame, plan: Plan, books: np.ndarray, moves: np.ndarray, kind: str) -> DataFrame:
    """vec_id, label, code, error after the last move."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in _alike(batches):
            v = _vectors(rows["v"], plan)
            states = unpacked(rows["near"].tolist(), rows["low"].tolist(), rows["step"].to_numpy(), plan.parts)
            done = [reassigned(v[:, p], states[p], books[p], moves[p]) for p in range(plan.parts)]
            code = np.stack([d[1].near[:, 0] for d in done], axis=1).astype(np.uint8)
            yield pd.DataFrame({"vec_id": rows["vec_id"], "label": rows["label"], "code": [x.tobytes().hex() for x in code], "error": sum(d[0] for d in done)})

    return state.mapInPandas(run, f"vec_id long, label {kind}, code string, error long")


def _moved(state: DataFrame, plan: Plan, books: np.ndarray) -> np.ndarray:
    """Entries replaced by the floor of their parts' mean; sums are made in each task and then by key."""
    k = books.shape[1]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((plan.parts, k, plan.width + 1), dtype=np.int64)
        for rows in _alike(batches):
            v = _vectors(rows["v"], plan)
            e = np.frombuffer(b"".join(rows["near"]), dtype=np.uint8).reshape(len(rows), plan.parts, -1)[:, :, 0]
            for p in range(plan.parts):
                np.add.at(total[p], e[:, p], np.column_stack([v[:, p], np.ones(len(rows), dtype=np.int64)]))
        p, j = np.nonzero(total[:, :, -1])
        if len(p):
            yield pd.DataFrame({"part": p, "entry": j, "sums": list(total[p, j])})

    sums = state.select("v", "near").mapInPandas(run, "part int, entry int, sums array<long>")
    each = sums.select("part", "entry", F.posexplode("sums").alias("at", "x")).groupBy("part", "entry", "at").agg(F.sum("x").alias("x"))
    out = np.zeros((plan.parts, k, plan.width + 1), dtype=np.int64)
    for r in each.collect():  # at most entries x (components + parts) numbers
        out[r.part, r.entry, r["at"]] = r.x
    count = out[:, :, -1:]
    return np.where(count > 0, out[:, :, :-1] // np.maximum(count, 1), books)


def compress(vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256) -> tuple[DataFrame, np.ndarray]:
    """vec_id, label, code, error, label_error of every row that takes part; and the codebooks (part, entry, component)."""
    if not 1 <= entries <= 256:
        raise ValueError("a code's digits hold 256 entries")
    rows = usable(vectors, scale)
    size = F.size("v")
    n, dims, most = rows.agg(F.count("*"), F.max(size), F.max(F.array_max(F.transform("v", F.abs)))).first()
    kind = vectors.schema["label"].dataType.simpleString()
    width = max(1, -(-(dims or 0) // parts))
    plan = Plan(parts, width, "int16" if (most or 0) < 2**15 else "int32")
    if not n:
        empty = rows.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"))
        return empty.where(F.lit(False)), np.zeros((parts, 0, width), dtype=np.int64)
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).collect()
    books = np.ascontiguousarray(_matrix([r.v for r in first], plan).transpose(1, 0, 2))
    state = materialize(_first(rows, plan, books, kind), "codes-state", "zstd")
    for i in range(rounds):
        new = _moved(state, plan, books)
        moves = np.sqrt(((new - books).astype(np.float64) ** 2).sum(2)) * _UP
        books = new
        if i + 1 < rounds:
            state = materialize(_again(state, plan, books, moves, kind), "codes-state", "zstd")
    if not rounds:
        moves = np.zeros(books.shape[:2])
    coded = materialize(_coded(state, plan, books, moves, kind), "codes", "zstd").withColumn("_label", F.struct("label"))
    sums = coded.groupBy("_label").agg(F.sum("error").alias("label_error"), F.count("*").alias("_count"))
    out = with_groups(coded, sums, "_label", "_count", n, ["label_error"])
    return out.select("vec_id", "label", "code", "error", "label_error"), books


def digest(books: np.ndarray) -> str:
    """SHA-256 of all components in decimal, by part, entry and place, joined by commas."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
