"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

Learning takes a bounded sample of labelled rows (``Limits.rows``, the least seeded hashes of
doc_id), dealt by hash into ten parts: four for the lexicon, six for the trees and the calibration.
The lexicon holds the words and word beginnings with the highest log-odds in toxic documents, found
by a Spark aggregation over its parts; at most the ``Limits.lexicon`` strongest are kept, and the
model tells how many are not (``left_out``). The trees learn from all of their parts; what calibrates
them are scores of trees that have not met the row (``FOLDS`` further sets of trees, each without
its share of the rows), at every size of the sample. Features of
a text: densities and counts of strong and weak lexicon words, the share of lexicon words near a
second-person word, capitals, punctuation and obfuscation rates, and lengths. Labels, language,
source and doc_id are never features.

Defined cases: a null text is empty and gets a score like any other; rows without a label, a
doc_id or a 0/1 value don't teach; without two classes among the labels, or without a row for the
trees, every score is the share of label 1 (0 if there are no labels); repeated rows are scored each;
an empty table gives no row. Where toxic rows are almost absent, calibrated scores are low and none
may reach 0.5.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.tasks import by_bytes, tidy
from corpusloom.storage import materialize


@dataclass(frozen=True)
class Limits:
    """Bounds of what learning takes: labelled rows, lexicon entries, trees and their depth."""

    rows: int = 12_000
    lexicon: int = 20_000
    trees: int = 80
    depth: int = 3


#: Second-person words of the languages covered.
SECOND_PERSON = frozenset(
    "you your yours yourself du dich dir dein deine ihr euch sie tu te toi ton ta tes vous votre vos tú ti tus usted ustedes vosotros".split()
)
#: Characters written for letters.
DISGUISE = str.maketrans("013457@$!", "oieastasi")
WORD = re.compile(r"[^\W_][\w@$!*'-]*")
PREFIXES = (4, 5, 6)
LEXICON_PARTS, FOLDS = 4, 3
STRONG, WEAK = 4.0, 2.2


def plain(word: str) -> tuple[str, bool]:
    """The word in lower case with disguises undone, and whether there were any."""
    low = word.lower().rstrip("!'-")
    if low.isalpha() or low.isdigit():
        return low, False
    told = low.translate(DISGUISE).replace("*", "").replace("'", "").replace("-", "").replace("_", "")
    return told, told != low and any(c.isalpha() for c in low)


def tokens(text: str) -> set[str]:
    """Words and, marked with ^, beginnings of longer words."""
    out = set()
    for w in set(WORD.findall(text)):
        p, _ = plain(w)
        out.add(p)
        for k in PREFIXES:
            if len(p) > k:
                out.add("^" + p[:k])
    return out


FEATURES = 18


def features(text: str, lexicon: dict[str, float]) -> list[float]:
    words = WORD.findall(text)
    n, chars = max(len(words), 1), max(len(text), 1)
    known: dict[str, tuple[float, bool, bool]] = {}
    strong = weak = hidden = disguised = near = caps = 0
    top = total = 0.0
    kinds = set()
    last_you, waiting = -99, []
    for i, w in enumerate(words):
        got = known.get(w)
        if got is None:
            p, changed = plain(w)
            weight = lexicon.get(p, 0.0)
            for k in PREFIXES:
                if len(p) > k:
                    weight = max(weight, lexicon.get("^" + p[:k], 0.0))
            got = known[w] = (weight, changed, p in SECOND_PERSON)
        weight, changed, you = got
        if changed:
            disguised += 1
        if you:
            near += sum(1 for at in waiting if i - at <= 5)
            waiting.clear()
            last_you = i
        if weight >= WEAK:
            kinds.add(w)
            total += weight
            top = max(top, weight)
            if weight >= STRONG:
                strong += 1
            else:
                weak += 1
            hidden += changed
            if i - last_you <= 5:
                near += 1
            else:
                waiting.append(i)
                if len(waiting) > 8:
                    del waiting[0]
        if len(w) > 1 and w.isupper():
            caps += 1
    hits = strong + weak
    marks = text.count("!")
    return [
        strong,
        strong / n * 1000,
        weak,
        weak / n * 1000,
        top,
        total / n * 100,
        total,
        len(kinds),
        near / max(hits, 1),
        near,
        sum(1 for c in text if c.isupper()) / chars,
        caps / n,
        marks / chars,
        text.count("?") / chars,
        disguised / n,
        hidden,
        float(np.log1p(len(words))),
        sum(1 for c in text if not c.isalnum() and not c.isspace()) / chars,
    ]


class Trees:
    """Boosted regression trees on binned features, log loss, plain numpy."""

    def __init__(self, edges: list[np.ndarray], trees: list[tuple], base: float, steps: tuple[np.ndarray, np.ndarray] | None = None):
        self.edges, self.trees, self.base, self.steps = edges, trees, base, steps

    @staticmethod
    def bins(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(edges)], axis=1).astype(np.int16)

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, trees: int, depth: int, rate: float = 0.15, leaf: float = 1.0, least: int = 5) -> Trees:
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, 33)[1:-1])) for j in range(x.shape[1])]
        extra = [np.unique(x[:, j]) for j in range(x.shape[1])]
        edges = [np.unique(np.concatenate([e, u[:24]])) if len(u) else e for e, u in zip(edges, extra, strict=True)]
        b = cls.bins(x, edges)
        width = max(len(e) for e in edges) + 1
        share = min(max(y.mean(), 1e-3), 1 - 1e-3)
        base = float(np.log(share / (1 - share)))
        score = np.full(len(y), base)
        grown = []
        for _ in range(trees):
            p = 1 / (1 + np.exp(-score))
            g, h = y - p, p * (1 - p)
            nodes = 2 ** (depth + 1) - 1
            feature, cut, value = np.full(nodes, -1), np.zeros(nodes, dtype=np.int64), np.zeros(nodes)
            at = np.zeros(len(y), dtype=np.int64)
            for node in range(nodes):
                rows = np.flatnonzero(at == node)
                if not len(rows):
                    continue
                G, H = g[rows].sum(), h[rows].sum()
                value[node] = rate * G / (H + leaf)
                if node >= 2**depth - 1 or len(rows) < 2 * least:
                    continue
                best = (1e-6, -1, 0)
                for j in range(x.shape[1]):
                    bj = b[rows, j]
                    gl = np.cumsum(np.bincount(bj, g[rows], width))
                    hl = np.cumsum(np.bincount(bj, h[rows], width))
                    nl = np.cumsum(np.bincount(bj, minlength=width))
                    gain = gl**2 / (hl + leaf) + (G - gl) ** 2 / (H - hl + leaf) - G**2 / (H + leaf)
                    gain[(nl < least) | (len(rows) - nl < least)] = 0
                    k = int(gain.argmax())
                    if gain[k] > best[0]:
                        best = (float(gain[k]), j, k)
                if best[1] >= 0:
                    feature[node], cut[node] = best[1], best[2]
                    right = b[rows, best[1]] > best[2]
                    at[rows] = 2 * node + 1 + right
            score += value[at]
            grown.append((feature, cut, value))
        return cls(edges, grown, base)

    def raw(self, x: np.ndarray) -> np.ndarray:
        b = self.bins(x, self.edges)
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, cut, value in self.trees:
            at = np.zeros(len(x), dtype=np.int64)
            while True:
                f = feature[at]
                inner = f >= 0
                if not inner.any():
                    break
                go = b[rows, np.maximum(f, 0)] > cut[at]
                at = np.where(inner, 2 * at + 1 + go, at)
            out += value[at]
        return out

    def calibrate(self, raw: np.ndarray, y: np.ndarray) -> None:
        """Isotonic regression (pool adjacent violators), kept as steps between block centres."""
        order = np.argsort(raw, kind="stable")
        blocks: list[list[float]] = []
        for r, v in zip(raw[order].tolist(), y[order].tolist(), strict=True):
            blocks.append([v, 1.0, r])
            while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
                v2, n2, r2 = blocks.pop()
                blocks[-1] = [blocks[-1][0] + v2, blocks[-1][1] + n2, blocks[-1][2] + r2]
        at = np.array([r / n for _, n, r in blocks])
        level = np.array([v / n for v, n, _ in blocks])
        self.steps = (at, level)

    def score(self, x: np.ndarray) -> np.ndarray:
        raw = self.raw(x)
        if self.steps is None or not len(self.steps[0]):
            return 1 / (1 + np.exp(-raw))
        return np.clip(np.interp(raw, *self.steps), 0.0, 1.0)


@dataclass
class Model:
    lexicon: dict[str, float]
    trees: Trees | None
    share: float
    #: Lexicon entries that the bound has left out.
    left_out: int = 0

    def of(self, texts: list[str | None]) -> np.ndarray:
        if self.trees is None:
            return np.full(len(texts), self.share)
        if not texts:
            return np.zeros(0)
        return self.trees.score(np.array([features(t or "", self.lexicon) for t in texts], dtype=float))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int) -> DataFrame:
    """text, y, part (0..9): at most ``rows`` labelled documents, by the least hashes of doc_id."""
    own = labels.select(F.col("doc_id").cast("long").alias("id"), F.col(label).cast("int").alias("y")).where("id is not null and y in (0, 1)")
    own = own.groupBy("id").agg(F.max("y").alias("y")).withColumn("h", F.xxhash64(F.col("id"), F.lit(17)))
    chosen = own.orderBy("h", "id").limit(rows).withColumn("part", F.pmod(F.shiftright("h", 8), F.lit(10)).cast("int"))
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    return materialize(texts.join(F.broadcast(chosen), "id").select("id", "text", "y", "part"), "labelled-sample")


def learn_lexicon(sample: DataFrame, limit: int) -> tuple[dict[str, float], int]:
    """token: log-odds, of the tokens met in toxic documents far more often than in others; and how many the limit leaves out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(t, y) for text, y in zip(batch["text"].tolist(), batch["y"].tolist(), strict=True) for t in tokens(text)]
            yield pd.DataFrame(rows, columns=["token", "y"])

    totals = sample.agg(F.sum("y").alias("p"), F.count("*").alias("n")).first()
    pos, neg = totals["p"] or 0, (totals["n"] or 0) - (totals["p"] or 0)
    if not pos or not neg:
        return {}, 0
    counts = by_bytes(sample.select("text", "y")).mapInPandas(tidy(run), "token string, y int").groupBy("token").agg(F.sum("y").alias("p"), F.count("*").alias("n"))
    odds = F.log((F.col("p") + 0.25) / (pos + 0.5)) - F.log((F.col("n") - F.col("p") + 0.25) / (neg + 0.5))
    found = materialize(counts.where(F.col("p") >= max(2, round(0.004 * pos))).withColumn("w", odds).where(F.col("w") >= WEAK), "lexicon")
    kept = {r["token"]: float(r["w"]) for r in found.orderBy(F.desc(F.col("w") * F.sqrt("p")), "token").limit(limit).collect()}
    return kept, found.count() - len(kept)


def learn(docs: DataFrame, labels: DataFrame, limits: Limits | None = None) -> Model:
    """A model from labelled rows; hand in only the labels that may teach."""
    limits = limits or Limits()
    sample = labelled_sample(docs, labels, "toxic", limits.rows)
    lexicon, left_out = learn_lexicon(sample.where(F.col("part") < LEXICON_PARTS), limits.lexicon)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = [features(t, lexicon) for t in batch["text"].tolist()]
            yield pd.DataFrame({"id": batch["id"], "x": x, "y": batch["y"], "part": batch["part"]})

    told = sample.agg(F.count("*").alias("n"), F.sum("y").alias("p")).first()
    if not told["p"] or told["p"] == told["n"]:
        return Model({}, None, 1.0 if told["p"] else 0.0)
    rows = sample.where(F.col("part") >= LEXICON_PARTS).mapInPandas(run, "id long, x array<double>, y int, part int").toPandas().sort_values("id")
    if not len(rows):
        return Model({}, None, told["p"] / told["n"])
    x, y = np.stack(rows["x"].to_list()), rows["y"].to_numpy(float)
    trees = Trees.fit(x, y, limits.trees, limits.depth)
    fold, unseen = np.arange(len(y)) % FOLDS, np.zeros(len(y))
    for k in range(FOLDS):
        others = fold != k if (fold != k).any() else fold == k
        unseen[fold == k] = Trees.fit(x[others], y[others], limits.trees, limits.depth).raw(x[fold == k])
    trees.calibrate(unseen, y)
    return Model(lexicon, trees, told["p"] / told["n"], left_out)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every whole text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "score": model.of(batch["text"].tolist())})

    return by_bytes(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).mapInPandas(tidy(run), "doc_id long, score double")


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, limits: Limits | None = None) -> DataFrame:
    """docs without those scored at the threshold or above; rows and columns are kept as they are."""
    model = learn(docs, labels, limits)

    @F.pandas_udf("boolean")
    def accepted(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        yield from tidy(lambda batches: (pd.Series(model.of(text.tolist()) < threshold) for text in batches))(texts)

    return by_bytes(docs).where(accepted(F.coalesce(F.col("text"), F.lit(""))))


def held_out(modulus: int, remainder: int) -> Column:
    """Whether crc32(doc_id as text) mod modulus is the remainder; false without a doc_id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % modulus == remainder, F.lit(False))
