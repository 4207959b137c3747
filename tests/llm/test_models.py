"""The learned models against plain loops: convolution, the sign of every gradient, a boosting step, isotonic levels."""

import math

import numpy as np

from corpusloom.llm import quality as Q
from corpusloom.llm import toxicity as T


def plain_score(net, raw):
    """The network's probability by loops over chunks, positions, filters."""
    p = {k: v.astype(float) for k, v in net.p.items()}
    out = []
    for start in Q.chunk_starts(len(raw)):
        data = (raw[start:] + b"\0" * (Q.CHUNK_BYTES + Q.WIDTH))[: Q.CHUNK_BYTES + Q.WIDTH]
        peak = [max(sum(p["t"][j][data[i + j]][f] for j in range(Q.WIDTH)) for i in range(0, Q.CHUNK_BYTES, Q.STRIDE)) + p["tb"][f] for f in range(Q.FILTERS)]
        hidden = [max(0.0, sum(max(0.0, peak[f]) * p["u"][f][h] for f in range(Q.FILTERS)) + p["ub"][h]) for h in range(Q.HIDDEN)]
        out.append(sum(hidden[h] * p["v"][h] for h in range(Q.HIDDEN)))
    z = p["o"][0] * max(out) + p["o"][1] * sum(out) / len(out) + p["o"][2]
    return 1 / (1 + math.exp(-z))


def test_convolution_against_loops():
    net = Q.Network(np.random.default_rng(4))
    net.p["tb"] += np.linspace(-0.2, 0.2, Q.FILTERS, dtype=np.float32)
    for text in ("", "a", "short text", "é" * 300, "words of a longer text, " * 60):
        assert abs(net.score(text) - plain_score(net, text.encode())) < 1e-4


def test_gradients_have_the_sign_of_finite_differences():
    """The first step of Adam moves each parameter against its gradient by the pace, so its sign shows."""
    rng = np.random.default_rng(6)
    docs = [Q.chunks_of(t) for t in ("the first text " * 50, "other words 123 " * 80, "!!!", "third one")]
    y = np.array([1, 0, 1, 0], dtype=np.float32)
    net = Q.Network(rng)
    net.p["tb"] += 0.3
    net.p["ub"] += 0.1
    before = {k: v.copy() for k, v in net.p.items()}

    def loss(params):
        own = Q.Network(np.random.default_rng(0))
        own.p = params
        total = 0.0
        for d, label in zip(docs, y):
            peaks = np.stack([own.convolve(c, Q.BLOCK * Q.SPAN).max(axis=0) for c in d]).astype(float) + params["tb"]
            s = np.maximum(np.maximum(peaks, 0) @ params["u"].astype(float) + params["ub"], 0) @ params["v"].astype(float)
            o = params["o"].astype(float)
            z = o[0] * s.max() + o[1] * s.mean() + o[2]
            total += math.log1p(math.exp(-z)) if label else math.log1p(math.exp(z))
        return total / len(docs)

    net.fit(docs, y, 1, len(docs), np.random.default_rng(0))
    checked = 0
    for key, value in before.items():
        flat = np.argsort(-np.abs(value - net.p[key]).ravel())[:40] if key == "t" else np.arange(min(value.size, 40))
        for i in flat.tolist():
            h = 1e-2
            up, down = ({k: v.copy() for k, v in before.items()} for _ in range(2))
            up[key].ravel()[i] += h
            down[key].ravel()[i] -= h
            slope = (loss(up) - loss(down)) / (2 * h)
            moved = float(before[key].ravel()[i] - net.p[key].ravel()[i])
            if abs(slope) > 1e-3:
                assert np.sign(moved) == np.sign(slope), (key, i, slope, moved)
                checked += 1
    assert checked > 60


def test_a_boosting_step_against_all_splits():
    rng = np.random.default_rng(2)
    x = rng.integers(0, 9, size=(120, 3)).astype(float)
    y = ((x[:, 1] > 4) ^ (rng.random(120) < 0.1)).astype(float)
    t = T.Trees.fit(x, y, 1, 1)
    base = math.log(y.mean() / (1 - y.mean()))
    p = 1 / (1 + math.exp(-base))
    best = (0.0, None)
    total = sum(v - p for v in y)
    for j in range(3):
        for edge in sorted(set(x[:, j])):
            left = [i for i in range(120) if x[i, j] < edge]
            right = [i for i in range(120) if x[i, j] >= edge]
            if min(len(left), len(right)) < 5:
                continue
            g = [sum(y[i] - p for i in side) for side in (left, right)]
            h = [len(side) * p * (1 - p) for side in (left, right)]
            gain = sum(a * a / (b + 1) for a, b in zip(g, h)) - total**2 / (120 * p * (1 - p) + 1)
            if gain > best[0] + 1e-12:
                best = (gain, (left, right, [base + 0.15 * a / (b + 1) for a, b in zip(g, h)]))
    left, right, values = best[1]
    raw = t.raw(x)
    assert np.allclose(raw[left], values[0]) and np.allclose(raw[right], values[1])


def test_isotonic_levels_against_the_min_max_formula():
    rng = np.random.default_rng(3)
    raw = np.sort(rng.normal(size=60))
    y = (rng.random(60) < 1 / (1 + np.exp(-raw))).astype(float)
    t = T.Trees([], [], 0.0)
    t.calibrate(raw, y)
    at, level = t.steps
    want = [max(min(y[a : b + 1].mean() for b in range(i, 60)) for a in range(i + 1)) for i in range(60)]
    blocks = [want[0]] + [b for a, b in zip(want, want[1:]) if abs(a - b) > 1e-12]
    assert np.allclose(level, blocks) and (np.diff(at) > 0).all()


def test_ties_and_equal_features():
    x, y = np.ones((80, 3)), np.array([1.0] * 20 + [0.0] * 60)
    t = T.Trees.fit(x, y, 5, 3)
    t.calibrate(t.raw(x), y)
    s = t.score(x)
    assert (s == s[0]).all() and abs(s[0] - 0.25) < 1e-9
    net = Q.Network(np.random.default_rng(1))
    docs = [Q.chunks_of("the same text")] * 8
    net.fit(docs, np.array([1, 0] * 4, dtype=np.float32), 30, 8, np.random.default_rng(1))
    assert net.score("the same text") == net.score("the same text") and abs(net.score("the same text") - 0.5) < 0.1
