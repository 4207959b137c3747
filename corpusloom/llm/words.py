"""Words of many texts at once: hashes of the runs of other than ASCII white space, A-Z in lower case.

Texts are laid end to end and hashed as arrays, so that the cost is a few operations a byte and
not a Python object a word. A word's hash is a polynomial of its bytes modulo 2^64, taken from
running sums, and mixed; it depends on nothing but the word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Bytes of a group of texts; a longer text is a group of its own and is cut at white space.
GROUP = 1 << 18

_BASE = 0x9E3779B97F4A7C15
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOW = np.arange(256, dtype=np.uint64) + np.uint64(1)
_LOW[65:91] = _LOW[97:123]
_POWERS: list[np.ndarray] = []


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer on an array."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers() -> list[np.ndarray]:
    """The base's powers and those of its inverse, for the places of a group."""
    if not _POWERS:
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            table = np.full(GROUP + 1, np.uint64(base & (2**64 - 1)))
            table[0] = 1
            _POWERS.append(np.multiply.accumulate(table))
    return _POWERS


def _hashed(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words in at most GROUP bytes, and the places where they begin."""
    power, inverse = _powers()
    inside = np.zeros(len(data) + 2, dtype=np.int8)
    inside[1:-1] = ~_SPACE[data]
    step = np.diff(inside)
    first, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_LOW[data] * power[: len(data)], out=sums[1:])
    return mixed((sums[end] - sums[first]) * inverse[first]), first


def _long(raw: bytes) -> np.ndarray:
    """Word hashes of a text of more than GROUP bytes."""
    import xxhash

    parts, at = [], 0
    while at < len(raw):
        end = min(at + GROUP, len(raw))
        if end < len(raw):
            cut = next((i for i in range(end, at, -1) if raw[i - 1] in b"\t\n\v\f\r "), None)
            if cut is None:  # a word as long as a group
                while end < len(raw) and raw[end] not in b"\t\n\v\f\r ":
                    end += 1
                parts.append(np.array([xxhash.xxh3_64_intdigest(raw[at:end].lower())], dtype=np.uint64))
                at = end
                continue
            end = cut
        parts.append(_hashed(np.frombuffer(raw, dtype=np.uint8, count=end - at, offset=at))[0])
        at = end
    return np.concatenate(parts)


def word_groups(texts: list[str | None]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(place of the first text, word hashes, bounds): a group of consecutive texts; text i of it has the words bounds[i] to bounds[i + 1]."""
    raws: list[bytes] = []
    size, first = 0, 0

    def group() -> tuple[int, np.ndarray, np.ndarray]:
        words, begins = _hashed(np.frombuffer(b"\n".join(raws), dtype=np.uint8))
        ends = np.cumsum([len(r) + 1 for r in raws])
        return first, words, np.concatenate([[0], np.searchsorted(begins, ends)])

    for i, text in enumerate(texts):
        raw = (text or "").encode("utf-8", "surrogatepass")
        if raws and size + len(raw) + 1 > GROUP:
            yield group()
            raws, size, first = [], 0, i
        if len(raw) + 1 > GROUP:
            words = _long(raw)
            yield i, words, np.array([0, len(words)])
            first = i + 1
            continue
        raws.append(raw)
        size += len(raw) + 1
    if raws:
        yield group()


def shingles(words: np.ndarray, bounds: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of ``n`` words inside each text, and their bounds; a text of fewer words has none."""
    count = np.maximum(np.diff(bounds) - (n - 1), 0)
    out = np.concatenate([[0], np.cumsum(count)])
    if not out[-1]:
        return np.zeros(0, dtype=np.uint64), out
    rng = np.random.default_rng(n)
    place = rng.integers(1, 2**63, n, dtype=np.uint64) | np.uint64(1)
    total = len(words) - n + 1
    acc = words[:total] * place[0]
    for j in range(1, n):
        acc += words[j : j + total] * place[j]
    # the places of a text's shingles follow each other, and what crosses a bound is left out
    own = np.arange(out[-1]) + np.repeat(bounds[:-1] - out[:-1], count)
    return mixed(acc[own]), out
