"""Sets of word shingles as 64-bit hashes, for whole batches of texts at once.

Words are maximal runs without the six ASCII spaces, after A-Z are lower-cased.
A word's hash is a polynomial over its bytes modulo 2**64, which differences of
running sums give for all words of a batch together; a shingle's hash combines
those of its words, and a final mix spreads the bits.
"""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15 | 1
_STEP = np.uint64(0xC2B2AE3D27D4EB4F)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_powers: list[np.ndarray] = []


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, for ``n`` places at least."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, 1 << 20)
        out = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        _powers[:] = out
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the words in bytes that end with a space."""
    space = _SPACE[data]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if not space[0]:
        edge = np.concatenate(([0], edge))
    starts, ends = edge[::2], edge[1::2]
    power, inverse = _tables(len(data) + 1)
    running = np.concatenate((np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * inverse[: len(data)], dtype=np.uint64)))
    return starts, mix((running[ends] - running[starts]) * power[ends])


def shingle_sets(texts: list[str | None], width: int = 5, group_bytes: int = 1 << 19) -> list[np.ndarray]:
    """The sorted set of each text's shingle hashes; a text of fewer words has its whole sequence, one without words none."""
    out: list[np.ndarray] = []
    group: list[bytes] = []
    held = 0
    for t in texts:
        group.append((t or "").encode("utf-8", "surrogatepass").lower())
        held += len(group[-1]) + 1
        if held >= group_bytes:
            out += _sets(group, width)
            group, held = [], 0
    return out + (_sets(group, width) if group else [])


def _sets(group: list[bytes], width: int) -> list[np.ndarray]:
    data = np.frombuffer(b" ".join(group) + b" ", np.uint8)
    starts, words = _words(data)
    ends = np.cumsum([len(x) + 1 for x in group])
    cuts = np.concatenate(([0], np.searchsorted(starts, ends)))
    n = len(words)
    rolled = np.zeros(max(0, n - width + 1), np.uint64)
    for k in range(width):
        rolled = rolled * _STEP + words[k : k + len(rolled)]
    rolled = mix(rolled)
    out = []
    for a, b in zip(cuts[:-1], cuts[1:]):
        if b - a >= width:
            out.append(np.unique(rolled[a : b - width + 1]))
        elif b > a:
            h = np.zeros(1, np.uint64)
            for w in words[a:b]:
                h = h * _STEP + w
            out.append(mix(h + np.uint64(b - a)))
        else:
            out.append(np.empty(0, np.uint64))
    return out


class MinHash:
    """Signatures of ``size`` coordinates: least values of as many hash functions over a set."""

    def __init__(self, size: int, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.masks = rng.integers(0, 1 << 63, size, dtype=np.uint64)[:, None] * np.uint64(2)
        self.factors = (rng.integers(0, 1 << 63, size, dtype=np.uint64) * np.uint64(2) + np.uint64(1))[:, None]

    def signature(self, values: np.ndarray) -> np.ndarray:
        least = None
        for at in range(0, len(values), 2048):
            part = ((values[None, at : at + 2048] ^ self.masks) * self.factors).min(axis=1)
            least = part if least is None else np.minimum(least, part)
        return least.view(np.int64)


def needed_matches(size: int, threshold: float, deviations: float = 5.0) -> int:
    """The fewest equal coordinates to expect of two sets at the threshold, five standard deviations down."""
    return max(1, int(size * threshold - deviations * (size * threshold * (1 - threshold)) ** 0.5))
