"""Hashes of the words of many texts at once."""

from __future__ import annotations

import numpy as np

#: Bytes that are hashed at once; a longer text comes in several pieces, cut between words.
PIECE = 1 << 18
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_STEP = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers in which every bit depends on every other."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_STEP)) | np.uint64(1)
_powers: list[np.ndarray] = []


def power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers (at least) of a fixed odd number modulo 2^64, and of its inverse: hashes of stretches are differences of weighted sums."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, PIECE + (1 << 16))
        inverse = pow(_STEP, -1, 1 << 64)
        _powers[:] = [np.ones(size, np.uint64) for _ in range(2)]
        for table, base in zip(_powers, (_STEP, inverse)):
            table[1:] = np.cumprod(np.full(size - 1, base, np.uint64))
    return _powers[0], _powers[1]


def _hash(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, hash) of every word of one stretch of bytes."""
    space = _SPACE[data]
    edges = np.diff(np.concatenate([[True], space, [True]]).astype(np.int8))
    starts, ends = np.flatnonzero(edges == -1), np.flatnonzero(edges == 1)
    up, down = power_tables(len(data) + 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[_LOWER[data]] * up[: len(data)], dtype=np.uint64)])
    return starts, mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def hashed_words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, bounds): the words of text k, lower-cased in A-Z and cut at x20 and x09-x0D, are hashes[bounds[k]:bounds[k + 1]]."""
    found, counts = [], np.zeros(len(texts), np.int64)
    parts: list[bytes] = []
    rows: list[int] = []
    begins: list[int] = []
    size = 0

    def flush() -> None:
        nonlocal size
        if parts:
            at, h = _hash(np.frombuffer(b"\n".join(parts), np.uint8))
            found.append(h)
            owner = np.array(rows)[np.searchsorted(np.array(begins), at, side="right") - 1]
            np.add.at(counts, owner, 1)
            parts.clear(), rows.clear(), begins.clear()
            size = 0

    for row, text in enumerate(texts):
        data = (text or "").encode("utf-8", "surrogatepass")
        at = 0
        while at < len(data):
            end = min(at + PIECE, len(data))
            while end < len(data) and not _SPACE[data[end]]:
                end += 1
            parts.append(data[at:end])
            rows.append(row)
            begins.append(size)
            size += end - at + 1
            at = end
            if size >= PIECE:
                flush()
    flush()
    return np.concatenate(found) if found else np.zeros(0, np.uint64), np.concatenate([[0], np.cumsum(counts)])


def shingle_sets(texts: list[str | None], width: int) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's runs of `width` words; fewer words make one run, none an empty set."""
    words, bounds = hashed_words(texts)
    factors = [np.uint64((_STEP * (2 * k + 3)) & _MASK | 1) for k in range(width)]
    n = len(words) - width + 1
    runs = np.zeros(max(n, 0), np.uint64)
    for k in range(width if n > 0 else 0):
        runs += mix(words[k : k + n] + np.uint64(k)) * factors[k]
    runs = mix(runs)
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if b - a >= width:
            own = np.sort(runs[a : b - width + 1])
            out.append(own[np.concatenate([[True], own[1:] != own[:-1]])])
        elif b > a:
            short = sum(int(mix(words[j : j + 1] + np.uint64(j - a))[0]) * int(factors[j - a]) for j in range(a, b)) + b - a
            out.append(mix(np.array([short & _MASK], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
