"""Vectorised hashing of words and word windows over UTF-8 buffers."""

from __future__ import annotations

import numpy as np

_P = np.uint64(0x9E3779B97F4A7C55)
_P_INV = np.uint64(pow(int(_P), -1, 1 << 64))
_powers: dict[int, np.ndarray] = {}

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        have = np.full(size, base, dtype=np.uint64)
        have[0] = 1
        np.cumprod(have, out=have)
        _powers[int(base)] = have
    return have[:n]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of ``data[starts:ends]``, by differences of one running
    polynomial sum; equal byte strings have equal hashes wherever they stand."""
    if not len(starts):
        return np.empty(0, np.uint64)
    running = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(_P, len(data)), out=running[1:])
    h = (running[ends] - running[starts]) * powers(_P_INV, len(data) + 1)[starts]
    return mix(h + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True, cut at the row ``offsets``."""
    n = len(inside)
    cut = np.zeros(n + 1, dtype=bool)
    cut[offsets] = True
    before = np.zeros(n, dtype=bool)
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | cut[:n]))
    after = np.zeros(n, dtype=bool)
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | cut[1:])) + 1
    return starts, ends


def word_hashes(
    data: np.ndarray, offsets: np.ndarray, lower: bool = True
) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words between ASCII white space, and the index of each
    row's first word (one more entry than rows)."""
    if lower:
        data = LOWER[data]
    starts, ends = runs(~SPACE[data], offsets)
    return span_hashes(data, starts, ends), np.searchsorted(starts, offsets)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> list[np.ndarray]:
    """Per row, the sorted distinct hashes of its ``k``-word shingles; rows of
    fewer words have their whole sequence as one, rows without words none."""
    words, first = word_hashes(data, offsets)
    seed = np.arange(1, k + 1, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407) | np.uint64(1)
    n = max(0, len(words) - k + 1)
    acc = np.zeros(n, dtype=np.uint64)
    for j in range(k):
        acc += words[j : j + n] * seed[j]
    acc = mix(acc)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= k:
            out.append(np.unique(acc[a : b - k + 1]))
        elif b > a:
            part = words[a:b]
            out.append(mix((part * seed[: b - a]).sum(dtype=np.uint64, keepdims=True) + np.uint64(b - a)))
        else:
            out.append(np.empty(0, np.uint64))
    return out
