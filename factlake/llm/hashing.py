"""Vectorised hashes of words and byte strings, for texts laid end to end."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

U = np.uint64
BASE = U(0x9E3779B97F4A7C15 | 1)
INVERSE = U(pow(int(BASE), -1, 1 << 64))
#: Bytes of text handled at once; a longer text is handled alone.
CHUNK = 1 << 18

_rng = np.random.default_rng(20240229)
#: A random number for each byte, and the same with A-Z as a-z.
PLAIN = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) << U(1) | U(1)
FOLDED = PLAIN.copy()
FOLDED[65:91] = PLAIN[97:123]
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True

_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE ** i and its inverse modulo 2 ** 64, for i below n at least."""
    if len(_powers[0]) < n:
        for k, b in enumerate((BASE, INVERSE)):
            p = np.full(max(n, CHUNK + 4096), b, np.uint64)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers[0], _powers[1]


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit numbers (a finalizer with two multiplications)."""
    x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
    return x ^ (x >> U(32))


def prefix(raw: np.ndarray, table: np.ndarray = PLAIN) -> np.ndarray:
    """Sums over prefixes, from which window() takes the hash of any stretch."""
    out = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(table[raw] * powers(len(raw))[0][: len(raw)], out=out[1:])
    return out


def window(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the stretches from start to end, the same for equal bytes wherever they are."""
    return (sums[end] - sums[start]) * powers(len(sums))[1][start]


def chunks(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about CHUNK bytes together."""
    first, total = 0, 0
    for i, t in enumerate(texts):
        if total and total + len(t) > CHUNK:
            yield first, i
            first, total = i, 0
        total += len(t) + 1
    if first < len(texts):
        yield first, len(texts)


def shingles(texts: list[bytes], words: int = 5) -> Iterator[np.ndarray]:
    """For each text the sorted distinct 64-bit hashes of its word shingles, A-Z as a-z; of fewer words, of them all."""
    for first, last in chunks(texts):
        part = texts[first:last]
        raw = np.frombuffer(b"\n".join(part) + b"\n", np.uint8)
        ends_of = np.cumsum([len(t) + 1 for t in part])
        gap = SPACE[raw]
        start = np.flatnonzero(~gap & np.concatenate(([True], gap[:-1])))
        end = np.flatnonzero(gap & np.concatenate(([False], ~gap[:-1])))
        hashed = mixed(window(prefix(raw, FOLDED), start, end) + (end - start).astype(np.uint64))
        bounds = np.concatenate(([0], np.searchsorted(start, ends_of)))
        whole = np.zeros(max(len(hashed) - words + 1, 0), np.uint64)
        for k in range(words):
            whole = whole * BASE + hashed[k : k + len(whole)]
        whole = mixed(whole)
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            if b - a >= words:
                yield np.unique(whole[a : b - words + 1])
            elif b > a:
                few = np.zeros(1, np.uint64)  # arrays wrap around silently, scalars warn
                for k in range(a, b):
                    few = few * BASE + hashed[k]
                yield mixed(few * BASE + U(b - a))
            else:
                yield whole[:0]
