"""Vectorised word hashing over UTF-8 bytes: A-Z lower-cased, words between bytes 32 and 9 to 13."""

from __future__ import annotations

import numpy as np

U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
#: Bytes hashed at once; temporaries take about 100 bytes for each.
PIECE = 1 << 19

SEPARATOR = np.zeros(256, bool)
SEPARATOR[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_powers: tuple[np.ndarray, np.ndarray] | None = None


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """The finaliser of splitmix64."""
    with np.errstate(over="ignore"):
        x = x + U((0x9E3779B97F4A7C15 * (salt + 1)) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
        return x ^ (x >> U(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and its inverse, modulo 2**64."""
    global _powers
    if _powers is None or len(_powers[0]) < n:
        size = max(n, PIECE) + 1
        with np.errstate(over="ignore"):
            up = np.full(size, U(_BASE))
            up[0] = 1
            down = np.full(size, U(pow(_BASE, -1, 1 << 64)))
            down[0] = 1
            made = np.multiply.accumulate(up), np.multiply.accumulate(down)
        if n > PIECE:
            return made
        _powers = made
    return _powers


def _hash_piece(data: np.ndarray, starts_at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = len(data)
    word = ~SEPARATOR[data]
    first = np.zeros(n + 1, bool)
    first[starts_at] = True
    before = np.empty(n, bool)
    before[0] = True
    np.logical_not(word[:-1], out=before[1:])
    starts = np.flatnonzero(word & (before | first[:n]))
    after = np.empty(n, bool)
    after[-1] = True
    np.logical_not(word[1:], out=after[:-1])
    after |= first[1:]
    ends = np.flatnonzero(word & after) + 1
    up, down = powers(n)
    with np.errstate(over="ignore"):
        total = np.empty(n + 1, U)
        total[0] = 0
        np.cumsum((LOWER[data].astype(U) + U(1)) * up[:n], out=total[1:])
        return mix((total[ends] - total[starts]) * down[starts], 1), starts


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all rows in order, and the number of words before each row (one entry more than rows)."""
    n = len(data)
    if not n:
        return np.empty(0, U), np.zeros(len(offsets), np.int64)
    hashes, places, at = [], [], 0
    while at < n:
        end = min(n, at + PIECE)
        if end < n and not (SEPARATOR[data[end]] or offsets[np.searchsorted(offsets, end)] == end):
            gaps = np.flatnonzero(SEPARATOR[data[at:end]])
            row = int(offsets[np.searchsorted(offsets, end, side="right") - 1])
            end = max(row if row > at else at, at + int(gaps[-1]) + 1 if len(gaps) else at)
            if end == at:  # one word fills the piece: take it whole
                end = at + PIECE
                while end < n and not SEPARATOR[data[end]] and offsets[np.searchsorted(offsets, end)] != end:
                    end += 1
        inside = offsets[(offsets >= at) & (offsets < end)] - at
        h, s = _hash_piece(data[at:end], inside)
        hashes.append(h)
        places.append(s + at)
        at = end
    starts = np.concatenate(places)
    return np.concatenate(hashes), np.searchsorted(starts, offsets, side="left")


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each row, end to end, and the row bounds in them.

    A row of fewer than `width` words has its whole sequence as its one shingle; a row without words has none.
    """
    words, bounds = word_hashes(data, offsets)
    rows, counts = len(offsets) - 1, np.diff(bounds)
    with np.errstate(over="ignore"):
        if len(words) >= width:
            run = np.zeros(len(words) - width + 1, U)
            for k in range(width):
                run = mix(run, 2) * U(3) + words[k : len(words) - width + 1 + k]
            run = mix(run, 3)
        else:
            run = np.empty(0, U)
        parts = []
        for row in range(rows):
            a, n = int(bounds[row]), int(counts[row])
            if n >= width:
                s = np.sort(run[a : a + n - width + 1])
                if len(s) > 1:
                    keep = np.empty(len(s), bool)
                    keep[0] = True
                    np.not_equal(s[1:], s[:-1], out=keep[1:])
                    s = s[keep]
            elif n:
                x = U(n)
                for w in words[a : a + n]:
                    x = mix(np.array([x]), 4)[0] * U(3) + w
                s = mix(np.array([x]), 5)
            else:
                s = run[:0]
            parts.append(s)
    sizes = np.array([len(p) for p in parts], np.int64)
    return (np.concatenate(parts) if parts else np.empty(0, U)), np.concatenate([[0], np.cumsum(sizes)])
