"""The order of a block's rotations or suffixes, many blocks of one length at a time.

Doubling: places are sorted by a few bytes, then by the ranks that gave to the places behind them, and so on. A place's
rank and the place itself are packed into one whole number, so a round is one sort of the rows of a matrix; a block
whose places all differ takes no part in later rounds.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

Shift = Callable[[np.ndarray, int, np.ndarray], np.ndarray]


def rotations(a: np.ndarray, j: int, rows: np.ndarray) -> np.ndarray:
    return np.roll(a, -(j % a.shape[1]), axis=1)


def suffixes(a: np.ndarray, j: int, rows: np.ndarray) -> np.ndarray:
    out = np.zeros_like(a)
    if j < a.shape[1]:
        out[:, : a.shape[1] - j] = a[:, j:]
    return out


def within(start: np.ndarray, size: np.ndarray) -> Shift:
    """Rotations of parts: each place's part by its start and size."""
    return lambda a, j, rows: np.take_along_axis(a, start[rows] + (np.arange(a.shape[1]) - start[rows] + j) % size[rows], 1)


def _ranked(key: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places by key, of equal ones the later first; each place's dense rank; whether a row's keys all differ."""
    n = key.shape[1]
    low = n.bit_length()
    if bits + low < 64:
        packed = np.sort(key << low | (n - 1 - np.arange(n)), axis=1)
        order, key = n - 1 - (packed & ((1 << low) - 1)), packed >> low
    else:
        order = n - 1 - np.argsort(key[:, ::-1], axis=1, kind="stable")
        key = np.take_along_axis(key, order, 1)
    of = np.zeros_like(key)
    np.cumsum(key[:, 1:] != key[:, :-1], axis=1, out=of[:, 1:])
    rank = np.empty_like(of)
    np.put_along_axis(rank, order, of, 1)
    return order, rank, of[:, -1] == n - 1


def ordered(b: np.ndarray, shift: Shift, lead: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(order, rank) of the places of each row of b by what shift reads from them on; lead (below n), if given, goes first."""
    n = b.shape[1]
    bits = n.bit_length()
    symbols, every = b.astype(np.int64) + 1, np.arange(len(b))  # 0: past the end
    own = 0 if lead is None else bits
    read = max(min((63 - bits - own) // 9, n), 1)
    key = np.zeros(b.shape, np.int64) if lead is None else lead.astype(np.int64)
    for j in range(read):
        key = key << 9 | shift(symbols, j, every)
    order, rank, differ = _ranked(key, own + 9 * read)
    left, each = every[~differ], max((63 - bits) // bits, 2)
    while len(left) and read < n:
        r = rank[left] + 1
        key = r
        for j in range(1, each):
            key = key << bits | shift(r, j * read, left)
        order[left], rank[left], differ = _ranked(key, bits * each)
        left, read = left[~differ], read * each
    return order, rank
