"""Arrow batches of byte values as numpy, a bounded piece at a time.

An Arrow batch is bounded by rows, so its bytes grow with the blocks. Work on it goes by pieces of about PIECE
bytes (one value at least) and each piece yields batches of its own, so a task needs little more than the batch itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes worked on at a time.
PIECE = 1 << 20


def pieces(batches: Iterator[pa.RecordBatch], column: str = "data", most: int | None = None) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, bytes, ends) of each piece: the bytes of all its values on end (null: none), and where each value starts and the last ends."""
    for batch in batches:
        values = batch.column(column).cast(pa.large_binary()).fill_null(b"")
        ends = np.frombuffer(values.buffers()[1], np.int64)[values.offset : values.offset + len(values) + 1] if len(values) else np.zeros(1, np.int64)
        raw = np.frombuffer(values.buffers()[2] or b"", np.uint8)
        at = 0
        while at < len(values):
            to = max(int(np.searchsorted(ends, ends[at] + (most or PIECE), "right")) - 1, at + 1)
            yield batch.slice(at, to - at), raw[ends[at] : ends[to]], ends[at : to + 1] - ends[at]
            at = to


def strings(raw: bytes | np.ndarray, ends: np.ndarray) -> pa.Array:
    """Texts that lie on end in raw."""
    return pa.LargeStringArray.from_buffers(len(ends) - 1, pa.py_buffer(np.ascontiguousarray(ends, np.int64)), pa.py_buffer(raw)).cast(pa.string())


def hexes(raw: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Values that lie on end in raw, as upper-case hex."""
    return strings(np.ascontiguousarray(raw).tobytes().hex().upper().encode(), ends * 2)


def number_lists(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Lists of whole numbers from 0 on that lie on end in values, as texts with commas between."""
    digits = len(str(int(values.max(initial=0))))
    wide, sizes, left = np.full((len(values), digits + 1), 44, np.uint8), np.full(len(values), 2, np.int64), values.astype(np.int64)
    for k in range(1, digits):
        sizes += values >= 10**k
    keep = np.arange(digits + 1) >= (digits + 1 - sizes)[:, None]
    for k in range(digits - 1, -1, -1):
        wide[:, k], left = 48 + left % 10, left // 10
    last = ends[1:][np.diff(ends) > 0] - 1  # no comma after a list's last number
    keep[last, digits] = False
    sizes[last] -= 1
    return strings(wide[keep].tobytes(), np.concatenate([[0], np.cumsum(sizes)])[ends])


def by_length(ends: np.ndarray, most: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(which, places): which values have one length, and the places of their bytes as the rows of a matrix of bounded size."""
    sizes = np.diff(ends)
    for n in np.unique(sizes[sizes > 0]).tolist():
        which = np.flatnonzero(sizes == n)
        step = max((most or PIECE) // n, 1)
        for k in range(0, len(which), step):
            yield which[k : k + step], ends[which[k : k + step], None] + np.arange(n)


def cut(ends: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(value, block, ends) of the blocks of values that lie on end."""
    counts = -(-np.diff(ends) // size)
    value = np.repeat(np.arange(len(counts)), counts)
    block = np.arange(len(value)) - np.repeat(np.cumsum(counts) - counts, counts)
    return value, block, np.append(ends[:-1][value] + block * size, ends[-1])
