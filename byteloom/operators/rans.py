"""A range coder (asymmetric numeral system) over blocks, with tables from normalised histograms.

Blocks of one document share the document's table. The blocks of a piece of an Arrow batch advance together,
one symbol a step, as numpy lanes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import pieces, stats

#: Bits of the frequency scale, lower bound of the state; words of 16 bits move between them.
SCALE, LOW = 12, 1 << 16


def _lanes(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The longest blocks first, so that those with a byte at a place are the first ones; and how many those are at each place."""
    return np.argsort(-n, kind="stable"), len(n) - np.searchsorted(np.sort(n), np.arange(n.max(initial=0)), "right")


def encode(blocks: list[np.ndarray], freqs: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Final states and 16-bit words (in decoding order) of all blocks; row k of the tables belongs to block k."""
    n = np.array([len(b) for b in blocks], np.int64)
    order, on = _lanes(n)
    wide = np.zeros((len(on), len(n)), np.uint8)  # a row per place
    for lane, k in enumerate(order):
        wide[: n[k], lane] = blocks[k]
    f_of, c_of, base = freqs[order].astype(np.uint32).ravel(), starts[order].astype(np.uint32).ravel(), np.arange(len(n)) * freqs.shape[1]
    state, words, used = np.full(len(n), LOW, np.uint32), np.empty((len(n), len(on)), np.uint16), np.zeros(len(n), np.int64)
    for at in range(len(on) - 1, -1, -1):
        m = on[at]
        own = base[:m] + wide[at, :m]
        f, x = f_of[own], state[:m]
        over = np.flatnonzero(x >> (32 - SCALE) >= f)
        words[over, used[over]] = x[over]  # the low 16 bits
        used[over] += 1
        x[over] >>= 16
        times = (x / f.astype(np.float64)).astype(np.uint32)  # exact: x has 32 bits, f at most 13
        state[:m] = (times << SCALE) + (x - times * f) + c_of[own]
    back = np.argsort(order)
    return state[back].astype(np.int64), [words[k, : used[k]][::-1].astype("<u2") for k in back]


def decode(state: np.ndarray, words: list[np.ndarray], n: np.ndarray, freqs: np.ndarray, starts: np.ndarray) -> list[np.ndarray]:
    """The blocks; running out of words or ending in a wrong state is an error."""
    order, on = _lanes(n)
    f_of, c_of = freqs[order].astype(np.uint32), starts[order].astype(np.uint32)
    slots = np.repeat(np.tile(np.arange(freqs.shape[1], dtype=np.uint8), len(n)), f_of.ravel())
    f_of, c_of, base, slot_base = f_of.ravel(), c_of.ravel(), np.arange(len(n)) * freqs.shape[1], np.arange(len(n)) << SCALE
    ends = np.cumsum([len(words[k]) for k in order])
    taken = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
    flat = np.concatenate([words[k] for k in order]).astype(np.uint32) if len(order) else np.empty(0, np.uint32)
    state, out = state[order].astype(np.uint32), np.zeros((len(on), len(n)), np.uint8)
    for at, m in enumerate(on):
        x = state[:m]
        low = x & ((1 << SCALE) - 1)
        s = slots[slot_base[:m] + low]
        out[at, :m] = s
        own = base[:m] + s
        x = f_of[own] * (x >> SCALE) + low - c_of[own]
        more = np.flatnonzero(x < LOW)
        if (taken[more] >= ends[more]).any():
            raise ValueError("a block's words run out")
        x[more] = x[more] << 16 | flat[taken[more]]
        taken[more] += 1
        state[:m] = x
    if (state != LOW).any():
        raise ValueError("a block does not end in its first state")
    return [out[: n[k], lane].copy() for k, lane in enumerate(np.argsort(order))]


#: Bytes coded at a time; blocks at a time, as each has a table of 2^12 slots.
RANS_PIECE, RANS_ROWS = 1 << 19, 1024


def _coded(raw: np.ndarray, ends: np.ndarray, freqs: np.ndarray) -> list[pa.Array]:
    """length, coded_len, same of the blocks that lie on end in raw; row k of the frequencies belongs to block k."""
    sizes, coded, same = np.diff(ends), [], []
    for k in range(0, len(sizes), RANS_ROWS):
        own, at = freqs[k : k + RANS_ROWS].astype(np.int64), ends[k : k + RANS_ROWS + 1]
        starts, data = np.cumsum(own, axis=1) - own, [raw[a:z] for a, z in zip(at, at[1:])]
        state, words = encode(data, own, starts)
        back = decode(state, words, np.diff(at), own, starts)
        coded += [4 + 2 * len(w) for w in words]
        same += [np.array_equal(a, b) for a, b in zip(data, back)]
    return [pa.array(sizes, pa.int32()), pa.array(coded, pa.int32()), pa.array(same, pa.bool_())]


_COLUMNS = ["doc_id", "block_idx", "length", "coded_len", "same"]


def _kinds(rows: DataFrame) -> str:
    return f"doc_id {dict(rows.dtypes)['doc_id']}, block_idx int, length int, coded_len int, same boolean"


def round_trip(blocks: DataFrame, normalised: DataFrame) -> DataFrame:
    """(doc_id, block_idx, length, coded_len, same) of blocks, with the tables of a relation of normalised histograms."""
    table = stats.wide_of(normalised, value="f").select("doc_id", F.col("counts").cast("array<short>").alias("freqs"))
    rows = blocks.join(table, "doc_id").select("doc_id", "block_idx", "data", "freqs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, raw, ends in pieces.pieces(batches, most=RANS_PIECE):
            freqs = part.column("freqs").flatten().to_numpy(zero_copy_only=False).reshape(len(part), 256)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("block_idx"), *_coded(raw, ends, freqs)], _COLUMNS)

    return rows.mapInArrow(run, _kinds(blocks))


def round_trip_of(data: DataFrame, block_size: int) -> DataFrame:
    """(doc_id, block_idx, length, coded_len, same) of the blocks of whole values, each value with the table of its own normalised histogram.

    Counted, cut, coded and decoded in the value's row, in one Arrow pass; nothing is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, raw, ends in pieces.pieces(batches, most=RANS_PIECE):
            freqs = stats.scaled(stats.counts_of(raw, ends), SCALE).astype(np.int16)
            value, block, cuts = pieces.cut(ends, block_size)
            yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(value)), pa.array(block, pa.int32()), *_coded(raw, cuts, freqs[value])], _COLUMNS)

    return data.select("doc_id", "data").mapInArrow(run, _kinds(data))
