"""Reversible transforms of blocks, each inside its row: no explode, no shuffle, one Arrow pass.

The blocks of a batch are worked on together, a bounded piece at a time: sorting goes by matrices of blocks of one length
(sorting.py), matches by all places of a piece.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import pieces, sorting
from .codecs import mtf_encode, rle_encode

BLOCK = 64
#: Bytes whose matches are looked for at a time.
MATCH_PIECE = 1 << 18


def keys_of(blocks: DataFrame) -> str:
    kinds = dict(blocks.dtypes)
    return f"doc_id {kinds['doc_id']}, block_idx {kinds['block_idx']}"


def _each_piece(blocks: DataFrame, columns: str, own: Callable[[np.ndarray, np.ndarray], list[pa.Array]]) -> DataFrame:
    """(doc_id, block_idx, columns): what own makes of the bytes and ends of each piece."""
    names = ["doc_id", "block_idx", *[c.split()[0] for c in columns.split(", ")]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, raw, ends in pieces.pieces(batches):
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("block_idx"), *own(raw, ends)], names)

    return blocks.select("doc_id", "block_idx", "data").mapInArrow(run, f"{keys_of(blocks)}, {columns}")


def bwt(blocks: DataFrame) -> DataFrame:
    """(doc_id, block_idx, bwt, primary_index): last column of the sorted rotations, as hex; of equal rotations the later start comes first."""

    def own(raw: np.ndarray, ends: np.ndarray) -> list[pa.Array]:
        last, primary = np.empty_like(raw), np.zeros(len(ends) - 1, np.int64)
        for which, at in pieces.by_length(ends):
            order, _ = sorting.ordered(raw[at], sorting.rotations)
            last[at] = np.take_along_axis(raw[at], (order - 1) % at.shape[1], 1)
            primary[which] = (order == 0).argmax(axis=1)
        return [pieces.hexes(last, ends), pa.array(primary)]

    return _each_piece(blocks, "bwt string, primary_index long", own)


def suffix_array(blocks: DataFrame) -> DataFrame:
    """(doc_id, block_idx, suffixes): starts of the suffixes in order, a shorter one before those it begins."""

    def own(raw: np.ndarray, ends: np.ndarray) -> list[pa.Array]:
        out = np.empty(len(raw), np.int32)
        for _, at in pieces.by_length(ends):
            out[at] = sorting.ordered(raw[at], sorting.suffixes)[0]
        return [pieces.number_lists(out, ends)]

    return _each_piece(blocks, "suffixes string", own)


def _lyndon_starts(b: np.ndarray) -> np.ndarray:
    """Whether a Lyndon factor starts at each place of the rows of b: its suffix is below all earlier ones."""
    rank = sorting.ordered(b, sorting.suffixes)[1]
    return np.concatenate([np.ones((len(b), 1), bool), rank[:, 1:] < np.minimum.accumulate(rank, axis=1)[:, :-1]], axis=1)


def _listed(values: np.ndarray, on: np.ndarray, ends: np.ndarray) -> pa.Array:
    return pieces.number_lists(values[on], np.concatenate([[0], np.cumsum(on)])[ends])


def lyndon(blocks: DataFrame) -> DataFrame:
    """(doc_id, block_idx, starts)."""

    def own(raw: np.ndarray, ends: np.ndarray) -> list[pa.Array]:
        on = np.zeros(len(raw), bool)
        for _, at in pieces.by_length(ends):
            on[at] = _lyndon_starts(raw[at])
        return [_listed(np.arange(len(raw)) - np.repeat(ends[:-1], np.diff(ends)), on, ends)]

    return _each_piece(blocks, "starts string", own)


def mtf(blocks: DataFrame) -> DataFrame:
    """(doc_id, block_idx, ranks): move-to-front ranks.

    A byte met before has as its rank the number of distinct bytes since; a new one its value plus the number of
    larger distinct bytes before it.
    """

    def own(raw: np.ndarray, ends: np.ndarray) -> list[pa.Array]:
        data, at = raw.tobytes(), ends.tolist()
        ranks = b"".join([mtf_encode(data[a:z]) for a, z in zip(at, at[1:])])
        return [pieces.number_lists(np.frombuffer(ranks, np.uint8), ends)]

    return _each_piece(blocks, "ranks string", own)


def rle(data: DataFrame) -> DataFrame:
    """(doc_id, size, encoded): four literals and a count for runs of 4 to 259, as hex."""

    @F.pandas_udf("binary")
    def code(values: pd.Series) -> pd.Series:
        return values.map(lambda x: rle_encode(bytes(x or b"")))

    out = data.select("doc_id", code("data").alias("raw"))
    return out.select("doc_id", F.octet_length("raw").cast("long").alias("size"), F.hex("raw").alias("encoded"))


def bijective_bwt(blocks: DataFrame) -> DataFrame:
    """(doc_id, block_idx, bwt, lengths): the last columns of the sorted rotations of each Lyndon factor, on end, as hex, and the factors' lengths."""

    def own(raw: np.ndarray, ends: np.ndarray) -> list[pa.Array]:
        last, on, lengths = np.empty_like(raw), np.zeros(len(raw), bool), np.empty(len(raw), np.int64)
        for _, at in pieces.by_length(ends):
            b, n = raw[at], at.shape[1]
            starts = _lyndon_starts(b)
            start = np.maximum.accumulate(np.where(starts, np.arange(n), 0), axis=1)
            nexts = np.where(starts, np.arange(n), n)
            size = np.concatenate([np.minimum.accumulate(nexts[:, ::-1], axis=1)[:, ::-1][:, 1:], np.full((len(b), 1), n)], axis=1) - start
            order, _ = sorting.ordered(b, sorting.within(start, size), np.cumsum(starts, axis=1) - 1)
            first, long = np.take_along_axis(start, order, 1), np.take_along_axis(size, order, 1)
            last[at] = np.take_along_axis(b, first + (order - first - 1) % long, 1)
            on[at], lengths[at] = starts, size
        return [pieces.hexes(last, ends), _listed(lengths, on, ends)]

    return _each_piece(blocks, "bwt string, lengths string", own)


def _same_bytes(words: np.ndarray, raw: np.ndarray, p: np.ndarray, q: np.ndarray, most: np.ndarray) -> np.ndarray:
    """How many bytes from p and from q on are equal, at most so many; eight at a time, and only where all before are equal."""
    out, left = np.zeros(len(p), np.int64), np.arange(len(p))
    while len(left):
        x = words[p[left] + out[left]] ^ words[q[left] + out[left]]
        low = np.frexp((x & (~x + np.uint64(1))).astype(np.float64))[1] - 1  # the lowest bit that differs
        out[left] += np.where(x == 0, 8, low >> 3)
        left = left[(x == 0) & (out[left] < most[left])]
    return np.minimum(out, most)


def matches_of(raw: np.ndarray, ends: np.ndarray, k: int, candidates: int, least: int, window: int, longest: int) -> tuple[np.ndarray, ...]:
    """(value, place, rank, offset, length) of the k best matches of each place of the values that lie on end in raw."""
    sizes = np.diff(ends)
    value = np.repeat(np.arange(len(sizes)), sizes)
    padded = np.concatenate([raw, np.zeros(16, np.uint8)])
    words = np.ndarray(len(padded) - 7, "<u8", padded, 0, (1,))
    at = np.flatnonzero(np.arange(len(raw)) + max(least, 4) <= ends[1:][value])
    key = (value[at].astype(np.uint64) << np.uint64(32)) | (words[at] & np.uint64(0xFFFFFFFF))
    order = np.argsort(key, kind="stable")
    at, key = at[order], key[order]
    p, q = [], []
    for c in range(1, candidates + 1):  # the c-th last place with the same four bytes
        on = np.flatnonzero(key[c:] == key[:-c])
        p.append(at[on + c])
        q.append(at[on])
    p, q = np.concatenate(p), np.concatenate(q)
    near = p - q <= window
    p, q = p[near], q[near]
    n = _same_bytes(words, padded, p, q, np.minimum(ends[1:][value[p]] - p, longest))
    p, q, n = p[n >= least], q[n >= least], n[n >= least]
    order = np.lexsort((q, -n, p))  # a smaller q: an earlier source
    p, q, n = p[order], q[order], n[order]
    new = np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1]])) if len(p) else np.empty(0, np.int64)
    rank = np.arange(len(p)) - np.repeat(new, np.diff(np.append(new, len(p))))
    on = rank < k
    p, q, n, rank = p[on], q[on], n[on], rank[on]
    return value[p], p - ends[:-1][value[p]], rank + 1, p - q, n


def sort_matches(blocks: DataFrame, candidates: int = 8, least: int = 4, window: int = 65535, longest: int = 260) -> DataFrame:
    """(doc_id, block_idx, pos, offset, length): for each place the longest match among the last `candidates` places that
    begin with the same four bytes; the earliest of equal ones; lengths are cut at `longest`."""
    return top_matches(blocks, 1, candidates, least, window, longest).drop("rank")


def top_matches(blocks: DataFrame, k: int = 4, candidates: int = 8, least: int = 4, window: int = 65535, longest: int = 260) -> DataFrame:
    """(doc_id, block_idx, pos, rank, offset, length): the k best of a place's matches, longest first, the earliest of equal ones first; offsets differ.

    A block's matches are found inside its row, in one Arrow pass; nothing is shuffled. They come in the order of place and rank.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, raw, ends in pieces.pieces(batches, most=MATCH_PIECE):
            value, *found = matches_of(raw, ends, k, candidates, least, window, longest)
            own = [rows.column(c).take(pa.array(value)) for c in ("doc_id", "block_idx")]
            yield pa.RecordBatch.from_arrays([*own, *[pa.array(x, pa.int32()) for x in found]], ["doc_id", "block_idx", "pos", "rank", "offset", "length"])

    return blocks.select("doc_id", "block_idx", "data").mapInArrow(run, f"{keys_of(blocks)}, pos int, rank int, offset int, length int")
