"""Sequential codecs over block rows. Each is a small helper that Spark runs on Arrow batches of blocks."""

from __future__ import annotations

import gzip
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from ..functions.bytes import little_endian
from . import pieces, sorting, stats


def suffix_order(data: bytes) -> np.ndarray:
    """Starts of the rotations in order, the later start first among equal ones."""
    return sorting.ordered(np.frombuffer(data, np.uint8)[None], sorting.rotations)[0][0]


def bwt_encode(data: bytes) -> bytes:
    """Primary index (4 bytes) and the last column."""
    if not data:
        return b""
    order = suffix_order(data)
    raw = np.frombuffer(data, np.uint8)
    return int(np.flatnonzero(order == 0)[0]).to_bytes(4, "little") + raw[order - 1].tobytes()


def bwt_decode(data: bytes) -> bytes:
    if not data:
        return b""
    at, last = int.from_bytes(data[:4], "little"), np.frombuffer(data[4:], np.uint8)
    if at >= len(last):
        raise ValueError("primary index is past the end")
    forward = np.argsort(last, kind="stable")
    after, path = forward.tolist(), []
    for _ in range(len(last)):
        at = after[at]
        path.append(at)
    return last[path].tobytes()


_ALL = bytes(range(256))


def mtf_encode(data: bytes) -> bytes:
    raw, order = np.frombuffer(data, np.uint8), bytearray(_ALL)
    out = bytearray(len(data))
    new = np.flatnonzero(raw[1:] != raw[:-1]) + 1  # within a run the rank is 0
    for k in [0, *new.tolist()] if len(data) > 256 else range(len(data)):
        x = data[k]
        r = order.index(x)
        if r:
            out[k] = r
            del order[r]
            order.insert(0, x)
    return bytes(out)


def mtf_decode(data: bytes) -> bytes:
    moves = np.flatnonzero(np.frombuffer(data, np.uint8))  # a rank of 0 repeats the byte before
    order, front = bytearray(_ALL), bytearray(1)
    for k in moves.tolist():
        r = data[k]
        x = order[r]
        del order[r]
        order.insert(0, x)
        front.append(x)
    return np.repeat(np.frombuffer(front, np.uint8), np.diff(moves, prepend=0, append=len(data))).tobytes()


def rle_encode(data: bytes) -> bytes:
    raw = np.frombuffer(data, np.uint8)
    if not len(raw):
        return b""
    starts = np.flatnonzero(np.concatenate([[True], raw[1:] != raw[:-1]]))
    lengths = np.diff(np.append(starts, len(raw)))
    out, at = [], 0
    for k in np.flatnonzero(lengths >= 4).tolist():  # what lies between long runs is copied as it is
        start, n = int(starts[k]), int(lengths[k])
        x, (full, left) = int(raw[start]), divmod(n, 259)
        out += [data[at:start], bytes([x] * 4 + [255]) * full, bytes([x] * 4 + [left - 4]) if left >= 4 else bytes([x]) * left]
        at = start + n
    return b"".join([*out, data[at:]])


_RUN, _CUT = re.compile(rb"(.)\1{3}(.)", re.S), re.compile(rb"(.)\1{3}\Z", re.S)


def rle_decode(data: bytes) -> bytes:
    out, at = [], 0
    for m in _RUN.finditer(data):
        out += [data[at : m.start()], m[1] * (4 + m[2][0])]
        at = m.end()
    if _CUT.match(data, max(at, len(data) - 4)):
        raise ValueError("a run's count is missing")
    return b"".join([*out, data[at:]])


def deflate(data: bytes) -> bytes:
    c = zlib.compressobj(6, zlib.DEFLATED, -15)
    return c.compress(data) + c.flush()


def _bw(data: bytes) -> bytes:
    own = bwt_encode(data)
    return own[:4] + deflate(rle_encode(mtf_encode(own[4:])))


def _unbw(data: bytes) -> bytes:
    return bwt_decode(data[:4] + mtf_decode(rle_decode(zlib.decompress(data[4:], -15)))) if len(data) > 6 else b""


#: Name -> (number, encoder, decoder) of each block pipeline; stages run left to right inside one task.
PIPELINES: dict[str, tuple[int, Callable[[bytes], bytes], Callable[[bytes], bytes]]] = {
    "bw": (1, _bw, _unbw),
    "deflate": (128, deflate, lambda x: zlib.decompress(x, -15)),
    "gzip": (129, lambda x: gzip.compress(x, mtime=0), gzip.decompress),
    "stored": (130, bytes, bytes),
}


def _with(rows: DataFrame, source: str, target: str, code: Callable[[bytes], bytes]) -> DataFrame:
    """Adds target, what code makes of source, in one Arrow pass; its batches are bounded in bytes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, raw, ends in pieces.pieces(batches, source):
            at, data = ends.tolist(), memoryview(raw)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array([code(bytes(data[a:z])) for a, z in zip(at, at[1:])], pa.binary())], [*part.schema.names, target])

    return rows.mapInArrow(run, StructType([*rows.schema, StructField(target, BinaryType())]))


def encoded(blocks: DataFrame, pipeline: str) -> DataFrame:
    """Adds payload and crc of the original to block rows; one Arrow pass."""
    rows = blocks.withColumn("crc", F.crc32("data")).withColumn("original_len", F.octet_length("data").cast("long"))
    return _with(rows.drop("payload"), "data", "payload", PIPELINES[pipeline][1])


def decoded(frames: DataFrame, pipeline: str) -> DataFrame:
    """Adds data to rows with payload; a wrong checksum stops the query."""
    rows = _with(frames.drop("data"), "payload", "data", PIPELINES[pipeline][2])
    return rows.withColumn("data", F.when(F.crc32("data") == F.col("crc"), F.col("data")).otherwise(F.raise_error(F.lit("a block's checksum is wrong")).cast("binary")))


def coded_sizes(blocks: DataFrame) -> DataFrame:
    """(doc_id, block_idx, original_len, a column per pipeline): bytes of each block by each pipeline; one Arrow pass, no payload leaves it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, raw, ends in pieces.pieces(batches):
            at, data = ends.tolist(), memoryview(raw)
            values = [bytes(data[a:z]) for a, z in zip(at, at[1:])]
            sizes = [pa.array([len(code(v)) for v in values], pa.int64()) for _, code, _ in PIPELINES.values()]
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("block_idx"), pa.array(np.diff(ends)), *sizes], ["doc_id", "block_idx", "original_len", *PIPELINES])

    kinds = dict(blocks.dtypes)
    return blocks.select("doc_id", "block_idx", "data").mapInArrow(run, f"doc_id {kinds['doc_id']}, block_idx {kinds['block_idx']}, original_len long, " + ", ".join(f"{n} long" for n in PIPELINES))


def gzip_facts(rows: DataFrame) -> DataFrame:
    """(doc_id, method, flags, mtime, os, crc, isize) of gzip members in `payload`, by position."""
    p = F.col("payload")
    n = F.octet_length(p)
    tail = F.substring(p, n - 7, F.lit(8))
    ok = F.substring(p, 1, 2) == F.lit(b"\x1f\x8b")
    return rows.where(ok).select(
        "doc_id", little_endian(p, 2, 1).alias("method"), little_endian(p, 3, 1).alias("flags"), F.timestamp_seconds(little_endian(p, 4, 4)).alias("mtime"),
        little_endian(p, 9, 1).alias("os"), little_endian(tail, 0, 4).alias("crc"), little_endian(tail, 4, 4).alias("isize"),
    )


def huffman_lengths(counts: list[int]) -> list[int]:
    """Code lengths of a Huffman tree over the counts (0: no code); one symbol gets one bit."""
    import heapq

    heap = [(c, k, [k]) for k, c in enumerate(counts) if c]
    out = [0] * len(counts)
    if len(heap) == 1:
        out[heap[0][1]] = 1
    heapq.heapify(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        for k in a[2] + b[2]:
            out[k] += 1
        heapq.heappush(heap, (a[0] + b[0], min(a[1], b[1]), a[2] + b[2]))
    return out


def _codes_of(counts: np.ndarray) -> tuple[list[int], list[int], list[str]]:
    """Symbols, counts and canonical codes: the shortest first, then by symbol."""
    lengths = huffman_lengths(counts.tolist())
    symbols, codes, code, last = sorted((b for b in range(len(lengths)) if lengths[b]), key=lambda b: (lengths[b], b)), [], 0, 0
    for b in symbols:
        code <<= lengths[b] - last
        codes.append(f"{code:0{lengths[b]}b}")
        code, last = code + 1, lengths[b]
    return symbols, counts[symbols].tolist(), codes


def huffman_of(wide: DataFrame) -> DataFrame:
    """(doc_id, b array, n array, code array) of rows with counts, an array of 256; one Arrow pass, nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, len(batch), HUFFMAN_ROWS):
                part = batch.slice(k, HUFFMAN_ROWS)
                counts = part.column("counts").flatten().to_numpy(zero_copy_only=False).reshape(len(part), -1)
                b, n, code = zip(*map(_codes_of, counts))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(b, pa.list_(pa.int32())), pa.array(n, pa.list_(pa.int64())), pa.array(code, pa.list_(pa.string()))], ["doc_id", "b", "n", "code"])

    return wide.select("doc_id", "counts").mapInArrow(run, f"doc_id {dict(wide.dtypes)['doc_id']}, b array<int>, n array<long>, code array<string>")


#: Documents whose codes are made at a time.
HUFFMAN_ROWS = 256


def huffman_rows(coded: DataFrame) -> DataFrame:
    """(doc_id, b, n, length, code) of huffman_of's rows."""
    return coded.select("doc_id", F.explode(F.arrays_zip("b", "n", "code")).alias("x")).select("doc_id", "x.b", "x.n", F.length("x.code").alias("length"), "x.code")


def huffman(hist: DataFrame) -> DataFrame:
    """(doc_id, b, n, length, code): canonical codes, shortest first, then by symbol, of a histogram relation."""
    return huffman_rows(huffman_of(stats.wide_of(hist)))
