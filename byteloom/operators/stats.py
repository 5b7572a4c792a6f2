"""Byte statistics and the rules that choose codecs by them.

The statistics of a value are computed inside its row: one Arrow pass over whole values yields exact whole sums
(`facts`), and everything else is expressions over those. No byte becomes a row and nothing is shuffled.
Work on a value goes PIECE bytes at a time, so a very long one needs little more memory than itself.

Defined cases: a null or empty value has 0 bytes and statistics of 0; rows with equal or null ids are
values of their own, each with its own result; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import bytes as fb
from . import pieces

#: How far back a match counts, and the bits of the hash that finds it.
MATCH_WINDOW, MATCH_HASH_BITS = 4096, 13
ROUND, PIECE = 6, 1 << 20
#: Rows of facts that are put out at a time.
FACT_ROWS = 256

FACTS = (
    "input_len long, used int, nln double, n1 long, b1 int, n2 long, b2 int, pairs long, sx long, sy long, sxx long, syy long, sxy long, "
    "run_bytes long, rle_size long, matches long, places long, counts array<long>"
)


def _runs(b: np.ndarray) -> Iterator[np.ndarray]:
    """Lengths of the maximal runs of equal bytes, piece by piece."""
    open_, last = 0, -1
    for k in range(0, len(b), PIECE):
        part = b[k : k + PIECE]
        ends = np.append(np.flatnonzero(part[1:] != part[:-1]) + 1, len(part))
        n = np.diff(ends, prepend=0)
        if part[0] == last:
            n[0] += open_
        elif open_:
            yield np.array([open_])
        yield n[:-1]
        open_, last = n[-1], part[-1]
    if open_:
        yield np.array([open_])


def _near_matches(b: np.ndarray) -> int:
    """Places whose three bytes are also those of the last place in the same hash slot, if that is near."""
    last_at, last_word, found = np.full(1 << MATCH_HASH_BITS, -1 - MATCH_WINDOW, np.int64), np.zeros(1 << MATCH_HASH_BITS, np.int32), 0
    for k in range(0, len(b) - 2, PIECE):
        part = b[k : k + PIECE + 2].astype(np.int32)
        x, y, z = part[:-2], part[1:-1], part[2:]
        word, slot = x << 16 | y << 8 | z, ((x << 10 ^ y << 5 ^ z) & ((1 << MATCH_HASH_BITS) - 1)).astype(np.uint16)
        order = np.argsort(slot, kind="stable")
        s, w, at = slot[order], word[order], order + k
        new = np.concatenate([[True], s[1:] != s[:-1]])
        before, before_w = np.where(new, last_at[s], np.roll(at, 1)), np.where(new, last_word[s], np.roll(w, 1))
        found += int(((at - before <= MATCH_WINDOW) & (before_w == w)).sum())
        end = np.append(new[1:], True)
        last_at[s[end]], last_word[s[end]] = at[end], w[end]
    return found


def _facts_of(raw: bytes | np.ndarray | None) -> tuple:
    b = raw if isinstance(raw, np.ndarray) else np.frombuffer(raw or b"", np.uint8)
    counts = np.bincount(b, minlength=256) if len(b) <= PIECE else sum(np.bincount(b[k : k + PIECE], minlength=256) for k in range(0, len(b), PIECE))
    some = counts[counts > 0]
    top = np.lexsort((np.arange(256), -counts))[:2]
    pairs = np.zeros(5, np.int64)
    for k in range(0, len(b) - 1, PIECE):
        part = b[k : k + PIECE + 1].astype(np.int64)
        x, y = part[:-1], part[1:]
        pairs += [x.sum(), y.sum(), x @ x, y @ y, x @ y]
    inside = size = 0
    for n in _runs(b):
        left = n % 259
        inside += int(n[n >= 4].sum())
        size += int((n // 259 * 5 + np.where(left >= 4, 5, left)).sum())
    return (
        len(b), len(some), float((some * np.log2(some)).sum()), counts[top[0]], top[0], counts[top[1]], top[1], max(len(b) - 1, 0), *pairs,
        inside, size, _near_matches(b), max(len(b) - 2, 0), counts.tolist(),
    )


def facts(data: DataFrame, sample_size: int = 0) -> DataFrame:
    """doc_id and FACTS of each value's first sample_size bytes (0: of all)."""
    own = data.select("doc_id", F.substring("data", 1, sample_size).alias("data") if sample_size else F.col("data"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, raw, ends in pieces.pieces(batches):
            for k in range(0, len(rows), FACT_ROWS):  # values may be tiny, their counts are not
                at = ends[k : k + FACT_ROWS + 1].tolist()
                columns = zip(*[_facts_of(raw[a:z]) for a, z in zip(at, at[1:])])
                arrays = [pa.array(x, t) for x, t in zip(columns, types)]
                yield pa.RecordBatch.from_arrays([rows.column("doc_id").slice(k, FACT_ROWS), *arrays], names)

    kinds = [c.split() for c in FACTS.split(", ")]
    names = ["doc_id", *[n for n, _ in kinds]]
    types = [{"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "array<long>": pa.list_(pa.int64())}[t] for _, t in kinds]
    return own.mapInArrow(run, f"doc_id {dict(own.dtypes)['doc_id']}, {FACTS}")


def histogram(data: DataFrame) -> DataFrame:
    """(doc_id, b, n)."""
    return facts(data).select("doc_id", F.posexplode("counts").alias("b", "n")).where("n > 0")


def _entropy(total: Column, n_log_n: Column) -> Column:
    return F.when(total > 0, F.greatest(F.log2(total) - n_log_n / total, F.lit(0.0))).otherwise(F.lit(0.0))


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def entropy(data: DataFrame) -> DataFrame:
    """(doc_id, total, used, entropy): Shannon entropy in bits per byte."""
    n = F.col("input_len")
    return facts(data).select("doc_id", n.alias("total"), F.col("used").cast("long").alias("used"), F.round(_entropy(n, F.col("nln")), ROUND).alias("entropy"))


def _correlation() -> Column:
    """Pearson's, of neighbouring bytes, from exact whole sums; 0 for constant data."""
    n, sx, sy, sxx, syy, sxy = (F.col(c).cast("decimal(19,0)") for c in ("pairs", "sx", "sy", "sxx", "syy", "sxy"))
    spread = (n * sxx - sx * sx).cast("double") * (n * syy - sy * sy).cast("double")
    return F.when(spread > 0, (n * sxy - sx * sy).cast("double") / F.sqrt(spread)).otherwise(F.lit(0.0))


def autocorrelation(data: DataFrame) -> DataFrame:
    """(doc_id, autocorrelation_lag1)."""
    return facts(data).select("doc_id", F.round(_correlation(), ROUND).alias("autocorrelation_lag1"))


def run_ratio(data: DataFrame) -> DataFrame:
    """(doc_id, run_ratio): share of bytes in runs of 4 or more."""
    return facts(data).select("doc_id", F.round(_share(F.col("run_bytes"), F.col("input_len")), ROUND).alias("run_ratio"))


def rle_size(data: DataFrame) -> DataFrame:
    """(doc_id, length, rle_size): bytes after run-length coding: four literals and a count for each run of 4 to 259, literals for shorter ones."""
    return facts(data).select("doc_id", F.col("input_len").alias("length"), "rle_size")


def match_density(data: DataFrame) -> DataFrame:
    """(doc_id, match_density): share of the places that have a near match."""
    return facts(data).select("doc_id", F.round(_share(F.col("matches"), F.col("places")), ROUND).alias("match_density"))


def shape_of(entropy_: Column, used: Column, bimodal: Column) -> Column:
    """Class of a distribution; the first rule that holds decides."""
    return (
        F.when((used <= 1) | (entropy_ < 0.1), "Constant").when(entropy_ > 7.0, "Uniform").when(bimodal, "Bimodal").when((entropy_ < 3.0) & (used < 32), "Skewed").otherwise("General")
    )


def bimodal_of(total: Column, n1: Column, b1: Column, n2: Column, b2: Column) -> Column:
    """By the two most frequent bytes, the lower first on ties: two peaks of 5 % each, 64 values apart."""
    least = F.floor(total * 0.05)
    return (n2 > 0) & (n1 >= least) & (n2 >= least) & (F.abs(b1 - b2) >= 64)


def profile(data: DataFrame, sample_size: int = 65536) -> DataFrame:
    """All statistics of each value's first sample_size bytes (0: of all), from one pass over the values."""
    n, used, h = F.col("input_len"), F.col("used"), _entropy(F.col("input_len"), F.col("nln"))
    return facts(data, sample_size).select(
        "doc_id", F.round(h, ROUND).alias("byte_entropy"), F.round(_correlation(), ROUND).alias("autocorrelation_lag1"), F.round(_share(F.col("run_bytes"), n), ROUND).alias("run_ratio"),
        F.round(_share(F.col("matches"), F.col("places")), ROUND).alias("match_density"), shape_of(h, used, bimodal_of(n, *map(F.col, ("n1", "b1", "n2", "b2")))).alias("distribution_shape"),
        used.alias("distinct_bytes"), n.alias("input_len"),
    )


def pipeline_rule() -> Column:
    """Name of the pipeline that a profile's row calls for; the first rule that holds decides."""
    h, density, runs, shape = F.col("byte_entropy"), F.col("match_density"), F.col("run_ratio"), F.col("distribution_shape")
    return (
        F.when(F.col("input_len") == 0, "lzf").when((h > 7.5) & (density < 0.1), "lzf").when(runs > 0.3, "bw").when((h < 3.0) & shape.isin("Skewed", "Constant"), "bw")
        .when(density > 0.4, F.when(h > 6.0, "lzfi").otherwise("lzf")).when((density > 0.2) & (h > 5.0), "lzfi").otherwise("lzf")
    )


def finder_rule(length: Column) -> Column:
    """Name of the match finder that a profile's row and the value's own length call for."""
    h, density = F.col("byte_entropy"), F.col("match_density")
    return (
        F.when((length < 1024) | (h > 7.5), "hash_chain").when((density > 0.3) & (h < 6.5), "sort_lz").when((length >= 65536) & (density > 0.2) & (h < 5.5), "sort_lz").otherwise("hash_chain")
    )


def chain_depth_rule(length: Column) -> Column:
    """Links of a hash chain to follow where speed matters."""
    return F.when(length >= 4 << 20, 24).when(length >= 1 << 20, 32).when(length >= 256 << 10, 48).otherwise(64)


#: Block sizes where the caller leaves the default.
DEFAULT_BLOCK, BW_BLOCK, DEVICE_BLOCK = 256 << 10, 512 << 10, 128 << 10


def block_size_rule(pipeline: Column, asked: Column | None = None, device: bool = False) -> Column:
    """Bytes of a block: what was asked for if that isn't the default; else more for the block-sorting pipelines and less for others on a device."""
    asked = F.lit(DEFAULT_BLOCK) if asked is None else asked
    return F.when(asked != DEFAULT_BLOCK, asked).when(pipeline.isin("bw", "bbw"), BW_BLOCK).otherwise(DEVICE_BLOCK if device else DEFAULT_BLOCK).cast("long")


def accuracy_rule(used: Column) -> Column:
    """Table bits for a state machine over so many symbols: room for four slots each, 5 to 12 bits; 7 for none."""
    return F.when(used == 0, 7).otherwise(F.greatest(F.lit(5), F.least(F.lit(12), F.length(F.bin(used * 4 - 1))))).cast("int")


def scale_rule(used: Column) -> Column:
    """Bits of a range coder's frequency scale by symbols."""
    return F.when(used <= 8, 10).when(used >= 64, 13).otherwise(12)


def counts_of(raw: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Row k: how often each byte is in the k-th of the values that lie on end in raw."""
    sizes = np.diff(ends)
    return np.bincount(np.repeat(np.arange(len(sizes)) * 256, sizes) + raw, minlength=256 * len(sizes)).reshape(-1, 256)


def scaled(counts: np.ndarray, bits: int) -> np.ndarray:
    """Each row of counts scaled to sum to 2^bits, at least 1 for each that isn't 0; bits grow where there are more symbols.

    A surplus is dealt round by round in the order of count, then symbol. A deficit takes one a round from each symbol
    that has more than one left, in that order; so each loses the largest common number of whole
    rounds that fits, and the first ones one more.
    """
    total, used = counts.sum(axis=1), (counts > 0).sum(axis=1)
    size = np.left_shift(1, np.where(used == 1, bits, np.maximum(bits, np.ceil(np.log2(np.maximum(used, 1))).astype(np.int64))))
    f0 = np.where(counts > 0, np.maximum(counts * size[:, None] // np.maximum(total, 1)[:, None], 1), 0)
    diff = np.where(used > 0, size - f0.sum(axis=1), 0)
    order = np.argsort(-counts, axis=1, kind="stable")
    rank = np.argsort(order, axis=1)
    each, over = np.divmod(np.maximum(diff, 0), np.maximum(used, 1))
    f = f0 + np.where(counts > 0, each[:, None] + (rank < over[:, None]), 0)
    less = np.flatnonzero(diff < 0)
    if len(less):
        own, k, fits = f0[less], np.zeros(len(less), np.int64), np.ones(len(less), bool)
        while fits.any():  # as many rounds as a deficit has whole ones: fewer than symbols
            fits &= np.minimum(k[:, None] + 1, np.maximum(own - 1, 0)).sum(axis=1) <= -diff[less]
            fits &= k < -diff[less]
            k += fits
        f1 = own - np.minimum(k[:, None], np.maximum(own - 1, 0))
        rest = -diff[less] - (own - f1).sum(axis=1)
        turn = np.take_along_axis(np.cumsum(np.take_along_axis(f1 > 1, order[less], 1), axis=1), rank[less], 1)
        f[less] = f1 - ((f1 > 1) & (turn <= rest[:, None]))
    return f


def normalised_of(wide: DataFrame, bits: int, key: str = "doc_id") -> DataFrame:
    """(key, b, n, f) of rows with counts, an array of 256: see scaled. One Arrow pass, nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, len(batch), FACT_ROWS):
                part = batch.slice(k, FACT_ROWS)
                counts = part.column("counts").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(part), 256)
                row, b = np.nonzero(counts)
                yield pa.RecordBatch.from_arrays([part.column(key).take(pa.array(row)), pa.array(b, pa.int32()), pa.array(counts[row, b]), pa.array(scaled(counts, bits)[row, b])], [key, "b", "n", "f"])

    return wide.select(key, "counts").mapInArrow(run, f"{key} {dict(wide.dtypes)[key]}, b int, n long, f long")


def wide_of(hist: DataFrame, key: str = "doc_id", value: str = "n") -> DataFrame:
    """(key, counts): a histogram relation as arrays of 256; at most 256 rows a key."""
    wide = hist.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("b", value))).alias("m"))
    return wide.select(key, F.transform(F.sequence(F.lit(0), F.lit(255)), lambda b: F.coalesce(F.try_element_at("m", b), F.lit(0).cast("long"))).alias("counts"))


def normalised(hist: DataFrame, bits: int, key: str = "doc_id") -> DataFrame:
    """(key, b, n, f) of a histogram relation: counts scaled to sum to 2^bits, see scaled."""
    return normalised_of(wide_of(hist, key), bits, key)


def costs_of(raw: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """What a literal costs by the histogram of its value, in 1/256 bit, rounded down; row k of 256 belongs to the k-th value that lies on end in raw."""
    sizes, n = np.diff(ends), counts_of(raw, ends)
    with np.errstate(divide="ignore", invalid="ignore"):
        cost = np.floor(np.round(-np.log2(n / sizes[:, None]) * 256, 6))
    return np.where(n > 0, cost, UNSEEN).astype(np.int64)


def match_hashes(data: DataFrame) -> DataFrame:
    """(doc_id, hash3, hash4): sums of the 15-bit hashes of three and of four bytes over the places of each value; values without bytes have no row. One Arrow pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, raw, ends in pieces.pieces(batches):
            some = np.flatnonzero(np.diff(ends))
            sums = [_sums(fb.hash3_of(raw), 2, ends)[some], _sums(fb.hash4_of(raw), 3, ends)[some]]
            yield pa.RecordBatch.from_arrays([rows.column("doc_id").take(pa.array(some)), *map(pa.array, sums)], ["doc_id", "hash3", "hash4"])

    return data.select("doc_id", "data").mapInArrow(run, f"doc_id {dict(data.dtypes)['doc_id']}, hash3 long, hash4 long")


def _sums(hashes: np.ndarray, more: int, ends: np.ndarray) -> np.ndarray:
    """Sum of the hashes of each value's places that have so many bytes after them."""
    upto = np.concatenate([[0], np.cumsum(hashes, dtype=np.int64)])
    return upto[np.maximum(ends[1:] - more, ends[:-1]).clip(max=len(upto) - 1)] - upto[ends[:-1].clip(max=len(upto) - 1)]


def literal_costs(hist: DataFrame) -> DataFrame:
    """(doc_id, b, cost): what a literal costs, in 1/256 bit, rounded down."""
    p = F.col("n") / F.sum("n").over(W.partitionBy("doc_id"))
    return hist.select("doc_id", "b", F.floor(F.round(-F.log2(p) * 256, 6)).cast("long").alias("cost"))


#: Fixed values, in 1/256 bit: a flag, a code, the rebate for the two commonest offset codes, a repeated offset, the length code after one; a byte never seen.
FLAG, CODE, NEAR, REPEAT, REPEAT_LENGTH, UNSEEN = 256, 1024, 512, 512, 768, 2048


def match_cost(offset: Column, length: Column, next_literal: Column, repeat: Column, least: int = 3) -> Column:
    """What a match and the literal after it cost, in 1/256 bit; a repeated offset needs no extra bits of its own."""
    n = length - least + 1
    plain = 2 * CODE - F.when(fb.value_code(offset) <= 1, NEAR).otherwise(0) + (fb.value_extra_bits(offset) + fb.value_extra_bits(n)) * 256
    again = REPEAT + REPEAT_LENGTH + fb.value_extra_bits(n) * 256
    return (F.when(repeat, again).otherwise(plain) + FLAG + F.coalesce(next_literal, F.lit(UNSEEN))).cast("long")
