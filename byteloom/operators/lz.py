"""Lempel-Ziv parsing of blocks, and what the token relation says about coders.

Matches and the choice among them stay inside a block, so a block is parsed in its row, in one Arrow pass
(transforms.matches_of finds the matches of all places of a piece at once); everything after it is relational:
tokens are split into streams, streams get histograms, histograms get sizes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import bytes as fb
from . import pieces, stats, transforms

#: The rule of transforms.sort_matches: the best match, candidates, least length, window, longest.
RULE = (1, 8, 4, 65535, 260)


def parse(longest: list[int], lazy: bool = True, least: int = 4, good: int = 32) -> list[int]:
    """Where a block's tokens begin, from the longest match at each place (0: none). A match of `least` is taken; lazy: a literal goes first if the next place has a longer one."""
    out, at, size = [], 0, len(longest)
    while at < size:
        out.append(at)
        n = longest[at]
        at += n if n >= least and not (lazy and n < good and at + 1 < size and longest[at + 1] > n) else 1
    return out


def unparse(tokens: list[tuple[int | None, int | None, int | None]]) -> bytes:
    """The bytes of tokens in order; a match may overlap what it writes."""
    out = bytearray()
    for lit, off, n in tokens:
        if lit is not None:
            out.append(lit)
            continue
        if not 0 < off <= len(out):
            raise ValueError("a match reaches before the block")
        start = len(out) - off
        for k in range(n):
            out.append(out[start + k])
    return bytes(out)


def parsed(blocks: DataFrame, lazy: bool = True) -> DataFrame:
    """(doc_id, block_idx, data, lit, off, len, slot): each block with its parse, arrays in the order of the tokens.

    A token is a literal (lit) or a match (off, len and slot: which of the three recent offsets it repeats, or -1); what a token lacks is -1.
    """
    names = ["lit", "off", "len", "slot"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, raw, ends in pieces.pieces(batches, most=transforms.MATCH_PIECE):
            value, place, _, offset, length = transforms.matches_of(raw, ends, *RULE)
            longest, back = np.zeros(len(raw), np.int64), np.zeros(len(raw), np.int64)
            at = ends[:-1][value] + place
            longest[at], back[at] = length, offset
            begin, edges = [], ends.tolist()
            for a, z in zip(edges, edges[1:]):
                begin.append(np.array(parse(longest[a:z].tolist(), lazy), np.int64) + a)
            first = np.concatenate([[0], np.cumsum([len(x) for x in begin])])
            begin = np.concatenate(begin)
            # a token that reaches further than one byte is a match
            match = np.diff(begin, append=ends[-1]) > 1
            slot = np.full(len(begin), -1)
            of = np.concatenate([[0], np.cumsum(match)])[first]
            slot[match] = np.concatenate([_slots(x.tolist()) for x in np.split(back[begin[match]], of[1:-1])]) if match.any() else -1
            columns = [np.where(match, -1, raw[begin].astype(np.int32)), np.where(match, back[begin], -1), np.where(match, longest[begin], -1), slot]
            lists = [pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(x, pa.int32())) for x in columns]
            yield pa.RecordBatch.from_arrays([*rows.columns, *lists], [*rows.schema.names, *names])

    kinds = ", ".join(f"{n} array<int>" for n in names)
    return blocks.select("doc_id", "block_idx", "data").mapInArrow(run, f"{transforms.keys_of(blocks)}, data binary, {kinds}")


def tokens(blocks: DataFrame, lazy: bool = True) -> DataFrame:
    """(doc_id, block_idx, seq, lit, off, len, slot): each block's parse, a row a token; null is what a token lacks."""
    rows = parsed(blocks, lazy).select("doc_id", "block_idx", F.posexplode(F.arrays_zip("lit", "off", "len", "slot")).alias("seq", "t"))
    match = F.col("t.off") > 0
    return rows.select("doc_id", "block_idx", "seq", F.when(~match, F.col("t.lit")).alias("lit"), *[F.when(match, F.col(f"t.{c}").cast("long")).alias(c) for c in ("off", "len")], F.col("t.slot").alias("slot"))


def rebuilt(rows: DataFrame) -> DataFrame:
    """Adds back: a block's bytes, from its arrays of tokens alone."""

    @F.pandas_udf("binary")
    def run(lit: pd.Series, off: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([unparse([(x if x >= 0 else None, o, m) for x, o, m in zip(a.tolist(), b.tolist(), c.tolist())]) for a, b, c in zip(lit, off, n)], dtype=object)

    return rows.withColumn("back", run("lit", "off", "len"))


def restored(toks: DataFrame) -> DataFrame:
    """(doc_id, block_idx, data) from tokens in any order."""
    # a block has at most as many tokens as bytes
    rows = toks.groupBy("doc_id", "block_idx").agg(F.array_sort(F.collect_list(F.struct("seq", *[F.coalesce(c, F.lit(-1)).alias(c) for c in ("lit", "off", "len")]))).alias("t"))

    @F.pandas_udf("binary")
    def run(t: pd.Series) -> pd.Series:
        return t.map(lambda rows: unparse([(r["lit"] if r["lit"] >= 0 else None, r["off"], r["len"]) for r in rows]))

    return rows.select("doc_id", "block_idx", run("t").alias("data"))


def _slots(offsets: list[int]) -> list[int]:
    recent, out = [1, 1, 1], []
    for x in offsets:
        at = recent.index(x) if x in recent else -1
        out.append(at)
        recent.insert(0, recent.pop(at) if at >= 0 else x)
        del recent[3:]
    return out


def repeat_slots(offsets: pd.Series) -> pd.Series:
    """For each array of offsets in order: which of the three recent ones (0 to 2, from 1, 1, 1 at the start) each repeats, or -1. A repeated one comes to the front."""
    return offsets.map(_slots)


def repeated(data: DataFrame, block_size: int) -> DataFrame:
    """(doc_id, block_idx, pos, offset, length, slot, next_cost): the best match of each place of the blocks of whole values, its repeat slot
    within the block (-1: a new offset), and what the literal after it costs by its value's own histogram (null: the block ends).

    A value is cut, matched and counted in its row, in one Arrow pass; nothing is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, raw, ends in pieces.pieces(batches, most=transforms.MATCH_PIECE):
            value, block, cuts = pieces.cut(ends, block_size)
            which, place, _, offset, length = transforms.matches_of(raw, cuts, *RULE)
            slot = np.concatenate([_slots(x.tolist()) for x in np.split(offset, np.flatnonzero(np.diff(which)) + 1)]) if len(which) else which
            after = cuts[:-1][which] + place + length
            inside = after < cuts[1:][which]
            costs = stats.costs_of(raw, ends)
            cost = costs[value[which], raw[np.where(inside, after, 0)]] if len(raw) else which
            arrays = [pa.array(x, pa.int32()) for x in (block[which], place, offset, length, slot)]
            yield pa.RecordBatch.from_arrays([rows.column("doc_id").take(pa.array(value[which])), *arrays, pa.array(cost, pa.int64(), mask=~inside)], names)

    names = ["doc_id", "block_idx", "pos", "offset", "length", "slot", "next_cost"]
    kinds = f"doc_id {dict(data.dtypes)['doc_id']}, block_idx int, pos int, offset int, length int, slot int, next_cost long"
    return data.select("doc_id", "data").mapInArrow(run, kinds)


def streams(toks: DataFrame) -> DataFrame:
    """(doc_id, stream, b): the symbols of four streams - flags, literals, offset codes, length codes - one row each.

    Offsets equal to one of a block's three recent ones are repeats: codes 0 to 2; other codes are shifted by 3.
    """
    code = F.when(F.col("slot") >= 0, F.col("slot")).otherwise(fb.value_code(F.col("off")) + 3)
    match = F.col("off").isNotNull()
    each = F.array(
        F.struct(F.lit("flags").alias("stream"), F.when(match, 1).otherwise(0).cast("long").alias("b")),
        F.struct(F.lit("literals").alias("stream"), F.col("lit").cast("long").alias("b")),
        F.struct(F.lit("offsets").alias("stream"), F.when(match, code).cast("long").alias("b")),
        F.struct(F.lit("lengths").alias("stream"), F.when(match, fb.value_code(F.col("len") - 2)).cast("long").alias("b")),
    )
    return toks.select("doc_id", F.explode(each).alias("s")).select("doc_id", "s.stream", "s.b").where("b is not null")


def stream_sizes(toks: DataFrame) -> DataFrame:
    """(doc_id, stream, symbols, bits): what an ideal entropy coder makes of each stream."""
    hist = streams(toks).groupBy("doc_id", "stream", "b").agg(F.count("*").alias("n"))
    per = hist.groupBy("doc_id", "stream").agg(F.sum("n").alias("symbols"), F.sum(F.col("n") * F.log2("n")).alias("nln"))
    return per.select("doc_id", "stream", "symbols", F.ceil(F.round(F.greatest(F.col("symbols") * F.log2("symbols") - F.col("nln"), F.lit(0.0)), 6)).cast("long").alias("bits"))
