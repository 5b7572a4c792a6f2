"""Column expressions over BINARY values, which stay inside Catalyst, and hashes of places for Arrow passes."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def latin(data: Column) -> Column:
    """A binary value as a string with one character per byte."""
    return F.decode(data, "ISO-8859-1")


def byte_values(data: Column) -> Column:
    """A binary value as an array of numbers from 0 to 255; empty for the empty value."""
    return F.when(F.octet_length(data) > 0, F.transform(F.split(latin(data), ""), lambda c: F.ascii(c))).otherwise(F.array().cast("array<int>"))


def little_endian(data: Column, at: int, n: int) -> Column:
    """An unsigned number of n bytes at a 0-based place, lowest byte first."""
    out = F.lit(0).cast("long")
    for k in range(n):
        out = out + F.conv(F.hex(F.substring(data, at + k + 1, 1)), 16, 10).cast("long") * F.lit(1 << (8 * k))
    return out


def bit_length(n: Column) -> Column:
    """Bits of a number below 2^32: the length of its binary digits, 0 for 0."""
    return F.when(n > 0, F.length(F.bin(n))).otherwise(F.lit(0))


def value_code(v: Column) -> Column:
    """Code of a value from 1 on: 1 -> 0, 2 -> 1, else bits of v - 1."""
    return F.when(v <= 2, v - 1).otherwise(bit_length(v - 1)).cast("int")


def value_extra_bits(v: Column) -> Column:
    """Raw bits that follow the code."""
    return F.greatest(value_code(v) - 1, F.lit(0)).cast("int")


def value_extra(v: Column) -> Column:
    """What the raw bits hold: the value above the least one of its code."""
    return F.when(v <= 2, F.lit(0)).otherwise(v - 1 - F.call_function("shiftleft", F.lit(1).cast("long"), value_extra_bits(v))).cast("long")


def least_profitable_length(offset: Column) -> Column:
    """Shortest match worth its offset, by the offset's raw bits; none for offset 0."""
    bits = value_extra_bits(offset)
    return F.when(offset > 0, 3 + F.least(F.floor(bits / 4), F.lit(4))).cast("int")


#: Fixed value: the multiplier of the four-byte hash, 2^32 over the golden ratio.
GOLDEN = 0x9E3779B9


def hash3_of(raw: np.ndarray) -> np.ndarray:
    """Shift-and-xor hash of the three bytes at each place, to 15 bits."""
    b = raw.astype(np.int32)
    return (b[:-2] << 10 ^ b[1:-1] << 5 ^ b[2:]) & 0x7FFF


def hash4_of(raw: np.ndarray) -> np.ndarray:
    """Multiply-shift hash of the four bytes at each place, kept to 32 bits, to 15 bits."""
    b = raw.astype(np.uint32)
    return ((b[:-3] | b[1:-2] << 8 | b[2:-1] << 16 | b[3:] << 24) * np.uint32(GOLDEN)) >> 17
