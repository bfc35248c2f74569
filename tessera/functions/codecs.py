"""Integer codecs for gap lists: sizes as columns, bytes and bit strings both ways."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def gaps(ids: Column) -> Column:
    """Differences of an ascending array; the first element stays."""
    s = F.array_sort(ids)
    return F.transform(s, lambda x, i: F.when(i == 0, x).otherwise(x - F.get(s, i - 1)))


def from_gaps(values: Column) -> Column:
    return F.transform(values, lambda _, i: F.aggregate(F.slice(values, F.lit(1), i + 1), F.lit(0).cast("long"), lambda a, x: a + x))


def vbyte_size(n: Column) -> Column:
    """Bytes of 7 bits each that n takes."""
    return F.when(n < 1 << 7, 1).when(n < 1 << 14, 2).when(n < 1 << 21, 3).when(n < 1 << 28, 4).when(n < 1 << 35, 5).when(n < 1 << 42, 6).when(n < 1 << 49, 7).when(n < 1 << 56, 8).otherwise(9)


def gamma_code(n: Column) -> Column:
    """Elias gamma of n >= 1: its binary form after as many zeros, less one."""
    b = F.bin(n)
    return F.when(n >= 1, F.concat(F.repeat(F.lit("0"), F.length(b) - 1), b))


def delta_code(n: Column) -> Column:
    """Elias delta of n >= 1: the length of its binary form as gamma, then the form without its first one."""
    b = F.bin(n)
    return F.when(n >= 1, F.concat(gamma_code(F.length(b).cast("long")), F.substring(b, 2, 64)))


def vbyte_encode(numbers: list[int]) -> bytes:
    """Low groups of 7 bits first; the high bit says that more follow."""
    out = bytearray()
    for n in numbers:
        while n >= 128:
            out.append(n & 127 | 128)
            n >>= 7
        out.append(n)
    return bytes(out)


def vbyte_decode(data: bytes) -> list[int]:
    out, value, shift = [], 0, 0
    for byte in data:
        value |= (byte & 127) << shift
        shift += 7
        if byte < 128:
            out.append(value)
            value = shift = 0
    return out


def gamma_decode(bits: str) -> list[int]:
    out, at = [], 0
    while at < len(bits):
        zeros = bits.index("1", at) - at
        out.append(int(bits[at + zeros : at + 2 * zeros + 1], 2))
        at += 2 * zeros + 1
    return out


def delta_decode(bits: str) -> list[int]:
    out, at = [], 0
    while at < len(bits):
        zeros = bits.index("1", at) - at
        length = int(bits[at + zeros : at + 2 * zeros + 1], 2)
        at += 2 * zeros + 1
        out.append(int("1" + bits[at : at + length - 1], 2))
        at += length - 1
    return out
