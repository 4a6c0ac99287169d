"""Hashes with exact arithmetic: FNV as SQL expressions, and FNV and Murmur3 over the bytes of whole Arrow columns."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of FNV-1 and FNV-1a.
FNV32_START, FNV32_PRIME = 2166136261, 16777619
FNV64_START = 0xCBF29CE484222325
MASK32 = 0xFFFFFFFF


def byte_at(data: Column, place: Column) -> Column:
    return F.conv(F.hex(F.substring(data, place, F.lit(1))), 16, 10).cast("bigint")


def places(data: Column) -> Column:
    size = F.octet_length(data)
    return F.when(size > 0, F.sequence(F.lit(1), size)).otherwise(F.array().cast("array<int>"))


def fnv1a_32(text: Column) -> Column:
    data = F.encode(text, "UTF-8")
    return F.aggregate(places(data), F.lit(FNV32_START).cast("bigint"), lambda h, i: (h.bitwiseXOR(byte_at(data, i)) * FNV32_PRIME).bitwiseAND(F.lit(MASK32).cast("bigint")))


def fnv1_32(data: Column) -> Column:
    return F.aggregate(places(data), F.lit(FNV32_START).cast("bigint"), lambda h, i: (h * FNV32_PRIME).bitwiseAND(F.lit(MASK32).cast("bigint")).bitwiseXOR(byte_at(data, i)))


def fnv1_64(text: Column) -> Column:
    """Upper and lower 32 bits, as a struct(hi, lo): 64-bit products would overflow."""
    data, mask = F.encode(text, "UTF-8"), F.lit(MASK32).cast("bigint")
    start = F.struct(F.lit(FNV64_START >> 32).cast("bigint").alias("hi"), F.lit(FNV64_START & MASK32).cast("bigint").alias("lo"))

    def step(h: Column, i: Column) -> Column:
        low = h["lo"] * 435
        high = (h["hi"] * 435 + F.shiftrightunsigned(low, 32) + h["lo"].bitwiseAND(F.lit(0xFFFFFF).cast("bigint")) * 256).bitwiseAND(mask)
        return F.struct(high.alias("hi"), low.bitwiseAND(mask).bitwiseXOR(byte_at(data, i)).alias("lo"))

    return F.aggregate(places(data), start, step)


def _rotl(x: int, r: int, bits: int) -> int:
    return ((x << r) | (x >> (bits - r))) & ((1 << bits) - 1)


def murmur3_32(data: bytes, seed: int = 0) -> int:
    h, n = seed, len(data)
    for i in range(0, n + 1, 4):
        k = int.from_bytes(data[i : i + 4], "little")
        k = _rotl(k * 0xCC9E2D51 & MASK32, 15, 32) * 0x1B873593 & MASK32
        h ^= k
        if i + 4 <= n:
            h = (_rotl(h, 13, 32) * 5 + 0xE6546B64) & MASK32
    h ^= n
    for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
        h = (h ^ (h >> shift)) * factor & MASK32
    return h ^ (h >> 16)


def murmur3_64(data: bytes) -> int:
    """First half of the 128-bit hash for 64-bit machines, seed 0."""
    full, c1, c2 = (1 << 64) - 1, 0x87C37B91114253D5, 0x4CF5AD432745937F
    h1 = h2 = 0
    for i in range(0, len(data) + 1, 16):
        part = data[i : i + 16]
        k1, k2 = int.from_bytes(part[:8], "little"), int.from_bytes(part[8:], "little")
        h1 ^= _rotl(k1 * c1 & full, 31, 64) * c2 & full
        whole = len(part) == 16
        if whole:
            h1 = ((_rotl(h1, 27, 64) + h2) * 5 + 0x52DCE729) & full
        h2 ^= _rotl(k2 * c2 & full, 33, 64) * c1 & full
        if whole:
            h2 = ((_rotl(h2, 31, 64) + h1) * 5 + 0x38495AB5) & full

    def final(x: int) -> int:
        x = (x ^ (x >> 33)) * 0xFF51AFD7ED558CCD & full
        x = (x ^ (x >> 33)) * 0xC4CEB9FE1A85EC53 & full
        return x ^ (x >> 33)

    h1, h2 = h1 ^ len(data), h2 ^ len(data)
    h1 = (h1 + h2) & full
    h2 = (h2 + h1) & full
    return (final(h1) + final(h2)) & full


def flat_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column and the n + 1 offsets of its rows; null counts as empty."""
    column = column.fill_null("").cast(pa.large_string())
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def _lanes(raw: np.ndarray, start: np.ndarray, size: np.ndarray, first: int, width: int, kind: type) -> np.ndarray:
    """Little-endian numbers of `width` bytes from byte `first` of each row on; bytes beyond a row's end are zero."""
    out = np.zeros(len(start), kind)
    for i in range(width):
        there = first + i < size
        out[there] |= raw[start[there] + first + i].astype(kind) << kind(8 * i)
    return out


def _turn(x: np.ndarray, r: int) -> np.ndarray:
    bits = x.dtype.itemsize * 8
    return (x << x.dtype.type(r)) | (x >> x.dtype.type(bits - r))


def murmur3_32_rows(raw: np.ndarray, offsets: np.ndarray, seed: int) -> np.ndarray:
    """murmur3_32 of every row, a step for all rows at a time."""
    start, size = offsets[:-1], np.diff(offsets)
    u = np.uint32
    h = np.full(len(size), seed, u)
    for i in range(0, int(size.max(initial=0)) + 1, 4):
        on = np.flatnonzero(size >= i)
        k = _turn(_lanes(raw, start[on], size[on], i, 4, u) * u(0xCC9E2D51), 15) * u(0x1B873593)
        mixed = h[on] ^ k
        h[on] = np.where(size[on] >= i + 4, _turn(mixed, 13) * u(5) + u(0xE6546B64), mixed)
    h ^= size.astype(u)
    for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
        h = (h ^ (h >> u(shift))) * u(factor)
    return h ^ (h >> u(16))


def murmur3_64_rows(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """murmur3_64 of every row, a step for all rows at a time."""
    start, size = offsets[:-1], np.diff(offsets)
    u, c1, c2 = np.uint64, np.uint64(0x87C37B91114253D5), np.uint64(0x4CF5AD432745937F)
    h1, h2 = np.zeros(len(size), u), np.zeros(len(size), u)
    for i in range(0, int(size.max(initial=0)) + 1, 16):
        on = np.flatnonzero(size >= i)
        a, b, whole = h1[on], h2[on], size[on] >= i + 16
        a ^= _turn(_lanes(raw, start[on], size[on], i, 8, u) * c1, 31) * c2
        a = np.where(whole, (_turn(a, 27) + b) * u(5) + u(0x52DCE729), a)
        b ^= _turn(_lanes(raw, start[on], size[on], i + 8, 8, u) * c2, 33) * c1
        h2[on] = np.where(whole, (_turn(b, 31) + a) * u(5) + u(0x38495AB5), b)
        h1[on] = a

    def final(x: np.ndarray) -> np.ndarray:
        x = (x ^ (x >> u(33))) * u(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> u(33))) * u(0xC4CEB9FE1A85EC53)
        return x ^ (x >> u(33))

    h1, h2 = h1 ^ size.astype(u), h2 ^ size.astype(u)
    h1 = h1 + h2
    h2 = h2 + h1
    return final(h1) + final(h2)


def fnv1_64_rows(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """FNV-1 of 64 bits of every raw[start:end], a byte of all of them at a time, long ones first."""
    order = np.argsort(start - end, kind="stable")
    size, first = (end - start)[order], start[order]
    h = np.full(len(order), FNV64_START, np.uint64)
    left = np.searchsorted(-size, -np.arange(int(size.max(initial=0))), "left")
    for i, n in enumerate(left):
        h[:n] = (h[:n] * np.uint64(0x100000001B3)) ^ raw[first[:n] + i]
    out = np.empty_like(h)
    out[order] = h
    return out


def bloom_positions(hashes: int, bits: int):
    """Pandas function: the positions of a key, one seed per hash."""

    @F.pandas_udf("array<bigint>")
    def positions(keys: pd.Series) -> pd.Series:
        raw, offsets = flat_bytes(pa.array(keys, pa.string()))
        return pd.Series(list(np.stack([murmur3_32_rows(raw, offsets, i).astype(np.int64) % bits for i in range(hashes)], axis=1)))

    return positions


def murmur64():
    """Pandas function: the 64-bit hash as a signed number."""

    @F.pandas_udf("bigint")
    def hashed(keys: pd.Series) -> pd.Series:
        return pd.Series(murmur3_64_rows(*flat_bytes(pa.array(keys, pa.string()))).view(np.int64))

    return hashed
