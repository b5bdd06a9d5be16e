"""Bloom filters of runs: their size for a number of keys, and filters over UTF-16 code units."""

from __future__ import annotations

import math
import struct

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Offset basis and prime of 32-bit FNV-1a; start of djb2.
FNV_BASIS, FNV_PRIME, DJB_START = 0x811C9DC5, 0x01000193, 5381
LEAST_RATE = 1e-4


def bits(n: Column, rate: float = 0.01) -> Column:
    """m = ceil(-n ln p / (ln 2) ** 2), for one key at least."""
    return F.ceil(-F.greatest(n, F.lit(1)) * F.log(F.lit(max(rate, LEAST_RATE))) / (math.log(2) * math.log(2))).cast("long")


def hashes(n: Column, m: Column) -> Column:
    """k = round(m / n * ln 2), one at least."""
    return F.greatest(F.lit(1), F.round(m / F.greatest(n, F.lit(1)) * math.log(2))).cast("long")


def units(key: Column) -> Column:
    """The UTF-16 code units of a text, as an array."""
    digits = F.hex(F.encode(key, "UTF-16BE"))
    n = (F.length(digits) / 4).cast("int")
    at = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.conv(F.substring(digits, i * 4 + 1, F.lit(4)), 16, 10).cast("long"))


def fnv1a(key: Column) -> Column:
    """32 bits of FNV-1a over UTF-16 code units, as a long from 0 on."""
    # the prime is 2 ** 24 + 403, so that no product passes a long: the high part is cut before it is shifted
    return F.aggregate(units(key), F.lit(FNV_BASIS).cast("long"), lambda h, x: F.pmod(h.bitwiseXOR(x) * F.lit(FNV_PRIME).cast("long"), F.lit(1 << 32)))


def djb2(key: Column) -> Column:
    """32 bits of djb2, the variant that joins by exclusive-or, over UTF-16 code units."""
    return F.aggregate(units(key), F.lit(DJB_START).cast("long"), lambda h, x: F.pmod(h * 33, F.lit(1 << 32)).bitwiseXOR(x))


def positions(key: Column, m: Column, k: Column) -> Column:
    """The k bits of a key in a filter of m: (h1 + i * h2) mod 2 ** 32 mod m."""
    # a lambda's body is worked out for each element, so the hashes are bound before
    hashed = F.array(F.struct(fnv1a(key).alias("a"), djb2(key).alias("b")))
    return F.get(F.transform(hashed, lambda h: _positions(h["a"], h["b"], m, k)), F.lit(0))


def _positions(a: Column, b: Column, m: Column, k: Column) -> Column:
    return F.transform(F.sequence(F.lit(0).cast("long"), k.cast("long") - 1), lambda i: F.pmod(F.pmod(a + i * b, F.lit(1 << 32)), m.cast("long")))


class BloomFilter:
    """k positions of a key from two 32-bit hashes over its UTF-16 code units: (h1 + i * h2) mod 2 ** 32 mod m.

    As bytes: m and k as u32, big-endian, and the bits from the lowest of each byte on.
    """

    def __init__(self, n: int, rate: float = 0.01):
        n, rate = max(1, n), max(rate, LEAST_RATE)
        self.m = math.ceil(-n * math.log(rate) / math.log(2) ** 2)
        self.k = max(1, round(self.m / n * math.log(2)))
        self.bits = np.zeros(-(-self.m // 8), np.uint8)

    def positions(self, key: str) -> list[int]:
        a, b = FNV_BASIS, DJB_START
        raw = key.encode("utf-16-le", "surrogatepass")
        for unit in memoryview(raw).cast("H"):
            a = ((a ^ unit) * FNV_PRIME) & 0xFFFFFFFF
            b = ((b * 33) ^ unit) & 0xFFFFFFFF
        return [((a + i * b) & 0xFFFFFFFF) % self.m for i in range(self.k)]

    def add(self, key: str) -> None:
        for p in self.positions(key):
            self.bits[p >> 3] |= 1 << (p & 7)

    def might_contain(self, key: str) -> bool:
        return all(self.bits[p >> 3] >> (p & 7) & 1 for p in self.positions(key))

    def to_bytes(self) -> bytes:
        return struct.pack(">II", self.m, self.k) + self.bits.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> BloomFilter:
        self = cls.__new__(cls)
        self.m, self.k = struct.unpack_from(">II", data)
        self.bits = np.frombuffer(data, np.uint8, -(-self.m // 8), 8).copy()
        return self

    def stats(self) -> dict:
        return {"num_bits": self.m, "num_hashes": self.k, "bytes": len(self.bits)}
