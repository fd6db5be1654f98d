"""MinHash over shingle sets with 61-bit affine functions, banding and its parameters."""

from __future__ import annotations

from collections.abc import Collection
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .batches import slices

MODULUS = (1 << 61) - 1
PERMUTATIONS, SEED = 128, 1
_M = np.uint64(MODULUS)


def _digest(data: bytes, key: bytes = b"") -> int:
    return int.from_bytes(blake2b(data, digest_size=8, key=key).digest(), "big")


def shingle_hash(shingle: str) -> int:
    return _digest(shingle.encode()) % MODULUS


def shingle_hashes(shingles: Collection[str]) -> np.ndarray:
    """shingle_hash of each."""
    return np.frombuffer(b"".join([blake2b(s.encode(), digest_size=8).digest() for s in shingles]), ">u8").astype(np.uint64) % _M


@lru_cache
def coefficients(n: int = PERMUTATIONS, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    key = seed.to_bytes(8, "big", signed=True)
    pairs = [(_digest(f"a{i}".encode(), key) % (MODULUS - 1) + 1, _digest(f"b{i}".encode(), key) % MODULUS) for i in range(n)]
    return np.array([a for a, _ in pairs], np.uint64), np.array([b for _, b in pairs], np.uint64)


def signature(hashes: np.ndarray, n: int = PERMUTATIONS, seed: int = SEED) -> np.ndarray:
    """The n minima; the modulus in all places for an empty set."""
    return minima(hashes, *coefficients(n, seed))


#: Hashes that are taken through all functions at once: what is computed for them fits a core's cache.
AT_ONCE = 256


def minima(hashes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least a * x + b modulo 2^61 - 1 over the hashes x < 2^61, for each a < 2^61 and b < 2^61; the modulus if there are none.

    Products are made of 31- and 30-bit halves. 2^62 is 2 in this modulus and 2^61 is 1, so all parts of a value add up to below 2^64
    and are reduced once: what is less than the modulus becomes huge by taking that away, and the smaller of the two is right.
    """
    u = np.uint64
    a1, a0, b = (a >> u(31))[:, None], (a & u((1 << 31) - 1))[:, None], b[:, None]
    twice, out = a1 * u(2), np.full(len(a), MODULUS, np.uint64)
    for lo in range(0, len(hashes), AT_ONCE):
        x = hashes[lo : lo + AT_ONCE]
        x1, x0 = x >> u(31), x & u((1 << 31) - 1)
        value, mid, part = twice * x1, a1 * x0, a0 * x1
        value += b
        mid += part
        value += np.right_shift(mid, u(30), out=part)
        mid &= u((1 << 30) - 1)
        mid <<= u(31)
        value += mid
        value += np.multiply(a0, x0, out=part)
        np.right_shift(value, u(61), out=part)
        value &= _M
        value += part
        np.minimum(value, np.subtract(value, _M, out=part), out=value)
        np.minimum(out, value.min(axis=1), out=out)
    return out


def signatures(shingled: DataFrame, key: str, shingles: str, n: int = PERMUTATIONS, seed: int = SEED) -> DataFrame:
    """shingled(key, shingles array<string>) -> (key, signature array<long>); null counts as the empty set."""

    def run(stream):
        for batch in slices(stream):
            out = [signature(shingle_hashes(set(row or ())), n, seed).astype(np.int64) for row in batch.column(1).to_pylist()]
            flat = np.concatenate(out) if out else np.zeros(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1) * n, pa.int32()), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], [key, "signature"])

    kind = shingled.schema[key].dataType.simpleString()
    return shingled.select(key, shingles).mapInArrow(run, f"{key} {kind}, signature array<long>")


def signatures_of_hashes(hashed: DataFrame, key: str, hashes: str, functions: list[tuple[int, int]]) -> DataFrame:
    """hashed(key, hashes array<long>) -> (key, signature array<long>) by the given (multiplier, addend) pairs."""
    a, b = (np.array(x, np.uint64) for x in zip(*functions))

    def run(stream):
        for batch in slices(stream):
            out = [minima(np.array(() if row.values is None else row.values, np.uint64), a, b).astype(np.int64) for row in batch.column(1)]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1) * len(a), pa.int32()), pa.array(np.concatenate(out) if out else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], [key, "signature"])

    return hashed.select(key, hashes).mapInArrow(run, f"{key} {hashed.schema[key].dataType.simpleString()}, signature array<long>")


def estimate(a: Column, b: Column) -> Column:
    """Share of equal places of two signatures."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda same: same)) / F.size(a)


def bands(sig: Column, n_bands: int, rows: int) -> Column:
    """array of (band, its rows), to be joined on as it is."""
    return F.transform(F.sequence(F.lit(0), F.lit(n_bands - 1)), lambda i: F.struct(i.alias("band"), F.slice(sig, i * rows + 1, F.lit(rows)).alias("rows")))


def band_key(band: int, rows: list[int]) -> str:
    """The stored form of a band's key."""
    return f"{band}:" + blake2b(b"".join(int(r).to_bytes(8, "big") for r in rows), digest_size=8).hexdigest()


@lru_cache
def optimal_bands(threshold: float, n: int = PERMUTATIONS, false_positive: float = 0.5, false_negative: float = 0.5) -> tuple[int, int]:
    """(bands, rows) with the least weighted area of errors under the S-curve; the first of equals."""
    if not 0 < threshold < 1 or n < 1:
        raise ValueError("0 < threshold < 1 and at least one permutation are needed")
    low, high = np.linspace(0, threshold, 201), np.linspace(threshold, 1, 201)
    best = (float("inf"), 1, n)
    for count in range(1, n + 1):
        for rows in range(1, n // count + 1):
            wrong = false_positive * np.trapezoid(1 - (1 - low**rows) ** count, low) + false_negative * np.trapezoid((1 - high**rows) ** count, high)
            if wrong < best[0] - 1e-15:
                best = (wrong, count, rows)
    return best[1:]
