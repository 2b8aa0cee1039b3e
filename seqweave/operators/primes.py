"""Primes by a segmented sieve over blocks."""

from __future__ import annotations

from functools import cache
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .halo import flat_tabulate

BLOCK = 1 << 20


@cache
def small_primes(most: int) -> np.ndarray:
    flags = np.ones(most + 1, bool)
    flags[:2] = False
    for p in range(2, isqrt(most) + 1):
        if flags[p]:
            flags[p * p :: p] = False
    return np.flatnonzero(flags)


def sieve(start: int, end: int) -> np.ndarray:
    """The primes in [start, end): multiples of the primes up to the root are struck, odd numbers alone are held."""
    if end <= 2:
        return np.zeros(0, np.int64)
    low = max(start, 3) | 1
    flags = np.ones(max(0, (end - low + 1) // 2), bool)
    for p in small_primes(isqrt(end - 1))[1:].tolist():
        first = max(p * p, -(-low // p) * p)
        first += p * (first % 2 == 0)
        if first < end:
            flags[(first - low) // 2 :: p] = False
    found = low + 2 * np.flatnonzero(flags)
    return np.concatenate([[2], found]) if start <= 2 else found


def primes(spark: SparkSession, most: int, block: int = BLOCK) -> DataFrame:
    """The primes up to and with `most`, in order."""
    return flat_tabulate(spark, most + 1, lambda a, b: pa.array(sieve(a, b), pa.int64()), block=block)
