"""Scalar expressions: arithmetic modulo 2 ** 64, order of unsigned words, a prime field, mixing, signed area."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = 1 << 64
FIELD = (1 << 31) - 1


def wide(c: Column) -> Column:
    return c.cast("decimal(38,0)")


def word() -> Column:
    return F.lit(str(WORD)).cast("decimal(38,0)")


def wrap(c: Column) -> Column:
    """A non-negative decimal modulo 2 ** 64, as decimal(20,0)."""
    return (wide(c) % word()).cast("decimal(20,0)")


def unsigned(c: Column) -> Column:
    """The unsigned value of a 64-bit pattern, as decimal(20,0)."""
    return F.when(c < 0, wide(c) + word()).otherwise(wide(c)).cast("decimal(20,0)")


def unsigned_order(c: Column) -> Column:
    """A long whose signed order is the unsigned order of the bit pattern c."""
    return c.bitwiseXOR(F.lit(-(1 << 63)))


def narrow32(c: Column) -> Column:
    return c.bitwiseAND(F.lit(0xFFFFFFFF))


def field_add(a: Column, b: Column) -> Column:
    return (a + b) % FIELD


def field_multiply(a: Column, b: Column) -> Column:
    """a * b modulo 2 ** 31 - 1 for a, b below it: the product stays below 2 ** 62."""
    return (a * b) % FIELD


def mixed(c: Column, seed: int = 0) -> Column:
    """A well-spread long of a value, the same in every run."""
    return F.xxhash64(F.lit(seed), c)


def area(ax: Column, ay: Column, bx: Column, by: Column, cx: Column, cy: Column) -> Column:
    """Twice the signed area of the triangle a, b, c: positive if c is left of a -> b."""
    return (bx - ax) * (cy - ay) - (by - ay) * (cx - ax)
