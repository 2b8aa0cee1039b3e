"""Monoids: an aggregate, the merge of two of its results, and an identity.

`ordered` monoids are associative but not commutative; they are for scans and segments, where rows have an order.

One rule holds for folds, scans and segments: a fold starts at the identity, so what it gives is merged with it.  The identity of MAX is 0,
for sequences of natural numbers; `starting_at` gives another one.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Monoid:
    name: str
    identity: object
    aggregate: Callable[[Column], Column]
    merge: Callable[[Column, Column], Column]
    ordered: bool = False

    def unit(self) -> Column:
        return F.lit(self.identity)

    def started(self, fold: Column) -> Column:
        """A fold, null if of nothing, merged with the identity."""
        if self.identity is None:
            return fold
        return F.when(fold.isNull(), self.unit()).otherwise(self.merge(self.unit(), fold))

    def total(self, value: Column) -> Column:
        """The fold of an aggregate's rows; the identity for none."""
        return self.started(self.aggregate(value))

    def starting_at(self, identity: object) -> Monoid:
        return replace(self, identity=identity)


SUM = Monoid("sum", 0, F.sum, lambda a, b: a + b)
MAX = Monoid("max", 0, F.max, F.greatest)
MIN = Monoid("min", (1 << 63) - 1, F.min, F.least)
XOR = Monoid("xor", 0, F.bit_xor, lambda a, b: a.bitwiseXOR(b))
#: The later of two values that is not null: what a carry chain needs.
LAST = Monoid("last", None, lambda c: F.last(c, ignorenulls=True), lambda a, b: F.coalesce(b, a), ordered=True)
