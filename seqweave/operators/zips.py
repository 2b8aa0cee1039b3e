"""Positional zips.

Sequences that are columns of one table need no zip: select both expressions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .checks import checked


def zip_strict(a: DataFrame, b: DataFrame, names: tuple[str, str] = ("a", "b")) -> DataFrame:
    """pos with the values of both; a position that only one has raises while the query runs."""
    return zip_all([a, b], names)


def zip_all(parts: Sequence[DataFrame], names: Sequence[str]) -> DataFrame:
    """pos with one column for each sequence, all of one length: also a count, or a query of one column, raises otherwise."""
    out = parts[0].select("pos", F.col("value").alias("0"), F.lit(True).alias("in0"))
    for k, part in enumerate(parts[1:], 1):
        out = out.join(part.select("pos", F.col("value").alias(str(k)), F.lit(True).alias(f"in{k}")), "pos", "full")
    whole = F.lit(True)
    for k in range(len(parts)):
        whole = whole & F.col(f"in{k}").isNotNull()
    return checked(out, whole, "sequences of different lengths").select("pos", *[F.col(str(k)).alias(n) for k, n in enumerate(names)])


def zip_padded(a: DataFrame, b: DataFrame, pad, names: tuple[str, str] = ("a", "b")) -> DataFrame:
    """pos with the values of both up to the longer one's end; `pad` where one has ended."""
    left, right = (p.select("pos", F.col("value").alias(str(k)), F.lit(True).alias(f"in{k}")) for k, p in enumerate((a, b)))
    filled = [F.when(F.col(f"in{k}").isNull(), F.lit(pad)).otherwise(F.col(str(k))).alias(n) for k, n in enumerate(names)]
    return left.join(right, "pos", "full").select("pos", *filled)
