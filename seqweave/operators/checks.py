"""Checks that run with the query."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def checked(df: DataFrame, holds: Column, message: str) -> DataFrame:
    """df, whose query raises at a row where the condition does not hold.

    The check is a filter, which unlike a column is never pruned.  Its condition counts as not deterministic, so that the
    optimizer neither runs it while it plans nor moves it below a join.
    """
    always = F.rand(0) >= 0
    return df.where(always & F.when(holds, True).otherwise(F.raise_error(F.lit(message)).cast("boolean")))
