"""Folds, dense histograms, farthest points and the least-squares line."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.monoids import Monoid


def reduce_values(df: DataFrame, monoid: Monoid, value: str = "value", out: str = "value") -> DataFrame:
    """One row: the fold of all values; the identity for none."""
    return df.agg(monoid.total(F.col(value)).alias(out))


def histogram(df: DataFrame, bins: int, key: Callable[[Column], Column] | None = None, check: bool = True) -> DataFrame:
    """bin and n for each of [0, bins), zeros included.  A value outside them raises while the query runs."""
    at = F.col("value") if key is None else key(F.col("value"))
    inside = (at >= 0) & (at < bins)
    at = F.when(inside, at).otherwise(F.raise_error(F.lit(f"a value is outside [0, {bins})"))) if check else at
    counts = df.select(at.cast("long").alias("bin")).groupBy("bin").agg(F.count("*").alias("n"))
    return df.sparkSession.range(bins).select(F.col("id").alias("bin")).join(counts, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


def line_fit(df: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """One row: intercept and slope of the least-squares line."""
    return df.agg(F.regr_intercept(y, x).alias("intercept"), F.regr_slope(y, x).alias("slope"))


def farthest(points: DataFrame, key: Column) -> DataFrame:
    """One row: idx, x, y of the point with the largest key, then the largest idx."""
    best = points.agg(F.max(F.struct(key.alias("key"), "idx", "x", "y")).alias("p"))
    return best.where("p is not null").select("p.idx", "p.x", "p.y")


def extremes(points: DataFrame) -> DataFrame:
    """One row: the least and the greatest point by (x, y)."""
    return points.agg(F.min(F.struct("x", "y", "idx")).alias("low"), F.max(F.struct("x", "y", "idx")).alias("high"))
