"""Buckets, sorting, selection and permutation.

Buckets are a column of one table, never k tables.  Sorting is Spark's range partitioning (a sample sort); dense ranks come from
counts of ordered ranges, not from one window over all rows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import free
from ..plans.ship import ship_package
from ..plans.storage import stored
from .checks import checked

BUCKETS = 4096


def partition(df: DataFrame, buckets: int, key: Callable[[Column], Column]) -> DataFrame:
    """df with a bucket from key(value); null drops the row, another value outside [0, buckets) raises, whatever of the result is read."""
    placed = df.withColumn("bucket", key(F.col("value")).cast("long")).where("bucket is not null")
    return checked(placed, F.col("bucket").between(0, buckets - 1), f"a bucket is outside [0, {buckets})")


def route(df: DataFrame, ids: DataFrame, buckets: int | None = None) -> DataFrame:
    """df with the bucket that the sequence `ids` has at its position; with `buckets`, one outside [0, buckets) raises."""
    met = df.join(ids.select("pos", F.col("value").cast("long").alias("bucket")), "pos")
    return met if buckets is None else checked(met, F.col("bucket").between(0, buckets - 1), f"a bucket is outside [0, {buckets})")


def sort_buckets(df: DataFrame, order: Sequence[Column | str] = ("value", "pos"), out: str = "rank") -> DataFrame:
    """df with each row's place (from 0) in the order inside its bucket; a bucket is what one task can hold on disk."""
    return df.withColumn(out, F.row_number().over(Window.partitionBy("bucket").orderBy(*order)) - 1)


def process_buckets(df: DataFrame, f: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    """f of each bucket's rows, as Arrow tables."""
    ship_package(df.sparkSession)
    return df.groupBy("bucket").applyInArrow(f, schema)


def pivot_rank(key: Column, pivots: Sequence) -> Column:
    """The number of pivots below the key."""
    return F.size(F.filter(F.array(*[F.lit(p) for p in sorted(pivots)]), lambda p: p < key))


def sort_values(df: DataFrame, order: Sequence[Column] | None = None, buckets: int | None = None) -> DataFrame:
    """The values in order, with dense positions; ties in the order of their old positions.

    Rows are range-partitioned by the order; each gets its place inside its range and the sizes of the ranges before.
    """
    order = [F.col("value").asc_nulls_first()] if order is None else list(order)
    part_, n_, at_, before_, local_ = free(df, "_part", "_n", "_at", "_before", "_local")
    n = buckets or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, *order, F.col("pos")).withColumn(part_, F.spark_partition_id())
    ranged = stored(ranged, "ranges")  # partition ids are fixed by writing them down
    sizes = ranged.groupBy(part_).agg(F.count("*").alias(n_))
    before = Window.orderBy(part_).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(F.col(part_).alias(at_), F.coalesce(F.sum(n_).over(before), F.lit(0)).alias(before_))
    local = ranged.withColumn(local_, F.row_number().over(Window.partitionBy(part_).orderBy(*order, "pos")) - 1)
    rest = [c for c in df.columns if c != "pos"]
    return local.join(offsets, F.col(part_) == F.col(at_)).select((F.col(before_) + F.col(local_)).alias("pos"), *rest)


def kth_smallest(df: DataFrame, k: int, buckets: int = BUCKETS, most: int = 100_000) -> int:
    """The k-th smallest (from 0) of a sequence of longs, exactly.

    The range of values is cut into equal buckets, counted in one pass each round, and narrowed to the bucket that holds
    the k-th; what is left of at most `most` rows is sorted.  A round shuffles `buckets` counts.
    """
    low, high, n = df.agg(F.min("value"), F.max("value"), F.count("*")).first()
    if not 0 <= k < n:
        raise IndexError(k)
    while low < high and n > most:
        width = -(-(high - low + 1) // buckets)
        inside = df.where(F.col("value").between(low, high))
        rows = inside.groupBy(F.expr(f"(value - {low}L) div {width}L").alias("b")).agg(F.count("*").alias("n")).collect()
        counts = sorted((r["b"], r["n"]) for r in rows)
        for b, count in counts:
            if k < count:
                low, high, n = low + b * width, min(high, low + (b + 1) * width - 1), count
                break
            k -= count
    if low == high:
        return low
    return df.where(F.col("value").between(low, high)).select("value").orderBy("value").offset(k).limit(1).first()[0]


def permutation(df: DataFrame, seed: int = 0) -> DataFrame:
    """A uniform permutation, the same for a seed in every run: positions in the order of their seeded hash."""
    (hash_,) = free(df, "_h")
    return sort_values(df.withColumn(hash_, F.xxhash64(F.lit(seed), "pos")), [F.col(hash_)]).drop(hash_)


def scatter_process_gather(df: DataFrame, assign: Callable[[Column, Column], Column], process: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    """Buckets from assign(value, pos), each processed as an Arrow table, all together."""
    return process_buckets(df.withColumn("bucket", assign(F.col("value"), F.col("pos")).cast("long")), process, schema)
