"""Flat maps with look-ahead across chunk borders, block generators, and an Arrow escape hatch."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.names import chunk_of, free
from ..plans.ship import ship_package
from ..plans.storage import stored
from .scan import CHUNK, exclusive_scan


def flat_map(df: DataFrame, f: Callable[[Column], Column], chunk: int = CHUNK) -> DataFrame:
    """The values of f(value), an array, one after the other with dense positions."""
    return spread_lists(df.select("pos", f(F.col("value")).alias("_list")), chunk)


def spread_lists(df: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """A sequence of arrays (pos, _list) as one sequence of their elements; null is an empty array."""
    sized = df.select("pos", "_list", F.greatest(F.coalesce(F.size("_list"), F.lit(0)).cast("long"), F.lit(0)).alias("_n"))
    placed = exclusive_scan(sized, value="_n", out="_start", chunk=chunk)
    return placed.select("_start", F.posexplode("_list").alias("_k", "value")).select((F.col("_start") + F.col("_k")).alias("pos"), "value")


def with_halo(df: DataFrame, halo: int, chunk: int = CHUNK, out: str = "ahead") -> DataFrame:
    """df with the next `halo` values (fewer at the end) as an array.

    Each row goes to its chunk, and the first rows of a chunk also to the chunks before it that look into it; the window
    then runs inside chunks.
    """
    own_, chunk_ = free(df, "_own", "_chunk")
    rows = df.withColumn(own_, chunk_of("pos", chunk))
    reach = F.greatest(F.lit(0), chunk_of(F.col("pos") - halo, chunk))
    copies = rows.withColumn(chunk_, F.explode(F.sequence(reach, F.col(own_))))
    ahead = F.collect_list("value").over(Window.partitionBy(chunk_).orderBy("pos").rowsBetween(1, halo))
    return copies.withColumn(out, ahead).where(F.col(chunk_) == F.col(own_)).drop(chunk_, own_)


def flat_map_halo(df: DataFrame, halo: int, f: Callable[[Column, Column, Column], Column], chunk: int = CHUNK) -> DataFrame:
    """The values of f(value, pos, next `halo` values), an array, one after the other."""
    seen = with_halo(df, halo, chunk)
    return spread_lists(seen.select("pos", f(F.col("value"), F.col("pos"), F.col("ahead")).alias("_list")), chunk)


def flat_tabulate(spark: SparkSession, n: int, f: Callable[[int, int], pa.Array], kind: T.DataType | None = None, block: int = CHUNK) -> DataFrame:
    """The values that f(start, end) gives for the blocks of [0, n), one after the other with dense positions.

    What f gives is written down once, so that its sizes and its values are of one run even if f is not deterministic.
    """
    ship_package(spark)
    kind = kind or T.LongType()
    schema = T.StructType([T.StructField("block", T.LongType()), T.StructField("k", T.LongType()), T.StructField("value", kind)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in batch.column(0).to_pylist():
                values = f(b * block, min(n, (b + 1) * block))
                yield pa.RecordBatch.from_arrays([pa.array([b] * len(values), pa.int64()), pa.array(range(len(values)), pa.int64()), values], names=["block", "k", "value"])

    made = stored(spark.range(-(-n // block)).mapInArrow(run, schema), "blocks")
    sizes = made.groupBy("block").agg(F.count("*").alias("value"))
    offsets = exclusive_scan(spark.range(-(-n // block)).select(F.col("id").alias("pos")).join(sizes, F.col("pos") == F.col("block"), "left").select("pos", F.coalesce("value", F.lit(0)).alias("value")), out="before")
    return made.join(offsets.select(F.col("pos").alias("block"), "before"), "block").select((F.col("before") + F.col("k")).alias("pos"), "value")


def transform_chunks(df: DataFrame, f: Callable[[pa.Table], pa.Table], schema: str, chunk: int = CHUNK) -> DataFrame:
    """f of each chunk's rows in order, as Arrow tables: for what column expressions can't say.  `chunk`, the number of a row's chunk, is added."""
    ship_package(df.sparkSession)
    return df.withColumn("chunk", chunk_of("pos", chunk)).groupBy("chunk").applyInArrow(lambda t: f(t.sort_by("pos")), schema)
