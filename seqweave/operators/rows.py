"""Generation, maps, filters, packs, slices and concatenation of sequences."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.storage import stored
from .scan import CHUNK, renumber

Map = Callable[[Column], Column]


def tabulate(spark: SparkSession, n: int, f: Map, out: str = "value") -> DataFrame:
    """f(i) at each position i of [0, n)."""
    return spark.range(n).select(F.col("id").alias("pos"), f(F.col("id")).alias(out))


def iota(spark: SparkSession, n: int) -> DataFrame:
    return tabulate(spark, n, lambda i: i)


def from_values(spark: SparkSession, values: Iterable, kind: str = "bigint") -> DataFrame:
    """A sequence of the values of a (driver-sized) iterable, in its order."""
    schema = T.StructType([T.StructField("pos", T.LongType(), False), T.StructField("value", T._parse_datatype_string(kind))])
    return spark.createDataFrame(list(enumerate(values)), schema)


def from_frame(df: DataFrame, position: str, value: Column | str) -> DataFrame:
    """The sequence of a table that has a dense key."""
    return df.select(F.col(position).cast("long").alias("pos"), (F.col(value) if isinstance(value, str) else value).alias("value"))


def copied(df: DataFrame) -> DataFrame:
    """The sequence written to the shared folder and read back."""
    return stored(df, "sequence")


force = copied


def to_list(df: DataFrame, value: str = "value") -> list:
    """All values in order, on the driver: for sequences that fit there."""
    return [r[0] for r in df.orderBy("pos").select(value).collect()]


def get(df: DataFrame, position: int, value: str = "value"):
    """The value at a position; IndexError if there is none."""
    row = df.where(F.col("pos") == position).select(value).first()
    if row is None:
        raise IndexError(position)
    return row[0]


def size(df: DataFrame) -> int:
    return df.count()


def chunk_count(df: DataFrame, chunk: int = CHUNK) -> int:
    return -(-df.count() // chunk)


def push_back(df: DataFrame, value, n: int | None = None) -> DataFrame:
    """df with one more value at the end; n: its size, if known."""
    n = df.count() if n is None else n
    one = df.sparkSession.range(1).select(F.lit(n).cast("long").alias("pos"), F.lit(value).cast(df.schema["value"].dataType).alias("value"))
    return df.select("pos", "value").unionByName(one)


def map_values(df: DataFrame, f: Map) -> DataFrame:
    return df.select("pos", f(F.col("value")).alias("value"))


def filter_values(df: DataFrame, keep: Map, chunk: int = CHUNK) -> DataFrame:
    """The values that pass, in order and with dense positions."""
    return renumber(df.where(keep(F.col("value"))), chunk=chunk)


pack_value = filter_values


def pack(df: DataFrame, flags: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """The values at whose position the sequence of booleans `flags` is true."""
    return pack_if(df, flags, lambda flag: flag, chunk)


def pack_if(df: DataFrame, selector: DataFrame, keep: Map, chunk: int = CHUNK) -> DataFrame:
    """The values at whose position `keep` holds of the selector's value."""
    chosen = selector.where(keep(F.col("value"))).select("pos")
    return renumber(df.join(chosen, "pos", "left_semi"), chunk=chunk)


def find_if(df: DataFrame, found: Map, out: str = "pos") -> DataFrame:
    """One row: the least position whose value passes, else the size."""
    return df.agg(F.coalesce(F.min(F.when(found(F.col("value")), F.col("pos"))), F.count("*")).alias(out))


def cut(df: DataFrame, start: int, end: int, n: int | None = None) -> DataFrame:
    """[start, end), positions from 0; n: the size, if known.  A slice that leaves the sequence is refused."""
    if start > end or start < 0 or end > (df.count() if n is None else n):
        raise ValueError(f"bad slice [{start}, {end})")
    return between(df, start, end)


def between(df: DataFrame, start: int, end: int) -> DataFrame:
    return df.where((F.col("pos") >= start) & (F.col("pos") < end)).withColumn("pos", F.col("pos") - start)


def cut_or_empty(df: DataFrame, start: int, end: int) -> DataFrame:
    """cut, but empty where the slice is empty or leaves the sequence."""
    if start >= end or start < 0 or end > df.count():
        return df.limit(0)
    return between(df, start, end)


def cut_chunks(df: DataFrame, first: int, end: int, chunk: int = CHUNK) -> DataFrame:
    """Chunks [first, end), as far as there are."""
    return between(df, first * chunk, max(first, end) * chunk)


def prepend_zeros(df: DataFrame, count: int) -> DataFrame:
    """`count` zeros in front (for limbs: a multiplication by base ** count)."""
    zeros = df.sparkSession.range(count).select(F.col("id").alias("pos"), F.lit(0).cast(df.schema["value"].dataType).alias("value"))
    return zeros.unionByName(df.select((F.col("pos") + count).alias("pos"), "value"))


def append_zeros(df: DataFrame, count: int, n: int | None = None) -> DataFrame:
    n = df.count() if n is None else n
    zeros = df.sparkSession.range(n, n + count).select(F.col("id").alias("pos"), F.lit(0).cast(df.schema["value"].dataType).alias("value"))
    return df.select("pos", "value").unionByName(zeros)


def concat(parts: Sequence[DataFrame], sizes: Sequence[int] | None = None) -> DataFrame:
    """The sequences one after the other; sizes: theirs, if known."""
    sizes = [p.count() for p in parts] if sizes is None else sizes
    out, at = None, 0
    for part, n in zip(parts, sizes, strict=True):
        moved = part.withColumn("pos", F.col("pos") + at)
        out, at = moved if out is None else out.unionByName(moved), at + n
    if out is None:
        raise ValueError("no sequences")
    return out
