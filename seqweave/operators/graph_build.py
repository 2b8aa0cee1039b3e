"""Graph generators and weights, from hashes of positions: the same in every run, and in any engine that has MD5."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .graph import symmetrize

#: Levels of an R-MAT edge that one hash serves, and hexadecimal digits for each.
LEVELS = 8
DIGITS = 4


def digest(*parts: Column) -> Column:
    """32 hexadecimal digits from whole numbers."""
    return F.md5(F.concat_ws(":", *[p.cast("string") for p in parts]))


def number(hexadecimal: Column) -> Column:
    return F.conv(hexadecimal, 16, 10).cast("long")


def add_weights(edges: DataFrame, low: float = 0.0, high: float = 1.0, seed: int = 0) -> DataFrame:
    """Edges with random weights of [low, high), the same for both directions: 52 bits of a hash of the seed and both ends."""
    at = number(F.substring(digest(F.lit(seed), F.least("src", "dst"), F.greatest("src", "dst")), 1, 13)) / F.lit(float(1 << 52))
    return edges.select("src", "dst", (F.lit(float(low)) + at * float(high - low)).alias("weight"))


def rmat(spark: SparkSession, levels: int, edges: int, seed: int = 0, a: float = 0.5, b: float = 0.15, c: float = 0.15) -> DataFrame:
    """Distinct edges of an R-MAT graph of 2 ** levels vertices: each level picks a quadrant by 16 bits of a hash of the edge's number."""
    bits = 1 << (4 * DIGITS)
    hashed = spark.range(edges).select(*[digest(F.lit(seed), F.col("id"), F.lit(k)).alias(str(k)) for k in range(-(-levels // LEVELS))])
    src, dst = F.lit(0).cast("long"), F.lit(0).cast("long")
    for level in range(levels):
        at = number(F.substring(str(level // LEVELS), level % LEVELS * DIGITS + 1, DIGITS))
        down = (at >= round((a + b) * bits)).cast("long")
        right = (((at >= round(a * bits)) & (at < round((a + b) * bits))) | (at >= round((a + b + c) * bits))).cast("long")
        src, dst = src * 2 + down, dst * 2 + right
    return hashed.select(src.alias("src"), dst.alias("dst")).distinct()


def rmat_symmetric(spark: SparkSession, levels: int, edges: int, seed: int = 0) -> DataFrame:
    """Both directions of half as many edges, without loops."""
    return symmetrize(rmat(spark, levels, edges // 2, seed))


def grid(spark: SparkSession, rows: int, columns: int) -> DataFrame:
    """The eight neighbours of each cell of a grid, cells numbered by row."""
    steps = F.array(*[F.struct(F.lit(r).alias("r"), F.lit(c).alias("c")) for r in (-1, 0, 1) for c in (-1, 0, 1) if r or c])
    cells = spark.range(rows * columns).select("id", F.call_function("div", F.col("id"), F.lit(columns).cast("long")).alias("r"), (F.col("id") % columns).alias("c"), F.explode(steps).alias("s"))
    to_r, to_c = F.col("r") + F.col("s.r"), F.col("c") + F.col("s.c")
    return cells.where(to_r.between(0, rows - 1) & to_c.between(0, columns - 1)).select(F.col("id").alias("src"), (to_r * columns + to_c).alias("dst"))
