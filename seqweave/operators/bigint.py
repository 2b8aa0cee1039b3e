"""Big integers: sequences of limbs in base 2 ** 64, least first, two's complement (the top bit of the top limb is the sign).

Limbs are decimal(20,0).  Addition zips the operands, sums limb by limb, and finds every carry with one scan: a limb generates a carry,
kills it, or passes on the one it gets, so the carry into a limb is the last one that is not passed on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.monoids import LAST
from ..functions.names import chunk_of
from ..functions.scalars import WORD, wide, wrap
from ..plans.ship import ship_package
from ..plans.storage import stored
from .scan import CHUNK, exclusive_scan

LIMB = T.DecimalType(20, 0)
HALF = 1 << 63
SCHEMA = T.StructType([T.StructField("pos", T.LongType(), False), T.StructField("limb", LIMB, False)])


def from_int(spark: SparkSession, x: int, limbs: int | None = None) -> DataFrame:
    """The limbs of a Python integer: as many as its sign needs, or `limbs`."""
    n = limbs if limbs is not None else max(1, (x.bit_length() + 64) // 64)
    from decimal import Decimal

    return spark.createDataFrame([(k, Decimal((x >> (64 * k)) & (WORD - 1))) for k in range(n)], SCHEMA)


def to_int(df: DataFrame) -> int:
    """The value of a driver-sized big integer."""
    rows = sorted((r["pos"], int(r["limb"])) for r in df.collect())
    x = sum(limb << (64 * k) for k, limb in rows)
    return x - (1 << (64 * len(rows))) if rows and rows[-1][1] >= HALF else x


def literal(x: int) -> Column:
    return F.lit(str(x)).cast("decimal(38,0)")


def ends(df: DataFrame) -> tuple[int, bool]:
    """The number of limbs and whether the integer is negative."""
    n, top = df.agg(F.count("*"), F.max_by("limb", "pos")).first()
    return n, top is not None and int(top) >= HALF


def fill(negative: bool) -> Column:
    return literal(WORD - 1 if negative else 0)


def add(a: DataFrame, b: DataFrame, carry_in: bool = False, chunk: int = CHUNK) -> DataFrame:
    """a + b (+ 1 with carry_in), with one more limb where the sum of two integers of one sign does not fit.

    If b has no limbs the result is a, and if a has none it is b; the carry then counts for nothing.
    """
    (n_a, neg_a), (n_b, neg_b) = ends(a), ends(b)
    if not n_b:
        return a
    if not n_a:
        return b
    n = max(n_a, n_b)
    left, right = a.select("pos", F.col("limb").alias("a")), b.select("pos", F.col("limb").alias("b"))
    met = left.join(right, "pos", "full").select("pos", F.coalesce(wide(F.col("a")), fill(neg_a)).alias("a"), F.coalesce(wide(F.col("b")), fill(neg_b)).alias("b"))
    total = F.col("a") + F.col("b")
    makes = F.when(total >= literal(WORD), 1).when(total == literal(WORD - 1), None).otherwise(0)
    carried = exclusive_scan(met.withColumn("makes", makes), LAST, "makes", "carry", chunk, initial=F.lit(int(carry_in)))
    limbs = carried.select("pos", wrap(F.col("a") + F.col("b") + wide(F.col("carry"))).alias("limb"))
    if neg_a == neg_b:  # only then can the sign be lost
        limbs = stored(limbs, "limbs")
        top = int(limbs.agg(F.max_by("limb", "pos")).first()[0])
        if (top >= HALF) != neg_a:
            extra = limbs.sparkSession.range(1).select(F.lit(n).cast("long").alias("pos"), fill(neg_a).cast("decimal(20,0)").alias("limb"))
            limbs = limbs.unionByName(extra)
    return limbs


def add_eager(a: DataFrame, b: DataFrame, carry_in: bool = False, chunk: int = CHUNK) -> DataFrame:
    """add with its operands and result written out between steps."""
    return stored(add(stored(a, "limbs"), stored(b, "limbs"), carry_in, chunk), "limbs")


def complement(a: DataFrame) -> DataFrame:
    return a.select("pos", (literal(WORD - 1) - wide(F.col("limb"))).cast("decimal(20,0)").alias("limb"))


def negate(a: DataFrame) -> DataFrame:
    """-a; one more limb where a is the least integer of its length."""
    n, _ = ends(a)
    if not n:
        return a
    zero = a.sparkSession.range(1).select(F.lit(0).cast("long").alias("pos"), literal(0).cast("decimal(20,0)").alias("limb"))
    return add(zero, complement(padded(a)), carry_in=True)


def padded(a: DataFrame, limbs: int = 1) -> DataFrame:
    """a with more limbs of its sign."""
    n, negative = ends(a)
    more = a.sparkSession.range(n, n + limbs).select(F.col("id").alias("pos"), fill(negative).cast("decimal(20,0)").alias("limb"))
    return a.unionByName(more)


def subtract(a: DataFrame, b: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """a - b: a + ~b + 1."""
    if not ends(b)[0]:
        return a
    if not ends(a)[0]:
        return negate(b)
    return add(padded(a), complement(padded(b)), carry_in=True, chunk=chunk)


DIGITS = 1 << 12  # base 2 ** 16 digits in a block of the product


def multiply(a: DataFrame, b: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """a * b, signed.  An operand without limbs counts as 0.

    Magnitudes are cut into blocks of base 2 ** 16 digits.  Blocks meet by pairs of block numbers, each pair is a
    convolution in numpy (exact in 64 bits, as digits are split), and products are summed by digit; carries are
    then resolved by additions of the high parts until none is left.  A pair is one task's work, so the product of two
    operands of n blocks is n * n independent small tasks.
    """
    spark = a.sparkSession
    ship_package(spark)
    (n_a, neg_a), (n_b, neg_b) = ends(a), ends(b)
    if not n_a or not n_b:
        return from_int(spark, 0)
    size = n_a + n_b + 1
    digits_a, digits_b = digits(negate(a) if neg_a else a), digits(negate(b) if neg_b else b)
    blocks_a = digits_a.groupBy(chunk_of("pos", DIGITS).alias("i")).agg(F.collect_list(F.struct("pos", "digit")).alias("a"))
    blocks_b = digits_b.groupBy(chunk_of("pos", DIGITS).alias("j")).agg(F.collect_list(F.struct("pos", "digit")).alias("b"))
    n_i, n_j = -(-4 * (n_a + 1) // DIGITS), -(-4 * (n_b + 1) // DIGITS)
    spread_a = blocks_a.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(n_j - 1))))
    spread_b = blocks_b.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(n_i - 1))))
    pairs = spread_a.join(spread_b, ["i", "j"]).select("a", "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def dense(xs: list[dict]) -> tuple[int, np.ndarray]:
            start = min(x["pos"] for x in xs)
            out = np.zeros(max(x["pos"] for x in xs) - start + 1, np.int64)
            for x in xs:
                out[x["pos"] - start] = x["digit"]
            return start, out

        for batch in batches:
            for left, right in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                (s, x), (t, y) = dense(left), dense(right)
                product = np.convolve(x, y)  # below 2 ** 32 * 2 ** 12
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(product)) + s + t), pa.array(product)], names=["pos", "part"])

    sums = pairs.mapInArrow(run, "pos long, part long").groupBy("pos").agg(F.sum("part").alias("digit"))
    limbs = resolved(sums, size, chunk)
    return negate(limbs) if neg_a != neg_b else limbs


def digits(a: DataFrame) -> DataFrame:
    """The base 2 ** 16 digits of a magnitude: pos and digit."""
    pattern = F.when(F.col("limb") >= literal(HALF), wide(F.col("limb")) - literal(WORD)).otherwise(wide(F.col("limb"))).cast("long")
    digit = lambda k: F.shiftrightunsigned(pattern, 16 * k).bitwiseAND(F.lit(0xFFFF))
    every = F.array(*[F.struct((F.col("pos") * 4 + k).alias("pos"), digit(k).alias("digit")) for k in range(4)])
    return a.select(F.explode(every).alias("d")).select("d.pos", "d.digit")


def resolved(sums: DataFrame, size: int, chunk: int = CHUNK) -> DataFrame:
    """Limbs from sums of base 2 ** 16 digits: each sum is a few digits itself, of which those at one offset are one integer; these are added."""
    spark = sums.sparkSession
    sums = stored(sums, "digits")
    total = None
    for k in range(4):  # a sum is below 2 ** 63: four digits
        digit = F.expr(f"shiftright(digit, {16 * k}) & 65535")
        placed = sums.select((F.col("pos") + k).alias("at"), digit.alias("digit"))
        weight = F.element_at(F.array(*[literal(1 << (16 * r)) for r in range(4)]), (F.col("at") % 4 + 1).cast("int"))
        packed = placed.groupBy(chunk_of("at", 4).alias("pos")).agg(F.sum(F.col("digit") * weight).cast("decimal(20,0)").alias("limb"))
        filled = spark.range(size).select(F.col("id").alias("pos")).join(packed, "pos", "left").select("pos", F.coalesce("limb", literal(0).cast("decimal(20,0)")).alias("limb"))
        total = filled if total is None else add(total, filled, chunk=chunk)
    return total
