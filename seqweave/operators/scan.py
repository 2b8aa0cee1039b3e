"""Prefix scans in two levels, and what rests on them: dense renumbering and segmented reduction.

A window without partitions would put all rows in one task.  Here rows are cut into chunks of `chunk` positions: chunks
are folded (pre-aggregated before the shuffle), the folds of chunks are scanned in one small window, rows are scanned inside their
chunk, and the two are merged.  The window inside a chunk and the join with the chunk's offset use one and the same partitioning.
Chunks come from positions, never from partition ids, so a repeated task gives the same rows.

Two levels put one row a chunk into the small window: 15 million rows for 10 ** 12 positions.  Three scan the folds of chunks
the same way once more, and are taken where the plan reads more than LARGE bytes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.monoids import SUM, Monoid
from ..functions.names import chunk_of, free

CHUNK = 1 << 16
#: Bytes of input from which a scan has three levels.
LARGE = 1 << 40
#: Positions that one interval of a segment is longer than those of the level below.
RADIX = 16


def levels_of(df: DataFrame) -> int:
    """By the bytes that the plan reads, as the optimizer knows them (a table made on the driver counts as small); no job runs."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(k).stats().sizeInBytes())) for k in range(leaves.size())]
    return 3 if sum(s for s in sizes if s < 1 << 62) > LARGE else 2


def exclusive_scan(df: DataFrame, monoid: Monoid = SUM, value: str = "value", out: str = "scan", chunk: int = CHUNK, inclusive: bool = False, initial: Column | None = None, levels: int | None = None) -> DataFrame:
    """df with `out`, the fold of the values at all smaller positions (inclusive: and its own); the identity, or `initial`, before the first."""
    start = monoid.unit() if initial is None else initial
    chunk_, local_, at_, before_ = free(df, "_chunk", "_local", "_at", "_before")
    cut = df.withColumn(chunk_, chunk_of("pos", chunk))
    fold = F.max_by(value, F.when(F.col(value).isNotNull(), F.col("pos"))) if monoid.ordered else monoid.aggregate(F.col(value))
    offsets = before_each(cut.groupBy(F.col(chunk_).alias("chunk")).agg(fold.alias("value")), monoid, chunk, levels or levels_of(df)).toDF(at_, before_)
    rows = Window.partitionBy(chunk_).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    local = cut.withColumn(local_, monoid.aggregate(F.col(value)).over(rows))
    met = local.join(offsets, F.col(chunk_) == F.col(at_))
    both = merged(monoid, merged(monoid, start, F.col(before_)), F.col(local_))
    return met.select(*df.columns, both.alias(out))


def before_each(folds: DataFrame, monoid: Monoid, chunk: int, levels: int) -> DataFrame:
    """chunk and before, the fold of all earlier chunks, from chunk and value; null or the identity before the first."""
    if levels > 2:
        above = exclusive_scan(folds.select(F.col("chunk").alias("pos"), "value"), monoid, out="before", chunk=chunk, levels=levels - 1)
        return above.select(F.col("pos").alias("chunk"), "before")
    earlier = Window.orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    return folds.select("chunk", monoid.aggregate(F.col("value")).over(earlier).alias("before"))


def merged(monoid: Monoid, a: Column, b: Column) -> Column:
    """The merge of two folds of which null is the empty one."""
    return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(monoid.merge(a, b))


def inclusive_scan(df: DataFrame, monoid: Monoid = SUM, value: str = "value", out: str = "scan", chunk: int = CHUNK) -> DataFrame:
    return exclusive_scan(df, monoid, value, out, chunk, inclusive=True)


def scan_total(df: DataFrame, monoid: Monoid = SUM, value: str = "value", out: str = "total") -> DataFrame:
    """One row: the fold of the whole sequence."""
    return df.agg(monoid.total(F.col(value)).alias(out))


def renumber(df: DataFrame, order: str = "pos", chunk: int = CHUNK, levels: int | None = None) -> DataFrame:
    """df with its positions made dense from 0 in their order; ties, which are no positions, are not allowed."""
    chunk_, local_, at_, before_ = free(df, "_chunk", "_local", "_at", "_before")
    cut = df.withColumn(chunk_, chunk_of(order, chunk))
    offsets = before_each(cut.groupBy(F.col(chunk_).alias("chunk")).agg(F.count("*").alias("value")), SUM, chunk, levels or levels_of(df)).toDF(at_, before_)
    local = cut.withColumn(local_, F.row_number().over(Window.partitionBy(chunk_).orderBy(order)) - 1)
    met = local.join(offsets, F.col(chunk_) == F.col(at_))
    rest = [c for c in df.columns if c != order]
    return met.select((F.coalesce(before_, F.lit(0)) + F.col(local_)).alias(order), *rest)


def intervals(top: int, radix: int = RADIX) -> Column:
    """level and idx of the aligned intervals [idx * radix ** level, (idx + 1) * radix ** level) that [lo, hi) is made of: an array, at most 2 * radix a level below `top`."""
    parts, lo, hi = [], F.col("lo").cast("long"), F.col("hi").cast("long")
    span = lambda a, b, k: F.when(a < b, F.transform(F.sequence(a, b - 1), lambda i: F.struct(F.lit(k).alias("level"), i.alias("idx")))).otherwise(F.array().cast("array<struct<level:int,idx:bigint>>"))
    for k in range(top):
        up, down = chunk_of(lo + (radix - 1), radix), chunk_of(hi, radix)
        whole = up < down
        parts += [span(lo, F.when(whole, up * radix).otherwise(hi), k), span(F.when(whole, down * radix).otherwise(hi), hi, k)]
        lo, hi = F.when(whole, up).otherwise(0), F.when(whole, down).otherwise(0)
    return F.concat(*parts, span(lo, hi, top))


def segmented_reduce(df: DataFrame, segments: DataFrame, monoid: Monoid = SUM, value: str = "value", out: str = "value", radix: int = RADIX) -> DataFrame:
    """seg and `out`, the fold of the positions in [lo, hi) of each segment (seg, lo, hi); the identity for an empty one.

    Segments may overlap.  Each is cut into aligned intervals of radix ** level positions, of which it has few whatever its length; rows are folded
    to the intervals of a level from those of the level below.  Both sides meet by equality of level and interval, without a
    range test, so the work is in proportion to the rows and the intervals.  Only levels that the longest segment can use are made.
    """
    longest = segments.agg(F.max(F.col("hi") - F.col("lo"))).first()[0] or 0
    top = 0
    while radix ** (top + 1) <= longest:
        top += 1
    level = df.select(F.col("pos").cast("long").alias("idx"), F.col(value).alias("fold"))
    folds = level.select(F.lit(0).alias("level"), "idx", "fold")
    for k in range(1, top + 1):
        level = level.groupBy(chunk_of("idx", radix).alias("up")).agg(folded(monoid, F.col("idx")).alias("fold")).select(F.col("up").alias("idx"), "fold")
        folds = folds.unionByName(level.select(F.lit(k).alias("level"), "idx", "fold"))
    pieces = segments.where("hi > lo").select("seg", F.inline(intervals(top, radix)))
    met = pieces.join(folds, ["level", "idx"]).withColumn("first", F.col("idx") * F.element_at(F.array(*[F.lit(radix**k).cast("long") for k in range(top + 1)]), F.col("level") + 1))
    found = met.groupBy("seg").agg(folded(monoid, F.col("first")).alias("fold"))
    return segments.select("seg").join(found, "seg", "left").select("seg", monoid.started(F.col("fold")).alias(out))


def folded(monoid: Monoid, place: Column) -> Column:
    """The aggregate of folds at places."""
    return F.max_by("fold", F.when(F.col("fold").isNotNull(), place)) if monoid.ordered else monoid.aggregate(F.col("fold"))
