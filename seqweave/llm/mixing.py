"""Mixing sources to target weights by weighted fair queueing.

Each source shuffles its documents by a seeded hash.  A document's virtual finish time is the words of
its source up to and with it, divided by the source's target; a source with a target above its size is
read again, up to MOST times, each reading in the same order.  All (document, reading) pairs in the order
of finish time, cut where the running words pass the budget (the words of all documents), are the mix.

Targets: the budget shared by weight; a share above MOST times its source's size stops there and the
excess goes to the rest by weight, until none is above.

At scale: only keys and sizes are shuffled, never texts.  Prefix sums have two levels.  A source is
cut into buckets of its hash (so one that holds a third of all rows is spread over many tasks), buckets
are summed before the shuffle, and running sums over (source, bucket) offsets are added to sums inside
a bucket.  The cut of the budget works the same way over ranges of finish time.  Sums of buckets and
of ranges, whose number does not depend on the rows, are the only thing in one task.

Defined results: a null or empty text has size 0 and is never taken (0 words); a null source is a source
of its own, last; documents with equal ids are ordered by their text's hash, and rows equal in both share
the same place (their sizes count one by one); an empty table gives an empty one; a source without words
has target 0.  The weights of sources follow their order by code point.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import bounded_batches, ensure_columns, rows_of, slices, stored, utf8, with_columns
from .words import words

WEIGHTS = (5.0, 2.0, 1.0)
MOST = 3
BUCKETS = 1024
RANGES = 4096
IN_ONE = 10_000


def sized(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """key, source, size (words of the text) and tie (a hash of the text), in one pass and without the text."""
    ensure_columns(docs, key, source, text)
    bounded_batches(docs.sparkSession)
    schema = T.StructType([T.StructField("key", docs.schema[key].dataType), T.StructField("source", docs.schema[source].dataType), T.StructField("tie", T.LongType()), T.StructField("size", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            data, offsets = utf8(batch.column(3))
            yield with_columns(batch, ["key", "source", "tie"], {"size": pa.array(np.diff(words(data, offsets).first))})

    return docs.select(F.col(key).alias("key"), F.col(source).alias("source"), F.xxhash64(F.col(text)).alias("tie"), F.col(text).alias("text")).mapInArrow(run, schema)


def fill(sizes: Sequence[float], weights: Sequence[float], budget: float, most: float = MOST) -> list[float]:
    """Shares of the budget by weight, none above `most` times its size."""
    target, free = [0.0] * len(sizes), [k for k, s in enumerate(sizes) if s > 0]
    left = float(budget)
    while free:
        total = sum(weights[k] for k in free)
        full = [k for k in free if left * weights[k] / total > most * sizes[k]]
        if not full:
            for k in free:
                target[k] = left * weights[k] / total
            return target
        for k in full:
            target[k] = float(most * sizes[k])
        left -= sum(target[k] for k in full)
        free = [k for k in free if k not in set(full)]
    return target


def targets(by_source: DataFrame, weights: Sequence[float] = WEIGHTS, most: float = MOST) -> DataFrame:
    """source, source_size and target from source, source_size.  One row a source: the sums of a corpus by source, not its documents."""
    by_source = by_source.select("source", "source_size")
    schema = T.StructType([*by_source.schema.fields, T.StructField("target", T.DoubleType())])
    kind = to_arrow_type(by_source.schema["source"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for b in batches for r in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
        if not rows:
            return
        rows.sort(key=lambda r: (r[0] is None, r[0] if r[0] is not None else ""))
        sizes = [r[1] for r in rows]
        out = fill(sizes, [weights[k % len(weights)] for k in range(len(rows))], sum(sizes), most)
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], kind), pa.array(sizes, pa.int64()), pa.array(out, pa.float64())], names=["source", "source_size", "target"])

    return by_source.coalesce(1).mapInArrow(run, schema)


def running(df: DataFrame, by: list[str], bucket: str, order: list[Column], value: str, out: str) -> DataFrame:
    """df with the running sum of `value` inside `by`, in the order of (bucket, order)."""
    offsets = df.groupBy(*by, bucket).agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(*by).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = offsets.withColumn("_before", F.coalesce(F.sum("_sum").over(before), F.lit(0))).drop("_sum")
    inner = Window.partitionBy(*by, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = df.withColumn("_local", F.sum(value).over(inner))
    on = reduce(Column.__and__, [local[c].eqNullSafe(offsets[c]) for c in [*by, bucket]])
    return local.join(offsets, on=on).select(*[local[c] for c in df.columns], (F.col("_local") + F.col("_before")).alias(out))


def weighted_fair_queue(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", weights: Sequence[float] = WEIGHTS, most: int = MOST, seed: int = 17) -> DataFrame:
    """key, source, tie (a hash of the text), size, source_size, target, taken and readings of every row of docs."""
    spark = docs.sparkSession
    shuffled = F.xxhash64(F.lit(seed), "key", "tie")
    base = stored(sized(docs, key, source, text).withColumn("h", shuffled).withColumn("bucket", F.shiftrightunsigned("h", 64 - (BUCKETS - 1).bit_length())), "sizes")
    plan = stored(targets(base.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most), "targets")
    # The place of each document in its source's order: words up to and with it.
    placed = running(base, ["source"], "bucket", [F.col("h"), F.col("key"), F.col("tie")], "size", "upto")
    placed = placed.join(F.broadcast(plan) if plan.count() <= 10_000 else plan, placed["source"].eqNullSafe(plan["source"])).drop(plan["source"])
    placed = stored(placed, "places")
    # Readings: the finish time of reading e is (e * source_size + upto) / target; near time 1 the budget is spent.
    budget = placed.agg(F.sum("size")).first()[0] or 0
    live = (F.col("size") > 0) & (F.col("target") > 0)
    cap = F.least(F.lit(most), F.coalesce(F.ceil(F.try_divide("target", F.col("source_size").cast("double"))) + 1, F.lit(0)).cast("int"))
    turns = placed.where(live).select("h", "key", "tie", "size", F.explode(F.sequence(F.lit(0), cap - 1)).alias("e"), "source_size", "upto", "target")
    turns = turns.select("h", "key", "tie", "size", "e", finish_time(F.col("e")).alias("finish"))
    low, last = cutoff(turns, budget)
    took = F.lit(0)
    for e in range(most):
        finish = finish_time(F.lit(e))
        inside = F.lit(True) if low is None else finish < low
        if last is not None:
            here = F.struct(finish.alias("finish"), F.col("h"), F.col("key"), F.col("tie"), F.lit(e).alias("e"))
            bound = F.struct(*[F.lit(last[n]).cast(t).alias(n) for n, t in (("finish", "double"), ("h", "long"), ("key", placed.schema["key"].dataType), ("tie", "long"), ("e", "int"))])
            inside = inside | (here <= bound)
        took = took + F.when(live & (F.lit(e) < cap) & inside, 1).otherwise(0)
    return placed.select(F.col("key").alias(key), F.col("source").alias(source), "tie", "size", "source_size", "target", (F.col("size") * took).alias("taken"), took.cast("int").alias("readings"))


def mix(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", weights: Sequence[float] = WEIGHTS, most: int = MOST, seed: int = 17) -> DataFrame:
    """The rows of docs, each as often as the mix reads it; all columns stay, whatever their names.

    Rows equal in key, source and text are read as often in all as the queue says for them.  The queue passes through such copies one after the other, so
    it ends inside the copies of at most one key a source and reading; these alone are numbered, by partitions and then inside of them.
    """
    queue = weighted_fair_queue(docs, key, source, text, weights, most, seed)
    queue = queue.groupBy(F.col(key).alias("of_key"), F.col(source).alias("of_source"), F.col("tie").alias("of_tie"))
    queue = queue.agg(F.min("readings").alias("least"), F.max("readings").alias("most"), (F.sum("readings") - F.count("*") * F.min("readings")).alias("more")).where("most > 0")
    rows = rows_of(docs, key=F.col(key), source=F.col(source), tie=F.xxhash64(text))
    met = rows.join(queue, F.col("key").eqNullSafe(F.col("of_key")) & F.col("source").eqNullSafe(F.col("of_source")) & (F.col("tie") == F.col("of_tie")))
    turns = lambda df, n: df.select("doc", F.explode(F.sequence(F.lit(1), n)).alias("turn")).select("doc.*")
    even = turns(met.where("least = most"), F.col("least"))
    if queue.where("least < most").isEmpty():
        return even
    odd = stored(met.where("least < most").withColumns({"part": F.spark_partition_id(), "id": F.monotonically_increasing_id(), "one": F.lit(1)}), "copies")
    odd = running(odd, ["key", "source", "tie"], "part", [F.col("id")], "one", "number").withColumn("n", F.col("least") + F.when(F.col("number") <= F.col("more"), 1).otherwise(0))
    return even.unionByName(turns(odd.where("n > 0"), F.col("n")))


def finish_time(reading: Column) -> Column:
    """Null for a source without words, whose target is 0."""
    return F.try_divide((reading * F.col("source_size") + F.col("upto")).cast("double"), F.col("target"))


def cutoff(turns: DataFrame, budget: int) -> tuple[float | None, tuple | None]:
    """Where the running words of turns, by finish time and then h, key, tie, e, pass the budget.

    (low, last): all that finish before low are in, and those up to the row last.  low is None if all are in.
    The sums of at most RANGES + 1 ranges come to the driver; the range with the edge is cut again until
    it has at most IN_ONE rows, which are then ordered one by one.
    """
    low, high, room = 0.0, 2.0, budget
    for step in range(12):
        slot = F.least(F.lit(RANGES), F.floor((F.col("finish") - low) / (high - low) * RANGES)).cast("long")
        part = turns if not step else turns.where(F.col("finish").between(first, end))  # noqa: F821
        rows = part.groupBy(slot.alias("slot")).agg(F.sum("size").alias("words"), F.count("*").alias("n"), F.min("finish").alias("low"), F.max("finish").alias("high")).collect()
        edge = None
        for r in sorted(rows, key=lambda r: r["slot"]):
            if r["words"] > room:
                edge = r
                break
            room -= r["words"]
        if edge is None:
            return None, None
        first, end = edge["low"], edge["high"]
        low, high = first, end + max(1e-12, (end - first) * 1e-9)
        if edge["n"] <= IN_ONE or first == end:
            break
    order = Window.orderBy("finish", "h", "key", "tie", "e").rowsBetween(Window.unboundedPreceding, 0)
    inside = turns.where(F.col("finish").between(first, end)).withColumn("sum", F.sum("size").over(order)).where(F.col("sum") <= room)
    return first, inside.agg(F.max(F.struct("finish", "h", "key", "tie", "e")).alias("x")).first()["x"]
