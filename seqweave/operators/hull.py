"""Upper convex hull.

Each task keeps the upper hull of its own points; rounds merge hulls of several tasks at a time until few points are left.
A hull has few points next to its input, so the rounds move little.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.ship import ship_package
from ..plans.storage import stored
from .scan import renumber

FINISH = 100_000
SCHEMA = "idx long, x double, y double"


def chain(idx: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The places of the upper hull's points from left to right; collinear points between its ends are left out, and of
    equal points the one with the larger idx stays (the least idx at the left end)."""
    order = np.lexsort((idx, y, x))
    kept: list[int] = []
    last = None
    for k in order.tolist():
        if last is not None and x[k] == x[last] and y[k] == y[last]:
            if len(kept) > 1:
                kept[-1] = k
            last = k
            continue
        while len(kept) > 1:
            a, b = kept[-2], kept[-1]
            if (x[b] - x[a]) * (y[k] - y[a]) - (y[b] - y[a]) * (x[k] - x[a]) >= 0:
                kept.pop()
            else:
                break
        kept.append(k)
        last = k
    return np.array(kept, np.int64)


BINS = 4096


def outer(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The places of points that may be on the upper hull: none below the hull of the highest points of BINS strips of x."""
    low, high = x.min(initial=np.inf), x.max(initial=-np.inf)
    if len(x) <= 4 * BINS or not low < high:
        return np.arange(len(x))
    strip = np.minimum(((x - low) * (BINS / (high - low))).astype(np.int64), BINS - 1)
    order = np.lexsort((y, strip))
    tops = order[np.flatnonzero(np.diff(np.append(strip[order], BINS)))]
    tops = np.concatenate([tops, np.flatnonzero((x == low) | (x == high))])
    hull = tops[chain(np.arange(len(tops)), x[tops], y[tops])]
    line = np.interp(x, x[hull], y[hull])
    slack = 1e-9 * (np.abs(y).max() + 1)
    return np.flatnonzero((y >= line - slack) | (x == low) | (x == high))


def local_hulls(points: DataFrame) -> DataFrame:
    ship_package(points.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            held = t if held is None else pa.concat_tables([held, t])
            held = held.take(pa.array(outer(held["x"].to_numpy(), held["y"].to_numpy())))
            place = chain(*(held[c].to_numpy() for c in ("idx", "x", "y")))
            held = held.take(pa.array(place))
        if held is not None:
            yield from held.combine_chunks().to_batches()

    return points.select(F.col("idx").cast("long"), F.col("x").cast("double"), F.col("y").cast("double")).mapInArrow(run, SCHEMA)


def upper_hull(points: DataFrame, finish: int = FINISH, fan_in: int = 16) -> DataFrame:
    """pos, idx, x, y of the upper hull from left to right, its ends by (x, y) included."""
    left = stored(local_hulls(points), "hulls")
    parts = max(1, left.rdd.getNumPartitions())
    while parts > 1 and left.count() > finish:
        parts = max(1, parts // fan_in)
        left = stored(local_hulls(left.coalesce(parts)), "hulls")
    whole = local_hulls(left.coalesce(1))
    # Points of a hull have distinct x but for the ends; its size is small by now.
    ordered = whole.withColumn("pos", F.monotonically_increasing_id())
    return renumber(ordered).select("pos", "idx", "x", "y")
