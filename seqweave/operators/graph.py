"""Graph algorithms over edge tables (src, dst, weight): one table of longs, no adjacency lists in memory.

Iterations write what a round changes to the shared folder, which cuts the lineage and survives lost executors; what is
joined each round is the frontier or the changed vertices.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.monoids import SUM, Monoid
from ..plans.storage import stored
from .scan import CHUNK, exclusive_scan

UNREACHED = (1 << 63) - 1


def vertex_count(edges: DataFrame) -> int:
    """The largest endpoint and one; 0 without edges."""
    most = edges.agg(F.max(F.greatest("src", "dst"))).first()[0]
    return 0 if most is None else most + 1


def vertices(edges: DataFrame, n: int | None = None) -> DataFrame:
    return edges.sparkSession.range(vertex_count(edges) if n is None else n).select(F.col("id").alias("v"))


def adjacent(edges: DataFrame, v: int) -> DataFrame:
    return edges.where(F.col("src") == v).select("dst", "weight")


def edge_exists(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs (src, dst) with `found`."""
    known = edges.select("src", "dst").distinct().withColumn("found", F.lit(True))
    return pairs.join(known, ["src", "dst"], "left").select("src", "dst", F.coalesce("found", F.lit(False)).alias("found"))


def degrees(edges: DataFrame, n: int | None = None) -> DataFrame:
    """v and degree (out), zeros included."""
    counts = edges.groupBy(F.col("src").alias("v")).agg(F.count("*").alias("degree"))
    return vertices(edges, n).join(counts, "v", "left").select("v", F.coalesce("degree", F.lit(0)).alias("degree"))


def degree_scan(edges: DataFrame, n: int | None = None, chunk: int = CHUNK) -> DataFrame:
    """v and start for v of [0, n]: the edges of all smaller vertices; the last is the number of edges."""
    n = vertex_count(edges) if n is None else n
    sequence = degrees(edges, n).select(F.col("v").alias("pos"), F.col("degree").alias("value"))
    end = edges.sparkSession.range(1).select(F.lit(n).cast("long").alias("pos"), F.lit(0).cast("long").alias("value"))
    return exclusive_scan(sequence.unionByName(end), chunk=chunk).select(F.col("pos").alias("v"), F.col("scan").alias("start"))


def reduce_over_edges(edges: DataFrame, f: Callable[[Column, Column], Column], monoid: Monoid = SUM, n: int | None = None) -> DataFrame:
    """v and value: the fold of f(dst, weight) over its out-edges; the identity without."""
    folded = edges.select(F.col("src").alias("v"), f(F.col("dst"), F.col("weight")).alias("x")).groupBy("v").agg(monoid.aggregate(F.col("x")).alias("x"))
    return vertices(edges, n).join(folded, "v", "left").select("v", monoid.started(F.col("x")).alias("value"))


def merge(a: DataFrame, b: DataFrame, n_a: int | None = None) -> DataFrame:
    """The edges of a and of b, whose source vertices follow a's; destinations stay as they are."""
    n_a = vertex_count(a) if n_a is None else n_a
    return a.unionByName(b.withColumn("src", F.col("src") + n_a))


def transpose(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *[c for c in edges.columns if c not in ("src", "dst")])


def symmetrize(edges: DataFrame) -> DataFrame:
    """Both directions, no loops, each edge once."""
    plain = edges.select("src", "dst").where("src <> dst")
    return plain.unionByName(transpose(plain)).distinct()


def from_adjacency(lists: DataFrame) -> DataFrame:
    """src and dst from v and neighbours (an array)."""
    return lists.select(F.col("v").alias("src"), F.explode("neighbours").alias("dst"))


def normalized(edges: DataFrame) -> DataFrame:
    """row, col, value: for each edge 1 / (in-degree of its destination)."""
    counts = edges.groupBy("dst").agg(F.count("*").alias("n"))
    return edges.join(counts, "dst").select(F.col("src").alias("row"), F.col("dst").alias("col"), (1 / F.col("n")).alias("value"))


def graph_stats(edges: DataFrame, n: int | None = None) -> DataFrame:
    """One row: vertices, edges, max_degree."""
    most = edges.groupBy("src").agg(F.count("*").alias("n")).agg(F.coalesce(F.max("n"), F.lit(0)).alias("max_degree"), F.coalesce(F.sum("n"), F.lit(0)).alias("edges"))
    return most.select(F.lit(vertex_count(edges) if n is None else n).cast("long").alias("vertices"), "edges", "max_degree")


class Log:
    """A table that grows by few rows a round: parts are merged WIDTH at a time, so a row is written again a logarithmic number of times and
    a plan reads a logarithmic number of parts.  `fold` may put rows of a merge together."""

    WIDTH = 8

    def __init__(self, fold: Callable[[DataFrame], DataFrame] = lambda df: df) -> None:
        self.fold, self.levels = fold, [[]]

    def add(self, part: DataFrame) -> None:
        self.levels[0].append(part)
        for k in range(len(self.levels)):
            if len(self.levels[k]) < self.WIDTH:
                return
            if k + 1 == len(self.levels):
                self.levels.append([])
            self.levels[k + 1].append(stored(self.fold(joined(self.levels[k])), "merged"))
            self.levels[k] = []

    def rows(self) -> DataFrame:
        """All rows, versions of one vertex included."""
        return joined([part for level in self.levels for part in level])

    def table(self) -> DataFrame:
        return self.fold(self.rows())


def joined(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def bfs(edges: DataFrame, start: int, rounds: int = 1 << 20) -> DataFrame:
    """v and level of what can be reached from start."""
    links = stored(edges.select("src", "dst").distinct(), "edges")
    frontier = stored(edges.sparkSession.range(1).select(F.lit(start).cast("long").alias("v"), F.lit(0).alias("level")), "seen")
    seen = Log()
    seen.add(frontier)
    for level in range(1, rounds + 1):
        new = links.join(frontier, F.col("src") == F.col("v"), "left_semi").select(F.col("dst").alias("v")).distinct().join(seen.rows(), "v", "left_anti")
        frontier = stored(new.withColumn("level", F.lit(level)), "frontier")
        if frontier.isEmpty():
            break
        seen.add(frontier)
    return seen.rows()


def shortest_paths(edges: DataFrame, start: int, n: int | None = None, active_only: bool = True) -> DataFrame | None:
    """v and distance from start for each vertex of [0, n) (unreached: null); None if a negative cycle can be reached.

    A round relaxes the out-edges of the vertices whose distance has changed (or of all reached ones), takes the least offer of each destination, and writes
    down what is better than before: rows in proportion to the changes.  Vertices remember whom their distance comes from; where weights are negative, these
    links are followed after 1, 2, 4, 8 ... rounds, and a cycle of them is a negative one.
    """
    n = vertex_count(edges) if n is None else n
    links = stored(edges.select("src", "dst", F.col("weight").alias("w")).groupBy("src", "dst").agg(F.min("w").alias("w")), "edges")
    negative = not links.where("w < 0").isEmpty()
    best = Log(lambda df: df.groupBy("v").agg(F.min(F.struct("d", "parent")).alias("x")).select("v", "x.*"))
    changed = stored(edges.sparkSession.range(1).select(F.lit(start).cast("long").alias("v"), F.lit(0).cast(links.schema["w"].dataType).alias("d"), F.lit(start).cast("long").alias("parent")), "distances")
    best.add(changed)
    for k in range(1, n + 1):
        live = changed if active_only else best.table()
        offers = live.select("v", "d").join(links, F.col("v") == F.col("src")).groupBy(F.col("dst").alias("at")).agg(F.min(F.struct((F.col("d") + F.col("w")).alias("d"), F.col("src").alias("parent"))).alias("x"))
        known = best.rows().select("v", F.col("d").alias("old"))
        step = offers.join(known, F.col("at") == F.col("v"), "left").groupBy("at", "x").agg(F.min("old").alias("old"))
        changed = stored(step.where(F.col("old").isNull() | (F.col("x.d") < F.col("old"))).select(F.col("at").alias("v"), F.col("x.d").alias("d"), F.col("x.parent").alias("parent")), "distances")
        if changed.isEmpty():
            found = best.table().select(F.col("v").alias("at"), F.col("d").alias("distance"))
            return vertices(edges, n).join(found, F.col("v") == F.col("at"), "left").select("v", "distance")
        best.add(changed)
        if negative and k & (k - 1) == 0 and cyclic(best.table().select("v", "parent"), start):
            return None
    return None


def cyclic(parents: DataFrame, start: int) -> bool:
    """Whether some vertex does not come to start by its parents; parents of parents are taken as often as the logarithm of their number."""
    at = stored(parents, "parents")
    if not at.where((F.col("v") == start) & (F.col("parent") != start)).isEmpty():
        return True
    for _ in range(at.count().bit_length()):
        if at.where(F.col("parent") != start).isEmpty():
            return False
        far = at.select(F.col("v").alias("via"), F.col("parent").alias("far"))
        at = stored(at.join(far, F.col("parent") == F.col("via")).select("v", F.col("far").alias("parent")), "parents")
    return not at.where(F.col("parent") != start).isEmpty()


def dijkstra_frontiers(edges: DataFrame, start: int, n: int | None = None) -> DataFrame:
    """v, distance and frontier of what can be reached.  There is a frontier for each distance from 0 on, empty ones included, so a vertex's
    is its distance; weights must be whole numbers from 0 on."""
    if not edges.where((F.col("weight") < 0) | (F.col("weight") != F.col("weight").cast("long"))).isEmpty():
        raise ValueError("a weight is negative or no whole number")
    found = shortest_paths(edges, start, n).where("distance is not null")
    return found.select("v", "distance", F.col("distance").cast("long").alias("frontier"))


def kcore(edges: DataFrame, n: int | None = None) -> DataFrame:
    """v and coreness for each vertex of [0, n); edges count as undirected, once, without loops.

    Bounds from above, degrees at first: a vertex's falls to the largest h such that h of its neighbours have bounds of h or more, until none falls.
    A round looks at the vertices that have a neighbour whose bound fell below theirs, and writes the bounds that fall.  Neighbours are
    counted by bound, cut at the vertex's own, before they meet in its window, so a hub's window holds distinct bounds only.
    """
    n = vertex_count(edges) if n is None else n
    links = stored(symmetrize(edges), "edges")
    fell = stored(links.groupBy(F.col("src").alias("v")).agg(F.count("*").alias("core")), "bounds")
    bounds = Log(lambda df: df.groupBy("v").agg(F.min("core").alias("core")))
    bounds.add(fell)
    down = Window.partitionBy("src").orderBy(F.desc("bound")).rowsBetween(Window.unboundedPreceding, 0)
    while not fell.isEmpty():
        known = bounds.table()
        touched = links.join(fell, F.col("src") == F.col("v")).groupBy("dst").agg(F.min("core").alias("low"))
        looked = touched.join(known, F.col("dst") == F.col("v")).where("low < core").select(F.col("v").alias("src"), F.col("core").alias("own"))
        near = links.join(looked, "src").join(known, F.col("dst") == F.col("v"))
        counts = near.groupBy("src", "own", F.least("own", "core").alias("bound")).agg(F.count("*").alias("n"))
        best = counts.withColumn("n", F.sum("n").over(down)).groupBy("src", "own").agg(F.max(F.least("bound", "n")).alias("core"))
        fell = stored(best.where("core < own").select(F.col("src").alias("v"), "core"), "bounds")
        bounds.add(fell)
    return vertices(edges, n).join(bounds.table().withColumnRenamed("v", "at"), F.col("v") == F.col("at"), "left").select("v", F.coalesce("core", F.lit(0)).alias("core"))


def pagerank(matrix: DataFrame, n: int, iterations: int = 10, damping: float = 0.85, store_each: int = 3) -> DataFrame:
    """v and rank after fixed iterations of rank = (1 - d) / n + d * matrix * rank; matrix: row, col, value.  Nothing is redistributed."""
    spark = matrix.sparkSession
    cells = stored(matrix.select("row", "col", "value"), "matrix")
    rank = spark.range(n).select(F.col("id").alias("v"), F.lit(1.0 / n).alias("rank"))
    for k in range(1, iterations + 1):
        got = cells.join(rank, F.col("col") == F.col("v")).groupBy(F.col("row").alias("at")).agg(F.sum(F.col("value") * F.col("rank")).alias("got"))
        rank = spark.range(n).select(F.col("id").alias("v")).join(got, F.col("v") == F.col("at"), "left").select("v", (F.lit((1 - damping) / n) + damping * F.coalesce("got", F.lit(0.0))).alias("rank"))
        if k % store_each == 0 and k < iterations:
            rank = stored(rank, "ranks")
    return rank
