"""Checks that can't be pruned, helper names, identities, segments of any length, and loops that write what changes."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqweave.functions.monoids import LAST, MAX, MIN, SUM
from seqweave.functions.names import free
from seqweave.operators import graph, halo, hull, partition, reduce, rows, scan, text_search, zips
from seqweave.plans import queries as core
from seqweave.sources import graph_files


def values(df):
    return [r["value"] for r in df.orderBy("pos").collect()]


@pytest.mark.parametrize("read", [lambda d: d.count(), lambda d: d.select("pos").collect(), lambda d: d.collect()])
def test_checks_hold_whatever_is_read(spark, read, tmp_path):
    a, b = rows.from_values(spark, [1, 2, 3]), rows.from_values(spark, [1, 2])
    for bad in (zips.zip_strict(a, b), zips.zip_all([a, a, b], ["x", "y", "z"]), partition.partition(a, 2, lambda v: v), partition.route(a, a, 2)):
        with pytest.raises(Exception, match="lengths|outside"):
            read(bad)
    assert read(zips.zip_strict(a, a)) and read(partition.partition(a, 4, lambda v: v)) and read(partition.route(a, a, 4))


def test_bad_files_are_refused(spark, tmp_path):
    (tmp_path / "lines").write_text("1 2\n3\n")
    with pytest.raises(Exception, match="no edge"):
        graph_files.read_edges(spark, str(tmp_path / "lines")).select("weight").count()
    for name, text, read in (("a", "AdjacencyGraph\n2\n2\n0\n1\n1\n", graph_files.read_adjacency), ("b", "2\n2\n1\n1\n1\n0\n9\n", graph_files.read_differences), ("c", "", graph_files.read_differences)):
        (tmp_path / name).write_text(text)
        with pytest.raises(ValueError):
            read(spark, str(tmp_path / name))
    edges = spark.createDataFrame([(0, 1), (0, 1), (2, 0)], "src long, dst long")
    graph_files.write_adjacency(edges, 4, str(tmp_path / "w"))
    n, back = graph_files.read_adjacency(spark, str(tmp_path / "w"))
    assert n == 4 and sorted(map(tuple, back.collect())) == [(0, 1), (0, 1), (2, 0)]


def test_slices_that_leave_the_sequence(spark):
    s = rows.from_values(spark, range(10))
    assert values(rows.cut(s, 3, 10)) == list(range(3, 10)) and values(rows.cut(s, 3, 5, n=10)) == [3, 4]
    for bad in ((0, 11), (5, 4), (-1, 3)):
        with pytest.raises(ValueError):
            rows.cut(s, *bad)
    assert rows.cut_or_empty(s, 0, 11).count() == 0 and values(rows.cut_chunks(s, 1, 9, 4)) == list(range(4, 10))


@pytest.mark.parametrize("n", [0, 60, 700])
def test_slice_queries_on_short_tables(spark, tmp_path, n):
    """As their SQL: the rows of the slice that the table has."""
    spark.read.parquet("/root/testdata/sf0.001/events.parquet").orderBy("event_id").limit(n).write.parquet(str(tmp_path / "events.parquet"))
    every = [r["value"] for r in core.ev(spark, str(tmp_path)).orderBy("pos").collect()]
    assert len(every) == n
    for name, start, end in (("seq_cut", 100, 7000), ("seq_to_list", 0, 1000)):
        out = core.QUERIES[name](spark, str(tmp_path)).orderBy("pos").collect()
        assert [tuple(r[c] for c in ("pos", "value")) for r in out] == list(enumerate(every[start:end]))


def test_helper_names_do_not_touch_a_callers(spark):
    names = ["_chunk", "_local", "_at", "_before", "_part", "_n", "_own", "_h", "_start", "_CHUNK_"]
    s = spark.createDataFrame([(k, 9 - k, *([f"x{k}"] * len(names))) for k in range(10)], "pos long, value long, " + ", ".join(f"{n} string" for n in names))
    assert free(s, "_chunk", "_new") == ["_chunk__", "_new"]
    for out in (scan.exclusive_scan(s, chunk=3).drop("scan"), scan.renumber(s, chunk=3), partition.sort_values(s), partition.permutation(s), halo.with_halo(s, 2, 3).drop("ahead")):
        assert sorted(out.columns) == sorted(s.columns)
        for r in out.collect():
            assert {r[n] for n in names} == {f"x{9 - r['value']}"}


def test_one_identity_for_folds_scans_and_segments(spark):
    s = rows.from_values(spark, [-5, -2, -9])
    whole = spark.createDataFrame([(0, 0, 3)], "seg long, lo long, hi long")
    for monoid, want, scanned in ((MAX, 0, [0, 0, 0]), (MAX.starting_at(-100), -2, [-5, -2, -2]), (SUM, -16, [-5, -7, -16])):
        assert values(reduce.reduce_values(s, monoid).withColumn("pos", F.lit(0))) == [want]
        assert [r["scan"] for r in scan.inclusive_scan(s, monoid, chunk=2).orderBy("pos").collect()] == scanned
        assert scan.segmented_reduce(s, whole, monoid).first()["value"] == want
    assert reduce.reduce_values(s.limit(0), MAX).first()["value"] == 0


def test_segments_of_all_lengths(spark):
    rng = random.Random(4)
    xs = [rng.randrange(-50, 50) for _ in range(5000)]
    cuts = [tuple(sorted((rng.randrange(5001), rng.randrange(5001)))) for _ in range(150)] + [(x, x + rng.randrange(4)) for x in rng.sample(range(4990), 150)] + [(0, 5000), (0, 4096), (16, 272), (7, 7), (4999, 5000), (0, 0)]
    segments = spark.createDataFrame([(k, *c) for k, c in enumerate(cuts)], "seg long, lo long, hi long")
    s = rows.from_values(spark, xs)
    some = s.withColumn("value", F.when(F.col("pos") % 7 == 0, F.col("value")))
    last = lambda a, b: next((xs[i] for i in range(b - 1, a - 1, -1) if i % 7 == 0), None)
    for df, monoid, fold in ((s, SUM, lambda a, b: sum(xs[a:b])), (s, MIN, lambda a, b: min(xs[a:b], default=(1 << 63) - 1)), (some, LAST, last)):
        out = scan.segmented_reduce(df, segments, monoid)
        assert {r["seg"]: r["value"] for r in out.collect()} == {k: fold(a, b) for k, (a, b) in enumerate(cuts)}
    plan = scan.segmented_reduce(s, segments)._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join" in line]
    assert joins and not any(">" in line or "<" in line for line in joins)
    assert scan.segmented_reduce(s, segments.limit(0)).count() == 0


def test_levels_follow_the_size(spark, monkeypatch):
    s = rows.iota(spark, 100)
    assert scan.levels_of(s) == scan.levels_of(rows.from_values(spark, [1])) == 2 and scan.levels_of(rows.iota(spark, 1 << 50)) == 3
    monkeypatch.setattr(scan, "LARGE", 1)
    assert scan.levels_of(s) == 3 and [r["scan"] for r in scan.exclusive_scan(s, chunk=4).orderBy("pos").collect()] == [k * (k - 1) // 2 for k in range(100)]


def test_far_positions(spark):
    far = (1 << 53) + 1
    s = spark.createDataFrame([(far + k, 1) for k in range(4)], "pos long, value long")
    assert [r["scan"] for r in scan.inclusive_scan(s, chunk=2).orderBy("pos").collect()] == [1, 2, 3, 4]


def test_search_is_linear_in_the_text():
    rng = random.Random(3)
    for _ in range(400):
        data, pattern = (np.array([rng.randrange(3) for _ in range(rng.randrange(n))], np.uint32) for n in (60, 9))
        want = [i for i in range(len(data) - len(pattern) + 1) if (data[i : i + len(pattern)] == pattern).all()] if len(pattern) else []
        assert text_search.kmp_starts(data, pattern).tolist() == want and text_search.rolling_starts(data, pattern).tolist() == want
    assert text_search.borders(np.array([1, 1, 2, 1, 1, 1])) == [0, 1, 0, 1, 2, 2]
    flat = np.zeros(100_000, np.uint32)
    for search in (text_search.kmp_starts, text_search.rolling_starts):
        assert len(search(flat, flat[:20_000])) == 80_001


def test_search_across_windows(spark, monkeypatch):
    monkeypatch.setattr(text_search, "WINDOW", 10)
    text = "abaabaababa" * 9
    docs = spark.createDataFrame([(1, text), (2, None), (3, "ba")], "doc_id long, text string")
    want = [i for i in range(len(text)) if text.startswith("aba", i)]
    for search in (text_search.find_in_documents, text_search.rabin_karp):
        assert sorted(r["pos"] for r in search(docs, "aba").collect()) == want and search(docs, "").count() == 0


def test_points_below_the_hull_go_first():
    rng = np.random.default_rng(5)
    x, y = rng.normal(size=50_000), rng.normal(size=50_000)
    kept = hull.outer(x, y)
    assert len(kept) < 5000
    assert set(hull.chain(np.arange(len(x)), x, y)) == set(kept[hull.chain(kept, x[kept], y[kept])])
    assert len(hull.outer(np.ones(50_000), y)) == 50_000


def path(spark, n):
    return spark.range(n - 1).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"), F.lit(1).cast("long").alias("weight"))


def test_rounds_write_what_changes(spark, monkeypatch):
    sizes = []

    def counted(df, what="step", real=graph.stored):
        out = real(df, what)
        sizes.append((what, out.count()))
        return out

    monkeypatch.setattr(graph, "stored", counted)
    n = 24
    out = graph.shortest_paths(path(spark, n), 0)
    assert sorted(map(tuple, out.collect())) == [(k, k) for k in range(n)]
    assert sum(c for what, c in sizes if what == "distances") == n and sum(c for what, c in sizes if what == "merged") <= n
    sizes.clear()
    assert {r["core"] for r in graph.kcore(path(spark, n)).collect()} == {1}
    assert sum(c for what, c in sizes if what in ("leaving", "lost")) <= 2 * n


def test_negative_cycles_end_soon(spark, monkeypatch):
    edges = path(spark, 40).union(spark.createDataFrame([(3, 2, -2)], "src long, dst long, weight long"))
    rounds = []
    monkeypatch.setattr(graph, "cyclic", lambda *a, real=graph.cyclic: rounds.append(1) or real(*a))
    assert graph.shortest_paths(edges, 0) is None and len(rounds) <= 4
    fine = path(spark, 6).union(spark.createDataFrame([(0, 3, 9), (5, 2, -1)], "src long, dst long, weight long"))
    assert [r["distance"] for r in graph.shortest_paths(fine, 0).orderBy("v").collect()] == [0, 1, 2, 3, 4, 5]


def test_frontiers_are_distances(spark):
    edges = spark.createDataFrame([(0, 1, 5), (1, 2, 0), (0, 3, 2)], "src long, dst long, weight long")
    assert sorted(map(tuple, graph.dijkstra_frontiers(edges, 0).collect())) == [(0, 0, 0), (1, 5, 5), (2, 5, 5), (3, 2, 2)]
    with pytest.raises(ValueError):
        graph.dijkstra_frontiers(edges.select("src", "dst", F.lit(0.5).alias("weight")), 0)


def test_kcore_against_peeling(spark):
    rng = random.Random(2)
    edges = {(rng.randrange(40), rng.randrange(40)) for _ in range(120)}
    near = {v: {b for a, b in edges if a == v and b != v} | {a for a, b in edges if b == v and a != v} for v in range(40)}
    core, left, k = {}, {v: set(x) for v, x in near.items()}, 0
    while left:
        k = max(k, min(len(x) for x in left.values()))
        for v in [v for v, x in left.items() if len(x) <= k]:
            core[v] = k
            for u in left.pop(v):
                left[u].discard(v) if u in left else None
    out = graph.kcore(spark.createDataFrame(sorted(edges), "src long, dst long"), 40)
    assert {r["v"]: r["core"] for r in out.collect()} == core


def test_values_of_a_generator_are_made_once(spark):
    import pyarrow as pa

    def random_count(a, b):
        return pa.array(np.zeros(np.random.default_rng().integers(1, 50), np.int64))

    out = halo.flat_tabulate(spark, 100, random_count, block=10)
    places = sorted(r["pos"] for r in out.collect())
    assert places == list(range(len(places)))
