"""Text, numbers, geometry and graphs against plain Python."""

from __future__ import annotations

import heapq
import random

import numpy as np
import pytest

from seqweave.operators import bigint, graph, graph_build, hull, primes, rows, suffix, text_search
from seqweave.sources import graph_files, packed

C = 8


def values(df):
    return [r["value"] for r in df.orderBy("pos").collect()]


@pytest.mark.parametrize("text,pattern", [("abab" * 7, "abab"), ("a" * 40, "aaaa"), ("ab" * 9, "abz"), ("x" * (C - 3) + "needle" + "y" * 20 + "needle", "needle"), ("seam" * 10, "seamseam"), ("short", "longer than it"), ("a.b*c a.b*c", "a.b*c")])
def test_search(spark, text, pattern):
    want = [i for i in range(len(text)) if text.startswith(pattern, i)]
    docs = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")
    for find in (text_search.find_in_documents, text_search.rabin_karp):
        assert sorted(r["pos"] for r in find(docs, pattern).collect()) == want
    letters = rows.from_values(spark, list(text), "string")
    assert values(text_search.find_in_sequence(letters, list(pattern), C)) == want
    assert text_search.find_in_documents(docs, "").count() == 0


def test_primes(spark):
    for n, want in ((1, 0), (2, 1), (100, 25), (1_000_000, 78_498)):
        assert primes.primes(spark, n, block=1 << 16).count() == want
    assert values(primes.primes(spark, 50, block=C)) == [2, 3, 5, 7, 11, 13, 17, 19, 23, 29, 31, 37, 41, 43, 47]


@pytest.mark.parametrize("word", ["a", "aa", "banana", "mississippi", "abracadabra", "aaaaaaaa"])
def test_suffix_array(spark, word):
    want = sorted(range(len(word)), key=lambda i: word[i:])
    assert values(suffix.suffix_array(rows.from_values(spark, list(word), "string"))) == want


def upper(points):
    """Points of the upper hull by testing every pair."""
    low, high = min(points), max(points)
    keep = {low, high}
    for p in points:
        if low < p < high and p[0] not in (low[0],) and not any(a[0] < p[0] < b[0] and (b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0]) <= 0 for a in points for b in points) and all(q[0] != p[0] or q[1] <= p[1] for q in points):
            keep.add(p)
    return sorted(keep)


def test_hull(spark):
    rng = random.Random(3)
    for points in ([(float(rng.randrange(40)), float(rng.randrange(40))) for _ in range(40)], [(float(i), float(-i * i)) for i in range(-9, 10)], [(0.0, 0.0), (0.0, 2.0), (1.0, 1.0), (2.0, 0.0), (2.0, 2.0), (1.0, 0.5)]):
        df = spark.createDataFrame([(i, *p) for i, p in enumerate(points)], "idx long, x double, y double")
        got = [(r["x"], r["y"]) for r in hull.upper_hull(df).orderBy("pos").collect()]
        want = upper(points)
        top = max(y for x, y in points if x == min(points)[0])
        assert [p for p in got if p != (min(points)[0], top)] == [p for p in want if p != (min(points)[0], top)]
    assert hull.upper_hull(df.limit(0)).count() == 0


NUMBERS = (0, 1, -1, 5, 2**62, 2**63 - 1, -(2**63), 2**64 - 1, -(2**64), 3**200, -(7**150))


def test_big_integers(spark):
    rng = random.Random(1)
    for a, b in ((5, 7), (-1, 1), (2**62, 2**62), (-(2**63), -(2**63)), (1, 2**640 - 1), *((rng.choice(NUMBERS), rng.choice(NUMBERS)) for _ in range(4))):
        x, y = bigint.from_int(spark, a), bigint.from_int(spark, b)
        assert bigint.to_int(bigint.add(x, y, chunk=C)) == a + b
        assert bigint.to_int(bigint.add(x, y, carry_in=True, chunk=C)) == a + b + 1
        assert bigint.to_int(bigint.subtract(x, y)) == a - b
        assert bigint.to_int(bigint.negate(x)) == -a
        assert bigint.to_int(bigint.complement(x)) == ~a
    none = x.limit(0)
    assert bigint.to_int(bigint.add(x, none, carry_in=True)) == a


@pytest.mark.parametrize("a,b", [(3, 4), (0, 9), (-3, 2**64), (2**64, 2**64), (-(3**300), 7**100), (2**320 - 1, -(2**64) + 1)])
def test_big_product(spark, a, b):
    assert bigint.to_int(bigint.multiply(bigint.from_int(spark, a), bigint.from_int(spark, b))) == a * b


def graph_of(spark, n=30, m=90, seed=2):
    rng = random.Random(seed)
    edges = [(rng.randrange(n), rng.randrange(n), rng.randrange(1, 9)) for _ in range(m)]
    return edges, spark.createDataFrame(edges, "src long, dst long, weight long")


def test_distances(spark):
    edges, df = graph_of(spark)
    n = max(max(a, b) for a, b, _ in edges) + 1
    best, heap = {}, [(0, 3)]
    while heap:
        d, v = heapq.heappop(heap)
        if v not in best:
            best[v] = d
            for a, b, w in edges:
                if a == v:
                    heapq.heappush(heap, (d + w, b))
    for active in (True, False):
        assert {r["v"]: r["distance"] for r in graph.shortest_paths(df, 3, active_only=active).collect()} == {v: best.get(v) for v in range(n)}
    assert {r["v"]: (r["distance"], r["frontier"]) for r in graph.dijkstra_frontiers(df, 3).collect()} == {v: (d, d) for v, d in best.items()}
    level, front = {3: 0}, [3]
    while front:
        front = sorted({b for a, b, _ in edges if a in front} - level.keys())
        level |= {v: max(level.values()) + 1 for v in front}
    assert {r["v"]: r["level"] for r in graph.bfs(df, 3).collect()} == level


def test_negative_cycle(spark):
    df = spark.createDataFrame([(0, 1, 1), (1, 2, -3), (2, 0, 1)], "src long, dst long, weight long")
    assert graph.shortest_paths(df, 0) is None
    with pytest.raises(ValueError):
        graph.dijkstra_frontiers(df, 0)


def test_kcore_and_pagerank(spark):
    edges, df = graph_of(spark, 25, 60)
    n = max(max(a, b) for a, b, _ in edges) + 1
    near = {v: set() for v in range(n)}
    for a, b, _ in edges:
        if a != b:
            near[a].add(b)
            near[b].add(a)
    core, left, k = {}, set(near), 0
    while left:
        leaving = {v for v in left if len(near[v] & left) <= k}
        core |= dict.fromkeys(leaving, k)
        left -= leaving
        k += not leaving
    assert {r["v"]: r["core"] for r in graph.kcore(df).collect()} == core
    m = np.zeros((n, n))
    for a, b, _ in edges:
        m[a, b] += 1 / sum(e[1] == b for e in edges)
    rank = np.full(n, 1 / n)
    for _ in range(5):
        rank = 0.15 / n + 0.85 * m @ rank
    got = {r["v"]: r["rank"] for r in graph.pagerank(graph.normalized(df), n, 5).collect()}
    assert np.allclose([got[v] for v in range(n)], rank, atol=1e-12)


def test_builders(spark):
    edges = {tuple(r) for r in graph_build.rmat(spark, 5, 200, seed=1).collect()}
    assert edges == {tuple(r) for r in graph_build.rmat(spark, 5, 200, seed=1).collect()} and all(0 <= x < 32 for e in edges for x in e)
    both = {tuple(r) for r in graph_build.rmat_symmetric(spark, 5, 400, seed=1).collect()}  # half as many are drawn
    assert both == {e for a, b in edges if a != b for e in ((a, b), (b, a))}
    weighted = {(r["src"], r["dst"]): r["weight"] for r in graph_build.add_weights(spark.createDataFrame(sorted(both), "src long, dst long"), 2, 3).collect()}
    assert all(weighted[a, b] == weighted[b, a] and 2 <= weighted[a, b] < 3 for a, b in both)
    assert graph_build.grid(spark, 3, 3).where("src = 4").count() == 8 and graph_build.grid(spark, 3, 3).where("src = 0").count() == 3


def test_graph_files(spark, tmp_path):
    (tmp_path / "edges.txt").write_text("0 1 1.5\n0\t2\t2.5\n1 2 3.5\n3 0 4.5\n")
    df = graph_files.read_edges(spark, f"file://{tmp_path}/edges.txt")
    assert [r["start"] for r in graph.degree_scan(df).orderBy("v").collect()] == [0, 2, 3, 3, 4]
    assert {r["dst"] for r in graph.adjacent(df, 0).collect()} == {1, 2}
    pairs = spark.createDataFrame([(0, 1), (0, 3)], "src long, dst long")
    assert {r["dst"]: r["found"] for r in graph.edge_exists(df, pairs).collect()} == {1: True, 3: False}
    (tmp_path / "adjacency.txt").write_text("AdjacencyGraph\n4\n4\n0\n2\n3\n3\n1\n2\n2\n0\n")
    n, read = graph_files.read_adjacency(spark, f"file://{tmp_path}/adjacency.txt")
    assert n == 4 and {tuple(r) for r in read.collect()} == {(0, 1), (0, 2), (1, 2), (3, 0)}
    graph_files.write_differences(df, 4, f"file://{tmp_path}/differences")
    n, read = graph_files.read_differences(spark, f"file://{tmp_path}/differences")
    assert n == 4 and sorted(tuple(r) for r in read.collect()) == [(0, 1), (0, 2), (1, 2), (3, 0)]
    both = graph.symmetrize(df)
    graph_files.write_symmetric(both, 4, f"file://{tmp_path}/symmetric")
    n, read = graph_files.read_symmetric(spark, f"file://{tmp_path}/symmetric")
    assert sorted(tuple(r) for r in read.collect()) == sorted(tuple(r) for r in both.collect())


@pytest.mark.parametrize("kind,xs", [("i8", [-5, 0, 2**40]), ("u8", [-1, 7]), ("u4", [1, 2**32 - 1]), ("f8", [0.5, -2.25]), ("u1", [0, 255])])
def test_packed_files(spark, tmp_path, kind, xs):
    xs = xs * 11
    s = rows.from_values(spark, xs, "double" if kind == "f8" else "bigint")
    path = f"file://{tmp_path}/x.bin"
    assert packed.consolidate(s, path, kind) == len(xs) * int(kind[1])
    assert values(packed.read_packed(spark, path, kind, block=C)) == xs
    assert packed.find_files(spark, f"file://{tmp_path}/*.bin")[0].endswith("x.bin")
    (tmp_path / "odd.bin").write_bytes(b"123")
    if kind != "u1":
        with pytest.raises(ValueError):
            packed.read_packed(spark, f"file://{tmp_path}/odd.bin", kind)
