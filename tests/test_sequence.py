"""Sequence operators against lists, with 8 positions a chunk so that every border case is small."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from seqweave.functions.monoids import LAST, MAX, MIN, SUM, XOR
from seqweave.operators import halo, partition, reduce, rows, scan, zips

C = 8
SIZES = (0, 1, 7, C - 1, C, C + 1, 2 * C + 3)


def values(df):
    found = sorted((r["pos"], r["value"]) for r in df.select("pos", "value").collect())
    assert [p for p, _ in found] == list(range(len(found)))
    return [v for _, v in found]


def make(spark, xs, kind="bigint"):
    return rows.from_values(spark, xs, kind)


@pytest.mark.parametrize("n", SIZES)
def test_pipeline_of_all_sizes(spark, n):
    s = rows.iota(spark, n)
    kept = rows.filter_values(rows.map_values(s, lambda v: v * 3), lambda v: v % 2 == 0, chunk=C)
    want = [3 * i for i in range(n) if i % 2 == 0]
    assert values(kept) == want
    scanned = {r["pos"]: r["scan"] for r in scan.exclusive_scan(kept, chunk=C).collect()}
    assert scanned == {i: sum(want[:i]) for i in range(len(want))}
    assert reduce.reduce_values(kept, SUM).first()[0] == sum(want)


@pytest.mark.parametrize("monoid,fold", [(SUM, sum), (MAX, lambda x: max([0, *x])), (MIN, lambda x: min([2**63 - 1, *x])), (XOR, lambda x: __import__("functools").reduce(lambda a, b: a ^ b, x, 0))])
def test_scans_and_folds(spark, monoid, fold):
    xs = [(7 * i * i + 3) % 41 for i in range(3 * C + 5)]
    s = make(spark, xs)
    got = {r["pos"]: r["scan"] for r in scan.exclusive_scan(s, monoid, chunk=C).collect()}
    assert got == {i: fold(xs[:i]) for i in range(len(xs))}
    got = {r["pos"]: r["scan"] for r in scan.inclusive_scan(s, monoid, chunk=C).collect()}
    assert got == {i: fold(xs[: i + 1]) for i in range(len(xs))}
    assert reduce.reduce_values(s, monoid).first()[0] == fold(xs)
    assert reduce.reduce_values(s.limit(0), monoid).first()[0] == fold([])
    assert scan.exclusive_scan(s.limit(0), monoid, chunk=C).count() == 0


def test_carry_scan(spark):
    codes = [None, 1, None, None, 0, None] * 5 + [None] * 20
    got = {r["pos"]: r["scan"] for r in scan.exclusive_scan(make(spark, codes), LAST, chunk=C, initial=F.lit(7)).collect()}
    carry = 7
    for i, c in enumerate(codes):
        assert got[i] == carry
        carry = carry if c is None else c


def test_three_levels(spark):
    xs = [(5 * i) % 23 for i in range(5 * C * C + 3)]
    s = make(spark, xs)
    got = {r["pos"]: r["scan"] for r in scan.exclusive_scan(s, chunk=C, levels=3).collect()}
    assert got == {i: sum(xs[:i]) for i in range(len(xs))}
    codes = rows.map_values(s, lambda v: F.when(v < 3, v))
    two, three = ({r["pos"]: r["scan"] for r in scan.exclusive_scan(codes, LAST, chunk=C, initial=F.lit(9), levels=k).collect()} for k in (2, 3))
    assert two == three
    assert sorted(r["pos"] for r in scan.renumber(s.where("value > 4"), chunk=C, levels=3).collect()) == list(range(sum(x > 4 for x in xs)))


def test_scan_does_not_gather_rows(spark):
    plan = scan.exclusive_scan(rows.iota(spark, 100), chunk=C)._jdf.queryExecution().executedPlan().toString()
    singles = [line for line in plan.splitlines() if "SinglePartition" in line]
    assert len(singles) == 1  # the sums of chunks alone


def test_filter_edges(spark):
    s = rows.iota(spark, C)
    assert values(rows.filter_values(s, lambda v: v < 0, C)) == []
    assert values(rows.filter_values(s, lambda v: v >= 0, C)) == list(range(C))
    assert values(rows.filter_values(s, lambda v: v == 0, C)) == [0]
    assert values(rows.filter_values(rows.iota(spark, 129 * C), lambda v: v % 3 == 0, C)) == list(range(0, 129 * C, 3))


def test_packs(spark):
    s = make(spark, [10 * i for i in range(20)])
    flags = make(spark, [i % 3 == 1 for i in range(20)], "boolean")
    assert values(rows.pack(s, flags, C)) == [10 * i for i in range(20) if i % 3 == 1]
    assert values(rows.pack_if(s, rows.iota(spark, 20), lambda v: v > 15, C)) == [160, 170, 180, 190]


@pytest.mark.parametrize("target,want", [(0, 0), (1, 1), (10, 10), (19, 19), (C, C), (C + 1, C + 1), (99, 20)])
def test_find_if(spark, target, want):
    assert rows.find_if(rows.iota(spark, 20), lambda v: v == target).first()[0] == want
    assert rows.find_if(rows.iota(spark, 0), lambda v: v == target).first()[0] == 0


def test_access_and_ends(spark):
    s = rows.iota(spark, 2 * C)
    assert rows.get(s, C) == C and rows.to_list(s) == list(range(2 * C)) and rows.size(s) == 2 * C and rows.chunk_count(s, C) == 2
    with pytest.raises(IndexError):
        rows.get(s, 2 * C)
    longer = rows.push_back(rows.push_back(s, 5), 6)
    assert values(longer) == [*range(2 * C), 5, 6]
    assert values(rows.push_back(s.limit(0), 1)) == [1]
    assert values(rows.copied(s)) == list(range(2 * C))


def test_slices(spark):
    s = rows.iota(spark, 3 * C)
    assert values(rows.cut(s, C - 5, C + 5)) == list(range(C - 5, C + 5))
    assert values(rows.cut(s, 4, 4)) == []
    with pytest.raises(ValueError):
        rows.cut(s, 5, 4)
    assert values(rows.cut_or_empty(s, 5, 99)) == []
    assert values(rows.cut_chunks(s, 1, 9, C)) == list(range(C, 3 * C))
    assert values(rows.prepend_zeros(s, 2)) == [0, 0, *range(3 * C)]
    assert values(rows.append_zeros(s, 2)) == [*range(3 * C), 0, 0]
    assert values(rows.concat([s, s.limit(0), rows.iota(spark, 3)])) == [*range(3 * C), 0, 1, 2]


def test_zips(spark):
    a, b = rows.iota(spark, C + 5), rows.iota(spark, 3 * C + 2)
    got = sorted(tuple(r) for r in zips.zip_padded(a, b, 7).collect())
    assert got == [(i, i if i < C + 5 else 7, i) for i in range(3 * C + 2)]
    got = sorted(tuple(r) for r in zips.zip_all([a, a, a], ["x", "y", "z"]).collect())
    assert got == [(i, i, i, i) for i in range(C + 5)]
    with pytest.raises(Exception, match="different lengths"):
        zips.zip_strict(a, b).collect()


def test_histograms(spark):
    s = rows.iota(spark, 25)
    assert {r["bin"]: r["n"] for r in reduce.histogram(s, 30).collect()} == {b: int(b < 25) for b in range(30)}
    assert {r["bin"]: r["n"] for r in reduce.histogram(s, 10, lambda v: v % 10).collect()} == {b: 3 if b < 5 else 2 for b in range(10)}
    with pytest.raises(Exception, match="outside"):
        reduce.histogram(s, 10).collect()


def test_segments(spark):
    lengths = [0, 1, 4, 2 * C + 3, C - 1, 3, C + 1, 0, 12, 3 * C + 7, 1, 5]
    bounds = [sum(lengths[:k]) for k in range(len(lengths) + 1)]
    table = spark.createDataFrame([(k, bounds[k], bounds[k + 1]) for k in range(len(lengths))], "seg long, lo long, hi long")
    s = rows.iota(spark, bounds[-1])
    for monoid, fold, unit in ((SUM, sum, 0), (MIN, min, 2**63 - 1), (MAX, max, 0)):
        got = {r["seg"]: r["value"] for r in scan.segmented_reduce(s, table, monoid, radix=C).collect()}
        assert got == {k: fold(range(bounds[k], bounds[k + 1])) if lengths[k] else unit for k in range(len(lengths))}


def test_partition(spark):
    s = rows.iota(spark, 60)
    got = {r["pos"]: r["bucket"] for r in partition.partition(s, 4, lambda v: F.when(v % 13 != 0, v % 4)).collect()}
    assert got == {i: i % 4 for i in range(60) if i % 13}
    with pytest.raises(Exception, match="outside"):
        partition.partition(s, 4, lambda v: v).collect()


def test_sort_select_permute(spark):
    xs = [(37 * i * i) % 101 - 50 for i in range(200)]
    s = make(spark, xs)
    assert values(partition.sort_values(s)) == sorted(xs)
    assert values(partition.sort_values(s.limit(0))) == []
    for k in (0, 3, 100, 199):
        assert partition.kth_smallest(s, k, buckets=7, most=5) == sorted(xs)[k]
    with pytest.raises(IndexError):
        partition.kth_smallest(s, 200)
    one, again, other = (values(partition.permutation(s, seed)) for seed in (1, 1, 2))
    assert one == again != other and sorted(one) == sorted(xs) and one != xs
    assert spark.range(5).select(partition.pivot_rank(F.col("id"), [1, 3, 3]).alias("r")).collect() == [(0,), (0,), (1,), (1,), (3,)]


def test_flat_maps(spark):
    s = rows.iota(spark, 2 * C + 5)
    got = values(halo.flat_map(s, lambda v: F.when(v % 2 == 0, F.array(v, v * 2)), C))
    assert got == [x for v in range(2 * C + 5) if v % 2 == 0 for x in (v, 2 * v)]
    for n in (2, 2 * C + 3):  # a look-ahead over more than one border
        ahead = {r["pos"]: r["ahead"] for r in halo.with_halo(s, n, C).collect()}
        assert ahead == {i: list(range(i + 1, min(2 * C + 5, i + 1 + n))) for i in range(2 * C + 5)}


def test_flat_tabulate(spark):
    import pyarrow as pa

    for n in (0, 1, C, 3 * C + 7):
        assert values(halo.flat_tabulate(spark, n, lambda a, b: pa.array([i for i in range(a, b) if i % 2], pa.int64()), block=C)) == [i for i in range(n) if i % 2]


def test_stored_tables_can_be_dropped(spark, monkeypatch):
    from seqweave.plans import storage

    monkeypatch.setattr(storage, "_written", [])
    kept = rows.copied(rows.iota(spark, 5))
    assert kept.count() == 5 and storage.drop_stored(spark) == 1 and storage.drop_stored(spark) == 0
