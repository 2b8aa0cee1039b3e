"""Driver queries over the reference operators, each with its SQL.

`ev` is the events table as a sequence: position event_id, value cents.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.monoids import LAST, MAX, MIN, SUM, XOR
from ..functions.names import chunk_of
from ..functions.scalars import area, field_multiply, narrow32
from ..operators import bigint, graph, graph_build, halo, hull, partition, primes, reduce, rows, scan, suffix, text_search, zips
from ..sources import graph_files, packed
from .storage import new_path

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
EV = "ev AS (SELECT event_id AS pos, CAST(ROUND(value * 100) AS BIGINT) AS value FROM events)"
ORD = "o AS (SELECT o_orderkey AS pos, o_custkey AS value FROM orders)"
EDGES = "e AS (SELECT CAST(o_custkey AS BIGINT) AS src, CAST(o_orderkey // 10 AS BIGINT) AS dst, CAST(1 + o_orderkey % 9 AS BIGINT) AS weight FROM orders)"
N = "n AS (SELECT max(greatest(src, dst)) + 1 AS n FROM e)"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def ev(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows.from_frame(table(spark, sf_dir, "events"), "event_id", F.round(F.col("value") * 100).cast("long"))


def cut_there(s: DataFrame, start: int, end: int) -> DataFrame:
    """rows.cut, which refuses a slice beyond the end, of as much of [start, end) as the sequence has."""
    n = rows.size(s)
    return rows.cut(s, min(start, n), min(end, n), n)


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows.from_frame(table(spark, sf_dir, "orders"), "o_orderkey", F.col("o_custkey").cast("long"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_custkey").cast("long").alias("src"), chunk_of("o_orderkey", 10).alias("dst"), (1 + F.col("o_orderkey") % 9).cast("long").alias("weight"))


def seq(sql: str, head: str = EV) -> str:
    return f"WITH {head} {sql}"


def dense(where: str, value: str = "value", head: str = EV, source: str = "ev") -> str:
    return f"WITH {head} SELECT CAST(row_number() OVER (ORDER BY pos) - 1 AS BIGINT) AS pos, {value} AS value FROM {source} WHERE {where}"


# ---- generation and access


@query("seq_tabulate", "SELECT CAST(range AS BIGINT) AS pos, CAST(range * range % 1000003 AS BIGINT) AS value FROM range(100000)")
def _(spark, sf_dir):
    return rows.tabulate(spark, 100_000, lambda i: i * i % 1_000_003)


@query("seq_iota", "SELECT CAST(range AS BIGINT) AS pos, CAST(range AS BIGINT) AS value FROM range(100000)")
def _(spark, sf_dir):
    return rows.iota(spark, 100_000)


@query("seq_from_values", "SELECT CAST(i - 1 AS BIGINT) AS pos, CAST([5, 3, 8, 1][i] AS BIGINT) AS value FROM range(1, 5) AS t(i)")
def _(spark, sf_dir):
    return rows.from_values(spark, [5, 3, 8, 1])


@query("seq_copy", seq("SELECT pos, value FROM ev"))
def _(spark, sf_dir):
    return rows.copied(ev(spark, sf_dir))


@query("seq_get", seq("SELECT pos, value FROM ev WHERE pos IN (0, 17, (SELECT max(pos) FROM ev))"))
def _(spark, sf_dir):
    s = ev(spark, sf_dir)
    places = [0, 17, rows.size(s) - 1]
    return rows.from_values(spark, [rows.get(s, p) for p in places]).select(F.element_at(F.array(*[F.lit(p) for p in places]), (F.col("pos") + 1).cast("int")).cast("long").alias("pos"), "value")


@query("seq_push_back", seq("SELECT pos, value FROM ev UNION ALL SELECT count(*), 42 FROM ev"))
def _(spark, sf_dir):
    return rows.push_back(ev(spark, sf_dir), 42)


@query("seq_size", seq("SELECT count(*) AS n, CAST(ceil(count(*) / 1000.0) AS BIGINT) AS chunks FROM ev"))
def _(spark, sf_dir):
    s = ev(spark, sf_dir)
    return spark.range(1).select(F.lit(rows.size(s)).cast("long").alias("n"), F.lit(rows.chunk_count(s, 1000)).cast("long").alias("chunks"))


# ---- files and lists


@query("seq_to_list", seq("SELECT pos, value FROM ev WHERE pos < 1000"))
def _(spark, sf_dir):
    return rows.from_values(spark, rows.to_list(cut_there(ev(spark, sf_dir), 0, 1000)))


@query("seq_force", seq("SELECT pos, 3 * value + 1 AS value FROM ev"))
def _(spark, sf_dir):
    return rows.force(rows.map_values(ev(spark, sf_dir), lambda v: 3 * v + 1))


@query("seq_consolidate", seq("SELECT pos, value - 5000 AS value FROM ev"))
def _(spark, sf_dir):
    path = new_path(spark, "packed") + ".bin"
    packed.consolidate(rows.map_values(ev(spark, sf_dir), lambda v: v - 5000), path)
    return packed.read_packed(spark, path, block=4096)


@query("seq_find_files", "SELECT CAST(n - 1 AS BIGINT) AS pos, printf('part-%06d.bin', n - 1) AS value FROM range(1, 4) AS t(n)")
def _(spark, sf_dir):
    folder = new_path(spark, "parts")
    packed.write_parts(ev(spark, sf_dir), folder, parts=3).count()
    return rows.from_values(spark, [f.rsplit("/", 1)[1] for f in packed.find_files(spark, f"{folder}/part-*.bin")], "string")


# ---- maps


@query("seq_map", seq("SELECT pos, 3 * value + 1 AS value FROM ev"))
def _(spark, sf_dir):
    return rows.map_values(ev(spark, sf_dir), lambda v: 3 * v + 1)


@query("seq_map_chain", seq("SELECT pos, ((value + 1) * 2) % 97 AS value FROM ev"))
def _(spark, sf_dir):
    return rows.map_values(rows.map_values(rows.map_values(ev(spark, sf_dir), lambda v: v + 1), lambda v: v * 2), lambda v: v % 97)


@query("seq_map_narrow", seq("SELECT pos, (value * 1000003) & 4294967295 AS value FROM ev"))
def _(spark, sf_dir):
    return rows.map_values(ev(spark, sf_dir), lambda v: narrow32(v * 1_000_003))


@query("seq_map_bits", seq("SELECT pos, xor(~value, value >> 3) AS value FROM ev"))
def _(spark, sf_dir):
    return rows.map_values(ev(spark, sf_dir), lambda v: F.bitwise_not(v).bitwiseXOR(F.shiftright(v, 3)))


@query("seq_map_field", seq("SELECT pos, CAST(CAST(value AS HUGEINT) * 500000000 % 2147483647 AS BIGINT) AS value FROM ev"))
def _(spark, sf_dir):
    return rows.map_values(ev(spark, sf_dir), lambda v: field_multiply(v, F.lit(500_000_000)))


@query("seq_transform_chunks", seq("SELECT pos, max(value) OVER (PARTITION BY pos // 1000) - value AS value FROM ev"))
def _(spark, sf_dir):
    def below_top(t: pa.Table) -> pa.Table:
        values = t["value"].to_numpy()
        return pa.table({"pos": t["pos"], "value": values.max() - values})

    return halo.transform_chunks(ev(spark, sf_dir), below_top, "pos long, value long", 1000)


# ---- filters and packs


@query("seq_filter", dense("value % 3 = 0"))
def _(spark, sf_dir):
    return rows.filter_values(ev(spark, sf_dir), lambda v: v % 3 == 0)


@query("seq_filter_fused", dense("(value + 7) % 5 < 2", "value + 7"))
def _(spark, sf_dir):
    return rows.filter_values(rows.map_values(ev(spark, sf_dir), lambda v: v + 7), lambda v: v % 5 < 2)


@query("seq_filter_none", dense("false"))
def _(spark, sf_dir):
    return rows.filter_values(ev(spark, sf_dir), lambda v: v != v)


@query("seq_pack_flags", seq("SELECT CAST(row_number() OVER (ORDER BY ev.pos) - 1 AS BIGINT) AS pos, ev.value FROM ev JOIN o ON ev.pos = o.pos WHERE o.value % 2 = 0", f"{EV}, {ORD}"))
def _(spark, sf_dir):
    return rows.pack(ev(spark, sf_dir), rows.map_values(orders(spark, sf_dir), lambda v: v % 2 == 0))


@query("seq_pack_if", seq("SELECT CAST(row_number() OVER (ORDER BY ev.pos) - 1 AS BIGINT) AS pos, ev.value FROM ev JOIN o ON ev.pos = o.pos WHERE o.value > 700", f"{EV}, {ORD}"))
def _(spark, sf_dir):
    return rows.pack_if(ev(spark, sf_dir), orders(spark, sf_dir), lambda v: v > 700)


@query("seq_pack_value", dense("value > 5000"))
def _(spark, sf_dir):
    return rows.pack_value(ev(spark, sf_dir), lambda v: v > 5000)


@query("seq_find_if", seq("SELECT coalesce(min(pos) FILTER (WHERE value > 9000 AND pos > 100), count(*)) AS pos FROM ev"))
def _(spark, sf_dir):
    s = ev(spark, sf_dir)
    return rows.find_if(s.withColumn("value", F.when(F.col("pos") > 100, F.col("value")).otherwise(0)), lambda v: v > 9000)


@query("seq_find_if_missing", seq("SELECT coalesce(min(pos) FILTER (WHERE value < -1000000000), count(*)) AS pos FROM ev"))
def _(spark, sf_dir):
    return rows.find_if(ev(spark, sf_dir), lambda v: v < -1_000_000_000)


# ---- folds

for _name, _monoid, _sql in (("sum", SUM, "coalesce(sum(value), 0)"), ("max", MAX, "coalesce(max(value), 0)"), ("min", MIN, "coalesce(min(value), 9223372036854775807)"), ("xor", XOR, "coalesce(bit_xor(value), 0)")):
    query(f"seq_reduce_{_name}", seq(f"SELECT CAST({_sql} AS BIGINT) AS value FROM ev"))(lambda spark, sf_dir, m=_monoid: reduce.reduce_values(ev(spark, sf_dir), m))
    query(f"seq_reduce_{_name}_empty", seq(f"SELECT CAST({_sql} AS BIGINT) AS value FROM ev WHERE pos < 0"))(lambda spark, sf_dir, m=_monoid: reduce.reduce_values(ev(spark, sf_dir).where("pos < 0"), m))


#: All values are below 0, so that a fold that forgets the identity of MAX shows.
SIGNED = "ev AS (SELECT event_id AS pos, -1 - abs(CAST(ROUND(value * 100) AS BIGINT)) AS value FROM events)"


def signed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows.map_values(ev(spark, sf_dir), lambda v: -1 - F.abs(v))


@query("seq_reduce_max_negative", seq("SELECT CAST(0 AS BIGINT) AS value, max(value) AS least FROM ev", SIGNED))
def _(spark, sf_dir):
    s = signed(spark, sf_dir)
    lowest = MAX.starting_at(-(1 << 63))
    return s.agg(MAX.total(F.col("value")).alias("value"), lowest.total(F.col("value")).alias("least"))


@query("seq_scan_max_negative", seq("SELECT pos, max(value) OVER (ORDER BY pos) AS scan FROM ev", SIGNED))
def _(spark, sf_dir):
    return scan.inclusive_scan(signed(spark, sf_dir), MAX.starting_at(-(1 << 63)), chunk=4096).select("pos", "scan")


@query("seq_fused_reduce", seq("SELECT CAST(sum(value * 2 + 1) AS BIGINT) AS value FROM ev"))
def _(spark, sf_dir):
    return reduce.reduce_values(rows.map_values(rows.map_values(ev(spark, sf_dir), lambda v: v * 2), lambda v: v + 1), SUM)


@query("seq_histogram", "SELECT b.range AS bin, count(l.q) AS n FROM range(60) AS b LEFT JOIN (SELECT CAST(l_quantity AS BIGINT) AS q FROM lineitem) AS l ON l.q = b.range GROUP BY 1")
def _(spark, sf_dir):
    return reduce.histogram(table(spark, sf_dir, "lineitem").select(F.col("l_quantity").cast("long").alias("value")), 60)


@query("seq_histogram_key", seq("SELECT b.range AS bin, count(v.k) AS n FROM range(16) AS b LEFT JOIN (SELECT abs(value) % 10 AS k FROM ev) AS v ON v.k = b.range GROUP BY 1"))
def _(spark, sf_dir):
    return reduce.histogram(ev(spark, sf_dir), 16, lambda v: F.abs(v) % 10)


LONG_SEGMENTS = "s AS (SELECT s_suppkey AS seg, s_suppkey * 7 % 100 AS lo, s_suppkey * 7 % 100 + s_suppkey * 31 % 9000 AS hi FROM supplier)"


@query("seq_segmented_long", seq("SELECT seg, CAST(coalesce(sum(value), 0) AS BIGINT) AS value FROM s LEFT JOIN ev ON ev.pos >= s.lo AND ev.pos < s.hi GROUP BY seg", f"{EV}, {LONG_SEGMENTS}"))
def _(spark, sf_dir):
    key = F.col("s_suppkey")
    bounds = table(spark, sf_dir, "supplier").select(key.alias("seg"), (key * 7 % 100).alias("lo"), (key * 7 % 100 + key * 31 % 9000).alias("hi"))
    return scan.segmented_reduce(ev(spark, sf_dir), bounds)


SEGMENTS = "s AS (SELECT o_orderkey AS seg, o_orderkey // 2 AS lo, o_orderkey // 2 + o_orderkey % 4 AS hi FROM orders)"


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, lo = F.col("o_orderkey"), chunk_of("o_orderkey", 2)
    return table(spark, sf_dir, "orders").select(key.alias("seg"), lo.alias("lo"), (lo + key % 4).alias("hi"))


for _name, _monoid, _sql in (("sum", SUM, "coalesce(sum(value), 0)"), ("min", MIN, "coalesce(min(value), 9223372036854775807)")):
    query(f"seq_segmented_{_name}", seq(f"SELECT seg, CAST({_sql} AS BIGINT) AS value FROM s LEFT JOIN ev ON ev.pos >= s.lo AND ev.pos < s.hi GROUP BY seg", f"{EV}, {SEGMENTS}"))(lambda spark, sf_dir, m=_monoid: scan.segmented_reduce(ev(spark, sf_dir), segments(spark, sf_dir), m))


@query("seq_linefit", "SELECT round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope FROM lineitem")
def _(spark, sf_dir):
    fit = reduce.line_fit(table(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice")
    return fit.select(F.round("intercept", 4).alias("intercept"), F.round("slope", 4).alias("slope"))


@query("geo_farthest", "SELECT s_suppkey AS idx, CAST(s_nationkey AS DOUBLE) AS x, s_acctbal AS y FROM supplier ORDER BY 3 * s_nationkey - s_acctbal DESC, s_suppkey DESC LIMIT 1")
def _(spark, sf_dir):
    return reduce.farthest(points(spark, sf_dir), 3 * F.col("x") - F.col("y"))


@query("geo_extremes", "SELECT min(s_nationkey) AS low_x, max(s_nationkey) AS high_x, (SELECT min(s_acctbal) FROM supplier WHERE s_nationkey = (SELECT min(s_nationkey) FROM supplier)) AS low_y, (SELECT max(s_acctbal) FROM supplier WHERE s_nationkey = (SELECT max(s_nationkey) FROM supplier)) AS high_y FROM supplier")
def _(spark, sf_dir):
    return reduce.extremes(points(spark, sf_dir)).select(F.col("low.x").cast("int").alias("low_x"), F.col("high.x").cast("int").alias("high_x"), F.col("low.y").alias("low_y"), F.col("high.y").alias("high_y"))


# ---- scans

BEFORE = "OVER (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
for _name, _monoid, _sql in (("sum", SUM, f"CAST(coalesce(sum(value) {BEFORE}, 0) AS BIGINT)"), ("max", MAX, f"coalesce(greatest(max(value) {BEFORE}, 0), 0)"), ("min", MIN, f"coalesce(min(value) {BEFORE}, 9223372036854775807)"), ("xor", XOR, f"CAST(coalesce(bit_xor(value) {BEFORE}, 0) AS BIGINT)")):
    query(f"seq_scan_{_name}", seq(f"SELECT pos, {_sql} AS scan FROM ev"))(lambda spark, sf_dir, m=_monoid: scan.exclusive_scan(ev(spark, sf_dir), m, chunk=4096).select("pos", "scan"))


@query("seq_scan_inclusive", seq("SELECT pos, CAST(sum(value) OVER (ORDER BY pos) AS BIGINT) AS scan FROM ev"))
def _(spark, sf_dir):
    return scan.inclusive_scan(ev(spark, sf_dir), chunk=4096).select("pos", "scan")


@query("seq_scan_carry", seq(f"SELECT pos, coalesce(last_value(CASE WHEN value % 5 < 2 THEN value % 5 END IGNORE NULLS) {BEFORE}, 1) AS scan FROM ev"))
def _(spark, sf_dir):
    codes = rows.map_values(ev(spark, sf_dir), lambda v: F.when(v % 5 < 2, v % 5))
    return scan.exclusive_scan(codes, LAST, chunk=4096, initial=F.lit(1)).select("pos", "scan")


@query("seq_scan_total", seq("SELECT CAST(sum(value) AS BIGINT) AS total FROM ev"))
def _(spark, sf_dir):
    return scan.scan_total(ev(spark, sf_dir))


# ---- zips


@query("seq_zip", seq("SELECT pos, value AS a, 10 * value AS b FROM ev"))
def _(spark, sf_dir):
    s = ev(spark, sf_dir)
    return zips.zip_strict(s, rows.map_values(s, lambda v: 10 * v))


@query("seq_zip_pad", seq("SELECT coalesce(ev.pos, o.pos) AS pos, coalesce(ev.value, 7) AS a, coalesce(o.value, 7) AS b FROM ev FULL JOIN o ON ev.pos = o.pos", f"{EV}, {ORD}"))
def _(spark, sf_dir):
    return zips.zip_padded(ev(spark, sf_dir), orders(spark, sf_dir), 7)


@query("seq_zip3", seq("SELECT pos, value + 10 * value + 100 * pos AS value FROM ev"))
def _(spark, sf_dir):
    s = ev(spark, sf_dir)
    z = zips.zip_all([s, rows.map_values(s, lambda v: 10 * v), s.select("pos", (F.col("pos") * 100).alias("value"))], ["a", "b", "c"])
    return z.select("pos", (F.col("a") + F.col("b") + F.col("c")).alias("value"))


@query("seq_zip_scan", seq("SELECT pos, value + CAST(coalesce(sum(value) OVER (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS value FROM ev"))
def _(spark, sf_dir):
    return scan.exclusive_scan(ev(spark, sf_dir), chunk=4096).select("pos", (F.col("value") + F.col("scan")).alias("value"))


# ---- slices and concatenation


@query("seq_cut", seq("SELECT pos - 100 AS pos, value FROM ev WHERE pos >= 100 AND pos < 7000"))
def _(spark, sf_dir):
    return cut_there(ev(spark, sf_dir), 100, 7000)


@query("seq_cut_empty", seq("SELECT pos, value FROM ev WHERE false"))
def _(spark, sf_dir):
    return rows.cut_or_empty(ev(spark, sf_dir), 5, 1 << 40)


@query("seq_cut_chunk", seq("SELECT pos - 2000 AS pos, value FROM ev WHERE pos >= 2000 AND pos < 5000"))
def _(spark, sf_dir):
    return rows.cut_chunks(ev(spark, sf_dir), 2, 5, 1000)


@query("seq_shift", seq("SELECT pos + 1000 AS pos, value FROM ev UNION ALL SELECT range, 0 FROM range(1000)"))
def _(spark, sf_dir):
    return rows.prepend_zeros(ev(spark, sf_dir), 1000)


@query("seq_append_zero", seq("SELECT pos, value FROM ev UNION ALL SELECT range + (SELECT count(*) FROM ev), 0 FROM range(50)"))
def _(spark, sf_dir):
    return rows.append_zeros(ev(spark, sf_dir), 50)


@query("seq_concat", seq("SELECT pos, value FROM ev UNION ALL SELECT pos + (SELECT count(*) FROM ev), value FROM o UNION ALL SELECT pos + (SELECT count(*) FROM ev) + (SELECT count(*) FROM o), value + 1 FROM ev", f"{EV}, {ORD}"))
def _(spark, sf_dir):
    s = ev(spark, sf_dir)
    return rows.concat([s, orders(spark, sf_dir), rows.map_values(s, lambda v: v + 1)])


# ---- buckets, order, selection


@query("seq_partition", seq("SELECT pos, value, value % 4 AS bucket FROM ev WHERE value % 13 <> 0"))
def _(spark, sf_dir):
    return partition.partition(ev(spark, sf_dir), 4, lambda v: F.when(v % 13 != 0, v % 4))


@query("seq_count_sort", seq("SELECT ev.pos, ev.value, o.value AS bucket FROM ev JOIN o ON ev.pos = o.pos", f"{EV}, {ORD}"))
def _(spark, sf_dir):
    return partition.route(ev(spark, sf_dir), orders(spark, sf_dir))


@query("seq_bucket_sort", seq("SELECT pos, value, value % 64 AS bucket, row_number() OVER (PARTITION BY value % 64 ORDER BY value, pos) - 1 AS rank FROM ev"))
def _(spark, sf_dir):
    return partition.sort_buckets(partition.partition(ev(spark, sf_dir), 64, lambda v: v % 64)).withColumn("rank", F.col("rank").cast("long"))


@query("seq_process_buckets", seq("SELECT value % 64 AS bucket, CAST(median(value) * 2 AS BIGINT) AS twice_median FROM ev GROUP BY 1"))
def _(spark, sf_dir):
    import numpy as np

    def middle(t: pa.Table) -> pa.Table:
        return pa.table({"bucket": [t["bucket"][0].as_py()], "twice_median": [int(2 * np.median(t["value"].to_numpy()))]})

    return partition.process_buckets(partition.partition(ev(spark, sf_dir), 64, lambda v: v % 64), middle, "bucket long, twice_median long")


@query("seq_scatter_gather", seq("SELECT pos, value, count(*) OVER (PARTITION BY (value + pos) % 32) AS peers FROM ev"))
def _(spark, sf_dir):
    def peers(t: pa.Table) -> pa.Table:
        return pa.table({"pos": t["pos"], "value": t["value"], "peers": [t.num_rows] * t.num_rows})

    return partition.scatter_process_gather(ev(spark, sf_dir), lambda v, i: (v + i) % 32, peers, "pos long, value long, peers long")


@query("seq_sort", seq("SELECT row_number() OVER (ORDER BY value, pos) - 1 AS pos, value FROM ev"))
def _(spark, sf_dir):
    return partition.sort_values(ev(spark, sf_dir))


@query("seq_sort_descending", seq("SELECT row_number() OVER (ORDER BY value DESC, pos) - 1 AS pos, value FROM ev"))
def _(spark, sf_dir):
    return partition.sort_values(ev(spark, sf_dir), [F.col("value").desc()])


@query("seq_kth", seq("SELECT quantile_disc(value, 0.5) AS value FROM ev UNION ALL SELECT min(value) FROM ev UNION ALL SELECT max(value) FROM ev"))
def _(spark, sf_dir):
    s = ev(spark, sf_dir)
    n = rows.size(s)
    return rows.from_values(spark, [partition.kth_smallest(s, k, most=1000) for k in ((n - 1) // 2, 0, n - 1)]).select("value")


@query("seq_rank", seq("SELECT pos, CAST(len(list_filter([10, 500, 2500, 2500, 9000], lambda p: p < value)) AS INTEGER) AS rank FROM ev"))
def _(spark, sf_dir):
    return ev(spark, sf_dir).select("pos", partition.pivot_rank(F.col("value"), [2500, 10, 9000, 500, 2500]).alias("rank"))


@query("seq_shuffle", seq("SELECT pos, row_number() OVER (ORDER BY value) - 1 AS rank FROM (SELECT pos, pos AS value FROM ev)"))
def _(spark, sf_dir):
    """The permuted positions, sorted back: every position once."""
    mixed = partition.permutation(ev(spark, sf_dir).select("pos", F.col("pos").alias("value")), seed=3)
    return partition.sort_values(mixed).select(F.col("value").alias("pos"), F.col("pos").alias("rank"))


# ---- flat maps


@query("seq_flat_map", "WITH ev AS (SELECT event_id AS pos, CAST(ROUND(value * 100) AS BIGINT) AS value FROM events), u AS (SELECT pos, k, value * 10 + k AS v FROM ev, range(3) AS t(k) WHERE k < value % 3 + 1) SELECT row_number() OVER (ORDER BY pos, k) - 1 AS pos, v AS value FROM u")
def _(spark, sf_dir):
    return halo.flat_map(ev(spark, sf_dir), lambda v: F.transform(F.sequence(F.lit(0).cast("long"), v % 3), lambda k: v * 10 + k))


@query("seq_flat_map_halo", seq("SELECT row_number() OVER (ORDER BY pos) - 1 AS pos, pos AS value FROM (SELECT pos, value, lead(value) OVER (ORDER BY pos) AS n1, lead(value, 2) OVER (ORDER BY pos) AS n2 FROM ev) WHERE value < n1 AND n1 < n2"))
def _(spark, sf_dir):
    rising = lambda v, i, ahead: F.when((F.size(ahead) == 2) & (v < F.get(ahead, F.lit(0))) & (F.get(ahead, F.lit(0)) < F.get(ahead, F.lit(1))), F.array(i)).otherwise(F.array().cast("array<long>"))
    return halo.flat_map_halo(ev(spark, sf_dir), 2, rising, chunk=1000)


@query("seq_flat_tabulate", "SELECT row_number() OVER (ORDER BY range) - 1 AS pos, range AS value FROM range(100000) WHERE range % 7 = 3")
def _(spark, sf_dir):
    return halo.flat_tabulate(spark, 100_000, lambda a, b: pa.array([i for i in range(a, b) if i % 7 == 3], pa.int64()), block=8192)


# ---- text, numbers, geometry

FIND = "SELECT doc_id, pos FROM (SELECT doc_id, CAST(sum(length(piece) + {m}) OVER (PARTITION BY doc_id ORDER BY i) - {m} AS BIGINT) AS pos, i, n FROM (SELECT doc_id, unnest(p) AS piece, generate_subscripts(p, 1) AS i, len(p) AS n FROM (SELECT doc_id, string_split(text, '{w}') AS p FROM documents))) WHERE i < n"


@query("str_kmp", FIND.format(m=5, w="thand"))
def _(spark, sf_dir):
    return text_search.find_in_documents(table(spark, sf_dir, "documents"), "thand")


@query("str_rabin_karp", FIND.format(m=6, w="of the"))
def _(spark, sf_dir):
    return text_search.rabin_karp(table(spark, sf_dir, "documents"), "of the")


@query("str_find_in_sequence", seq("SELECT row_number() OVER (ORDER BY pos) - 1 AS pos, pos AS value FROM (SELECT pos, value % 4 AS a, lead(value % 4) OVER (ORDER BY pos) AS b, lead(value % 4, 2) OVER (ORDER BY pos) AS c FROM ev) WHERE a = 1 AND b = 2 AND c = 1"))
def _(spark, sf_dir):
    return text_search.find_in_sequence(rows.map_values(ev(spark, sf_dir), lambda v: v % 4), [1, 2, 1], chunk=1000)


@query("txt_suffix_array", "WITH t AS (SELECT string_agg(s_name, ' ' ORDER BY s_suppkey) AS t FROM supplier), s AS (SELECT CAST(i - 1 AS BIGINT) AS value, substr(t, CAST(i AS BIGINT)) AS x FROM t, range(1, (SELECT length(t) + 1 FROM t)) AS r(i)) SELECT row_number() OVER (ORDER BY x) - 1 AS pos, value FROM s")
def _(spark, sf_dir):
    names = table(spark, sf_dir, "supplier").select("s_suppkey", F.concat("s_name", F.lit(" ")).alias("s_name"))
    chars = names.withColumn("pos", F.col("s_suppkey")).select("pos", F.split("s_name", "").alias("_list"))
    letters = halo.spread_lists(scan.renumber(chars))
    n = letters.count()
    return suffix.suffix_array(letters.where(F.col("pos") < n - 1))


@query("num_primes", "SELECT row_number() OVER (ORDER BY i) - 1 AS pos, i AS value FROM (SELECT range AS i FROM range(2, (SELECT 2 * count(*) + 1 FROM events))) WHERE NOT EXISTS (SELECT 1 FROM range(2, (SELECT CAST(ceil(sqrt(2 * count(*))) AS BIGINT) + 1 FROM events)) AS d(k) WHERE k < i AND i % k = 0)")
def _(spark, sf_dir):
    return primes.primes(spark, 2 * table(spark, sf_dir, "events").count(), block=4096)


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("idx"), F.col("s_nationkey").cast("double").alias("x"), F.col("s_acctbal").alias("y"))


@query("geo_upper_hull", "WITH p AS (SELECT s_suppkey AS idx, CAST(s_nationkey AS DOUBLE) AS x, s_acctbal AS y FROM supplier), ends AS (SELECT min(x) AS lo, max(x) AS hi FROM p), tops AS (SELECT x, max(y) AS y FROM p GROUP BY x), h AS (SELECT t.x, t.y FROM tops t WHERE NOT EXISTS (SELECT 1 FROM tops a, tops b WHERE a.x < t.x AND b.x > t.x AND (b.x - a.x) * (t.y - a.y) - (b.y - a.y) * (t.x - a.x) <= 0) UNION SELECT x, min(y) FROM p, ends WHERE x = lo GROUP BY x) SELECT row_number() OVER (ORDER BY x, y) - 1 AS pos, x, y FROM h")
def _(spark, sf_dir):
    return hull.upper_hull(points(spark, sf_dir)).select("pos", "x", "y")


@query("geo_area", "SELECT idx, round((bx - x) * (cy - y) - (b_y - y) * (cx - x), 3) AS area FROM (SELECT s_suppkey AS idx, CAST(s_nationkey AS DOUBLE) AS x, s_acctbal AS y, 1.0 AS bx, 2.0 AS b_y, 30.0 AS cx, 5.0 AS cy FROM supplier)")
def _(spark, sf_dir):
    p = points(spark, sf_dir)
    one = lambda v: F.lit(float(v))
    return p.select("idx", F.round(area(F.col("x"), F.col("y"), one(1), one(2), one(30), one(5)), 3).alias("area"))


A, B = -(3**157) + 12345, 7**90 - 2**200


def limbs(x: DataFrame) -> DataFrame:
    return x.select("pos", F.col("limb").cast("string").alias("limb"))


def limbs_sql(x: int, count: int) -> str:
    return " UNION ALL ".join(f"SELECT CAST({k} AS BIGINT) AS pos, '{(x >> (64 * k)) & ((1 << 64) - 1)}' AS limb" for k in range(count))


def two(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    return bigint.from_int(spark, A), bigint.from_int(spark, B)


@query("big_add", limbs_sql(A + B, 5))
def _(spark, sf_dir):
    return limbs(rows.between(bigint.padded(bigint.add(*two(spark)), 3), 0, 5))


@query("big_sub", limbs_sql(A - B, 5))
def _(spark, sf_dir):
    return limbs(rows.between(bigint.padded(bigint.subtract(*two(spark)), 3), 0, 5))


@query("big_mul", limbs_sql(A * B, 9))
def _(spark, sf_dir):
    return limbs(rows.between(bigint.padded(bigint.multiply(*two(spark)), 9), 0, 9))


@query("big_add_eager", limbs_sql(A + B, 5))
def _(spark, sf_dir):
    return limbs(rows.between(bigint.padded(bigint.add_eager(*two(spark)), 3), 0, 5))


@query("big_negate", limbs_sql(-A, 5))
def _(spark, sf_dir):
    return limbs(rows.between(bigint.padded(bigint.negate(bigint.from_int(spark, A)), 3), 0, 5))


@query("big_complement", limbs_sql(~A, 4))
def _(spark, sf_dir):
    return limbs(bigint.complement(bigint.from_int(spark, A)))


TWO64 = "18446744073709551616::HUGEINT"
LIMBS = f"""l AS (SELECT event_id AS pos, CASE WHEN event_id % 7 < 3 THEN {TWO64} - 1 - event_id % 2 ELSE (event_id * 1000003 % 1000000007)::HUGEINT * 18000000000 % {TWO64} END AS a,
CASE WHEN event_id % 7 < 3 THEN event_id % 2 ELSE (event_id * 999983 % 1000000007)::HUGEINT * 17000000000 % {TWO64} END AS b FROM events WHERE event_id < (SELECT count(*) - 1 FROM events))"""


def event_limbs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two big integers of a limb for each event but the last, with long chains of carries; their top limbs are small."""
    n = table(spark, sf_dir, "events").count() - 1
    at = F.col("id")
    wide = lambda x, by: (x.cast("decimal(20,0)") * F.lit(by).cast("decimal(15,0)")) % F.lit(str(1 << 64)).cast("decimal(38,0)")
    limb = lambda chain, other: F.when(at % 7 < 3, chain).otherwise(other).cast("decimal(20,0)").alias("limb")
    top = F.lit(str((1 << 64) - 1)).cast("decimal(38,0)")
    a = spark.range(n).select(at.alias("pos"), limb(top - (at % 2).cast("decimal(20,0)"), wide(at * 1000003 % 1000000007, 18000000000)))
    b = spark.range(n).select(at.alias("pos"), limb((at % 2).cast("decimal(38,0)"), wide(at * 999983 % 1000000007, 17000000000)))
    zero = lambda x: x.unionByName(spark.range(1).select(F.lit(n).cast("long").alias("pos"), F.lit(0).cast("decimal(20,0)").alias("limb")))
    return zero(a), zero(b)


@query("big_add_events", f"WITH {LIMBS}, s AS (SELECT pos, a + b AS s FROM l UNION ALL SELECT count(*), 0 FROM l), c AS (SELECT pos, s, coalesce(last_value(CASE WHEN s >= {TWO64} THEN 1 WHEN s < {TWO64} - 1 THEN 0 END IGNORE NULLS) OVER (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS carry FROM s) SELECT CAST(pos AS BIGINT) AS pos, CAST((s + carry) % {TWO64} AS VARCHAR) AS limb FROM c")
def _(spark, sf_dir):
    return limbs(bigint.add(*event_limbs(spark, sf_dir), chunk=1024))


WIDE_A, WIDE_B = 3**44000 + 17, -(7**24500) + 5


@query("big_mul_blocks", "SELECT CAST(row_number() OVER () - 1 AS BIGINT) AS pos, limb FROM (SELECT unnest([" + ", ".join(f"'{(WIDE_A * WIDE_B >> (64 * k)) & ((1 << 64) - 1)}'" for k in range(2200)) + "]) AS limb)")
def _(spark, sf_dir):
    """Operands of more than one block of digits each."""
    product = bigint.multiply(bigint.from_int(spark, WIDE_A), bigint.from_int(spark, WIDE_B))
    return limbs(rows.cut_chunks(bigint.padded(product, 100), 0, 1, 2200))


# ---- graphs


@query("g_degree", f"WITH {EDGES}, {N} SELECT r.range AS v, count(e.src) AS degree FROM range((SELECT n FROM n)) AS r LEFT JOIN e ON e.src = r.range GROUP BY 1")
def _(spark, sf_dir):
    return graph.degrees(edges(spark, sf_dir))


@query("g_degree_scan", f"WITH {EDGES}, {N}, d AS (SELECT r.range AS v, count(e.src) AS degree FROM range((SELECT n + 1 FROM n)) AS r LEFT JOIN e ON e.src = r.range GROUP BY 1) SELECT v, CAST(coalesce(sum(degree) OVER (ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM d")
def _(spark, sf_dir):
    return graph.degree_scan(edges(spark, sf_dir))


@query("g_adjacent", f"WITH {EDGES} SELECT dst, weight FROM e WHERE src = 7")
def _(spark, sf_dir):
    return graph.adjacent(edges(spark, sf_dir), 7)


@query("g_edge_exists", f"WITH {EDGES}, q AS (SELECT CAST(c_custkey AS BIGINT) AS src, CAST(c_nationkey AS BIGINT) AS dst FROM customer) SELECT src, dst, EXISTS (SELECT 1 FROM e WHERE e.src = q.src AND e.dst = q.dst) AS found FROM q")
def _(spark, sf_dir):
    pairs = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("src"), F.col("c_nationkey").cast("long").alias("dst"))
    return graph.edge_exists(edges(spark, sf_dir), pairs)


@query("g_edge_reduce", f"WITH {EDGES}, {N} SELECT r.range AS v, coalesce(max(e.weight * 1000 + e.dst % 1000), 0) AS value FROM range((SELECT n FROM n)) AS r LEFT JOIN e ON e.src = r.range GROUP BY 1")
def _(spark, sf_dir):
    return graph.reduce_over_edges(edges(spark, sf_dir), lambda dst, w: w * 1000 + dst % 1000, MAX)


@query("g_merge", f"WITH {EDGES}, {N} SELECT src, dst, weight FROM e UNION ALL SELECT src + (SELECT n FROM n), dst, weight FROM e")
def _(spark, sf_dir):
    e = edges(spark, sf_dir)
    return graph.merge(e, e)


@query("g_transpose", f"WITH {EDGES} SELECT dst AS src, src AS dst, weight FROM e")
def _(spark, sf_dir):
    return graph.transpose(edges(spark, sf_dir))


@query("g_symmetrize", f"WITH {EDGES} SELECT src, dst FROM e WHERE src <> dst UNION SELECT dst, src FROM e WHERE src <> dst")
def _(spark, sf_dir):
    return graph.symmetrize(edges(spark, sf_dir))


@query("g_edges", f"WITH {EDGES} SELECT src, dst FROM e")
def _(spark, sf_dir):
    lists = edges(spark, sf_dir).groupBy(F.col("src").alias("v")).agg(F.collect_list("dst").alias("neighbours"))
    return graph.from_adjacency(lists)


@query("g_stats", f"WITH {EDGES}, {N} SELECT (SELECT n FROM n) AS vertices, count(*) AS edges, (SELECT max(c) FROM (SELECT count(*) AS c FROM e GROUP BY src)) AS max_degree FROM e")
def _(spark, sf_dir):
    return graph.graph_stats(edges(spark, sf_dir))


@query("g_vertices", f"WITH {EDGES}, {N} SELECT range AS v FROM range((SELECT n FROM n))")
def _(spark, sf_dir):
    return graph.vertices(edges(spark, sf_dir))


@query("g_grid", "SELECT r * 40 + c AS src, (r + dr) * 40 + c + dc AS dst FROM range(25) AS a(r), range(40) AS b(c), range(-1, 2) AS x(dr), range(-1, 2) AS y(dc) WHERE (dr <> 0 OR dc <> 0) AND r + dr BETWEEN 0 AND 24 AND c + dc BETWEEN 0 AND 39")
def _(spark, sf_dir):
    return graph_build.grid(spark, 25, 40)


def _uniform(seed: int, levels: int, edges: int) -> str:
    """The steps of an R-MAT edge, 16 bits a level."""
    bits = ", ".join(f"('0x' || substr(md5('{seed}:' || range || ':{k // 8}'), {k % 8 * 4 + 1}, 4))::INT AS x{k}" for k in range(levels))
    down = " + ".join(f"(CASE WHEN x{k} >= 42598 THEN {1 << (levels - 1 - k)} ELSE 0 END)" for k in range(levels))
    right = " + ".join(f"(CASE WHEN x{k} >= 32768 AND x{k} < 42598 OR x{k} >= 52429 THEN {1 << (levels - 1 - k)} ELSE 0 END)" for k in range(levels))
    return f"x AS (SELECT {bits} FROM range({edges})), r AS (SELECT DISTINCT CAST({down} AS BIGINT) AS src, CAST({right} AS BIGINT) AS dst FROM x)"


@query("g_rmat", f"WITH {_uniform(5, 10, 8000)} SELECT src, dst FROM r")
def _(spark, sf_dir):
    return graph_build.rmat(spark, 10, 8000, seed=5)


@query("g_rmat_symmetric", f"WITH {_uniform(5, 10, 4000)} SELECT src, dst FROM r WHERE src <> dst UNION SELECT dst, src FROM r WHERE src <> dst")
def _(spark, sf_dir):
    return graph_build.rmat_symmetric(spark, 10, 8000, seed=5)


@query("g_weights", f"WITH {EDGES} SELECT src, dst, round(1 + 9 * (('0x' || substr(md5('5:' || least(src, dst) || ':' || greatest(src, dst)), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE), 9) AS weight FROM e")
def _(spark, sf_dir):
    return graph_build.add_weights(edges(spark, sf_dir).select("src", "dst"), 1, 10, seed=5).withColumn("weight", F.round("weight", 9))


@query("g_read_edges", f"WITH {EDGES} SELECT src, dst, CAST(weight AS DOUBLE) AS weight FROM e")
def _(spark, sf_dir):
    path = new_path(spark, "lines")
    edges(spark, sf_dir).select(F.concat_ws("\t", "src", F.concat_ws(" ", "dst", "weight")).alias("value")).write.text(path)
    return graph_files.read_edges(spark, path)


@query("g_read_adjacency", f"WITH {EDGES} SELECT src, dst FROM e")
def _(spark, sf_dir):
    path, e = new_path(spark, "adjacency"), edges(spark, sf_dir).select("src", "dst")
    graph_files.write_adjacency(e, graph.vertex_count(e), path)
    return graph_files.read_adjacency(spark, path)[1]


@query("g_read_differences", f"WITH {EDGES} SELECT src, dst FROM e")
def _(spark, sf_dir):
    path, e = new_path(spark, "differences"), edges(spark, sf_dir).select("src", "dst")
    graph_files.write_differences(e, graph.vertex_count(e), path)
    return graph_files.read_differences(spark, path)[1]


@query("g_read_symmetric", f"WITH {EDGES} SELECT src, dst FROM e WHERE src < dst UNION ALL SELECT dst, src FROM e WHERE src < dst")
def _(spark, sf_dir):
    path, e = new_path(spark, "symmetric"), edges(spark, sf_dir).select("src", "dst")
    graph_files.write_symmetric(e, graph.vertex_count(e), path)
    return graph_files.read_symmetric(spark, path)[1]


@query("g_bfs", f"WITH RECURSIVE {EDGES}, r(v, level) AS (SELECT CAST(1 AS BIGINT), 0 UNION SELECT e.dst, r.level + 1 FROM r JOIN e ON e.src = r.v WHERE r.level < 30) SELECT v, min(level) AS level FROM r GROUP BY v")
def _(spark, sf_dir):
    return graph.bfs(edges(spark, sf_dir), 1)


SSSP = f"WITH RECURSIVE {EDGES}, {N}, m AS (SELECT src, dst, min(weight) AS w FROM e GROUP BY src, dst), r(v, d) AS (SELECT CAST(1 AS BIGINT), CAST(0 AS BIGINT) UNION SELECT m.dst, r.d + m.w FROM r JOIN m ON m.src = r.v WHERE r.d + m.w <= 90), best AS (SELECT v, min(d) AS distance FROM r GROUP BY v)"


@query("g_sssp", f"{SSSP} SELECT x.range AS v, distance FROM range((SELECT n FROM n)) AS x LEFT JOIN best ON best.v = x.range")
def _(spark, sf_dir):
    return graph.shortest_paths(edges(spark, sf_dir), 1)


@query("g_bellman_ford", SQL["g_sssp"])
def _(spark, sf_dir):
    return graph.shortest_paths(edges(spark, sf_dir), 1, active_only=False)


@query("g_dijkstra", f"{SSSP} SELECT v, distance, distance AS frontier FROM best")
def _(spark, sf_dir):
    return graph.dijkstra_frontiers(edges(spark, sf_dir), 1)


def _cores(steps: int) -> str:
    """Bounds of the coreness, from degrees down: the largest h such that h neighbours have a bound of h or more, again and again."""
    out = [f"WITH {EDGES}, {N}, l AS MATERIALIZED (SELECT src, dst FROM e WHERE src <> dst UNION SELECT dst, src FROM e WHERE src <> dst), k0 AS MATERIALIZED (SELECT src AS v, count(*) AS core FROM l GROUP BY src)"]
    for i in range(1, steps + 1):
        out.append(f"k{i} AS MATERIALIZED (SELECT v, max(least(core, place)) AS core FROM (SELECT l.src AS v, k.core, row_number() OVER (PARTITION BY l.src ORDER BY k.core DESC) AS place FROM l JOIN k{i - 1} AS k ON k.v = l.dst) GROUP BY v)")
    return ", ".join(out) + f" SELECT CAST(r.range AS BIGINT) AS v, coalesce(core, 0) AS core FROM range((SELECT n FROM n)) AS r LEFT JOIN k{steps} AS k ON k.v = r.range"


@query("g_kcore", _cores(40))
def _(spark, sf_dir):
    return graph.kcore(edges(spark, sf_dir))


MATRIX = "m AS (SELECT src AS r, dst AS c, 1.0::DOUBLE / count(*) OVER (PARTITION BY dst) AS x FROM e)"


@query("g_matrix", f"WITH {EDGES}, {MATRIX} SELECT r AS row, c AS col, round(x, 9) AS value FROM m")
def _(spark, sf_dir):
    return graph.normalized(edges(spark, sf_dir)).withColumn("value", F.round("value", 9))


def _ranks(k: int) -> str:
    out = [f"WITH {EDGES}, {N}, {MATRIX}, v AS (SELECT range AS v FROM range((SELECT n FROM n))), p0 AS (SELECT v, 1.0::DOUBLE / (SELECT n FROM n) AS p FROM v)"]
    for i in range(1, k + 1):
        out.append(f"p{i} AS (SELECT v.v, 0.15::DOUBLE / (SELECT n FROM n) + 0.85::DOUBLE * coalesce(sum(m.x * q.p), 0) AS p FROM v LEFT JOIN m ON m.r = v.v LEFT JOIN p{i - 1} q ON q.v = m.c GROUP BY v.v)")
    return ", ".join(out) + f" SELECT v, round(p, 9) AS rank FROM p{k}"


@query("g_pagerank", _ranks(5))
def _(spark, sf_dir):
    e = edges(spark, sf_dir)
    return graph.pagerank(graph.normalized(e), graph.vertex_count(e), 5).withColumn("rank", F.round("rank", 9))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generate, filter, scan and fold: values that pass, their running sum and its remainder, by bucket."""
    kept = rows.filter_values(ev(spark, sf_dir), lambda v: v % 3 != 1)
    summed = scan.exclusive_scan(kept)
    return summed.groupBy((F.col("scan") % 16).alias("bucket")).agg(F.count("*").alias("n"), F.sum("value").alias("total"))


query("seq_pipeline", seq("SELECT scan % 16 AS bucket, count(*) AS n, CAST(sum(value) AS BIGINT) AS total FROM (SELECT value, CAST(coalesce(sum(value) OVER (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS scan FROM ev WHERE value % 3 <> 1) GROUP BY 1"))(flagship)
