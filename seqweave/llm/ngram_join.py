"""Jaccard self-join on sets of word n-grams, by MinHash banding.

1. Each text becomes the set of its n-word windows (64-bit hashes; a text of 1 to n - 1 words has one window, all
   its words).  Texts with equal sets are one class; the rest works on one representative of each.
2. Band and row counts follow from the target recall: the most rows a band for which the bands that reach it fit in
   MOST_HASHES.  Representatives meet on band hashes, each bucket as a star around its least member.
3. Connected components of the stars are candidate blocks.  A block of more than PART_SETS sets or PART_GRAMS n-grams is cut into
   parts, and the members' sketches (their n-grams counted in BINS bins) meet for each pair of parts: two sets share at most the sum of the smaller
   counts, so pairs for which that is too little for the threshold are no edges, and the components of the others are finer blocks.  So a family of texts
   that share bands but are not similar falls apart before any set is sent.  A bound, not an estimate: no similar pair is lost, whatever a block's size.
4. The representatives' full sets are sent to their block once (to each pair of parts, where a finer block is still large, which its members then are
   similar enough for), where intersections are counted exactly by a product of incidence matrices over the n-grams that two sets share.  Groups
   give each member its number of links and one edge to a root of what is linked, never the pairs.
5. Components of those verified edges are the near-duplicate classes.

No cap on a bucket, a partner or a candidate: copies are counted through their class, blocks of any size are
cut into parts of at most PART_SETS sets and PART_GRAMS n-grams (a longer set is a part by itself).

Defined results: null and empty texts have no n-grams and stay alone, with no links; repeated rows are copies;
documents with equal keys but different texts count apart; a class is named by its least (key, tie) pair; other columns do not
matter; an empty table gives an empty one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.storage import settled
from .common import bounded_batches, ensure_columns, rows_of, slices, stored, utf8, with_columns
from .graph import components
from .words import mix, windows, word_hashes, words

N = 5
THRESHOLD = 0.8
RECALL = 0.9999
MOST_HASHES = 240
PART_SETS = 2048
PART_GRAMS = 2_000_000
COLUMNS = 8192
#: Bins of a sketch, and how many of them are compared at a time.
BINS = 4096
SOME_BINS = 1024


def bands_for(threshold: float = THRESHOLD, recall: float = RECALL, most: int = MOST_HASHES) -> tuple[int, int]:
    """(bands, rows): 1 - (1 - threshold ** rows) ** bands >= recall."""
    best = None
    for rows in range(1, 33):
        bands = max(1, math.ceil(math.log(1 - recall) / math.log1p(-(threshold**rows)))) if threshold < 1 else 1
        if bands * rows <= most:
            best = (bands, rows)
    if best is None:
        raise ValueError("the recall needs more hashes")
    return best


def gram_sets(column: pa.Array, n: int = N) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct n-gram hashes of each text in a row, and the offsets of the texts."""
    data, offsets = utf8(column)
    w = words(data, offsets)
    hashes = word_hashes(data, w)
    found, at = windows(hashes, w.first, n)
    doc = w.doc[at]
    count = np.diff(w.first)
    for size in range(1, n):
        few = np.flatnonzero(count == size)
        if len(few):
            at_first = w.first[few]
            total = sum(hashes[at_first + k] * np.uint64(pow(0xD6E8FEB86659FD93, k + 1, 1 << 64)) for k in range(size))
            found, doc = np.concatenate([found, mix(total + np.uint64(size))]), np.concatenate([doc, few])
    order = np.lexsort((found, doc))
    found, doc = found[order], doc[order]
    fresh = np.ones(len(found), bool)
    fresh[1:] = (found[1:] != found[:-1]) | (doc[1:] != doc[:-1])
    found, doc = found[fresh], doc[fresh]
    return found, np.searchsorted(doc, np.arange(len(offsets)))


def sketches(docs: DataFrame, key: str, text: str, n: int, bands: int, rows: int) -> DataFrame:
    """key, tie (a hash of the text), set (16 bytes that stand for the n-gram set; null if empty), grams, and band hashes."""
    bounded_batches(docs.sparkSession)
    schema = T.StructType([T.StructField("key", docs.schema[key].dataType), *T._parse_datatype_string("tie long, `set` binary, grams long, bands array<long>").fields])
    factors = np.random.default_rng(20240307).integers(1, 2**63, bands * rows, dtype=np.uint64) | np.uint64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found, at = gram_sets(batch.column(2), n)
            count = np.diff(at)
            live = np.flatnonzero(count)
            first = at[:-1][live]
            out = np.zeros((len(live), bands), np.uint64)
            ids = np.zeros((len(live), 2), np.uint64)
            if len(live):
                for b in range(bands):
                    h = np.full(len(live), b + 1, np.uint64)
                    for f in factors[b * rows : (b + 1) * rows]:
                        h = mix(h + np.minimum.reduceat(found * f, first))
                    out[:, b] = h
                for k, salt in enumerate((0xA0761D6478BD642F, 0xE7037ED1A0B428DB)):
                    ids[:, k] = mix(np.add.reduceat(mix(found ^ np.uint64(salt)), first) + count[live].astype(np.uint64))
            raw = ids.tobytes()
            sets: list[bytes | None] = [None] * len(count)
            for k, d in enumerate(live.tolist()):
                sets[d] = raw[16 * k : 16 * k + 16]
            sizes = np.zeros(len(count), np.int64)
            sizes[live] = bands
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(out.ravel().view(np.int64)))
            yield with_columns(batch, ["key", "tie"], {"set": pa.array(sets, pa.binary()), "grams": pa.array(count), "bands": lists})

    return docs.select(F.col(key).alias("key"), F.xxhash64(text).alias("tie"), F.col(text).alias("text")).mapInArrow(run, schema)


def sketched(sets: DataFrame) -> DataFrame:
    """label, part, parts, rid and sketch of sets: how many of the hashes are in each of BINS bins, a byte each, 255 at most; then how many there are, 8 bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for grams in batch.column(4):
                h = mix(grams.values.to_numpy(zero_copy_only=False).view(np.uint64) ^ np.uint64(0x5851F42D4C957F2D))
                count = np.bincount((h >> np.uint64(52)).astype(np.int64), minlength=BINS)
                out.append(np.minimum(count, 255).astype(np.uint8).tobytes() + np.int64(len(h)).tobytes())
            yield with_columns(batch, ["label", "part", "parts", "rid"], {"sketch": pa.array(out, pa.binary())})

    return sets.select("label", "part", "parts", "rid", "grams").mapInArrow(run, "label long, part long, parts long, rid long, sketch binary")


def alike(left: np.ndarray, right: np.ndarray, threshold: float | Fraction) -> np.ndarray:
    """Which pairs of two arrays of sketches can be similar, as a matrix: all that are, and few others."""
    limit = Fraction(threshold).limit_denominator(10_000)
    num, den = limit.numerator, limit.denominator
    n, m = (x[:, BINS:].copy().view(np.int64)[:, 0] for x in (left, right))
    inter = np.zeros((len(left), len(right)), np.float32)  # at most 255 * BINS: exact
    for start in range(0, BINS, SOME_BINS):
        a, b = (x[:, start : min(start + SOME_BINS, BINS)] for x in (left, right))
        # The smaller of two counts is the number of k that both reach.
        for k in range(1, 256):
            x, y = a >= k, b >= k
            used = np.flatnonzero(x.any(0) & y.any(0))
            if not len(used):
                break
            inter += x[:, used].astype(np.float32) @ y[:, used].astype(np.float32).T
    # What a byte did not hold may be shared too.
    over_a, over_b = n - left[:, :BINS].sum(1, dtype=np.int64), m - right[:, :BINS].sum(1, dtype=np.int64)
    most = inter.astype(np.int64) + np.minimum(over_a[:, None], over_b[None, :])
    return most * (num + den) >= num * (n[:, None] + m[None, :])


def roots(linked: np.ndarray, left: np.ndarray, right: np.ndarray, n: int) -> np.ndarray:
    """The least place that each of n places is tied to by a matrix of links: least label over links, then the label's label, until nothing moves."""
    root = np.arange(n)
    while True:
        old = root.copy()
        np.minimum.at(root, left, np.where(linked, root[right][None, :], n).min(1, initial=n))
        np.minimum.at(root, right, np.where(linked, root[left][:, None], n).min(0, initial=n))
        root = root[root]
        if (root == old).all():
            return root


def finer(sets: DataFrame, threshold: Fraction) -> DataFrame:
    """sets (label, part, parts, rid, copies, grams) with blocks of several parts cut into finer ones; members that can have no link are left out."""
    large = sets.where("parts > 1")
    if large.isEmpty():
        return sets

    def run(group: pa.Table) -> pa.Table:
        rid, part = group["rid"].to_numpy(), group["part"].to_numpy()
        sketch = np.frombuffer(b"".join(group["sketch"].to_pylist()), np.uint8).reshape(len(rid), -1)
        i, j = group["i"][0].as_py(), group["j"][0].as_py()
        left, right = np.flatnonzero(part == i), np.flatnonzero(part == j)
        near = alike(sketch[left], sketch[right], threshold)
        if i == j:
            np.fill_diagonal(near, False)
        root = roots(near, left, right, len(rid))
        live = np.unique(np.concatenate([left[near.any(1)], right[near.any(0)]]))
        return pa.table({"rid": rid[live], "root": rid[root[live]]})

    edges = stored(in_pairs(stored(sketched(large), "sketches"), "sketch").groupBy("label", "i", "j").applyInArrow(run, "rid long, root long"), "near")
    blocks = components(edges.select(F.col("rid").alias("u"), F.col("root").alias("v")))
    kept = large.select("rid", "copies", "grams").join(blocks, F.col("rid") == F.col("node")).select("label", "rid", "copies", "grams")
    return stored(sets.where("parts = 1").unionByName(parted(stored(kept, "blocks"), F.size("grams"))), "sets")


def parted(members: DataFrame, grams: Column) -> DataFrame:
    """members (label, rid and others) with part and parts of their block."""
    parts = members.groupBy("label").agg(F.greatest(F.ceil(F.count("*") / PART_SETS), F.ceil(F.sum(grams) / PART_GRAMS)).alias("parts"))
    return members.join(parts, "label").withColumn("part", F.pmod(F.xxhash64("rid"), F.col("parts")))


def in_pairs(members: DataFrame, *more: str) -> DataFrame:
    """members at each pair i, j of parts of their block that theirs is one of."""
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))
    return members.withColumn("k", other).select("label", F.least("part", "k").alias("i"), F.greatest("part", "k").alias("j"), "part", "rid", *more)


def verified(members: DataFrame, threshold: Fraction) -> DataFrame:
    """rid, links and root from members: label, i, j (a pair of parts), part, rid, copies, grams (array of longs)."""
    num, den = threshold.numerator, threshold.denominator

    def run(group: pa.Table) -> pa.Table:
        rid, copies, part = (group[c].to_numpy() for c in ("rid", "copies", "part"))
        lists = group["grams"].combine_chunks()
        size = np.diff(lists.offsets.to_numpy())
        owner = np.repeat(np.arange(len(rid)), size)
        grams, which, seen = np.unique(lists.flatten().to_numpy(), return_inverse=True, return_counts=True)
        shared = np.flatnonzero(seen > 1)
        column = np.full(len(grams), -1)
        column[shared] = np.arange(len(shared))
        column = column[which]
        owner, column = owner[column >= 0], column[column >= 0]
        order = np.argsort(column, kind="stable")
        owner, column = owner[order], column[order]
        i, j = group["i"][0].as_py(), group["j"][0].as_py()
        left, right = np.flatnonzero(part == i), np.flatnonzero(part == j)
        inter = np.zeros((len(left), len(right)), np.int64)
        for start in range(0, len(shared), COLUMNS):
            a, b = np.searchsorted(column, [start, start + COLUMNS])
            held = np.zeros((len(rid), min(COLUMNS, len(shared) - start)), np.float32)
            held[owner[a:b], column[a:b] - start] = 1
            inter += (held[left] @ held[right].T).astype(np.int64)  # at most COLUMNS: exact
        linked = inter * (num + den) >= num * (size[left][:, None] + size[right][None, :])
        if i == j:
            np.fill_diagonal(linked, False)
        links = np.zeros(len(rid), np.int64)
        links[left] += linked @ copies[right]
        if i != j:
            links[right] += linked.T @ copies[left]
        root = roots(linked, left, right, len(rid))
        live = links > 0
        return pa.table({"rid": rid[live], "links": links[live], "root": rid[root[live]]})

    return members.groupBy("label", "i", "j").applyInArrow(run, "rid long, links long, root long")


def similarity_join(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = N, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """For each row of docs: key, tie (a hash of the text), class_id (the least key among all it is linked to, directly or not),
    class_tie (the tie of that row; where keys are null or repeat, class_id and class_tie together tell classes apart),
    set_id (the least key with the same n-gram set), copies (rows with that set) and n_links (other rows with a Jaccard
    similarity of `threshold` or more; copies count one by one)."""
    ensure_columns(docs, key, text)
    bands, rows = bands_for(threshold, recall)
    base = stored(sketches(docs, key, text, n, bands, rows), "sketches")
    live = base.where("set is not null")
    # Struct order: nulls come first in a key, as in the least key of a class.
    reps = live.groupBy("set").agg(F.min(F.struct("key", "tie")).alias("rep"), F.count("*").alias("copies"), F.first("grams").alias("grams"), F.first("bands").alias("bands"))
    reps = stored(reps.select(F.monotonically_increasing_id().alias("rid"), "set", "rep.key", "rep.tie", "copies", "grams", "bands"), "classes")
    # Buckets as stars around their least member.
    cells = reps.select("rid", F.explode("bands").alias("band"))
    hubs = cells.groupBy("band").agg(F.min("rid").alias("hub"), F.count("*").alias("n")).where("n > 1").select(F.col("band").alias("at"), "hub")
    stars = cells.join(hubs, F.col("band") == F.col("at")).where("rid <> hub").select(F.col("rid").alias("u"), F.col("hub").alias("v")).distinct()
    blocks = components(stars)
    mine = stored(blocks.join(reps.select("rid", "key", "tie", "copies", "grams"), F.col("node") == F.col("rid")).drop("node"), "candidates")
    wanted = parted(mine, F.col("grams")).select(F.col("key").alias("_key"), F.col("tie").alias("_tie"), "label", "part", "parts", "rid", "copies")
    limit = Fraction(threshold).limit_denominator(10_000)
    spread = in_pairs(finer(with_sets(docs, key, text, wanted, n), limit), "copies", "grams")
    found = stored(verified(spread, limit), "links")
    links = found.groupBy("rid").agg(F.sum("links").alias("links"))
    classes = components(found.select(F.col("rid").alias("u"), F.col("root").alias("v")))
    # Back to rows, through the sets.
    named = reps.select("rid", "set", "key", "tie", "copies").join(classes, F.col("rid") == F.col("node"), "left").withColumn("label", F.coalesce("label", "rid"))
    least = named.groupBy("label").agg(F.min(F.struct("key", "tie")).alias("least"))
    named = named.join(least, "label").join(links, "rid", "left").select(F.col("set").alias("_set"), F.col("key").alias("set_id"), F.col("least.key").alias("class_id"), F.col("least.tie").alias("class_tie"), "copies", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    out = base.select("key", "tie", "set").join(named, F.col("set") == F.col("_set"), "left")
    alone = F.col("_set").isNull()
    return out.select(F.col("key").alias(key), "tie", F.when(alone, F.col("key")).otherwise(F.col("class_id")).alias("class_id"), F.when(alone, F.col("tie")).otherwise(F.col("class_tie")).alias("class_tie"), F.when(alone, F.col("key")).otherwise(F.col("set_id")).alias("set_id"), F.coalesce("copies", F.lit(1)).alias("copies"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def with_sets(docs: DataFrame, key: str, text: str, wanted: DataFrame, n: int) -> DataFrame:
    """wanted (a row for each set: _key, _tie and others) with the n-gram set of one row of docs that has that key and text."""
    keep = [c for c in wanted.columns if c not in ("_key", "_tie")]
    rows = docs.select(F.col(key).alias("key"), F.xxhash64(text).alias("tie"), F.col(text).alias("text"))
    # Candidates grow with the corpus, so neither side is ever broadcast, however small a test makes it.
    met = rows.join(wanted.hint("merge"), F.col("key").eqNullSafe(F.col("_key")) & (F.col("tie") == F.col("_tie"))).select(*keep, "text")
    schema = T.StructType([wanted.schema[c] for c in keep] + [T.StructField("grams", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found, at = gram_sets(batch.column(batch.schema.get_field_index("text")), n)
            yield with_columns(batch, keep, {"grams": pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(found.view(np.int64)))})

    # Repeated rows have one key and text: one of them stands for the set.
    return stored(met.mapInArrow(run, schema).dropDuplicates(["rid"]), "sets")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one row of each near-duplicate class, the one with the least key; all columns as they were, whatever their names."""
    joined, _ = settled(docs.sparkSession, lambda: similarity_join(docs, key, text), "joined")  # its sets and sketches go
    of = lambda df, key, tie: df.select(key.alias("of_key"), tie.alias("of_tie"))
    alone = of(joined.where("copies = 1 and n_links = 0"), F.col(key), F.col("tie")).distinct().withColumn("one", F.lit(False))
    groups = joined.where("copies > 1 or n_links > 0").select(F.col(key).alias("key"), "tie", "class_id", "class_tie")
    first = groups.groupBy("class_id", "class_tie").agg(F.min(F.struct("key", "tie")).alias("x"))
    keep = alone.unionByName(of(first, F.col("x.key"), F.col("x.tie")).withColumn("one", F.lit(True)))
    met = rows_of(docs, key=F.col(key), tie=F.xxhash64(text)).join(keep, F.col("key").eqNullSafe(F.col("of_key")) & (F.col("tie") == F.col("of_tie")))
    # Of rows with one key and text in a class, only one stays; rows without n-grams are no class.
    once = met.where("one").dropDuplicates(["of_key", "of_tie"])
    return met.where("not one").unionByName(once).select("doc.*")
