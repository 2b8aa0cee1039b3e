"""Token ids in binary shards, with a minimal perfect hash index from document keys to offsets.

Files: `payload/shard-PPPPP-KKK-A.bin`, ids as little-endian 16-bit words (32-bit if the tokenizer has more
than 65,536 ids), documents in ascending key order, each followed by the end id; `offsets`, a Parquet table
with a row for each document (key, ordinal among rows with that key, shard, offset and count); `index`, a
Parquet table with one row for each part of the key space, which holds a minimal perfect hash function
of its keys and, at each key's slot, a stored 32-bit fingerprint, shard, offset and count.

Index: a key has a 64-bit hash (its part and three vertices) and a second one (its fingerprint).  The keys of
a part are the edges of a 3-partite random hypergraph of 1.23 vertices a key, which is peeled by degree-one
vertices in rounds; in reverse, each edge gives its free vertex a 2-bit value such that the values of its
three vertices say which of them is the edge's own.  The rank of that vertex among all owned ones is the
slot.  Values are packed four to a byte, and the rank before every RANK_STEP vertices is stored beside them.  A lookup reads three
values, one rank with the RANK_STEP values after it, and one record, whatever the size (`get` does it for one key); a foreign key is told apart by its
fingerprint (an error of 2 ** -32).

At scale: texts are range-partitioned by key once; each task writes its own shards, rolled at SHARD_BYTES,
under names of its attempt (A), which no other attempt ever writes to; the offsets table, which Spark commits, names those that count, and
files of attempts that failed are removed at the end.  Only sums of shards meet in one task.  Parts of the index hold about PART_KEYS keys whatever the number of documents.

Defined results: null and empty texts give the end id alone; a null key sorts first; rows that share a key lie
together in one shard in the order of their text hashes and are told apart by the ordinal; an empty table gives empty ones.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import cache
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, ensure_columns, new_path, slices, spread, stored
from .pretok import Memo, pretokens
from .words import mix

SHARD_BYTES = 256 << 20
PART_KEYS = 50_000
LOAD = 1.23
RANK_STEP = 64
LOCATIONS = "ordinal long, shard string, offset long, n_tokens long"


@cache
def library(path: str):
    """The tokenizers library's encoder for distinct pre-tokens and its memo, once for each worker."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import re

    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    added = [x.content for x in tokenizer.get_added_tokens_decoder().values()]
    special = re.compile("|".join(map(re.escape, sorted(added, key=len, reverse=True)))) if added else None
    memo = Memo(lambda pieces: [x.ids for x in tokenizer.encode_batch_fast(pieces, add_special_tokens=False)])
    return memo, special


def encode_texts(texts: list[str | None], path: str) -> tuple[np.ndarray, np.ndarray]:
    memo, special = library(path)
    return memo.ragged(pretokens(texts, special))


def write_shards(docs: DataFrame, out: str, tokenizer: str, end_id: int, vocabulary: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Writes payload and offsets under `out`; returns the offsets as read back."""
    ensure_columns(docs, key, text)
    spark = docs.sparkSession
    bounded_batches(spark)
    width = np.dtype("<u2" if max(vocabulary, end_id + 1) <= 1 << 16 else "<u4")
    schema = T.StructType([T.StructField("key", docs.schema[key].dataType)] + T._parse_datatype_string(LOCATIONS).fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(f"{out}/payload")
        fs.create_dir(root, recursive=True)
        task = TaskContext.get()
        sink, name, at, last, ordinal, rolled = None, "", 0, object(), 0, 0
        for batch in slices(batches, "text"):
            keys = batch.column(0).to_pylist()
            flat, offsets = encode_texts(batch.column(1).to_pylist(), tokenizer)
            n = len(keys)
            ids = np.full(len(flat) + n, end_id, width)
            ids[np.arange(len(flat)) + np.repeat(np.arange(n), np.diff(offsets))] = flat
            bounds = (offsets + np.arange(n + 1)) * width.itemsize
            raw, shards, places, ordinals = memoryview(ids).cast("B"), [], [], []
            for k, value in enumerate(keys):
                if value != last:
                    last, ordinal = value, 0
                    if sink is not None and at >= SHARD_BYTES:
                        sink.close()
                        sink = None
                else:
                    ordinal += 1
                if sink is None:
                    name, at = f"shard-{task.partitionId():05d}-{rolled:03d}-{task.taskAttemptId()}.bin", 0
                    sink, rolled = fs.open_output_stream(f"{root}/{name}"), rolled + 1
                part = raw[bounds[k] : bounds[k + 1]]
                sink.write(part)
                shards.append(name)
                places.append(at)
                ordinals.append(ordinal)
                at += len(part)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ordinals, pa.int64()), pa.array(shards, pa.string()), pa.array(places, pa.int64()), pa.array(np.diff(offsets) + 1)], names=["key", "ordinal", "shard", "offset", "n_tokens"])
        if sink is not None:
            sink.close()

    ordered = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).repartitionByRange(spread(spark), "key").sortWithinPartitions("key", F.xxhash64("text"))
    ordered.mapInArrow(run, schema).write.parquet(f"{out}/offsets")
    offsets = spark.read.schema(schema).parquet(f"{out}/offsets")
    remove_orphans(offsets, out)
    return offsets


def remove_orphans(offsets: DataFrame, out: str) -> int:
    """Removes payload files that the offsets table does not name, of attempts that failed; returns their number.  The driver lists shards, not documents."""
    fs, root = pafs.FileSystem.from_uri(f"{out}/payload")
    named = {r["shard"] for r in offsets.select("shard").distinct().collect()}
    found = fs.get_file_info(pafs.FileSelector(root, allow_not_found=True))
    orphans = [f.path for f in found if f.is_file and f.base_name not in named]
    for path in orphans:
        fs.delete_file(path)
    return len(orphans)


def starts(offsets: DataFrame, width: int) -> DataFrame:
    """shard and `before`, the ids in all shards before it; sums of shards alone are ordered in one task."""
    totals = offsets.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    order = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("shard", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("before"))


def hashed(df: DataFrame, parts: int) -> DataFrame:
    """df with h, print and part of its key and ordinal."""
    df = df.withColumn("h", F.xxhash64(F.lit(1), "key", "ordinal")).withColumn("print", F.xxhash64(F.lit(2), "key", "ordinal").bitwiseAND(F.lit(0xFFFFFFFF)))
    return df.withColumn("part", F.pmod(F.shiftrightunsigned("h", 11), F.lit(parts)))


def vertices(h: np.ndarray, seed: int, third: int) -> np.ndarray:
    """The three vertices of each key, one in each third."""
    base = mix(h.astype(np.int64).view(np.uint64) + np.uint64(seed * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
    return np.stack([((base >> np.uint64(21 * k)) & np.uint64((1 << 21) - 1)).astype(np.int64) % third + k * third for k in range(3)])


def build_mph(h: np.ndarray) -> tuple[int, int, np.ndarray]:
    """(seed, third, values) of a minimal perfect hash of the distinct hashes h."""
    n = len(h)
    third = max(2, int(np.ceil(LOAD * n / 3)) + 1)
    for seed in range(1, 1000):
        v = vertices(h, seed, third)
        degree = np.bincount(v.ravel(), minlength=3 * third)
        edges = np.zeros(3 * third, np.int64)  # the exclusive or of the edges at a vertex: at degree one, its edge
        for row in v:
            np.bitwise_xor.at(edges, row, np.arange(n))
        alive, rounds = np.ones(n, bool), []
        while True:
            free = np.flatnonzero(degree == 1)
            if not len(free):
                break
            edge, first = np.unique(edges[free], return_index=True)
            own = free[first]
            rounds.append((edge, own))
            alive[edge] = False
            for row in v[:, edge]:
                np.subtract.at(degree, row, 1)
                np.bitwise_xor.at(edges, row, edge)
        if not alive.any():
            values = np.full(3 * third, 3, np.uint8)  # 3: no key's own, counts as 0
            for edge, own in reversed(rounds):
                rest = sum(np.where(v[k, edge] == own, 0, values[v[k, edge]] % 3).astype(np.int64) for k in range(3))
                values[own] = (own // third - rest) % 3
            return seed, third, values
        third += third // 50 + 1
    raise ValueError("keys whose hashes are equal cannot be told apart")


#: For a byte of four values: how many of its first k are a key's own, k from 0 to 4.
OWNED = np.array([[sum((byte >> 2 * j & 3) != 3 for j in range(k)) for k in range(5)] for byte in range(256)], np.uint8)


def packed(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values four to a byte, to a whole number of steps, and the rank before each step."""
    full = np.full(-(-len(values) // RANK_STEP) * RANK_STEP, 3, np.uint8)
    full[: len(values)] = values
    four = full.reshape(-1, 4)
    owned = (full != 3).reshape(-1, RANK_STEP).sum(1)
    return four[:, 0] | four[:, 1] << 2 | four[:, 2] << 4 | four[:, 3] << 6, (np.cumsum(owned) - owned).astype("<u4")


def slots(h: np.ndarray, seed: int, third: int, values: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """The slot of each key of the index, from packed values and ranks; for a foreign key some slot or -1."""
    v = vertices(h, seed, third)
    value = lambda at: values[at >> 2] >> (2 * (at & 3)).astype(np.uint8) & 3
    which = sum(value(row).astype(np.int64) % 3 for row in v) % 3
    own = v[which, np.arange(len(h))]
    step = own // RANK_STEP
    rank = ranks[step].astype(np.int64)
    for k in range(RANK_STEP // 4):  # bytes of the step before and with the one the vertex is in
        rank += OWNED[values[step * (RANK_STEP // 4) + k], np.clip(own - step * RANK_STEP - 4 * k, 0, 4)]
    return np.where(value(own) == 3, -1, rank)


INDEX = "parts long, part long, n long, seed long, third long, `values` binary, ranks binary, prints binary, shards array<string>, shard binary, offset binary, count binary"


def write_index(offsets: DataFrame, out: str, part_keys: int = PART_KEYS) -> DataFrame:
    """Builds the index of the offsets table under `out` and returns it as read back."""
    spark = offsets.sparkSession
    bounded_batches(spark)
    parts = max(1, -(-offsets.count() // part_keys))

    def build(group: pa.Table) -> pa.Table:
        h = group["h"].to_numpy()
        seed, third, plain = build_mph(h)
        values, ranks = packed(plain)
        order = np.argsort(slots(h, seed, third, values, ranks))
        names, shard = np.unique(np.array(group["shard"].to_pylist(), object), return_inverse=True)
        column = lambda name, kind: group[name].to_numpy()[order].astype(kind).tobytes()
        row = {"parts": [parts], "part": [group["part"][0].as_py()], "n": [len(h)], "seed": [seed], "third": [third], "values": [values.tobytes()], "ranks": [ranks.tobytes()], "prints": [column("print", "<u4")], "shards": [names.tolist()], "shard": [shard[order].astype("<u4").tobytes()], "offset": [column("offset", "<u8")], "count": [column("n_tokens", "<u4")]}
        return pa.Table.from_pydict(row, schema=pa.schema([("parts", pa.int64()), ("part", pa.int64()), ("n", pa.int64()), ("seed", pa.int64()), ("third", pa.int64()), ("values", pa.binary()), ("ranks", pa.binary()), ("prints", pa.binary()), ("shards", pa.list_(pa.string())), ("shard", pa.binary()), ("offset", pa.binary()), ("count", pa.binary())]))

    keyed = hashed(offsets, parts).select("part", "h", "print", "shard", "offset", "n_tokens")
    keyed.groupBy("part").applyInArrow(build, INDEX).write.parquet(f"{out}/index")
    return spark.read.schema(INDEX).parquet(f"{out}/index")


def lookup(keys: DataFrame, index: DataFrame) -> DataFrame:
    """keys (key, ordinal and others) with shard, offset and n_tokens from the index; keys it does not hold are left out."""
    parts = index.agg(F.max("parts")).first()[0] or 1
    schema = T.StructType([*keys.schema.fields, *T._parse_datatype_string("shard string, offset long, n_tokens long").fields])
    names = keys.columns

    def find(wanted: pa.Table, held: pa.Table) -> pa.Table:
        if not wanted.num_rows or not held.num_rows:
            empty = wanted.select(names).slice(0, 0)
            return empty.append_column("shard", pa.array([], pa.string())).append_column("offset", pa.array([], pa.int64())).append_column("n_tokens", pa.array([], pa.int64()))
        row = held.slice(0, 1).to_pylist()[0]
        slot = slots(wanted["h"].to_numpy(), row["seed"], row["third"], np.frombuffer(row["values"], np.uint8), np.frombuffer(row["ranks"], "<u4"))
        true = (slot >= 0) & (np.frombuffer(row["prints"], "<u4")[slot] == wanted["print"].to_numpy())
        slot, shards = slot[true], np.array(row["shards"], object)
        return (
            wanted.select(names).filter(pa.array(true))
            .append_column("shard", pa.array(shards[np.frombuffer(row["shard"], "<u4")[slot]], pa.string()))
            .append_column("offset", pa.array(np.frombuffer(row["offset"], "<u8")[slot].astype(np.int64)))
            .append_column("n_tokens", pa.array(np.frombuffer(row["count"], "<u4")[slot].astype(np.int64)))
        )

    return hashed(keys, parts).groupBy("part").cogroup(index.groupBy("part")).applyInArrow(find, schema)


def get(spark: SparkSession, out: str, key: object, ordinal: int = 0, width: int = 2) -> np.ndarray | None:
    """The ids of one document with its end id, or None: one part of the index is read, and then the ids alone."""
    kind = spark.read.parquet(f"{out}/offsets").schema["key"].dataType
    index = spark.read.schema(INDEX).parquet(f"{out}/index")
    parts = index.select("parts").first()
    if parts is None:
        return None
    at = hashed(spark.range(1).select(F.lit(key).cast(kind).alias("key"), F.lit(ordinal).cast("long").alias("ordinal")), parts[0]).first()
    row = index.where(F.col("part") == at["part"]).first()
    if row is None:
        return None
    slot = int(slots(np.array([at["h"]]), row["seed"], row["third"], np.frombuffer(row["values"], np.uint8), np.frombuffer(row["ranks"], "<u4"))[0])
    if slot < 0 or int(np.frombuffer(row["prints"], "<u4")[slot]) != at["print"]:
        return None
    shard = row["shards"][int(np.frombuffer(row["shard"], "<u4")[slot])]
    offset, n = int(np.frombuffer(row["offset"], "<u8")[slot]), int(np.frombuffer(row["count"], "<u4")[slot])
    fs, root = pafs.FileSystem.from_uri(f"{out}/payload")
    with fs.open_input_file(f"{root}/{shard}") as f:
        return np.frombuffer(f.read_at(n * width, offset), f"<u{width}")


def read_checksums(located: DataFrame, out: str, width: int, keep: list[str]) -> DataFrame:
    """keep with ids_crc32 of the ids (as little-endian 32-bit words) at shard, offset and n_tokens."""
    schema = T.StructType([located.schema[c] for c in keep] + [T.StructField("ids_crc32", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(f"{out}/payload")
        name, source = "", None
        for batch in batches:
            sums = []
            rows = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("shard", "offset", "n_tokens")]
            for shard, offset, n in zip(*rows, strict=True):
                if shard != name:
                    if source is not None:
                        source.close()
                    name, source = shard, fs.open_input_file(f"{root}/{shard}")
                ids = np.frombuffer(source.read_at(n * width, offset), f"<u{width}")
                if len(ids) != n:
                    raise ValueError(f"{shard} ends before {offset} + {n} ids")
                sums.append(crc32(ids.astype("<u4").tobytes()))
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(c)) for c in keep] + [pa.array(sums, pa.int64())], names=[*keep, "ids_crc32"])

    return located.repartitionByRange(spread(located.sparkSession), "shard", "offset").sortWithinPartitions("shard", "offset").mapInArrow(run, schema)


def export_and_read_back(docs: DataFrame, tokenizer: str, end_id: int, vocabulary: int, key: str = "doc_id", text: str = "text", out: str | None = None) -> DataFrame:
    """key, start, n_tokens and ids_crc32 of every row of docs: written, indexed, looked up and read from the files."""
    spark: SparkSession = docs.sparkSession
    out = out or new_path(spark, "ids")
    offsets = write_shards(docs, out, tokenizer, end_id, vocabulary, key, text)
    width = 2 if max(vocabulary, end_id + 1) <= 1 << 16 else 4
    index = write_index(offsets, out)
    found = stored(lookup(offsets.select("key", "ordinal"), index), "found")
    read = read_checksums(found, out, width, ["key", "shard", "offset", "n_tokens"])
    before = starts(offsets, width)
    return read.join(before, "shard").select(F.col("key").alias(key), (F.col("before") + F.col("offset") / width).cast("long").alias("start"), "n_tokens", "ids_crc32")
