"""Sequences as raw packed files of little-endian values, and files by prefix."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..operators.scan import CHUNK
from ..plans.ship import ship_package
from ..plans.storage import stored

KINDS = {"u8": (T.LongType(), "<u8"), "i8": (T.LongType(), "<i8"), "u4": (T.LongType(), "<u4"), "i4": (T.IntegerType(), "<i4"), "u1": (T.IntegerType(), "u1"), "f8": (T.DoubleType(), "<f8"), "f4": (T.FloatType(), "<f4")}


def write_parts(df: DataFrame, folder: str, kind: str = "i8", parts: int | None = None) -> DataFrame:
    """One file for each range of positions, named so that they sort in order; returns name and n.

    A task writes under the name of its attempt and renames, so a repeated one replaces its file.  `u8` holds bit patterns.
    """
    spark = df.sparkSession
    ship_package(spark)
    n = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    dtype = KINDS[kind][1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        task = TaskContext.get()
        name, attempt, count, sink = f"part-{task.partitionId():06d}.bin", f"{root}/.{task.taskAttemptId()}.tmp", 0, None
        for batch in batches:
            sink = sink or fs.open_output_stream(attempt)
            values = batch.column(1).to_numpy(zero_copy_only=False)
            sink.write((values.view("<u8") if kind == "u8" else values.astype(dtype)).tobytes())
            count += batch.num_rows
        if sink is not None:
            sink.close()
            fs.move(attempt, f"{root}/{name}")
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([count], pa.int64())], names=["name", "n"])

    ordered = df.select("pos", "value").repartitionByRange(n, "pos").sortWithinPartitions("pos")
    return stored(ordered.mapInArrow(run, "name string, n long"), "parts")


def consolidate(df: DataFrame, path: str, kind: str = "i8") -> int:
    """One raw file of all values in order; returns its size in bytes.  Parts are written by tasks and joined as streams by the driver."""
    folder = f"{path}.parts"
    names = [r["name"] for r in write_parts(df, folder, kind).orderBy("name").select("name").collect()]
    fs, root = pafs.FileSystem.from_uri(folder)
    _, target = pafs.FileSystem.from_uri(path)
    total = 0
    with fs.open_output_stream(target) as out:
        for name in names:
            with fs.open_input_stream(f"{root}/{name}") as part:
                while data := part.read(8 << 20):
                    total += len(data)
                    out.write(data)
    fs.delete_dir(root)
    return total


def read_packed(spark: SparkSession, path: str, kind: str = "i8", block: int = CHUNK) -> DataFrame:
    """The sequence of a raw file, read in blocks by tasks.  A file that is no whole number of values is refused."""
    ship_package(spark)
    fs, at = pafs.FileSystem.from_uri(path)
    size, width = fs.get_file_info(at).size, np.dtype(KINDS[kind][1]).itemsize
    if size is None:
        raise FileNotFoundError(path)
    if size % width:
        raise ValueError(f"{path}: {size} bytes are no whole number of {width}-byte values")
    n, dtype = size // width, KINDS[kind][1]
    schema = T.StructType([T.StructField("pos", T.LongType(), False), T.StructField("value", KINDS[kind][0])])
    plain = {T.LongType(): np.int64, T.IntegerType(): np.int32, T.DoubleType(): np.float64, T.FloatType(): np.float32}[KINDS[kind][0]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source, place = pafs.FileSystem.from_uri(path)
        with source.open_input_file(place) as f:
            for batch in batches:
                for b in batch.column(0).to_pylist():
                    first, end = b * block, min(n, (b + 1) * block)
                    values = np.frombuffer(f.read_at((end - first) * width, first * width), dtype)
                    values = values.view(np.int64) if kind == "u8" else values.astype(plain)
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(first, end)), pa.array(values)], names=["pos", "value"])

    return spark.range(-(-n // block)).mapInArrow(run, schema)


def find_files(spark: SparkSession, pattern: str) -> list[str]:
    """The files that match a Hadoop path pattern, sorted."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
    return sorted(s.getPath().toString() for s in found or ())
