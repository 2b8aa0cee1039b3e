"""Places that the driver and the executors share, and cuts of lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir, set here only where it is unset."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and the executors share")
        at = "file://" + tempfile.mkdtemp(prefix="seqweave-")
        spark.conf.set("spark.checkpoint.dir", at)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


#: What this process has written; drop_stored deletes it.
_written: list[str] = []


def new_path(spark: SparkSession, what: str) -> str:
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    _written.append(path)
    return path


def drop_stored(spark: SparkSession) -> int:
    """Deletes the intermediate tables of this process, once no DataFrame that reads them is needed; returns their number."""
    paths = _written[:]
    _written.clear()
    return deleted(spark, paths)


def deleted(spark: SparkSession, paths: list[str]) -> int:
    jvm, conf, n = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), 0
    for name in paths:
        path = jvm.org.apache.hadoop.fs.Path(name)
        n += bool(path.getFileSystem(conf).delete(path, True))
    return n


def stored(df: DataFrame, what: str = "step", block: int | None = None) -> DataFrame:
    """df written to the shared folder and read back: a cut of the lineage that outlives its executors.

    block: bytes of a row group, where later passes are to be spread over more tasks than wrote it.
    """
    path = new_path(df.sparkSession, what)
    (df.write if block is None else df.write.option("parquet.block.size", block)).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settled(spark: SparkSession, make: Callable[[], DataFrame], what: str) -> tuple[DataFrame, str]:
    """What make() gives, stored, and its path; the intermediate tables that make() wrote are then deleted."""
    before = len(_written)
    out = stored(make(), what)
    made, _written[before:] = _written[before:-1], _written[-1:]
    deleted(spark, made)
    return out, _written[-1]
