"""Helpers shared by the training-data operators.

Text columns reach Python as Arrow batches.  A batch is cut again into slices of 2 MB of text
(a longer text is a slice of its own), so that memory does not depend on the row count of a batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import quoted
from ..plans.ship import ship_package
from ..plans.storage import new_path, shared_dir, stored

__all__ = ["bounded_batches", "ensure_columns", "field", "new_path", "rows_of", "shared_dir", "slices", "spread", "stored", "table", "utf8", "with_columns"]

SLICE_BYTES = 2 << 20
ARROW_BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Make workers ready: they have this package, and Arrow batches are bounded by bytes, not by rows alone."""
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BATCH_BYTES))


def ensure_columns(df: DataFrame, *names: str) -> None:
    for name in names:
        if df.columns.count(name) != 1:
            raise ValueError(f"column {name!r} must be there once; there are {df.columns}")


def rows_of(docs: DataFrame, **beside: Column) -> DataFrame:
    """Each row of docs as one struct `doc`, with helper columns beside it: whatever docs calls its own columns, none of them is touched."""
    return docs.select(F.struct(*[F.col(c) for c in quoted(docs.columns)]).alias("doc"), *[c.alias(n) for n, c in beside.items()])


def field(name: str) -> Column:
    """A column of docs in rows_of(docs)."""
    return F.col("doc").getField(name)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the n + 1 offsets of its rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = column.type in (pa.large_string(), pa.large_binary())
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches, cut where the running bytes of the text column pass `most`."""
    for batch in batches:
        _, offsets = utf8(batch.column(batch.schema.get_field_index(text)))
        start = 0
        while start < batch.num_rows:
            end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + most, side="right")) - 1)
            yield batch.slice(start, end - start)
            start = end


def spread(spark: SparkSession, least: int = 2) -> int:
    """Partitions for a shuffle that is given a count by hand: the session's own setting."""
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))


def with_columns(batch: pa.RecordBatch, keep: list[str], new: dict[str, pa.Array]) -> pa.RecordBatch:
    names = [*keep, *new]
    arrays = [batch.column(batch.schema.get_field_index(k)) for k in keep] + [v if isinstance(v, pa.Array) else pa.array(v) for v in new.values()]
    return pa.RecordBatch.from_arrays(arrays, names=names)
