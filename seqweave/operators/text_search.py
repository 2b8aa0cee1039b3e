"""All occurrences of a pattern, overlapping ones included, in time that grows with the text and not with the pattern."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import FIELD
from ..plans.ship import ship_package
from .halo import with_halo
from .scan import CHUNK, renumber

#: The base of the rolling hash.
BASE = 500_000_000
#: Code points that are searched at once: what a task holds of a text, whatever its length.
WINDOW = 1 << 20

Search = Callable[[np.ndarray, np.ndarray], np.ndarray]


def borders(pattern: np.ndarray) -> list[int]:
    """For each prefix of the pattern the length of its longest border, a shorter prefix that it also ends with."""
    p, out, k = pattern.tolist(), [0] * len(pattern), 0
    for i in range(1, len(p)):
        while k and p[i] != p[k]:
            k = out[k - 1]
        k += p[i] == p[k]
        out[i] = k
    return out


def kmp_starts(data: np.ndarray, pattern: np.ndarray) -> np.ndarray:
    """Starts of the pattern in an array: the automaton of its borders, from one place of its first value to the next.

    Places of that value come from one pass in numpy; the automaton runs from there until it is back at its start,
    so every value is read a bounded number of times.
    """
    m, n = len(pattern), len(data)
    if not m or n < m:
        return np.zeros(0, np.int64)
    starts = np.flatnonzero(data == pattern[0])
    if m == 1:
        return starts
    p, fail, out = pattern.tolist(), borders(pattern), []
    at = 0
    while at < len(starts):
        i = int(starts[at])
        if i + m > n:
            break
        k = 0
        # The automaton reads on while a prefix of the pattern is held.
        while True:
            if i >= n:
                break
            x = data[i]
            while k and x != p[k]:
                k = fail[k - 1]
            k += bool(x == p[k])
            i += 1
            if not k:
                break
            if k == m:
                out.append(i - m)
                k = fail[k - 1]
                if not k:
                    break
        at = int(np.searchsorted(starts, i)) if i < n else len(starts)
    return np.array(out, np.int64)


def rolling_starts(data: np.ndarray, pattern: np.ndarray) -> np.ndarray:
    """The same by a polynomial hash modulo 2 ** 31 - 1: hashes of windows of 2 ** k values from two of 2 ** (k - 1) each, hits checked.

    A window's hash comes from the binary digits of the pattern's length, so n values and m take about n * log m steps.
    """
    m, n = len(pattern), len(data)
    if not m or n < m:
        return np.zeros(0, np.int64)
    hashes, wanted = hashed(data, m), int(hashed(pattern, m)[0])
    at = np.flatnonzero(hashes == wanted)
    # Hits are checked by the first value that differs, a few at a time.
    for k in range(m):
        if not len(at):
            break
        if k and k % 64 == 0 and len(at) * m > 4 * n:  # too many hits to compare each: the automaton is linear
            return kmp_starts(data, pattern)
        at = at[data[at + k] == pattern[k]]
    return at


def hashed(data: np.ndarray, m: int) -> np.ndarray:
    """The hash of every window of m values."""
    field, n = np.uint64(FIELD), len(data)
    power = (data.astype(np.uint64) + np.uint64(1)) % field  # hashes of windows of `width`
    width, scale = 1, BASE % FIELD
    out, done = None, 0
    while True:
        if m & width:
            count = n - (done + width) + 1
            if out is None:
                out = power[:count].copy()
            else:
                out = (out[:count] * np.uint64(scale) + power[done : done + count]) % field
            done += width
        if width * 2 > m:
            return out
        power = (power[: n - 2 * width + 1] * np.uint64(scale) + power[width : n - width + 1]) % field
        width, scale = 2 * width, scale * scale % FIELD


def find_in_documents(docs: DataFrame, pattern: str, key: str = "doc_id", text: str = "text", search: Search | None = None) -> DataFrame:
    """key and pos (from 0, code points) of each occurrence in each text: one pass over Arrow batches.

    Texts that do not contain the pattern are filtered out by the scan; an empty pattern and null texts have no occurrences.  Texts are searched
    WINDOW code points at a time, with the pattern's length but one of overlap.
    """
    ship_package(docs.sparkSession)
    search = search or kmp_starts
    schema = T.StructType([docs.schema[key], T.StructField("pos", T.LongType())])
    wanted = np.array([ord(c) for c in pattern], np.uint32)
    step = max(WINDOW, 4 * len(pattern))

    def places(t: str) -> Iterator[np.ndarray]:
        for start in range(0, len(t), step):
            piece = t[start : start + step + len(wanted) - 1]
            yield search(np.frombuffer(piece.encode("utf-32-le", "surrogatepass"), np.uint32), wanted) + start

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, t in zip(batch.column(0), batch.column(1), strict=True):
                for found in places(t.as_py()):
                    if len(found):
                        yield pa.RecordBatch.from_arrays([pa.array([k.as_py()] * len(found), batch.schema.field(0).type), pa.array(found, pa.int64())], names=[key, "pos"])

    return docs.select(key, text).where(F.contains(text, F.lit(pattern))).mapInArrow(gathered(run), schema) if pattern else docs.select(key, F.lit(0).cast("long").alias("pos")).limit(0)


def gathered(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], rows: int = 1 << 16) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run with its small batches put together to `rows` rows or more."""

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        count = 0
        for out in run(batches):
            held.append(out)
            count += out.num_rows
            if count >= rows:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, count = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    return put


def rabin_karp(docs: DataFrame, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """find_in_documents by the rolling hash."""
    return find_in_documents(docs, pattern, key, text, rolling_starts)


def find_in_sequence(df: DataFrame, pattern: list, chunk: int = CHUNK) -> DataFrame:
    """The starts of the pattern in one long sequence of values, as a sequence; occurrences across chunk borders are seen."""
    m = len(pattern)
    if not m:
        return df.select("pos", F.col("pos").alias("value")).limit(0)
    hits = df.select("pos", "value")
    if m > 1:
        seen = with_halo(hits, m - 1, chunk)
        found = seen.where((F.col("value") == pattern[0]) & (F.col("ahead") == F.array(*[F.lit(p) for p in pattern[1:]])))
    else:
        found = hits.where(F.col("value") == pattern[0])
    return renumber(found.select("pos", F.col("pos").alias("value")), chunk=chunk)
