"""Quality rules by compression bands.

A text's zstandard ratio (compressed bytes / bytes) is taken over the whole text and over its full
chunks of CHUNK bytes.  Each has limits that depend on the length in bytes: below the lower limit
the text repeats itself, above the upper one it is noise (base64 and other random bytes of 64 signs or
more).  A document is rejected if the whole text is outside its band, or more than OUTSIDE of its chunks
are outside theirs.

What bands cannot tell apart: random signs of a small alphabet.  From 512 bytes on, hexadecimal hashes have
ratios of 0.51 to 0.58 and random digits of 0.45 to 0.52, as clean text has (up to 0.70); they pass.  Nor are
texts under 128 bytes judged, where clean text comes near 0.9.

Beside it stand counts of words, symbols, repeated lines and repeated 8-word windows, with the base
rule of at least MIN_WORDS words and at most MAX_REPEAT percent of words in repeated windows.

Defined results: null and empty texts have no words, ratio null, and fail the base rule; repeated
rows get equal results; other columns are passed on as they are; an empty table gives an empty one.
The work is one pass of a map over the rows: no shuffle, memory bounded by one slice of text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import bounded_batches, ensure_columns, slices, utf8, with_columns
from .words import BYTE, code_points, mix, range_hash, sums, windows, word_hashes, words

CHUNK = 2048
OUTSIDE = 0.5
LEVEL = 3
MIN_WORDS = 20
MAX_REPEAT = 30
WINDOW = 8
#: From so many bytes on: lower and upper limit of the whole text's ratio.  Short texts compress badly and are not judged.
BANDS = ((0, 0.0, 99.0), (128, 0.40, 0.92), (256, 0.40, 0.80), (512, 0.30, 0.72), (2048, 0.25, 0.72), (8192, 0.20, 0.72), (32768, 0.15, 0.70))
#: The same for one chunk of CHUNK bytes.
CHUNK_BAND = (0.20, 0.72)
SYMBOLS = np.isin(np.arange(256), list(b"#*$%&|<>"))
FIELDS = (
    ("n_words", T.LongType()), ("word_chars", T.LongType()), ("n_symbols", T.LongType()), ("n_dup_lines", T.LongType()), ("n_repeat_words", T.LongType()),
    ("base_failed", T.BooleanType()), ("ratio", T.DoubleType()), ("chunks", T.LongType()), ("chunks_low", T.LongType()), ("chunks_high", T.LongType()), ("kept", T.BooleanType()),
)


def keyed(hashes: np.ndarray, doc: np.ndarray) -> np.ndarray:
    return mix(hashes + mix(doc.astype(np.uint64) + np.uint64(1)))


def duplicate_lines(data: np.ndarray, offsets: np.ndarray, word_start: np.ndarray) -> np.ndarray:
    """Of each text: lines with a word that equal an earlier line of it."""
    n = len(offsets) - 1
    breaks = np.flatnonzero(data == 10)
    start = np.unique(np.concatenate([offsets[:-1], breaks + 1]))
    start = start[start < len(data)]
    end = np.minimum.reduce([np.append(breaks, len(data))[np.searchsorted(breaks, start)], offsets[np.searchsorted(offsets, start, side="right")]])
    filled = np.searchsorted(word_start, end) > np.searchsorted(word_start, start)
    start, end = start[filled], end[filled]
    doc = np.searchsorted(offsets, start, side="right") - 1
    _, first = np.unique(keyed(range_hash(BYTE[data], start, end), doc), return_index=True)
    return np.bincount(doc, minlength=n) - np.bincount(doc[first], minlength=n)


def repeated_words(hashes: np.ndarray, doc: np.ndarray, first: np.ndarray, size: int = WINDOW) -> np.ndarray:
    """Of each text: words that stand in a window of `size` words found twice or more in it."""
    seen, at = windows(hashes, first, size)
    covered = np.zeros(len(hashes) + 1, np.int64)
    if len(at):
        _, inverse, count = np.unique(keyed(seen, doc[at]), return_inverse=True, return_counts=True)
        again = at[count[inverse] > 1]
        np.add.at(covered, again, 1)
        np.add.at(covered, again + size, -1)
    return sums(np.cumsum(covered[:-1]) > 0, first)


def band(n_bytes: int) -> tuple[float, float]:
    return next((low, high) for least, low, high in reversed(BANDS) if n_bytes >= least)


def ratios(text: memoryview, packer: zstandard.ZstdCompressor) -> tuple[float | None, int, int, int]:
    """The whole text's ratio, its full chunks, and how many of those are below and above their band."""
    n = len(text)
    if not n:
        return None, 0, 0, 0
    whole = len(packer.compress(text)) / n
    parts = [len(packer.compress(text[k : k + CHUNK])) / CHUNK for k in range(0, n - CHUNK + 1, CHUNK)] if n > CHUNK else []
    return whole, len(parts), sum(x < CHUNK_BAND[0] for x in parts), sum(x > CHUNK_BAND[1] for x in parts)


def measure(column: pa.Array) -> dict[str, pa.Array]:
    """The FIELDS of a column of texts."""
    data, offsets = utf8(column)
    w = words(data, offsets)
    n_words = np.diff(w.first)
    inside = np.zeros(len(data) + 1, np.int64)
    np.add.at(inside, w.start, 1)
    np.add.at(inside, w.end, -1)
    word_chars = sums((np.cumsum(inside[:-1]) > 0) & code_points(data), offsets)
    repeat = repeated_words(word_hashes(data, w), w.doc, w.first)
    failed = (n_words < MIN_WORDS) | (100 * repeat > MAX_REPEAT * n_words)
    packer = zstandard.ZstdCompressor(level=LEVEL, write_content_size=False, write_checksum=False)
    view = memoryview(np.ascontiguousarray(data))
    found = [ratios(view[a:b], packer) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
    good = []
    for (whole, n, low, high), size in zip(found, np.diff(offsets).tolist(), strict=True):
        least, most = band(size)
        good.append(whole is not None and least <= whole <= most and low + high <= OUTSIDE * n)
    return {
        "n_words": pa.array(n_words), "word_chars": pa.array(word_chars), "n_symbols": pa.array(sums(SYMBOLS[data], offsets)), "n_dup_lines": pa.array(duplicate_lines(data, offsets, w.start)), "n_repeat_words": pa.array(repeat),
        "base_failed": pa.array(failed), "ratio": pa.array([x[0] for x in found], pa.float64()), "chunks": pa.array([x[1] for x in found], pa.int64()), "chunks_low": pa.array([x[2] for x in found], pa.int64()), "chunks_high": pa.array([x[3] for x in found], pa.int64()),
        "kept": pa.array(np.array(good, bool) & ~failed),
    }


def compression_bands(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` (all but the text by default) of docs with FIELDS of its text; `kept` is the verdict.

    A column of docs that has the name of a field is left out of the default.
    """
    ensure_columns(docs, text)
    names = {f for f, _ in FIELDS}
    keep = [c for c in docs.columns if c != text and c not in names] if keep is None else keep
    bounded_batches(docs.sparkSession)
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField(f, t) for f, t in FIELDS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            yield with_columns(batch, keep, measure(batch.column(batch.schema.get_field_index(text))))

    return docs.select(*dict.fromkeys([*keep, text])).mapInArrow(run, schema)


def keep_good(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of docs whose text passes, with their columns as they were."""
    ensure_columns(docs, text)
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            yield batch.filter(measure(batch.column(batch.schema.get_field_index(text)))["kept"])

    return docs.mapInArrow(run, docs.schema)
