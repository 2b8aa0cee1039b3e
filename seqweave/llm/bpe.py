"""Byte-level BPE with a pair occurrence index, and decoding.

The distinct pre-tokens of a slice that the worker has not met yet stand in one array of symbols, linked
to their neighbours.  The index maps each mergeable pair (named by its rank) to all its positions in that
array.  Ranks are taken in ascending order; a rank's positions are merged from left to right, and the pairs
that a merge makes with its neighbours go to the lists of their ranks.  A merge makes only pairs of higher
ranks, so each rank is taken once.  An entry that a merge has made stale is seen by its symbols and skipped.

The tokenizer file is read where spark workers run (a path or a parameter of the operator), never copied.

Defined results: a null or empty text has no ids and decodes to ""; strings of the file's added tokens in a
text become those tokens, as in the library; repeated rows get equal results; an empty table an empty one.
One map over the rows: no shuffle; memory is one slice and the worker's bounded memo of pre-tokens.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import bounded_batches, ensure_columns, slices, with_columns
from .pretok import Memo, pretokens

#: Pre-tokens that a worker remembers: half of what others do, as the merge tables take memory too.
MOST_MERGED = 600_000


@cache
def byte_chars() -> list[str]:
    """The character by which byte-level vocabularies name each byte: itself if printable Latin-1, else one from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


class Bpe:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, plain = spec["model"], spec["pre_tokenizer"]
        if model["type"] != "BPE" or plain["type"] != "ByteLevel" or plain["add_prefix_space"] or not plain["use_regex"] or spec["normalizer"] or model.get("ignore_merges"):
            raise ValueError(f"{path}: not a byte-level BPE without normalizer and prefix space")
        vocab, chars = model["vocab"], byte_chars()
        back = {c: b for b, c in enumerate(chars)}
        self.added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        if any(x[k] for x in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip")):
            raise ValueError(f"{path}: added tokens that strip or need word borders are not supported")
        self.special = re.compile("|".join(map(re.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        self.byte_id = [vocab[c] for c in chars]
        pairs = [tuple(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        self.left, self.right = [vocab[a] for a, _ in pairs], [vocab[b] for _, b in pairs]
        self.merged = [vocab[a + b] for a, b in pairs]
        self.rank = {(a << 20) | b: r for r, (a, b) in enumerate(zip(self.left, self.right, strict=True))}
        size = max([*vocab.values(), *self.added.values()]) + 1
        self.token_bytes, self.decimal = [b""] * size, [str(k) for k in range(size)]
        for token, k in vocab.items():
            self.token_bytes[k] = bytes(back[c] for c in token) if all(c in back for c in token) else token.encode()
        for token, k in self.added.items():
            self.token_bytes[k] = token.encode()

    def encode_distinct(self, pieces: list[str]) -> list[list[int]]:
        """The ids of each piece; an added token is its own id."""
        ends, symbols, byte_id = [], [], self.byte_id
        for piece in pieces:
            if piece in self.added:
                symbols.append(self.added[piece])
            else:
                symbols += [byte_id[b] for b in piece.encode("utf-8", "surrogatepass")]
            symbols.append(-1)
            ends.append(len(symbols))
        after, before = list(range(1, len(symbols) + 1)), list(range(-1, len(symbols) - 1))
        rank, index = self.rank, {}
        for at in range(len(symbols) - 1):
            a, b = symbols[at], symbols[at + 1]
            if a >= 0 and b >= 0 and (r := rank.get((a << 20) | b)) is not None:
                index.setdefault(r, []).append(at)
        active = list(index)
        heapq.heapify(active)
        while active:
            r = heapq.heappop(active)
            left, right, merged = self.left[r], self.right[r], self.merged[r]
            for at in sorted(index.pop(r)):
                other = after[at]
                if symbols[at] != left or symbols[other] != right:
                    continue
                symbols[at], symbols[other] = merged, -2
                nearest = after[at] = after[other]
                before[nearest] = at
                if (x := symbols[nearest]) >= 0 and (new := rank.get((merged << 20) | x)) is not None:
                    if new not in index:
                        index[new] = []
                        heapq.heappush(active, new)
                    index[new].append(at)
                earlier = before[at]
                if earlier >= 0 and (x := symbols[earlier]) >= 0 and (new := rank.get((x << 20) | merged)) is not None:
                    if new not in index:
                        index[new] = []
                        heapq.heappush(active, new)
                    index[new].append(earlier)
        out, start = [], 0
        for end in ends:
            out.append([x for x in symbols[start : end - 1] if x >= 0])
            start = end
        return out

    def decode_bytes(self, ids: list[int]) -> bytes:
        return b"".join(map(self.token_bytes.__getitem__, ids))

    def decode(self, ids: list[int]) -> str:
        return self.decode_bytes(ids).decode("utf-8", "replace")


@cache
def loaded(path: str) -> tuple[Bpe, Memo]:
    """The tokenizer and its memo, once for each worker."""
    bpe = Bpe(path)
    return bpe, Memo(bpe.encode_distinct, MOST_MERGED)


def encode_texts(texts: list[str | None], path: str) -> tuple[np.ndarray, np.ndarray]:
    bpe, memo = loaded(path)
    return memo.ragged(pretokens(texts, bpe.special))


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids", keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` (all by default) of docs with the ids of its text, an array of ints."""
    ensure_columns(docs, text)
    keep = [c for c in docs.columns if c != ids] if keep is None else keep
    bounded_batches(docs.sparkSession)
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField(ids, T.ArrayType(T.IntegerType(), False))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            flat, offsets = encode_texts(batch.column(batch.schema.get_field_index(text)).to_pylist(), path)
            yield with_columns(batch, keep, {ids: pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32()))})

    return docs.select(*dict.fromkeys([*keep, text])).mapInArrow(run, schema)


def decode(rows: DataFrame, path: str, ids: str = "ids", text: str = "text") -> DataFrame:
    """rows with the text of its ids (null: "")."""
    ensure_columns(rows, ids)
    keep = [c for c in rows.columns if c != text]
    schema = T.StructType([rows.schema[c] for c in keep] + [T.StructField(text, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, _ = loaded(path)
        for batch in batches:
            yield with_columns(batch, keep, {text: pa.array([bpe.decode(x or []) for x in batch.column(batch.schema.get_field_index(ids)).to_pylist()], pa.string())})

    return rows.mapInArrow(run, schema)


def digests(docs: DataFrame, path: str, text: str = "text", keep: list[str] | None = None, ids: str | None = None) -> DataFrame:
    """keep, n_tokens, ids_sha256 and decoded_sha256, encoded and decoded in one pass; with `ids`, a column of that name has the ids too."""
    ensure_columns(docs, text)
    new = [(ids, T.ArrayType(T.IntegerType(), False))] if ids else []
    new += [("n_tokens", T.LongType()), ("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType())]
    keep = [c for c in docs.columns if c != text and c not in dict(new)] if keep is None else keep
    bounded_batches(docs.sparkSession)
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField(*x) for x in new])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, _ = loaded(path)
        decimal = bpe.decimal.__getitem__
        for batch in slices(batches, text):
            flat, offsets = encode_texts(batch.column(batch.schema.get_field_index(text)).to_pylist(), path)
            named, plain = [], []
            for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                one = flat[a:b].tolist()
                named.append(hashlib.sha256(",".join(map(decimal, one)).encode()).hexdigest())
                plain.append(hashlib.sha256(bpe.decode(one).encode()).hexdigest())
            lists = {ids: pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32()))} if ids else {}
            yield with_columns(batch, keep, lists | {"n_tokens": pa.array(np.diff(offsets)), "ids_sha256": pa.array(named, pa.string()), "decoded_sha256": pa.array(plain, pa.string())})

    return docs.select(*dict.fromkeys([*keep, text])).mapInArrow(run, schema)
