"""Token counts under a unigram model, by dynamic programming shared over a trie of pre-tokens.

A unigram tokenizer cuts a pre-token into the pieces whose scores (log probabilities) have the largest sum.  The distinct
pre-tokens of a slice go into a trie of bytes.  A node keeps the forward score of the best cut of its prefix and
that cut's number of pieces, worked out once from the nodes above it however many pre-tokens share the prefix;
a pre-token's count is that of its terminal node.  A node also keeps the starts from which a piece may still
be under way, so that each new byte looks at those alone.

Pieces come from a public tokenizer file.  A byte-level BPE vocabulary lists its pieces by the order of their merges,
which follows their frequency, so by default a piece of id k has the Zipf score -log(k + 1) - log(H) with H the
harmonic number of the vocabulary; other scores may be given.  Of cuts with equal sums the one whose last piece is longest is taken,
at each prefix.

Defined results: null and empty texts have 0 tokens; repeated rows get equal counts; an empty table gives an empty one.
One map over the rows: no shuffle; the trie and the memo of counts are emptied at MOST_NODES and at the memo's own bounds, and
a pre-token of more than LONG bytes is counted without nodes.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .bpe import byte_chars
from .common import bounded_batches, ensure_columns, slices, with_columns
from .pretok import Memo, pretokens

MOST_NODES = 400_000
#: A pre-token of more bytes gets no nodes: its scores are held for the longest piece's length alone.
LONG = 1024


def zipf_pieces(path: str) -> dict[bytes, float]:
    """Pieces of a byte-level vocabulary file as bytes, with Zipf scores by id; added tokens are left out."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    back = {c: b for b, c in enumerate(byte_chars())}
    added = {x["content"] for x in spec["added_tokens"]}
    ids = {bytes(back[c] for c in token): k for token, k in spec["model"]["vocab"].items() if token not in added}
    total = math.log(math.fsum(1 / (k + 1) for k in ids.values()))
    return {piece: -math.log(k + 1) - total for piece, k in ids.items()}


class Trie:
    """Forward scores and piece counts of prefixes."""

    def __init__(self, pieces: dict[bytes, float]):
        if any(bytes([b]) not in pieces for b in range(256)):
            raise ValueError("every byte must be a piece")
        self.pieces: dict[bytes, float | None] = {}
        for piece in pieces:
            for k in range(1, len(piece)):
                self.pieces.setdefault(piece[:k], None)  # under way
        self.pieces |= pieces
        self.longest = max(map(len, pieces))
        self.clear()

    def clear(self) -> None:
        self.child: dict[tuple[int, int], int] = {}
        self.best, self.count, self.open = [0.0], [0], [()]

    def counts(self, words: list[bytes]) -> list[int]:
        """The number of pieces of each word, which is inserted."""
        out = []
        for word in words:
            if len(word) > LONG:
                out.append(self.alone(word))
                continue
            if len(self.best) > MOST_NODES:
                self.clear()
            node, path = 0, [0]
            for depth, byte in enumerate(word):
                below = self.child.get((node, byte))
                if below is None:
                    below = self.child[node, byte] = self.extend(word, depth, path)
                node = below
                path.append(node)
            out.append(self.count[node])
        return out

    def alone(self, word: bytes) -> int:
        """The same count without nodes, in memory that does not grow with the word."""
        n = self.longest + 1
        best, count, still = [0.0] * n, [0] * n, ()
        for depth in range(len(word)):
            top, pieces, kept = -math.inf, 0, []
            for start in (*still, depth):
                piece = word[start : depth + 1]
                if piece in self.pieces:
                    kept.append(start)
                    score = self.pieces[piece]
                    if score is not None and (total := best[start % n] + score) > top:
                        top, pieces = total, count[start % n] + 1
            still = tuple(kept)
            best[(depth + 1) % n], count[(depth + 1) % n] = top, pieces
        return count[len(word) % n]

    def extend(self, word: bytes, depth: int, path: list[int]) -> int:
        """A node for word[:depth + 1]; path: the nodes of its shorter prefixes."""
        best, count, still = -math.inf, 0, []
        for start in (*self.open[path[-1]], depth):
            piece = word[start : depth + 1]
            if piece in self.pieces:
                still.append(start)
                score = self.pieces[piece]
                if score is not None and (total := self.best[path[start]] + score) > best:
                    best, count = total, self.count[path[start]] + 1
        self.best.append(best)
        self.count.append(count)
        self.open.append(tuple(still))
        return len(self.best) - 1


@cache
def loaded(path: str) -> Memo:
    trie = Trie(zipf_pieces(path))
    return Memo(lambda words: [[n] for n in trie.counts([w.encode("utf-8", "surrogatepass") for w in words])])


def count_tokens(docs: DataFrame, path: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` (all but the text by default) of docs with n_tokens and n_pretokens of its text."""
    ensure_columns(docs, text)
    new = [("n_tokens", T.LongType()), ("n_pretokens", T.LongType())]
    keep = [c for c in docs.columns if c != text and c not in dict(new)] if keep is None else keep
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = loaded(path)
        for batch in slices(batches, text):
            p = pretokens(batch.column(batch.schema.get_field_index(text)).to_pylist())
            n = np.zeros(len(p.which) + 1, np.int64)
            if p.distinct:
                place = memo.places(p.distinct)  # may move the memo's arrays
                np.cumsum(memo.flat[memo.start[place]].astype(np.int64)[p.which], out=n[1:])
            yield with_columns(batch, keep, {"n_tokens": pa.array(np.diff(n[p.first])), "n_pretokens": pa.array(np.diff(p.first))})

    return docs.select(*dict.fromkeys([*keep, text])).mapInArrow(run, T.StructType([docs.schema[c] for c in keep] + [T.StructField(*x) for x in new]))
