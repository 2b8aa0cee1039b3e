"""Toxicity by multiple-instance learning.

A document is a bag of sentences.  A sentence has p = sigmoid(bias + weights of its distinct words), a word's
weight is the sum of those of its features (itself and its prefixes), and a document has the noisy-or of its
sentences, 1 - product(1 - p).  Labels exist for documents alone: the weights are fitted by AdaGrad to the
likelihood of the noisy-or, so a sentence's p says where the offence is.

Fitting uses at most MOST_POSITIVE and MOST_NEGATIVE labelled documents, the first by a hash of the id; it runs in
one task.  Scoring is one map over all rows; the model (at most MOST_FEATURES weights) goes with the task.

Sentences end at a word that ends in . ! or ?, at a line break, and after SENTENCE_WORDS words.

Defined results: null and empty texts score 0; if no label is 1 (or the sample is empty), every score is 0;
of labels with equal ids all are taken; null ids or labels are not used for fitting; an empty table gives an empty one.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, ensure_columns, slices, utf8, with_columns
from .words import code_points, mix, word_hashes, words

MOST_POSITIVE = 2000
MOST_NEGATIVE = 4000
MOST_FEATURES = 20_000
SENTENCE_WORDS = 60
PREFIXES = (4, 5, 6, 7)
LEAST_Z = 4.5
LEAST_DOCS = 3
ROUNDS = 600
STEP, BIAS_STEP = 1.0, 0.5
MOST_CACHED = 400_000


def features(word: str) -> list[str]:
    """The features of a word as it stands in a text: without case and what is no letter."""
    word = "".join(c for c in word.lower() if c.isalpha())
    return [f"={word}", *(f"^{word[:k]}" for k in PREFIXES if len(word) > k)] if len(word) > 1 else []


def sentences(data: np.ndarray, w) -> tuple[np.ndarray, np.ndarray]:
    """For each word the sentence it is in, numbered over the slice, and for each sentence its first word."""
    n = len(w.start)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    breaks = np.zeros(len(data) + 1, np.int64)
    np.cumsum(data == 10, out=breaks[1:])
    fresh = np.ones(n, bool)
    fresh[1:] = (w.doc[1:] != w.doc[:-1]) | np.isin(data[w.end[:-1] - 1], list(b".!?")) | (breaks[w.start[1:]] > breaks[w.end[:-1]])
    first = np.flatnonzero(fresh)
    inside = np.arange(n) - np.repeat(first, np.diff(np.append(first, n)))
    fresh |= inside % SENTENCE_WORDS == 0
    return np.cumsum(fresh) - 1, np.flatnonzero(fresh)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


class Bags:
    """Labelled documents as sentences of word numbers; a word's features are numbers too, so a sample stays small."""

    def __init__(self):
        self.word: dict[bytes, int] = {}
        self.feature: dict[str, int] = {}
        self.of_word: list[list[int]] = []
        self.ones, self.zeros = np.zeros(0, np.int64), np.zeros(0, np.int64)  # documents by feature and label
        self.toxic: list[int] = []
        self.doc_of: list[np.ndarray] = []  # of each sentence
        self.sentence: list[np.ndarray] = []  # and word: distinct pairs
        self.words: list[np.ndarray] = []
        self.n_sentences = 0

    def number(self, raw: bytes) -> int:
        found = self.word.get(raw)
        if found is None:
            found = self.word[raw] = len(self.of_word)
            self.of_word.append([self.feature.setdefault(f, len(self.feature)) for f in features(raw.decode())])
        return found

    def expanded(self, owner: np.ndarray, word: np.ndarray, chosen: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (owner, feature) of pairs (owner, word); with chosen, of features it renumbers, -1 leaving out."""
        lists = [self.of_word[k] for k in word.tolist()]
        size = np.fromiter((len(x) for x in lists), np.int64, len(lists))
        flat = np.fromiter((f for x in lists for f in x), np.int64, int(size.sum()))
        owner = np.repeat(owner, size)
        if chosen is not None:
            flat = chosen[flat]
            owner, flat = owner[flat >= 0], flat[flat >= 0]
        pairs = np.unique(owner << 32 | flat)
        return pairs >> 32, pairs & 0xFFFFFFFF

    def add(self, column: pa.Array, toxic: list[int]) -> None:
        data, offsets = utf8(column)
        w = words(data, offsets)
        first_doc = len(self.toxic)
        self.toxic += toxic
        if not len(w.start):
            return
        sentence, first = sentences(data, w)
        _, one, which = np.unique(word_hashes(data, w), return_index=True, return_inverse=True)
        raw = data.tobytes()
        number = np.array([self.number(raw[a:b]) for a, b in zip(w.start[one].tolist(), w.end[one].tolist(), strict=True)])[which]
        grow = len(self.feature) - len(self.ones)
        self.ones, self.zeros = (np.concatenate([x, np.zeros(grow, np.int64)]) for x in (self.ones, self.zeros))
        pairs = np.unique(w.doc << 32 | number)
        doc, feature = self.expanded(pairs >> 32, pairs & 0xFFFFFFFF)
        label = np.array(toxic)[doc] == 1
        self.ones += np.bincount(feature[label], minlength=len(self.ones))
        self.zeros += np.bincount(feature[~label], minlength=len(self.zeros))
        pairs = np.unique((sentence + self.n_sentences) << 32 | number)
        self.sentence.append(pairs >> 32)
        self.words.append(pairs & 0xFFFFFFFF)
        self.doc_of.append(w.doc[first] + first_doc)
        self.n_sentences += len(first)

    def fit(self, rounds: int = ROUNDS) -> tuple[dict[str, float], float]:
        """Weights by feature and the bias."""
        y = np.array(self.toxic, bool)
        n1, n0 = int(y.sum()), int((~y).sum())
        if not n1 or not n0 or not self.n_sentences:
            return {}, -40.0
        p = (self.ones + self.zeros) / (n1 + n0)
        z = (self.ones / n1 - self.zeros / n0) / np.sqrt(np.maximum(p * (1 - p), 1e-12) * (1 / n1 + 1 / n0))
        good = np.flatnonzero((self.ones >= LEAST_DOCS) & (z >= LEAST_Z))
        good = good[np.argsort(-z[good], kind="stable")][:MOST_FEATURES]
        if not len(good):
            return {}, -40.0
        chosen = np.full(len(self.feature), -1)
        chosen[good] = np.arange(len(good))
        useful = np.array([any(chosen[f] >= 0 for f in x) for x in self.of_word])
        sentence, word = np.concatenate(self.sentence), np.concatenate(self.words)
        live = useful[word]
        row, col = self.expanded(sentence[live], word[live], chosen)
        doc = np.concatenate(self.doc_of)
        weight, bias = descend(row, col, doc, y, len(good), rounds)
        names = list(self.feature)
        return {names[f]: float(x) for f, x in zip(good.tolist(), weight, strict=True) if abs(x) > 1e-3}, bias


def descend(row: np.ndarray, col: np.ndarray, doc: np.ndarray, y: np.ndarray, n_features: int, rounds: int) -> tuple[np.ndarray, float]:
    """AdaGrad on the negative log likelihood of the noisy-or; row and col: sentences and their features, doc: of each sentence."""
    n_docs, n_sentences = len(y), len(doc)
    weight, bias = np.full(n_features, 0.5), -6.0
    seen_w, seen_b = np.full(n_features, 1e-6), 1e-6
    has = np.bincount(doc, minlength=n_docs) > 0
    for _ in range(rounds):
        p = sigmoid(bias + np.bincount(row, weight[col], minlength=n_sentences))
        clean = np.exp(np.bincount(doc, np.log1p(-np.minimum(p, 1 - 1e-12)), minlength=n_docs))
        whole = np.clip(1 - clean, 1e-9, 1)
        slope = np.where(y, -clean / whole, 1.0) * has
        at_z = slope[doc] * p / n_docs
        grad_w = np.bincount(col, at_z[row], minlength=n_features) + 1e-5 * weight
        grad_b = at_z.sum()
        seen_w += grad_w**2
        seen_b += grad_b**2
        weight -= STEP * grad_w / np.sqrt(seen_w)
        bias = max(-14.0, bias - BIAS_STEP * grad_b / np.sqrt(seen_b))
    return weight, float(bias)


def training_sample(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> DataFrame:
    """text and label of the bounded sample."""
    usable = labels.where(F.col(key).isNotNull() & F.col(label).isin(0, 1)).select(F.col(key).alias("key"), F.col(label).cast("int").alias("label"))
    parts = [usable.where(F.col("label") == k).orderBy(F.xxhash64("key"), "key").limit(most) for k, most in ((1, MOST_POSITIVE), (0, MOST_NEGATIVE))]
    sample = F.broadcast(parts[0].unionAll(parts[1]))  # at most MOST_POSITIVE + MOST_NEGATIVE rows
    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).join(sample, "key").select("text", "label")


def train(sample: DataFrame) -> bytes:
    """The model from text and label (0 or 1)."""
    bounded_batches(sample.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bags = Bags()
        for batch in slices(batches, "text"):
            bags.add(batch.column(0), batch.column(1).to_pylist())
        yield pa.RecordBatch.from_arrays([pa.array([saved(*bags.fit())], pa.binary())], names=["model"])

    # One task by design: the sample is bounded by the parameters above.
    row = sample.select("text", "label").repartition(1).mapInArrow(run, "model binary").first()
    return saved({}, -40.0) if row is None else bytes(row["model"])  # an empty sample may leave no task


def saved(weights: dict[str, float], bias: float) -> bytes:
    out = io.BytesIO()
    names = sorted(weights)
    np.savez_compressed(out, names=np.array(names, "U"), weights=np.array([weights[n] for n in names], float), bias=bias)
    return out.getvalue()


class Model:
    def __init__(self, saved: bytes):
        with np.load(io.BytesIO(saved)) as f:
            self.weights = dict(zip(f["names"].tolist(), f["weights"].tolist(), strict=True))
            self.bias = float(f["bias"])
        self.memo: dict[bytes, float] = {}

    def word(self, raw: bytes) -> float:
        found = self.memo.get(raw)
        if found is None:
            if len(self.memo) > MOST_CACHED:
                self.memo.clear()
            found = self.memo[raw] = sum(self.weights.get(f, 0.0) for f in features(raw.decode()))
        return found

    def score(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Scores of the texts; then each sentence's text, score, start and end (code points)."""
        data, offsets = utf8(column)
        w = words(data, offsets)
        n = len(offsets) - 1
        if not len(w.start):
            none = np.zeros(0, np.int64)
            return np.zeros(n), none, np.zeros(0), none, none
        sentence, first = sentences(data, w)
        hashes = word_hashes(data, w)
        _, one, which = np.unique(hashes, return_index=True, return_inverse=True)
        raw = data.tobytes()
        weight = np.array([self.word(raw[a:b]) for a, b in zip(w.start[one].tolist(), w.end[one].tolist(), strict=True)])
        hit = np.flatnonzero(weight[which])
        _, distinct = np.unique(mix(hashes[hit] + mix(sentence[hit].astype(np.uint64) + np.uint64(1))), return_index=True)
        hit = hit[distinct]
        p = sigmoid(self.bias + np.bincount(sentence[hit], weight[which[hit]], minlength=len(first)))
        doc = w.doc[first]
        clean = np.bincount(doc, np.log1p(-np.minimum(p, 1 - 1e-12)), minlength=n)
        points = np.zeros(len(data) + 1, np.int64)
        np.cumsum(code_points(data), out=points[1:])
        last = np.append(first[1:], len(w.start)) - 1
        base = points[offsets[doc]]
        return -np.expm1(clean), doc, p, points[w.start[first]] - base, points[w.end[last]] - base


SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("score", T.DoubleType())]))


def score(docs: DataFrame, model: bytes, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` (all but the text by default) with score, predicted, n_sentences, and the sentences that score 0.5 or more (code points, end exclusive)."""
    ensure_columns(docs, text)
    new = [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType()), T.StructField("n_sentences", T.LongType()), T.StructField("toxic_sentences", SPANS)]
    keep = [c for c in docs.columns if c != text and c not in {f.name for f in new}] if keep is None else keep
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Model(model)
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
        for batch in slices(batches, text):
            column = batch.column(batch.schema.get_field_index(text))
            scores, doc, p, start, end = scorer.score(column)
            spans: list[list[dict]] = [[] for _ in range(len(scores))]
            for k in np.flatnonzero(p >= 0.5).tolist():
                spans[doc[k]].append({"start": int(start[k]), "end": int(end[k]), "score": float(p[k])})
            yield with_columns(batch, keep, {"score": pa.array(scores), "predicted": pa.array((scores >= 0.5).astype(np.int32)), "n_sentences": pa.array(np.bincount(doc.astype(np.int64), minlength=len(scores))), "toxic_sentences": pa.array(spans, kind)})

    schema = T.StructType([docs.schema[c] for c in keep] + new)
    return docs.select(*dict.fromkeys([*keep, text])).mapInArrow(run, schema)
