"""Callers' columns whose names are those of helpers, repeated rows, ties and empty tables in the stages of the pipeline."""

from __future__ import annotations

from collections import Counter

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from seqweave.llm import binary_ids, mixing, ngram_join, pii, quality
from seqweave.llm.queries import byte_bpe

NAMES = ["_t", "_key", "_tie", "_reading", "_n", "_one", "_spans", "_ordered", "_text", "doc", "key", "tie", "of_key", "of_tie", "spans", "least", "most", "turn", "one", "n", "ordered", "row", "label", "size", "h"]


def clashing(spark, texts):
    """documents with a column for each helper's name."""
    rows = [(k, t, "s" + str(k % 2), 0 if t is None else len(t), "en") + (f"x{k}",) * len(NAMES) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long, lang string, " + ", ".join(f"`{n}` string" for n in NAMES))


def words(k, n=40):
    return " ".join(f"w{k}x{i}" for i in range(n))


TEXTS = [words(0) + " mail a@b.c", words(0) + " mail a@b.c", words(1) + " ip 1.2.3.4 end", None, "", words(2), words(3), words(3)]


@pytest.mark.parametrize("stage", ["quality_rules", "near_duplicates", "personal_data", "mix_sources"])
def test_columns_of_the_caller_stay(spark, stage):
    docs = clashing(spark, TEXTS)
    out = dict(corpus_pipeline.STAGES)[stage](spark, docs, "")
    assert out.columns == docs.columns
    got = out.collect()
    assert got
    for r in got:
        assert all(r[n] == f"x{r['doc_id']}" for n in NAMES) and r["source"] == f"s{r['doc_id'] % 2}"
    empty = dict(corpus_pipeline.STAGES)[stage](spark, docs.limit(0), "")
    assert empty.columns == docs.columns and empty.count() == 0


def test_last_stage_on_odd_tables(spark):
    docs = clashing(spark, TEXTS)
    out = corpus_pipeline.bpe_ids(spark, docs.union(docs), "")
    assert out.count() == 2 * len(TEXTS) and corpus_pipeline.bpe_ids(spark, docs.limit(0), "").count() == 0
    assert {r["n_tokens"] for r in out.where("text is null" if "text" in out.columns else "doc_id = 3").collect()} == {0}


def test_index_beside_clashing_columns(spark):
    docs = clashing(spark, TEXTS)
    out = binary_ids.export_and_read_back(docs, byte_bpe(), end_id=2, vocabulary=50257)
    assert sorted(r["doc_id"] for r in out.collect()) == list(range(len(TEXTS)))


def test_redaction_keeps_other_columns(spark):
    out = {r["doc_id"]: r for r in pii.redact(clashing(spark, TEXTS)).collect()}
    assert out[0]["text"].endswith("mail [EMAIL]") and out[2]["text"].endswith("ip [IP] end") and out[3]["text"] is None


def test_repeated_rows_are_read_as_the_queue_says(spark):
    # Copies of a few keys in two sources, of which the budget reads some less often than others.
    rows = [(k % 7, "ab"[k % 2], words(k % 7, 20 + k % 7), k) for k in range(300)] + [(100 + k, "c", words(k, 30), k) for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, n int").repartition(5)
    queue = mixing.weighted_fair_queue(docs).groupBy("doc_id", "source").agg(F.sum("readings").alias("n"), F.min("readings").alias("low"), F.max("readings").alias("high")).collect()
    assert any(r["low"] < r["high"] for r in queue)
    want = Counter({(r["doc_id"], r["source"]): r["n"] for r in queue if r["n"]})
    mixed = mixing.mix(docs).collect()
    assert Counter((r["doc_id"], r["source"]) for r in mixed) == want
    per_row = Counter(r["n"] for r in mixed if r["source"] != "c")
    assert max(per_row.values()) - min(per_row.get(k, 0) for k in range(300)) <= 3
    taken = mixing.weighted_fair_queue(docs).agg(F.sum("taken")).first()[0]
    assert sum(len(r["text"].split()) for r in mixed) == taken


def test_queue_order_against_a_sorted_list(spark):
    """taken of each document from one sorted list of (finish time, hash, key) per reading."""
    rows = [(k, "abc"[min(2, k % 5)], words(k, 1 + k * 7 % 23)) for k in range(400)] + [(500, "a", None), (501, None, "x y"), (502, "z", "")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    out = {r["doc_id"]: r for r in mixing.weighted_fair_queue(docs).collect()}
    hashes = {r["doc_id"]: (r["h"], r["doc_id"], r["tie"]) for r in docs.select("doc_id", F.xxhash64("text").alias("tie"), F.xxhash64(F.lit(17), "doc_id", F.xxhash64("text")).alias("h")).collect()}
    unsigned = lambda k: (hashes[k][0] % (1 << 64) >> 54, *hashes[k])
    size = {k: len((t or "").split()) for k, _, t in rows}
    turns, budget = [], sum(size.values())
    for s in {s for _, s, _ in rows}:
        mine = sorted((k for k, x, _ in rows if x == s), key=unsigned)
        total = sum(size[k] for k in mine)
        for e in range(3):
            upto = 0
            for k in mine:
                upto += size[k]
                if size[k]:
                    turns.append(((e * total + upto) / out[k]["target"], *hashes[k], e))
    taken, spent = Counter(), 0
    for _, _, k, _, _ in sorted(turns):
        if spent + size[k] > budget:
            break
        spent += size[k]
        taken[k] += size[k]
    assert {k: r["taken"] for k, r in out.items()} == {k: taken[k] for k in out}


def test_quality_of_repeated_rows(spark):
    docs = clashing(spark, TEXTS)
    assert quality.keep_good(docs.union(docs)).count() == 2 * quality.keep_good(docs).count()


def test_classes_beside_clashing_columns(spark):
    out = {r["doc_id"]: r["class_id"] for r in ngram_join.similarity_join(clashing(spark, TEXTS)).collect()}
    assert out == {0: 0, 1: 0, 2: 2, 3: 3, 4: 4, 5: 5, 6: 6, 7: 6}


def family(rng, n, base, keep):
    """n texts that share about the share `keep` of a base's words, in place."""
    import random

    r = random.Random(rng)
    return [" ".join(w if r.random() < keep else f"v{r.randrange(10**9)}" for w in base) for _ in range(n)]


def test_families_below_the_threshold_fall_apart(spark, monkeypatch):
    """Texts of a similarity of about 0.6 share bands, but their sets go to no pair of parts; true copies among them stay linked."""
    monkeypatch.setattr(ngram_join, "PART_SETS", 64)
    base = [f"b{i}" for i in range(400)]
    # A window of five words stays with a probability of keep ** 5, and a pair shares it with its square.
    texts = family(1, 300, base, 0.973)
    near = [" ".join([*t.split()[:-3], "x", "y", f"z{k}"]) for k, t in enumerate(texts[:20])]
    docs = spark.createDataFrame(list(enumerate(texts + near)), "doc_id long, text string")
    shipped = []
    real = ngram_join.verified
    monkeypatch.setattr(ngram_join, "verified", lambda members, t: shipped.append(members.count()) or real(members, t))
    out = {r["doc_id"]: r for r in ngram_join.similarity_join(docs).collect()}
    from tests.llm.test_corpus_operators import classes, grams, linked

    links = linked([grams(t) for t in texts + near])
    label = classes(len(texts + near), links)
    assert {k: (r["class_id"], r["n_links"]) for k, r in out.items()} == {k: (label[k], len(links[k])) for k in range(len(texts + near))}
    assert sum(map(len, links.values())) >= 40 and shipped[0] <= 320


def test_recall_of_many_links(spark):
    """Links at and above the threshold, of pairs just above it: at least 0.99 of them are found."""
    from tests.llm.test_corpus_operators import grams, linked

    texts = []
    for k in range(150):
        base = [f"g{k}w{i}" for i in range(300)]
        texts += family(100 + k, 6, base, 0.9885)
    links = linked([grams(t) for t in texts])
    want = sum(map(len, links.values()))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = ngram_join.similarity_join(docs).agg(F.sum("n_links")).first()[0]
    assert want > 400 and 0.99 * want <= got <= want


def test_sketches_estimate(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    pool = rng.integers(-(2**62), 2**62, 6000)
    sets = [pool[:n].tolist() for n in (3000, 2500, 1800)] + [pool[4000:].tolist(), pool[:40].tolist(), pool[:33].tolist()]
    df = spark.createDataFrame([(0, 0, 2, k, 1, s) for k, s in enumerate(sets)], "label long, part long, parts long, rid long, copies long, grams array<long>")
    rows = {r["rid"]: np.frombuffer(r["sketch"], np.uint8) for r in ngram_join.sketched(df).collect()}
    m = np.stack([rows[k] for k in range(len(sets))])
    assert ngram_join.alike(m, m, 0.8).tolist() == [[min(len(set(a) & set(b)) / len(set(a) | set(b)), 1) >= 0.8 for b in sets] for a in sets]
