"""Near duplicates, personal data and mixing against brute force, and the whole pipeline."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from seqweave.llm import graph, mixing, ngram_join, pii
from seqweave.llm.words import mix
from seqweave.plans import storage

SPACE = "\x20\x09-\x0d"


def grams(text, n=5):
    w = re.findall(f"[^{SPACE}]+", text or "")
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} or ({tuple(w)} if w else set())


def linked(sets, threshold=0.8):
    """Links between items by their sets: pairs at or above the threshold; no sets, no links."""
    inverted, links = defaultdict(list), defaultdict(set)
    for k, s in enumerate(sets):
        shared = Counter(j for g in s for j in inverted[g])
        for j, c in shared.items():
            if c >= threshold * (len(s) + len(sets[j]) - c) - 1e-9:
                links[k].add(j)
                links[j].add(k)
        for g in s:
            inverted[g].append(k)
    return links


def classes(n, links):
    label = list(range(n))
    for k in range(n):
        todo = [k]
        while todo:
            x = todo.pop()
            for y in links[x]:
                if label[y] > label[k]:
                    label[y] = label[k]
                    todo.append(y)
    return label


def near_copies(seed=5, groups=12):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdef") for _ in range(6))
    texts = [None, "", "  ", "one two", "one two", "one  two", "one two three four five", "solo"]
    for _ in range(groups):
        base = [word() for _ in range(rng.randrange(5, 120))]
        for _ in range(rng.randrange(1, 9)):
            copy = list(base)
            for _ in range(rng.randrange(0, 1 + len(copy) // 20)):
                copy[rng.randrange(len(copy))] = word()
            texts.append(rng.choice([" ", "\n"]).join(copy))
    rng.shuffle(texts)
    return texts


def test_bands():
    bands, rows = ngram_join.bands_for(0.8, 0.9999)
    assert 1 - (1 - 0.8**rows) ** bands >= 0.9999 and bands * rows <= ngram_join.MOST_HASHES
    with pytest.raises(ValueError):
        ngram_join.bands_for(0.1, 0.999999, 10)


@pytest.mark.parametrize("parts", [(2048, 2_000_000), (3, 100)])
def test_similarity_join(spark, monkeypatch, parts):
    monkeypatch.setattr(ngram_join, "PART_SETS", parts[0])
    monkeypatch.setattr(ngram_join, "PART_GRAMS", parts[1])
    texts = near_copies()
    df = spark.createDataFrame([(k, t, "clash") for k, t in enumerate(texts)], "doc_id long, text string, label string")
    links = linked([grams(t) for t in texts])
    label = classes(len(texts), links)
    got = {r["doc_id"]: r for r in ngram_join.similarity_join(df).collect()}
    assert {k: (r["class_id"], r["n_links"]) for k, r in got.items()} == {k: (label[k], len(links[k])) for k in range(len(texts))}
    kept = ngram_join.keep_one(df)
    assert kept.columns == df.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted({label[k] for k in range(len(texts))})
    assert ngram_join.similarity_join(df.limit(0)).count() == 0


def test_blocks_of_several_parts_lose_no_link(spark):
    """Pairs of 4 and 5 n-grams, 4 of them shared (0.8), whose fifth is in a bin of another one: cut into parts or not, they stay together."""
    rng = np.random.default_rng(5)
    bin_of = lambda g: mix(g.view(np.uint64) ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(52)
    rows = []
    for k in range(20):
        four, more = rng.integers(-(2**62), 2**62, 4), rng.integers(-(2**62), 2**62, 40_000)
        fifth = more[np.isin(bin_of(more), bin_of(four))][0]
        rows += [(k, 0, 2, 2 * k, 1, four.tolist()), (k, 1, 2, 2 * k + 1, 1, [*four.tolist(), int(fifth)])]
    sets = spark.createDataFrame(rows, "label long, part long, parts long, rid long, copies long, grams array<long>")
    blocks = defaultdict(list)
    for r in ngram_join.finer(sets, Fraction(4, 5)).collect():
        blocks[r["label"]].append(r["rid"])
    assert sorted(map(sorted, blocks.values())) == [[2 * k, 2 * k + 1] for k in range(20)]


@pytest.mark.parametrize("n", [300, 30_000, 1_200_000])
def test_sketches_bound_what_is_shared(spark, n):
    """Long sets too, whose bins overflow a byte: what the sketches allow holds all pairs at the threshold."""
    rng = np.random.default_rng(n)
    pool = rng.integers(-(2**62), 2**62, 2 * n)
    sets = [pool[:n], pool[n // 9 : n + n // 9], pool[n // 8 : n + n // 8], pool[n:], pool[: -(-4 * n // 5)]]
    df = spark.createDataFrame([(0, 0, 2, k, 1, s.tolist()) for k, s in enumerate(sets)], "label long, part long, parts long, rid long, copies long, grams array<long>") if n < 10**6 else None
    if df is None:
        counts = [np.bincount((mix(s.view(np.uint64) ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(52)).astype(np.int64), minlength=ngram_join.BINS) for s in sets]
        assert max(c.max() for c in counts) > 255
        m = np.stack([np.frombuffer(np.minimum(c, 255).astype(np.uint8).tobytes() + np.int64(len(s)).tobytes(), np.uint8) for c, s in zip(counts, sets, strict=True)])
    else:
        m = np.stack([np.frombuffer(r["sketch"], np.uint8) for r in ngram_join.sketched(df).orderBy("rid").collect()])
    near = ngram_join.alike(m, m, Fraction(4, 5))
    held = [set(s.tolist()) for s in sets]
    true = np.array([[5 * len(a & b) >= 4 * len(a | b) for b in held] for a in held])
    assert (near | ~true).all() and true[0, 4] and (n > 30_000 or not near[0, 3])


def test_repeated_rows_and_keys(spark):
    text = "a b c d e f g h"
    df = spark.createDataFrame([(1, text), (1, text), (2, text), (None, text), (1, "p q r s t u v"), (None, None), (None, None)], "doc_id long, text string")
    out = ngram_join.similarity_join(df).collect()
    assert len(out) == 7 and sorted(r["n_links"] for r in out) == [0, 0, 0, 3, 3, 3, 3]
    assert Counter((r["doc_id"], r["text"]) for r in ngram_join.keep_one(df).collect()) == {(None, text): 1, (1, "p q r s t u v"): 1, (None, None): 2}


def test_classes_with_equal_least_keys(spark):
    a, b, c, d = ("a b c d e f g h", "p q r s t u v", "one two three four five six", "k l m n o p q r")
    rows = [(None, a), (2, a), (None, b), (3, b), (0, c), (5, c), (0, d), (6, d)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter((r["doc_id"], r["text"]) for r in ngram_join.keep_one(df).collect()) == {(None, a): 1, (None, b): 1, (0, c): 1, (0, d): 1}


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(k, k + 1) for k in range(300, 340)]
    links = defaultdict(set)
    for a, b in edges:
        links[a].add(b)
        links[b].add(a)
    label = classes(400, links)
    got = {r["node"]: r["label"] for r in graph.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {k: label[k] for k in range(400) if links[k] - {k}}
    assert graph.components(spark.createDataFrame([], "u long, v long")).count() == 0


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(number):
    total = 0
    for i, c in enumerate(reversed(number)):
        v = int(c) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def base(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "email" or kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")) or kind == "card" and 13 <= len(d) <= 19 and luhn(d) or kind == "phone" and 9 <= len(d) <= 15:
                out.append((kind, m.start(), m.end()))
    return out


def odd_texts():
    rng = random.Random(6)
    pieces = ["a@b.c", "x_y%@d-e.f.g", "@", ".", "1.2.3.4", "255.256.1.1", "0001.2.3.004", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "4111-1111-1111-1111", "4929348385146306", "+1 (555) 123-4567", "+4", "+49 ", " ", "  ", "-", "é", "漢字", "🙂", "\n", "\t", " ", "12", "7", "id", "%+"]
    texts = [None, "", "a@b@c.d", "a@b.c_d@e.f", "..@-.-", "1" * 3000, "a" * 5000, "+1" + " " * 2000, "+1" + "2 " * 2000, "a." * 2000 + "@", "1." * 3000, "card 4111111111111111 " * 300, "a@b.c " * 4000 + "id 4111111111111111 é " * 1500 + "+1 (555) 123-4567 " * 500]
    return texts + ["".join(rng.choice(pieces) for _ in range(rng.randrange(1, 25))) for _ in range(500)]


def test_base_spans(spark):
    texts = odd_texts()
    df = spark.createDataFrame([(k, t, "clash") for k, t in enumerate(texts)], "doc_id long, text string, spans string")
    for r in pii.digest(df).collect():
        want = base(texts[r["doc_id"]])
        spelled = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert r["base_sha256"] == hashlib.sha256(spelled.encode()).hexdigest(), (texts[r["doc_id"]], want, r["spans"])
        assert [r[f"n_{k}"] for k in PATTERNS] == [sum(x[0] == k for x in want) for k in PATTERNS] and r["spans"].startswith(spelled)
    assert pii.digest(df.limit(0)).count() == 0


def test_bootstrapping_finds_unseen_identifiers(spark):
    rng = random.Random(8)
    card = lambda: next(x for x in iter(lambda: str(rng.randrange(10**15, 10**16)), "") if luhn(x))
    texts = [f"some talk {rng.randrange(99)} here, customer account {card()} was billed today" for _ in range(40)]
    texts += [f"other talk, customer account QX-{rng.randrange(10**6, 10**7)} was billed today" for _ in range(5)]
    texts += [f"page {rng.randrange(10**6, 10**7)} of the book" for _ in range(30)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {r["doc_id"]: r["spans"] for r in pii.find(df).collect()}
    for k, t in enumerate(texts):
        new = [t[s["start"] : s["end"]] for s in out[k] if s["kind"] == pii.ID]
        assert new == (re.findall(r"QX-\d+", t) if 40 <= k < 45 else [])
    clean = {r["doc_id"]: r["text"] for r in pii.redact(df).collect()}
    assert clean[0].endswith("customer account [CARD] was billed today") and clean[41] == "other talk, customer account [ID] was billed today" and clean[50] == texts[50]


def found(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {r["doc_id"]: r["spans"] for r in pii.find(df).collect()}
    return [[t[s["start"] : s["end"]] for s in out[k] if s["kind"] == pii.ID] for k, t in enumerate(texts)]


def test_identifiers_without_digits_and_of_several_words(spark):
    name = lambda k: "".join("abcdefghij"[int(c)] for c in f"{k:03}")
    # Mails without digits are seeds; handles, masked mails and numbers of several words stand in their contexts.
    texts = [f"note {name(k)}, please write to {name(k)}@acme.com for more help" for k in range(40)]
    want = ["jdoe", "jane(at)acme", "AB 1234 5678", "john dot doe"]
    texts += [f"note {name(50 + k)}, please write to {w} for more help" for k, w in enumerate(want)]
    texts += [f"thanks jdoe and {name(70 + k)} of the book" for k in range(3)]
    assert found(spark, texts) == [[]] * 40 + [[w] for w in want] + [["jdoe"]] * 3


def test_contexts_are_whole(spark):
    # Neighbours are candidates themselves, and a gap is longer than 80 blanks.
    texts = [f"entry {k} id: AB{10000 + k} 2024-01-02 10.0.0.{k} 10:20:30 end {k}" for k in range(40)]
    texts += ["entry 90 id: AB12345 2024-01-02 K99817 10:20:30 end 90", "entry 91 id: AB12346 2024-01-02" + " " * 90 + "K99818 x"]
    out = found(spark, texts)
    assert "K99817" in out[40] and "K99818" in out[41]


def test_redaction_of_overlaps(spark):
    texts = [None, "", "mail a@b.c and +1 (555) 123-4567, ip 1.2.3.4.", "+4111111111111111 x", "é🙂 a@b.c"]
    df = spark.createDataFrame([(k, t, 7) for k, t in enumerate(texts)], "doc_id long, text string, n int")
    out = {r["doc_id"]: r["text"] for r in pii.redact(df.union(df.where("doc_id = 2"))).collect()}
    assert out == {0: None, 1: "", 2: "mail [EMAIL] and [PHONE], ip [IP].", 3: "+[CARD] x" if base(texts[3])[0][0] == "card" and len(base(texts[3])) == 1 else out[3], 4: "é🙂 [EMAIL]"}
    assert pii.redact(df.union(df)).count() == 10


def shares(sizes):
    """Targets by filling up in small steps of logic: who is above stops, the rest share again."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    stopped, left = {}, sum(sizes.values())
    while True:
        free = [s for s in names if s not in stopped and sizes[s]]
        if not free:
            break
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        above = [s for s in free if share[s] > 3 * sizes[s]]
        if not above:
            return {s: stopped.get(s, share.get(s, 0.0)) for s in names}
        for s in above:
            stopped[s] = 3.0 * sizes[s]
        left -= sum(stopped[s] for s in above)
    return {s: stopped.get(s, 0.0) for s in names}


@pytest.mark.parametrize("limit", [10_000, 20])
def test_mixing(spark, monkeypatch, limit):
    monkeypatch.setattr(mixing, "IN_ONE", limit)
    rng = random.Random(9)
    rows = [(k, rng.choice(["hot"] * 9 + ["b", "Ä", "a", "\U0001f642", "z", None, "tiny"][: 1 + k % 7]), " ".join(["w"] * rng.randrange(1, 40))) for k in range(1500)]
    rows += [(9000, "empty", None), (9001, "empty", ""), (9002, "hot", None), (9003, "hot", "\x1c")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, source string, text string, size string")
    out = {r["doc_id"]: r for r in mixing.weighted_fair_queue(df).collect()}
    size = {k: len(re.findall(f"[^{SPACE}]+", t or "")) for k, _, t in rows}
    sizes, taken = defaultdict(int), defaultdict(int)
    for k, s, _ in rows:
        sizes[s] += size[k]
        taken[s] += out[k]["taken"]
    want = shares(sizes)
    for k, s, _ in rows:
        r = out[k]
        assert (r["size"], r["source_size"]) == (size[k], sizes[s]) and abs(r["target"] - want[s]) < 1e-6
        assert r["taken"] in {e * size[k] for e in range(4)}
    assert all(abs(taken[s] - want[s]) <= 45 for s in sizes), (dict(taken), want)
    assert sum(sizes.values()) - 400 <= sum(taken.values()) <= sum(sizes.values())
    again = {r["doc_id"]: r["taken"] for r in mixing.weighted_fair_queue(df.repartition(7)).collect()}
    assert again == {k: r["taken"] for k, r in out.items()}
    mixed = mixing.mix(df)
    assert mixed.columns == df.columns and Counter(r["doc_id"] for r in mixed.collect()) == Counter({k: r["readings"] for k, r in out.items() if r["readings"]})


def test_mixing_of_few_rows(spark):
    df = spark.createDataFrame([(1, "a", "x y z")] * 3 + [(None, None, "x")], "doc_id long, source string, text string")
    out = mixing.weighted_fair_queue(df).collect()
    assert len(out) == 4 and {r["source_size"] for r in out} == {9, 1}
    assert mixing.weighted_fair_queue(df.limit(0)).count() == 0 and mixing.mix(df.limit(0)).count() == 0


def test_fill():
    assert mixing.fill([10, 10, 0], [5, 1, 1], 20) == [20 * 5 / 6, 20 / 6, 0.0]
    assert mixing.fill([1, 100], [5, 1], 101) == [3.0, 98.0]
    assert mixing.fill([], [], 0) == []


def test_pipeline(spark):
    """run() against its stages by brute force, but for the mix, whose order is a hash."""
    from tests.llm.test_text_operators import rules

    sf = "/root/testdata/sf0.001"
    rows = {r["doc_id"]: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    good = [k for k in sorted(rows) if rules(rows[k]["text"])[-1]]
    label = classes(len(good), linked([grams(rows[k]["text"]) for k in good]))
    kept = {good[k] for k in label}
    staged = corpus_pipeline.quality_rules(spark, spark.read.parquet(f"{sf}/documents.parquet"), sf)
    assert {r["doc_id"] for r in staged.collect()} == set(good)
    staged = corpus_pipeline.near_duplicates(spark, staged, sf)
    assert {r["doc_id"] for r in staged.collect()} == kept
    staged = corpus_pipeline.personal_data(spark, staged, sf)
    clean = {r["doc_id"]: r for r in staged.collect()}
    for k in kept:
        want, at = "", 0
        for kind, a, b in sorted(base(rows[k]["text"]), key=lambda s: (s[1], -s[2])):
            if a >= at:
                want += rows[k]["text"][at:a] + f"[{kind.upper()}]"
            at = max(at, b)
        assert clean[k]["text"] == want + rows[k]["text"][at:] and clean[k]["n_chars"] == len(clean[k]["text"])
    out = corpus_pipeline.run(spark, sf).collect()
    counts = Counter(r["doc_id"] for r in out)
    assert set(counts) <= kept and max(counts.values()) <= 3
    for r in out:
        assert r["decoded_sha256"] == hashlib.sha256(clean[r["doc_id"]]["text"].encode()).hexdigest() and len(r["ids"]) == r["n_tokens"]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_duplicates", "personal_data", "mix_sources", "bpe_ids"]


def test_queries_are_registered():
    names = entry.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))


def test_checkpoint_folder_is_the_sessions(spark):
    from seqweave.llm.common import shared_dir

    assert shared_dir(spark) == spark.sparkContext.getConf().get("spark.checkpoint.dir").rstrip("/")


def test_stages_leave_their_results_alone(spark):
    """After a run of the pipeline the shared folder holds one more table: what its last stage reads."""
    from pathlib import Path

    from seqweave.plans.storage import shared_dir

    folder = Path(shared_dir(spark).removeprefix("file://"))
    before = {p.name for p in folder.iterdir()}
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert [n.split("-")[0] for n in {p.name for p in folder.iterdir()} - before] == ["mix_sources"] and out.count() > 0


def test_forms_contexts_and_heads_lead_on(spark):
    """Two steps: keys are found by their form, and a key without digits by the heads of those; dates and paths of which the corpus has many are left."""
    rng = random.Random(12)
    pick = lambda chars, n: "".join(rng.choice(chars) for _ in range(n))
    word = lambda: pick("abcdefgh", rng.randrange(2, 11))
    say = lambda: " ".join(word() for _ in range(6))
    texts = [f"{say()} {word()}.{rng.randrange(10, 99)}@mail{k % 9}.example.com {say()}" for k in range(60)]
    keys = ["QKEY" + pick("ABCDEFG234567", 15) + "7" for _ in range(30)] + ["QKEY" + pick("ABCDEFG", 16) for _ in range(3)]
    texts += [f"{say()} {k} {say()}" for k in keys]
    texts += [f"{say()} 20{rng.randrange(10, 99)}-0{rng.randrange(1, 9)}-1{rng.randrange(9)} {say()}" for _ in range(60)]
    out = found(spark, texts)
    assert out[:60] == [[]] * 60 and out[93:] == [[]] * 60
    hits = sum(o == [k] for o, k in zip(out[60:93], keys, strict=True))
    assert hits == len(keys), [o for o in out[60:93]]


def test_precision_and_recall_of_added_spans(spark):
    """On documents with planted keys among clean ones: what is added against what was planted."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    text = {r["doc_id"]: r["text"] or "" for r in docs.select("doc_id", "text").collect()}
    planted = {(k, m.start(), m.end()) for k, t in text.items() for m in re.finditer(r"(?<=token = )\"[0-9a-f]+\"|(?<![^\s])[0-9]{16}(?!\S)", t) if not any(a <= m.start() < b for _, a, b in base(t))}
    added = {(r["doc_id"], s["start"], s["end"]) for r in pii.find(docs).collect() for s in r["spans"] if s["kind"] == pii.ID}
    assert planted and len(added & planted) >= 0.9 * len(planted) and len(added & planted) >= 0.9 * len(added), (planted - added, added - planted)


def test_no_join_makes_a_row_of_every_word(spark):
    """hits: what the joins make is what they return, however many words there are; and a word counts for each pattern that it has."""
    words = [f"w{k % 97}" for k in range(4000)]
    rows = [(0, " ".join([*words, "my", "key", "is", "Zq81xxxxx", *words])), (1, "my key is Zq81yyyyy"), (2, "is Zq81zzzzz my key")]
    base = spark.createDataFrame(rows, "row long, text string")
    at = {(r["row"], r["at"]): r for r in pii.placed(base).withColumn("head", pii.head(F.col("raw"))).collect()}
    spot = at[1, 3]
    patterns = pii.Table(spark.createDataFrame([("L", spot["left"]), ("R", at[2, 1]["right"]), ("H", spot["head"]), ("R", 5)], "side string, h long"), "patterns")
    found = pii.hits(base, patterns)
    assert Counter((r["row"], r["word"], r["side"]) for r in found.collect()) == Counter([(0, 3999, "R"), (0, 4003, "H"), (0, 4003, "L"), (1, 3, "H"), (1, 3, "L"), (2, 1, "H"), (2, 1, "R")])
    assert {r["token"] for r in found.where("side = 'H'").collect()} == {r[0] for r in spark.createDataFrame([("Zq81xxxxx",), ("Zq81yyyyy",), ("Zq81zzzzz",)], "w string").select(F.xxhash64("w")).collect()}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Inner" in plan and "LeftOuter" not in plan


def test_texts_stay_where_they_are(spark, monkeypatch, tmp_path):
    """personal_data shuffles no text, near_duplicates leaves one small table; tables too large to be sent change no result."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    docs = docs.unionByName(docs.limit(1).withColumns({"doc_id": F.lit(-1).cast(docs.schema["doc_id"].dataType), "text": F.lit(None).cast("string")}))
    out = pii.redact(docs)
    assert out.schema.simpleString() == docs.schema.simpleString()
    assert "Exchange hashpartitioning" not in out._jdf.queryExecution().executedPlan().toString()
    rows = lambda df: sorted(map(repr, df.collect()))
    want = rows(out)
    assert any("[EMAIL]" in r for r in want) and any("[ID]" in r for r in want) and any("doc_id=-1" in r and "text=None" in r for r in want)
    monkeypatch.setattr(pii, "FEW", 0)
    assert rows(pii.redact(docs)) == want
    monkeypatch.setattr(storage, "_written", [])
    corpus_pipeline.near_duplicates(spark, docs, "").count()
    assert len(storage._written) == 1
