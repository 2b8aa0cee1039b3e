"""Personal data: base patterns, and bootstrapped contextual extraction.  DataFrame functions only.

Base spans.  For each kind the matches and the pieces between them come from two regular expression calls; the
positions are running sums of their lengths, taken in blocks of the square root of their number; what lambdas share is bound first.  The expressions
use possessive quantifiers and start only where a run of their first class starts (or a match has ended), so
that they find the same leftmost matches in time that grows with the text.  E-mail addresses; IPv4 addresses with parts of
at most 255; card numbers of 13 to 19 digits with a right Luhn sum; phone numbers of 9 to 15 digits.

Contextual extraction.  Words are runs between blanks.  The instance of a base span is the words it touches, whole.  Its lexical patterns
are its contexts (the two words before and the two after it in the full text, whatever they are, in lower case with digits as 0) and, if it is one
word of SHORT characters or more, its head (its first four characters, if unlike an ordinary word's) and, with a digit in it, its forms: its shape, and from 16 characters on which kinds
of characters it has.
Base instances are seeds.  A pattern with LEAST_SEEDS distinct seeds or more makes a candidate of any word that has it, and two contexts make one of any
run of 2 to MOST_WORDS words between them (the nearest right one for each left one, and the reverse).

Rounds over the pattern-instance graph: a pattern's confidence is the mean score of the distinct seeds and words that have it, times 1 - 1 / (1 + its
seeds); a candidate's score is the noisy-or of its best form, its head and its contexts.  Patterns under LEAST_CONFIDENCE do not count, as many weak ones would
add up for every common word; nor do contexts and heads which, counted by places, other words have most of the time.  So a form such as "16 characters or more, letters and digits" speaks for an identifier only if a good part of the corpus's
distinct words of that form are known ones; where most are dates, paths or hashes it is dropped.

Candidates that reach LEAST_SCORE are new identifiers, of kind `id`, wherever they stand; one with fewer than 3 digits that no form speaks for
must have LEAST_SHARE of its distinct contexts in such patterns, so that an ordinary word is not taken for an identifier.  Runs go before the
words in them.  New identifiers are seeds of the next pass over the text, of PASSES: keys found by their form give contexts and heads that find others.

Not found: an identifier of several words with a known context on one side only (its next word alone is), and ordinary words used as names.

At scale: texts are stored once, beside their spans, and read again by each pass; what is shuffled are the distinct words, hashes of patterns and words at
patterns with enough seeds, as distinct edges, so copies of a passage count once.  Contexts and heads that common words have go first, by an estimate of fixed size
for each.  Texts are shuffled only if more than FEW of them hold new identifiers.

Defined results: null and empty texts have no spans; repeated rows get equal results; spans of one kind never overlap, those of two
kinds may; other columns are passed on or left out as each function says; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import quoted
from .common import ensure_columns, stored

#: The patterns of the four kinds, written so that they do not backtrack.
LOCAL = "[A-Za-z0-9._%+-]"
EMAIL = rf"(?:(?<!{LOCAL})|\G){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[ -]?[0-9])++"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
BLANK = r"\x20\x09-\x0D"
WORD = rf"[^{BLANK}]++"
KINDS = ("email", "ip", "card", "phone")
ID = "id"
ROUNDS = 4
LEAST_SEEDS = 3
LEAST_SCORE = 0.8
MOST_WORDS = 9
LEAST_CONFIDENCE = 0.2
LEAST_SHARE = 0.1
PASSES = 3
#: Words of fewer characters have no forms.
SHORT = 8
#: An estimated number of words may be so many times too high.
SLACK = 2.0
#: Characters of a plan that the driver keeps for each of many jobs.
PLAN_CHARACTERS = 10_000
#: Bytes of a row group of the stored texts, which each pass reads: a table of few files is then many tasks' work.
BLOCK = 4 << 20
#: Tables of up to so many rows are broadcast, or worked on in one task.
FEW = 200_000
#: Bits of a sieve for each hash that it holds, and in all, at least and at most: powers of two.
SIEVE_BITS, LEAST_BITS, MOST_BITS = 64, 1 << 20, 1 << 28


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value) with the value worked out once: inside lambdas the optimizer would repeat it for each element."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def total(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0), lambda a, x: a + x)


def ends(lengths: Column) -> Column:
    """The running sums of an array, by sums of blocks of the square root of its size: n * sqrt(n) steps at most."""
    n = F.size(lengths)

    def inside(p: Column) -> Column:
        xs, side, before = p["xs"], p["side"], p["before"]
        return F.transform(xs, lambda _, i: F.get(before, F.floor(i / side).cast("int")) + total(F.slice(xs, i - i % side + 1, i % side + 1)))

    def blocks(p: Column) -> Column:
        xs, side = p["xs"], p["side"]
        sums = F.transform(F.sequence(F.lit(0), F.ceil(n / side).cast("int") - 1), lambda b: total(F.slice(xs, b * side + 1, side)))
        before = let(sums, lambda s: F.transform(s, lambda _, b: total(F.slice(s, F.lit(1), b))))
        return let(F.struct(xs.alias("xs"), side.alias("side"), before.alias("before")), inside)

    return let(F.struct(lengths.alias("xs"), F.ceil(F.sqrt(n)).cast("int").alias("side")), blocks)


def matches(df: DataFrame, text: str, pattern: str, out: str, worth: Column) -> DataFrame:
    """df with `out`, the matches of the pattern as an array of start, end (code points, end exclusive), text; and `out`_gaps, the pieces between."""
    none = F.array().cast("array<string>")
    df = df.withColumn("_parts", F.when(worth, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(none))
    some = F.size("_parts") > 0
    df = df.withColumn(f"{out}_gaps", F.when(some, F.split(text, pattern, -1)).otherwise(none))
    both = F.struct(F.col("_parts").alias("parts"), F.col(f"{out}_gaps").alias("gaps"))
    sized = lambda p: F.struct(p["parts"].alias("parts"), F.transform(p["parts"], lambda x, i: F.length(x) + F.length(F.get(p["gaps"], i))).alias("lengths"))
    with_ends = lambda p: F.struct(p["parts"].alias("parts"), ends(p["lengths"]).alias("ends"))
    place = lambda p: F.transform(p["parts"], lambda x, i: F.struct((F.get(p["ends"], i) - F.length(x)).alias("start"), F.get(p["ends"], i).alias("end"), x.alias("text")))
    spans = let(both, lambda p: let(sized(p), lambda q: let(with_ends(q), place)))
    return df.withColumn(out, F.when(some, spans).otherwise(F.array().cast("array<struct<start:int,end:int,text:string>>"))).drop("_parts")


def rank(xs: Column, holds: Callable[[Column], Column]) -> Column:
    """How many elements of an array fulfil `holds`, which only a prefix of them does: by halving."""
    n = F.size(xs)
    pair = lambda lo, hi: F.struct(lo.alias("lo"), hi.alias("hi"))
    mid = lambda a: F.shiftright(a["lo"] + a["hi"], 1)
    step = lambda a, _: F.when(a["lo"] >= a["hi"], a).when(holds(F.get(xs, mid(a))), pair(mid(a) + 1, a["hi"])).otherwise(pair(a["lo"], mid(a)))
    return F.aggregate(F.sequence(F.lit(0), F.ceil(F.log2(n + 1)).cast("int")), pair(F.lit(0), n), step, lambda a: a["lo"])


def plain(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), "[1-9]", "0")


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def instance(words: Column, low: Column, first: Column, last: Column) -> Column:
    """first, last, instance (a hash of the words first to last), word (a single one) and left and right, hashes of two words of `low` before and after; null at an end."""
    return F.struct(
        first.alias("first"), last.alias("last"), F.xxhash64(F.array_join(F.slice(words, first + 1, last - first + 1), " ")).alias("instance"), F.when(first == last, F.get(words, first)).alias("word"),
        F.when(first > 0, F.xxhash64(F.get(low, first - 2), F.get(low, first - 1))).alias("left"),
        F.when(last < F.size(words) - 1, F.xxhash64(F.get(low, last + 1), F.get(low, last + 2))).alias("right"),
    )


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits has a right Luhn sum."""
    doubled = F.translate(number, "0123456789", "0246813579")
    n = F.length(number)
    one = lambda i: F.substring(F.when((n - i) % 2 == 0, number).otherwise(doubled), i, F.lit(1)).cast("int")
    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda a, i: a + one(i)) % 10 == 0


def true_ip(text: Column) -> Column:
    return F.forall(F.split(text, r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.coalesce(F.substring(F.ltrim(p, F.lit("0")), 1, 3).try_cast("int"), F.lit(0)) <= 255))


def true_card(text: Column) -> Column:
    n = F.length(digits(text))
    return F.when(n.between(13, 19), luhn(digits(text))).otherwise(False)


def true_phone(text: Column) -> Column:
    return F.length(digits(text)).between(9, 15)


def kept(kind: str, true: Callable[[Column], Column]) -> Column:
    """The matches of a kind that pass its test, as kind, start, end."""
    passed = F.filter(f"_{kind}", lambda s: true(s["text"]))
    return F.transform(passed, lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))


def base_spans(docs: DataFrame, text: str = "text", context: bool = True) -> DataFrame:
    """docs with `spans` (array of kind, start, end in the order of KINDS, then start) and, with context, `seeds`: their distinct instances."""
    text_ = F.coalesce(F.col(text), F.lit(""))
    df = docs.withColumn("_text", text_)
    digit = F.col("_text").rlike("[0-9]")
    df = matches(df, "_text", EMAIL, "_email", F.contains("_text", F.lit("@")))
    df = matches(df, "_text", IP, "_ip", digit & F.contains("_text", F.lit(".")))
    df = matches(df, "_text", CARD, "_card", F.col("_text").rlike("[0-9][ -]?[0-9]"))
    df = matches(df, "_text", PHONE, "_phone", F.contains("_text", F.lit("+")))
    true = {"email": lambda _: F.lit(True), "ip": true_ip, "card": true_card, "phone": true_phone}
    df = df.withColumn("spans", F.concat(*[kept(k, true[k]) for k in KINDS])).drop(*(f"_{k}{x}" for k in KINDS for x in ("", "_gaps")))
    if context:
        some = F.size("spans") > 0
        df = matches(df, "_text", WORD, "_word", some)
        placed = F.struct(F.col("_word").alias("at"), F.transform("_word", lambda w: w["text"]).alias("words"), words_of(plain(F.col("_text"))).alias("low"), F.col("spans").alias("spans"))
        ranges = lambda p: F.array_distinct(F.transform(p["spans"], lambda s: F.struct(rank(p["at"], lambda w: w["end"] <= s["start"]).alias("first"), (rank(p["at"], lambda w: w["start"] < s["end"]) - 1).alias("last"))))
        seeds = let(placed, lambda p: F.transform(ranges(p), lambda x: instance(p["words"], p["low"], x["first"], x["last"])))
        df = df.withColumn("seeds", F.when(some, seeds).otherwise(F.array().cast("array<struct<first:int,last:int,instance:bigint,word:string,left:bigint,right:bigint>>"))).drop("_word", "_word_gaps")
    return df.drop("_text")


@contextmanager
def many_jobs(spark: SparkSession) -> Iterator[Callable[[], None]]:
    """For a long chain of small jobs: the driver keeps no more than the head of each one's plan as text, and what is given back, called between
    passes, frees the broadcasts and compiled classes of jobs that are over, which the driver's JVM else holds until its heap is full."""
    name = "spark.sql.maxPlanStringLength"
    before = spark.conf.get(name)
    spark.conf.set(name, str(PLAN_CHARACTERS))
    sweep = spark.sparkContext._jvm.java.lang.System.gc
    try:
        sweep()
        yield sweep
    finally:
        spark.conf.set(name, before)


class Table:
    """A stored table, counted once: what is small by its count is broadcast or worked on in one task, anything larger is shuffled as usual.

    The graph of a small corpus takes many steps, each of which would else be as many tasks as the session's shuffles have, for a few rows.
    """

    def __init__(self, df: DataFrame, what: str) -> None:
        self.df = stored(df, what)
        self.n = self.df.count()

    @property
    def near(self) -> DataFrame:
        """The table in one partition if it has few rows: joins and aggregates of such tables need no shuffle."""
        return self.df.coalesce(1) if self.n <= FEW else self.df

    @property
    def sent(self) -> DataFrame:
        """The table to be sent to all tasks if it has few rows."""
        return self.few(self.df)

    def few(self, part: DataFrame) -> DataFrame:
        """The same for some of its rows or columns."""
        return F.broadcast(part) if self.n <= FEW else part


def forms(word: Column) -> Column:
    """Hashes of the forms of a word: an array, empty for a word of fewer than SHORT characters or without a digit.

    Its shape (runs of letters of a case and of digits as one sign each) with its length to a power of two; and from 16 characters on,
    which kinds of characters it has, and whether it has letters at all.
    """
    size = F.least(F.floor(F.log2(F.length(word))), F.lit(5))
    shape = F.regexp_replace(F.regexp_replace(F.regexp_replace(word, r"\p{Nd}+", "0"), r"\p{Lu}+", "A"), r"[\p{L}&&[^A]]+", "a")
    lower, upper = F.contains(shape, F.lit("a")), F.contains(shape, F.lit("A"))
    other = F.length(F.translate(shape, "aA0", "")) > 0
    long = F.array(F.xxhash64(F.lit("kinds"), lower, upper, other, size), F.xxhash64(F.lit("mixed"), lower | upper))
    short = F.array(F.xxhash64(F.lit("shape"), shape, size))
    return F.when(~formed(word), F.array().cast("array<bigint>")).when(size >= 4, F.concat(short, long)).otherwise(short)


def formed(word: Column) -> Column:
    return (F.length(word) >= SHORT) & word.rlike("[0-9]")


def head(word: Column) -> Column:
    """A hash of the first four characters of a word of SHORT characters or more that starts unlike ordinary words, which are letters and of one case from the second on; else null."""
    start = F.substring(word, 1, 4)
    return F.when((F.length(word) >= SHORT) & ~start.rlike(r"^\p{L}\p{Ll}{3}"), F.xxhash64(start))


def outer() -> Column:
    """side and h of the patterns outside of a word's form: contexts (L, R) and head (H); h may be null."""
    return F.array(*[F.struct(F.lit(s).alias("side"), h.alias("h")) for s, h in (("L", F.col("left")), ("R", F.col("right")), ("H", head(F.col("word"))))])


def patterns_of(places: DataFrame) -> DataFrame:
    """Distinct instance, side (as in outer(); F: a form), h and n (places) of places with instance, left, right and, of single words, word."""
    contexts = places.select("instance", F.inline(outer())).where("h is not null")
    inner = places.where("word is not null").select("instance", "word").distinct().select("instance", F.lit("F").alias("side"), F.explode(forms(F.col("word"))).alias("h"))
    return contexts.unionByName(inner).groupBy("instance", "side", "h").agg(F.count("*").alias("n"))


def covering(places: DataFrame) -> DataFrame:
    return places.select("row", F.explode(F.sequence("first", "last")).alias("word")).distinct()


def split_words(text: Column) -> Column:
    """The words as a pattern of one sign splits them, in which Java is several times as fast as in longer ones."""
    return F.array_remove(F.split(text, "[ \t\n\x0b\x0c\r]"), "")


def placed(base: DataFrame) -> DataFrame:
    """row, at (the number of the word), raw, and left and right (hashes of its contexts) of every word: arrays side by side, then code without lambdas."""
    text = F.col("text")
    cut = base.select("row", split_words(text).alias("raw"), split_words(plain(text)).alias("low"))
    none = F.lit(None).cast("string")
    wide = cut.select(
        "row", "raw", F.concat(F.array(none, none), "low").alias("p2"), F.concat(F.array(none), "low").alias("p1"),
        F.slice("low", F.lit(2), F.size("low")).alias("n1"), F.slice("low", F.lit(3), F.size("low")).alias("n2"), F.sequence(F.lit(0), F.size("low")).alias("at"),
    )
    rows = wide.select("row", F.inline(F.arrays_zip("raw", "p2", "p1", "n1", "n2", "at"))).where("raw is not null")
    return rows.select("row", "at", "raw", F.when(F.col("p1").isNotNull(), F.xxhash64("p2", "p1")).alias("left"), F.when(F.col("n1").isNotNull(), F.xxhash64("n1", "n2")).alias("right"))


def sieve(hashes: DataFrame, n: int) -> Callable[[Column], Column]:
    """Of n hashes (one column of longs), a test that holds for all of them and for few others: two bits each in one array, which is sent as one value.  Null for null.

    A join whose other side is large meets what passes only.  Where the array is as long as it may be, more passes; the join stays exact.
    """
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (SIEVE_BITS * n - 1).bit_length()))
    places = lambda h: (h.bitwiseAND(F.lit(bits - 1)), F.shiftrightunsigned(h, 32).bitwiseAND(F.lit(bits - 1)))
    at, bit = lambda p: F.shiftright(p, 6).cast("int"), lambda p: p.bitwiseAND(F.lit(63)).cast("int")
    one = F.call_function("shiftleft", F.lit(1).cast("long"), bit(F.col("p")))
    full = hashes.select(F.explode(F.array(*places(F.col(hashes.columns[0])))).alias("p")).select(at(F.col("p")).alias("at"), one.alias("bits"))
    zero = hashes.sparkSession.range(bits >> 6).select(F.col("id").cast("int").alias("at"), F.lit(0).cast("long").alias("bits"))
    longs = full.unionByName(zero).groupBy("at").agg(F.bit_or("bits").alias("bits")).agg(F.sort_array(F.collect_list(F.struct("at", "bits"))).alias("x"))
    held = stored(longs.select(F.col("x.bits").alias("bits")), "sieve").scalar()

    def test(h: Column) -> Column:
        first, second = (F.getbit(F.get(held, at(p)), bit(p)) == 1 for p in places(h))
        return first & second

    return test


def hits(base: DataFrame, patterns: Table) -> DataFrame:
    """row, word (its number), token (its hash), side and h where a word has one of the patterns (a stored table: side L, R or H, and h)."""
    names = {"L": "left", "R": "right", "H": "head"}
    of_side = lambda s, h: h.bitwiseXOR(F.lit(ord(s) * 0x9E3779B97F4A7))  # noqa: E731  two words may be a context on either side
    passes = sieve(patterns.df.select(F.coalesce(*[F.when(F.col("side") == s, of_side(s, F.col("h"))) for s in names])), patterns.n)
    some = [passes(of_side(s, F.col(n))) for s, n in names.items()]
    # Nearly all words have none of the patterns, and go before any join.
    words = placed(base).withColumn("head", head(F.col("raw"))).where(some[0] | some[1] | some[2])
    none = F.array().cast("array<struct<side:string,h:bigint>>")
    sides = F.concat(*[F.when(x, F.array(F.struct(F.lit(s).alias("side"), F.col(n).alias("h")))).otherwise(none) for (s, n), x in zip(names.items(), some, strict=True)])
    met = words.select("row", F.col("at").alias("word"), F.xxhash64("raw").alias("token"), F.inline(sides))
    return met.join(patterns.sent.select("side", "h"), ["side", "h"]).select("row", "word", "token", "side", "h")


def vocabulary(base: DataFrame) -> DataFrame:
    """token and h of every distinct word that has forms and each of them."""
    words = base.select(F.explode(split_words(F.col("text"))).alias("raw")).where(formed(F.col("raw"))).distinct()
    return words.select(F.xxhash64("raw").alias("token"), F.explode(forms(F.col("raw"))).alias("h"))


def places_of(base: DataFrame, ranges: DataFrame) -> DataFrame:
    """row, head (hash of the first word) and the fields of instance() for ranges: row, first, last."""
    by_row = Table(ranges.groupBy("row").agg(F.collect_set(F.struct("first", "last")).alias("ranges")), "ranges")
    met = meeting(base.select("row", "text"), by_row, "row")
    bound = F.struct(words_of(F.col("text")).alias("words"), words_of(plain(F.col("text"))).alias("low"), F.col("ranges").alias("ranges"))
    one = lambda p, x: F.struct(instance(p["words"], p["low"], x["first"], x["last"]).alias("at"), F.xxhash64(F.get(p["words"], x["first"])).alias("head"))
    inside = lambda p: F.filter(p["ranges"], lambda x: x["last"] < F.size(p["words"]))
    return met.select("row", F.inline(let(bound, lambda p: F.transform(inside(p), lambda x: one(p, x))))).select("row", "head", "at.*")


def long_instances(base: DataFrame, ranges: DataFrame, covered: Table) -> DataFrame:
    """Places of the instances of several words at ranges (row, first, last), wherever they stand clear of covered words."""
    new = Table(places_of(base, ranges).select("instance", "head", (F.col("last") - F.col("first") + 1).alias("n")).distinct(), "new")
    words = base.select("row", F.posexplode(split_words(F.col("text"))).alias("first", "raw")).withColumn("head", F.xxhash64("raw"))
    met = meeting(words, Table(new.df.groupBy("head").agg(F.collect_set("n").alias("ns")), "heads"), "head").select("row", "first", F.explode("ns").alias("n")).select("row", "first", (F.col("first") + F.col("n") - 1).alias("last"))
    met = Table(places_of(base, stored(met, "ranges")).join(new.few(new.df.select("instance")), "instance", "left_semi"), "places")
    return clear(met.near, covered).select("row", "first", "last", "instance", "word", "left", "right")


def clear(places: DataFrame, covered: Table) -> DataFrame:
    """Places none of whose words is covered."""
    words = places.select("row", "first", "last", F.explode(F.sequence("first", "last")).alias("at"))
    bad = words.join(covered.few(covered.df.withColumnRenamed("word", "at")), ["row", "at"]).select("row", "first", "last").distinct()
    return places.join(bad, ["row", "first", "last"], "left_anti")


def runs(at: DataFrame) -> DataFrame:
    """row, first, last of runs of 2 to MOST_WORDS words between a left and a right pattern of hits, each with the nearest, and lw, rw, their worth."""
    block = lambda c: F.floor(F.col(c) / MOST_WORDS)
    left = at.where("side = 'L'").select("row", F.col("word").alias("first"), F.col("worth").alias("lw")).withColumn("block", F.explode(F.array(block("first"), block("first") + 1)))
    right = at.where("side = 'R'").select("row", F.col("word").alias("last"), F.col("worth").alias("rw")).withColumn("block", block("last"))
    both = left.join(right, ["row", "block"]).where(F.col("last").between(F.col("first"), F.col("first") + MOST_WORDS - 1))
    near = both.groupBy("row", "first", "lw").agg(F.min(F.struct("last", "rw")).alias("x")).select("row", "first", "lw", "x.*")
    near = near.groupBy("row", "last", "rw").agg(F.max(F.struct("first", "lw")).alias("x")).select("row", "last", "rw", "x.*")
    return near.where("last > first")


def scored(edges: DataFrame, patterns: DataFrame) -> DataFrame:
    """token, form (the best confidence among its forms) and score (noisy-or of that and of its contexts' confidences)."""
    form, sure = F.col("side") == "F", F.least("confidence", F.lit(1 - 1e-9))
    best = F.coalesce(F.max(F.when(form, sure)), F.lit(0.0))
    rest = F.coalesce(F.sum(F.when(~form, F.log1p(-sure))), F.lit(0.0))
    met = edges.join(patterns, ["side", "h"], "left").groupBy("token")
    return met.agg(best.alias("form"), (1 - (1 - best) * F.exp(rest)).alias("score"))


def confidences(edges: DataFrame, seeds: DataFrame, rounds: int) -> tuple[Table, DataFrame]:
    """side, h, confidence, and token, form, score from edges (distinct side, h, token of words that are no seeds) and seeds (side, h, seeds)."""
    mean = (F.col("seeds") + F.coalesce("sum", F.lit(0.0))) / (F.col("seeds") + F.coalesce("others", F.lit(0))) * (1 - 1 / (1 + F.col("seeds")))
    scores = edges.select("token").distinct().select("token", F.lit(0.0).alias("score"))
    for k in range(rounds):
        sums = edges.join(scores.select("token", "score"), "token").groupBy("side", "h").agg(F.sum("score").alias("sum"), F.count("*").alias("others"))
        patterns = seeds.join(sums, ["side", "h"], "left").select("side", "h", mean.alias("confidence")).where(F.col("confidence") >= LEAST_CONFIDENCE)
        if k == rounds - 1:
            last = Table(patterns, "patterns")
            patterns = last.near
        scores = scored(edges, patterns)  # each is used once by the next round: one job in all
    return last, scores


def bound() -> Column:
    """The confidence of a pattern with `seeds` seeds and `others` other words, none of which is an identifier."""
    return F.col("seeds") / (F.col("seeds") + F.coalesce("others", F.lit(0))) * (1 - 1 / (1 + F.col("seeds")))


def counted(base: DataFrame, patterns: Table) -> DataFrame:
    """side, h, words (an estimate of the distinct words that have the pattern) and places."""
    return hits(base, patterns).groupBy("side", "h").agg(F.approx_count_distinct("token").alias("words"), F.count("*").alias("places"))


def able(active: DataFrame, met: DataFrame) -> DataFrame:
    """The active patterns that, by what is counted in met (nothing, if not there), can reach the least confidence by distinct words and by places."""
    others = F.greatest(F.lit(0.0), F.coalesce(F.col("words") / SLACK, F.lit(0.0)) - F.col("seeds"))
    both = active.join(met, ["side", "h"], "left").withColumn("others", others)
    return both.where(bound() >= LEAST_CONFIDENCE).where(F.col("n") >= LEAST_CONFIDENCE * F.coalesce("places", F.lit(0)))


def bootstrap(base: DataFrame, rounds: int = ROUNDS, least_seeds: int = LEAST_SEEDS, least_score: float = LEAST_SCORE, passes: int = PASSES, after_pass: Callable[[], None] = lambda: None) -> DataFrame | None:
    """row, first, last of new identifiers in base (row, text, seeds), by numbers of words; None if there are none."""
    seeds = base.select("row", F.inline("seeds"))
    covered = Table(covering(seeds), "covered")
    known, found, met, at = Table(patterns_of(seeds), "known"), None, None, None
    if not known.n:
        return None
    shapes = Table(vocabulary(base), "vocabulary")
    for _ in range(passes):
        active = Table(known.near.groupBy("side", "h").agg(F.count("*").alias("seeds"), F.sum("n").alias("n")).where(F.col("seeds") >= least_seeds), "active")
        # Outer patterns that many other words have, or that other words have most of the time, go before any place is written; later passes reuse the counts.
        outside = active.near.where("side <> 'F'")
        fresh = Table((outside if met is None else outside.join(met.near, ["side", "h"], "left_anti")).select("side", "h"), "fresh")
        if fresh.n:
            # The documents with seeds alone bound the counts from below, and leave few patterns to look for everywhere.
            some = Table(counted(base.where(F.size("seeds") > 0), fresh), "words")
            likely = Table(able(outside.join(fresh.near, ["side", "h"], "left_semi"), some.near).select("side", "h"), "likely")
            known_by = some.near.join(likely.near, ["side", "h"], "left_anti")
            if likely.n:
                known_by = known_by.unionByName(Table(counted(base, likely), "words").near)
            met = Table(known_by if met is None else met.near.unionByName(known_by), "words")
        strong = Table((outside.limit(0) if met is None else able(outside, met.near)).select("side", "h", "seeds"), "strong")
        # Forms: the vocabulary is counted exactly.
        others = shapes.near.join(known.near.select(F.col("instance").alias("token")).distinct(), "token", "left_anti").withColumn("side", F.lit("F"))
        others = others.join(active.near.where("side = 'F'").select("side", "h"), ["side", "h"])
        inner = Table(active.near.where("side = 'F'").join(others.groupBy("side", "h").agg(F.count("*").alias("others")), ["side", "h"], "left").where(bound() >= LEAST_CONFIDENCE).select("side", "h", "seeds"), "forms")
        edges = others.join(inner.near.select("side", "h"), ["side", "h"]).select("side", "h", "token")
        more = Table((strong.near if at is None else strong.near.join(at.near.select("side", "h").distinct(), ["side", "h"], "left_anti")).select("side", "h"), "more")
        if more.n:
            new = Table(hits(base, more), "hits")
            at = new if at is None else Table(at.near.unionByName(new.near), "hits")
        now = None
        if at is not None:
            now = Table(at.near.join(strong.near.select("side", "h"), ["side", "h"]).join(covered.sent, ["row", "word"], "left_anti"), "hits")
            edges = edges.unionByName(now.near.select("side", "h", "token").distinct())
        edges = Table(edges, "edges")
        if not edges.n:
            break
        patterns, scores = confidences(edges.near, strong.near.unionByName(inner.near), rounds)
        good = Table(scores.where(F.col("score") >= least_score), "good")
        places = None
        if now is not None:
            # Runs first, then words outside of them.
            sure = now.near.join(patterns.near.withColumnRenamed("confidence", "worth"), ["side", "h"])
            long = Table(clear(runs(sure).where(1 - (1 - F.col("lw")) * (1 - F.col("rw")) >= least_score), covered).select("row", "first", "last"), "runs")
            if long.n:
                places = Table(long_instances(base, long.df, covered), "runs")
        if good.n:
            taken = covered if places is None else Table(covered.df.union(covering(places.df)).distinct(), "covered")
            tokens = base.select("row", F.posexplode(split_words(F.col("text"))).alias("word", "raw")).withColumn("token", F.xxhash64("raw"))
            # Stored before the next join, which the optimizer would else move below this one, to all words.
            every = Table(meeting(tokens, good, "token").select("row", "word", "token", "form"), "places")
            every = Table(every.near.join(taken.sent, ["row", "word"], "left_anti"), "places")
            at_words = places_of(base, every.near.select("row", F.col("word").alias("first"), F.col("word").alias("last")))
            at_words = Table(at_words.select("row", F.col("first").alias("at"), "word", "left", "right").withColumnsRenamed({"word": "raw", "at": "word"}), "places")
            every = every.near.join(at_words.near, ["row", "word"])
            # A word with few digits that no form speaks for must stand in such patterns often enough.
            inside = patterns.near.where("side <> 'F'").select("side", "h")
            seen = every.where(F.col("form") < least_score).where(F.length(digits(F.col("raw"))) < 3).select("token", F.col("raw").alias("word"), "left", "right").distinct()
            met_by = seen.select("token", "left", "right", F.inline(outer())).join(inside, ["side", "h"]).select("token", "left", "right").distinct()
            counts = seen.groupBy("token").agg(F.count("*").alias("all")).join(met_by.groupBy("token").agg(F.count("*").alias("met")), "token", "left")
            rare = Table(counts.where(F.coalesce("met", F.lit(0)) < LEAST_SHARE * F.col("all")).select("token"), "rare")
            short = every.join(rare.near, "token", "left_anti").select("row", F.col("word").alias("first"), F.col("word").alias("last"), F.col("token").alias("instance"), F.col("raw").alias("word"), "left", "right")
            places = Table(short if places is None else places.near.unionByName(short), "found")
        if places is None or not places.n:
            break
        spots = places.near.select("row", "first", "last")
        found = Table(spots if found is None else found.near.unionByName(spots), "found")
        known = Table(known.near.unionByName(patterns_of(places.near)).groupBy("instance", "side", "h").agg(F.sum("n").alias("n")), "known")
        covered = Table(covered.near.union(covering(places.near)).distinct(), "covered")
        after_pass()
    return None if found is None else found.near


def meeting(df: DataFrame, table: Table, on: str, whole: bool = False) -> DataFrame:
    """df joined with a stored table that has a row for each value of the long `on`; whole: all of df, else what meets.

    A large table is not sent, and of df only what has such a value (and few others) is shuffled.
    """
    if table.n <= FEW:
        return df.join(F.broadcast(table.df), on, "left" if whole else "inner")
    passes = sieve(table.df.select(F.xxhash64(on)), table.n)(F.xxhash64(on))
    met = df.where(passes).join(table.df, on, "left" if whole else "inner")
    return met.unionByName(df.where(~passes), allowMissingColumns=True) if whole else met


def searched(docs: DataFrame, key: str, text: str, others: list[str]) -> DataFrame:
    """For each row of docs: key, tie (a hash of the text), text, kept (a struct: whether the text is null, then the columns `others`), spans (base ones) and more (null, or new ones)."""
    kept = F.struct(F.col(text).isNull().alias("absent"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(quoted(others))])
    base = base_spans(docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.xxhash64(text).alias("tie"), kept.alias("kept")))
    base = stored(base.select(F.monotonically_increasing_id().alias("row"), "key", "tie", F.coalesce("text", F.lit("")).alias("text"), "kept", "spans", "seeds"), "spans", BLOCK)
    with many_jobs(docs.sparkSession) as sweep:
        new = bootstrap(base, after_pass=sweep)
        sweep()
    if new is None:
        return base.withColumn("more", F.lit(None).cast(base.schema["spans"].dataType))
    by_row = Table(new.groupBy("row").agg(F.sort_array(F.collect_set(F.struct("first", "last"))).alias("ranges")), "marks")
    met = matches(meeting(base.select("row", "text"), by_row, "row"), "text", WORD, "_word", F.lit(True))
    # Of ranges that overlap (in one text, found in different ways) the later one goes on where the earlier one ends.
    joined = lambda p: F.aggregate(p["ranges"], F.array().cast("array<struct<first:int,last:int>>"), lambda a, x: F.when((F.size(a) > 0) & (F.get(a, F.size(a) - 1)["last"] >= x["first"]), F.concat(F.slice(a, F.lit(1), F.size(a) - 1), F.array(F.struct(F.get(a, F.size(a) - 1)["first"].alias("first"), F.greatest(F.get(a, F.size(a) - 1)["last"], x["last"]).alias("last"))))).otherwise(F.concat(a, F.array(x))))
    spans = let(F.struct(F.col("_word").alias("words"), F.col("ranges").alias("ranges")), lambda p: F.transform(joined(p), lambda x: F.struct(F.lit(ID).alias("kind"), F.get(p["words"], x["first"])["start"].alias("start"), F.get(p["words"], x["last"])["end"].alias("end"))))
    return meeting(base, Table(met.select("row", spans.alias("more")), "more"), "row", whole=True)


def all_spans() -> Column:
    return F.concat("spans", F.coalesce("more", F.array().cast("array<struct<kind:string,start:int,end:int>>")))


def find(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """For each row of docs: key, tie (a hash of the text), spans (base ones, then new ones of kind `id`, by kind and start)."""
    ensure_columns(docs, key, text)
    return searched(docs, key, text, []).select(F.col("key").alias(key), "tie", all_spans().alias("spans"))


def spelled(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def digest(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_id (the spans that the method adds) and n_spans (all)."""
    found = find(docs, key, text)
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    base = F.filter("spans", lambda s: s["kind"] != ID)
    return found.select(key, *[count(k).alias(f"n_{k}") for k in KINDS], F.sha2(spelled(base), 256).alias("base_sha256"), spelled(F.col("spans")).alias("spans"), count(ID).alias("n_id"), F.size("spans").cast("long").alias("n_spans"))


def redact(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with each span of its text replaced by [KIND]; of spans that overlap, the first by start (then the longest) counts and what others add goes with it.

    All columns stay, whatever their names (of types that Parquet holds), and the text alone changes.  A null text stays null.  Rows are stored beside
    their spans, so no text is shuffled but those with new identifiers, where these are many.
    """
    ensure_columns(docs, key, text)
    others = [c for c in docs.columns if c != text]
    rows = searched(docs, key, text, others).select("kept", F.when(~F.col("kept.absent"), F.col("text")).alias("text"), all_spans().alias("spans"))
    ordered = F.array_sort("spans", lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(b["end"] - a["end"]))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    step = lambda a, s: F.struct(
        F.greatest(a["at"], s["end"]).alias("at"),
        F.when(s["start"] < a["at"], a["out"]).otherwise(F.concat(a["out"], F.substring("text", a["at"] + 1, s["start"] - a["at"]), F.lit("["), F.upper(s["kind"]), F.lit("]"))).alias("out"),
    )
    done = F.aggregate(F.col("ordered"), start, step, lambda a: F.concat(a["out"], F.substring("text", a["at"] + 1, F.length("text"))))
    clean = F.when(F.size("ordered") > 0, done).otherwise(F.col("text"))
    place = {c: i for i, c in enumerate(others)}
    return rows.withColumn("ordered", ordered).select(*[(clean if c == text else F.col(f"kept.c{place[c]}")).alias(c) for c in docs.columns])
