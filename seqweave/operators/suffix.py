"""Suffix arrays by prefix doubling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.storage import stored
from .partition import sort_values
from .scan import exclusive_scan


def suffix_array(text: DataFrame) -> DataFrame:
    """pos and value: the starts of all suffixes in lexicographic order, shorter ones first.  text: a sequence of characters or numbers.

    In a round each suffix has the rank of its first k values and meets the rank k places on; ranks of the pairs are the numbers
    of smaller pairs, from one sort.  Rounds double k and end when all ranks differ.
    """
    ranks = ranked(text.select("pos", F.col("value").alias("a"), F.lit(-1).cast("long").alias("b")))
    n, k = text.count(), 1
    while k < n and ranks.select("rank").distinct().count() < n:
        ahead = ranks.select((F.col("pos") - k).alias("pos"), F.col("rank").alias("b")).where("pos >= 0")
        pairs = ranks.join(ahead, "pos", "left").select("pos", F.col("rank").alias("a"), F.coalesce("b", F.lit(-1)).alias("b"))
        ranks, k = ranked(pairs), 2 * k
    return ranks.select(F.col("rank").alias("pos"), F.col("pos").alias("value"))


def ranked(pairs: DataFrame) -> DataFrame:
    """pos and rank, the number of smaller (a, b): equal pairs share a rank."""
    groups = pairs.groupBy("a", "b").agg(F.count("*").alias("n")).withColumn("pos", F.xxhash64("a", "b"))
    places = sort_values(groups, [F.col("a"), F.col("b")])
    starts = exclusive_scan(places, value="n", out="rank")
    return stored(pairs.join(starts.select("a", "b", "rank"), ["a", "b"]).select("pos", "rank"), "ranks")
