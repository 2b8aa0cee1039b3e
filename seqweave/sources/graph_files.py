"""Text graphs: edge lists, adjacency files with offsets, and degree-and-difference files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.monoids import MAX
from ..operators.checks import checked
from ..operators.graph import transpose
from ..operators.partition import sort_values
from ..operators.scan import exclusive_scan
from ..plans.storage import stored


def read_edges(spark: SparkSession, path: str) -> DataFrame:
    """src, dst, weight from lines `src dst [weight]`, separated by blanks or tabs; the weight is 1 if left out.  Other lines raise."""
    parts = F.split(F.trim(F.translate("value", "\t", " ")), " +")
    lines = checked(spark.read.text(path).select(parts.alias("p")).where("p[0] <> ''"), F.size("p").isin(2, 3), "a line is no edge")
    return lines.select(F.get("p", F.lit(0)).cast("long").alias("src"), F.get("p", F.lit(1)).cast("long").alias("dst"), F.coalesce(F.get("p", F.lit(2)), F.lit("1")).cast("double").alias("weight"))


def head(words: DataFrame, position: int, path: str) -> int:
    row = words.where(F.col("pos") == position).first()
    if row is None:
        raise ValueError(f"{path}: the file has no head")
    return int(row["value"])


def whole(words: DataFrame, expected: int, path: str) -> None:
    """Refuses a file that has fewer or more words than its head says."""
    if (count := words.count()) != expected:
        raise ValueError(f"{path}: {count} words where its head makes it {expected}")


def tokens(spark: SparkSession, path: str) -> DataFrame:
    """The words of a text file as a sequence: pos and value.

    Lines are ordered by the block they are in and their place in it, both written down once.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"))
    lines = stored(lines, "lines").withColumn("words", F.filter(F.split("value", "[ \t\r]+"), lambda w: w != "")).where("size(words) > 0")
    blocks = lines.groupBy("file", "block").agg(F.min("id").alias("first"), F.sum(F.size("words")).alias("n"))
    before = Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(F.col("file").alias("f"), F.col("block").alias("b"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("file", "block").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    local = lines.withColumn("local", F.coalesce(F.sum(F.size("words")).over(inside), F.lit(0)))
    met = local.join(blocks, (F.col("file") == F.col("f")) & (F.col("block") == F.col("b")))
    return met.select(F.posexplode("words").alias("k", "value"), "before", "local").select((F.col("before") + F.col("local") + F.col("k")).alias("pos"), "value")


def read_adjacency(spark: SparkSession, path: str) -> tuple[int, DataFrame]:
    """n and the edges (src, dst) of a file: a header word, n, m, n offsets, m destinations."""
    words = stored(tokens(spark, path), "tokens")
    n, m = (head(words, k, path) for k in (1, 2))
    whole(words, n + m + 3, path)
    starts = words.where(F.col("pos").between(3, n + 2)).select((F.col("pos") - 3).alias("src"), F.col("value").cast("long").alias("start"))
    return n, owned(words.where(F.col("pos").between(n + 3, n + m + 2)).select((F.col("pos") - n - 3).alias("at"), F.col("value").cast("long").alias("dst")), starts)


def owned(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """src and dst from places and each vertex's first place: the last vertex to start at or before a place owns it."""
    marks = starts.groupBy(F.col("start").alias("at")).agg(F.max("src").alias("src"))
    met = edges.join(marks, "at", "left").select(F.col("at").alias("pos"), "dst", "src")
    return exclusive_scan(met, MAX, "src", "owner", inclusive=True).select(F.col("owner").alias("src"), "dst")


def read_differences(spark: SparkSession, path: str) -> tuple[int, DataFrame]:
    """n and the edges of a file: n, m, n degrees, then each vertex's destinations as differences (the first as it is)."""
    words = stored(tokens(spark, path), "tokens")
    n, m = (head(words, k, path) for k in (0, 1))
    whole(words, n + m + 2, path)
    degrees = words.where(F.col("pos").between(2, n + 1)).select((F.col("pos") - 2).alias("pos"), F.col("value").cast("long").alias("degree"))
    starts = exclusive_scan(degrees, value="degree", out="start").where("degree > 0").select(F.col("pos").alias("src"), "start")
    steps = words.where(F.col("pos").between(n + 2, n + m + 1)).select((F.col("pos") - n - 2).alias("pos"), F.col("value").cast("long").alias("dst"))
    sums = exclusive_scan(steps, value="dst", out="sum", inclusive=True)
    edges = owned(sums.select(F.col("pos").alias("at"), "sum", "dst").withColumn("dst", F.struct("sum", "dst", "at")), starts)
    firsts = edges.join(starts.withColumnRenamed("src", "s"), (F.col("src") == F.col("s")) & (F.col("dst.at") == F.col("start"))).select(F.col("src").alias("v"), (F.col("dst.sum") - F.col("dst.dst")).alias("base"))
    return n, edges.join(firsts, F.col("src") == F.col("v")).select("src", (F.col("dst.sum") - F.col("base")).alias("dst"))


def read_symmetric(spark: SparkSession, path: str) -> tuple[int, DataFrame]:
    """read_differences with each edge in both directions; double edges and loops stay."""
    n, edges = read_differences(spark, path)
    edges = stored(edges, "edges")
    return n, edges.unionByName(transpose(edges))


def write_adjacency(edges: DataFrame, n: int, path: str) -> None:
    """The inverse of read_adjacency, one word a line, in files that sort in order."""
    spark = edges.sparkSession
    places = sort_values(edges.select("src", "dst").withColumn("pos", F.xxhash64("src", "dst")), [F.col("src"), F.col("dst")])
    counts = edges.groupBy("src").agg(F.count("*").alias("value"))
    degrees = spark.range(n).join(counts, F.col("id") == F.col("src"), "left").select(F.col("id").alias("pos"), F.coalesce("value", F.lit(0)).alias("value"))
    starts = exclusive_scan(degrees).select(F.lit(1).alias("kind"), F.col("pos").alias("at"), F.col("scan").cast("string").alias("value"))
    body = places.select(F.lit(2).alias("kind"), F.col("pos").alias("at"), F.col("dst").cast("string").alias("value"))
    top = spark.createDataFrame([(0, 0, "AdjacencyGraph"), (0, 1, str(n)), (0, 2, str(edges.count()))], "kind int, at long, value string")
    written(top.unionByName(starts).unionByName(body), path)


def written(words: DataFrame, path: str) -> None:
    words.repartitionByRange("kind", "at").sortWithinPartitions("kind", "at").select("value").write.text(path)


def write_differences(edges: DataFrame, n: int, path: str) -> None:
    """The inverse of read_differences, one word a line, in files that sort in order."""
    spark = edges.sparkSession
    plain = edges.select("src", "dst")
    counts = plain.groupBy("src").agg(F.count("*").alias("d"))
    degrees = spark.range(n).join(counts, F.col("id") == F.col("src"), "left").select(F.lit(1).alias("kind"), F.col("id").alias("at"), F.coalesce("d", F.lit(0)).cast("string").alias("value"))
    previous = F.lag("dst").over(Window.partitionBy("src").orderBy("dst"))
    steps = plain.withColumn("step", F.col("dst") - F.coalesce(previous, F.lit(0)))
    places = sort_values(steps.withColumn("pos", F.xxhash64("src", "dst")), [F.col("src"), F.col("dst")])
    body = places.select(F.lit(2).alias("kind"), F.col("pos").alias("at"), F.col("step").cast("string").alias("value"))
    top = spark.createDataFrame([(0, 0, str(n)), (0, 1, str(plain.count()))], "kind int, at long, value string")
    written(top.unionByName(degrees).unionByName(body), path)


def write_symmetric(edges: DataFrame, n: int, path: str) -> None:
    """write_differences of the edges from smaller to larger vertices."""
    write_differences(edges.where("dst > src"), n, path)
