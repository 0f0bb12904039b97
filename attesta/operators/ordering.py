"""Places, line numbers and digests of ordered rows, without bringing them together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from attesta.sources.workspace import kept

#: Lines of a leaf and digests of a node.
FAN = 1024


def _before(counts: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """``counts`` (keys, order, n) with ``before``, the sum of n in front.  One row a part of the input, so few."""
    window = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("before", F.coalesce(F.sum("n").over(window), F.lit(0)))


def placed(rows: DataFrame, order: list[str], name: str = "place") -> DataFrame:
    """``rows`` with their place from 0 in the order of columns: ranges are sorted apart, and counts of earlier ranges added.

    Rows: nulls come first; rows of one order keep a place each, in any order, so
    ``order`` should tell rows apart; an empty table stays empty.
    """
    parts = kept(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranges")
    earlier = _before(parts.groupBy("_part").agg(F.count("*").alias("n")), [], ["_part"]).select("_part", "before")
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return parts.withColumn("_in", inside).join(earlier, "_part").withColumn(name, F.col("before") + F.col("_in")).drop("_part", "_in", "before")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, value): the lines of text files, numbered from 1 in each file, however many parts a file is read in.

    A part's lines are in order, so the counts of a file's earlier parts give the
    rest; lines themselves aren't shuffled, and files are read twice.  Rows: an empty
    file has no lines; a line is split at newlines only.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_at"), F.monotonically_increasing_id().alias("_id"), "value")
    parts = _before(lines.groupBy("file", "_at").agg(F.min("_id").alias("_first"), F.count("*").alias("n")), ["file"], ["_at"])
    parts = kept(parts.select(F.col("file").alias("_f"), F.col("_at").alias("_a"), "_first", "before"), "parts")
    number = F.col("_id") - F.col("_first") + F.col("before") + 1
    # every line has its part; a left join keeps lines where they are read
    return lines.join(parts, (F.col("file") == F.col("_f")) & (F.col("_at") == F.col("_a")), "left").select("file", number.alias("line"), "value")


def placed_lines(spark: SparkSession, path: str) -> DataFrame:
    """(place, value): the lines of a folder's files from 0, files in order of their names."""
    lines = numbered_lines(spark, path)
    files = _before(lines.groupBy("file").agg(F.count("*").alias("n")), [], ["file"]).select("file", "before")
    return lines.join(files, "file").select((F.col("before") + F.col("line") - 1).alias("place"), "value")


def merkle(rows: DataFrame, place: str, line: Column, keys: list[str] | None = None, levels: int | None = None) -> DataFrame:
    """(keys, lines, digest) of the lines of each key, or of all together, by their places from 0.

    A tree of SHA-256: a leaf is over the hashes of FAN lines whose places follow
    each other, a node over FAN digests, each with its place in front, so a swap or a
    gap changes the root and the number of partitions doesn't.  No task has more than
    FAN hashes of a node.  ``levels`` fixes the tree's height, the root then being over
    whatever is below it: at two levels, a digest for each FAN lines.  Rows: null lines
    count as empty; an empty table has none.
    """
    keys = keys or []
    level = rows.select(*keys, F.col(place).alias("_p"), F.sha2(F.coalesce(line, F.lit("")), 256).alias("_h"), F.lit(1).cast("long").alias("_n"))
    depth, most = 0, None
    while True:
        listed = F.array_sort(F.collect_list(F.struct("_p", "_h")))
        text = F.array_join(F.transform(listed, lambda x: F.concat_ws(":", x["_p"].cast("string"), x["_h"])), "\n")
        root = levels is not None and depth + 1 == levels
        up = level.withColumn("_up", F.lit(0).cast("long") if root else F.expr(f"_p div {FAN}")).groupBy(*keys, "_up").agg(F.sha2(text, 256).alias("_h"), F.sum("_n").alias("_n"))
        level = up.select(*keys, F.col("_up").alias("_p"), "_h", "_n")
        if levels is None and most is None:
            most = rows.agg(F.max(place)).first()[0] or 0
        depth += 1
        if root or levels is None and most // FAN**depth == 0:
            return level.select(*keys, F.col("_n").alias("lines"), F.col("_h").alias("digest"))


def digest_of_files(spark: SparkSession, path: str) -> DataFrame:
    """(file, lines, digest) of each text file, over its lines in order."""
    lines = numbered_lines(spark, path)
    return merkle(lines.withColumn("_place", F.col("line") - 1), "_place", F.col("value"), ["file"])
