"""The lines of text files with their numbers, whatever a file's length: read in byte ranges, by as many tasks as there are.

A range's rows come in the order of the file, and Spark tells where the range begins. So one pass counts the lines of each range, sums over the ranges before
it give the number of its first line, and the second pass numbers its lines from there. Lines aren't shuffled, sorted or collected: what is joined to them is
one row for each range.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

NUMBERED = "path string, pos long, line string"


def numbered(spark: SparkSession, path: str, blank: bool = False) -> DataFrame:
    """path, pos, line of a file, or of each of a folder's files: lines end at a line feed, one carriage return before it goes too.

    Lines are numbered from 0 in each file; without ``blank``, those of nothing but white space are neither kept nor counted. A file of no lines gives none.
    """
    rows = spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("range"), F.regexp_replace("value", r"\r\z", "").alias("line"))
    if not blank:
        rows = rows.filter(F.rlike("line", F.lit(r"\S")))
    # within a range the place is one more for each row, as a task reads a range as a whole and in order
    rows = rows.withColumn("place", F.monotonically_increasing_id())
    ranges = rows.groupBy("path", "range").agg(F.min("place").alias("first"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("path").orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = ranges.select("path", "range", (before - F.col("first")).alias("shift"))
    return rows.join(starts, ["path", "range"]).select("path", (F.col("place") + F.col("shift")).alias("pos"), "line")
