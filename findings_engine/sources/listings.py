"""A workspace's files as tables: documents with their places, and the numbers that file names and tables use.

Texts and logs go through Spark's readers, so any store serves. A folder or file that isn't there gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import markdown, tsv
from .numbered import numbered

SKIPPED_FOLDERS = ("node_modules", ".git")


def exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder, if it is there."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def plain_path(uri: Column) -> Column:
    """A file's URI as a path, percent-codes resolved."""
    return F.url_decode(F.replace(F.regexp_replace(uri, "^file:/+", "/"), F.lit("+"), F.lit("%2B")))


def files(spark: SparkSession, folder: str, ending: str = "", deep: bool = False) -> DataFrame:
    """path, name of a folder's files, those below it too if ``deep``; never those of vendored or version-control folders."""
    if not exists(spark, folder):
        return spark.createDataFrame([], "path string, name string")
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", str(deep).lower()).option("pathGlobFilter", f"*{ending}").load(folder).select(plain_path(F.col("path")).alias("path"))
    return _kept(rows.withColumn("name", F.substring_index("path", "/", -1)))


def _kept(rows: DataFrame) -> DataFrame:
    skipped = "|".join(n.replace(".", r"\.") for n in SKIPPED_FOLDERS)
    return rows.filter(~F.rlike("path", F.lit(f"/(?:{skipped})/")))


def texts(spark: SparkSession, folder: str, ending: str, deep: bool = False) -> DataFrame:
    """path, name, text of a folder's files: one row for each, whatever its length."""
    if not exists(spark, folder):
        return spark.createDataFrame([], "path string, name string, text string")
    found = spark.read.option("recursiveFileLookup", str(deep).lower()).option("pathGlobFilter", f"*{ending}").text(folder, wholetext=True)
    rows = found.select(plain_path(F.col("_metadata.file_path")).alias("path"), F.col("_metadata.file_name").alias("name"), F.col("value").alias("text"))
    return _kept(rows)


def reports(spark: SparkSession, folder: str) -> DataFrame:
    return texts(spark, folder, ".md", deep=True)


def additions(spark: SparkSession, folder: str) -> DataFrame:
    """name, path, the columns of an addition, errors and ``bound`` (whether its cells could be told apart), of the folder's own TSV files."""
    found = texts(spark, folder, ".tsv")
    return tsv.parse(found, path="path").withColumn("name", F.substring_index("path", "/", -1))


def findings(spark: SparkSession, path: str) -> DataFrame | None:
    """The tracker's rows; None if the file isn't there."""
    if not exists(spark, path):
        return None
    return markdown.parse(spark.read.text(path, wholetext=True).select(F.lit(path).alias("path"), F.col("value").alias("text")))


def lines(spark: SparkSession, path: str) -> DataFrame | None:
    """pos, line of a file's lines that aren't blank, numbered from 0 (by many tasks, if the file is long); None if the file isn't there."""
    return numbered(spark, path).select("pos", "line") if exists(spark, path) else None


def history(spark: SparkSession, path: str) -> DataFrame:
    """pos, line, date, url, title, status, source of the scan history; lines of fewer than two cells have no url."""
    found = lines(spark, path)
    if found is None:
        return spark.createDataFrame([], "pos long, line string, date string, url string, title string, status string, source string")
    cells = F.split("line", "\t", -1)
    return found.filter("pos > 0").select("pos", "line", *(F.get(cells, F.lit(k)).alias(c) for k, c in enumerate(("date", "url", "title", "status", "source"))))


def reservations(spark: SparkSession, path: str) -> DataFrame:
    """pos, start, end, timestamp of the reserved ranges; lines without both bounds are left out."""
    found = lines(spark, path)
    if found is None:
        return spark.createDataFrame([], "pos long, start long, end long, timestamp string")
    cells = F.split("line", "\t", -1)
    rows = found.filter("pos > 0").select("pos", F.get(cells, F.lit(0)).try_cast("long").alias("start"), F.get(cells, F.lit(1)).try_cast("long").alias("end"), F.coalesce(F.get(cells, F.lit(2)), F.lit("")).alias("timestamp"))
    return rows.filter("start is not null and end is not null")


# -- numbers in use -------------------------------------------------------------------------------------
def row_numbers(rows: DataFrame) -> DataFrame:
    return rows.filter("not malformed").filter(F.rlike("num", F.lit(r"^[0-9]+\z"))).select(F.col("num").try_cast("long").alias("n")).filter("n is not null")


def named_numbers(names: DataFrame, pattern: str) -> DataFrame:
    return names.select(F.nullif(F.regexp_extract("name", pattern, 1), F.lit("")).try_cast("long").alias("n")).filter("n is not null")


def report_numbers(names: DataFrame) -> DataFrame:
    return named_numbers(names, r"^([0-9]+)[-.]")


def addition_numbers(names: DataFrame) -> DataFrame:
    return named_numbers(names, r"^([0-9]+)[^/]*\.tsv\z")


def used_numbers(rows: DataFrame | None, reports: DataFrame, additions: DataFrame | None = None) -> DataFrame:
    """n: the distinct numbers of rows, of top-level reports and of pending additions."""
    parts = [report_numbers(reports)] + ([row_numbers(rows)] if rows is not None else []) + ([addition_numbers(additions)] if additions is not None else [])
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.distinct()
