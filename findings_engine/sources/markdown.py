"""Markdown pipe tables as a DataFrame: whole files in, one row for each table row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import escape_cell, trimmed

# The columns of the findings table and their order.
LABELS = ("#", "date", "title", "source", "company", "location", "url", "risk", "confidence", "status", "report", "notes")
COLUMNS = ("num", "date", "title", "source", "company", "location", "url", "risk", "confidence", "status", "report", "notes")


def cells(line: Column) -> Column:
    """The cells of a line: one outer pipe off at each side, cut at pipes that no backslash escapes."""
    inner = F.regexp_replace(trimmed(line), r"^\||\|\z", "")
    return F.transform(F.split(inner, r"(?<!\\)\|", -1), lambda x: trimmed(F.replace(x, F.lit("\\|"), F.lit("|"))))


def separator(line: Column) -> Column:
    return F.rlike(line, F.lit(r"^[\s:|\-]*-[\s:|\-]*\z"))


def parse(texts: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """path, pos, the table's columns (null where the header lacks one), raw, n_cells, malformed. Files are split where they are read.

    A header's labels are those that the table is written with (``#`` for num), in any case.
    """
    lines = F.split(F.col(text), r"\r?\n", -1)
    table = F.filter(F.transform(lines, lambda x, i: F.struct(i.alias("pos"), x.alias("raw"))), lambda x: F.startswith(F.ltrim(x["raw"]), F.lit("|")))
    header = F.transform(cells(F.col("t")[0]["raw"]), F.lower)
    rest = F.slice("t", 2, F.greatest(F.size("t") - 1, F.lit(0)))
    first = F.array_min(F.transform(F.filter(F.transform("rest", lambda x, i: F.struct(i.alias("i"), separator(x["raw"]).alias("s"))), lambda x: x["s"]), lambda x: x["i"]))
    rows = texts.select(path, table.alias("t")).filter(F.size("t") > 0)
    rows = rows.select(path, header.alias("header"), rest.alias("rest")).withColumn("line", first)
    rows = rows.select(path, "header", F.explode(F.filter("rest", lambda x, i: F.col("line").isNull() | (i != F.col("line")))).alias("row"))
    rows = rows.select(path, "header", F.col("row.pos").alias("pos"), F.col("row.raw").alias("raw"), cells(F.col("row.raw")).alias("cells"))
    known = F.array(*map(F.lit, LABELS))
    malformed = (F.size("cells") != F.size("header")) | (F.size(F.array_except("header", known)) > 0)
    value = lambda c, label: F.when(~malformed, F.try_element_at("cells", F.nullif(F.array_position("header", label), F.lit(0)).cast("int"))).alias(c)
    return rows.select(path, "pos", *map(value, COLUMNS, LABELS), "raw", F.size("cells").alias("n_cells"), malformed.alias("malformed"))


def read(spark: SparkSession, path: str) -> DataFrame:
    return parse(spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text")))


def rendered(columns: tuple[str, ...] = COLUMNS) -> Column:
    """A row as a line of the table."""
    return F.concat(F.lit("| "), F.concat_ws(" | ", *(F.coalesce(escape_cell(F.col(c)), F.lit("")) for c in columns)), F.lit(" |"))
