"""Additions: TSV files of one header line and one row, bound by each file's own header."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import messages, trimmed

# The labels of an addition.
REQUIRED = ("num", "date", "title", "source", "url", "risk", "confidence", "status", "report")
OPTIONAL = ("company", "location", "notes")


def parse(texts: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """path, the labels' cells (null if they can't be told apart), errors (array), bound (whether they could)."""
    lines = F.filter(F.split(F.col(text), r"\r?\n", -1), lambda x: trimmed(x) != "")
    rows = texts.select(path, lines.alias("lines"))
    split = lambda k: F.transform(F.split(F.try_element_at("lines", F.lit(k)), "\t", -1), trimmed)
    rows = rows.withColumns({"labels": F.transform(split(1), F.lower), "cells": split(2)})
    labels, none = F.coalesce("labels", F.array().cast("array<string>")), F.array().cast("array<string>")
    two = F.size("lines") == 2
    repeated = F.transform(F.filter(labels, lambda x, i: F.array_position(labels, x) != i + 1), lambda x: F.concat(F.lit("repeated label "), x))
    unknown = F.transform(F.filter(labels, lambda x: ~x.isin(*REQUIRED, *OPTIONAL)), lambda x: F.concat(F.lit("unknown label "), x))
    missing = F.transform(F.array_except(F.array(*map(F.lit, REQUIRED)), labels), lambda x: F.concat(F.lit("missing label "), x))
    uneven = messages((F.size(labels) != F.size(F.coalesce("cells", none)), F.lit("there are not as many cells as labels")))
    count = F.when(F.size("lines") == 0, F.lit("the file is empty")).otherwise(F.concat(F.lit("a header line and one row are wanted, there are "), F.size("lines").cast("string"), F.lit(" lines")))
    rows = rows.withColumn("errors", F.when(~two, F.array(count)).otherwise(F.concat(repeated, unknown, missing, uneven)))
    bound = two & (F.size(labels) == F.size(F.coalesce("cells", none)))
    # of a repeated label the last cell counts
    last = lambda c: F.size(labels) - F.nullif(F.array_position(F.reverse(labels), c), F.lit(0)).cast("int") + 1
    value = lambda c: F.when(bound, F.try_element_at("cells", last(c))).alias(c)
    return rows.select(path, *map(value, REQUIRED + OPTIONAL), "errors", bound.alias("bound"))


def read(spark: SparkSession, folder: str) -> DataFrame:
    texts = spark.read.option("pathGlobFilter", "*.tsv").text(folder, wholetext=True)
    return parse(texts.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text")))
