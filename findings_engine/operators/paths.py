"""Paths and files as tables: which files are still their templates, and which paths lie inside others.

A path is cut into components at slashes; empty ones and single dots don't count, so ``a//b/`` is ``a/b``. A null path lies nowhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def components(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda x: (x != "") & (x != "."))


def plain(path: Column) -> Column:
    return F.array_join(components(path), "/")


def ancestors(path: Column) -> Column:
    """The path itself and every path that it lies in, shortest first."""
    parts = components(path)
    return F.when(F.size(parts) > 0, F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts), F.lit(1))), lambda n: F.array_join(F.slice(parts, 1, n), "/")))


def overlapping(left: DataFrame, a: str, right: DataFrame, b: str) -> DataFrame:
    """(a, b, inside): pairs of paths of which one lies in the other, or both are the same; ``inside`` is left, right or same.

    Each path meets the other side's paths by an equi-join on what it lies in, so a pair of sides of n and m paths costs n and m times their depth.
    """
    one, two = (df.select(F.col(c).alias("_path"), plain(F.col(c)).alias("_plain")).filter("_plain <> ''").distinct() for df, c in ((left, a), (right, b)))
    up = lambda df: df.select(F.col("_path").alias("_deep"), F.col("_plain").alias("_own"), F.explode(ancestors(F.col("_plain"))).alias("_plain"))
    same = F.col("_own") == F.col("_plain")
    inner = up(one).join(two, "_plain").select(F.col("_deep").alias("a"), F.col("_path").alias("b"), F.when(same, "same").otherwise("left").alias("inside"))
    outer = up(two).join(one, "_plain").filter(~same).select(F.col("_path").alias("a"), F.col("_deep").alias("b"), F.lit("right").alias("inside"))
    return inner.unionByName(outer)


def unchanged(files: DataFrame, templates: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """Files (``path``, ``content``) that hold what the template for their path holds: found by path and digest, checked by content."""
    digest = lambda c: F.sha2(F.coalesce(F.col(c).cast("binary"), F.lit("").cast("binary")), 256)
    known = templates.select(F.col(path).alias("_path"), F.col(content).alias("_content"), digest(content).alias("_digest"))
    rows = files.withColumn("_own", digest(content))
    return rows.join(known, (rows[path] == known["_path"]) & (rows["_own"] == known["_digest"]) & rows[content].eqNullSafe(known["_content"]), "left_semi").drop("_own")
