"""Merging additions into the tracker: all or nothing, first in wins, numbers in order."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import DASH
from ..sources.markdown import COLUMNS
from . import reports, tracker
from .identity import first_wins
from .states import Catalog


@dataclass(frozen=True)
class Merge:
    """``errors``: name, place, message. ``known``: the tracker's rows, canonical. ``accepted`` and ``skipped`` (with duplicate_of): additions."""

    errors: DataFrame
    known: DataFrame
    accepted: DataFrame
    skipped: DataFrame

    @property
    def rows(self) -> DataFrame:
        """The tracker afterwards."""
        return joined(self.known, self.accepted)


def errors_of(additions: DataFrame, catalog: Catalog) -> DataFrame:
    """name, place, message of every structural error and every rule that an addition breaks."""
    none = F.array().cast("array<string>")
    said = F.concat("errors", F.when(F.col("bound"), tracker.validate(catalog)).otherwise(none))
    return additions.select("name", F.posexplode(said).alias("place", "message"))


def merged(rows: DataFrame, additions: DataFrame, catalog: Catalog) -> Merge:
    """``rows``: well-formed tracker rows. ``additions``: name, path, the columns, errors, bound. Files count in the order of their names.

    An addition whose identity the tracker or an earlier addition has is skipped, and names that row's number (of several rows of
    one identity the last, which is the one that later rows would be told of). The new tracker is ordered by number.
    """
    found = errors_of(additions, catalog)
    known = tracker.canonical(rows, catalog).withColumn("key", tracker.identity_key())
    new = tracker.canonical(additions.filter("bound").filter(F.size("errors") == 0), catalog).withColumn("key", tracker.identity_key())
    of = known.groupBy(F.col("key").alias("_key")).agg(F.max_by("num", "pos").alias("_known"))
    seen = first_wins(new, "key", "name", "num", "_earlier").join(of, F.col("key") == F.col("_key"), "left")
    seen = seen.withColumn("duplicate_of", F.coalesce("_known", "_earlier")).drop("_key", "_known", "_earlier")
    accepted = seen.filter("duplicate_of is null").drop("duplicate_of")
    return Merge(found, known, accepted, seen.filter("duplicate_of is not null"))


def joined(known: DataFrame, accepted: DataFrame) -> DataFrame:
    """Rows and accepted additions in the order of their numbers as numbers; equal ones by their place, additions last by their names."""
    a = known.select(*COLUMNS, F.lit(0).alias("_part"), F.col("pos").cast("long").alias("_at"), F.lit("").alias("_name"))
    b = accepted.select(*COLUMNS, F.lit(1).alias("_part"), F.lit(0).cast("long").alias("_at"), F.col("name").alias("_name"))
    both = a.unionByName(b).withColumn("_n", F.col("num").try_cast("decimal(38,0)"))
    place = F.struct("_n", "_part", "_at", "_name")
    return both.withColumns({"pos": place, "malformed": F.lit(False), "raw": F.lit(None).cast("string")}).drop("_n", "_part", "_at", "_name")


def backfilled(rows: DataFrame, documents: DataFrame, root: str) -> DataFrame:
    """Rows without a URL take it from their report, under the root or else in its reports folder. ``documents``: path, text."""
    target = F.when(F.col("url") == DASH, F.nullif(F.nullif(F.regexp_replace("report", r"^\[[^\]]*\]\((.+)\)\z", "$1"), F.lit(DASH)), F.lit("")))
    found = documents.select("path", reports.source_url(F.col("text")).alias("_url")).filter("_url is not null")

    def side(df: DataFrame, path: Column, name: str) -> DataFrame:
        other = found.select(F.col("path").alias(f"_p{name}"), F.col("_url").alias(f"_u{name}"))
        return df.withColumn(f"_t{name}", path).join(other, F.col(f"_t{name}") == F.col(f"_p{name}"), "left")

    out = side(rows, tracker.resolved_path(target, root), "a")
    out = side(out, tracker.resolved_path(F.concat(F.lit("reports/"), F.substring_index(target, "/", -1)), root), "b")
    return out.withColumn("url", F.coalesce("_ua", "_ub", "url")).drop("_ta", "_pa", "_ua", "_tb", "_pb", "_ub")
