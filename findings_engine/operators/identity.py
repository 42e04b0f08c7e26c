"""First-wins identity, merging, numbering."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructField, StructType


def first_wins(df: DataFrame, key: list[str] | str, order: list[str] | str, label: str, duplicate_of: str = "duplicate_of") -> DataFrame:
    """All rows with the label of the first of their key, null for that row itself. Null is a key like any other.

    The firsts come from an aggregation (summed up before its shuffle) and a join back on a 64-bit digest and the key,
    which a hot key can't pile up in one task the way a window would: AQE splits it.
    """
    key, order = [key] if isinstance(key, str) else key, [order] if isinstance(order, str) else order
    place = F.struct(F.struct(*(F.col(c) for c in order)).alias("at"), F.col(label).alias("label"))
    digest = F.xxhash64(*(F.col(k) for k in key), *(F.col(k).isNull() for k in key))
    keyed = df.withColumns({"_digest": digest, "_own": place})
    names = [f"_key{n}" for n in range(len(key))]
    firsts = keyed.groupBy("_digest", *(F.col(k).alias(n) for k, n in zip(key, names, strict=True))).agg(F.min("_own").alias("_first"))
    firsts = firsts.withColumnRenamed("_digest", "_of")
    same = F.col("_digest") == F.col("_of")
    for k, n in zip(key, names, strict=True):
        same &= F.col(k).eqNullSafe(F.col(n))
    joined = keyed.join(firsts, same)
    return joined.withColumn(duplicate_of, F.when(F.col("_first") < F.col("_own"), F.col("_first.label"))).drop("_own", "_first", "_of", "_digest", *names)


def merged(findings: DataFrame, additions: DataFrame, key: str, label: str) -> DataFrame:
    """The additions with ``duplicate_of``: the first finding of their key; null for those to accept."""
    known = findings.groupBy(key).agg(F.min(label).alias("duplicate_of"))
    return additions.join(known, key, "left")


def next_number(*numbers: DataFrame) -> DataFrame:
    """One row: the number after the largest used (1 if none) and how many distinct numbers are used."""
    used = numbers[0]
    for n in numbers[1:]:
        used = used.union(n)
    n = F.col(used.columns[0])
    return used.agg((F.coalesce(F.max(n), F.lit(0)) + 1).cast("long").alias("next_num"), F.count_distinct(n).cast("long").alias("used"))


#: Ranges of an order, and rows sampled for each of them.
RANGES, SAMPLED = 256, 50


def numbered(df: DataFrame, order: list[str], start: int | Column, name: str = "num", ranges: int = RANGES) -> DataFrame:
    """Numbers in order from ``start``, by the counts of ranges of the whole order and places within each; no task sees all rows.

    The order may be of any columns that can be compared, nulls first. Its ranges lie between keys of a sample of some ``ranges`` * SAMPLED rows, which the driver
    holds. Rows equal in ``order`` follow each other by a hash of their other cells, so that many of them are several ranges too.
    """
    spark = df.sparkSession
    rest = sorted(c for c, kind in df.dtypes if c not in order and "map<" not in kind and "variant" not in kind)
    rows = df.withColumn("_key", F.struct(*order, F.xxhash64(*order, *rest).alias("_tie")))
    # the keys with the least hashes are as good as drawn, and take one pass
    some = rows.select("_key").orderBy(F.xxhash64("_key", F.lit(7))).limit(ranges * SAMPLED).orderBy("_key").collect()
    cuts = [some[len(some) * k // ranges]["_key"] for k in range(1, ranges)] if len(some) > ranges else [r["_key"] for r in some]
    key = rows.schema["_key"].dataType
    bounds = spark.createDataFrame([(cuts,)], StructType([StructField("_cuts", ArrayType(key))]))
    part = F.size(F.filter("_cuts", lambda c: F.col("_key") > c))
    rows = rows.crossJoin(F.broadcast(bounds)).withColumn("_part", part).drop("_cuts")  # one row
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = rows.groupBy("_part").count().withColumn("_before", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")  # a row for each range
    nth = F.row_number().over(W.partitionBy("_part").orderBy("_key"))
    return rows.withColumn("_nth", nth).join(F.broadcast(offsets), "_part").withColumn(name, (F.col("_nth") + F.col("_before") + start - 1).cast("long")).drop("_part", "_nth", "_before", "_key")


def missing_filled(df: DataFrame, column: str, *lookups: tuple[DataFrame, str, str]) -> DataFrame:
    """``column`` with nulls filled from the first lookup that has a value; a lookup is (table, key, value) with unique keys."""
    out = df
    for n, (table, key, value) in enumerate(lookups):
        found = table.select(F.col(key).alias(f"_k{n}"), F.col(value).alias(f"_v{n}"))
        out = out.join(found, F.col(key) == F.col(f"_k{n}"), "left")
    values = [F.col(f"_v{n}") for n in range(len(lookups))]
    return out.withColumn(column, F.coalesce(F.col(column), *values)).drop(*(f"_{x}{n}" for n in range(len(lookups)) for x in "kv"))


def groups_of_several(df: DataFrame, key: list[str], member: Column, name: str = "members") -> DataFrame:
    """The key, ``n`` and the sorted members of each group of two and more; groups of one are never collected."""
    several = df.groupBy(*key).agg(F.count("*").alias("n")).filter("n > 1")
    rows = df.select(*key, member.alias("_member")).join(several, key)
    return rows.groupBy(*key).agg(F.first("n").alias("n"), F.sort_array(F.collect_list("_member")).alias(name))


def synced(table: DataFrame, latest: DataFrame, key: str, own: str, logged: str) -> DataFrame:
    """(key, own, logged, state): match, mismatch, table_only or log_only, from a full join of both on the key."""
    a, b = table.select(F.col(key).alias("_a"), F.col(own).alias("own")), latest.select(F.col(key).alias("_b"), F.col(logged).alias("logged"))
    state = F.when(F.col("_a").isNull(), "log_only").when(F.col("_b").isNull(), "table_only").when(F.col("own").eqNullSafe(F.col("logged")), "match").otherwise("mismatch")
    return a.join(b, F.col("_a") == F.col("_b"), "full_outer").select(F.coalesce("_a", "_b").alias(key), "own", "logged", state.alias("state"))


# -- reserved numbers -----------------------------------------------------------------------------------
def reservation_label(start: int, end: int) -> str:
    pad = lambda n: str(n).zfill(3)
    return pad(start) if start == end else f"{pad(start)}-{pad(end)}"


def label_range(label: str) -> tuple[int, int] | None:
    """The bounds that ``7`` or ``7-9`` names; None if it names none."""
    found = re.fullmatch(r"([0-9]+)(?:-([0-9]+))?", (label or "").strip())
    return (int(found[1]), int(found[2] or found[1])) if found else None


def reserved(reservations: DataFrame, used: DataFrame, count: int, stamp: str) -> tuple[DataFrame, tuple[int, int]]:
    """The reservations with ``count`` further numbers behind all used and reserved ones, and their bounds."""
    if not 1 <= count <= 1000:
        raise ValueError("between 1 and 1000 numbers are reserved at once")
    spark = reservations.sparkSession
    taken = used.select(F.col(used.columns[0]).alias("n")).union(reservations.select(F.col("end").alias("n")))
    start = taken.agg(F.coalesce(F.max("n"), F.lit(0)) + 1).first()[0]
    new = spark.createDataFrame([(start, start + count - 1, stamp)], "start long, end long, timestamp string")
    return reservations.select("start", "end", "timestamp").unionByName(new), (start, start + count - 1)


def released(reservations: DataFrame, label: str) -> DataFrame:
    """The reservations without the first one (in the file's order) that has exactly the label's bounds."""
    bounds = label_range(label)
    if not bounds:
        raise ValueError(f"no label of a reservation: {label!r}")
    fits = (F.col("start") == bounds[0]) & (F.col("end") == bounds[1])
    first = reservations.filter(fits).agg(F.min("pos")).first()[0]
    if first is None:
        raise LookupError(f"no reservation is {label}")
    return reservations.filter(F.col("pos") != first)


def stale(reservations: DataFrame, now: Column, days: int = 7) -> Column:
    """Whether a reservation is older than so many days; a blank time is, one that is no time isn't."""
    stamp = F.coalesce(F.col("timestamp"), F.lit(""))
    return F.when(stamp == "", True).otherwise(F.coalesce(F.try_to_timestamp(stamp) < now - F.expr(f"INTERVAL {days} DAYS"), F.lit(False)))
