"""What a log says of states and reservations, entry by entry, as batch tables; ``streaming.stateful`` says the same of streams.

A log's well-formed entries are facts: the last one of a number is its state, whatever is wrong with it. ``problem`` tells what is:
an entry that doesn't begin where the one before it ended, or that leaves a terminal state for another one. Entries that are
not well-formed move nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .states import Catalog
from .tracker import DIGITS, LOG_SOURCES

#: The columns of a checked entry, and of what happened to a reservation.
CHECKED = "num string, pos long, prev string, new string, status string, problem string"
HAPPENED = "label string, event string, at timestamp"
DAYS = 7
#: How far events may lie behind the latest one.
LATE = "1 second"


def parsed(log: DataFrame, catalog: Catalog) -> DataFrame:
    """num, pos, prev, new, moves (the state that the entry moves to, null if it isn't well-formed), begins (where it begins; null if nowhere known), malformed.

    ``log``: timestamp, prev, new, source, num (strings) and pos, the entry's place.
    """
    trim = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"^\s+|\s+$", "")
    new, prev = catalog.state(F.col("new")), F.when(F.col("prev") == "-", "-").otherwise(catalog.state(F.col("prev")))
    said = lambda name: F.concat(F.lit(f'{name} "'), F.coalesce(name, F.lit("")), F.lit('" is none'))
    malformed = (
        F.when(~F.rlike(F.coalesce("num", F.lit("")), F.lit(DIGITS)), said("num"))
        .when(F.try_to_timestamp(trim(F.col("timestamp"))).isNull(), said("timestamp"))
        .when(new.isNull(), said("new"))
        .when(~F.coalesce(F.col("source"), F.lit("")).isin(*LOG_SOURCES), said("source"))
    )
    rows = log.select("num", F.col("pos").cast("long").alias("pos"), "prev", "new", F.when(malformed.isNull(), new).alias("moves"), prev.alias("begins"), malformed.alias("malformed"))
    return rows


def broken(status: Column, begins: Column, moves: Column, catalog: Catalog) -> Column:
    """What is wrong with a well-formed entry that follows ``status`` (null: the number's first)."""
    terminal = [s.name for s in catalog.states if s.terminal]
    expected = F.coalesce(status, F.lit("-"))
    return (
        F.when(~F.coalesce(begins == expected, F.lit(False)), F.concat(F.lit("begins at "), F.coalesce(begins, F.lit("no state")), F.lit(" instead of "), expected))
        .when(status.isin(*terminal) & (moves != status), F.concat(F.lit("leaves "), status))
    )


def checked(log: DataFrame, catalog: Catalog) -> DataFrame:
    """CHECKED: every entry with the state after it. A number's entries follow each other by ``pos``."""
    order = W.partitionBy("num").orderBy("pos")
    before = F.last("moves", ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, -1))
    rows = parsed(log, catalog).withColumn("_before", before)
    problem = F.when(F.col("moves").isNull(), F.col("malformed")).otherwise(broken(F.col("_before"), F.col("begins"), F.col("moves"), catalog))
    return rows.select("num", "pos", "prev", "new", F.coalesce("moves", "_before").alias("status"), problem.alias("problem"))


def happened(events: DataFrame, days: int = DAYS, late: str = LATE) -> DataFrame:
    """HAPPENED: what became of reservations. ``events``: label, kind (reserve or release), at, pos; ordered by (at, pos).

    A reservation lasts ``days`` days or until it is released. ``reserved``, ``released`` and ``expired`` tell so; ``refused`` is a release of a label that
    isn't reserved (any more), or a reservation of one that still is. What ends later than ``late`` before the latest event of all hasn't yet.
    A label's events meet in one row: so many as one label is reserved and released.
    """
    lasts = F.expr(f"INTERVAL {days} DAYS")
    rows = events.filter("label is not null and at is not null").select("label", "kind", "at", "pos")
    # a reservation holds from the first reserve after the label was free; runs of one label are folded in order
    ordered = F.array_sort(F.collect_list(F.struct("at", "pos", "kind")))
    each = rows.groupBy("label").agg(ordered.alias("all"))
    empty = F.struct(F.lit(None).cast("timestamp").alias("held"), F.array().cast("array<struct<event:string,at:timestamp>>").alias("out"))

    def step(state: Column, e: Column) -> Column:
        over = state["held"].isNotNull() & (e["at"] >= state["held"] + lasts)
        told = F.when(over, F.concat(state["out"], F.array(F.struct(F.lit("expired").alias("event"), (state["held"] + lasts).alias("at"))))).otherwise(state["out"])
        held = F.when(~over, state["held"])
        event = F.when(e["kind"] == "reserve", F.when(held.isNull(), "reserved").otherwise("refused")).otherwise(F.when(held.isNotNull(), "released").otherwise("refused"))
        now = F.when(e["kind"] == "reserve", F.coalesce(held, e["at"])).otherwise(F.lit(None).cast("timestamp"))
        return F.struct(now.alias("held"), F.concat(told, F.array(F.struct(event.alias("event"), e["at"].alias("at")))).alias("out"))

    folded = each.select("label", F.aggregate("all", empty, step).alias("x"))
    last = rows.agg(F.max("at").alias("_last"))
    folded = folded.crossJoin(F.broadcast(last))  # one row
    end = F.when(F.col("x.held") + lasts <= F.col("_last") - F.expr(f"INTERVAL {late}"), F.array(F.struct(F.lit("expired").alias("event"), (F.col("x.held") + lasts).alias("at")))).otherwise(F.array().cast("array<struct<event:string,at:timestamp>>"))
    return folded.select("label", F.explode(F.concat("x.out", end)).alias("y")).select("label", "y.event", "y.at")
