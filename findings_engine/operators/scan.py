"""The scan of fetched postings: validity, duplicates, filters, in this order of precedence; counts, numbers, and the rows to append.

Postings carry their entry's terms and place in the order of fetching (``entry_pos``, ``pos``). A posting's key is the
identity of its URL. Everything is one aggregation by key and joins on a 64-bit digest of it, whatever a key's weight.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import url as urls
from ..functions.text import DASH, clean_cell, padded
from .identity import numbered

#: Counted statuses; ``postings`` counts all that were fetched.
STATUSES = ("added", "duplicate", "skipped_title", "skipped_location", "no_provider", "invalid_posting", "error")
# The columns of the tables that a scan appends to.
HISTORY = ("date", "url", "title", "status", "source")
RUNS = ("timestamp", "source", "entries", "postings", "added", "skipped")
ADDITION = ("num", "date", "title", "source", "url", "risk", "confidence", "status", "report", "company", "location", "notes")


def contains_any(c: Column, terms: Column | tuple[str, ...]) -> Column:
    """Whether a cell holds one of the terms, in any case; an empty term is held by every cell."""
    if isinstance(terms, tuple):
        terms = F.array(*map(F.lit, terms)).cast("array<string>")
    cell = F.lower(clean_cell(F.coalesce(c, F.lit(""))))
    return F.coalesce(F.exists(terms, lambda t: F.contains(cell, F.lower(t))), F.lit(False))


def statuses(postings: DataFrame, history: DataFrame, key: str, order: list[str], title: Column, location: Column, title_terms, location_terms, valid: Column) -> DataFrame:
    """``status`` of each posting. A key counts as seen from its first valid posting on, whatever the filters say to that.

    Of postings that are equal in ``order`` the first by their other cells is first, so that a retry decides alike.
    """
    plain = sorted(c for c, kind in postings.dtypes if c not in order and "map<" not in kind and "variant" not in kind)
    place = F.struct(*(F.col(c) for c in order), F.xxhash64(*(F.col(c) for c in plain)))
    ok = F.coalesce(valid, F.lit(False))
    seen = history.select(F.col(key).alias("_key")).filter("_key is not null").distinct().withColumn("_seen", F.lit(True))
    rows = postings.withColumns({"_key": F.when(ok, F.col(key)), "_place": place})
    first = rows.filter("_key is not null").groupBy("_key").agg(F.min("_place").alias("_first"))
    rows = rows.join(first.join(seen, "_key", "left"), "_key", "left")
    status = (
        F.when(~ok, "invalid_posting")
        .when(F.col("_seen").isNotNull() | (F.col("_first") < F.col("_place")), "duplicate")
        .when(contains_any(title, title_terms), "skipped_title")
        .when(contains_any(location, location_terms), "skipped_location")
        .otherwise("added")
    )
    return rows.withColumn("status", status).drop("_key", "_place", "_first", "_seen")


def scanned(postings: DataFrame, history: DataFrame) -> DataFrame:
    """Postings (entry_pos, pos, entry, source, title_terms, location_terms and a posting's fields) with ``url_norm`` and ``status``.

    ``history``: url. Its URLs are normalised again, as stored ones may come from elsewhere.
    """
    clean = {c: clean_cell(F.coalesce(F.col(c), F.lit(""))) for c in ("title", "url", "company", "location", "source")}
    rows = urls.with_normalized(postings.withColumns(clean), "url", "url_norm")
    known = urls.with_normalized(history.select("url"), "url", "url_norm").select("url_norm")
    valid = (F.col("title") != "") & (F.col("url") != "")
    return statuses(rows, known, "url_norm", ["entry_pos", "pos"], F.col("title"), F.col("location"), F.col("title_terms"), F.col("location_terms"), valid)


def capped(rows: DataFrame, order: list[str] | str, cap: int) -> DataFrame:
    """Rows up to the one that is the ``cap``-th added; later ones are as if never fetched. A cap of 0 is none."""
    if cap <= 0:
        return rows
    place = F.struct(*(F.col(c) for c in ([order] if isinstance(order, str) else order)))
    last = rows.filter(F.col("status") == "added").select(place.alias("_place")).orderBy("_place").limit(cap).agg(F.max("_place").alias("_last"), F.count("*").alias("_n"))
    return rows.withColumn("_place", place).crossJoin(F.broadcast(last)).filter((F.col("_n") < cap) | (F.col("_place") <= F.col("_last"))).drop("_last", "_n", "_place")  # one row


def reached(rows: DataFrame, cap: int) -> int | None:
    """The entry of the ``cap``-th added posting, the last that a scan with this cap looks at; None if there are fewer, or no cap."""
    if cap <= 0:
        return None
    n, last = rows.filter(F.col("status") == "added").agg(F.count("*"), F.max("entry_pos")).first()
    return last if n >= cap else None


def counts(rows: DataFrame, failed: DataFrame | None = None) -> DataFrame:
    """One row: postings, and every status, zeros included. ``failed``: status of entries that gave no postings at all."""
    one = rows.select("status", F.lit(1).alias("posting"))
    if failed is not None:
        one = one.unionByName(failed.select("status", F.lit(0).alias("posting")))
    total = F.coalesce(F.sum("posting"), F.lit(0)).cast("long").alias("postings")
    return one.agg(total, *(F.count_if(F.col("status") == s).cast("long").alias(s) for s in STATUSES))


def skipped(row: dict) -> int:
    return row["duplicate"] + row["skipped_title"] + row["skipped_location"]


def additions(rows: DataFrame, first: Column | int, date: str) -> DataFrame:
    """The added postings as additions, numbered from ``first`` in the order of fetching, with the name of each one's file."""
    new = numbered(rows.filter(F.col("status") == "added").drop("status"), ["entry_pos", "pos"], first)
    cells = {"date": F.lit(date), "url": F.col("url_norm"), "risk": F.lit(DASH), "confidence": F.lit(DASH), "status": F.lit("Queued"), "report": F.lit(DASH), "notes": F.lit("")}
    named = new.withColumns({**cells, "label": padded(F.col("num")), "num": F.col("num").cast("string")})
    return named.select("entry_pos", "pos", "label", *ADDITION)


def history_rows(rows: DataFrame, date: str) -> DataFrame:
    """What a scan adds to the history: added postings by their source first, then duplicates and skipped ones by their entry."""
    kept = rows.filter(F.col("status").isin("added", "duplicate", "skipped_title", "skipped_location"))
    added = F.col("status") == "added"
    return kept.select(F.when(added, 0).otherwise(1).alias("part"), "entry_pos", "pos", F.lit(date).alias("date"), F.col("url_norm").alias("url"), "title", "status", F.when(added, F.col("source")).otherwise(F.col("entry")).alias("source"))
