"""The eighteen integrity checks of a workspace, each a DataFrame of (check_id, level, message, ord), and their rollup.

A check gives one row for each message, in the order of ``ord``; a check without rows is fine. All inputs are tables (see
``Inputs``), so that a workspace's files and tables of any size are checked alike. A missing tracker is None: its checks are fine
and say so.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import identity, reports, tracker
from ..operators.states import Catalog

# The checks and their names.
NAMES = {
    1: "canonical statuses", 2: "duplicate identities", 3: "report links resolve", 4: "risk and confidence format", 5: "row format", 6: "pending additions",
    7: "bold markup in cells", 8: "stale report-number reservations", 9: "duplicate report numbers", 10: "orphan reports", 11: "source consistency",
    12: "duplicate tracker numbers", 13: "status log sync", 14: "status log schema", 15: "portals entries resolve to a provider",
    16: "invisible control bytes in tracker cells", 17: "JD archive coverage", 18: "risk-assessment-layer consistency",
}
NEED_TRACKER = (1, 2, 3, 4, 5, 7, 11, 12, 16)
LOG_HEADER = ("timestamp", "prev", "new", "source", "num", "note")
SCHEMA = "check_id int, level string, message string, ord long"


@dataclass(frozen=True)
class Inputs:
    """What the checks read.

    rows: the tracker's columns, pos, raw, n_cells, malformed; None without a tracker. tracker_dir: its folder.
    reports: path (absolute), name, text. additions: name, the tracker's columns, errors. log: pos (0 for the header), line; None
    without a log. reservations: pos, start, end, timestamp. entries: entry_pos, name, integration; None if the document can't be read.
    captures: name; None without the folder. boards: the names of known boards.
    """

    rows: DataFrame | None
    tracker_dir: str
    reports: DataFrame
    additions: DataFrame
    log: DataFrame | None
    reservations: DataFrame
    entries: DataFrame | None
    captures: DataFrame | None
    boards: tuple[str, ...]
    catalog: Catalog


def _found(df: DataFrame, check: int, message: Column, order: Column, level: Column | str = "error") -> DataFrame:
    return df.select(F.lit(check).alias("check_id"), (F.lit(level) if isinstance(level, str) else level).alias("level"), message.alias("message"), order.cast("long").alias("ord"))


def _each(df: DataFrame, check: int, messages: Column, order: Column, level: str = "error") -> DataFrame:
    """One row for each message of an array, after one another."""
    return _found(df.withColumn("_o", order).select("_o", F.posexplode(messages).alias("_k", "_m")), check, F.col("_m"), F.col("_o") * 100 + F.col("_k"), level)


def _row(text: str, *cells: Column) -> Column:
    """``row N: text`` with a cell for each ``{}``."""
    parts = text.split("{}")
    out = [F.lit("row "), F.coalesce("num", F.lit("")), F.lit(": " + parts[0])]
    for cell, part in zip(cells, parts[1:], strict=True):
        out += [F.coalesce(cell, F.lit("")), F.lit(part)]
    return F.concat(*out)


def statuses(x: Inputs) -> DataFrame:
    state, cell = x.catalog.state(F.col("status")), F.coalesce("status", F.lit(""))
    unknown, other = _row('unknown status "{}"', F.col("status")), _row('status "{}" is to be {}', F.col("status"), state)
    return _found(good(x).filter(state.isNull() | (state != cell)), 1, F.when(state.isNull(), unknown).otherwise(other), F.col("pos"))


def good(x: Inputs) -> DataFrame:
    return x.rows.filter("not malformed")


def identities(x: Inputs) -> DataFrame:
    found = tracker.duplicates(good(x)).filter("duplicate_of is not null")
    return _found(found, 2, _row("the same as row {} ({})", F.col("duplicate_of"), F.col("key")), F.col("pos"))


def _linked(x: Inputs) -> DataFrame:
    """Well-formed rows with ``target`` and ``path`` of their report."""
    target = tracker.report_target(F.col("report"))
    return good(x).withColumn("target", target).withColumn("path", tracker.resolved_path(F.col("target"), x.tracker_dir))


def links(x: Inputs) -> DataFrame:
    state = x.catalog.state(F.col("status"))
    files = x.reports.select(F.col("path").alias("_file")).distinct()
    rows = _linked(x).join(files, F.col("path") == F.col("_file"), "left").filter("_file is null")
    wanted = F.col("target").isNull() & x.catalog.needs_report(state)
    message = F.when(wanted, _row('{} needs a report, found "{}"', state, F.col("report"))).otherwise(_row("no such report: {}", F.col("target")))
    return _found(rows.filter(wanted | F.col("target").isNotNull()), 3, message, F.col("pos"))


def levels(x: Inputs) -> DataFrame:
    wrong = lambda name, listed: F.when(~x.catalog.is_sentinel(F.col(name)) & listed(F.col(name)).isNull(), _row(f'{name} "{{}}" is no level', F.col(name)))
    return _each(good(x), 4, F.array_compact(F.array(wrong("risk", x.catalog.risk), wrong("confidence", x.catalog.confidence))), F.col("pos"))


def format_of_rows(x: Inputs) -> DataFrame:
    short = F.concat(F.lit("malformed row of "), F.col("n_cells").cast("string"), F.lit(" cells: "), F.substring(F.coalesce("raw", F.lit("")), 1, 60))
    rules = F.transform(tracker.validate(x.catalog), lambda m: F.concat(F.lit("row "), F.coalesce("num", F.lit("")), F.lit(": "), m))
    return _each(x.rows, 5, F.when(F.col("malformed"), F.array(short)).otherwise(rules), F.col("pos"))


def pending(x: Inputs) -> DataFrame:
    none = F.array().cast("array<string>")
    bound = F.coalesce(F.col("bound"), F.lit(False)) if "bound" in x.additions.columns else F.size("errors") == 0
    said = F.concat("errors", F.when(bound, tracker.validate(x.catalog)).otherwise(none))
    place = F.lit(0).cast("long")  # the names order them; a file's messages keep their own order
    return _each(x.additions, 6, F.transform(said, lambda m: F.concat("name", F.lit(": "), m)), place)


def bold(x: Inputs) -> DataFrame:
    found = tracker.marked_cells(x.rows).filter("bold")
    return _found(found, 7, _row("bold markup in {}", F.col("column")), F.col("pos") * 100 + F.col("place"))


def reservations(x: Inputs, now: Column | None = None) -> DataFrame:
    label = F.concat(F.col("start").cast("string"), F.lit("-"), F.col("end").cast("string"))
    old = x.reservations.filter(identity.stale(x.reservations, F.current_timestamp() if now is None else now))
    return _found(old, 8, F.concat(F.lit("older than seven days: "), label), F.col("pos"), "warn")


def report_numbers(x: Inputs) -> DataFrame:
    number = F.nullif(F.regexp_extract("name", r"^([0-9]+)[-.]", 1), F.lit("")).try_cast("decimal(38,0)")
    rows = x.reports.select("name", number.alias("number")).filter("number is not null")
    several = identity.groups_of_several(rows, ["number"], F.col("name"))
    return _found(several, 9, F.concat(F.lit("report number "), F.col("number").cast("string"), F.lit(" is used by "), F.array_join("members", ", ")), F.col("number"))


def orphans(x: Inputs) -> DataFrame:
    if x.rows is None:
        alone = x.reports
    else:
        alone = x.reports.join(_linked(x).filter("path is not null").select("path").distinct(), "path", "left_anti")
    return _found(alone, 10, F.concat(F.lit("no row has the report "), F.col("name")), F.lit(0), "warn")


def sources(x: Inputs) -> DataFrame:
    empty = _found(good(x).filter(F.coalesce("source", F.lit("")) == ""), 11, _row("no source"), F.col("pos"))
    declared = x.reports.select("path", reports.header_field(F.col("text"), "Source").alias("declared")).filter("declared is not null")
    unlike = _linked(x).join(declared, "path").filter(~F.col("declared").eqNullSafe(F.coalesce("source", F.lit(""))))
    return empty.unionByName(_found(unlike, 11, _row('source "{}" but its report has "{}"', F.col("source"), F.col("declared")), F.col("pos") + 2**40, "warn"))


def numbers(x: Inputs) -> DataFrame:
    again = identity.first_wins(good(x), "num", "pos", "pos", "earlier").filter("earlier is not null")  # no window: a number may be very common
    return _found(again, 12, F.concat(F.lit("number "), F.coalesce("num", F.lit("")), F.lit(" is used again")), F.col("pos"))


def log_rows(log: DataFrame) -> DataFrame:
    """pos, n_cells and the log's columns of each line behind the header; blank lines are none."""
    cells = F.split("line", "\t", -1)
    lines = log.filter("pos > 0").filter(F.trim(F.regexp_replace("line", r"\s", "")) != "")
    return lines.select("pos", F.size(cells).alias("n_cells"), *(F.get(cells, F.lit(k)).alias(c) for k, c in enumerate(LOG_HEADER)))


def sync(x: Inputs) -> DataFrame | None:
    if x.log is None:
        return None
    latest = tracker.current_states(log_rows(x.log).filter("n_cells >= 6")).withColumnRenamed("status", "logged")
    if x.rows is None:
        return _found(latest, 13, F.concat(F.lit("the log has row "), F.col("num"), F.lit(", which the tracker lacks")), F.lit(0), "warn")
    both = good(x).select("num", "pos", "status").join(latest.withColumnRenamed("num", "_num"), F.col("num") == F.col("_num"), "full_outer")
    unlike = both.filter(F.col("pos").isNotNull() & F.col("_num").isNotNull() & ~F.col("logged").eqNullSafe(F.coalesce("status", F.lit(""))))
    alone = both.filter(F.col("pos").isNull())
    errors = _found(unlike, 13, _row('has "{}", the log\'s last is "{}"', F.col("status"), F.col("logged")), F.col("pos"))
    return errors.unionByName(_found(alone, 13, F.concat(F.lit("the log has row "), F.col("_num"), F.lit(", which the tracker lacks")), F.lit(2**40), "warn"))


def log_schema(x: Inputs) -> DataFrame | None:
    if x.log is None:
        return None
    header = x.log.filter("pos = 0").filter(F.col("line") != "\t".join(LOG_HEADER))
    wrong = _found(header, 14, F.lit("the header has to be " + " | ".join(LOG_HEADER)), F.lit(0))
    at = F.concat(F.lit("line "), (F.col("pos") + 1).cast("string"), F.lit(": "))
    said = lambda name: F.concat(F.lit(f'{name} "'), F.col(name), F.lit('" is none'))
    state = x.catalog.state
    stamp = F.try_to_timestamp(F.regexp_replace("timestamp", r"^\s+|\s+$", "")).isNull()
    rules = F.array_compact(F.array(
        F.when(stamp, said("timestamp")),
        F.when((F.col("prev") != "-") & state(F.col("prev")).isNull(), said("prev")),
        F.when(state(F.col("new")).isNull(), said("new")),
        F.when(~F.col("source").isin(*tracker.LOG_SOURCES), said("source")),
        F.when(~F.rlike("num", F.lit(tracker.DIGITS)), said("num")),
    ))
    cells = F.array(F.concat(F.lit(f"{len(LOG_HEADER)} cells are wanted, there are "), F.col("n_cells").cast("string")))
    said_of = F.when(F.col("n_cells") != len(LOG_HEADER), cells).otherwise(rules)
    return wrong.unionByName(_each(log_rows(x.log), 14, F.transform(said_of, lambda m: F.concat(at, m)), F.col("pos")))


def portals(x: Inputs) -> DataFrame:
    if x.entries is None:
        return x.reports.sparkSession.createDataFrame([(15, "error", "the document of portals can't be read", 0)], SCHEMA)
    named = F.coalesce("integration", F.lit(""))
    unknown = x.entries.filter((named != "") & ~named.isin(*x.boards))
    return _found(unknown, 15, F.concat(F.lit('entry "'), F.coalesce("name", F.lit("")), F.lit('": unknown board "'), named, F.lit('"')), F.col("entry_pos"))


def control(x: Inputs) -> DataFrame:
    found = tracker.marked_cells(x.rows).filter("control")
    return _found(found, 16, _row("control byte in {}", F.col("column")), F.col("pos") * 100 + F.col("place"))


def archive(x: Inputs) -> DataFrame:
    wrong = reports.archive_checked(x.reports, x.captures).filter("problem is not null")
    return _found(wrong, 17, F.concat(F.col("name"), F.lit(": "), F.col("problem")), F.lit(0))


def risk_layer(x: Inputs) -> DataFrame:
    wrong = reports.checked(x.reports).filter(F.size("hard") > 0)
    return _found(wrong, 18, F.concat(F.col("name"), F.lit(": "), F.array_join("hard", "; ")), F.lit(0))


CHECKS = {1: statuses, 2: identities, 3: links, 4: levels, 5: format_of_rows, 6: pending, 7: bold, 8: reservations, 9: report_numbers, 10: orphans, 11: sources, 12: numbers, 13: sync, 14: log_schema, 15: portals, 16: control, 17: archive, 18: risk_layer}


def findings(x: Inputs, only: tuple[int, ...] = tuple(CHECKS)) -> DataFrame:
    """All messages of the checks; a tracker that isn't there gives one of level ok for each check that needs it."""
    spark = x.reports.sparkSession
    parts, said = [], []
    for number in only:
        if x.rows is None and number in NEED_TRACKER:
            said.append((number, "ok", "there is no tracker yet", 0))
        elif (df := CHECKS[number](x)) is not None:
            parts.append(df)
    return reduce(DataFrame.unionByName, parts, spark.createDataFrame(said, SCHEMA))


def levels_of(found: DataFrame, only: tuple[int, ...] = tuple(CHECKS)) -> DataFrame:
    """check_id, name, level (the worst of its messages), n; every check has its row."""
    spark: SparkSession = found.sparkSession
    names = spark.createDataFrame([(k, NAMES[k]) for k in only], "check_id int, name string")
    got = found.groupBy("check_id").agg(F.min(_rank()).alias("worst"), F.count("*").alias("n"))
    level = F.get(F.array(F.lit("error"), F.lit("warn"), F.lit("ok")), F.coalesce("worst", F.lit(2)))
    return names.join(got, "check_id", "left").select("check_id", "name", level.alias("level"), F.coalesce("n", F.lit(0)).alias("n"))


def _rank() -> Column:
    return F.when(F.col("level") == "error", 0).when(F.col("level") == "warn", 1).otherwise(2)


def rollup(found: DataFrame, only: tuple[int, ...] = tuple(CHECKS)) -> DataFrame:
    """The levels with the messages in order, errors before warnings, for a report that people read: a check's messages come together in a row."""
    each = F.sort_array(F.collect_list(F.struct(_rank().alias("rank"), "ord", "message")))
    said = found.groupBy(F.col("check_id").alias("_of")).agg(F.transform(each, lambda m: m["message"]).alias("messages"))
    rows = levels_of(found, only).join(said, F.col("check_id") == F.col("_of"), "left").drop("_of")
    return rows.withColumn("messages", F.coalesce("messages", F.array().cast("array<string>")))


def summary(levels: DataFrame) -> DataFrame:
    """One row: checks, ok, warn, error, passed."""
    n = lambda level: F.count_if(F.col("level") == level).cast("long").alias(level)
    return levels.agg(F.count("*").alias("checks"), n("ok"), n("warn"), n("error"), F.bool_and(F.col("level") != "error").alias("passed"))


