"""The tracker as a DataFrame: validation, canonical cells, identity, queries and changes of state.

A tracker row has the columns of ``sources.markdown.COLUMNS``, all text, and ``pos``, its place in the file.
Nothing here writes: each operator returns the rows as they would be, and ``sinks`` takes them from there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import url as urls
from ..functions.text import DASH, bold, control_bytes, messages, trimmed
from ..sources.markdown import COLUMNS
from .identity import first_wins
from .states import Catalog

# The formats of cells.
DATE, SLUG, DIGITS = r"^\d{4}-\d{2}-\d{2}\z", r"^[a-z0-9][a-z0-9-]*\z", r"^[0-9]+\z"
LINK, BARE_PATH = r"^\[(\d+)\]\((.+)\)\z", r"^[A-Za-z0-9._/-]+\.md\z"
LOG_SOURCES = ("cli", "agent", "merge", "script", "import")


class SelectorError(LookupError):
    """A selector that names no row, or several."""


def _cell(name: str) -> Column:
    return trimmed(F.coalesce(F.col(name), F.lit("")))


def validate(catalog: Catalog) -> Column:
    """The messages of the nine rules that a row breaks, in the order of the rules."""
    num, url, risk, confidence, status, report = map(_cell, ("num", "url", "risk", "confidence", "status", "report"))
    said = lambda text, cell: F.concat(F.lit(f"{text}, not \""), cell, F.lit('"'))
    rules = (
        (~F.rlike(num, F.lit(DIGITS)) | F.rlike(num, F.lit(r"^0+\z")), said("num has to be a positive whole number", num)),
        (~F.rlike(_cell("date"), F.lit(DATE)), said("date has to be YYYY-MM-DD", _cell("date"))),
        (_cell("title") == "", F.lit("title is empty")),
        (~F.rlike(_cell("source"), F.lit(SLUG)), said("source has to be a slug in lower case", _cell("source"))),
        (~catalog.is_sentinel(url) & ~F.rlike(url, F.lit("(?i)^https?://")), said("url has to be http(s) or a sentinel", url)),
        (~catalog.is_sentinel(risk) & catalog.risk(risk).isNull(), said(f"risk has to be one of {'/'.join(catalog.risk_levels)} or a sentinel", risk)),
        (~catalog.is_sentinel(confidence) & catalog.confidence(confidence).isNull(), said(f"confidence has to be one of {'/'.join(catalog.confidence_levels)} or a sentinel", confidence)),
        (catalog.state(status).isNull(), said("status has to be a state or an alias", status)),
        (~catalog.is_sentinel(report) & ~F.rlike(report, F.lit(LINK)) & ~F.rlike(report, F.lit(BARE_PATH)), said("report has to be a sentinel, a link or a .md path", report)),
    )
    return messages(*rules)


def canonical(rows: DataFrame, catalog: Catalog) -> DataFrame:
    """All cells trimmed, the source in lower case, levels and states by their listed names, sentinels as the dash."""

    def level(name: str, listed: Column) -> Column:
        return F.coalesce(listed, F.when(catalog.is_sentinel(F.col(name)), DASH), _cell(name))

    changed = {c: _cell(c) for c in COLUMNS}
    changed["source"] = F.lower(_cell("source"))
    changed["risk"], changed["confidence"] = level("risk", catalog.risk(F.col("risk"))), level("confidence", catalog.confidence(F.col("confidence")))
    changed["status"] = F.coalesce(catalog.state(F.col("status")), _cell("status"))
    for c in ("url", "report"):
        changed[c] = F.when(catalog.is_sentinel(F.col(c)), DASH).otherwise(_cell(c))
    return rows.withColumns(changed)


def identity_key() -> Column:
    return urls.identity(F.coalesce("url", F.lit("")), F.coalesce("title", F.lit("")), F.coalesce("source", F.lit("")))


def duplicates(rows: DataFrame) -> DataFrame:
    """All rows with ``key`` and ``duplicate_of``: the number of the first row, in the file's order, of the same identity."""
    return first_wins(rows.withColumn("key", identity_key()), "key", "pos", "num")


def deduplicated(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows that stay, malformed ones among them, and those that go, with ``duplicate_of``."""
    found = duplicates(rows.filter("not malformed"))
    kept = found.filter("duplicate_of is null").select(*rows.columns).unionByName(rows.filter("malformed"))
    return kept, found.filter("duplicate_of is not null")


def report_target(report: Column) -> Column:
    """The path that a report cell names, by a link or alone; null if it names none."""
    cell = trimmed(report)
    linked = F.nullif(F.regexp_extract(cell, LINK, 2), F.lit(""))
    return F.coalesce(linked, F.when(F.rlike(cell, F.lit(BARE_PATH)), cell))


def resolved_path(target: Column, folder: str) -> Column:
    """A relative path from the folder, without ``.`` and ``..`` segments; null stays null."""
    joined = F.when(F.startswith(target, F.lit("/")), target).otherwise(F.concat(F.lit(folder.rstrip("/") + "/"), target))

    def step(done: Column, part: Column) -> Column:
        return F.when(part.isin("", "."), done).when(part == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(part)))

    parts = F.aggregate(F.split(joined, "/"), F.array().cast("array<string>"), step)
    return F.when(target.isNotNull(), F.concat(F.lit("/"), F.array_join(parts, "/")))


def relative_path(path: Column, folder: str) -> Column:
    """An absolute path as seen from the folder, both without dot segments."""
    base = F.array(*(F.lit(p) for p in folder.strip("/").split("/") if p)).cast("array<string>")
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    same = F.size(F.filter(F.sequence(F.lit(1), F.greatest(F.size(base), F.lit(1))), lambda n: F.slice(parts, F.lit(1), n) == F.slice(base, F.lit(1), n)))
    shared = F.when(F.size(base) == 0, 0).otherwise(same)
    up = F.array_repeat(F.lit(".."), F.size(base) - shared)
    return F.array_join(F.concat(up, F.slice(parts, shared + 1, F.greatest(F.size(parts) - shared, F.lit(0)))), "/")


def rewritten_links(rows: DataFrame, files: DataFrame, tracker_dir: str, root: str) -> DataFrame:
    """``report`` as seen from the tracker's folder where the file exists there or else under the root. ``files``: path (absolute).

    The listing joins twice, by the path from either folder; a cell whose file is in neither place stays as it is.
    """
    target = report_target(F.col("report"))
    known = files.select("path").distinct()
    near, far = known.withColumnRenamed("path", "_near"), known.withColumnRenamed("path", "_far")
    out = rows.withColumns({"_a": resolved_path(target, tracker_dir), "_b": resolved_path(target, root)})
    out = out.join(near, out["_a"] == near["_near"], "left").join(far, out["_b"] == far["_far"], "left")
    path, number = relative_path(F.coalesce("_near", "_far"), tracker_dir), F.regexp_extract(trimmed(F.col("report")), LINK, 1)
    linked = F.when(number != "", F.concat(F.lit("["), number, F.lit("]("), path, F.lit(")"))).otherwise(path)
    return out.withColumn("report", F.when(F.coalesce("_near", "_far").isNotNull(), linked).otherwise(trimmed(F.col("report")))).drop("_a", "_b", "_near", "_far")


# -- queries --------------------------------------------------------------------------------------------
def find(rows: DataFrame, catalog: Catalog, status: str | None = None, risk: str | None = None, text: str | None = None, limit: int = 0) -> DataFrame:
    """Well-formed rows by state (name or alias), risk and a text in title, company or notes; the first ``limit`` in the file's order."""
    rows = rows.filter("not malformed")
    if status:
        rows = rows.filter(F.col("status") == (catalog.resolve(status) or status))
    if risk:
        rows = rows.filter(F.lower("risk") == risk.lower())
    if text:
        needle = F.lit(text.lower())
        held = F.lit(False)
        for c in ("title", "company", "notes"):
            held |= F.coalesce(F.contains(F.lower(c), needle), F.lit(False))
        rows = rows.filter(held)
    return rows.orderBy("pos").limit(limit) if limit > 0 else rows


def output(rows: DataFrame) -> DataFrame:
    """The columns of the tracker in order, empty where a cell is absent."""
    return rows.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in COLUMNS))


def console_line() -> Column:
    """A row in columns of fixed width; longer cells push the rest to the right."""
    wide = lambda c, n, pad: F.when(F.length(c) >= n, c).otherwise(pad(c, n, " "))
    cell = lambda name: F.coalesce(F.col(name), F.lit(""))
    shown = lambda name: F.when(cell(name) == "", DASH).otherwise(cell(name))
    parts = (wide(cell("num"), 4, F.lpad), cell("date"), wide(cell("risk"), 8, F.rpad), wide(cell("confidence"), 5, F.rpad), wide(cell("status"), 10, F.rpad), cell("title"))
    return F.concat_ws("  ", *parts, F.concat(F.lit("["), shown("company"), F.lit("]")), F.concat(F.lit("report="), shown("report")))


def selected(rows: DataFrame, selector: str) -> dict:
    """The one row that a number (all digits, compared as text) or a part of a title names."""
    named = F.col("num") == selector if selector.isascii() and selector.isdigit() else F.contains(F.lower("title"), F.lit(selector.lower()))
    found = rows.filter("not malformed").filter(named).orderBy("pos").limit(2).collect()
    if len(found) != 1:
        raise SelectorError(f"{'no row matches' if not found else 'several rows match'} {selector!r}")
    return found[0].asDict()


# -- changes of state -----------------------------------------------------------------------------------
def with_status(rows: DataFrame, pos: int, state: str) -> DataFrame:
    return rows.withColumn("status", F.when(F.col("pos") == pos, state).otherwise(F.col("status")))


def log_entry(spark, stamp: str, before: str, after: str, source: str, num: str, note: str = "") -> DataFrame:
    """One row of the status log; tabs and line ends in the note become spaces."""
    if source not in LOG_SOURCES:
        raise ValueError(f"source is one of {', '.join(LOG_SOURCES)}")
    clean = " ".join(note.replace("\t", " ").splitlines()).strip()
    return spark.createDataFrame([(stamp, before, after, source, num, clean)], "timestamp string, prev string, new string, source string, num string, note string")


def normalized_statuses(rows: DataFrame, catalog: Catalog, stamp: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows with canonical cells, log entries of those whose state changed, rows of no known state).

    Malformed rows and rows of unknown state stay as they are.
    """
    state = catalog.state(F.col("status"))
    good = rows.filter(~F.col("malformed")).filter(state.isNotNull())
    unknown = rows.filter(~F.col("malformed")).filter(state.isNull())
    changed = good.filter(state != F.col("status"))
    log = changed.select(F.lit(stamp).alias("timestamp"), F.col("status").alias("prev"), state.alias("new"), F.lit("script").alias("source"), "num", F.lit("normalize-statuses").alias("note"), "pos")
    return canonical(good, catalog).unionByName(unknown).unionByName(rows.filter("malformed")), log, unknown


def current_states(log: DataFrame) -> DataFrame:
    """(num, status): the last entry of each number, in the log's order."""
    return log.groupBy("num").agg(F.max_by("new", "pos").alias("status"))


def cells(rows: DataFrame) -> DataFrame:
    """(num, pos, column, place, value): one row for each cell of the well-formed rows."""
    each = F.array(*(F.struct(F.lit(c).alias("column"), F.lit(k).alias("place"), F.col(c).alias("value")) for k, c in enumerate(COLUMNS)))
    return rows.filter("not malformed").select("num", "pos", F.explode(each).alias("x")).select("num", "pos", "x.*").filter("value is not null")


def marked_cells(rows: DataFrame) -> DataFrame:
    """Cells with bold markup or control bytes."""
    found = cells(rows).withColumns({"bold": bold(F.col("value")), "control": control_bytes(F.col("value"))})
    return found.filter("bold or control")


def occurrences(rows: DataFrame, key: str = "num") -> DataFrame:
    """Rows whose key an earlier row has, with ``occurrence`` (1 for the second)."""
    nth = F.row_number().over(W.partitionBy(key).orderBy("pos")) - 1
    return rows.withColumn("occurrence", nth).filter("occurrence > 0")
