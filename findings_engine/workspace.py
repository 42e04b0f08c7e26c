"""The commands over a workspace's files: each reads, computes tables, and writes unless it is a dry run.

Every command returns a plain report (a dict with ``ok``) and leaves printing to its caller.
"""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .checks import integrity
from .functions import risk
from .operators import identity, merge, reports, scan, states, tracker
from .sinks import committed
from .sinks import files as sinks
from .sources import documents, jobboard, listings, plugins
from .sources.documents import Workspace


def now() -> datetime:
    return datetime.now(UTC)


def stamp(at: datetime) -> str:
    return at.strftime("%Y-%m-%dT%H:%M:%S.") + f"{at.microsecond // 1000:03d}Z"


def run_id(at: datetime) -> str:
    return stamp(at).replace(":", "-").replace(".", "-")


def _rows(spark: SparkSession, w: Workspace) -> DataFrame | None:
    return listings.findings(spark, w.tracker)


def _used(spark: SparkSession, w: Workspace, pending: bool) -> DataFrame:
    return listings.used_numbers(_rows(spark, w), listings.files(spark, w.reports), listings.files(spark, w.additions) if pending else None)


def _root(w: Workspace) -> str:
    """The folder that holds the workspace and its tracker, wherever that lies."""
    return os.path.commonpath([w.path(), os.path.dirname(w.tracker_to_write)])


@contextmanager
def held(w: Workspace) -> Iterator[None]:
    """The workspace's lock; runs that were committed before their writer died are brought to their end first."""
    with sinks.lock(w.lock):
        committed.recover(_root(w))
        yield


def scratch(spark: SparkSession, w: Workspace) -> str:
    """A new folder that all executors share: under ``spark.checkpoint.dir``, or the workspace's own where all runs on this machine."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
    return f"{(shared or w.path('data')).rstrip('/')}/.scan-{uuid.uuid4().hex}"


def _asked(spark: SparkSession, entries: list[dict], first: int, last: int, source: type[jobboard.JobBoards], folder: str | None) -> DataFrame:
    """What the boards of the entries from ``first`` on and before ``last`` answer; places stay those in the whole list."""
    return jobboard.fetched(spark, [e if first <= n < last else {"enabled": False} for n, e in enumerate(entries)], source, folder)


def run_scan(spark: SparkSession, w: Workspace, dry: bool = False, limit: int = 0, source: type[jobboard.JobBoards] = jobboard.JobBoards, at: datetime | None = None, folder: str | None = None) -> dict:
    """Fetch the entries' boards (also those of a ``folder`` of modules), tell new postings from known ones, number them and publish additions, history and runs.

    With a ``limit`` boards are asked in rounds, each of twice as many entries as the one before, until so many postings are new. What lies
    behind the last of these counts for nothing, as if it had never been fetched: neither its postings nor entries that fail.
    """
    at = at or now()
    entries = documents.portal_entries(documents.load_yaml(w.portals))
    known = plugins.discover(folder)
    kept = scratch(spark, w)  # what boards answered is written down at once, so that none is asked twice
    try:
        before, wanted = listings.history(spark, w.history), {known.board_of(e) for e in entries}
        first, size = 0, 1 if limit > 0 else max(1, len(entries))
        while True:
            last = min(len(entries), first + size)
            _asked(spark, entries, first, last, source, folder).write.mode("append").parquet(f"{kept}/documents")
            fetched = spark.read.parquet(f"{kept}/documents")
            jobboard.postings(fetched, wanted, known.boards).write.mode("overwrite").parquet(f"{kept}/postings")
            scan.capped(scan.scanned(spark.read.parquet(f"{kept}/postings"), before), ["entry_pos", "pos"], limit).write.mode("overwrite").parquet(f"{kept}/rows")
            rows = spark.read.parquet(f"{kept}/rows")
            reached = scan.reached(rows, limit)
            if reached is not None or last >= len(entries):
                break
            first, size = last, size * 2
        failed = fetched.filter("status <> 'fetched'")
        failed = failed if reached is None else failed.filter(F.col("entry_pos") < reached)
        counted = scan.counts(rows, failed).first().asDict()
        errors = [r.asDict() for r in failed.select("entry_pos", "entry", "status", "error").orderBy("entry_pos").collect()]
        out = {"ok": counted["error"] == 0, "dry": dry, "run": run_id(at), "counts": counted, "failed": errors, "files": []}
        first_number = lambda: _used(spark, w, True).agg(F.coalesce(F.max("n"), F.lit(0)) + 1).first()[0]
        if dry:
            return out | {"next": first_number()}
        with held(w):
            start = first_number()
            line = (stamp(at), os.path.basename(w.portals), len(entries), counted["postings"], counted["added"], scan.skipped(counted))
            found, told = scan.additions(rows, start, stamp(at)[:10]), scan.history_rows(rows, stamp(at)[:10])
            sinks.publish_scan(_root(w), run_id(at), w.additions, w.history, w.runs, found, told, line)
        written = sorted(n for n in os.listdir(w.additions) if n.endswith(f"-scan-{run_id(at)}.tsv")) if counted["added"] else []
        return out | {"next": start, "files": written}
    finally:
        listings.remove(spark, kept)


def run_merge(spark: SparkSession, w: Workspace, catalog: states.Catalog, dry: bool = False, migrate: bool = False, backfill: bool = False) -> dict:
    """Merge the pending additions into the tracker, all or none; consumed files go to the archive, skipped ones stay."""
    with held(w):
        rows = _rows(spark, w)
        if rows is not None and (bad := rows.filter("malformed").count()):
            return {"ok": False, "errors": [f"the tracker has {bad} malformed rows"], "merged": 0, "skipped": []}
        empty = spark.createDataFrame([], ", ".join(f"{c} string" for c in sinks.COLUMNS) + ", pos int, raw string, malformed boolean")
        done = merge.merged(rows if rows is not None else empty, listings.additions(spark, w.additions), catalog)
        skipped = [r.asDict() for r in done.skipped.select("name", "num", "duplicate_of").orderBy("name").collect()]
        errors = [f"{r.name}: {r.message}" for r in done.errors.orderBy("name", "place").collect()]
        if errors:
            return {"ok": False, "errors": errors, "merged": 0, "skipped": skipped}
        consumed = [r.name for r in done.accepted.select("name").orderBy("name").collect()]
        if not dry:
            if consumed or migrate or backfill:
                folder, present = os.path.dirname(w.tracker), listings.files(spark, w.reports, deep=True)
                accepted = tracker.rewritten_links(done.accepted, present, folder, w.path())
                known = tracker.canonical(rows if rows is not None else empty, catalog)
                if migrate:
                    known = tracker.rewritten_links(known, present, folder, w.path())
                after = merge.joined(known, accepted)
                if backfill:
                    after = merge.backfilled(after, listings.reports(spark, w.reports), w.path())
                sinks.write_tracker(w.tracker, after)
            sinks.archive(w.additions, consumed)
        return {"ok": True, "merged": len(consumed), "skipped": skipped, "consumed": consumed, "dry": dry}


def set_status(spark: SparkSession, w: Workspace, catalog: states.Catalog, selector: str, state: str, note: str = "", source: str = "cli", dry: bool = False, at: datetime | None = None) -> dict:
    if source not in tracker.LOG_SOURCES:
        raise ValueError(f"source is one of {', '.join(tracker.LOG_SOURCES)}")
    named = catalog.resolve(state)
    if named is None:
        raise ValueError(f"{state!r} is no state")
    with held(w):
        rows = _rows(spark, w)
        if rows is None:
            return {"ok": False, "error": "there is no tracker yet"}
        row = tracker.selected(rows, selector)
        if row["status"] == named:
            return {"ok": True, "unchanged": True, "num": row["num"]}
        if not dry:
            when = at or now()
            entry = tracker.log_entry(spark, stamp(when), row["status"], named, source, row["num"], note)
            sinks.publish_states(spark, _root(w), f"{run_id(when)}-{uuid.uuid4().hex}", w.tracker, tracker.with_status(rows, row["pos"], named), w.status_log, entry)
        return {"ok": True, "num": row["num"], "title": row["title"], "prev": row["status"], "next": named, "dry": dry}


def normalize_statuses(spark: SparkSession, w: Workspace, catalog: states.Catalog, dry: bool = False, at: datetime | None = None) -> dict:
    with held(w):
        rows = _rows(spark, w)
        if rows is None:
            return {"ok": False, "error": "there is no tracker yet"}
        after, log, unknown = tracker.normalized_statuses(rows, catalog, stamp(at or now()))
        changes = [r.asDict() for r in log.select("num", "prev", "new", "pos").orderBy("pos").collect()]
        touched = len(changes) + rows.filter("malformed").count()
        invalid = [r.num for r in unknown.orderBy("pos").collect()]
        if not dry and touched:
            sinks.publish_states(spark, _root(w), f"{run_id(at or now())}-{uuid.uuid4().hex}", w.tracker, after, w.status_log, log)
        return {"ok": not invalid, "changed": touched, "changes": changes, "invalid": invalid, "dry": dry}


def dedup(spark: SparkSession, w: Workspace, dry: bool = False) -> dict:
    with held(w):
        rows = _rows(spark, w)
        if rows is None:
            return {"ok": False, "error": "there is no tracker yet"}
        kept, gone = tracker.deduplicated(rows)
        removed = [r.asDict() for r in gone.select("num", "duplicate_of", "title", "pos").orderBy("pos").collect()]
        if removed and not dry:
            sinks.write_tracker(w.tracker, kept)
        return {"ok": True, "removed": removed, "dry": dry}


def fix_links(spark: SparkSession, w: Workspace, dry: bool = False) -> dict:
    with held(w):
        rows = _rows(spark, w)
        if rows is None:
            return {"ok": False, "error": "there is no tracker yet"}
        folder, present = os.path.dirname(w.tracker), listings.files(spark, w.reports, deep=True)
        after = tracker.rewritten_links(rows.filter("not malformed"), present, folder, w.path())
        before = rows.select("pos", F.col("report").alias("before"))
        changed = [r.asDict() for r in after.join(before, "pos").filter("not report <=> before").select("num", "before", "report", "pos").orderBy("pos").collect()]
        target = tracker.resolved_path(tracker.report_target(F.col("report")), folder)
        lost = after.withColumn("_path", target).filter("_path is not null").join(present.select(F.col("path").alias("_path")), "_path", "left_anti")
        missing = [r.num for r in lost.orderBy("pos").collect()]
        if changed and not dry:
            sinks.write_tracker(w.tracker, after.unionByName(rows.filter("malformed"), allowMissingColumns=True))
        return {"ok": True, "changed": changed, "missing": missing, "dry": dry}


def evaluate(spark: SparkSession, w: Workspace, selector: str, indicators: str = "", decision: str = "", next_action: str = "", dry: bool = False) -> dict:
    """Score a row's indicators and write its report under the next number; the report's own summary is checked."""
    if decision and decision not in reports.DECISIONS:
        raise ValueError(f"the decision is one of {', '.join(reports.DECISIONS)}")
    with held(w):
        rows = _rows(spark, w)
        if rows is None:
            return {"ok": False, "error": "there is no tracker yet"}
        row = tracker.selected(rows.filter(F.rlike("num", F.lit(tracker.DIGITS))), selector)
        number = _used(spark, w, False).agg(F.coalesce(F.max("n"), F.lit(0)) + 1).first()[0]
        one = rows.filter(F.col("pos") == row["pos"]).withColumn("codes", risk.codes(F.lit(indicators)))
        text = reports.rendered({c: F.col(c) for c in sinks.COLUMNS}, F.col("codes"), F.lit(decision), F.lit(next_action))
        made = one.select(risk.assessed(F.col("codes")).alias("risk"), text.alias("text"), reports.file_name(F.lit(number), F.col("company"), F.col("title")).alias("name"))
        problems = reports.parsed(made).withColumn("problems", reports.summary_problems()).first()
        path = os.path.join(w.reports, problems["name"])
        if not dry:
            sinks.write_atomically(path, problems["text"])
        assessed = problems["risk"].asDict(recursive=True)
        return {"ok": not problems["problems"], "num": row["num"], "report": number, "path": path, "problems": problems["problems"], "dry": dry, **{k: assessed[k] for k in ("level", "tier", "categories", "confidence")}, "indicators": [i["code"] for i in assessed["indicators"]]}


def reserve(spark: SparkSession, w: Workspace, count: int = 1, at: datetime | None = None) -> dict:
    with held(w):
        found = listings.reservations(spark, w.reservations)
        after, (start, end) = identity.reserved(found, _used(spark, w, False), count, stamp(at or now()))
        sinks.write_reservations(w.reservations, after)
        return {"ok": True, "start": start, "end": end, "label": identity.reservation_label(start, end)}


def release(spark: SparkSession, w: Workspace, label: str) -> dict:
    with held(w):
        sinks.write_reservations(w.reservations, identity.released(listings.reservations(spark, w.reservations), label))
        return {"ok": True, "label": label}


def inputs(spark: SparkSession, w: Workspace, catalog: states.Catalog, folder: str | None = None) -> integrity.Inputs:
    """What the checks are given; boards of a ``folder`` of modules are known boards."""
    try:
        entries = documents.entries_table(spark, documents.portal_entries(documents.load_yaml(w.portals))) if os.path.exists(w.portals) else documents.entries_table(spark, [])
    except ValueError:
        entries = None
    captures = listings.files(spark, w.captures) if os.path.isdir(w.captures) else None
    return integrity.Inputs(_rows(spark, w), os.path.dirname(w.tracker), listings.reports(spark, w.reports), listings.additions(spark, w.additions), listings.lines(spark, w.status_log), listings.reservations(spark, w.reservations), entries, captures, plugins.discover(folder).names(), catalog)


def run_checks(spark: SparkSession, w: Workspace, states_file: str | None = None, fix: bool = False, folder: str | None = None) -> dict:
    """The levels and messages of all checks. A catalogue that is wrong is the only finding, of check 0."""
    try:
        catalog = states.load(states_file) if states_file else states.Catalog()
    except (states.CatalogError, OSError, ValueError) as error:
        return {"ok": False, "errors": 1, "warnings": 0, "checks": [{"check_id": 0, "name": "states configuration", "level": "error", "messages": [str(error)]}]}
    x = inputs(spark, w, catalog, folder)
    checks = [r.asDict() for r in integrity.rollup(integrity.findings(x)).orderBy("check_id").collect()]
    if fix:
        for c in checks:
            if c["check_id"] == 8 and c["level"] == "warn":
                kept = x.reservations.filter(~identity.stale(x.reservations, F.current_timestamp()))
                sinks.write_reservations(w.reservations, kept)
                c.update(level="ok", messages=["taken away: " + m for m in c["messages"]])
    of = lambda level: sum(c["level"] == level for c in checks)
    return {"ok": not of("error"), "errors": of("error"), "warnings": of("warn"), "checks": checks}


def run_report_checks(spark: SparkSession, w: Workspace) -> dict:
    found = reports.checked(listings.reports(spark, w.reports)).select("path", "name", "hard", "warnings").cache()
    total = reports.totals(found).first().asDict()
    rows = [r.asDict() for r in found.orderBy("path").collect()]
    found.unpersist()
    return {**total, "rows": rows}


def run_archive_checks(spark: SparkSession, w: Workspace) -> dict:
    captures = listings.files(spark, w.captures) if os.path.isdir(w.captures) else None
    rows = [r.asDict() for r in reports.archive_checked(listings.reports(spark, w.reports), captures).select("path", "verbatim", "capture", "problem").orderBy("path").collect()]
    return {"ok": all(r["problem"] is None for r in rows), "rows": rows}


def check_portals(w: Workspace, live: bool = False, transport: jobboard.Transport | None = None, folder: str | None = None) -> dict:
    """What is wrong with the portals document, whose boards may be those of a ``folder``; with ``live`` also what each entry's URL shows."""
    known = plugins.discover(folder)
    if not os.path.exists(w.portals):
        return {"ok": False, "problems": ["there is no document of portals"], "rows": []}
    document = documents.load_yaml(w.portals)
    problems = documents.entry_problems(document, lambda e: known.board_of(e) is not None)
    entries = documents.portal_entries(document)
    lost = [str(e.get("name") or "") for e in entries if e.get("enabled") is not False and known.board_of(e) is None]
    probe = (transport or jobboard.Transport()).probe
    rows = [{"name": e.get("name"), "url": e.get("url"), "status": probe(e.get("url"))} for e in entries] if live else []
    return {"ok": not problems and all(r["status"] in ("ok", "redirect", "no-target") for r in rows), "problems": problems, "without_board": lost, "rows": rows}


def doctor(w: Workspace) -> dict:
    """Which of the user's files are missing, and which YAML among them can't be read."""
    missing = [p for p in (documents.TRACKER, "portals.yml", "config/profile.yml") if not os.path.exists(w.path(p))]
    broken = []
    for p in ("portals.yml", "config/profile.yml"):
        if p not in missing:
            try:
                documents.load_yaml(w.path(p))
            except ValueError as error:
                broken.append(f"{p}: {error}")
    return {"ok": not broken, "missing": missing, "broken": broken}


def onboarding(w: Workspace) -> dict:
    """Which of the files that a user is to make their own are missing, and which still are as they were made."""
    missing, unpersonalized = [], []
    for p, _ in documents.OWN:
        if not os.path.exists(w.path(p)):
            missing.append(p)
            continue
        with open(w.path(p), encoding="utf-8", errors="replace") as f:
            if f.read() == documents.TEMPLATES[p]:
                unpersonalized.append(p)
    return {"needed": bool(missing or unpersonalized), "to_make": missing, "unpersonalized": unpersonalized}


def init(w: Workspace) -> dict:
    """Make the files that a new workspace gets at once, and an empty tracker, where they are missing. Nothing that is there is touched."""
    made = []
    for p, at_once in documents.OWN:
        if at_once and not os.path.exists(w.path(p)):
            sinks.write_atomically(w.path(p), documents.TEMPLATES[p])
            made.append(p)
    if sinks.new_tracker(w.tracker_to_write):
        made.append(os.path.relpath(w.tracker_to_write, w.path()))
    return {"ok": True, "made": made}
