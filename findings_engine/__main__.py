"""The command line: ``python -m findings_engine COMMAND …``. Every command prints its report, with ``--json`` as JSON.

Exit codes: 0 fine, 1 something was found or failed, 2 wrong usage, 3 no such row or several, 5 no tracker yet, 6 locked.
"""

from __future__ import annotations

import argparse
import json
import os
import sys

from . import workspace
from .operators import states, tracker
from .sinks import files as sinks
from .sources import listings
from .sources.documents import Workspace

OK, FOUND, USAGE, SELECTOR, NO_TRACKER, LOCKED = 0, 1, 2, 3, 5, 6


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="findings_engine")
    p.add_argument("--root", default=os.environ.get("FINDINGS_ROOT", "."), help="the workspace")
    p.add_argument("--tracker", help="another tracker file, from the root")
    p.add_argument("--portals", help="another document of portals, from the root")
    p.add_argument("--states", help="another catalogue of states")
    p.add_argument("--json", action="store_true")
    p.add_argument("--summary", action="store_true", help="one line of key=value")
    commands = p.add_subparsers(dest="command", required=True)

    def add(name: str, *flags: str, **options) -> argparse.ArgumentParser:
        c = commands.add_parser(name)
        for f in flags:
            c.add_argument(f"--{f}", action="store_true")
        for k, default in options.items():
            c.add_argument(f"--{k.replace('_', '-')}", default=default, type=type(default) if default is not None else str)
        return c

    add("tracker", "init", status=None, risk=None, find=None, limit=0)
    add("scan", "dry-run", limit=0, providers_dir=None)
    add("merge", "dry-run", "migrate", "backfill-urls")
    one = add("status", "dry-run", note="", source="cli")
    one.add_argument("selector")
    one.add_argument("state")
    for name in ("normalize", "dedup", "links"):
        add(name, "dry-run")
    add("evaluate", "dry-run", indicators="", final_decision="", next_action="").add_argument("selector")
    held = add("reserve", count=None, release=None)
    held.set_defaults(count=None)
    add("check", "fix", providers_dir=None)
    add("reports")
    add("archive")
    add("portals", "live", providers_dir=None)
    add("doctor")
    add("init")
    return p


def run(spark, a: argparse.Namespace) -> tuple[dict, int]:
    """The report and the exit code of a parsed command line."""
    w = Workspace(a.root, a.tracker, a.portals)
    catalog = states.load(a.states) if a.states and a.command != "check" else states.Catalog()
    if a.command == "tracker":
        if a.init:
            return {"ok": True, "created": sinks.new_tracker(w.tracker_to_write), "tracker": w.tracker_to_write}, OK
        rows = listings.findings(spark, w.tracker)
        if rows is not None:
            rows = tracker.find(rows, catalog, a.status, a.risk, a.find, a.limit)
        return {"ok": True, **sinks.tracker_json(rows, w.tracker)}, OK
    dry = getattr(a, "dry_run", False)
    calls = {
        "scan": lambda: workspace.run_scan(spark, w, dry, a.limit, folder=a.providers_dir),
        "merge": lambda: workspace.run_merge(spark, w, catalog, dry, a.migrate, a.backfill_urls),
        "status": lambda: workspace.set_status(spark, w, catalog, a.selector, a.state, a.note, a.source, dry),
        "normalize": lambda: workspace.normalize_statuses(spark, w, catalog, dry),
        "dedup": lambda: workspace.dedup(spark, w, dry),
        "links": lambda: workspace.fix_links(spark, w, dry),
        "evaluate": lambda: workspace.evaluate(spark, w, a.selector, a.indicators, a.final_decision, a.next_action, dry),
        "reserve": lambda: workspace.release(spark, w, a.release) if a.release else workspace.reserve(spark, w, int(a.count or 1)),
        "check": lambda: workspace.run_checks(spark, w, a.states, a.fix, a.providers_dir),
        "reports": lambda: workspace.run_report_checks(spark, w),
        "archive": lambda: workspace.run_archive_checks(spark, w),
        "portals": lambda: workspace.check_portals(w, a.live, folder=a.providers_dir),
        "doctor": lambda: {**workspace.doctor(w), "onboarding": workspace.onboarding(w)},
        "init": lambda: workspace.init(w),
    }
    if a.command == "reserve" and a.release and a.count:
        return {"ok": False, "error": "numbers are either reserved or released"}, USAGE
    try:
        report = calls[a.command]()
    except tracker.SelectorError as error:
        return {"ok": False, "error": str(error)}, SELECTOR
    except sinks.Locked as error:
        return {"ok": False, "error": str(error)}, LOCKED
    except (ValueError, LookupError) as error:
        return {"ok": False, "error": str(error)}, USAGE
    except OSError as error:
        return {"ok": False, "error": str(error)}, FOUND
    if report.get("error") == "there is no tracker yet":
        return report, NO_TRACKER
    return report, OK if report["ok"] else FOUND


def lines(report: dict) -> list[str]:
    """The report for people: a check's line and its messages, a tracker's rows, or each member."""
    if "checks" in report:
        out = [f"{c['check_id']:>3}. {c['name']} {'.' * max(3, 44 - len(c['name']))} {c['level']}" for c in report["checks"]]
        said = [[f"       {m}" for m in c["messages"]] if c["level"] != "ok" else [] for c in report["checks"]]
        return [x for line, more in zip(out, said, strict=True) for x in (line, *more)]
    if "initialized" in report:
        return ["  ".join(str(r.get(c, "")) for c in ("num", "date", "risk", "status", "title", "company")) for r in report["rows"]] or ["no rows"]
    return [f"{k}: {v}" for k, v in report.items()]


def summary(report: dict) -> str:
    if "checks" in report:
        n = lambda level: sum(c["level"] == level for c in report["checks"])
        return f"checks={len(report['checks'])} ok={n('ok')} warn={n('warn')} error={n('error')}"
    return " ".join(f"{k}={v if not isinstance(v, (list, dict)) else len(v)}" for k, v in report.items())


def shown(report: dict, a: argparse.Namespace) -> str:
    if a.json:
        return json.dumps(report, indent=2, default=str, ensure_ascii=False)
    return summary(report) if a.summary else "\n".join(lines(report))


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").config("spark.sql.shuffle.partitions", "8").getOrCreate()
    report, code = run(spark, a)
    print(shown(report, a))
    return code


if __name__ == "__main__":
    sys.exit(main())
