"""Commands and checks over workspaces in temporary folders, with the outcomes that the cases call for."""

import json
import os
import time
from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from findings_engine import __main__ as cli
from findings_engine import workspace as commands
from findings_engine.operators import identity, paths, reports, states, tracker
from findings_engine.sinks import committed
from findings_engine.sinks import files as sinks
from findings_engine.sources import documents, jobboard, listings, plugins
from findings_engine.sources.documents import Workspace
from findings_engine.sources.markdown import COLUMNS

CATALOG = states.Catalog()
ROW = {"num": "1", "date": "2026-10-08", "title": "Senior Engineer", "source": "greenhouse", "company": "ACME", "location": "Remote", "url": "https://jobs.example.com/posting/1", "risk": "—", "confidence": "—", "status": "Queued", "report": "—", "notes": ""}
LABELS = ("num", "date", "title", "source", "url", "risk", "confidence", "status", "report", "company", "location", "notes")
AT = datetime(2026, 10, 9, 8, 7, 6, 5000, UTC)
SUMMARY = {"company": "ACME", "role": "Senior Engineer", "legitimacy_tier": "High Confidence", "risk_level": "Low", "confidence": "High", "categories": ["Likely Genuine"], "indicators": []}


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")


def report(sections=reports.SECTIONS, more="", **members):
    held = {k: v for k, v in (SUMMARY | members).items() if v is not None}
    return f"# Analysis\n\n**Source:** greenhouse\n\n<!-- machine-summary -->\n```yaml\n{json.dumps(held)}\n```\n<!-- /machine-summary -->\n\n" + "\n\ntext\n\n".join(sections) + f"\n\n> JD. {more}\n"


@pytest.fixture
def place(tmp_path):
    class Place:
        root, w = tmp_path, Workspace(str(tmp_path))

        def rows(self, *rows, raw=()):
            lines = [f"| {' | '.join(sinks.HEADINGS)} |", f"|{'---|' * 12}"]
            lines += [f"| {' | '.join((ROW | r)[c] for c in COLUMNS)} |" for r in rows]
            write(tmp_path / "data/findings.md", "\n".join(["# Findings", "", *lines, *raw, ""]))

        def addition(self, name, labels=LABELS, **cells):
            write(tmp_path / "data/additions" / name, "\t".join(labels) + "\n" + "\t".join((ROW | cells)[c] for c in labels) + "\n")

        def report(self, name, text):
            write(tmp_path / "reports" / name, text)

        def log(self, *rows, header=sinks.LOG):
            write(tmp_path / "data/status-log.tsv", "\n".join("\t".join(r) for r in (header, *rows)) + "\n")

    return Place()


def levels(spark, place, **kw):
    found = commands.run_checks(spark, place.w, **kw)
    return {c["check_id"]: c["level"] for c in found["checks"] if c["level"] != "ok"}, {c["check_id"]: c["messages"] for c in found["checks"]}


# -- checks ---------------------------------------------------------------------------------------------
def test_checks_of_a_fresh_and_a_clean_workspace(spark, place):
    bad, messages = levels(spark, place)
    assert bad == {} and len(messages) == 18 and messages[1] == ["there is no tracker yet"]
    place.rows({})
    bad, messages = levels(spark, place)
    assert bad == {} and not any(messages.values())


def test_checks_of_rows(spark, place):
    place.rows(
        {"status": "pending"}, {"num": "2", "url": "https://jobs.example.com/posting/1?utm_source=x"}, {"num": "0", "date": "10/08/2026", "source": "Green House", "url": "ftp://x"},
        {"num": "4", "risk": "Extreme", "url": "u", "title": "**Bold**"}, {"num": "4", "status": "Weird", "url": "https://a.b/c", "company": "A\x01B"}, {"num": "6", "status": "Analyzed", "url": "https://a.b/d", "source": ""},
        raw=["| only | three | cells |"],
    )
    bad, messages = levels(spark, place)
    assert bad == dict.fromkeys((1, 2, 3, 4, 5, 7, 11, 12, 16), "error")
    assert len(messages[1]) == 2 and "pending" in messages[1][0] and "Weird" in messages[1][1]
    assert messages[2] == ["row 2: the same as row 1 (url:https://jobs.example.com/posting/1)"] and "Analyzed" in messages[3][0]
    assert [m[:6] for m in messages[5]] == ["row 0:"] * 4 + ["row 4:"] * 3 + ["row 6:", "malfor"]
    assert messages[7] == ["row 4: bold markup in title"] and messages[16] == ["row 4: control byte in company"]
    assert messages[12] == ["number 4 is used again"] and messages[11] == ["row 6: no source"]


def test_checks_of_files(spark, place):
    place.rows({"status": "Analyzed", "report": "[3](../reports/003-x.md)"}, {"num": "2", "status": "Analyzed", "report": "[9](../reports/009-gone.md)", "url": "https://a.b/2", "source": "lever"}, {"num": "5", "url": "https://a.b/5", "source": "lever", "report": "[4](../reports/004-y.md)"})
    place.report("003-x.md", report(more="x" * 20))
    place.report("003-z.md", report(sections=reports.SECTIONS[:-1]))
    place.report("deep/004-y.md", report(risk_level="High", indicators=["M1", "M2"]))
    place.report("004-y.md", report(sections=(reports.SECTIONS[1], reports.SECTIONS[0], reports.SECTIONS[-1]), more="this is a scam"))
    place.addition("002-a.tsv", labels=[c for c in LABELS if c != "url"])
    place.addition("001-b.tsv", risk="Extreme")
    place.log(("2026-10-08T00:00:00.000Z", "-", "Queued", "cli", "1", ""), ("2026-10-09T00:00:00.000Z", "Queued", "Queued", "manual", "1", ""), ("soon", "x", "y", "cli", "77x", ""), ("1", "2"))
    write(place.root / "data/report-nums.reserved.tsv", "start\tend\ttimestamp\n1\t5\t2026-01-01T00:00:00.000Z\n9\t9\tsoon\n7\t7\t\n")
    write(place.root / "portals.yml", "entries:\n  - name: A\n    integration: nobody\n  - name: B\n    integration: lever\n")
    bad, messages = levels(spark, place)
    assert bad == {3: "error", 6: "error", 8: "warn", 9: "error", 10: "warn", 11: "warn", 13: "error", 14: "error", 15: "error", 17: "error", 18: "error"}
    assert messages[3] == ["row 2: no such report: ../reports/009-gone.md"] and len(messages[6]) == 2 and messages[6][0].startswith("00")
    assert messages[9] == ["report number 3 is used by 003-x.md, 003-z.md", "report number 4 is used by 004-y.md, 004-y.md"]
    assert messages[8] == ["older than seven days: 1-5", "older than seven days: 7-7"] and sorted(messages[10]) == ["no row has the report 003-z.md", "no row has the report 004-y.md"]
    assert messages[11] == ['row 5: source "lever" but its report has "greenhouse"']
    assert messages[13] == ['row 1: has "Analyzed", the log\'s last is "Queued"', "the log has row 77x, which the tracker lacks"]
    assert [m[:7] for m in messages[14]] == ["line 3:", "line 4:", "line 4:", "line 4:", "line 4:", "line 5:"]
    assert messages[15] == ['entry "A": unknown board "nobody"'] and [m[:9] for m in messages[17]] == ["003-z.md:"] and len(messages[18]) == 2
    assert levels(spark, place, fix=True)[0].get(8) is None and listings.reservations(spark, place.w.reservations).count() == 1


def test_a_wrong_catalogue_is_the_only_finding(spark, place):
    write(place.root / "states.yml", "states:\n  - name: A\n    dashboard_group: g\n  - name: a\n    dashboard_group: g\ndashboard_groups: [g]\nrisk_levels: [Low]\nconfidence_levels: [Low]\n")
    found = commands.run_checks(spark, place.w, str(place.root / "states.yml"))
    assert [c["check_id"] for c in found["checks"]] == [0] and not found["ok"]


# -- merging --------------------------------------------------------------------------------------------
def numbers(spark, place):
    return [r.num for r in listings.findings(spark, place.w.tracker).orderBy("pos").collect()]


def test_merge(spark, place):
    place.rows({"num": "10", "url": "https://a.b/10"}, {"num": "2", "url": "https://a.b/2", "status": "pending"})
    place.addition("003-a.tsv", num="3", url="https://a.b/3", risk="medium")
    place.addition("004-b.tsv", num="4", url="https://a.b/2/?utm_source=x")
    place.addition("005-c.tsv", num="5", url="https://A.b/3#top")
    dry = commands.run_merge(spark, place.w, CATALOG, dry=True)
    assert dry["merged"] == 1 and numbers(spark, place) == ["10", "2"]
    done = commands.run_merge(spark, place.w, CATALOG)
    assert done["ok"] and done["consumed"] == ["003-a.tsv"] and [(s["name"], s["duplicate_of"]) for s in done["skipped"]] == [("004-b.tsv", "2"), ("005-c.tsv", "3")]
    assert numbers(spark, place) == ["2", "3", "10"] and sorted(os.listdir(place.w.additions)) == ["004-b.tsv", "005-c.tsv", "merged"]
    rows = {r.num: r for r in listings.findings(spark, place.w.tracker).collect()}
    assert (rows["3"].risk, rows["2"].status) == ("Medium", "Queued")


def test_merge_is_all_or_nothing(spark, place):
    place.rows({})
    place.addition("002-a.tsv", num="2", url="https://a.b/2")
    place.addition("003-b.tsv", num="3", url="ftp://x")
    done = commands.run_merge(spark, place.w, CATALOG)
    assert not done["ok"] and done["merged"] == 0 and done["errors"][0].startswith("003-b.tsv: url") and numbers(spark, place) == ["1"]
    place.rows({}, raw=["| a | b |"])
    assert commands.run_merge(spark, place.w, CATALOG)["errors"] == ["the tracker has 1 malformed rows"]


def test_merge_into_nothing_with_links_and_urls(spark, place):
    place.report("007-x.md", "**URL:** https://found.example/7\n")
    place.addition("007-a.tsv", num="7", url="—", report="[7](reports/007-x.md)")
    assert commands.run_merge(spark, place.w, CATALOG, backfill=True)["merged"] == 1
    row = listings.findings(spark, place.w.tracker).first()
    assert (row.report, row.url) == ("[7](../reports/007-x.md)", "https://found.example/7")


# -- commands on the tracker ----------------------------------------------------------------------------
def test_status_changes(spark, place):
    place.rows({}, {"num": "2", "title": "Data Analyst", "status": "pending", "url": "https://a.b/2"}, {"num": "3", "title": "Data Engineer", "url": "https://a.b/3"})
    assert commands.set_status(spark, place.w, CATALOG, "analyst", "reviewed", note="a\tb\nc", at=AT)["next"] == "Analyzed"
    assert (place.root / "data/status-log.tsv").read_text().splitlines()[1] == "2026-10-09T08:07:06.005Z\tpending\tAnalyzed\tcli\t2\ta b c"
    assert commands.set_status(spark, place.w, CATALOG, "1", "queued")["unchanged"]
    for selector in ("nobody", "data", "01"):
        with pytest.raises(tracker.SelectorError):
            commands.set_status(spark, place.w, CATALOG, selector, "Cleared")
    with pytest.raises(ValueError, match="no state"):
        commands.set_status(spark, place.w, CATALOG, "1", "done")


def test_normalizing_dedup_and_links(spark, place):
    place.rows({"status": "stale"}, {"num": "2", "status": "nope", "url": "https://a.b/2"}, {"num": "3", "report": "reports/003-x.md"}, raw=["| a | b |"])
    place.report("003-x.md", report())
    found = commands.normalize_statuses(spark, place.w, CATALOG, at=AT)
    assert not found["ok"] and found["invalid"] == ["2"] and [(c["prev"], c["new"]) for c in found["changes"]] == [("stale", "Archived")]
    assert commands.fix_links(spark, place.w)["changed"][0]["report"] == "../reports/003-x.md"
    gone = commands.dedup(spark, place.w)["removed"]
    assert [(g["num"], g["duplicate_of"]) for g in gone] == [("3", "1")]
    text = (place.root / "data/findings.md").read_text()
    assert "| a | b |" in text and "Archived" in text and numbers(spark, place) == ["1", "2", None]


def test_queries_of_the_tracker(spark, place):
    place.rows({"title": r"A \| B"}, {"num": "2", "status": "Archived", "notes": "Needle", "risk": "High"}, {"num": "3", "status": "Archived", "company": "needles", "risk": "low"})
    rows = listings.findings(spark, place.w.tracker)
    found = lambda **kw: [r.num for r in tracker.find(rows, CATALOG, **kw).orderBy("pos").collect()]
    assert found(status="dead") == found(text="NEEDLE") == ["2", "3"] and found(risk="LOW") == ["3"] and found(limit=2) == ["1", "2"] and found(status="x") == []
    shown = sinks.tracker_json(rows, "t")
    assert shown["rows"][0]["title"] == "A | B" and list(shown["rows"][0]) == list(COLUMNS)
    assert rows.orderBy("pos").select(tracker.console_line()).first()[0].startswith("   1  2026-10-08  —         —      Queued      A | B")
    assert sinks.new_tracker(place.w.tracker) is False and sinks.new_tracker(str(place.root / "other.md")) is True


def test_evaluate(spark, place):
    place.rows({}, {"num": "2", "title": "Data Analyst", "company": "Globex Inc.", "url": "https://a.b/2"})
    place.report("041-old.md", report())
    done = commands.evaluate(spark, place.w, "analyst", "h1, m1 m2", "Skip", "write to them")
    assert done["ok"] and (done["report"], done["level"], done["tier"], done["categories"]) == (42, "High", "Suspicious", ["Ghost/Stale", "Scam"])
    text = (place.root / "reports/042-globex-inc-data-analyst.md").read_text()
    assert "| H1 | High | recruiter uses" in text and documents.parse_yaml(text.split("```yaml\n")[1].split("\n```")[0])["indicators"] == ["H1", "M1", "M2"]
    row = spark.createDataFrame([(text,)], "text string")
    checked = reports.checked(row).first()
    assert (checked.hard, checked.warnings) == ([], [])
    assert reports.archive_checked(row, None).first().problem is None


def test_reservations(spark, place):
    place.rows({"num": "7"})
    assert commands.reserve(spark, place.w, 3, AT)["label"] == "008-010" and commands.reserve(spark, place.w, at=AT)["label"] == "011"
    commands.release(spark, place.w, "8-10")
    assert [r.start for r in listings.reservations(spark, place.w.reservations).collect()] == [11]
    with pytest.raises(LookupError):
        commands.release(spark, place.w, "8-10")
    with pytest.raises(ValueError):
        commands.reserve(spark, place.w, 1001)
    assert identity.label_range("7") == (7, 7) and identity.label_range("x") is None


def test_lock_and_paths(place):
    with sinks.lock(place.w.lock):
        with pytest.raises(sinks.Locked), sinks.lock(place.w.lock, attempts=2, wait=0):
            pass
        with sinks.lock(place.w.lock, stale_seconds=-1):
            pass
    assert not os.path.exists(place.w.lock) and documents.is_user_path("data/x") and not documents.is_user_path("database")
    write(place.root / "findings.md", "x")
    assert place.w.tracker.endswith("/findings.md") and place.w.tracker_to_write.endswith("data/findings.md")


# -- reports --------------------------------------------------------------------------------------------
@pytest.mark.parametrize(
    ("text", "hard", "warnings"),
    [
        (report(), 0, 0),
        ("no summary", 1, 0),
        (report(sections=()), 0, 1),
        (report(risk_level="Medium"), 1, 0),
        (report(risk_level="High", legitimacy_tier="Suspicious", indicators=["M1", "M2"], categories=["Ghost/Stale", "Suspicious"]), 1, 0),
        (report(risk_level="Medium", legitimacy_tier="Proceed with Caution", indicators=["M1", "m1"], categories=["Suspicious"]), 3, 0),
        (report(sections=reports.SECTIONS[::-1]), 1, 0),
        (report(sections=(*reports.SECTIONS, reports.SECTIONS[2])), 1, 0),
        (report(more="It is certainly a  fake."), 1, 0),
        (report(role="", company=None, confidence="Sure", categories="x", indicators=["Z9"], next_action=3), 7, 0),
    ],
)
def test_report_checks(spark, text, hard, warnings):
    r = reports.checked(spark.createDataFrame([(text,)], "text string")).first()
    assert (len(r.hard), len(r.warnings)) == (hard, warnings), r.hard


def test_captures(spark):
    rows = [(report(sections=()) + "see jds/a-1.pdf", None), (report(sections=()) + "see b.txt", "the captured file is missing: b.txt"), ("nothing", "there is neither the description itself nor a captured file"), (None, "there is neither the description itself nor a captured file")]
    df = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(rows)], "k int, text string")
    got = reports.archive_checked(df, spark.createDataFrame([("a-1.pdf",)], "name string")).orderBy("k").collect()
    assert [r.problem for r in got] == [p for _, p in rows]


# -- scanning -------------------------------------------------------------------------------------------
POSTINGS = [{"title": "Engineer", "hostedUrl": "https://a.b/1?utm_source=x"}, {"title": "Suspicious role", "hostedUrl": "https://a.b/2"}, {"title": "Analyst\t2", "hostedUrl": "https://a.b/3/", "categories": {"location": "Oz"}}]


class StubBoards(jobboard.JobBoards):
    def transport(self):
        def answer(url, timeout, headers, method):
            if "down" in url:
                return jobboard.Response(500)
            return jobboard.Response(200, json.dumps([*POSTINGS, {"title": "", "hostedUrl": "https://a.b/9"}] if "more" in url else POSTINGS).encode())

        return jobboard.Transport(jobboard.Guard(lookup=lambda host: ["93.184.216.34"]), request=answer)


def portals(place, *entries):
    write(place.root / "portals.yml", json.dumps({"entries": entries}))


def test_scan(spark, place):
    portals(place, {"name": "Filtered", "integration": "Lever", "company": "a", "source": "stub", "filters": {"title_blacklist": ["SUSPICIOUS"]}}, {"name": "Plain", "url": "https://api.lever.co/x", "company": "b"})
    dry = commands.run_scan(spark, place.w, dry=True, source=StubBoards, at=AT)
    want = {"postings": 6, "added": 2, "duplicate": 3, "skipped_title": 1, "skipped_location": 0, "no_provider": 0, "invalid_posting": 0, "error": 0}
    assert dry["ok"] and dry["counts"] == want and not os.path.exists(place.w.history)
    assert commands.run_scan(spark, place.w, source=StubBoards, at=AT)["files"] == ["001-scan-2026-10-09T08-07-06-005Z.tsv", "002-scan-2026-10-09T08-07-06-005Z.tsv"]
    added = (place.root / "data/additions/002-scan-2026-10-09T08-07-06-005Z.tsv").read_text().splitlines()[1]
    assert added == "2\t2026-10-09\tAnalyst 2\tstub\thttps://a.b/3\t—\t—\tQueued\t—\ta\tOz\t"
    history = (place.root / "data/scan-history.tsv").read_text().splitlines()
    assert len(history) == 7 and [line.split("\t")[3] for line in history[1:]] == ["added", "added", "skipped_title", "duplicate", "duplicate", "duplicate"]
    assert (place.root / "data/scan-runs.tsv").read_text().splitlines()[1].endswith("portals.yml\t2\t6\t2\t4")
    again = commands.run_scan(spark, place.w, source=StubBoards, at=AT)
    assert again["counts"]["duplicate"] == 6 and again["next"] == 3 and len((place.root / "data/scan-history.tsv").read_text().splitlines()) == 13
    assert commands.run_merge(spark, place.w, CATALOG)["merged"] == 2


def test_scan_of_failing_entries_and_limits(spark, place):
    portals(place, {"name": "off", "integration": "lever", "company": "a", "enabled": False}, {"name": "who"}, {"integration": "lever", "company": "down"}, {"name": "w", "integration": "workday", "url": "https://evil.example/x"}, {"name": "none", "integration": "lever"}, {"name": "more", "integration": "lever", "company": "more"})
    found = commands.run_scan(spark, place.w, dry=True, source=StubBoards)
    assert not found["ok"] and (found["counts"]["no_provider"], found["counts"]["error"], found["counts"]["invalid_posting"], found["counts"]["added"]) == (1, 2, 1, 3)
    assert [f["entry"] for f in found["failed"]] == ["who", "lever", "w"]
    limited = commands.run_scan(spark, place.w, dry=True, limit=2, source=StubBoards)["counts"]
    assert (limited["added"], limited["postings"], limited["invalid_posting"]) == (2, 2, 0)


def test_a_limit_stops_the_scan(spark, place):
    """Entries behind the last new posting are as if never asked: their failures don't count; those before it do."""
    portals(place, {"name": "who"}, {"integration": "lever", "company": "a"}, {"name": "after"}, {"integration": "lever", "company": "down"}, {"integration": "lever", "company": "more"})
    found = commands.run_scan(spark, place.w, limit=1, source=StubBoards, at=AT)
    assert (found["counts"]["added"], found["counts"]["postings"], found["counts"]["no_provider"], found["counts"]["error"]) == (1, 1, 1, 0)
    assert found["ok"] and [f["entry"] for f in found["failed"]] == ["who"] and len(found["files"]) == 1
    assert len((place.root / "data/scan-history.tsv").read_text().splitlines()) == 2
    every = commands.run_scan(spark, place.w, dry=True, limit=1000, source=StubBoards)
    assert (every["counts"]["no_provider"], every["counts"]["error"], every["ok"]) == (2, 1, False)
    assert not [n for n in os.listdir(place.root / "data") if n.startswith(".scan")]


def test_a_scan_is_whole_or_not_there(spark, place, monkeypatch):
    """The committer dies in the middle: the next command under the lock brings the scan to its end."""
    portals(place, {"name": "Plain", "url": "https://api.lever.co/x", "company": "b", "source": "stub"})
    publish = committed.publish
    monkeypatch.setattr(committed, "publish", lambda *a, **k: publish(*a, source=DiesMidway, **k))
    with pytest.raises(Exception, match="killed"):
        commands.run_scan(spark, place.w, source=StubBoards, at=AT)
    monkeypatch.undo()
    assert not os.path.exists(place.w.history) and not os.path.exists(place.w.runs)
    merged = commands.run_merge(spark, place.w, CATALOG)
    added = (place.root / "data/scan-history.tsv").read_text().splitlines()
    assert merged["ok"] and merged["merged"] == len([x for x in added if "\tadded\t" in x]) > 0
    assert len((place.root / "data/scan-runs.tsv").read_text().splitlines()) == 2
    assert commands.run_scan(spark, place.w, source=StubBoards, at=AT)["counts"]["added"] == 0


class DiesMidway(committed.RunFiles):
    @classmethod
    def name(cls):
        return "diesmidway"

    def writer(self, schema, overwrite):
        class Dying(committed.Writer):
            def commit(self, messages):
                next(self.steps(messages))
                raise RuntimeError("killed")

        return Dying(self.options)


def test_a_held_lock_stays_fresh(place):
    with sinks.lock(place.w.lock, stale_seconds=0.6):
        before = os.stat(place.w.lock).st_mtime
        time.sleep(1.2)
        assert os.stat(place.w.lock).st_mtime > before
        with pytest.raises(sinks.Locked), sinks.lock(place.w.lock, stale_seconds=0.6, attempts=2, wait=0):
            pass


PLUGIN = """
from findings_engine.sources.boards import FIELDS, Board

BOARD = Board({name!r}, ("stub.example",), "exact", ("jobs",), True, dict.fromkeys(FIELDS, "ctx") | {{"title": "title", "url": "link"}})
SEED = {seed}
"""


def test_boards_of_a_folder(spark, place):
    folder = place.root / "boards"
    write(folder / "stub.py", PLUGIN.format(name="stub", seed='lambda entry: "https://stub.example/more"'))
    write(folder / "other.py", PLUGIN.format(name="other", seed='("fixed", "https://other.example/")'))
    write(folder / "bad.py", "BOARD = 3")
    write(folder / "_helper.py", "raise SystemExit")
    found = plugins.discover(str(folder))
    assert list(found.errors) == ["bad.py"] and len(found.boards) == 25 and found.board_of({"url": "https://stub.example/x"}) in ("other", "stub")
    assert found.seed("other", {}) == "https://other.example/" and found.seed("lever", {"company": "a"}).endswith("/a?mode=json") and plugins.discover(None).names() == tuple(sorted(jobboard.SEEDS))
    portals(place, {"name": "A", "integration": "stub"}, {"name": "B", "integration": "lever", "company": "a"})
    counted = commands.run_scan(spark, place.w, dry=True, source=StubBoards, folder=str(folder))["counts"]
    assert (counted["postings"], counted["invalid_posting"], counted["added"]) == (7, 4, 3)


def test_operators_do_not_depend_on_partitions(spark, place):
    place.rows(*({"num": str(n), "url": f"https://a.b/{n % 7}?utm_source={n}", "title": f"T {n % 3}"} for n in range(1, 40)))
    rows = listings.findings(spark, place.w.tracker)
    outcome = lambda df: (sorted((r.pos, r.duplicate_of) for r in tracker.duplicates(df).collect()), sorted((r.num, r.n) for r in identity.numbered(df.select("num", "pos"), ["pos"], 5, name="n").collect()))
    assert outcome(rows.repartition(1)) == outcome(rows.repartition(9))
    kept, _ = tracker.deduplicated(rows)
    assert tracker.deduplicated(kept)[1].count() == 0 and kept.count() == 7


def test_seeds():
    entry = {"company": "A b/c", "limit": 5, "search": "data eng"}
    got = {b: jobboard.seed(b, entry) for b in ("ashby", "greenhouse", "lever", "recruitcrm", "remotive", "jobicy", "nomado24", "weworkremotely", "workday")}
    assert got == {
        "ashby": "https://api.ashbyhq.com/posting-api/job-board/A%20b%2Fc", "greenhouse": "https://boards-api.greenhouse.io/v1/boards/A%20b%2Fc/jobs", "lever": "https://api.lever.co/v0/postings/A%20b%2Fc?mode=json",
        "recruitcrm": "https://api.recruitcrm.io/v1/jobs?company=A%20b%2Fc&search=data%20eng", "remotive": "https://remotive.com/api/remote-jobs?search=data+eng&limit=5", "jobicy": "https://jobicy.com/api/v2/remote-jobs?count=5",
        "nomado24": "https://api.nomado24.de/api/public/v1/jobs?perPage=5", "weworkremotely": "https://weworkremotely.com/remote-jobs.json", "workday": None,
    }
    assert jobboard.seed("arbeitnow", {"key": "x.org/api"}) == "https://x.org/api" and jobboard.seed("jobspresso", {"endpoint": "api"}) == "https://jobspresso.co/api" and jobboard.seed("themuse", {}) == "https://www.themuse.com/api/public/jobs"
    assert jobboard.seed("remotive", {"tag": "a&b"}) == "https://remotive.com/api/remote-jobs?tag=a%26b&limit=50" and jobboard.seed("icims", {"url": "x.icims.com"}) == "https://x.icims.com"
    assert set(jobboard.SEEDS) == {b.name for b in jobboard.boards.BOARDS}


def test_transport():
    waits, answers = [], [jobboard.Response(429, headers={"retry-after": "3"}), TimeoutError("timed out"), jobboard.Response(200, b"[]")]

    def answer(url, timeout, headers, method):
        got = answers.pop(0)
        if isinstance(got, Exception):
            raise got
        return got

    public = jobboard.Guard(lookup=lambda host: ["93.184.216.34"])
    t = jobboard.Transport(public, answer, waits.append)
    assert t.json_text("https://x.example/", retries=2) == "[]" and waits[0] == 3 and 0.5 <= waits[1] <= 1.0
    assert jobboard.retry_after("Wed, 21 Oct 2015 07:28:00 GMT", 0) > 1e9 and jobboard.retry_after("soon", 0) is None and jobboard.backoff(9, chance=lambda: 1.0) == 8.0
    assert not jobboard.retryable(jobboard.Redirected("x")) and not jobboard.retryable(jobboard.GuardError("x")) and jobboard.retryable(OSError("getaddrinfo failed"))
    called = []
    inside = jobboard.Transport(jobboard.Guard(lookup=lambda host: ["8.8.8.8", "127.0.0.1"]), lambda *a: called.append(a))
    for url in ("http://in.example/", "ftp://x/", "http://[::1]/", "http://10.0.0.1/", "http:///x"):
        with pytest.raises(jobboard.GuardError):
            inside.fetch(url)
    assert not called and inside.probe("http://in.example/") == "blocked" and inside.probe(None) == "no-target"
    head = lambda status: jobboard.Transport(public, lambda *a: jobboard.Response(status)).probe("https://x.example/")
    assert (head(200), head(404)) == ("ok", "http_404")


def test_portals(place):
    portals(place, {"name": "A", "integration": "lever", "colour": "red"}, {"url": "https://nobody.example/"}, "text")
    found = commands.check_portals(place.w)
    assert len(found["problems"]) == 4 and found["without_board"] == [""] and not found["ok"]
    assert jobboard.board_of({"url": "https://api.lever.co:443/x"}) == "lever" and jobboard.board_of({"url": "https://lever.co"}) is None
    assert commands.doctor(place.w) == {"ok": True, "missing": ["data/findings.md", "config/profile.yml"], "broken": []}


def test_onboarding(place):
    assert commands.onboarding(place.w) == {"needed": True, "to_make": ["config/profile.yml", "modes/_profile.md", "modes/_custom.md"], "unpersonalized": []}
    assert commands.init(place.w)["made"] == ["modes/_profile.md", "modes/_custom.md", "data/findings.md"] and commands.init(place.w)["made"] == []
    write(place.root / "config/profile.yml", "name: A\n")
    assert commands.onboarding(place.w) == {"needed": True, "to_make": [], "unpersonalized": ["modes/_profile.md", "modes/_custom.md"]}
    write(place.root / "modes/_profile.md", "mine")
    write(place.root / "modes/_custom.md", "mine too")
    assert commands.onboarding(place.w) == {"needed": False, "to_make": [], "unpersonalized": []} and commands.init(place.w)["made"] == []
    assert (place.root / "modes/_custom.md").read_text() == "mine too"


def test_boards_of_a_folder_are_known_to_the_checks(spark, place):
    folder = place.root / "boards"
    write(folder / "stub.py", PLUGIN.format(name="stub", seed='("fixed", "https://stub.example/")'))
    portals(place, {"name": "A", "integration": "stub", "url": "https://stub.example/x"})
    assert commands.check_portals(place.w)["without_board"] == [] or commands.check_portals(place.w)["problems"]
    assert commands.check_portals(place.w, folder=str(folder)) == {"ok": True, "problems": [], "without_board": [], "rows": []}
    place.rows()
    assert 15 in levels(spark, place)[0] and 15 not in levels(spark, place, folder=str(folder))[0]


def test_paths_inside_others(spark):
    one = spark.createDataFrame([("data",), ("a/b/",), ("./a//c",), ("x/y/z",), ("ab",), (None,), ("",)], "p string")
    two = spark.createDataFrame([("data/x.md",), ("a",), ("a/b",), ("x/y/zz",), ("/",), ("ab",)], "q string")
    got = {tuple(r) for r in paths.overlapping(one, "p", two, "q").collect()}
    assert got == {("data", "data/x.md", "right"), ("a/b/", "a", "left"), ("a/b/", "a/b", "same"), ("./a//c", "a", "left"), ("ab", "ab", "same")}
    # what an update may touch and what is the user's own don't overlap
    own, system = (spark.createDataFrame([(x,) for x in found], "p string") for found in (documents.USER_PATHS, ("findings_engine", "tests", "README.md", "modes/scan.md", "config/states.yml")))
    assert paths.overlapping(own, "p", system, "p").count() == 0
    files = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", None), ("d", "")], "path string, content string")
    kept = spark.createDataFrame([("a", "x"), ("b", "y"), ("c", None), ("d", None)], "path string, content string")
    assert sorted(r.path for r in paths.unchanged(files, kept).collect()) == ["a", "c"]


def test_catalogue(spark):
    assert CATALOG.resolve(" Follow-UP ") == "Followup" and CATALOG.resolve("x") is None
    assert CATALOG.table(spark).filter("requires_report").select("name").distinct().count() == 4
    df = spark.createDataFrame([(" DEAD ",), ("x",), (None,)], "c string")
    assert [r[0] for r in df.select(CATALOG.state(F.col("c"))).collect()] == ["Archived", None, None]


def test_command_line(spark, place):
    def call(*argv):
        a = cli.parser().parse_args(["--root", str(place.root), *argv])
        report, code = cli.run(spark, a)
        return report, code, cli.shown(report, a)

    assert call("status", "1", "Cleared")[1] == cli.NO_TRACKER and call("tracker")[0]["initialized"] is False
    assert call("tracker", "--init")[0]["created"] and not call("tracker", "--init")[0]["created"]
    place.rows({}, {"num": "2", "status": "nope", "url": "https://a.b/2"})
    assert call("tracker", "--find", "engineer", "--limit", "1")[2].startswith("1  2026-10-08")
    assert [call("status", s, t)[1] for s, t in (("9", "Cleared"), ("1", "done"), ("1", "legit"))] == [cli.SELECTOR, cli.USAGE, cli.OK]
    report, code, text = call("check")
    assert code == cli.FOUND and "  1. canonical statuses" in text and 'row 2: unknown status "nope"' in text
    assert call("--summary", "check")[2] == "checks=18 ok=15 warn=0 error=3" and json.loads(call("--json", "check")[2])["errors"] == 3
    assert call("reserve", "--count", "2")[0]["label"] == "003-004" and call("reserve", "--release", "3-4")[1] == cli.OK
    assert call("reserve", "--release", "3-4")[1] == call("reserve", "--count", "1", "--release", "1")[1] == call("evaluate", "1", "--final-decision", "x")[1] == cli.USAGE
    with sinks.lock(place.w.lock):
        assert call("dedup")[1] == cli.LOCKED
    assert call("dedup")[1] == call("links", "--dry-run")[1] == call("merge")[1] == call("doctor")[1] == call("reports")[1] == call("archive")[1] == cli.OK
    assert call("portals")[1] == cli.FOUND and call("normalize")[1] == cli.FOUND and call("scan")[1] == cli.FOUND
