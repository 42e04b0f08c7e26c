"""Files that people read: the tracker in Markdown, TSV files and reports.

Operators return tables; a sink is the only place that writes, so leaving it out is a dry run. What a scan adds, and a change of states with its log,
are runs that executors write and that are published whole or not at all (``committed``). The other files are small; the driver writes each
beside its place and moves it there. A lock file keeps two commands from writing at once.
"""

from __future__ import annotations

import json
import os
import threading
import time
from collections.abc import Iterator
from contextlib import contextmanager, suppress
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import scan, tracker
from ..sources.markdown import COLUMNS, rendered
from . import committed

# The labels of the tracker's table, and a scan's and a log's headers.
HEADINGS = ("#", "Date", "Title", "Source", "Company", "Location", "URL", "Risk", "Confidence", "Status", "Report", "Notes")
LOG, RESERVATIONS = ("timestamp", "prev", "new", "source", "num", "note"), ("start", "end", "timestamp")
PREAMBLE = "# Findings\n\nThe tracker. Rows come from merged additions, states from the command that sets them;\nneither is to be edited by hand.\n"


class Locked(RuntimeError):
    """Another process holds the lock."""


def write_atomically(path: str, text: str) -> None:
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    beside = target.with_name(f".{target.name}.{os.getpid()}.tmp")
    beside.write_text(text, encoding="utf-8")
    os.replace(beside, target)


@contextmanager
def lock(path: str, stale_seconds: float = 30, attempts: int = 10, wait: float = 0.025) -> Iterator[None]:
    """Holds the lock file, and touches it meanwhile; one untouched for ``stale_seconds`` is taken away. Raises Locked after so many attempts."""
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    for _ in range(attempts):
        try:
            handle = os.open(target, os.O_CREAT | os.O_EXCL | os.O_WRONLY)
            break
        except FileExistsError:
            try:
                age = time.time() - target.stat().st_mtime
            except FileNotFoundError:
                continue
            if age > stale_seconds:
                target.unlink(missing_ok=True)
            else:
                time.sleep(wait)
    else:
        raise Locked(f"{path} is held by another process")
    over = threading.Event()

    def touched() -> None:
        while not over.wait(max(0.1, abs(stale_seconds) / 6)):
            with suppress(OSError):
                os.utime(target)

    try:
        with os.fdopen(handle, "w") as f:
            json.dump({"pid": os.getpid(), "at": time.time()}, f)
        threading.Thread(target=touched, daemon=True).start()
        yield
    finally:
        over.set()
        target.unlink(missing_ok=True)


def tracker_text(rows: DataFrame | None) -> str:
    """The whole tracker: preamble, header, divider and a line for each row in the order of ``pos``; malformed rows as they were."""
    table = [f"| {' | '.join(HEADINGS)} |", f"| {' | '.join('---' for _ in HEADINGS)} |"]
    if rows is not None:
        line = F.when(F.col("malformed"), F.col("raw")).otherwise(rendered(COLUMNS))
        table += [r.line for r in rows.select("pos", line.alias("line")).orderBy("pos").collect()]
    return "\n".join([PREAMBLE, *table, ""])


def write_tracker(path: str, rows: DataFrame | None) -> None:
    write_atomically(path, tracker_text(rows))


def new_tracker(path: str) -> bool:
    """An empty tracker, unless there is one; whether it was written."""
    if os.path.exists(path):
        return False
    write_tracker(path, None)
    return True


def tsv_lines(df: DataFrame, columns: tuple[str, ...], order: list[str]) -> list[str]:
    cells = F.concat_ws("\t", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns))
    return [r.line for r in df.select(*order, cells.alias("line")).orderBy(*order).collect()]


def _under(root: str, path: str) -> str:
    return os.path.relpath(path, root).replace(os.sep, "/")


def publish_scan(root: str, run: str, additions: str, history: str, runs: str, found: DataFrame, known: DataFrame, line: tuple) -> None:
    """What a scan adds, as one run: a file for each addition (named by its padded number and the run), lines of the history, a line of the runs."""
    spark = found.sparkSession
    place = ("a", "b", "c")
    text = F.concat(F.lit("\t".join(scan.ADDITION) + "\n"), F.concat_ws("\t", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in scan.ADDITION)), F.lit("\n"))
    name = F.concat(F.lit(f"{_under(root, additions)}/"), "label", F.lit(f"-scan-{run}.tsv"))
    numbers = lambda *columns: [c.cast("long").alias(n) for c, n in zip(columns, place, strict=True)]
    files = found.select(F.lit("file").alias("kind"), name.alias("path"), *numbers(F.lit(0), F.col("entry_pos"), F.col("pos")), text.alias("line"))
    ordered = known.select(*numbers(F.col("part"), F.col("entry_pos"), F.col("pos")), *(F.col(c).alias(f"cell_{c}") for c in scan.HISTORY))
    added = committed.lines(ordered, "append", _under(root, history), tuple(f"cell_{c}" for c in scan.HISTORY), list(place))
    ran = spark.createDataFrame([("append", _under(root, runs), 0, 0, 0, "\t".join(map(str, line)))], "kind string, path string, a long, b long, c long, line string")
    headers = {_under(root, history): "\t".join(scan.HISTORY), _under(root, runs): "\t".join(scan.RUNS)}
    committed.publish(files.unionByName(added).unionByName(ran), root, run, list(place), headers)


def publish_states(spark: SparkSession, root: str, run: str, path: str, rows: DataFrame, log_path: str, entries: DataFrame) -> None:
    """The whole tracker with its new states, and the log's entries, as one run."""
    table = [PREAMBLE, f"| {' | '.join(HEADINGS)} |", f"| {' | '.join('---' for _ in HEADINGS)} |"]
    top = spark.createDataFrame([("replace", _under(root, path), n - len(table), line) for n, line in enumerate(table)], "kind string, path string, place long, line string")
    cells = F.when(F.col("malformed"), F.col("raw")).otherwise(rendered(COLUMNS))
    body = rows.select(F.lit("replace").alias("kind"), F.lit(_under(root, path)).alias("path"), F.col("pos").cast("long").alias("place"), cells.alias("line"))
    log = committed.lines(entries.withColumn("place", _order_of(entries).cast("long")), "append", _under(root, log_path), LOG, ["place"])
    committed.publish(top.unionByName(body).unionByName(log), root, run, ["place"], {_under(root, log_path): "\t".join(LOG)})


def _order_of(entries: DataFrame):
    return F.col("pos") if "pos" in entries.columns else F.lit(0)


def write_reservations(path: str, found: DataFrame) -> None:
    write_atomically(path, "".join(f"{line}\n" for line in ["\t".join(RESERVATIONS), *tsv_lines(found, RESERVATIONS, ["start", "end"])]))


def archive(folder: str, names: list[str]) -> None:
    """Move consumed additions to the folder ``merged`` inside theirs; files there of the same name are replaced."""
    done = Path(folder) / "merged"
    done.mkdir(parents=True, exist_ok=True)
    for name in names:
        os.replace(Path(folder) / name, done / name)


def json_rows(df: DataFrame) -> list[dict]:
    """The rows as JSON values, for a command's output."""
    return [json.loads(r) for r in df.toJSON().collect()]


def tracker_json(rows: DataFrame | None, path: str) -> dict:
    if rows is None:
        return {"initialized": False, "rows": []}
    shown = tracker.output(rows.orderBy("pos"))
    return {"initialized": True, "tracker": path, "rows": json_rows(shown)}
