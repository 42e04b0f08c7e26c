"""Keyed state with timers: the log's entries checked as they come, and reservations that expire by themselves.

Both give what ``operators.transitions`` gives for the whole log, however it is cut into batches (in its order), and go on where they were after a restart:
state and timers lie in the query's checkpoint. They need the RocksDB state store, which ``prepared`` sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators import transitions
from ..operators.states import Catalog

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def prepared(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)


class Entries(StatefulProcessor):
    """A number's state: the last well-formed entry's state and the last entry's place."""

    def __init__(self, terminal: frozenset[str]):
        self.terminal = terminal

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "status string, pos long")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:  # noqa: N802
        status, at = self.last.get() if self.last.exists() else (None, None)
        for r in sorted(rows, key=lambda r: r.pos):
            if at is not None and r.pos <= at:
                yield Row(num=r.num, pos=r.pos, prev=r.prev, new=r.new, status=status, problem=f"comes after entry {at}")
                continue
            at, problem = r.pos, r.malformed
            if r.moves is not None:
                problem, status = self.broken(status, r.begins, r.moves), r.moves
            yield Row(num=r.num, pos=r.pos, prev=r.prev, new=r.new, status=status, problem=problem)
        self.last.update((status, at))

    def broken(self, status: str | None, begins: str | None, moves: str) -> str | None:
        if begins != (status or "-"):
            return f"begins at {begins or 'no state'} instead of {status or '-'}"
        return f"leaves {status}" if status in self.terminal and moves != status else None

    def close(self) -> None:
        pass


def checked(log: DataFrame, catalog: Catalog) -> DataFrame:
    """``transitions.checked`` of a stream of the log, for append mode. An entry that arrives after a later one of its number moves nothing, and says so."""
    prepared(log.sparkSession)
    terminal = frozenset(s.name for s in catalog.states if s.terminal)
    return transitions.parsed(log, catalog).groupBy("num").transformWithState(Entries(terminal), transitions.CHECKED, "Append", "None")


class Reservations(StatefulProcessor):
    """A label's reservation: since when it is held, in microseconds. A timer at its end takes it away."""

    def __init__(self, days: int):
        self.lasts = days * 86_400_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "since long")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:  # noqa: N802
        since = self.held.get()[0] if self.held.exists() else None
        before = since
        for r in sorted(rows, key=lambda r: (r.us, r.pos)):
            if since is not None and r.us >= since + self.lasts:
                yield Row(label=key[0], event="expired", us=since + self.lasts)
                since = None
            if r.kind == "reserve":
                yield Row(label=key[0], event="reserved" if since is None else "refused", us=r.us)
                since = r.us if since is None else since
            else:
                yield Row(label=key[0], event="refused" if since is None else "released", us=r.us)
                since = None
        if since == before:
            return
        if before is not None:
            self.handle.deleteTimer(self._ends(before))
        if since is None:
            self.held.clear()
        else:
            self.held.update((since,))
            self.handle.registerTimer(self._ends(since))

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:  # noqa: N802
        if self.held.exists():
            yield Row(label=key[0], event="expired", us=self.held.get()[0] + self.lasts)
            self.held.clear()

    def _ends(self, since: int) -> int:
        """Milliseconds since the epoch, rounded up: a timer never fires before the reservation ends."""
        return -(-(since + self.lasts) // 1000)

    def close(self) -> None:
        pass


def happened(events: DataFrame, days: int = transitions.DAYS, late: str = transitions.LATE) -> DataFrame:
    """``transitions.happened`` of a stream, for append mode: expiries come when the watermark passes them.

    Events that lie further behind the latest one than ``late`` are dropped by the watermark, as the query's progress counts.
    """
    prepared(events.sparkSession)
    rows = events.filter("label is not null and at is not null").select("label", "kind", "at", F.unix_micros("at").alias("us"), F.col("pos").cast("long").alias("pos"))
    found = rows.withWatermark("at", late).groupBy("label").transformWithState(Reservations(days), "label string, event string, us long", "Append", "EventTime")
    return found.select("label", "event", F.timestamp_micros("us").alias("at"))
