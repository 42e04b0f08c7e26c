"""Streams with state against the batch tables, for several splits into batches and over restarts."""

import random
from datetime import UTC, datetime, timedelta

import pytest

from findings_engine.operators import transitions
from findings_engine.operators.states import Catalog
from findings_engine.streaming import stateful

LOG = "timestamp string, prev string, new string, source string, num string, note string, pos long"
EVENTS = "label string, kind string, at timestamp, pos long"
DAY = datetime(2026, 1, 1, tzinfo=UTC)


def entries(n=400, seed=1):
    rng = random.Random(seed)
    names = ["Queued", "analyzed", "reviewed", "Cleared", "Discarded", "stale", " Confirmed "]
    state, rows = {}, []
    for pos in range(n):
        num = str(rng.randint(1, 12))
        prev = state.get(num, "-") if rng.random() < 0.8 else rng.choice(["-", "Queued", "nonsense", None])
        new = rng.choice([*names, "bogus"]) if rng.random() < 0.9 else None
        stamp = (DAY + timedelta(hours=pos)).strftime("%Y-%m-%dT%H:%M:%SZ") if rng.random() < 0.95 else rng.choice(["later", "", None])
        row = (stamp, prev, new, rng.choice(["cli", "script", "cli", "ghost", None]) if rng.random() < 0.2 else "cli", num if rng.random() < 0.95 else rng.choice(["x", None]), "n", pos)
        rows.append(row)
        if Catalog().resolve(new) and row[3] in ("cli", "script") and row[0] not in ("later", "", None):
            state[num] = Catalog().resolve(new)
    return rows


def streamed(spark, rows, schema, cuts, make, out, tmp):
    """The rows in batches cut at ``cuts``; the query is started anew for each, and so goes on from its checkpoint."""
    folder = f"{tmp}/in-{out}"
    for a, b in zip([0, *cuts], [*cuts, len(rows)], strict=True):
        spark.createDataFrame(rows[a:b], schema).coalesce(1).write.mode("append").parquet(folder)
        stream = make(spark.readStream.schema(schema).parquet(folder))
        stream.writeStream.format("parquet").option("checkpointLocation", f"{tmp}/cp-{out}").option("path", f"{tmp}/{out}").trigger(availableNow=True).start().awaitTermination(120)
    return sorted(map(tuple, spark.read.parquet(f"{tmp}/{out}").collect()), key=repr)


@pytest.mark.parametrize("cuts", [[], [200], [1, 150, 151, 390]])
def test_entries_of_any_split(spark, tmp_path, cuts):
    rows = entries()
    want = sorted(map(tuple, transitions.checked(spark.createDataFrame(rows, LOG), Catalog()).collect()), key=repr)
    assert len(want) == len(rows) and {(p or "").split(" ")[0] for *_, p in want} >= {"", "begins", "leaves", "new", "timestamp", "source", "num"}
    assert streamed(spark, rows, LOG, cuts, lambda s: stateful.checked(s, Catalog()), "checked", tmp_path) == want


def test_entries_by_hand(spark):
    rows = [("2026-01-01T00:00:00Z", "-", "Queued", "cli", "1", "", 0), ("2026-01-02T00:00:00Z", "pending", "legit", "cli", "1", "", 1), ("2026-01-03T00:00:00Z", "Cleared", "Queued", "cli", "1", "", 2), ("2026-01-04T00:00:00Z", "Cleared", "Queued", "cli", "1", "", 3), ("2026-01-05T00:00:00Z", "Queued", "odd", "cli", "1", "", 4), ("2026-01-06T00:00:00Z", "Queued", "Followup", "cli", "2", "", 5)]
    got = transitions.checked(spark.createDataFrame(rows, LOG), Catalog()).orderBy("pos").collect()
    assert [(r.status, r.problem) for r in got] == [("Queued", None), ("Cleared", None), ("Queued", "leaves Cleared"), ("Queued", "begins at Cleared instead of Queued"), ("Queued", 'new "odd" is none'), ("Followup", "begins at Queued instead of -")]
    assert transitions.checked(spark.createDataFrame([], LOG), Catalog()).count() == 0


def test_an_entry_that_comes_late_moves_nothing(spark, tmp_path):
    rows = [("2026-01-01T00:00:00Z", "-", "Queued", "cli", "1", "", 5), ("2026-01-02T00:00:00Z", "-", "Cleared", "cli", "1", "", 3)]
    got = streamed(spark, rows, LOG, [1], lambda s: stateful.checked(s, Catalog()), "late", tmp_path)
    assert [(r[1], r[4], r[5]) for r in got] == [(3, "Queued", "comes after entry 5"), (5, "Queued", None)]


def brute(events, days=7):
    out, held = [], {}
    ends = timedelta(days=days)
    for label, kind, at, _ in sorted(events, key=lambda e: (e[2], e[3])):
        if label in held and at >= held[label] + ends:
            out.append((label, "expired", held.pop(label) + ends))
        if kind == "reserve":
            out.append((label, "refused" if label in held else "reserved", at))
            held.setdefault(label, at)
        else:
            out.append((label, "released" if held.pop(label, None) else "refused", at))
    last = max(e[2] for e in events) - timedelta(seconds=1)
    out += [(label, "expired", at + ends) for label, at in held.items() if at + ends <= last]
    return sorted((a, b, c.replace(tzinfo=None)) for a, b, c in out)


@pytest.mark.parametrize("cuts", [[], [60], [1, 40, 41, 119]])
def test_reservations_of_any_split(spark, tmp_path, cuts):
    rng = random.Random(7)
    events, at = [], DAY
    for pos in range(120):
        at += timedelta(hours=rng.choice([0, 1, 5, 40]), milliseconds=rng.randint(0, 3))
        events.append((f"{rng.randint(1, 6):03d}", rng.choice(["reserve", "reserve", "release"]), at, pos))
    # exactly seven days later is over
    events += [("100", "reserve", at, 200), ("100", "release", at + timedelta(days=7), 201), ("101", "reserve", at + timedelta(days=7), 202)]
    want = brute(events)
    df = spark.createDataFrame(events, EVENTS)
    assert sorted(map(tuple, transitions.happened(df).collect())) == want
    assert {e for _, e, _ in want} == {"reserved", "released", "expired", "refused"}
    assert sorted(streamed(spark, events, EVENTS, cuts, stateful.happened, "happened", tmp_path)) == want
