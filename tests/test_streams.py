import json
import os

import pytest
from pyspark.sql import functions as F

from findings_engine.operators.states import Catalog
from findings_engine.sources import jobboard
from findings_engine.streaming import history, ingest

LABELS = ("num", "date", "title", "source", "url", "risk", "confidence", "status", "report")


def addition(folder, name, *cells):
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/{name}", "w") as f:
        f.write("\t".join(LABELS) + "\n" + "\t".join(cells) + "\n")


def row(num, url, risk="—"):
    return num, "2026-10-08", "T", "s", url, risk, "—", "Queued", "—"


def test_additions_are_merged_once(spark, tmp_path):
    folder, table, refused = (str(tmp_path / n) for n in ("in", "table", "refused"))
    run = lambda: ingest.merge_stream(ingest.additions(spark, folder, str(tmp_path / "done")), table, refused, str(tmp_path / "cp"), Catalog()).awaitTermination(60)
    addition(folder, "1.tsv", *row("1", "https://a.b/1"))
    addition(folder, "2.tsv", *row("2", "https://a.b/2", "Extreme"))
    run()
    addition(folder, "3.tsv", *row("3", "https://A.b/1?utm_source=x"))
    addition(folder, "4.tsv", *row("4", "https://a.b/4"))
    addition(folder, "5.tsv", *row("5", "https://a.b/4/"))
    run()
    assert sorted(r.num for r in spark.read.parquet(table).collect()) == ["1", "4"]
    assert [r.name for r in spark.read.parquet(refused).collect()] == ["2.tsv"]
    # what is known already is told too, by the number it repeats
    assert sorted((r.name, r.duplicate_of) for r in spark.read.parquet(f"{refused}-skipped").collect()) == [("3.tsv", "1"), ("5.tsv", "4")]


def test_history_of_null_keys_and_buckets(spark, tmp_path):
    """The null key enters once, and a batch reads only the buckets that its keys fall in."""
    source, table = str(tmp_path / "in"), str(tmp_path / "history")
    schema = "key string, pos long"
    first = [(f"k{n}", n) for n in range(300)] + [(None, 900), (None, 901)]
    for rows in (first, [(None, 902), ("k7", 903), ("new", 904)], [(None, 905), ("new", 906)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        history.dedup_stream(spark.readStream.schema(schema).parquet(source), table, str(tmp_path / "cp"), "key", "pos").awaitTermination(60)
    got = spark.read.parquet(table).collect()
    assert len(got) == 302 and sum(r.key is None for r in got) == 1 and {r.pos for r in got if r.key in (None, "new", "k7")} == {900, 904, 7}
    one = spark.createDataFrame([("k7", 1)], schema)
    known = history.may_match(spark, table, one, "key", 99)
    assert 0 < known.count() < 30 and "PartitionFilters: [isnotnull(bucket" in known._jdf.queryExecution().executedPlan().toString().replace("  ", " ")


class Changing(jobboard.JobBoards):
    """Each round of the stub board has two postings of its own and one that stays; what is asked is written down."""

    def transport(self):
        log = self.options["log"]

        def answer(url, timeout, headers, method):
            with open(log, "a") as f:
                f.write(url + "\n")
            with open(log) as f:
                n = len(f.readlines())
            if "down" in url:
                return jobboard.Response(500)
            own = [{"title": f"Job {n}-{k}", "hostedUrl": f"https://a.b/{n}/{k}"} for k in (1, 2)]
            return jobboard.Response(200, json.dumps([{"title": "Always", "hostedUrl": "https://a.b/always"}, *own]).encode())

        return jobboard.Transport(jobboard.Guard(lookup=lambda host: ["93.184.216.34"]), request=answer)


def test_boards_as_a_stream(spark, tmp_path):
    """Each posting once through rounds and restarts; a batch that dies is run again with the answers it had."""
    entries = [{"name": "A", "integration": "lever", "company": "a"}, {"name": "off", "enabled": False}, {"name": "B", "integration": "lever", "company": "down"}]
    table, log, kept = str(tmp_path / "history"), str(tmp_path / "log"), str(tmp_path / "kept")

    def rounds(fail=False):
        spark.dataSource.register(Changing)
        rows = spark.readStream.format("jobboard").option("entries", json.dumps(entries)).option("kept", kept).option("every", "0.001").option("log", log).load()
        if not fail:
            history.scan_stream(rows, table, str(tmp_path / "cp")).awaitTermination(60)
            return
        def dies(df, number):
            df.collect()
            raise RuntimeError("killed")

        with pytest.raises(Exception, match="killed"):
            rows.writeStream.foreachBatch(dies).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(60)

    asked = lambda: len(open(log).readlines())  # noqa: E731, SIM115
    rounds()
    before = asked()
    first = {r.url_norm for r in spark.read.parquet(table).collect()}
    assert len(first) == 3 and "https://a.b/always" in first
    rounds(fail=True)
    died = asked()
    assert died == before + 2 and os.listdir(kept)
    rounds()  # the batch that died, from its kept answers, and no later round in the same run or one
    rows = spark.read.parquet(table).collect()
    urls = [r.url_norm for r in rows]
    assert len(urls) == len(set(urls)) and f"https://a.b/{died - 1}/1" in urls or f"https://a.b/{died}/1" in urls
    replayed = {f"https://a.b/{n}/{k}" for n in (died - 1, died) for k in (1, 2)} & set(urls)
    assert len(replayed) == 2
    rounds()
    rows = spark.read.parquet(table).collect()
    assert len({r.url_norm for r in rows}) == len(rows) and sum(r.url_norm.endswith("always") for r in rows) == 1 and len(rows) % 2 == 1


def collected(stream, mode, tmp_path, name):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination(60)


def test_states_and_windows(spark, tmp_path):
    rows = [("2026-01-01T00:00:00Z", "Queued", "1"), ("2026-01-03T00:00:00Z", "Cleared", "1"), ("2026-01-02T00:00:00Z", "Analyzed", "1"), ("2026-01-01T00:00:00Z", "Queued", "2")]
    schema = "timestamp string, new string, num string"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "log"))
    log = spark.readStream.schema(schema).parquet(str(tmp_path / "log"))
    collected(ingest.current_states(log), "complete", tmp_path, "now_states")
    assert sorted((r.num, r.status) for r in spark.table("now_states").collect()) == [("1", "Cleared"), ("2", "Queued")]
    timed = log.withColumn("at", F.to_timestamp("timestamp"))
    collected(ingest.fresh(timed, "num", "at", "7 days"), "append", tmp_path, "fresh_rows")
    assert sorted(r.num for r in spark.table("fresh_rows").collect()) == ["1", "2"]
    collected(ingest.counted(timed, "at", "1 day", "0 days", "num"), "append", tmp_path, "windows")
    assert {(r.start.day, r.num, r.n) for r in spark.table("windows").collect()} <= {(1, "1", 1), (1, "2", 1), (2, "1", 1), (3, "1", 1)}
