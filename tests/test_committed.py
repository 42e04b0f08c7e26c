"""Runs that are published whole or not at all, whatever dies on the way."""

import os

import pytest
from pyspark.sql import functions as F

from findings_engine.sinks import committed
from findings_engine.sinks.committed import RunFiles, Writer, publish, recover

HEADERS = {"data/history.tsv": "n\ttext", "log.tsv": "t"}


class DyingTask(RunFiles):
    """The last partition's task dies in the middle of its rows."""

    @classmethod
    def name(cls):
        return "dyingtask"

    def writer(self, schema, overwrite):
        class Dying(Writer):
            def write(self, iterator):
                from pyspark import TaskContext

                if TaskContext.get().partitionId() == 2:
                    committed.stage(self.root, self.run, 2, iterator)
                    raise RuntimeError("killed")
                return super().write(iterator)

        return Dying(self.options)


def dying_commit(after: int):
    class DyingCommit(RunFiles):
        """The committer dies after so many steps; 0 is before the journal."""

        @classmethod
        def name(cls):
            return f"dyingcommit{after}"

        def writer(self, schema, overwrite):
            class Dying(Writer):
                def commit(self, messages):
                    if after == 0:
                        raise RuntimeError("killed")
                    journal = committed.begin(self.root, self.run, [m for m in messages if m], self.headers)
                    for n, _ in enumerate(committed.steps(self.root, journal), 2):
                        if n >= after:
                            raise RuntimeError("killed")

            return Dying(self.options)

    return DyingCommit


def rows_of(spark, run, n=60):
    """Files, appended lines in an order that spans partitions, and a replaced file."""
    base = spark.range(n).repartition(5)
    files = base.filter("id < 7").select(F.lit("file").alias("kind"), F.format_string(f"data/additions/%03d-{run}.tsv", "id").alias("path"), F.col("id").alias("place"), F.format_string("body %d\n", "id").alias("line"))
    history = committed.lines(base.select(F.col("id").alias("place"), "id", F.lit(f"{run}\tx\ny").alias("text")), "append", "data/history.tsv", ("id", "text"), ["place"])
    log = spark.createDataFrame([("append", "log.tsv", 0, run)], "kind string, path string, place long, line string")
    state = base.select(F.lit("replace").alias("kind"), F.lit("state.md").alias("path"), F.col("id").alias("place"), F.concat(F.lit(f"{run} "), "id").alias("line"))
    return files.union(history).union(log).union(state)


def seen(root):
    """Everything under the root but the runs' own folder."""
    out = {}
    for folder, _, names in os.walk(root):
        for name in names:
            path = os.path.relpath(os.path.join(folder, name), root)
            if not path.startswith(committed.RUNS):
                with open(os.path.join(folder, name)) as f:
                    out[path] = f.read()
    return out


def wanted(runs, n=60):
    out = {f"data/additions/{k:03d}-{run}.tsv": f"body {k}\n" for run in runs for k in range(min(7, n))}
    out["data/history.tsv"] = "n\ttext\n" + "".join(f"{k}\t{run} x y\n" for run in runs for k in range(n))
    out["log.tsv"] = "t\n" + "".join(f"{run}\n" for run in runs)
    out["state.md"] = "".join(f"{runs[-1]} {k}\n" for k in range(n))
    return out


@pytest.fixture
def root(spark, tmp_path):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else a few rows are one task
    yield str(tmp_path / "root")
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_runs_are_published(spark, root):
    for name in ("one", "two"):
        publish(rows_of(spark, name), root, name, ["place"], HEADERS)
    assert seen(root) == wanted(["one", "two"])
    assert recover(root) == [] and seen(root) == wanted(["one", "two"])
    publish(rows_of(spark, "none").limit(0), root, "none", ["place"], HEADERS)
    assert seen(root) == wanted(["one", "two"]) and os.listdir(f"{root}/{committed.RUNS}") == []


def test_a_task_dies(spark, root):
    publish(rows_of(spark, "one"), root, "one", ["place"], HEADERS)
    with pytest.raises(Exception, match="killed"):
        publish(rows_of(spark, "two"), root, "two", ["place"], HEADERS, DyingTask)
    assert seen(root) == wanted(["one"])
    assert recover(root) == [] and seen(root) == wanted(["one"]) and os.listdir(f"{root}/{committed.RUNS}") == []
    publish(rows_of(spark, "two"), root, "two", ["place"], HEADERS)
    assert seen(root) == wanted(["one", "two"])


@pytest.mark.parametrize("after", [0, 1, 2, 5, 9, 10, 11, 12])
def test_the_commit_dies(spark, root, after):
    """Before the journal nothing is there, after it everything once recovered, and a second time."""
    publish(rows_of(spark, "one"), root, "one", ["place"], HEADERS)
    if after == 1:
        after = 2  # the journal alone: no step is done
        source = dying_commit(2)
    source = dying_commit(after)
    with pytest.raises(Exception, match="killed"):
        publish(rows_of(spark, "two"), root, "two", ["place"], HEADERS, source)
    recover(root)
    assert seen(root) == wanted(["one"] if after == 0 else ["one", "two"])
    assert recover(root) == []
    publish(rows_of(spark, "three"), root, "three", ["place"], HEADERS)
    assert seen(root) == wanted(["one", "three"] if after == 0 else ["one", "two", "three"])


def test_appends_are_undone_before_they_are_done_again(tmp_path):
    """A committer that dies in the middle of an append leaves half of it; the next try begins where the file ended before."""
    root = tmp_path / "root"
    root.mkdir()
    (root / "log.tsv").write_text("t\nold\n")
    part = root / committed.RUNS / "r" / "0-x" / "append"
    part.mkdir(parents=True)
    (part / "log.tsv").write_text("new\n")
    journal = committed.begin(str(root), "r", [committed.Attempt(0, "0-x", 0, {"append": ["log.tsv"]})], {"log.tsv": "t"})
    (root / "log.tsv").write_text("t\nold\nne")
    assert recover(str(root)) == ["r"] and (root / "log.tsv").read_text() == "t\nold\nnew\n"
    assert journal["lines"][0]["before"] == 6


def test_paths_stay_under_the_root(spark, root):
    for path in ("../x", "/etc/x", "a/../../x", "", ".runs/x"):
        rows = spark.createDataFrame([("file", path, 0, "x")], "kind string, path string, place long, line string")
        with pytest.raises(Exception, match="no path under the root"):
            publish(rows, root, "bad", ["place"])
    with pytest.raises(Exception, match="no kind of row"):
        publish(spark.createDataFrame([("odd", "x", 0, "x")], "kind string, path string, place long, line string"), root, "bad", ["place"])
    assert seen(root) == {}
