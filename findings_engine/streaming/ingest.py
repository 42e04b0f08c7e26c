"""Files and logs as streams: additions that are archived once read, the state of each row, and what is known for a time only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import merge, tracker
from ..operators.states import Catalog
from ..sources import listings, tsv
from . import history


def additions(spark: SparkSession, folder: str, archive: str | None = None, files: int = 1000) -> DataFrame:
    """Pending additions as they arrive: name, path, the columns, errors, bound. Read files move to ``archive`` (outside the folder) if given."""
    reader = spark.readStream.format("text").schema("value string").option("wholetext", "true").option("pathGlobFilter", "*.tsv").option("maxFilesPerTrigger", files)
    if archive:
        reader = reader.option("cleanSource", "archive").option("sourceArchiveDir", archive)
    texts = reader.load(folder).select(listings.plain_path(F.col("_metadata.file_path")).alias("path"), F.col("value").alias("text"))
    return tsv.parse(texts).withColumn("name", F.substring_index("path", "/", -1))


def merge_stream(pending: DataFrame, table: str, refused: str, checkpoint: str, catalog: Catalog, skipped: str | None = None) -> StreamingQuery:
    """Each micro-batch is merged into the Parquet table of findings: new identities are appended, files with errors go to ``refused``,
    those of known identities, with the number that they repeat, to ``skipped`` (beside ``refused``, if not given).

    A batch that runs again overwrites its own partition and doesn't see it as known, so it leaves the tables as they were. It reads only
    the buckets of findings that its identities fall in.
    """
    skipped = skipped or f"{refused.rstrip('/')}-skipped"

    def batch(df: DataFrame, number: int) -> None:
        spark = df.sparkSession
        wrong = merge.errors_of(df, catalog)
        good = df.join(wrong.select("name").distinct(), "name", "left_anti")
        keys = tracker.canonical(good.filter("bound"), catalog).select(tracker.identity_key().alias("key"))
        known = history.may_match(spark, table, keys, "key", number)
        if known is None:
            known = spark.createDataFrame([], ", ".join(f"{c} string" for c in merge.COLUMNS) + ", pos int")
        else:
            known = known.withColumn("pos", F.struct("batch", "name")).drop("key", "bucket")
        done = merge.merged(known, good, catalog)
        history.append(done.accepted.select(*merge.COLUMNS, "name", "key"), table, number, "key")
        wrong.write.mode("overwrite").parquet(f"{refused}/batch={number}")
        done.skipped.select("name", "num", "duplicate_of").write.mode("overwrite").parquet(f"{skipped}/batch={number}")

    return pending.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_states(log: DataFrame) -> DataFrame:
    """(num, status, since) from a stream of the status log (timestamp, new, num): the latest entry of each number, for update mode."""
    at = F.try_to_timestamp(F.col("timestamp"))
    return log.groupBy("num").agg(F.max_by("new", F.struct(at.alias("at"), "new")).alias("status"), F.max(at).alias("since"))


def fresh(rows: DataFrame, key: str, time: str, keep: str) -> DataFrame:
    """The first row of each key, forgotten after ``keep``: the state holds what came within that time, and no more."""
    return rows.withWatermark(time, keep).dropDuplicatesWithinWatermark([key])


def counted(rows: DataFrame, time: str, width: str, late: str, by: str) -> DataFrame:
    """Rows by window of time and ``by``, final once ``late`` has passed."""
    return rows.withWatermark(time, late).groupBy(F.window(time, width), by).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), by, "n")
