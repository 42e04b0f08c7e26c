"""Incremental scans as a stream: each micro-batch is checked against the history table and appended to it.

The history lies in ``batch=N/bucket=B``: a batch's own folder, in it a folder for each bucket of keys by hash. A batch reads only the buckets that its
keys fall in, and their files are sorted by key and hold Bloom filters, for Spark's readers to skip by.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import scan
from ..operators.identity import first_wins
from ..sources import boards, jobboard
from ..sources.listings import exists

BUCKETS = 256


def bucket(key: Column, buckets: int = BUCKETS) -> Column:
    """A null key has a bucket too."""
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def append(new: DataFrame, table: str, number: int, key: str) -> None:
    """The batch's rows, in place of what it wrote before."""
    rows = new.withColumn("bucket", bucket(F.col(key))).repartition("bucket").sortWithinPartitions("bucket", key)
    rows.write.partitionBy("bucket").option(f"parquet.bloom.filter.enabled#{key}", "true").mode("overwrite").parquet(f"{table}/batch={number}")


def may_match(spark: SparkSession, table: str, new: DataFrame, key: str, number: int) -> DataFrame | None:
    """The rows of other batches in the buckets that the new rows' keys fall in (BUCKETS numbers at most reach the driver); None without a table."""
    if not exists(spark, table):
        return None
    touched = [r.b for r in new.select(bucket(F.col(key)).alias("b")).distinct().collect()]
    return spark.read.option("mergeSchema", "false").parquet(table).filter(F.col("bucket").isin(touched) & (F.col("batch") != number))


def unknown(new: DataFrame, known: DataFrame | None, key: str) -> DataFrame:
    """Rows whose key isn't known; null is a key like others."""
    if known is None:
        return new
    seen = known.select(F.col(key).alias("_seen"), "bucket").distinct()
    mark = F.struct(F.col(key).isNull().alias("none"), F.coalesce(F.col(key).cast("string"), F.lit("")).alias("key"))
    seen = seen.select(F.struct(F.col("_seen").isNull().alias("none"), F.coalesce(F.col("_seen").cast("string"), F.lit("")).alias("key")).alias("_mark"))
    return new.withColumn("_mark", mark).join(seen, "_mark", "left_anti").drop("_mark")


def dedup_stream(postings: DataFrame, history: str, checkpoint: str, key: str, order: str) -> StreamingQuery:
    """New keys of each batch, the first of each, go to the Parquet table ``history`` with their batch number and bucket.

    A batch that runs again after a failure leaves the table as it was: rows of its own number don't count as history,
    and its partition is overwritten. The null key is one key: its first row is kept, once.
    """

    def batch(df: DataFrame, number: int) -> None:
        spark: SparkSession = df.sparkSession
        new = first_wins(df, key, order, order).filter("duplicate_of is null").drop("duplicate_of").dropDuplicates([key])
        append(unknown(new, may_match(spark, history, new, key, number), key), history, number, key)

    return postings.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def scan_stream(answers: DataFrame, history: str, checkpoint: str, known: tuple[boards.Board, ...] = boards.BOARDS, **trigger) -> StreamingQuery:
    """Rounds of boards (``jobboard.stream``) as a scan that goes on: new postings, with their status and ``url_norm``, go to ``history`` once.

    Within a round entries count in their order and postings in theirs. A posting that a filter holds back counts as seen, as in a scan of a workspace.
    """

    def batch(df: DataFrame, number: int) -> None:
        spark: SparkSession = df.sparkSession
        # what an earlier batch has seen, by its URLs' identities, which the scan takes from the URLs again
        among = {r.board for r in df.select("board").distinct().collect()}  # of the boards there are
        told = scan.scanned(jobboard.postings(df, among, known), spark.createDataFrame([], "url string"))
        new = told.filter(F.col("status").isin("added", "skipped_title", "skipped_location")).drop("title_terms", "location_terms")
        append(unknown(new, may_match(spark, history, new, "url_norm", number), "url_norm"), history, number, "url_norm")

    return answers.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
