"""Shared pieces: table access, tables written to the cluster's shared folder, bounded samples."""

from __future__ import annotations

import atexit
import ctypes
import gc
import re
import sys
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, suppress

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of labels that decide a fold: crc32 of the decimal doc_id, modulo this; fold 1 is held out.
FOLDS, HELD_OUT_FOLD = 3, 1
#: Bytes of a shuffle's partition; from so many partitions on, partitions grow up to the larger size.
PARTITION_BYTES, MANY, MOST_PARTITION_BYTES = 16 << 20, 20_000, 256 << 20
#: Rows that a worker turns into Python values at a time.
PIECE_ROWS = 512
#: Longer words and parts of texts are worked out anew each time, so that what a worker remembers stays small.
REMEMBERED_CHARS = 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see: ``spark.checkpoint.dir``. Where that is unset, a temporary one, if all runs on this machine."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        path = tempfile.mkdtemp(prefix="shared-")
        spark.conf.set("spark.checkpoint.dir", path)
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def written(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    This cuts the lineage: a lost executor costs a reread, and an expensive stage runs once however
    many jobs read it. The files go when the driver's process ends.
    """
    return written_at(df, name, compression)[0]


def written_at(df: DataFrame, name: str, compression: str = "zstd") -> tuple[DataFrame, str]:
    """``written``, and the folder, for one who removes it earlier."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    atexit.register(remove, spark, path)
    return spark.read.schema(df.schema).parquet(path), path


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that isn't needed any more."""
    try:
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
    except Exception:  # noqa: BLE001  the session is already gone; its folder goes with it
        pass


def drop_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of queries that are over: it does when the driver collects its garbage, which may be never before the disks are full."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


#: While tables are written one after the other: batches for Python of few bytes.
FRUGAL = {"spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20)}


@contextmanager
def frugal(spark: SparkSession) -> Iterator[None]:
    """Queries that run inside hold batches of few bytes; the session's own settings come back. Not for queries that run later."""
    before = {name: spark.conf.get(name, None) for name in FRUGAL}
    for name, value in FRUGAL.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def bytes_of(df: DataFrame) -> int:
    """The size of the files of a written table, as the planner has it."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def partitions_for(spark: SparkSession, size: int) -> int:
    """Partitions for a shuffle of so many bytes: PARTITION_BYTES each, more from MANY partitions on, the session's number at least."""
    wanted = max(min(size // PARTITION_BYTES, MANY), size // MOST_PARTITION_BYTES)
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), wanted, 1)


def free_name(name: str, taken: list[str]) -> str:
    """The name, with underscores behind it until no column has it (names differ by more than case)."""
    lower = {c.lower() for c in taken}
    while name.lower() in lower:
        name += "_"
    return name


def fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS


def held_out(doc_id: Column) -> Column:
    """Null ids are in no fold and count as not held out."""
    return F.coalesce(fold(doc_id) == HELD_OUT_FOLD, F.lit(False))


def bounded_sample(df: DataFrame, key: str, rows: int) -> DataFrame:
    """The ``rows`` rows whose hashed key is smallest: the same ones for any partitioning."""
    return df.orderBy(F.xxhash64(key, F.lit(20)), key).limit(rows)


def forget() -> None:
    """Drop the vocabularies that another operator's tasks left in this worker, and give their memory back to the machine."""
    held = [m.load for name in ("byte_vocab", "merge_vocab") if (m := sys.modules.get(f"{__package__}.{name}")) and m.load.cache_info().currsize]
    for load in held:
        load.cache_clear()
    if held:
        give_back()


def give_back() -> None:
    """Give the memory that this worker doesn't use any more back to the machine; workers outlive their tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with suppress(AttributeError, OSError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)


def pieces(batches, rows: int = PIECE_ROWS):
    """The batches in pieces, so that a worker holds the Python values of a few rows at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def texts(batch, column: str) -> Iterator[str]:
    """The column's strings, null as empty."""
    for value in batch.column(column).to_pylist():
        yield value or ""
