"""Shared helpers of the training-data operators."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The letters that the text contracts lower-case, and nothing else.
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"

#: Lists of ids up to this many rows (16 MB of longs) may be broadcast; longer ones are shuffled.
BROADCAST_IDS = 1_000_000
#: A key is hot if it has more than one row of so many, and more than HOT_ROWS rows: there are fewer than HOT_SHARE hot keys.
HOT_SHARE, HOT_ROWS = 500, 100
#: Rows that go to a Python worker at once, at most: texts can be long, and both sides hold a batch, the JVM outside its heap.
BATCH_ROWS = 500
#: Spark's setting that removes the shuffle files of a query when it ends.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where it is unset and all run in one process.

    On a cluster a folder of our own would be a different one on each machine, so an unset one raises there.
    """
    context = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not path:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="pitchloom-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(path)
    return path.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """df as a table in the shared folder, read back, and its path.

    The shuffle files behind a table are of no use once it is written, so Spark removes them when the write ends.
    """
    spark, path = df.sparkSession, scratch(df.sparkSession, name)
    before = spark.conf.get(CLEAN_UP, None)
    spark.conf.set(CLEAN_UP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(CLEAN_UP)
        else:
            spark.conf.set(CLEAN_UP, before)
    return spark.read.schema(df.schema).parquet(path), path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there, and a lost executor costs nothing."""
    return stored(df, name)[0]


def remove(spark: SparkSession, *paths: str) -> None:
    """Delete tables that ``stored`` wrote and no later step reads."""
    for path in paths:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(df: DataFrame) -> DataFrame:
    """df, after lowering its session's Arrow batches to BATCH_ROWS rows where they are larger; results don't depend on it."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(df.sparkSession.conf.get(key)) <= BATCH_ROWS:
        df.sparkSession.conf.set(key, str(BATCH_ROWS))
    return df


def utf8(column: pa.Array) -> Iterator[bytes | None]:
    """The texts of an Arrow column in UTF-8, one at a time."""
    return (x.as_py() for x in column.cast(pa.binary()))


def release() -> None:
    """Give freed memory back to the system: Python workers stay alive between stages."""
    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def look_up(big: DataFrame, small: DataFrame, on: str, value: str, spread: str, total: int | None = None) -> DataFrame:
    """big with the column ``value`` of small (columns on, value and n, the rows that big has for the key), null where it has none.

    Hot keys are broadcast, fewer than HOT_SHARE rows by their definition; their rows are dealt by a hash of ``spread``,
    so no task gathers a hot key. The other keys meet in a shuffle join. total is the number of rows of big, or more, if known.
    """
    small = small.select(F.col(on).alias("__on"), F.col(value).alias("__value"), "n")
    if total is None:
        small = materialize(small, "keys")
        total = small.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    is_hot = (F.col("n") * HOT_SHARE > total) & (F.col("n") > HOT_ROWS)
    hot = F.broadcast(small.where(is_hot).select("__on", F.struct("__value").alias("__hot")))
    cold = small.where(~is_hot).select("__on", F.lit(0).alias("__plain"), F.col("__value").alias("__cold"))
    marked = big.join(hot, F.col(on) == F.col("__on"), "left").drop("__on")
    marked = marked.withColumn("__salt", F.when(F.col("__hot").isNotNull(), 1 + F.pmod(F.xxhash64(spread), F.lit(1000))).otherwise(0).cast("int"))
    found = marked.join(cold.hint("merge"), (F.col(on) == F.col("__on")) & (F.col("__salt") == F.col("__plain")), "left")
    return found.select(*big.columns, F.coalesce("__hot.__value", "__cold").alias(value))


def lower_az(column):
    """Lower-case A-Z only."""
    return F.translate(column, UPPER, LOWER)


def text_key(text="text"):
    """A hash that tells versions of a document apart, next to its doc_id."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def without_rows(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """Rows of docs whose (doc_id, text_key()) is not in gone (doc_id, __key; null-safe).

    The list is broadcast only if its counted size is within BROADCAST_IDS; else both sides are shuffled by it.
    """
    gone = materialize(gone.select(F.col("doc_id").alias("__id"), F.col("__key").alias("__hash")), "gone")
    if gone.count() <= BROADCAST_IDS:
        gone = F.broadcast(gone)
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["__id"]) & (text_key() == gone["__hash"]), "left_anti")
