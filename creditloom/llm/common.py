"""Helpers shared by the operators: input tables, tables staged in the shared folder, joins of checked size."""

from __future__ import annotations

import gc
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A side with at most so many rows of a few numbers (about 50 bytes each, 25 MB) may be broadcast; above it joins shuffle.
BROADCAST_ROWS = 500_000
#: Bounds of one Arrow batch, so that very long texts do not pile up in a Python worker.
BATCH_ROWS, BATCH_BYTES = 2000, 32 << 20


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches that Python workers get."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``, or a folder of this machine where it is unset (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the lineage is cut and a lost executor loses nothing of it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/llm-{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame) -> DataFrame:
    """The rows with a number of their own, ``__row``, stored so that every pass over them sees the same one."""
    return staged(df.withColumn("__row", F.monotonically_increasing_id()), "numbered")


def sized(df: DataFrame, rows: int) -> DataFrame:
    """Hint a broadcast only where the counted rows allow it."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def lookup(left: DataFrame, right: DataFrame, rows: int, on: str, how: str = "left") -> DataFrame:
    """Join ``left`` to ``right``, which has at most ``rows`` rows and each key once.

    A small right side is broadcast. Otherwise the sides are shuffled, and adaptive execution splits the partition of a
    key that holds many rows of the left side, so that no task reads them all.
    """
    return left.join(sized(right, rows), on, how)


def positions(rows: DataFrame, group: list[str], order: list[str], name: str) -> DataFrame:
    """Add ``pos`` (from 0 inside each group) and ``n`` (rows of the group) by the order of the columns ``group``, ``order``.

    Rows are range-partitioned and counted per group and partition; a row number is the last sort key, so that a group, an
    id or equal rows of any number spread over the partitions. Nulls come first; a group column must not be null.
    """
    keys = [F.col(k).asc_nulls_first() for k in [*group, *order, "__tie"]]
    dealt = rows.withColumn("__tie", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys).drop("__tie")
    dealt = dealt.withColumn("__part", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    dealt = staged(dealt, name)
    runs = dealt.groupBy(*group, "__part").agg(F.min("__at").alias("__first"), F.count(F.lit(1)).alias("__rows"))
    whole = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))  # one row per partition and group
    before = F.coalesce(F.sum("__rows").over(whole.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = staged(runs.select(*group, "__part", (before - F.col("__first")).alias("__shift"), F.sum("__rows").over(whole).alias("n")), f"{name}_runs")
    placed = dealt.join(sized(runs, runs.count()), [*group, "__part"])
    return placed.withColumn("pos", F.col("__at") + F.col("__shift")).drop("__part", "__at", "__shift")


_MODEL: dict[tuple, object] = {}


def model(key: tuple, build):
    """The Python worker's model of ``key``. A worker holds one at a time: Spark reuses workers, and a stage needs no model of
    the stages before it."""
    if key not in _MODEL:
        _MODEL.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        _MODEL[key] = build()
    return _MODEL[key]


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(f"`{column}`").cast("string"), F.lit(""))


def held(doc_id: str, parts: int, part: int) -> Column:
    """Whether crc32 of the id as text leaves ``part`` when divided by ``parts``; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % parts == part, F.lit(False))
