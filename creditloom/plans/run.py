"""Tables a replay run leaves behind, written once per session and read by everything downstream.

A replay writes its answers and module results; evaluation, queues and pricing read those tables instead of deciding
the book again. The tables live in the cluster's shared checkpoint folder, so they survive lost executors, and reading
them cuts the lineage of every later query.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from creditloom.session import ensure_checkpoint_dir
from creditloom.sources.tables import table

#: Input tables that the loan book and its runs are made of.
SOURCES = ("customer", "nation", "region", "orders", "lineitem", "events", "conversations")

_WRITTEN: dict[tuple, str] = {}


def fingerprint(spark: SparkSession, folder: str) -> int:
    """A checksum of the input files' names, sizes and times: a changed input is another run."""
    total = 0
    for name in SOURCES:
        meta = table(spark, folder, name).select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct()
        total ^= meta.agg(F.coalesce(F.bit_xor(F.xxhash64("file_path", "file_size", "file_modification_time")), F.lit(0))).first()[0]
    return total


def run_table(spark: SparkSession, folder: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """Read the named table of this session's run over ``folder``, writing it first if no query has yet."""
    key = (spark.sparkContext.applicationId, folder, fingerprint(spark, folder), name)
    if key not in _WRITTEN:
        root = ensure_checkpoint_dir(spark).rstrip("/")
        path = f"{root}/run-{uuid.uuid4().hex}/{name}"
        build().write.mode("errorifexists").parquet(path)
        _WRITTEN[key] = path
    return spark.read.parquet(_WRITTEN[key])
