"""Registry of named queries: the Spark form and, where one exists, the ANSI SQL that checks it."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from creditloom.oracle import decisions, judging  # noqa: F401  (registers the views)
from creditloom.oracle.views import compose
from creditloom.session import tune

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def stable_types(df: DataFrame) -> DataFrame:
    """Widen counters and narrow floats to the types every engine shares."""
    out = []
    for f in df.schema.fields:
        col = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            col = col.cast("bigint").alias(f.name)
        elif isinstance(f.dataType, (T.FloatType, T.DecimalType)):
            col = col.cast("double").alias(f.name)
        out.append(col)
    return df.select(*out)


def query(name: str, sql: str | None = None, needs: str = ""):
    """Register a query function under ``name`` with its oracle SQL over the named views."""
    def wrap(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")

        @functools.wraps(fn)
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return stable_types(fn(tune(spark), folder))

        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = compose(needs, sql)
        return fn

    return wrap
