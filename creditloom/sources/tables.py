"""Access to the input tables and to the small constant tables built from fixed values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One input table. Readers select the columns they use, so the scan stays pruned."""
    if name not in TABLES:
        raise ValueError(f"unknown input table {name!r}")
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _literal(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, (list, tuple)):
        return "array(" + ", ".join(_literal(v) for v in value) + ")"
    if isinstance(value, str):
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return f"{value}D" if isinstance(value, float) else str(value)


def inline(spark: SparkSession, rows, columns: str) -> DataFrame:
    """A constant table as inline VALUES with ``columns`` given as ``name type, ...``.

    Inline rows become a local relation whose size the optimizer knows, so joins against it broadcast because the
    size is proven, not because of a hint.
    """
    specs = [c.strip().split(" ", 1) for c in columns.split(";")]
    names = ", ".join(n for n, _ in specs)
    casts = ", ".join(f"CAST({n} AS {t}) AS {n}" for n, t in specs)
    body = ", ".join("(" + ", ".join(_literal(v) for v in row) + ")" for row in rows)
    return spark.sql(f"SELECT {casts} FROM VALUES {body} AS t({names})")
