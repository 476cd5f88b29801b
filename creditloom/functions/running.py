"""Running sums over keys of any size: totals per block of the order, then a short sum inside each block."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running_sum(df: DataFrame, key: list[str], order: list[str], block: Column, value: Column, out: str) -> DataFrame:
    """Sum of ``value`` over the rows of the key up to and including each row.

    ``block`` must not decrease with the order. A window over a whole key sees one row per block only.
    """
    tagged = df.withColumn("_blk", block).withColumn("_val", value)
    totals = tagged.groupBy(*key, "_blk").agg(F.sum("_val").alias("_tot"))
    w = Window.partitionBy(*key).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.withColumn("_base", F.coalesce(F.sum("_tot").over(w), F.lit(0))).drop("_tot")
    inside = Window.partitionBy(*key, "_blk").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return tagged.join(base, [*key, "_blk"]).withColumn(out, F.col("_base") + F.sum("_val").over(inside)).drop("_blk", "_val", "_base")
