"""Exact ranks, percentiles and AUC that never gather a whole group in one task.

Rows are first collapsed to a histogram of distinct values (partial aggregation shrinks hot values to one row), then
cumulative counts are taken in two levels: over a bounded number of coarse buckets per group, and inside one bucket at
a time. ``coarse`` must be a non-strictly increasing function of the sort key.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_PRECEDING = (Window.unboundedPreceding, -1)


def magnitude_bucket(v: Column) -> Column:
    """Increasing bucket number of a double: 64 buckets per power of two, so a bucket spans about one percent."""
    return F.floor(F.signum(v) * F.log2(1.0 + F.abs(v)) * 64.0).cast("bigint")


def cumulative(hist: DataFrame, group: list[str], order: list[Column], count: str, coarse: str = "coarse") -> DataFrame:
    """Adds ``before``: the sum of ``count`` over the rows of the group that sort strictly earlier.

    ``order`` sorts the histogram inside one coarse bucket. The only window over a whole group runs on its coarse
    buckets, whose number is bounded by construction.
    """
    buckets = hist.groupBy(*group, coarse).agg(F.sum(count).alias("_n"))
    w = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    offsets = buckets.withColumn("_base", F.coalesce(F.sum("_n").over(w.orderBy(coarse).rowsBetween(*_PRECEDING)), F.lit(0))).drop("_n")
    keys = [*group, coarse]
    cond = reduce(lambda a, b: a & b, [F.col(f"h.{x}").eqNullSafe(F.col(f"o.{x}")) for x in keys])
    joined = hist.alias("h").join(offsets.alias("o"), cond).select("h.*", "o._base")
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(*_PRECEDING)
    return joined.withColumn("before", F.col("_base") + F.coalesce(F.sum(count).over(inside), F.lit(0))).drop("_base")


def exact_percentiles(df: DataFrame, group: list[str], value: str, quantiles: dict[str, float]) -> DataFrame:
    """Linear-interpolation percentiles per group, equal to sorting each group but with bounded tasks."""
    if not group:
        out = exact_percentiles(df.withColumn("_all", F.lit(0)), ["_all"], value, quantiles)
        return out.drop("_all")
    v = df.filter(F.col(value).isNotNull()).select(*group, F.col(value).cast("double").alias("v"))
    hist = v.groupBy(*group, "v").agg(F.count(F.lit(1)).alias("cnt")).withColumn("coarse", magnitude_bucket(F.col("v")))
    ranked = cumulative(hist, group, [F.col("v")], "cnt")
    totals = v.groupBy(*group).agg(F.count(F.lit(1)).alias("n"))
    withn = ranked.join(totals, group)
    aggs = []
    for name, q in quantiles.items():
        pos = F.lit(q) * (F.col("n") - 1)
        for tag, at in (("lo", F.floor(pos)), ("hi", F.ceil(pos))):
            hit = (F.col("before") <= at) & (at < F.col("before") + F.col("cnt"))
            aggs.append(F.max(F.when(hit, F.col("v"))).alias(f"_{name}_{tag}"))
    out = withn.groupBy(*group).agg(F.first("n").alias("n"), *aggs)
    cols = []
    for name, q in quantiles.items():
        pos = F.lit(q) * (F.col("n") - 1)
        lo, hi = F.col(f"_{name}_lo"), F.col(f"_{name}_hi")
        cols.append((lo + (pos - F.floor(pos)) * (hi - lo)).alias(name))
    return out.select(*group, "n", *cols)


def auc(df: DataFrame, group: list[str], score: str, positive: Column) -> DataFrame:
    """Mann-Whitney AUC with tie-averaged ranks, from the histogram of distinct scores alone.

    A positive beats every negative scored below it and half of the negatives that share its score.
    """
    s = df.select(*group, F.col(score).cast("double").alias("v"), positive.cast("bigint").alias("y"))
    hist = s.groupBy(*group, "v").agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg")).withColumn(
        "coarse", magnitude_bucket(F.col("v")))
    r = cumulative(hist, group, [F.col("v")], "neg")
    won = F.sum(F.col("pos").cast("double") * (F.col("before") + F.col("neg") / 2.0))
    pos, neg = F.sum("pos").cast("double"), F.sum("neg").cast("double")
    return r.groupBy(*group).agg(
        F.sum("pos").alias("positives"), F.sum("neg").alias("negatives"),
        F.when((pos > 0) & (neg > 0), won / F.nullif(pos * neg, F.lit(0.0))).alias("auc"))


def average_ranks(df: DataFrame, value: str, out: str, weight: str) -> DataFrame:
    """Distinct values of a column with their tie-averaged rank."""
    hist = df.groupBy(F.col(value).alias("v")).agg(F.sum(weight).alias("cnt")).withColumn(
        "coarse", magnitude_bucket(F.col("v").cast("double")))
    ranked = cumulative(hist, [], [F.col("v")], "cnt")
    return ranked.select(F.col("v").alias(value), (F.col("before") + (F.col("cnt") + 1) / 2.0).alias(out))


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """Rank correlation with average ranks, over the histogram of distinct (x, y) pairs."""
    pairs = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(x, y).agg(F.count(F.lit(1)).alias("w"))
    ranked = pairs.join(average_ranks(pairs, x, "rx", "w"), x).join(average_ranks(pairs, y, "ry", "w"), y)
    w, rx, ry = F.col("w").cast("double"), F.col("rx"), F.col("ry")
    sums = ranked.agg(F.sum("w").alias("n"), F.sum(w * rx).alias("sx"), F.sum(w * ry).alias("sy"),
                      F.sum(w * rx * rx).alias("sxx"), F.sum(w * ry * ry).alias("syy"), F.sum(w * rx * ry).alias("sxy"))
    n = F.col("n").cast("double")
    cov = F.col("sxy") - F.col("sx") * F.col("sy") / n
    vx, vy = F.col("sxx") - F.col("sx") * F.col("sx") / n, F.col("syy") - F.col("sy") * F.col("sy") / n
    return sums.select("n", F.when((F.col("n") >= 2) & (vx > 0) & (vy > 0), cov / F.sqrt(F.nullif(vx * vy, F.lit(0.0)))).alias("spearman"))


def row_numbers(df: DataFrame, group: list[str], coarse: Column, fine: dict[str, Column], fine_order: list[Column],
                order: list[Column], out: str = "rank") -> DataFrame:
    """Row number inside each group for groups of any size.

    ``coarse`` and the ``fine`` columns cut the order into short runs; only one run is ever sorted in a task. A run's
    offset is the count of rows in the earlier runs of its group.
    """
    tagged = df.select("*", coarse.alias("coarse"), *[x.alias(n) for n, x in fine.items()])
    keys = [*group, "coarse", *fine]
    hist = tagged.groupBy(*keys).agg(F.count(F.lit(1)).alias("cnt"))
    offsets = cumulative(hist, group, fine_order, "cnt").drop("cnt")
    cond = reduce(lambda a, b: a & b, [F.col(f"d.{x}").eqNullSafe(F.col(f"o.{x}")) for x in keys])
    local = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    joined = tagged.alias("d").join(offsets.alias("o"), cond).select("d.*", "o.before")
    return joined.withColumn(out, F.col("before") + local).drop("before", "coarse", *fine)
