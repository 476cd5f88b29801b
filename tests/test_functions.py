"""Bands, finance, ranks and running sums against plain Python and numpy."""

from __future__ import annotations

import bisect
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from creditloom.functions import bands, finance, ranks
from creditloom.functions.running import running_sum
from creditloom.reference import BANDS


@pytest.mark.parametrize("name", sorted(BANDS))
def test_band_edges(spark, name):
    edges, labels, right = BANDS[name]
    values = [x for e in edges for x in (e - 0.001, e - 1e-9, float(e), e + 1e-9, e + 0.001)] + [-1e6, 1e12, math.inf]

    def expected(v):
        v = v if math.isinf(v) else round(v, 6)
        return labels[bisect.bisect_left(edges, v) if right else bisect.bisect_right(edges, v)]

    df = spark.createDataFrame([(float(v),) for v in values], "v double").withColumn("b", bands.band(name, "v"))
    assert [r.b for r in df.collect()] == [expected(v) for v in values]


def test_missing_score_is_its_own_band(spark):
    df = spark.createDataFrame([(None,), (599,), (600,), (800,)], "s bigint").select(bands.bureau_band("s").alias("b"))
    assert [r.b for r in df.collect()] == ["NTC", "<600", "600-649", "800+"]


def test_emi_and_apr(spark):
    df = spark.createDataFrame([(500000, 0, 16607.15, 36), (100000, 1000, 100000 / 12, 12), (360, 0, 1.0, 360), (1000, 0, 1000.0, 360),
                                (1000, 0, 90.0, 10), (100, 200, 10.0, 10), (100, 0, 0.0, 10)], "p bigint, f bigint, e double, n bigint")
    got = [r.a for r in df.select(finance.apr("p", "f", "e", "n").alias("a")).collect()]
    assert got[0] == pytest.approx(12.0, abs=1e-3)
    assert got[1] == pytest.approx(1.8605, abs=1e-3)
    assert got[2] == pytest.approx(0.0, abs=1e-6)
    assert got[3] == pytest.approx(1200.0, rel=1e-9)
    assert got[4] < 0
    assert got[5] is None and got[6] is None
    for (p, f, e, n), a in zip([tuple(r) for r in df.collect()][:5], got):
        r = a / 1200
        pv = e * n if abs(r) < 1e-9 else e * (1 - (1 + r) ** -n) / r
        assert pv == pytest.approx(p - f, rel=1e-9)
    row = spark.range(1).select(finance.emi(F.lit(500000), F.lit(12.0), F.lit(36)).alias("x"), finance.emi(F.lit(1200), F.lit(0.0), F.lit(12)).alias("z"),
                                finance.emi(F.lit(1200), F.lit(0.0), F.lit(0)).alias("bad")).first()
    assert row.x == pytest.approx(16607.15, abs=0.01) and row.z == 100.0 and row.bad is None


def test_exact_percentiles_match_numpy(spark):
    rng = random.Random(3)
    rows = [(g, v) for g in "ab" for v in [rng.lognormvariate(3, 2) for _ in range(500)] + [7.0] * 300]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r.g: r for r in ranks.exact_percentiles(df, ["g"], "v", {"p50": 0.5, "p95": 0.95, "p99": 0.99}).collect()}
    for g in "ab":
        xs = [v for k, v in rows if k == g]
        for name, q in (("p50", 50), ("p95", 95), ("p99", 99)):
            assert got[g][name] == pytest.approx(np.percentile(xs, q), rel=1e-12)


def test_auc_and_spearman(spark):
    rng = random.Random(5)
    rows = [(rng.choice([0.1, 0.2, 0.5, 0.9, -1.5]), rng.random() < 0.4, rng.randrange(5)) for _ in range(400)]
    df = spark.createDataFrame(rows, "s double, y boolean, z bigint")
    pos, neg = [s for s, y, _ in rows if y], [s for s, y, _ in rows if not y]
    brute = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    assert ranks.auc(df, [], "s", F.col("y")).first().auc == pytest.approx(brute)

    def avg_rank(xs):
        return [sum(x < v for x in xs) + (sum(x == v for x in xs) + 1) / 2 for v in xs]

    want = np.corrcoef(avg_rank([r[0] for r in rows]), avg_rank([r[2] for r in rows]))[0, 1]
    assert ranks.spearman(df, "s", "z").first().spearman == pytest.approx(want)


def test_row_numbers_and_running_sum_on_a_hot_key(spark):
    rows = [("hot" if i % 3 else "cold", (i * 37) % 501, i, i % 2) for i in range(600)]
    df = spark.createDataFrame(rows, "g string, o bigint, id bigint, v bigint")
    out = ranks.row_numbers(df, ["g"], F.floor(F.col("o") / 50), {"_s": F.floor(F.col("o") / 10)}, [F.col("_s")], [F.col("o"), F.col("id")])
    got = {r.id: r["rank"] for r in out.collect()}
    for g in ("hot", "cold"):
        for i, r in enumerate(sorted((x for x in rows if x[0] == g), key=lambda x: (x[1], x[2])), 1):
            assert got[r[2]] == i
    sums = {r.id: r.s for r in running_sum(df, ["g"], ["o", "id"], F.floor(F.col("o") / 50), F.col("v"), "s").collect()}
    for g in ("hot", "cold"):
        total = 0
        for r in sorted((x for x in rows if x[0] == g), key=lambda x: (x[1], x[2])):
            total += r[3]
            assert sums[r[2]] == total
