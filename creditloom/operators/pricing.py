"""Versioned pricing formula in exact decimals: benchmark + spread + premium + bureau adjustment, clamped."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from creditloom import reference as R
from creditloom.functions import finance as fin
from creditloom.sources.tables import inline

_DEC = "DECIMAL(9,4)"


def _decimal_case(mapping: dict[str, str], key: str, default: str | None = None) -> str:
    arms = " ".join(f"WHEN '{k}' THEN CAST('{v}' AS {_DEC})" for k, v in mapping.items())
    other = f" ELSE CAST('{default}' AS {_DEC})" if default is not None else ""
    return f"CASE {key} {arms}{other} END"


def premium_tiers(spark: SparkSession) -> DataFrame:
    return inline(spark, [(b, f, p, i) for i, (b, f, p) in enumerate(R.PREMIUM_TIERS)],
                  f"tier_band string; composite_floor double; premium_pct {_DEC}; tier_no int")


def join_premium_tier(requests: DataFrame, spark: SparkSession) -> DataFrame:
    """First tier of the band whose floor the composite reaches.

    Tiers are disjoint once each carries the next higher floor of its band as a ceiling, so this is an equality join
    on the band with a range residual against three constant rows, with no ranking after it.
    """
    tiers = premium_tiers(spark)
    higher = tiers.select(F.col("tier_band").alias("b2"), F.col("composite_floor").alias("f2"))
    bounded = tiers.join(higher, (F.col("b2") == F.col("tier_band")) & (F.col("f2") > F.col("composite_floor")), "left").groupBy(
        "tier_band", "composite_floor", "premium_pct").agg(F.min("f2").alias("composite_ceiling"))
    r, t = requests.alias("r"), bounded.alias("t")
    on = ((F.col("r.price_band") == F.col("t.tier_band")) & (F.col("r.composite") >= F.col("t.composite_floor"))
          & (F.col("t.composite_ceiling").isNull() | (F.col("r.composite") < F.col("t.composite_ceiling"))))
    return r.join(F.broadcast(t), on, "left").select("r.*", "t.premium_pct", "t.composite_floor")


INELIGIBLE = (
    "CASE WHEN price_band IS NULL OR price_band NOT IN ('pass', 'borderline_approved_by_human') THEN 'band_not_priceable'"
    " WHEN composite IS NULL OR composite < 0 OR composite > 1 THEN 'composite_out_of_bounds'"
    " WHEN loan_amount_inr <= 0 OR tenure_months <= 0 THEN 'principal_or_tenure'"
    " WHEN premium_pct IS NULL THEN 'below_every_tier' END")


def price(requests: DataFrame, spark: SparkSession) -> DataFrame:
    """Rate, clamp and line amounts of every request; a request that may not be priced keeps its reason and no rate."""
    df = join_premium_tier(requests, spark).selectExpr("*", f"{INELIGIBLE} AS ineligible_reason")
    ok = "ineligible_reason IS NULL"
    df = df.selectExpr(
        "*", f"CASE WHEN {ok} THEN CAST('{R.BENCHMARK_PCT}' AS {_DEC}) END AS benchmark_rate",
        f"CASE WHEN {ok} THEN {_decimal_case(R.SPREAD_PCT, 'segment')} END AS segment_spread",
        f"CASE WHEN {ok} THEN premium_pct END AS risk_premium",
        f"CASE WHEN {ok} THEN {_decimal_case(R.BUREAU_ADJ_PCT, 'score_band', R.BUREAU_ADJ_DEFAULT)} END AS bureau_adjustment",
        f"{_decimal_case(R.FLOOR_PCT, 'segment')} AS floor_pct", f"{_decimal_case(R.CAP_PCT, 'segment')} AS cap_pct",
    )
    df = df.selectExpr("*", f"CAST(benchmark_rate + segment_spread + risk_premium + bureau_adjustment AS {_DEC}) AS pre_clamp_rate")
    df = df.selectExpr("*", f"CASE WHEN pre_clamp_rate IS NOT NULL THEN CAST(least(greatest(pre_clamp_rate, floor_pct), cap_pct) AS {_DEC}) END AS priced_rate")
    return df.selectExpr("*", f"CAST(priced_rate - pre_clamp_rate AS {_DEC}) AS clamp_amount")


def fee_emi_apr(priced: DataFrame) -> DataFrame:
    """Fee half-up to the rupee, instalment to the rupee, APR with the fee."""
    df = priced.filter("priced_rate IS NOT NULL").selectExpr(
        "*", f"CAST(round(CAST(loan_amount_inr AS DECIMAL(18,0)) * {_decimal_case(R.FEE_PCT, 'segment')} / 100, 0) AS BIGINT) AS fee_inr")
    df = df.withColumn("emi_inr", F.round(fin.emi(F.col("loan_amount_inr"), F.col("priced_rate").cast("double"), F.col("tenure_months"))).cast("bigint"))
    return df.withColumn("apr_pct", fin.apr("loan_amount_inr", "fee_inr", "emi_inr", "tenure_months"))


def line_items(priced: DataFrame) -> DataFrame:
    """The terms of each rate as rows; a moved clamp is its own line."""
    terms = ["benchmark_rate", "segment_spread", "risk_premium", "bureau_adjustment"]
    structs = [f"named_struct('name', '{t}', 'value_pct', {t})" for t in terms]
    structs.append("CASE WHEN clamp_amount <> 0 THEN named_struct('name', CASE WHEN priced_rate = floor_pct THEN 'floor_clamp'"
                   " ELSE 'cap_clamp' END, 'value_pct', clamp_amount) END")
    return priced.filter("priced_rate IS NOT NULL").select(
        "file_id", "priced_rate", F.expr(f"inline(array_compact(array({', '.join(structs)})))"))
