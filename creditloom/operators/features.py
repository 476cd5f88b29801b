"""Feature projections: observed ratios, bands, stage states and the risk score. All narrow, all JVM-side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from creditloom import reference as R
from creditloom.functions import bands as B
from creditloom.functions import finance as fin
from creditloom.sources.tables import inline

# --- fixed values: words that carry no meaning when two condition texts are compared
STOP_WORDS = ("the", "and", "for", "with", "from", "that", "this", "over", "under", "above", "before", "where", "which")

GRID_COLUMNS = ("product string; grid_band string; min_amount_inr bigint; max_amount_inr bigint;"
                " max_tenure_months bigint; max_ltv_pct double; required_conditions array<string>")


def grid(spark: SparkSession) -> DataFrame:
    rows = [(p, b, lo, hi, t, None if v is None else float(v), list(c)) for p, b, lo, hi, t, v, c in R.GRID]
    # the words of each required condition are split once per grid row, not once per file
    return inline(spark, rows, GRID_COLUMNS).selectExpr("*", f"transform(required_conditions, t -> {words_sql('t')}) AS required_words")


def words_sql(text: str) -> str:
    """Distinct words longer than three letters that are not stop words."""
    stop = ", ".join(f"'{w}'" for w in STOP_WORDS)
    return f"array_distinct(filter(split(lower({text}), '[^a-z0-9]+'), w -> length(w) > 3 AND w NOT IN ({stop})))"


def join_grid_row(files: DataFrame, spark: SparkSession) -> DataFrame:
    """Range join: the grid row of the product whose (min, max] holds the amount.

    The product equality makes it a hash join against 13 constant rows; the range is a residual filter. A file with
    no grid row keeps NULLs, so it is visible instead of lost.
    """
    g = grid(spark).alias("g")
    f = files.alias("f")
    on = (
        (F.col("f.product") == F.col("g.product"))
        & (F.col("f.loan_amount_inr") > F.col("g.min_amount_inr"))
        & (F.col("g.max_amount_inr").isNull() | (F.col("f.loan_amount_inr") <= F.col("g.max_amount_inr")))
    )
    return f.join(g, on, "left").select(
        "f.*", "g.grid_band", "g.max_tenure_months", "g.max_ltv_pct", "g.required_conditions", "g.required_words"
    )


def observed_ratios(files: DataFrame) -> DataFrame:
    """FOIR, DSCR, headrooms and the GST-to-bank ratio from observed fields (files joined to their grid row)."""
    total = F.expr("existing_emi_inr + proposed_emi_inr")
    df = files.select(
        "*",
        fin.foir(total, F.col("income_inr")).alias("foir_pct"),
        fin.dscr(F.col("income_inr") * 12, total * 12).alias("dscr"),
        F.expr(f"CAST({B.lookup_sql(R.FOIR_LIMIT_PCT, 'segment')} AS BIGINT) AS foir_limit_pct"),
        F.expr("CASE WHEN bank_credits_inr > 0 THEN CAST(gst_turnover_inr AS DOUBLE) / bank_credits_inr END AS gst_ratio"),
    )
    return df.selectExpr(
        "*", "CASE WHEN segment <> 'msme_business' THEN foir_limit_pct - foir_pct END AS foir_headroom_pts",
        "CASE WHEN is_home THEN coalesce(max_ltv_pct, 80D) - ltv_pct END AS ltv_headroom_pts",
    )


_BUSINESS = "segment IN ('self_employed', 'msme_business')"
# banded column -> (band table, expression, condition under which the state carries the block)
_STATE_BANDS = {
    "loan_amount_band": ("amount", "loan_amount_inr", None), "years_band": ("vintage_years", "years", None),
    "declared_income_band": ("monthly", "declared_income_inr", None),
    "age_band": ("age", f"({R.REFERENCE_YEAR} - dob_year)", None), "max_dpd_band": ("dpd", "max_dpd", None),
    "history_band": ("history_length", "history_months", None), "verified_income_band": ("monthly", "income_inr", None),
    "volatility": ("volatility", "volatility_cv", None), "existing_emi_band": ("monthly", "existing_emi_inr", None),
    "proposed_emi_band": ("monthly", "proposed_emi_inr", None), "foir_band": ("foir_pct", "foir_pct", None),
    "utilization_band": ("card_utilization", "utilization", None),
    "foir_headroom_band": ("foir_headroom_pts", "foir_headroom_pts", None),
    "avg_credits_band": ("monthly", "avg_credits_inr", None), "cash_share_band": ("cash_deposit_share", "cash_share", None),
    "gst_turnover_band": ("amount", "gst_turnover_inr", "has_gst"), "bank_credits_band": ("amount", "bank_credits_inr", "has_gst"),
    "gst_ratio_band": ("gst_to_bank_ratio", "gst_ratio", "has_gst"), "dscr_band": ("dscr", "dscr", _BUSINESS),
    "business_vintage_band": ("vintage_years", "years", _BUSINESS), "market_value_band": ("amount", "market_value_inr", "is_home"),
    "ltv_band": ("ltv_pct", "ltv_pct", "is_home"), "ltv_headroom_band": ("ltv_headroom_pts", "ltv_headroom_pts", "is_home"),
    "valuation_spread_band": ("valuation_spread", B.valuation_spread_sql("market_value_inr", "valuation_2_inr"), "is_home"),
    "phone_vintage_band": ("phone_vintage", "phone_vintage_months", None),
    "address_shared_band": ("address_shared", "address_shared", None),
}


def appraisal_state(ratios: DataFrame) -> DataFrame:
    """Every banded block of the appraisal state beside the raw columns; blocks a segment lacks are NULL."""
    exprs = []
    for name, (table, x, present) in _STATE_BANDS.items():
        label = B.band_sql(table, x)
        exprs.append(f"{f'CASE WHEN {present} THEN {label} END' if present else label} AS {name}")
    return ratios.selectExpr(
        "*", *exprs, f"{B.bureau_band_sql('score')} AS score_band",
        f"CAST({B.lookup_sql(R.MONTHS_REQUIRED, 'segment')} AS BIGINT) AS months_required",
    )


# the columns an appraisal state may show: bands, enums and small integers, never a raw amount or a protected attribute
STATE_COLUMNS = (
    "segment", "product", "loan_amount_band", "tenure_months", "employment_type", "years_band", "declared_income_band",
    "age_band", "city_tier", "score_band", "active_loans", "max_dpd_band", "enquiries_6m", "writeoffs", "history_band",
    "verified_income_band", "volatility", "months_history", "documentation_type", "existing_emi_band",
    "proposed_emi_band", "foir_band", "foir_limit_pct", "utilization_band", "foir_headroom_band", "months_covered",
    "months_required", "most_recent_month_age", "narration_token", "avg_credits_band", "bounces", "cash_share_band",
    "balance_breaches", "gst_turnover_band", "bank_credits_band", "gst_ratio_band", "dscr_band",
    "business_vintage_band", "property_type", "market_value_band", "ltv_band", "ltv_headroom_band", "title_status",
    "legal_opinion", "valuation_spread_band", "pan_linked", "phone_vintage_band", "email_domain", "address_shared_band",
    "history_consistent",
)
STATE_NUMERIC = ("tenure_months", "city_tier", "active_loans", "enquiries_6m", "writeoffs", "months_history",
                 "foir_limit_pct", "months_covered", "months_required", "most_recent_month_age", "bounces",
                 "balance_breaches")


def state_text(df: DataFrame) -> Column:
    """Canonical text of a state: sorted ``key=value`` pairs, missing blocks left out."""
    parts = [F.concat(F.lit(f"{name}="), F.col(name).cast("string")) for name in sorted(STATE_COLUMNS)]
    return F.concat_ws("|", *parts)


def state_flatten(state: DataFrame) -> DataFrame:
    """Sparse long features: ``num:field`` keeps the value, ``cat:field=value`` is 1. One explode, no shuffle."""
    entries = []
    for name in STATE_COLUMNS:
        col = F.col(name)
        if name in STATE_NUMERIC:
            entries.append(F.when(col.isNotNull(), F.struct(F.lit(f"num:{name}").alias("feature"),
                                                            col.cast("double").alias("value"))))
        else:
            entries.append(F.when(col.isNotNull(), F.struct(
                F.concat(F.lit(f"cat:{name}="), col.cast("string")).alias("feature"), F.lit(1.0).alias("value"))))
    return state.select("file_id", F.inline(F.array_compact(F.array(*entries))))


# ------------------------------------------------------------------------------------------------ risk score


# the score labels use: the real one where the reported score is hidden by the thin-file subset
EFFECTIVE_SCORE = "CASE WHEN ck % 8 = 3 AND k % 3 = 1 THEN coalesce(true_score, score) ELSE score END"


def risk_inputs(*, exact: bool) -> dict[str, str]:
    """The quantities the risk score reads: true values for labels, band midpoints for the rules-only baseline."""
    if exact:
        return {
            "score": EFFECTIVE_SCORE, "foir": "foir_pct / 100D", "cv": "volatility_cv", "dpd": "CAST(max_dpd AS DOUBLE)",
            "years": "years", "util": "utilization", "ltv": "ltv_pct", "gst": "gst_ratio",
            "income": "CAST(declared_income_inr AS DOUBLE) / income_inr", "fraud": "CASE WHEN fraud THEN 1D ELSE 0D END",
        }
    at = B.lookup_sql
    return {
        "score": at(R.MID_SCORE, "score_band"),
        "foir": f"CASE WHEN segment = 'msme_business' THEN 1D / {at(R.MID_DSCR, 'dscr_band')}"
                f" ELSE {at(R.MID_FOIR, 'foir_band')} / 100D END",
        "cv": at(R.MID_CV, "volatility"), "dpd": at(R.MID_DPD, "max_dpd_band"), "years": at(R.MID_VINTAGE, "years_band"),
        "util": at(R.MID_UTIL, "utilization_band"), "ltv": at(R.MID_LTV, "ltv_band"), "gst": at(R.MID_GST, "gst_ratio_band"),
        "income": f"{at(R.MID_MONTHLY, 'declared_income_band')} / {at(R.MID_MONTHLY, 'verified_income_band')}", "fraud": "0D",
    }


def risk_features(v: dict[str, str]) -> dict[str, str]:
    """Standardised features, 0 being typical. A missing quantity contributes nothing."""
    at = B.lookup_sql

    def clip(x: str, lo: float, hi: float) -> str:
        return f"greatest({lo}D, least({hi}D, {x}))"

    title = at({"clear": 0.0, "pending_mutation": 0.5, "disputed": 1.0}, "title_status")
    return {
        "seg_self_employed": "CAST(segment = 'self_employed' AS DOUBLE)",
        "seg_msme_business": "CAST(segment = 'msme_business' AS DOUBLE)",
        "seg_secured_home": "CAST(segment = 'secured_home' AS DOUBLE)",
        "bureau_score": f"coalesce(({v['score']} - 725D) / 60D, 0D)",
        "ntc": f"CAST({v['score']} IS NULL AS DOUBLE)",
        "foir": f"({v['foir']} - {at(R.FOIR_CENTRE, 'segment')}) / 0.15D",
        "income_volatility": f"({v['cv']} - {at(R.VOL_CENTRE, 'employment_type')}) / {at(R.VOL_SCALE, 'employment_type')}",
        "max_dpd": f"least({v['dpd']}, 120D) / 30D",
        "emi_bounces": "least(CAST(bounces AS DOUBLE), 4D) / 2D",
        "writeoff": "CAST(writeoffs > 0 AS DOUBLE)",
        "ltv": f"CASE WHEN is_home THEN {clip('(' + v['ltv'] + ' - 65D) / 12D', -3.0, 4.0)} ELSE 0D END",
        "title_risk": f"CASE WHEN is_home THEN {title} + CASE WHEN legal_opinion = 'adverse' THEN 0.5D ELSE 0D END ELSE 0D END",
        "business_vintage": f"(least({v['years']}, 15D) - {at(R.VINTAGE_CENTRE, 'segment')}) / 5D",
        "gst_inconsistency": f"CASE WHEN {v['gst']} > 0D THEN {clip('(abs(ln(' + v['gst'] + ')) - 0.12D) / 0.25D', 0.0, 3.0)} ELSE 0D END",
        "income_gap": clip(f"({v['income']} - 1.05D) / 0.15D", 0.0, 3.0),
        "card_utilization": f"({v['util']} - 0.35D) / 0.2D",
        "fraud_flag": v["fraud"],
    }


def with_risk(state: DataFrame, prefix: str, *, exact: bool) -> DataFrame:
    """Adds ``{prefix}{feature}`` columns and ``{prefix}pd``, the clipped logistic score."""
    feats = risk_features(risk_inputs(exact=exact))
    df = state.selectExpr("*", *[f"{x} AS {prefix}{name}" for name, x in feats.items()])
    z = " + ".join(f"({R.COEFFICIENTS[f]}D) * {prefix}{f}" for f in R.FEATURES)
    return df.selectExpr("*", f"greatest(0.002D, least(0.95D, 1D / (1D + exp(-({R.COEFFICIENTS['intercept']}D + {z}))))) AS {prefix}pd")


# ------------------------------------------------------------------------------------------------ other states


def sanction_docs_state(memo: DataFrame) -> DataFrame:
    """Memo and KFS facts with the grid row and one row per required disclosure (an explode of eight constants)."""
    headings = F.array(*[F.struct(F.lit(i).alias("disclosure_id"), F.lit(h).alias("heading")) for i, h in R.DISCLOSURES])
    return memo.select(
        "file_id", "segment", "product", "grid_band", "max_tenure_months", "tenure_months", "rate_pct",
        "apr_stated_pct", "apr_recomputed_pct", F.size("memo_conditions").cast("bigint").alias("n_conditions"),
        F.size("required_conditions").cast("bigint").alias("n_required"), "kfs_text", F.inline(headings),
    ).withColumn("heading_present", F.expr("contains(lower(kfs_text), lower(heading))")).drop("kfs_text")


# (first two, last two) balances of the ordered month array; NULL under two months
FIRST_TWO = "CASE WHEN size(months) >= 2 THEN get(months, 0).balance_inr + get(months, 1).balance_inr END"
LAST_TWO = ("CASE WHEN size(months) >= 2 THEN get(months, size(months) - 2).balance_inr"
            " + get(months, size(months) - 1).balance_inr END")
BALANCE_CHANGE = B.balance_change_sql(f"({FIRST_TWO})", f"({LAST_TWO})")


def monitoring_state(files_with_conduct: DataFrame) -> DataFrame:
    """One row per file and month with DPD and balance bands and the file's balance trend."""
    return (
        files_with_conduct.filter("months IS NOT NULL")
        .select("file_id", "segment", "product", F.size("months").cast("bigint").alias("months_since_disbursal"),
                F.expr(f"{BALANCE_CHANGE} AS balance_change_band"), F.inline("months"))
        .withColumn("dpd_band", B.band("dpd", "dpd"))
        .withColumn("avg_balance_band", B.band("monthly", "balance_inr"))
        .drop("balance_inr")
    )


def covenant_state(files_with_covenants: DataFrame) -> DataFrame:
    """Covenants of the MSME files; the DSCR covenant shows a band, the others keep their small value."""
    df = files_with_covenants.filter("covs IS NOT NULL").select("file_id", F.inline("covs"))
    return df.select(
        "file_id", "covenant_id", "required",
        F.when(F.col("covenant_id") == "dscr_min_1_25", B.band("dscr", "reported"))
        .otherwise(F.col("reported").cast("bigint").cast("string")).alias("reported_value_band"), "evidence",
    )
