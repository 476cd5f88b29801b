"""Named SQL views the oracle queries build on, written for an ANSI engine over the same Parquet tables.

Each view states its formula independently of the Spark code; ``compose`` prepends the views a query names.
"""

from __future__ import annotations

from creditloom import reference as R

VIEWS: dict[str, tuple[tuple[str, ...], str]] = {}


def view(name: str, needs: str, sql: str) -> None:
    VIEWS[name] = (tuple(needs.split()), sql)


def compose(needs: str, select: str) -> str:
    """``WITH`` clause of every view reachable from ``needs``, dependencies first, then the select."""
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order:
            return
        for d in VIEWS[n][0]:
            visit(d)
        order.append(n)

    for n in needs.split():
        visit(n)
    if not order:
        return select
    return "WITH " + ",\n".join(f"{n} AS MATERIALIZED ({VIEWS[n][1]})" for n in order) + "\n" + select


def q(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, str):
        return "'" + value.replace("'", "''") + "'"
    if isinstance(value, (list, tuple)):
        return "[" + ", ".join(q(v) for v in value) + "]"
    if isinstance(value, float):
        return f"CAST({value!r} AS DOUBLE)"
    return str(value)


def case(key: str, mapping: dict, default: str | None = None) -> str:
    body = " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in mapping.items())
    return f"CASE {key} {body}{'' if default is None else ' ELSE ' + default} END"


def band(name: str, x: str) -> str:
    edges, labels, right = R.BANDS[name]
    op = "<=" if right else "<"
    arms = " ".join(f"WHEN round({x}, 6) {op} {e} THEN {q(lab)}" for e, lab in zip(edges, labels, strict=False))
    return f"CASE WHEN {x} IS NULL THEN NULL WHEN {x} >= 1e15 THEN {q(labels[-1])} {arms} ELSE {q(labels[-1])} END"


def level(edges, x: str) -> str:
    arms = " ".join(f"WHEN round({x}, 6) < {e} THEN {i}" for i, e in enumerate(edges))
    return f"CASE WHEN {x} >= 1e15 THEN {len(edges)} {arms} ELSE {len(edges)} END"


def emi(p: str, rate: str, n: str) -> str:
    r = f"(CAST({rate} AS DOUBLE) / 1200.0)"
    return (f"CASE WHEN {n} <= 0 OR {p} < 0 THEN NULL WHEN {r} = 0 THEN {p} / CAST({n} AS DOUBLE)"
            f" ELSE {p} * {r} * pow(1 + {r}, {n}) / (pow(1 + {r}, {n}) - 1) END")


def apr(p: str, fees: str, inst: str, n: str) -> str:
    """Monthly IRR by bisection as a list fold over sixty steps."""
    mid = "((b.lo + b.hi) / 2)"
    pv = f"(CASE WHEN abs({mid}) < 1e-12 THEN {inst} * {n} ELSE {inst} * (1 - pow(1 + {mid}, -{n})) / {mid} END)"
    net = f"({p} - {fees})"
    return (f"CASE WHEN {net} > 0 AND {inst} > 0 THEN (SELECT 600.0 * (z.lo + z.hi) FROM (SELECT list_reduce("
            f"list_transform(range(60), lambda i: {{'lo': CAST(-0.5 AS DOUBLE), 'hi': CAST(1.0 AS DOUBLE)}}),"
            f" lambda b, s: {{'lo': CASE WHEN {pv} > {net} THEN {mid} ELSE b.lo END,"
            f" 'hi': CASE WHEN {pv} > {net} THEN b.hi ELSE {mid} END}},"
            f" {{'lo': CAST(-0.5 AS DOUBLE), 'hi': CAST(1.0 AS DOUBLE)}}) AS z)) END")


_MON = "['Jan','Feb','Mar','Apr','May','Jun','Jul','Aug','Sep','Oct','Nov','Dec']"

view("book0", "", """
SELECT o_orderkey AS k, o_custkey AS ck, c_nationkey, o_orderpriority AS priority, o_orderdate AS applied_on,
  printf('F%06d', o_orderkey + 1) AS file_id,
  CASE c_mktsegment WHEN 'MACHINERY' THEN 'self_employed' WHEN 'AUTOMOBILE' THEN 'msme_business'
    WHEN 'BUILDING' THEN 'secured_home' WHEN 'HOUSEHOLD' THEN 'salaried_personal'
    WHEN 'FURNITURE' THEN 'salaried_personal' END AS segment,
  c_mktsegment = 'BUILDING' AS is_home, CAST(floor(o_totalprice) AS BIGINT) AS price
FROM orders JOIN customer ON o_custkey = c_custkey""")

view("book1", "book0", f"""
SELECT *, price * (CASE WHEN is_home THEN 20 ELSE 4 END) AS loan_amount_inr,
  CAST((CASE WHEN is_home THEN 60 ELSE 12 END) * (1 + k % 5) AS BIGINT) AS tenure_months,
  CASE WHEN segment = 'self_employed' THEN 'self_employed' WHEN segment = 'msme_business' THEN 'business_owner'
    WHEN segment = 'secured_home' AND k % 3 = 0 THEN 'self_employed' ELSE 'salaried' END AS employment_type,
  25000 + (ck * 7919 % 200) * 1000 AS income_inr, 25000 + (ck * 7919 % 200) * 1000 + (k % 10) * 1000 AS declared_income_inr,
  (k * 31 % 20) * 500 AS existing_emi_inr,
  CASE WHEN ck % 17 = 0 OR (ck % 8 = 3 AND k % 3 = 1) THEN NULL ELSE 600 + ck * 37 % 250 END AS score,
  CASE WHEN ck % 17 = 0 THEN NULL ELSE 600 + ck * 37 % 250 END AS true_score,
  CASE WHEN k % 7 = 0 THEN k * 13 % 120 ELSE 0 END AS max_dpd, CASE WHEN k % 53 = 0 THEN 1 ELSE 0 END AS writeoffs,
  CASE WHEN k % 9 = 0 THEN k % 4 ELSE 0 END AS bounces, k % 6 AS active_loans, k % 8 AS enquiries_6m,
  ck * 11 % 150 AS history_months, (ck * 29 % 50) / CAST(100 AS DOUBLE) AS volatility_cv, ck * 5 % 60 AS months_history,
  (ck * 3 % 200) / CAST(10 AS DOUBLE) AS years, (k * 17 % 100) / CAST(100 AS DOUBLE) AS utilization,
  CASE WHEN k % 37 = 0 THEN 'informal_declared' WHEN segment = 'msme_business' THEN 'gst_and_bank'
    WHEN segment = 'self_employed' THEN 'itr' ELSE 'salary_slip' END AS documentation_type,
  3 + k % 13 AS months_covered, k % 3 AS most_recent_month_age,
  25000 + (ck * 7919 % 200) * 1000 + (k % 7) * 500 AS avg_credits_inr, (k % 45) / CAST(100 AS DOUBLE) AS cash_share,
  k % 5 AS balance_breaches,
  (segment = 'msme_business' OR (segment = 'self_employed' AND k % 5 < 3)) AS has_gst,
  k % 29 <> 0 AS pan_linked, k % 60 AS phone_vintage_months,
  CASE WHEN k % 25 = 0 THEN 'disposable' WHEN k % 25 < 10 THEN 'corporate' ELSE 'free' END AS email_domain,
  k % 6 AS address_shared, k % 31 <> 0 AS history_consistent, 2026 - (21 + ck % 45) AS dob_year, 1 + k % 3 AS city_tier,
  'C' || CAST(ck % 8 AS VARCHAR) AS cohort, k % 41 = 0 AS fraud,
  CASE WHEN k % 41 = 0 THEN ['identity_mismatch','salary_pattern_mismatch','gst_bank_mismatch','synthetic_identity']
    [1 + (k // 41) % 4] END AS fraud_type,
  k % 17 = 5 AS miss_income, k % 19 = 3 AS miss_address, k % 43 = 7 AS miss_fields, k % 29 = 4 AS defect_conditions,
  k % 31 = 5 AS defect_apr, CASE WHEN k % 37 = 6 THEN (k // 37) % 8 END AS defect_disclosure,
  {case('segment', R.PRODUCT_BY_SEGMENT)} AS product,
  {case('segment', {"salaried_personal": 11.25, "self_employed": 12.75, "msme_business": 10.25, "secured_home": 8.65})} AS rate_pct
FROM book0""")

view("book", "book1", f"""
SELECT *, CASE WHEN is_home THEN 100 * loan_amount_inr / CAST(market_value_inr AS DOUBLE) END AS ltv_pct FROM (
 SELECT *, CAST(round({emi('loan_amount_inr', 'rate_pct', 'tenure_months')}) AS BIGINT) AS proposed_emi_inr,
  CASE WHEN has_gst THEN income_inr * 24 END AS bank_credits_inr,
  CASE WHEN has_gst THEN (income_inr * 24 * (40 + k * 23 % 200)) // 100 END AS gst_turnover_inr,
  CASE WHEN is_home THEN (loan_amount_inr * 100) // (50 + k % 45) END AS market_value_inr,
  CASE WHEN is_home THEN (((loan_amount_inr * 100) // (50 + k % 45)) * (100 - k % 30)) // 100 END AS valuation_2_inr,
  CASE WHEN is_home THEN ['apartment','house','plot','villa'][1 + k % 4] END AS property_type,
  CASE WHEN NOT is_home THEN NULL WHEN k % 11 = 0 THEN 'disputed' WHEN k % 13 = 0 THEN 'pending_mutation' ELSE 'clear' END AS title_status,
  CASE WHEN NOT is_home THEN NULL WHEN k % 19 = 0 THEN 'adverse' WHEN k % 23 = 0 THEN 'pending' ELSE 'positive' END AS legal_opinion,
  CASE WHEN segment = 'salaried_personal' OR (is_home AND k % 3 <> 0) THEN '[ORG_A]' END AS employer_token,
  CASE WHEN segment = 'salaried_personal' OR (is_home AND k % 3 <> 0) THEN
    CASE WHEN k % 71 = 6 THEN '[ORG_B]' ELSE '[ORG_A]' END END AS narration_token
 FROM book1)""")

view("grid", "", "SELECT * FROM (VALUES " + ", ".join(
    f"({q(p)}, {q(b)}, {lo}, {q(hi)}, {t}, {q(None if v is None else float(v))}, {q(list(cs))})" for p, b, lo, hi, t, v, cs in R.GRID)
    + ") g(g_product, grid_band, min_amount_inr, max_amount_inr, max_tenure_months, max_ltv_pct, required_conditions)")

view("bookg", "book grid", """
SELECT b.*, grid_band, CAST(max_tenure_months AS BIGINT) AS max_tenure_months, max_ltv_pct, required_conditions
FROM book b LEFT JOIN grid ON g_product = product AND loan_amount_inr > min_amount_inr
 AND (max_amount_inr IS NULL OR loan_amount_inr <= max_amount_inr)""")

view("ratios", "bookg", f"""
SELECT *, CASE WHEN segment <> 'msme_business' THEN foir_limit_pct - foir_pct END AS foir_headroom_pts,
  CASE WHEN is_home THEN coalesce(max_ltv_pct, 80) - ltv_pct END AS ltv_headroom_pts FROM (
 SELECT *, CAST({case('segment', R.FOIR_LIMIT_PCT)} AS BIGINT) AS foir_limit_pct,
  100.0 * CAST(existing_emi_inr + proposed_emi_inr AS DOUBLE) / income_inr AS foir_pct,
  CASE WHEN existing_emi_inr + proposed_emi_inr = 0 THEN CAST('inf' AS DOUBLE)
   ELSE CAST(income_inr * 12 AS DOUBLE) / ((existing_emi_inr + proposed_emi_inr) * 12) END AS dscr,
  CASE WHEN bank_credits_inr > 0 THEN CAST(gst_turnover_inr AS DOUBLE) / bank_credits_inr END AS gst_ratio
 FROM bookg)""")

_SPREAD = ("(CASE WHEN greatest(market_value_inr, valuation_2_inr) > 0 THEN CAST(abs(market_value_inr - valuation_2_inr) AS DOUBLE)"
           " / greatest(market_value_inr, valuation_2_inr) WHEN is_home THEN 0 END)")
_BIZ = "segment IN ('self_employed', 'msme_business')"
view("state", "ratios", f"""
SELECT *, {band('amount', 'loan_amount_inr')} AS loan_amount_band, {band('vintage_years', 'years')} AS years_band,
 {band('monthly', 'declared_income_inr')} AS declared_income_band, {band('age', '(2026 - dob_year)')} AS age_band,
 coalesce({band('bureau_score', 'score')}, 'NTC') AS score_band, {band('dpd', 'max_dpd')} AS max_dpd_band,
 {band('history_length', 'history_months')} AS history_band, {band('monthly', 'income_inr')} AS verified_income_band,
 {band('volatility', 'volatility_cv')} AS volatility, {band('monthly', 'existing_emi_inr')} AS existing_emi_band,
 {band('monthly', 'proposed_emi_inr')} AS proposed_emi_band, {band('foir_pct', 'foir_pct')} AS foir_band,
 {band('card_utilization', 'utilization')} AS utilization_band, {band('foir_headroom_pts', 'foir_headroom_pts')} AS foir_headroom_band,
 CAST({case('segment', R.MONTHS_REQUIRED)} AS BIGINT) AS months_required, {band('monthly', 'avg_credits_inr')} AS avg_credits_band,
 {band('cash_deposit_share', 'cash_share')} AS cash_share_band,
 CASE WHEN has_gst THEN {band('amount', 'gst_turnover_inr')} END AS gst_turnover_band,
 CASE WHEN has_gst THEN {band('amount', 'bank_credits_inr')} END AS bank_credits_band,
 CASE WHEN has_gst THEN {band('gst_to_bank_ratio', 'gst_ratio')} END AS gst_ratio_band,
 CASE WHEN {_BIZ} THEN {band('dscr', 'dscr')} END AS dscr_band,
 CASE WHEN {_BIZ} THEN {band('vintage_years', 'years')} END AS business_vintage_band,
 {band('amount', 'market_value_inr')} AS market_value_band, {band('ltv_pct', 'ltv_pct')} AS ltv_band,
 {band('ltv_headroom_pts', 'ltv_headroom_pts')} AS ltv_headroom_band, {band('valuation_spread', _SPREAD)} AS valuation_spread_band,
 {band('phone_vintage', 'phone_vintage_months')} AS phone_vintage_band, {band('address_shared', 'address_shared')} AS address_shared_band
FROM ratios""")

view("attrs", "", """
SELECT o_orderkey AS k, r_name AS region, CASE WHEN o_custkey % 8 = 3 AND o_orderkey % 3 = 1 THEN 'pincode_bureau_thin'
  WHEN r_name = 'ASIA' AND o_orderkey % 3 = 0 THEN 'lang_doc_script'
  WHEN o_orderpriority = '5-LOW' AND o_orderkey % 4 = 1 THEN 'gender_income_proxy' END AS disparity_subset
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")

view("months_long", "", """
SELECT * FROM (SELECT l_orderkey AS k, CAST(l_linenumber AS BIGINT) AS m,
 max(CASE WHEN l_returnflag = 'R' THEN CAST(floor(l_quantity) AS BIGINT) ELSE 0 END) AS dpd,
 bool_or(l_returnflag = 'R' AND l_linestatus = 'O') AS bounced, bool_or(l_discount >= 0.09) AS "partial",
 CAST(floor(max(l_extendedprice)) AS BIGINT) AS balance_inr
FROM lineitem GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY k ORDER BY m DESC) <= 6""")

_CHANGE = ("CASE WHEN n < 2 THEN NULL WHEN first2 <= 0 THEN 'flat' WHEN last2 * 10 <= first2 * 6 THEN 'falling_40_plus'"
           " WHEN last2 * 10 <= first2 * 9 THEN 'falling_10_40' WHEN last2 * 10 >= first2 * 11 THEN 'rising' ELSE 'flat' END")
view("conduct", "months_long", f"""
SELECT *, {_CHANGE} AS balance_change_band, max_month_dpd >= 30 OR rises >= 3 AS dpd_rising FROM (
 SELECT k, count(*) AS n, max(dpd) AS max_month_dpd, count(*) FILTER (WHERE bounced) AS n_bounced,
  count(*) FILTER (WHERE "partial") AS n_partial,
  count(*) FILTER (WHERE dpd > prev AND rn > n_all - 4) AS rises,
  CAST(sum(balance_inr) FILTER (WHERE rn <= 2) AS BIGINT) AS first2, CAST(sum(balance_inr) FILTER (WHERE rn > n_all - 2) AS BIGINT) AS last2
 FROM (SELECT *, lag(dpd) OVER w AS prev, row_number() OVER w AS rn, count(*) OVER (PARTITION BY k) AS n_all
       FROM months_long WINDOW w AS (PARTITION BY k ORDER BY m)) GROUP BY k)""")

_HEAD = [h for _, h in R.DISCLOSURES]
view("memo", "state", f"""
SELECT *, round(apr_recomputed_pct + CASE WHEN defect_apr THEN 0.5 WHEN k % 67 = 2 THEN 0.2 ELSE 0 END, 2) AS apr_stated_pct FROM (
 SELECT *, round({apr('loan_amount_inr', 'kfs_fees_inr', 'proposed_emi_inr', 'tenure_months')}, 2) AS apr_recomputed_pct FROM (
  SELECT *, CASE WHEN defect_conditions THEN required_conditions[2:] ELSE required_conditions END AS memo_conditions,
   'Approved at rate ' || printf('%.2f', rate_pct + CASE WHEN k % 61 = 9 THEN 0.5 ELSE 0 END) || '% for ' ||
    CAST(tenure_months AS VARCHAR) || ' months.' AS memo_text,
   array_to_string(list_filter({q(_HEAD)}, lambda h, i: defect_disclosure IS NULL OR i - 1 <> defect_disclosure), '. ') AS kfs_text,
   CAST(floor(loan_amount_inr * 15 / 1000) AS BIGINT) AS kfs_fees_inr
  FROM state))""")


def _mon_year(text: str, pattern: str, g: int = 1) -> str:
    rx = pattern.replace("MY", r"\b(Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)\s+(\d{4})\b")
    return (f"CASE WHEN regexp_extract({text}, {q(rx)}, {g + 1}) <> '' THEN CAST(regexp_extract({text}, {q(rx)}, {g + 1}) AS BIGINT) * 12"
            f" + list_position({_MON}, regexp_extract({text}, {q(rx)}, {g})) END")


view("docs", "memo", f"""
SELECT *, CASE WHEN miss_income THEN NULL ELSE k % 4 END AS income_doc_age,
 CASE k % 3 WHEN 0 THEN 'utility_bill' WHEN 1 THEN 'rent_agreement' ELSE 'passport' END AS address_kind,
 CASE WHEN k % 3 = 0 THEN k % 4 ELSE k % 14 END AS address_age,
 (CASE WHEN k % 47 = 1 THEN 'Prepaid connection. ' ELSE '' END) || 'Received: ' || {_MON}[1 + k % 12] || ' 2026. ' ||
 (CASE k % 3 WHEN 1 THEN 'Lease term Jan 2024 to ' || {_MON}[1 + k % 7] || ' ' || CAST(2026 + k % 2 AS VARCHAR) || '. '
   WHEN 2 THEN 'Passport expires ' || {_MON}[1 + k % 5] || ' ' || CAST(2025 + k % 8 AS VARCHAR) || '. ' ELSE '' END) ||
 'Address ' || (CASE WHEN miss_address THEN '[ADDR_2]' ELSE '[ADDR_1]' END) || '.' AS address_text,
 CASE WHEN employment_type = 'salaried' AND NOT miss_income THEN
   CASE WHEN fraud_type = 'salary_pattern_mismatch' THEN '[ORG_B]' ELSE '[ORG_A]' END END AS slip_org,
 CASE WHEN employment_type = 'salaried' THEN 24 + (ck * 13 % 40) * 10 END AS months_to_superannuation,
 coalesce(fraud_type = 'synthetic_identity', false) AS auto_generated
FROM memo""")
