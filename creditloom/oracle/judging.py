"""Oracle views of the rules, labels, answers and decisions."""

from __future__ import annotations

from creditloom import reference as R
from creditloom.oracle.views import _mon_year, band, case, level, q, view  # noqa: F401

_SEG = "segment"


def _feature_sql(v: dict[str, str], p: str) -> str:
    f = {
        "seg_self_employed": "CASE WHEN segment = 'self_employed' THEN 1.0 ELSE 0.0 END",
        "seg_msme_business": "CASE WHEN segment = 'msme_business' THEN 1.0 ELSE 0.0 END",
        "seg_secured_home": "CASE WHEN segment = 'secured_home' THEN 1.0 ELSE 0.0 END",
        "bureau_score": f"CASE WHEN {v['score']} IS NULL THEN 0.0 ELSE ({v['score']} - 725) / 60.0 END",
        "ntc": f"CASE WHEN {v['score']} IS NULL THEN 1.0 ELSE 0.0 END",
        "foir": f"({v['foir']} - {case(_SEG, R.FOIR_CENTRE)}) / 0.15",
        "income_volatility": f"({v['cv']} - {case('employment_type', R.VOL_CENTRE)}) / {case('employment_type', R.VOL_SCALE)}",
        "max_dpd": f"least({v['dpd']}, 120) / 30.0", "emi_bounces": "least(bounces, 4) / 2.0",
        "writeoff": "CASE WHEN writeoffs > 0 THEN 1.0 ELSE 0.0 END",
        "ltv": f"CASE WHEN is_home THEN greatest(-3.0, least(4.0, ({v['ltv']} - 65) / 12.0)) ELSE 0.0 END",
        "title_risk": "CASE WHEN is_home THEN CASE title_status WHEN 'disputed' THEN 1.0 WHEN 'pending_mutation' THEN 0.5 ELSE 0.0 END"
                      " + CASE WHEN legal_opinion = 'adverse' THEN 0.5 ELSE 0.0 END ELSE 0.0 END",
        "business_vintage": f"(least({v['years']}, 15) - {case(_SEG, R.VINTAGE_CENTRE)}) / 5.0",
        "gst_inconsistency": f"CASE WHEN {v['gst']} > 0 THEN least(3.0, greatest(0.0, (abs(ln({v['gst']})) - 0.12) / 0.25)) ELSE 0.0 END",
        "income_gap": f"least(3.0, greatest(0.0, ({v['income']} - 1.05) / 0.15))",
        "card_utilization": f"({v['util']} - 0.35) / 0.2", "fraud_flag": v["fraud"],
    }
    return ", ".join(f"CAST({f[n]} AS DOUBLE) AS {p}{n}" for n in R.FEATURES)


def _pd(p: str) -> str:
    z = " + ".join(f"({q(float(R.COEFFICIENTS[n]))}) * {p}{n}" for n in R.FEATURES)
    return f"greatest(0.002, least(0.95, 1 / (1 + exp(-(-3.9 + {z})))))"


_EFF = "(CASE WHEN ck % 8 = 3 AND k % 3 = 1 THEN coalesce(true_score, score) ELSE score END)"
EXACT = {"score": _EFF, "foir": "foir_pct / 100.0", "cv": "volatility_cv", "dpd": "max_dpd", "years": "years",
         "util": "utilization", "ltv": "ltv_pct", "gst": "gst_ratio",
         "income": "CAST(declared_income_inr AS DOUBLE) / income_inr", "fraud": "CASE WHEN fraud THEN 1.0 ELSE 0.0 END"}
BANDED = {
    "score": case("score_band", R.MID_SCORE),
    "foir": f"CASE WHEN segment = 'msme_business' THEN 1.0 / {case('dscr_band', R.MID_DSCR)} ELSE {case('foir_band', R.MID_FOIR)} / 100.0 END",
    "cv": case("volatility", R.MID_CV), "dpd": case("max_dpd_band", R.MID_DPD), "years": case("years_band", R.MID_VINTAGE),
    "util": case("utilization_band", R.MID_UTIL), "ltv": case("ltv_band", R.MID_LTV), "gst": case("gst_ratio_band", R.MID_GST),
    "income": f"{case('declared_income_band', R.MID_MONTHLY)} / {case('verified_income_band', R.MID_MONTHLY)}", "fraud": "0.0",
}

_VINTAGE = "(segment IN ('self_employed','msme_business') OR (is_home AND employment_type = 'self_employed'))"


def _margins(p: str, exact: bool) -> list[str]:
    v = EXACT if exact else BANDED
    cut = case(_SEG, R.PD_CUTOFF)
    dscr = "dscr" if exact else case("dscr_band", R.MID_DSCR)
    foir = "foir_pct" if exact else case("foir_band", R.MID_FOIR)
    if exact:
        thin = "CASE WHEN segment = 'salaried_personal' AND income_inr >= 50000 THEN least(2.0, (income_inr - 50000) / 25000.0) ELSE -2.0 END"
    else:
        low = case("verified_income_band", R.LOW_MONTHLY)
        thin = f"CASE WHEN segment = 'salaried_personal' AND {low} >= 50000 THEN least(2.0, ({low} - 50000) / 25000.0 + 0.5) ELSE -2.0 END"
    out = [
        f"CASE WHEN segment = 'msme_business' THEN ({dscr} - 1.25) / 0.35 ELSE (foir_limit_pct - {foir}) / 10.0 END",
        f"CASE WHEN {v['score']} IS NULL THEN {thin} ELSE ({v['score']} - 650) / 40.0 END",
        f"(60 - {v['dpd']}) / 20.0", "CASE WHEN writeoffs = 0 THEN 2.0 ELSE -2.5 END",
        f"CASE WHEN is_home THEN (coalesce(max_ltv_pct, 80) - {v['ltv']}) / 6.0 END",
        "CASE WHEN is_home THEN CASE WHEN title_status = 'clear' THEN 2.0 ELSE -2.5 END END",
        f"CASE WHEN {_VINTAGE} THEN ({v['years']} - 2.0) / 1.5 END", f"({cut} - {p}pd) / (0.5 * {cut})",
    ]
    if exact:
        out.append("CASE WHEN fraud THEN -3.0 ELSE 3.0 END")
    return [f"CAST({m} AS DOUBLE)" for m in out]


def margins_list(p: str, exact: bool) -> str:
    return "[" + ", ".join(_margins(p, exact)) + "]"


def weakness_sql(p: str, thin: str) -> str:
    """Arg-max over the six category totals by sorting a list of (score, order, name) structs."""
    def total(cat: str, positive: bool) -> str:
        feats = [f for f, c in R.FEATURE_CATEGORY.items() if c == cat and (positive or f in R.FALLBACK_FEATURES)]
        if not feats:
            return "NULL"
        terms = [f"({q(float(R.COEFFICIENTS[f]))}) * {p}{f}" for f in feats]
        s = " + ".join(f"greatest(0.0, {t})" if positive else t for t in terms)
        if not positive and cat == "repayment_history":
            s = f"CASE WHEN {thin} THEN NULL ELSE {s} END"
        return f"CASE WHEN is_home THEN {s} END" if cat == "collateral" else f"({s})"

    def best(positive: bool) -> str:
        items = ", ".join(
            f"{{'s': round(CAST({total(cat, positive)} AS DOUBLE), 9), 'o': {-i}, 'c': {q(cat)}}}" for i, cat in enumerate(R.CATEGORY_ORDER))
        return f"list_max(list_filter([{items}], lambda e: e.s IS NOT NULL))"

    return (f"CASE WHEN ({best(True)}).s >= 0.05 THEN ({best(True)}).c ELSE ({best(False)}).c END")


view("risk_x", "docs", f"SELECT *, {_pd('x_')} AS x_pd FROM (SELECT *, {_feature_sql(EXACT, 'x_')}, {_EFF} AS x_score FROM docs)")
view("risk_b", "docs", f"SELECT *, {_pd('b_')} AS b_pd FROM (SELECT *, {_feature_sql(BANDED, 'b_')} FROM docs)")

_IDX = q(R.BANDS["monthly"][1])
_STOP = "['the','and','for','with','from','that','this','over','under','above','before','where','which']"


def _words(text: str) -> str:
    return (f"list_distinct(list_filter(regexp_split_to_array(lower({text}), '[^a-z0-9]+'),"
            f" lambda w: length(w) > 3 AND NOT list_contains({_STOP}, w)))")


_KN = R.CLOSENESS_KNOTS
_CLOSE = "CASE WHEN b_worst <= -2.0 THEN 0.0 " + " ".join(
    f"WHEN b_worst <= {x1} THEN {y0} + ({y1} - {y0}) * (b_worst - ({x0})) / (({x1}) - ({x0}))" for (x0, y0), (x1, y1) in zip(_KN, _KN[1:])
) + " ELSE 4.0 END"

_WILL = ("CASE WHEN writeoffs > 0 OR max_dpd >= 90 THEN 0 WHEN max_dpd >= 60 THEN 1 WHEN max_dpd >= 30 OR bounces >= 2 THEN 2"
         " WHEN max_dpd >= 1 OR bounces = 1 THEN 3 ELSE 4 END")
_RATIO = (f"CASE WHEN segment = 'msme_business' THEN 1.25 / {case('dscr_band', R.CAPACITY_DSCR_MID)}"
          f" ELSE (CAST(foir_limit_pct AS DOUBLE) - {case('foir_headroom_band', R.CAPACITY_HEADROOM_MID)}) / foir_limit_pct END")
_CAP_B = ("greatest(0, CASE WHEN cap_ratio <= 0.6 THEN 4 WHEN cap_ratio <= 0.8 THEN 3 WHEN cap_ratio <= 1.0 THEN 2"
          " WHEN cap_ratio <= 1.2 THEN 1 WHEN cap_ratio IS NULL THEN 2 ELSE 0 END - CASE WHEN volatility = 'high' THEN 1 ELSE 0 END)")
_WITHIN = ("CASE WHEN segment = 'msme_business' THEN dscr >= 1e15 OR round(dscr, 6) >= 1.25 ELSE round(foir_headroom_pts, 6) >= 0 END")
_COLL = (f"greatest(0, {case('ltv_headroom_band', R.LTV_HEADROOM_LEVEL)} - CASE title_status WHEN 'disputed' THEN 2 WHEN 'pending_mutation' THEN 1 ELSE 0 END"
         " - CASE WHEN legal_opinion = 'adverse' THEN 1 ELSE 0 END - CASE WHEN valuation_spread_band = '>20%' THEN 1 ELSE 0 END)")
_TITLE = "title_status = 'clear' AND legal_opinion = 'positive'"
_RECV = _mon_year("address_text", "Received:.*?MY")
_ADDR = (f"NOT (contains(lower(address_text), 'prepaid') OR (address_kind = 'utility_bill' AND address_age >= 3)"
         f" OR (address_kind = 'rent_agreement' AND (address_age >= 12 OR coalesce({_mon_year('address_text', 'term.*?MY.*?MY', 3)} < {_RECV}, false)))"
         f" OR (address_kind = 'passport' AND coalesce({_mon_year('address_text', 'expires.*?MY')} < {_RECV}, false))"
         f" OR NOT list_contains(regexp_extract_all(address_text, '\\[ADDR(?:_[A-Z0-9]+)?\\]'), '[ADDR_1]'))")
_SYN = ("auto_generated OR (CASE WHEN phone_vintage_band = '<3m' THEN 1 ELSE 0 END + CASE WHEN email_domain = 'disposable' THEN 1 ELSE 0 END"
        " + CASE WHEN NOT history_consistent THEN 1 ELSE 0 END + CASE WHEN address_shared_band = '3+' THEN 1 ELSE 0 END) >= 2")
_MEMO = (f"tenure_months <= max_tenure_months AND len(list_filter(required_conditions, lambda r: len(list_filter("
         f"list_append(memo_conditions, memo_text), lambda o: len(list_intersect({_words('r')}, {_words('o')})) >= 0.8 * len({_words('r')}))) = 0)) = 0")
_RATE = ("round(abs(apr_stated_pct - apr_recomputed_pct), 9) < 0.3 AND"
         " abs(CAST(regexp_extract(memo_text, '\\brate\\s+(\\d+(?:\\.\\d+)?)\\s*%', 1) AS DOUBLE) - rate_pct) <= 0.006")


def _cov(exact: bool) -> dict[str, str]:
    return {"dscr_min_1_25": "(80 + k % 90) / 100.0 >= 1.25", "stock_statement_monthly": "k % 7 >= 6",
            "no_unapproved_borrowing": "k % 3 = 0", "insurance_current": "k % 5 <> 0"}


BASE_RULES = {
    "A_income_proof_current": "coalesce(income_doc_age <= 2, false)", "A_address_proof_valid": _ADDR,
    "A_statements_cover_months": "months_covered >= months_required",
    "A_fields_cohere": f"NOT (list_position({_IDX}, declared_income_band) - list_position({_IDX}, verified_income_band) >= 2"
                       " OR coalesce(tenure_months > months_to_superannuation, false)"
                       " OR (years_band = '>10y' AND age_band IN ('<20','20-24','25-29')) OR (years_band = '5-10y' AND age_band IN ('<20','20-24')))",
    "B_identity_coheres": "NOT auto_generated AND k % 97 <> 3 AND k % 89 <> 5 AND coalesce(fraud_type, '') <> 'identity_mismatch'",
    "B_salary_matches_employer": "len(list_distinct(list_filter([slip_org, employer_token, narration_token], lambda t: t IS NOT NULL))) <= 1",
    "B_gst_bank_consistent": "gst_ratio_band NOT IN ('<0.5', '>2')", "B_synthetic_identity_signals": _SYN,
    "C_willingness": _WILL, "C_recent_delinquency": "max_dpd >= 30", "C_capacity": _CAP_B, "C_foir_within_limit": _WITHIN,
    "C_income_stable": "volatility_cv < 0.25 AND months_history >= 12", "C_collateral_adequacy": _COLL,
    "C_collateral_title_clear": _TITLE,
    "D_closeness": f"greatest(0, least(4, CAST(round_even(round({_CLOSE}, 9), 0) AS BIGINT)))",
    **{qid: f"b_weakness = {q(cat)}" for qid, cat in R.DOUBT_CATEGORY.items()},
    "E_memo_matches_grid": f"coalesce({_MEMO}, false)", "E_rate_math_correct": _RATE,
    "E_disclosures_complete": "defect_disclosure IS NULL",
    **{f"E_disclosure_{d}": f"contains(lower(kfs_text), {q(h.lower())})" for d, h in R.DISCLOSURES},
    "F_ews_dpd_rising": "coalesce(dpd_rising, false)", "F_ews_emi_bounces": "coalesce(n_bounced >= 2, false)",
    "F_ews_partial_payments": "coalesce(n_partial >= 2, false)",
    "F_ews_balance_stress": "coalesce(balance_change_band = 'falling_40_plus', false)",
    **{f"F_covenant_{cid}": f"CASE WHEN segment = 'msme_business' THEN {x} END" for cid, x in _cov(False).items()},
}

view("baseline", "risk_b conduct",
     "SELECT *, " + ", ".join(f"{x} AS r_{n}" for n, x in BASE_RULES.items())
     + f" FROM (SELECT *, list_min({margins_list('b_', False)}) AS b_worst, {weakness_sql('b_', chr(39) + 'NTC' + chr(39) + ' = score_band')} AS b_weakness,"
     f" {_RATIO} AS cap_ratio FROM risk_b LEFT JOIN conduct USING (k))")

_FAILED = {
    "fraud": "fraud", "dscr_below_1_25": "segment = 'msme_business' AND dscr < 1.25",
    "foir_above_limit": "segment <> 'msme_business' AND foir_pct > foir_limit_pct",
    "ntc_not_eligible": "x_score IS NULL AND NOT (segment = 'salaried_personal' AND income_inr >= 50000)",
    "bureau_below_650": "x_score < 650", "max_dpd_60_plus": "max_dpd >= 60", "writeoff_or_settlement": "writeoffs > 0",
    "ltv_above_limit": "is_home AND ltv_pct > max_ltv_pct", "title_not_clear": "is_home AND title_status <> 'clear'",
    "business_vintage_below_2y": f"{_VINTAGE} AND years < 2.0", "pd_above_cutoff": f"x_pd >= {case(_SEG, R.PD_CUTOFF)}",
}
_CL = "CASE WHEN x_worst >= 1.0 THEN 4 WHEN x_worst >= 0.3 THEN 3 WHEN x_worst >= -0.3 THEN 2 WHEN x_worst >= -1.0 THEN 1 ELSE 0 END"
view("labelled", "risk_x conduct", f"""
SELECT *, len(failed_rules) = 0 AS sanctionable, {_CL} AS closeness_level,
 CASE WHEN k * 97 % 1000 / 1000.0 < x_pd THEN 'defaults' WHEN k * 97 % 1000 / 1000.0 < x_pd + least(0.3, 1.5 * x_pd) THEN 'slips'
  ELSE 'repays' END AS outcome_12m FROM (
 SELECT *, list_filter([{', '.join(f"CASE WHEN {x} THEN {q(n)} END" for n, x in _FAILED.items())}], lambda r: r IS NOT NULL) AS failed_rules,
  list_filter([CASE WHEN miss_income THEN 'income_proof' END, CASE WHEN miss_address THEN 'address_proof' END,
   CASE WHEN months_covered < months_required THEN 'statements' END, CASE WHEN miss_fields THEN 'fields_coherence' END], lambda r: r IS NOT NULL) AS missing_items,
  list_filter([CASE WHEN defect_conditions THEN 'memo_condition_mismatch' END, CASE WHEN defect_apr THEN 'apr_math_wrong' END,
   'disclosure_missing:' || {q([d for d, _ in R.DISCLOSURES])}[1 + defect_disclosure]], lambda r: r IS NOT NULL) AS memo_defects,
  list_min({margins_list('x_', True)}) AS x_worst, {weakness_sql('x_', 'x_score IS NULL')} AS primary_weakness
 FROM risk_x LEFT JOIN conduct USING (k))""")

_CAP_X = (f"greatest(0, CASE WHEN segment = 'msme_business' THEN {level(R.BANDS['dscr'][0], 'dscr')} ELSE"
          f" {level(R.BANDS['foir_headroom_pts'][0], 'foir_headroom_pts')} END - CASE WHEN volatility_cv >= 0.35 THEN 1 ELSE 0 END)")
TRUTH = {
    **{k: v for k, v in BASE_RULES.items() if k[0] in "CF"},
    "A_income_proof_current": "NOT miss_income", "A_address_proof_valid": "NOT miss_address",
    "A_statements_cover_months": "months_covered >= months_required", "A_fields_cohere": "NOT miss_fields",
    "B_identity_coheres": "coalesce(fraud_type NOT IN ('identity_mismatch', 'synthetic_identity'), true)",
    "B_salary_matches_employer": "coalesce(fraud_type <> 'salary_pattern_mismatch', true)",
    "B_gst_bank_consistent": "coalesce(fraud_type <> 'gst_bank_mismatch', true)",
    "B_synthetic_identity_signals": "coalesce(fraud_type = 'synthetic_identity', false)",
    "C_capacity": _CAP_X, "D_closeness": "closeness_level",
    **{qid: f"primary_weakness = {q(cat)}" for qid, cat in R.DOUBT_CATEGORY.items()},
    "E_memo_matches_grid": "NOT defect_conditions", "E_rate_math_correct": "NOT defect_apr",
    "E_disclosures_complete": "defect_disclosure IS NULL",
    **{f"E_disclosure_{d}": f"coalesce(defect_disclosure <> {i}, true)" for i, (d, _) in enumerate(R.DISCLOSURES)},
}
view("truths", "labelled", "SELECT *, " + ", ".join(f"{TRUTH[n]} AS t_{n}" for n in R.QIDS) + " FROM labelled")


def applicable(qid: str) -> str:
    segs = next(x[6] for x in R.QUESTIONS if x[0] == qid)
    cond = "true" if segs is None else f"segment IN ({', '.join(q(s) for s in segs)})"
    if qid == "B_salary_matches_employer":
        cond += " AND employment_type = 'salaried'"
    if qid == "B_gst_bank_consistent":
        cond += " AND has_gst"
    return cond


def unpivot(source: str, prefix: str, name: str) -> str:
    return " UNION ALL ".join(
        f"SELECT k, file_id, segment, CAST({i} AS BIGINT) AS q, {q(qid)} AS qid, {q(m)} AS module, {q(st)} AS stage, {q(ty)} AS qtype, {q(pol)} AS polarity,"
        f" {'true' if ro else 'false'} AS routing, CAST({prefix}{qid} AS DOUBLE) AS {name} FROM {source} WHERE {applicable(qid)}"
        for i, (qid, m, st, ty, pol, ro, _) in enumerate(R.QUESTIONS, 1))


view("asked", "baseline", unpivot("baseline", "r_", "rule_value"))
view("truth_long", "truths", unpivot("truths", "t_", "truth"))
view("sheet", "asked", """
SELECT *, failure_kind IS NULL AND (k + q) % 197 <> 0 AND rule_value IS NOT NULL AS answered FROM (
 SELECT *, CASE WHEN call_no % 151 = 0 THEN 'timeout' WHEN call_no % 173 = 1 THEN 'api_error' WHEN call_no % 211 = 2 THEN 'pii_blocked' END AS failure_kind,
  (k * 3 + q * 5) % 41 = 0 AS weak, (k * 7 + q * 13) % 53 = 0 AS flip, (k * 11 + q * 3) % 499 = 0 AS malformed
 FROM (SELECT *, k * 5 + CASE stage WHEN 'appraisal' THEN 0 WHEN 'sanction_docs' THEN 1 ELSE 2 END AS call_no FROM asked))""")
view("answers", "sheet", """
SELECT k, file_id, segment, q, qid, module, stage, qtype, polarity, routing, rule_value, failure_kind, answered,
 CASE WHEN answered AND qtype = 'noul' THEN CASE WHEN malformed THEN 1.5 WHEN (rule_value = 1) <> flip THEN s / CAST(100 AS DOUBLE)
   ELSE (100 - s) / CAST(100 AS DOUBLE) END END AS p,
 CASE WHEN answered AND qtype = 'score' THEN CASE WHEN malformed THEN [0.9, 0.9]
   ELSE list_transform(range(5), lambda i: CASE WHEN i = chosen THEN c / 100.0 ELSE (100 - c) / 400.0 END) END END AS probs,
 CASE WHEN answered AND qtype = 'score' THEN round(chosen * (c / 100.0) + (10 - chosen) * ((100 - c) / 400.0), 9) END AS level,
 CASE WHEN answered AND qtype = 'score' THEN CASE WHEN malformed THEN 1.5 ELSE c / 100.0 END END AS confidence, chosen
FROM (SELECT *, CASE WHEN weak THEN 60 ELSE 97 - k * q % 16 END AS s, CASE WHEN weak THEN 40 ELSE 95 - k * q % 20 END AS c,
  CAST(CASE WHEN flip THEN (CAST(rule_value AS BIGINT) + 2) % 5 ELSE rule_value END AS BIGINT) AS chosen FROM sheet)""")
