"""Fixed values shared by every operator: bands, policy, pricing, sanction grid, disclosures, questions, thresholds.

Everything in this module is data that has to equal the published decision policy for the results to be right. It
is small and constant, so operators turn it into Column expressions or inline tables that never grow with the book.
"""

from __future__ import annotations

# --- fixed values: segments -------------------------------------------------------------------------------------
SEGMENTS = ("salaried_personal", "self_employed", "msme_business", "secured_home")
PRODUCT_BY_SEGMENT = {
    "salaried_personal": "personal_loan_unsecured",
    "self_employed": "business_loan_self_employed",
    "msme_business": "msme_term_loan",
    "secured_home": "home_loan",
}
FOIR_LIMIT_PCT = {"salaried_personal": 55, "self_employed": 50, "msme_business": 80, "secured_home": 60}
MONTHS_REQUIRED = {"salaried_personal": 6, "self_employed": 12, "msme_business": 12, "secured_home": 6}
PD_CUTOFF = {"salaried_personal": 0.08, "self_employed": 0.10, "msme_business": 0.10, "secured_home": 0.05}
DSCR_MIN = 1.25
REFERENCE_YEAR = 2026
STATE_SCHEMA = "loan.state.v1"
STAGES = ("appraisal", "sanction_docs", "monitoring")

# --- fixed values: band tables (edges, labels, right-closed?) ---------------------------------------------------
BANDS: dict[str, tuple[list[float], list[str], bool]] = {
    "amount": ([1e5, 3e5, 5e5, 1e6, 2.5e6, 5e6, 1e7, 2e7, 5e7],
               ["<1L", "1-3L", "3-5L", "5-10L", "10-25L", "25-50L", "50L-1Cr", "1-2Cr", "2-5Cr", ">5Cr"], False),
    "monthly": ([1e4, 2.5e4, 5e4, 7.5e4, 1e5, 2e5, 5e5],
                ["<10k", "10-25k", "25-50k", "50-75k", "75k-1L", "1-2L", "2-5L", ">5L"], False),
    "foir_pct": ([30, 40, 50, 55, 60, 70], ["<30", "30-40", "40-50", "50-55", "55-60", "60-70", ">70"], True),
    "ltv_pct": ([60, 70, 75, 80, 85], ["<60", "60-70", "70-75", "75-80", "80-85", ">85"], True),
    "dscr": ([1, 1.25, 1.5, 2], ["<1", "1-1.25", "1.25-1.5", "1.5-2", ">2"], False),
    "gst_to_bank_ratio": ([0.5, 0.8, 1.2, 2], ["<0.5", "0.5-0.8", "0.8-1.2", "1.2-2", ">2"], True),
    "dpd": ([1, 30, 60, 90], ["0", "1-29", "30-59", "60-89", "90+"], False),
    "bureau_score": ([600, 650, 700, 750, 800], ["<600", "600-649", "650-699", "700-749", "750-799", "800+"], False),
    "age": ([20, 25, 30, 35, 40, 45, 50, 55, 60, 65],
            ["<20", "20-24", "25-29", "30-34", "35-39", "40-44", "45-49", "50-54", "55-59", "60-64", "65+"], False),
    "vintage_years": ([1, 2, 5, 10], ["<1y", "1-2y", "2-5y", "5-10y", ">10y"], False),
    "history_length": ([6, 12, 36, 84], ["<6m", "6-12m", "1-3y", "3-7y", ">7y"], False),
    "phone_vintage": ([3, 12, 36], ["<3m", "3-12m", "1-3y", ">3y"], False),
    "cash_deposit_share": ([0.05, 0.15, 0.30], ["<5%", "5-15%", "15-30%", ">30%"], False),
    "card_utilization": ([0.10, 0.30, 0.50, 0.75], ["<10%", "10-30%", "30-50%", "50-75%", ">75%"], False),
    "valuation_spread": ([0.05, 0.10, 0.20], ["<5%", "5-10%", "10-20%", ">20%"], False),
    "address_shared": ([1, 3], ["0", "1-2", "3+"], False),
    "volatility": ([0.25, 0.35], ["low", "moderate", "high"], False),
    "foir_headroom_pts": ([-10, 0, 10, 20], ["<-10", "-10-0", "0-10", "10-20", ">=20"], False),
    "ltv_headroom_pts": ([-5, 0, 8, 15], ["<-5", "-5-0", "0-8", "8-15", ">=15"], False),
    # amounts quoted in free text: the monthly scale below 10 lakh, the ticket scale from there up
    "redaction_amount": ([1e4, 2.5e4, 5e4, 7.5e4, 1e5, 2e5, 5e5, 1e6, 2.5e6, 5e6, 1e7, 2e7, 5e7],
                         ["<10k", "10-25k", "25-50k", "50-75k", "75k-1L", "1-2L", "2-5L", ">5L", "10-25L", "25-50L",
                          "50L-1Cr", "1-2Cr", "2-5Cr", ">5Cr"], False),
}

# --- fixed values: band midpoints read by the rules-only baseline -----------------------------------------------
MID_SCORE = {"<600": 570.0, "600-649": 625.0, "650-699": 675.0, "700-749": 725.0, "750-799": 775.0, "800+": 825.0}
MID_DPD = {"0": 0.0, "1-29": 15.0, "30-59": 45.0, "60-89": 75.0, "90+": 100.0}
MID_FOIR = {"<30": 24.0, "30-40": 35.0, "40-50": 45.0, "50-55": 52.5, "55-60": 57.5, "60-70": 64.5, ">70": 80.0}
MID_LTV = {"<60": 55.0, "60-70": 65.0, "70-75": 72.5, "75-80": 77.5, "80-85": 82.5, ">85": 90.0}
MID_DSCR = {"<1": 0.88, "1-1.25": 1.13, "1.25-1.5": 1.37, "1.5-2": 1.75, ">2": 2.3}
MID_CV = {"low": 0.10, "moderate": 0.22, "high": 0.40}
MID_VINTAGE = {"<1y": 0.6, "1-2y": 1.5, "2-5y": 3.4, "5-10y": 7.2, ">10y": 14.0}
MID_UTIL = {"<10%": 0.08, "10-30%": 0.20, "30-50%": 0.40, "50-75%": 0.625, ">75%": 0.84375}
MID_GST = {"<0.5": 0.4, "0.5-0.8": 0.65, "0.8-1.2": 1.0, "1.2-2": 1.6, ">2": 2.25}
MID_MONTHLY = {"<10k": 8000.0, "10-25k": 17500.0, "25-50k": 37500.0, "50-75k": 62500.0, "75k-1L": 87500.0,
               "1-2L": 150000.0, "2-5L": 350000.0, ">5L": 562500.0}
LOW_MONTHLY = {"<10k": 6000.0, "10-25k": 10000.0, "25-50k": 25000.0, "50-75k": 50000.0, "75k-1L": 75000.0,
               "1-2L": 100000.0, "2-5L": 200000.0, ">5L": 500000.0}
CAPACITY_DSCR_MID = {"<1": 0.85, "1-1.25": 1.125, "1.25-1.5": 1.375, "1.5-2": 1.75, ">2": 2.5}
CAPACITY_HEADROOM_MID = {"<-10": -15.0, "-10-0": -5.0, "0-10": 5.0, "10-20": 15.0, ">=20": 27.0}
LTV_HEADROOM_LEVEL = {"<-5": 0, "-5-0": 1, "0-8": 2, "8-15": 3, ">=15": 4}
CLOSENESS_KNOTS = ((-2.0, 0.0), (-1.0, 0.5), (-0.3, 1.5), (0.3, 2.5), (1.0, 3.5), (1.8, 4.0))

# --- fixed values: risk score -----------------------------------------------------------------------------------
COEFFICIENTS = {
    "intercept": -3.90, "seg_self_employed": 0.15, "seg_msme_business": -0.10, "seg_secured_home": -0.90,
    "bureau_score": -0.80, "ntc": 0.55, "foir": 0.60, "income_volatility": 0.30, "max_dpd": 0.55, "emi_bounces": 0.35,
    "writeoff": 0.90, "ltv": 0.50, "title_risk": 0.60, "business_vintage": -0.35, "gst_inconsistency": 0.35,
    "income_gap": 0.30, "card_utilization": 0.25, "fraud_flag": 1.20,
}
FEATURES = tuple(k for k in COEFFICIENTS if k != "intercept")
FOIR_CENTRE = {"salaried_personal": 0.40, "self_employed": 0.38, "msme_business": 0.60, "secured_home": 0.45}
VINTAGE_CENTRE = {"salaried_personal": 5.0, "self_employed": 6.0, "msme_business": 9.0, "secured_home": 6.0}
VOL_CENTRE = {"salaried": 0.07, "self_employed": 0.28, "business_owner": 0.30}
VOL_SCALE = {"salaried": 0.08, "self_employed": 0.15, "business_owner": 0.15}
FEATURE_CATEGORY = {
    "bureau_score": "repayment_history", "max_dpd": "repayment_history", "emi_bounces": "repayment_history",
    "writeoff": "repayment_history", "ntc": "bureau_thin_file", "foir": "debt_burden", "card_utilization": "debt_burden",
    "income_volatility": "employment_or_business_stability", "business_vintage": "employment_or_business_stability",
    "ltv": "collateral", "title_risk": "collateral", "gst_inconsistency": "income_documentation",
    "income_gap": "income_documentation",
}
CATEGORY_ORDER = ("repayment_history", "debt_burden", "employment_or_business_stability", "income_documentation",
                  "collateral", "bureau_thin_file")
FALLBACK_FEATURES = ("bureau_score", "foir", "card_utilization", "income_volatility", "business_vintage", "ltv")

# --- fixed values: sanction grid (product, band, min exclusive, max inclusive, max tenure, max LTV, conditions) --
_NACH_SAL = "Auto-debit (NACH) mandate for the EMI from the salary account"
_NACH_BIZ = "Auto-debit (NACH) mandate for the EMI from the business current account"
_KYC = "KYC (PAN and address proof) verified before disbursal"
_EMPLOYER = "Employment verified directly with the employer before disbursal"
_GUARANTOR = "Guarantor with satisfactory bureau standing (unsecured loans above 10 lakh)"
_LIFE = "Credit life insurance cover for the loan amount, bank as beneficiary"
_ITR = "Latest ITR and GST returns verified against bank statements"
_PG_PROP = "Personal guarantee of the proprietor or partners"
_COLL = "Collateral security by mortgage of immovable property with full cover"
_UDYAM = "Valid Udyam registration on file"
_CGTMSE = "CGTMSE guarantee cover obtained for the collateral-free loan"
_ASSET = "Insurance of the financed assets with the bank as loss payee"
_HYPO = "Hypothecation of stock and book debts in favour of the bank (loans above 50 lakh)"
_PG_PROM = "Personal guarantee of the promoters"
_ESCROW = "Escrow of business receivables with the bank"
_PROP_INS = "Property insurance assigned to the bank for the life of the loan"
_MORTGAGE = "Equitable mortgage created over the property before disbursal"
_LEGAL = "Positive legal opinion on title from the bank's panel advocate"
_COAPP = "Income of the co-applicant documented where it is counted for eligibility"
_VALUERS = "Independent valuation by two empanelled valuers (loans above 75 lakh)"
GRID = (
    ("personal_loan_unsecured", "<=5L", 0, 500000, 48, None, (_NACH_SAL, _KYC)),
    ("personal_loan_unsecured", "5-10L", 500000, 1000000, 60, None, (_NACH_SAL, _KYC, _EMPLOYER)),
    ("personal_loan_unsecured", "10-25L", 1000000, 2500000, 60, None, (_NACH_SAL, _KYC, _EMPLOYER, _GUARANTOR)),
    ("personal_loan_unsecured", "25-40L", 2500000, 4000000, 60, None,
     (_NACH_SAL, _KYC, _EMPLOYER, _GUARANTOR, _LIFE)),
    ("business_loan_self_employed", "<=10L", 0, 1000000, 60, None, (_NACH_BIZ, _KYC, _ITR)),
    ("business_loan_self_employed", "10-50L", 1000000, 5000000, 84, None, (_NACH_BIZ, _KYC, _ITR, _PG_PROP)),
    ("business_loan_self_employed", "50L-2Cr", 5000000, 20000000, 84, None, (_NACH_BIZ, _KYC, _ITR, _PG_PROP, _COLL)),
    ("msme_term_loan", "<=50L", 0, 5000000, 84, None, (_UDYAM, _CGTMSE, _ASSET)),
    ("msme_term_loan", "50L-2Cr", 5000000, 20000000, 96, None, (_UDYAM, _CGTMSE, _ASSET, _HYPO, _PG_PROM)),
    ("msme_term_loan", "2-5Cr", 20000000, 50000000, 120, None, (_UDYAM, _CGTMSE, _ASSET, _HYPO, _PG_PROM, _ESCROW)),
    ("home_loan", "<=30L", 0, 3000000, 300, 80, (_PROP_INS, _MORTGAGE, _LEGAL)),
    ("home_loan", "30-75L", 3000000, 7500000, 360, 80, (_PROP_INS, _MORTGAGE, _LEGAL, _COAPP)),
    ("home_loan", ">75L", 7500000, None, 360, 75, (_PROP_INS, _MORTGAGE, _LEGAL, _VALUERS)),
)
GRID_VERSION = "grid-v1"

# --- fixed values: Key Fact Statement disclosures (id, heading) -------------------------------------------------
DISCLOSURES = (
    ("apr", "Annual Percentage Rate (APR)"),
    ("total_cost_of_credit", "Total cost of credit"),
    ("fees_and_charges_breakup", "Fees and charges"),
    ("cooling_off_period", "Cooling-off period"),
    ("grievance_redressal_officer", "Grievance redressal officer"),
    ("recovery_agent_policy", "Recovery agent policy"),
    ("repayment_schedule", "Repayment schedule"),
    ("penal_charges", "Penal charges"),
)

# --- fixed values: routing policy -------------------------------------------------------------------------------
POLICY_VERSION = "policy-2026.09-v1"
MIN_CONFIDENCE = {"noul": 0.5, "choice": 0.5, "score": 0.45}
A_FAIL_BELOW = 0.5
B_BAD_AT_LEAST = 0.8
B_GOOD_AT_MOST = 0.2
E_FAIL_BELOW = 0.5
APR_TOLERANCE_PP = 0.10
F_WARN_AT = 0.6
F_BREACH_WEIGHT = 2
WEIGHTS = {
    "salaried_personal": {"C_willingness": 0.30, "C_capacity": 0.30, "C_foir_within_limit": 0.15,
                          "C_income_stable": 0.10, "C_recent_delinquency": 0.15},
    "self_employed": {"C_willingness": 0.25, "C_capacity": 0.30, "C_foir_within_limit": 0.15, "C_income_stable": 0.15,
                      "C_recent_delinquency": 0.15},
    "msme_business": {"C_willingness": 0.25, "C_capacity": 0.35, "C_foir_within_limit": 0.15, "C_income_stable": 0.10,
                      "C_recent_delinquency": 0.15},
    "secured_home": {"C_willingness": 0.25, "C_capacity": 0.25, "C_foir_within_limit": 0.10, "C_income_stable": 0.05,
                     "C_recent_delinquency": 0.10, "C_collateral_adequacy": 0.15, "C_collateral_title_clear": 0.10},
}
PASS_AT, BORDERLINE_AT = 0.70, 0.50
QUEUE_OWNER = {
    "credit_review": "credit_exceptions", "fraud_investigation": "fraud_investigation",
    "deficiency_ops": "deficiency_ops", "decline_confirmation": "decline_confirmation",
    "disbursal_correction": "disbursal_correction", "watchlist_review": "watchlist_review",
}
OWNERS = {
    "credit_exceptions": ("Zonal Credit Head", "UNASSIGNED"),
    "fraud_investigation": ("Head, Fraud Risk Control Unit", "UNASSIGNED"),
    "deficiency_ops": ("Branch Operations Manager", "UNASSIGNED"),
    "decline_confirmation": ("Credit Manager (sanctioning authority)", "UNASSIGNED"),
    "disbursal_correction": ("Central Processing Unit Lead", "UNASSIGNED"),
    "watchlist_review": ("Credit Monitoring Head", "UNASSIGNED"),
    "model_risk": ("Chief Risk Officer (model risk)", "UNASSIGNED"),
}
OUTCOME_QUEUE = {
    "PROCEED_TO_SANCTIONING_AUTHORITY": None, "DECLINE_RECOMMENDED": "decline_confirmation",
    "DEFICIENCY_NOTICE": "deficiency_ops", "FRAUD_INVESTIGATION": "fraud_investigation",
    "DISBURSAL_CLEARED_FOR_HUMAN_SIGNOFF": None, "DISBURSAL_BLOCKED": "disbursal_correction",
    "WATCHLIST_T0": None, "WATCHLIST_T1": "watchlist_review", "WATCHLIST_T2": "watchlist_review",
    "WATCHLIST_T3": "watchlist_review",
}
STAGE_FAILURE_QUEUE = {"appraisal": "credit_review", "sanction_docs": "disbursal_correction",
                       "monitoring": "watchlist_review"}
FAILURE_CODE = {
    "timeout": "MODEL_TIMEOUT", "api_error": "MODEL_ERROR", "rate_limited": "MODEL_RATE_LIMITED",
    "connection_error": "MODEL_UNREACHABLE", "circuit_open": "CIRCUIT_OPEN", "pii_blocked": "PII_BLOCKED",
    "forced_human": "FORCED_HUMAN_REVIEW",
}
REVIEWER_CODES = {
    "credit_review": ("ACCEPT_AS_ADVISED", "MODIFY_TERMS", "REJECT_MODEL_MISREAD_DOCS", "REJECT_MODEL_MISREAD_CONDUCT",
                      "REJECT_MODEL_MISREAD_CAPACITY", "OVERRIDE_POLICY_EXCEPTION", "MANUAL_APPRAISAL_COMPLETED"),
    "fraud_investigation": ("FRAUD_CONFIRMED", "FRAUD_CLEARED", "FRAUD_INCONCLUSIVE_ESCALATED"),
    "deficiency_ops": ("DEFICIENCY_CURED", "DEFICIENCY_NOT_CURABLE", "DEFICIENCY_MODEL_MISREAD"),
    "decline_confirmation": ("DECLINE_CONFIRMED", "DECLINE_OVERRIDDEN_TO_REVIEW", "DECLINE_MODEL_MISREAD"),
    "disbursal_correction": ("MEMO_CORRECTED", "KFS_CORRECTED", "DISBURSAL_BLOCK_FALSE_ALARM"),
    "watchlist_review": ("WATCHLIST_ESCALATED", "WATCHLIST_MONITOR", "WATCHLIST_FALSE_ALARM", "WATCHLIST_RESOLVED"),
}
SYSTEM_CODE_TEXT = {
    "LOW_CONFIDENCE": "A routing question was answered below its minimum confidence (or not at all).",
    "FRAUD_SIGNAL": "A confident fraud signal was raised.",
    "READINESS_FAIL": "A required item is missing or invalid.",
    "COMPOSITE_PASS": "The appraisal composite is in the pass band.",
    "COMPOSITE_BORDERLINE": "The appraisal composite is in the borderline band.",
    "COMPOSITE_FAIL": "The appraisal composite is in the fail band.",
    "NO_APPRAISAL_ANSWERS": "No appraisal answers were usable, so no composite could be computed.",
}
DECISION_VERBS = ("accept", "modify", "reject")

# --- fixed values: pricing --------------------------------------------------------------------------------------
PRICING_VERSION = "pricing-2026.09-v1"
BENCHMARK_PCT = "8.75"
SPREAD_PCT = {"salaried_personal": "3.0", "self_employed": "3.75", "msme_business": "3.0", "secured_home": "0.25"}
PREMIUM_TIERS = (("pass", 0.85, "0.0"), ("pass", 0.70, "0.5"), ("borderline_approved_by_human", 0.0, "1.25"))
BUREAU_ADJ_PCT = {"800+": "-0.25", "750-799": "0.0", "700-749": "0.25", "650-699": "0.5", "NTC": "0.75"}
BUREAU_ADJ_DEFAULT = "1.0"
FLOOR_PCT = {"salaried_personal": "10.5", "self_employed": "11.0", "msme_business": "10.0", "secured_home": "8.5"}
CAP_PCT = {"salaried_personal": "16.0", "self_employed": "17.0", "msme_business": "16.0", "secured_home": "11.5"}
FEE_PCT = {"salaried_personal": "1.5", "self_employed": "1.5", "msme_business": "1.0", "secured_home": "0.5"}

# --- fixed values: evaluation thresholds ------------------------------------------------------------------------
MIN_GROUP_N = 100
PROCEED_RATIO_MIN = 0.80
EQ_OPP_GAP_MAX = 0.05
GROUP_ECE_GAP_MAX = 0.03
CIL_GAP_MAX = 0.05
PROBE_AUC_MAX = 0.60
ECE_MAX = 0.08
CONFIDENT_WRONG_MAX = 0.02
CALIBRATION_MIN_N = 200
CALIBRATION_FAIL_SHARE_MAX = 0.25
BASELINE_MARGIN_PP = 2.0
RECALL_MIN = {"A": 0.90, "B": 0.80, "E": 0.90}
NON_BORDERLINE_MIN, BORDERLINE_SHARE_MAX = 0.85, 0.35
FALLBACK_MAX, USD_PER_FILE_MAX = 0.05, 0.01
USD_PER_MILLION_TOKENS = 0.042
TIMEOUT_BUDGET_MS = 2000.0
RATE_LIMIT_RPM = 1000
BREAKER_FAILURES, BREAKER_COOLDOWN_S = 5, 30.0
# numpy linspace(0, 1, 11): three of the inner edges are not the nearest double to n/10
BIN_EDGES = (0.0, 0.1, 0.2, 0.30000000000000004, 0.4, 0.5, 0.6000000000000001, 0.7000000000000001, 0.8, 0.9, 1.0)

# --- fixed values: question catalogue (qid, module, stage, type, polarity, routing, segments or None for all) ----
_HOME, _MSME = ("secured_home",), ("msme_business",)
COVENANTS = ("dscr_min_1_25", "stock_statement_monthly", "no_unapproved_borrowing", "insurance_current")
DOUBT_CATEGORY = {
    "D_doubt_income_documentation": "income_documentation", "D_doubt_repayment_history": "repayment_history",
    "D_doubt_debt_burden": "debt_burden", "D_doubt_stability": "employment_or_business_stability",
    "D_doubt_collateral": "collateral", "D_doubt_thin_file": "bureau_thin_file",
}
QUESTIONS = (
    [(q, "A", "appraisal", "noul", "yes_is_good", True, None) for q in (
        "A_income_proof_current", "A_address_proof_valid", "A_statements_cover_months", "A_fields_cohere")]
    + [("B_identity_coheres", "B", "appraisal", "noul", "yes_is_good", True, None),
       ("B_salary_matches_employer", "B", "appraisal", "noul", "yes_is_good", True, ("salaried_personal", "secured_home")),
       ("B_gst_bank_consistent", "B", "appraisal", "noul", "yes_is_good", True, ("msme_business", "self_employed")),
       ("B_synthetic_identity_signals", "B", "appraisal", "noul", "yes_is_bad", True, None),
       ("C_willingness", "C", "appraisal", "score", "ordinal_high_is_good", True, None),
       ("C_recent_delinquency", "C", "appraisal", "noul", "yes_is_bad", True, None),
       ("C_capacity", "C", "appraisal", "score", "ordinal_high_is_good", True, None),
       ("C_foir_within_limit", "C", "appraisal", "noul", "yes_is_good", True, None),
       ("C_income_stable", "C", "appraisal", "noul", "yes_is_good", True, None),
       ("C_collateral_adequacy", "C", "appraisal", "score", "ordinal_high_is_good", True, _HOME),
       ("C_collateral_title_clear", "C", "appraisal", "noul", "yes_is_good", True, _HOME),
       ("D_closeness", "D", "appraisal", "score", "ordinal_high_is_good", False, None)]
    + [(q, "D", "appraisal", "noul", "yes_is_bad", False, _HOME if q == "D_doubt_collateral" else None)
       for q in DOUBT_CATEGORY]
    + [(q, "E", "sanction_docs", "noul", "yes_is_good", True, None)
       for q in ("E_memo_matches_grid", "E_rate_math_correct", "E_disclosures_complete")]
    + [(f"E_disclosure_{d}", "E", "sanction_docs", "noul", "yes_is_good", False, None) for d, _ in DISCLOSURES]
    + [(q, "F", "monitoring", "noul", "yes_is_bad", True, None) for q in (
        "F_ews_dpd_rising", "F_ews_emi_bounces", "F_ews_partial_payments", "F_ews_balance_stress")]
    + [(f"F_covenant_{c}", "F", "monitoring", "noul", "yes_is_good", True, _MSME) for c in COVENANTS]
)
QIDS = tuple(q[0] for q in QUESTIONS)
SCORE_QIDS = tuple(q[0] for q in QUESTIONS if q[3] == "score")
SCORE_LEVELS = 5

# --- fixed values: audit event types ----------------------------------------------------------------------------
EVENT_TYPES = ("MODEL_CALL", "MODEL_FAILURE", "PII_BLOCK", "POLICY_OUTCOME", "PRICING", "QUEUED", "HUMAN_DECISION",
               "MONITOR_ALERT", "SYSTEM")
GENESIS_HASH = "0" * 64
