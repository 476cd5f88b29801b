"""Deterministic answers: the rules-only baseline, the credit-policy labels and per-question truth.

Each rule is one SQL expression; all of them are evaluated in one projection per file and unpivoted once. The
baseline reads bands and redacted text (what a state shows), the labels read exact values.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditloom import reference as R
from creditloom.functions import bands as B
from creditloom.operators.features import BALANCE_CHANGE, EFFECTIVE_SCORE, risk_inputs, with_risk, words_sql

# --- fixed values: markers and patterns the document rules look for ---------------------------------
WRONG_KIND_MARKERS = ("prepaid", "not a billing statement", "plain paper", "unregistered", "address page is missing",
                      "photo page only")
AUTO_GENERATED = "Auto-generated document; no signature required."
MONTH_NAMES = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")
SUPERANNUATION = r"(?i)superannuation:?\\s*(\\d+)\\s*months"
MEMO_RATE = r"(?i)\\brate\\s+(\\d+(?:\\.\\d+)?)\\s*%"
TOO_LONG = {">10y": ("<20", "20-24", "25-29"), "5-10y": ("<20", "20-24")}

_MON_YEAR = r"\\b(" + "|".join(MONTH_NAMES) + r")\\s+(\\d{4})\\b"


def _list(values: Iterable[str]) -> str:
    return ", ".join("'" + v.replace("'", "\\'") + "'" for v in values)


def _doc(doc_type: str) -> str:
    """The file's first document of a type."""
    return f"get(docs, CAST(array_position(docs.doc_type, {doc_type}) - 1 AS INT))"


def _month_index(text: str, pattern: str, group: int = 1) -> str:
    """year * 12 + month of the captured ``Mon YYYY``; NULL when the pattern is absent."""
    year = f"regexp_extract({text}, '{pattern}', {group + 1})"
    month = f"array_position(array({_list(MONTH_NAMES)}), regexp_extract({text}, '{pattern}', {group}))"
    return f"(CASE WHEN {year} <> '' THEN CAST({year} AS BIGINT) * 12 + {month} END)"


def _no(cond: str) -> str:
    """A failing test that is unknown does not fail."""
    return f"coalesce({cond}, false)"


# ------------------------------------------------------------------------------------------------ modules A and B

_NEEDED = "CASE WHEN employment_type = 'salaried' THEN 'salary_slip' ELSE 'itr' END"
INCOME_PROOF = _no(_doc(_NEEDED) + ".month_age <= 2")


ADDRESS_DOC = "get(filter(docs, d -> startswith(d.doc_type, 'address_proof')), 0) AS address_doc"


def _address_proof() -> str:
    received = _month_index("address_doc.text", f"Received:.*?{_MON_YEAR}")
    term_end = _month_index("address_doc.text", f"term.*?{_MON_YEAR}.*?{_MON_YEAR}", 3)
    expiry = _month_index("address_doc.text", f"expires.*?{_MON_YEAR}")
    shown = r"regexp_extract_all(address_doc.text, '(\\[ADDR(?:_[A-Z0-9]+)?\\])', 1)"
    wrong = " OR ".join(f"contains(lower(address_doc.text), '{m}')" for m in WRONG_KIND_MARKERS)
    bad = [
        wrong, "endswith(address_doc.doc_type, 'utility_bill') AND address_doc.month_age >= 3",
        f"endswith(address_doc.doc_type, 'rent_agreement') AND (address_doc.month_age >= 12 OR {_no(term_end + ' < ' + received)})",
        f"endswith(address_doc.doc_type, 'passport') AND {_no(expiry + ' < ' + received)}",
        f"size({shown}) > 0 AND NOT array_contains({shown}, '[ADDR_1]')",
    ]
    test = " OR ".join(f"({b})" for b in bad)
    return f"coalesce(NOT ({test}), false)"


def _fields_cohere() -> str:
    labels = f"array({_list(R.BANDS['monthly'][1])})"
    gap = f"array_position({labels}, declared_income_band) - array_position({labels}, verified_income_band) >= 2"
    letter = _doc("'employer_letter'") + ".text"
    left = f"regexp_extract({letter}, '{SUPERANNUATION}', 1)"
    past = f"CASE WHEN {left} <> '' THEN tenure_months > CAST({left} AS BIGINT) END"
    long = " OR ".join(f"(years_band = '{y}' AND age_band IN ({_list(ages)}))" for y, ages in TOO_LONG.items())
    return f"NOT ({_no(gap)} OR {_no(past)} OR {_no(long)})"


def _tokens(text: str, kind: str) -> str:
    return rf"regexp_extract_all({text}, '(\\[{kind}(?:_[A-Z0-9]+)?\\])', 1)"


AUTO_FOOTER = f"exists(docs, d -> contains(d.text, '{AUTO_GENERATED}'))"


def _identity() -> str:
    text = _doc("'pan_card_text'") + ".text"
    name = rf"regexp_extract({text}, '\\bName:\\s*(\\[[A-Z]+(?:_[A-Z0-9]+)?\\])', 1)"
    mismatch = (f"exists({_tokens(text, 'PAN')}, t -> t <> '[PAN_1]') OR exists({_tokens(text, 'DOB')}, t -> t <> '[DOB_1]')"
                f" OR ({name} <> '' AND {name} <> '[APPLICANT]')")
    return f"NOT {AUTO_FOOTER} AND NOT {_no('(' + mismatch + ')')}"


def _salary() -> str:
    org = f"get({_tokens(_doc(chr(39) + 'salary_slip' + chr(39)) + '.text', 'ORG')}, 0)"
    return f"size(array_distinct(array_compact(array({org}, employer_token, narration_token)))) <= 1"


SYNTHETIC = (f"({AUTO_FOOTER} OR CAST(phone_vintage_band = '<3m' AS INT) + CAST(email_domain = 'disposable' AS INT)"
             " + CAST(NOT history_consistent AS INT) + CAST(address_shared_band = '3+' AS INT) >= 2)")

# ------------------------------------------------------------------------------------------------ module C

# DPD bands end exactly on the DPD thresholds, so the banded and exact forms of this rule agree
WILLINGNESS = ("CASE WHEN writeoffs > 0 OR max_dpd >= 90 THEN 0 WHEN max_dpd >= 60 THEN 1 WHEN max_dpd >= 30 OR bounces >= 2 THEN 2"
               " WHEN max_dpd >= 1 OR bounces = 1 THEN 3 ELSE 4 END")
_BURDEN = (f"CASE WHEN segment = 'msme_business' THEN 1.25D / {B.lookup_sql(R.CAPACITY_DSCR_MID, 'dscr_band')}"
           f" ELSE (CAST(foir_limit_pct AS DOUBLE) - {B.lookup_sql(R.CAPACITY_HEADROOM_MID, 'foir_headroom_band')}) / foir_limit_pct END")
CAPACITY_BANDED = (f"greatest(0, (CASE WHEN {_BURDEN} <= 0.6D THEN 4 WHEN {_BURDEN} <= 0.8D THEN 3 WHEN {_BURDEN} <= 1D THEN 2"
                   f" WHEN {_BURDEN} <= 1.2D THEN 1 WHEN {_BURDEN} IS NULL THEN 2 ELSE 0 END) - CAST(volatility = 'high' AS INT))")


def level_sql(edges, x: str) -> str:
    """Index of the left-closed band of a value rounded to six places."""
    arms = " ".join(f"WHEN {x} < {B.shifted(e)} THEN {i}" for i, e in enumerate(edges))
    return f"(CASE {arms} ELSE {len(edges)} END)"


CAPACITY_EXACT = (f"greatest(0, (CASE WHEN segment = 'msme_business' THEN {level_sql(R.BANDS['dscr'][0], 'dscr')}"
                  f" ELSE {level_sql(R.BANDS['foir_headroom_pts'][0], 'foir_headroom_pts')} END) - CAST(volatility_cv >= 0.35D AS INT))")
FOIR_WITHIN = (f"CASE WHEN segment = 'msme_business' THEN dscr >= {B.shifted(R.DSCR_MIN)}"
               f" ELSE foir_headroom_pts >= {B.shifted(0)} END")
COLLATERAL = (f"greatest(0, {B.lookup_sql(R.LTV_HEADROOM_LEVEL, 'ltv_headroom_band')}"
              f" - {B.lookup_sql({'clear': 0, 'pending_mutation': 1, 'disputed': 2}, 'title_status')}"
              " - CAST(legal_opinion = 'adverse' AS INT) - CAST(valuation_spread_band = '>20%' AS INT))")

# ------------------------------------------------------------------------------------------------ module D

_VINTAGE_APPLIES = "(segment IN ('self_employed', 'msme_business') OR (is_home AND employment_type = 'self_employed'))"


def margins(prefix: str, *, exact: bool) -> dict[str, str]:
    """Signed distance to each sanction rule, in comparable units; NULL where a rule does not apply."""
    v = risk_inputs(exact=exact)
    cutoff = B.lookup_sql(R.PD_CUTOFF, "segment")
    dscr = "dscr" if exact else B.lookup_sql(R.MID_DSCR, "dscr_band")
    foir = "foir_pct" if exact else B.lookup_sql(R.MID_FOIR, "foir_band")
    income = "income_inr" if exact else B.lookup_sql(R.LOW_MONTHLY, "verified_income_band")
    bonus = "" if exact else " + 0.5D"
    thin = (f"CASE WHEN segment = 'salaried_personal' AND {income} >= 50000"
            f" THEN least(2D, ({income} - 50000) / 25000D{bonus}) ELSE -2D END")
    out = {
        "capacity": f"CASE WHEN segment = 'msme_business' THEN ({dscr} - {R.DSCR_MIN}D) / 0.35D ELSE (foir_limit_pct - {foir}) / 10D END",
        "bureau": f"coalesce(({v['score']} - 650D) / 40D, {thin})",
        "dpd": f"(60D - {v['dpd']}) / 20D", "writeoff": "CASE WHEN writeoffs = 0 THEN 2D ELSE -2.5D END",
        "ltv": f"CASE WHEN is_home THEN (coalesce(max_ltv_pct, 80D) - {v['ltv']}) / 6D END",
        "title": "CASE WHEN is_home THEN CASE WHEN title_status = 'clear' THEN 2D ELSE -2.5D END END",
        "vintage": f"CASE WHEN {_VINTAGE_APPLIES} THEN ({v['years']} - 2D) / 1.5D END",
        "pd": f"({cutoff} - {prefix}pd) / (0.5D * {cutoff})",
    }
    if exact:
        out["fraud"] = "CASE WHEN fraud THEN -3D ELSE 3D END"
    return out


def smallest(prefix: str, *, exact: bool) -> str:
    return f"array_min(array({', '.join(margins(prefix, exact=exact).values())}))"


def closeness_banded(worst: str) -> str:
    """Ordinal level: piecewise linear between the knots, then half-to-even, the rounding the answer is defined with."""
    k = R.CLOSENESS_KNOTS
    arms = " ".join(f"WHEN {worst} <= {x1}D THEN {y0}D + {y1 - y0}D * ({worst} - ({x0}D)) / ({x1}D - ({x0}D))"
                    for (x0, y0), (x1, y1) in zip(k, k[1:], strict=False))
    return f"greatest(0, least(4, CAST(rint(round(CASE WHEN {worst} <= {k[0][0]}D THEN 0D {arms} ELSE 4D END, 9)) AS INT)))"


def closeness_exact(worst: str) -> str:
    return f"CASE WHEN {worst} >= 1 THEN 4 WHEN {worst} >= 0.3D THEN 3 WHEN {worst} >= -0.3D THEN 2 WHEN {worst} >= -1 THEN 1 ELSE 0 END"


def weakness_sums(prefix: str, thin: str) -> list[str]:
    """Each category's contributions, positive ones and fallback ones, in units of the ninth place; NULL where it does not apply."""
    def total(cat: str, positive: bool) -> str:
        feats = [f for f, x in R.FEATURE_CATEGORY.items() if x == cat and (positive or f in R.FALLBACK_FEATURES)]
        if not feats:
            return "CAST(NULL AS DOUBLE)"
        terms = [f"({R.COEFFICIENTS[f]}D) * {prefix}{f}" for f in feats]
        s = " + ".join(f"greatest(0D, {t})" if positive else t for t in terms)
        if cat == "repayment_history" and not positive:
            s = f"CASE WHEN NOT ({thin}) THEN {s} END"
        return f"CASE WHEN is_home THEN {s} END" if cat == "collateral" else s

    return [f"floor(({total(cat, positive)}) * 1e9D + 0.5D) AS {prefix}{tag}_{cat}" for tag, positive in (("up", True), ("any", False)) for cat in R.CATEGORY_ORDER]


def weakness(prefix: str) -> str:
    """Category with the largest positive contribution; ties follow the fixed order.

    The category sums of ``weakness_sums`` lie in the file's own row, so the arg-max needs no explode, window or shuffle.
    """
    def first(tag: str) -> str:
        sums = [f"{prefix}{tag}_{cat}" for cat in R.CATEGORY_ORDER]
        return "CASE " + f"greatest({', '.join(sums)}) " + " ".join(f"WHEN {x} THEN '{cat}'" for cat, x in zip(R.CATEGORY_ORDER, sums, strict=True)) + " END"

    return f"CASE WHEN greatest({', '.join(f'{prefix}up_{cat}' for cat in R.CATEGORY_ORDER)}) >= 50000000 THEN {first('up')} ELSE {first('any')} END"


# ------------------------------------------------------------------------------------------------ module E


def _memo_grid() -> str:
    """Tenure within the grid and each required condition stated: 80 percent of its words in one memo sentence."""
    offered = f"transform(concat(memo_conditions, array(memo_text)), t -> {words_sql('t')})"
    # the memo's word lists are named once: the outer transform runs over a single element
    body = "forall(required_words, r -> exists(z, o -> size(array_intersect(r, o)) >= 0.8D * size(r)))"
    # a condition repeated word for word needs no comparison; the others are compared by their words
    stated = (f"CASE WHEN size(array_except(required_conditions, memo_conditions)) = 0 THEN true"
              f" ELSE get(transform(array({offered}), z -> {body}), 0) END")
    return _no(f"tenure_months <= max_tenure_months AND {stated}")


_QUOTED = f"regexp_extract(memo_text, '{MEMO_RATE}', 1)"
RATE_MATH = ("CASE WHEN apr_stated_pct IS NOT NULL AND apr_recomputed_pct IS NOT NULL THEN"
             " round(abs(apr_stated_pct - apr_recomputed_pct), 9) < 0.3D AND NOT "
             + _no(f"({_QUOTED} <> '' AND abs(try_cast({_QUOTED} AS DOUBLE) - rate_pct) > 0.006D)") + " END")


def _heading(heading: str) -> str:
    return f"contains(lower(kfs_text), '{heading.lower()}')"


# ------------------------------------------------------------------------------------------------ module F

# the last four steps; a step before the first month is NULL
_RISES = "(" + " + ".join(f"CAST(coalesce(get(months.dpd, size(months) - {i}) > get(months.dpd, size(months) - {i + 1}), false) AS INT)" for i in range(1, 5)) + ")"
EARLY_WARNINGS = {
    "F_ews_dpd_rising": _no(f"(array_max(months.dpd) >= 30 OR {_RISES} >= 3)"),
    "F_ews_emi_bounces": _no("size(filter(months, m -> m.bounced)) >= 2"),
    "F_ews_partial_payments": _no("size(filter(months, m -> m.partial)) >= 2"),
    "F_ews_balance_stress": _no(f"{BALANCE_CHANGE} = 'falling_40_plus'"),
}


def covenant_from_text(cid: str, v: str = "v") -> str:
    """Compliance read from the evidence sentence first, then from the reported value."""
    low = f"lower({v}.evidence)"

    def number(pattern: str) -> str:
        got = f"regexp_extract({low}, '{pattern}', 1)"
        return f"coalesce(CASE WHEN {got} <> '' THEN CAST({got} AS DOUBLE) END, {v}.reported)"

    num = r"(\\d+(?:\\.\\d+)?)"
    if cid == "dscr_min_1_25":
        return f"{number(rf'\\bis {num}\\b')} >= {v}.required"
    if cid == "stock_statement_monthly":
        return f"{number(rf'\\bfor {num} of the last')} >= {v}.required"
    if cid == "no_unapproved_borrowing":
        return rf"CASE WHEN rlike({low}, '\\bno new borrowing\\b|\\bnothing new\\b') THEN true ELSE {number(rf'\\bfound {num} new')} = 0 END"
    return (rf"CASE WHEN rlike({low}, '\\bexpired\\b|\\blapsed\\b|\\bnot evidenced\\b|\\bnot current\\b') THEN false"
            rf" WHEN rlike({low}, '\\bis current\\b') THEN true ELSE {v}.reported = 1 END")


def covenant_exact(cid: str, v: str = "v") -> str:
    """The breach test on the reported value alone."""
    if cid in ("dscr_min_1_25", "stock_statement_monthly"):
        return f"{v}.reported >= {v}.required"
    return f"{v}.reported = {0 if cid == 'no_unapproved_borrowing' else 1}"


def _covenant(cid: str, test) -> str:
    return f"get(transform(filter(covs, x -> x.covenant_id = '{cid}'), v -> {test(cid)}), 0)"


# ------------------------------------------------------------------------------------------------ assembled tables

BASELINE_RULES: dict[str, str] = {
    "A_income_proof_current": INCOME_PROOF, "A_address_proof_valid": _address_proof(),
    "A_statements_cover_months": "months_covered >= months_required", "A_fields_cohere": _fields_cohere(),
    "B_identity_coheres": _identity(), "B_salary_matches_employer": _salary(),
    "B_gst_bank_consistent": "gst_ratio_band NOT IN ('<0.5', '>2')", "B_synthetic_identity_signals": SYNTHETIC,
    "C_willingness": WILLINGNESS, "C_recent_delinquency": "max_dpd >= 30", "C_capacity": CAPACITY_BANDED,
    "C_foir_within_limit": FOIR_WITHIN, "C_income_stable": "volatility_cv < 0.25D AND months_history >= 12",
    "C_collateral_adequacy": COLLATERAL, "C_collateral_title_clear": "title_status = 'clear' AND legal_opinion = 'positive'",
    "D_closeness": closeness_banded("b_worst"),
    **{q: f"b_weakness = '{cat}'" for q, cat in R.DOUBT_CATEGORY.items()},
    "E_memo_matches_grid": _memo_grid(), "E_rate_math_correct": RATE_MATH,
    "E_disclosures_complete": " AND ".join(_heading(h) for _, h in R.DISCLOSURES),
    **{f"E_disclosure_{d}": _heading(h) for d, h in R.DISCLOSURES},
    **EARLY_WARNINGS,
    **{f"F_covenant_{x}": _covenant(x, covenant_from_text) for x in R.COVENANTS},
}


def baseline_columns(evidence: DataFrame, only: Iterable[str] = R.QIDS) -> DataFrame:
    """One ``r_{qid}`` column per question (boolean or ordinal).

    Rules that read documents, memo or months come first, so that no later projection copies those.
    """
    only = list(only)
    df = evidence
    if "A_address_proof_valid" in only:
        df = df.selectExpr("*", ADDRESS_DOC)
    df = df.selectExpr("*", *[f"{BASELINE_RULES[q]} AS r_{q}" for q in only if not q.startswith("D_")])
    if any(q.startswith("D_") for q in only):
        df = with_risk(df, "b_", exact=False).selectExpr(
            "*", f"{smallest('b_', exact=False)} AS b_worst", *weakness_sums("b_", "score_band = 'NTC'")).selectExpr("*", f"{weakness('b_')} AS b_weakness")
    return df.selectExpr("*", *[f"{BASELINE_RULES[q]} AS r_{q}" for q in only if q.startswith("D_")])


_FAILING = {
    "fraud": "fraud", "dscr_below_1_25": f"segment = 'msme_business' AND dscr < {R.DSCR_MIN}D",
    "foir_above_limit": "segment <> 'msme_business' AND foir_pct > foir_limit_pct",
    "ntc_not_eligible": "x_score IS NULL AND NOT (segment = 'salaried_personal' AND income_inr >= 50000)",
    "bureau_below_650": "x_score < 650", "max_dpd_60_plus": "max_dpd >= 60", "writeoff_or_settlement": "writeoffs > 0",
    "ltv_above_limit": "is_home AND ltv_pct > max_ltv_pct", "title_not_clear": "is_home AND title_status <> 'clear'",
    "business_vintage_below_2y": f"{_VINTAGE_APPLIES} AND years < 2D",
    "pd_above_cutoff": f"x_pd >= {B.lookup_sql(R.PD_CUTOFF, 'segment')}",
}


def _names(conditions: dict[str, str]) -> str:
    return f"array_remove(array({', '.join(f'CASE WHEN {x} THEN {chr(39)}{n}{chr(39)} ELSE {chr(39)}{chr(39)} END' for n, x in conditions.items())}), '')"


def labels(evidence: DataFrame) -> DataFrame:
    """Credit-policy labels from exact values: failed rules, sanctionable, closeness, weakness, outcome."""
    df = with_risk(evidence, "x_", exact=True).selectExpr("*", f"{EFFECTIVE_SCORE} AS x_score")
    missing = {"income_proof": "miss_income", "address_proof": "miss_address",
               "statements": "months_covered < months_required", "fields_coherence": "miss_fields"}
    ids = _list(d for d, _ in R.DISCLOSURES)
    draw = "CAST(k * 97 % 1000 AS DOUBLE) / 1000D"
    df = df.selectExpr(
        "*", f"{_names(_FAILING)} AS failed_rules", f"{_names(missing)} AS missing_items",
        "array_remove(array(CASE WHEN defect_conditions THEN 'memo_condition_mismatch' ELSE '' END,"
        " CASE WHEN defect_apr THEN 'apr_math_wrong' ELSE '' END,"
        f" coalesce(concat('disclosure_missing:', get(array({ids}), defect_disclosure)), '')), '') AS memo_defects",
        f"{smallest('x_', exact=True)} AS x_worst", *weakness_sums("x_", "x_score IS NULL"),
        f"CASE WHEN {draw} < x_pd THEN 'defaults' WHEN {draw} < x_pd + least(0.3D, 1.5D * x_pd) THEN 'slips' ELSE 'repays' END"
        " AS outcome_12m")
    return df.selectExpr("*", "size(failed_rules) = 0 AS sanctionable", f"{closeness_exact('x_worst')} AS closeness_level",
                         f"{weakness('x_')} AS primary_weakness")


def _lacks(items: str, value: str) -> str:
    return f"NOT array_contains({items}, '{value}')"


_FRAUD = "coalesce(fraud_type, '')"
TRUTH_RULES: dict[str, str] = {
    **{q: BASELINE_RULES[q] for q in ("C_willingness", "C_recent_delinquency", "C_foir_within_limit", "C_income_stable",
                                      "C_collateral_adequacy", "C_collateral_title_clear")},
    "A_income_proof_current": _lacks("missing_items", "income_proof"),
    "A_address_proof_valid": _lacks("missing_items", "address_proof"),
    "A_statements_cover_months": _lacks("missing_items", "statements"),
    "A_fields_cohere": _lacks("missing_items", "fields_coherence"),
    "B_identity_coheres": f"{_FRAUD} NOT IN ('identity_mismatch', 'synthetic_identity')",
    "B_salary_matches_employer": f"{_FRAUD} <> 'salary_pattern_mismatch'",
    "B_gst_bank_consistent": f"{_FRAUD} <> 'gst_bank_mismatch'",
    "B_synthetic_identity_signals": f"{_FRAUD} = 'synthetic_identity'",
    "C_capacity": CAPACITY_EXACT, "D_closeness": "closeness_level",
    **{q: f"primary_weakness = '{cat}'" for q, cat in R.DOUBT_CATEGORY.items()},
    "E_memo_matches_grid": _lacks("memo_defects", "memo_condition_mismatch"),
    "E_rate_math_correct": _lacks("memo_defects", "apr_math_wrong"),
    "E_disclosures_complete": "NOT exists(memo_defects, d -> startswith(d, 'disclosure_missing:'))",
    **{f"E_disclosure_{d}": _lacks("memo_defects", f"disclosure_missing:{d}") for d, _ in R.DISCLOSURES},
    **EARLY_WARNINGS,
    **{f"F_covenant_{x}": _covenant(x, covenant_exact) for x in R.COVENANTS},
}


def truth_columns(labelled: DataFrame, only: Iterable[str] = R.QIDS) -> DataFrame:
    """Truth of each question as ``t_{qid}`` columns (0/1 for yes-no questions, the level for ordinals)."""
    known = {f"r_{q}" for q in R.QIDS if TRUTH_RULES[q] == BASELINE_RULES[q]} & set(labelled.columns)
    return labelled.selectExpr("*", *[f"CAST({f'r_{q}' if f'r_{q}' in known else TRUTH_RULES[q]} AS DOUBLE) AS t_{q}" for q in only])


def applicable_sql(qid: str) -> str:
    """Whether a question applies to the file (segment, salaried applicant, GST registration)."""
    segments = next(q[6] for q in R.QUESTIONS if q[0] == qid)
    cond = "true" if segments is None else f"segment IN ({_list(segments)})"
    if qid == "B_salary_matches_employer":
        cond += " AND employment_type = 'salaried'"
    if qid == "B_gst_bank_consistent":
        cond += " AND has_gst"
    return cond


def unpivot_questions(wide: DataFrame, keep: list[str], only: Iterable[str] = R.QIDS, **values: str) -> DataFrame:
    """Wide question columns to one row per applicable question.

    ``values`` maps an output column to the prefix of its wide columns. One generator over the file's own row: no
    join with the catalogue and no shuffle.
    """
    only = set(only)
    structs = []
    for i, (qid, module, stage, qtype, polarity, routing, _) in enumerate(R.QUESTIONS, 1):
        if qid not in only:
            continue
        extra = "".join(f", '{name}', CAST({prefix}{qid} AS DOUBLE)" for name, prefix in values.items())
        structs.append(
            f"CASE WHEN {applicable_sql(qid)} THEN named_struct('q', CAST({i} AS BIGINT), 'qid', '{qid}', 'module', '{module}',"
            f" 'stage', '{stage}', 'qtype', '{qtype}', 'polarity', '{polarity}', 'routing', {str(routing).lower()}{extra}) END")
    # a question that is not asked is a null struct, which inline turns into a row of nulls
    return wide.select(*keep, F.expr(f"inline(array({', '.join(structs)}))")).filter("q IS NOT NULL")
