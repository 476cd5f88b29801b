"""Oracle views of answer reads, module results and decisions."""

from __future__ import annotations

from creditloom import reference as R
from creditloom.oracle.views import case, q, view

view("reads", "answers", """
SELECT *, read_confidence < CASE WHEN qtype = 'noul' THEN 0.5 ELSE 0.45 END AS low FROM (
 SELECT *, CASE WHEN nok OR sok THEN true ELSE false END AS usable, CASE WHEN nok THEN p WHEN sok THEN level END AS value,
  CASE WHEN nok AND polarity = 'yes_is_good' THEN p WHEN nok THEN 1 - p WHEN sok THEN least(1.0, greatest(0.0, level / 4)) END AS goodness,
  CASE WHEN nok THEN round(abs(2 * p - 1), 9) WHEN sok THEN confidence ELSE 0 END AS read_confidence
 FROM (SELECT *, coalesce(qtype = 'noul' AND p BETWEEN 0 AND 1, false) AS nok,
   coalesce(qtype = 'score' AND confidence BETWEEN 0 AND 1 AND level BETWEEN 0 AND len(probs) - 1, false) AS sok FROM answers))""")
_W = "CASE " + " ".join(f"WHEN segment = {q(s)} THEN {case('qid', w)}" for s, w in R.WEIGHTS.items()) + " END"
view("weighed", "reads", f"SELECT *, {_W} AS weight FROM reads")
_A = "module = 'A' AND usable AND NOT low AND value < 0.5"
_B = "module = 'B' AND usable AND ((polarity = 'yes_is_bad' AND value >= 0.8) OR (polarity = 'yes_is_good' AND value <= 0.2))"
_E = "module = 'E' AND usable AND NOT low AND value < 0.5"
_EWS = "qid LIKE 'F\\_ews\\_%' ESCAPE '\\' AND usable AND value >= 0.6"
_BR = "qid LIKE 'F\\_covenant\\_%' ESCAPE '\\' AND usable AND round(value, 9) <= 0.4"


def flags(cond: str) -> str:
    return f"coalesce(string_agg(DISTINCT qid, ',' ORDER BY qid) FILTER (WHERE {cond}), '')"


def _module_view(name: str, source: str) -> None:
    view(name, f"{source} memo", f"""
SELECT w.k, any_value(w.file_id) AS file_id, any_value(w.segment) AS segment, bool_or({_A}) AS a_fail, bool_or(module = 'A' AND low) AS a_uncertain,
 {flags(_A)} AS a_items, (min({{'d': -round(weight * (1 - goodness), 9), 'qid': qid}}) FILTER (WHERE usable AND round(weight * (1 - goodness), 9) > 0)).qid AS c_top, min(goodness) FILTER (WHERE module = 'A') AS a_lowest, bool_or({_B}) AS b_signal,
 bool_or(module = 'B' AND low) AS b_uncertain, {flags(_B)} AS b_flags, min(goodness) FILTER (WHERE module = 'B') AS b_lowest,
 round(sum(weight * goodness) FILTER (WHERE usable) / sum(weight) FILTER (WHERE usable), 9) AS composite, bool_or(module = 'C' AND low) AS c_uncertain,
 max(round(goodness, 9)) FILTER (WHERE qid = 'D_closeness' AND usable) AS d_closeness,
 (min({{'v': -value, 'qid': qid}}) FILTER (WHERE qid LIKE 'D\\_doubt\\_%' ESCAPE '\\' AND usable)).qid AS d_top,
 bool_or({_E}) AS e_fail, bool_or(module = 'E' AND low) AS e_uncertain, {flags(_E)} AS e_flags, min(goodness) FILTER (WHERE module = 'E') AS e_lowest,
 count(*) FILTER (WHERE {_EWS}) + 2 * count(*) FILTER (WHERE {_BR}) AS f_warnings, {flags(f'({_EWS}) OR ({_BR})')} AS f_flags,
 max(failure_kind) FILTER (WHERE stage = 'appraisal') AS fail_1, max(failure_kind) FILTER (WHERE stage = 'sanction_docs') AS fail_2,
 max(failure_kind) FILTER (WHERE stage = 'monitoring') AS fail_3, any_value(round(abs(apr_stated_pct - apr_recomputed_pct), 9)) AS apr_gap
FROM {source} w JOIN memo m ON w.k = m.k GROUP BY w.k""")


_module_view("modules0", "weighed")
view("weighed_b", "asked", f"""SELECT *, {_W} AS weight FROM (SELECT *, rule_value IS NOT NULL AS usable, rule_value AS value,
 CASE WHEN qtype = 'score' THEN rule_value / 4 WHEN polarity = 'yes_is_good' THEN rule_value ELSE 1 - rule_value END AS goodness,
 false AS low, CAST(NULL AS VARCHAR) AS failure_kind FROM asked)""")
_module_view("modules0_b", "weighed_b")
def _verdict_view(name: str, source: str) -> None:
    view(name, source, f"""
SELECT *, CASE WHEN a_fail THEN 'fail' WHEN a_uncertain THEN 'uncertain' ELSE 'pass' END AS a_outcome,
 CASE WHEN b_signal THEN 'signal' WHEN b_uncertain THEN 'uncertain' ELSE 'clear' END AS b_outcome,
 CASE WHEN composite >= 0.7 THEN 'pass' WHEN composite >= 0.5 THEN 'borderline' WHEN composite IS NOT NULL THEN 'fail' END AS band,
 CASE WHEN c_uncertain THEN 'uncertain' WHEN composite IS NULL THEN 'not_run' WHEN composite >= 0.7 THEN 'pass'
  WHEN composite >= 0.5 THEN 'borderline' ELSE 'fail' END AS c_outcome,
 CASE WHEN e_fail THEN 'fail' WHEN e_uncertain THEN 'uncertain' ELSE 'pass' END AS e_outcome,
 'T' || CAST(least(3, f_warnings) AS VARCHAR) AS f_tier,
 apr_gap IS NULL OR apr_gap > 0.1 OR e_fail OR e_uncertain AS blocked FROM {source}""")


_verdict_view("modules", "modules0")
_verdict_view("modules_b", "modules0_b")
_CODE = {f: f"CASE {f} WHEN 'timeout' THEN 'MODEL_TIMEOUT' WHEN 'pii_blocked' THEN 'PII_BLOCKED' ELSE 'MODEL_ERROR' END" for f in ("fail_1", "fail_2", "fail_3")}
view("appraisals", "modules", f"""
SELECT *, CASE WHEN fail_1 IS NOT NULL THEN {_CODE['fail_1']} WHEN b_signal THEN 'FRAUD_SIGNAL' WHEN a_fail THEN 'READINESS_FAIL'
  WHEN a_uncertain OR b_uncertain OR c_uncertain THEN 'LOW_CONFIDENCE' WHEN band = 'pass' THEN 'COMPOSITE_PASS' WHEN band = 'fail' THEN 'COMPOSITE_FAIL'
  WHEN band IS NULL THEN 'NO_APPRAISAL_ANSWERS' ELSE 'COMPOSITE_BORDERLINE' END AS code FROM modules""")
view("decisions", "appraisals", f"""
SELECT k, file_id, segment, 'appraisal' AS stage, CASE code WHEN 'FRAUD_SIGNAL' THEN 'FRAUD_INVESTIGATION' WHEN 'READINESS_FAIL' THEN 'DEFICIENCY_NOTICE'
  WHEN 'COMPOSITE_PASS' THEN 'PROCEED_TO_SANCTIONING_AUTHORITY' WHEN 'COMPOSITE_FAIL' THEN 'DECLINE_RECOMMENDED' ELSE 'HUMAN_REVIEW' END AS outcome,
 CASE code WHEN 'FRAUD_SIGNAL' THEN 'fraud_investigation' WHEN 'READINESS_FAIL' THEN 'deficiency_ops' WHEN 'COMPOSITE_PASS' THEN NULL
  WHEN 'COMPOSITE_FAIL' THEN 'decline_confirmation' ELSE 'credit_review' END AS queue, code AS reason_codes,
 CASE WHEN fail_1 IS NULL THEN composite END AS composite, CASE WHEN fail_1 IS NULL THEN band END AS band,
 CASE WHEN code = 'COMPOSITE_BORDERLINE' THEN d_closeness END AS closeness, CASE WHEN code = 'COMPOSITE_BORDERLINE' THEN d_top END AS top_doubt,
 CASE WHEN code = 'READINESS_FAIL' THEN a_items END AS items, fail_1 AS failure_kind FROM appraisals
UNION ALL SELECT k, file_id, segment, 'sanction_docs', CASE WHEN fail_2 IS NOT NULL THEN 'HUMAN_REVIEW' WHEN codes <> '' THEN 'DISBURSAL_BLOCKED'
  ELSE 'DISBURSAL_CLEARED_FOR_HUMAN_SIGNOFF' END, CASE WHEN fail_2 IS NOT NULL OR codes <> '' THEN 'disbursal_correction' END,
  CASE WHEN fail_2 IS NOT NULL THEN concat_ws(',', {_CODE['fail_2']}, CASE WHEN apr_gap > 0.1 THEN 'APR_MISMATCH_DETERMINISTIC' END)
   WHEN codes <> '' THEN codes ELSE 'MEMO_KFS_CONSISTENT' END, NULL, NULL, NULL, NULL, e_flags, fail_2 FROM (
  SELECT *, concat_ws(',', CASE WHEN apr_gap IS NULL THEN 'APR_CHECK_UNAVAILABLE' END, CASE WHEN apr_gap > 0.1 THEN 'APR_MISMATCH_DETERMINISTIC' END,
   CASE WHEN e_fail THEN 'E_CHECK_FAILED' END, CASE WHEN e_uncertain THEN 'LOW_CONFIDENCE' END) AS codes FROM modules)
UNION ALL SELECT k, file_id, segment, 'monitoring', CASE WHEN fail_3 IS NOT NULL THEN 'HUMAN_REVIEW' ELSE 'WATCHLIST_' || f_tier END,
  CASE WHEN fail_3 IS NOT NULL OR f_tier <> 'T0' THEN 'watchlist_review' END,
  CASE WHEN fail_3 IS NOT NULL THEN {_CODE['fail_3']} ELSE 'WATCHLIST_' || f_tier END, NULL, NULL, NULL, NULL, f_flags, fail_3 FROM modules""")
