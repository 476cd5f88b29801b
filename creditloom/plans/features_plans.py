"""Registered queries: sources, contracts, finance, bands, states and the risk score."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from creditloom import reference as R
from creditloom.functions import bands as B
from creditloom.functions import finance as fin
from creditloom.operators import features, rules
from creditloom.oracle.views import apr, band, emi, q
from creditloom.plans import base
from creditloom.plans.registry import query
from creditloom.session import ensure_checkpoint_dir
from creditloom.sources import book as book_source
from creditloom.sources import io
from creditloom.sources.tables import inline, table

c = F.col


def scratch(spark) -> str:
    """A fresh folder for round-trip queries inside the shared folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/roundtrip-{uuid.uuid4().hex}"


# ------------------------------------------------------------------------------------------------ sources


@query("book_scan", """SELECT file_id, segment, product, loan_amount_inr, tenure_months, income_inr, score, proposed_emi_inr
FROM book""", "book")
def book_scan(spark, folder):
    return base.files(spark, folder).select("file_id", "segment", "product", "loan_amount_inr", "tenure_months",
                                            "income_inr", "score", "proposed_emi_inr")


@query("book_write", """SELECT segment, count(*) AS files, CAST(sum(loan_amount_inr) AS BIGINT) AS loan_amount_inr,
count(score) AS scored, count(*) FILTER (WHERE is_home) AS with_property FROM book GROUP BY segment""", "book")
def book_write(spark, folder):
    path = scratch(spark)
    io.write_book(io.nested_loan_files(base.files(spark, folder)), path, "parquet")
    back = io.read_book(spark, path, "parquet")
    return back.groupBy("segment").agg(
        F.count(F.lit(1)).alias("files"), F.sum("application.loan_amount_inr").alias("loan_amount_inr"),
        F.count("bureau.score").alias("scored"), F.count("property").alias("with_property"))


_CONFIG = [("grid", R.GRID_VERSION, repr(R.GRID)), ("policy", R.POLICY_VERSION, repr(R.WEIGHTS)),
           ("pricing", R.PRICING_VERSION, repr(R.PREMIUM_TIERS))]
_GOVERNED = {"home_loan": "grid", "msme_term_loan": "policy"}  # which configuration a product's files are checked against


@query("config_tables", "SELECT name, version, sha256(content) AS sha256, count(*) AS governed_files FROM book JOIN (VALUES "
       + ", ".join(f"({q(n)}, {q(v)}, {q(t)})" for n, v, t in _CONFIG) + ") t(name, version, content) ON name = CASE product WHEN 'home_loan'"
       " THEN 'grid' WHEN 'msme_term_loan' THEN 'policy' ELSE 'pricing' END GROUP BY ALL", "book")
def config_tables(spark, folder):
    configs = inline(spark, _CONFIG, "name string; version string; content string")
    n = base.files(spark, folder).groupBy(F.coalesce(B.lookup(_GOVERNED, "product"), F.lit("pricing")).alias("name")).agg(
        F.count(F.lit(1)).alias("governed_files"))
    return configs.select("name", "version", F.sha2("content", 256).alias("sha256")).join(n, "name")


@query("contract_duplicates", """SELECT printf('F%06d', l_orderkey + 1) AS file_id, printf('L%d', l_linenumber) AS stage, count(*) AS n
FROM lineitem GROUP BY ALL HAVING count(*) > 1""")
def contract_duplicates(spark, folder):
    rows = table(spark, folder, "lineitem").select(
        F.expr("printf('F%06d', l_orderkey + 1)").alias("file_id"), F.expr("printf('L%d', l_linenumber)").alias("stage"))
    return io.duplicate_keys(rows)


@query("contract_missing_files", """SELECT DISTINCT printf('F%06d', user_id * 997 + 1) AS file_id FROM events
WHERE user_id * 997 NOT IN (SELECT o_orderkey FROM orders)""")
def contract_missing_files(spark, folder):
    processed = table(spark, folder, "events").select(F.expr("printf('F%06d', user_id * 997 + 1)").alias("file_id")).distinct()
    files = table(spark, folder, "orders").select(F.expr("printf('F%06d', o_orderkey + 1)").alias("file_id"))
    return io.missing_files(processed, files)


@query("contract_frozen_inputs", """SELECT segment AS name, CASE WHEN segment = 'msme_business' THEN 'CHANGED' ELSE 'MATCH' END AS status
FROM book GROUP BY segment""", "book")
def contract_frozen_inputs(spark, folder):
    files = base.files(spark, folder).select("segment", "file_id", "loan_amount_inr", "tenure_months")

    def digests(df):
        lane = F.conv(F.substring(F.sha2(F.concat_ws("|", "file_id", c("loan_amount_inr").cast("string"),
                                                     c("tenure_months").cast("string")), 256), 1, 12), 16, 10).cast("bigint")
        return df.groupBy(c("segment").alias("name")).agg(
            F.sha2(F.concat_ws("|", F.count(F.lit(1)).cast("string"), F.bit_xor(lane).cast("string")), 256).alias("sha256"))

    edited = files.withColumn("loan_amount_inr", F.when(c("segment") == "msme_business", c("loan_amount_inr") + 1)
                              .otherwise(c("loan_amount_inr")))
    return io.frozen_input_mismatch(digests(edited), digests(files)).select("name", "status")


@query("pii_record_scan_source", """SELECT event_id, event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events""")
def pii_record_scan_source(spark, folder):
    e = table(spark, folder, "events").select("event_id", "event_type", F.parse_json("props").alias("payload"))
    return e.select("event_id", "event_type", F.variant_get("payload", "$.k", "bigint").alias("k"))


@query("replay_limit", """SELECT file_id, segment FROM book ORDER BY length(file_id), file_id LIMIT 50""", "book")
def replay_limit(spark, folder):
    return io.first_files(base.files(spark, folder).select("file_id", "segment"), 50)


@query("split_holdout", """SELECT file_id, CASE WHEN CAST(regexp_extract(file_id, '(\\d+)$', 1) AS BIGINT) % 5 = 0 THEN 'dev' ELSE 'holdout' END AS split
FROM book""", "book")
def split_holdout(spark, folder):
    return base.files(spark, folder).select("file_id", io.split_of(c("file_id")).alias("split"))


# ------------------------------------------------------------------------------------------------ finance


@query("fin_emi", f"""SELECT file_id, round({emi('loan_amount_inr', 'rate_pct', 'tenure_months')}, 4) AS emi,
round({emi('loan_amount_inr', '0', 'tenure_months')}, 4) AS emi_zero_rate FROM book""", "book")
def fin_emi(spark, folder):
    return base.files(spark, folder).select(
        "file_id", F.round(fin.emi(c("loan_amount_inr"), c("rate_pct"), c("tenure_months")), 4).alias("emi"),
        F.round(fin.emi(c("loan_amount_inr"), F.lit(0.0), c("tenure_months")), 4).alias("emi_zero_rate"))


_FEES = "CAST(floor(loan_amount_inr * 15 / 1000) AS BIGINT)"


@query("fin_apr", f"""SELECT file_id, round({apr('loan_amount_inr', _FEES, 'proposed_emi_inr', 'tenure_months')}, 5) AS apr,
true AS reprices FROM book""", "book")
def fin_apr(spark, folder):
    df = base.files(spark, folder).withColumn("fees", F.expr(_FEES))
    df = df.withColumn("apr", fin.apr("loan_amount_inr", "fees", "proposed_emi_inr", "tenure_months"))
    r = c("apr") / 1200.0
    pv = c("proposed_emi_inr") * (1 - F.exp(-c("tenure_months") * F.log1p(r))) / r
    return df.select("file_id", F.round("apr", 5).alias("apr"),
                     (F.abs(pv - (c("loan_amount_inr") - c("fees"))) <= 0.01).alias("reprices"))


@query("fin_foir", "SELECT file_id, round(foir_pct, 6) AS foir_pct FROM ratios", "ratios")
def fin_foir(spark, folder):
    return base.ratios(spark, folder).select("file_id", F.round("foir_pct", 6).alias("foir_pct"))


@query("fin_ltv", "SELECT file_id, round(ltv_pct, 6) AS ltv_pct FROM book WHERE is_home", "book")
def fin_ltv(spark, folder):
    return base.files(spark, folder).filter("is_home").select("file_id", F.round("ltv_pct", 6).alias("ltv_pct"))


@query("fin_dscr", """SELECT file_id, CASE WHEN dscr >= 1e15 THEN NULL ELSE round(dscr, 6) END AS dscr, dscr >= 1e15 AS unlimited FROM ratios""",
       "ratios")
def fin_dscr(spark, folder):
    return base.ratios(spark, folder).select(
        "file_id", F.when(c("dscr") < 1e15, F.round("dscr", 6)).alias("dscr"), (c("dscr") >= 1e15).alias("unlimited"))


# ------------------------------------------------------------------------------------------------ features, bands


@query("feat_observed_ratios", """SELECT file_id, round(foir_pct, 6) AS foir_pct, round(foir_headroom_pts, 6) AS foir_headroom_pts,
round(ltv_headroom_pts, 6) AS ltv_headroom_pts, round(gst_ratio, 6) AS gst_ratio FROM ratios""", "ratios")
def feat_observed_ratios(spark, folder):
    return base.ratios(spark, folder).select(
        "file_id", *[F.round(x, 6).alias(x) for x in ("foir_pct", "foir_headroom_pts", "ltv_headroom_pts", "gst_ratio")])


@query("band_label", f"""SELECT foir_band, count(*) AS n FROM (SELECT {band('foir_pct', 'foir_pct')} AS foir_band FROM ratios) GROUP BY ALL""",
       "ratios")
def band_label(spark, folder):
    return base.ratios(spark, folder).groupBy(B.band("foir_pct", "foir_pct").alias("foir_band")).agg(
        F.count(F.lit(1)).alias("n"))


_BANDED = ("loan_amount_band", "years_band", "declared_income_band", "age_band", "score_band", "max_dpd_band", "history_band",
           "verified_income_band", "volatility", "foir_band", "utilization_band", "foir_headroom_band", "cash_share_band",
           "gst_ratio_band", "dscr_band", "ltv_band", "ltv_headroom_band", "valuation_spread_band", "phone_vintage_band",
           "address_shared_band")


@query("band_all", f"SELECT file_id, {', '.join(_BANDED)} FROM state", "state")
def band_all(spark, folder):
    return base.state(spark, folder).select("file_id", *_BANDED)


@query("band_bureau_ntc", f"SELECT file_id, coalesce({band('bureau_score', 'score')}, 'NTC') AS score_band FROM book", "book")
def band_bureau_ntc(spark, folder):
    return base.files(spark, folder).select("file_id", B.bureau_band("score").alias("score_band"))


@query("band_valuation_spread", "SELECT file_id, valuation_spread_band FROM state WHERE is_home", "state")
def band_valuation_spread(spark, folder):
    return base.files(spark, folder).filter("is_home").select("file_id", B.band(
        "valuation_spread", B.valuation_spread_sql("market_value_inr", "valuation_2_inr")).alias("valuation_spread_band"))


@query("band_balance_change", "SELECT k, balance_change_band FROM conduct", "conduct")
def band_balance_change(spark, folder):
    return book_source.monthly_conduct(spark, folder).selectExpr("k", f"{features.BALANCE_CHANGE} AS balance_change_band")


@query("band_redaction_amount", f"""SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_extendedprice, {band('redaction_amount', '(l_extendedprice * 100)')} AS amount_band
FROM lineitem""")
def band_redaction_amount(spark, folder):
    return table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_extendedprice",
        B.band("redaction_amount", "(l_extendedprice * 100)").alias("amount_band"))


_STATE = ", ".join(f"CAST({n} AS BIGINT) AS {n}" if n in features.STATE_NUMERIC else n for n in features.STATE_COLUMNS)


@query("state_appraisal", f"SELECT file_id, {_STATE} FROM state", "state")
def state_appraisal(spark, folder):
    return base.state(spark, folder).select("file_id", *features.STATE_COLUMNS)


@query("state_sanction_docs", """SELECT file_id, segment, product, grid_band, max_tenure_months, tenure_months, rate_pct, apr_stated_pct,
apr_recomputed_pct, len(memo_conditions) AS n_conditions, len(required_conditions) AS n_required, d.disclosure_id, d.heading,
contains(lower(kfs_text), lower(d.heading)) AS heading_present FROM memo, (VALUES """
       + ", ".join(f"({q(i)}, {q(h)})" for i, h in R.DISCLOSURES) + ") d(disclosure_id, heading)", "memo")
def state_sanction_docs(spark, folder):
    return features.sanction_docs_state(book_source.with_memo(base.state(spark, folder)))


@query("state_monitoring", f"""SELECT b.file_id, b.segment, b.product, m.m, m.dpd, m.bounced, m."partial", c.n AS months_since_disbursal,
c.balance_change_band, {band('dpd', 'm.dpd')} AS dpd_band, {band('monthly', 'm.balance_inr')} AS avg_balance_band
FROM months_long m JOIN conduct c USING (k) JOIN book b USING (k)""", "book conduct")
def state_monitoring(spark, folder):
    conduct = book_source.monthly_conduct(spark, folder)
    files = base.files(spark, folder).select("k", "file_id", "segment", "product")
    return features.monitoring_state(files.join(conduct, "k"))


@query("state_token_estimate", """SELECT file_id, CAST(ceil(length(t) / 2.2) AS BIGINT) AS tokens FROM (SELECT file_id, concat_ws('|', """
       + ", ".join(f"'{n}=' || CAST({n} AS VARCHAR)" for n in sorted(features.STATE_COLUMNS)) + ") AS t FROM state)", "state")
def state_token_estimate(spark, folder):
    df = base.state(spark, folder)
    return df.select("file_id", F.ceil(F.length(features.state_text(df)) / F.lit(2.2)).cast("bigint").alias("tokens"))


@query("canonical_hash", "SELECT file_id, sha256(concat_ws('|', "
       + ", ".join(f"'{n}=' || CAST({n} AS VARCHAR)" for n in sorted(features.STATE_COLUMNS)) + ")) AS state_hash FROM state", "state")
def canonical_hash(spark, folder):
    df = base.state(spark, folder)
    return df.select("file_id", F.sha2(features.state_text(df), 256).alias("state_hash"))


@query("state_flatten", "SELECT * FROM (" + " UNION ALL ".join(
    (f"SELECT file_id, 'num:{n}' AS feature, CAST({n} AS DOUBLE) AS value FROM state WHERE {n} IS NOT NULL" if n in features.STATE_NUMERIC
     else f"SELECT file_id, 'cat:{n}=' || CAST({n} AS VARCHAR) AS feature, CAST(1 AS DOUBLE) AS value FROM state WHERE {n} IS NOT NULL")
    for n in features.STATE_COLUMNS) + ")", "state")
def state_flatten(spark, folder):
    return features.state_flatten(base.state(spark, folder))


@query("feat_risk", "SELECT file_id, " + ", ".join(f"round(x_{n}, 6) AS {n}" for n in R.FEATURES) + " FROM risk_x", "risk_x")
def feat_risk(spark, folder):
    df = features.with_risk(base.state(spark, folder), "x_", exact=True)
    return df.select("file_id", *[F.round("x_" + n, 6).alias(n) for n in R.FEATURES])


@query("score_risk_pd", "SELECT file_id, segment, round(x_pd, 6) AS risk_pd FROM risk_x", "risk_x")
def score_risk_pd(spark, folder):
    df = features.with_risk(base.state(spark, folder), "x_", exact=True)
    return df.select("file_id", "segment", F.round("x_pd", 6).alias("risk_pd"))


@query("feat_effective_score", "SELECT file_id, score, x_score AS effective_score FROM risk_x", "risk_x")
def feat_effective_score(spark, folder):
    return base.files(spark, folder).select("file_id", "score", F.expr(f"{features.EFFECTIVE_SCORE} AS effective_score"))


# ------------------------------------------------------------------------------------------------ rules


def _rule(name: str, qids: list[str], where: str = "") -> None:
    cols = ", ".join((f"CAST(r_{x} AS BIGINT)" if x in R.SCORE_QIDS else f"r_{x}") + f" AS {x.lower()}" for x in qids)

    @query(name, f"SELECT file_id, {cols} FROM baseline {where and 'WHERE ' + where}", "baseline")
    def run(spark, folder, _q=tuple(qids), _w=where):
        df = base.baseline(spark, folder, _q)
        if _w:
            df = df.filter(_w)
        return df.select("file_id", *[c(f"r_{x}").alias(x.lower()) for x in _q])


_rule("rule_a_income_proof", ["A_income_proof_current"])
_rule("rule_a_address_proof", ["A_address_proof_valid"])
_rule("rule_a_statements", ["A_statements_cover_months"])
_rule("rule_a_fields_cohere", ["A_fields_cohere"])
_rule("rule_b_identity", ["B_identity_coheres"])
_rule("rule_b_salary_employer", ["B_salary_matches_employer"])
_rule("rule_b_gst_bank", ["B_gst_bank_consistent"], "has_gst")
_rule("rule_b_synthetic", ["B_synthetic_identity_signals"])
_rule("rule_c_willingness", ["C_willingness"])
_rule("rule_c_foir_within", ["C_foir_within_limit"])
_rule("rule_c_income_stable", ["C_income_stable"])
_rule("rule_c_delinquency", ["C_recent_delinquency"])
_rule("rule_c_collateral", ["C_collateral_adequacy", "C_collateral_title_clear"], "is_home")
_rule("rule_e_memo_grid", ["E_memo_matches_grid"])
_rule("rule_e_rate_math", ["E_rate_math_correct"])
_rule("rule_e_disclosures", ["E_disclosures_complete", *[f"E_disclosure_{d}" for d, _ in R.DISCLOSURES]])
_rule("rule_f_ews", ["F_ews_dpd_rising", "F_ews_emi_bounces", "F_ews_partial_payments", "F_ews_balance_stress"])
_rule("rule_f_covenant", [f"F_covenant_{x}" for x in R.COVENANTS], "segment = 'msme_business'")


@query("rule_c_capacity", """SELECT file_id, CAST(b."r_C_capacity" AS BIGINT) AS banded_level, CAST(t."t_C_capacity" AS BIGINT) AS exact_level
FROM baseline b JOIN truths t USING (file_id)""", "baseline truths")
def rule_c_capacity(spark, folder):
    return base.state(spark, folder).selectExpr(
        "file_id", f"{rules.CAPACITY_BANDED} AS banded_level", f"{rules.CAPACITY_EXACT} AS exact_level")


@query("rule_d_margins", """SELECT file_id, round(b_worst, 9) AS banded_margin, round(x_worst, 9) AS exact_margin
FROM baseline JOIN labelled USING (file_id)""", "baseline labelled")
def rule_d_margins(spark, folder):
    df = features.with_risk(features.with_risk(base.state(spark, folder), "b_", exact=False), "x_", exact=True)
    return df.selectExpr("file_id", f"round({rules.smallest('b_', exact=False)}, 9) AS banded_margin",
                         f"round({rules.smallest('x_', exact=True)}, 9) AS exact_margin")


@query("rule_d_closeness", """SELECT file_id, CAST(b."r_D_closeness" AS BIGINT) AS banded_level, CAST(closeness_level AS BIGINT) AS exact_level
FROM baseline b JOIN labelled USING (file_id)""", "baseline labelled")
def rule_d_closeness(spark, folder):
    return rules.labels(base.baseline(spark, folder, ["D_closeness"])).select(
        "file_id", c("r_D_closeness").alias("banded_level"), c("closeness_level").alias("exact_level"))


@query("rule_d_weakness", """SELECT file_id, b_weakness AS banded_weakness, primary_weakness FROM baseline JOIN labelled USING (file_id)""",
       "baseline labelled")
def rule_d_weakness(spark, folder):
    return rules.labels(base.baseline(spark, folder, ["D_closeness"])).select("file_id", c("b_weakness").alias("banded_weakness"), "primary_weakness")


@query("q_applicability", "SELECT file_id, qid, q FROM asked", "asked")
def q_applicability(spark, folder):
    wide = base.files(spark, folder).select("*", *[F.lit(1.0).alias(f"n_{x}") for x in R.QIDS])
    return rules.unpivot_questions(wide, ["file_id"], one="n_").select("file_id", "qid", "q")


@query("rules_baseline_answers", """SELECT file_id, qid, stage, qtype, CASE WHEN qtype = 'noul' THEN rule_value END AS p,
CASE WHEN qtype = 'score' THEN rule_value END AS level, CAST(1 AS DOUBLE) AS confidence FROM asked""", "asked")
def rules_baseline_answers(spark, folder):
    sheet = rules.unpivot_questions(base.baseline(spark, folder), ["file_id"], rule_value="r_")
    return sheet.select("file_id", "qid", "stage", "qtype", F.when(c("qtype") == "noul", c("rule_value")).alias("p"),
                        F.when(c("qtype") == "score", c("rule_value")).alias("level"), F.lit(1.0).alias("confidence"))


@query("label_sanctionable", """SELECT file_id, sanctionable, array_to_string(failed_rules, ',') AS failed_rules,
array_to_string(missing_items, ',') AS missing_items, array_to_string(memo_defects, ',') AS memo_defects, outcome_12m,
primary_weakness FROM labelled""", "labelled")
def label_sanctionable(spark, folder):
    return base.labelled(spark, folder).select(
        "file_id", "sanctionable", *[F.array_join(x, ",").alias(x) for x in ("failed_rules", "missing_items", "memo_defects")],
        "outcome_12m", "primary_weakness")


@query("label_question_truth", "SELECT file_id, qid, truth FROM truth_long", "truth_long")
def label_question_truth(spark, folder):
    wide = rules.truth_columns(rules.labels(base.evidence(spark, folder, "covs months")))
    return rules.unpivot_questions(wide, ["file_id"], truth="t_").select("file_id", "qid", "truth")


@query("join_grid_row", """SELECT file_id, product, loan_amount_inr, grid_band, max_tenure_months, max_ltv_pct,
len(required_conditions) AS n_conditions FROM bookg""", "bookg")
def join_grid_row(spark, folder):
    return features.join_grid_row(base.files(spark, folder), spark).select(
        "file_id", "product", "loan_amount_inr", "grid_band", "max_tenure_months", "max_ltv_pct",
        F.size("required_conditions").alias("n_conditions"))

