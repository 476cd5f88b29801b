"""Evaluation: agreement, calibration, parity, operations and stop conditions over decisions and labels.

Missing evidence stays in every denominator: a failed or uncertain module has a NULL prediction that counts as wrong.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from creditloom import reference as R
from creditloom.functions.bands import lookup_sql

c = F.col


def ratio(num: Column, den: Column) -> Column:
    return F.when(den != 0, num.cast("double") / F.nullif(den.cast("double"), F.lit(0.0)))


# ------------------------------------------------------------------------------------------------ predictions

PREDICTIONS = {
    "A": "CASE WHEN appraisal_failure IS NULL AND a_outcome NOT IN ('uncertain', 'not_run') THEN CAST(a_outcome = 'fail' AS STRING) END",
    "B": "CASE WHEN appraisal_failure IS NULL AND b_outcome NOT IN ('uncertain', 'not_run') THEN CAST(b_outcome = 'signal' AS STRING) END",
    "C": "CASE WHEN appraisal_failure IS NULL AND c_outcome NOT IN ('uncertain', 'not_run') THEN CAST(band = 'pass' AS STRING) END",
    "D": f"CASE WHEN appraisal_failure IS NULL AND d_closeness IS NOT NULL THEN {lookup_sql(R.DOUBT_CATEGORY, 'd_top')} END",
    # a deterministic APR mismatch or an uncertain check blocks disbursal even when the answers pass
    "E": "CASE WHEN sanction_docs_failure IS NULL THEN CAST(blocked AS STRING) END",
    "F": "CASE WHEN monitoring_failure IS NULL THEN CAST(f_tier IN ('T2', 'T3') AS STRING) END",
}
TRUTHS = {
    "A": "CAST(size(missing_items) > 0 AS STRING)", "B": "CAST(fraud AS STRING)", "C": "CAST(sanctionable AS STRING)",
    "D": "primary_weakness", "E": "CAST(size(memo_defects) > 0 AS STRING)",
    "F": "CAST(outcome_12m IN ('slips', 'defaults') AS STRING)",
}
_FLAGS = {"A": "a_items", "B": "b_flags", "C": "c_top", "D": "d_top", "E": "e_flags", "F": "f_flags"}


_NEEDS = {"A": "missing_items appraisal_failure a_outcome a_items", "B": "fraud appraisal_failure b_outcome b_flags",
          "C": "sanctionable appraisal_failure c_outcome band c_top", "D": "primary_weakness appraisal_failure d_closeness d_top",
          "E": "memo_defects sanction_docs_failure blocked e_flags", "F": "outcome_12m monitoring_failure f_tier f_flags"}


def judged_columns(modules: str) -> tuple[str, ...]:
    """What ``judged_files`` reads of a file for these modules."""
    return tuple(dict.fromkeys(["k", "file_id", "segment", *[x for m in modules for x in (*_NEEDS[m].split(), f"base_{m}")]]))


def judged_files(files: DataFrame, keep: tuple[str, ...] = (), modules: str = "ABCDEF") -> DataFrame:
    """Truth, system and baseline prediction per file and module, unpivoted from the file's own row of the run.

    A file whose decision failed has NULL predictions and stays in the denominator.
    """
    structs = ", ".join(
        f"named_struct('module', '{m}', 'truth', {TRUTHS[m]}, 'system', {PREDICTIONS[m]}, 'baseline', base_{m},"
        f" 'driver', coalesce(nullif(split({_FLAGS[m]}, ',')[0], ''), 'unknown'))" for m in modules)
    return files.select("k", "file_id", "segment", *keep, F.expr(f"inline(array({structs}))"))


def agreement(judged: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Accuracy over all files, baseline accuracy, margin, coverages, recall floors and the verdict per module."""
    right = F.count_if(c("system") == c("truth"))
    base = F.count_if(c("baseline") == c("truth"))
    df = judged.groupBy(*by, "module").agg(
        F.count(F.lit(1)).alias("n"), right.alias("_r"), base.alias("_b"), F.count("system").alias("_s"), F.count("baseline").alias("_c"),
        F.count_if((c("system") == "true") & (c("truth") == "true")).alias("tp"),
        F.count_if((c("system") == "true") & (c("truth") == "false")).alias("fp"),
        F.count_if((c("truth") == "true") & ~c("system").eqNullSafe("true")).alias("fn"))
    df = df.select(*by, "module", "n", "tp", "fp", "fn", ratio(c("_r"), c("n")).alias("system"), ratio(c("_b"), c("n")).alias("rules_baseline"),
                   ratio(c("_s"), c("n")).alias("prediction_coverage"), ratio(c("_c"), c("n")).alias("baseline_coverage"))
    df = df.withColumn("delta_pp", (c("system") - c("rules_baseline")) * 100).withColumn("recall", ratio(c("tp"), c("tp") + c("fn")))
    floor = F.expr(lookup_sql(R.RECALL_MIN, "module"))
    return df.withColumn("verdict", F.when(F.round("delta_pp", 9) < R.BASELINE_MARGIN_PP, "NO_GO").when(
        floor.isNotNull() & (c("recall").isNull() | (c("recall") < floor)), "NO_GO").otherwise("PASS"))


def precision_recall(judged: DataFrame) -> DataFrame:
    a = agreement(judged.filter(c("module").isin("A", "B", "E")))
    return a.select(
        "module", "tp", "fp", "fn", ratio(c("tp"), c("tp") + c("fp")).alias("precision"), "recall",
        ratio(2 * c("tp"), 2 * c("tp") + c("fp") + c("fn")).alias("f1"),
        F.coalesce(c("recall") >= F.expr(lookup_sql(R.RECALL_MIN, "module")), F.lit(False)).alias("meets_floor"))


def item_recall(files: DataFrame) -> DataFrame:
    """Recall of each missing item: was its question among the confident fails of module A?"""
    items = {"income_proof": "A_income_proof_current", "address_proof": "A_address_proof_valid",
             "statements": "A_statements_cover_months", "fields_coherence": "A_fields_cohere"}
    j = files.select(F.explode("missing_items").alias("item"), F.when(c("appraisal_failure").isNull(), c("a_items")).alias("a_items"))
    hit = F.coalesce(F.array_contains(F.split("a_items", ","), F.expr(lookup_sql(items, "item"))), F.lit(False))
    return j.groupBy("item").agg(F.count(F.lit(1)).alias("n"), F.avg(hit.cast("double")).alias("recall"))


def borderline(files: DataFrame, accepted: str) -> DataFrame:
    """Agreement outside the borderline band, the band's share, and agreement counting human-accepted files as passes."""
    j = files.select("sanctionable", F.expr(f"({accepted})").alias("accepted"), F.when(c("appraisal_failure").isNull(), c("band")).alias("band"),
                     F.expr(PREDICTIONS["C"]).alias("pred"))
    edge = c("band").eqNullSafe("borderline")
    agree = c("pred") == c("sanctionable").cast("string")
    passed = (c("pred") == "true") | (edge & c("accepted"))
    return j.agg(
        F.count_if(~edge).alias("non_borderline_n"), ratio(F.count_if(~edge & agree), F.count_if(~edge)).alias("non_borderline_agreement"),
        F.avg(edge.cast("double")).alias("borderline_share"),
        F.avg((c("pred").isNotNull() & (passed == c("sanctionable"))).cast("double")).alias("pass_or_accepted_agreement"))


def disagreements(judged: DataFrame, examples: int = 3) -> DataFrame:
    """Mismatches per module, driver and segment with a count and the first few files.

    The example limit is a row_number filter, which Spark turns into a per-task top-n before the shuffle, so a group
    holding a third of the book still moves only a few rows.
    """
    wrong = judged.filter(~c("system").eqNullSafe(c("truth")))
    keys = ["module", "driver", "segment"]
    counts = wrong.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*keys).orderBy("k")
    top = wrong.withColumn("rn", F.row_number().over(w)).filter(c("rn") <= examples)
    shown = top.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", "file_id"))), lambda s: s["file_id"]), ",").alias("examples"))
    return counts.join(shown, keys)


# ------------------------------------------------------------------------------------------------ calibration


def measured(answers: DataFrame) -> DataFrame:
    """Validated probability, correctness and level error of each answer to a question with a truth; those of an invalid answer mean nothing."""
    e = ("CASE WHEN qtype = 'noul' THEN p IS NOT NULL AND NOT isnan(p) AND p BETWEEN 0D AND 1D ELSE probs IS NOT NULL AND size(probs) > 0"
         " AND forall(probs, x -> x IS NOT NULL AND NOT isnan(x) AND x BETWEEN 0D AND 1D)"
         " AND abs(aggregate(probs, 0D, (s, x) -> s + x) - 1D) <= 0.02D AND confidence BETWEEN 0D AND 1D END")
    df = answers.filter("truth IS NOT NULL").selectExpr("*", f"coalesce({e}, false) AS valid")
    # the likeliest level; the lowest level wins a tie
    chosen = "-array_max(transform(probs, (x, i) -> named_struct('x', x, 'i', -i))).i"
    return df.selectExpr(
        "* EXCEPT (p)", "CASE WHEN qtype = 'noul' THEN p ELSE confidence END AS p",
        f"CASE WHEN qtype = 'noul' THEN (p >= 0.5D) = (truth = 1D) ELSE {chosen} = truth END AS correct",
        "CASE WHEN qtype = 'score' THEN abs(aggregate(transform(probs, (x, i) -> x * i), 0D, (s, x) -> s + x) - truth) END AS level_error")


def answer_probability(answers: DataFrame) -> DataFrame:
    """The valid answers of ``measured``; invalid ones are dropped as unmeasured."""
    return measured(answers).filter("valid").drop("valid")


def bin_sql(p: str = "p") -> str:
    """Calibration bin over the literal edges; the last bin is closed at one."""
    arms = " ".join(f"WHEN {p} < {e!r}D THEN {i}" for i, e in enumerate(R.BIN_EDGES[1:-1]))
    return f"CASE {arms} ELSE {len(R.BIN_EDGES) - 2} END"


BIN_SUMS = {
    "n": "count(1)", "sum_p": "sum(p)", "sum_y": "sum(y)", "sum_sq": "sum((p - y) * (p - y))", "sum_err": "sum(level_error)",
    "n_err": "count(level_error)",
    # a score answer has no confident 'no', so only its high end can be confidently wrong
    "wrong": "count_if((p >= 0.9D AND y = 0D) OR (qtype = 'noul' AND p <= 0.1D AND y = 1D))",
}


def bins(scored: DataFrame, keys: list[str]) -> DataFrame:
    """Per-bin sums: the only aggregation that touches answers; everything after works on a few rows per question."""
    df = scored.selectExpr("*", f"{bin_sql()} AS bin", "CASE WHEN qtype = 'noul' THEN truth ELSE CAST(correct AS DOUBLE) END AS y")
    return df.groupBy(*keys, "qid", "qtype", "routing", "bin").agg(*[F.expr(x).alias(n) for n, x in BIN_SUMS.items()])


def calibration(binned: DataFrame, keys: list[str] | None = None, *more: Column) -> DataFrame:
    keys = keys or []
    gap = F.abs(c("sum_p") - c("sum_y"))
    return binned.groupBy(*keys, "qid", "qtype", "routing").agg(
        F.sum("n").alias("n"), ratio(F.sum(gap), F.sum("n")).alias("ece"), F.max(gap / c("n")).alias("mce"),
        F.when(F.first("qtype") == "noul", ratio(F.sum("sum_sq"), F.sum("n"))).otherwise(ratio(F.sum("sum_err"), F.sum("n_err"))).alias("brier_or_mae"),
        F.sum("wrong").alias("confident_wrong"), ratio(F.sum("wrong"), F.sum("n")).alias("confident_wrong_rate"), *more)


def calibration_report(answers: DataFrame) -> DataFrame:
    """Per question: measured and applicable counts, coverage, ECE, MCE, error and the verdict, from one pass over the answers of ``measured``."""
    cells = bins(answers, ["valid"]).select("qid", "qtype", "routing", c("n").alias("asked"), *[F.when(c("valid"), c(x)).alias(x) for x in BIN_SUMS])
    j = calibration(cells, [], F.sum("asked").alias("applicable_n")).withColumn("n", F.coalesce("n", F.lit(0)))
    fail = (c("ece") > R.ECE_MAX) | (c("confident_wrong_rate") > R.CONFIDENT_WRONG_MAX)
    return j.withColumn("coverage", ratio(c("n"), c("applicable_n"))).withColumn(
        "verdict", F.when(c("n") < R.CALIBRATION_MIN_N, "INSUFFICIENT_N").when(fail & c("routing"), "FAIL").when(fail, "DIAGNOSTIC_FAIL")
        .when(c("routing"), "PASS").otherwise("DIAGNOSTIC_PASS"))


def calibration_gate(report: DataFrame) -> DataFrame:
    bad = c("verdict").isin("FAIL", "INSUFFICIENT_N") | (c("coverage") != 1.0)
    return report.filter("routing AND applicable_n > 0").agg(
        F.count(F.lit(1)).alias("routing_questions"), F.avg(bad.cast("double")).alias("failing_share"))


# ------------------------------------------------------------------------------------------------ parity

ATTRIBUTES = {"region": "AFRICA", "priority": "1-URGENT", "cohort": "C0"}
SUBSET_ATTRIBUTE = {"lang_doc_script": "region", "gender_income_proxy": "priority", "pincode_bureau_thin": "cohort"}


def _unpivot_groups(df: DataFrame, keep: list[str]) -> DataFrame:
    """Attribute and scope rows of an already aggregated table: its few rows are multiplied, never the book's."""
    attrs = ", ".join(f"named_struct('attribute', '{a}', 'grp', {a})" for a in ATTRIBUTES)
    scopes = "CASE WHEN disparity_subset IS NULL THEN array('all', 'without_disparity_subset') ELSE array('all') END"
    return df.withColumn("scope", F.explode(F.expr(scopes))).select(*keep, "disparity_subset", "scope", F.expr(f"inline(array({attrs}))"))


def group_counts(file_facts: DataFrame) -> DataFrame:
    """Counts per attribute, group and scope, pre-aggregated over the attribute combinations first."""
    cells = file_facts.groupBy(*ATTRIBUTES, "disparity_subset").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("proceed").alias("proceeded"), F.count_if("sanctionable").alias("eligible"),
        F.count_if(c("proceed") & c("sanctionable")).alias("eligible_proceeded"), F.sum("composite").alias("sum_composite"),
        F.count("composite").alias("n_composite"))
    sums = ["n", "proceeded", "eligible", "eligible_proceeded", "sum_composite", "n_composite"]
    return _unpivot_groups(cells, sums).groupBy("attribute", "grp", "scope").agg(*[F.sum(x).alias(x) for x in sums])


def group_ece(scored: DataFrame) -> DataFrame:
    """ECE of each routing question inside each group and scope, and its gap to the scope's overall ECE."""
    cells = bins(scored.filter("routing"), [*ATTRIBUTES, "disparity_subset"])
    sums = list(BIN_SUMS)
    long = _unpivot_groups(cells, ["qid", "qtype", "routing", "bin", *sums])
    per = long.groupBy("attribute", "grp", "scope", "qid", "qtype", "routing", "bin").agg(*[F.sum(x).alias(x) for x in sums])
    overall = per.groupBy("attribute", "scope", "qid", "qtype", "routing", "bin").agg(*[F.sum(x).alias(x) for x in sums])
    g = calibration(per, ["attribute", "grp", "scope"]).select("attribute", "grp", "scope", "qid", "n", "ece")
    o = calibration(overall, ["attribute", "scope"]).select("attribute", "scope", "qid", c("ece").alias("overall_ece"))
    return g.join(o, ["attribute", "scope", "qid"]).withColumn("ece_gap", F.abs(c("ece") - c("overall_ece")))


def parity(counts: DataFrame, ece: DataFrame) -> DataFrame:
    """Rate ratios, equal-opportunity and calibration gaps against the reference group, breaches and status."""
    refs = F.expr(lookup_sql(ATTRIBUTES, "attribute"))
    g = counts.select(
        "attribute", "grp", "scope", "n", refs.alias("reference"), ratio(c("proceeded"), c("n")).alias("proceed_rate"),
        ratio(c("eligible_proceeded"), c("eligible")).alias("opportunity_rate"), ratio(c("eligible"), c("n")).alias("observed"),
        ratio(c("sum_composite"), c("n_composite")).alias("predicted"), ratio(c("n_composite"), c("n")).alias("prediction_coverage"))
    ref = g.filter("grp = reference").select("attribute", "scope", c("n").alias("reference_n"), c("proceed_rate").alias("ref_rate"),
                                             c("opportunity_rate").alias("ref_opportunity"))
    worst = ece.groupBy("attribute", "grp", "scope").agg(F.max("ece_gap").alias("worst_ece_gap"))
    j = g.join(ref, ["attribute", "scope"], "left").join(worst, ["attribute", "grp", "scope"], "left").select(
        "*", F.when(c("ref_rate") > 0, c("proceed_rate") / F.nullif(c("ref_rate"), F.lit(0.0))).alias("proceed_rate_ratio"),
        F.abs(c("opportunity_rate") - c("ref_opportunity")).alias("equal_opportunity_gap"),
        F.abs(c("predicted") - c("observed")).alias("calibration_in_large_gap"))
    tests = {"PROCEED_RATE_RATIO": f"round(proceed_rate_ratio, 9) < {R.PROCEED_RATIO_MIN}D", "EQUAL_OPPORTUNITY": f"round(equal_opportunity_gap, 9) > {R.EQ_OPP_GAP_MAX}D",
             "GROUP_ECE": f"round(worst_ece_gap, 9) > {R.GROUP_ECE_GAP_MAX}D", "CALIBRATION_IN_LARGE": f"round(calibration_in_large_gap, 9) > {R.CIL_GAP_MAX}D"}
    breaches = ", ".join(f"CASE WHEN {x} THEN '{n}' END" for n, x in tests.items())
    j = j.withColumn("breaches", F.expr(f"array_join(array_compact(array({breaches})), ',')"))
    return j.withColumn("status", F.expr(
        f"CASE WHEN n < {R.MIN_GROUP_N} OR coalesce(reference_n, 0) < {R.MIN_GROUP_N} THEN 'INSUFFICIENT_N' WHEN breaches <> '' THEN 'FAIL'"
        " WHEN proceed_rate_ratio IS NULL OR equal_opportunity_gap IS NULL OR calibration_in_large_gap IS NULL THEN 'INSUFFICIENT_EVIDENCE' ELSE 'PASS' END"))


def disparity_detection(file_facts: DataFrame, parity_rows: DataFrame, probes: DataFrame | None = None) -> DataFrame:
    """Is each engineered subset visible as a parity shift (or in the proxy probe)? Small groups prove nothing."""
    members = file_facts.filter("disparity_subset IS NOT NULL").groupBy("disparity_subset", *ATTRIBUTES).agg(F.count(F.lit(1)).alias("m"))
    attr = F.expr(lookup_sql(SUBSET_ATTRIBUTE, "disparity_subset"))
    pick = F.expr("CASE attribute " + " ".join(f"WHEN '{a}' THEN {a}" for a in ATTRIBUTES) + " END")
    touched = members.withColumn("attribute", attr).withColumn("grp", pick).groupBy("disparity_subset", "attribute", "grp").agg(F.sum("m").alias("m"))
    ok = parity_rows.filter("status IN ('PASS', 'FAIL') AND grp <> reference")
    keep = ["attribute", "grp", "proceed_rate", "opportunity_rate", "proceed_rate_ratio", "equal_opportunity_gap"]
    a = ok.filter("scope = 'all'").select(*keep).alias("a")
    b = ok.filter("scope = 'without_disparity_subset'").select(*keep).alias("b")
    j = a.join(b, (c("a.attribute") == c("b.attribute")) & (c("a.grp") == c("b.grp")))

    def breach(t: str) -> Column:
        return F.coalesce((F.round(f"{t}.proceed_rate_ratio", 9) < R.PROCEED_RATIO_MIN) | (F.round(f"{t}.equal_opportunity_gap", 9) > R.EQ_OPP_GAP_MAX), F.lit(False))

    def moved(x: str) -> Column:
        return F.coalesce(F.round(F.abs(c(f"a.{x}") - c(f"b.{x}")), 9) > R.EQ_OPP_GAP_MAX, F.lit(False))

    flags = j.select(c("a.attribute").alias("attribute"), c("a.grp").alias("grp"),
                     ((breach("a") & ~breach("b")) | moved("proceed_rate") | moved("opportunity_rate")).alias("flag"))
    out = touched.join(flags, ["attribute", "grp"], "left").groupBy("disparity_subset", "attribute").agg(
        F.sum("m").alias("n"), F.coalesce(F.bool_or("flag"), F.lit(False)).alias("parity_flagged"))
    if probes is not None:
        out = out.join(probes.select("attribute", (c("auc_macro_ovr") > R.PROBE_AUC_MAX).alias("probe_flagged")), "attribute", "left")
    else:
        out = out.withColumn("probe_flagged", F.lit(None).cast("boolean"))
    return out.withColumn("status", F.when(c("parity_flagged") | F.coalesce("probe_flagged", F.lit(False)), "DETECTED").otherwise("UNDETECTED"))


# ------------------------------------------------------------------------------------------------ stops


def one_row(*metrics: DataFrame) -> DataFrame:
    """Side by side columns of single-row metric tables: a union of (name, value) rows folded by one aggregate."""
    names = [n for m in metrics for n in m.columns]
    longs = [m.select(F.expr("inline(array(" + ", ".join(f"named_struct('name', '{n}', 'value', CAST({n} AS DOUBLE))" for n in m.columns) + "))"))
             for m in metrics]
    union = longs[0]
    for x in longs[1:]:
        union = union.unionByName(x)
    return union.agg(*[F.max(F.when(c("name") == n, c("value"))).alias(n) for n in names])


def stop_conditions(agree: DataFrame, border: DataFrame, gate: DataFrame, parity_rows: DataFrame, disparity: DataFrame, totals: DataFrame,
                    backend: str) -> DataFrame:
    """The registered stop conditions as rows; NULL means not measured by this run."""
    b = agree.agg(F.max(F.when(c("module") == "B", c("recall"))).alias("b_recall"))
    p = parity_rows.agg(F.count_if((c("scope") == "without_disparity_subset") & (c("status") == "FAIL")).alias("unexplained"))
    d = disparity.agg(F.count_if(c("status") == "UNDETECTED").alias("undetected"))
    one = one_row(b, border, gate, p, d, totals)
    rows = {
        "S1": "CAST(NULL AS BOOLEAN)", "S2": "CAST(NULL AS BOOLEAN)", "S3": "CAST(NULL AS BOOLEAN)", "S4": "CAST(NULL AS BOOLEAN)",
        "S5": f"failing_share <= {R.CALIBRATION_FAIL_SHARE_MAX}D", "S6": f"coalesce(b_recall, 0D) >= {R.RECALL_MIN['B']}D",
        "S7": f"coalesce(non_borderline_agreement, 0D) >= {R.NON_BORDERLINE_MIN}D", "S8": f"borderline_share <= {R.BORDERLINE_SHARE_MAX}D",
        "S9": "unexplained = 0", "S10": "undetected = 0", "S11": f"fallback_rate <= {R.FALLBACK_MAX}D",
        "S12": f"CASE WHEN unknown_usage = 0 THEN usd_per_file <= {R.USD_PER_FILE_MAX}D END", "S13": str(backend == "real").lower(),
    }
    return one.select(F.expr("inline(array(" + ", ".join(f"named_struct('condition', '{s}', 'passed', {x})" for s, x in rows.items()) + "))"))


def recommendation(stops: DataFrame, agree: DataFrame, backend: str) -> DataFrame:
    failed = stops.agg(F.count_if(~F.coalesce("passed", F.lit(False))).alias("failed_stops"))
    weak = agree.agg(F.count_if(c("verdict") == "NO_GO").alias("no_go_modules"))
    j = one_row(failed, weak)
    bad = (c("failed_stops") > 0) | (c("no_go_modules") > 0)
    return j.withColumn("recommendation", F.lit("PROVISIONAL: NOT A GO") if backend == "sim" else F.when(bad, "NO-GO").otherwise("GO"))
