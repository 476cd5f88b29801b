"""The loan book: one wide row per loan file, derived from the order and customer tables.

Every column is integer arithmetic on the keys, so any engine reproduces it. Files keep raw facts only; bands,
ratios, answers and decisions are computed by the operators. ``k`` is the order key, ``ck`` the customer key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from creditloom import reference as R
from creditloom.functions import finance
from creditloom.functions.bands import lookup
from creditloom.sources.tables import table

# segment of each market segment of the customer table
_SEGMENT = {"HOUSEHOLD": "salaried_personal", "FURNITURE": "salaried_personal", "MACHINERY": "self_employed",
            "AUTOMOBILE": "msme_business", "BUILDING": "secured_home"}
_RATE = {"salaried_personal": 11.25, "self_employed": 12.75, "msme_business": 10.25, "secured_home": 8.65}

_FACTS = [
    "k", "ck", "c_nationkey", "o_orderpriority AS priority", "o_orderdate AS applied_on",
    "printf('F%06d', k + 1) AS file_id", "segment",
    "home AS is_home",
    "CAST(floor(o_totalprice) AS BIGINT) * (CASE WHEN home THEN 20 ELSE 4 END) AS loan_amount_inr",
    "CAST((CASE WHEN home THEN 60 ELSE 12 END) * (1 + k % 5) AS BIGINT) AS tenure_months",
    "CASE segment WHEN 'self_employed' THEN 'self_employed' WHEN 'msme_business' THEN 'business_owner'"
    " WHEN 'secured_home' THEN CASE WHEN k % 3 <> 0 THEN 'salaried' ELSE 'self_employed' END ELSE 'salaried' END"
    " AS employment_type",
    "25000 + (ck * 7919 % 200) * 1000 AS income_inr",
    "25000 + (ck * 7919 % 200) * 1000 + (k % 10) * 1000 AS declared_income_inr",
    "(k * 31 % 20) * 500 AS existing_emi_inr",
    "CASE WHEN ck % 17 = 0 OR (ck % 8 = 3 AND k % 3 = 1) THEN NULL ELSE 600 + ck * 37 % 250 END AS score",
    "CASE WHEN ck % 17 = 0 THEN NULL ELSE 600 + ck * 37 % 250 END AS true_score",
    "CASE WHEN k % 7 = 0 THEN k * 13 % 120 ELSE 0 END AS max_dpd",
    "CASE WHEN k % 53 = 0 THEN 1 ELSE 0 END AS writeoffs",
    "CASE WHEN k % 9 = 0 THEN k % 4 ELSE 0 END AS bounces",
    "k % 6 AS active_loans", "k % 8 AS enquiries_6m", "ck * 11 % 150 AS history_months",
    "CAST(ck * 29 % 50 AS DOUBLE) / 100D AS volatility_cv", "ck * 5 % 60 AS months_history",
    "CAST(ck * 3 % 200 AS DOUBLE) / 10D AS years", "CAST(k * 17 % 100 AS DOUBLE) / 100D AS utilization",
    "CASE WHEN k % 37 = 0 THEN 'informal_declared' WHEN segment = 'msme_business' THEN 'gst_and_bank'"
    " WHEN segment = 'self_employed' THEN 'itr' ELSE 'salary_slip' END AS documentation_type",
    "3 + k % 13 AS months_covered", "k % 3 AS most_recent_month_age",
    "25000 + (ck * 7919 % 200) * 1000 + (k % 7) * 500 AS avg_credits_inr",
    "CAST(k % 45 AS DOUBLE) / 100D AS cash_share", "k % 5 AS balance_breaches",
    "(segment = 'msme_business' OR (segment = 'self_employed' AND k % 5 < 3)) AS has_gst",
    "CASE WHEN segment = 'msme_business' OR (segment = 'self_employed' AND k % 5 < 3)"
    " THEN (25000 + (ck * 7919 % 200) * 1000) * 24 END AS bank_credits_inr",
    "CASE WHEN segment = 'msme_business' OR (segment = 'self_employed' AND k % 5 < 3)"
    " THEN ((25000 + (ck * 7919 % 200) * 1000) * 24 * (40 + k * 23 % 200)) div 100 END AS gst_turnover_inr",
    "CASE k % 4 WHEN 0 THEN 'apartment' WHEN 1 THEN 'house' WHEN 2 THEN 'plot' ELSE 'villa' END AS property_kind",
    "CASE WHEN k % 11 = 0 THEN 'disputed' WHEN k % 13 = 0 THEN 'pending_mutation' ELSE 'clear' END AS title_kind",
    "CASE WHEN k % 19 = 0 THEN 'adverse' WHEN k % 23 = 0 THEN 'pending' ELSE 'positive' END AS legal_kind",
    "CASE WHEN segment = 'salaried_personal' OR (home AND k % 3 <> 0) THEN '[ORG_A]' END AS employer_token",
    "CASE WHEN segment = 'salaried_personal' OR (home AND k % 3 <> 0) THEN"
    " CASE WHEN k % 71 = 6 THEN '[ORG_B]' ELSE '[ORG_A]' END END AS narration_token",
    "k % 29 <> 0 AS pan_linked", "k % 60 AS phone_vintage_months",
    "CASE WHEN k % 25 = 0 THEN 'disposable' WHEN k % 25 < 10 THEN 'corporate' ELSE 'free' END AS email_domain",
    "k % 6 AS address_shared", "k % 31 <> 0 AS history_consistent",
    f"{R.REFERENCE_YEAR} - (21 + ck % 45) AS dob_year", "1 + k % 3 AS city_tier",
    # protected-attribute stand-ins kept apart from every state column
    "concat('C', CAST(ck % 8 AS STRING)) AS cohort",
    # labels' raw facts
    "k % 41 = 0 AS fraud",
    "CASE WHEN k % 41 = 0 THEN CASE (k div 41) % 4 WHEN 0 THEN 'identity_mismatch' WHEN 1 THEN 'salary_pattern_mismatch'"
    " WHEN 2 THEN 'gst_bank_mismatch' ELSE 'synthetic_identity' END END AS fraud_type",
    "k % 17 = 5 AS miss_income", "k % 19 = 3 AS miss_address", "k % 43 = 7 AS miss_fields",
    "k % 29 = 4 AS defect_conditions", "k % 31 = 5 AS defect_apr",
    "CASE WHEN k % 37 = 6 THEN CAST((k div 37) % 8 AS INT) END AS defect_disclosure",
]


def _base(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("ck"), "o_totalprice", "o_orderdate", "o_orderpriority"
    )
    customer = table(spark, folder, "customer").select(
        F.col("c_custkey").alias("ck"), "c_nationkey", lookup(_SEGMENT, "c_mktsegment").alias("segment")
    )
    return orders.join(customer, "ck").withColumn("home", F.col("segment") == "secured_home")


def book(spark: SparkSession, folder: str, *, by_file: bool = False, months: bool = False) -> DataFrame:
    """Loan files. One equi join on the customer key; everything after it is a narrow projection.

    ``by_file`` hash-partitions the six raw columns on the file key first. Every later join and aggregation on that
    key (repayment months, answers, decisions) reuses the partitioning, so a whole decision run needs one exchange,
    taken while the row is still narrow. ``months`` joins the repayment months there, so the join sorts narrow rows.
    """
    df = _base(spark, folder)
    if by_file:
        df = df.repartition("k")
    if months:
        df = df.join(monthly_conduct(spark, folder), "k", "left")
    df = df.selectExpr(*_FACTS, *(["months"] if months else []))
    df = df.select(
        "*",
        lookup(R.PRODUCT_BY_SEGMENT, "segment").alias("product"),
        lookup(_RATE, "segment").alias("rate_pct"),
        F.expr("CASE WHEN is_home THEN (loan_amount_inr * 100) div (50 + k % 45) END").alias("market_value_inr"),
    )
    df = df.select(
        "*",
        F.expr("(market_value_inr * (100 - k % 30)) div 100").alias("valuation_2_inr"),
        F.expr("CASE WHEN is_home THEN property_kind END").alias("property_type"),
        F.expr("CASE WHEN is_home THEN title_kind END").alias("title_status"),
        F.expr("CASE WHEN is_home THEN legal_kind END").alias("legal_opinion"),
        finance.ltv(F.col("loan_amount_inr"), F.col("market_value_inr")).alias("ltv_pct"),
        F.round(finance.emi(F.col("loan_amount_inr"), F.col("rate_pct"), F.col("tenure_months")))
        .cast("bigint").alias("proposed_emi_inr"),
    )
    return df.drop("property_kind", "title_kind", "legal_kind")


def with_attributes(files: DataFrame, spark: SparkSession, folder: str) -> DataFrame:
    """Add the region attribute and the engineered disparity subset.

    Nation and region are dimension tables; whether they broadcast is left to their measured size. A file of an unknown
    nation keeps a NULL region.
    """
    nation = table(spark, folder, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_regionkey")
    region = table(spark, folder, "region").select(F.col("r_regionkey").alias("n_regionkey"), F.col("r_name").alias("region"))
    return (
        files.join(nation, "c_nationkey", "left").join(region, "n_regionkey", "left").drop("n_regionkey")
        .withColumn("disparity_subset", F.expr(
            "CASE WHEN ck % 8 = 3 AND k % 3 = 1 THEN 'pincode_bureau_thin'"
            " WHEN region = 'ASIA' AND k % 3 = 0 THEN 'lang_doc_script'"
            " WHEN priority = '5-LOW' AND k % 4 = 1 THEN 'gender_income_proxy' END"))
    )


# ------------------------------------------------------------------------------------------------ documents, memo

_MONTHS = "array('Jan','Feb','Mar','Apr','May','Jun','Jul','Aug','Sep','Oct','Nov','Dec')"


def _doc(doc_type: str, age: str, script: str, text: str) -> str:
    return (f"named_struct('doc_type', {doc_type}, 'month_age', CAST({age} AS BIGINT), 'script', {script},"
            f" 'text', {text})")


def _if(cond: str, item: str) -> str:
    """An array of the item where the condition holds, else an empty one: generated code, unlike a filter with a lambda."""
    return f"slice(array({item}), 1, CASE WHEN {cond} THEN 1 ELSE 0 END)"


def with_documents(files: DataFrame) -> DataFrame:
    """The redacted documents of each file as an array of structs (five at most, so a row stays small)."""
    income = _doc("CASE WHEN employment_type = 'salaried' THEN 'salary_slip' ELSE 'itr' END", "k % 4", "'latin'",
                  "concat('Paid by ', CASE WHEN fraud_type = 'salary_pattern_mismatch' THEN '[ORG_B]' ELSE '[ORG_A]' END,"
                  " ' to [APPLICANT].')")
    address = _doc(
        "CASE k % 3 WHEN 0 THEN 'address_proof_utility_bill' WHEN 1 THEN 'address_proof_rent_agreement'"
        " ELSE 'address_proof_passport' END",
        "CASE WHEN k % 3 = 0 THEN k % 4 ELSE k % 14 END",
        "CASE WHEN k % 12 = 0 THEN 'devanagari' ELSE 'latin' END",
        f"concat(CASE WHEN k % 47 = 1 THEN 'Prepaid connection. ' ELSE '' END,"
        f" 'Received: ', element_at({_MONTHS}, CAST(1 + k % 12 AS INT)), ' 2026. ',"
        f" CASE k % 3 WHEN 1 THEN concat('Lease term Jan 2024 to ', element_at({_MONTHS}, CAST(1 + k % 7 AS INT)),"
        f" ' ', CAST(2026 + k % 2 AS STRING), '. ') WHEN 2 THEN concat('Passport expires ',"
        f" element_at({_MONTHS}, CAST(1 + k % 5 AS INT)), ' ', CAST(2025 + k % 8 AS STRING), '. ') ELSE '' END,"
        " 'Address ', CASE WHEN miss_address THEN '[ADDR_2]' ELSE '[ADDR_1]' END, '.')")
    pan = _doc("'pan_card_text'", "0", "'latin'",
               "concat('Name: ', CASE WHEN fraud_type = 'identity_mismatch' THEN '[PERSON_2]' ELSE '[APPLICANT]' END,"
               " ' PAN [PAN_', CASE WHEN k % 97 = 3 THEN '2' ELSE '1' END, '] born [DOB_',"
               " CASE WHEN k % 89 = 5 THEN '2' ELSE '1' END, '].')")
    letter = _doc("'employer_letter'", "1", "'latin'",
                  "concat('Months to superannuation: ', CAST(24 + (ck * 13 % 40) * 10 AS STRING), ' months.')")
    letter_asked = "employment_type = 'salaried'"
    header = _doc("'bank_statement_header'", "most_recent_month_age", "'latin'",
                  "concat('Statement for ', CAST(months_covered AS STRING), ' months.',"
                  " CASE WHEN fraud_type = 'synthetic_identity'"
                  " THEN ' Auto-generated document; no signature required.' ELSE '' END)")
    return files.withColumn("docs", F.expr(
        f"concat({_if('NOT miss_income', income)}, array({address}, {pan}), {_if(letter_asked, letter)}, array({header}))"))


def with_memo(files_with_grid: DataFrame) -> DataFrame:
    """Sanction memo and Key Fact Statement, on files already joined to their grid row."""
    headings = ", ".join("'" + h + "'" for _, h in R.DISCLOSURES)
    df = files_with_grid.select(
        "*",
        F.expr("CASE WHEN defect_conditions THEN slice(required_conditions, 2, size(required_conditions))"
               " ELSE required_conditions END").alias("memo_conditions"),
        F.expr("concat('Approved at rate ', format_number(rate_pct + CASE WHEN k % 61 = 9 THEN 0.5D ELSE 0D END, '0.00'),"
               " '% for ', CAST(tenure_months AS STRING), ' months.')").alias("memo_text"),
        F.expr(f"array_join(filter(array({headings}), (h, i) -> defect_disclosure IS NULL OR i <> defect_disclosure), '. ')")
        .alias("kfs_text"),
        (F.expr("CAST(floor(loan_amount_inr * 15 / 1000) AS BIGINT)")).alias("kfs_fees_inr"),
    )
    apr_value = F.round(finance.apr("loan_amount_inr", "kfs_fees_inr", "proposed_emi_inr", "tenure_months"), 2)
    return df.withColumn("apr_recomputed_pct", apr_value).withColumn(
        "apr_stated_pct",
        F.round(F.col("apr_recomputed_pct") + F.expr(
            "CASE WHEN defect_apr THEN 0.5D WHEN k % 67 = 2 THEN 0.2D ELSE 0D END"), 2))


# ------------------------------------------------------------------------------------------------ repayment

#: An order has at most seven lines, which stand for months; conduct looks at the latest six.
MONTHS, LATEST = 7, 6


def monthly_conduct(spark: SparkSession, folder: str) -> DataFrame:
    """The latest six repayment months of each file as one array, from a single aggregation on the file key.

    An order line number can repeat, so each month is a maximum. Conditional maxima combine map-side and shuffle one
    row per file and input partition; every buffer is fixed-width, so the hash aggregate never falls back to sorting.
    """
    lines = table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("m"),
        F.when(F.col("l_returnflag") == "R", F.floor("l_quantity")).otherwise(0).cast("bigint").alias("dpd"),
        ((F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "O")).alias("bounced"),
        (F.col("l_discount") >= 0.09).alias("partial"), "l_extendedprice",
    )
    aggs = []
    for m in range(1, MONTHS + 1):
        here = F.col("m") == m
        aggs.append((F.count_if(here) > 0).alias(f"has_{m}"))
        for c in ("dpd", "bounced", "partial"):
            aggs.append(F.max(F.when(here, F.col(c))).alias(f"{c}_{m}"))
        aggs.append(F.floor(F.max(F.when(here, F.col("l_extendedprice")))).cast("bigint").alias(f"balance_{m}"))
    wide = lines.groupBy("k").agg(*aggs)
    months = ", ".join(
        _if(f"has_{m}", f"named_struct('m', CAST({m} AS BIGINT), 'dpd', dpd_{m}, 'bounced', bounced_{m},"
                        f" 'partial', partial_{m}, 'balance_inr', balance_{m})") for m in range(1, MONTHS + 1))
    return wide.select("k", F.expr(f"concat({months})").alias("months")).withColumn(
        "months", F.expr(f"slice(months, greatest(size(months) - {LATEST - 1}, 1), {LATEST})"))


def repayment(spark: SparkSession, folder: str) -> DataFrame:
    """Long form: one row per file and month."""
    return monthly_conduct(spark, folder).select("k", F.expr("inline(months)"))


def with_covenants(files: DataFrame) -> DataFrame:
    """The four covenants of an MSME file as an array of structs; empty for every other segment."""
    return files.withColumn("covs", F.expr(
        "CASE WHEN segment = 'msme_business' THEN array("
        "named_struct('covenant_id', 'dscr_min_1_25', 'required', 1.25D, 'reported', CAST(80 + k % 90 AS DOUBLE) / 100D,"
        " 'evidence', concat('DSCR for the year is ', format_number(CAST(80 + k % 90 AS DOUBLE) / 100D, '0.00'), ' times.')),"
        "named_struct('covenant_id', 'stock_statement_monthly', 'required', 6D, 'reported', CAST(k % 7 AS DOUBLE),"
        " 'evidence', concat('Statements received for ', CAST(k % 7 AS STRING), ' of the last 6 months.')),"
        "named_struct('covenant_id', 'no_unapproved_borrowing', 'required', 0D, 'reported', CAST(k % 3 AS DOUBLE),"
        " 'evidence', CASE WHEN k % 3 = 0 THEN 'Bureau shows no new borrowing.'"
        " ELSE concat('Bureau found ', CAST(k % 3 AS STRING), ' new facilities.') END),"
        "named_struct('covenant_id', 'insurance_current', 'required', 1D, 'reported', CASE WHEN k % 5 = 0 THEN 0D ELSE 1D END,"
        " 'evidence', CASE WHEN k % 5 = 0 THEN 'Policy expired.' ELSE 'Policy is current.' END)) END"))
