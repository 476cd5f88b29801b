"""Readers and writers for books, decisions and payloads, and the contracts that guard a replay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# one nested loan file as JSON lines carry it; unknown fields are an error under FAILFAST with this schema
LOAN_FILE_SCHEMA = (
    "file_id STRING, segment STRING,"
    " application STRUCT<product: STRING, loan_amount_inr: BIGINT, tenure_months: BIGINT, employment_type: STRING,"
    " declared_monthly_income_inr: BIGINT, years_in_job_or_business: DOUBLE, city_tier: BIGINT>,"
    " bureau STRUCT<score: BIGINT, active_loans: BIGINT, max_dpd_12m: BIGINT, enquiries_6m: BIGINT,"
    " writeoffs_or_settlements: BIGINT, history_months: BIGINT>,"
    " income STRUCT<verified_monthly_income_inr: BIGINT, volatility_cv: DOUBLE, months_history: BIGINT,"
    " documentation_type: STRING>,"
    " obligations STRUCT<existing_emi_inr: BIGINT, proposed_emi_inr: BIGINT, credit_card_utilization: DOUBLE>,"
    " gst STRUCT<turnover_12m_inr: BIGINT, bank_credits_12m_inr: BIGINT>,"
    " property STRUCT<market_value_inr: BIGINT, valuation_2_inr: BIGINT, title_status: STRING, legal_opinion: STRING>,"
    " documents ARRAY<STRUCT<doc_type: STRING, month_age: BIGINT, script: STRING, text: STRING>>")
DECISION_SCHEMA = (
    "run_id STRING, file_id STRING, segment STRING, stage STRING, outcome STRING, composite DOUBLE,"
    " failure_kind STRING, latency_ms DOUBLE, input_tokens BIGINT")


def nested_loan_files(files: DataFrame) -> DataFrame:
    """Flat book rows in the nested loan-file shape. Blocks a segment lacks are NULL structs."""
    c = F.col
    return files.select(
        "file_id", "segment",
        F.struct("product", "loan_amount_inr", "tenure_months", "employment_type",
                 c("declared_income_inr").alias("declared_monthly_income_inr"),
                 c("years").alias("years_in_job_or_business"), "city_tier").alias("application"),
        F.struct("score", "active_loans", c("max_dpd").alias("max_dpd_12m"), "enquiries_6m",
                 c("writeoffs").alias("writeoffs_or_settlements"), "history_months").alias("bureau"),
        F.struct(c("income_inr").alias("verified_monthly_income_inr"), "volatility_cv", "months_history",
                 "documentation_type").alias("income"),
        F.struct("existing_emi_inr", "proposed_emi_inr", c("utilization").alias("credit_card_utilization")).alias("obligations"),
        F.when(c("has_gst"), F.struct(c("gst_turnover_inr").alias("turnover_12m_inr"),
                                      c("bank_credits_inr").alias("bank_credits_12m_inr"))).alias("gst"),
        F.when(c("is_home"), F.struct("market_value_inr", "valuation_2_inr", "title_status", "legal_opinion")).alias("property"),
        *([c("docs").alias("documents")] if "docs" in files.columns else []),
    )


def read_book(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """Loan files. JSON lines are split across tasks; blank lines carry no row; a malformed line stops the read."""
    if fmt == "json":
        return spark.read.schema(LOAN_FILE_SCHEMA).json(path, mode="FAILFAST")
    return spark.read.schema(LOAN_FILE_SCHEMA).format(fmt).load(path)


def write_book(files: DataFrame, path: str, fmt: str = "json") -> None:
    """JSON lines keep the nested shape; columnar formats are partitioned by segment for pruning."""
    writer = files.write.mode("errorifexists")
    (writer if fmt == "json" else writer.partitionBy("segment")).format(fmt).save(path)


def read_decisions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(DECISION_SCHEMA).json(path, mode="FAILFAST")


def read_decisions_quarantine(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(good rows, malformed lines with the raw text and its file) for runs that must not stop."""
    # lines are read as text, so the raw form of a malformed one is kept whatever columns a query prunes to
    lines = spark.read.text(path).filter("trim(value) <> ''").withColumn("source_file", F.input_file_name())
    parsed = lines.withColumn("row", F.from_json("value", DECISION_SCHEMA + ", _corrupt_record STRING", {"mode": "PERMISSIVE"}))
    bad = parsed.filter("row._corrupt_record IS NOT NULL").select("source_file", F.col("value").alias("_corrupt_record"))
    return parsed.filter("row._corrupt_record IS NULL").select("row.*").drop("_corrupt_record"), bad


def write_decisions(decisions: DataFrame, path: str) -> None:
    """A run id is written once: an existing folder is an error, never overwritten."""
    decisions.write.mode("errorifexists").json(path)


def input_digest(spark: SparkSession, path: str) -> DataFrame:
    """SHA-256 of each frozen configuration or metadata file under a path.

    ``binaryFile`` loads one file into one row, so this is for configuration files; ``book_digest`` covers data.
    """
    raw = spark.read.format("binaryFile").load(path)
    return raw.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), F.sha2("content", 256).alias("sha256"))


def row_digest(df: DataFrame, columns: list[str]) -> DataFrame:
    """Canonical row hash: typed values joined in a fixed column order, NULL spelled out."""
    return df.withColumn("row_hash", F.sha2(F.concat_ws("|", *[
        F.coalesce(F.col(x).cast("string"), F.lit("~")) for x in columns]), 256))


def book_digest(df: DataFrame, columns: list[str]) -> DataFrame:
    """Order-free fingerprint of a whole table: counts and wrapped sums of hash prefixes combine map-side."""
    h = row_digest(df, columns)
    lane = F.conv(F.substring("row_hash", 1, 12), 16, 10).cast("bigint")
    return h.agg(F.count(F.lit(1)).alias("rows"), F.sum(lane.cast("decimal(38,0)")).alias("total"),
                 F.bit_xor(lane).alias("xor")).select(
        F.sha2(F.concat_ws("|", F.col("rows").cast("string"), F.col("total").cast("string"), F.col("xor").cast("string")), 256)
        .alias("digest"), "rows")


# ------------------------------------------------------------------------------------------------ contracts


def duplicate_keys(decisions: DataFrame) -> DataFrame:
    """(file, stage) keys with more than one replay row."""
    return decisions.groupBy("file_id", "stage").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def missing_files(processed: DataFrame, files: DataFrame) -> DataFrame:
    return processed.join(files.select("file_id"), "file_id", "left_anti")


def frozen_input_mismatch(recorded: DataFrame, actual: DataFrame) -> DataFrame:
    """Recorded digests that differ from, or are missing among, the inputs."""
    j = recorded.select("name", F.col("sha256").alias("recorded")).join(
        actual.select("name", F.col("sha256").alias("actual")), "name", "left")
    return j.withColumn("status", F.when(F.col("actual").isNull(), "MISSING")
                        .when(F.col("actual") == F.col("recorded"), "MATCH").otherwise("CHANGED"))


def split_of(file_id: Column) -> Column:
    """dev when the trailing number of the file id is a multiple of five, else holdout."""
    number = F.regexp_extract(file_id, r"(\d+)$", 1).cast("bigint")
    return F.when(number % 5 == 0, "dev").otherwise("holdout")


def first_files(files: DataFrame, n: int) -> DataFrame:
    """The first ``n`` files in book order (a top-n, so no full sort)."""
    if n < 0:
        raise ValueError("n must not be negative")
    return files.orderBy(F.length("file_id"), "file_id").limit(n)
