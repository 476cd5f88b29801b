"""Human review queues as views over append-only events: an item plus its first valid decision."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from creditloom import reference as R
from creditloom.functions.bands import _text
from creditloom.functions.ranks import row_numbers
from creditloom.sources.tables import inline

_ALL_CODES = ", ".join(_text(code) for codes in R.REVIEWER_CODES.values() for code in codes)


def first_decisions(attempts: DataFrame) -> DataFrame:
    """The earliest acceptable decision of each item: a minimum, so a much-contested item combines map-side."""
    ok = attempts.filter("problem IS NULL")
    best = F.min(F.struct("attempt_seq", "verdict", "reason_code", "reviewer_id")).alias("d")
    return ok.groupBy("item_id").agg(best).select("item_id", "d.*")


def with_problems(attempts: DataFrame, items: DataFrame) -> DataFrame:
    """Why an attempted decision is refused on its own (bad verdict, code, reviewer or item); NULL when acceptable."""
    known = items.select("item_id", F.lit(True).alias("known"))
    j = attempts.join(known, "item_id", "left")
    return j.withColumn("problem", F.expr(
        f"CASE WHEN verdict IS NULL OR verdict NOT IN ('accept', 'modify', 'reject') THEN 'invalid_verdict'"
        f" WHEN reason_code IS NULL OR reason_code NOT IN ({_ALL_CODES}) THEN 'unknown_reason_code'"
        " WHEN reviewer_id IS NULL OR trim(reviewer_id) = '' THEN 'blank_reviewer'"
        " WHEN known IS NULL THEN 'unknown_item' END")).drop("known")


def current(items: DataFrame, attempts: DataFrame) -> DataFrame:
    """Every item with its status: decided by its first acceptable decision, open otherwise."""
    won = first_decisions(with_problems(attempts, items))
    return items.join(won, "item_id", "left").withColumn("status", F.when(F.col("attempt_seq").isNull(), "open").otherwise("decided"))


def refused(items: DataFrame, attempts: DataFrame) -> DataFrame:
    """Attempts that were refused, each with its reason; a decision after the first acceptable one is too late."""
    checked = with_problems(attempts, items)
    won = first_decisions(checked).select("item_id", F.col("attempt_seq").alias("won_seq"))
    j = checked.join(won, "item_id", "left")
    late = F.col("problem").isNull() & (F.col("attempt_seq") > F.col("won_seq"))
    return j.withColumn("problem", F.when(late, "already_decided").otherwise(F.col("problem"))).filter("problem IS NOT NULL")


def review_order(items: DataFrame) -> DataFrame:
    """Review position in each queue: credit review nearest to passing first, every other queue oldest first.

    A queue may hold most of the book, so positions come from bucket offsets instead of one window per queue.
    """
    credit = F.col("queue") == "credit_review"
    key = F.when(credit, -F.col("closeness"))
    coarse = F.when(~credit, F.floor(F.col("created_seq") / 4096)).when(key.isNull(), F.lit(1 << 40)).otherwise(F.floor(key * 1000))
    fine = {"_key": key, "_slot": F.floor(F.col("created_seq") / 4096)}
    return row_numbers(items, ["queue"], coarse, fine, [F.col("_key").asc_nulls_last(), F.col("_slot")],
                       [F.col("created_seq"), F.col("item_id")], "position")


def stats(current_items: DataFrame, spark: SparkSession) -> DataFrame:
    """Counts by queue and status (zero where none), by verdict and by reason code, in one pass of grouping sets."""
    counted = current_items.selectExpr("queue", "status", "verdict", "reason_code", "item_id", "created_seq").createOrReplaceTempView
    counted("_queue_items")
    sets = spark.sql(
        "SELECT CASE WHEN grouping(queue) = 0 THEN 'queue_status' WHEN grouping(verdict) = 0 THEN 'verdict' ELSE 'reason_code' END AS kind,"
        " CASE WHEN grouping(queue) = 0 THEN concat(queue, '/', status) WHEN grouping(verdict) = 0 THEN verdict ELSE reason_code END AS name,"
        " count(1) AS n, min(CASE WHEN status = 'open' THEN created_seq END) AS oldest_open FROM _queue_items"
        " GROUP BY GROUPING SETS ((queue, status), (verdict), (reason_code))").filter("name IS NOT NULL")
    every = [("queue_status", f"{q}/{s}") for q in R.QUEUE_OWNER for s in ("open", "decided")] + [("verdict", d) for d in R.DECISION_VERBS]
    zeros = inline(spark, every, "kind string; name string")
    return zeros.join(sets, ["kind", "name"], "full").select("kind", "name", F.coalesce("n", F.lit(0)).alias("n"), "oldest_open")
