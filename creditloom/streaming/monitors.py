"""Scheduled monitors. Each aggregation is one function that runs unchanged on a table or on a stream.

Streams carry a watermark; on a table the watermark is ignored. Window results leave a stream in append mode, once the
watermark closes the window.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from creditloom import reference as R
from creditloom.functions.running import running_sum
from creditloom.operators.evaluate import bin_sql, ratio

c = F.col
LATENESS = "1 hour"


def calls(events: DataFrame) -> DataFrame:
    """Events as timed model calls with their watermark, set once here (a table ignores it).

    Zone-less timestamps are read as UTC, as watermarks need real instants.
    """
    return events.select(
        "event_id", c("ts").cast("timestamp").alias("ts"), "user_id", "event_type", (c("event_type") == "error").alias("failed"),
        (c("value") * 200).alias("latency_ms"), ((c("event_id") * 37 % 101).cast("double") / 100.0).alias("p"),
        (c("event_type") != "error").cast("double").alias("y"), F.concat(F.lit("G"), (c("user_id") % 3).cast("string")).alias("grp")).withWatermark("ts", LATENESS)


def day(column: Column) -> Column:
    return F.date_format(column, "yyyy-MM-dd HH:mm")


def calibration_bins(timed: DataFrame, window: str = "1 day") -> DataFrame:
    """Per window and probability bin: counts and sums (the only stateful step of the calibration monitor)."""
    return timed.groupBy(F.window("ts", window).alias("w"), F.expr(bin_sql()).alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("p").alias("sum_p"), F.sum("y").alias("sum_y"))


def calibration_windows(timed: DataFrame, window: str = "1 day", bins: int = 10) -> DataFrame:
    """Calibration error per window from one stateful aggregate: the bins are conditional sums, so a stream can run it."""
    tagged = timed.withColumn("bin", F.expr(bin_sql()))
    gaps = [F.sum(F.when(c("bin") == i, c("p") - c("y"))).alias(f"gap_{i}") for i in range(bins)]
    g = tagged.groupBy(F.window("ts", window).alias("w")).agg(F.count(F.lit(1)).alias("n"), *gaps)
    total = F.aggregate(F.array(*[F.abs(F.coalesce(f"gap_{i}", F.lit(0.0))) for i in range(bins)]), F.lit(0.0), lambda a, x: a + x)
    return g.select(day(c("w.start")).alias("window_start"), "n", ratio(total, c("n")).alias("ece"))


def alerts(windows: DataFrame, limit: float = R.ECE_MAX) -> DataFrame:
    """Windows past the drift threshold as MONITOR_ALERT events; new files then go to human review."""
    return windows.filter(F.round("ece", 9) > limit).select(
        F.lit("MONITOR_ALERT").alias("event_type"), "window_start", F.round("ece", 6).alias("ece"), F.lit("REVERT_TO_HUMAN_REVIEW").alias("action"))


def parity_counts(timed: DataFrame, size: str = "7 days", slide: str = "1 day") -> DataFrame:
    return timed.groupBy(F.window("ts", size, slide).alias("w"), "grp").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(c("event_type") == "click").alias("passed"))


GROUPS = ("G0", "G1", "G2")


def parity_windows(timed: DataFrame, groups: tuple[str, ...] = GROUPS, reference: str = "G0", size: str = "7 days", slide: str = "1 day") -> DataFrame:
    """Pass rate per group and window and its ratio to the reference group's.

    The groups are conditional counts of one aggregate, a row per window, so no join is needed and a stream can run it.
    """
    aggs = [x for i, g in enumerate(groups) for x in (F.count_if(c("grp") == g).alias(f"n_{i}"), F.count_if((c("grp") == g) & (c("event_type") == "click")).alias(f"passed_{i}"))]
    wide = timed.groupBy(F.window("ts", size, slide).alias("w")).agg(*aggs)
    i = groups.index(reference)
    ref = ratio(c(f"passed_{i}"), c(f"n_{i}"))
    rows = F.array(*[F.when(c(f"n_{j}") > 0, F.struct(F.lit(g).alias("grp"), c(f"n_{j}").alias("n"), ratio(c(f"passed_{j}"), c(f"n_{j}")).alias("rate"))) for j, g in enumerate(groups)])
    long = wide.select(day(c("w.start")).alias("window_start"), ref.alias("ref_rate"), F.inline(F.array_compact(rows)))
    return long.select("window_start", "grp", "n", "rate", ratio(c("rate"), c("ref_rate")).alias("rate_ratio"))


def call_rate(timed: DataFrame, limit: int) -> DataFrame:
    """Minutes with more calls than the limit."""
    g = timed.groupBy(F.window("ts", "1 minute").alias("w")).agg(F.count(F.lit(1)).alias("calls"))
    return g.filter(c("calls") > limit).select(day(c("w.start")).alias("minute"), "calls")


def timeout_share(timed: DataFrame, budget_ms: float = R.TIMEOUT_BUDGET_MS) -> DataFrame:
    g = timed.groupBy(F.window("ts", "1 day").alias("w")).agg(
        F.count(F.lit(1)).alias("calls"), F.count_if(c("latency_ms") > budget_ms).alias("slow"))
    return g.select(day(c("w.start")).alias("window_start"), "calls", "slow", F.round(ratio(c("slow"), c("calls")), 6).alias("slow_share"))


def deduplicated(timed: DataFrame) -> DataFrame:
    """Each call once. On a stream the key is forgotten once the watermark passes it."""
    if timed.isStreaming:
        return timed.dropDuplicatesWithinWatermark(["event_id"])
    return timed.dropDuplicates(["event_id"])


def daily_counts(timed: DataFrame) -> DataFrame:
    return timed.groupBy(F.window("ts", "1 day").alias("w")).agg(F.count(F.lit(1)).alias("calls")).select(
        day(c("w.start")).alias("window_start"), "calls")


def outage_episodes(timed: DataFrame, failures: int = R.BREAKER_FAILURES) -> DataFrame:
    """Runs of consecutive failures per source. A run is named by the successes counted before it."""
    epoch_day = F.floor(F.unix_seconds("ts") / 86400)
    ok = (~c("failed")).cast("bigint")
    runs = running_sum(timed, ["user_id"], ["ts", "event_id"], epoch_day, ok, "island").filter("failed")
    g = runs.groupBy("user_id", "island").agg(F.count(F.lit(1)).alias("failures"), F.min("ts").alias("t0"), F.max("ts").alias("t1"))
    return g.filter(c("failures") >= failures).select("user_id", "failures", day(c("t0")).alias("first_failure"), day(c("t1")).alias("last_failure"))


def backlog(items: DataFrame, day_seconds: int = 86400) -> DataFrame:
    """Open items per queue at the end of each day: daily net change, then a running sum over days."""
    opened = items.select("queue", F.floor(c("created_seq") / day_seconds).alias("day"), F.lit(1).alias("delta"))
    closed = items.filter("closed_seq IS NOT NULL").select("queue", F.floor(c("closed_seq") / day_seconds).alias("day"), F.lit(-1).alias("delta"))
    net = opened.unionByName(closed).groupBy("queue", "day").agg(F.sum("delta").alias("net"))
    # aggregated first: the running sum sees one row per queue and day
    return running_sum(net, ["queue"], ["day"], F.floor(c("day") / 64), c("net"), "open_items").select("queue", "day", "net", "open_items")


# ------------------------------------------------------------------------------------------------ stateful streams


class OutageCounter(StatefulProcessor):
    """Consecutive failures of one source across micro-batches; emits the run when a success ends it."""

    def __init__(self, failures: int = R.BREAKER_FAILURES) -> None:
        self.failures = failures

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.run = handle.getValueState("run", "failures bigint, first_failure string, last_failure string")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timer_values: Any) -> Iterator[pd.DataFrame]:
        state = self.run.get() if self.run.exists() else (0, "", "")
        n, first, last = state
        done = []
        batch = pd.concat(list(rows)).sort_values(["ts", "event_id"])
        for failed, at in zip(batch["failed"], batch["ts"].dt.strftime("%Y-%m-%d %H:%M"), strict=True):
            if failed:
                n, first, last = n + 1, first or at, at
            else:
                if n >= self.failures:
                    done.append((key[0], n, first, last))
                n, first, last = 0, "", ""
        self.run.update((n, first, last))
        if done:
            yield pd.DataFrame(done, columns=["user_id", "failures", "first_failure", "last_failure"])

    def close(self) -> None:
        pass


def outage_stream(timed: DataFrame, failures: int = R.BREAKER_FAILURES) -> DataFrame:
    return timed.select("user_id", "event_id", "ts", "failed").groupBy("user_id").transformWithStateInPandas(
        statefulProcessor=OutageCounter(failures), outputStructType="user_id bigint, failures bigint, first_failure string, last_failure string",
        outputMode="Append", timeMode="None")


class WatchlistTier(StatefulProcessor):
    """Latest six repayment months of an account; emits its watchlist tier whenever months arrive."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.months = handle.getMapState("months", "m bigint", "dpd bigint, bounced boolean, partial boolean, balance_inr bigint")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timer_values: Any) -> Iterator[pd.DataFrame]:
        for batch in rows:
            for r in batch.itertuples(index=False):
                self.months.updateValue((int(r.m),), (int(r.dpd), bool(r.bounced), bool(r.partial), int(r.balance_inr)))
        known = sorted((k[0], *v) for k, v in self.months.iterator())
        for old in known[:-6]:
            self.months.removeKey((old[0],))
        known = known[-6:]
        dpd = [m[1] for m in known]
        rises = sum(b > a for a, b in list(zip(dpd, dpd[1:], strict=False))[-4:])
        bal = [m[4] for m in known]
        stressed = len(bal) >= 2 and bal[0] + bal[1] > 0 and 10 * (bal[-2] + bal[-1]) <= 6 * (bal[0] + bal[1])
        warnings = int(max(dpd) >= 30 or rises >= 3) + int(sum(m[2] for m in known) >= 2) + int(sum(m[3] for m in known) >= 2) + int(stressed)
        yield pd.DataFrame([(key[0], warnings, f"T{min(3, warnings)}")], columns=["k", "warnings", "tier"])

    def close(self) -> None:
        pass


def watchlist_stream(months: DataFrame) -> DataFrame:
    return months.groupBy("k").transformWithStateInPandas(
        statefulProcessor=WatchlistTier(), outputStructType="k bigint, warnings bigint, tier string", outputMode="Update", timeMode="None")


def event_stream(spark: SparkSession, path: str, schema, per_trigger: int = 1) -> DataFrame:
    """Parquet files of a folder as a stream, a bounded number of files per micro-batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def append_alerts(path: str):
    """foreachBatch sink writing alerts to the audit folder; a replayed batch overwrites only its own partition."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return write
