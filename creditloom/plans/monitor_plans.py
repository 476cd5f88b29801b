"""Registered queries: the batch form of every monitor."""

from __future__ import annotations

from pyspark.sql import functions as F

from creditloom.operators import queue, rules
from creditloom.oracle.views import view
from creditloom.plans.policy_plans import decision_attempts, queue_items
from creditloom.plans.registry import query
from creditloom.sources import book as book_source
from creditloom.sources.tables import table
from creditloom.streaming import monitors as M

c = F.col
RATE_LIMIT = 2  # per minute; the sample stream is sparse, the production limit is in the fixed values


def timed(spark, folder):
    return M.calls(table(spark, folder, "events"))


view("timed", "", """SELECT event_id, ts, user_id, event_type, event_type = 'error' AS failed, value * 200 AS latency_ms, (event_id * 37 % 101) / CAST(100 AS DOUBLE) AS pp,
 CASE WHEN event_type <> 'error' THEN 1.0 ELSE 0.0 END AS y, 'G' || CAST(user_id % 3 AS VARCHAR) AS grp, strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M') AS d FROM events""")
_BIN = "CASE WHEN pp < 0.1 THEN 0 WHEN pp < 0.2 THEN 1 WHEN pp < 0.30000000000000004 THEN 2 WHEN pp < 0.4 THEN 3 WHEN pp < 0.5 THEN 4 WHEN pp < 0.6000000000000001 THEN 5 WHEN pp < 0.7000000000000001 THEN 6 WHEN pp < 0.8 THEN 7 WHEN pp < 0.9 THEN 8 ELSE 9 END"
view("mcal", "timed", f"SELECT d AS window_start, CAST(sum(n) AS BIGINT) AS n, sum(abs(sp - sy)) / sum(n) AS ece FROM (SELECT d, {_BIN} AS bin, count(*) AS n, sum(pp) AS sp, sum(y) AS sy FROM timed GROUP BY ALL) GROUP BY d")


@query("mon_calibration_window", "SELECT window_start, n, round(ece, 6) AS ece FROM mcal", "mcal")
def mon_calibration_window(spark, folder):
    return M.calibration_windows(timed(spark, folder)).select("window_start", "n", F.round("ece", 6).alias("ece"))


@query("mon_alert", "SELECT 'MONITOR_ALERT' AS event_type, window_start, round(ece, 6) AS ece, 'REVERT_TO_HUMAN_REVIEW' AS action FROM mcal WHERE round(ece, 9) > 0.08", "mcal")
def mon_alert(spark, folder):
    return M.alerts(M.calibration_windows(timed(spark, folder)))


@query("mon_parity_window", """SELECT w AS window_start, g.grp, g.n, round(g.rate, 6) AS rate, round(g.rate / nullif(r.rate, 0), 6) AS rate_ratio FROM
(SELECT strftime(date_trunc('day', ts) - i * INTERVAL 1 DAY, '%Y-%m-%d %H:%M') AS w, grp, count(*) AS n, count(*) FILTER (WHERE event_type = 'click') * 1.0 / count(*) AS rate FROM timed, range(7) t(i) GROUP BY ALL) g
LEFT JOIN (SELECT strftime(date_trunc('day', ts) - i * INTERVAL 1 DAY, '%Y-%m-%d %H:%M') AS w, count(*) FILTER (WHERE event_type = 'click') * 1.0 / count(*) AS rate FROM timed, range(7) t(i) WHERE grp = 'G0' GROUP BY ALL) r USING (w)""", "timed")
def mon_parity_window(spark, folder):
    return M.parity_windows(timed(spark, folder)).select("window_start", "grp", "n", F.round("rate", 6).alias("rate"), F.round("rate_ratio", 6).alias("rate_ratio"))


@query("mon_call_rate", f"SELECT strftime(date_trunc('minute', ts), '%Y-%m-%d %H:%M') AS minute, count(*) AS calls FROM timed GROUP BY ALL HAVING count(*) > {RATE_LIMIT}", "timed")
def mon_call_rate(spark, folder):
    return M.call_rate(timed(spark, folder), RATE_LIMIT)


@query("mon_outage_episodes", """SELECT user_id, failures, first_failure, last_failure FROM (SELECT user_id, island, count(*) AS failures, strftime(min(ts), '%Y-%m-%d %H:%M') AS first_failure, strftime(max(ts), '%Y-%m-%d %H:%M') AS last_failure
FROM (SELECT *, count(*) FILTER (WHERE NOT failed) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM timed) WHERE failed GROUP BY user_id, island) WHERE failures >= 3""", "timed")
def mon_outage_episodes(spark, folder):
    return M.outage_episodes(timed(spark, folder), 3)


@query("mon_timeout_budget", "SELECT d AS window_start, count(*) AS calls, count(*) FILTER (WHERE latency_ms > 2000) AS slow, round(count(*) FILTER (WHERE latency_ms > 2000) * 1.0 / count(*), 6) AS slow_share FROM timed GROUP BY d", "timed")
def mon_timeout_budget(spark, folder):
    return M.timeout_share(timed(spark, folder))


@query("mon_stream_dedupe", "SELECT d AS window_start, count(DISTINCT event_id) AS calls FROM timed GROUP BY d", "timed")
def mon_stream_dedupe(spark, folder):
    t = timed(spark, folder)
    return M.daily_counts(M.deduplicated(t.unionByName(t.filter("event_id % 10 = 0"))))


@query("mon_review_backlog", """SELECT queue, day, net, CAST(sum(net) OVER (PARTITION BY queue ORDER BY day) AS BIGINT) AS open_items FROM (SELECT queue, day, CAST(sum(delta) AS BIGINT) AS net FROM (
SELECT queue, created_seq // 86400 AS day, 1 AS delta FROM current_items UNION ALL SELECT queue, (created_seq + 3600 + attempt_seq % 500000) // 86400, -1 FROM current_items WHERE attempt_seq IS NOT NULL) GROUP BY ALL)""", "current_items")
def mon_review_backlog(spark, folder):
    items = queue_items(spark, folder)
    cur = queue.current(items, decision_attempts(items)).withColumn(
        "closed_seq", F.when(c("attempt_seq").isNotNull(), c("created_seq") + 3600 + c("attempt_seq") % 500000))
    return M.backlog(cur)


@query("mon_watchlist_stream", """SELECT k, w AS warnings, 'T' || CAST(least(3, w) AS VARCHAR) AS tier FROM (SELECT k, CAST(coalesce(dpd_rising, false) AS BIGINT) + CAST(n_bounced >= 2 AS BIGINT) + CAST(n_partial >= 2 AS BIGINT)
+ CAST(coalesce(balance_change_band = 'falling_40_plus', false) AS BIGINT) AS w FROM conduct)""", "conduct")
def mon_watchlist_stream(spark, folder):
    df = book_source.monthly_conduct(spark, folder)
    warnings = " + ".join(f"CAST({x} AS BIGINT)" for x in rules.EARLY_WARNINGS.values())
    return df.selectExpr("k", f"{warnings} AS warnings").selectExpr("k", "warnings", "concat('T', CAST(least(3, warnings) AS STRING)) AS tier")
