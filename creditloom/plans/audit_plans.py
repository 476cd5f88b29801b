"""Registered queries: the audit log, its verification and as-of joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from creditloom.operators import audit
from creditloom.oracle.views import view
from creditloom.plans.policy_plans import all_decisions, decision_attempts, queue_items
from creditloom.plans.registry import query
from creditloom.plans.run import run_table
from creditloom.sources.tables import table

c = F.col
BODY = ["event_type", "text"]


def log_events(spark, folder):
    """Conversation turns as audit events: a file per conversation, an event per turn."""
    return table(spark, folder, "conversations").select(
        c("conv_id").cast("string").alias("file_id"), (c("turn") + 1).cast("bigint").alias("seq"),
        F.expr("CASE role WHEN 'user' THEN 'MODEL_CALL' WHEN 'assistant' THEN 'QUEUED' ELSE 'MODEL_FAILURE' END").alias("event_type"), "text")


def sealed_log(spark, folder):
    return run_table(spark, folder, "sealed", lambda: audit.seal(log_events(spark, folder), BODY))


view("log", "", """SELECT CAST(conv_id AS VARCHAR) AS file_id, CAST(turn + 1 AS BIGINT) AS seq,
 CASE role WHEN 'user' THEN 'MODEL_CALL' WHEN 'assistant' THEN 'QUEUED' ELSE 'MODEL_FAILURE' END AS event_type, text FROM conversations""")
view("hashed", "log", "SELECT file_id, seq, event_type, sha256(concat_ws('|', coalesce(event_type, '~'), coalesce(text, '~'))) AS body_hash FROM log")
view("sealed", "hashed", f"""SELECT * FROM (WITH RECURSIVE chain AS (
 SELECT file_id, seq, event_type, body_hash, '{'0' * 64}' AS prev_hash, sha256('{'0' * 64}' || body_hash) AS entry_hash FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY seq) AS rn FROM hashed) WHERE rn = 1
 UNION ALL SELECT h.file_id, h.seq, h.event_type, h.body_hash, c.entry_hash, sha256(c.entry_hash || h.body_hash) FROM chain c
  JOIN (SELECT *, lag(seq) OVER (PARTITION BY file_id ORDER BY seq) AS before FROM hashed) h ON h.file_id = c.file_id AND h.before = c.seq) SELECT * FROM chain)""")


@query("audit_scan", "SELECT file_id, seq, event_type, length(text) AS n_chars FROM log", "log")
def audit_scan(spark, folder):
    return log_events(spark, folder).orderBy("file_id", "seq").select("file_id", "seq", "event_type", F.length("text").alias("n_chars"))


@query("audit_trail", "SELECT file_id, seq, event_type FROM log WHERE file_id IN (SELECT file_id FROM log WHERE event_type = 'MODEL_FAILURE')", "log")
def audit_trail(spark, folder):
    e = log_events(spark, folder).drop("text")
    return audit.trail(e, e.filter("event_type = 'MODEL_FAILURE'"))


@query("audit_seal", "SELECT file_id, seq, prev_hash, entry_hash FROM sealed", "sealed")
def audit_seal(spark, folder):
    return audit.seal(log_events(spark, folder), BODY).select("file_id", "seq", "prev_hash", "entry_hash")


def tampered(spark, folder):
    """The sealed log after an attack: edited, re-hashed, deleted and truncated rows in different files."""
    f = c("file_id").cast("bigint")
    log = sealed_log(spark, folder)
    log = log.filter(~((f % 11 == 3) & (c("seq") == 2)) & ~((f % 13 == 5) & (c("seq") >= 4)))
    edited = (f % 7 == 2) & (c("seq") == 3)
    rehashed = (f % 17 == 6) & (c("seq") == 2)
    new_body = F.sha2(F.lit("edited"), 256)
    return log.withColumn("body_hash", F.when(edited | rehashed, new_body).otherwise(c("body_hash"))).withColumn(
        "entry_hash", F.when(rehashed, F.sha2(F.concat("prev_hash", new_body), 256)).otherwise(c("entry_hash")))


view("tampered", "sealed", """SELECT file_id, seq, prev_hash, CASE WHEN ed OR re THEN sha256('edited') ELSE body_hash END AS body_hash,
 CASE WHEN re THEN sha256(prev_hash || sha256('edited')) ELSE entry_hash END AS entry_hash FROM (SELECT *, f % 7 = 2 AND seq = 3 AS ed, f % 17 = 6 AND seq = 2 AS re
  FROM (SELECT *, CAST(file_id AS BIGINT) AS f FROM sealed) WHERE NOT (f % 11 = 3 AND seq = 2) AND NOT (f % 13 = 5 AND seq >= 4))""")


@query("audit_verify", f"""SELECT file_id, min(code) // 4 AS first_bad_seq, ['missing_entry', 'broken_link', 'modified_entry', 'truncated'][1 + min(code) % 4] AS reason FROM (
 SELECT file_id, CASE WHEN seq > 1 AND before IS DISTINCT FROM seq - 1 THEN (seq - 1) * 4 WHEN prev_hash <> coalesce(before_hash, '{'0' * 64}') THEN seq * 4 + 1
  WHEN entry_hash <> sha256(prev_hash || body_hash) THEN seq * 4 + 2 END AS code FROM (SELECT *, lag(seq) OVER w AS before, lag(entry_hash) OVER w AS before_hash FROM tampered WINDOW w AS (PARTITION BY file_id ORDER BY seq))
 UNION ALL SELECT s.file_id, (coalesce(max(t.seq), 0) + 1) * 4 + 3 FROM (SELECT file_id, max(seq) AS high FROM sealed GROUP BY 1) s LEFT JOIN tampered t USING (file_id) GROUP BY s.file_id, s.high HAVING coalesce(max(t.seq), 0) < s.high)
WHERE code IS NOT NULL GROUP BY file_id""", "tampered")
def audit_verify(spark, folder):
    high = sealed_log(spark, folder).groupBy("file_id").agg(F.max("seq").alias("high"))
    return audit.verify(tampered(spark, folder), high)


def long_events(spark, folder):
    """A thousand events a file, so that a file's log has several blocks."""
    return table(spark, folder, "events").select(F.expr("CAST(event_id DIV 1000 AS STRING)").alias("file_id"), (c("event_id") % 1000 + 1).cast("bigint").alias("seq"),
                                                 "event_type", c("props").alias("text"))


view("long_log", "", "SELECT CAST(event_id // 1000 AS VARCHAR) AS file_id, CAST(event_id % 1000 + 1 AS BIGINT) AS seq, event_type, props AS text FROM events")
view("long_hashed", "long_log", """SELECT file_id, seq, (seq - 1) // 256 AS block, sha256(concat_ws('|', coalesce(event_type, '~'), coalesce(text, '~'))) AS body_hash FROM long_log""")
view("long_sealed", "long_hashed", f"""SELECT *, sha256(prev_hash || body_hash) AS entry_hash FROM (WITH RECURSIVE chain AS (
 SELECT file_id, seq, block, body_hash, CASE WHEN block = 0 THEN '{'0' * 64}' ELSE sha256('block:' || block) END AS prev_hash FROM long_hashed WHERE (seq - 1) % 256 = 0
 UNION ALL SELECT h.file_id, h.seq, h.block, h.body_hash, sha256(c.prev_hash || c.body_hash) FROM chain c
  JOIN long_hashed h ON h.file_id = c.file_id AND h.seq = c.seq + 1 AND (h.seq - 1) % 256 <> 0) SELECT * FROM chain)""")


@query("audit_seal_long", "SELECT file_id, seq, prev_hash, entry_hash FROM long_sealed", "long_sealed")
def audit_seal_long(spark, folder):
    return audit.seal(long_events(spark, folder), BODY).select("file_id", "seq", "prev_hash", "entry_hash")


@query("audit_block_heads", """SELECT file_id, CAST(block AS BIGINT) AS block, max(seq) AS seq, max_by(entry_hash, seq) AS head FROM long_sealed GROUP BY file_id, block""", "long_sealed")
def audit_block_heads(spark, folder):
    return audit.block_heads(audit.seal(long_events(spark, folder), BODY))


@query("audit_file_roots", """SELECT file_id, sha256(string_agg(head, '|' ORDER BY block)) AS root FROM (
 SELECT file_id, block, max_by(entry_hash, seq) AS head FROM long_sealed GROUP BY file_id, block) GROUP BY file_id""", "long_sealed")
def audit_file_roots(spark, folder):
    return audit.file_roots(audit_block_heads(spark, folder))


@query("audit_verify_long", """SELECT file_id, least(512, max(seq)) AS first_bad_seq, 'rewritten_block' AS reason FROM long_log WHERE CAST(file_id AS BIGINT) % 3 = 1 GROUP BY file_id HAVING max(seq) >= 300""", "long_log")
def audit_verify_long(spark, folder):
    """A block that was rewritten consistently, from an entry in its middle to its end, differs from its stored head."""
    events = long_events(spark, folder)
    sealed = audit.seal(events, BODY)
    forged = events.withColumn("text", F.when((c("file_id").cast("bigint") % 3 == 1) & (c("seq") == 300), F.lit("forged")).otherwise(c("text")))
    high = sealed.groupBy("file_id").agg(F.max("seq").alias("high"))
    return audit.verify(audit.seal(forged, BODY), high, audit.block_heads(sealed))


# the events of each decision, in one or two attempts, with some lost, doubled, out of order, late or of another queue
_BASE = "CASE stage WHEN 'appraisal' THEN 0 WHEN 'sanction_docs' THEN 100 ELSE 200 END + 20 * a"
_TRAIL = [("'CALL'", "b + CASE WHEN k % 103 = 4 THEN 3 ELSE 1 END", "true"), ("'POLICY_OUTCOME'", "b + 2", "true"),
          ("'QUEUED'", "b + CASE WHEN k % 107 = 9 THEN 0 WHEN k % 89 = 6 AND k % 7 = 0 AND a = 0 THEN 30 ELSE 4 END", "queue IS NOT NULL AND k % 101 <> 3"),
          ("'PRICING'", "b + 5", "outcome = 'PROCEED_TO_SANCTIONING_AUTHORITY' AND k % 109 <> 7"), ("'POLICY_OUTCOME'", "b + 6", "k % 113 = 8 AND a = 0"),
          ("'CALL'", "b + 7", "k % 61 = 2 AND a = 0")]
_WRITTEN = "CASE WHEN k % 97 = 5 THEN 'elsewhere' ELSE queue END"


def trail_events(spark, folder):
    """The events, written once a run: the check reads them once for each of its rules."""
    return run_table(spark, folder, "trail_events", lambda: _trail_events(spark, folder))


def _trail_events(spark, folder):
    d = all_decisions(spark, folder).selectExpr("k", "file_id", "stage", "outcome", "queue", "failure_kind", "explode(CASE WHEN k % 7 = 0 THEN array(0, 1) ELSE array(0) END) AS a")
    call = "CASE WHEN failure_kind = 'pii_blocked' THEN 'PII_BLOCK' WHEN failure_kind IS NOT NULL THEN 'MODEL_FAILURE' ELSE 'MODEL_CALL' END"
    e = "array(" + ", ".join(f"CASE WHEN {when} THEN named_struct('event_type', {call if t == chr(39) + 'CALL' + chr(39) else t}, 'seq', CAST({at} AS BIGINT), 'queue', "
                                           f"{_WRITTEN if 'QUEUED' in t else 'queue'}) END" for t, at, when in _TRAIL) + ")"
    # an event that was not written is a null struct, which inline turns into a row of nulls
    return d.withColumn("b", F.expr(_BASE)).select("file_id", "stage", c("outcome").alias("policy_outcome"), F.expr(f"inline({e})")).filter("event_type IS NOT NULL")


def trail_required(spark, folder):
    return run_table(spark, folder, "trail_required", lambda: all_decisions(spark, folder).selectExpr("file_id", "stage", "CASE WHEN k % 7 = 0 THEN 2 ELSE 1 END AS needed"))


view("trail_log", "decisions", "SELECT file_id, stage, outcome, unnest([" + ", ".join(
    f"CASE WHEN {when} THEN {{'kind': {t}, 'seq': {at}, 'q': {_WRITTEN if 'QUEUED' in t else 'queue'}}} END" for t, at, when in _TRAIL)
    + f"]) AS e FROM (SELECT *, {_BASE} AS b FROM (SELECT *, unnest(CASE WHEN k % 7 = 0 THEN [0, 1] ELSE [0] END) AS a FROM decisions))")
view("trail_nth", "trail_log", "SELECT file_id, stage, outcome, e.kind AS kind, e.seq AS seq, e.q AS q, row_number() OVER (PARTITION BY file_id, stage, e.kind ORDER BY e.seq) AS i FROM trail_log WHERE e IS NOT NULL")
view("trail_pairs", "trail_nth", """SELECT o.file_id, o.stage, o.i, o.outcome, o.q, c.seq AS call, o.seq AS at_outcome, n.seq AS next_call, f.seq AS next_outcome FROM trail_nth o
JOIN trail_nth c ON c.kind = 'CALL' AND c.file_id = o.file_id AND c.stage = o.stage AND c.i = o.i LEFT JOIN trail_nth n ON n.kind = 'CALL' AND n.file_id = o.file_id AND n.stage = o.stage AND n.i = o.i + 1
LEFT JOIN trail_nth f ON f.kind = 'POLICY_OUTCOME' AND f.file_id = o.file_id AND f.stage = o.stage AND f.i = o.i + 1 WHERE o.kind = 'POLICY_OUTCOME'""")
view("trail_claims", "trail_pairs", """SELECT *, row_number() OVER (PARTITION BY file_id, stage, kind ORDER BY i) AS j FROM (
SELECT *, 'QUEUED' AS kind FROM trail_pairs WHERE q IS NOT NULL UNION ALL SELECT *, 'PRICING' FROM trail_pairs WHERE outcome = 'PROCEED_TO_SANCTIONING_AUTHORITY')""")
view("trail_met", "trail_claims trail_nth", """SELECT p.*, m.seq AS at_met, m.q AS got FROM trail_claims p JOIN trail_nth m ON m.kind = p.kind AND m.file_id = p.file_id AND m.stage = p.stage AND m.i = p.j""")
_COUNT = "(SELECT count(*) FROM {} x WHERE x.file_id = d.file_id AND x.stage = d.stage AND x.kind = '{}')"
view("trailv", "trail_pairs trail_met trail_claims trail_nth decisions", f"""SELECT file_id, stage, i AS attempt, 'outcome_before_result' AS problem FROM trail_pairs WHERE call >= at_outcome
UNION ALL SELECT file_id, stage, i, 'next_call_before_outcome' FROM trail_pairs WHERE at_outcome >= next_call
UNION ALL SELECT file_id, stage, i, lower(kind) || '_before_outcome' FROM trail_met WHERE at_met <= at_outcome UNION ALL SELECT file_id, stage, i, lower(kind) || '_after_next_outcome' FROM trail_met WHERE at_met >= next_outcome
UNION ALL SELECT file_id, stage, i, 'wrong_queue' FROM trail_met WHERE kind = 'QUEUED' AND got IS DISTINCT FROM q
UNION ALL SELECT d.file_id, d.stage, 0, 'gateway_results' FROM decisions d WHERE {_COUNT.format('trail_nth', 'CALL')} <> CASE WHEN k % 7 = 0 THEN 2 ELSE 1 END
UNION ALL SELECT d.file_id, d.stage, 0, 'policy_outcomes' FROM decisions d WHERE {_COUNT.format('trail_nth', 'POLICY_OUTCOME')} <> CASE WHEN k % 7 = 0 THEN 2 ELSE 1 END
UNION ALL SELECT d.file_id, d.stage, 0, 'queued_events' FROM decisions d WHERE {_COUNT.format('trail_nth', 'QUEUED')} <> {_COUNT.format('trail_claims', 'QUEUED')}
UNION ALL SELECT d.file_id, d.stage, 0, 'pricing_events' FROM decisions d WHERE {_COUNT.format('trail_nth', 'PRICING')} <> {_COUNT.format('trail_claims', 'PRICING')}""")


@query("audit_trail_complete", "SELECT file_id, stage, CAST(attempt AS BIGINT) AS attempt, problem FROM trailv", "trailv")
def audit_trail_complete(spark, folder):
    """Each broken rule with the attempt that breaks it; a lawful second attempt is none."""
    return audit.trail_problems(trail_events(spark, folder), trail_required(spark, folder))


@query("audit_completeness_rate", """SELECT count(*) AS files, round(avg(CASE WHEN b.file_id IS NULL THEN 1.0 ELSE 0.0 END), 6) AS complete_share
FROM (SELECT DISTINCT file_id FROM decisions) d LEFT JOIN (SELECT DISTINCT file_id FROM trailv) b ON b.file_id = d.file_id""", "decisions trailv")
def audit_completeness_rate(spark, folder):
    required = trail_required(spark, folder)
    return audit.completeness(audit.trail_problems(trail_events(spark, folder), required), required).select("files", F.round("complete_share", 6).alias("complete_share"))


@query("audit_dump", "SELECT printf('F%06d', user_id + 1) AS file_id, event_id AS seq, event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS detail_k FROM events")
def audit_dump(spark, folder):
    e = table(spark, folder, "events").withColumn("detail", F.parse_json("props"))
    return e.select(F.expr("printf('F%06d', user_id + 1)").alias("file_id"), c("event_id").alias("seq"), "event_type",
                    F.variant_get("detail", "$.k", "bigint").alias("detail_k"))


@query("audit_field_validity", """SELECT event_id, concat_ws(',', CASE WHEN event_type NOT IN ('click', 'error', 'view') THEN 'event_type' END, CASE WHEN event_id % 89 = 1 THEN 'latency_ms' END,
CASE WHEN event_id % 61 = 2 THEN 'input_tokens' END, CASE WHEN event_id % 71 = 3 THEN 'detail_json' END) AS problems FROM events
WHERE event_type NOT IN ('click', 'error', 'view') OR event_id % 89 = 1 OR event_id % 61 = 2 OR event_id % 71 = 3""")
def audit_field_validity(spark, folder):
    e = table(spark, folder, "events").select(
        "event_id", "event_type", F.when(c("event_id") % 89 == 1, F.lit(float("nan"))).otherwise(c("value")).alias("latency_ms"),
        F.when(c("event_id") % 61 == 2, "many").otherwise(F.get_json_object("props", "$.k")).alias("tokens_text"),
        F.when(c("event_id") % 71 == 3, "{not json").otherwise(c("props")).alias("detail"), c("ts").alias("created_ts"))
    return audit.field_problems(e, ("click", "error", "view")).select("event_id", "problems")


@query("join_asof_model_result", """SELECT q.file_id, q.seq, CASE WHEN r.event_type = 'MODEL_CALL' THEN r.seq END AS result_seq FROM (SELECT * FROM log WHERE event_type = 'QUEUED') q
ASOF LEFT JOIN (SELECT * FROM log WHERE event_type <> 'QUEUED') r ON q.file_id = r.file_id AND q.seq > r.seq""", "log")
def join_asof_model_result(spark, folder):
    e = log_events(spark, folder).select("file_id", "seq", "event_type")
    results = e.filter("event_type <> 'QUEUED'").select("file_id", "seq", c("seq").alias("result_seq"), c("event_type").alias("kind"))
    hit = audit.asof_last(e.filter("event_type = 'QUEUED'").select("file_id", "seq"), results, ["file_id"], "seq", ["result_seq", "kind"])
    # a failed call before the item means it had no answers to show
    return hit.select("file_id", "seq", F.when(c("kind") == "MODEL_CALL", c("result_seq")).alias("result_seq"))


@query("join_asof_authorization", """SELECT file_id, verdict = 'accept' AND trim(reviewer_id) <> '' AND attempt_seq % 7 <> 0 AS authorized FROM (SELECT i.file_id, a.* FROM attempts a JOIN items i USING (item_id))
QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY attempt_seq DESC) = 1""", "attempts items")
def join_asof_authorization(spark, folder):
    items = queue_items(spark, folder)
    a = decision_attempts(items).join(items.select("item_id", "file_id"), "item_id")
    ok = (c("verdict") == "accept") & (F.trim("reviewer_id") != "") & (c("attempt_seq") % 7 != 0)
    # newest decision and whether it qualifies, in one sortable number: a fixed-width maximum, no ranking
    return a.groupBy("file_id").agg(F.max(c("attempt_seq") * 2 + ok.cast("bigint")).alias("newest")).select("file_id", (c("newest") % 2 == 1).alias("authorized"))
