"""Tamper detection over block boundaries, as-of lookups and queue decisions against brute force."""

from __future__ import annotations

import hashlib
import random

from pyspark.sql import functions as F

from creditloom.operators import audit, queue


def test_chain_links_and_tampering(spark):
    events = spark.createDataFrame([("A", i, f"t{i}") for i in range(1, 601)] + [("B", 1, "x"), ("B", 2, None)], "file_id string, seq bigint, text string")
    sealed = audit.seal(events, ["text"]).persist()
    rows = {(r.file_id, r.seq): r for r in sealed.collect()}
    prev = "0" * 64
    for i in range(1, 257):
        body = hashlib.sha256(f"t{i}".encode()).hexdigest()
        prev = hashlib.sha256((prev + body).encode()).hexdigest()
        assert rows[("A", i)].entry_hash == prev
    high = sealed.groupBy("file_id").agg(F.max("seq").alias("high"))
    assert audit.verify(sealed, high).count() == 0
    edited = sealed.withColumn("body_hash", F.when((F.col("file_id") == "A") & (F.col("seq") == 300), F.sha2(F.lit("no"), 256)).otherwise(F.col("body_hash")))
    assert [tuple(r) for r in audit.verify(edited, high).collect()] == [("A", 300, "modified_entry")]
    rehashed = edited.withColumn("entry_hash", F.when((F.col("file_id") == "A") & (F.col("seq") == 300), F.sha2(F.concat("prev_hash", "body_hash"), 256)).otherwise(F.col("entry_hash")))
    assert [tuple(r) for r in audit.verify(rehashed, high).collect()] == [("A", 301, "broken_link")]
    gap = sealed.filter(~((F.col("file_id") == "A") & (F.col("seq") == 257)))
    assert [tuple(r) for r in audit.verify(gap, high).collect()] == [("A", 257, "missing_entry")]
    cut = sealed.filter("NOT (file_id = 'B' AND seq = 2)")
    assert [tuple(r) for r in audit.verify(cut, high).collect()] == [("B", 2, "truncated")]
    heads = audit.block_heads(sealed)
    assert sorted((r.block, r.seq) for r in heads.filter("file_id = 'A'").collect()) == [(0, 256), (1, 512), (2, 600)]
    assert audit.verify(sealed, high, heads).count() == 0
    forged = audit.seal(events.withColumn("text", F.when((F.col("file_id") == "A") & F.col("seq").between(257, 512), F.lit("forged")).otherwise(F.col("text"))), ["text"])
    assert audit.verify(forged, high).count() == 0  # one level alone does not see it
    assert [tuple(r) for r in audit.verify(forged, high, heads).collect()] == [("A", 512, "rewritten_block")]


def test_roots_roll_up_over_several_levels(spark):
    heads = spark.createDataFrame([("A", i, f"h{i}") for i in range(11)] + [("B", 0, "x")], "file_id string, block bigint, head string")
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    level = [f"h{i}" for i in range(11)]
    while True:
        level = [sha("|".join(level[i:i + 3])) for i in range(0, len(level), 3)]
        if len(level) == 1:
            break
    got = {r.file_id: r.root for r in audit.file_roots(heads, fan_in=3).collect()}
    assert got["A"] == level[0] and got["B"] == sha(sha(sha("x")))


def test_asof_over_many_blocks(spark):
    rng = random.Random(11)
    left = [("k" if rng.random() < 0.8 else "j", rng.randrange(10000)) for _ in range(300)]
    right = [("k" if rng.random() < 0.8 else "j", rng.randrange(10000)) for _ in range(60)]
    ldf = spark.createDataFrame([(g, o, i) for i, (g, o) in enumerate(left)], "g string, o bigint, id bigint")
    rdf = spark.createDataFrame([(g, o, o) for g, o in right], "g string, o bigint, v bigint")
    got = {r.id: r.v for r in audit.asof_last(ldf, rdf, ["g"], "o", ["v"], block=64).collect()}
    for i, (g, o) in enumerate(left):
        assert got[i] == max((x for h, x in right if h == g and x < o), default=None)


def test_first_decision_wins(spark):
    items = spark.createDataFrame([(1, "credit_review", 0.5, 10), (2, "credit_review", None, 5), (3, "fraud_investigation", None, 7), (4, "credit_review", 0.9, 90)],
                                  "item_id bigint, queue string, closeness double, created_seq bigint")
    tries = spark.createDataFrame([(1, 1, "maybe", "ACCEPT_AS_ADVISED", "r"), (1, 2, "accept", "NOPE", "r"), (1, 3, "accept", "ACCEPT_AS_ADVISED", " "), (1, 4, "reject", "ACCEPT_AS_ADVISED", "r"),
                                   (1, 5, "accept", "ACCEPT_AS_ADVISED", "s"), (9, 6, "accept", "ACCEPT_AS_ADVISED", "s")],
                                  "item_id bigint, attempt_seq bigint, verdict string, reason_code string, reviewer_id string")
    now = {r.item_id: r for r in queue.current(items, tries).collect()}
    assert (now[1].status, now[1].verdict, now[2].status) == ("decided", "reject", "open")
    refused = {r.attempt_seq: r.problem for r in queue.refused(items, tries).collect()}
    assert refused == {1: "invalid_verdict", 2: "unknown_reason_code", 3: "blank_reviewer", 5: "already_decided", 6: "unknown_item"}
    order = {r.item_id: r.position for r in queue.review_order(items).collect()}
    assert (order[4], order[1], order[2], order[3]) == (1, 2, 3, 1)


def test_trails_are_checked_attempt_by_attempt(spark):
    from creditloom.operators import audit

    lawful = [("MODEL_CALL", 1, None), ("POLICY_OUTCOME", 2, "q"), ("QUEUED", 3, "q"), ("MODEL_FAILURE", 5, None), ("POLICY_OUTCOME", 6, "r"), ("QUEUED", 7, "r")]
    cases = {
        "lawful": (lawful, 2, set()), "once too often": (lawful, 1, {(0, "gateway_results"), (0, "policy_outcomes")}),
        "late queue": ([*lawful[:2], *lawful[3:], ("QUEUED", 8, "q")], 2, {(1, "queued_after_next_outcome"), (1, "wrong_queue"), (2, "wrong_queue")}),
        "early outcome": ([("MODEL_CALL", 3, None), ("POLICY_OUTCOME", 2, None)], 1, {(1, "outcome_before_result")}),
        "no outcome between calls": ([("MODEL_CALL", 1, None), ("MODEL_CALL", 2, None), ("POLICY_OUTCOME", 3, None), ("POLICY_OUTCOME", 4, None)], 2, {(1, "next_call_before_outcome")}),
        "price": ([("PII_BLOCK", 1, None), ("PRICING", 2, None), ("POLICY_OUTCOME", 3, "proceed")], 1, {(1, "pricing_before_outcome")}),
        "nothing": ([], 1, {(0, "gateway_results"), (0, "policy_outcomes")}), "lost queue": (lawful[:2], 1, {(0, "queued_events")}),
    }
    rows = [(name, "appraisal", t, seq, None if q == "proceed" else q, audit.PROCEED if q == "proceed" else None) for name, (events, *_) in cases.items() for t, seq, q in events]
    events = spark.createDataFrame([*rows, ("other", "appraisal", "QUEUED", 1, "q", None)], "file_id string, stage string, event_type string, seq bigint, queue string, policy_outcome string")
    required = spark.createDataFrame([(name, "appraisal", n) for name, (_, n, _) in cases.items()], "file_id string, stage string, needed int")
    got = {}
    found = audit.trail_problems(events, required)
    for r in found.collect():
        got.setdefault(r.file_id, set()).add((r.attempt, r.problem))
    assert got == {name: want for name, (*_, want) in cases.items() if want}
    assert audit.completeness(found, required).first().complete_share == 1 / len(cases)


def test_the_plan_of_the_trail_check_stays_small(spark):
    events = spark.createDataFrame([("A", "appraisal", "MODEL_CALL", 1, None, None), ("A", "appraisal", "POLICY_OUTCOME", 2, None, None)],
                                   "file_id string, stage string, event_type string, seq bigint, queue string, policy_outcome string")
    found = audit.trail_problems(events, spark.createDataFrame([("A", "appraisal", 1)], "file_id string, stage string, needed int"))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert found.count() == 0 and plan.count("Join ") <= 6
