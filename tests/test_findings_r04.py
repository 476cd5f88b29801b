"""What was done once too often, in one task or in too many shuffles, by the findings of round 4."""

from __future__ import annotations

import random

from creditloom.operators import audit, policy, probe
from creditloom.plans import base, evaluate_plans, policy_plans

FOLDER = "/root/testdata/sf0.001"


def test_the_probe_deals_files_and_assembles_them_once(spark, monkeypatch):
    assert "Exchange hashpartitioning(k" in evaluate_plans.probed(spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    calls, plain = [], probe.assembled
    monkeypatch.setattr(probe, "assembled", lambda *a: calls.append(a) or plain(*a))
    rows = sorted(tuple(r) for r in evaluate_plans.ev_proxy_probe(spark, FOLDER).collect())
    assert rows == [("copied", 3, "FAIL"), ("noise", 3, "PASS")] and len(calls) == 1


def test_shared_vectors_give_the_probe_of_each_attribute(spark):
    state = evaluate_plans.probed(spark, FOLDER).persist()
    shared = probe.state_vectors(state, ["k", "copied", "noise"])
    own, same = (probe.proxy_probe(state, "copied", folds=2, tolerance=1e-2, **x).first() for x in ({}, {"vectors": shared}))
    assert own.status == same.status and abs(own.auc_macro_ovr - same.auc_macro_ovr) < 1e-3
    state.unpersist()


def test_an_answer_sheet_is_built_once_to_find_what_is_unanswered(spark):
    found = policy_plans.pol_unanswered(spark, FOLDER)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Generate ") == 1
    sheet = base.answer_sheet(spark, FOLDER)
    joined = policy.unanswered(sheet.select("file_id", "qid", "routing"), sheet.filter("answered")).filter("NOT received").select("file_id", "qid", "routing")
    got, want = (sorted(tuple(r) for r in df.collect()) for df in (found, joined))
    assert got and got == want


def test_a_trail_is_checked_by_one_grouping_and_a_long_one_in_runs(spark, monkeypatch):
    rnd = random.Random(7)
    kinds = ["MODEL_CALL", "MODEL_FAILURE", "POLICY_OUTCOME", "POLICY_OUTCOME", "QUEUED", "PRICING", "OTHER"]
    rows = [(f"F{f}" if f else None, stage, rnd.choice(kinds), seq, rnd.choice(["a", "b", None]), rnd.choice([audit.PROCEED, "NO", None]))
            for f in range(30) for stage in ("x", "y") for seq in rnd.sample(range(3000), f)]
    events = spark.createDataFrame(rows, "file_id string, stage string, event_type string, seq bigint, queue string, policy_outcome string")
    wanted = [(f"F{f}" if f else None, stage, rnd.choice([0, 1, 2, None])) for f in range(32) for stage in ("x", "y", "z")]
    required = spark.createDataFrame([*wanted, wanted[20]], "file_id string, stage string, needed int")
    found = audit.trail_problems(events, required)
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    seen = []
    for long in (audit.LONG, 12, 0):
        monkeypatch.setattr(audit, "LONG", long)
        found = audit.trail_problems(events, required)
        share = audit.completeness(found, required).first()
        seen.append((sorted(map(repr, found.collect())), tuple(share)))
    assert len(seen[0][0]) > 100 and seen[0] == seen[1] == seen[2]


def test_complete_files_are_counted_without_a_join(spark):
    problems = spark.createDataFrame([("A", "x"), ("A", "y"), ("C", "x"), (None, "x")], "file_id string, stage string")
    required = spark.createDataFrame([("A", "x"), ("B", "x"), ("B", "y"), (None, "x")], "file_id string, stage string")
    share = audit.completeness(problems, required)
    assert "Join" not in share._jdf.queryExecution().optimizedPlan().toString()
    assert tuple(share.first()) == (3, 2 / 3)
