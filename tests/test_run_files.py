"""A run is one row per file: its results equal the long form's, and its readers join and shuffle no files."""

from creditloom import reference as R
from creditloom.plans import base, evaluate_plans, policy_plans

FOLDER = "/root/testdata/sf0.001"


def test_results_in_the_row_equal_the_grouped_answer_sheet(spark):
    cols = ["file_id", "a_n", "a_fail", "a_uncertain", "a_items", "a_lowest", "b_n", "b_signal", "b_uncertain", "b_flags", "b_lowest", "composite", "c_top",
            "c_uncertain", "c_outcome", "d_closeness", "d_top", "d_low", "e_fail", "e_uncertain", "e_flags", "e_lowest", "f_warnings", "f_flags", "f_low", "f_tier",
            "blocked", *[f"{s}_failure" for s in R.STAGES]]
    wide = policy_plans.run_files(spark, FOLDER).select(*cols)
    long = policy_plans.modules(spark, FOLDER).select(*cols)
    got, want = sorted(map(tuple, wide.collect())), sorted(map(tuple, long.collect()))
    assert len(got) == 1500 and got == want


def test_readers_of_a_run_join_and_shuffle_no_files(spark):
    policy_plans.run_files(spark, FOLDER)
    for query in (evaluate_plans.join_book_dedupe_truth, evaluate_plans.join_decisions_labels, evaluate_plans.ev_module_prediction,
                  policy_plans.pol_failure_route):
        plan = query(spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
        assert "Join" not in plan and "Exchange" not in plan, query.__name__


def test_a_file_of_an_unknown_nation_stays_in_the_run(spark, tmp_path):
    from creditloom.sources import book

    rows = spark.createDataFrame([(1, 2, 99, "5-LOW")], "k long, ck long, c_nationkey int, priority string")
    assert [r.region for r in book.with_attributes(rows, spark, FOLDER).collect()] == [None]
