from __future__ import annotations

import re

import corpus_pipeline
from creditloom.llm.common import staged
from tests.llm.cases import awkward, frame, prose
from tests.llm.test_exact_and_near import components
from tests.llm.test_filters import brute_hits
from tests.llm.test_packing import check
from tests.llm.test_spans import brute_lines


def stages():
    return dict(corpus_pipeline.STAGES)


def by_id(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_each_stage_against_brute_force(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    columns, before = docs.columns, by_id(docs)
    docs = staged(stages()["language"](spark, docs, small), "a")
    after = by_id(docs)
    assert docs.columns == columns and after == {i: t for i, t in before.items() if t and re.search(r"[^\W\d_]", t)}
    docs, before = staged(stages()["line_dedup"](spark, docs, small), "b"), after
    after = by_id(docs)
    assert docs.columns == columns and after == {i: t for i, _, _, t in brute_lines(before.items(), 10, 0.5)}
    docs, before = staged(stages()["near_dedup"](spark, docs, small), "c"), after
    after, found = by_id(docs), components(before.items(), 5)
    assert docs.columns == columns and set(after) == {i for i, (_, c) in found.items() if c == i}
    docs, before = staged(stages()["decontamination"](spark, docs, small), "d"), after
    after, hits = by_id(docs), {i: (n, h) for i, n, h, _ in brute_hits(before.items(), items)}
    assert docs.columns == columns and set(after) == {i for i, (n, h) in hits.items() if h <= 0.5 * n}
    assert {i for i in after if after[i] != before[i]} == {i for i in after if hits[i][1]}
    assert not any(h for _, _, h, _ in brute_hits(after.items(), items))
    assert check(stages()["packing"](spark, docs, small).collect(), after.items()) > 0.9


def test_one_row_of_each_group_of_near_duplicates_stays(spark):
    """Rows without an id, repeated rows and different texts that share an id are judged row by row."""
    a, b, c, d = (" ".join(f"{k}{i}" for i in range(80)) for k in "abcd")
    rows = [(9, a), (5, f"{a} end"), (None, a), (None, f"{a} end"), (5, b), (3, c), (3, c), (7, f"{c} end"), (7, d), (None, "of its own kind"), (None, None)]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, source string")
    got = stages()["near_dedup"](spark, docs, "")
    assert got.columns == docs.columns
    want = [(5, f"{a} end"), (5, b), (3, c), (7, d), (None, "of its own kind"), (None, None)]
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted(want, key=str)


def test_run_on_awkward_rows(spark, tmp_path):
    rows = awkward() + [(1000 + i, f"{prose(i + 50, 80)} alpha beta gamma delta epsilon zeta eta theta iota kappa", "en", None, None, None, None, None) for i in range(12)]
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta eta theta iota kappa")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    kept = {r.doc_id for r in got}
    assert {1000 + i for i in range(12)} <= kept and not kept & {0, 1, 2, 3, 17}
    assert len({8, 9} & kept) == 1


def test_run_on_empty_table(spark, tmp_path):
    frame(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
