"""Sources and sinks, and streams against their batch form."""

from __future__ import annotations

import tempfile

import pytest
from pyspark.sql import functions as F

from creditloom.plans import base
from creditloom.sources import io
from creditloom.sources.book import repayment
from creditloom.sources.tables import table
from creditloom.streaming import monitors as M


def fresh():
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def test_book_round_trip_and_contracts(spark, small):
    files = base.files(spark, small)
    path = fresh() + "/book"
    io.write_book(io.nested_loan_files(files), path, "json")
    back = io.read_book(spark, path)
    assert back.count() == files.count()
    assert back.filter("segment <> 'secured_home' AND property IS NOT NULL").count() == 0
    with pytest.raises(Exception, match="(?i)exist"):
        io.write_book(io.nested_loan_files(files), path, "json")
    assert {r[0] for r in files.select(io.split_of(F.col("file_id"))).distinct().collect()} == {"dev", "holdout"}
    with pytest.raises(ValueError):
        io.first_files(files, -1)
    a, b = io.book_digest(files, ["file_id", "score"]).first(), io.book_digest(files.withColumn("score", F.col("score") + 1), ["file_id", "score"]).first()
    assert a.digest != b.digest and a["rows"] == b["rows"]


def test_malformed_decisions_stop_or_are_quarantined(spark):
    path = fresh() + "/d.jsonl"
    with open(path, "w") as f:
        f.write('{"run_id":"r","file_id":"F1","stage":"appraisal"}\n{broken\n\n{"run_id":"r","file_id":"F2","stage":"appraisal"}\n')
    with pytest.raises(Exception):
        io.read_decisions(spark, path).collect()
    good, bad = io.read_decisions_quarantine(spark, path)
    assert sorted(r.file_id for r in good.collect()) == ["F1", "F2"]
    assert [r._corrupt_record for r in bad.collect()] == ["{broken"]


@pytest.fixture(scope="module")
def event_folder(spark, small):
    path = fresh() + "/events"
    table(spark, small, "events").orderBy("ts").coalesce(1).write.option("maxRecordsPerFile", 250).parquet(path)
    return path


def run(spark, df, name, mode="append"):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", fresh()).trigger(availableNow=True).start()
    q.awaitTermination(240)
    assert q.exception() is None
    return spark.table(name)


def stream(spark, small, folder):
    return M.calls(M.event_stream(spark, folder, table(spark, small, "events").schema))


def test_closed_windows_equal_batch(spark, small, event_folder):
    got = {(r.w.start, r.bin): (r.n, round(r.sum_p, 6)) for r in run(spark, M.calibration_bins(stream(spark, small, event_folder)), "bins").collect()}
    want = {(r.w.start, r.bin): (r.n, round(r.sum_p, 6)) for r in M.calibration_bins(M.calls(table(spark, small, "events"))).collect()}
    assert got and all(want[k] == v for k, v in got.items())
    assert len({k[0] for k in want}) - len({k[0] for k in got}) == 1  # only the window still open is missing


def test_monitors_run_as_streams_and_equal_the_table(spark, small, event_folder):
    timed = M.calls(table(spark, small, "events"))
    key = lambda rows, digits: {tuple(round(v, digits) if isinstance(v, float) else v for v in r) for r in rows}
    for name, monitor in (("cal", M.calibration_windows), ("alert", lambda t: M.alerts(M.calibration_windows(t), 0.0)), ("parity", M.parity_windows)):
        got, want = run(spark, monitor(stream(spark, small, event_folder)), name).collect(), monitor(timed).collect()
        still_open = max(r.window_start for r in got)
        assert key(got, 6) == key((r for r in want if r.window_start <= still_open), 6)
        assert len({r.window_start for r in want}) - len({r.window_start for r in got}) in range(1, 9)


def test_duplicates_count_once(spark, small, event_folder):
    s = stream(spark, small, event_folder)
    out = run(spark, M.daily_counts(M.deduplicated(s.unionByName(stream(spark, small, event_folder)))), "dedupe")
    batch = {r.window_start: r.calls for r in M.daily_counts(M.calls(table(spark, small, "events"))).collect()}
    got = {r.window_start: r.calls for r in out.collect()}
    assert got and all(batch[k] == v for k, v in got.items())


def test_outages_across_micro_batches(spark, small, event_folder):
    batch = {tuple(r) for r in M.outage_episodes(M.calls(table(spark, small, "events")), 2).collect()}
    got = {tuple(r) for r in run(spark, M.outage_stream(stream(spark, small, event_folder), 2), "outages").collect()}
    # a run still open at the end of the stream has not been emitted yet
    assert got and got <= batch


def test_watchlist_tiers_follow_months(spark, small):
    path = fresh() + "/months"
    repayment(spark, small).filter("k < 400").orderBy("m").coalesce(1).write.option("maxRecordsPerFile", 400).parquet(path)
    src = M.event_stream(spark, path, repayment(spark, small).schema)
    last = {}
    for r in run(spark, M.watchlist_stream(src), "tiers", "update").collect():
        last.setdefault(r.k, []).append(r.warnings)
    from creditloom.plans.catalog import QUERIES

    want = {r.k: r.warnings for r in QUERIES["mon_watchlist_stream"](spark, small).collect()}
    assert last and all(want[k] in v for k, v in last.items())
