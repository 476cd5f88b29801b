"""Registry checks and a sample of queries against their SQL on the smallest tables."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as entry
from creditloom.sources.tables import TABLES
from tools.check_oracle import norm

SAMPLE = ["book_scan", "fin_apr", "band_all", "rule_a_address_proof", "rule_e_memo_grid", "rule_f_ews", "label_sanctionable", "pol_composite", "route_book", "audit_verify",
          "join_asof_model_result", "ev_operations", "pii_detector_union", "pii_leak_scan", "redact_tokens", "mon_outage_episodes", "mon_parity_window"]


def test_registry_is_complete():
    assert len(entry.queries()) >= 160
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark):
    rows = entry.entry(spark).collect()
    assert sum(r.files for r in rows) == 1500 and len({r.outcome for r in rows}) == 5


@pytest.mark.parametrize("name", SAMPLE)
def test_sample_matches_sql(spark, small, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    df = entry.queries()[name](spark, small)
    cols = sorted(df.columns)
    got = sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=str)
    rel = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == cols
    want = sorted((tuple(norm(r[names.index(c)]) for c in cols) for r in rel.fetchall()), key=str)
    assert got == want
