from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as entry
from creditloom.llm import catalog
from creditloom.sources.tables import TABLES
from tools.check_oracle import norm


def test_every_operator_and_the_pipeline_are_registered():
    names = set(entry.queries())
    assert "pipeline" in names
    assert {n.split("_")[0] for n in names if n.startswith("op")} == {f"op{i}" for i in range(1, 11)}
    assert set(catalog.SQL) <= names


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_matches_its_sql(spark, small, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    df = catalog.QUERIES[name](spark, small)
    cols = sorted(df.columns)
    got = sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=str)
    rel = con.execute(catalog.SQL[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == cols
    assert sorted((tuple(norm(r[names.index(c)]) for c in cols) for r in rel.fetchall()), key=str) == got
