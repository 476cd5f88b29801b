"""Rows on which queries differed from their SQL or did quadratic work, by the findings of round 3."""

from __future__ import annotations

import random
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from creditloom.llm import line_dedup, suffix_dedup
from creditloom.operators import gate


def both(spark, folder, name, tables):
    """Sorted rows of a query and of its SQL over small tables of (rows, schema)."""
    con = duckdb.connect()
    for table, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{table}.parquet")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet/*.parquet')")
    got = sorted((tuple(r) for r in entry.queries()[name](spark, str(folder)).collect()), key=repr)
    return got, sorted(con.execute(entry.oracle_sql()[name]).fetchall(), key=repr)


DOCS, ITEMS = "doc_id bigint, text string", "item_id bigint, text string"
SEEN = [(1, "see one two three four, Rose Lane"), (2, "zero\u200bwidth call nine eight seven six; one two three four"), (3, "STRASSE rose lane"), (4, "Stra\u00dfe rose lane \u212aM \u0130s"),
        (5, "sent twice rose lane"), (6, "sent twice rose lane\u00a0"), (7, "rose lane"), (8, "rose lane\u3000"), (9, "a rose lane"), (9, "own words"), (10, None), (11, "")]
KNOWN = [(1, "one two three four"), (2, "Rose Lane"), (3, "stra\u00dfe"), (4, "km is"), (2, "rose lane"), (2, "Rose Lane"), (5, " - ")]


@pytest.mark.parametrize("docs, items", [(SEEN, KNOWN), (SEEN, [*KNOWN, (6, None)]), ([*SEEN, (12, None)], KNOWN), (SEEN, [])])
def test_outbound_inventory_agrees_with_its_sql(spark, tmp_path, docs, items):
    got, expected = both(spark, tmp_path, "pii_outbound_inventory", {"documents": (docs, DOCS), "benchmark": (items, ITEMS)})
    assert got == expected


@pytest.mark.parametrize("small", [1000, 1])
def test_copies_of_a_passage_are_compared_once(spark, monkeypatch, small):
    """What is compared must not grow with the number of copies; what is found must be what a search of all windows finds."""
    monkeypatch.setattr(suffix_dedup, "SMALL", small)
    rnd = random.Random(4)
    word = lambda n: "".join(rnd.choice("abcdefghij ") for _ in range(n))
    passage, tails, own = word(700), [word(90) for _ in range(6)], word(300)
    seen = []
    for copies in (3, 12):
        texts = [passage + t for t in tails for _ in range(copies)] + [passage[:430], "x" + passage[150:520] + "y", own + passage[200:405]]
        sizes, plain = {}, suffix_dedup.staged
        monkeypatch.setattr(suffix_dedup, "staged", lambda df, name, sizes=sizes, plain=plain: sizes.setdefault(name, plain(df, name)))
        got = {r.doc_id: (r.n_removed, bytes(r.kept)) for r in suffix_dedup.remove_repeats(spark.createDataFrame(list(enumerate(texts)), DOCS)).collect()}
        count = Counter(t[i:i + 200] for t in texts for i in range(len(t) - 199))
        for i, t in enumerate(texts):
            hit = {p for a in range(len(t) - 199) if count[t[a:a + 200]] > 1 for p in range(a, a + 200)}
            assert got[i] == (len(hit), "".join(x for p, x in enumerate(t) if p not in hit).encode())
        seen.append((sizes["third"].count(), sizes["windows"].count()))
        monkeypatch.setattr(suffix_dedup, "staged", plain)
    assert seen[0] == seen[1]


def test_templates_are_those_of_the_sql(spark):
    rnd = random.Random(5)
    lines = ["".join(rnd.choice("ab:/@1 \t\x0b\u00a0") for _ in range(rnd.randint(0, 14))) for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(lines)), "i long, line string")
    plain = F.regexp_replace(F.trim(F.regexp_replace("line", line_dedup.BLANKS, " ")), line_dedup.FIELD, "<*>")
    assert df.select(line_dedup.template(F.col("line")).alias("a"), plain.alias("b")).filter("a <> b").collect() == []


def test_rows_of_one_row_group_are_scanned_in_many_tasks(spark, tmp_path):
    spark.range(3000).selectExpr("id AS doc_id", "concat('PAN ABCPE', lpad(id, 4, '0'), 'F') AS text").coalesce(1).write.parquet(f"{tmp_path}/texts")
    found = gate.scanned(spark.read.parquet(f"{tmp_path}/texts")).select("doc_id", F.size("found").alias("n"), F.spark_partition_id().alias("part"))
    rows = found.collect()
    assert len(rows) == 3000 and all(r.n == 1 for r in rows) and len({r.part for r in rows}) >= 8
