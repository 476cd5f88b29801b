"""Removal of repeated sentence spans.

A text is cut into sentences: characters up to and with a run of ``.``, ``!``, ``?`` or line feeds and the blanks after it. Every
run of ``SPANS`` sentences with enough words is hashed to 128 bits, runs are joined globally, and a sentence goes if any
run that covers it is repeated and not the first: the first is in the document with the smallest id, and there the one
that starts first. Runs of three sentences find most passages; runs of two or one need more words, so that passages
made of long sentences are found and short phrases that many texts share by chance are not.

Hashes are counted per document before the shuffle and partly summed in it, so that a span that is in a third of all
documents meets no single task; adaptive execution splits the join back.

Defined results: a null or empty text has no sentences and stays as it is; rows that share an id are one document, whose first
runs stay in each; a null id counts as larger than all others; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from creditloom.llm.common import read, sized, small_batches, staged

#: Sentences in a run and the words that it needs.
SPANS = ((3, 8), (2, 30), (1, 50))
_SENTENCE = re.compile(r"[^.!?\n]*[.!?\n]+[ \t\r]*|[^.!?\n]+")
LARGEST = (1 << 63) - 1


def sentences(text: str | None) -> list[str]:
    """Pieces of the text, in order; joined they are the text."""
    return _SENTENCE.findall(text) if text else []


def spans(pieces: list[str]) -> list[tuple[bytes, int, int]]:
    """(hash, first sentence, last sentence + 1) of every run that counts."""
    bare = [p.strip(" \t\r\n").encode("utf-8", "surrogatepass") for p in pieces]
    words = [len(b.split()) for b in bare]
    out = []
    for k, least in SPANS:
        for i in range(len(bare) - k + 1):
            if sum(words[i:i + k]) >= least:
                out.append((xxhash.xxh3_128_digest(b"\n".join(bare[i:i + k])), i, i + k))
    return out


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, found = [], []
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            own = {h for h, _, _ in spans(sentences(text.as_py()))}
            ids.append(np.full(len(own), doc, dtype=np.int64))
            found.extend(own)
        both = np.frombuffer(b"".join(found), dtype="<i8").reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1]), pa.array(np.concatenate(ids) if ids else np.empty(0, dtype=np.int64))], names=["h1", "h2", "id"])


def cut(text: str | None, later: set[bytes]) -> tuple[str | None, int, int, int]:
    """The text without repeated sentences, its sentences, those removed, and runs of them. ``later``: spans whose first is elsewhere."""
    pieces = sentences(text)
    gone, seen = bytearray(len(pieces)), set()
    for h, first, stop in sorted(spans(pieces), key=lambda s: s[1]):
        if h in later or h in seen:
            gone[first:stop] = b"\x01" * (stop - first)
        seen.add(h)
    if not any(gone):
        return text, len(pieces), 0, 0
    starts = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
    return "".join(p for p, g in zip(pieces, gone) if not g), len(pieces), sum(gone), starts


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text, later in zip(batch.column("text").to_pylist(), batch.column("later").to_pylist()):
            marks = {np.array([x["h1"], x["h2"]], dtype="<i8").tobytes() for x in later or ()}
            rows.append(cut(text, marks))
        kept, n, removed, runs = zip(*rows) if rows else ((), (), (), ())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(kept, pa.string())],
                                         names=["doc_id", "n_sentences", "n_removed", "n_spans", "kept_text"])


def remove_repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, n_sentences, n_removed, n_spans (runs of removed sentences), kept_text."""
    small_batches(docs.sparkSession)
    base = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    base = base.withColumn("id", F.coalesce("doc_id", F.lit(LARGEST)))
    found = base.select("id", "text").mapInArrow(_hashes, "h1 long, h2 long, id long")
    often = staged(found.groupBy("h1", "h2").agg(F.min("id").alias("first"), F.max("id").alias("last")).filter("first < last")
                   .select(F.struct("h1", "h2").alias("h"), "first"), "often")
    # as many rows as the corpus has repeated spans: never broadcast; adaptive execution splits the partition of a hot span
    later = found.select(F.struct("h1", "h2").alias("h"), "id").join(often, "h").filter("id <> first")
    by_doc = staged(later.groupBy("id").agg(F.collect_list("h").alias("later")), "later")
    n = by_doc.count()
    ids = by_doc.select("id")
    alone = base.join(sized(ids, n), "id", "left_anti").withColumn("later", F.lit(None).cast("array<struct<h1:long,h2:long>>"))
    marked = base.join(sized(ids, n), "id", "left_semi").join(by_doc, "id")
    columns = ["doc_id", "text", "later"]
    schema = "doc_id long, n_sentences long, n_removed long, n_spans long, kept_text string"
    return alone.select(columns).mapInArrow(_cut, schema).union(marked.select(columns).mapInArrow(_cut, schema))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeated_spans(read(spark, sf_dir, "documents"))


SQL = r"""
WITH p AS (SELECT doc_id, text, regexp_extract_all(coalesce(text, ''), '[^.!?\n]*[.!?\n]+[ \t\r]*|[^.!?\n]+') AS pieces FROM documents),
s AS (
    SELECT doc_id, i, trim(pieces[i], ' ' || chr(9) || chr(13) || chr(10)) AS bare, pieces[i] AS piece
    FROM (SELECT doc_id, pieces, unnest(range(1, len(pieces) + 1)) AS i FROM p)),
w AS (SELECT *, len(regexp_extract_all(bare, '[^\x20\x09-\x0D]+')) AS n FROM s),
r AS (
    SELECT doc_id, i, 3 AS k, bare || chr(10) || lead(bare) OVER d || chr(10) || lead(bare, 2) OVER d AS run, n + lead(n) OVER d + lead(n, 2) OVER d AS words FROM w WINDOW d AS (PARTITION BY doc_id ORDER BY i)
    UNION ALL
    SELECT doc_id, i, 2, bare || chr(10) || lead(bare) OVER d, n + lead(n) OVER d FROM w WINDOW d AS (PARTITION BY doc_id ORDER BY i)
    UNION ALL
    SELECT doc_id, i, 1, bare, n FROM w),
c AS (
    SELECT doc_id, i, k, row_number() OVER (PARTITION BY k, run ORDER BY doc_id, i) AS nth
    FROM r WHERE run IS NOT NULL AND words >= CASE k WHEN 3 THEN 8 WHEN 2 THEN 30 ELSE 50 END),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + k)) AS i FROM c WHERE nth > 1),
starts AS (SELECT g.doc_id, count(*) AS n_spans FROM gone g ANTI JOIN (SELECT doc_id, i + 1 AS i FROM gone) b ON g.doc_id = b.doc_id AND g.i = b.i GROUP BY g.doc_id),
kept AS (
    SELECT s.doc_id, count(g.i) AS n_removed, coalesce(string_agg(CASE WHEN g.i IS NULL THEN s.piece END, '' ORDER BY s.i), '') AS kept_text
    FROM s LEFT JOIN gone g ON g.doc_id = s.doc_id AND g.i = s.i GROUP BY s.doc_id)
SELECT p.doc_id, len(p.pieces)::BIGINT AS n_sentences, coalesce(kept.n_removed, 0)::BIGINT AS n_removed, coalesce(starts.n_spans, 0)::BIGINT AS n_spans,
       coalesce(kept.kept_text, p.text) AS kept_text
FROM p LEFT JOIN kept USING (doc_id) LEFT JOIN starts USING (doc_id)
"""
