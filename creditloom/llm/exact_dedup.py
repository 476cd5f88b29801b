"""Exact deduplication with counting quotient filters.

Each partition builds a counting quotient filter over the 64-bit fingerprints of its texts: the leading bits of a
fingerprint (the quotient) name a bucket, the other bits (the remainder) are kept sorted in the bucket's run with a
count. Runs of one bucket merge losslessly by merging their sorted remainders and adding counts. Only texts whose
merged count is above one go on to verification, which groups them by their whole bytes.

Defined results: a null text counts as empty; empty texts are equal to one another; rows that repeat an id and its text
count once each in ``group_size`` and get the same answer; a null id never stays while another id has the same text; an
empty table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from creditloom.llm.common import lookup, read, sized, staged, text_or_empty

#: Rows that one bucket of the merged filter holds on average.
BUCKET_ROWS = 50_000
RUNS = "bucket int, remainders binary, counts binary"


def _quotient_bits(rows: int) -> int:
    return max(0, int(np.ceil(np.log2(max(1, rows) / BUCKET_ROWS))))


def _merge(remainders: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sort remainders and add up the counts of equal ones."""
    order = np.argsort(remainders, kind="stable")
    remainders, counts = remainders[order], counts[order]
    first = np.flatnonzero(np.concatenate(([True], remainders[1:] != remainders[:-1]))) if len(remainders) else np.array([], dtype=np.int64)
    return remainders[first], (np.add.reduceat(counts, first) if len(first) else counts)


def build_filters(bits: int):
    """A function for mapInArrow: a partition's fingerprints to the runs of its counting quotient filter."""
    low = np.uint64((1 << (64 - bits)) - 1)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.array([], dtype=np.uint64), np.array([], dtype=np.int64)
        for batch in batches:
            new = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            held = _merge(np.concatenate((held[0], new)), np.concatenate((held[1], np.ones(len(new), dtype=np.int64))))
        fps, counts = held
        buckets = (fps >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(fps), dtype=np.int64)
        edges = np.flatnonzero(np.concatenate(([True], buckets[1:] != buckets[:-1]))) if len(fps) else np.array([], dtype=np.int64)
        for lo, hi in zip(edges, [*edges[1:], len(fps)]):
            yield pa.RecordBatch.from_pydict({
                "bucket": pa.array([int(buckets[lo])], pa.int32()),
                "remainders": pa.array([(fps[lo:hi] & low).tobytes()], pa.binary()),
                "counts": pa.array([counts[lo:hi].tobytes()], pa.binary())})

    return build


def merge_filters(bits: int):
    """A function for applyInPandas: all runs of one bucket to the fingerprints that occur more than once."""

    def merge(runs: pd.DataFrame) -> pd.DataFrame:
        remainders = np.concatenate([np.frombuffer(x, dtype=np.uint64) for x in runs["remainders"]])
        counts = np.concatenate([np.frombuffer(x, dtype=np.int64) for x in runs["counts"]])
        remainders, counts = _merge(remainders, counts)
        often = counts > 1
        quotient = np.uint64(int(runs["bucket"].iloc[0])) << np.uint64(64 - bits) if bits else np.uint64(0)
        return pd.DataFrame({"fp": (remainders[often] | quotient).view(np.int64), "n": counts[often]})

    return merge


def repeated_fingerprints(fingerprints: DataFrame, rows: int) -> DataFrame:
    """(fp long, n long) of the fingerprints in column ``fp`` that occur more than once among ``rows`` rows."""
    bits = _quotient_bits(rows)
    runs = fingerprints.select("fp").mapInArrow(build_filters(bits), RUNS)
    return runs.groupBy("bucket").applyInPandas(merge_filters(bits), "fp long, n long")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, keep_id (largest id with the same text), group_size, kept, text_sha256, n_bytes."""
    base = docs.select(F.col(f"`{id_col}`").alias("doc_id"), text_or_empty(text_col).alias("text"))
    digest = staged(base.select("doc_id", F.xxhash64("text").alias("fp"), F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"),
                                F.octet_length("text").cast("long").alias("n_bytes")), "digest")
    repeated = staged(repeated_fingerprints(digest, digest.count()), "repeated")
    n = repeated.count()
    candidates = base.withColumn("fp", F.xxhash64("text")).join(sized(repeated.select("fp"), n), "fp", "left_semi")
    # grouping by the text itself compares whole bytes; partial aggregation folds hot groups before they are shuffled
    groups = (candidates.groupBy("text").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
              .filter("group_size > 1").select(F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"), "keep_id", "group_size"))
    groups = staged(groups, "groups")
    out = lookup(digest, groups, groups.count(), "text_sha256")
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return out.select("doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
                      keep.eqNullSafe(F.col("doc_id")).alias("kept"), "text_sha256", "n_bytes")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(read(spark, sf_dir, "documents"))


SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept,
       sha256(coalesce(text, '')) AS text_sha256, strlen(coalesce(text, ''))::BIGINT AS n_bytes
FROM documents
WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
