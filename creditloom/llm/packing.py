"""Packing by minimum bin slack.

Documents are tokenised and cut at multiples of the window; what is left over is one shorter piece. All short pieces
together are a histogram of at most ``window - 1`` lengths, however many documents there are. On that histogram each step
takes the longest length left and a bitset subset-sum over the counted lengths picks the multiset that fills the window
closest to capacity; its counts are backtracked and the pattern is used as often as the counts allow, so that every
step uses up at least one length. Pieces then find their sequence and offset by their rank among the pieces of their
length, which is computed in parallel chunks.

Defined results: a null text is an empty one; an empty text is the end mark alone; repeated rows are packed once each;
an empty table gives no pieces; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from creditloom.llm.common import BROADCAST_ROWS, read, small_batches, staged, text_or_empty
from creditloom.llm.tokens import loaded

WINDOW, END = 1024, 0
#: Pieces of one length are ranked in chunks of about so many rows of the whole table.
CHUNK_ROWS, LEAST_CHUNKS = 100_000, 16
PIECES = "doc_id long, start long, length long, doc_tokens long, ids binary"


def _cut(tokenizer: str, window: int, end: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = loaded(tokenizer)
        for batch in batches:
            ids, counts = tokens.batch(batch.column(1))
            flat, totals = np.insert(ids, np.cumsum(counts), end).astype("<u4"), counts + 1
            pieces = -(-totals // window)
            row = np.repeat(np.arange(batch.num_rows), pieces)
            start = (np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * window
            total = totals[row]
            first = (np.cumsum(totals) - totals)[row] + start
            offsets = pa.py_buffer(np.append(4 * first, 4 * len(flat)).astype(np.int64))  # pieces lie one after another
            data = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(row), [None, offsets, pa.py_buffer(flat)]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(start), pa.array(np.minimum(window, total - start)), pa.array(total), data],
                                             names=["doc_id", "start", "length", "doc_tokens", "ids"])

    return cut


def token_pieces(docs: DataFrame, tokenizer: str, window: int = WINDOW, end: int = END, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of at most ``window`` ids: doc_id, start, length, doc_tokens, ids (little-endian unsigned 32-bit)."""
    small_batches(docs.sparkSession)
    base = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    return base.mapInArrow(_cut(tokenizer, window, end), PIECES)


def _closest(counts: dict[int, int], room: int) -> dict[int, int]:
    """How often to use each length so that the sum comes as close to ``room`` as it can without passing it."""
    mask, reach, steps = (1 << (room + 1)) - 1, 1, []
    for length in sorted((x for x in counts if x <= room), reverse=True):
        left, size = min(counts[length], room // length), 1
        while left:
            take = min(size, left)
            steps.append((length, take, reach))
            reach |= (reach << (length * take)) & mask
            left, size = left - take, size * 2
        if reach >> room & 1:
            break
    at, used = reach.bit_length() - 1, {}
    for length, take, before in reversed(steps):
        if not before >> at & 1:
            used[length] = used.get(length, 0) + take
            at -= length * take
    return used


def plan(counts: dict[int, int], window: int = WINDOW) -> list[tuple[int, int, int, int, int, int, int]]:
    """Rows (length, first rank, last rank + 1, first sequence, sequences, copies, offset) for a histogram of lengths.

    A row gives the pieces of a length, by rank, to equal sequences: rank ``first + j`` goes to sequence
    ``first sequence + j mod sequences`` at ``offset + (j div sequences) * length``.
    """
    left = {k: v for k, v in counts.items() if v > 0}
    given, rows, sequence = dict.fromkeys(left, 0), [], 0
    while left:
        longest = max(left)
        left[longest] -= 1
        pattern = _closest({k: v for k, v in left.items() if v}, window - longest)
        left[longest] += 1
        pattern[longest] = pattern.get(longest, 0) + 1
        times, offset = min(left[k] // n for k, n in pattern.items()), 0
        for length, copies in sorted(pattern.items(), reverse=True):
            rows.append((length, given[length], given[length] + times * copies, sequence, times, copies, offset))
            given[length] += times * copies
            offset += copies * length
            left[length] -= times * copies
            if not left[length]:
                del left[length]
        sequence += times
    return rows


def pack(pieces: DataFrame, window: int = WINDOW) -> DataFrame:
    """Add sequence_id and offset to a stored table of pieces (doc_id, start, length and any other columns)."""
    spark = pieces.sparkSession
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most ``window`` rows
    chunks = max(LEAST_CHUNKS, sum(counts.values()) // CHUNK_ROWS)
    chunked = pieces.withColumn("__chunk", F.pmod(F.xxhash64("doc_id", "start"), F.lit(chunks)).cast("int"))
    before = Window.partitionBy("length").orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    shift = (chunked.groupBy("length", "__chunk").agg(F.count(F.lit(1)).alias("__n"))
             .select("length", "__chunk", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__shift")))
    in_chunk = Window.partitionBy("length", "__chunk").orderBy("doc_id", "start")
    ranked = chunked.withColumn("__rank", F.row_number().over(in_chunk).cast("long") - 1)
    shift = F.broadcast(shift) if len(counts) * chunks <= BROADCAST_ROWS else shift
    ranked = ranked.join(shift, ["length", "__chunk"]).withColumn("__rank", F.col("__rank") + F.col("__shift")).drop("__chunk", "__shift")
    rows = plan(counts, window)
    # each step of the plan uses up a length: at most ``window`` steps of at most log2(window) lengths on average
    table = spark.createDataFrame(rows, "length long, __lo long, __hi long, __first long, __times long, __copies long, __offset long")
    placed = ranked.join(F.broadcast(table), "length").filter((F.col("__rank") >= F.col("__lo")) & (F.col("__rank") < F.col("__hi")))
    j = F.col("__rank") - F.col("__lo")
    return placed.select(*[F.col(f"`{c}`") for c in pieces.columns], (F.col("__first") + j % F.col("__times")).alias("sequence_id"),
                         (F.col("__offset") + F.floor(j / F.col("__times")) * F.col("length")).cast("long").alias("offset"))


def sequences(packed: DataFrame) -> DataFrame:
    """Whole sequences (sequence_id, ids) from packed pieces that still carry their ids; a group is at most one window."""
    got = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("p"))
    return got.select("sequence_id", F.expr("aggregate(p, cast('' as binary), (a, x) -> concat(a, x.ids))").alias("ids"))


def packed_documents(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Pieces with digest columns: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    pieces = token_pieces(docs, tokenizer).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens")
    return pack(staged(pieces, "pieces"))


def query(spark: SparkSession, sf_dir: str, tokenizer: str = "byte_bpe_50k.json") -> DataFrame:
    import public_tokenizers

    return packed_documents(read(spark, sf_dir, "documents"), public_tokenizers.path(tokenizer))
