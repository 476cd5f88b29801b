"""Importance resampling towards a target: documents are drawn by how much their hashed n-grams look like the target's.

Each batch interns its n-grams in an open-addressed NumPy table: keys are 64-bit xxhash values, an equal key is verified byte by
byte, and a slot stores the n-gram's bucket and its count. The first pass adds the slots' counts up per bucket, for the
corpus and for the target; the second pass gathers, for each occurrence, its slot's gain. Draws add Gumbel noise that depends on
the seed and the id alone, so that taking the highest scores is sampling without replacement by weight.

Defined results: a null, empty or wordless text has no features and weight 0; equal scores go by the smaller id, a null id is
the smallest; rows that repeat an id are drawn each by itself; an empty table draws nothing; an empty target has no counts;
other columns are ignored. A text of any length is worked on in pieces of ``PIECE`` bytes.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from creditloom.llm.common import positions, read, small_batches, staged, text_or_empty
from creditloom.llm.words import folded

BUCKETS, LONGEST, SEED = 10_000, 3, 42
#: Share of the eligible documents that is drawn, in percent, and the words that make a document eligible.
PERCENT, LEAST_WORDS = 5, 20
#: Bytes of text that one table interns.
PIECE = 1 << 20
#: Longer strings are taken one at a time, not in steps over all strings of a length.
MANY_STEPS = 64

_P1, _P2, _P3, _P4, _P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _turn(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint64(by)) | (x >> np.uint64(64 - by))


def _crc_steps() -> np.ndarray:
    """What two further bytes do to a crc32, for each value of the two."""
    one = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        one = (one >> np.uint32(1)) ^ (np.uint32(0xEDB88320) * (one & np.uint32(1)))
    two = np.arange(1 << 16, dtype=np.uint32)
    for _ in range(2):
        two = one[two & np.uint32(255)] ^ (two >> np.uint32(8))
    return two


_CRC = _crc_steps()


class Bytes:
    """A byte string with views that read 1, 2, 4 or 8 bytes at any offset."""

    def __init__(self, raw: bytes) -> None:
        self.raw = raw
        padded = raw + b"\0" * 8
        n = len(raw) + 1
        self.one = np.frombuffer(padded, dtype=np.uint8)
        self.two = np.ndarray((n,), dtype="<u2", buffer=padded, strides=(1,))
        self.four = np.ndarray((n,), dtype="<u4", buffer=padded, strides=(1,))
        self.eight = np.ndarray((n,), dtype="<u8", buffer=padded, strides=(1,))

    def hashes(self, at: np.ndarray, length: int) -> np.ndarray:
        """xxhash64 of the strings of one length at the offsets ``at``."""
        if length >= 32:
            raw = self.raw
            return np.array([xxhash.xxh64_intdigest(raw[i:i + length]) for i in at.tolist()], dtype=np.uint64)
        h = np.full(len(at), _P5 + np.uint64(length), dtype=np.uint64)
        done = 0
        while length - done >= 8:
            h ^= _turn(self.eight[at + done] * _P2, 31) * _P1
            h = _turn(h, 27) * _P1 + _P4
            done += 8
        if length - done >= 4:
            h ^= self.four[at + done].astype(np.uint64) * _P1
            h = _turn(h, 23) * _P2 + _P3
            done += 4
        while done < length:
            h ^= self.one[at + done].astype(np.uint64) * _P5
            h = _turn(h, 11) * _P1
            done += 1
        h ^= h >> np.uint64(33)
        h *= _P2
        h ^= h >> np.uint64(29)
        h *= _P3
        return h ^ (h >> np.uint64(32))

    def crc32s(self, at: np.ndarray, length: int) -> np.ndarray:
        """crc32 of the strings of one length at the offsets ``at``."""
        if length > MANY_STEPS:
            raw = self.raw
            return np.array([zlib.crc32(raw[i:i + length]) for i in at.tolist()], dtype=np.uint32)
        crc, low = np.full(len(at), 0xFFFFFFFF, dtype=np.uint32), np.uint32(0xFFFF)
        for k in range(0, length - 1, 2):
            crc = _CRC[(crc ^ self.two[at + k]) & low] ^ (crc >> np.uint32(16))
        if length % 2:  # a single byte is the step of two whose first is none
            crc = _CRC[((crc ^ self.one[at + (length - 1)]) & np.uint32(0xFF)) << np.uint32(8)] ^ (crc >> np.uint32(8))
        return crc ^ np.uint32(0xFFFFFFFF)

    def equal(self, a: np.ndarray, b: np.ndarray, length: int) -> np.ndarray:
        """Whether the strings of one length at ``a`` and at ``b`` have the same bytes."""
        if length < 8:
            mask = np.uint64((1 << (8 * length)) - 1)
            return (self.eight[a] & mask) == (self.eight[b] & mask)
        if length > MANY_STEPS:
            raw = self.raw
            return np.array([raw[i:i + length] == raw[j:j + length] for i, j in zip(a.tolist(), b.tolist())], dtype=bool)
        same = self.eight[a + (length - 8)] == self.eight[b + (length - 8)]
        for k in range(0, length - 8, 8):
            same &= self.eight[a + k] == self.eight[b + k]
        return same


def _by_length(items: np.ndarray, length: np.ndarray) -> Iterator[tuple[np.ndarray, int]]:
    """The items of each length."""
    order = np.argsort(np.minimum(length, 0xFFFF).astype(np.uint16), kind="stable")  # a radix sort
    if len(order) and length[order[-1]] >= 0xFFFF:
        order = np.argsort(length, kind="stable")
    items, length = items[order], length[order]
    edges = np.flatnonzero(np.diff(length, prepend=-1)).tolist()
    for lo, hi in zip(edges, [*edges[1:], len(items)]):
        yield items[lo:hi], int(length[lo])


class GramTable:
    """Open-addressed table of the n-grams of one piece of text; a slot holds key, place, length, bucket and count."""

    def __init__(self, text: Bytes, at: np.ndarray, length: np.ndarray, buckets: int) -> None:
        size = 1 << max(4, int(2 * len(at)).bit_length())
        self.text, self.buckets = text, buckets
        self.key, self.at, self.length = np.zeros(size, dtype=np.uint64), np.full(size, -1, dtype=np.int64), np.zeros(size, dtype=np.int64)
        #: The slot of each occurrence, in the order given.
        self.slots = np.empty(len(at), dtype=np.int64)
        for which, n in _by_length(np.arange(len(at)), length):
            self.slots[which] = self._intern(at[which], n)
        self.count = np.bincount(self.slots, minlength=size)
        self.bucket = np.zeros(size, dtype=np.int64)
        used = np.flatnonzero(self.at >= 0)
        for slots, n in _by_length(used, self.length[used]):
            self.bucket[slots] = text.crc32s(self.at[slots], n) % buckets

    def _intern(self, at: np.ndarray, length: int) -> np.ndarray:
        keys, last = self.text.hashes(at, length), len(self.at) - 1
        slot, waiting = (keys & np.uint64(last)).astype(np.int64), np.arange(len(at))
        claim = np.empty(len(self.at), dtype=np.int64) if len(at) else None
        while len(waiting):
            s = slot[waiting]
            free = self.at[s] < 0
            if free.any():
                mine, empty = waiting[free], s[free]
                claim[empty] = mine  # of several claims to a slot one stays
                won = claim[empty]
                self.key[empty], self.at[empty], self.length[empty] = keys[won], at[won], length
            same = (self.key[s] == keys[waiting]) & (self.length[s] == length)
            same[same] = self.text.equal(self.at[s[same]], at[waiting[same]], length)
            waiting = waiting[~same]
            slot[waiting] = (slot[waiting] + 1) & last
        return slot

    def totals(self) -> np.ndarray:
        """Occurrences per bucket."""
        used = np.flatnonzero(self.count)
        return np.bincount(self.bucket[used], weights=self.count[used], minlength=self.buckets).astype(np.int64)


def pieces(texts: list[bytes], size: int = PIECE) -> Iterator[list[tuple[int, bytes, int]]]:
    """Groups of (text number, words joined by one blank, leading words that the piece before has counted) of about ``size`` bytes."""
    group, held = [], 0
    for i, raw in enumerate(texts):
        at, carry = 0, []
        while at < len(raw):
            end = at + size
            if end < len(raw):
                end = raw.find(b" ", end)
                end = len(raw) if end < 0 else end
            words = raw[at:end].split()
            if words:
                joined = b" ".join([*carry, *words])
                group.append((i, joined, len(carry)))
                held += len(joined)
                carry = [*carry, *words][-(LONGEST - 1):]
            at = end
            if held >= size:
                yield group
                group, held = [], 0
    if group:
        yield group


def grams(group: list[tuple[int, bytes, int]], buckets: int) -> tuple[GramTable, np.ndarray, np.ndarray]:
    """The table of a group of pieces, the text number of each occurrence, and the text numbers of the words it counts."""
    raw = b" ".join([joined for _, joined, _ in group])
    text = Bytes(raw)
    ends = np.append(np.flatnonzero(text.one[:len(raw)] == 32), len(raw))
    starts = np.append(0, ends[:-1] + 1)
    words = np.array([joined.count(b" ") + 1 for _, joined, _ in group])
    piece = np.repeat(np.arange(len(group)), words)
    nth = np.arange(len(starts)) - np.repeat(np.cumsum(words) - words, words)
    doc, carried = np.array([i for i, _, _ in group])[piece], np.array([c for _, _, c in group])[piece]
    new = nth >= carried
    at, length, owner = [], [], []
    for n in range(LONGEST):  # runs of n + 1 words, by their last word
        last = np.flatnonzero(new & (nth >= n))
        at.append(starts[last - n])
        length.append(ends[last] - starts[last - n])
        owner.append(doc[last])
    return GramTable(text, np.concatenate(at), np.concatenate(length), buckets), np.concatenate(owner), doc[new]


def _texts(batch: pa.RecordBatch, column: int) -> list[bytes]:
    return [folded(t) for t in batch.column(column).cast(pa.binary()).to_pylist()]


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): occurrences of n-grams in the column ``text`` per bucket; at most ``buckets`` rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for group in pieces(_texts(batch, 0)):
                total += grams(group, buckets)[0].totals()
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], names=["bucket", "n"])

    small_batches(texts.sparkSession)
    return texts.select("text").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Gain of each bucket: 1000 times the log ratio of its smoothed shares in target and corpus, rounded down."""
    s, t, n = corpus.astype(np.float64), target.astype(np.float64), len(corpus)
    ratio = (t + 1.0) * (s.sum() + n) / ((s + 1.0) * (t.sum() + n))
    return np.floor(1000.0 * np.log(ratio)).astype(np.int64)


def learned_gains(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Gains from all texts of both tables; only the bucket counts reach the driver, at most ``buckets`` rows a table."""
    both = []
    for table in (docs, target):
        counts = np.zeros(buckets, dtype=np.int64)
        for r in bucket_counts(table.select(text_or_empty().alias("text")), buckets).collect():
            counts[r["bucket"]] = r["n"]
        both.append(counts)
    return gains(*both)


def weighted(docs: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_features, weight of every row."""

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            words, features, weight = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
            for group in pieces(_texts(batch, 1)):
                table, owner, word_owner = grams(group, len(gain))
                words += np.bincount(word_owner, minlength=n)
                features += np.bincount(owner, minlength=n)
                weight += np.bincount(owner, weights=gain[table.bucket][table.slots], minlength=n).astype(np.int64)  # sums stay below 2 ** 53
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words), pa.array(features), pa.array(weight)], names=["doc_id", "n_words", "n_features", "weight"])

    small_batches(docs.sparkSession)
    base = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    return base.mapInArrow(weigh, "doc_id long, n_words long, n_features long, weight long")


def gumbel(doc_id: Column, seed: int = SEED) -> Column:
    """Gumbel noise of an id in thousandths, rounded down; a null id counts as an empty one."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000.0 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def draws(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight, score, rank of every row; rank is null where the row is not drawn."""
    scored = weighted(docs, learned_gains(docs, target)).withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed))
    scored = staged(scored, "scored")
    may = scored.filter(F.col("n_words") >= least_words)
    drawn = percent * may.count() // 100
    ranked = positions(may.withColumn("__down", -F.col("score")), [], ["__down", "doc_id"], "order").withColumn("rank", F.when(F.col("pos") < drawn, F.col("pos") + 1))
    return ranked.drop("__down", "pos", "n").unionByName(scored.filter(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = draws(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


#: Features by their distinct texts; crc32 is folded over the nibbles of the UTF-8 bytes.
SQL = r"""
WITH texts AS (
    SELECT 0 AS part, row_number() OVER () AS r, doc_id, text FROM documents UNION ALL SELECT 1, 0, NULL, text FROM benchmark),
split AS (
    SELECT part, r, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
    FROM texts),
runs AS (
    SELECT part, r, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])
                             || list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS f
    FROM split),
counts AS (SELECT part, r, f, count(*) AS k FROM runs GROUP BY ALL),
distinct_features AS (SELECT f, hex(encode(f)) AS h FROM (SELECT DISTINCT f FROM counts)),
hashed AS (
    SELECT f, xor(4294967295, list_reduce(
               list_prepend(4294967295::BIGINT, flatten(list_transform(range(0, len(h) // 2), lambda i: [strpos('123456789ABCDEF', h[2 * i + 2]), strpos('123456789ABCDEF', h[2 * i + 1])]))),
               lambda a, x: xor(a >> 4, [0, 498536548, 997073096, 651767980, 1994146192, 1802195444, 1303535960, 1342533948, 3988292384, 4027552580, 3604390888,
                                         3412177804, 2607071920, 2262029012, 2685067896, 3183342108][(xor(a, x) & 15) + 1]::BIGINT))) % 10000 AS bucket
    FROM distinct_features),
sizes AS (SELECT bucket, sum(k) FILTER (part = 0) AS s, sum(k) FILTER (part = 1) AS t FROM counts JOIN hashed USING (f) GROUP BY bucket),
totals AS (SELECT coalesce(sum(s), 0)::DOUBLE AS ss, coalesce(sum(t), 0)::DOUBLE AS tt FROM sizes),
gain AS (
    SELECT bucket, floor(1000 * ln((coalesce(t, 0)::DOUBLE + 1) * (ss + 10000) / ((coalesce(s, 0)::DOUBLE + 1) * (tt + 10000))))::BIGINT AS g FROM sizes, totals),
weights AS (
    SELECT r, sum(k)::BIGINT AS n_features, sum(k * g)::BIGINT AS weight FROM counts JOIN hashed USING (f) JOIN gain USING (bucket) WHERE part = 0 GROUP BY r),
scored AS (
    SELECT doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
           coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
    FROM split LEFT JOIN weights USING (r) WHERE part = 0),
ranked AS (
    SELECT *, CASE WHEN n_words >= 20 THEN row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) END AS place,
           5 * (count(*) FILTER (n_words >= 20) OVER ()) // 100 AS drawn
    FROM scored)
SELECT doc_id, n_features::BIGINT AS n_features, weight::BIGINT AS weight, score::BIGINT AS score, CASE WHEN place <= drawn THEN place END AS rank FROM ranked
"""
