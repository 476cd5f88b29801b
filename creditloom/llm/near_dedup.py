"""Near-duplicates by one-permutation hashing with optimal densification.

A document's set is its distinct shingles of ``words`` words. One permutation hashes them all; the range is cut into
``BINS`` bins that keep their smallest value, and an empty bin borrows from a bin drawn by a hash of its number and the
attempt. Bands of ``ROWS`` bins are buckets: two sets with a similarity of 0.8 miss each other in all of them with a chance
of about 5e-8. Candidate edges are stars:

1. equal sets fold into the smallest id;
2. each bucket's members are joined to the smallest one; links are confirmed on whole sets and closed to components;
3. in buckets that still hold several components, each member outside the largest one is the centre of a star over
   the bucket's members of other components. Pairs inside a component are never compared, and of the others only those
   leave the task whose signatures agree in nearly as many bins as the similarity asked for.

Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased. Defined results: a text with fewer words than a shingle is one
shingle; without words or text the set is empty and linked with nothing; rows that share an id are one document in links; a
null id is linked but names no component; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from creditloom.llm.common import lookup, read, sized, small_batches, staged
from creditloom.llm.components import components
from creditloom.llm.words import blank_words

BINS, ROWS = 128, 4
#: Signatures of step 3 may agree in this much less than the similarity asked for, five standard deviations of the estimate.
SLACK = 0.18
#: Members, and centres, of a bucket that are compared in one cell.
BLOCK = 1000
#: A document that is the centre of more links than this is repeated, so that no task confirms them all.
CENTRE_LINKS = 500
CACHE_WORDS = 400_000
_M1, _M2, _STEP = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """The published SplitMix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class _WordHashes(dict):
    """Hash of each word, computed when it is first asked for."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > CACHE_WORDS:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word)
        return value


class Shingler:
    """Sets of 64-bit shingle hashes; word hashes are cached up to a bound."""

    def __init__(self, words: int) -> None:
        self.k, self.cache = words, _WordHashes()

    def __call__(self, text: str | None) -> np.ndarray:
        found = blank_words(text)
        if not found:
            return np.empty(0, dtype=np.uint64)
        cache = self.cache
        h = np.array([cache[w] for w in found], dtype=np.uint64)
        k = min(self.k, len(h))
        out = np.full(len(h) - k + 1, k, dtype=np.uint64)
        for i in range(k):
            out = mix(out * _STEP + h[i:len(h) - k + 1 + i])
        return np.unique(out)


def _donors(attempt: int) -> np.ndarray:
    """For each bin, the bin that it tries to borrow from at this attempt."""
    bins = np.arange(BINS, dtype=np.uint64)
    return (mix(mix(bins + np.uint64(1)) + np.uint64(attempt * int(_STEP) & 2**64 - 1)) % np.uint64(BINS)).astype(np.int64)


_TRIES: list[np.ndarray] = []


def signature(shingles: np.ndarray) -> np.ndarray:
    """The smallest hash of each bin of a sorted set that is not empty; empty bins are densified."""
    shift = np.uint64(64 - int(np.log2(BINS)))
    bins, first = np.unique((shingles >> shift).astype(np.int64), return_index=True)
    out, filled = np.zeros(BINS, dtype=np.uint64), np.zeros(BINS, dtype=bool)
    out[bins], filled[bins] = shingles[first], True
    empty, attempt = np.flatnonzero(~filled), 0
    while len(empty):
        if attempt == len(_TRIES):
            _TRIES.append(_donors(attempt))
        donor = _TRIES[attempt][empty]
        lucky = filled[donor]
        out[empty[lucky]] = out[donor[lucky]]
        empty, attempt = empty[~lucky], attempt + 1
    return out


def bands(sig: np.ndarray) -> np.ndarray:
    """One 64-bit key per band; the band's number is part of it."""
    rows = sig.reshape(-1, ROWS)
    out = np.arange(1, len(rows) + 1, dtype=np.uint64)
    for i in range(ROWS):
        out = mix(out * _STEP + rows[:, i])
    return out.view(np.int64)


def _sketch(words: int):
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        for batch in batches:
            sizes, digests, keys, sigs = [], [], [], []
            for text in batch.column(1):
                s = shingler(text.as_py())
                sizes.append(len(s))
                digests.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                sig = signature(s) if len(s) else None
                keys.append(bands(sig) if len(s) else None)
                sigs.append(mix(sig).astype(np.uint8).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(sigs, pa.binary())],
                                             names=["doc_id", "n_shingles", "digest", "bands", "sig"])

    return sketch


def _sets(words: int):
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingler(t.as_py()).tobytes() for t in batch.column(1)], pa.binary())], names=["id", "set"])

    return sets


def _confirm(percent: int):
    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for a, b in zip(batch.column("set_u"), batch.column("set_v")):
                a, b = (np.frombuffer(x.as_py(), dtype=np.uint64) for x in (a, b))
                both = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(100 * both >= percent * (len(a) + len(b) - both))
            yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return confirm


def _confirmed(edges: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The edges (u, v) whose whole sets are similar enough. Centres (v) of many edges are repeated and their edges dealt out."""
    degree = edges.groupBy("v").agg(F.ceil(F.count(F.lit(1)) / CENTRE_LINKS).cast("int").alias("copies"))
    centres = degree.join(sets, F.col("id") == F.col("v")).select("v", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"), F.col("set").alias("set_v"))
    dealt = edges.join(degree, "v").withColumn("copy", F.pmod(F.xxhash64("u"), F.col("copies")).cast("int")).drop("copies")
    pairs = dealt.join(sets.select(F.col("id").alias("u"), F.col("set").alias("set_u")), "u").join(centres, ["v", "copy"])
    return pairs.select("u", "v", "set_u", "set_v").mapInArrow(_confirm(percent), "u long, v long")


def _agreeing(percent: int):
    """Rows of one cell after another: pairs of a centre and a member of other components whose signatures agree enough.

    A row's ``sig`` is its signature of a byte per bin, then the whole keys of the bands before the cell's.
    """
    least = BINS * (percent / 100 - SLACK)

    def pairs(group: dict[str, list]) -> tuple[np.ndarray, np.ndarray]:
        raw = np.frombuffer(b"".join(group["sig"]), dtype=np.uint8).reshape(-1, BINS + 8 * group["band"][0])
        sig, earlier = raw[:, :BINS], np.ascontiguousarray(raw[:, BINS:]).view(np.uint64)
        ids, comps, sizes = (np.array(group[c], dtype=np.int64) for c in ("id", "component", "n_shingles"))
        centre = np.array(group["centre"], dtype=bool)
        members = np.flatnonzero(~centre)
        us, vs = [], []
        for i in np.flatnonzero(centre):
            fits = (comps[members] != comps[i]) & (100 * np.minimum(sizes[members], sizes[i]) >= percent * np.maximum(sizes[members], sizes[i]))
            found = members[fits]
            found = found[(sig[found] == sig[i]).sum(axis=1) >= least]
            # a pair leaves only the first bucket in which it meets; bytes of the signature may agree in bands whose keys differ
            found = found[~(earlier[found] == earlier[i]).any(axis=1)]
            us.append(np.maximum(ids[found], ids[i]))
            vs.append(np.minimum(ids[found], ids[i]))
        return (np.concatenate(us), np.concatenate(vs)) if us else (np.empty(0, dtype=np.int64),) * 2

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, group = None, {c: [] for c in ("band", "id", "component", "n_shingles", "sig", "centre")}
        for batch in batches:
            cells = list(zip(*(batch.column(c).to_pylist() for c in ("key", "block", "part"))))
            columns = {c: batch.column(c).to_pylist() for c in group}
            edges = [i for i in range(len(cells)) if i == 0 or cells[i] != cells[i - 1]]
            for lo, hi in zip(edges, [*edges[1:], len(cells)]):
                if cells[lo] != now:
                    if now is not None:
                        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in pairs(group)], names=["u", "v"])
                    now, group = cells[lo], {c: [] for c in group}
                for c in group:
                    group[c].extend(columns[c][lo:hi])
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in pairs(group)], names=["u", "v"])

    return compare


def _mixed_stars(members: DataFrame, sigs: DataFrame, comps: DataFrame, n_comps: int, percent: int) -> DataFrame:
    """Candidate edges (u, v) of step 3 from the members (key, band, id, n_shingles) of buckets and the signatures (id, sig, bands).

    A bucket is dealt to cells of at most about ``BLOCK`` members and ``BLOCK`` centres; only pairs whose signatures agree leave
    a cell.
    """
    labelled = lookup(members, comps.withColumnRenamed("u", "id"), n_comps, "id").withColumn("component", F.coalesce("component", "id"))
    by_comp = labelled.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n"))
    biggest = F.max_by("component", F.struct("n", "component")).alias("main")
    mixed = staged(by_comp.groupBy("key").agg(biggest, F.max("n").alias("most"), F.sum("n").alias("total"), F.count(F.lit(1)).alias("comps")).filter("comps > 1")
                   .select("key", "main", F.ceil(F.col("total") / BLOCK).cast("int").alias("blocks"), F.ceil((F.col("total") - F.col("most")) / BLOCK).cast("int").alias("parts")), "mixed")
    keys = F.unhex(F.array_join(F.transform("bands", lambda k: F.lpad(F.hex(k), 16, "0")), ""))
    inside = lookup(labelled, mixed, mixed.count(), "key", "inner").join(sigs.select("id", F.concat("sig", keys).alias("sig")), "id")
    inside = inside.withColumn("sig", F.substring("sig", F.lit(1), F.lit(BINS) + 8 * F.col("band")))
    deal = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    columns = ["key", "band", "block", "part", "id", "component", "n_shingles", "sig", "centre"]
    rows = inside.withColumn("block", deal("blocks")).withColumn("part", every("parts")).withColumn("centre", F.lit(False)).select(columns)
    centres = inside.filter("component <> main").withColumn("part", deal("parts")).withColumn("block", every("blocks")).withColumn("centre", F.lit(True)).select(columns)
    cells = rows.union(centres).repartition("key", "block", "part").sortWithinPartitions("key", "block", "part")
    return cells.mapInArrow(_agreeing(percent), "u long, v long")


def _edge(a: str, b: str, size_a: str, size_b: str, percent: int) -> list:
    """Filter on sizes and the columns u > v."""
    fits = 100 * F.least(size_a, size_b) >= percent * F.greatest(size_a, size_b)
    return [fits, F.greatest(a, b).alias("u"), F.least(a, b).alias("v")]


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (smallest id reachable over links), kept.

    A link is ``100 * intersection >= percent * union`` of two sets.
    """
    small_batches(docs.sparkSession)
    base = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    sketches = staged(base.mapInArrow(_sketch(words), "doc_id long, n_shingles long, digest binary, bands array<long>, sig binary"), "sketches")
    folded = staged(sketches.filter("digest is not null").groupBy("digest").agg(
        F.min("doc_id").alias("id"), F.count(F.lit(1)).alias("copies"), F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands"), F.first("sig").alias("sig"))
        .filter("id is not null"), "folded")
    dealt = folded.select("id", "n_shingles", F.posexplode("bands").alias("band", "key"))
    buckets = staged(dealt.groupBy("key").agg(F.min("id").alias("centre"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("key", "centre"), "buckets")
    # buckets grow with the corpus: never broadcast; adaptive execution splits the partition of a hot bucket
    members = staged(dealt.join(buckets, "key"), "members")
    size_of = folded.select(F.col("id").alias("centre"), F.col("n_shingles").alias("c_size"))
    fits, u, v = _edge("id", "centre", "n_shingles", "c_size", percent)
    stars = members.filter("id <> centre").select("id", "centre", "n_shingles").distinct().join(size_of, "centre").filter(fits).select(u, v)
    stars = staged(stars, "stars")
    ids = members.select(F.col("id").alias("doc_id")).distinct()
    ids = staged(ids, "ids")
    sets = staged(base.join(sized(ids, ids.count()), "doc_id", "left_semi").mapInArrow(_sets(words), "id long, set binary"), "sets")
    links = staged(_confirmed(stars, sets, percent), "links")
    comps = components(links)
    rest = _mixed_stars(members.select("key", "band", "id", "n_shingles"), folded.select("id", "sig", "bands"), comps, comps.count(), percent).distinct().join(stars, ["u", "v"], "left_anti")
    rest = staged(rest, "rest")
    more = staged(_confirmed(rest, sets, percent), "more")
    if more.count():
        comps = components(links.union(more))
    found = folded.join(comps.withColumnRenamed("u", "id"), "id", "left").withColumn("component_id", F.coalesce("component", "id"))
    found = staged(found.filter("copies > 1 or component is not null").select("digest", "component_id"), "found")
    out = lookup(sketches.select("doc_id", "n_shingles", "digest"), found, found.count(), "digest")
    out = out.withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"), words=2)


SQL = r"""
WITH RECURSIVE d AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
    FROM documents),
s AS (
    SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]]
                                 ELSE list_transform(range(1, len(w)), lambda p: w[p] || ' ' || w[p + 1]) END) AS x
    FROM d),
e AS (SELECT doc_id, len(x) AS n, unnest(x) AS h FROM s),
link AS (
    SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.h = b.h AND a.doc_id <> b.doc_id
    GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
reach(doc_id, r) AS (
    SELECT doc_id, doc_id FROM documents
    UNION
    SELECT reach.doc_id, link.b FROM reach JOIN link ON link.a = reach.r)
SELECT s.doc_id, len(x)::BIGINT AS n_shingles, m.component_id, s.doc_id = m.component_id AS kept
FROM s JOIN (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id) m USING (doc_id)
"""
