"""Benchmark decontamination by a generalised suffix automaton of the test items.

The words of all items feed one automaton. The words of a document are streamed through it while the length of the
longest match that ends at each word is tracked; where it reaches ``window`` words, those words are hit. An item of
fewer words is one window, found through the suffix links of the state that spells it.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z lower-cased. Defined results: a null or empty text
has no words and no hits; items without words have no window; items that repeat an id are one item; an item with a null
id marks words but is not named; an empty item table hits nothing; other columns are ignored.

Items go to the executors in shards of at most ``SHARD_WORDS`` words, so that what is broadcast stays bounded however
large the item table is. Each shard is one pass over the whole texts; the passes are merged per row, by a row number that is
stored with the texts, and texts are judged and cut once, by the merged spans. So results do not depend on the shards.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from creditloom.llm.common import model, numbered, read, small_batches, staged
from creditloom.llm.words import alnum_offsets, alnum_words

WINDOW = 10
#: Words of items in one automaton; an automaton has at most two states a word (about 100 MB for a full shard).
SHARD_WORDS = 200_000
HITS = "n_words long, spans array<struct<first:int,last:int>>, items array<string>"


class Automaton:
    """Generalised suffix automaton over word numbers, with the items of every long enough state."""

    def __init__(self, items: list[tuple[str | None, str]], window: int) -> None:
        self.window, self.vocab = window, {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.owners: list[set] = [set()]
        self.short: list[dict[int, set]] = [{}]
        self.least = window
        spelled = []
        for item, text in items:
            words = [self.vocab.setdefault(w, len(self.vocab)) for w in alnum_words(text)]
            if words:
                spelled.append((item, words))
                self.least = min(self.least, len(words))
                last = 0
                for w in words:
                    last = self._add(last, w)
        for item, words in spelled:
            state = 0
            for w in words:
                state = self.next[state][w]
                if len(words) >= window:
                    # the path of an item passes, prefix by prefix, every end position of it
                    up = state
                    while up > 0 and self.length[up] >= window and item not in self.owners[up]:
                        self.owners[up].add(item)
                        up = self.link[up]
            if len(words) < window:
                self.short[state].setdefault(len(words), set()).add(item)
        for state in sorted(range(1, len(self.link)), key=self.length.__getitem__):
            up = self.link[state]
            if up > 0 and self.short[up]:
                merged = {k: set(v) for k, v in self.short[up].items()}
                for k, v in self.short[state].items():
                    merged.setdefault(k, set()).update(v)
                self.short[state] = merged

    def _state(self, length: int, link: int, moves: dict[int, int]) -> int:
        self.next.append(moves)
        self.link.append(link)
        self.length.append(length)
        self.owners.append(set())
        self.short.append({})
        return len(self.link) - 1

    def _add(self, last: int, w: int) -> int:
        known = self.next[last].get(w)
        if known is not None and self.length[known] == self.length[last] + 1:
            return known
        new = None if known is not None else self._state(self.length[last] + 1, 0, {})
        p = last
        if new is not None:
            while p >= 0 and w not in self.next[p]:
                self.next[p][w] = new
                p = self.link[p]
            if p < 0:
                return new
        q = self.next[p][w]
        if self.length[q] == self.length[p] + 1:
            self.link[new] = q
            return new
        clone = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = clone
        if new is not None:
            self.link[new] = clone
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = clone
            p = self.link[p]
        return clone if new is None else new

    def scan(self, numbers: np.ndarray) -> tuple[list[tuple[int, int]], set]:
        """Hit word ranges [first, last] in order, merged, and the items with a window in the text."""
        known = np.flatnonzero(np.diff(np.concatenate(([0], (numbers >= 0).view(np.int8), [0]))))
        spans: list[tuple[int, int]] = []
        items: set = set()
        for lo, hi in zip(known[::2].tolist(), known[1::2].tolist()):
            if hi - lo >= self.least:
                self._stream(numbers[lo:hi].tolist(), lo, spans, items)
        merged: list[tuple[int, int]] = []
        for first, last in sorted(spans):
            if merged and first <= merged[-1][1] + 1:
                merged[-1] = merged[-1][0], max(last, merged[-1][1])
            else:
                merged.append((first, last))
        return merged, items

    def _stream(self, words: list[int], at: int, spans: list, items: set) -> None:
        nxt, link, length, window = self.next, self.link, self.length, self.window
        state = size = 0
        for i, w in enumerate(words, at):
            while state and w not in nxt[state]:
                state = link[state]
                size = length[state]
            if w not in nxt[state]:
                continue
            state, size = nxt[state][w], size + 1
            if size >= window:
                up = state
                while length[link[up]] >= window:
                    up = link[up]
                items |= self.owners[up]
                spans.append((i - window + 1, i))
            short = self.short[state]
            if not short and link[state] > 0:
                short = self.short[link[state]]
            for k, named in short.items():
                if k <= size:
                    items |= named
                    spans.append((i - k + 1, i))


def _automaton(items: tuple[tuple[str | None, str], ...], window: int) -> Automaton:
    return model(("automaton", items, window), lambda: Automaton(list(items), window))


def _shards(items: DataFrame, id_col: str, text_col: str) -> Iterator[tuple]:
    """The items as tuples of bounded size, at least one; rows stream to the driver one partition at a time."""
    rows = items.select(F.col(f"`{id_col}`").cast("string").alias("i"), F.col(f"`{text_col}`").cast("string").alias("t")).filter("t is not null")
    now, size = [], 0
    for r in rows.toLocalIterator():
        n = len(alnum_words(r.t))
        if now and size + n > SHARD_WORDS:
            yield tuple(now)
            now, size = [], 0
        now.append((r.i, r.t))
        size += n
    yield tuple(now)


def _broadcasts(items: DataFrame, id_col: str, text_col: str) -> list:
    """A broadcast of each shard; the driver holds one shard at a time, broadcasts are files."""
    return [items.sparkSession.sparkContext.broadcast(s) for s in _shards(items, id_col, text_col)]


def _scanner(shard, window: int):
    """The last column, the text, gives way to ``HITS``; the columns before it stay."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = _automaton(shard.value, window)
        get = auto.vocab.get
        kind = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))
        for batch in batches:
            counts, spans, names = [], [], []
            for text in batch.columns[-1]:
                words = alnum_words(text.as_py())
                hit, items = auto.scan(np.fromiter((get(w, -1) for w in words), dtype=np.int64, count=len(words)))
                counts.append(len(words))
                spans.append([{"first": a, "last": b} for a, b in hit])
                names.append(sorted(x for x in items if x is not None))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(counts, pa.int64()), pa.array(spans, kind), pa.array(names, pa.list_(pa.string()))],
                                             names=[*batch.schema.names[:-1], "n_words", "spans", "items"])

    return scan


def _merged(rows: DataFrame, shards: list, window: int, id_col: str, every: bool) -> DataFrame:
    """Per row: __row, the id column, n_words, spans and items over all shards; only rows with a hit unless ``every`` is set."""
    base = rows.select("__row", id_col, "text")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema.fields[:-1])
    passes = [base.mapInArrow(_scanner(s, window), f"{kinds}, {HITS}").filter(F.lit(True) if every else F.size("spans") > 0) for s in shards]
    union = passes[0]
    for p in passes[1:]:
        union = union.unionByName(p)
    merged = union.groupBy("__row", id_col).agg(F.max("n_words").alias("n_words"), F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"),
                                                F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    join = ("aggregate(spans, cast(array() as array<struct<first:int,last:int>>), (a, x) -> "
            "CASE WHEN size(a) > 0 AND x.first <= element_at(a, -1).last + 1 THEN concat(slice(a, 1, size(a) - 1), "
            "array(named_struct('first', element_at(a, -1).first, 'last', greatest(x.last, element_at(a, -1).last)))) ELSE concat(a, array(x)) END)")
    return merged.withColumn("spans", F.expr(join))


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Per document: doc_id, n_words, spans of hit words (first and last word, from 0), items (sorted ids as text)."""
    small_batches(docs.sparkSession)
    base = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    shards = _broadcasts(items, item_col, item_text_col)
    if len(shards) == 1:
        return base.mapInArrow(_scanner(shards[0], window), f"doc_id long, {HITS}")
    return _merged(numbered(base), shards, window, "doc_id", every=True).drop("__row")


def n_hit() -> F.Column:
    return F.expr("aggregate(spans, 0L, (a, x) -> a + x.last - x.first + 1)")


def _cut(text: str, hit: list[tuple[int, int]]) -> str:
    """The text without the hit word ranges."""
    raw, at = alnum_offsets(text)
    kept, end = [], 0
    for first, last in hit:
        kept.append(raw[end:at[first][0]])
        end = at[last][1]
    return b"".join([*kept, raw[end:]]).decode("utf-8", "surrogatepass")


def _cutter(shard, window: int, max_coverage: float, columns: list[str]):
    """Cut by the hits of the only shard, or, without one, by the columns __n and __spans that all shards gave."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = _automaton(shard.value, window) if shard is not None else None
        for batch in batches:
            texts, keep = [], []
            at = None if auto else list(zip(batch.column("__n").to_pylist(), batch.column("__spans").to_pylist()))
            for i, text in enumerate(batch.column("text")):
                text = text.as_py()
                if auto:
                    words = alnum_words(text)
                    n = len(words)
                    hit, _ = auto.scan(np.fromiter((auto.vocab.get(w, -1) for w in words), dtype=np.int64, count=n))
                else:
                    n, hit = at[i][0] or 0, [(x["first"], x["last"]) for x in at[i][1] or ()]
                keep.append(sum(b - a + 1 for a, b in hit) <= max_coverage * n)
                texts.append(_cut(text, hit) if hit else text)
            yield batch.set_column(batch.schema.get_field_index("text"), "text", pa.array(texts, pa.string())).select(columns).filter(pa.array(keep, pa.bool_()))

    return cut


def remove_contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, max_coverage: float = 0.5) -> DataFrame:
    """The documents with every hit span cut out of ``text``; a document goes where more than ``max_coverage`` of its words are
    hit. All columns stay; texts without a hit stay as they are, null included."""
    small_batches(docs.sparkSession)
    shards, columns = _broadcasts(items, "item_id", "text"), docs.columns
    if len(shards) == 1:
        return docs.mapInArrow(_cutter(shards[0], window, max_coverage, columns), docs.schema)
    rows = numbered(docs)
    hits = staged(_merged(rows, shards, window, "doc_id", every=False).select("__row", F.col("n_words").alias("__n"), F.col("spans").alias("__spans")), "hits")
    return rows.join(hits, "__row", "left").mapInArrow(_cutter(None, window, max_coverage, columns), docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", n_hit().alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))


_WORDS = (r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
          r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')")

SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
win AS (
    SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[p:p + least(len(w), 10) - 1], ' ') AS k
    FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS p FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
grams AS (
    SELECT doc_id, n, p, array_to_string(w[p:p + n - 1], ' ') AS k
    FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, sizes WHERE len(w) >= n)),
hit AS (SELECT g.doc_id, g.p, g.n, win.item_id FROM grams g JOIN win ON g.k = win.k AND g.n = win.n),
words AS (SELECT doc_id, count(DISTINCT i) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS i FROM (SELECT DISTINCT doc_id, p, n FROM hit)) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS i FROM hit) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(words.n_hit, 0)::BIGINT AS n_hit, coalesce(named.n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(named.items, '')) AS items_sha256, coalesce(words.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN named USING (doc_id)
"""
