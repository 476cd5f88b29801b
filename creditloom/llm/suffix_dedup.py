"""Removal of repeated byte windows by a depth-limited radix sort of suffixes.

Suffixes are compared only through ``LENGTH`` bytes, most significant digits first; a suffix that is alone under the digits
seen so far leaves, and what is equal to the end is exactly the repeated windows. A window's leading digit is its
smallest ``GRAM``-byte gram (by hash, the leftmost of equal ones): equal windows choose the same gram at the same place,
and neighbouring windows share one, so that one row, an anchor, stands for about eighty windows.

1. digit one, the gram: anchors whose gram occurs once leave;
2. digit two, everything that any window over the gram can reach to its left and right: anchors that are equal in it are
   copies, all their windows are repeated, and one of them goes on for them all;
3. the rest: up to ``SMALL`` anchors of a gram are compared byte by byte to the left and right, but for those that sorting
   shows to agree with none far enough. The windows of more
   frequent anchors fall into cells of windows that start at most ``GRAM`` bytes apart: digit three is what all windows of a
   cell share, digit four all that they reach; cells that are equal in it are copies again, and of different cells that
   share digit three one of each goes on as single windows, counted by two 64-bit hashes.

Digits of stages 1 and 2 are 64-bit hashes of different bases. Nothing is grouped in one task but the at most ``SMALL``
anchors of a rare gram and the ranges of one document; counts are partly summed before they are shuffled.

Defined results: a null or empty text has no bytes and is kept as it is; matches never cross documents; repeated rows count
as two documents; of rows that share an id and differ in text, a range found in one applies to the others as far as
they reach; rows with a null id are judged as well; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from creditloom.llm.common import read, sized, small_batches, staged, text_or_empty
from creditloom.llm.near_dedup import mix

LENGTH, GRAM, SMALL, FEW = 200, 40, 1000, 16
#: Rows of windows that leave a Python worker at once.
ROWS_OUT = 100_000
REACH = LENGTH - GRAM
#: Windows of a document are handled in segments of so many, so that memory does not grow with its length.
SEGMENT = 1 << 20
_POS = np.uint64((1 << 22) - 1)
ANCHORS = "g long, c long, row long, a int, lo int, hi int"
PLACE = ["row", "a", "lo", "hi"]


class _Base:
    """Polynomial hashes of byte ranges modulo 2^64, over mixed byte values."""

    def __init__(self, seed: int) -> None:
        with np.errstate(over="ignore"):
            self.values = mix(np.arange(256, dtype=np.uint64) + np.uint64(seed) * np.uint64(0x9E3779B97F4A7C15))
        self.base = (0x5851F42D4C957F2D * (2 * seed + 1)) & (2**64 - 1) | 1
        self.inverse = pow(self.base, -1, 2**64)
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.up) < n:
            self.up, self.down = (self._powers(x, max(n, 2 * len(self.up))) for x in (self.base, self.inverse))

    @staticmethod
    def _powers(x: int, n: int) -> np.ndarray:
        out = np.full(n, x, dtype=np.uint64)
        out[0] = 1
        return np.cumprod(out, dtype=np.uint64)

    def sums(self, data: np.ndarray) -> np.ndarray:
        self._grow(len(data) + 1)
        out = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(self.values[data] * self.down[:len(data)], out=out[1:])
        return out

    def hash(self, sums: np.ndarray, start, stop) -> np.ndarray:
        return mix((sums[stop] - sums[start]) * self.up[start])


ONE, TWO = _Base(1), _Base(2)


def _smallest(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours."""
    n = len(values)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[:n] = values
    blocks = padded.reshape(-1, width)
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n - width + 1], left[width - 1:n])


def anchors(data: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """Arrays (gram hash, reach hash, anchor, first window, last window) of a document's windows, segment by segment."""
    n = len(data)
    for s in range(0, max(0, n - LENGTH + 1), SEGMENT):
        first = max(0, s - 1)  # one window more on the left tells whether an anchor began there
        last = min(s + SEGMENT + REACH + 1, n - LENGTH + 1)
        base = max(0, first - REACH)
        piece = data[base:min(n, last - 1 + REACH + LENGTH)]
        sums = ONE.sums(piece)
        at = np.arange(first - base, last - 1 + LENGTH - GRAM + 1 - base)
        grams = ONE.hash(sums, at, at + GRAM)
        chosen = (_smallest((grams & ~_POS) | at.astype(np.uint64), REACH + 1) & _POS).astype(np.int64)
        edge = np.flatnonzero(np.concatenate(([True], chosen[1:] != chosen[:-1])))
        a, lo, hi = chosen[edge], first + edge, first + np.concatenate((edge[1:], [len(chosen)])) - 1
        own = (lo >= s) & (lo < s + SEGMENT)
        a, lo, hi = a[own], lo[own], hi[own]
        start, stop = np.maximum(a + base - REACH, 0) - base, np.minimum(a + base + LENGTH, n) - base
        reach = TWO.hash(TWO.sums(piece), start, stop)
        reach = mix(reach + mix((a - start).astype(np.uint64) * np.uint64(4096) + (stop - a).astype(np.uint64)))
        yield grams[a - at[0]], reach, a + base, lo, hi


def _bytes(text) -> np.ndarray:
    return np.frombuffer(text.as_buffer(), dtype=np.uint8) if text.is_valid and len(text.as_py()) else np.empty(0, dtype=np.uint8)


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        parts: list[list[np.ndarray]] = [[] for _ in range(6)]
        for row, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            for g, c, a, lo, hi in anchors(_bytes(text)):
                for part, x in zip(parts, (g.view(np.int64), c.view(np.int64), np.full(len(a), row), a, lo, hi)):
                    part.append(x)
        if parts[0]:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(p).astype(np.int64 if i < 3 else np.int32)) for i, p in enumerate(parts)],
                                             names=["g", "c", "row", "a", "lo", "hi"])


STAGE3 = "kind int, key long, f long, row long, a int, lo int, hi int, left int, around binary"
_TYPES = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary())


def _cells(data: np.ndarray, a: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """(key, f, anchor, first window, last window) for the windows of each anchor that start ``GRAM`` bytes apart at most.

    All windows of a cell cover the bytes that ``key`` stands for, and lie in those that ``f`` stands for.
    """
    n, one, two = len(data), ONE.sums(data), TWO.sums(data)
    for k in range(REACH // GRAM):
        near, far = GRAM * k + (k > 0), GRAM * (k + 1)
        first, last = np.maximum(lo, a - far), np.minimum(hi, a - near)
        some = np.flatnonzero(first <= last)
        at = a[some]
        key = mix(ONE.hash(one, at - near, at + LENGTH - far) + np.uint64(k))
        start, stop = np.maximum(at - far, 0), np.minimum(at + LENGTH - near, n)
        f = mix(TWO.hash(two, start, stop) + mix((at - start).astype(np.uint64) * np.uint64(4096) + (stop - at).astype(np.uint64)))
        yield key.view(np.int64), f.view(np.int64), at, first[some], last[some]


def _third_digits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For the unsettled anchors of a document: the bytes around those of rare grams, the cells of the others."""
    for batch in batches:
        out: list[tuple] = []
        for row, text, marks in zip(batch.column("row").to_pylist(), batch.column("text"), batch.column("marks").to_pylist()):
            raw = text.as_buffer().to_pybytes()
            marks = [m for m in marks if m["hi"] + LENGTH <= len(raw)]  # others are of another text with this id
            for m in marks:
                if m["kind"] == 1:
                    start = max(0, m["a"] - REACH)
                    out.append((1, m["g"], 0, row, m["a"], m["lo"], m["hi"], m["a"] - start, raw[start:m["a"] + LENGTH]))
            often = np.array([(m["a"], m["lo"], m["hi"]) for m in marks if m["kind"] == 2], dtype=np.int64).reshape(-1, 3)
            data = np.frombuffer(raw, dtype=np.uint8)
            for i in range(0, len(data), SEGMENT) if len(often) else ():
                own = often[(often[:, 0] >= i) & (often[:, 0] < i + SEGMENT)]
                base = max(0, i - REACH)
                for cell in _cells(data[base:i + SEGMENT + LENGTH], own[:, 0] - base, own[:, 1] - base, own[:, 2] - base) if len(own) else ():
                    key, f, a, lo, hi = (x.tolist() for x in cell)
                    out.extend((2, key[j], f[j], row, a[j] + base, lo[j] + base, hi[j] + base, 0, None) for j in range(len(key)))
        cols = list(zip(*out)) if out else [[]] * len(_TYPES)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _TYPES)], names=["kind", "key", "f", "row", "a", "lo", "hi", "left", "around"])


def _longest(rows: np.ndarray) -> np.ndarray:
    """How far each row agrees with the row that agrees with it furthest: a neighbour in sorted order."""
    order = np.array(sorted(range(len(rows)), key=[r.tobytes() for r in rows].__getitem__), dtype=np.int64)
    differ = rows[order[1:]] != rows[order[:-1]]
    differ[:, REACH] = True
    shared = differ.argmax(axis=1)
    out = np.empty(len(rows), dtype=np.int64)
    out[order] = np.maximum(np.concatenate(([0], shared)), np.concatenate((shared, [0])))
    return out


def _equal_runs(group: list[tuple]) -> Iterator[tuple[int, int, int]]:
    """(row, first window, last window) of the repeated windows among the anchors of one gram."""
    alike: dict[tuple, list[int]] = {}
    for i, (_, _, _, _, left, around) in enumerate(group):
        alike.setdefault((left, around), []).append(i)
    kept = []
    for same in alike.values():
        if len(same) > 1:  # equal as far as any window reaches
            yield from ((group[i][0], group[i][2], group[i][3]) for i in same)
        kept.append(same[0])
    before, after = np.full((len(kept), REACH + 1), 256, dtype=np.int16), np.full((len(kept), REACH + 1), 256, dtype=np.int16)
    for i, k in enumerate(kept):
        left, b = group[k][4], np.frombuffer(group[k][5], dtype=np.uint8)
        before[i, :left] = b[:left][::-1]
        after[i, :len(b) - left - GRAM] = b[left + GRAM:]
    if len(kept) > FEW:  # only anchors whose longest matches to both sides add up to a window can have one
        able = np.flatnonzero(_longest(before) + _longest(after) >= REACH)
        kept, before, after = [kept[i] for i in able], before[able], after[able]
    for i, k in enumerate(kept):
        row, a, lo, hi, left, around = group[k]
        if len(alike[(left, around)]) > 1:
            continue
        # the last column is never equal, so argmax finds the first difference
        differ = before != before[i]
        differ[:, REACH] = True
        reach_left = differ.argmax(axis=1)
        differ = after != after[i]
        differ[:, REACH] = True
        reach_right = differ.argmax(axis=1)
        first, last = np.maximum(lo, a - reach_left), np.minimum(hi, a + reach_right - REACH)
        first[i], last[i] = 1, 0
        good = np.flatnonzero(first <= last)
        for lo_, hi_ in sorted({(int(first[j]), int(last[j])) for j in good}):
            yield row, lo_, hi_


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by gram: compares the anchors of each gram."""
    now, group = None, []
    for batch in batches:
        found: list[tuple[int, int, int]] = []
        for g, *rest in zip(*(batch.column(c).to_pylist() for c in ("key", "row", "a", "lo", "hi", "left", "around"))):
            if g != now:
                found.extend(_equal_runs(group))
                now, group = g, []
            group.append(tuple(rest))
        yield _ranges(found)
    yield _ranges(list(_equal_runs(group)))


def _ranges(found: list[tuple[int, int, int]]) -> pa.RecordBatch:
    cols = list(zip(*found)) if found else [[]] * 3
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int32()))], names=["row", "lo", "hi"])


def _window_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hashes of all windows of each unsettled cell of a document."""
    parts: list[list[np.ndarray]] = [[] for _ in range(4)]

    def flush() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(np.concatenate(p).astype(np.int64) if p else np.empty(0, dtype=np.int64)) for p in parts], names=["h1", "h2", "row", "p"])
        for p in parts:
            p.clear()
        return out

    size = 0
    for batch in batches:
        for row, text, marks in zip(batch.column("row").to_pylist(), batch.column("text"), batch.column("marks").to_pylist()):
            data = _bytes(text)
            for m in marks:
                if m["hi"] + LENGTH > len(data):
                    continue  # of another text with this id
                piece = data[m["lo"]:m["hi"] + LENGTH]
                at = np.arange(m["hi"] - m["lo"] + 1)
                for part, x in zip(parts, (*(b.hash(b.sums(piece), at, at + LENGTH).view(np.int64) for b in (ONE, TWO)), np.full(len(at), row), at + m["lo"])):
                    part.append(x)
                size += len(at)
                if size >= ROWS_OUT:
                    yield flush()
                    size = 0
    yield flush()


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cut the ranges of repeated windows out of each text."""
    for batch in batches:
        sizes, texts = [], []
        for text, ranges in zip(batch.column("text"), batch.column("ranges").to_pylist()):
            raw, spans, kept, end = text.as_buffer().to_pybytes(), [], [], 0
            for r in sorted((r["lo"], min(r["hi"] + LENGTH, len(raw))) for r in ranges if r["lo"] < len(raw)):
                if spans and r[0] <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], r[1])
                else:
                    spans.append(list(r))
            for lo, hi in spans:
                kept.append(raw[end:lo])
                end = hi
            texts.append(b"".join([*kept, raw[end:]]))
            sizes.append((len(raw), len(raw) - len(texts[-1]), len(spans)))
        a, b, c = zip(*sizes) if sizes else ((), (), ())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.int64()), pa.array(texts, pa.binary())],
                                         names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])


def _marked(texts: DataFrame, marks: DataFrame, columns: list[str]) -> DataFrame:
    """Texts of the rows that have marks, with the marks; only those texts are shuffled where their ids may be broadcast."""
    by_row = marks.groupBy("row").agg(F.collect_list(F.struct(*columns)).alias("marks"))
    rows = marks.select("row").distinct()
    return texts.join(sized(rows, rows.count()), "row", "left_semi").join(by_row, "row")


def _one(columns: list[str]) -> list[Column]:
    """One row of a group of equals stands for them all."""
    return [F.first(x).alias(x) for x in columns]


def repeated_windows(texts: DataFrame) -> DataFrame:
    """(row, lo, hi): ranges of window starts whose ``LENGTH`` bytes also start anywhere else. ``texts`` has row (unique) and text."""
    found = texts.mapInArrow(_anchor_rows, ANCHORS)
    digits = (found.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.min("c").alias("low"), F.max("c").alias("high")).filter("n > 1")
              .select("g", (F.col("low") != F.col("high")).alias("mixed")))
    digits = staged(digits, "digits")
    # tables of grams grow with the corpus: never broadcast; adaptive execution splits the partition of a hot gram
    held = staged(found.join(digits, "g"), "anchors")
    mixed = held.filter("mixed")
    classes = staged(mixed.groupBy("g", "c").agg(F.count(F.lit(1)).alias("n"), *_one(PLACE)), "classes")
    copied = mixed.join(classes.filter("n > 1").select("g", "c"), ["g", "c"], "left_semi")
    variants = classes.groupBy("g").agg(F.when(F.count(F.lit(1)) <= SMALL, 1).otherwise(2).alias("kind"))
    third = staged(_marked(texts, classes.join(variants, "g"), ["kind", "g", "a", "lo", "hi"]).mapInArrow(_third_digits, STAGE3), "third")
    near = third.filter("kind = 1").drop("kind", "f").repartition("key").sortWithinPartitions("key").mapInArrow(_compare, "row long, lo int, hi int")
    cells = third.filter("kind = 2").select("key", "f", *PLACE)
    shapes = staged(cells.groupBy("key", "f").agg(F.count(F.lit(1)).alias("n"), *_one(PLACE)), "shapes")
    whole = cells.join(shapes.filter("n > 1").select("key", "f"), ["key", "f"], "left_semi")
    shared = shapes.groupBy("key").agg(F.count(F.lit(1)).alias("shapes")).filter("shapes > 1").select("key")
    windows = staged(_marked(texts, shapes.join(shared, "key", "left_semi"), ["a", "lo", "hi"]).mapInArrow(_window_rows, "h1 long, h2 long, row long, p long"), "windows")
    often = windows.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("h1", "h2")
    wide = windows.join(often, ["h1", "h2"], "left_semi").select("row", F.col("p").cast("int").alias("lo"), F.col("p").cast("int").alias("hi"))
    settled = held.filter("not mixed").unionByName(copied).unionByName(whole, allowMissingColumns=True).select("row", "lo", "hi")
    return settled.union(near).union(wide)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept (the remaining bytes)."""
    small_batches(docs.sparkSession)
    base = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text_or_empty(text_col).cast("binary").alias("text"))
    texts = base.withColumn("row", F.coalesce("doc_id", F.xxhash64("text")))
    ranges = staged(repeated_windows(texts.select("row", "text")), "ranges")
    by_row = ranges.groupBy("row").agg(F.collect_list(F.struct("lo", "hi")).alias("ranges"))
    rows = staged(ranges.select("row").distinct(), "rows")
    n = rows.count()
    whole = texts.join(sized(rows, n), "row", "left_anti").select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"),
                                                                 F.lit(0).cast("long").alias("n_spans"), F.col("text").alias("kept"))
    cut = texts.join(sized(rows, n), "row", "left_semi").join(by_row, "row").select("doc_id", "text", "ranges")
    return whole.unionByName(cut.mapInArrow(_remove, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
