"""Toxicity by compression distance between two zstandard dictionaries.

Two dictionaries are trained separately. The ordinary one is trained on ordinary training texts, the toxic one on those
stretches of toxic training texts whose letter sequences are far more common in toxic than in ordinary documents (by the
likelihood ratio of their document counts). A text is cut into windows of ``WINDOW`` words. Each is compressed with the
ordinary dictionary and again with the toxic one added to it; the bytes that the toxic dictionary saves are the window's
distance. Letters are written as three bytes and matches need seven, so that a saved byte means a match of some letters.

Thresholds are calibrated on training rows that no dictionary has seen: window thresholds as quantiles of ordinary windows,
then a small logistic model of a document's counts over them, moved so that a score of 0.7 is where it decides best.

Training takes at most ``TOXIC_ROWS`` and ``ORDINARY_ROWS`` labelled rows, drawn by a hash of the id, and at most ``TRAIN_CHARS``
characters of each. Defined results: a null or empty text, or one without letters, has no window and gets the score of
no evidence; a row with several labels counts as toxic if one says so; without rows of both labels all scores are 0;
repeated rows get the same score; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard as zs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from creditloom.llm.common import held, read, small_batches
from creditloom.llm.language_id import words_of
from creditloom.llm.near_dedup import mix

TOXIC_ROWS, ORDINARY_ROWS, TRAIN_CHARS = 1500, 5000, 12_000_000
WINDOW, GRAM, DECIDE = 3, 5, 0.7
#: Least likelihood ratio statistic of a toxic letter sequence, ratio of its shares of documents, documents, share of toxic ones.
LEAST_RATIO, LEAST_TIMES, LEAST_DOCS, LEAST_SHARE = 20.0, 20.0, 3, 0.03
ORDINARY_BYTES, TOXIC_BYTES, SAMPLE = 32768, 8192, 1200
#: Shares of ordinary windows that pass the two window thresholds.
QUANTILES = (1e-3, 1e-4)


def _spread(text: str) -> bytes:
    """Three bytes for each character, drawn by a hash of it."""
    h = mix(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64))
    out = np.empty((len(h), 3), dtype=np.uint8)
    for i in range(3):
        out[:, i] = (h >> np.uint64(8 * i)) & np.uint64(255)
    return out.tobytes()


def _line(text: str | None) -> str:
    """The text's words with a blank around each."""
    words = words_of(text)
    return f" {' '.join(words)} " if words else ""


def _grams(line: str) -> set[str]:
    return {line[i:i + GRAM] for i in range(len(line) - GRAM + 1)}


def _statistic(a: int, b: int, n: int, m: int) -> float:
    """Likelihood ratio statistic of ``a`` of ``n`` against ``b`` of ``m`` documents."""
    share = (a + b) / (n + m)
    cells = ((a, n * share), (b, m * share), (n - a, n * (1 - share)), (m - b, m * (1 - share)))
    return 2 * sum(seen * math.log(seen / due) for seen, due in cells if seen)


def _train(samples: list[bytes], size: int) -> bytes:
    """A trained dictionary's content; with too few samples to train, the samples themselves."""
    try:
        return zs.train_dictionary(size, samples).as_bytes()
    except zs.ZstdError:
        return b"".join(samples)[:size]


def train_dictionaries(toxic: list[str], ordinary: list[str]) -> tuple[bytes, bytes]:
    """Dictionaries of ordinary and of toxic text, from lines."""
    counts: tuple[Counter, Counter] = Counter(), Counter()
    for line in toxic:
        counts[0].update(_grams(line))
    for line in ordinary:
        counts[1].update(_grams(line) & counts[0].keys())
    n, m = len(toxic), len(ordinary)
    telling = {g for g, a in counts[0].items() if a >= max(LEAST_DOCS, LEAST_SHARE * n) and a / n >= LEAST_TIMES * (counts[1][g] + 0.5) / m and _statistic(a, counts[1][g], n, m) >= LEAST_RATIO}
    stretches = []
    for line in toxic:
        marks = bytearray(len(line))
        for i in range(len(line) - GRAM + 1):
            if line[i:i + GRAM] in telling:
                marks[i:i + GRAM] = b"\x01" * GRAM
        found = "".join(line[x.start():x.end()] for x in re.finditer(b"\x01+", bytes(marks)))
        if found:
            stretches.append(_spread(found))
    plain = [_spread(line) for line in ordinary]
    samples = [p[i:i + SAMPLE] for p in plain for i in range(0, len(p), SAMPLE)]
    return _train(samples, ORDINARY_BYTES), _train(stretches, TOXIC_BYTES)


class Scorer:
    """Distances of windows under the two dictionaries."""

    def __init__(self, ordinary: bytes, toxic: bytes) -> None:
        self.compressors = []
        for content in (ordinary, ordinary + toxic):
            how = zs.ZstdCompressionParameters.from_level(1, min_match=7, write_content_size=False, write_checksum=False, write_dict_id=False)
            content = zs.ZstdCompressionDict(content, dict_type=zs.DICT_TYPE_RAWCONTENT) if len(content) >= 8 else None
            if content:
                content.precompute_compress(compression_params=how)
            self.compressors.append(zs.ZstdCompressor(dict_data=content, compression_params=how).compress)

    def distances(self, text: str | None) -> np.ndarray:
        """Bytes that the toxic dictionary saves in each window."""
        words = words_of(text)
        if not words:
            return np.empty(0, dtype=np.int64)
        raw = _spread(f" {' '.join(words)} ")
        ends = [0]
        at = 0
        for w in words:
            at += len(w) + 1
            ends.append(at)
        stops = ends[WINDOW::WINDOW]
        if not stops or stops[-1] != at:
            stops.append(at)
        plain, both = self.compressors
        out, begin = [], 0
        for stop in stops:
            piece = raw[3 * begin:3 * stop + 3]  # with the blanks on both sides
            out.append(len(plain(piece)) - len(both(piece)))
            begin = stop
        return np.array(out, dtype=np.int64)


def _features(distances: np.ndarray, marks: tuple[float, float]) -> list[float]:
    """Largest distance, windows over each threshold, and windows."""
    n = len(distances)
    return [1.0, float(max(0, distances.max())) if n else 0.0, *(math.log1p(int((distances > t).sum())) for t in marks), math.log1p(n)]


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Ridge logistic regression by Newton's method."""
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(x.shape[1]), x.T @ (y - p) - 0.1 * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(rows: list[tuple[int, str, int]]) -> tuple | None:
    """A model (two dictionaries, window thresholds, weights) from rows (id, text, label), or None without both labels.

    Two thirds of the rows, by a hash of their id, train the dictionaries and the others calibrate.
    """
    third = mix(np.array([r[0] for r in rows], dtype=np.int64).view(np.uint64)) % np.uint64(3) == 0
    lines = [(_line(t), label) for _, t, label in rows]
    toxic, ordinary = ([x for (x, y), c in zip(lines, third) if y == label and not c and x] for label in (1, 0))
    if not toxic or not ordinary:
        return None
    dictionaries = train_dictionaries(toxic, ordinary)
    scorer = Scorer(*dictionaries)
    checked = [(scorer.distances(t), label) for (_, t, label), c in zip(rows, third) if c]
    plain = np.concatenate([d for d, y in checked if not y] or [np.zeros(1, dtype=np.int64)])
    marks = tuple(float(np.quantile(plain, 1 - q)) for q in QUANTILES) if len(plain) else (0.0, 0.0)
    x = np.array([_features(d, marks) for d, _ in checked]).reshape(-1, 5)
    y = np.array([label for _, label in checked], dtype=np.float64)
    if not len(y) or y.min() == y.max():
        return (*dictionaries, marks, (0.0, 0.0, 0.0, 0.0, 0.0))
    w = _logistic(x, y)
    logit = x @ w
    best = max(sorted(set(logit)), key=lambda t: 2 * ((logit >= t) & (y > 0)).sum() / ((logit >= t).sum() + y.sum()))
    under = logit[logit < best]
    w[0] += math.log(DECIDE / (1 - DECIDE)) - (best + (under.max() if len(under) else best)) / 2
    return (*dictionaries, marks, tuple(w.tolist()))


@lru_cache(maxsize=2)
def _scorer(ordinary: bytes, toxic: bytes) -> Scorer:
    return Scorer(ordinary, toxic)


def _score(shared):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            scores = [0.0] * batch.num_rows
            if model:
                ordinary, toxic, marks, w = model
                own = _scorer(ordinary, toxic)
                for i, text in enumerate(batch.column("text")):
                    z = sum(a * b for a, b in zip(w, _features(own.distances(text.as_py()), marks)))
                    scores[i] = 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names=[*batch.schema.names, "score"])

    return score


def score_texts(texts: DataFrame, model: tuple | None) -> DataFrame:
    """Add ``score`` to a table with a column ``text``."""
    small_batches(texts.sparkSession)
    schema = T.StructType([*texts.schema.fields, T.StructField("score", T.DoubleType())])
    return texts.mapInArrow(_score(texts.sparkSession.sparkContext.broadcast(model)), schema)


def training_rows(docs: DataFrame, labels: DataFrame) -> list[tuple[int, str, int]]:
    """(id, text, label) of a bounded sample of the labelled rows (doc_id, toxic) of each label."""
    labels = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("label"))
    parts = []
    for label, rows in ((1, TOXIC_ROWS), (0, ORDINARY_ROWS)):
        own = labels.filter(F.col("label") == label)
        n = own.count()
        draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
        parts.append(own.filter(draw * n < 2.0 * rows).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows))  # at most ``rows`` rows
    ids = parts[0].union(parts[1])
    found = docs.select("doc_id", "text").filter("text is not null").join(F.broadcast(ids), "doc_id")
    out, left = [], {0: TRAIN_CHARS, 1: TRAIN_CHARS}
    for r in found.toLocalIterator():
        if len(r["text"]) <= left[r["label"]]:
            left[r["label"]] -= len(r["text"])
            out.append((r["doc_id"], r["text"], r["label"]))
    return sorted(out)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(training_rows(docs, read(spark, sf_dir, "labels").filter(~held("doc_id", 3, 1))))
    out = score_texts(docs.withColumn("held_out", held("doc_id", 3, 1)), model)
    return out.select("doc_id", "held_out", "score", (F.col("score") >= DECIDE).cast("int").alias("predicted"))
