"""Language identification by cross-parsing entropy.

For each language a suffix automaton of labelled text gives the longest match at any place of a text. A text is parsed
phrase by phrase, each as long as the language's text allows, and the language that needs the fewest normalised phrases
wins: ``phrases * log2(training characters) / characters parsed``, an estimate of the cross entropy in bits.

Texts are lower-cased and parsed as their words (runs of letters), each with a blank before it; a phrase does not cross a
word, so that each distinct word of a batch is parsed once, all of them together, letter by letter. Words of over
``WORD`` letters are parsed in pieces. The automata hold at most ``TRAIN_CHARS`` characters a language.

Defined results: a text that is null or has no letter is ``und`` with score 0; ties go to the first language by name; with no
training text all are ``und``; repeated rows get the same answer; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from creditloom.llm.common import held, model, read, sized, small_batches

#: Characters of labelled text in a language's automaton, and documents per language that are looked at for them.
TRAIN_CHARS, TRAIN_DOCS = 40_000, 200
WORD = 60
UNKNOWN = "und"
_LETTERS = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> list[str]:
    """Lower-cased runs of letters."""
    return _LETTERS.findall(text.lower()) if text else []


def _pieces(word: str) -> list[str]:
    return [word] if len(word) <= WORD else [word[i:i + WORD] for i in range(0, len(word), WORD)]


def substring_moves(text: str) -> list[dict[str, int]]:
    """Transitions of the suffix automaton of ``text``; state 0 is the start. Every path spells a substring."""
    moves, link, length, last = [{}], [-1], [0], 0
    for ch in text:
        new = len(moves)
        moves.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and ch not in moves[p]:
            moves[p][ch] = new
            p = link[p]
        if p >= 0:
            q = moves[p][ch]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                clone = len(moves)
                moves.append(dict(moves[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                link[q] = link[new] = clone
                while p >= 0 and moves[p].get(ch) == q:
                    moves[p][ch] = clone
                    p = link[p]
        last = new
    return moves


class Parser:
    """Counts phrases of words in each language. ``samples`` is (language, training text) sorted by language."""

    def __init__(self, samples: tuple[tuple[str, str], ...]) -> None:
        self.languages = [lang for lang, _ in samples]
        letters = sorted(set("".join(t for _, t in samples)))
        self.codes = np.zeros(0x110000, dtype=np.uint8 if len(letters) < 255 else np.uint32)
        self.codes[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        self.tables, self.bits = [], []
        for _, text in samples:
            moves = substring_moves(text)
            table = np.zeros((len(moves), len(letters) + 1), dtype=np.int32)  # 0: no such move; nothing moves to the start
            for state, to in enumerate(moves):
                for c, target in to.items():
                    table[state, self.codes[ord(c)]] = target
            self.tables.append(table)
            self.bits.append(np.log2(max(2, len(text))))

    def phrases(self, words: list[str]) -> np.ndarray:
        """Phrases of each word (with a blank before it), one column per language."""
        order = sorted(range(len(words)), key=lambda i: -len(words[i]))
        lengths = np.array([len(words[i]) + 1 for i in order], dtype=np.int64)
        codes = self.codes[np.frombuffer("".join([" " + words[i] for i in order]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
        start = np.cumsum(lengths) - lengths
        live = [int(np.searchsorted(-lengths, -j, side="left")) for j in range(int(lengths[0]) if len(lengths) else 0)]
        out = np.ones((len(words), len(self.tables)), dtype=np.int32)
        for lang, table in enumerate(self.tables):
            state, count, flat, width = np.zeros(len(words), dtype=np.int64), np.ones(len(words), dtype=np.int32), table.ravel(), table.shape[1]
            for j, n in enumerate(live):
                c = codes[start[:n] + j]
                to = flat[state[:n] * width + c]
                stuck = to == 0
                if j:
                    count[:n] += stuck | (state[:n] == 0)  # a letter that the language lacks is a phrase by itself
                to[stuck] = table[0][c[stuck]]
                state[:n] = to
            out[order, lang] = count
        return out

    def batch(self, texts: list[str | None]) -> list[tuple[str, float, float]]:
        """(language, score, bits per character) of each text."""
        counts = [Counter(w for word in words_of(t) for w in _pieces(word)) for t in texts]
        number: dict[str, int] = {}
        for c in counts:
            for w in c:
                number.setdefault(w, len(number))
        if not number or not self.tables:
            return [(UNKNOWN, 0.0, 0.0)] * len(texts)
        words = list(number)
        phrases = self.phrases(words)
        sizes = np.array([len(w) + 1 for w in words], dtype=np.int64)
        out = []
        for c in counts:
            if not c:
                out.append((UNKNOWN, 0.0, 0.0))
                continue
            at, times = np.array([number[w] for w in c]), np.array(list(c.values()), dtype=np.int64)
            bits = (times @ phrases[at]) * self.bits / int(times @ sizes[at])
            best = int(np.argmin(bits))
            rest = np.delete(bits, best)
            out.append((self.languages[best], float(1 - bits[best] / rest.min()) if len(rest) else 1.0, float(bits[best])))
        return out


def _parser(samples: tuple[tuple[str, str], ...]) -> Parser:
    return model(("parser", samples), lambda: Parser(samples))


def training_samples(labelled: DataFrame, chars: int = TRAIN_CHARS, docs: int = TRAIN_DOCS) -> tuple[tuple[str, str], ...]:
    """(language, text) from a table (doc_id, text, lang): at most ``docs`` rows and ``chars`` characters of each language.

    Rows are drawn by a hash of the id, evenly from all of the table; what reaches the driver is bounded by the number of
    languages.
    """
    labelled = labelled.filter("lang is not null and text is not null")
    sizes = labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("__n"))
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    # twice the rows wanted, so that a hot language is thinned before its rows are ordered
    drawn = labelled.join(sized(sizes, sizes.count()), "lang").filter(draw * F.col("__n") < 2.0 * docs)
    first = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    # the sample is full at ``chars`` characters, so no row can add more than that
    rows = drawn.withColumn("__i", F.row_number().over(first)).filter(F.col("__i") <= docs).select("lang", "__i", F.substring("text", 1, chars).alias("text"))
    texts: dict[str, str] = {}
    for r in sorted(rows.toLocalIterator(), key=lambda r: (r["lang"], r["__i"])):
        have = texts.get(r["lang"], " ")
        if len(have) < chars:
            texts[r["lang"]] = (have + " ".join(words_of(r["text"])) + " ")[:chars]
    return tuple((k, v) for k, v in sorted(texts.items()) if v.strip())


def _predict(shared):
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = _parser(shared.value)
        for batch in batches:
            found = parser.batch(batch.column("text").to_pylist())
            lang, score, bits = zip(*found) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(bits, pa.float64())],
                                             names=[*batch.schema.names, "lang_pred", "score", "bits"])

    return predict


def predict(texts: DataFrame, samples: tuple[tuple[str, str], ...]) -> DataFrame:
    """Add lang_pred, score (how much fewer phrases than the next language, 0 to 1) and bits per character to a table with
    a column ``text``."""
    small_batches(texts.sparkSession)
    shared = texts.sparkSession.sparkContext.broadcast(samples)
    added = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("bits", T.DoubleType())]
    return texts.mapInArrow(_predict(shared), T.StructType([*texts.schema.fields, *added]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    samples = training_samples(docs.filter(~held("doc_id", 4, 2)).select("doc_id", "text", "lang"))
    return predict(docs.select("doc_id", "text", held("doc_id", 4, 2).alias("held_out")), samples).drop("text")
