"""Small tables with the awkward rows that every operator must take."""

from __future__ import annotations

import random

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, text_sha256 string, component_id long"


def prose(seed: int, words: int) -> str:
    rnd = random.Random(seed)
    parts = ["the", "of", "and", "ber", "tion", "er", "re", "on", "sha", "über", "née", "stone", "wh", "it"]
    out = []
    while len(out) < words:
        n = rnd.randint(2, 14)
        s = " ".join("".join(rnd.choice(parts) for _ in range(rnd.randint(1, 3))) for _ in range(n))
        out.append(s.capitalize() + rnd.choice([".", ".", "!", ".\n"]))
    return " ".join(out[:max(1, words // 8)])


def awkward() -> list[tuple]:
    """Rows of ``COLUMNS``: nulls in any column, empty, blank and very long texts, ties, repeated rows, clashing names."""
    long = prose(1, 3000)
    texts = [None, "", " ", "\n\n", "x", "One.", "One.", "Émile zola", prose(2, 200), prose(2, 200), prose(2, 200) + " End of it.", prose(3, 400), long, long + " tail", "a" * 5000,
             "É" * 700, "\u3000wide\u3000blank ", "12 34 56", "<|endoftext|> marks", prose(3, 400).replace("the", "thy", 1), "tab\tand\r\nreturn", "."]
    rows = [(i, t, None if i % 5 == 0 else "en", None if i % 3 == 0 else "s", None, i % 2 == 0, "clash", 99) for i, t in enumerate(texts)]
    return [*rows, rows[8], (None, prose(2, 200), None, None, None, None, None, None), (None, None, None, None, None, None, None, None)]


def frame(spark, rows=None):
    return spark.createDataFrame(awkward() if rows is None else rows, COLUMNS)


def documents(spark, folder: str) -> list:
    return spark.read.parquet(f"{folder}/documents.parquet").collect()
