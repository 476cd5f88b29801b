from __future__ import annotations

import random
import zlib

from creditloom.llm import language_id, toxicity
from tests.llm.cases import awkward, frame


def phrases(text, sample):
    n = at = 0
    while at < len(text):
        size = 1
        while at + size < len(text) and text[at:at + size + 1] in sample:
            size += 1
        at, n = at + size, n + 1
    return n


def test_phrases_match_a_search_for_substrings():
    rnd = random.Random(1)
    sample = " " + " ".join("".join(rnd.choice("abcd") for _ in range(rnd.randint(1, 9))) for _ in range(200)) + " "
    other = sample[:40]
    parser = language_id.Parser((("a", sample), ("b", other)))
    words = ["".join(rnd.choice("abcdeé") for _ in range(rnd.randint(1, 30))) for _ in range(300)]
    got = parser.phrases(words)
    assert [tuple(x) for x in got] == [(phrases(" " + w, sample), phrases(" " + w, other)) for w in words]


def test_language_on_awkward_rows(spark):
    docs = frame(spark)
    samples = (("en", " the of and stone it "), ("fr", " née le la les émile zola "))
    got = language_id.predict(docs.select("doc_id", "text"), samples).collect()
    assert len(got) == len(awkward())
    for r in got:
        assert 0 <= r.score <= 1
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in r.text or ""))
    assert {r.lang_pred for r in got if r.doc_id == 7} == {"fr"}
    assert {r.lang_pred for r in language_id.predict(docs.select("text"), ()).collect()} == {"und"}
    assert language_id.predict(frame(spark, []).select("text"), samples).count() == 0
    assert language_id.training_samples(frame(spark, []).select("doc_id", "text", "lang")) == ()
    assert [k for k, _ in language_id.training_samples(docs.select("doc_id", "text", "lang"))] == ["en"]


def test_language_of_held_out_documents(spark, small):
    got = {r.doc_id: r for r in language_id.query(spark, small).collect()}
    docs = spark.read.parquet(f"{small}/documents.parquet").collect()
    assert len(got) == len(docs)
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items())
    held = [(got[d.doc_id].lang_pred == d.lang) for d in docs if got[d.doc_id].held_out]
    assert sum(held) >= 0.97 * len(held)


def test_toxicity_learns_a_planted_vocabulary(spark):
    rnd = random.Random(2)
    parts = ["the", "of", "ber", "tion", "er", "re", "on", "sha", "wh"]

    def text(toxic):
        words = ["".join(rnd.choice(parts) for _ in range(rnd.randint(1, 3))) for _ in range(rnd.randint(40, 200))]
        for _ in range(4 * toxic):
            words.insert(rnd.randrange(len(words)), rnd.choice(["grumblefig", "snottlewax", "vilepox"]))
        return " ".join(words)

    rows = [(i, text(i % 4 == 0), int(i % 4 == 0)) for i in range(600)]
    model = toxicity.fit(rows[:400])
    scored = toxicity.score_texts(spark.createDataFrame(rows[400:], "id long, text string, label int"), model).collect()
    assert all(0 <= r.score <= 1 for r in scored)
    assert sum((r.score >= 0.7) == bool(r.label) for r in scored) >= 0.93 * len(scored)
    assert toxicity.fit(rows[:1]) is None
    got = toxicity.score_texts(frame(spark).select("doc_id", "text"), model).collect()
    assert len(got) == len(awkward()) and all(0 <= r.score <= 1 for r in got)
    none = toxicity.score_texts(frame(spark).select("text"), None).collect()
    assert {r.score for r in none} == {0.0}
    assert toxicity.score_texts(frame(spark, []).select("text"), model).count() == 0


def test_toxicity_query_beats_chance_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    got = toxicity.query(spark, folder).collect()
    assert len(got) == 1000 and all(r.predicted == (r.score >= 0.7) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    held = [(r.score, labels[r.doc_id]) for r in got if r.held_out and r.doc_id in labels]
    bad, good = [s for s, y in held if y], [s for s, y in held if not y]
    assert sum((a > b) + 0.5 * (a == b) for a in bad for b in good) / (len(bad) * len(good)) > 0.8
