from __future__ import annotations

import hashlib
import re

from creditloom.llm import decontaminate, url_filter
from tests.llm.cases import awkward, frame, prose

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_hits(rows, items, window=10):
    grams = {}
    for item, text in items:
        w = WORD.findall((text or "").encode().lower())
        n = min(window, len(w))
        for p in range(len(w) - n + 1 if n else 0):
            grams.setdefault(tuple(w[p:p + n]), set()).add(item)
    out = []
    for doc, text in rows:
        w = WORD.findall((text or "").encode().lower())
        hit, named = set(), set()
        for n in {len(g) for g in grams}:
            for p in range(len(w) - n + 1):
                found = grams.get(tuple(w[p:p + n]))
                if found:
                    hit |= set(range(p, p + n))
                    named |= {str(i) for i in found if i is not None}
        out.append((doc, len(w), len(hit), tuple(sorted(named))))
    return sorted(out, key=str)


def items_of():
    long = " ".join(prose(3, 400).split()[5:60])
    return [(1, long), (1, long), (2, "née stone, It!"), (3, None), (4, ""), (5, " ".join(prose(2, 200).split()[:30])), (None, "tab and return"), (7, "x"),
            (8, " ".join(prose(3, 400).split()[20:34]))]


def test_hits_on_awkward_rows(spark, monkeypatch):
    items = spark.createDataFrame(items_of(), "item_id long, text string")
    rows = [r[:2] for r in awkward()]
    read = lambda df: sorted(((r.doc_id, r.n_words, sum(s["last"] - s["first"] + 1 for s in r.spans), tuple(r["items"])) for r in df.collect()), key=str)
    assert read(decontaminate.contamination(frame(spark), items)) == brute_hits(rows, items_of())
    monkeypatch.setattr(decontaminate, "SHARD_WORDS", 20)
    own = list({r[0]: r for r in awkward()}.values())
    assert read(decontaminate.contamination(frame(spark, own), items)) == brute_hits([r[:2] for r in own], items_of())


def test_shards_merge_rows_that_share_an_id_one_by_one(spark, monkeypatch):
    items = spark.createDataFrame(items_of(), "item_id long, text string")
    monkeypatch.setattr(decontaminate, "SHARD_WORDS", 20)
    got = sorted(((r.doc_id, r.n_words, sum(s["last"] - s["first"] + 1 for s in r.spans), tuple(r["items"])) for r in decontaminate.contamination(frame(spark), items).collect()), key=str)
    assert got == brute_hits([r[:2] for r in awkward()], items_of())


def test_shards_cut_what_one_shard_cuts(spark, monkeypatch):
    """Coverage is judged once, overlapping passages go whole, and words that cutting joins are no hit."""
    a, b, c = ([f"{k}{i}" for i in range(20)] for k in "abc")
    texts = [(1, " ".join([*a[:12], *[f"own{i}" for i in range(16)], *b[:12]])), (2, " ".join([*[f"own{i}" for i in range(40)], *a[:15], *b[:12]])),
             (3, " ".join([*[f"own{i}" for i in range(40)], *c[:5], *a[:12], *c[5:15]])), (3, " ".join([f"own{i}" for i in range(9)])), (4, None)]
    items = spark.createDataFrame([(1, " ".join(a)), (2, " ".join(a[10:15] + b[:12])), (3, " ".join(b)), (4, " ".join(c[:10]))], "item_id long, text string")
    docs = spark.createDataFrame([(i, t, "x") for i, t in texts], "doc_id long, text string, n_words string")
    read = lambda: sorted(map(tuple, decontaminate.remove_contamination(docs, items).collect()), key=str)
    want = read()
    assert [r[0] for r in want] == [2, 3, 3, 4] and want[0][1].split() == [f"own{i}" for i in range(40)]
    monkeypatch.setattr(decontaminate, "SHARD_WORDS", 10)
    assert read() == want


def test_spans_are_cut_and_copies_of_items_go(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda"
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    rows = [(1, f"Before it, {prose(9, 100)} - {item.upper()}! After."), (2, item), (3, None), (4, "nothing here"), (4, "nothing here")]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, n_words string")
    got = decontaminate.remove_contamination(docs, items).collect()
    assert sorted((r.doc_id, r.n_words) for r in got) == [(1, "x"), (3, "x"), (4, "x"), (4, "x")]
    assert {r.text for r in got if r.doc_id == 1} == {f"Before it, {prose(9, 100)} - ! After."}
    assert decontaminate.remove_contamination(docs, items.limit(0)).count() == 5
    assert decontaminate.contamination(docs.limit(0), items).count() == 0


def test_digest_of_items(spark, small):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    want = [(d, n, h, len(i), hashlib.sha256(",".join(i).encode()).hexdigest(), h > 0) for d, n, h, i in brute_hits(docs, items)]
    got = sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontaminate.query(spark, small).collect()), key=str)
    assert got == sorted(want, key=str)


URLS = [(1, "http://a.NET/x?y#z"), (2, "https://example.net/en/1"), (3, "https://www.example.net/en"), (4, "http://badexample.net/en/"), (5, "http://x.org/fr/"), (6, "http://org/fr/q"),
        (7, "http://example.com/de/"), (8, "http://example.com/en/"), (9, None), (10, "no scheme"), (11, "http://a.net?x"), (12, "x://HOST"), (13, ""), (14, "http://b.org/frx"), (14, "http://b.org/frx"),
        (None, "ftp://u.example.com/de/a#b")]


def brute_url(url):
    host = path = ""
    if url and "://" in url:
        rest = re.split(r"[?#]", url.split("://", 1)[1], maxsplit=1)[0]
        host, slash, path = rest.partition("/")
        host, path = re.sub("[A-Z]", lambda m: m[0].lower(), host), slash + path
    fits = [(len(r), r, v) for v, r in url_filter.RULES if ("." + host).endswith("." + r.split("/")[0]) and path.startswith("/" + r.split("/", 1)[1])]
    return (host, path, max(fits)[1], max(fits)[2]) if fits else (host, path, None, None)


def test_rules_on_awkward_urls(spark):
    pages = spark.createDataFrame([(i, u, "clash", "v") for i, u in URLS], "page_id long, url string, host string, verdict string")
    got = url_filter.filter_urls(pages).collect()
    assert len(got) == len(URLS)
    seen = sorted((r.page_id, r.host, r.path, r.rule, r.verdict if r.rule else None) for r in got if r.page_id)
    assert seen == sorted(((i, *brute_url(u)) for i, u in URLS if i), key=lambda x: x[0])
    assert all(r.verdict in ("allow", "block") and 0 <= r.block_score <= 1 for r in got)
    assert url_filter.filter_urls(pages.limit(0)).count() == 0
    assert {r.verdict for r in url_filter.filter_urls(pages.filter("page_id in (9, 10)")).collect()} == {"allow"}


def test_model_learns_labelled_urls(spark):
    rows = [(f"{w}{i}.example.com", f"/{p}/{i}", v) for i in range(60) for w, p, v in (("news", "story", "allow"), ("casino", "win", "block"))]
    labelled = spark.createDataFrame(rows, "host string, path string, verdict string")
    pages = spark.createDataFrame([(1, "http://casino777.example.com/win/9"), (2, "http://news777.example.com/story/9")], "page_id long, url string")
    got = {r.page_id: r.verdict for r in url_filter.filter_urls(pages, labelled=labelled).collect()}
    assert got == {1: "block", 2: "allow"}
