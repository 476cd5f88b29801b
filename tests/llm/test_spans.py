from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import pytest

from creditloom.llm import line_dedup, sentence_dedup, suffix_dedup
from tests.llm.cases import awkward, frame, prose


def brute_windows(rows, size):
    """(n_bytes, n_removed, n_spans, sha256) of each row by counting every window."""
    raw = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(b[p:p + size] for _, b in raw for p in range(len(b) - size + 1))
    out = []
    for i, b in raw:
        mark = bytearray(len(b))
        for p in range(len(b) - size + 1):
            if seen[b[p:p + size]] > 1:
                mark[p:p + size] = b"\x01" * size
        out.append((i, len(b), sum(mark), len(re.findall(b"\x01+", bytes(mark))), hashlib.sha256(bytes(x for x, m in zip(b, mark) if not m)).hexdigest()))
    return sorted(out, key=str)


def got_windows(df):
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in suffix_dedup.remove_repeats(df).collect()), key=str)


def test_windows_on_awkward_rows(spark):
    assert got_windows(frame(spark)) == brute_windows([r[:2] for r in awkward()], 200)


@pytest.mark.parametrize("segment,small", [(1 << 20, 1000), (300, 1)])
def test_windows_in_segments_and_hot_groups(spark, monkeypatch, segment, small):
    monkeypatch.setattr(suffix_dedup, "SMALL", small)
    monkeypatch.setattr(suffix_dedup, "SEGMENT", segment)
    rnd = random.Random(5)
    base = ["".join(rnd.choice("ab cdé") for _ in range(500)) for _ in range(4)]
    rows = [(i, base[i % 4][rnd.randint(0, 200):][:rnd.randint(150, 400)] + "z" * rnd.choice([0, 0, 450]) + "".join(rnd.choice("qwe") for _ in range(rnd.randint(0, 80)))
             + base[rnd.randint(0, 3)][rnd.randint(0, 200):]) for i in range(30)]
    rows += [(100, ""), (101, None), (102, "z" * 199), (103, "z" * 200)]
    assert got_windows(spark.createDataFrame(rows, "doc_id long, text string")) == brute_windows(rows, 200)


def test_anchors_cover_every_window_once():
    import numpy as np
    rnd = np.random.default_rng(3)
    for n in (0, 199, 200, 201, 3000):
        data = rnd.integers(0, 4, n).astype(np.uint8)
        covered = [p for _, _, a, lo, hi in suffix_dedup.anchors(data) for x, y in zip(lo, hi) for p in range(x, y + 1)]
        assert covered == list(range(max(0, n - 199)))


def brute_sentences(rows):
    """(doc_id, n_removed, kept_text): spans in order of id and place, all but the first of equal ones removed."""
    pieces = {i: re.findall(r"[^.!?\n]*[.!?\n]+[ \t\r]*|[^.!?\n]+", t or "") for i, t in rows}
    first, gone = {}, {i: set() for i in pieces}
    for k, least in ((3, 8), (2, 30), (1, 50)):
        for i in sorted(pieces):
            for at in range(len(pieces[i]) - k + 1):
                run = tuple(p.strip(" \t\r\n") for p in pieces[i][at:at + k])
                if sum(len(s.encode().split()) for s in run) >= least and first.setdefault((k, run), (i, at)) != (i, at):
                    gone[i] |= set(range(at, at + k))
    return {i: (len(gone[i]), "".join(p for n, p in enumerate(pieces[i]) if n not in gone[i])) for i in pieces}


def test_sentence_spans_on_awkward_rows(spark):
    passage = prose(11, 500)
    rows = [r for r in awkward() if r[0] is not None]
    rows = list({r[0]: r for r in rows}.values()) + [(500 + i, f"{prose(600 + i, 60)}\n{passage}\n{prose(700 + i, 60)}", *[None] * 6) for i in range(12)]
    want = brute_sentences([r[:2] for r in rows])
    got = sentence_dedup.remove_repeated_spans(frame(spark, rows)).collect()
    assert {r.doc_id: (r.n_removed, r.kept_text or "") for r in got} == want
    texts = {r.doc_id: r.kept_text for r in got}
    assert passage.strip() in texts[500] and all(passage[:200] not in texts[500 + i] for i in range(1, 12))


def test_sentence_spans_of_repeated_and_empty_input(spark):
    rows = [r for r in awkward() if r[0] in (8, None)]
    got = sentence_dedup.remove_repeated_spans(frame(spark, rows)).collect()
    assert len(got) == len(rows) and {r.n_removed for r in got if r.doc_id == 8} == {0}
    assert sentence_dedup.remove_repeated_spans(frame(spark, [])).count() == 0


def brute_lines(rows, least, copied):
    def key(line):
        t = re.sub(r"[\x09-\x0D\x20]+", " ", line).strip(" ")
        return re.sub(r"[^ ]*(?:[0-9@]|://)[^ ]*", "<*>", t)

    n = Counter(k for _, t in rows if t is not None for k in {key(x) for x in t.split("\n")} if k)
    out = []
    for i, t in rows:
        lines = t.split("\n") if t else []
        drop = [bool(key(x)) and n[key(x)] >= least for x in lines]
        shared, size = sum(len(x.encode()) for x, d in zip(lines, drop) if d), sum(len(x.encode()) for x in lines if key(x))
        cut = 0 < shared <= copied * size
        out.append((i, len(lines), sum(drop) if cut else 0, "\n".join(x for x, d in zip(lines, drop) if not (d and cut)) if t is not None else None))
    return sorted(out, key=str)


def test_line_templates(spark):
    rows = awkward() + [(900 + i, f"Unique words number {prose(i, 40)}\nPosted on 2024-01-{i:02d} by user{i}@mail.example\n\nAll   rights reserved.\nSee https://x.example/{i} now", *[None] * 6) for i in range(12)]
    got = line_dedup.drop_lines(frame(spark, rows))
    assert got.columns[:8] == frame(spark, rows).columns
    found = sorted(((r.doc_id, r["__lines"], r["__dropped"], r.text) for r in got.collect()), key=str)
    assert found == brute_lines([r[:2] for r in rows], line_dedup.MIN_DOCS, line_dedup.COPIED)
    assert any(x[2] for x in found)


def test_lines_of_empty_table(spark):
    assert line_dedup.drop_lines(frame(spark, [])).count() == 0
    assert suffix_dedup.remove_repeats(frame(spark, [])).count() == 0
