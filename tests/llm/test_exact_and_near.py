from __future__ import annotations

import hashlib
import re
from collections import defaultdict

import numpy as np

from creditloom.llm import exact_dedup, near_dedup
from tests.llm.cases import awkward, frame


def test_filters_merge_losslessly():
    rnd = np.random.default_rng(1)
    fps = rnd.integers(-(2**63), 2**63 - 1, 3000)
    fps = np.concatenate((fps, fps[:700], fps[:50], [0, -1, -1]))
    for bits in (0, 3):
        import pandas as pd
        import pyarrow as pa
        runs = defaultdict(list)
        for part in np.array_split(fps, 5):
            for batch in exact_dedup.build_filters(bits)(pa.RecordBatch.from_pydict({"fp": pa.array(x)}) for x in np.array_split(part, 3)):
                r = batch.to_pylist()[0]
                runs[r["bucket"]].append(r)
        got = pd.concat([exact_dedup.merge_filters(bits)(pd.DataFrame(r)) for r in runs.values()])
        values, counts = np.unique(fps, return_counts=True)
        assert dict(zip(got["fp"], got["n"])) == {v: n for v, n in zip(values, counts) if n > 1}


def test_exact_groups_on_awkward_rows(spark):
    rows = awkward()
    groups = defaultdict(list)
    for r in rows:
        groups[r[1] or ""].append(r[0])
    want = []
    for doc, text, *_ in rows:
        ids = [i for i in groups[text or ""] if i is not None]
        keep = max(ids) if ids else None
        want.append((doc, keep, len(groups[text or ""]), doc == keep, hashlib.sha256((text or "").encode()).hexdigest()))
    got = [(r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup.exact_groups(frame(spark)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_exact_groups_without_broadcast(spark, monkeypatch):
    """The way beyond the broadcast bound gives the same rows."""
    from creditloom.llm import common
    want = sorted(exact_dedup.exact_groups(frame(spark)).collect(), key=str)
    monkeypatch.setattr(common, "BROADCAST_ROWS", -1)
    assert sorted(exact_dedup.exact_groups(frame(spark)).collect(), key=str) == want


def sets(rows, k):
    out = {}
    for doc, text in rows:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
        out[doc] = {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set())
    return out


def components(rows, k):
    s = sets(rows, k)
    ids = sorted(s)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for n, a in enumerate(ids):
        for b in ids[n + 1:]:
            if s[a] and s[b] and 100 * len(s[a] & s[b]) >= 80 * len(s[a] | s[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(s[i]), find(i)) for i in ids}


def chained(n):
    """Texts of which each is near the next, and only the next."""
    words = [f"w{i}" for i in range(400)]
    return [(i, " ".join(words[i * 5:i * 5 + 60])) for i in range(n)]


def test_near_duplicates_on_awkward_rows(spark):
    rows = [r for r in awkward() if r[0] is not None]
    for k in (2, 5):
        want = components([r[:2] for r in rows], k)
        got = near_dedup.near_duplicates(frame(spark, rows), words=k).collect()
        assert len(got) == len(rows)
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
        assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_near_duplicates_follow_chains_and_stars(spark):
    base = [f"v{i}" for i in range(100)]
    star = [(200 + i, " ".join(base[:i] + [f"x{i}"] + base[i + 1:])) for i in range(40)]
    rows = [*chained(40), *star, (300, "alone in the world")]
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=2).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == components(rows, 2)


def test_cells_without_fitting_members():
    import pyarrow as pa
    sig = bytes(range(near_dedup.BINS))
    rows = {"key": [1, 1, 1, 2, 2], "band": [0] * 5, "block": [0] * 5, "part": [0] * 5, "id": [5, 6, 5, 7, 8], "component": [5, 6, 5, 7, 7], "n_shingles": [10, 90, 10, 5, 5],
            "sig": [sig] * 5, "centre": [False, False, True, False, True]}
    got = [b.to_pydict() for b in near_dedup._agreeing(80)(iter([pa.RecordBatch.from_pydict(rows)]))]
    assert [b["u"] for b in got] == [[], []]
    rows["n_shingles"][1] = 9
    assert [b.to_pydict() for b in near_dedup._agreeing(80)(iter([pa.RecordBatch.from_pydict(rows)]))][0] == {"u": [6], "v": [5]}


def test_pairs_leave_the_first_bucket_in_which_their_keys_agree(spark):
    """Signatures that agree by chance in bands before the first common bucket lose no pair, and none leaves twice."""
    sig, n = bytes(range(near_dedup.BINS)), near_dedup.BINS // near_dedup.ROWS
    keys = {i: [-i if b < 5 else b << 40 for b in range(n)] for i in (1, 2)}
    members = spark.createDataFrame([(b << 40, b, i, 10) for b in range(5, n) for i in keys], "key long, band int, id long, n_shingles long")
    sigs = spark.createDataFrame([(i, bytearray(sig), k) for i, k in keys.items()], "id long, sig binary, bands array<long>")
    comps = spark.createDataFrame([], "u long, component long")
    assert [tuple(r) for r in near_dedup._mixed_stars(members, sigs, comps, 0, 80).collect()] == [(2, 1)]


def test_empty_table(spark):
    assert near_dedup.near_duplicates(frame(spark, [])).count() == 0
    assert exact_dedup.exact_groups(frame(spark, [])).count() == 0


def test_densified_bins_agree_as_often_as_sets():
    rnd = np.random.default_rng(2)
    for n in (6, 60, 600):
        agree = []
        for _ in range(60):
            pool = rnd.integers(0, 2**63, 2 * n).astype(np.uint64)
            a, b = pool[:n], np.concatenate((pool[n // 4:n], pool[n:n + n // 4]))
            x, y = near_dedup.signature(np.unique(a)), near_dedup.signature(np.unique(b))
            agree.append((x == y).mean())
        exact = (n - n // 4) / (n + n // 4)
        assert abs(np.mean(agree) - exact) < 0.08
