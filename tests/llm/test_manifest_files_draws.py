from __future__ import annotations

import hashlib
import math
import random
import uuid
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from pyarrow import fs
from tokenizers import Tokenizer

from creditloom.llm import merkle, resample, token_files
from creditloom.llm.common import read, shared_dir
from creditloom.llm.words import folded
from tests.llm.cases import awkward, frame, prose

PATH = public_tokenizers.path("byte_bpe_50k.json")
WORDS = bytes(b if b >= 0x80 or 48 <= b <= 57 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def sha(s: str) -> str:
    return hashlib.sha256(s.encode()).hexdigest()


def leaf(row, text):
    values = [row["doc_id"], row["source"], row["lang"], row["n_chars"], text]
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def climb(nodes):
    """Root and, for each node, its path of (left, right) siblings."""
    paths, at, level = [[] for _ in nodes], list(range(len(nodes))), list(nodes)
    while len(level) > 1:
        for i in range(len(nodes)):
            lo = at[i] // 3 * 3
            paths[i].append(("".join(level[lo:at[i]]), "".join(level[at[i] + 1:lo + 3])))
            at[i] //= 3
        level = [sha("".join(level[i:i + 3])) for i in range(0, len(level), 3)]
    return level[0], paths


def brute_manifest(rows):
    groups = defaultdict(list)
    for r in rows:
        changed = r["text"] is not None and r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 2 == 0
        text = r["text"].replace("\n", "") if changed else r["text"]
        key = (r["source"] is not None, (r["source"] or "").encode())
        groups[key].append((r["doc_id"] is not None, r["doc_id"] or 0, leaf(r, r["text"]), leaf(r, text), r["doc_id"]))
    names = sorted(groups)
    sub = {k: climb([x[2] for x in sorted(groups[k])]) for k in names}
    root, tops = climb([sub[k][0] for k in names])
    out = []
    for k, above in zip(names, tops):
        for (_, _, own, given, doc_id), path in zip(sorted(groups[k]), sub[k][1]):
            fold = given
            for lft, rgt in path + above:
                fold = sha(lft + fold + rgt)
            out.append((doc_id, own, sub[k][0], root, sha("".join(a + b for a, b in path + above)), fold, fold == root))
    return out


def key(row):
    return tuple((x is not None, str(x)) for x in row)


MANIFEST = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9, 10, 28, 120])
def test_manifest_of_groups_of_many_sizes(spark, n, monkeypatch):
    monkeypatch.setattr(merkle, "DEPTH", 2)  # blocks of nine, so that roots recurse
    for name, old in (("_LEVELS", merkle._LEVELS), ("_OWN_PATH", merkle._OWN_PATH)):
        monkeypatch.setattr(merkle, name, old.replace("sequence(1, 5)", "sequence(1, 2)").replace("least(5, ", "least(2, ").replace("sequence(0, 4)", "sequence(0, 1)"))
    rnd = random.Random(n)
    rows = [(i, f"a\nb {i}", "en", rnd.choice(["s", "t", "ß"]) if i % 2 else "hot", i, True, "", i) for i in range(n)]
    docs = frame(spark, rows)
    got = merkle.verified_documents(docs).select(*MANIFEST).collect()
    assert sorted(map(tuple, got), key=key) == sorted(brute_manifest(docs.collect()), key=key)


def test_manifest_of_awkward_rows_and_of_none(spark):
    docs = frame(spark)
    got = merkle.verified_documents(docs).select(*MANIFEST).collect()
    assert sorted(map(tuple, got), key=key) == sorted(brute_manifest(docs.collect()), key=key)
    assert merkle.verified_documents(frame(spark, [])).collect() == []


def test_manifest_of_the_whole_table(spark, small):
    got = merkle.query(spark, small).select(*MANIFEST).collect()
    assert sorted(map(tuple, got), key=key) == sorted(brute_manifest(read(spark, small, "documents").collect()), key=key)


def shared(spark) -> str:
    return f"file://{shared_dir(spark).removeprefix('file://')}/tokens-{uuid.uuid4().hex}"


def brute_tokens(rows):
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    out, at = [], 0
    for r in sorted(rows, key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0)):
        ids = t.encode(r["text"] or "", add_special_tokens=False).ids + [2]
        out.append((r["doc_id"], at, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        at += len(ids)
    return out


def test_token_files_of_a_whole_table(spark, small):
    rows = read(spark, small, "documents").collect()
    got = token_files.query(spark, small).collect()
    assert sorted(map(tuple, got)) == sorted(brute_tokens(rows))


def test_token_files_of_awkward_rows(spark):
    folder = shared(spark)
    docs = frame(spark).coalesce(1)
    shards = token_files.write_files(docs, folder, PATH, length=16)
    got = token_files.read_digests(shards, folder).collect()
    assert sorted(map(tuple, got), key=key) == sorted(brute_tokens(docs.collect()), key=key)
    empty = shared(spark)
    assert token_files.read_digests(token_files.write_files(frame(spark, []), empty, PATH), empty).collect() == []


def test_sequences_are_views_of_the_file_and_masks_mark_the_padding(spark):
    folder = shared(spark).removeprefix("file://")
    docs = frame(spark, [(i, prose(i, 900), "en", "s", 1, True, "", 1) for i in range(40)])
    for s in token_files.write_files(docs, f"file://{folder}", PATH, length=8).collect():
        path = f"{folder}/{s['name']}.sequences.arrow"
        sequences, before = token_files.SequenceFile(fs.LocalFileSystem(), path), pa.total_allocated_bytes()
        flat, seen = [], 0
        for i in range(s["sequences"]):
            ids, bits = sequences.sequence(i)
            assert len(ids) == 8 and len(bits) == 1 and not ids.flags.owndata and not bits.flags.owndata
            mask = np.unpackbits(bits, bitorder="little")
            flat.extend(ids[mask == 1].tolist())
            seen += int(mask.sum())
        assert seen == s["ids"] and pa.total_allocated_bytes() - before < 4096  # nothing was copied
        t = Tokenizer.from_file(PATH)
        index = pa.ipc.open_file(pa.memory_map(f"{folder}/{s['name']}.documents.arrow")).read_all().to_pylist()
        texts = {r["doc_id"]: r["text"] for r in docs.collect()}
        for d in index:
            assert flat[d["start"]:d["start"] + d["n_tokens"]] == t.encode(texts[d["doc_id"]], add_special_tokens=False).ids + [2]


def test_hashes_and_crcs_of_strings_at_any_place():
    rnd = random.Random(5)
    raw = bytes(rnd.randrange(256) for _ in range(400))
    b = resample.Bytes(raw)
    for n in [*range(1, 40), 63, 64, 65, 90]:
        at = np.arange(0, len(raw) - n, 7)
        assert b.hashes(at, n).tolist() == [xxhash.xxh64_intdigest(raw[i:i + n]) for i in at]
        assert b.crc32s(at, n).tolist() == [zlib.crc32(raw[i:i + n]) for i in at]
        assert b.equal(at, at, n).all() and b.equal(at[:-1], at[1:], n).tolist() == [raw[i:i + n] == raw[i + 7:i + 7 + n] for i in at[:-1]]


def features(text):
    words = (text or "").encode().translate(WORDS).split()
    return words, [b" ".join(words[i:i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]


@pytest.mark.parametrize("size", [40, 1000, 1 << 20])
def test_table_counts_each_gram_once_however_texts_are_cut(size):
    texts = [folded((r[1] or "").encode()) for r in awkward()]
    got, want = np.zeros(997, dtype=np.int64), Counter(zlib.crc32(f) % 997 for r in awkward() for f in features(r[1])[1])
    for group in resample.pieces(texts, size):
        got += resample.grams(group, 997)[0].totals()
    assert {i: n for i, n in enumerate(got.tolist()) if n} == want


def test_table_verifies_bytes_where_keys_collide(monkeypatch):
    monkeypatch.setattr(resample.Bytes, "hashes", lambda self, at, length: np.full(len(at), 7, dtype=np.uint64))
    table, owner, _ = resample.grams([(0, b"a b a c b a", 0)], 10_000)
    grams = Counter(features("a b a c b a")[1])
    assert sorted(table.count[table.count > 0].tolist()) == sorted(grams.values()) and len(owner) == sum(grams.values())


def brute_draws(docs, target, percent=5, least=20):
    s, t = Counter(), Counter()
    for counts, rows in ((s, docs), (t, target)):
        for r in rows:
            counts.update(zlib.crc32(f) % 10_000 for f in features(r["text"])[1])
    ns, nt = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1.0) * (ns + 10_000.0) / ((s[b] + 1.0) * (nt + 10_000.0)))) for b in range(10_000)]
    rows = []
    for r in docs:
        words, grams = features(r["text"])
        h = int(sha(f"42:{'' if r['doc_id'] is None else r['doc_id']}")[:8], 16)
        weight = sum(gain[zlib.crc32(f) % 10_000] for f in grams)
        rows.append([r["doc_id"], len(grams), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words)])
    may = sorted((r for r in rows if r[5] >= least), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    for i, r in enumerate(may[:percent * len(may) // 100]):
        r[4] = i + 1
    return [tuple(r[:5]) for r in rows]


def test_draws_of_a_whole_table(spark, small):
    got = resample.query(spark, small).collect()
    want = brute_draws(read(spark, small, "documents").collect(), read(spark, small, "benchmark").collect())
    assert sorted(map(tuple, got)) == sorted(want, key=lambda r: r[0]) and sum(r["rank"] is not None for r in got) > 0


def test_draws_of_awkward_rows(spark):
    docs = frame(spark)
    for target in (frame(spark, awkward()[:12]), frame(spark, [])):
        got = resample.draws(docs, target, percent=50).select("doc_id", "n_features", "weight", "score", "rank").collect()
        assert sorted(map(tuple, got), key=key) == sorted(brute_draws(docs.collect(), target.collect(), 50), key=key)
    assert resample.draws(frame(spark, []), docs).collect() == []
