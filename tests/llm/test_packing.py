from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from creditloom.llm import packing
from creditloom.llm.tokens import TokenBatches
from tests.llm.cases import awkward, frame

PATH = public_tokenizers.path("byte_bpe_50k.json")


def tokenizer():
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return t


def test_words_give_the_tokens_of_whole_texts():
    rnd = random.Random(3)
    marks = ["a", "b", "word", " ", " ", "\n", "\t", ".", "'s", "'", "x'y", "²", "ª", "×", "’", "–", "é", "日", "1", " ", "\r", "!!", "  ", "\x1c", "\x85", "\u3000", "<|endoftext|>"]
    texts = ["".join(rnd.choice(marks) for _ in range(rnd.randint(0, 25))) for _ in range(3000)] + [r[1] or "" for r in awkward()]
    want, tokens = [x.ids for x in tokenizer().encode_batch(texts, add_special_tokens=False)], TokenBatches(PATH)
    for size in (1, 9, len(texts)):
        for i in range(0, len(texts) if size > 1 else 200, size):
            ids, counts = tokens.batch(pa.array(texts[i:i + size], pa.string()))
            assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == want[i:i + size]


@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), max_size=20))
@settings(max_examples=60, deadline=None)
def test_plan_uses_each_piece_once_and_fills_without_gaps(counts):
    filled, used = defaultdict(list), Counter()
    for length, lo, hi, first, times, copies, offset in packing.plan(counts, 64):
        assert lo == used[length] and hi - lo == times * copies
        used[length] += hi - lo
        for j in range(hi - lo):
            filled[first + j % times].append((offset + j // times * length, length))
    assert used == Counter(counts)
    assert sorted(filled) == list(range(len(filled)))
    for pieces in filled.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 64


def test_closest_sum_is_the_best():
    from itertools import product
    rnd = random.Random(4)
    for _ in range(50):
        counts = {rnd.randint(1, 20): rnd.randint(1, 3) for _ in range(4)}
        room = rnd.randint(0, 40)
        best = max(s for s in (sum(k * n for k, n in zip(counts, c)) for c in product(*(range(v + 1) for v in counts.values()))) if s <= room)
        used = packing._closest(counts, room)
        assert sum(k * n for k, n in used.items()) == best and all(n <= counts[k] for k, n in used.items())


def check(rows, docs):
    """Pieces tile the documents, carry the right ids, and fill the sequences without gaps; the share that is filled."""
    t = tokenizer()
    want = Counter()
    for doc, text, *_ in docs:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], dtype="<u4")
        for at in range(0, len(ids), 1024):
            piece = ids[at:at + 1024]
            want[(doc, at, len(piece), zlib.crc32(piece.tobytes()), len(ids))] += 1
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows) == want
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    assert sorted(sequences) == list(range(len(sequences)))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 1024
    return sum(r.length for r in rows) / (1024 * max(1, len(sequences)))


def test_awkward_rows_round_trip(spark):
    check(packing.packed_documents(frame(spark), PATH).collect(), awkward())
    assert packing.packed_documents(frame(spark, []), PATH).count() == 0


def test_documents_are_packed_tightly(spark, small):
    rows = packing.query(spark, small).collect()
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    assert check(rows, docs) > 0.95


def test_sequences_hold_the_ids(spark):
    docs = frame(spark)
    pieces = packing.staged(packing.token_pieces(docs, PATH), "pieces")
    packed = packing.pack(pieces).cache()
    by_place = {(r.sequence_id, r.offset): r.ids for r in packed.collect()}
    for r in packing.sequences(packed).collect():
        assert bytes(r.ids) == b"".join(bytes(v) for (s, _), v in sorted(by_place.items()) if s == r.sequence_id)
