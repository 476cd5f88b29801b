"""Token ids of whole batches of texts by a byte-level BPE tokenizer.

The tokenizer's pattern first cuts a text into runs of letters, digits, marks or white space, a blank going with the run after
it, and tokenises each run by itself. NumPy finds these runs in the bytes of a batch, Arrow dictionary-encodes them where
they lie, and only the batch's distinct runs are looked up in a bounded cache or tokenised; the ids of all texts are then
one gather. Where a byte's class is in doubt (an apostrophe, letters and marks beyond Latin) everything between two white spaces
is one run, and a text with white space beyond ASCII is a run as a whole; the tokenizer cuts these itself.
"""

from __future__ import annotations

import os
from array import array

import numpy as np
import pyarrow as pa

from creditloom.llm.common import model

#: Bounds of a worker's cache, about 60 MB: distinct runs in two generations, and the longest cached run in bytes.
CACHE_RUNS, CACHED_BYTES = 300_000, 64
#: Runs that are tokenised in one call.
TOGETHER = 64
_SPACE, _LETTER, _DIGIT, _MARK, _UNSURE = range(5)


def _classes() -> np.ndarray:
    kind = np.full(256, _UNSURE, dtype=np.uint8)
    kind[:0x80] = _MARK
    kind[[0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20]] = _SPACE
    kind[0x30:0x3A] = _DIGIT
    kind[0x41:0x5B] = kind[0x61:0x7B] = _LETTER
    kind[0x27] = _UNSURE  # the apostrophe may go with the letters after it
    return kind


_CLASS = _classes()


def _other_space(data: np.ndarray) -> np.ndarray:
    """Places of bytes that may be white space to some: U+001C-001F, 0085, 00A0, 1680, 2000-200A, 2028, 2029, 202F, 205F, 3000."""
    found = [np.flatnonzero((data >= 0x1C) & (data <= 0x1F))]
    for lead, rest in ((0xC2, [(0x85,), (0xA0,)]), (0xE1, [(0x9A, 0x80)]), (0xE3, [(0x80, 0x80)]),
                       (0xE2, [*[(0x80, x) for x in range(0x80, 0x8B)], (0x80, 0xA8), (0x80, 0xA9), (0x80, 0xAF), (0x81, 0x9F)])):
        at = np.flatnonzero(data == lead)
        for tail in rest if len(at) else []:
            same = np.ones(len(at), dtype=bool)
            for k, x in enumerate(tail, 1):
                same &= data[np.minimum(at + k, len(data) - 1)] == x
            found.append(at[same])
    return np.concatenate(found)


def run_starts(data: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """Where runs start in the bytes of texts that start at the places ``texts`` (ascending, none empty)."""
    kind = _CLASS[data]
    high = np.flatnonzero((data >= 0xC3) & (data <= 0xC5))
    if len(high):  # U+00C0-017F, letters but for two signs
        second = data[np.minimum(high + 1, len(data) - 1)]
        high = high[(data[high] != 0xC3) | ((second != 0x97) & (second != 0xB7))]
        kind[high] = kind[high + 1] = _LETTER
    is_text = np.zeros(len(data), dtype=bool)
    is_text[texts] = True
    solid = kind != _SPACE
    before = np.append(False, solid[:-1]) & ~is_text
    unsure = np.flatnonzero(kind == _UNSURE)
    if len(unsure):
        word = np.cumsum(solid & ~before, dtype=np.int32)
        bad = np.zeros(int(word[-1]) + 1, dtype=bool)
        bad[word[unsure]] = True
        kind[solid & bad[word]] = _UNSURE
    change = np.append(True, kind[1:] != kind[:-1])
    start = change | is_text
    after_space = np.flatnonzero(solid & change & ~is_text & ~before)  # the first byte after white space of the same text
    start[after_space - 1] = True
    start[after_space[data[after_space - 1] == 0x20]] = False
    odd = _other_space(data)
    if len(odd):
        ends = np.append(texts[1:], len(data))
        for i in np.unique(np.searchsorted(texts, odd, side="right") - 1).tolist():
            start[texts[i] + 1:ends[i]] = False
    return np.flatnonzero(start)


class TokenBatches:
    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        vocab = self.tokenizer.get_vocab()
        self.blank = np.zeros(max(vocab.values()) + 1, dtype=bool)
        self.blank[[i for t, i in vocab.items() if t[0] == "Ġ"]] = True  # how a byte-level vocabulary writes a leading blank
        self.runs: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [array("I", x.ids).tobytes() for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)] if texts else []

    def _learn(self, runs: list[bytes]) -> dict[bytes, bytes]:
        """Ids of new runs; those that start with their only white space, a blank, are tokenised many in one call."""
        after_blank = [r for r in runs if r[:1] == b" " and len(r) <= CACHED_BYTES and b" " + r.strip() == r]
        got: dict[bytes, bytes] = {}
        for i in range(0, len(after_blank), TOGETHER):
            some = after_blank[i:i + TOGETHER]
            raw = self._encode([b"".join(some).decode()])[0]
            at = [4 * i for i in np.flatnonzero(self.blank[np.frombuffer(raw, dtype="<u4")]).tolist()]
            if len(at) == len(some):
                got.update(zip(some, [raw[a:b] for a, b in zip(at, [*at[1:], len(raw)])]))
        rest = [r for r in runs if r not in got]
        got.update(zip(rest, self._encode([r.decode() for r in rest])))
        return got

    def batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, counts): the ids of all texts one after another, unsigned 32-bit, and the number of ids of each text."""
        texts = texts.cast(pa.binary())
        _, offsets, buffer = texts.buffers()
        edges = np.frombuffer(offsets, dtype=np.int32, count=len(texts) + 1, offset=4 * texts.offset).astype(np.int64) if len(texts) else np.zeros(1, dtype=np.int64)
        if edges[-1] == edges[0]:
            return np.zeros(0, dtype="<u4"), np.zeros(len(texts), dtype=np.int64)
        data = np.frombuffer(buffer, dtype=np.uint8, count=edges[-1])[edges[0]:]
        edges -= edges[0]
        starts = run_starts(data, edges[:-1][np.diff(edges) > 0])
        places = np.append(starts, len(data)).astype(np.int32)
        coded = pa.BinaryArray.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(places), pa.py_buffer(data)]).dictionary_encode()
        distinct, unit = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        if len(self.runs) > CACHE_RUNS // 2:
            self.runs, self.old = {}, self.runs
        found = [self.runs.get(r) or self.old.get(r) for r in distinct]  # a run has at least one id
        lacks = [i for i, x in enumerate(found) if x is None]
        new = self._learn([distinct[i] for i in lacks])
        for i in lacks:
            found[i] = new[distinct[i]]
        self.runs.update((r, x) for r, x in zip(distinct, found) if len(r) <= CACHED_BYTES)
        # a batch is less than 2 GB, so that places and numbers of ids fit 32 bits
        size = np.fromiter(map(len, found), dtype=np.int32, count=len(found)) // 4
        first, flat = np.cumsum(size, dtype=np.int32) - size, np.frombuffer(b"".join(found), dtype="<u4")
        sizes = size[unit]
        ends = np.append(np.int32(0), np.cumsum(sizes, dtype=np.int32))
        at = np.repeat(first[unit] - ends[:-1], sizes)
        at += np.arange(len(at), dtype=np.int32)
        return flat[at], np.diff(ends[np.searchsorted(starts, edges)]).astype(np.int64)


def loaded(path: str) -> TokenBatches:
    """The worker's tokenizer of a file."""
    return model(("tokenizer", path), lambda: TokenBatches(path))
