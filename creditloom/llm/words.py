"""Byte-level word splitting that several operators share. Only A-Z are lower-cased; other letters stay as they are."""

from __future__ import annotations

import re

#: Every byte that is no ASCII digit, ASCII letter or part of a longer UTF-8 character becomes a blank; A-Z become a-z.
_ALNUM = bytes(b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 32 for b in range(256))
_WORD = re.compile(rb"[^ ]+")


def folded(raw: bytes | None) -> bytes:
    """Text with A-Z lower-cased and a blank for each byte that is in no word; words are what lies between the blanks."""
    return raw.translate(_ALNUM) if raw else b""


def alnum_words(text: str | None) -> list[bytes]:
    """Words of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after A-Z are lower-cased."""
    return text.encode("utf-8", "surrogatepass").translate(_ALNUM).split() if text else []


def alnum_offsets(text: str) -> tuple[bytes, list[tuple[int, int]]]:
    """The text's UTF-8 bytes and the byte range of each of its words."""
    raw = text.encode("utf-8", "surrogatepass")
    return raw, [m.span() for m in _WORD.finditer(raw.translate(_ALNUM))]


def blank_words(text: str | None) -> list[bytes]:
    """Words of ``[^\\x20\\x09-\\x0D]+`` after A-Z are lower-cased."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []
