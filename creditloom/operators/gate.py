"""One gate over a text column: every identifier in every reading of a text, with its place in the text as it was written.

A text is first cut to windows around the characters and words that an identifier, a disguise or a name can't do without; most
text is left behind there. Each window is then read in several views: as written, normalised (other digits, look-alike letters,
invisible characters, escapes, spelled-out digits), with separated digits joined, and with long tokens decoded. A view carries an
offset map, so that a finding in any of them has a start and an end in the original text. All patterns run as native
expressions on the windows; only normalising characters takes a small Arrow function, on windows that need it.

Defined results: a null or empty text has no findings; a finding of several views counts once per detector and span; ``start`` and
``end`` count characters from 0, the end excluded; a text of any length is read as a whole.
"""

from __future__ import annotations

import html
import re
import unicodedata
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Private-use characters: one that takes part in no pattern, and marks around what a pattern finds.
FILLER, LEFT, RIGHT = "\ue000", "\ue001", "\ue002"

# --- fixed values: words and characters ---------------------------------------------------------------------------
DIGIT_WORDS = {"zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9"}
TIMES = {"double": 2, "dbl": 2, "triple": 3}
LOOK_ALIKES = {
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X", "Ѕ": "S", "І": "I", "Ј": "J", "Ү": "Y",
    "а": "a", "с": "c", "е": "e", "о": "o", "р": "p", "х": "x", "у": "y", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "һ": "h", "ԛ": "q", "ԝ": "w",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "ο": "o", "ν": "v", "ι": "i", "α": "a", "ρ": "p",
}
#: Characters that show nothing: all of category Cf, variation selectors and a few fillers.
FILLERS = frozenset(map(chr, [0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, *range(0x180B, 0x180F), 0x3164, 0xFFA0, *range(0xFE00, 0xFE10)]))
HONORIFICS = ("mr", "mrs", "ms", "miss", "mx", "shri", "shree", "sri", "smt", "shrimati", "sushri", "kumari", "dr", "prof")
NATIVE_HONORIFICS = ("श्री", "श्रीमती", "कुमारी", "डॉ", "திரு", "শ্রী")
NATIVE_LABELS = ("नाम", "आवेदक का नाम", "आवेदक", "பெயர்", "নাম")
PARTIES = ("applicant", "co-applicant", "co applicant", "borrower", "co-borrower", "guarantor", "proprietor", "account holder", "customer", "employee",
           "father", "mother", "spouse", "husband", "wife", "nominee", "signatory", "beneficiary", "director", "partner", "owner", "tenant", "landlord")
#: Capitalised words that end a name.
NO_NAMES = ("Bank", "Ltd", "Limited", "Pvt", "Private", "Company", "Road", "Street", "Nagar", "Colony", "Branch", "Account", "Number", "Date", "Loan", "The",
            "Pan", "Aadhaar", "Phone", "Email", "Address", "Report")
PLACES = ("Bengaluru", "Bangalore", "Mumbai", "Delhi", "New Delhi", "Chennai", "Kolkata", "Hyderabad", "Pune", "Ahmedabad", "Jaipur", "Lucknow", "Kochi")
TOKEN_NAMES = ("CO_APPLICANT", "APPLICANT", "GUARANTOR", "EMPLOYER", "BUSINESS", "PASSPORT", "REDACTED", "COMPANY", "AADHAAR", "ACCOUNT", "ADDRESS",
               "PERSON", "AMOUNT", "PHONE", "EMAIL", "GSTIN", "VOTER", "ACCT", "ADDR", "CITY", "DATE", "IFSC", "NAME", "BANK", "CARD", "ORG", "PAN", "UID",
               "PIN", "DOB", "UPI", "ID", "DL")
NAMES = ("anita", "arjun", "deepa", "harish", "kavita", "lakshmi", "meena", "mohan", "priya", "rahul", "ramesh", "sanjay", "sharma", "sunita", "suresh",
         "vijay", "verma", "gupta", "राजेश", "शर्मा", "सुनीता", "वर्मा")

#: Characters kept on each side of what opened a window; longer tokens at its edge are kept whole.
CONTEXT = 160
INDIC = r"\u0900-\u0963\u0966-\u0DFF"
_PLAIN = (r"\x00-\x7F\u00A1-\u00A9\u00AB\u00AC\u00AE\u00B0\u00B6\u00B7\u00BB\u00BF-\u024F\u2010-\u2015\u2018-\u2026\u20AC\u20B9"
          r"\u3040-\u30FF\u4E00-\u9FFF\uAC00-\uD7A3")
_LATIN = r"A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u024F"
_TRIGGERS = [*DIGIT_WORDS, "dot", *HONORIFICS, "name", "names", r"[sdwhc] ?[/\\] ?o",
             *[f"{x} of" for x in ("son", "daughter", "wife", "husband", "widow", "father", "mother", "care")], *PARTIES]


def _by_first(words: list[str]) -> str:
    """An alternation that looks at the first letter once."""
    first: dict[str, list[str]] = {}
    for w in words:
        first.setdefault("[sdwhc]" if w[0] == "[" else w[0], []).append(w[7:] if w[0] == "[" else w[1:])
    return "|".join(f"{a}(?:{'|'.join(sorted(rest, key=len, reverse=True))})" for a, rest in first.items())


#: A word that opens no window, marks between words, and a stretch of them. Stretches of any length are matched, so that none is
#: read twice, and cut at some hundred words, since Java matches a repeated group by recursion.
_QUIET_WORD = rf"(?!(?i:{_by_first(_TRIGGERS)})(?![A-Za-z]))[{_LATIN}]++"
_QUIET_MARK = rf"[^{_LATIN}0-9@%&\[({{<\x80-\uFFFF]++|[\[({{<](?!\s{{0,9}}(?i:at)\s{{0,9}}[\])}}>])|[{_PLAIN}&&[^\x00-\x7F]&&[^{_LATIN}]]"
_OPENS = rf"[0-9@%&]|(?=[^\x00-\x7F])[^{_PLAIN}]|[\[({{<]\s{{0,9}}(?i:at)\s{{0,9}}[\])}}>]|(?<![A-Za-z])(?i:{_by_first(_TRIGGERS)})(?![A-Za-z])"
_QUIET = rf"()((?:{_QUIET_WORD}|{_QUIET_MARK}){{1,600}}+)"
DISGUISED = rf"[^{_PLAIN}]|%[0-9A-Fa-f]{{2}}|&[#A-Za-z]|[0-9][OolI][0-9]|(?<![A-Za-z])(?i:{'|'.join(DIGIT_WORDS)})(?![a-z])"


def _sql(pattern: str) -> str:
    """A raw SQL string; no pattern here holds a double quote."""
    return f'r"{pattern}"'


# ------------------------------------------------------------------------------------------------ normalising

_WORD = rf"(?:(?:double|triple|dbl)[\s\-_]+)?(?:{'|'.join(DIGIT_WORDS)}|oh|o)"
_DIGIT_WORD = re.compile(rf"(?:(double|triple|dbl)[\s\-_]+)?({'|'.join(DIGIT_WORDS)}|oh|o)", re.I)


class _Mapped:
    """Text whose characters know the span of the original that they stand for."""

    def __init__(self, text: str) -> None:
        self.chars, self.spans = list(text), [(i, i + 1) for i in range(len(text))]

    def replace(self, pattern: re.Pattern[str], new) -> None:
        """Put ``new(match)`` in the place of each match; None leaves it. New characters share the match's span."""
        text, chars, spans, at = "".join(self.chars), [], [], 0
        for m in pattern.finditer(text):
            got = new(m)
            if got is None or got == m.group():
                continue
            a, b = m.span()
            whole = (self.spans[a][0], self.spans[b - 1][1])
            chars += [*self.chars[at:a], *got]
            spans += [*self.spans[at:a], *([whole] * len(got))]
            at = b
        self.chars, self.spans = chars + self.chars[at:], spans + self.spans[at:]


def _readable(cluster: str) -> str:
    out = []
    for ch in unicodedata.normalize("NFKC", cluster):
        if ch <= "\x7f":
            out.append(ch)
        elif ch not in FILLERS and unicodedata.category(ch) != "Cf":
            out.append(str(unicodedata.decimal(ch)) if ch.isdecimal() else LOOK_ALIKES.get(ch, ch))
    return "".join(out)


def _digits(m: re.Match[str]) -> str | None:
    parts = [(TIMES.get((times or "").lower(), 1), DIGIT_WORDS.get(word.lower())) for times, word in _DIGIT_WORD.findall(m.group())]
    digits = "".join((d or "0") * n for n, d in parts)
    return digits if len(digits) >= 4 and sum(d is not None for _, d in parts) >= 2 else None


def _unquoted(m: re.Match[str]) -> str | None:
    try:
        return unquote(m.group(), errors="strict")
    except UnicodeDecodeError:  # percent signs that are no escaped text
        return None


#: A character with its combining marks, or one beyond ASCII.
_CLUSTER = re.compile("[^\u0300-\u036f][\u0300-\u036f]+|[^\\x00-\\x7f]")
_PERCENT = re.compile("(?:%[0-9A-Fa-f]{2})+")
_ENTITY = re.compile("&(?:#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6}|[A-Za-z]{2,8});")
_ZERO, _ONE = re.compile("(?<=[0-9])[Oo](?=[0-9])"), re.compile("(?<=[0-9])[lI](?=[0-9])")
_SPELLED = re.compile(rf"(?<![A-Za-z0-9]){_WORD}(?:[\s,\-_]*{_WORD})+(?![A-Za-z0-9])", re.I)


def normalized(text: str) -> tuple[str, list[int], list[int]]:
    """The plain reading of a window, and for each of its characters where its original starts and ends."""
    t = _Mapped(text)
    t.replace(_CLUSTER, lambda m: _readable(m.group()))
    if len(re.findall("%[0-9A-Fa-f]{2}", text)) >= 3:
        t.replace(_PERCENT, _unquoted)
    t.replace(_ENTITY, lambda m: html.unescape(m.group()))
    t.replace(_CLUSTER, lambda m: _readable(m.group()))  # what the escapes held
    t.replace(_ZERO, lambda m: "0")
    t.replace(_ONE, lambda m: "1")
    t.replace(_SPELLED, _digits)
    return "".join(t.chars), [a for a, _ in t.spans], [b for _, b in t.spans]


def _normalize_windows(batch: pd.Series) -> pd.Series:
    empty = {"s": None, "ms": None, "me": None}
    return batch.map(lambda ws: None if ws is None else [empty if w is None else dict(zip(("s", "ms", "me"), normalized(w))) for w in ws])


# ------------------------------------------------------------------------------------------------ windows and views


def _windows(docs: DataFrame, text: str) -> DataFrame:
    """Add ``windows``: array of (at, s), the parts of a text that an identifier can lie in."""
    q = _sql(_QUIET)
    out = docs.withColumn("__parts", F.expr(f"split({text}, {q}, -1)")).withColumn("__gaps", F.expr(f"regexp_extract_all({text}, {q}, 1)"))
    tail = f"concat(substring_index(left(gap, length(gap) - {CONTEXT}), ' ', -1), right(gap, {CONTEXT}))"
    head = f"concat(left(gap, {CONTEXT}), substring_index(substring(gap, {CONTEXT + 1}), ' ', 1))"
    before = f"CASE WHEN i > 0 THEN element_at(transform(array(get(__gaps, i - 1)), gap -> {tail}), 1) ELSE '' END"
    after = f"CASE WHEN i < size(__gaps) THEN element_at(transform(array(get(__gaps, i)), gap -> {head}), 1) ELSE '' END"
    one = (f"element_at(transform(array({before}), b -> named_struct('at', CAST(acc.pos - length(b) AS INT), 's', concat(b, get(__parts, i), {after}))), 1)")
    step = (f"named_struct('pos', CAST(acc.pos + length(get(__parts, i)) + coalesce(length(get(__gaps, i)), 0) AS INT), "
            f"'out', CASE WHEN get(__parts, i) = '' THEN acc.out ELSE array_append(acc.out, {one}) END)")
    zero = "named_struct('pos', 0, 'out', CAST(array() AS array<struct<at:int,s:string>>))"
    fold = f"aggregate(sequence(0, size(__parts) - 1), {zero}, (acc, i) -> {step}, acc -> acc.out)"
    return out.withColumn("windows", F.expr(f"CASE WHEN {text} <> '' THEN {fold} END")).drop("__parts", "__gaps")


def _cut(s: str, pattern: str) -> str:
    """Array of a string's parts, by turns outside and inside the pattern's second group; the first group stays outside."""
    return f"split(regexp_replace({s}, {_sql(pattern)}, '$1{LEFT}$2{RIGHT}'), '[{LEFT}{RIGHT}]', -1)"


def _windows(docs: DataFrame, text: str) -> DataFrame:
    """Add ``windows``: array of (at, s), the parts of a text that an identifier can lie in, each with some context."""
    # stretches shorter than two contexts lose their marks again; the parts are by turns between quiet stretches and inside them
    marked = f"regexp_replace(regexp_replace({text}, {_sql(_QUIET)}, '$1{LEFT}$2{RIGHT}'), '{LEFT}([^{LEFT}{RIGHT}]{{0,{2 * CONTEXT}}}){RIGHT}', '$1')"
    out = docs.withColumn("__parts", F.expr(f"split({marked}, '[{LEFT}{RIGHT}]', -1)"))
    tail = f"CASE WHEN length(g) > {CONTEXT} THEN concat(substring_index(left(g, length(g) - {CONTEXT}), ' ', -1), right(g, {CONTEXT})) ELSE g END"
    head = f"CASE WHEN length(g) > {CONTEXT} THEN concat(left(g, {CONTEXT}), substring_index(substring(g, {CONTEXT + 1}), ' ', 1)) ELSE g END"
    before = f"element_at(transform(array(coalesce(get(__parts, i - 1), '')), g -> {tail}), 1)"
    after = f"element_at(transform(array(coalesce(get(__parts, i + 1), '')), g -> {head}), 1)"
    one = f"element_at(transform(array({before}), b -> named_struct('at', CAST(acc.pos - length(b) AS INT), 's', concat(b, x, {after}))), 1)"
    step = (f"named_struct('pos', CAST(acc.pos + length(x) AS INT), 'i', acc.i + 1, "
            f"'out', CASE WHEN acc.i % 2 = 1 OR NOT rlike(x, {_sql(_OPENS)}) THEN acc.out ELSE element_at(transform(array(acc.i), i -> array_append(acc.out, {one})), 1) END)")
    zero = "named_struct('pos', 0, 'i', 0, 'out', CAST(array() AS array<struct<at:int,s:string>>))"
    fold = f"aggregate(__parts, {zero}, (acc, x) -> {step}, acc -> acc.out)"
    return out.withColumn("windows", F.expr(f"CASE WHEN {text} <> '' THEN {fold} END")).drop("__parts")


_TOKENS = rf"()(\[(?:(?:{'|'.join(TOKEN_NAMES)})(?:_[A-Z0-9]{{1,3}})?|[<>]?[0-9]{{1,3}}(?:k|L|Cr)?(?:-[0-9]{{1,3}}(?:k|L|Cr)?)?\+?)\])"
_UUIDS = r"()((?<![0-9A-Fa-f])[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}(?![0-9A-Fa-f]))"
#: One separator between two digits, but for the point after a lone leading zero.
JOINT = r"(?<=[0-9])(?:[ \t\n\-/_]|(?<!(?<![0-9.])0)\.)(?=[0-9])"
_LONG_TOKEN = r"()((?<![A-Za-z0-9+/_\-])[A-Za-z0-9+/_\-]{16,}+={0,2})"


def _blanked(s: str, pattern: str) -> str:
    """What matches becomes as many characters that take part in no pattern."""
    return f"array_join(transform({_cut(s, pattern)}, (x, i) -> CASE WHEN i % 2 = 1 THEN repeat('{FILLER}', length(x)) ELSE x END), '')"


def _places(parts: str, body: str) -> str:
    """An array with ``body`` for each inside part ``x`` of ``parts``, which starts at ``p``."""
    return (f"transform(array({parts}), parts -> CASE WHEN size(parts) > 1 THEN transform(sequence(1, CAST(size(parts) div 2 AS INT)), k -> "
            f"element_at(transform(array(named_struct('p', length(array_join(slice(parts, 1, 2 * k - 1), '')), 'x', element_at(parts, 2 * k))), m -> {body}), 1)) END)[0]")


def _views(docs: DataFrame, text: str) -> DataFrame:
    """Add ``views``: array of (s, at, ms, me, joins, whole), each a reading of a window with its offset map.

    Character p of a view stands for character q = p + (number of ``joins`` up to p) of the window's reading, and that for ``ms[q]``
    to ``me[q]`` of the window (q itself where there is no map), which starts at ``at``. A decoded token stands for its
    ``whole`` characters at ``at``.
    """
    normalize = F.pandas_udf(_normalize_windows, "array<struct<s:string,ms:array<int>,me:array<int>>>")
    out = _windows(docs, text)
    todo = F.expr(f"CASE WHEN exists(windows, w -> rlike(w.s, {_sql(DISGUISED)})) THEN transform(windows, w -> CASE WHEN rlike(w.s, {_sql(DISGUISED)}) THEN w.s END) END")
    out = out.withColumn("__read", normalize(todo))
    kind = "CAST(NULL AS array<int>)"
    plain = f"transform(windows, w -> named_struct('s', w.s, 'at', w.at, 'ms', {kind}, 'me', {kind}, 'joins', {kind}, 'whole', CAST(NULL AS INT)))"
    read = ("filter(transform(windows, (w, i) -> named_struct('s', __read[i].s, 'at', w.at, 'ms', __read[i].ms, 'me', __read[i].me, "
            f"'joins', {kind}, 'whole', CAST(NULL AS INT))), v -> v.s IS NOT NULL)")
    out = out.withColumn("__plain", F.expr(plain)).withColumn("__read", F.expr(f"CASE WHEN __read IS NOT NULL THEN {read} END"))
    # decoded tokens are taken from the whole text: one may be made of letters alone
    tokens = _places(_cut(text, _LONG_TOKEN), "m")
    out = out.withColumn("__tokens", F.expr(tokens))
    body = "translate(rtrim('=', m.x), '-_', '+/')"
    raw = [f"CASE WHEN rlike(m.x, '^(?:[0-9a-fA-F]{{2}}){{8,}}$') THEN try_to_binary(m.x, 'hex') END",
           f"try_to_binary(rpad({body}, CAST(ceil(length({body}) / 4D) * 4 AS INT), '='), 'base64')"]
    # a run of digits is found as a number; an @ among its bytes is chance (631 of 2,000,000 random 16-digit numbers that start with 4), no handle
    said = f"CASE WHEN is_valid_utf8(CAST(b AS STRING)) THEN CASE WHEN rlike(m.x, '^[0-9]{{16,19}}$') THEN translate(CAST(b AS STRING), '@', '{FILLER}') ELSE CAST(b AS STRING) END END"
    view = f"named_struct('s', {said}, 'at', m.p, 'ms', {kind}, 'me', {kind}, 'joins', {kind}, 'whole', length(m.x))"
    layers = f"flatten(transform(__tokens, m -> transform(array_compact(array({', '.join(raw)})), b -> {view})))"
    good = r"length(v.s) >= 6 AND NOT rlike(v.s, '[\\x00-\\x1f\\x7f]') AND length(regexp_replace(v.s, '[^A-Za-z0-9]', '')) >= 6"
    out = out.withColumn("__layers", F.expr(f"CASE WHEN __tokens IS NOT NULL THEN filter({layers}, v -> {good}) END"))
    every = out.withColumn("__all", F.expr("flatten(array_compact(array(__plain, __read, __layers)))"))
    blank = lambda s, p, guard: f"CASE WHEN {guard} THEN {_blanked(s, p)} ELSE {s} END"
    ready = blank("v.s", _TOKENS, "contains(v.s, '[')")
    cleared = f"transform(__all, v -> named_struct('s', {ready}, 'at', v.at, 'ms', v.ms, 'me', v.me, 'joins', v.joins, 'whole', v.whole))"
    every = every.withColumn("__all", F.expr(cleared))
    ready = blank("v.s", _UUIDS, f"rlike(v.s, {_sql(_UUIDS)})")
    every = every.withColumn("__all", F.expr(f"transform(__all, v -> named_struct('s', {ready}, 'at', v.at, 'ms', v.ms, 'me', v.me, 'joins', v.joins, 'whole', v.whole))"))
    ends = "aggregate(slice(parts, 1, size(parts) - 1), named_struct('n', 0, 'e', CAST(array() AS array<int>)), (a, x) -> named_struct('n', CAST(a.n + length(x) AS INT), 'e', array_append(a.e, CAST(a.n + length(x) AS INT))), a -> a.e)"
    joined = (f"transform(filter(__all, v -> rlike(v.s, {_sql(JOINT)})), v -> element_at(transform(array(split(v.s, {_sql(JOINT)}, -1)), parts -> "
              f"named_struct('s', array_join(parts, ''), 'at', v.at, 'ms', v.ms, 'me', v.me, 'joins', {ends}, 'whole', v.whole)), 1))")
    every = every.withColumn("__joined", F.expr(joined))
    run = "coalesce(array_max(transform(regexp_extract_all(v.s, '([0-9]+)', 1), x -> length(x))), 0)"
    final = f"transform(concat(__all, __joined), v -> named_struct('s', v.s, 'at', v.at, 'ms', v.ms, 'me', v.me, 'joins', v.joins, 'whole', v.whole, 'run', {run}))"
    return every.withColumn("views", F.expr(f"CASE WHEN size(__all) > 0 THEN {final} END")).drop("__read", "__plain", "__tokens", "__layers", "__all", "__joined", "windows")


# ------------------------------------------------------------------------------------------------ detectors

_NOT_ALNUM, _NO_ALNUM = r"(?<![A-Za-z0-9])", r"(?![A-Za-z0-9])"
_BETWEEN = r"[ ._/\-]"
_LOCAL_PART = r"[A-Za-z0-9%+._\-]"
_HOST = r"[A-Za-z0-9\-]+"
_OPEN, _CLOSE = r"[\[({<]", r"[\])}>]"
_SQUASHED = f"regexp_replace(m.x, {_sql(r'[ \t\n\-./_]')}, '')"
_CITY = "|".join(PLACES)
_PIN_CODE = r"([1-9][0-9]{2} ?[0-9]{3}(?![0-9]))"
_HON = "|".join(HONORIFICS)
_NAME_WORD = rf"(?!(?:{'|'.join(NO_NAMES)}|(?i:{_HON}))(?![a-z]))[A-Z][A-Za-z'’\-]*+"
_NAME_RUN = rf"({_NAME_WORD}(?: {_NAME_WORD}){{0,15}}+)"
_ANY_NAME = rf"((?!(?i:{'|'.join(NO_NAMES)})(?![a-z]))[A-Za-z][A-Za-z'’\-]++(?: {_NAME_WORD}){{0,15}}+)"
_START = r"(?<![A-Za-z0-9_'’])"
_INDIC_RUN = rf"([{INDIC}]++(?: [{INDIC}]++){{0,3}}+)"
_WHO = "|".join(PARTIES)

#: detector -> (patterns: group 1 is context, group 2 the finding; digits in a row that a view needs; condition on the finding m.x)
DETECTORS: dict[str, tuple[list[str], int, str]] = {
    "pan": ([r"()((?<![A-Za-z])[A-Za-z]{5}[0-9]{4}[A-Za-z](?![A-Za-z]))",
             r"()((?<=[A-Za-z])[A-Za-z]{3}(?i:[abcfghjlpt])[A-Za-z][0-9]{4}[A-Za-z](?![A-Za-z]))",
             rf"()({_NOT_ALNUM}(?:[A-Za-z]{{5}}|[A-Za-z](?:{_BETWEEN}[A-Za-z]){{4}}){_BETWEEN}?(?:[0-9]{{4}}|[0-9](?:{_BETWEEN}[0-9]){{3}}){_BETWEEN}?[A-Za-z]{_NO_ALNUM})"],
            1, f"lower(left({_SQUASHED}, 5)) NOT IN ('march', 'april')"),
    "ifsc": ([rf"()({_NOT_ALNUM}[A-Za-z]{{4}}[ \-]?0[A-Za-z0-9]{{6}}{_NO_ALNUM})"], 1, f"rlike(substring({_SQUASHED}, 6), '[0-9]')"),
    "passport": ([rf"()({_NOT_ALNUM}(?:[A-Za-z]|[A-Z][ \-])[0-9]{{7}}{_NO_ALNUM})"], 7, "true"),
    "voter_id": ([rf"()({_NOT_ALNUM}(?:[A-Za-z]{{3}}|[A-Z]{{3}}[ \-])[0-9]{{7}}{_NO_ALNUM})"], 7, "true"),
    "driving_licence": ([rf"()({_NOT_ALNUM}[A-Za-z]{{2}}[ \-]?[0-9]{{2}}[ \-]?[0-9]{{11}}{_NO_ALNUM})"], 9, "true"),
    "pincode_ctx": ([rf"((?<![A-Za-z])(?i:(?:(?:pin|postal|post|zip)[\s\-]?code|pin|zip|पिन[\s\-]?कोड|पिन)[ \t]*(?:no\.?|number|#)?[ \t]*[:=\-]?[ \t]*)){_PIN_CODE}",
                     rf"((?<![A-Za-z])(?i:{_CITY})[ \t]*[,\-–]?[ \t]*){_PIN_CODE}",
                     rf"(,[ \t]*[A-Z][A-Za-z]+(?:[ \t][A-Z][A-Za-z]+){{0,2}}[ \t]*[\-–][ \t]*){_PIN_CODE}"], 3, "true"),
}
#: Runs of nine digits and more are read once and named by their length and form.
_NUMBERS = r"()((?<![0-9])\+?[0-9]{9,}(?![0-9]))"
_NUMBER_KINDS = {
    "aadhaar": "rlike(m.x, '^\\\\+?[2-9][0-9]{11}$')", "aadhaar_vid": "length(ltrim('+', m.x)) = 16", "account_number": "true",
    "card_number": "length(ltrim('+', m.x)) BETWEEN 13 AND 19 AND luhn_check(ltrim('+', m.x))",
    "phone_in": "rlike(m.x, '^(?:\\\\+?(?:(?:0091|91|0)[1-9]|[6-9])[0-9]{9})$')",
}
_PAREN_PHONE = r"()(\(\s{0,9}0[0-9]{2,4}\s{0,9}\)[ \-.]?[0-9](?:[ \-.]?[0-9]){5,7}(?![0-9]))"
_EMAILS = [rf"()((?<!{_LOCAL_PART}){_LOCAL_PART}++\s?@\s?{_HOST}(?:\.{_HOST})*\.[A-Za-z]{{2,}})",
           rf"()((?<!{_LOCAL_PART})[A-Za-z0-9]{_LOCAL_PART}*+\s*{_OPEN}\s*(?i:at)\s*{_CLOSE}\s*{_HOST}(?:\s*(?:\.|{_OPEN}\s*(?i:dot)\s*{_CLOSE})\s*{_HOST})+)",
           rf"()((?<!{_LOCAL_PART})[A-Za-z0-9]{_LOCAL_PART}*+\s+(?i:at)\s+{_HOST}(?:\s+(?i:dot)\s+{_HOST})+{_NO_ALNUM})"]
_UPI = rf"()((?<!{_LOCAL_PART})(?<!@)[A-Za-z0-9][A-Za-z0-9._\-]+@[A-Za-z]{{2,}}(?![A-Za-z0-9@])(?!\.[A-Za-z0-9]))"
_MARKED = [rf"({_START}(?i:{_HON})(?![A-Za-z])\.? +(?:(?i:{_HON})\.? +)?){_NAME_RUN}",
           rf"({_START}(?i:[sdwhc] ?[/\\] ?o)\.?:? +(?:(?i:{_HON})\.? +)?){_ANY_NAME}",
           rf"({_START}(?i:(?:son|daughter|wife|husband|widow|father|mother|care) of) +(?:(?i:{_HON})\.? +)?){_NAME_RUN}",
           rf"({_START}(?<![A-Za-z0-9'’] )(?i:(?:(?:{_WHO})(?:['’]?s)? )?(?:full |first |last |sur)?name|{_WHO}) *[:=\-–] *(?:(?i:{_HON})\.? +)?){_ANY_NAME}",
           rf"((?<![{INDIC}])(?:{'|'.join(NATIVE_HONORIFICS)})\.? +){_INDIC_RUN}",
           rf"((?<![{INDIC}])(?:{'|'.join(NATIVE_LABELS)}) *: *)((?:[{INDIC}]++|[A-Za-z]++)(?: (?:[{INDIC}]++|[A-Z][A-Za-z]*+)){{0,3}}+)"]
_NAME_GUARD = rf"{_START}(?i:{_HON}|names?|surname|{_WHO}|[sdwhc] ?[/\\] ?o|of)(?![A-Za-z])|[{INDIC}]"
_RUNS = rf"()({_START}(?<!-){_NAME_WORD}(?: {_NAME_WORD}){{0,15}}+|[{INDIC}]++)"
ALL_DETECTORS = (*DETECTORS, *_NUMBER_KINDS, "email", "upi_id", "person_name")


def _mask(x: str) -> str:
    s = f"regexp_replace({x}, {_sql(r'[ \t\n\-./_]')}, '')"
    return (f"CASE WHEN length({s}) <= 1 THEN repeat('*', length({s})) WHEN length({s}) <= 4 THEN concat(left({s}, 1), repeat('*', length({s}) - 1))"
            f" ELSE concat(left({s}, 2), repeat('*', length({s}) - 4), right({s}, 2)) END")


def _found(detector: str, x: str = "m.x", start: str = "m.p", masked: str | None = None) -> str:
    """A finding whose first character is ``start`` of view v, put to its place in the original."""
    q = lambda p: f"({p} + coalesce(size(filter(v.joins, e -> e <= {p})), 0))"
    last = f"({start} + length({x}) - 1)"
    lo = f"v.at + CASE WHEN v.whole IS NOT NULL THEN 0 ELSE coalesce(get(v.ms, {q(start)}), {q(start)}) END"
    hi = f"v.at + CASE WHEN v.whole IS NOT NULL THEN v.whole ELSE coalesce(get(v.me, {q(last)}), {q(last)} + 1) END"
    return (f"named_struct('detector', '{detector}', 'masked', {masked or _mask(x)}, 'start', CAST({lo} AS INT), 'end', CAST({hi} AS INT), 'raw', {x})")


def _hits(pattern: str, body: str, keep: str = "true") -> str:
    return f"array_compact({_places(_cut('v.s', pattern), f'CASE WHEN {keep} THEN {body} END')})"


#: A long token of hexadecimal digits is a digest or an id; runs of digits inside it are no numbers.
_IN_HEX = ("element_at(transform(array(concat(regexp_extract(left(v.s, m.p), '((?<![A-Za-z0-9])[A-Za-z0-9]*+)$', 1), '+', ltrim('+', m.x), '+', "
           "regexp_extract(substring(v.s, m.p + length(m.x) + 1), '^([A-Za-z0-9]*+)', 1))), t -> length(t) >= 26 AND rlike(t, '^[0-9a-fA-F+]+$')), 1)")


def _numbers(names) -> str:
    """Findings among the digit runs of view v. A leading plus belongs to +91 only."""
    kinds = [n for n in _NUMBER_KINDS if n in names]
    plus = "rlike(m.x, '^\\\\+91[1-9][0-9]{9}$')"
    bare = ("ltrim('+', m.x)", "(m.p + CASE WHEN startswith(m.x, '+') THEN 1 ELSE 0 END)")
    out = []
    for n in kinds:
        body = f"CASE WHEN {plus} THEN {_found(n)} ELSE {_found(n, *bare)} END" if n == "phone_in" else _found(n, *bare)
        out.append(f"CASE WHEN {_NUMBER_KINDS[n]} THEN {body} END")
    body = f"CASE WHEN NOT {_IN_HEX} THEN array_compact(array({', '.join(out)})) END"
    return f"flatten(array_compact({_places(_cut('v.s', _NUMBERS), body)}))"


def _of_view(names) -> str:
    """All findings of view v."""
    parts = []
    for n, (patterns, run, keep) in DETECTORS.items():
        if n in names:
            parts += [f"CASE WHEN v.run >= {run} THEN {_hits(p, _found(n), keep)} END" for p in patterns]
    if set(names) & set(_NUMBER_KINDS):
        parts.append(f"CASE WHEN v.run >= 9 THEN {_numbers(names)} END")
    if "phone_in" in names:
        parts.append(f"CASE WHEN v.joins IS NULL AND v.run >= 2 AND contains(v.s, '(') THEN {_hits(_PAREN_PHONE, _found('phone_in'))} END")
    if "email" in names:
        worded = f"rlike(v.s, {_sql(rf'{_OPEN}\s*(?i:at)\s*{_CLOSE}|\s(?i:at)\s')})"
        parts += [f"CASE WHEN v.joins IS NULL AND {guard} THEN {_hits(p, _found('email'))} END" for p, guard in zip(_EMAILS, ("contains(v.s, '@')", worded, worded))]
    if "upi_id" in names:
        parts.append(f"CASE WHEN v.joins IS NULL AND contains(v.s, '@') THEN {_hits(_UPI, _found('upi_id'))} END")
    if "person_name" in names:
        name = "concat(left(m.x, 1), '***')"
        marked = ", ".join(_hits(p, _found("person_name", masked=name)) for p in _MARKED)
        parts.append(f"CASE WHEN v.joins IS NULL AND rlike(v.s, {_sql(_NAME_GUARD)}) THEN flatten(array_compact(array({marked}))) END")
    return f"flatten(array_compact(array({', '.join(parts)})))"


def _lexicon_runs(text: str, lexicon: tuple[str, ...]) -> str:
    """Runs of capitalised (or native) words of the text that hold a word of the lexicon."""
    words = "array(" + ", ".join("'" + w[:1].upper() + w[1:] + "'" for w in lexicon) + ")"
    seen = f"array_intersect(regexp_extract_all({text}, '([A-Z][a-z]+|[{INDIC}]+)', 1), {words})"
    run = _places(_cut(text, _RUNS), f"CASE WHEN arrays_overlap(split(m.x, ' '), hits) THEN named_struct('detector', 'person_name', 'masked', concat(left(m.x, 1), '***'), "
                                     f"'start', CAST(m.p AS INT), 'end', CAST(m.p + length(m.x) AS INT), 'raw', m.x) END")
    return f"transform(array({seen}), hits -> CASE WHEN size(hits) > 0 THEN array_compact({run}) END)[0]"


def dealt(docs: DataFrame) -> DataFrame:
    """The rows dealt out evenly over all cores: a file of a million short rows is one row group, and its scan one task."""
    spark = docs.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * spark.sparkContext.defaultParallelism)
    return docs.repartition(parts, F.xxhash64(*[F.col(f"`{x}`") for x in docs.columns]))


def scanned(docs: DataFrame, names=ALL_DETECTORS, text: str = "text", lexicon: tuple[str, ...] = NAMES) -> DataFrame:
    """Add ``found``: array of (detector, masked, start, end, raw), each once. ``raw`` is restricted and must not be published."""
    out = _views(dealt(docs), text)
    out = out.withColumn("__found", F.expr(f"flatten(transform(views, v -> {_of_view(names)}))")).drop("views")
    both = f"array_distinct(flatten(array_compact(array(__found, {_lexicon_runs(text, lexicon)}))))" if "person_name" in names else "array_distinct(coalesce(__found, array()))"
    return out.withColumn("found", F.expr(both)).drop("__found")


def findings(docs: DataFrame, key: list[str], names=ALL_DETECTORS, text: str = "text", lexicon: tuple[str, ...] = NAMES) -> DataFrame:
    """(key, detector, masked, start, end), each once; nothing is shuffled."""
    found = scanned(docs.select(*key, text), names, text, lexicon)
    return found.select(*key, F.expr("inline(array_distinct(transform(found, f -> named_struct('detector', f.detector, 'masked', f.masked, 'start', f.start, 'end', f.end))))"))


def masked_findings(docs: DataFrame, key: list[str], names=ALL_DETECTORS, text: str = "text", lexicon: tuple[str, ...] = NAMES) -> DataFrame:
    """(key, detector, masked), once a text however often the value is in it."""
    found = scanned(docs.select(*key, text), names, text, lexicon)
    return found.select(*key, F.expr("inline(array_distinct(transform(found, f -> named_struct('detector', f.detector, 'masked', f.masked))))"))


def blocked(docs: DataFrame, key: list[str], text: str = "text", lexicon: tuple[str, ...] = NAMES) -> DataFrame:
    """Texts the gate refuses: those with at least one finding in any view."""
    # a generator of at most one row, not a filter: a pushed filter would scan twice
    return scanned(docs.select(*key, text), ALL_DETECTORS, text, lexicon).select(*key, F.expr("inline(slice(found, 1, 1))")).select(*key)
