"""One gate: every detector, every disguise, spans in the text as written, clean texts."""

from __future__ import annotations

import base64
import random

import pytest

from creditloom.operators import gate

POSITIVE = {
    "pan": ["PAN ABCPE1234F", "GSTIN 29ABCPE1234F1Z5", "PANABCPE1234F", "A B C P E 1 2 3 4 F", "ABCPE-1234-F"],
    "aadhaar": ["2345 6789 0123", "234567890123", "2345-6789-0123"], "aadhaar_vid": ["4785 3805 9239 1139"],
    "account_number": ["a/c 123456789"], "card_number": ["4111 1111 1111 1111"],
    "phone_in": ["98765 43210", "+91 9876543210", "0091-98765-43210", "(022) 2345 6789"],
    "ifsc": ["SBIN0001234"], "passport": ["K1234567", "K 1234567"], "voter_id": ["ABC1234567"], "driving_licence": ["MH12 20110012345"],
    "pincode_ctx": ["PIN code: 560034", "pin 560 034", "Bengaluru - 560034", "12 MG Road, Mysuru - 570001", "पिन कोड: 560034"],
    "email": ["a.b@mail.example.com", "a.b [at] mail [dot] com", "write to a at mail dot com"], "upi_id": ["pay ramesh.k@okbank now"],
    "person_name": ["We met Mr Zoravar Lal today", "S/o Gopal Das, age 3", "son of Gopal Das", "Applicant name: tara bose", "Signed by Priya Zorba, clerk", "श्री मोहन लाल आए", "नाम: राजेश",
                    "Late in May Sunita Rao came"],
}
CLEAN = ["Band 50L-1Cr or 750-799 and 25-50k.", "[PAN_1] and [APPLICANT] at [ADDR_2].", "Ratios 0.30 0.15 0.45 0.22 0.18.", "March 2026 A review of 12 months.",
         "id 3f2504e0-4f89-11d3-9a0c-0305e82c3301", "hash 24be64439e3e49cf46b2d7c90f3602a3d0b907ff", "560034 alone", "Loan of 45,000 over 36 months.", "one or two of seven, oh no",
         "Bank name: State Holdings", "100%25 and 5% off & more", "The Quick Brown Fox ran.", "Größe naïve café — “ok” … 5 €", None, "", " ", "12", "justalongwordwithoutanything"]
# how it is written, what of it is found, and as what
DISGUISED = [
    ("Aadhaar २३४५ ६७८९ ०१२३.", "२३४५ ६७८९ ०१२३", "aadhaar", "23********23"), ("call ９８７６５ ４３２１０", "９８７６５ ４３２１０", "phone_in", "98******10"),
    ("ring nine eight seven six five four three two one zero now", "nine eight seven six five four three two one zero", "phone_in", "98******10"),
    ("ring double nine eight seven six five four three two one", "double nine eight seven six five four three two one", "phone_in", "99******21"),
    ("PAN АВСРЕ 1234F", "АВСРЕ 1234F", "pan", "AB******4F"), ("Mail a&#64;b.com!", "a&#64;b.com", "email", "a@**om"), ("a/c 98765​43210", "98765​43210", "account_number", "98******10"),
    ("id %41%42%43PE1234F", "%41%42%43PE1234F", "pan", "AB******4F"), ("tel 9876O43210", "9876O43210", "phone_in", "98******10"),
    ("blob " + base64.b64encode(b"mail me: someone@example.com").decode() + " end", base64.b64encode(b"mail me: someone@example.com").decode(), "email", "so**************om"),
    ("hex " + b"someone@example.com".hex(), b"someone@example.com".hex(), "email", "so**************om"), ("Ｒef 𝟒𝟏𝟏𝟏 1111 1111 1111", "𝟒𝟏𝟏𝟏 1111 1111 1111", "card_number", "41************11"),
]


def scan(spark, texts, **kw):
    df = spark.createDataFrame(list(enumerate(texts)), "i bigint, text string")
    out = {}
    for r in gate.findings(df, ["i"], **kw).collect():
        out.setdefault(r.i, set()).add((r.detector, r.masked, r.start, r.end))
    return out


def test_every_detector_catches_its_examples(spark):
    cases = [(d, t) for d, ts in POSITIVE.items() for t in ts]
    got = scan(spark, [t for _, t in cases])
    for i, (d, t) in enumerate(cases):
        assert d in {x[0] for x in got.get(i, set())}, (d, t)


def test_clean_texts_are_silent(spark):
    assert scan(spark, CLEAN) == {}


def test_disguised_values_are_found_where_they_are_written(spark):
    quiet = "plain words that hold nothing at all and go on and on " * 30
    texts = [f"{before}{t}{after}" for t, *_ in DISGUISED for before, after in (("", ""), (quiet, ""), (quiet, " " + quiet), ("é​ü ", " ﬁn"))]
    got = scan(spark, texts)
    for i, text in enumerate(texts):
        _, written, detector, masked = DISGUISED[i // 4]
        at = text.index(written)
        assert (detector, masked, at, at + len(written)) in got.get(i, set()), (text[-60:], got.get(i))


def test_maps_of_normalised_text_cover_the_original():
    rnd = random.Random(1)
    marks = ["a", "9", "०", "ﬁ", "é", "é", "&amp;", "%41%42%43", "​", " ", "nine", "eight ", "double two", "O", "l", "１", "А", "½", "ｶﾞ", "\U000e0041", "日"]
    for _ in range(400):
        text = "".join(rnd.choice(marks) for _ in range(rnd.randint(0, 30)))
        plain, starts, ends = gate.normalized(text)
        assert len(plain) == len(starts) == len(ends) and all(0 <= a < b <= len(text) for a, b in zip(starts, ends))
        assert starts == sorted(starts) and ends == sorted(ends)
        for ch, a, b in zip(plain, starts, ends):
            assert ch == text[a:b] or b - a >= 1
        if text.isascii() and not any(x in text for x in ("&", "%", "O", "l", "nine", "eight", "two")):
            assert plain == text


def test_a_window_is_found_in_texts_of_any_length(spark):
    got = scan(spark, ["word " * 60000 + "4111111111111111", "x" * 200000 + " 98765 43210 " + "y" * 100000, "9 " * 3000 + ", 98765 43210", "PIN" + " " * 120 + "560034", "bob at " + "x" * 70 + " dot com"])
    assert ("card_number", "41************11", 300000, 300016) in got[0] and ("phone_in", "98******10", 200001, 200012) in got[1] and 2 in got
    assert any(d == "pincode_ctx" for d, *_ in got[3]) and any(d == "email" for d, *_ in got[4])


def test_blocking_and_tables_without_rows(spark):
    df = spark.createDataFrame([(1, "PAN ABCPE1234F"), (2, "nothing"), (3, "Bengaluru - 560034"), (4, None), (4, None)], "i bigint, text string")
    assert sorted(r.i for r in gate.blocked(df, ["i"]).collect()) == [1, 3]
    assert gate.findings(df.limit(0), ["i"]).collect() == []


@pytest.mark.parametrize("lexicon, hit", [(("zorba",), True), (("nobody",), False)])
def test_the_lexicon_is_a_parameter(spark, lexicon, hit):
    assert bool(scan(spark, ["Signed by Priya Zorba today"], lexicon=lexicon)) is hit


def test_card_numbers_are_not_read_as_hexadecimal_handles(spark):
    number = b"Aqq@dFAD".hex()
    assert number.isdigit() and len(number) == 16
    rows = [(0, f"card {number} here"), (1, "hex " + b"ramesh@okbank".hex()), (2, "hex " + b"A1234567".hex()), (3, "hex " + b"ABCPE1234F".hex())]
    found = gate.masked_findings(spark.createDataFrame(rows, "i bigint, text string"), ["i"]).collect()
    got = {(r.i, r.detector) for r in found}
    assert (0, "upi_id") not in got and (0, "account_number") in got and {(1, "upi_id"), (2, "passport"), (3, "pan")} <= got
