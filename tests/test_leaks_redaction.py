"""Leaks of a file's own inventory and file-wide redaction."""

from __future__ import annotations

import random

from creditloom.operators import leaks, redaction

INVENTORY = "file_id bigint, kind string, value string, item string"
VALUES = [(1, "pan", "ABCPE1234F", ""), (1, "phone", "+91 98765 43210", ""), (1, "person_name", "Ramesh Kumar", ""), (1, "address", "12, MG Road, Pune 411001", ""),
          (2, "pan", "ZZZPE9999G", ""), (2, "email", "u@mail.com", ""), (2, "account", None, ""), (2, "pan", "A1", ""), (None, "pan", "QQQPE1111Q", "")]
TEXTS = [(1, 1, "pan abcpe 1234 f", {"pan"}), (2, 1, "call 0 98765-43210", {"phone"}), (3, 1, "ring +919876543210", {"phone"}), (4, 1, "Kumar came", {"person_name_part"}), (5, 1, "Kumaran, a_kumar", set()),
         (6, 1, "ramesh  KUMAR", {"person_name", "person_name_part"}), (7, 1, "at 12, mg road, pune 411 001 ok", {"address"}), (8, 1, "АВСРЕ1234F", {"pan"}), (9, 2, "ABCPE1234F", set()),
         (10, 2, "to U@MAIL.com", {"email"}), (11, None, "QQQPE1111Q", set()), (12, 3, "ABCPE1234F", set()), (13, 1, None, set()), (14, 1, "", set()), (15, 1, "a/c ९८७६५४३२१०", {"phone"})]


def test_leaks_are_searched_in_the_texts_of_their_file(spark):
    texts = spark.createDataFrame([t[:3] for t in TEXTS], "i bigint, file_id bigint, text string")
    inventory = spark.createDataFrame(VALUES, INVENTORY)
    got = {}
    for r in leaks.leak_scan(texts, inventory, "i").collect():
        got.setdefault(r.i, set()).add(r.kind)
    assert got == {i: kinds for i, _, _, kinds in TEXTS if kinds}
    assert leaks.leak_scan(texts, inventory.limit(0), "i").collect() == [] and leaks.leak_scan(texts.limit(0), inventory, "i").collect() == []


def test_large_inventories_are_cut_and_joined_by_a_shuffle(spark, monkeypatch):
    monkeypatch.setattr(leaks, "CHUNK", 7)
    monkeypatch.setattr(leaks, "BROADCAST_VALUES", -1)
    rnd = random.Random(2)
    values = sorted({"".join(rnd.choice("abc") for _ in range(rnd.randint(4, 7))) for _ in range(60)})
    rows = [(i % 3, "code", v, str(i)) for i, v in enumerate(values)]
    texts = [(i, i % 3, "".join(rnd.choice("abc ") for _ in range(60))) for i in range(30)]
    got = {(r.i, r.item) for r in leaks.leak_scan(spark.createDataFrame(texts, "i bigint, file_id bigint, text string"), spark.createDataFrame(rows, INVENTORY), "i").collect()}
    assert got == {(i, item) for i, f, t in texts for g, _, v, item in rows if f == g and v in " ".join(t.split())}


def test_passages_are_found_as_whole_words(spark):
    texts = spark.createDataFrame([(1, 0, "see Flat 12 Rose Garden Lane, now"), (2, 0, "flat 12 rose"), (3, 0, "Flat 12 Rose Garden Lanes")], "i bigint, file_id bigint, text string")
    known = spark.createDataFrame([(0, leaks.PASSAGE, "Flat 12, Rose Garden Lane", "7"), (0, leaks.PASSAGE, " - ", "8")], INVENTORY)
    assert [(r.i, r.item) for r in leaks.leak_scan(texts, known, "i").collect()] == [(1, "7")]


KNOWN = "file_id bigint, kind string, value string, pos int, canonical string"


def redact(spark, rows, known=()):
    df = spark.createDataFrame([(i, f, t) for i, (f, t) in enumerate(rows)], "i bigint, file_id bigint, text string")
    return [r.text for r in redaction.redact(df, spark.createDataFrame(list(known), KNOWN), "i").orderBy("i").collect()]


def test_one_value_has_one_token_in_all_texts_of_its_file(spark):
    rows = [(1, "PAN ABCPE1234F, again abcpe 1234 f; Aadhaar 2345 6789 0123."), (1, "Aadhaar २३४५-६७८९-०१२३, pan ZZZPE9999G and АВСРЕ1234F"), (2, "only ZZZPE9999G"), (2, None), (2, ""), (2, "nothing to see")]
    assert redact(spark, rows) == ["PAN [PAN_1], again [PAN_1]; Aadhaar [UID_1].", "Aadhaar [UID_1], pan [PAN_2] and [PAN_1]", "only [PAN_1]", None, "", "nothing to see"]


def test_declared_values_come_first_and_aliases_share_a_token(spark):
    known = [(1, "PAN", "QQQPE1111Q", 0, None), (1, "PAN", "abcpe-1234-f", 1, "RRRPE2222R"), (1, "PAN", "RRRPE2222R", 2, "qqqpe1111q"), (1, "PERSON", "Ramesh Kumar", 0, None), (1, "PAN", "SSSPE3333S", 9, "unknown")]
    rows = [(1, "ZZZPE9999G and ABCPE1234F, RRRPE 2222 R, QQQPE1111Q of Mr Ramesh Kumar and Smt Sunita Rao"), (2, "ABCPE1234F")]
    assert redact(spark, rows, known) == ["[PAN_3] and [PAN_1], [PAN_1], [PAN_1] of Mr [APPLICANT] and Smt [PERSON_2]", "[PAN_1]"]


def test_rings_and_long_chains_of_aliases_are_one_class(spark):
    chain = [(1, "PAN", f"AAAPE{i:04d}A", i, f"AAAPE{i + 1:04d}A") for i in range(20)] + [(2, "PAN", "AAAPE0001A", 0, "AAAPE0002A"), (2, "PAN", "AAAPE0002A", 1, "AAAPE0001A")]
    got = redaction.alias_classes(spark.createDataFrame(chain, KNOWN)).collect()
    assert len({r.root for r in got if r.file_id == 1}) == 1 and len([r for r in got if r.file_id == 1]) == 21
    assert {(r.form, r.root) for r in got if r.file_id == 2} == {("AAAPE0001A", "AAAPE0001A"), ("AAAPE0002A", "AAAPE0001A")}


def test_of_overlapping_findings_rank_and_length_decide(spark):
    rows = [(1, "card 4111 1111 1111 1111"), (2, "vid 4785 3805 9239 1130"), (3, "+91 98765 43210"), (4, "DL MH12 20110012345"), (5, "a.b@mail.com and 123456789"), (6, "GSTIN 29ABCPE1234F1Z5")]
    assert redact(spark, rows) == ["card [CARD_1]", "vid [UID_1]", "[PHONE_1]", "DL [DL_1]", "[EMAIL_1] and [ACCT_1]", "GSTIN 29[PAN_1]1Z5"]


def test_files_of_many_texts_are_numbered_by_first_place(spark, monkeypatch):
    monkeypatch.setattr(redaction, "RUN_TEXTS", 4)
    rnd = random.Random(3)
    picks = [[rnd.randrange(40) for _ in range(rnd.randint(0, 4))] for _ in range(50)]
    rows = [(1, "; ".join(f"PAN ABCPE{p:04d}F" for p in ps)) for ps in picks]
    order = list(dict.fromkeys(p for ps in picks for p in ps))
    assert redact(spark, rows) == ["; ".join(f"PAN [PAN_{order.index(p) + 1}]" for p in ps) for ps in picks]
