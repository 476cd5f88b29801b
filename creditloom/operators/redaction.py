"""File-wide redaction: one token per value of a file, whatever text, case, script or separators it is written in.

The gate finds values with their spans; of spans that overlap one is chosen in the row by the rank of its detector and its
length. A value's canonical form and the file's aliases put all its mentions in one class, classes are numbered inside the file,
declared values first and the others by first place, and each span of a text is replaced by the token of its class. A second
scan replaces what is still found by ``[REDACTED]``.

Defined results: a null text stays null; a value of a file that has no inventory is numbered by first place alone; an alias of
an unknown value is a value of its own; aliases that form a ring are one class, named by its smallest form; texts are told
apart by ``key``, which must be unique.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditloom.functions import ranks
from creditloom.operators import gate
from creditloom.session import ensure_checkpoint_dir

#: Detector -> kind of its tokens. Of overlapping findings the earlier detector of the list wins, numbers by length first.
KINDS = {"email": "EMAIL", "upi_id": "UPI", "pan": "PAN", "ifsc": "IFSC", "passport": "PASSPORT", "voter_id": "VOTER", "driving_licence": "DL", "card_number": "CARD",
         "aadhaar_vid": "UID", "aadhaar": "UID", "phone_in": "PHONE", "account_number": "ACCT", "pincode_ctx": "PIN", "person_name": "PERSON"}
_NUMBERS = ("card_number", "aadhaar_vid", "aadhaar", "phone_in", "account_number")
REDACTED = "[REDACTED]"
#: Classes of one file and kind are numbered in runs of texts, so that a file of any size is never sorted in one task.
RUN_TEXTS = 256


def _rank(f: str) -> str:
    """Sort key of a finding: smaller wins."""
    whens = " ".join(f"WHEN '{d}' THEN {i if d not in _NUMBERS else list(KINDS).index(_NUMBERS[0])}" for i, d in enumerate(KINDS))
    ties = " ".join(f"WHEN '{d}' THEN {i}" for i, d in enumerate(KINDS))
    return f"struct(CASE {f}.detector {whens} ELSE 99 END, {f}.start - {f}.end, CASE {f}.detector {ties} ELSE 99 END, {f}.start, {f}.raw)"


def chosen(found: str = "found") -> str:
    """The findings of a text that are replaced: no two overlap, and none that is left out beats all those it overlaps."""
    order = f"transform(array_sort(transform({found}, f -> struct({_rank('f')} AS r, f AS f))), x -> x.f)"
    free = "NOT exists(a, g -> f.start < g.end AND g.start < f.end)"
    # the empty slice gives the fold its type
    return f"aggregate({order}, slice({found}, 1, 0), (a, f) -> CASE WHEN {free} THEN array_append(a, f) ELSE a END)"


def canonical(kind: str, raw: str) -> str:
    """One form for all ways to write a value of a kind."""
    bare = f"upper(regexp_replace({raw}, '[^\\\\p{{L}}\\\\p{{N}}]', ''))"
    digits = f"regexp_replace({raw}, '[^0-9]', '')"
    at = f"regexp_replace(lower({raw}), '\\\\s*[\\\\[({{<]\\\\s*at\\\\s*[\\\\])}}>]\\\\s*|\\\\s+at\\\\s+|\\\\s*@\\\\s*', '@')"
    dot = f"regexp_replace({at}, '\\\\s*[\\\\[({{<]\\\\s*dot\\\\s*[\\\\])}}>]\\\\s*|\\\\s+dot\\\\s+', '.')"
    return (f"CASE WHEN {kind} = 'PHONE' THEN right({digits}, 10) WHEN {kind} IN ('UID', 'ACCT', 'CARD', 'PIN') THEN {digits} WHEN {kind} IN ('EMAIL', 'UPI') THEN {dot}"
            f" WHEN {kind} IN ('PERSON', 'ORG', 'ADDR') THEN trim(regexp_replace(lower({raw}), '[\\\\s.,]+', ' ')) ELSE {bare} END")


def _stored(df: DataFrame, name: str) -> DataFrame:
    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/redact-{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spans(texts: DataFrame, key: str, file: str = "file_id", text: str = "text") -> DataFrame:
    """(key, file, start, end, kind, form) of the values to replace, stored; ``form`` is restricted and must not be published."""
    found = gate.scanned(texts.select(key, file, text), text=text)
    kind = "CASE f.detector " + " ".join(f"WHEN '{d}' THEN '{k}'" for d, k in KINDS.items()) + " END"
    out = found.select(key, file, F.inline(F.expr(f"transform({chosen()}, f -> named_struct('start', f.start, 'end', f.end, 'kind', {kind}, 'raw', f.raw))")))
    return _stored(out.withColumn("form", F.expr(canonical("kind", "raw"))).drop("raw"), "spans")


def alias_classes(inventory: DataFrame, file: str = "file_id") -> DataFrame:
    """(file, kind, form, root): for each alias form the smallest form of its class.

    Aliases are links between forms; labels are passed on over the links until none changes, each round halving the way by a jump
    to the label's label. A file declares few aliases, and only forms with a link take part.
    """
    pair = inventory.filter("canonical IS NOT NULL").select(file, "kind", F.expr(canonical("kind", "value")).alias("a"), F.expr(canonical("kind", "canonical")).alias("b")).filter("a <> b")
    links = _stored(pair.union(pair.select(file, "kind", F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    on = [file, "kind"]
    labels = _stored(links.groupBy(*on, F.col("a").alias("form")).agg(F.least(F.min("b"), F.first("a")).alias("root")), "labels")
    while True:
        near = links.join(labels.select(*on, F.col("form").alias("b"), "root"), [*on, "b"]).groupBy(*on, F.col("a").alias("form")).agg(F.min("root").alias("near"))
        jump = labels.select(*on, F.col("form").alias("root"), F.col("root").alias("jump"))
        new = labels.join(near, [*on, "form"]).join(jump, [*on, "root"], "left").select(
            *on, "form", F.least("root", "near", "jump").alias("root"), (F.least("near", "jump") < F.col("root")).alias("moved"))
        new = _stored(new, "labels")
        labels = new.drop("moved")
        if new.filter("moved").isEmpty():
            return labels


def tokens(found: DataFrame, inventory: DataFrame, key: str, file: str = "file_id") -> DataFrame:
    """(file, kind, form, n, token) for every form found in a file or declared for it.

    ``inventory`` holds (file, kind, value, pos, canonical): declared values by ``pos``; ``canonical`` is null but for aliases.
    """
    on = [file, "kind", "form"]
    declared = inventory.select(file, "kind", F.expr(canonical("kind", "value")).alias("form"), F.lit(0).alias("late"), F.col("pos").cast("long").alias("place"), F.lit(0).alias("at"))
    seen = found.select(*on, F.lit(1).alias("late"), F.col(key).cast("long").alias("place"), F.col("start").alias("at"))
    forms = declared.unionByName(seen).groupBy(*on).agg(F.min(F.struct("late", "place", "at")).alias("first"))
    forms = forms.join(alias_classes(inventory, file), on, "left").withColumn("root", F.coalesce("root", "form"))
    forms = _stored(forms, "forms")
    classes = forms.groupBy(file, "kind", "root").agg(F.min("first").alias("first")).select(file, "kind", "root", "first.*")
    order = [F.col("at"), F.col("root")]
    numbered = ranks.row_numbers(classes, [file, "kind"], F.when(F.col("late") == 0, F.lit(-1)).otherwise(F.floor(F.col("place") / RUN_TEXTS)).cast("long"),
                                 {"fine": F.col("place")}, [F.col("fine")], order, "n")
    token = F.when((F.col("kind") == "PERSON") & (F.col("n") == 1) & (F.col("late") == 0), F.lit("[APPLICANT]")).otherwise(
        F.concat(F.lit("["), "kind", F.lit("_"), F.col("n").cast("string"), F.lit("]")))
    named = numbered.withColumn("token", token).select(file, "kind", "root", "n", "token")
    return forms.join(named, [file, "kind", "root"]).select(*on, "n", "token")


def _replaced(text: str, spans_: str) -> str:
    """The text with each span's token in its place; spans are sorted and don't overlap."""
    step = f"named_struct('at', s.end, 'out', concat(a.out, substring({text}, a.at + 1, s.start - a.at), s.token))"
    return f"aggregate({spans_}, named_struct('at', 0, 'out', ''), (a, s) -> {step}, a -> concat(a.out, substring({text}, a.at + 1)))"


def redacted(texts: DataFrame, found: DataFrame, named: DataFrame, key: str, file: str = "file_id", text: str = "text") -> DataFrame:
    """The texts with every span replaced by its class's token, then scanned once more; all other columns stay."""
    placed = found.join(named, [file, "kind", "form"]).select(key, "start", "end", "token")
    # the spans of one text, which do not overlap
    lists = placed.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("start", "end", "token"))).alias("__spans"))
    once = texts.join(lists, key, "left").withColumn(text, F.expr(f"CASE WHEN __spans IS NULL THEN {text} ELSE {_replaced(text, '__spans')} END")).drop("__spans")
    again = gate.scanned(once, text=text)
    left = f"transform(array_sort({chosen()}, (x, y) -> x.start - y.start), f -> named_struct('start', f.start, 'end', f.end, 'token', '{REDACTED}'))"
    return again.withColumn(text, F.expr(f"CASE WHEN size(found) = 0 THEN {text} ELSE {_replaced(text, left)} END")).select(*texts.columns)


def redact(texts: DataFrame, inventory: DataFrame, key: str, file: str = "file_id", text: str = "text") -> DataFrame:
    """All steps: find, number inside each file, replace."""
    found = spans(texts, key, file, text)
    return redacted(texts, found, tokens(found, inventory, key, file), key, file, text)
