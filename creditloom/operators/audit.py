"""Tamper-evident audit log: sealing, verification, trail completeness and as-of lookups.

A single global chain cannot be built in parallel, so entries are chained inside blocks of a file's log. The last hash of
each block is its head; heads are stored apart from the log and roll up to one root per file. Verification recomputes both
levels: row by row with an equality join on the previous entry, and block by block against the stored heads, so that a
block that was rewritten from its first entry to its last is found as well.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from creditloom import reference as R
from creditloom.functions import ranks
from creditloom.functions.bands import _text
from creditloom.session import ensure_checkpoint_dir

BLOCK = 256  # entries per chain; bounds the array one task folds, however long a file's log grows
c = F.col


def _genesis(block: Column) -> Column:
    """The first block of a file starts from the fixed genesis hash, later ones from their own number."""
    return F.when(block == 0, F.lit(R.GENESIS_HASH)).otherwise(F.sha2(F.concat(F.lit("block:"), block.cast("string")), 256))


def seal(events: DataFrame, body: list[str]) -> DataFrame:
    """Adds prev_hash and entry_hash: entry = sha256(prev + sha256(body)).

    Bodies are hashed before the shuffle, so only 64 characters per entry travel to the fold.
    """
    rows = events.select(
        "file_id", "seq", F.floor((c("seq") - 1) / BLOCK).cast("bigint").alias("block"),
        F.sha2(F.concat_ws("|", *[F.coalesce(c(x).cast("string"), F.lit("~")) for x in body]), 256).alias("body_hash"))
    grouped = rows.groupBy("file_id", "block").agg(F.array_sort(F.collect_list(F.struct("seq", "body_hash"))).alias("entries"))
    empty = "cast(array() as array<struct<seq:bigint,prev_hash:string,entry_hash:string>>)"
    fold = (f"aggregate(entries, named_struct('last', genesis, 'out', {empty}), (a, e) -> named_struct('last', sha2(concat(a.last, e.body_hash), 256),"
            " 'out', concat(a.out, array(named_struct('seq', e.seq, 'prev_hash', a.last, 'entry_hash', sha2(concat(a.last, e.body_hash), 256))))), a -> a.out)")
    chained = grouped.withColumn("genesis", _genesis(c("block"))).select("file_id", "block", F.expr(f"inline({fold})"))
    return rows.join(chained.drop("block"), ["file_id", "seq"])


def block_heads(sealed: DataFrame) -> DataFrame:
    """(file_id, block, seq, head): the last entry of each block and its hash, to be stored apart from the log."""
    last = F.max(F.struct("seq", "entry_hash")).alias("last")
    return sealed.groupBy("file_id", "block").agg(last).select("file_id", "block", "last.seq", c("last.entry_hash").alias("head"))


def file_roots(heads: DataFrame, fan_in: int = BLOCK) -> DataFrame:
    """(file_id, root): block heads hashed in order, ``fan_in`` at a time, until one hash a file is left.

    No task ever folds more than ``fan_in`` hashes; the number of rounds is the logarithm of the longest log.
    """
    level, longest = heads.select("file_id", c("block").alias("i"), c("head").alias("h")), heads.agg(F.max("block")).first()[0] or 0
    while True:
        ordered = F.transform(F.array_sort(F.collect_list(F.struct("i", "h"))), lambda x: x["h"])
        level = level.withColumn("up", F.floor(c("i") / fan_in).cast("bigint")).groupBy("file_id", "up").agg(F.sha2(F.array_join(ordered, "|"), 256).alias("h")).withColumnRenamed("up", "i")
        longest //= fan_in
        if not longest:
            return level.select("file_id", c("h").alias("root"))


_REASONS = ("missing_entry", "broken_link", "modified_entry", "truncated", "rewritten_block")


def verify(log: DataFrame, high_water: DataFrame, heads: DataFrame | None = None) -> DataFrame:
    """First bad sequence number and reason of each file with a problem.

    Each row re-hashes itself; its link is checked against the row one sequence earlier by an equality join (no window
    over a file); a tail shorter than the recorded high-water mark is a truncation; with stored ``heads``, a block whose last
    entry differs from its head was rewritten.
    """
    kinds = len(_REASONS)
    first = (c("seq") - 1) % BLOCK == 0
    prev = log.select("file_id", (c("seq") + 1).alias("seq"), c("entry_hash").alias("before"))
    j = log.join(prev, ["file_id", "seq"], "left")
    linked = F.when(first, c("prev_hash") == _genesis(c("block"))).otherwise(c("prev_hash") == c("before"))
    own = F.sha2(F.concat("prev_hash", "body_hash"), 256) == c("entry_hash")
    gap = (c("seq") > 1) & c("before").isNull()
    # reasons ranked as a sequential walk would meet them: a gap is noticed at the missing entry
    code = F.when(gap, (c("seq") - 1) * kinds).when(~linked, c("seq") * kinds + 1).when(~own, c("seq") * kinds + 2)
    bad = j.select("file_id", code.alias("code")).filter("code IS NOT NULL")
    tail = log.groupBy("file_id").agg(F.max("seq").alias("last"))
    cut = high_water.join(tail, "file_id", "left").filter(F.coalesce("last", F.lit(0)) < c("high")).select(
        "file_id", ((F.coalesce("last", F.lit(0)) + 1) * kinds + 3).alias("code"))
    bad = bad.unionByName(cut)
    if heads is not None:
        ends = log.select("file_id", "seq", "entry_hash").join(heads.select("file_id", "seq", "head"), ["file_id", "seq"])
        bad = bad.unionByName(ends.filter("entry_hash <> head").select("file_id", (c("seq") * kinds + 4).alias("code")))
    worst = bad.groupBy("file_id").agg(F.min("code").alias("code"))
    return worst.select("file_id", F.floor(c("code") / kinds).cast("bigint").alias("first_bad_seq"),
                        F.get(F.array(*[F.lit(x) for x in _REASONS]), (c("code") % kinds).cast("int")).alias("reason"))


def trail(events: DataFrame, file_ids: DataFrame) -> DataFrame:
    """The events of the requested files in order. The request is a semi join, so it prunes by the join key."""
    return events.join(file_ids.select("file_id").distinct(), "file_id", "left_semi").orderBy("file_id", "seq")


#: Events that end a call to the model, whatever its result.
CALLS = ("MODEL_CALL", "MODEL_FAILURE", "PII_BLOCK")
PROCEED = "PROCEED_TO_SANCTIONING_AUTHORITY"
#: Events of one file and stage are numbered in runs of so many sequence numbers, so that a log of any length spreads.
RUN_EVENTS = 1024
#: A file's stage of more events than this (and twice the usual bucket of the count) is numbered in runs, any other in its own row.
LONG, BUCKETS = 10_000, 65_536
ON = ["file_id", "stage"]


def _stored(df: DataFrame, name: str) -> DataFrame:
    """Written to the shared folder and read back: what reads it starts from a scan."""
    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/trail-{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _numbered(events: DataFrame, kind: str, out: str, order: str = "seq") -> DataFrame:
    """Number of each event among those of its kind in its file and stage, stored."""
    return _stored(ranks.row_numbers(events, [*ON, kind], F.floor(c(order) / RUN_EVENTS).cast("bigint"), {"fine": c(order)}, [c("fine")], [c(order)], out), out)


def _long(known: DataFrame) -> DataFrame | None:
    """The files and stages of more events than a row should hold, if any.

    Events are counted by a hash of their file and stage first, which shuffles next to nothing; only those of a bucket that
    stands out are counted by file and stage.
    """
    known = known.select(*ON, F.pmod(F.xxhash64(*ON), F.lit(BUCKETS)).alias("bucket"))
    counts = _stored(known.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")), "counts")
    usual = (counts.agg(F.sum("n")).first()[0] or 0) / BUCKETS
    full = counts.filter(c("n") > LONG + 2 * usual).select("bucket")
    if full.isEmpty():
        return None
    return _stored(known.join(full, "bucket", "left_semi").groupBy(*ON).agg(F.count(F.lit(1)).alias("n")).filter(c("n") > LONG).select(*ON), "long")


def trail_problems(events: DataFrame, required: DataFrame) -> DataFrame:
    """(file_id, stage, attempt, problem): where the events of a stage break the protocol of its attempts.

    ``required`` holds (file_id, stage, needed): how often the stage was to run. Attempt i is the i-th model result with the i-th
    outcome; the outcomes that need a queue or a price claim the QUEUED and PRICING events of the stage in order. Attempt 0 stands
    for the stage as a whole. The events of a file's stage and what is required of it meet in one row by one grouping; a stage
    of more events than a row should hold is numbered in runs instead.
    """
    kind = F.when(c("event_type").isin(*CALLS), "CALL").when(c("event_type").isin("POLICY_OUTCOME", "QUEUED", "PRICING"), c("event_type"))
    known = events.filter("seq IS NOT NULL AND file_id IS NOT NULL AND stage IS NOT NULL").select(
        *ON, kind.alias("kind"), c("seq").cast("bigint").alias("seq"), "queue", "policy_outcome").filter("kind IS NOT NULL")
    required = required.select(*ON, F.coalesce("needed", F.lit(0)).cast("bigint").alias("needed"))
    long = _long(known)
    if long is None:
        return _row_problems(known, required)
    short = _row_problems(known.join(long, ON, "left_anti"), required.join(long, ON, "left_anti"))
    return short.unionByName(_run_problems(known.join(long, ON, "left_semi"), required.join(long, ON, "left_semi")))


def _row_problems(known: DataFrame, required: DataFrame) -> DataFrame:
    """``trail_problems`` of stages whose events fit a row."""
    rows = known.select(*ON, F.struct("kind", "seq", "queue", "policy_outcome").alias("e"), F.lit(None).cast("bigint").alias("needed"))
    asked = required.select(*ON, F.lit(None).cast(rows.schema["e"].dataType).alias("e"), "needed")
    df = rows.unionByName(asked).groupBy(*ON).agg(F.sort_array(F.collect_list("e")).alias("e"), F.collect_list("needed").alias("needed")).filter("size(needed) > 0")
    of = "filter(e, x -> x.kind = '{}')"
    df = df.selectExpr(*ON, "needed", f"transform({of.format('CALL')}, x -> x.seq) AS calls", f"{of.format('POLICY_OUTCOME')} AS outcomes",
                       f"{of.format('QUEUED')} AS queued", f"{of.format('PRICING')} AS pricing")
    df = df.selectExpr("*", "slice(transform(outcomes, (o, i) -> named_struct('i', CAST(i + 1 AS BIGINT), 'call', get(calls, i), 'outcome', o.seq, 'next_call', get(calls, i + 1),"
                            " 'next_outcome', get(outcomes, i + 1).seq, 'queue', o.queue, 'policy_outcome', o.policy_outcome)), 1, least(size(calls), size(outcomes))) AS pairs")
    df = df.selectExpr("*", "filter(pairs, p -> p.queue IS NOT NULL) AS want_queued", f"filter(pairs, p -> p.policy_outcome = '{PROCEED}') AS want_pricing")

    def found(over: str, names: str, attempt: str, tests: dict[str, str]) -> str:
        each = ", ".join(f"CASE WHEN {x} THEN named_struct('attempt', {attempt}, 'problem', '{n}') END" for n, x in tests.items())
        return f"flatten(transform({over}, {names} -> array_compact(array({each}))))"

    at = {k: {f"{k}_before_outcome": f"get({k}, j).seq <= p.outcome", f"{k}_after_next_outcome": f"get({k}, j).seq >= p.next_outcome"} for k in ("queued", "pricing")}
    at["queued"]["wrong_queue"] = "get(queued, j) IS NOT NULL AND NOT get(queued, j).queue <=> p.queue"
    counts = {"gateway_results": "size(calls) <> n", "policy_outcomes": "size(outcomes) <> n", "queued_events": "size(queued) <> size(want_queued)",
              "pricing_events": "size(pricing) <> size(want_pricing)"}
    parts = [found("pairs", "p", "p.i", {"outcome_before_result": "p.call >= p.outcome", "next_call_before_outcome": "p.outcome >= p.next_call"}),
             *[found(f"want_{k}", "(p, j)", "p.i", tests) for k, tests in at.items()], found("needed", "n", "0L", counts)]
    # a filter on the found problems would be pushed down and find them twice; the parts of an array are found once
    return df.selectExpr(*ON, f"explode(array({', '.join(parts)})) AS problems").selectExpr(*ON, "inline(problems)")


def _run_problems(known: DataFrame, required: DataFrame) -> DataFrame:
    """``trail_problems`` of stages of any length: events are numbered once and claims once; what has the same number meets in one
    grouping, not in a join for each pairing.
    """
    on = ON
    numbered = _numbered(known, "kind", "i")
    # an event stands at its own number and, as the next one, at the number before; a number without result and outcome is no attempt
    at = numbered.filter("kind IN ('CALL', 'POLICY_OUTCOME')").select(*on, "kind", "seq", "queue", "policy_outcome", F.expr("inline(array(struct(i AS i, true AS own), struct(i - 1 AS i, false AS own)))"))
    call, outcome = c("kind") == "CALL", c("kind") == "POLICY_OUTCOME"
    pairs = at.groupBy(*on, "i").agg(
        F.max(F.when(call & c("own"), c("seq"))).alias("call"), F.max(F.when(outcome & c("own"), c("seq"))).alias("outcome"),
        F.max(F.when(call & ~c("own"), c("seq"))).alias("next_call"), F.max(F.when(outcome & ~c("own"), c("seq"))).alias("next_outcome"),
        F.max(F.when(outcome & c("own"), c("queue"))).alias("queue"), F.max(F.when(outcome & c("own"), c("policy_outcome"))).alias("policy_outcome"),
    ).filter("call IS NOT NULL AND outcome IS NOT NULL")
    # (attempt, problem) of each pair and (kind, attempt) of each claim in one pass: a row with a kind is a claim
    pairs = pairs.select(*on, "i", "call", "outcome", "next_call", "next_outcome", "queue", F.explode(F.expr(
        "array_compact(array(CASE WHEN call >= outcome THEN struct(CAST(NULL AS STRING) AS kind, 'outcome_before_result' AS problem) END,"
        " CASE WHEN outcome >= next_call THEN struct(CAST(NULL AS STRING) AS kind, 'next_call_before_outcome' AS problem) END,"
        " CASE WHEN queue IS NOT NULL THEN struct('QUEUED' AS kind, CAST(NULL AS STRING) AS problem) END,"
        f" CASE WHEN policy_outcome = '{PROCEED}' THEN struct('PRICING' AS kind, CAST(NULL AS STRING) AS problem) END))")).alias("x"))
    pairs = pairs.select(*on, "i", "outcome", "next_outcome", "queue", "x.kind", "x.problem")
    claims = _numbered(pairs, "kind", "j", "i")
    tests = [claims.filter("problem IS NOT NULL").select(*on, c("i").alias("attempt"), "problem")]
    claims = claims.filter("kind IS NOT NULL")
    none = lambda t: F.lit(None).cast(t)
    found = numbered.filter("kind IN ('QUEUED', 'PRICING')").select(*on, "kind", c("i").alias("j"), none("bigint").alias("i"), none("bigint").alias("outcome"), none("bigint").alias("next_outcome"),
                                                                    none("string").alias("queue"), c("seq").alias("at"), c("queue").alias("got"))
    wanted = claims.select(*on, "kind", "j", "i", "outcome", "next_outcome", "queue", none("bigint").alias("at"), none("string").alias("got"))
    met = found.unionByName(wanted).groupBy(*on, "kind", "j").agg(*[F.max(x).alias(x) for x in ("i", "outcome", "next_outcome", "queue", "at", "got")]).filter("i IS NOT NULL AND at IS NOT NULL")
    checks = ("CASE WHEN at <= outcome THEN concat(name, '_before_outcome') END, CASE WHEN at >= next_outcome THEN concat(name, '_after_next_outcome') END,"
              " CASE WHEN kind = 'QUEUED' AND NOT got <=> queue THEN 'wrong_queue' END")
    tests.append(met.withColumn("name", F.lower("kind")).select(*on, c("i").alias("attempt"), F.explode(F.expr(f"array_compact(array({checks}))")).alias("problem")))
    n = lambda k: F.count_if(c("kind") == k)
    seen = numbered.groupBy(*on).agg(n("CALL").alias("n_calls"), n("POLICY_OUTCOME").alias("n_outcomes"), n("QUEUED").alias("n_queued"), n("PRICING").alias("n_pricing"))
    want = claims.groupBy(*on).agg(n("QUEUED").alias("want_queued"), n("PRICING").alias("want_pricing"))
    whole = required.join(seen, on, "left").join(want, on, "left").na.fill(0)
    off = {"gateway_results": "n_calls <> needed", "policy_outcomes": "n_outcomes <> needed", "queued_events": "n_queued <> want_queued", "pricing_events": "n_pricing <> want_pricing"}
    missing = ", ".join(f"CASE WHEN {x} THEN '{k}' END" for k, x in off.items())
    out = whole.select(*on, F.lit(0).cast("bigint").alias("attempt"), F.explode(F.expr(f"array_compact(array({missing}))")).alias("problem"))
    tests = tests[0].unionByName(tests[1]).withColumn("attempt", c("attempt").cast("bigint"))
    return out.unionByName(tests.join(required.select(*on), on, "left_semi"))


def completeness(problems: DataFrame, required: DataFrame) -> DataFrame:
    """Files and the share of them without a problem in any required stage."""
    flag = lambda required, bad: [F.lit(required).alias("required"), F.lit(bad).alias("bad")]
    both = required.select("file_id", *flag(True, False)).unionByName(problems.filter("file_id IS NOT NULL").select("file_id", *flag(False, True)))
    per = both.groupBy("file_id").agg(F.max("required").alias("required"), F.max("bad").alias("bad")).filter("required")
    return per.agg(F.count(F.lit(1)).alias("files"), F.avg(F.when(c("bad"), 0.0).otherwise(1.0)).alias("complete_share"))


def field_problems(events: DataFrame, known_types) -> DataFrame:
    """Rows that may not be appended, with every failed check; the rest of the batch is unaffected."""
    known = ", ".join(_text(t) for t in known_types)
    tests = {"event_type": f"event_type IS NULL OR event_type NOT IN ({known})", "latency_ms": "latency_ms IS NULL OR isnan(latency_ms) OR abs(latency_ms) = double('infinity')",
             "input_tokens": "tokens_text IS NOT NULL AND try_cast(tokens_text AS BIGINT) IS NULL", "detail_json": "detail IS NOT NULL AND try_parse_json(detail) IS NULL",
             "created_ts": "created_ts IS NULL"}
    problems = ", ".join(f"CASE WHEN {x} THEN '{k}' END" for k, x in tests.items())
    return events.withColumn("problems", F.expr(f"array_join(array_compact(array({problems})), ',')")).filter("problems <> ''")


def asof_last(left: DataFrame, right: DataFrame, key: list[str], order: str, values: list[str], block: int = 1024) -> DataFrame:
    """For each left row the values of the last right row of its key that comes strictly before it.

    Both sides are merged into one ordered stream and the last right row is carried forward: no row pairs are formed.
    The carry runs inside blocks of the order column, and block to block over one summary row each, so a key that
    holds a third of all rows is still spread over many tasks.
    """
    payload = F.struct(*values)
    kind = F.struct(*[F.lit(None).cast(right.schema[v].dataType).alias(v) for v in values])
    lcols = left.columns
    both = left.select(*[c(x).alias(f"l_{x}") for x in lcols], *key, c(order).alias("_o"), F.lit(1).alias("_side"),
                       F.when(F.lit(False), kind).alias("_v")).unionByName(
        right.select(*key, c(order).alias("_o"), F.lit(0).alias("_side"), payload.alias("_v")), allowMissingColumns=True)
    both = both.withColumn("_b", F.floor(c("_o") / block))
    # strictly before: among equal positions left rows come first
    inside = Window.partitionBy(*key, "_b").orderBy("_o", F.desc("_side")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    carried = both.withColumn("_in", F.last("_v", ignorenulls=True).over(inside))
    summary = both.filter("_side = 0").groupBy(*key, "_b").agg(F.max(F.struct("_o", "_v"))["_v"].alias("_last"))
    # blocks that hold left rows also need the carry, so the summary covers every block of either side
    blocks = both.select(*key, "_b").distinct().join(summary, [*key, "_b"], "left")
    across = Window.partitionBy(*key).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carry = blocks.withColumn("_prev", F.last("_last", ignorenulls=True).over(across)).select(*key, "_b", "_prev")
    out = carried.filter("_side = 1").join(carry, [*key, "_b"]).withColumn("_hit", F.coalesce("_in", "_prev"))
    return out.select(*[c(f"l_{x}").alias(x) for x in lcols], *[c(f"_hit.{v}").alias(v) for v in values])
