"""Merkle manifest of a table: a tree per group, a tree over the groups, and a path of siblings for each row.

Rows of a group are ordered and numbered; every aligned block of ``ARITY ** DEPTH`` nodes keeps each of its levels as one string
of concatenated hex digests. Parents are hashes of fixed-width substrings, the siblings of a node are the substrings at its
left and right, and the roots of the blocks are the nodes of the next round, until a group is one block. The roots of the
groups are then treated in the same way as one more group. No task holds more than one block.

Defined results: rows of one id are ordered by their hash, so that equal rows may change places; a null id is the smallest and
is never tampered with; null groups are one group, the first; a table of one row has its leaf as root and an empty path; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from creditloom.llm.common import positions, read, staged

#: Children of a node, levels of a block, and the width of a digest in a level's string.
ARITY, DEPTH, WIDTH = 3, 5, 64
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PATH = "array<struct<lft:string,rgt:string>>"


def leaf_hash(values: list[Column]) -> Column:
    """sha256 of the values one after another, each as ``-`` if null, else its UTF-8 byte count, a colon and the value."""
    text = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.when(t.isNull(), "-").otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in text]), 256)


def group_key(group: Column) -> Column:
    """A string that orders groups: null first, then by UTF-8 bytes."""
    return F.coalesce(F.concat(F.lit("="), group.cast("string")), F.lit(""))


def _powers(below: int) -> str:
    return "array(" + ", ".join(f"{ARITY ** j}L" for j in range(64) if ARITY ** j < below) + ")"


#: Levels above a group of n nodes.
_HEIGHT = f"size(filter({_powers(1 << 62)}, p -> p < n))"
#: The next level's string from the last one of ``a``.
_PARENTS = (f"array_join(transform(sequence(0, (length(element_at(a, -1)) - 1) div {ARITY * WIDTH}), "
            f"i -> sha2(substring(element_at(a, -1), i * {ARITY * WIDTH} + 1, {ARITY * WIDTH}), 256)), '')")
_LEVELS = f"aggregate(slice(sequence(1, {DEPTH}), 1, least({DEPTH}, height)), array(array_join(rows.node, '')), (a, j) -> concat(a, array({_PARENTS})))"
#: The siblings of position i of a block, from its level up to the block's root.
_OWN_PATH = (f"transform(slice(sequence(0, {DEPTH - 1}), 1, size(levels) - 1), j -> named_struct("
             f"'lft', substring(levels[j], i div {{p}}[j] div {ARITY} * {ARITY * WIDTH} + 1, i div {{p}}[j] % {ARITY} * {WIDTH}), "
             f"'rgt', substring(levels[j], (i div {{p}}[j] + 1) * {WIDTH} + 1, ({ARITY - 1} - i div {{p}}[j] % {ARITY}) * {WIDTH})))"
             ).format(p=_powers(ARITY ** DEPTH))


def _blocks(nodes: DataFrame, name: str) -> DataFrame:
    """(g, b, n, rows, levels, top): aligned blocks of the nodes (g, pos, n, node, more)."""
    more = [c for c in nodes.columns if c not in ("g", "pos", "n")]
    cut = nodes.withColumn("b", F.floor(F.col("pos") / ARITY ** DEPTH).cast("long"))
    # a block holds at most ARITY ** DEPTH rows
    got = cut.groupBy("g", "b", "n").agg(F.array_sort(F.collect_list(F.struct("pos", *more))).alias("rows"))
    got = got.withColumn("height", F.expr(_HEIGHT)).withColumn("levels", F.expr(_LEVELS)).drop("height")
    return staged(got.withColumn("top", F.expr("element_at(levels, -1)")), name)


def build(nodes: DataFrame, name: str) -> list[DataFrame]:
    """The blocks of each round of the trees over the nodes (g, pos, n, node, more)."""
    size, rounds = ARITY ** DEPTH, [_blocks(nodes, name)]
    most = rounds[0].agg(F.max("n")).first()[0] or 0
    while most > size:
        most = -(-most // size)
        up = rounds[-1].filter(F.col("n") > size).select("g", F.col("b").alias("pos"), F.ceil(F.col("n") / size).alias("n"), F.col("top").alias("node"))
        rounds.append(_blocks(up, f"{name}_{len(rounds)}"))
    return rounds


def roots(rounds: list[DataFrame]) -> DataFrame:
    """(g, root): the root of each group."""
    tops = [r.filter(F.col("n") <= ARITY ** DEPTH).select("g", F.col("top").alias("root")) for r in rounds]
    out = tops[0]
    for t in tops[1:]:
        out = out.union(t)
    return out


def paths(rounds: list[DataFrame], above: DataFrame) -> DataFrame:
    """The nodes with ``path``, their siblings level by level up to the root.

    ``above`` holds a row per group: g, rest (the path of the group's root) and any columns that its nodes get as well.
    """
    got = None
    extra = [c for c in above.columns if c not in ("g", "rest")]
    for blocks in reversed(rounds):
        last = F.col("n") <= ARITY ** DEPTH
        known = blocks.filter(last).join(above, "g")
        if got is not None:
            upper = got.select("g", F.col("pos").alias("b"), F.col("path").alias("rest"), *extra)
            known = known.unionByName(blocks.filter(~last).join(upper, ["g", "b"]))
        row = f"transform(rows, (x, i) -> named_struct('row', x, 'path', concat({_OWN_PATH}, rest)))"
        got = known.select("g", *extra, F.inline(F.expr(row))).select("g", *extra, "row.*", "path")
    return got


def fold(leaf: str, path: str = "path") -> Column:
    """The root that a leaf and its path give."""
    return F.expr(f"aggregate({path}, {leaf}, (x, s) -> sha2(concat(s.lft, x, s.rgt), 256))")


def path_hash(path: str = "path") -> Column:
    """sha256 of all siblings of a path, from the leaf to the root, left to right."""
    return F.expr(f"sha2(array_join(transform({path}, s -> concat(s.lft, s.rgt)), ''), 256)")


def manifest(leaves: DataFrame) -> DataFrame:
    """Paths and roots for leaves (g, doc_id, node and any other columns): adds pos, path, subroot and root.

    ``node`` is the leaf's hash and ``g`` the group's key; leaves of a group ascend by doc_id, then by their hash.
    """
    per_group = build(positions(leaves, ["g"], ["doc_id", "node"], "leaves"), "blocks")
    groups = roots(per_group).select(F.lit("").alias("g"), F.col("g").alias("name"), F.col("root").alias("node"))
    top = build(positions(groups, ["g"], ["name"], "groups"), "group_blocks")
    above = roots(top).select("g", F.expr(f"cast(array() as {PATH})").alias("rest"), "root")
    above = staged(paths(top, above).select(F.col("name").alias("g"), F.col("path").alias("rest"), F.col("node").alias("subroot"), "root"), "above")
    return paths(per_group, above)


def document_leaves(docs: DataFrame, id_col: str = "doc_id", group_col: str = "source", fields: tuple[str, ...] = FIELDS, text_col: str = "text") -> DataFrame:
    """(g, doc_id, node, tampered): the leaf of each row, and of the row without line feeds in its text where the id's crc32 is even."""
    cols = [F.col(f"`{c}`") for c in fields]
    bare = [F.regexp_replace(F.col(f"`{c}`"), "\n", "") if c == text_col else F.col(f"`{c}`") for c in fields]
    doc_id = F.col(f"`{id_col}`")
    even = F.crc32(doc_id.cast("string").cast("binary")) % 2 == 0
    changed = even & F.contains(F.col(f"`{text_col}`"), F.lit("\n"))  # else the leaf stays as it is
    return docs.select(group_key(F.col(f"`{group_col}`")).alias("g"), doc_id.alias("doc_id"), leaf_hash(cols).alias("node"), F.when(changed, leaf_hash(bare)).alias("tampered"))


def verified_documents(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified."""
    found = manifest(document_leaves(docs)).withColumn("given", F.coalesce("tampered", "node"))
    out = found.select("doc_id", F.col("node").alias("leaf"), "subroot", "root", path_hash().alias("proof_sha256"), fold("given").alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verified_documents(read(spark, sf_dir, "documents"))


#: crc32 of an id's decimal text by nibbles; levels and folds by recursion, one level a step.
SQL = """
WITH RECURSIVE fields AS (
    SELECT doc_id, source, lang, n_chars, text,
           list_reduce(
               list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT & 15, ascii(c)::BIGINT >> 4]))),
               lambda a, x: xor(a >> 4, [0, 498536548, 997073096, 651767980, 1994146192, 1802195444, 1303535960, 1342533948, 3988292384, 4027552580, 3604390888,
                                      3412177804, 2607071920, 2262029012, 2685067896, 3183342108][(xor(a, x) & 15) + 1]::BIGINT)) AS c
    FROM documents),
texts AS (
    SELECT *, CASE WHEN xor(c, 4294967295) % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS changed FROM fields),
leaves AS (
    SELECT doc_id, source, head, sha256(head || coalesce(strlen(text)::VARCHAR || ':' || text, '-')) AS leaf,
           sha256(head || coalesce(strlen(changed)::VARCHAR || ':' || changed, '-')) AS given
    FROM (SELECT *, coalesce(strlen(doc_id::VARCHAR)::VARCHAR || ':' || doc_id::VARCHAR, '-') || coalesce(strlen(source)::VARCHAR || ':' || source, '-')
                 || coalesce(strlen(lang)::VARCHAR || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR)::VARCHAR || ':' || n_chars::VARCHAR, '-') AS head FROM texts)),
placed AS (
    SELECT *, coalesce('=' || source, '') AS g, row_number() OVER (PARTITION BY source ORDER BY doc_id, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n FROM leaves),
tree AS (
    SELECT g, 0 AS lvl, pos, n, leaf AS node FROM placed
    UNION ALL
    SELECT g, lvl + 1, pos // 3, max((n + 2) // 3), sha256(string_agg(node, '' ORDER BY pos)) FROM tree WHERE n > 1 GROUP BY g, lvl, pos // 3),
subs AS (SELECT g, lvl AS height, node AS subroot, row_number() OVER (ORDER BY g) - 1 AS pos, count(*) OVER () AS n FROM tree WHERE n = 1),
upper AS (
    SELECT 0 AS lvl, pos, n, subroot AS node FROM subs
    UNION ALL
    SELECT lvl + 1, pos // 3, max((n + 2) // 3), sha256(string_agg(node, '' ORDER BY pos)) FROM upper WHERE n > 1 GROUP BY lvl, pos // 3),
climb AS (
    SELECT g, pos AS leaf_pos, 0 AS lvl, pos, given AS cur, '' AS sibs FROM placed
    UNION ALL
    SELECT c.g, c.leaf_pos, c.lvl + 1, c.pos // 3, sha256(string_agg(CASE WHEN t.pos = c.pos THEN c.cur ELSE t.node END, '' ORDER BY t.pos)),
           max(c.sibs) || coalesce(string_agg(t.node, '' ORDER BY t.pos) FILTER (t.pos <> c.pos), '')
    FROM climb c JOIN tree t ON t.g = c.g AND t.lvl = c.lvl AND t.pos // 3 = c.pos // 3 WHERE t.n > 1 GROUP BY c.g, c.leaf_pos, c.lvl, c.pos),
halfway AS (SELECT c.g, c.leaf_pos, s.pos, c.cur, c.sibs FROM climb c JOIN subs s ON s.g = c.g AND s.height = c.lvl),
rest AS (
    SELECT g, leaf_pos, 0 AS lvl, pos, cur, sibs FROM halfway
    UNION ALL
    SELECT c.g, c.leaf_pos, c.lvl + 1, c.pos // 3, sha256(string_agg(CASE WHEN t.pos = c.pos THEN c.cur ELSE t.node END, '' ORDER BY t.pos)),
           max(c.sibs) || coalesce(string_agg(t.node, '' ORDER BY t.pos) FILTER (t.pos <> c.pos), '')
    FROM rest c JOIN upper t ON t.lvl = c.lvl AND t.pos // 3 = c.pos // 3 WHERE t.n > 1 GROUP BY c.g, c.leaf_pos, c.lvl, c.pos),
top AS (SELECT lvl AS height, node AS root FROM upper WHERE n = 1)
SELECT p.doc_id, p.leaf, s.subroot, top.root, sha256(r.sibs) AS proof_sha256, r.cur AS folded_root, r.cur = top.root AS verified
FROM placed p JOIN subs s USING (g) CROSS JOIN top JOIN rest r ON r.g = p.g AND r.leaf_pos = p.pos AND r.lvl = top.height
"""
