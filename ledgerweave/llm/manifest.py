"""A Merkle manifest of a dataset: a tree over the rows of each language, a tree over the languages' roots, and for
every row the digests that prove it.

Leaves are numbered without a task that holds a language: rows are dealt by ranges of (language, id), sorted in their
range, and a range's first number in a language follows from the counts of the ranges before it. The trees are then
built in blocks of `2^BLOCK_LEVELS` neighbouring nodes. Inside a block each level is one pair of windows: the row
where a node starts holds its digest; lag and lead columns at the level's fixed offset, masked by the node's slot in
its run and by the run's length, give each node its sibling; and the first child's row hashes the parent. The rows
between take the sibling of the node that covers them. All levels of a block share one exchange and one sort. Blocks'
top nodes are the leaves of the next pass, so a pass has 1/256 of the rows of the one before, and siblings above a
block reach its rows by a join on the block.

Defined results: ids ascend with nulls first, rows with equal ids by their digests (repeated rows are neighbours,
each with a proof of its own); nulls of any column hash as `-`; the null language is a tree of its own, the first;
a tree of one leaf is that leaf; an empty table gives an empty result; columns beyond the named ones are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, tasks_for, written

#: Levels that a block of neighbours is folded by at a time.
BLOCK_LEVELS = 8
#: Positions of monotonically_increasing_id in a task.
IN_TASK = 33
SIB = "array<struct<first:boolean,sibling:string>>"


def hashed(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def field(value: Column) -> Column:
    """A value with its length before it, so that neighbouring fields can't run into each other."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def kept(rows: DataFrame, name: str, of: int) -> DataFrame:
    """rows written and read again, in the tasks that a table of so many rows is worth; partitions are joined, not dealt anew."""
    return written(rows.coalesce(tasks_for(rows.sparkSession, of)), name)


def numbered(rows: DataFrame, tree: str, order: list[str]) -> DataFrame:
    """rows with `at`, their place from 0 in their tree, and `leaves`, the tree's size. rows: a written table; order makes each row unique."""
    n, count = partitions(rows.sparkSession), rows.count()
    ranged = rows.repartitionByRange(n, tree, *order).sortWithinPartitions(tree, *order).withColumn("seat", F.monotonically_increasing_id())
    ranged = kept(ranged, "manifest-ranges", count).withColumn("range", F.shiftright("seat", IN_TASK))
    # A row for each range and tree in it: at most ranges + trees rows.
    runs = ranged.groupBy("range", tree).agg(F.min("seat").alias("first_seat"), F.count(F.lit(1)).alias("rows"))
    whole = Window.partitionBy(tree)
    runs = runs.select(
        "range", F.col(tree).alias("of"), (F.coalesce(F.sum("rows").over(whole.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) - F.col("first_seat")).alias("shift"),
        F.sum("rows").over(whole).alias("leaves"),
    )
    runs = kept(runs, "manifest-runs", n).withColumnRenamed("range", "range_of")
    joined = ranged.join(runs, (F.col("range") == F.col("range_of")) & F.col(tree).eqNullSafe(F.col("of")))
    return joined.select(*rows.columns, (F.col("seat") + F.col("shift")).alias("at"), "leaves")


def block_pass(nodes: DataFrame, tree: str, digest: str, levels: int) -> DataFrame:
    """nodes (tree, at, leaves, digest, ...) with `path`, their siblings inside their block from below, and `top`, on the first row the block's node."""
    size = 1 << levels
    block = Window.partitionBy(tree, "block").orderBy("at")
    so_far = block.rowsBetween(Window.unboundedPreceding, 0)
    out = nodes.withColumn("block", F.shiftright("at", levels)).withColumn("place", F.col("at") % size).withColumn("d", F.col(digest))
    for level in range(levels):
        width = 1 << level
        starts, slot = F.col("place") % width == 0, F.shiftright("place", level).bitwiseAND(1)
        grows = F.col("leaves") > width  # several nodes remain on this level
        right, left = F.lead("d", width).over(block), F.lag("d", width).over(block)
        sibling = F.when(starts & grows, F.coalesce(F.when(slot == 0, right).otherwise(left), F.lit("")))
        parent = F.when(F.col("place") % (2 * width) == 0, F.when(grows, hashed(F.col("d"), F.coalesce(right, F.lit("")))).otherwise(F.col("d")))
        out = out.withColumns({f"s{level}": sibling, "d": parent})
    # The rows between take the sibling of the node that covers them. A level that the tree doesn't have gives
    # nothing; a node alone in its run has no sibling, but is hashed.
    steps = [
        F.when(F.col("leaves") > 1 << level, F.struct((F.shiftright("place", level).bitwiseAND(1) == 0).alias("first"),
            F.coalesce(F.last(f"s{level}", ignorenulls=True).over(so_far), F.lit("")).alias("sibling")))
        for level in range(levels)
    ]
    path = F.filter(F.array(*steps), lambda s: s.isNotNull()).cast(SIB)
    return out.select(*[c for c in nodes.columns], "block", path.alias("path"), F.when(F.col("place") == 0, F.col("d")).alias("top"))


def folded(nodes: DataFrame, tree: str, digest: str, levels: int = BLOCK_LEVELS) -> tuple[DataFrame, DataFrame]:
    """For numbered nodes: the same rows with `path`, all siblings up to the root of their tree; and (tree, root) of every tree."""
    count, most = nodes.agg(F.count(F.lit(1)), F.max("leaves")).first()
    most, passes = most or 0, [kept(block_pass(nodes, tree, digest, levels), "manifest-pass", count)]
    while most > 1 << levels:
        most = -(-most >> levels)
        tops = passes[-1].filter(F.col("top").isNotNull()).select(
            F.col(tree), F.col("block").alias("at"), F.ceil(F.col("leaves") / (1 << levels)).cast("long").alias("leaves"), F.col("top").alias("d0")
        )
        passes.append(kept(block_pass(tops, tree, "d0", levels), "manifest-pass", tops.count()))
    roots = passes[-1].filter(F.col("top").isNotNull() & (F.col("block") == 0)).select(tree, F.col("top").alias("root"))

    def below(above: DataFrame, nodes: DataFrame) -> DataFrame:
        up = above.select(F.col(tree).alias("up_tree"), F.col("at").alias("up_at"), F.col("path").alias("up_path"))
        both = nodes.join(up, nodes[tree].eqNullSafe(up["up_tree"]) & (nodes["block"] == up["up_at"]), "left")
        return both.withColumn("path", F.concat("path", F.coalesce("up_path", F.array().cast(SIB)))).drop("up_tree", "up_at", "up_path")

    return reduce(below, reversed(passes)).drop("block", "top"), roots


def climbed(leaf: Column, path: Column) -> Column:
    """The root that a leaf and the siblings of its path lead to."""
    return F.aggregate(path, leaf, lambda d, s: F.when(s["first"], hashed(d, s["sibling"])).otherwise(hashed(s["sibling"], d)))


def manifest(docs: DataFrame, tree_col: str = "lang", id_col: str = "doc_id", columns: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), altered: dict[str, Column] | None = None) -> DataFrame:
    """doc_id, leaf, subroot, root, path, proof_sha256, seen_leaf, folded_root, verified for every row.

    altered: columns of a copy that is checked against the manifest, as expressions over docs; its leaves are
    climbed with the siblings of the original. Without, the original itself is checked.
    """
    altered = altered or {}
    leaf = hashed(*[field(F.col(f"`{c}`")) for c in columns])
    seen = hashed(*[field(altered.get(c, F.col(f"`{c}`"))) for c in columns])
    leaves = docs.select(
        F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{tree_col}`").cast("string").alias("tree"), leaf.alias("leaf"), seen.alias("seen_leaf"),
        F.monotonically_increasing_id().alias("turn"),
    )
    leaves = written(leaves, "manifest-leaves")
    count = leaves.count()
    rows, subroots = folded(numbered(leaves, "tree", ["doc_id", "leaf", "turn"]), "tree", "leaf")
    # The languages' roots are the leaves of one tree more; a null language is the first.
    langs = kept(subroots.select(F.lit(0).alias("all"), F.col("tree"), F.col("root").alias("subroot")), "manifest-subroots", 1)
    langs, root = folded(numbered(langs, "all", ["tree"]), "all", "subroot")
    upper = langs.join(root, "all").select(F.col("tree").alias("of"), "subroot", "root", F.col("path").alias("upper"))
    upper = kept(upper, "manifest-upper", 1)
    joined = rows.coalesce(tasks_for(rows.sparkSession, count)).join(upper, F.col("tree").eqNullSafe(F.col("of"))).withColumn("path", F.concat("path", "upper"))
    out = joined.withColumn("folded_root", climbed(F.col("seen_leaf"), F.col("path")))
    proof = F.sha2(F.array_join(F.transform("path", lambda s: s["sibling"]), "").cast("binary"), 256)
    return out.select("doc_id", "leaf", "subroot", "root", "path", proof.alias("proof_sha256"), "seen_leaf", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


ORACLE = """
WITH RECURSIVE bits AS (SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(b::BIGINT, range(8)),
        lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
f AS (SELECT row_number() OVER () AS r, doc_id, lang, doc_id::VARCHAR AS a, source::VARCHAR AS b, lang::VARCHAR AS c, n_chars::VARCHAR AS n, text AS e,
        CASE WHEN xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(doc_id::VARCHAR)), '..'), lambda h: ('0x' || h)::BIGINT)),
            lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 7 = 0 THEN (n_chars::HUGEINT + 1)::VARCHAR ELSE n_chars::VARCHAR END AS n2 FROM documents, bits),
h AS (SELECT r, doc_id, lang,
        sha256(concat_ws('', coalesce(octet_length(encode(a)) || ':' || a, '-'), coalesce(octet_length(encode(b)) || ':' || b, '-'), coalesce(octet_length(encode(c)) || ':' || c, '-'),
            coalesce(octet_length(encode(n)) || ':' || n, '-'), coalesce(octet_length(encode(e)) || ':' || e, '-'))) AS leaf,
        sha256(concat_ws('', coalesce(octet_length(encode(a)) || ':' || a, '-'), coalesce(octet_length(encode(b)) || ':' || b, '-'), coalesce(octet_length(encode(c)) || ':' || c, '-'),
            coalesce(octet_length(encode(n2)) || ':' || n2, '-'), coalesce(octet_length(encode(e)) || ':' || e, '-'))) AS seen FROM f),
g AS (SELECT dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
        count(*) OVER (PARTITION BY lang) AS m, doc_id, leaf, seen FROM h),
t1 AS (SELECT tree, 0 AS lvl, pos, m, leaf AS d FROM g
    UNION ALL SELECT tree, lvl + 1, pos // 2, (m + 1) // 2, sha256(string_agg(d, '' ORDER BY pos)) FROM t1 WHERE m > 1 GROUP BY tree, lvl, pos // 2, (m + 1) // 2),
sub AS (SELECT tree, d AS subroot FROM t1 WHERE m = 1),
t2 AS (SELECT 0 AS lvl, tree AS pos, count(*) OVER () AS m, subroot AS d FROM sub
    UNION ALL SELECT lvl + 1, pos // 2, (m + 1) // 2, sha256(string_agg(d, '' ORDER BY pos)) FROM t2 WHERE m > 1 GROUP BY lvl, pos // 2, (m + 1) // 2),
c1 AS (SELECT tree, pos AS leafno, 0 AS lvl, pos, m, seen AS acc, '' AS sibs FROM g
    UNION ALL SELECT c.tree, c.leafno, c.lvl + 1, c.pos // 2, (c.m + 1) // 2, sha256(CASE WHEN s.d IS NULL THEN c.acc WHEN c.pos % 2 = 0 THEN c.acc || s.d ELSE s.d || c.acc END), c.sibs || coalesce(s.d, '')
        FROM c1 c LEFT JOIN t1 s ON s.tree = c.tree AND s.lvl = c.lvl AND s.pos = xor(c.pos, 1) WHERE c.m > 1),
c2 AS (SELECT tree, leafno, 0 AS lvl, tree AS pos, (SELECT count(*) FROM sub) AS m, acc, sibs FROM c1 WHERE c1.m = 1
    UNION ALL SELECT c.tree, c.leafno, c.lvl + 1, c.pos // 2, (c.m + 1) // 2, sha256(CASE WHEN s.d IS NULL THEN c.acc WHEN c.pos % 2 = 0 THEN c.acc || s.d ELSE s.d || c.acc END), c.sibs || coalesce(s.d, '')
        FROM c2 c LEFT JOIN t2 s ON s.lvl = c.lvl AND s.pos = xor(c.pos, 1) WHERE c.m > 1)
SELECT g.doc_id, g.leaf, sub.subroot, root.d AS root, sha256(c2.sibs) AS proof_sha256, c2.acc AS folded_root, c2.acc = root.d AS verified
FROM g JOIN sub USING (tree) JOIN c2 ON c2.tree = g.tree AND c2.leafno = g.pos AND c2.m = 1 CROSS JOIN (SELECT d FROM t2 WHERE m = 1) root
"""
