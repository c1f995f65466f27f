"""Near copies by MinHash with tensored banding; every link is confirmed on the full shingle sets.

Two small collections of half keys (each a combination of a few minima) are formed per document; a table's key
combines one half of the first with one of the second, so a x b tables cost only the minima of a + b halves. Two
sets with 0.8 of their union in common miss all tables with a probability under 2e-4.

1. Documents become sets of 64-bit shingle hashes. Equal sets form a class; only classes go on.
2. Keys are dealt over tasks in packed arrays. Members of one key are tied to its smallest member: first among the
   documents of one map task, so that a hot key reaches the next task as one row a map task, then over all.
3. Those ties are confirmed on full sets; confirmed links give preliminary components.
4. Only keys whose members still lie in several components can hold a link that matters. Their members meet in
   blocks of bounded size, but blocks of one large component never meet each other; pairs of different components whose minima agree as far as a link allows tie those
   components into clusters, told by spanning trees.
5. The full sets of each cluster meet in blocks: every pair of different components is tested there.

So all candidate pairs that could join two components are tested, and no group of copies is expanded.

Defined results: null or blank text has no shingles, no links, and is its own component; a text with fewer words
than a shingle is one shingle of all its words; rows with a null id get a null component and are kept; repeated
ids take one component between them; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Steps, ids_and_text, joined_hot, partitions, tasks_for, written
from .components import components

#: Halves of the first and the second collection, and minima in each half.
HALVES, MINIMA = (13, 13), (3, 3)
#: Members of a key that meet in one block; share of the minima that must agree before a pair is confirmed, as a
#: part of the threshold (a pair at the threshold falls below it with a probability under 1e-7).
BLOCK, AGREE = 512, 0.68
#: Shingles that meet in one block.
WEIGHT = 1 << 20
#: Hash buckets of keys for each task that ties them; a task holds one bucket at a time.
FINE = 16
N_MINIMA = HALVES[0] * MINIMA[0] + HALVES[1] * MINIMA[1]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of unsigned 64-bit integers."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def shingle_set(text: str, words_in_shingle: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word shingles; A-Z are lower-cased, words end at ASCII blanks."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)
    k = min(n, words_in_shingle)
    out = np.full(n - k + 1, k, np.uint64)
    for j in range(k):
        out = mixed(out + h[j : n - k + 1 + j])
    return np.unique(out)


@functools.lru_cache(maxsize=4)
def _factors(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20_240_521)
    return rng.integers(1, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 2**63, n, dtype=np.uint64)


def minima(shingles: np.ndarray) -> np.ndarray:
    """The low 16 bits of the smallest image of the set under each of N_MINIMA hash functions."""
    a, b = _factors(N_MINIMA)
    low = np.full(N_MINIMA, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 2048):
        part = shingles[at : at + 2048, None] * a + b
        np.minimum(low, (part ^ (part >> np.uint64(32))).min(axis=0), out=low)
    return (mixed(low) & np.uint64(0xFFFF)).astype("<u2")


def halves(sig: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Half keys (rows x halves) of both collections from minima (rows x N_MINIMA)."""
    out, at = [], 0
    for count, width in zip(HALVES, MINIMA):
        keys = np.zeros((len(sig), count), np.uint64)
        for j in range(width):
            keys = (keys << np.uint64(16)) | sig[:, at + j : at + count * width : width].astype(np.uint64)
        out.append(keys)
        at += count * width
    return out[0], out[1]


def table_keys(sig: np.ndarray) -> np.ndarray:
    """The tensored keys: rows x tables."""
    first, second = halves(sig)
    tables = np.arange(HALVES[0] * HALVES[1], dtype=np.uint64).reshape(HALVES)
    return mixed(mixed(first[:, :, None] + mixed(tables + np.uint64(1))) + second[:, None, :]).reshape(len(sig), -1)


def _sets(words_in_shingle: int):
    def run(batches):
        for batch in batches:
            n, digest, sigs = [], [], []
            for text in batch.column("text"):
                s = shingle_set(text.as_py(), words_in_shingle)
                n.append(len(s))
                digest.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                sigs.append(minima(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(sigs, pa.binary())],
                ["doc_id", "n_shingles", "digest", "sig"],
            )

    return run


def _groups(keys: np.ndarray, ids: np.ndarray):
    """Of rows (key, id): those whose key has several, each with the key's smallest id."""
    order = np.lexsort((ids, keys))
    keys, ids = keys[order], ids[order]
    start = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.empty(0, np.int64)
    size = np.diff(np.r_[start, len(keys)])
    return keys, ids, np.repeat(ids[start], size), np.repeat(size, size), start


def _rows(keys, ids, reps):
    return pa.RecordBatch.from_arrays(
        [pa.array(keys.view(np.int64)), pa.array(ids, pa.int64()), pa.array(reps, pa.int64()), pa.nulls(len(keys), pa.int32()), pa.nulls(len(keys), pa.binary())],
        ["key", "cid", "rep", "bucket", "packed"],
    )


ROWS = "key long, cid long, rep long, bucket int, packed binary"


def _dealt(n: int, most: int = 8_000):
    """Keys of a map task's documents, as packed arrays (key, id) for each bucket; ties inside the task come first."""

    def emit(ids, sigs):
        keys = table_keys(np.frombuffer(b"".join(sigs), "<u2").reshape(len(ids), -1))
        flat, of = keys.ravel(), np.repeat(np.array(ids, np.int64), keys.shape[1])
        keys, of, rep, size, start = _groups(flat, of)
        several = size > 1
        if several.any():
            yield _rows(keys[several], of[several], rep[several])
        keys, of = keys[start], of[start]
        bucket = (keys >> np.uint64(20)) % np.uint64(n)
        order = np.argsort(bucket, kind="stable")
        keys, of, bucket = keys[order], of[order], bucket[order]
        used, at = np.unique(bucket, return_index=True)
        packed = [k.tobytes() + i.tobytes() for k, i in zip(np.split(keys, at[1:]), np.split(of, at[1:]))]
        yield pa.RecordBatch.from_arrays(
            [pa.nulls(len(used), pa.int64())] * 3 + [pa.array(used.astype(np.int32)), pa.array(packed, pa.binary())], ["key", "cid", "rep", "bucket", "packed"]
        )

    def run(batches):
        ids, sigs = [], []
        for batch in batches:
            for i, s in zip(batch.column("cid").to_pylist(), batch.column("sig").to_pylist()):
                ids.append(i)
                sigs.append(s)
                if len(ids) >= most:
                    yield from emit(ids, sigs)
                    ids, sigs = [], []
        if ids:
            yield from emit(ids, sigs)

    return run


def _tied(batches):
    """Keys that several map tasks have: each task's smallest member, tied to the smallest of all. Rows come by bucket."""
    for held in _runs(batches, ["bucket", "packed"], 1):
        raws = held["packed"]
        keys = np.concatenate([np.frombuffer(raw, np.uint64, len(raw) // 16) for raw in raws])
        ids = np.concatenate([np.frombuffer(raw, np.int64, -1, len(raw) // 2) for raw in raws])
        keys, ids, rep, size, _ = _groups(keys, ids)
        s = np.flatnonzero(size > 1)
        if len(s):
            yield pa.RecordBatch.from_arrays([pa.array(keys[s].view(np.int64)), pa.array(ids[s]), pa.array(rep[s])], ["key", "cid", "rep"])


def _likely(similarity: float):
    """Pairs whose minima agree often enough; (a, b, sig_a, sig_b) -> (a, b)."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u2").reshape(batch.num_rows, -1) for c in ("sig_a", "sig_b"))
                ok = pa.array((x == y).mean(axis=1) >= AGREE * similarity)
                yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(ok)

    return run


class _Forest:
    """Names that were joined; only joins that tie two trees together are worth telling."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        while (y := self.up.get(x, x)) != x:
            self.up[x] = self.up.get(y, y)
            x = y
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        self.up[max(x, y)] = min(x, y)
        return x != y


def _told(found):
    a, b = (np.array(x, np.int64) for x in zip(*found)) if found else (np.empty(0, np.int64),) * 2
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])


def _runs(batches, columns: list[str], keys: int):
    """The rows of each run of equal first columns, as lists by column; the rows come in that order."""
    held, of = None, None
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in columns)):
            if row[:keys] != of:
                if held:
                    yield held
                held, of = {c: [] for c in columns}, row[:keys]
            for c, v in zip(columns, row):
                held[c].append(v)
    if held:
        yield held


def _crossing(similarity: float):
    """Ties between the components that likely pairs of one block pair of a key lie in, as a spanning forest."""

    def ties(rows):
        comp, block = (np.array(rows[c], np.int64) for c in ("comp", "block"))
        sig = np.frombuffer(b"".join(rows["sig"]), "<u2").reshape(len(comp), -1)
        apart, tree = rows["lo"][0] != rows["hi"][0], comp.copy()
        for x in range(len(comp) - 1):
            if (tree == tree[0]).all():
                break
            y = x + 1 + np.flatnonzero((tree[x + 1 :] != tree[x]) & ((block[x + 1 :] != block[x]) | (not apart)))
            y = y[(sig[y] == sig[x]).mean(axis=1) >= AGREE * similarity] if len(y) else y
            for k in np.unique(tree[y], return_index=True)[1]:
                yield int(comp[x]), int(comp[y[k]])
                tree[tree == tree[y[k]]] = tree[x]

    def run(batches):
        for held in _runs(batches, CROSS, 3):
            yield _told(list(ties(held)))

    return run


CROSS = ["key", "lo", "hi", "block", "cid", "comp", "sig"]
MEET = ["cluster", "lo", "hi", "block", "cid", "comp", "shingles"]


def _meeting(similarity_percent: int):
    """Links of one block pair of a cluster, from all pairs of different components on their full sets.

    The sets of one block are turned into a list of owners for each shingle; each set of the other block counts
    its owners. Told are the components that a link joins.
    """

    def links(rows):
        sets = [np.frombuffer(x, np.uint64) for x in rows["shingles"]]
        cid, comp, block = (np.array(rows[c], np.int64) for c in ("cid", "comp", "block"))
        size, forest = np.array([len(x) for x in sets], np.int64), _Forest()
        near, far = np.flatnonzero(block == rows["lo"][0]), np.flatnonzero(block == rows["hi"][0])
        if not len(near) or not len(far):
            return
        owner = np.repeat(far, size[far])
        shingle = np.concatenate([sets[y] for y in far])
        order = np.argsort(shingle, kind="stable")
        shingle, owner = shingle[order], owner[order]
        for x in near.tolist():
            lo, hi = (np.searchsorted(shingle, sets[x], side) for side in ("left", "right"))
            n = hi - lo
            at = np.arange(int(n.sum())) + np.repeat(lo - (np.cumsum(n) - n), n)
            both = np.bincount(owner[at], minlength=len(cid))
            ok = (100 * both >= similarity_percent * (size[x] + size - both)) & (both > 0) & (comp != comp[x])
            for y in np.flatnonzero(ok).tolist():
                if forest.join(int(comp[x]), int(comp[y])):
                    yield int(comp[x]), int(comp[y])

    def run(batches):
        for held in _runs(batches, MEET, 3):
            yield _told(list(links(held)))

    return run


def _confirmed(similarity_percent: int):
    def run(batches):
        for batch in batches:
            ok = []
            for x, y in zip(batch.column("set_a"), batch.column("set_b")):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                both = len(x) + len(y) - len(np.union1d(x, y)) if len(x) and len(y) else 0
                ok.append(100 * both >= similarity_percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return run


def _in_blocks(members: DataFrame, key: str, weight: Column) -> DataFrame:
    """members (key, comp, cid, ...) with lo, hi, block: the pairs of blocks of a key that each takes part in.

    Blocks hold about BLOCK members and WEIGHT of weight. A component that fills a block has blocks of its own, which
    don't meet each other: its members hold together already. So a large group of copies costs in proportion to its
    size, not to the square of it.
    """
    large = (F.col("n") >= BLOCK) | (F.col("w") >= WEIGHT)
    parts = members.groupBy(key, "comp").agg(F.count(F.lit(1)).alias("n"), F.sum(weight).alias("w"))
    parts = parts.select(key, "comp", large.alias("large"), F.when(large, F.col("comp")).otherwise(F.lit(0)).alias("part"), "n", "w")
    blocks = F.greatest(F.ceil(F.sum("n") / BLOCK), F.ceil(F.sum("w") / WEIGHT)).cast("long")
    sizes = parts.groupBy(key, "large", "part").agg(blocks.alias("blocks"))
    up_to = Window.partitionBy(key).orderBy("large", "part").rowsBetween(Window.unboundedPreceding, 0)
    sizes = sizes.select("*", (F.sum("blocks").over(up_to) - F.col("blocks")).alias("start"), F.sum("blocks").over(Window.partitionBy(key)).alias("all_blocks"))
    slots = parts.select(key, "comp", "large", "part").join(sizes, [key, "large", "part"]).drop("part")
    placed = members.join(slots, [key, "comp"]).withColumn("block", F.col("start") + F.pmod(F.xxhash64("cid"), F.col("blocks")))
    own = lambda x: F.col("large") & (x >= F.col("start")) & (x < F.col("start") + F.col("blocks"))
    others = F.filter(F.sequence(F.lit(0).cast("long"), F.col("all_blocks") - 1), lambda x: ~own(x))
    placed = placed.withColumn("other", F.explode(others))
    return placed.select(*members.columns, F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block")


def near_groups(
    docs: DataFrame, words_in_shingle: int = 5, similarity_percent: int = 80, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row."""
    n, share = partitions(docs.sparkSession), similarity_percent / 100
    rows = ids_and_text(docs, id_col, text_col)
    steps = Steps(docs.sparkSession, "near", tasks_for(docs.sparkSession, docs.count()))
    few = lambda df: steps.fewer(df, most=steps.files)
    sets = written(steps.fewer(rows).mapInArrow(_sets(words_in_shingle), "doc_id long, n_shingles long, digest binary, sig binary"), "sets")
    named = sets.filter("doc_id is not null and digest is not null")
    # A class is named by its smallest id. A repeated id may name several texts: those are one node with several sets.
    classes = steps.written(named.groupBy("digest").agg(F.min("doc_id").alias("cid"), F.first("sig").alias("sig")), "classes")
    reps = classes.select("cid", "sig")
    dealt = steps.written(reps.mapInArrow(_dealt(n * FINE), ROWS), "keys")
    inside = dealt.filter("bucket is null").select("key", "cid", "rep")
    over = dealt.filter("bucket is not null").select("bucket", "packed").repartition(n, "bucket").sortWithinPartitions("bucket")
    ties = steps.written(inside.unionByName(steps.fewer(over).mapInArrow(_tied, "key long, cid long, rep long")), "ties", heavy=True)

    # Full sets of the documents that have a candidate at all.
    wanted = ties.select("cid").distinct()
    full = steps.fewer(rows.join(wanted, rows["doc_id"] == wanted["cid"], "left_semi")).mapInArrow(
        _full_sets(words_in_shingle), "cid long, digest binary, shingles binary"
    )
    full = steps.written(full.join(classes.select(F.col("cid"), F.col("digest")), ["cid", "digest"], "left_semi").dropDuplicates(["cid", "digest"]), "full-sets")

    # The smallest member of a key may have a third of all documents on its side: that side of the pairs is split.
    stars = steps.written(ties.filter("cid <> rep").select(F.col("rep").alias("a"), F.col("cid").alias("b")).distinct(), "stars")
    signed = joined_hot(stars, reps.select(F.col("cid").alias("a"), F.col("sig").alias("sig_a")), "a", n)
    signed = signed.join(reps.select(F.col("cid").alias("b"), F.col("sig").alias("sig_b")), "b").select("a", "b", "sig_a", "sig_b")
    near = steps.written(steps.fewer(signed).mapInArrow(_likely(share), "a long, b long").distinct(), "near-stars")
    held = joined_hot(near, full.select(F.col("cid").alias("a"), F.col("shingles").alias("set_a")), "a", n)
    held = held.join(full.select(F.col("cid").alias("b"), F.col("shingles").alias("set_b")), "b").select("a", "b", "set_a", "set_b")
    first = components(steps.fewer(held).mapInArrow(_confirmed(similarity_percent), "a long, b long"), steps)

    member = steps.written(
        ties.select("key", "cid").distinct().join(first.withColumnRenamed("node", "cid"), "cid", "left")
        .select("key", "cid", F.coalesce("component", "cid").alias("comp")), "members",
    )
    several = member.groupBy("key").agg(F.min("comp").alias("least"), F.max("comp").alias("most")).filter("least < most")
    met = steps.fewer(_in_blocks(member.join(several, "key", "left_semi"), "key", F.lit(1))).join(reps, "cid").select(*CROSS)
    met = met.repartition(n, "key", "lo", "hi").sortWithinPartitions("key", "lo", "hi", "cid")
    likely = steps.fewer(met).mapInArrow(_crossing(share), "a long, b long")

    # Clusters of components with likely pairs; the full sets of each meet once, in blocks that bound members and shingles.
    cluster = components(likely, steps).select(F.col("node").alias("comp"), F.col("component").alias("cluster"))
    placed = full.select("cid", "shingles").join(first.withColumnRenamed("node", "cid"), "cid", "left")
    placed = placed.select("cid", F.coalesce("component", "cid").alias("comp"), "shingles").join(cluster, "comp")
    spread = steps.fewer(_in_blocks(placed, "cluster", F.length("shingles") / 8)).select(*MEET)
    spread = spread.repartition(n, "cluster", "lo", "hi").sortWithinPartitions("cluster", "lo", "hi", "cid")
    joined = components(steps.fewer(spread).mapInArrow(_meeting(similarity_percent), "a long, b long"), steps)

    # Rows of one class belong together; so do classes that share an id.
    of = classes.join(first.withColumnRenamed("node", "cid"), "cid", "left").select("digest", F.coalesce("component", "cid").alias("node"))
    of = of.join(joined, "node", "left").select("digest", F.coalesce("component", "node").alias("component_id"))
    of = written(few(of), "component-ids")
    steps.emptied()
    out = sets.join(of, "digest", "left").select(
        "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")
    )
    return few(out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))))


def _full_sets(words_in_shingle: int):
    def run(batches):
        for batch in batches:
            found = [shingle_set(t.as_py(), words_in_shingle) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in found], pa.binary()),
                    pa.array([s.tobytes() for s in found], pa.binary()),
                ],
                ["cid", "digest", "shingles"],
            )

    return run


def drop_near_copies(docs: DataFrame, words_in_shingle: int = 5, similarity_percent: int = 80, id_col="doc_id", text_col="text") -> DataFrame:
    """The rows that stay, one of each group, with all their columns."""
    kept = near_groups(docs, words_in_shingle, similarity_percent, id_col, text_col).filter("kept").select(F.col("doc_id").alias("_kept_id")).distinct()
    out = docs.join(kept, docs[id_col].cast("long").eqNullSafe(kept["_kept_id"]), "left_semi")
    return out.coalesce(tasks_for(docs.sparkSession, docs.count()))
