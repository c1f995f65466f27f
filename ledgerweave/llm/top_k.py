"""Exact top-k inner products by pivot-table elimination.

Each vector becomes floor(scale * x). Pivots are vectors spread far apart: of a bounded sample, each next one is the
one farthest from those before. The distances of every vector to the pivots of its length are computed once, as a
table beside the vectors. For a query q and a candidate x, the largest |d(q, p) - d(x, p)| over the pivots is a
lower bound of their distance, which caps their inner product at (|q|^2 + |x|^2 - bound^2) / 2. Candidates are
evaluated in the order of those caps until the next cap falls below the k-th score: what is left cannot enter.

Vectors that are nearly orthogonal to each other lie at nearly the same distance from every pivot: no bound can tell
them apart then, and nearly all candidates are evaluated. `Best.evaluated` counts them.

The stated query set meets all rows in blocks: candidate blocks are dealt over stripes, the query blocks are sent
to every stripe, and each stripe keeps k rows a query; a last ranking merges the stripes.

Defined results: vectors that are null or hold null or non-finite components, and rows with a null id, take no
part; vectors meet only vectors of their own length; an empty vector scores 0; of repeated ids each row is a
candidate and, if asked, a query of its own, that only leaves itself out; ties go to the smaller id; an empty table
gives an empty result. Scores beyond the range of a long are cut to it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import lean_batches, partitions, written

#: Rows in a block; pivots; the sample that they are picked from; candidates that are evaluated at first
#: (twice as many each time after that).
BLOCK, PIVOTS, SAMPLE, STEP = 1024, 128, 4096, 32
#: Queries that are held against a block at a time.
TILE = 64
#: Sums of products stay whole in doubles up to here.
EXACT = float(1 << 52)
BLOCKS = "block long, dim int, n int, keys binary, ids binary, rows binary, norms binary, table binary"


def _distances(rows: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """To the origin and to each pivot: a column each."""
    out = [np.sqrt(np.einsum("ij,ij->i", rows, rows))]
    for p in pivots:
        gap = rows - p
        out.append(np.sqrt(np.einsum("ij,ij->i", gap, gap)))
    return np.stack(out, axis=1)


def spread_apart(sample: np.ndarray, most: int) -> np.ndarray:
    """Up to `most` different rows, the longest first, then always the one farthest from all before."""
    if not len(sample):
        return sample
    picked, near = [], np.full(len(sample), np.inf)
    at = int(np.argmax(np.einsum("ij,ij->i", sample, sample)))
    while len(picked) < most and near[at] > 0:
        picked.append(at)
        gap = sample - sample[at]
        np.minimum(near, np.einsum("ij,ij->i", gap, gap), out=near)
        at = int(np.argmax(near))
    return sample[picked]


def _blocks(scale: float, pivots_of: dict[int, np.ndarray]):
    def run(batches):
        me, made = TaskContext.get().partitionId() << 32, 0
        held: dict[int, list] = {}

        def close(dim):
            nonlocal made
            keys, ids, rows = (np.concatenate(x) for x in zip(*held.pop(dim)))
            for at in range(0, len(ids), BLOCK):
                r = rows[at : at + BLOCK]
                table = _distances(r, pivots_of.get(dim, np.empty((0, dim))))
                made += 1
                yield pa.RecordBatch.from_pylist(
                    [{"block": me + made, "dim": dim, "n": len(r), "keys": keys[at : at + BLOCK].tobytes(), "ids": ids[at : at + BLOCK].tobytes(), "rows": r.tobytes(), "norms": (table[:, 0] ** 2).tobytes(), "table": table.tobytes()}],
                    schema=pa.schema([("block", pa.int64()), ("dim", pa.int32()), ("n", pa.int32()), *[(c, pa.binary()) for c in ("keys", "ids", "rows", "norms", "table")]]),
                )

        for batch in batches:
            lists = batch.column("v")
            lens = np.diff(lists.offsets.to_numpy())
            values = lists.values.to_numpy(zero_copy_only=False)[lists.offsets[0].as_py() :]
            starts = np.cumsum(lens) - lens
            keys, ids = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "id"))
            for dim in np.unique(lens).tolist():
                at = np.flatnonzero(lens == dim)
                rows = np.floor(scale * values[starts[at][:, None] + np.arange(dim)].astype(np.float64)).reshape(len(at), dim)
                held.setdefault(dim, []).append((keys[at], ids[at], rows))
                if sum(len(x[0]) for x in held[dim]) >= BLOCK:
                    yield from close(dim)
        for dim in list(held):
            yield from close(dim)

    return run


class Best:
    """The k best of each query of a block so far."""

    def __init__(self, keys, ids, rows, norms, table, k):
        """keys tell the rows of the whole table apart."""
        self.keys, self.ids, self.rows, self.norms, self.k = keys, ids, rows, norms, k
        self.table, self.largest, self.evaluated = np.ascontiguousarray(table.T.astype(np.float32)), table.max(initial=0), 0
        self.found = [(np.empty(0, np.int64), np.empty(0, np.int64)) for _ in ids]

    def caps(self, norms, table) -> np.ndarray:
        """What no inner product of a query (row) and a candidate (column) can exceed."""
        largest = max(self.largest, table.max(initial=0))
        caps = self.norms[:, None] + norms
        if largest > 1e37:  # beyond single precision
            return np.full(caps.shape, np.inf)
        other = np.ascontiguousarray(table.T.astype(np.float32))
        # Distances are kept in single precision: a bound may come out too large by a few parts in 2^24 of them, and
        # the squares by a few in 2^50.
        slack = 8 * 2.0**-24 * largest
        caps += caps * 2.0**-44 + 2
        for at in range(0, len(self.ids), TILE):
            mine = self.table[:, at : at + TILE]
            bound = np.zeros((mine.shape[1], len(norms)), np.float32)
            for p in range(len(other)):
                np.maximum(bound, np.abs(mine[p][:, None] - other[p]), out=bound)
            caps[at : at + TILE] -= np.maximum(bound.astype(np.float64) - slack, 0) ** 2
        return caps / 2

    def meet(self, keys, ids, rows, norms, table) -> None:
        """Candidates of one block, in the order of their caps."""
        caps = self.caps(norms, table)
        whole = rows.shape[1] * max(np.abs(rows).max(initial=0), 1) * max(np.abs(self.rows).max(initial=0), 1) < EXACT
        for q in range(len(self.ids)):
            order = np.argsort(-caps[q], kind="stable")
            scores, names = self.found[q]
            at, step = 0, STEP
            while at < len(order):
                if len(scores) == self.k and caps[q, order[at]] < scores[-1]:
                    break
                some = order[at : at + step]
                at, step = at + step, 2 * step
                some = some[keys[some] != self.keys[q]]
                self.evaluated += len(some)
                if whole:
                    new = (rows[some] @ self.rows[q]).astype(np.int64)
                else:
                    mine = [int(x) for x in self.rows[q]]
                    cut = (max(-(2**63), min(2**63 - 1, sum(int(a) * b for a, b in zip(rows[s], mine)))) for s in some)
                    new = np.fromiter(cut, np.int64, len(some))
                scores, names = np.concatenate([scores, new]), np.concatenate([names, ids[some]])
                top = np.lexsort((names, -scores.astype(object) if not whole else -scores))[: self.k]
                scores, names = scores[top], names[top]
            self.found[q] = scores, names


def exact_top_k(
    vectors: DataFrame, is_query: Column, k: int = 10, scale: float = 1024.0, pivots: int = PIVOTS, id_col="vec_id", vec_col="embedding"
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best rows of every query row. is_query is over the column `id`."""
    spark = vectors.sparkSession
    lean_batches(spark)
    sound = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"), F.monotonically_increasing_id().alias("key")).filter(
        F.col("id").isNotNull() & F.col("v").isNotNull()
        & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    )
    sound = written(sound, "sound")  # so that a row has the same key as a query and as a candidate
    chosen: dict[int, list] = {}
    for r in sound.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).collect():  # a fixed number of rows
        chosen.setdefault(len(r.v), []).append(np.floor(scale * np.array(r.v, np.float64)))
    # Vectors of a length that the sample lacks have the origin alone.
    pivots_of = {d: spread_apart(np.array(x).reshape(len(x), d), pivots) for d, x in chosen.items()}
    blocks = written(sound.mapInArrow(_blocks(scale, pivots_of), BLOCKS), "vectors")
    asked = written(sound.filter(is_query).mapInArrow(_blocks(scale, pivots_of), BLOCKS), "queries")
    n = partitions(spark)
    stripes = blocks.withColumn("stripe", F.pmod(F.xxhash64("block"), F.lit(n)).cast("int"))
    sent = asked.select([F.col(c).alias(f"q_{c}") for c in asked.columns]).withColumn("q_stripe", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    pairs = sent.hint("merge").join(stripes, (F.col("q_stripe") == F.col("stripe")) & (F.col("q_dim") == F.col("dim")))

    def met(batches):
        best, of = None, None

        def out():
            for key, q, (scores, names) in zip(best.keys.tolist(), best.ids.tolist(), best.found):
                yield q, names, scores, key

        def flush():
            found = [x for x in out() if len(x[1])]
            if found:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat([x[0] for x in found], [len(x[1]) for x in found]), pa.int64()), pa.array(np.concatenate([x[1] for x in found]), pa.int64()), pa.array(np.concatenate([x[2] for x in found]), pa.int64()),
                     pa.array(np.repeat([x[3] for x in found], [len(x[1]) for x in found]), pa.int64())],
                    ["query_id", "vec_id", "score", "key"],
                )

        def arrays(row, p):
            n, dim = row[f"{p}n"], row[f"{p}dim"]
            table = np.frombuffer(row[f"{p}table"], np.float64).reshape(n, -1)
            return *(np.frombuffer(row[f"{p}{c}"], np.int64) for c in ("keys", "ids")), np.frombuffer(row[f"{p}rows"], np.float64).reshape(n, dim), np.frombuffer(row[f"{p}norms"], np.float64), table

        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                if row["q_block"] != of:
                    if best:
                        yield from flush()
                    best, of = Best(*arrays(row, "q_"), k), row["q_block"]
                best.meet(*arrays(row, ""))
        if best:
            yield from flush()

    partial = pairs.mapInArrow(met, "query_id long, vec_id long, score long, key long")
    rank = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("score"), "vec_id"))
    return partial.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE = """
WITH v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)
SELECT query_id, rank, vec_id, score FROM (
    SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score,
        CAST(row_number() OVER (PARTITION BY q.r ORDER BY list_dot_product(q.e, c.e) DESC, c.vec_id) AS INTEGER) AS rank
    FROM v q JOIN v c ON q.r <> c.r WHERE q.vec_id % 100 = 0) WHERE rank <= 10
"""
