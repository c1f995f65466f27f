"""Ranked lexical search of many queries at a time, with shared partial sums.

Items are taken in blocks of bounded size. For a block, one pass over the whole texts writes each document's length and
its counts of the block's terms; corpus statistics (documents, terms, document frequencies) come from those rows
with partial sums. The items of the block are mined for term sets that they share: terms that stand in exactly the
same items become one node, then the pair of nodes that most items share is made a node of its own, again and
again. That gives a DAG whose leaves are weighted terms and whose roots are the items. A task then takes its
documents a slice at a time, fills the leaves' accumulators, adds up each inner node once, level by level, and
reads the items' scores from the roots, however many items share a node. It keeps the best `k` of each item; a
window over the tasks' few rows ranks them.

Scores are whole numbers; see `search`. Bounds: an item block (BLOCK_BYTES of text, or one longer item) is what the
driver sees and what is broadcast; accumulators of a slice take SLICE_BYTES; a task returns k rows for each item.

Defined results: null or empty text has no terms, such documents are never ranked and such items find nothing; each
item row is a query of its own, repeated ids or texts too; repeated document rows are ranked one by one; of equal
scores the smaller doc_id comes first, null ids last; empty tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ids_and_text, lean_batches, written

#: Bytes of item text that one block holds, about.
BLOCK_BYTES = 1 << 20
#: Nodes of an item that are paired with one another: more are paired in groups of so many, by how many items have them.
PAIRED = 32
#: Bytes of accumulators of a slice of documents.
SLICE_BYTES = 32 << 20
#: Fixed values of the score: term frequencies saturate at 1.2 (half at length 0.25 + 0.75 n / average).
UNIT, LONG_SHARE = 1_000_000_000, 75

#: Bytes that end a term become blanks, A-Z become a-z; bytes of other characters stay.
_ENDS = [*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]
FOLD = bytes(0x20 if b in set(_ENDS) else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


def terms(text: bytes) -> list[bytes]:
    """The terms of a UTF-8 text, in order, with repeats."""
    return text.translate(FOLD).split()


class Dag:
    """Shared sums of a block of items.

    leaves: (term number, times) of the first nodes; levels: (node numbers, left children, right children), lowest
    first; roots: for each item the nodes whose sum is its score.
    """

    def __init__(self, items: list[dict[int, int]]):
        self.leaves = sorted({leaf for item in items for leaf in item.items()})
        number = {leaf: i for i, leaf in enumerate(self.leaves)}
        self._children: list[tuple[int, int]] = []
        where = defaultdict(list)
        for i, item in enumerate(items):
            for leaf in item.items():
                where[number[leaf]].append(i)
        together = defaultdict(list)  # leaves by the items that they stand in
        for leaf in sorted(where):
            together[tuple(where[leaf])].append(leaf)
        nodes: list[list[int]] = [[] for _ in items]
        for owners, group in sorted(together.items(), key=lambda x: (-len(x[0]), x[1])):
            node = self._sum(group) if len(owners) > 1 else None
            for i in owners:
                nodes[i].extend(group if node is None else [node])
        groups = [(i, set(own[at : at + PAIRED])) for i, own in enumerate(nodes) for at in range(0, len(own), PAIRED)]
        self._pair(groups)
        self.roots: list[list[int]] = [[] for _ in items]
        for i, own in groups:
            self.roots[i].extend(sorted(own))
        self.size = len(self.leaves) + len(self._children)
        self.levels = self._levelled()

    def _made(self, left: int, right: int) -> int:
        self._children.append((left, right))
        return len(self.leaves) + len(self._children) - 1

    def _sum(self, group: list[int]) -> int:
        while len(group) > 1:
            group = [self._made(*group[i : i + 2]) if i + 1 < len(group) else group[i] for i in range(0, len(group), 2)]
        return group[0]

    def _pair(self, groups: list[tuple[int, set[int]]]) -> None:
        """Replace the pair of nodes that most groups hold by its sum until no two groups hold the same pair."""
        holders = defaultdict(set)
        for g, (_, own) in enumerate(groups):
            ordered = sorted(own)
            for i, a in enumerate(ordered):
                for b in ordered[i + 1 :]:
                    holders[a, b].add(g)
        heap = [(-len(h), pair) for pair, h in holders.items() if len(h) > 1]
        heapq.heapify(heap)
        while heap:
            count, pair = heapq.heappop(heap)
            held = {g for g in holders.pop(pair, ()) if pair[0] in groups[g][1] and pair[1] in groups[g][1]}
            if len(held) < 2:
                continue
            if len(held) < -count:
                holders[pair] = held
                heapq.heappush(heap, (-len(held), pair))
                continue
            node, grown = self._made(*pair), set()
            for g in held:
                own = groups[g][1]
                own.difference_update(pair)
                for other in own:
                    holders[other, node].add(g)
                    grown.add((other, node))
                own.add(node)
            for p in grown:
                if len(holders[p]) > 1:
                    heapq.heappush(heap, (-len(holders[p]), p))

    def _levelled(self) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        depth, by_depth = [0] * self.size, defaultdict(list)
        for i, (a, b) in enumerate(self._children, start=len(self.leaves)):
            depth[i] = max(depth[a], depth[b]) + 1
            by_depth[depth[i]].append((i, a, b))
        return [tuple(np.array(x, np.int64) for x in zip(*by_depth[d])) for d in sorted(by_depth)]

    def scores(self, leaf_values: np.ndarray) -> np.ndarray:
        """(items, documents) from (leaves, documents)."""
        sums = np.empty((self.size, leaf_values.shape[1]), np.int64)
        sums[: len(self.leaves)] = leaf_values
        for node, left, right in self.levels:
            np.add(sums[left], sums[right], out=sums[node[0] : node[-1] + 1]) if node[-1] - node[0] + 1 == len(node) else sums.__setitem__(node, sums[left] + sums[right])
        return np.stack([sums[r].sum(axis=0) if r else np.zeros(sums.shape[1], np.int64) for r in self.roots])


POSTINGS = "doc_id long, n long, terms array<int>, times array<int>"


def postings(docs: DataFrame, vocabulary: list[bytes]) -> DataFrame:
    """For every document its number of terms, and how often it has which terms of the vocabulary (by number)."""
    sent = docs.sparkSession.sparkContext.broadcast({t: i for i, t in enumerate(vocabulary)})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = sent.value.get
        for batch in batches:
            n, ends, found, times = [], [0], [], []
            for text in batch.column("text").to_pylist():
                words = terms(text)
                counts = Counter(map(number, words))
                counts.pop(None, None)
                n.append(len(words))
                found.extend(counts.keys())
                times.extend(counts.values())
                ends.append(len(found))
            at = pa.array(ends, pa.int32())
            lists = [pa.ListArray.from_arrays(at, pa.array(x, pa.int32())) for x in (found, times)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), *lists], ["doc_id", "n", "terms", "times"])

    return ids_and_text(docs).select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(count, POSTINGS)


class Best:
    """The k best documents of each item so far."""

    def __init__(self, items: int, k: int):
        self.k, self.least = k, np.zeros(items, np.int64)  # a score must exceed 0, and reach the k-th so far
        self.rows = np.empty((0, 4), np.int64)  # item, score, no_id, doc_id

    def add(self, scores: np.ndarray, no_id: np.ndarray, doc_id: np.ndarray) -> None:
        item, doc = np.nonzero((scores >= self.least[:, None]) & (scores > 0))
        if not len(item):
            return
        rows = np.concatenate([self.rows, np.stack([item, scores[item, doc], no_id[doc], doc_id[doc]], axis=1)])
        rows = rows[np.lexsort((rows[:, 3], rows[:, 2], -rows[:, 1], rows[:, 0]))]
        starts = np.searchsorted(rows[:, 0], np.arange(len(self.least)))
        place = np.arange(len(rows)) - starts[rows[:, 0]]
        self.rows = rows[place < self.k]
        last = place[place < self.k] == self.k - 1
        self.least[self.rows[last, 0]] = self.rows[last, 1]


def scored(posted: DataFrame, dag: Dag, queries: list[int], weights: list[int], docs_n: int, terms_n: int, k: int) -> DataFrame:
    """query, doc_id, score: the best k rows of each task for each item."""
    leaf_term, leaf_times = (np.array(x, np.int64) for x in zip(*dag.leaves))
    order = np.argsort(leaf_term, kind="stable")
    sent = posted.sparkSession.sparkContext.broadcast((dag, np.array(queries, np.int64), np.array(weights, np.int64), leaf_term, leaf_times, order))

    def evaluate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dag, queries, weights, leaf_term, leaf_times, order = sent.value
        slice_rows, best = max(8, SLICE_BYTES // (8 * max(1, dag.size))), Best(len(queries), k)
        for whole in batches:
            for at in range(0, whole.num_rows, slice_rows):
                batch = whole.slice(at, slice_rows)
                n = batch.column("n").to_pylist()
                m = np.array([25 + LONG_SHARE * x * docs_n // terms_n for x in n], np.int64)
                found, times = (batch.column(c) for c in ("terms", "times"))
                doc = np.repeat(np.arange(len(n)), found.value_lengths().to_numpy())
                term, tf = (x.flatten().to_numpy().astype(np.int64) for x in (found, times))
                by_term = np.zeros((len(weights), len(n)), np.int64)
                by_term[term, doc] = weights[term] * (UNIT * tf // (1000 * tf + 8 * m[doc]))
                ids = batch.column("doc_id")
                best.add(dag.scores(by_term[leaf_term] * leaf_times[:, None]), np.asarray(ids.is_null()).astype(np.int64), ids.fill_null(0).to_numpy().astype(np.int64))
        rows = best.rows
        ids = pa.array(rows[:, 3], pa.int64(), mask=rows[:, 2] == 1)
        yield pa.RecordBatch.from_arrays([pa.array(queries[rows[:, 0]], pa.int64()), ids, pa.array(rows[:, 1], pa.int64())], ["query", "doc_id", "score"])

    return posted.mapInArrow(evaluate, "query long, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, k: int = 10, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of each item with a score above 0.

    With N documents that have terms, L terms in all, n terms of a document, df documents that hold a term and tf its
    occurrences in one: w = floor(1000 * ln((2 N + 2) / (2 df + 1))), m = 25 + (75 n N) div L, and a score is the sum
    of w * ((10^9 tf) div (1000 tf + 8 m)) over the item's terms, repeats included.
    """
    spark = docs.sparkSession
    lean_batches(spark)
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).cast("binary")
    asked = written(items.select(F.col(f"`{item_col}`").alias("item_id"), text.alias("text"), F.monotonically_increasing_id().alias("query")), "asked")
    blocks = 1 + (asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // BLOCK_BYTES
    tops = []
    for block in range(blocks):
        rows = asked.filter(F.pmod("query", F.lit(blocks)) == block).select("query", "text").collect()  # BLOCK_BYTES at most, about
        counts = [Counter(terms(bytes(r["text"]))) for r in rows]
        vocabulary = sorted(set().union(*counts))
        if not vocabulary:
            continue
        number = {t: i for i, t in enumerate(vocabulary)}
        dag = Dag([{number[t]: c for t, c in item.items()} for item in counts])
        posted = written(postings(docs, vocabulary), "postings")
        docs_n, terms_n = posted.agg(F.count_if(F.col("n") > 0), F.sum("n")).first()
        if not docs_n:
            continue
        df = dict(posted.select(F.explode("terms").alias("term")).groupBy("term").count().collect())  # a row for each term of the block
        weights = [math.floor(1000 * math.log((2 * docs_n + 2) / (2 * df.get(t, 0) + 1))) for t in range(len(vocabulary))]
        tops.append(scored(posted, dag, [r["query"] for r in rows], weights, docs_n, terms_n, k))
    if not tops:
        return asked.filter("false").select("item_id", F.lit(0).alias("rank"), F.lit(None).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score"))
    found = tops[0]
    for top in tops[1:]:
        found = found.unionByName(top)
    best = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.join(asked.select("query", "item_id"), "query").select("item_id", "rank", "doc_id", "score")


ORACLE = r"""
WITH abc AS (SELECT 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' AS u, 'abcdefghijklmnopqrstuvwxyz' AS l),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), u, l), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents, abc),
q AS (SELECT row_number() OVER () AS q, item_id, regexp_extract_all(translate(coalesce(text, ''), u, l), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM benchmark, abc),
qt AS (SELECT q, term, count(*) AS c FROM (SELECT q, unnest(ts) AS term FROM q) GROUP BY q, term),
s AS (SELECT count(*) AS n_docs, sum(len(ts))::BIGINT AS n_terms FROM d WHERE len(ts) > 0),
p AS (SELECT r, term, count(*)::BIGINT AS tf FROM (SELECT r, unnest(ts) AS term FROM d) WHERE term IN (SELECT term FROM qt) GROUP BY r, term),
w AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM p, s GROUP BY term, n_docs),
v AS (SELECT p.r, p.term, w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * len(ts) * n_docs) // n_terms))) AS v FROM p JOIN w USING (term) JOIN d USING (r), s),
x AS (SELECT q, r, sum(c * v)::BIGINT AS score FROM qt JOIN v USING (term) GROUP BY q, r),
ranked AS (SELECT q, doc_id, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id) AS rank FROM x JOIN d USING (r) WHERE score > 0)
SELECT item_id, rank::INT AS rank, doc_id, score FROM ranked JOIN q USING (q) WHERE rank <= 10
"""
