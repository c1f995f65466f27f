"""Repeated passages by bucket-pointer refinement over sampled suffixes.

A byte goes if some string of `length` bytes that covers it starts in more than one place. Every string of that
length belongs to one sampled suffix: the one whose q-gram has the smallest name inside the string (the leftmost of
equals), so equal strings belong to suffixes with equal q-grams at the same place inside them. Sampled suffixes
start in the bucket of their q-gram. A bucket is refined by the bucket names at later offsets, q, 2q, ... bytes
on, each level reusing the names of the level before; strings are looked up in the deepest level that they cover.
Names are 64-bit hashes of the content that they stand for, so that buckets of all documents meet without a global
renumbering, and one shuffle sorts all levels.

1. A block of documents keeps its texts and, for each sampled suffix and level, the strings it stands for. The
   distinct (bucket, content) pairs of the block are dealt by bucket, in packed arrays.
2. A bucket with one entry repeats nothing. Equal contents in a bucket repeat in full. Only a content that is alone
   in a bucket of several is open: the edges of passages.
3. For the open ones (and one copy of each repeated content in their buckets) the names of all single strings are
   dealt in the same way; those seen twice are repeated.
4. Each block gets both answers and cuts its documents.

A name is dealt once for each block at most, so a passage that a third of all documents share reaches a task as
one entry a block.

Defined results: null text is empty; texts shorter than the length keep all bytes; rows with a null or repeated id
are documents of their own (of repeated rows, each one's strings start elsewhere too); an empty table gives an
empty result; other columns are ignored, or kept by `cut_passages`.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import pyarrow.ipc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StringType, StructField, StructType

from .common import bucketed, ids_and_text, lean_batches, partitions, written
from .near_dedup import _runs as runs_of
from .near_dedup import mixed

#: Bytes of text after which a block is closed; positions that are handled at a time; hash buckets for each task
#: that judges them (it holds one at a time).
BLOCK_BYTES, CHUNK, FINE = 4 << 20, 1 << 22, 8
#: Low bits of a gram's name that give way to its position when the smallest is sought.
PLACE = np.uint64((1 << 24) - 1)
FACTOR = 0x9E3779B97F4A7C55


@functools.lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.random.default_rng(7).integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """FACTOR^i and its inverse, for i below n at least."""
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        for k, f in enumerate((FACTOR, pow(FACTOR, -1, 1 << 64))):
            steps = np.full(size, f, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps)
    return _powers[0], _powers[1]


def gram_size(length: int) -> int:
    """Bytes in a q-gram: the largest power of two in a third of the length, so that buckets are refined at least once."""
    return 1 << (length // 3).bit_length() - 1


class Names:
    """Names of any stretch of one text, from prefix sums of a polynomial over scrambled bytes."""

    def __init__(self, raw: np.ndarray):
        up, self.down = powers(len(raw) + 1)
        self.sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(_letters()[raw] * up[: len(raw)], out=self.sums[1:])

    def __call__(self, start, stop) -> np.ndarray:
        return mixed((self.sums[stop] - self.sums[start]) * self.down[start])


def sampled(names: Names, n: int, length: int, gram: int):
    """(position, first string's start, last string's start) of every sampled suffix of a text of n bytes."""
    width = length - gram + 1
    out = []
    for base in range(0, n - length + 1, CHUNK):
        starts = min(CHUNK, n - length + 1 - base)
        m = starts + width - 1
        grams = mixed((names.sums[base + gram : base + gram + m] - names.sums[base : base + m]) * names.down[base : base + m])
        low = (grams & ~PLACE) | np.arange(m, dtype=np.uint64)
        k = 1
        while 2 * k <= width:
            low = np.minimum(low[:-k], low[k:])
            k *= 2
        low = np.minimum(low[:starts], low[width - k : width - k + starts])
        place = (low & PLACE).astype(np.int64) + base
        first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
        out.append((place[first], first + base, np.r_[first[1:], starts] - 1 + base))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.empty(0, np.int64),) * 3


def bucket_names(names: Names, place: np.ndarray, level: int, gram: int) -> np.ndarray:
    """The bucket of suffixes at `place` after `level` refinements: two buckets of the level before, gram * 2^(level-1) apart."""
    if level == 0:
        return names(place, place + gram)
    before = gram << (level - 1)
    return mixed(bucket_names(names, place, level - 1, gram) * np.uint64(3) + bucket_names(names, place + before, level - 1, gram))


def strings(raw: np.ndarray, length: int):
    """(first start, last start, bucket, content) for each sampled suffix and level of a text."""
    n, gram = len(raw), gram_size(length)
    if n < length:
        return (np.empty(0, np.int64),) * 2 + (np.empty(0, np.uint64),) * 2
    names = Names(raw)
    place, first, last = sampled(names, n, length, gram)
    levels = max(k for k in range(16) if gram << k <= length) + 1
    parts = []
    for level in range(levels):
        # A string starting `back` bytes before its suffix covers length - back bytes of it.
        most, least = length - (gram << level), (length - (gram << (level + 1)) + 1 if level + 1 < levels else 0)
        lo, hi = np.maximum(first, place - most), np.minimum(last, place - max(least, 0))
        ok = np.flatnonzero(lo <= hi)
        lo, hi, at = lo[ok], hi[ok], place[ok]
        bucket = mixed(bucket_names(names, at, level, gram) + np.uint64(level))
        content = mixed(names(lo, hi + length) + ((at - lo) * 65536 + (at - hi)).astype(np.uint64))
        parts.append((lo, hi, bucket, content))
    return tuple(np.concatenate(x) for x in zip(*parts))


def _zip(*arrays: np.ndarray) -> bytes:
    return zstandard.compress(b"".join(np.ascontiguousarray(a).tobytes() for a in arrays), 1)


def _unzip(blob: bytes, *kinds: str) -> list[np.ndarray]:
    raw, at, out = zstandard.decompress(blob), 0, []
    n = len(raw) // sum(np.dtype(k).itemsize for k in kinds)
    for k in kinds:
        out.append(np.frombuffer(raw, k, n, at))
        at += n * np.dtype(k).itemsize
    return out


def _by_bucket(keys: np.ndarray, n: int, *more: np.ndarray):
    """Where each row goes in an order by hash bucket, the buckets in use, and a packed array for each of them."""
    bucket = ((keys >> np.uint64(24)) % np.uint64(n)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    place = np.empty(len(keys), np.int64)
    place[order] = np.arange(len(keys))
    used, at = np.unique(bucket[order], return_index=True)
    parts = [np.split(a[order], at[1:]) for a in (keys, *more)] if len(keys) else [[]] * (1 + len(more))
    return place, used.tolist(), [b"".join(p.tobytes() for p in x) for x in zip(*parts)]


def _stream(batches: list[pa.RecordBatch]) -> bytes:
    """The rows of a block without their texts."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batches[0].schema) as out:
        for b in batches:
            out.write_batch(b)
    return zstandard.compress(sink.getvalue().to_pybytes(), 1)


PACKS = [("buckets", pa.list_(pa.int32())), ("packs", pa.list_(pa.binary()))]
BLOCK_ARROW = pa.schema([("block", pa.int64()), ("others", pa.binary()), ("doc_lens", pa.list_(pa.int64())), ("texts", pa.binary()), ("rows", pa.binary()), *PACKS])
BLOCK_SCHEMA = "block long, others binary, doc_lens array<long>, texts binary, rows binary, buckets array<int>, packs array<binary>"
OPEN_ARROW = pa.schema([("block", pa.int64()), ("closed", pa.binary()), ("open", pa.binary()), *PACKS])
OPEN_SCHEMA = "block long, closed binary, open binary, buckets array<int>, packs array<binary>"


def _blocks(length: int, n: int):
    def run(batches):
        me, made, size = TaskContext.get().partitionId() << 32, 0, 0
        others, lens, texts, found, base = [], [], [], [], 0

        def close():
            lo, hi, bucket, content = (np.concatenate(x) for x in zip(*found))
            order = np.lexsort((content, bucket))
            b, c = bucket[order], content[order]
            new = np.r_[True, (b[1:] != b[:-1]) | (c[1:] != c[:-1])] if len(b) else np.empty(0, bool)
            times, which = np.diff(np.r_[np.flatnonzero(new), len(b)]), np.empty(len(b), np.int64)
            which[order] = np.cumsum(new) - 1
            place, used, packs = _by_bucket(b[new], n, c[new], (times > 1).astype(np.uint8))
            rows = _zip(np.diff(lo, prepend=0).astype("<i4"), (hi - lo).astype("<i4"), place[which].astype("<i4"))
            return pa.RecordBatch.from_pylist(
                [{"block": me + made, "others": _stream(others), "doc_lens": list(lens), "texts": zstandard.compress(b"".join(texts), 3), "rows": rows, "buckets": used, "packs": packs}],
                schema=BLOCK_ARROW,
            )

        for batch in batches:
            aside, since = batch.select([c for c in batch.schema.names if c != "text"]), 0
            for i, text in enumerate(batch.column("text")):
                raw = text.as_py().encode("utf-8", "surrogatepass")
                lo, hi, bucket, content = strings(np.frombuffer(raw, np.uint8), length)
                found.append((lo + base, hi + base, bucket, content))
                lens.append(len(raw))
                texts.append(raw)
                base += len(raw)
                if base >= BLOCK_BYTES:
                    others.append(aside.slice(since, i + 1 - since))
                    yield close()
                    made, base, since = made + 1, 0, i + 1
                    for x in (others, lens, texts, found):
                        x.clear()
            others.append(aside.slice(since))
        if lens:
            yield close()

    return run


#: Answers on a (bucket, content) pair.
ALONE, REPEATED, OPEN, SHOWN = 0, 1, 2, 3


def _judged(batches):
    """An answer for each pair of each block: SHOWN is a repeated content that the open ones of its bucket are held against."""
    for held in runs_of(batches, ["bucket", "block", "pack"], 1):
        sizes = [len(raw) // 17 for raw in held["pack"]]
        parts = [(np.frombuffer(raw, np.uint64, n), np.frombuffer(raw, np.uint64, n, 8 * n), np.frombuffer(raw, np.uint8, n, 16 * n)) for raw, n in zip(held["pack"], sizes)]
        yield _answers(held, sizes, _verdicts(*(np.concatenate(x) for x in zip(*parts))))


def _verdicts(key: np.ndarray, content: np.ndarray, many: np.ndarray) -> np.ndarray:
    order = np.lexsort((content, key))
    k, c = key[order], content[order]
    new_key = np.r_[True, k[1:] != k[:-1]]
    new_pair = new_key | np.r_[True, c[1:] != c[:-1]]
    of_pair, of_key = np.cumsum(new_pair) - 1, np.cumsum(new_key) - 1
    times = np.bincount(of_pair, 1.0 + many[order])[of_pair]
    contents = np.bincount(of_key, new_pair)[of_key]
    answer = np.where(times > 1, np.where(new_pair & (contents > 1), SHOWN, REPEATED), np.where(contents > 1, OPEN, ALONE)).astype(np.uint8)
    out = np.empty(len(key), np.uint8)
    out[order] = answer
    # A repeated content is shown only where its bucket has open ones.
    has_open = np.bincount(of_key, answer == OPEN)[of_key] > 0
    out[order] = np.where((answer == SHOWN) & ~has_open, REPEATED, answer)
    return out


def _seen_twice(batches):
    """For each name of each block, whether it was seen more than once in all."""
    for held in runs_of(batches, ["bucket", "block", "pack"], 1):
        sizes = [len(raw) // 9 for raw in held["pack"]]
        parts = [(np.frombuffer(raw, np.uint64, n), np.frombuffer(raw, np.uint8, n, 8 * n)) for raw, n in zip(held["pack"], sizes)]
        key, many = (np.concatenate(x) for x in zip(*parts))
        _, which = np.unique(key, return_inverse=True)
        yield _answers(held, sizes, (np.bincount(which, 1.0 + many)[which] > 1).astype(np.uint8))


def _answers(held: dict, sizes: list[int], answer: np.ndarray):
    blobs = [zstandard.compress(x.tobytes(), 1) for x in np.split(answer, np.cumsum(sizes)[:-1])]
    return pa.RecordBatch.from_arrays([pa.array(held["block"], pa.int64()), pa.array(held["bucket"], pa.int32()), pa.array(blobs, pa.binary())], ["block", "bucket", "answer"])


def _asked(table: DataFrame, judge, n: int, name: str) -> DataFrame:
    """The answers on a table's packs, gathered by block: one for each bucket that the block has."""
    packs = table.select("block", F.explode(F.arrays_zip("buckets", "packs")).alias("p")).select("block", F.col("p.buckets").alias("bucket"), F.col("p.packs").alias("pack"))
    answers = packs.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(judge, "block long, bucket int, answer binary")
    return answers.groupBy("block").agg(F.collect_list(F.struct("bucket", "answer")).alias(name))


def _gathered(row) -> np.ndarray:
    return np.frombuffer(b"".join(zstandard.decompress(a["answer"]) for a in sorted(row or [], key=lambda a: a["bucket"])), np.uint8)


def _spread(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """All integers of the ranges lo..hi, one range after the other."""
    size = hi - lo + 1
    return np.arange(int(size.sum())) + np.repeat(lo - (np.cumsum(size) - size), size)


def _opened(length: int, n: int):
    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                answer = _gathered(batch.column("judged")[i].as_py())
                lo, hi, pair = (x.astype(np.int64) for x in _unzip(batch.column("rows")[i].as_py(), "<i4", "<i4", "<i4"))
                lo = np.cumsum(lo)
                hi = lo + hi
                mine = answer[pair] if len(pair) else np.empty(0, np.uint8)
                shut = (mine == REPEATED) | (mine == SHOWN)
                look = np.flatnonzero(mine >= OPEN)
                # Of a shown content one copy in this block is enough, and it is known to repeat.
                shown = look[mine[look] == SHOWN]
                shown = shown[np.unique(pair[shown], return_index=True)[1]]
                look = np.sort(np.r_[look[mine[look] == OPEN], shown])
                text = np.frombuffer(zstandard.decompress(batch.column("texts")[i].as_py()), np.uint8)
                ends = np.cumsum(batch.column("doc_lens")[i].as_py())
                starts = np.r_[0, ends[:-1]]
                names_of, open_at, many = [], [], []
                doc = np.searchsorted(ends, lo[look], side="right")
                for d in np.unique(doc):
                    rows = look[doc == d]
                    at = _spread(lo[rows], hi[rows]) - starts[d]
                    names_of.append(Names(text[starts[d] : ends[d]])(at, at + length))
                    open_at.append(at + starts[d])
                    many.append(np.repeat(mine[rows] == SHOWN, hi[rows] - lo[rows] + 1))
                key = np.concatenate(names_of) if names_of else np.empty(0, np.uint64)
                at = np.concatenate(open_at) if open_at else np.empty(0, np.int64)
                many = np.concatenate(many) if many else np.empty(0, bool)
                distinct, which, times = np.unique(key, return_inverse=True, return_counts=True)
                often = (times > 1) | (np.bincount(which, many, len(distinct)) > 0 if len(key) else np.empty(0, bool))
                place, used, packs = _by_bucket(distinct, n, often.astype(np.uint8))
                keep = ~many
                row = {"block": batch.column("block")[i].as_py(), "closed": _zip(lo[shut], hi[shut]), "open": _zip(at[keep], place[which][keep] if len(key) else at), "buckets": used, "packs": packs}
                yield pa.RecordBatch.from_pylist([row], schema=OPEN_ARROW)

    return run


def _cut(length: int, words: int):
    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                again = _gathered(batch.column("seen")[i].as_py())
                lo, hi = _unzip(batch.column("closed")[i].as_py(), "<i8", "<i8")
                at, which = _unzip(batch.column("open")[i].as_py(), "<i8", "<i8")
                at = at[again[which] > 0] if len(which) else at
                lens = batch.column("doc_lens")[i].as_py()
                text = np.frombuffer(zstandard.decompress(batch.column("texts")[i].as_py()), np.uint8)
                change = np.zeros(len(text) + 1, np.int32)
                for first, last in ((lo, hi), (at, at)):
                    np.add.at(change, first, 1)
                    np.add.at(change, last + length, -1)
                gone = np.cumsum(change[:-1], dtype=np.int32) > 0
                others = pa.ipc.open_stream(zstandard.decompress(batch.column("others")[i].as_py())).read_all()
                end = np.cumsum(lens)
                for a in range(0, len(lens), 256):
                    spans, kept = [], []
                    for stop, size in zip(end[a : a + 256], lens[a : a + 256]):
                        g, t = gone[stop - size : stop], text[stop - size : stop]
                        edge = np.flatnonzero(np.diff(np.r_[False, g, False]))
                        for lo_, hi_ in zip(edge[::2], edge[1::2]) if words else ():
                            if len(t[lo_:hi_].tobytes().split()) < words:
                                g[lo_:hi_] = False
                        edge = np.flatnonzero(np.diff(np.r_[False, g, False])) if words else edge
                        spans.append([{"start": s, "stop": e} for s, e in zip(edge[::2].tolist(), edge[1::2].tolist())])
                        kept.append(t[~g].tobytes() if len(edge) else t.tobytes())
                    side = others.slice(a, 256).combine_chunks()
                    yield pa.RecordBatch.from_arrays(
                        [*(c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in side.columns), pa.array(lens[a : a + 256], pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))), pa.array(kept, pa.binary()), pa.array([x.decode("utf-8", "ignore") for x in kept], pa.string())],
                        [*side.schema.names, "n_bytes", "spans", "kept", "kept_text"],
                    )

    return run


def _marked(rows: DataFrame, length: int, words: int = 0) -> DataFrame:
    """All columns of rows but text, then n_bytes, spans, kept, kept_text."""
    if length < 24:
        raise ValueError("length is at least 24")
    lean_batches(rows.sparkSession)
    n = partitions(rows.sparkSession)
    blocks = bucketed(rows.mapInArrow(_blocks(length, n * FINE), BLOCK_SCHEMA), "block", n, "text_blocks")
    judged = _asked(blocks, _judged, n, "judged")
    first = blocks.select("block", "doc_lens", "texts", "rows").join(judged, "block", "left")
    opened = written(first.mapInArrow(_opened(length, n * FINE), OPEN_SCHEMA), "open-blocks", "uncompressed")
    seen = _asked(opened, _seen_twice, n, "seen")
    last = blocks.select("block", "others", "doc_lens", "texts").join(opened.select("block", "closed", "open"), "block").join(seen, "block", "left")
    span = ArrayType(StructType([StructField("start", LongType()), StructField("stop", LongType())]))
    more = [StructField("n_bytes", LongType()), StructField("spans", span), StructField("kept", BinaryType()), StructField("kept_text", StringType())]
    return last.mapInArrow(_cut(length, words), StructType([f for f in rows.schema.fields if f.name != "text"] + more))


def repeated_spans(docs: DataFrame, length: int = 400, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, spans (array of start, stop in bytes: the removed runs), kept (the bytes that stay) and kept_text
    (those as a text, without characters that a cut has split) for every row."""
    return _marked(ids_and_text(docs, id_col, text_col), length)


def cut_passages(docs: DataFrame, length: int = 400, words: int = 0, text_col: str = "text") -> DataFrame:
    """docs with the repeated passages cut out of the text column; rows whose text is cut to nothing stay, empty.

    With `words`, only runs of at least so many words are cut (words lie between ASCII blanks; one that the run
    holds in part counts). A cut may fall inside a character: the incomplete bytes at its ends go too. A null text
    comes back empty.
    """
    own = [c for c in docs.columns if c != text_col]
    rows = docs.select(*[F.col(f"`{c}`").alias(f"x{k}") for k, c in enumerate(own)], F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    marked = _marked(rows, length, words)
    back = {c: F.col(f"x{k}") for k, c in enumerate(own)} | {text_col: F.col("kept_text")}
    return marked.select(*[back[c].alias(c) for c in docs.columns])
