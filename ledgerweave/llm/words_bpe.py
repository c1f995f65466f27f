"""Byte-level BPE by a global shuffle of distinct words, and decoding by the token-byte table.

Encoding. Documents are split into pre-tokens; a block of documents keeps each of its distinct words once, and the
positions as numbers into that list. The words are dealt by their hash, so that a task sees all blocks' copies of
a word, encodes each distinct word once, and sends the ids back to the blocks, where the documents are put together
by position. Words and ids travel in packed rows: one for each block and hash bucket that it has words of. The
buckets of a task come one after the other, so each distinct word is encoded exactly once.

Decoding looks ids up in the table of token bytes, whose size the vocabulary bounds.

Defined results: null text is empty (no ids); a null id stays null; repeated rows give repeated results; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from .bpe import GPT_PATTERN, rank_encoding, read_ranks
from .common import bucketed, ids_and_text, partitions

#: Bytes of text after which a block of documents is closed.
BLOCK_BYTES = 8 << 20
#: Hash buckets of words for each task that encodes them; it holds one bucket's distinct words at a time.
FINE = 4


def _words_blob(words: list[bytes]) -> bytes:
    """Lengths, then bytes, compressed."""
    lens = np.fromiter(map(len, words), np.uint32, len(words))
    return zstandard.compress(np.uint32(len(words)).tobytes() + lens.tobytes() + b"".join(words), 1)


def _blob_words(blob: bytes) -> list[bytes]:
    raw = zstandard.decompress(blob)
    n = int(np.frombuffer(raw, np.uint32, 1)[0])
    ends = np.cumsum(np.frombuffer(raw, np.uint32, n, 4)).tolist()
    at, base, out = 0, 4 + 4 * n, []
    for end in ends:
        out.append(raw[base + at : base + end])
        at = end
    return out


def _blocks(pattern: str, n: int):
    """(block, document ids, lengths in words, word numbers, and for each bucket its words in their order)."""

    def run(batches):
        find, me, made = regex.compile(pattern).findall, TaskContext.get().partitionId() << 32, 0
        number: dict[str, int] = {}
        names: list = []
        lens: list[int] = []
        numbers: list[np.ndarray] = []
        size = 0

        def close():
            # Frequent words get the low numbers, which compress well; a word's place among the packed words of all
            # buckets follows from its bucket.
            flat = np.concatenate(numbers) if numbers else np.empty(0, np.uint32)
            rank = np.argsort(-np.bincount(flat, minlength=len(number)), kind="stable")
            new = np.empty(len(rank), np.uint32)
            new[rank] = np.arange(len(rank), dtype=np.uint32)
            flat, seen = new[flat], list(number)
            words = [seen[i].encode() for i in rank.tolist()]
            bucket = np.fromiter((zlib.crc32(w) % n for w in words), np.int64, len(words))
            order = np.argsort(bucket, kind="stable")
            used, first = np.unique(bucket[order], return_index=True)
            parts = [[words[i] for i in idx] for idx in np.split(order, first[1:])] if len(words) else []
            planes = np.ascontiguousarray(flat.astype("<u4")).view(np.uint8).reshape(-1, 4).T.tobytes()
            row = {"block": me + made, "doc_ids": list(names), "doc_words": list(lens), "flat": zstandard.compress(planes, 3),
                   "of": zstandard.compress(np.searchsorted(used, bucket).astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), 3), "buckets": used.tolist(), "words": [_words_blob(p) for p in parts]}
            for x in (number, names, lens, numbers):
                x.clear()
            return pa.RecordBatch.from_pylist([row], schema=BLOCK_ARROW)

        for batch in batches:
            for name, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                text = text.as_py()
                found = find(text)
                names.append(name)
                lens.append(len(found))
                numbers.append(np.fromiter((number.setdefault(w, len(number)) for w in found), np.uint32, len(found)))
                size += len(text)
                if size >= BLOCK_BYTES:
                    yield close()
                    made, size = made + 1, 0
        if names:
            yield close()

    return run


BLOCK_ARROW = pa.schema([
    ("block", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("doc_words", pa.list_(pa.int64())), ("flat", pa.binary()), ("of", pa.binary()),
    ("buckets", pa.list_(pa.int32())), ("words", pa.list_(pa.binary())),
])
BLOCK_SCHEMA = "block long, doc_ids array<long>, doc_words array<long>, flat binary, of binary, buckets array<int>, words array<binary>"


def _encoded(rank_path: str, pattern: str):
    """Each distinct word of a bucket is encoded once; out go the ids of every block's words, in order."""

    def run(batches):
        encoding, known, of = rank_encoding(rank_path, pattern), {}, None
        for batch in batches:
            ids_out = []
            for bucket, blob in zip(batch.column("bucket").to_pylist(), batch.column("blob")):
                if bucket != of:  # all copies of a word lie in one bucket, and buckets come one after the other
                    known, of = {}, bucket
                ids = []
                for word in _blob_words(blob.as_py()):
                    got = known.get(word)
                    if got is None:
                        # A pre-token is encoded by itself: it must not be split anew.
                        got = known[word] = np.array(encoding._encode_single_piece(word), "<u4").tobytes()
                    ids.append(got)
                counts = np.fromiter(map(len, ids), np.uint32, len(ids)) // 4
                ids_out.append(zstandard.compress(np.uint32(len(ids)).tobytes() + counts.tobytes() + b"".join(ids), 1))
            yield pa.RecordBatch.from_arrays([batch.column("block"), batch.column("bucket"), pa.array(ids_out, pa.binary())], ["block", "bucket", "ids"])

    return run


def _planes(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(blob), np.uint8)
    return np.ascontiguousarray(planes.reshape(4, -1).T).view("<u4").ravel()


def _assembled(batches):
    for batch in batches:
        for i in range(batch.num_rows):
            coded = sorted(((c["bucket"], c["ids"]) for c in batch.column("coded")[i].as_py() or []))
            counts, ids = [np.empty(0, np.int64)], [np.empty(0, np.uint32)]
            for _, blob in coded:
                raw = zstandard.decompress(blob)
                n = int(np.frombuffer(raw, np.uint32, 1)[0])
                counts.append(np.frombuffer(raw, np.uint32, n, 4).astype(np.int64))
                ids.append(np.frombuffer(raw, np.uint32, -1, 4 + 4 * n))
            count, ids = np.concatenate(counts), np.concatenate(ids)
            # The packed words stand by bucket, in the order of their numbers within it.
            by_bucket = np.argsort(_planes(batch.column("of")[i].as_py()), kind="stable")
            start, place = np.cumsum(count) - count, np.empty(len(count), np.int64)
            place[by_bucket] = np.arange(len(count))
            count, start = count[place], start[place]
            flat = _planes(batch.column("flat")[i].as_py())
            names, lens = batch.column("doc_ids")[i].as_py(), batch.column("doc_words")[i].as_py()
            at = 0
            for lo in range(0, len(names), 256):
                out, n_tokens = [], []
                for words in lens[lo : lo + 256]:
                    w = flat[at : at + words]
                    at += words
                    c = count[w]
                    total = int(c.sum())
                    pick = np.arange(total) + np.repeat(start[w] - (np.cumsum(c) - c), c)
                    out.append(ids[pick].astype("<u4").tobytes())
                    n_tokens.append(total)
                yield pa.RecordBatch.from_arrays([pa.array(names[lo : lo + 256], pa.int64()), pa.array(n_tokens, pa.int64()), pa.array(out, pa.binary())], ["doc_id", "n_tokens", "ids"])


def encode(docs: DataFrame, rank_path: str, pattern: str = GPT_PATTERN, id_col="doc_id", text_col="text") -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit) of every document."""
    n = partitions(docs.sparkSession)
    blocks = bucketed(ids_and_text(docs, id_col, text_col).mapInArrow(_blocks(pattern, n * FINE), BLOCK_SCHEMA), "block", n, "word_blocks")
    words = blocks.select("block", F.explode(F.arrays_zip("buckets", "words")).alias("w")).select(
        "block", F.col("w.buckets").alias("bucket"), F.col("w.words").alias("blob")
    )
    coded = words.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(_encoded(rank_path, pattern), "block long, bucket int, ids binary")
    back = coded.groupBy("block").agg(F.collect_list(F.struct("bucket", "ids")).alias("coded"))  # a row for each bucket at most
    joined = blocks.select("block", "doc_ids", "doc_words", "flat", "of").join(back, "block", "left")
    return joined.mapInArrow(_assembled, "doc_id long, n_tokens long, ids binary")


def decode(coded: DataFrame, rank_path: str, id_col="doc_id", ids_col="ids") -> DataFrame:
    """All columns of coded and `decoded`, the bytes that its ids stand for (null ids: null).

    The token-byte table has one row for each rank, which is what bounds its broadcast.
    """
    table = read_ranks(rank_path)
    sent = coded.sparkSession.sparkContext.broadcast([t for t, _ in sorted(table.items(), key=lambda x: x[1])])
    where = coded.schema.fieldNames().index(ids_col)

    def run(batches):
        token = sent.value.__getitem__
        for batch in batches:
            out = [
                None if x is None else b"".join(map(token, np.frombuffer(x, "<u4").tolist())) for x in batch.column(where).to_pylist()
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], [*batch.schema.names, "decoded"])

    schema = StructType([*coded.schema.fields, StructField("decoded", BinaryType())])
    return coded.mapInArrow(run, schema)
