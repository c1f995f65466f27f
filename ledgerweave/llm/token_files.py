"""Token-id files with byte- or bit-plane shuffling.

A file set is a Parquet dataset: one row is one chunk of whole documents. A chunk's ids are cut into blocks of
BLOCK ids; each block is transposed into planes (the low bytes of all its ids, then the next bytes, and so on, or
the same by bits) and each plane is compressed with zstandard. Beside the planes the row holds the chunk index:
shard, position, number of ids, documents and their lengths, block and plane sizes, and a checksum. Chunks decode
alone, so readers take them in any order; the Spark committer makes the write safe against lost executors.

Shards follow the ascending order of doc_id (nulls first; rows of equal id by text), dealt by sampled splitters.

Defined results: null text is empty, so its document holds the end id alone; a null id stays null and comes first;
repeated rows are written once for each row; an empty table gives an empty file set; other columns are ignored.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import byte_level_encoding, encode_ids
from .common import ids_and_text, partitions, shared_dir

#: Ids in a block, and ids after which a chunk is closed.
BLOCK, CHUNK = 1 << 16, 1 << 19
FILE_SCHEMA = (
    "shard int, chunk int, shard_start long, n_ids long, kind string, block int, doc_ids array<long>, "
    "doc_lens array<long>, plane_sizes array<int>, planes binary, crc long"
)


def to_planes(ids: np.ndarray, kind: str = "byte") -> list[bytes]:
    """The planes of one block of unsigned 32-bit ids, lowest first."""
    rows = np.ascontiguousarray(ids, dtype="<u4").view(np.uint8).reshape(-1, 4)
    if kind == "byte":
        return [rows[:, k].tobytes() for k in range(4)]
    bits = np.unpackbits(rows, axis=1, bitorder="little")
    return [np.packbits(bits[:, k]).tobytes() for k in range(32)]


def from_planes(planes: list[bytes], n: int, kind: str = "byte") -> np.ndarray:
    """The block's ids again."""
    if kind == "byte":
        rows = np.stack([np.frombuffer(p, np.uint8) for p in planes], axis=1)
    else:
        bits = np.stack([np.unpackbits(np.frombuffer(p, np.uint8), count=n) for p in planes], axis=1)
        rows = np.packbits(bits, axis=1, bitorder="little")
    return np.ascontiguousarray(rows).view("<u4").ravel()


def pack_chunk(ids: np.ndarray, kind: str = "byte", block: int = BLOCK, level: int = 3) -> tuple[list[int], bytes]:
    """Sizes of the compressed planes and their bytes, block after block."""
    zip_ = zstandard.ZstdCompressor(level=level).compress
    parts = [zip_(p) for at in range(0, len(ids), block) for p in to_planes(ids[at : at + block], kind)]
    return [len(p) for p in parts], b"".join(parts)


def unpack_chunk(sizes: list[int], planes: bytes, n: int, kind: str, block: int = BLOCK) -> np.ndarray:
    unzip, width, out, at = zstandard.ZstdDecompressor().decompress, 4 if kind == "byte" else 32, [], 0
    ends = np.cumsum([0, *sizes])
    for k in range(0, len(sizes), width):
        parts = [unzip(planes[ends[k + j] : ends[k + j + 1]]) for j in range(width)]
        out.append(from_planes(parts, min(block, n - at), kind))
        at += len(out[-1])
    return np.concatenate(out) if out else np.empty(0, np.uint32)


def write_token_files(
    docs: DataFrame, tokenizer_path: str, end_id: int, path: str | None = None, kind: str = "byte", id_col="doc_id", text_col="text"
) -> str:
    """Encode every document, append end_id, and write the file set in ascending doc_id order; returns its path."""
    if kind not in ("byte", "bit"):
        raise ValueError("kind is byte or bit")
    spark = docs.sparkSession
    path = path or f"{shared_dir(spark)}/token-files-{uuid.uuid4().hex}"
    rows = ids_and_text(docs, id_col, text_col)
    ordered = rows.repartitionByRange(partitions(spark), F.asc_nulls_first("doc_id"), F.xxhash64("text"))
    ordered = ordered.sortWithinPartitions(F.asc_nulls_first("doc_id"), "text")

    def shard(batches):
        encoding, me = byte_level_encoding(tokenizer_path), TaskContext.get().partitionId()
        end = np.array([end_id], np.uint32)
        held: list[np.ndarray] = []
        names: list = []
        state = {"chunk": 0, "start": 0}

        def flush():
            ids = np.concatenate([x for doc in held for x in (doc, end)])
            sizes, planes = pack_chunk(ids, kind)
            row = {
                "shard": me, "chunk": state["chunk"], "shard_start": state["start"], "n_ids": len(ids), "kind": kind, "block": BLOCK,
                "doc_ids": list(names), "doc_lens": [len(x) + 1 for x in held], "plane_sizes": sizes, "planes": planes,
                "crc": zlib.crc32(ids.tobytes()),
            }
            state["chunk"] += 1
            state["start"] += len(ids)
            held.clear()
            names.clear()
            return pa.RecordBatch.from_pylist([row], schema=FILE_ARROW)

        n = 0
        for batch in batches:
            for name, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                held.append(encode_ids(encoding, text.as_py()))
                names.append(name)
                n += len(held[-1]) + 1
                if n >= CHUNK:
                    yield flush()
                    n = 0
        if held:
            yield flush()

    ordered.mapInArrow(shard, FILE_SCHEMA).write.option("compression", "uncompressed").parquet(path)
    return path


FILE_ARROW = pa.schema([
    ("shard", pa.int32()), ("chunk", pa.int32()), ("shard_start", pa.int64()), ("n_ids", pa.int64()), ("kind", pa.string()),
    ("block", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("doc_lens", pa.list_(pa.int64())), ("plane_sizes", pa.list_(pa.int32())),
    ("planes", pa.binary()), ("crc", pa.int64()),
])


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids (little-endian unsigned 32-bit) of every document of a file set.

    The index columns alone give each shard's place; there is one such row for each shard of the write, which
    bounds what is broadcast by the number of partitions.
    """
    chunks = spark.read.schema(FILE_SCHEMA).parquet(path)
    totals = chunks.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    place = totals.select(
        F.col("shard").alias("of"), F.coalesce(F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before")
    )

    def decoded(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ids = unpack_chunk(row["plane_sizes"], row["planes"], row["n_ids"], row["kind"], row["block"])
                if zlib.crc32(ids.tobytes()) != row["crc"]:
                    raise ValueError(f"shard {row['shard']}, chunk {row['chunk']} is damaged")
                raw, ends = ids.tobytes(), np.cumsum([0, *row["doc_lens"]])
                first = row["before"] + row["shard_start"]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(row["doc_ids"], pa.int64()), pa.array(first + ends[:-1], pa.int64()), pa.array(row["doc_lens"], pa.int64()),
                        pa.array([raw[4 * a : 4 * b] for a, b in zip(ends[:-1], ends[1:])], pa.binary()),
                    ],
                    ["doc_id", "start", "n_tokens", "ids"],
                )

    placed = chunks.join(F.broadcast(place), chunks["shard"] == place["of"]).drop("of")
    return placed.mapInArrow(decoded, "doc_id long, start long, n_tokens long, ids binary")
