"""Packing into training sequences by best-fit decreasing.

A document's ids are cut into full windows of the sequence length; what is left over (shorter than a window) is
packed: longest first, each into the open sequence with the least room that still holds it. A segment tree over
the possible remaining capacities finds that sequence in a number of steps that depends on the window only.
Pieces are dealt evenly over tasks, whatever they hold, and sorted there by Spark, so that a task places one piece
after the other and holds no more than its open sequences. Each task packs sequences of its own, so the padding is at
most a few open sequences a task.

Defined results: null text is empty, so its document is the end id alone; a null id stays null; repeated rows are
packed once for each row; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import byte_level_encoding, encode_ids
from .common import ids_and_text, partitions


class OpenWindows:
    """Open sequences by remaining capacity, in a segment tree of counts."""

    def __init__(self, size: int):
        self.width = 1 << size.bit_length()
        self.count = [0] * (2 * self.width)
        self.at: list[list[int]] = [[] for _ in range(size + 1)]

    def _add(self, room: int, by: int) -> None:
        k = self.width + room
        while k:
            self.count[k] += by
            k >>= 1

    def put(self, sequence: int, room: int) -> None:
        if room > 0:
            self.at[room].append(sequence)
            self._add(room, 1)

    def take(self, need: int) -> tuple[int, int] | None:
        """The sequence with the least room >= need, and that room; it is no longer open."""
        k = self.width + need
        if not self.count[k]:
            while k > 1 and (k & 1 or not self.count[k + 1]):
                k >>= 1
            if k <= 1:
                return None
            k += 1
            while k < self.width:
                k = 2 * k if self.count[2 * k] else 2 * k + 1
        room = k - self.width
        self._add(room, -1)
        return self.at[room].pop(), room


class BestFit:
    """Places lengths, longest first: each in the open sequence with the least room for it, or in a new one."""

    def __init__(self, size: int):
        self.windows, self.size, self.opened = OpenWindows(size), size, 0

    def place(self, length: int) -> tuple[int, int]:
        """(sequence, from 0, and offset there)."""
        found = self.windows.take(length)
        if found is None:
            found, self.opened = (self.opened, self.size), self.opened + 1
        sequence, room = found
        self.windows.put(sequence, room - length)
        return sequence, self.size - room


def pack_documents(
    docs: DataFrame, tokenizer_path: str, end_id: int = 1, size: int = 2048, id_col="doc_id", text_col="text"
) -> DataFrame:
    """doc_id, start, length, doc_tokens, sequence_id, offset, ids (little-endian unsigned 32-bit) of every piece."""

    n = partitions(docs.sparkSession)

    def cut(batches):
        encoding, dealt = byte_level_encoding(tokenizer_path), TaskContext.get().partitionId() * 7919
        narrow = np.dtype("<u2") if max(encoding.n_vocab, end_id + 1) <= 1 << 16 else np.dtype("<u4")
        for batch in batches:
            names, start, total, parts = [], [], [], []
            for name, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                ids = np.append(encode_ids(encoding, text.as_py()), np.uint32(end_id)).astype(narrow)
                for at in range(0, len(ids), size):
                    names.append(name)
                    start.append(at)
                    total.append(len(ids))
                    parts.append(ids[at : at + size].tobytes())
            lengths = np.fromiter(map(len, parts), np.int64, len(parts)) // narrow.itemsize
            # Pieces go to the tasks in turn: neither equal texts nor equal ids can meet in one.
            turn = (dealt + np.arange(len(parts))) % (1 << 30)
            dealt += len(parts)
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.int64()), pa.array(start, pa.int64()), pa.array(total, pa.int64()), pa.array(lengths), pa.array(turn.astype(np.int32)), pa.array([narrow.itemsize] * len(names), pa.int32()), pa.array(parts, pa.binary())],
                ["doc_id", "start", "doc_tokens", "length", "turn", "width", "part"],
            )

    def packed(batches):
        fit, first = BestFit(size), TaskContext.get().partitionId() << 32
        for batch in batches:
            if not batch.num_rows:
                continue
            placed = [fit.place(x) for x in batch.column("length").to_pylist()]
            kind = f"<u{batch.column('width')[0].as_py()}"
            ids = [np.frombuffer(x.as_py(), kind).astype("<u4").tobytes() for x in batch.column("part")]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("doc_id", "start", "length", "doc_tokens")), pa.array([first + s for s, _ in placed], pa.int64()), pa.array([o for _, o in placed], pa.int64()), pa.array(ids, pa.binary())],
                ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"],
            )

    kind = "doc_id long, start long, doc_tokens long, length long, turn int, width int, part binary"
    pieces = ids_and_text(docs, id_col, text_col).mapInArrow(cut, kind)
    dealt = pieces.repartition(n, "turn").sortWithinPartitions(F.desc("length"), "doc_id", "start").drop("turn")
    return dealt.mapInArrow(
        packed, "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"
    )
