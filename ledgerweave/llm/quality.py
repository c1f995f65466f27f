"""Quality classification by co-training.

Two classifiers look at a document: one at its text (hashed character n-grams with case, word shapes), one at its
page metadata (source, language, size; nothing that is read from the text). Both start from the labelled sample. In
each round each scores all unlabelled documents; all that it is sure about are marked for the other one, which then
trains on the labelled sample and a sample of those marks. Equal documents (text and metadata) count as one.
Labelled documents that were left out then calibrate each view, and the two calibrated logits are added (the prior
counted once) to score all documents.

The samples that are fitted are bounded: `per_class` labelled documents for each label, and `marks_per_class` marked
ones for each class, view and round; whole texts, picked by a hash of ids or contents. Training is on the driver;
the weights have a fixed size.

Defined results: without labels of both classes every row is kept with score 0.5; a class with fewer than four
labelled documents is calibrated on those that it was fitted on; a document with contradicting labels counts as
unlabelled; null text counts as empty, null metadata as a value of its own; repeated rows get equal results; rows
with a null id are scored but not learned from; an empty table gives an empty result; all other columns are carried
unchanged by `keep_good`.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StructField, StructType

from .common import lean_batches
from .ftrl import SoftmaxFTRL, platt, scores

#: Features of each view (powers of two), the bound of the sample, and the rounds of co-training.
TEXT_BITS, META_BITS, PER_CLASS, ROUNDS = 12, 10, 1500, 3
#: How sure a view must be of a mark; marks of each class, view and round in the sample that is fitted.
SURE, MARKS_PER_CLASS = 0.98, 600
#: Tasks that merge the samples of all tasks before the driver does.
MERGERS = 16
WORD = re.compile(r"\S+").findall


def text_view(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Root counts of hashed byte bigrams and word shapes, each part of unit length."""
    half = 1 << (TEXT_BITS - 1)
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8).astype(np.uint64)
    grams = np.zeros(half)
    if len(raw) > 1:
        h = (raw[:-1] * np.uint64(257) + raw[1:] + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        grams = np.sqrt(np.bincount((h >> np.uint64(64 - TEXT_BITS + 1)).astype(np.int64), minlength=half))
    # Class of each byte: other, lower, upper, digit, blank, mark, beyond ASCII; runs of equal classes make a shape.
    kind = BYTE_KIND[raw.astype(np.int64)]
    runs = kind[np.flatnonzero(np.r_[True, kind[1:] != kind[:-1]])] if len(kind) else kind
    shapes = np.zeros(half)
    if len(runs) > 3:
        key = runs[:-3] * 343 + runs[1:-2] * 49 + runs[2:-1] * 7 + runs[3:]
        shapes = np.sqrt(np.bincount(key % half, minlength=half))
    x = np.concatenate([v / max(np.sqrt(v @ v), 1e-9) for v in (grams, shapes)])
    at = np.flatnonzero(x)
    return np.r_[at, 1 << TEXT_BITS], np.r_[x[at], 1.0]


def _byte_kinds() -> np.ndarray:
    kinds = np.zeros(256, np.int64)
    for b in range(256):
        c = chr(b)
        kinds[b] = 6 if b > 127 else 1 if c.islower() else 2 if c.isupper() else 3 if c.isdigit() else 4 if c.isspace() else 5 if b > 32 else 0
    return kinds


BYTE_KIND = _byte_kinds()


def meta_view(source, lang, n_chars) -> tuple[np.ndarray, np.ndarray]:
    """One-hot page metadata: where it comes from, its language, its size, and the first two together."""
    size = np.log2(1 + max(n_chars or 0, 0))
    facts = (f"s{source}", f"l{lang}", f"b{source} {lang}", f"n{int(size)}", f"m{int(4 * size)}")
    at = np.unique([xxhash.xxh3_64_intdigest(f) % (1 << META_BITS) for f in facts])
    return np.r_[at, 1 << META_BITS], np.r_[np.full(len(at), 0.5), 1.0]


VIEWS = (((1 << TEXT_BITS) + 1), ((1 << META_BITS) + 1))


def _views(names: list[str]):
    def run(batches):
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for source, lang, n, text in zip(*(batch.column(c).to_pylist() for c in ("source", "lang", "n_chars", "text"))):
                for k, (at, x) in enumerate((text_view(text), meta_view(source, lang, n))):
                    out[2 * k].append(at.astype(np.int32).tobytes())
                    out[2 * k + 1].append(x.astype(np.float32).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("h"), batch.column("y"), *(pa.array(o, pa.binary()) for o in out)], names)

    return run


def _sides(docs: DataFrame, id_col: str, text_col: str) -> list:
    have = set(docs.columns)
    null = lambda kind: F.lit(None).cast(kind)
    return [
        F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
        *[(F.col(c).cast(k) if c in have else null(k)).alias(c) for c, k in (("source", "string"), ("lang", "string"), ("n_chars", "long"))],
    ]


class _Sample:
    """A sample of the marks (key, sureness) of each class and view: those with the smallest hashes; a key counts once."""

    def __init__(self, most: int):
        self.most, self.kept = most, {}

    def add(self, view: int, y: int, keys: list, sure: list) -> None:
        kept = self.kept.setdefault((view, y), {})
        kept.update(zip(keys, sure))
        if len(kept) > self.most:
            self.kept[view, y] = dict(sorted(kept.items(), key=lambda x: place(x[0]))[: self.most])

    def batch(self) -> pa.RecordBatch:
        rows = [(v, y, key, sure) for (v, y), kept in self.kept.items() for key, sure in kept.items()]
        columns = zip(*rows) if rows else ((), (), (), ())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int32(), pa.int32(), pa.int64(), pa.float64()))], ["view", "y", "key", "sure"])


def place(key: int) -> int:
    """Where a key stands in the order that samples are drawn in."""
    return xxhash.xxh3_64_intdigest(key.to_bytes(8, "little", signed=True))


def _merged(most: int):
    def run(batches):
        sample = _Sample(most)
        for batch in batches:
            view, y = (batch.column(k).to_numpy() for k in (0, 1))
            for v in (0, 1):
                for c in (0, 1):
                    at = pa.array((view == v) & (y == c))
                    sample.add(v, c, *(batch.column(k).filter(at).to_pylist() for k in (2, 3)))
        yield sample.batch()

    return run


def marked(unlabelled: DataFrame, weights: list, cal: list, given: list, most: int = MARKS_PER_CLASS) -> list[tuple[int, int, int, float]]:
    """(view, class, key, sureness): a sample of all rows that a view is sure about, without keys given to the other view before."""
    sent = unlabelled.sparkSession.sparkContext.broadcast((weights, cal, [set(g) for g in given]))

    def sure_ones(batches):
        weights, cal, given = sent.value
        sample = _Sample(most)
        for batch in batches:
            keys, margins = batch.column("key").to_pylist(), np.zeros((2, batch.num_rows))
            texts = batch.column("text")
            for i, meta in enumerate(zip(*(batch.column(c).to_pylist() for c in ("source", "lang", "n_chars")))):
                for v, (at, x) in enumerate((text_view(texts[i].as_py()), meta_view(*meta))):
                    s = x.astype(np.float32).astype(float) @ weights[v][at]
                    margins[v, i] = s[1] - s[0]
            for v in (0, 1):
                p = 1 / (1 + np.exp(-np.clip(cal[v][0] * margins[v] + cal[v][1], -30, 30)))
                for y, sure in ((1, p), (0, 1 - p)):
                    at = [i for i in np.flatnonzero(sure >= SURE) if keys[i] not in given[1 - v]]
                    sample.add(v, y, [keys[i] for i in at], sure[at].tolist())
        yield sample.batch()

    kind = "view int, y int, key long, sure double"
    rows = unlabelled.mapInArrow(sure_ones, kind).repartition(MERGERS).mapInArrow(_merged(most), kind).collect()
    last = _Sample(most)
    for r in rows:
        last.add(r["view"], r.y, [r.key], [r.sure])
    # Class 1 goes first where a key is on both lists.
    return [(v, y, key, sure) for (v, y), kept in sorted(last.kept.items(), key=lambda x: (x[0][0], -x[0][1])) for key, sure in kept.items()]


def _once(names: list[str]):
    """_views, for the first row of each key in a task."""
    views = _views(names)

    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            at = []
            for i, key in enumerate(batch.column("h").to_pylist()):
                if key not in seen:
                    seen.add(key)
                    at.append(i)
            if at:
                yield from views([batch.take(pa.array(at))])

    return run


def _unpacked(r) -> tuple:
    return tuple((np.frombuffer(r[f"at{v}"], np.int32), np.frombuffer(r[f"x{v}"], np.float32).astype(float)) for v in (0, 1))


NAMES = ["h", "y", "at0", "x0", "at1", "x1"]
VIEWED = "h long, y int, at0 binary, x0 binary, at1 binary, x1 binary"


def looked_up(unlabelled: DataFrame, keys: set[int]) -> dict[int, tuple]:
    """Both views of the documents with these keys."""
    if not keys:
        return {}
    wanted = unlabelled.sparkSession.createDataFrame([(k,) for k in sorted(keys)], "key long")
    rows = unlabelled.join(F.broadcast(wanted), "key").select(F.col("key").alias("h"), F.lit(0).alias("y"), "source", "lang", "n_chars", "text")
    return {r.h: _unpacked(r) for r in rows.mapInArrow(_once(NAMES), VIEWED).dropDuplicates(["h"]).collect()}


def left_out(marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which rows are fitted, and which calibrate: every fourth of a class, or all of it where there are fewer than four."""
    fitted, rest = np.ones(len(marks), bool), np.zeros(len(marks), bool)
    for y in (0, 1):
        mine = np.flatnonzero(marks == y)
        rest[mine[3::4] if len(mine) >= 4 else mine] = True
        fitted[mine[3::4]] = False
    return fitted, rest


def co_train(labelled: list, marks: np.ndarray, unlabelled: DataFrame | None, rounds: int = ROUNDS, most: int = MARKS_PER_CLASS):
    """Weights of both views, and (slope, offset) of each, from rows ((at, x), (at, x)) and their labels 0 or 1.

    unlabelled: key, source, lang, n_chars, text.
    """
    fitted, rest = left_out(marks)
    own = [[r[v] for r, into in zip(labelled, fitted) if into] for v in (0, 1)]
    own_y = marks[fitted].tolist()
    given: list[dict[int, int]] = [{}, {}]  # keys marked for each view, by the other one
    known: dict[int, tuple] = {}
    weights, cal = [None, None], [(1.0, 0.0)] * 2
    for turn in range(rounds + 1):
        for v in (0, 1):
            extra = sorted(given[v].items())
            model = SoftmaxFTRL(VIEWS[v], 2, alpha=0.5)
            weights[v] = model.fit(own[v] + [known[k][v] for k, _ in extra], own_y + [y for _, y in extra], epochs=3, seed=turn).weights()
            s = scores([r[v] for r, out in zip(labelled, rest) if out], weights[v])
            cal[v] = platt(s[:, 1] - s[:, 0], marks[rest])
        if turn == rounds or unlabelled is None:
            break
        for v, y, key, _ in marked(unlabelled, weights, cal, given, most):
            given[1 - v].setdefault(key, y)
        known |= looked_up(unlabelled, {k for g in given for k in g} - set(known))
    return weights, cal


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, marks_per_class: int = MARKS_PER_CLASS, id_col="doc_id", text_col="text"):
    """(weights of both views, their calibrations, prior logit), or None where labels of a class are missing."""
    known_labels = (
        labels.select(F.col("doc_id").cast("long").alias("of"), F.col("quality").cast("int").alias("y")).filter("of is not null and y in (0, 1)")
        .groupBy("of").agg(F.min("y").alias("y"), F.max("y").alias("y2")).filter("y = y2").drop("y2")
    )
    sizes = {r.y: r["n"] for r in known_labels.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if set(sizes) != {0, 1}:
        return None
    h = lambda c: F.pmod(F.xxhash64(c, F.lit("quality")), F.lit(1 << 30))
    share = F.when(F.col("y") == 1, min(1.0, 1.2 * per_class / sizes[1])).otherwise(min(1.0, 1.2 * per_class / sizes[0]))
    picked = known_labels.withColumn("lh", h("of")).filter(F.col("lh") < share * (1 << 30))  # about 2.4 * per_class rows, whatever the size
    rows = docs.select(*_sides(docs, id_col, text_col)).filter("doc_id is not null").withColumn("h", h("doc_id"))
    known = rows.join(F.broadcast(picked.drop("lh")), F.col("doc_id") == F.col("of")).select("h", "y", "source", "lang", "n_chars", "text")
    unlabelled = rows.join(F.broadcast(picked.select("of")), F.col("doc_id") == F.col("of"), "left_anti")
    unlabelled = unlabelled.select(F.xxhash64("text", "source", "lang", "n_chars").alias("key"), "source", "lang", "n_chars", "text")
    got = known.mapInArrow(_views(NAMES), VIEWED).collect()
    got.sort(key=lambda r: r.h)
    labelled, used = [], {0: 0, 1: 0}
    for r in got:
        if used[r.y] < per_class:
            used[r.y] += 1
            labelled.append((_unpacked(r), r.y))
    if not all(used.values()):
        return None
    # Both classes are spread evenly over the part that trains and the part that calibrates.
    labelled = [x for y in (0, 1) for x in labelled if x[1] == y]
    marks = np.array([y for _, y in labelled])
    weights, cal = co_train([x for x, _ in labelled], marks, unlabelled, most=marks_per_class)
    return weights, cal, float(np.log(used[1] / used[0]))


def score(docs: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text", cut: float = 0.5, **bounds) -> DataFrame:
    """All columns of docs in the struct `row`, and score (of good quality), text_score, meta_score, kept."""
    lean_batches(docs.sparkSession)
    model = fit(docs, labels, id_col=id_col, text_col=text_col, **bounds)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    sides = _sides(docs, id_col, text_col)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *sides[2:])

    def scored(batches):
        for batch in batches:
            n = batch.num_rows
            logits = np.zeros((n, 2))
            prior = 0.0
            if sent.value is not None:
                weights, cal, prior = sent.value
                columns = [batch.column(c).to_pylist() for c in ("source", "lang", "n_chars")]
                texts = pc.cast(pc.struct_field(batch.column("row"), text_col), pa.string())
                for i, (source, lang, size) in enumerate(zip(*columns)):
                    text = texts[i].as_py() or ""
                    for v, (at, x) in enumerate((text_view(text), meta_view(source, lang, size))):
                        s = x @ weights[v][at]
                        logits[i, v] = cal[v][0] * (s[1] - s[0]) + cal[v][1]
            p = 1 / (1 + np.exp(-np.clip(np.c_[logits, logits.sum(axis=1) - prior], -40, 40)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), *(pa.array(p[:, k]) for k in (2, 0, 1)), pa.array(p[:, 2] >= cut)], ["row", "score", "text_score", "meta_score", "kept"]
            )

    out = StructType([rows.schema["row"], *(StructField(c, DoubleType()) for c in ("score", "text_score", "meta_score")), StructField("kept", BooleanType())])
    return rows.mapInArrow(scored, out)


def keep_good(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows that are kept, with all their columns."""
    return score(docs, labels, **options).filter("kept").select("row.*")
