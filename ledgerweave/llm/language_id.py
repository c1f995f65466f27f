"""Language identification: sparse softmax regression on TF-IDF of character n-grams.

Document frequencies are counted over all documents that may be learned from, with partial sums. The regression
(FTRL with elastic-net penalties) is fitted on the driver on a bounded sample: about `per_lang` documents for each
language, picked by a hash of their ids, whole texts each; a fifth of it is left out of the fit and sets the
temperature. Every language that occurs is learned. The weights are sent to all tasks, which score whole texts: at
most WEIGHTS numbers, since beyond 2^(23 - 15) languages the n-grams are hashed to fewer features.

Defined results: `und` with score 0 for a null text and a text without letters, or where nothing could be learned;
rows with a null id are never learned from and are not held out; rows whose lang is null are not learned from;
repeated rows get equal results; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean_batches
from .ftrl import SoftmaxFTRL, scores, softmax, temperature

#: Hashed features (a power of two), the lengths of the n-grams, and the bound on features x languages.
BITS, GRAMS, WEIGHTS = 15, (1, 2, 3), 1 << 23
#: Documents of each language in the sample.
PER_LANG = 700
HAS_LETTER = regex.compile(r"\p{L}").search
STEPS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


def feature_bits(languages: int) -> int:
    """Bits of the hashed features for so many languages."""
    return max(8, min(BITS, (WEIGHTS // max(languages, 1)).bit_length() - 1))


def gram_counts(text: str, bits: int = BITS) -> np.ndarray:
    """Counts of the hashed n-grams of a whole text, lower-cased, by code points."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    counts = np.zeros(1 << bits, np.int64)
    for n in GRAMS:
        if len(points) >= n:
            h = np.full(len(points) - n + 1, n, np.uint64)
            for k in range(n):
                h = (h + points[k : len(points) - n + 1 + k] + np.uint64(1)) * STEPS[k]
                h ^= h >> np.uint64(29)
            counts += np.bincount(((h * STEPS[0]) >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
    return counts


def weighted(at: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A row of unit length: (1 + log tf) * idf."""
    x = (1 + np.log(counts)) * idf[at]
    return at, x / max(np.sqrt(x @ x), 1e-12)


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def _document_frequency(bits: int):
    def run(batches):
        df, n = np.zeros(1 << bits, np.int64), 0
        for batch in batches:
            for text in batch.column("text"):
                df += gram_counts(text.as_py(), bits) > 0
                n += 1
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, at].astype(np.int32)), pa.array(np.r_[n, df[at]])], ["feature", "df"])

    return run


def _sample_rows(bits: int):
    def run(batches):
        for batch in batches:
            at, counts = [], []
            for text in batch.column("text"):
                c = gram_counts(text.as_py(), bits)
                i = np.flatnonzero(c)
                at.append(i.astype(np.int32).tobytes())
                counts.append(c[i].astype(np.int32).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("h"), batch.column("lang"), pa.array(at, pa.binary()), pa.array(counts, pa.binary())], ["h", "lang", "at", "counts"])

    return run


def fit(docs: DataFrame, per_lang: int = PER_LANG):
    """(langs, idf, weights, temperature) from docs (doc_id, text, lang) that may be learned from; None without any."""
    known = docs.filter(F.col("doc_id").isNotNull() & F.col("text").isNotNull() & F.col("lang").isNotNull())
    sizes = {r.lang: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return None
    langs = sorted(sizes)
    bits = feature_bits(len(langs))
    df = {r.feature: r["df"] for r in known.select("text").mapInArrow(_document_frequency(bits), "feature int, df long").groupBy("feature").agg(F.sum("df").alias("df")).collect()}
    total, frequency = df.pop(-1), np.zeros(1 << bits)
    frequency[list(df)] = list(df.values())
    idf = np.log((1 + total) / (1 + frequency)) + 1
    # A fifth more than wanted is asked for, so that chance rarely leaves a language short; the surplus is cut.
    shares = docs.sparkSession.createDataFrame([(g, min(1.0, 1.2 * per_lang / sizes[g])) for g in langs], "lang string, share double")
    h = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 30))
    picked = known.join(F.broadcast(shares), "lang").withColumn("h", h).filter(F.col("h") < F.col("share") * (1 << 30))
    by: dict[str, list] = {g: [] for g in langs}
    for r in sorted(picked.select("h", "lang", "text").mapInArrow(_sample_rows(bits), "h long, lang string, at binary, counts binary").collect(), key=lambda r: r.h):
        if len(by[r.lang]) < per_lang:
            by[r.lang].append(weighted(np.frombuffer(r["at"], np.int32), np.frombuffer(r["counts"], np.int32), idf))
    train = [(x, k) for k, g in enumerate(langs) for i, x in enumerate(by[g]) if i % 5]
    rest = [(x, k) for k, g in enumerate(langs) for i, x in enumerate(by[g]) if i % 5 == 0]
    train = train or rest
    weights = SoftmaxFTRL(1 << bits, len(langs)).fit([x for x, _ in train], [k for _, k in train]).weights()
    return langs, idf, weights, temperature(scores([x for x, _ in rest], weights), [k for _, k in rest])


def identify(docs: DataFrame, per_lang: int = PER_LANG, id_col="doc_id", text_col="text", lang_col="lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row; learned from rows that are not held out."""
    lean_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    rows = rows.withColumn("held_out", held_out())
    model = fit(rows.filter(~F.col("held_out")), per_lang)
    sent = docs.sparkSession.sparkContext.broadcast(model)  # WEIGHTS numbers at most

    def predicted(batches):
        langs, idf, weights, heat = sent.value or ([], None, None, 1.0)
        weights = None if weights is None else weights.astype(np.float32)
        bits = feature_bits(len(langs))
        for batch in batches:
            lang, score = [], []
            for text in batch.column("text").to_pylist():
                if not langs or text is None or not HAS_LETTER(text):
                    lang.append("und")
                    score.append(0.0)
                    continue
                counts = gram_counts(text, bits)
                at = np.flatnonzero(counts)
                at, x = weighted(at, counts[at], idf)
                p = softmax((x.astype(np.float32) @ weights[at]).astype(float) / heat)
                best = int(np.argmax(p))
                lang.append(langs[best])
                score.append(float(p[best]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return rows.select("doc_id", "held_out", "text").mapInArrow(predicted, "doc_id long, held_out boolean, lang_pred string, score double")
