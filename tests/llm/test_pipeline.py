"""Every stage of the pipeline against brute force on its own input, odd rows included."""

import corpus_pipeline
import public_tokenizers as P
from pyspark.sql import functions as F
from test_exact_words_topk import BLANKS
from test_near import brute as near_brute
from test_tokens import check_pieces, ids_of
from tokenizers import Tokenizer

from ledgerweave.llm import quality

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def with_odd_rows(spark, sf):
    """The documents of a directory, null and empty texts, repeated rows, null ids and metadata."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang", "source", F.col("n_chars").cast("long"))
    long = " ".join(f"word{k % 700}" for k in range(9000))
    odd = [
        (10**6, None, "en", "s", 0), (10**6 + 1, "", None, None, None), (10**6 + 2, long, "en", "s", len(long)), (10**6 + 3, "A short one.", "en", "s", 12),
        (10**6 + 3, "A short one.", "en", "s", 12), (None, "No id here, and nothing like it anywhere.", "en", "s", 41),
    ]
    return docs.unionByName(spark.createDataFrame(odd, COLUMNS))


def test_stages(spark, sf):
    docs, labels = with_odd_rows(spark, sf).cache(), spark.read.parquet(f"{sf}/labels.parquet")
    stages = dict(corpus_pipeline.STAGES)
    rows = lambda df: [(r.doc_id, r.text) for r in df.collect()]

    kept = stages["quality classifier"](spark, docs, sf).cache()
    assert kept.columns == docs.columns
    want = [(r.doc_id, r.text) for r in quality.score(docs, labels).select("row.*", "score").collect() if r.score >= 0.5]
    assert sorted(map(repr, rows(kept))) == sorted(map(repr, want)) and len(want) > 0.5 * docs.count()

    once = stages["exact dedup"](spark, kept, sf).cache()
    best = {}
    for i, t in rows(kept):
        norm, rank = (t or "").translate(BLANKS), (-len(t or ""), i is None, i or 0)
        best[norm] = min(best.get(norm, (rank, i, t)), (rank, i, t), key=lambda x: x[0])
    assert sorted(map(repr, rows(once))) == sorted(repr((i, t)) for _, i, t in best.values())

    apart = stages["near dedup"](spark, once, sf).cache()
    named = [(i, t) for i, t in rows(once) if i is not None]
    component = near_brute(named, 5)
    want = [(i, t) for i, t in rows(once) if i is None or component[i][1] == i]
    assert sorted(map(repr, rows(apart))) == sorted(map(repr, want))

    cut = stages["suffix-array dedup"](spark, apart, sf).cache()
    assert cut.columns == docs.columns and cut.count() == apart.count()
    before = rows(apart)
    want = []
    for (i, t), (spans, raw) in zip(before, repeated(before, 200)):
        long = [(lo, hi) for lo, hi in spans if len(raw[lo:hi].split()) >= 50]
        left = b"".join(raw[a:b] for a, b in zip([0, *(hi for _, hi in long)], [*(lo for lo, _ in long), len(raw)]))
        want.append((i, left.decode("utf-8", "ignore")))
    assert sorted(map(repr, rows(cut))) == sorted(map(repr, want))
    assert all(r.n_chars == len(r.text) for r in cut.collect())
    # No passage of 51 words stands in two documents any more.
    seen = {}
    for i, t in rows(cut):
        words = t.split()
        for k in range(len(words) - 50):
            assert seen.setdefault(" ".join(words[k : k + 51]), i) == i

    byte = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    pieces = stages["packing"](spark, cut, sf).collect()
    ids = {i: [*ids_of(byte, t), 1] for i, t in rows(cut)}
    crc = [type("Piece", (), {**r.asDict(), "ids": b"".join(x.to_bytes(4, "little") for x in ids[r.doc_id][r.start : r.start + r.length])}) for r in pieces]
    check_pieces(crc, ids)


def repeated(rows, length):
    """For each text: its maximal runs of bytes that strings of `length` bytes repeat, and its bytes."""
    seen = {}
    raws = [(t or "").encode() for _, t in rows]
    for raw in raws:
        for s in range(len(raw) - length + 1):
            h = hash(raw[s : s + length])
            seen[h] = seen.get(h, 0) + 1
    for raw in raws:
        spans = []
        for s in range(len(raw) - length + 1):
            if seen[hash(raw[s : s + length])] > 1:
                if spans and s <= spans[-1][1]:
                    spans[-1] = (spans[-1][0], s + length)
                else:
                    spans.append((s, s + length))
        yield spans, raw


def test_empty_and_clashing(spark, sf):
    """No rows; then columns that are named like those that the stages use inside."""
    names = ["key", "cid", "block", "salt", "row", "norm", "h", "y", "x0", "spans", "kept", "_kept_id", "component_id", "bucket"]
    none = spark.createDataFrame([], COLUMNS)
    few = with_odd_rows(spark, sf).limit(60).select("*", *(F.lit(k).alias(c) for k, c in enumerate(names)))
    for docs in (none, few):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, sf)
            if name != "packing":
                assert out.columns == docs.columns, name
            docs = out.cache()
        assert docs.count() >= 0


def test_run(spark, sf):
    """The whole run packs all tokens of its documents, each once."""
    total = {}
    for r in corpus_pipeline.run(spark, sf).collect():
        have, all_ = total.get(r.doc_id, (0, r.doc_tokens))
        total[r.doc_id] = have + r.length, all_
    assert len(total) > 50 and all(a == b for a, b in total.values())
