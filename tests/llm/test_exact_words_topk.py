"""Exact copies, word BPE and exact search against brute force."""

import hashlib
import math

import duckdb
import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F

from ledgerweave.llm import bpe, exact_dedup, queries, top_k, words_bpe
from ledgerweave.llm.common import written

BLANKS = dict.fromkeys(map(ord, " \t\n\x0b\x0c\r"))


def brute_copies(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault((t or "").translate(BLANKS), []).append((i, t or ""))
    out = []
    for norm, members in groups.items():
        members.sort(key=lambda m: (-len(m[1]), m[0] is None, m[0] or 0))
        sha = hashlib.sha256(norm.encode()).hexdigest()
        out += [(i, members[0][0], len(members), k == 0, sha) for k, (i, _) in enumerate(members)]
    return sorted(out, key=repr)


def test_copies(spark, odd, none, monkeypatch):
    more = [(100 + k, "a b" if k % 3 else "ab ") for k in range(400)] + [(99, "a b ")] * 40 + [(None, "q")] * 70 + [(900, None), (901, " \t"), (902, "Ab")]
    both = odd.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    for rows in (128, 20):  # without and with hot texts split
        monkeypatch.setattr(exact_dedup, "HOT_ROWS", rows)
        got = exact_dedup.exact_groups(both).collect()
        assert sorted(map(tuple, got), key=repr) == brute_copies([(r.doc_id, r.text) for r in both.collect()])
    kept = exact_dedup.drop_copies(odd)
    assert kept.columns == odd.columns and kept.count() == 10  # 2, 3 and the null id fall together, so do both rows of 7
    assert exact_dedup.exact_groups(none).count() == 0


def test_copies_oracle(spark, sf):
    got = queries.op2_exact_dedup(spark, sf)
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    want = con.execute(exact_dedup.ORACLE).fetchall()
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)


@pytest.mark.parametrize("block", [8 << 20, 30_000])
def test_words(spark, sf, odd, none, monkeypatch, block):
    monkeypatch.setattr(words_bpe, "BLOCK_BYTES", block)
    path = P.path("byte_bpe_multi_50k.tiktoken")
    e = tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    for docs in (odd, spark.read.parquet(f"{sf}/documents.parquet").coalesce(2)):
        got = words_bpe.decode(words_bpe.encode(docs, path), path).collect()
        want = [(r.doc_id, len(x := e.encode_ordinary(r.text or "")), np.array(x, "<u4").tobytes(), (r.text or "").encode()) for r in docs.collect()]
        assert sorted(map(repr, want)) == sorted(repr((r.doc_id, r.n_tokens, bytes(r.ids), bytes(r.decoded))) for r in got)
    assert words_bpe.decode(words_bpe.encode(none, path), path).count() == 0


def brute_top(rows, k):
    sound = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for at, (i, q) in enumerate(sound):
        if i % 100 == 0:
            scored = sorted((-sum(a * b for a, b in zip(q, v)), j) for other, (j, v) in enumerate(sound) if other != at and len(v) == len(q))
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scored[:k])]
    return sorted(out)


def test_top_k(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(0, 0.2, 8).tolist()) for i in range(600)] + [(1000 + i, [0.5] * 8) for i in range(60)]
    rows += [(700, None), (701, [None] * 8), (702, [float("nan")] * 8), (None, [1.0] * 8), (703, []), (704, []), (800, []), (900, [1e30] * 3), (901, [-1e30] * 3), (5, [9.0] * 8), (100, [7.0] * 8), (100, [7.0] * 8), (0, [-3.0] * 8)]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, score string")
    got = sorted(map(tuple, top_k.exact_top_k(df, F.col("id") % 100 == 0, k=10).collect()))
    want = [(q, r, j, max(-(2**63), min(2**63 - 1, s))) for q, r, j, s in brute_top(rows, 10)]
    assert got == want
    assert top_k.exact_top_k(df.limit(0), F.col("id") % 100 == 0).count() == 0


def test_pivots_eliminate(spark):
    """On vectors in groups the bounds leave few candidates to evaluate, and no cap is below a true product."""
    rng = np.random.default_rng(8)
    centres = rng.normal(0, 600, (60, 24))
    rows = np.floor(centres[rng.integers(0, 60, 3000)] + rng.normal(0, 20, (3000, 24)))
    for data, most in ((rows, 0.25), (np.floor(rng.normal(0, 1e8, (900, 5))), 1.0)):
        pivots = top_k.spread_apart(data[:1500], 128)
        table = top_k._distances(data, pivots)
        norms = table[:, 0] ** 2
        best = top_k.Best(np.arange(40), np.arange(40), data[:40], norms[:40], table[:40], 10)
        assert (best.caps(norms, table) >= (data[:40].astype(np.int64) @ data.T.astype(np.int64))).all()
        for at in range(0, len(data), 1024):
            part = slice(at, at + 1024)
            best.meet(np.arange(len(data))[part], np.arange(len(data))[part], data[part], norms[part], table[part])
        assert best.evaluated <= most * 40 * len(data)
        for q, (scores, names) in enumerate(best.found):
            want = sorted((-int(s), j) for j, s in enumerate(data.astype(np.int64) @ data[q].astype(np.int64)) if j != q)[:10]
            assert list(zip(-scores, names)) == want
    assert len(top_k.spread_apart(np.ones((9, 3)), 5)) == 1 and len(top_k.spread_apart(np.empty((0, 3)), 5)) == 0


def test_top_k_query(spark, sf):
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{sf}/embeddings.parquet'")
    assert sorted(map(tuple, queries.op10_top_k(spark, sf).collect())) == sorted(con.execute(top_k.ORACLE).fetchall())


def test_small_tables_write_few_files(spark, sf, monkeypatch):
    """The ranges of a small table are written by as many tasks as its rows are worth, not by one for each range."""
    name, coalesce = "spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled"
    old, files = spark.conf.get(name), []

    def counted(df, *more):
        out = written(df, *more)
        files.append(len(out.inputFiles()))
        return out

    monkeypatch.setattr(exact_dedup, "written", counted)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = sorted(map(repr, exact_dedup.exact_groups(docs).collect()))
    spark.conf.set(name, 64)
    spark.conf.set(coalesce, "false")
    files.clear()
    try:
        assert sorted(map(repr, exact_dedup.exact_groups(docs).collect())) == want
    finally:
        spark.conf.set(name, old)
        spark.conf.unset(coalesce)
    assert files and max(files) <= spark.sparkContext.defaultParallelism  # 64 before
