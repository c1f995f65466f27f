"""Repeated passages against a dictionary of all strings."""

import hashlib
import random

import numpy as np
import pytest

from ledgerweave.llm import queries, substring_dedup


def brute(rows, length):
    seen, out = {}, []
    raws = [(i, (t or "").encode()) for i, t in rows]
    for _, raw in raws:
        for s in range(len(raw) - length + 1):
            seen[hash(raw[s : s + length])] = seen.get(hash(raw[s : s + length]), 0) + 1
    for i, raw in raws:
        gone = np.zeros(len(raw), bool)
        for s in range(len(raw) - length + 1):
            if seen[hash(raw[s : s + length])] > 1:
                gone[s : s + length] = True
        edge = np.flatnonzero(np.diff(np.r_[False, gone, False]))
        kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
        out.append((i, len(raw), int(gone.sum()), len(edge) // 2, kept))
    return sorted(out, key=repr)


def got(df):
    rows = df.collect()
    return sorted(((r.doc_id, r.n_bytes, sum(s.stop - s.start for s in r.spans), len(r.spans), bytes(r.kept)) for r in rows), key=repr)


@pytest.mark.parametrize("length,block", [(400, 8 << 20), (150, 3000), (64, 900)])
def test_planted_passages(spark, monkeypatch, length, block):
    monkeypatch.setattr(substring_dedup, "BLOCK_BYTES", block)
    rng = random.Random(length)
    text = lambda n: "".join(rng.choice("abcdefgh é") for _ in range(n))
    passages = [text(n) for n in (length - 3, length, length + 1, length + 40, 2 * length, 1700)]
    rows = [(k, "".join(rng.choice([text(rng.randint(0, 300)), rng.choice(passages)]) for _ in range(rng.randint(1, 6)))) for k in range(60)]
    rows += [(100, passages[4] * 3), (101, "z" * 1500), (102, "ab" * 700), (103, ""), (104, None), (105, rows[3][1]), (105, rows[3][1]), (None, text(900))]
    base = text(900)
    rows += [(200 + k, base[:300 + k] + text(3) + base[300 + k :]) for k in range(6)] + [(300, base[17:700]), (301, base[300:])]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, texts string").repartition(3)
    assert got(substring_dedup.repeated_spans(df, length)) == brute(rows, length)


def test_odd_and_empty(spark, odd, none):
    assert got(substring_dedup.repeated_spans(odd)) == brute([(r.doc_id, r.text) for r in odd.collect()], 400)
    assert substring_dedup.repeated_spans(none).count() == 0
    cut = substring_dedup.cut_passages(odd.filter("doc_id is not null and doc_id <> 7"))
    assert cut.columns == odd.columns and cut.filter("doc_id = 8").first().text == ""


@pytest.mark.parametrize("block", [4 << 20, 60_000])
def test_query(spark, sf, monkeypatch, block):
    monkeypatch.setattr(substring_dedup, "BLOCK_BYTES", block)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = [(*r[:4], hashlib.sha256(r[4]).hexdigest(), r[4].decode("utf-8", "ignore")) for r in brute(rows, 400)]
    assert sorted(map(tuple, queries.op8_substring_dedup(spark, sf).collect()), key=repr) == sorted(want, key=repr)


def test_cut_by_words(spark, sf):
    """Of the runs of 200 bytes and more, those of 50 words and more go, from every document of the table."""
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    seen = {}
    for _, text in rows:
        raw = text.encode()
        for s in range(len(raw) - 199):
            seen[hash(raw[s : s + 200])] = seen.get(hash(raw[s : s + 200]), 0) + 1
    want = {}
    for i, text in rows:
        raw = text.encode()
        gone = np.zeros(len(raw), bool)
        for s in range(len(raw) - 199):
            if seen[hash(raw[s : s + 200])] > 1:
                gone[s : s + 200] = True
        edge = np.flatnonzero(np.diff(np.r_[False, gone, False]))
        for lo, hi in zip(edge[::2], edge[1::2]):
            gone[lo:hi] = len(raw[lo:hi].split()) >= 50
        want[i] = np.frombuffer(raw, np.uint8)[~gone].tobytes().decode("utf-8", "ignore")
    got_ = {r.doc_id: r.text for r in substring_dedup.cut_passages(spark.read.parquet(f"{sf}/documents.parquet"), 200, 50).collect()}
    assert got_ == want and got_ != dict(rows)
