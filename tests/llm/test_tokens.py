"""Token counts, token files and packing against the tokenizers library, row by row."""

import functools
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from ledgerweave.llm import bpe, packing, queries, token_counts, token_files


@pytest.fixture(scope="module")
def word():
    return Tokenizer.from_file(P.path("word_bpe_49k.json"))


@pytest.fixture(scope="module")
def byte():
    return Tokenizer.from_file(P.path("byte_bpe_50k.json"))


def ids_of(t, text):
    return t.encode(text or "", add_special_tokens=False).ids


def key(rows):
    return sorted(rows, key=lambda r: tuple((x is not None, x) for x in r))


def test_counts_on_odd_rows(spark, odd, word, none):
    got = token_counts.count_tokens(odd, P.path("word_bpe_49k.json")).collect()
    want = [(r.doc_id, len((r.text or "").encode()), n := len(ids_of(word, r.text)), n > 2048) for r in odd.collect()]
    assert key(map(tuple, got)) == key(want)
    assert token_counts.count_tokens(none, P.path("word_bpe_49k.json")).count() == 0


def test_counts_on_documents(spark, sf, word):
    got = {r.doc_id: r.n_tokens for r in queries.op1_token_counts(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert got == {r.doc_id: len(ids_of(word, r.text)) for r in docs}


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=40))
def test_counts_on_any_text(text):
    path = P.path("word_bpe_49k.json")
    count = token_counts._counter(path, token_counts_whole())
    assert count(text) == len(tokenizer("word_bpe_49k.json").encode(text, add_special_tokens=False).ids)


@pytest.mark.parametrize("lo,hi", [(0x21, 0x7E), (0xA1, 0x24F), (0x3AC, 0x3CE), (0x430, 0x45F), (0x3041, 0x3096), (0x30A1, 0x30FA), (0x4E00, 0x9FFF), (0xAC00, 0xD7A3)])
def test_counts_in_every_script_of_the_shortcut(lo, hi):
    """Single characters of a script, and words mixed with Latin."""
    rng, count = random.Random(lo), token_counts._counter(P.path("word_bpe_49k.json"), token_counts_whole())
    texts = [chr(rng.randint(lo, hi)) for _ in range(500)]
    for _ in range(1500):
        texts.append("".join(chr(rng.randint(lo, hi)) if rng.random() < 0.8 else chr(rng.randint(0x21, 0x24F)) for _ in range(rng.randint(2, 8))))
    for text, coded in zip(texts, tokenizer("word_bpe_49k.json").encode_batch(texts, add_special_tokens=False)):
        assert count(text) == len(coded.ids), text


@functools.cache
def token_counts_whole():
    return token_counts.whole_tokens(P.path("word_bpe_49k.json"))


@functools.cache
def tokenizer(name):
    return Tokenizer.from_file(P.path(name))


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=40))
def test_byte_ids_on_any_text(text):
    byte = tokenizer("byte_bpe_50k.json")
    assert bpe.encode_ids(bpe.byte_level_encoding(P.path("byte_bpe_50k.json")), text).tolist() == ids_of(byte, text)


@pytest.mark.parametrize("kind", ["byte", "bit"])
def test_planes_round_trip(kind):
    rng = np.random.default_rng(1)
    for n in (1, 7, 1000, 2500):
        ids = rng.integers(0, 2**32, n, dtype=np.uint32)
        sizes, planes = token_files.pack_chunk(ids, kind, block=1000)
        assert (token_files.unpack_chunk(sizes, planes, n, kind, block=1000) == ids).all()


@pytest.mark.parametrize("kind", ["byte", "bit"])
def test_files_on_odd_rows(spark, odd, byte, none, kind):
    path = token_files.write_token_files(odd, P.path("byte_bpe_50k.json"), 2, kind=kind)
    got = sorted(token_files.read_token_files(spark, path).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted((r.doc_id for r in odd.collect()), key=lambda i: (i is not None, i))
    assert got[0].start == 0 and all(a.start + a.n_tokens == b.start for a, b in zip(got, got[1:]))
    want = [(r.doc_id, np.array([*ids_of(byte, r.text), 2], "<u4").tobytes()) for r in odd.collect()]
    assert key((r.doc_id, bytes(r.ids)) for r in got) == key(want)
    empty = token_files.write_token_files(none, P.path("byte_bpe_50k.json"), 2)
    assert token_files.read_token_files(spark, empty).count() == 0


def test_files_query(spark, sf, byte):
    got = {r.doc_id: r for r in queries.op3_token_files(spark, sf).collect()}
    at = 0
    for r in sorted(spark.read.parquet(f"{sf}/documents.parquet").collect(), key=lambda r: r.doc_id):
        ids = np.array([*ids_of(byte, r.text), 2], "<u4")
        assert tuple(got[r.doc_id]) == (r.doc_id, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_best_fit_is_the_tightest():
    rng = random.Random(3)
    for size in (7, 64, 100):
        lengths = [rng.randint(1, size) for _ in range(200)]
        rooms, want = [], {}
        for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
            fits = [(room, k) for k, room in enumerate(rooms) if room >= lengths[i]]
            best = min(fits)[0] if fits else size
            want.setdefault(best, 0)
            if fits:
                rooms[min(fits)[1]] -= lengths[i]
            else:
                rooms.append(size - lengths[i])
        fit, by = packing.BestFit(size), {}
        placed = [(*fit.place(n), n) for n in sorted(lengths, reverse=True)]
        assert fit.opened == max(s for s, _, _ in placed) + 1 == len(rooms)
        for s, o, n in placed:
            by.setdefault(s, []).append((o, n))
        for parts in by.values():
            at = 0
            for o, n in sorted(parts):
                assert o == at
                at += n
            assert at <= size


def check_pieces(rows, want, size=2048):
    docs, seqs = {}, {}
    for r in rows:
        docs.setdefault(r.doc_id, []).append(r)
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in seqs.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at and n > 0
            at += n
        assert at <= size
    for name, ids in want.items():
        at = 0
        for r in sorted(docs[name], key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids))
            assert bytes(r.ids) == np.array(ids[at : at + r.length], "<u4").tobytes()
            at += r.length
        assert at == len(ids)
    return len(seqs)


def test_packing(spark, sf, odd, none, byte):
    rows = packing.pack_documents(odd.filter("doc_id is not null and doc_id <> 7"), P.path("byte_bpe_50k.json")).collect()
    check_pieces(rows, {r.doc_id: [*ids_of(byte, r.text), 1] for r in odd.collect() if r.doc_id not in (None, 7)})
    assert packing.pack_documents(odd, P.path("byte_bpe_50k.json")).groupBy("doc_id").count().filter("doc_id = 7").first()["count"] == 2
    assert packing.pack_documents(none, P.path("byte_bpe_50k.json")).count() == 0
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = packing.pack_documents(docs, P.path("byte_bpe_50k.json")).collect()
    used = check_pieces(rows, want := {r.doc_id: [*ids_of(byte, r.text), 1] for r in docs.collect()})
    # Little padding: each of the tasks may leave a few sequences partly filled.
    assert used <= -(-sum(map(len, want.values())) // 2048) + 2 * 8


def test_equal_rows_are_dealt_evenly(spark, byte):
    """A third of all rows may be one row: its copies go to all tasks, each packed on its own."""
    same, n = "one row again and again " * 40, len(ids_of(byte, "one row again and again " * 40)) + 1
    docs = spark.createDataFrame([(None, same)] * 400 + [(k, "short") for k in range(800)], "doc_id long, text string").repartition(2)
    rows = packing.pack_documents(docs, P.path("byte_bpe_50k.json")).filter("doc_id is null").collect()
    assert len(rows) == 400 and {r.length for r in rows} == {n}
    by = [r.sequence_id >> 32 for r in rows]
    assert len(set(by)) == 8 and max(map(by.count, set(by))) < 120
