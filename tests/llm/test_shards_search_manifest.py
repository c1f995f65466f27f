"""Sharding, ranked lexical search and the manifest against plain loops, on odd rows and hot groups."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerweave.llm import lexical_search, manifest, sharding
from ledgerweave.llm.common import fresh

# ---- sharding


def check_shards(out, docs, shards):
    rows, places = out.collect(), defaultdict(list)
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in docs)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == want
    for r in rows:
        assert 0 <= r["shard"] < shards
        places[r["shard"]].append(r["position"])
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    return rows


def held(rows, shards):
    return [sum(r["size"] for r in rows if r["shard"] == s) for s in range(shards)]


def test_sharding_odd_and_empty(spark, odd, none):
    docs = [(r["doc_id"], r["text"]) for r in odd.collect()]
    check_shards(sharding.sharded(odd, shards=4, slots=64), docs, 4)
    assert sharding.sharded(none, shards=4, slots=64).count() == 0


def test_sharding_balances_bytes(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = check_shards(sharding.sharded(docs, shards=16), [tuple(r) for r in docs.select("doc_id", "text").collect()], 16)
    sizes = held(rows, 16)
    assert max(sizes) - min(sizes) < 0.1 * sum(sizes) / 16


def test_sharding_splits_an_id_of_a_third_of_all_rows(spark):
    docs = [(7 if i % 3 == 0 else i, f"text {i}" * 5) for i in range(6000)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    rows = check_shards(sharding.sharded(df, shards=8, slots=256), docs, 8)
    assert len({(r["slot"], r["part"]) for r in rows if r["doc_id"] == 7}) > 8
    sizes = held(rows, 8)
    assert max(sizes) < 1.02 * min(sizes)


def test_slot_map_versions(spark):
    df = spark.createDataFrame([(i, "x" * (i % 97)) for i in range(3000)], "doc_id long, text string")
    path, shards = fresh(spark, "map"), 5
    rows = sharding.slotted(df, 128).cache()
    loads = sharding.slot_loads(rows)
    assert sharding.first_map(spark, path, 128, shards) == 0 and sharding.rebalance(spark, path, loads, shards) == 1
    maps = [{r["slot"]: r["shard"] for r in sharding.read_map(spark, path, v).collect()} for v in (0, 1)]
    assert maps[0] == {s: s % shards for s in range(128)} and set(maps[1]) == set(range(128))
    size = {r["slot"]: r["bytes"] for r in loads.collect()}
    total = sum(size.values())

    def spread(m):
        return [sum(b for s, b in size.items() if m[s] == k) for k in range(max(m.values()) + 1)]

    assert max(spread(maps[1])) - min(spread(maps[1])) <= max(spread(maps[0])) - min(spread(maps[0]))
    # an even map stays as it is but for crumbs; a shard more takes slots only into itself
    sharding.rebalance(spark, path, loads, shards)
    again = {r["slot"]: r["shard"] for r in sharding.read_map(spark, path, 2).collect()}
    assert sum(size[s] for s in size if again[s] != maps[1][s]) < 0.05 * total
    assert sharding.rebalance(spark, path, loads, shards + 1, into=[shards]) == 3
    grown = {r["slot"]: r["shard"] for r in sharding.read_map(spark, path).collect()}
    assert all(grown[s] in (again[s], shards) for s in grown)
    assert abs(spread(grown)[shards] - total / (shards + 1)) < 0.1 * total / (shards + 1)
    with pytest.raises(Exception, match="(?i)exists"):
        sharding.moves(loads, sharding.read_map(spark, path), shards).write.parquet(f"{path}/version=1")
    rows.unpersist()


def test_sharding_main_path_is_native(spark, odd):
    plan = sharding.sharded(odd, shards=4, slots=64)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# ---- lexical search

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def plain_terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_search(docs, items, k):
    bags = [(i, Counter(plain_terms(t))) for i, t in docs]
    lengths = [sum(b.values()) for _, b in bags]
    n_docs, n_terms = sum(n > 0 for n in lengths), sum(lengths)
    df, out = Counter(t for _, b in bags for t in b), []
    for item, text in items:
        found = []
        for (i, bag), n in zip(bags, lengths):
            score = 0
            for t in plain_terms(text):
                if bag[t]:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    score += w * (1_000_000_000 * bag[t] // (1000 * bag[t] + 8 * (25 + 75 * n * n_docs // n_terms)))
            if score > 0:
                found.append((-score, i is None, i))
        for rank, (score, _, i) in enumerate(sorted(found, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1):
            out.append((item, rank, i, -score))
    return sorted(out, key=repr)


def test_search_against_loops(spark, sf, odd, none):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    docs = docs.unionByName(odd.select("doc_id", "text")).unionByName(docs.filter("doc_id < 5"))
    items = spark.read.parquet(f"{sf}/benchmark.parquet").limit(12).unionByName(
        spark.createDataFrame([(3, "same words, SAME words same"), (3, "same row"), (None, "word ÇA é"), (90, None), (91, "... !"), (92, "x" * 9000), (93, "日本語 test")], "item_id long, text string")
    )
    plain = [tuple(r) for r in docs.collect()], [tuple(r) for r in items.collect()]
    got = lexical_search.search(docs, items.selectExpr("*", "1 as query", "2 as score"), k=10)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain_search(*plain, 10)
    assert lexical_search.search(none, items).count() == 0 and lexical_search.search(docs, items.limit(0)).count() == 0
    assert [f.dataType.simpleString() for f in lexical_search.search(none, items).schema] == ["bigint", "int", "bigint", "bigint"]


def test_search_in_several_blocks_and_slices(spark, sf, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").repartition(3)
    items = spark.read.parquet(f"{sf}/benchmark.parquet").repartition(2)
    whole = sorted(map(tuple, lexical_search.search(docs, items).collect()))
    monkeypatch.setattr(lexical_search, "BLOCK_BYTES", 3000)
    monkeypatch.setattr(lexical_search, "PAIRED", 4)
    monkeypatch.setattr(lexical_search, "SLICE_BYTES", 1)
    assert sorted(map(tuple, lexical_search.search(docs, items).collect())) == whole


def test_dag_shares_sums(spark, sf):
    texts = [r["text"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    texts += [texts[0] + " " + texts[1], texts[0] + " one more", ""]
    counts = [Counter(lexical_search.terms(t.encode())) for t in texts]
    number = {t: i for i, t in enumerate(sorted(set().union(*counts)))}
    items = [{number[t]: c for t, c in item.items()} for item in counts]
    dag = lexical_search.Dag(items)
    values = np.random.default_rng(5).integers(0, 1000, (len(number), 7))
    want = np.array([sum((c * values[t] for t, c in item.items()), np.zeros(7, np.int64)) for item in items])
    leaves = np.array([values[t] * c for t, c in dag.leaves])
    assert np.array_equal(dag.scores(leaves), want)
    # the inner nodes and the roots take fewer additions than the items one by one
    adds = sum(len(n) for n, _, _ in dag.levels) + sum(max(0, len(r) - 1) for r in dag.roots)
    assert adds < 0.9 * sum(len(i) - 1 for i in items if i)


# ---- manifest


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(row):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def plain_tree(nodes, arity=2):
    """The root, and for each leaf its siblings from below and whether it comes first in its run."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for leaf, k in enumerate(at):
            run = nodes[k - k % arity : k - k % arity + arity]
            paths[leaf].append((k % arity == 0, "".join(x for j, x in enumerate(run) if j != k % arity)))
        nodes = [h(*nodes[k : k + arity]) for k in range(0, len(nodes), arity)]
        at = [k // arity for k in at]
    return nodes[0], paths


def plain_manifest(rows, change):
    trees, out = defaultdict(list), []
    for r in rows:
        trees[r[2]].append((r[0] is not None, r[0] or 0, plain_leaf(r), r))
    langs = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    built = [plain_tree([x[2] for x in sorted(trees[lang], key=lambda x: x[:3])]) for lang in langs]
    root, upper = plain_tree([b[0] for b in built])
    for lang, (subroot, paths), up in zip(langs, built, upper):
        for (_, _, leaf, row), path in zip(sorted(trees[lang], key=lambda x: x[:3]), paths):
            d = plain_leaf(change(row))
            for first, sibling in path + up:
                d = h(d, sibling) if first else h(sibling, d)
            out.append((row[0], leaf, subroot, root, h(*[s for _, s in path + up]), d, d == root))
    return sorted(out, key=repr)


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def both(spark, rows, **how):
    df = spark.createDataFrame(rows, SCHEMA)
    bad = F.col("doc_id") % 3 == 0
    altered = {"n_chars": F.when(bad, F.col("n_chars") + 1).otherwise(F.col("n_chars"))}
    got = manifest.manifest(df.selectExpr("*", "'a' as tree", "1 as at", "2 as leaf", "3 as path"), altered=altered)
    got = sorted((tuple(r) for r in got.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()), key=repr)
    want = plain_manifest(rows, lambda r: r if r[0] is None or r[0] % 3 or r[3] is None else (*r[:3], r[3] + 1, r[4]))
    assert got == want
    return got


def test_manifest_sizes(spark):
    sizes = [1, 2, 3, 5, 16, 17, 255, 257, 600]
    got = both(spark, [(i * 7 % n * 10 + k, f"s{i % 3}", f"lang {k}", i, f"text {i}") for k, n in enumerate(sizes) for i in range(n)])
    assert all(r[6] == (r[0] % 3 != 0) for r in got)
    both(spark, [(1, "s", "en", 3, "alone")])


def test_manifest_odd_rows(spark, none):
    rows = [(1, None, "en", None, None), (3, "s", None, None, "x"), (3, "s", None, 5, ""), (None, "s", "é", 2, "日本"), (None, "s", "z", 2, "y" * 50_000)]
    rows += [(9, "s", "en", 1, "same")] * 5 + [(8, "", "", 0, "1:a"), (8, "1:", "", 0, "a")] + [(i, "s", f"lang {i}", 1, "t") for i in range(300)]
    both(spark, rows)
    assert manifest.manifest(spark.createDataFrame([], SCHEMA)).count() == 0


def test_manifest_hot_id_and_many_passes(spark, monkeypatch):
    folded = manifest.folded
    monkeypatch.setattr(manifest, "folded", lambda nodes, tree, digest: folded(nodes, tree, digest, levels=2))
    both(spark, [(4 if i % 3 == 0 else i, "s", "en", 1, "same text" if i % 3 == 0 else f"t{i}") for i in range(900)])


def test_small_manifest_takes_few_tasks(spark, sf):
    """The number of shuffle partitions is for large tables: the steps of a small one don't write as many files each."""
    name, coalesce = "spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled"
    old, docs = spark.conf.get(name), spark.read.parquet(f"{sf}/documents.parquet")
    want = sorted(map(tuple, manifest.manifest(docs).drop("path").collect()))
    spark.conf.set(name, 64)
    spark.conf.set(coalesce, "false")
    spark.sparkContext.setJobGroup("manifest-tasks", "manifest-tasks")
    try:
        got = sorted(map(tuple, manifest.manifest(docs).drop("path").collect()))
        tracker = spark.sparkContext.statusTracker()
        stages = {s for j in tracker.getJobIdsForGroup("manifest-tasks") for s in tracker.getJobInfo(j).stageIds}
        tasks = sum(x.numCompletedTasks for x in map(tracker.getStageInfo, stages) if x)
    finally:
        spark.conf.set(name, old)
        spark.conf.unset(coalesce)
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert got == want and 0 < tasks < 400  # 530 before
