"""Near copies against all pairs, and components against union-find."""

import random

import numpy as np
import pytest

from ledgerweave.llm import common, components, near_dedup, queries
from ledgerweave.llm.common import Steps


def brute_set(text, k):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def brute(rows, k, percent=80):
    sets = [brute_set(t, k) for _, t in rows]
    parent = {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    by = {}
    for n, s in enumerate(sets):
        for g in s:
            by.setdefault(g, []).append(n)
    pairs = {(a, b) for m in by.values() for i, a in enumerate(m) for b in m[i + 1 :]} if max(map(len, by.values()), default=0) < 400 else {(a, b) for b in range(len(sets)) for a in range(b)}
    for a, b in pairs:
        both = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            x, y = find(rows[a][0]), find(rows[b][0])
            parent[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for (i, _), s in zip(rows, sets)}


def mutated(rng, words, share):
    return " ".join(rng.choice(words) + "x" if rng.random() < share else w for w in words)


@pytest.mark.parametrize("block", [512, 16])
def test_near_groups(spark, monkeypatch, block):
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    rng, rows = random.Random(7), []
    for g in range(12):
        base = [f"w{rng.randint(0, 400)}" for _ in range(rng.randint(3, 160))]
        rows += [(len(rows) + k * 7 % 5 + 1000 * g, mutated(rng, base, rng.choice([0, 0.01, 0.03, 0.05]))) for k in range(1, 3 + 6 * (g % 5))]
    rows = [(i, t) for i, (_, t) in enumerate(rows)]
    rng.shuffle(rows)
    rows += [(5001, ""), (5002, None), (5003, " \n"), (5004, "One two"), (5005, "one  TWO"), (5006, "one two three"), (5006, "one two three")]
    df = spark.createDataFrame([(i, t, "z") for i, t in rows], "doc_id long, text string, cid string").repartition(5)
    got = near_dedup.near_groups(df, 4).collect()
    want = brute(list(dict(rows).items()), 4)
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_shingles, r.component_id) == want[r.doc_id] and r.kept == (r.doc_id == r.component_id)


def test_odd_and_empty(spark, odd, none):
    got = near_dedup.near_groups(odd).collect()
    assert len(got) == 13 and all(r.kept and r.component_id is None for r in got if r.doc_id is None)
    assert near_dedup.drop_near_copies(odd).count() == 13
    assert near_dedup.near_groups(none).count() == 0


def test_query(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = brute(rows, 4)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in queries.op5_near_dedup(spark, sf).collect()} == want


def test_components(spark):
    rng = random.Random(1)
    links = [(k, k + 1) for k in range(60)] + [(rng.randint(100, 400), rng.randint(100, 400)) for _ in range(150)] + [(500, x) for x in range(501, 600)] + [(7, 7), (None, 3)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        if a is not None and a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent}


def test_minima_estimate():
    a = np.arange(1, 1001, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x, y = near_dedup.minima(np.unique(a[:900])), near_dedup.minima(np.unique(a[100:]))
    assert abs((x == y).mean() - 0.8) < 0.2


def test_small_tables_take_few_tasks(spark, sf):
    """The number of shuffle partitions is for large tables: the steps of a small one don't launch as many tasks each."""
    name, coalesce = "spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled"
    old = spark.conf.get(name)
    spark.conf.set(name, 64)
    spark.conf.set(coalesce, "false")
    spark.sparkContext.setJobGroup("near-tasks", "near-tasks")
    try:
        got = near_dedup.near_groups(spark.read.parquet(f"{sf}/documents.parquet"), 4).collect()
        tracker = spark.sparkContext.statusTracker()
        stages = {s for j in tracker.getJobIdsForGroup("near-tasks") for s in tracker.getJobInfo(j).stageIds}
        infos = [x for x in map(tracker.getStageInfo, stages) if x and x.numCompletedTasks]
        tasks = sum(x.numCompletedTasks for x in infos)
    finally:
        spark.conf.set(name, old)
        spark.conf.unset(coalesce)
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert 0 < tasks < 1750  # 2204 before


def test_rounds_of_components_write_few_files(spark):
    """Tables of a round are written by as many tasks as their rows are worth; many links still get several tasks."""
    name, coalesce = "spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled"
    old = spark.conf.get(name)
    spark.conf.set(name, 64)
    spark.conf.set(coalesce, "false")
    files = {}

    class Counted(Steps):
        def written(self, df, *more):
            out = super().written(df, *more)
            files.setdefault(more[0], []).append(len(out.inputFiles()))
            return out

    try:
        for n in (300, 6000):
            files.clear()
            links = spark.range(n).selectExpr("id a", "id + IF(id % 3 = 2, 0, 1) b")
            got = {r.node: r.component for r in components.components(links, Counted(spark, "few", tasks=8)).collect()}
            assert got == {x: x - x % 3 for x in range(n)}
            rounds = files["lowest"] + files["links"][1:]
            assert rounds and max(rounds) <= (1 if n == 300 else 8), files  # 8 before
            assert n == 300 or max(rounds) > 1, files
    finally:
        spark.conf.set(name, old)
        spark.conf.unset(coalesce)


def test_what_stays_of_a_small_table_has_few_tasks(spark, sf):
    """The rows that stay come in as many tasks as the table is worth, and are those of near_groups."""
    name, coalesce = "spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled"
    old, docs = spark.conf.get(name), spark.read.parquet(f"{sf}/documents.parquet")
    want = sorted(r.doc_id for r in near_dedup.near_groups(docs, 4).filter("kept").collect())
    spark.conf.set(name, 64)
    spark.conf.set(coalesce, "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = near_dedup.drop_near_copies(docs, 4)
        assert out.rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism  # 64 before
        assert sorted(r.doc_id for r in out.collect()) == want
    finally:
        spark.conf.set(name, old)
        for key in (coalesce, "spark.sql.autoBroadcastJoinThreshold"):
            spark.conf.unset(key)


def test_tables_of_steps_have_few_files(spark, sf, monkeypatch):
    """A table that is worth a task for each of 64 partitions is worked on by as many, but written in a quarter of the files; the result too.

    Only the two tables whose rows Python makes in the same tasks keep a file for each of them.
    """
    name, coalesce = "spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled"
    old, docs, files = spark.conf.get(name), spark.read.parquet(f"{sf}/documents.parquet"), {}
    want = sorted(map(tuple, near_dedup.near_groups(docs, 4).collect()))

    class Counted(Steps):
        def written(self, df, *more, **how):
            out = super().written(df, *more, **how)
            files.setdefault(more[0], []).append(len(out.inputFiles()))
            return out

    def counted(df, label, write=near_dedup.written):
        out = write(df, label)
        files.setdefault(label, []).append(len(out.inputFiles()))
        return out

    monkeypatch.setattr(common, "TASK_ROWS", 1)
    monkeypatch.setattr(near_dedup, "Steps", Counted)
    monkeypatch.setattr(near_dedup, "written", counted)
    spark.conf.set(name, 64)
    spark.conf.set(coalesce, "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = near_dedup.near_groups(docs.repartition(64), 4)
        most = max(spark.sparkContext.defaultParallelism, 16)
        assert max(max(x) for k, x in files.items() if k not in ("sets", "ties")) <= most, files  # 64 before
        assert out.rdd.getNumPartitions() <= most  # 64 before
        assert sorted(map(tuple, out.collect())) == want
        assert not {"links-1", "likely", "links-2"} & files.keys()  # each was written for one reader
    finally:
        spark.conf.set(name, old)
        for key in (coalesce, "spark.sql.autoBroadcastJoinThreshold"):
            spark.conf.unset(key)
