"""Scalar functions, arithmetic, drift, replies, audit and files on hand-made cases."""

import datetime as dt
import hashlib
import itertools
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerweave.functions import scalar as P
from ledgerweave.operators import adjudicate, arith, audit, drift, score
from ledgerweave.sources import files, tables


def column(spark, values, fn, kind="string"):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"k int, v {kind}").repartition(2)
    return [r[1] for r in sorted(df.select("k", fn(F.col("v"))).collect())]


def test_money(spark):
    cases = {
        "1234.35": 123435, "1,23,456.78": 12345678, "0.01": 1, "-45.60": -4560, "100": 10000, "100.5": 10050, "₹ 2,000.00": 200000, "": 0, "8.70": 870, "1.239": 123,
        ".5": 50, "-": 0, "nan": 0, "None": 0, "+7": 700, "abc": None, "1.2.3": None, "12a": None, "1 2": None,
    }
    assert column(spark, cases, P.to_paise) == list(cases.values())
    assert column(spark, [None], P.to_paise) == [0]
    assert column(spark, [12345678, 100, -4560, 0, 99, 10**11], P.format_inr, "long") == ["₹1,23,456.78", "₹1.00", "-₹45.60", "₹0.00", "₹0.99", "₹1,00,00,00,000.00"]
    df = spark.createDataFrame([("refund", 5000, 10, 1), ("payment", 100000, 2000, 360), ("adjustment", -5, 0, 0)], "k string, g long, f long, t long")
    assert [r[0] for r in df.select(P.net_paise(F.col("k"), F.col("g"), F.col("f"), F.col("t"))).collect()] == [-5000, 97640, -5]


def test_dates(spark):
    first = dt.date(2026, 4, 1)
    cases = {"2026-04-01": first, "01-04-2026": first, "01/04/2026": first, "2026/04/01": first, "01-Apr-2026": first, "1-APR-2026": first, "31-02-2026": None, "04/13/2026": dt.date(2026, 4, 13), "04/01/2026": dt.date(2026, 1, 4),
             "2026-004-1": None, "01-04-26": None, "": None, "  2026-4-1 ": first}
    assert column(spark, cases, P.parse_date) == list(cases.values())


def test_risk_and_reason(spark):
    df = spark.createDataFrame([(4525.0, 10**7), (2.0**28, 10**7), (1.0, 0)], "h double, s long")
    got = [r[0] for r in df.select(P.collision_risk(F.col("h"), F.col("s"))).collect()]
    assert got[0] < 1e-3 and got[1:] == [1.0, 1.0]
    df = spark.createDataFrame([(0.00001, 5), (0.0, -7), (0.0, 0)], "r double, d long")
    assert [r[0] for r in df.select(P.reason_text(F.lit("x"), F.col("r"), F.col("d"))).collect()] == ["x, collision risk 1.0e-05", "x, delta -7p", "x"]


def test_subsets():
    assert arith.subsets([7, 11, 0, -4], 14) == [(0, 1, 3)] and arith.subsets([7, 11], 12) == [] and arith.subsets([3], arith.MOST_TARGET + 3) == []
    rng = random.Random(1)
    for _ in range(200):
        a = [rng.choice([0, rng.randint(-50, 200)]) for _ in range(rng.randint(1, 9))]
        t = rng.randint(-20, 400)
        used = [i for i, x in enumerate(a) if x]
        ways = {c for k in range(1, len(used) + 1) for c in itertools.combinations(used, k) if sum(a[i] for i in c) == t} if t > 0 else set()
        got = arith.subsets(a, t)
        assert len(got) == min(2, len(ways)) and set(got) <= ways and len(set(got)) == len(got)


def brute_ways(amounts, target):
    """How many sets of non-zero amounts sum to target, by all their sums."""
    sums = np.zeros(1, np.int64)
    for x in amounts:
        sums = np.concatenate([sums, sums + x]) if x else sums
    return int((sums == target).sum()) - (target == 0)


def test_subset_ways(spark):
    from ledgerweave.operators import pools
    from ledgerweave.plans import registry

    rng = random.Random(3)
    made = {f"{n}_{k}": [rng.choice([0, -700, rng.randint(1, 900), rng.randint(1, 9000) * 100]) for _ in range(n)] for n in (1, 5, 13, 16, 20, 21) for k in range(4)}
    asked = [(p, a, sum(a[::2])) for p, a in made.items()]
    got = {r.pool: (r.n, r.ways, r.declined) for r in pools.subset_ways(spark.createDataFrame(asked, "pool string, amounts array<long>, target long"), 20).collect()}
    assert got == {p: (len(a), None, True) if len(a) > 20 or t <= 0 else (len(a), min(2, brute_ways(a, t)), False) for p, a, t in asked}
    rows, sf = {}, "/root/testdata/sf0.01"
    for r in registry.pool_rows(spark, sf).orderBy("pos").collect():
        rows.setdefault(r.pool, []).append(r.amount)
    want = {p: (len(a), None, True) if len(a) > 20 or sum(a[::2]) <= 0 else (len(a), min(2, brute_ways(a, sum(a[::2]))), False) for p, a in rows.items()}
    assert any(12 < n <= 20 and not d for n, _, d in want.values()) and any(d for *_, d in want.values())
    assert {r.pool: (r.n, r.ways, r.declined) for r in registry.QUERIES["subset_sum"](spark, sf).collect()} == want


def test_complement():
    """Nothing to drop, more than there is, and a pool too large for triples; other cases are held against all sets below."""
    assert arith.complement([4, 9], 13) == () and arith.complement([4, 9], 14) is None and arith.complement([], 5) is None
    large = np.arange(arith.MOST_TRIPLE + 1) * 1000 + 7
    assert arith.complement(large, int(large.sum()) - 21 - 6000) is None and arith.complement(large[:-1], int(large[:-1].sum()) - 21 - 6000) == (0, 1, 5)


def test_spurious(spark):
    rng = random.Random(4)
    rows = []
    for n in (12, 28):
        for k in range(20):
            a = [rng.randint(9900, 1500000) for _ in range(n)]
            rows.append((f"{n}_{k}", a, sum(a[: n // 2])))
    got = {r.n: r.spurious for r in score.spurious_match_rate(spark.createDataFrame(rows, "pool_id string, amounts array<long>, target long")).collect()}
    assert got[12] == 0 and got[28] >= 15


def test_spurious_all_sizes(spark):
    from ledgerweave.plans import registry

    rng = random.Random(5)
    made = [[rng.choice([0, -300, rng.randint(1, 50)]) * 100 for _ in range(n)] for n in (3, 8, 16) for _ in range(6)] + [[-1] * 16 + [16, 10**9], [1] * 41, [1] * 79]
    rows = [(str(k), a, sum(a[::2])) for k, a in enumerate(made)]
    want = {n: sum(brute_ways(a, t) > 1 for _, a, t in rows if len(a) == n) for n in (3, 8, 16, 18)}
    got = {r.n: r for r in score.spurious_match_rate(spark.createDataFrame(rows, "pool_id string, amounts array<long>, target long")).collect()}
    assert {n: got[n].spurious for n in want} == want and want[18] == 1 and all(got[n].evaluated == got[n].pools for n in want)
    assert (got[41].pools, got[41].evaluated, got[41].spurious, got[41].rate) == (1, 1, 1, 1.0)
    assert (got[79].pools, got[79].evaluated, got[79].spurious, got[79].rate) == (1, 0, None, None)

    sf = "/root/testdata/sf0.01"
    sizes = registry.settlement_of(spark, sf).groupBy("scope", "settled_on").count().groupBy("count").agg(F.count(F.lit(1))).collect()
    got = {r.n: r for r in registry.QUERIES["spurious_match_rate"](spark, sf).collect()}
    assert {n: r.pools for n, r in got.items()} == dict(map(tuple, sizes)) and max(got) > 24
    assert all(r.evaluated == r.pools for r in got.values())


def test_policy_and_replies(spark):
    c = spark.createDataFrame([(0, "tie", 1, 0, 0, 1), (0, "tie", 2, 0, 0, 1), (0, "win", 1, 0, 0, 1), (0, "win", 2, 90000, 0, 1), (0, "one", 1, 5, 1, 1)], "scope long, txn_id string, cand_no int, delta long, lag int, n_rows long")
    got = {r.txn_id: (r.cand_no, r.confidence) for r in adjudicate.rank_candidates(c).collect()}
    assert got == {"tie": (None, 0.0), "win": (1, 0.72), "one": (1, 0.80)}
    raw = {'{"candidate_id":"c1","confidence":5.0,"reason":"r"}': ("c1", 1.0, False), '{"candidate_id":"zz"}': (None, 0.0, True), '{"candidate_id":7}': (None, 0.0, True), '{"candidate_id":"c1","confidence":"very"}': ("c1", 0.0, False),
           "no json": (None, 0.0, True), '```json\n{"candidate_id":null}\n```': (None, 0.0, False), '{"candidate_id":"c1","confidence":-3}': ("c1", 0.0, False), "{}": (None, 0.0, False)}
    df = spark.createDataFrame([(k, v) for k, v in enumerate(raw)], "k int, raw string")
    got = adjudicate.validate_replies(df, F.array(F.lit("c1"), F.lit("c2"))).orderBy("k").collect()
    assert [(r.chosen, r.confidence, r.degraded) for r in got] == list(raw.values())
    assert got[7].reason == "no reason given"


def test_drift(spark):
    rows = [(0, "a", "payment", 1000000, 25000, 4500, "upi"), (0, "b", "payment", 1000000, 20000, 3600, "upi"), (0, "c", "refund", 1000000, 90000, 0, "upi"), (0, "d", "payment", 0, 90000, 0, "upi"), (0, "e", "payment", 1000000, 20000, 90000, "card")]
    df = spark.createDataFrame(rows, "scope long, row_id string, kind string, gross_paise long, fee_paise long, tax_paise long, method string")
    got = drift.detect_fee_drift(df).collect()
    assert [(r.row_id, r.excess_paise, r.effective_bps) for r in got] == [("a", 5900, 250)]
    assert tuple(drift.drift_summary(df).first()) == (3, 1, 5900)


def test_chain(spark, tmp_path):
    rows = [(c, s, "match", f"t{s}", json.dumps({"n": s}), "2026-01-01") for c in range(3) for s in range(1, 11)]
    entries = spark.createDataFrame(rows, "chain_id int, seq long, kind string, subject string, payload string, recorded_at string").repartition(4)
    chained = audit.chain_append(entries)
    previous = audit.GENESIS
    for r in chained.filter("chain_id = 1").orderBy("seq").collect():
        assert r.prev_hash == previous
        previous = hashlib.sha256("\u001f".join([previous, r.recorded_at, r.kind, r.subject, r.payload]).encode()).hexdigest()
        assert r.hash == previous
    assert audit.verify_chain(chained).count() == 0
    bad = chained.withColumn("payload", F.when((F.col("chain_id") == 2) & (F.col("seq") == 5), "{}").otherwise(F.col("payload")))
    assert [(r.chain_id, r.seq) for r in audit.verify_chain(bad).collect()] == [(2, 5)]
    tables.append_audit(chained.withColumn("run_id", F.lit("r")), str(tmp_path / "log"))
    assert tables.read_audit(spark, str(tmp_path / "log"), "r", 7).count() == 7 and tables.read_audit(spark, str(tmp_path / "log"), "other").count() == 0


def test_fingerprint(spark, tmp_path):
    for name, text in (("a", "one"), ("b", "two"), ("c", "one")):
        (tmp_path / name).write_text(text)
    of = lambda *names, v="": audit.fingerprint(spark, [str(tmp_path / n) for n in names], v).first()[0]
    assert of("a", "b") == of("b", "c") == of("b", "c", "absent") != of("a", "c") and of("a", v="x") != of("a", v="y")


def test_files(spark, tmp_path):
    (tmp_path / "settlement_report.csv").write_text(
        "row_id,kind,order_id,gross,fee,tax,settled_on,settlement_id,method,utr\n"
        'p1,payment,o1,"1,000.50",20.00,3.60,2026-04-01,s1,upi,123456789012\np2,refund,,100,,,01/04/2026,,,\n'
        "p3,payment,,not-a-number,0,0,2026-04-01,,,\np4,payment,,5,0,0,31-02-2026,,,\ntwo,columns\n,,,,,,,,,\n\np5,Payment,,5,0,0,2026-04-01,,,\np6,payment,,,0,0,2026-04-01,,,\np1,payment,,7,0,0,2026-04-01,,,\n"
    )
    (tmp_path / "bank_statement.csv").write_text('txn_id,value_date,narration,credit,debit\nb1,2026-04-01,"NEFT, RZP",10.00,0\nb2,2026-13-45,x,1,0\n,2026-04-01,x,1,0\nb4,2026-04-01,x,1,2\n')
    p = files.load_directory(spark, str(tmp_path))
    rows = {r.row_id: r for r in p.settlement.collect()}
    assert set(rows) == {"p1", "p2"} and rows["p1"].gross_paise == 100050 and rows["p1"].utr == "123456789012"
    assert (rows["p2"].net_paise, rows["p2"].method, rows["p2"].settlement_id, rows["p2"].settled_on) == (-10000, "unknown", None, dt.date(2026, 4, 1))
    assert [(r.txn_id, r.narration, r.credit_paise) for r in p.bank.collect()] == [("b1", "NEFT, RZP", 1000)]
    assert p.orders.count() == 0
    reasons = sorted((r.source, r.reason) for r in p.quarantine.collect())
    assert [r for s, r in reasons if s == "bank_statement"] == ["missing txn_id", "row has both credit and debit", "unparseable date: '2026-13-45'"]
    assert sorted(r for s, r in reasons if s == "settlement_report") == sorted(
        ["unparseable amount in gross: 'not-a-number'", "unparseable date: '31-02-2026'", "wrong column count", "wrong column count", "wrong column count", "'Payment' is not a valid kind", "unparseable amount: ''", "duplicate row_id"]
    )


def test_truth_and_round_trip(spark, tmp_path):
    doc = {"entries": [{"txn_id": "t", "scenario": "clean", "expected_row_ids": ["a", "b"], "expect_exception": None, "note": ""}], "fee_drift_row_ids": ["a"]}
    (tmp_path / "truth.json").write_text(json.dumps(doc, indent=1))
    assert tuple(files.read_truth(spark, str(tmp_path / "truth.json")).first())[:3] == ("t", "clean", ["a", "b"])
    df = spark.createDataFrame([("b1", dt.date(2026, 4, 1), 'a "quoted", text', 5, 0), ("b2", dt.date(2026, 4, 2), "x", -4560, 0)], "txn_id string, value_date date, narration string, credit_paise long, debit_paise long")
    files.write_bank_csv(df, str(tmp_path / "bank"))
    back = files.read_bank(spark, str(tmp_path / "bank"))[0]
    assert sorted((r.txn_id, r.credit_paise) for r in back.collect()) == [("b1", 5), ("b2", -4560)]


@pytest.mark.parametrize("name", ["to_paise", "tier1_exact", "fee_drift", "complement_2", "subset_sum_small", "chain_append"])
def test_some_queries_against_sql(spark, name):
    import duckdb

    from ledgerweave.plans import registry

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("lineitem", "orders", "documents"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    df = registry.QUERIES[name](spark, sf)
    want = con.execute(f"select {', '.join(df.columns)} from ({registry.ORACLES[name]})").fetchall()
    assert sorted(map(repr, map(tuple, df.collect()))) == sorted(map(repr, want))


def test_line_numbers(spark, tmp_path):
    """Positions in the file, the header being line 1; a record that equals the header counts as one."""
    header = ",".join(files.BANK)
    lines = [header, "a,2026-01-01,t,1.00,", "", header, "b,2026-01-01,t,2.00,", "c,2026-13-45,t,1.00,"]
    (tmp_path / "bank.csv").write_text("\n".join(lines) + "\n")
    good, bad = files.read_bank(spark, str(tmp_path / "bank.csv"))
    assert sorted((r.txn_seq, r.txn_id) for r in good.collect()) == [(2, "a"), (5, "b")]
    assert sorted((r.line_no, r.reason) for r in bad.collect()) == [(3, "wrong column count"), (4, "unparseable amount in credit: 'credit'"), (6, "unparseable date: '2026-13-45'")]
    many = [header] + [f"t{k:06d},2026-01-01,text of a line,{k}.00," for k in range(1, 30000)]
    (tmp_path / "many.csv").write_text("\n".join(many) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", 100_000)
    try:
        good, bad = files.read_bank(spark, str(tmp_path / "many.csv"))
        assert spark.read.text(str(tmp_path / "many.csv")).rdd.getNumPartitions() > 5 and bad.count() == 0
        assert {(r.txn_seq, r.txn_id) for r in good.select("txn_seq", "txn_id").collect()} == {(k + 1, f"t{k:06d}") for k in range(1, 30000)}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_runs(spark, tmp_path):
    """The second start of the same inputs gives the first run; a finished run has its summary."""
    path = str(tmp_path / "runs")
    assert tables.start_run(spark, path, "r1", "f", "{}", "t1") == "r1"
    assert tables.start_run(spark, path, "r2", "f", "{}", "t2") == "r1"
    assert tables.start_run(spark, path, "r3", "g", "{}", "t3") == "r3"
    tables.finish_run(path, "r1", spark.createDataFrame([(7, 5)], "bank_lines long, matched long"), "t4")
    got = {r.run_id: (r.finished_at, r.matched) for r in tables.runs(spark, path).collect()}
    assert got == {"r1": ("t4", 5), "r3": (None, None)}


def test_complement_against_all_sets():
    """The first single, else the pair whose later row comes first with its latest partner, else the first triple."""
    rng = random.Random(4)
    for _ in range(400):
        a = [rng.randint(-3, 9) for _ in range(rng.randint(1, 9))]
        target = sum(a) - rng.randint(-2, 20)
        gap, n = sum(a) - target, len(a)
        singles = [(i,) for i in range(n) if a[i] == gap]
        pairs = sorted(((j, -i) for j in range(n) for i in range(j) if a[i] + a[j] == gap))
        triples = [(i, j, k) for i in range(n) for j in range(i + 1, n) for k in range(j + 1, n) if a[i] + a[j] + a[k] == gap]
        want = None if gap < 0 else () if gap == 0 else singles[0] if singles else (-pairs[0][1], pairs[0][0]) if pairs else triples[0] if triples else None
        assert arith.complement(np.array(a), target) == want


def counted_ways(amounts, target):
    """How many sets of non-zero amounts sum to target, by counting the ways to every sum."""
    ways = {0: 1}
    for x in filter(None, amounts):
        more = dict(ways)
        for s, n in ways.items():
            more[s + x] = more.get(s + x, 0) + n
        ways = more
    return ways.get(target, 0) - (target == 0)


def large_pools(seed, sizes=(33, 44, 45, 64, 78)):
    """Pools of up to 64 payments and 14 refunds, with every kind of target: none, few and many sets, all rows, refunds alone."""
    rng = random.Random(seed)
    for n in sizes:
        for most in (3, 40, 900):
            for refunds in (max(0, n - 64), 14):
                unit = rng.choice([1, 100])
                a = [-unit * rng.randint(1, most) for _ in range(refunds)] + [unit * rng.choice([0] + [rng.randint(1, most)] * 9) for _ in range(n - refunds)]
                rng.shuffle(a)
                plus = [x for x in a if x > 0]
                for t in (sum(plus), sum(a), sum(a[::2]), sum(plus) - min(plus), sum(plus) + unit, unit + 1, 0, sum(a) - sum(plus), sum(a) - sum(plus) - unit):
                    yield a, t


def test_large_subsets():
    """Pools of more rows than can be listed, against the count of all ways."""
    for a, t in large_pools(6):
        want, got = counted_ways(a, t), arith.exact_sets(np.array(a), t)
        assert len(got) == min(2, want) and len(set(got)) == len(got)
        assert all(sum(a[i] for i in g) == t and all(a[i] for i in g) and list(g) == sorted(set(g)) for g in got)
    # The only set: powers of two; a second one: two equal rows of which one is used.
    a = [3 * 2**k for k in range(24)] + [0] * 20 + [10**8 + 1] * 20
    assert arith.exact_sets(np.array(a), 3 * (2**24 - 1)) == [tuple(range(24))]
    assert len(arith.exact_sets(np.array(a), 3 * 5 + 10**8 + 1)) == 2 and arith.exact_sets(np.array(a), 10) == []
    assert arith.subsets([1] * 65, 7) == [] and len(arith.subsets([1] * 64 + [-1] * 14, 7)) == 2


def test_sums_beyond_the_tables():
    """Sums that no table holds: few rows are listed, more can't be told."""
    few, more = np.arange(1, 45) * 10**9 + 1, np.arange(1, 46) * 10**9 + 1
    assert arith.decidable(few, 10**10) and not arith.decidable(more, 10**12) and arith.decidable(more // 10**9, 10**12)
    with pytest.raises(ValueError):
        arith.exact_sets(more, 10**12)


def test_solve_subset_sum(spark):
    """Pools beyond the row gate of the cascade; declined are too many payments or refunds, and targets beyond the bound."""
    from ledgerweave.operators import pools
    from ledgerweave.plans import registry

    made = [(str(k), a, t) for k, (a, t) in enumerate(large_pools(8, (20, 45, 78)))]
    far = [("more", [1] * 65, 7), ("back", [-1] * 15 + [30], 15), ("far", [10**8 + 1], 10**8 + 1), ("wide", [-(10**9)] * 2 + [5 * 10**8 + k for k in range(60)], 10**8)]
    got = {r.pool: (r.n, r.ways, r.declined) for r in pools.subset_ways(spark.createDataFrame(made + far, "pool string, amounts array<long>, target long"), 78).collect()}
    want = {p: (len(a), None, True) if t <= 0 or sum(x < 0 for x in a) > 14 else (len(a), min(2, counted_ways(a, t)), False) for p, a, t in made}
    assert got == want | {p: (len(a), None, True) for p, a, _ in far}

    sf = "/root/testdata/sf0.01"
    wide = {r.pool: r for r in registry.QUERIES["solve_subset_sum"](spark, sf).collect()}
    gated = {r.pool: r for r in registry.QUERIES["subset_sum"](spark, sf).collect()}
    assert set(wide) == set(gated) and all(wide[p].ways == r.ways for p, r in gated.items() if not r.declined)
    rows = {}
    for r in registry.pool_rows(spark, sf).orderBy("pos").collect():
        rows.setdefault(r.pool, []).append(r.amount)
    beyond = [(p, a) for p, a in rows.items() if 20 < len(a) <= 26]
    assert beyond and all(wide[p].declined if sum(a[::2]) <= 0 else wide[p].ways == min(2, brute_ways(a, sum(a[::2]))) for p, a in beyond)


def test_own_header_and_line_breaks(spark, tmp_path):
    """Each file of a folder has its own column order; fields in quotes go over line breaks, also where a block ends inside one."""
    import csv
    import io

    (tmp_path / "two").mkdir()
    (tmp_path / "two" / "a.csv").write_text("txn_id,value_date,narration,credit,debit\na,2026-01-01,x,7.00,\n")
    (tmp_path / "two" / "b.csv").write_text("txn_id,value_date,narration,debit,credit,more\nb,2026-01-01,x,,7.00,y\nc,2026-01-01,x,,7.00\n")
    good, bad = files.read_bank(spark, str(tmp_path / "two"))
    assert sorted((r.txn_id, r.credit_paise, r.debit_paise, r.txn_seq) for r in good.collect()) == [("a", 700, 0, 2), ("b", 700, 0, 4)]
    assert [(r.line_no, r.reason) for r in bad.collect()] == [(5, "wrong column count")]
    rng = random.Random(3)
    kinds = ["plain", 'quo"te', "with, comma", "line\nbreak", '"', '""\n', 'a"b\nc"d,e', "\n\n", "", "three\n\nlines\n"]
    rows = [[f"t{i}", "2026-01-01", rng.choice(kinds) + str(i % 7), "1.00", ""] for i in range(3000)]
    out = io.StringIO()
    writer = csv.writer(out, lineterminator="\n")
    writer.writerow(files.BANK)
    starts = []
    for r in rows:
        starts.append(out.getvalue().count("\n") + 1 if len(starts) < 50 else None)
        writer.writerow(r)
    out.write('s1,2026-01-01,stray " quote,2.00,\ns2,2026-01-01,"x"y"z,3.00,\n')
    (tmp_path / "breaks.csv").write_text(out.getvalue())
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", 9_000)
    try:
        good, bad = files.read_bank(spark, str(tmp_path / "breaks.csv"))
        got = {r.txn_id: (r.narration, r.txn_seq) for r in good.collect()}
        assert spark.read.text(str(tmp_path / "breaks.csv")).rdd.getNumPartitions() > 5 and bad.count() == 0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert {k: v[0] for k, v in got.items()} == {r[0]: r[2].strip(" ") for r in rows} | {"s1": 'stray " quote', "s2": 'xy"z'}
    assert [got[r[0]][1] for r in rows[:50]] == starts[:50]


def test_log_order_and_repeated_appends(spark, tmp_path):
    """Quarantined records by file and line, then results in statement order; an append that is repeated leaves each entry once."""
    kind = "scope long, txn_id string, tier string, row_ids array<string>, delta_paise long, confidence double, reason string, exception_type string, candidates_considered long"
    results = spark.createDataFrame([(s, t, "tier1_exact", ["r"], 0, 0.99, "x", None, 1) for s in (4, 5) for t in ("a10", "a2", "b1")], kind)
    bank = spark.createDataFrame([(s, t, k) for s in (4, 5) for k, t in enumerate(("b1", "a2", "a10"))], "scope long, txn_id string, txn_seq long")
    bad = spark.createDataFrame([(4, "orders", 3, "r", "x"), (4, "bank_statement", 10, "r", "x"), (4, "bank_statement", 2, "r", "x"), (5, "settlement_report", 9, "r", "x")], "scope long, source string, line_no long, raw string, reason string")
    log = audit.numbered(audit.audit_records(results, bank, bad))
    got = {s: [r.subject for r in log.filter(F.col("scope") == s).orderBy("seq").collect()] for s in (4, 5)}
    assert got == {4: ["bank_statement:2", "bank_statement:10", "orders:3", "b1", "a2", "a10"], 5: ["settlement_report:9", "b1", "a2", "a10"]}
    path = str(tmp_path / "log")
    for run in ("r1", "r2", "r1", "r1"):
        tables.append_audit(log.withColumn("run_id", F.lit(run)), path)
    assert tables.read_audit(spark, path, "r1").count() == tables.read_audit(spark, path, "r2").count() == 10


def test_directory(spark, tmp_path):
    """A second call of the same files finds the run; a run that was lost on its way is made again and replaces its parts; other settings have another fingerprint."""
    from ledgerweave.config import ReconcileConfig
    from ledgerweave.plans import directory

    src, store = tmp_path / "in", str(tmp_path / "store")
    src.mkdir()
    (src / "settlement_report.csv").write_text(
        "scope,row_id,kind,order_id,gross,fee,tax,settled_on,settlement_id,method,utr\n"
        "7,p1,payment,,100.00,2,0.36,2026-04-01,s1,upi,123456789012\n7,p2,payment,,50.00,9,0.18,2026-04-01,s1,upi,123456789012\n8,p1,payment,,10,0,0,2026-04-01,,,\n7,p1,payment,,1,0,0,2026-04-01,,,\n"
    )
    (src / "bank_statement.csv").write_text('txn_id,value_date,narration,credit,debit,scope\nb1,2026-04-01,"RZP\n123456789012",138.46,,7\nb1,2026-04-02,RZP,10,,8\nb2,2026-04-02,cash,3,,8\n')
    run = lambda run_id, at: directory.reconcile_directory(spark, str(src), store, run_id, at)
    # What a lost run leaves: it was started, and wrote a part.
    mark = audit.fingerprint(spark, [f"{src}/{n}" for n in files.FILES], json.dumps({**ReconcileConfig().__dict__, "scope": 0}, sort_keys=True)).first()[0]
    tables.start_run(spark, f"{store}/runs", "lost", mark, "{}", "t0")
    tables.write_part(spark.createDataFrame([(7, "zz")], "scope long, txn_id string"), f"{store}/results", "lost")
    assert run("first", "t1") == ("lost", True) and run("second", "t2") == ("lost", False)
    lines = {(r.scope, r.txn_id): (r.tier, r.position) for r in directory.read(spark, store, "results").collect()}
    assert lines == {(7, "b1"): ("tier1_exact", 1), (8, "b1"): ("tier3_subset_sum", 1), (8, "b2"): ("tier5_exception", 2)}
    log = directory.read(spark, store, "audit").orderBy("scope", "seq").collect()
    assert [(r.scope, r.seq, r.kind, r.subject) for r in log] == [(7, 1, "quarantine", "settlement_report:5"), (7, 2, "match", "b1"), (8, 1, "match", "b1"), (8, 2, "exception", "b2")]
    assert audit.verify_chain(directory.read(spark, store, "audit"), "scope").count() == 0
    assert directory.read(spark, store, "drift").select("row_id").collect()[0].row_id == "p2"
    assert tables.runs(spark, f"{store}/runs").select("run_id", "matched", "quarantined").collect()[0] == ("lost", 2, 1)
    other = audit.fingerprint(spark, [f"{src}/{n}" for n in files.FILES], json.dumps({**ReconcileConfig(adjudicate=False).__dict__, "scope": 0}, sort_keys=True)).first()[0]
    assert other != mark


def test_settlement_records_are_taken_apart_once(spark, tmp_path):
    """No field is cut out of its record again for a filter or a count, however many columns ask for it."""
    header = ",".join(files.SETTLEMENT)
    lines = ["a,payment,,10.00,0.20,0.03,2026-01-01,s,upi,u", 'b,payment,"x,y",10.00,0,0,2026-01-01,,,', "a,payment,,10.00,0,0,2026-01-01,,,", "c,payment,,1e5,0,0,2026-01-01,,,", "c,payment,,-0.50,0,0,01-02-2026,,,", "c,refund,,7.5,0,0,2026-02-31,,,", "c,refund,,7.5,0,0,2026-02-01,,,"]
    (tmp_path / "s.csv").write_text("\n".join([header, *lines]) + "\n")
    good, bad = files.read_settlement(spark, str(tmp_path / "s.csv"))
    rows = [(r.row_id, r.order_id, r.gross_paise, r.net_paise, str(r.settled_on), r.row_seq) for r in good.orderBy("row_seq").collect()]
    assert rows == [("a", None, 1000, 977, "2026-01-01", 2), ("b", "x,y", 1000, 1000, "2026-01-01", 3), ("c", None, -50, -50, "2026-02-01", 6)]
    assert [(r.line_no, r.reason, r.raw) for r in bad.orderBy("line_no").collect()] == [
        (4, "duplicate row_id", lines[2]), (5, "unparseable amount in gross: '1e5'", lines[3]), (7, "unparseable date: '2026-02-31'", lines[5]), (8, "duplicate row_id", lines[6]),
    ]
    for side in (good, bad):
        plan = side.groupBy().count()._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("regexp_extract_all") == 1, plan


def test_settlement_file_without_row_id_is_quarantined(spark, tmp_path):
    (tmp_path / "s.csv").write_text(",".join(files.SETTLEMENT[1:]) + "\n" + "payment,,10.00,0,0,2026-01-01,,,\n" * 2)
    good, bad = files.read_settlement(spark, str(tmp_path / "s.csv"))
    assert good.count() == 0 and [r.reason for r in bad.collect()] == ["missing row_id"] * 2
