"""The Spark cascade against the sequential model on random batches, and hand-made cases."""

import datetime as dt
import random

import pytest
from model import Model
from pyspark.sql import functions as F

from ledgerweave.config import ReconcileConfig
from ledgerweave.functions.scalar import extract_utrs
from ledgerweave.operators.components import components
from ledgerweave.operators.tiers import EDGE, claim_in_order
from ledgerweave.plans.reconcile import reconcile

DAY0 = dt.date(2026, 4, 1)
SETTLED = "scope long, row_id string, row_seq long, net_paise long, settled_on date, settlement_id string, utr string"
BANK = "scope long, txn_id string, txn_seq long, value_date date, narration string, credit_paise long, debit_paise long"


def run(spark, scopes, config=ReconcileConfig()):
    """scopes: scope -> (rows, lines) in the model's form."""
    day = lambda n: DAY0 + dt.timedelta(days=n)
    rows = [(s, r["row_id"], k, r["net"], day(r["day"]), r["sid"], r["utr"]) for s, (rr, _) in scopes.items() for k, r in enumerate(rr)]
    lines = [(s, b["txn_id"], k, day(b["day"]), b["text"], b["credit"], b["debit"]) for s, (_, bb) in scopes.items() for k, b in enumerate(bb)]
    random.Random(0).shuffle(rows)
    got = reconcile(spark.createDataFrame(rows, SETTLED).repartition(3), spark.createDataFrame(lines, BANK).repartition(2), config)
    out = {(r.scope, r.txn_id): (r.tier, tuple(r.row_ids), r.delta_paise, r.confidence, r.exception_type) for r in got.results.collect()}
    claims = got.claims.collect()
    assert len({(c.scope, c.row_id) for c in claims}) == len(claims)
    assert len(out) == len(lines)
    return out


def line(txn, day, credit, text="NEFT RZP", utrs=(), debit=0):
    return {"txn_id": txn, "day": day, "credit": credit, "debit": debit, "text": " ".join([text, *utrs]), "utrs": list(utrs)}


def row(rid, day, net, sid=None, utr=None):
    return {"row_id": rid, "day": day, "net": net, "sid": sid, "utr": utr}


def random_scope(rng):
    rows, lines = [], []
    for b in range(rng.randint(2, 6)):
        day, n = rng.randint(0, 12), rng.randint(1, 7)
        named = rng.random() < 0.6
        utr = f"{100000000000 + (b if rng.random() < 0.85 else 0)}" if named else None
        mine = [row(f"r{b}_{k}", day, rng.choice([rng.randint(2000, 90000) * 7, 70000, 35000, -rng.randint(100, 3000)]), f"s{b}" if named else None, utr) for k in range(n)]
        rows += mine
        net = sum(r["net"] for r in mine)
        part = sum(r["net"] for r in rng.sample(mine, rng.randint(1, n)))
        for _ in range(rng.randint(0, 3)):
            credit = rng.choice([net, net, net + rng.choice([-900, 5, 1000, 1001]), part, net - mine[0]["net"], sum(r["net"] for r in mine[: n // 2])])
            refs = [utr] if utr and rng.random() < 0.6 else []
            lines.append(line(f"t{len(lines)}", day + rng.randint(-1, 4), credit, rng.choice(["NEFT RZP", "NEFT RZP", "direct"]), refs * rng.choice([1, 1, 1, 2])))
    lines.append(line("debit", 3, 0, "CHARGEBACK", debit=500))
    return rows, lines


def dense_scope(rng, days=40):
    """Something to pay every day, so that every line sees its neighbours' rows: whole days, days less a row, parts of batches, twins."""
    rows, lines = [], []
    for d in range(days):
        sid, utr = (f"s{d}", f"{200000000000 + d}") if d % 3 == 0 else (None, None)
        mine = [row(f"r{d}_{k}", d, rng.randint(2000, 90000) * 7, sid, utr) for k in range(rng.randint(2, 5))]
        rows += mine
        net, refs = sum(r["net"] for r in mine), [utr] if utr else []
        credits = [[net], [net - mine[0]["net"]], [mine[0]["net"], net - mine[0]["net"]], [net, net], [net + 500]][rng.randrange(5)]
        lines += [line(f"t{d}_{k}", d + rng.randint(0, 2), c, utrs=refs) for k, c in enumerate(credits)]
    return rows, lines


def chain_scope(parts=6):
    """A batch that is paid out row by row, each line fitting only once the one before it has taken its row; and equal days."""
    mine = batch(parts, sid="s", utr="300000000000", tag="c")
    rows = mine + [row(f"e{d}", 20 + d, 70000) for d in range(4)]
    lines = [line(f"p{k}", k % 3, r["net"], utrs=["300000000000"]) for k, r in enumerate(mine)]
    return rows, lines + [line(f"e{d}", 20 + d, 70000) for d in range(4)]


@pytest.mark.parametrize("adjudicated", [True, False])
def test_against_the_model(spark, adjudicated):
    config = ReconcileConfig(adjudicate=adjudicated, subset_safe_rows=6)
    scopes = {s: random_scope(random.Random(s)) for s in range(60 if adjudicated else 20)}
    scopes |= {100 + k: dense_scope(random.Random(k)) for k in range(3)} | {200: chain_scope()}
    got = run(spark, scopes, config)
    for s, (rows, lines) in scopes.items():
        want = Model(rows, lines, config).run()
        mine = {t: v for (k, t), v in got.items() if k == s}
        assert mine == want, (s, {t: (mine[t], want[t]) for t in want if mine[t] != want[t]})


def batch(n=6, day=0, sid="s", utr="123456789012", tag="p"):
    def net(k):
        gross = 100000 + 1000 * k
        fee = gross * 200 // 10000
        return gross - fee - fee * 18 // 100

    return [row(f"{tag}{k:02d}", day, net(k), sid, utr) for k in range(n)]


def test_named_cases(spark):
    total = lambda rows: sum(r["net"] for r in rows)
    six, pool, big = batch(), batch(sid=None, utr=None), batch(30, sid=None, utr=None)
    split = six[:3]
    twenty = batch(20)
    scopes = {
        1: (six, [line("a", 0, total(six), utrs=["123456789012"])]),
        2: (six, [line("a", 1, total(six))]),
        3: (pool, [line("a", 0, total(pool))]),
        4: (six, [line("a", 0, total(split), utrs=["123456789012"]), line("b", 1, total(six) - total(split), utrs=["123456789012"])]),
        5: (twenty, [line("a", 0, total(twenty)), line("b", 0, total(twenty))]),
        6: (six, [line("a", 0, 777, "direct transfer")]),
        7: (six, [line("a", 0, 0, "fee", debit=5000)]),
        8: (big, [line("a", 0, total(big[:14]))]),
        9: (six + batch(tag="q", sid="s2"), [line("a", 0, total(six), utrs=["123456789012"])]),
        10: (six, []),
        11: ([], [line("a", 0, 100)]),
    }
    got = run(spark, scopes)
    assert got[1, "a"][:2] == ("tier1_exact", tuple(r["row_id"] for r in six))
    assert got[2, "a"][0] == "tier2_fuzzy" and got[3, "a"][0] == "tier3_subset_sum"
    assert got[4, "a"][0] == got[4, "b"][0] == "tier3_subset_sum" and not set(got[4, "a"][1]) & set(got[4, "b"][1])
    assert got[5, "a"][0] == "tier2_fuzzy" and got[5, "b"][0] == "tier5_exception"
    assert got[6, "a"][4] == "orphan_credit" and got[7, "a"][4] == "chargeback_debit" and got[8, "a"][4] == "arithmetic_unsafe"
    assert got[9, "a"][0] != "tier1_exact" and got[11, "a"][4] == "missing_in_bank"


def test_claims_along_a_chain_and_in_cliques(spark):
    """A chain is replayed as one component in one go; a clique of lines with several options claims nothing; components equal a union-find."""
    edges = [(1, f"c{i}", i, f"b{j}", 1, 0, 0) for i in range(300) for j in (i - 1, i) if j >= 0]
    edges += [(2, f"q{i}", i, f"b{j}", 1, 0, 0) for i in range(9) for j in range(7)] + [(3, "twice", 0, "b", 2, 0, 0), (3, "later", 1, "b", 1, 0, 0)]
    df = spark.createDataFrame(edges, EDGE.rsplit(",", 1)[0])
    won = {(r.scope, r.txn_id, r.settlement_id) for r in claim_in_order(df).filter("wins").collect()}
    assert won == {(1, f"c{i}", f"b{i}") for i in range(300)} | {(3, "later", "b")}
    rng = random.Random(6)
    pairs = {(rng.randint(1, 3), rng.randint(0, 400), f"b{rng.randint(0, 420)}") for _ in range(450)}
    up = {}

    def top(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for s, i, b in pairs:
        up[top((s, b))] = top((s, i))
    least = {}
    for s, i, _ in pairs:
        least[top((s, i))] = min(least.get(top((s, i)), i), i)
    got = {(r.scope, r.txn_seq): r.component for r in components(spark.createDataFrame(list(pairs), "scope long, txn_seq long, settlement_id string")).collect()}
    assert got == {(s, i): least[top((s, i))] for s, i, _ in pairs}


def test_references(spark):
    texts = [("NEFT-123456789012-RAZORPAY",), ("RTGS 1234567890123456 RZP",), ("BRANCH 250001 ACCT 98765",), (None,)]
    got = [r[0] for r in spark.createDataFrame(texts, "t string").select(extract_utrs(F.col("t"))).collect()]
    assert got == [["123456789012"], ["1234567890123456"], [], []]


def test_settlement_view_is_read_from_the_line_items(spark, sf):
    """It outweighs them: it isn't written, and is only numbered, by a shuffle of all its rows, for queries that ask for row_seq."""
    from ledgerweave.plans import registry

    assert any("/lineitem.parquet" in f for f in registry.settlement_of(spark, sf).inputFiles())
    plan = registry.QUERIES["duplicate_utr_hits"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "row_number" not in plan
    first, again = (registry.settlement_of(spark, sf).select("scope", "row_id", "row_seq") for _ in range(2))
    assert first.exceptAll(again).isEmpty() and first.groupBy("scope", "row_id").count().filter("count > 1").isEmpty()


def test_first_of_two_lines_wins_in_many_components(spark):
    edges = spark.range(3000).selectExpr("id % 3 AS scope", "concat('t', id) AS txn_id", "id AS txn_seq", "concat('s', id div 6) AS settlement_id", "1L AS times", "0L AS delta", "0 AS lag")
    done = claim_in_order(edges)
    won = {(r.scope, r.txn_seq) for r in done.filter("wins").collect()}
    assert won == {(k % 3, k) for k in range(3000) if k % 6 < 3}


def test_replay_over_the_edges_of_its_parts():
    """A part ends inside a line and inside a component: both go on in the next part."""
    import pandas as pd

    from ledgerweave.operators.tiers import EDGES, _replayed

    lines = [(0, 1, 1, "a"), (0, 1, 2, "a"), (0, 1, 2, "b"), (0, 1, 3, "b"), (0, 1, 3, "c"), (0, 4, 4, "a"), (1, 1, 1, "a"), (1, 1, 2, "a"), (1, 1, 2, "d"), (1, 1, 2, "e")]
    edges = pd.DataFrame([dict(zip(EDGES, (s, f"t{q}", q, b, 1, 0, 0))) | {"component": c} for s, c, q, b in lines])
    for size in range(1, len(lines) + 1):
        parts = (edges[i : i + size].reset_index(drop=True) for i in range(0, len(lines), size))
        out = pd.concat(list(_replayed(parts)))
        assert len(out) == len(lines)
        assert {(r.scope, r.txn_seq, r.settlement_id) for r in out[out.wins].itertuples()} == {(0, 1, "a"), (0, 2, "b"), (0, 3, "c"), (0, 4, "a"), (1, 1, "a")}, size
