"""Settlement, bank, truth, candidate, reply and audit views derived from the star-schema tables, for queries, tests and bench.

The texts are shared by Spark and DuckDB; only the calls that differ are filled in by dialect.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerweave.storage import cut

SPARK = {
    "div": lambda a, b: f"(({a}) div ({b}))", "days": lambda a, b: f"datediff({a}, {b})", "plus": lambda d, n: f"date_add({d}, {n})",
    "lower_list": lambda x: f"array_sort({x})", "agg_list": lambda x: f"array_join(array_sort(collect_list({x})), '|')",
    "explode": lambda items: f"explode(array({items}))",
}
DUCK = {
    "div": lambda a, b: f"(({a}) // ({b}))", "days": lambda a, b: f"date_diff('day', {b}, {a})", "plus": lambda d, n: f"CAST({d} + ({n}) AS DATE)",
    "lower_list": lambda x: f"list_sort({x})", "agg_list": lambda x: f"string_agg({x}, '|' ORDER BY {x})",
    "explode": lambda items: f"unnest([{items}])",
}
EPOCH = "DATE '1995-01-01'"


def settlement(d: dict) -> str:
    div = d["div"]
    return f"""
settlement_0 AS (SELECT {div('l_suppkey', 100)} AS scope, l_orderkey AS ok, l_linenumber AS ln,
    concat('pay_', l_orderkey, '_', l_linenumber, '_', l_partkey, '_', l_suppkey, '_', {d['days']("CAST(l_shipdate AS DATE)", EPOCH)}, '_', CAST(round(l_extendedprice * 100) AS BIGINT)) AS row_id,
    CASE WHEN (l_orderkey * 7 + l_linenumber) % 37 = 0 THEN 'refund' WHEN (l_orderkey * 7 + l_linenumber) % 101 = 0 THEN 'adjustment' ELSE 'payment' END AS kind,
    CAST(l_orderkey AS VARCHAR(20)) AS order_id, {div('CAST(round(l_extendedprice * 100) AS BIGINT)', 10)} AS gross_paise,
    {d['plus']('CAST(l_shipdate AS DATE)', 2)} AS settled_on FROM lineitem),
settlement_1 AS (SELECT *, {d['days']('settled_on', EPOCH)} AS day, ({d['days']('settled_on', EPOCH)} + 3 * scope) % 20 AS scenario,
    {div('(' + d['days']('settled_on', EPOCH) + ' + 3 * scope)', 20)} AS wave FROM settlement_0),
settlement_2 AS (SELECT *, CASE WHEN kind = 'payment' THEN {div('gross_paise * (CASE WHEN scenario = 8 THEN 240 ELSE 200 END)', 10000)} ELSE 0 END AS fee_paise FROM settlement_1),
settlement_3 AS (SELECT scope, row_id, kind, order_id, gross_paise, fee_paise, {div('fee_paise * 1800', 10000)} AS tax_paise, settled_on, day, scenario, wave,
    CASE WHEN scenario IN (11, 12, 18) THEN NULL ELSE concat('setl_', scope, '_', day) END AS settlement_id,
    CASE ln % 4 WHEN 0 THEN 'upi' WHEN 1 THEN 'card' WHEN 2 THEN 'netbanking' ELSE 'wallet' END AS method,
    CASE WHEN scenario IN (11, 12, 18) THEN NULL ELSE CAST(100000000000 + scope * 1000000 + (CASE WHEN scenario = 16 THEN day - 1 ELSE day END) AS VARCHAR(20)) END AS utr FROM settlement_2),
settlement_4 AS (SELECT *, CASE WHEN kind = 'refund' THEN -abs(gross_paise) ELSE gross_paise - fee_paise - tax_paise END AS net_paise FROM settlement_3),
batch_v AS (SELECT scope, day, settled_on, scenario, wave, CAST(sum(net_paise) AS BIGINT) AS net, count(*) AS n,
    min(CASE WHEN kind = 'payment' THEN row_id END) AS first_payment FROM settlement_4 GROUP BY scope, day, settled_on, scenario, wave),
settlement_v AS (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY row_id) AS row_seq FROM (
    SELECT scope, row_id, kind, order_id, gross_paise, fee_paise, tax_paise, net_paise, settled_on, settlement_id, method, utr FROM settlement_4
    UNION ALL SELECT scope, concat('twin_', scope, '_', day), 'adjustment', NULL, net, 0, 0, net,
        {d['plus']('settled_on', "CASE WHEN wave % 2 = 0 THEN 1 ELSE 2 END")}, NULL, 'unknown', NULL FROM batch_v WHERE scenario = 18 AND net > 0))"""


def bank(d: dict) -> str:
    ref = "CAST(100000000000 + scope * 1000000 + (CASE WHEN scenario = 16 THEN day - 1 ELSE day END) AS VARCHAR(20))"
    return f"""
half_v AS (SELECT s.scope, s.day, sum(CASE WHEN place <= {d['div']('n', 2)} THEN net_paise ELSE 0 END) AS first_half FROM (
    SELECT scope, day, net_paise, row_number() OVER (PARTITION BY scope, day ORDER BY row_id) AS place, count(*) OVER (PARTITION BY scope, day) AS n
    FROM settlement_4 WHERE scenario = 13) s GROUP BY s.scope, s.day),
held_v AS (SELECT b.scope, b.day, s.net_paise AS held FROM batch_v b JOIN settlement_4 s ON s.scope = b.scope AND s.row_id = b.first_payment WHERE b.scenario = 12),
plain_v AS (SELECT b.*, h.first_half, k.held, ((b.day + 3 * b.scope) % 4 = 3) AS late, (b.day + 3 * b.scope) % 6 AS off FROM batch_v b
    LEFT JOIN half_v h ON h.scope = b.scope AND h.day = b.day LEFT JOIN held_v k ON k.scope = b.scope AND k.day = b.day),
lines_v AS (
    SELECT scope, day, scenario, 1 AS k, CASE WHEN scenario = 18 THEN CASE WHEN wave % 2 = 0 THEN settled_on ELSE {d['plus']('settled_on', 1)} END
            WHEN scenario = 13 THEN settled_on WHEN late THEN {d['plus']('settled_on', 1)} ELSE settled_on END AS value_date,
        CASE WHEN scenario IN (9, 10, 11, 12, 18) THEN concat('NEFT RAZORPAY SOFTWARE SETTLEMENT ', day) ELSE concat('NEFT-', {ref}, '-RAZORPAY SOFTWARE') END AS narration,
        CASE WHEN scenario = 12 THEN net - held WHEN scenario = 13 THEN first_half
            WHEN scenario = 17 THEN net + CASE off WHEN 0 THEN -7 WHEN 1 THEN -3 WHEN 2 THEN -1 WHEN 3 THEN 1 WHEN 4 THEN 4 ELSE 9 END ELSE net END AS credit_paise, 0 AS debit_paise
    FROM plain_v WHERE scenario <> 15 AND net > 0
    UNION ALL SELECT scope, day, scenario, 2, {d['plus']('settled_on', 1)}, concat('NEFT-', {ref}, '-RAZORPAY SOFTWARE'), net - first_half, 0 FROM plain_v WHERE scenario = 13 AND net > 0
    UNION ALL SELECT scope, day, scenario, 2, settled_on, 'IMPS DIRECT TRANSFER VENDOR REFUND', 4321 + day, 0 FROM plain_v WHERE scenario = 14
    UNION ALL SELECT scope, day, scenario, 2, settled_on, 'CHARGEBACK DEBIT', 0, 5000 + day FROM plain_v WHERE scenario = 19),
bank_v AS (SELECT scope, concat('bank_', scope, '_', day, '_', k) AS txn_id, row_number() OVER (PARTITION BY scope ORDER BY value_date, concat('bank_', scope, '_', day, '_', k)) AS txn_seq,
    value_date, narration, CAST(credit_paise AS BIGINT) AS credit_paise, CAST(debit_paise AS BIGINT) AS debit_paise, scenario, day, k FROM lines_v)"""


def truth(d: dict) -> str:
    """txn_id, scenario, row_ids (joined), expect_exception."""
    return f"""
member_v AS (SELECT b.scope, b.txn_id, s.row_id FROM bank_v b JOIN (
        SELECT *, row_number() OVER (PARTITION BY scope, day ORDER BY row_id) AS place, count(*) OVER (PARTITION BY scope, day) AS n FROM settlement_4) s
    ON s.scope = b.scope AND s.day = b.day JOIN batch_v g ON g.scope = b.scope AND g.day = b.day
    WHERE (b.scenario NOT IN (12, 13, 14, 18, 19) AND b.k = 1) OR (b.scenario IN (14, 19) AND b.k = 1) OR (b.scenario = 12 AND s.row_id <> g.first_payment)
        OR (b.scenario = 13 AND (b.k = 1) = (s.place <= {d['div']('s.n', 2)})) OR (b.scenario = 18 AND g.wave % 2 = 0)),
truth_v AS (SELECT b.scope, b.txn_id, concat('scenario_', b.scenario) AS scenario, coalesce(m.row_ids, '') AS row_ids,
    CASE WHEN b.k = 2 AND b.scenario = 14 THEN 'orphan_credit' WHEN b.k = 2 AND b.scenario = 19 THEN 'chargeback_debit'
        WHEN b.scenario = 18 AND m.row_ids IS NULL THEN 'ambiguous_candidates' END AS expect_exception
    FROM bank_v b LEFT JOIN (SELECT scope, txn_id, {d['agg_list']('row_id')} AS row_ids FROM member_v GROUP BY scope, txn_id) m ON m.scope = b.scope AND m.txn_id = b.txn_id)"""


def candidates(d: dict) -> str:
    """Candidates of orders from their line items."""
    return f"""
candidates_v AS (SELECT {d['div']('o_custkey', 100)} AS scope, concat('ord_', o_orderkey) AS txn_id, row_number() OVER (PARTITION BY o_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS cand_no,
    (CAST(round(l_extendedprice * 100) AS BIGINT) - CAST(round(o_totalprice * 100) AS BIGINT)) % 5000 AS delta, {d['days']('CAST(l_shipdate AS DATE)', 'CAST(o_orderdate AS DATE)')} % 4 AS lag, CAST(l_quantity AS BIGINT) AS n_rows
    FROM orders JOIN lineitem ON l_orderkey = o_orderkey)"""


def entries(d: dict, raw: bool = False) -> str:
    """One audit entry for each order, in chains by customer."""
    return f"""
entries_v AS (SELECT o_custkey % 64 AS chain_id, row_number() OVER (PARTITION BY o_custkey % 64 ORDER BY o_orderkey) AS seq, 'match' AS kind, concat('txn_', o_orderkey) AS subject,
    concat('{{"delta_paise":', o_orderkey % 7, ',"tier":"tier1_exact"}}') AS payload, '2026-01-01T00:00:00' AS recorded_at FROM orders)"""


PARTS = {"settlement": settlement, "bank": bank, "truth": truth, "candidates": candidates, "entries": entries}
NEEDS = {"bank": ["settlement"], "truth": ["settlement", "bank"]}


def with_views(dialect: dict, *names: str) -> str:
    """WITH clause of the named parts and what they need."""
    wanted: list[str] = []
    for name in names:
        wanted += [n for n in [*NEEDS.get(name, []), name] if n not in wanted]
    return "WITH " + ",".join(PARTS[n](dialect) for n in wanted)


_KEPT: dict[tuple[str, str], tuple[DataFrame, DataFrame]] = {}


def _base(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """settlement_v and bank_v of a directory, made once in an application: its tables must not change meanwhile.

    The bank lines and the batches, a row for some dozens of line items, are written tables. The settlement rows are not:
    they outweigh the line items that they come from, and a query that leaves row_seq out needs no shuffle of them.
    """
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _KEPT:
        _KEPT[key] = _derived(spark, sf_dir)
    return _KEPT[key]


def _derived(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    _tables(spark, sf_dir)
    cut(spark.sql(f"{with_views(SPARK, 'settlement')} SELECT * FROM batch_v"), "batches").createOrReplaceTempView("batch_w")
    text = with_views(SPARK, "bank")
    made, later = text[: text.index("\nbatch_v AS")] + "\nbatch_v AS (SELECT * FROM batch_w),", text[text.index("\nsettlement_v AS") :]
    return spark.sql(f"{made}{later} SELECT * FROM settlement_v"), cut(spark.sql(f"{made}{later} SELECT * FROM bank_v"), "bank")


def _tables(spark: SparkSession, sf_dir: str) -> None:
    for table in ("lineitem", "orders"):
        spark.read.parquet(f"{sf_dir}/{table}.parquet").createOrReplaceTempView(table)


def view(spark: SparkSession, sf_dir: str, name: str, part: str | None = None) -> DataFrame:
    """A derived view over the tables of a directory."""
    if name in ("settlement_v", "bank_v"):
        return _base(spark, sf_dir)[name == "bank_v"]
    _tables(spark, sf_dir)
    return spark.sql(f"{with_views(SPARK, part or name.removesuffix('_v'))} SELECT * FROM {name}")
