"""All registered queries and, where SQL can express them, their DuckDB counterparts over the same tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerweave.config import ACTIONS, REASONS, ReconcileConfig
from ledgerweave.functions import scalar as P
from ledgerweave.operators import adjudicate, anchored, arith, arithmetic, audit, classify, drift, explain, index, pools, score, tiers
from ledgerweave.plans.directory import read as read_store
from ledgerweave.plans.directory import reconcile_directory
from ledgerweave.plans.reconcile import Reconciliation, deterministic_only, reconcile
from ledgerweave.plans.views import DUCK, view, with_views
from ledgerweave.sources import files, tables
from ledgerweave.storage import cut, fresh_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, views: tuple[str, ...] = ()):
    """Registers a function under its own name, with its SQL over the named views."""
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            if not views:
                ORACLES[fn.__name__] = sql
            else:
                ORACLES[fn.__name__] = with_views(DUCK, *views) + (sql if sql.startswith(",") else " " + sql)
        return fn

    return add


def settlement_of(spark, sf_dir):
    return view(spark, sf_dir, "settlement_v")


def bank_of(spark, sf_dir):
    return view(spark, sf_dir, "bank_v")


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def truth_of(spark, sf_dir):
    t = view(spark, sf_dir, "truth_v")
    return t.select("scope", "txn_id", "scenario", F.when(F.col("row_ids") == "", F.array().cast("array<string>")).otherwise(F.split("row_ids", r"\|")).alias("expected_row_ids"), "expect_exception")


_RUNS: dict[tuple[str, str, bool], Reconciliation] = {}


def reconciled(spark: SparkSession, sf_dir: str, adjudicated: bool = True) -> Reconciliation:
    """The run of a directory, kept as written tables for the queries that start from it."""
    key = (spark.sparkContext.applicationId, sf_dir, adjudicated)
    if key not in _RUNS:
        run = reconcile if adjudicated else deterministic_only
        _RUNS[key] = run(settlement_of(spark, sf_dir), bank_of(spark, sf_dir))
    return _RUNS[key]


# -- scalar functions ---------------------------------------------------------------------------------------------

RUPEE_TEXT = """CASE l_linenumber % 8 WHEN 0 THEN concat('₹ ', CAST(l_orderkey AS VARCHAR(20)), '.5') WHEN 1 THEN concat('-', CAST(l_partkey AS VARCHAR(20)), '.129')
    WHEN 2 THEN concat(CAST(l_orderkey AS VARCHAR(20)), ',', '000', '.00') WHEN 3 THEN '' WHEN 4 THEN 'n/a' WHEN 5 THEN concat('.', CAST(l_partkey AS VARCHAR(20))) WHEN 6 THEN '-' ELSE CAST(l_suppkey AS VARCHAR(20)) END"""


@query(f"""WITH t AS (SELECT {RUPEE_TEXT} AS raw FROM lineitem), u AS (SELECT raw, trim(replace(replace(trim(raw), ',', ''), '₹', '')) AS x FROM t),
v AS (SELECT raw, x, regexp_replace(x, '^[+-]+', '') AS y FROM u)
SELECT raw, CASE WHEN x IN ('', '-', 'nan', 'None') THEN 0 WHEN regexp_matches(y, '^[0-9]*(\\.[0-9]*)?$') THEN
    (CASE WHEN x LIKE '-%' THEN -1 ELSE 1 END) * (CAST(coalesce(nullif(split_part(y, '.', 1), ''), '0') AS BIGINT) * 100 + CAST(rpad(substr(split_part(y, '.', 2), 1, 2), 2, '0') AS BIGINT)) END AS paise, count(*) AS n
FROM v GROUP BY ALL""")
def to_paise(spark, sf_dir):
    raw = table(spark, sf_dir, "lineitem").select(F.expr(RUPEE_TEXT.replace("VARCHAR(20)", "string")).alias("raw"))
    return raw.groupBy("raw", P.to_paise(F.col("raw")).alias("paise")).agg(F.count(F.lit(1)).alias("n"))


DATE_TEXT = {
    "spark": "CASE o_orderkey % 8 WHEN 0 THEN date_format(o_orderdate, 'yyyy-MM-dd') WHEN 1 THEN date_format(o_orderdate, 'dd-MM-yyyy') WHEN 2 THEN date_format(o_orderdate, 'dd/MM/yyyy') "
    "WHEN 3 THEN date_format(o_orderdate, 'yyyy/MM/dd') WHEN 4 THEN date_format(o_orderdate, 'dd-MMM-yyyy') WHEN 5 THEN date_format(o_orderdate, 'MM/dd/yyyy') WHEN 6 THEN '31-02-2026' ELSE '' END",
    "duck": "CASE o_orderkey % 8 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%d-%m-%Y') WHEN 2 THEN strftime(o_orderdate, '%d/%m/%Y') "
    "WHEN 3 THEN strftime(o_orderdate, '%Y/%m/%d') WHEN 4 THEN strftime(o_orderdate, '%d-%b-%Y') WHEN 5 THEN strftime(o_orderdate, '%m/%d/%Y') WHEN 6 THEN '31-02-2026' ELSE '' END",
}


@query(f"""WITH t AS (SELECT o_orderkey, {DATE_TEXT['duck']} AS raw FROM orders)
SELECT o_orderkey, raw, CAST(coalesce(try_strptime(raw, '%Y-%m-%d'), try_strptime(raw, '%d-%m-%Y'), try_strptime(raw, '%d/%m/%Y'), try_strptime(raw, '%Y/%m/%d'), try_strptime(raw, '%d-%b-%Y'), try_strptime(raw, '%m/%d/%Y')) AS DATE) AS parsed FROM t""")
def parse_date(spark, sf_dir):
    t = table(spark, sf_dir, "orders").select("o_orderkey", F.expr(DATE_TEXT["spark"]).alias("raw"))
    return t.withColumn("parsed", P.parse_date(F.col("raw")))


@query("""SELECT doc_id, array_to_string(list_filter(regexp_extract_all(text, '[0-9]+'), lambda x: len(x) IN (12, 16)), ',') AS utrs FROM documents""")
def extract_utrs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.concat_ws(",", P.extract_utrs(F.col("text"))).alias("utrs"))


@query("SELECT scope, txn_id, (contains(upper(narration), 'RAZORPAY') OR contains(upper(narration), 'RZP')) AS gateway, array_to_string(list_filter(regexp_extract_all(narration, '[0-9]+'), lambda x: len(x) IN (12, 16)), ',') AS utrs FROM bank_v", ("bank",))
def gateway_flag(spark, sf_dir):
    return bank_of(spark, sf_dir).select("scope", "txn_id", P.is_gateway(F.col("narration")).alias("gateway"), F.concat_ws(",", P.extract_utrs(F.col("narration"))).alias("utrs"))


# Groups of two from the right.
INR_HEAD = "array_to_string(list_reverse(list_transform(range(0, len({h}), 2), lambda i: reverse(substr(reverse({h}), i + 1, 2)))), ',')"


def inr(c: str) -> str:
    whole = f"CAST(abs({c}) // 100 AS VARCHAR)"
    head = INR_HEAD.format(h=f"left({whole}, len({whole}) - 3)")
    return f"concat(CASE WHEN {c} < 0 THEN '-' ELSE '' END, '₹', CASE WHEN len({whole}) > 3 THEN concat({head}, ',', right({whole}, 3)) ELSE {whole} END, '.', lpad(CAST(abs({c}) % 100 AS VARCHAR), 2, '0'))"


@query(f"SELECT l_orderkey, l_linenumber, v, {inr('v')} AS shown FROM (SELECT l_orderkey, l_linenumber, (CASE WHEN l_linenumber % 3 = 0 THEN -1 ELSE 1 END) * CAST(round(l_extendedprice * 100) AS BIGINT) * (CASE l_linenumber % 4 WHEN 0 THEN 1 WHEN 1 THEN 997 WHEN 2 THEN 1000003 ELSE 0 END) // (CASE WHEN l_linenumber % 4 = 0 THEN l_partkey + 1 ELSE 1 END) AS v FROM lineitem)")
def format_inr(spark, sf_dir):
    v = F.expr("((CASE WHEN l_linenumber % 3 = 0 THEN -1 ELSE 1 END) * CAST(round(l_extendedprice * 100) AS BIGINT) * (CASE l_linenumber % 4 WHEN 0 THEN 1 WHEN 1 THEN 997 WHEN 2 THEN 1000003 ELSE 0 END)) div (CASE WHEN l_linenumber % 4 = 0 THEN l_partkey + 1 ELSE 1 END)")
    t = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", v.alias("v"))
    return t.withColumn("shown", P.format_inr(F.col("v")))


@query("SELECT kind, CAST(sum(CASE WHEN kind = 'refund' THEN -abs(gross_paise) ELSE gross_paise - fee_paise - tax_paise END) AS BIGINT) AS net, count(*) AS n FROM settlement_v GROUP BY kind", ("settlement",))
def net_paise(spark, sf_dir):
    s = settlement_of(spark, sf_dir)
    net = P.net_paise(F.col("kind"), F.col("gross_paise"), F.col("fee_paise"), F.col("tax_paise"))
    return s.groupBy("kind").agg(F.sum(net).alias("net"), F.count(F.lit(1)).alias("n"))


@query("SELECT scope, txn_id, credit_paise - debit_paise AS signed, credit_paise > 0 AS credit FROM bank_v", ("bank",))
def signed_paise(spark, sf_dir):
    return bank_of(spark, sf_dir).select("scope", "txn_id", P.signed_paise(F.col("credit_paise"), F.col("debit_paise")).alias("signed"), P.is_credit(F.col("credit_paise")).alias("credit"))


@query("SELECT scope, day, CASE WHEN net <= 0 THEN 1.0 ELSE least(1.0, power(2, n) / net) END AS risk FROM batch_v", ("settlement",))
def collision_risk(spark, sf_dir):
    b = view(spark, sf_dir, "batch_v", "settlement")
    return b.select("scope", "day", P.collision_risk(F.pow(F.lit(2.0), "n"), F.col("net")).alias("risk"))


@query("SELECT l_orderkey, l_linenumber, coalesce(nullif(trim(CASE WHEN l_linenumber % 3 = 0 THEN '  ' ELSE concat(' ', l_returnflag, ' ') END), ''), 'unknown') AS cleaned FROM lineitem")
def clean_text(spark, sf_dir):
    raw = F.when(F.col("l_linenumber") % 3 == 0, "  ").otherwise(F.concat(F.lit(" "), "l_returnflag", F.lit(" ")))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", P.clean_text(raw, "unknown").alias("cleaned"))


_pair = ", ".join(f"('{k}', '{v}')" for k, v in ACTIONS.items())
RESULTS = f""",
base_r AS (SELECT b.*, t.row_ids, t.expect_exception, CASE WHEN b.scenario = 17 THEN CASE ((b.day + 3 * b.scope) % 6) WHEN 0 THEN -7 WHEN 1 THEN -3 WHEN 2 THEN -1 WHEN 3 THEN 1 WHEN 4 THEN 4 ELSE 9 END ELSE 0 END AS delta,
        least(1e0, CASE WHEN row_ids = '' THEN 0e0 WHEN b.scenario = 11 THEN CASE WHEN x.day IS NULL THEN 2e0 / g.net ELSE 4e0 / (g.net + CASE WHEN y.txn_seq < b.txn_seq THEN h.held ELSE x.net END) END
            WHEN b.scenario = 12 THEN (1e0 + g.n + CAST(g.n AS DOUBLE) * (g.n - 1) / 2 + CAST(g.n AS DOUBLE) * (g.n - 1) * (g.n - 2) / 6) / g.net WHEN b.scenario = 13 AND b.k = 1 THEN 2e0 * g.n / g.net ELSE 0e0 END) AS risk
    FROM bank_v b JOIN truth_v t ON t.scope = b.scope AND t.txn_id = b.txn_id JOIN batch_v g ON g.scope = b.scope AND g.day = b.day
    LEFT JOIN batch_v x ON b.scenario = 11 AND x.scope = b.scope AND x.day = b.day + 1 LEFT JOIN held_v h ON h.scope = x.scope AND h.day = x.day LEFT JOIN bank_v y ON y.scope = x.scope AND y.day = x.day AND y.k = 1),
results_v AS (SELECT scope, txn_id, txn_seq, value_date, narration, credit_paise, debit_paise, scenario, CASE WHEN row_ids = '' THEN 'tier5_exception' WHEN scenario IN (9, 10, 17) THEN 'tier2_fuzzy' WHEN scenario IN (11, 12, 13) THEN 'tier3_subset_sum' WHEN scenario = 18 THEN 'tier4_adjudicated' ELSE 'tier1_exact' END AS tier,
    row_ids, CAST(delta AS BIGINT) AS delta_paise, CASE WHEN row_ids = '' THEN 0e0 WHEN scenario IN (9, 10, 17) THEN 0.9e0 WHEN scenario IN (11, 12, 13) THEN 0.85e0 WHEN scenario = 18 THEN 0.72e0 ELSE 0.99e0 END AS confidence,
    concat(CASE WHEN expect_exception = 'ambiguous_candidates' THEN '2 candidates, none separable on the evidence' WHEN expect_exception = 'orphan_credit' THEN '{REASONS['orphan_credit']}' WHEN expect_exception = 'chargeback_debit' THEN '{REASONS['chargeback_debit']}'
        WHEN scenario IN (9, 10) THEN '{REASONS['fuzzy']}' WHEN scenario = 17 THEN concat('{REASONS['fuzzy']}, delta ', delta, 'p') WHEN scenario = 11 THEN 'whole settle-date groups' WHEN scenario = 12 THEN 'day group minus held-back rows'
        WHEN scenario = 13 AND k = 1 THEN 'leading slice of the batch' WHEN scenario = 13 THEN 'remaining rows of a partly paid batch' WHEN scenario = 18 THEN '{REASONS['closer']}' ELSE '{REASONS['exact']}' END, CASE WHEN risk <> 0 THEN printf(', collision risk %.1e', risk) ELSE '' END) AS reason,
    expect_exception AS exception_type, CAST(CASE WHEN scenario = 18 THEN 2 WHEN row_ids = '' THEN 0 ELSE 1 END AS BIGINT) AS candidates_considered FROM base_r),
action_v AS (SELECT * FROM (VALUES {_pair}) AS a(exception_type, action))"""
RV = ("truth",)


def plain(results: DataFrame) -> DataFrame:
    """Results with the row ids as one text."""
    return results.withColumn("row_ids", F.array_join("row_ids", "|"))


@query(RESULTS + " SELECT DISTINCT r.exception_type, a.action FROM results_v r JOIN action_v a ON a.exception_type = r.exception_type", RV)
def exception_action(spark, sf_dir):
    t = truth_of(spark, sf_dir).filter("expect_exception is not null").select(F.col("expect_exception").alias("exception_type")).distinct()
    return t.withColumn("action", P.exception_action(F.col("exception_type")))


@query("SELECT scope, day, concat('label', CASE WHEN n % 2 = 0 THEN printf(', collision risk %.1e', n / 1e6) WHEN day % 3 <> 0 THEN concat(', delta ', day % 3, 'p') ELSE '' END) AS reason FROM batch_v", ("settlement",))
def reason_text(spark, sf_dir):
    b = view(spark, sf_dir, "batch_v", "settlement")
    risk = F.when(F.col("n") % 2 == 0, F.col("n") / 1e6).otherwise(F.lit(0.0))
    return b.select("scope", "day", P.reason_text(F.lit("label"), risk, (F.col("day") % 3).cast("long")).alias("reason"))


# -- index ----------------------------------------------------------------------------------------------------------

CLAIMED = ", claim_v AS (SELECT scope, row_id FROM settlement_v WHERE row_seq % 3 = 0)"


def claims_of(spark, sf_dir):
    return settlement_of(spark, sf_dir).filter("row_seq % 3 = 0").select("scope", "row_id")


@query(CLAIMED + """ SELECT s.scope, s.settlement_id, arg_min(s.settled_on, s.row_seq) AS group_day, count(*) FILTER (WHERE c.row_id IS NULL) AS n, CAST(sum(s.net_paise) FILTER (WHERE c.row_id IS NULL) AS BIGINT) AS net
FROM settlement_v s LEFT JOIN claim_v c ON c.scope = s.scope AND c.row_id = s.row_id WHERE s.settlement_id IS NOT NULL GROUP BY s.scope, s.settlement_id HAVING count(*) FILTER (WHERE c.row_id IS NULL) > 0""", ("settlement",))
def settlement_groups(spark, sf_dir):
    return index.settlement_groups(settlement_of(spark, sf_dir), claims_of(spark, sf_dir))


@query("SELECT DISTINCT scope, utr, settlement_id FROM settlement_v WHERE utr IS NOT NULL AND settlement_id IS NOT NULL", ("settlement",))
def utr_map(spark, sf_dir):
    return index.utr_map(settlement_of(spark, sf_dir))


@query("SELECT scope, settled_on, count(*) AS n, CAST(sum(net_paise) AS BIGINT) AS net FROM settlement_v WHERE settlement_id IS NULL GROUP BY scope, settled_on", ("settlement",))
def day_pools(spark, sf_dir):
    return index.day_pools(settlement_of(spark, sf_dir))


@query(""", p AS (SELECT scope, settled_on, count(*) AS n, CAST(sum(net_paise) AS BIGINT) AS net FROM settlement_v WHERE settlement_id IS NULL GROUP BY scope, settled_on)
SELECT b.scope, b.txn_id, p.settled_on, p.n, p.net, CAST(b.value_date - p.settled_on AS INTEGER) AS lag FROM bank_v b JOIN p ON p.scope = b.scope AND abs(b.value_date - p.settled_on) <= 3""", ("bank",))
def day_pools_in_window(spark, sf_dir):
    met = index.day_pools_in_window(bank_of(spark, sf_dir), index.day_pools(settlement_of(spark, sf_dir)))
    return met.select("scope", "txn_id", "settled_on", "n", "net", "lag")


@query(CLAIMED + " SELECT s.scope, s.row_id, s.net_paise FROM settlement_v s WHERE NOT EXISTS (SELECT 1 FROM claim_v c WHERE c.scope = s.scope AND c.row_id = s.row_id)", ("settlement",))
def available_rows(spark, sf_dir):
    return index.available(settlement_of(spark, sf_dir), claims_of(spark, sf_dir)).select("scope", "row_id", "net_paise")


@query(CLAIMED + """ SELECT scope, txn_id, row_ids FROM truth_v t WHERE row_ids <> '' AND NOT EXISTS (SELECT 1 FROM member_v m JOIN settlement_v s ON s.scope = m.scope AND s.row_id = m.row_id
    WHERE m.scope = t.scope AND m.txn_id = t.txn_id AND s.row_seq % 50 = 0)""", ("truth",))
def candidates_available(spark, sf_dir):
    cands = truth_of(spark, sf_dir).filter(F.size("expected_row_ids") > 0).select("scope", "txn_id", F.lit(1).alias("cand_no"), F.col("expected_row_ids").alias("row_ids"))
    claims = settlement_of(spark, sf_dir).filter("row_seq % 50 = 0").select("scope", "row_id")
    return index.candidates_still_available(cands, claims).select("scope", "txn_id", F.array_join("row_ids", "|").alias("row_ids"))


@query("SELECT credit_paise > 0 AS credit, count(*) AS n, CAST(sum(credit_paise - debit_paise) AS BIGINT) AS signed FROM bank_v GROUP BY 1", ("bank",))
def split_lines(spark, sf_dir):
    credits, other = index.split_lines(bank_of(spark, sf_dir))
    both = credits.withColumn("credit", F.lit(True)).unionByName(other.withColumn("credit", F.lit(False)))
    return both.groupBy("credit").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("credit_paise") - F.col("debit_paise")).alias("signed"))


# -- tiers ------------------------------------------------------------------------------------------------------------

GROUPS = """, g AS (SELECT scope, settlement_id, arg_min(settled_on, row_seq) AS group_day, count(*) AS n, CAST(sum(net_paise) AS BIGINT) AS net FROM settlement_v WHERE settlement_id IS NOT NULL GROUP BY scope, settlement_id),
u AS (SELECT DISTINCT scope, utr, settlement_id FROM settlement_v WHERE utr IS NOT NULL AND settlement_id IS NOT NULL),
ref AS (SELECT b.*, i AS utr_pos, list_extract(x, i) AS utr FROM (SELECT *, list_filter(regexp_extract_all(narration, '[0-9]+'), lambda x: len(x) IN (12, 16)) AS x FROM bank_v WHERE credit_paise > 0) b, unnest(range(1, len(x) + 1)) AS r(i)),
named AS (SELECT ref.scope, ref.txn_id, ref.txn_seq, ref.credit_paise, g.settlement_id, g.n, g.net, CAST(ref.value_date - g.group_day AS INTEGER) AS lag, ref.utr FROM ref JOIN u ON u.scope = ref.scope AND u.utr = ref.utr JOIN g ON g.scope = u.scope AND g.settlement_id = u.settlement_id),
exact AS (SELECT scope, txn_id, txn_seq, settlement_id, count(*) AS times, lag FROM named WHERE net = credit_paise AND abs(lag) <= 3 GROUP BY ALL),
fuzzy AS (SELECT b.scope, b.txn_id, b.txn_seq, g.settlement_id, b.credit_paise - g.net AS delta, CAST(b.value_date - g.group_day AS INTEGER) AS lag FROM bank_v b JOIN g ON g.scope = b.scope AND abs(b.value_date - g.group_day) <= 3 AND abs(b.credit_paise - g.net) <= 1000 WHERE b.credit_paise > 0)"""


def _exact(spark, sf_dir):
    s = settlement_of(spark, sf_dir)
    lines, _ = index.split_lines(bank_of(spark, sf_dir))
    groups = index.settlement_groups(s)
    named = tiers.named_in_window(lines, index.utr_map(s), groups.select("scope", "settlement_id", "group_day"), ReconcileConfig().date_window_days)
    return tiers.exact_edges(named, groups)


def _fuzzy(spark, sf_dir):
    lines, _ = index.split_lines(bank_of(spark, sf_dir))
    return tiers.fuzzy_edges(lines, index.settlement_groups(settlement_of(spark, sf_dir)), ReconcileConfig())


@query(GROUPS + " SELECT scope, txn_id, settlement_id, times, lag FROM exact", ("bank",))
def tier1_exact(spark, sf_dir):
    return _exact(spark, sf_dir).select("scope", "txn_id", "settlement_id", "times", "lag")


@query(GROUPS + " SELECT scope, utr, count(DISTINCT settlement_id) AS batches, count(DISTINCT txn_id) AS lines FROM named GROUP BY scope, utr HAVING count(DISTINCT settlement_id) > 1", ("bank",))
def duplicate_utr_hits(spark, sf_dir):
    s = settlement_of(spark, sf_dir)
    lines, _ = index.split_lines(bank_of(spark, sf_dir))
    named = tiers.named_batches(lines, index.utr_map(s))
    return named.groupBy("scope", "utr").agg(F.count_distinct("settlement_id").alias("batches"), F.count_distinct("txn_id").alias("lines")).filter("batches > 1")


@query(GROUPS + " SELECT scope, txn_id, settlement_id, delta, lag FROM fuzzy", ("bank",))
def tier2_fuzzy(spark, sf_dir):
    return _fuzzy(spark, sf_dir).select("scope", "txn_id", "settlement_id", "delta", "lag")


@query(GROUPS + " SELECT scope, txn_id, settlement_id, txn_seq = min(txn_seq) OVER (PARTITION BY scope, settlement_id) AS first_claimant FROM fuzzy", ("bank",))
def claim_priority(spark, sf_dir):
    return tiers.claim_priority(_fuzzy(spark, sf_dir)).select("scope", "txn_id", "settlement_id", "first_claimant")


@query(GROUPS + " SELECT scope, txn_id, min(settlement_id) AS settlement_id FROM exact GROUP BY scope, txn_id HAVING sum(times) = 1", ("bank",))
def claim_exact(spark, sf_dir):
    """On these views no two lines want the same batch in the first tier."""
    return tiers.claim_in_order(_exact(spark, sf_dir)).filter("wins").select("scope", "txn_id", "settlement_id")


TWINS = GROUPS + """, twofold AS (SELECT scope, txn_id, 2 * txn_seq AS txn_seq, settlement_id, times FROM exact UNION ALL
    SELECT scope, concat(txn_id, '_twin'), 2 * txn_seq + CASE WHEN txn_seq % 2 = 0 THEN 1 ELSE -1 END, settlement_id, times FROM exact)"""


@query(TWINS + """ SELECT scope, txn_id, settlement_id FROM (SELECT *, sum(times) OVER (PARTITION BY scope, txn_id) AS options, row_number() OVER (PARTITION BY scope, settlement_id ORDER BY txn_seq) AS place FROM twofold) WHERE options = 1 AND place = 1""", ("bank",))
def claim_contested(spark, sf_dir):
    """Every line has a twin, before or after it, that wants the same batch: the first of both wins it."""
    edges = _exact(spark, sf_dir)
    seq = 2 * F.col("txn_seq")
    twin = edges.withColumn("txn_id", F.concat("txn_id", F.lit("_twin"))).withColumn("txn_seq", seq + F.when(F.col("txn_seq") % 2 == 0, 1).otherwise(-1))
    both = edges.withColumn("txn_seq", seq).unionByName(twin)
    return tiers.claim_in_order(both).filter("wins").select("scope", "txn_id", "settlement_id")


# -- part-paid batches ----------------------------------------------------------------------------------------------

PART = GROUPS + ", part AS (SELECT * FROM named WHERE n >= 2 AND net >= credit_paise AND abs(lag) <= 3)"


def slice_sql(order: str) -> str:
    return PART + f""", run AS (SELECT p.scope, p.txn_id, p.settlement_id, p.n, p.net, p.credit_paise, sum(s.net_paise) OVER w AS running, row_number() OVER w AS taken FROM part p JOIN settlement_v s ON s.scope = p.scope AND s.settlement_id = p.settlement_id
    WHERE p.net > p.credit_paise WINDOW w AS (PARTITION BY p.scope, p.txn_id, p.settlement_id ORDER BY s.row_id {order} ROWS UNBOUNDED PRECEDING))
SELECT scope, txn_id, settlement_id, min(taken) AS taken, n, CASE WHEN net <= 0 THEN 1.0 ELSE least(1.0, CAST(2 * n AS DOUBLE) / net) END AS risk FROM run WHERE running = credit_paise GROUP BY scope, txn_id, settlement_id, n, net"""


def _part(spark, sf_dir):
    lines, _ = index.split_lines(bank_of(spark, sf_dir))
    return anchored.part_paid_of(lines, settlement_of(spark, sf_dir), ReconcileConfig())


@query(slice_sql("ASC"), ("bank",))
def leading_slice(spark, sf_dir):
    return anchored.slices(_part(spark, sf_dir), settlement_of(spark, sf_dir))


@query(slice_sql("DESC"), ("bank",))
def trailing_slice(spark, sf_dir):
    return anchored.slices(_part(spark, sf_dir), settlement_of(spark, sf_dir), leading=False)


@query(PART + " SELECT scope, txn_id, settlement_id, n FROM part WHERE net = credit_paise", ("bank",))
def anchored_remaining(spark, sf_dir):
    return anchored.remaining_rows(_part(spark, sf_dir)).select("scope", "txn_id", "settlement_id", "n")


# -- pools -----------------------------------------------------------------------------------------------------------

_masks = ", ".join(f"('{','.join(map(str, m))}', [{', '.join(map(str, m))}])" for m in pools.day_masks(3))


@query(f""", p AS (SELECT scope, settled_on, count(*) AS n, CAST(sum(net_paise) AS BIGINT) AS net FROM settlement_v WHERE settlement_id IS NULL GROUP BY scope, settled_on),
near AS (SELECT b.scope, b.txn_id, b.credit_paise, map_from_entries(list((CAST(p.settled_on - b.value_date AS INTEGER), p.net))) AS m, map_from_entries(list((CAST(p.settled_on - b.value_date AS INTEGER), p.n))) AS c, sum(p.net) AS spread, count(*) AS days
    FROM bank_v b JOIN p ON p.scope = b.scope AND abs(b.value_date - p.settled_on) <= 3 WHERE b.credit_paise > 0 GROUP BY b.scope, b.txn_id, b.credit_paise),
mask(days, k) AS (VALUES {_masks})
SELECT n.scope, n.txn_id, mask.days, CAST(list_sum(list_transform(mask.k, lambda d: n.c[d])) AS BIGINT) AS n_rows, CASE WHEN greatest(n.spread, 1) <= 0 THEN 1.0 ELSE least(1.0, power(2, n.days) / greatest(n.spread, 1)) END AS risk
FROM near n, mask WHERE list_has_all(map_keys(n.m), mask.k) AND list_sum(list_transform(mask.k, lambda d: n.m[d])) = n.credit_paise""", ("bank",))
def day_combination(spark, sf_dir):
    lines, _ = index.split_lines(bank_of(spark, sf_dir))
    return pools.day_combinations(lines, index.day_pools(settlement_of(spark, sf_dir)))


POOL = """, r AS (SELECT concat(scope, '_', settled_on) AS pool, net_paise AS amount, row_number() OVER (PARTITION BY scope, settled_on ORDER BY row_seq) - 1 AS pos, count(*) OVER (PARTITION BY scope, settled_on) AS n FROM settlement_v WHERE settlement_id IS NULL)"""


def pool_rows(spark, sf_dir):
    w = tiers.Window.partitionBy("scope", "settled_on")
    loose = settlement_of(spark, sf_dir).filter("settlement_id is null")
    return loose.select(F.concat_ws("_", "scope", "settled_on").alias("pool"), F.col("net_paise").alias("amount"), (F.row_number().over(w.orderBy("row_seq")) - 1).cast("long").alias("pos"), F.count(F.lit(1)).over(w).alias("n"))


def gap_of(rows, *positions):
    return rows.filter(F.col("pos").isin(*positions) & (F.col("n") > max(positions) + 1)).groupBy("pool").agg(F.sum("amount").alias("gap"))


@query(POOL + ", t AS (SELECT pool, CAST(sum(amount) AS BIGINT) AS gap FROM r WHERE pos = 2 AND n > 3 GROUP BY pool HAVING sum(amount) > 0) SELECT r.pool, min(r.pos) AS dropped FROM r JOIN t ON t.pool = r.pool WHERE amount = gap GROUP BY r.pool", ("settlement",))
def complement_1(spark, sf_dir):
    rows = pool_rows(spark, sf_dir)
    return pools.complement_one(rows.select("pool", "pos", "amount"), gap_of(rows, 2))


@query(POOL + """, t AS (SELECT pool, CAST(sum(amount) AS BIGINT) AS gap FROM r WHERE pos IN (1, 4) AND n > 5 GROUP BY pool HAVING sum(amount) > 0),
pair AS (SELECT a.pool, a.pos AS first, b.pos AS second FROM r a JOIN t ON t.pool = a.pool JOIN r b ON b.pool = a.pool AND a.pos < b.pos AND a.amount + b.amount = t.gap)
SELECT pool, first, second FROM (SELECT *, row_number() OVER (PARTITION BY pool ORDER BY second, first DESC) AS k FROM pair) WHERE k = 1""", ("settlement",))
def complement_2(spark, sf_dir):
    rows = pool_rows(spark, sf_dir)
    return pools.complement_two(rows.select("pool", "pos", "amount"), gap_of(rows, 1, 4))


@query(POOL + """, t AS (SELECT pool, CAST(sum(amount) AS BIGINT) AS gap FROM r WHERE pos IN (0, 3, 6) AND n > 7 GROUP BY pool HAVING sum(amount) > 0),
one AS (SELECT r.pool FROM r JOIN t ON t.pool = r.pool AND amount = gap), two AS (SELECT a.pool FROM r a JOIN t ON t.pool = a.pool JOIN r b ON b.pool = a.pool AND a.pos < b.pos AND a.amount + b.amount = t.gap),
three AS (SELECT a.pool, a.pos AS i, b.pos AS j, c.pos AS k FROM r a JOIN t ON t.pool = a.pool JOIN r b ON b.pool = a.pool AND a.pos < b.pos JOIN r c ON c.pool = a.pool AND b.pos < c.pos AND a.amount + b.amount + c.amount = t.gap)
SELECT pool, concat(i, ',', j, ',', k) AS answer FROM (SELECT *, row_number() OVER (PARTITION BY pool ORDER BY i, j, k) AS q FROM three) WHERE q = 1 AND pool NOT IN (SELECT pool FROM one) AND pool NOT IN (SELECT pool FROM two)""", ("settlement",))
def complement_3(spark, sf_dir):
    rows = pool_rows(spark, sf_dir)
    amounts = rows.groupBy("pool").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "amount"))), lambda x: x["amount"]).alias("amounts"), F.sum("amount").alias("total"))
    asked = amounts.join(gap_of(rows, 0, 3, 6), "pool").withColumn("target", F.col("total") - F.col("gap"))
    return pools.solve(asked, "complement").select("pool", "answer").filter(F.size(F.split("answer", ",")) == 3)


# All sums of each half of a pool, matched on what is missing; declined pools have none.
SUBSET_WAYS = f""", ask AS (SELECT pool, any_value(n) AS n, CAST(sum(amount) FILTER (WHERE pos % 2 = 0) AS BIGINT) AS target, count(*) FILTER (WHERE amount < 0) AS bad FROM r GROUP BY pool),
decl AS (SELECT pool, n, target, (n > {ReconcileConfig().subset_safe_rows} OR target <= 0 OR target > 100000000 OR bad > 14) AS declined FROM ask),
ranked AS (SELECT r.pool, r.pos % 2 AS half, r.amount, row_number() OVER (PARTITION BY r.pool, r.pos % 2 ORDER BY r.pos) AS k FROM r JOIN decl ON decl.pool = r.pool WHERE NOT declined AND r.amount <> 0),
tops AS (SELECT d.pool, half, coalesce(max(k), 0) AS top FROM (SELECT pool, h.half FROM decl, (VALUES (0), (1)) AS h(half) WHERE NOT declined) d LEFT JOIN ranked USING (pool, half) GROUP BY d.pool, half),
sums AS (WITH RECURSIVE s AS (SELECT pool, half, CAST(0 AS BIGINT) AS k, CAST(0 AS HUGEINT) AS total, CAST(0 AS BIGINT) AS used FROM tops
    UNION ALL SELECT s.pool, s.half, s.k + 1, s.total + c.take * q.amount, s.used + c.take FROM s JOIN ranked q ON q.pool = s.pool AND q.half = s.half AND q.k = s.k + 1, (VALUES (0), (1)) AS c(take)) SELECT s.* FROM s JOIN tops t ON t.pool = s.pool AND t.half = s.half AND t.top = s.k),
ways AS (SELECT a.pool, count(*) AS ways FROM sums a JOIN decl d ON d.pool = a.pool JOIN sums b ON b.pool = a.pool AND a.half = 0 AND b.half = 1 AND a.total + b.total = d.target AND a.used + b.used > 0 GROUP BY a.pool)
SELECT {{columns}} FROM (SELECT d.pool, d.n, d.target, CASE WHEN d.declined THEN NULL ELSE CAST(least(coalesce(w.ways, 0), 2) AS INTEGER) END AS ways, d.declined FROM decl d LEFT JOIN ways w ON w.pool = d.pool)"""
WAYS = "pool, n, ways, declined"
BATCH = """, r AS (SELECT concat(scope, '_', settlement_id) AS pool, net_paise AS amount, row_number() OVER (PARTITION BY scope, settlement_id ORDER BY row_id) - 1 AS pos, count(*) OVER (PARTITION BY scope, settlement_id) AS n FROM settlement_v WHERE settlement_id IS NOT NULL)"""


@query(BATCH + SUBSET_WAYS.format(columns=WAYS), ("settlement",))
def anchored_subset(spark, sf_dir):
    """Every named batch in the order of its row ids, with every other row's sum as the credit."""
    w = tiers.Window.partitionBy("scope", "settlement_id")
    named = settlement_of(spark, sf_dir).filter("settlement_id is not null")
    rows = named.select(F.concat_ws("_", "scope", "settlement_id").alias("pool"), F.col("net_paise").alias("amount"), (F.row_number().over(w.orderBy("row_id")) - 1).cast("long").alias("pos"))
    asked = rows.groupBy("pool").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "amount"))), lambda x: x["amount"]).alias("amounts"), F.sum(F.when(F.col("pos") % 2 == 0, F.col("amount"))).alias("target"))
    return pools.subset_ways(asked, ReconcileConfig().subset_safe_rows)


@query(POOL + SUBSET_WAYS.format(columns=WAYS), ("settlement",))
def subset_sum(spark, sf_dir):
    """Every pool, with every other row's sum as the target: solved up to the row gate of the cascade, a declined row beyond it."""
    rows = pool_rows(spark, sf_dir)
    asked = rows.groupBy("pool").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "amount"))), lambda x: x["amount"]).alias("amounts"), F.sum(F.when(F.col("pos") % 2 == 0, F.col("amount"))).alias("target"))
    return pools.subset_ways(asked, ReconcileConfig().subset_safe_rows)


@query()
def solve_subset_sum(spark, sf_dir):
    """The same without the row gate of the cascade: up to 64 payments and 14 refunds a pool."""
    rows = pool_rows(spark, sf_dir)
    asked = rows.groupBy("pool").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "amount"))), lambda x: x["amount"]).alias("amounts"), F.sum(F.when(F.col("pos") % 2 == 0, F.col("amount"))).alias("target"))
    return pools.subset_ways(asked, arith.MOST_POSITIVE + arith.MOST_NEGATIVE)


@query(POOL + SUBSET_WAYS.format(columns="pool, ways") + " WHERE target > 0", ("settlement",))
def subset_sum_small(spark, sf_dir):
    """The same for pools with a positive target, without the columns that tell why there is no answer."""
    rows = pool_rows(spark, sf_dir)
    positive = rows.groupBy("pool").agg(F.sum(F.when(F.col("pos") % 2 == 0, F.col("amount"))).alias("target")).filter("target > 0")
    return subset_sum(spark, sf_dir).join(positive.select("pool"), "pool", "left_semi").select("pool", "ways")


_RISK = "CASE WHEN {s} <= 0 THEN 1.0 ELSE least(1.0, {h} / {s}) END"
_SETS_AT = f"least(1.0, power(2.0, n) / greatest(net, 1))"
_DROPS_AT = "least(1.0, (1 + n + n * (n - 1) / 2.0 + n * (n - 1) * (n - 2) / 6.0) / greatest(net, 1))"
_UNSAFE = f"(n > {ReconcileConfig().subset_safe_rows} OR {_SETS_AT} > {ReconcileConfig().max_collision_risk})"


def half_sums(pool: str, rows: str) -> str:
    """SQL: all sums of each half of the pools (key, at most a few rows) of `rows` (key, pos, row_id, amount), with the rows that they use."""
    return f"""ranked AS (SELECT {pool}, pos % 2 AS half, amount, row_id, row_number() OVER (PARTITION BY {pool}, pos % 2 ORDER BY pos) AS k FROM {rows} WHERE amount <> 0),
tops AS (SELECT {pool}, half, max(k) AS top FROM ranked GROUP BY {pool}, half),
sums AS (WITH RECURSIVE s AS (SELECT DISTINCT {pool}, h.half, CAST(0 AS BIGINT) AS k, CAST(0 AS HUGEINT) AS total, CAST([] AS VARCHAR[]) AS used FROM {rows}, (VALUES (0), (1)) AS h(half)
    UNION ALL SELECT {', '.join('s.' + c.strip() for c in pool.split(','))}, s.half, s.k + 1, s.total + c.take * q.amount, CASE WHEN c.take = 1 THEN list_append(s.used, q.row_id) ELSE s.used END
        FROM s JOIN ranked q ON {' AND '.join(f's.{c.strip()} = q.{c.strip()}' for c in pool.split(','))} AND q.half = s.half AND q.k = s.k + 1, (VALUES (0), (1)) AS c(take))
    SELECT s.* FROM s LEFT JOIN tops t ON {' AND '.join(f's.{c.strip()} = t.{c.strip()}' for c in pool.split(','))} AND t.half = s.half WHERE s.k = coalesce(t.top, 0))"""


def _one_set(df):
    """Candidates as ways (1, or 2 for more) and the rows where there is one way."""
    return df.withColumn("ways", F.size("sets").cast("int")).withColumn("row_ids", F.when(F.col("ways") == 1, F.array_join(F.array_sort(F.col("sets")[0]["row_id"]), "|")))


@query(f""", p AS (SELECT scope, settled_on, count(*) AS n, CAST(sum(net_paise) AS BIGINT) AS net, CAST(sum(greatest(net_paise, 0)) AS BIGINT) AS plus, count(*) FILTER (WHERE net_paise < 0) AS bad FROM settlement_v WHERE settlement_id IS NULL GROUP BY scope, settled_on),
near AS (SELECT b.scope, b.txn_id, b.credit_paise, p.settled_on AS day, CAST(b.value_date - p.settled_on AS INTEGER) AS lag, p.n, p.net, p.plus, p.bad FROM bank_v b JOIN p ON p.scope = b.scope AND abs(b.value_date - p.settled_on) <= 3 WHERE b.credit_paise > 0),
mapped AS (SELECT scope, txn_id, credit_paise, map_from_entries(list((-lag, net))) AS m FROM near GROUP BY ALL), mask(k) AS (VALUES {", ".join(f"([{', '.join(map(str, m))}])" for m in pools.day_masks(3))}),
whole AS (SELECT DISTINCT scope, txn_id FROM mapped n, mask WHERE list_has_all(map_keys(n.m), mask.k) AND list_sum(list_transform(mask.k, lambda d: n.m[d])) = n.credit_paise),
tried AS (SELECT *, row_number() OVER (PARTITION BY scope, txn_id ORDER BY abs(lag), day) AS place, {_UNSAFE} AS unsafe, {_DROPS_AT} AS drop_risk, {_SETS_AT} AS set_risk FROM near ANTI JOIN whole USING (scope, txn_id)),
r AS (SELECT scope, settled_on AS day, row_id, net_paise AS amount, row_number() OVER (PARTITION BY scope, settled_on ORDER BY row_seq) - 1 AS pos FROM settlement_v WHERE settlement_id IS NULL),
gap AS (SELECT scope, txn_id, day, n, net - credit_paise AS gap FROM tried WHERE drop_risk <= {ReconcileConfig().max_collision_risk} AND net > credit_paise),
one AS (SELECT scope, txn_id, day, [min(pos)] AS d FROM gap JOIN r USING (scope, day) WHERE amount = gap GROUP BY ALL),
two AS (SELECT scope, txn_id, day, arg_min([a.pos, b.pos], b.pos * 100000 - a.pos) AS d FROM gap JOIN r a USING (scope, day) JOIN r b USING (scope, day) WHERE a.pos < b.pos AND a.amount + b.amount = gap GROUP BY scope, txn_id, day),
three AS (SELECT scope, txn_id, day, min([a.pos, b.pos, c.pos]) AS d FROM gap JOIN r a USING (scope, day) JOIN r b USING (scope, day) JOIN r c USING (scope, day) WHERE n <= 120 AND a.pos < b.pos AND b.pos < c.pos AND a.amount + b.amount + c.amount = gap GROUP BY scope, txn_id, day),
drops AS (SELECT g.scope, g.txn_id, g.day, coalesce(one.d, two.d, three.d) AS d FROM gap g LEFT JOIN one USING (scope, txn_id, day) LEFT JOIN two USING (scope, txn_id, day) LEFT JOIN three USING (scope, txn_id, day) WHERE coalesce(one.d, two.d, three.d) IS NOT NULL AND len(coalesce(one.d, two.d, three.d)) < g.n),
small AS (SELECT r.* FROM r SEMI JOIN (SELECT scope, day FROM tried WHERE NOT unsafe) t USING (scope, day)), {half_sums('scope, day', 'small')},
sets AS (SELECT t.scope, t.txn_id, t.day, count(*) AS ways, any_value(list_sort(a.used || b.used)) AS rows FROM tried t JOIN sums a ON a.scope = t.scope AND a.day = t.day AND a.half = 0 JOIN sums b ON b.scope = t.scope AND b.day = t.day AND b.half = 1 AND a.total + b.total = t.credit_paise
    WHERE NOT t.unsafe AND len(a.used) + len(b.used) > 0 AND t.credit_paise <= 100000000 AND t.bad <= 14 ANTI_DROPS GROUP BY t.scope, t.txn_id, t.day),
judged AS (SELECT t.*, d.d, s.ways AS set_ways, s.rows AS set_rows, min(CASE WHEN d.d IS NOT NULL OR s.ways IS NOT NULL THEN place END) OVER w AS stop, count(*) OVER w AS days FROM tried t LEFT JOIN drops d USING (scope, txn_id, day) LEFT JOIN sets s USING (scope, txn_id, day) WINDOW w AS (PARTITION BY scope, txn_id)),
said AS (SELECT *, max(unsafe AND (stop IS NULL OR place < stop)) OVER (PARTITION BY scope, txn_id) AS declined FROM judged)
SELECT scope, txn_id, CASE WHEN stop IS NOT NULL THEN day END AS day, CASE WHEN stop IS NOT NULL THEN lag END AS lag, CASE WHEN d IS NOT NULL THEN 'day group minus held-back rows' WHEN set_ways IS NOT NULL THEN 'exact subset of one settle-date group' END AS strategy,
    CASE WHEN d IS NOT NULL THEN drop_risk WHEN set_ways IS NOT NULL THEN set_risk END AS risk, CAST(coalesce(stop, days) AS BIGINT) AS days_tried, declined, CAST(CASE WHEN d IS NOT NULL THEN 1 WHEN set_ways IS NOT NULL THEN least(set_ways, 2) ELSE 0 END AS INTEGER) AS ways,
    CASE WHEN d IS NOT NULL THEN (SELECT string_agg(r.row_id, '|' ORDER BY r.row_id) FROM r WHERE r.scope = said.scope AND r.day = said.day AND NOT list_contains(said.d, r.pos)) WHEN set_ways = 1 THEN array_to_string(set_rows, '|') END AS row_ids
FROM said WHERE place = coalesce(stop, 1)""".replace("ANTI_DROPS", "AND NOT EXISTS (SELECT 1 FROM drops d WHERE d.scope = t.scope AND d.txn_id = t.txn_id AND d.day = t.day)"), ("bank",))
def nearest_pool(spark, sf_dir):
    """Every credit that no set of whole days makes up, with the day pools in its window tried nearest first."""
    lines, _ = index.split_lines(bank_of(spark, sf_dir).select("scope", "txn_id", "txn_seq", "value_date", "credit_paise"))
    loose = settlement_of(spark, sf_dir).filter("settlement_id is null").select("scope", "row_id", "row_seq", "net_paise", "settled_on")
    near = index.day_pools_in_window(lines, arithmetic.pool_totals(loose)).withColumnRenamed("settled_on", "day")
    with_rows = pools.with_rows_of(loose)
    found = pools.nearest_first(cut(pools.near_pools(near, with_rows, ReconcileConfig()), "near-pools"), with_rows, ReconcileConfig())
    keys = ["scope", "txn_id", "day", "lag", "strategy", "risk", "days_tried", "declined"]
    return _one_set(found.groupBy(*keys).agg(F.collect_list("members").alias("sets"))).select(*keys, "ways", "row_ids")


@query(BATCH.replace("concat(scope, '_', settlement_id) AS pool, ", "scope, settlement_id, row_id, ") + f""", ask AS (SELECT scope, settlement_id, any_value(n) AS n, CAST(sum(amount) AS BIGINT) AS net, CAST(sum(amount) FILTER (WHERE pos % 2 = 0) AS BIGINT) AS credit, count(*) FILTER (WHERE amount < 0) AS bad FROM r GROUP BY scope, settlement_id),
part AS (SELECT *, {_UNSAFE} AS unsafe, {_SETS_AT} AS set_risk, least(1.0, 2.0 * n / greatest(net, 1)) AS slice_risk FROM ask WHERE n >= 2 AND net >= credit AND credit > 0),
run AS (SELECT p.scope, p.settlement_id, p.credit, p.net, r.amount, sum(r.amount) OVER w AS running, row_number() OVER w AS k FROM part p JOIN r USING (scope, settlement_id) WHERE p.net > p.credit WINDOW w AS (PARTITION BY p.scope, p.settlement_id ORDER BY r.row_id ROWS UNBOUNDED PRECEDING)),
cuts AS (SELECT scope, settlement_id, min(k) FILTER (WHERE running = credit) AS lead, max(k) FILTER (WHERE net - running + amount = credit) AS trail FROM run GROUP BY scope, settlement_id),
small AS (SELECT r.* FROM r SEMI JOIN (SELECT scope, settlement_id FROM part JOIN cuts USING (scope, settlement_id) WHERE NOT unsafe AND lead IS NULL AND trail IS NULL) t USING (scope, settlement_id)), {half_sums('scope, settlement_id', 'small')},
sets AS (SELECT t.scope, t.settlement_id, count(*) AS ways, any_value(list_sort(a.used || b.used)) AS rows FROM part t JOIN sums a ON a.scope = t.scope AND a.settlement_id = t.settlement_id AND a.half = 0 JOIN sums b ON b.scope = t.scope AND b.settlement_id = t.settlement_id AND b.half = 1 AND a.total + b.total = t.credit
    WHERE len(a.used) + len(b.used) > 0 AND t.credit <= 100000000 AND t.bad <= 14 GROUP BY t.scope, t.settlement_id)
SELECT * FROM (SELECT p.scope, p.settlement_id, p.n, CASE WHEN net = credit THEN 'remaining rows of a partly paid batch' WHEN lead IS NOT NULL THEN 'leading slice of the batch' WHEN trail IS NOT NULL THEN 'trailing slice of the batch' WHEN ways IS NOT NULL THEN 'exact subset of the named batch' END AS strategy,
    CAST(CASE WHEN net = credit OR lead IS NOT NULL OR trail IS NOT NULL THEN 1 ELSE least(coalesce(ways, 0), 2) END AS INTEGER) AS ways, CAST(CASE WHEN net = credit THEN n WHEN lead IS NOT NULL THEN lead WHEN trail IS NOT NULL THEN n - trail + 1 WHEN ways = 1 THEN len(rows) END AS BIGINT) AS n_rows,
    CASE WHEN net = credit THEN 0.0 WHEN coalesce(lead, trail) IS NOT NULL THEN slice_risk WHEN ways IS NOT NULL THEN set_risk END AS risk, net > credit AND lead IS NULL AND trail IS NULL AND unsafe AS declined, CASE WHEN ways = 1 THEN array_to_string(rows, '|') END AS row_ids
FROM part p LEFT JOIN cuts USING (scope, settlement_id) LEFT JOIN sets USING (scope, settlement_id)) WHERE strategy IS NOT NULL OR declined""", ("settlement",))
def anchored_candidates(spark, sf_dir):
    """Every named batch with a line that names it and whose credit is every other row's sum: remainder, slices, then exact subsets behind the gate."""
    named = settlement_of(spark, sf_dir).filter("settlement_id is not null")
    w = tiers.Window.partitionBy("scope", "settlement_id").orderBy("row_id")
    credit = F.sum(F.when(F.col("pos") % 2 == 0, F.col("net_paise"))).alias("credit_paise")
    lines = named.withColumn("pos", F.row_number().over(w) - 1).groupBy("scope", "settlement_id").agg(credit).filter("credit_paise > 0")
    lines = lines.select("scope", F.col("settlement_id").alias("txn_id"), F.lit(1).cast("long").alias("txn_seq"), "credit_paise", F.lit(0).alias("utr_pos"), "settlement_id", F.lit(0).alias("lag"))
    groups = index.settlement_groups(named)
    found = anchored.anchored_candidates(lines, groups, named, ReconcileConfig()).join(groups.select("scope", "settlement_id", "n"), ["scope", "settlement_id"])
    sets = F.filter(F.collect_list(F.coalesce("members", F.array().cast(anchored.MEMBERS))), lambda s: F.size(s) > 0)
    out = found.groupBy("scope", "settlement_id", "n", "strategy", "risk", "declined").agg(sets.alias("sets"), F.count("strategy").cast("int").alias("ways"), F.max("n_rows").alias("most"))
    one = F.when(F.size("sets") == 1, F.array_join(F.array_sort(F.col("sets")[0]["row_id"]), "|"))
    return out.select("scope", "settlement_id", "n", "strategy", "ways", F.when(F.col("ways") == 1, F.col("most")).alias("n_rows"), "risk", "declined", one.alias("row_ids"))


@query()
def spurious_match_rate(spark, sf_dir):
    """The day groups, whole and with their refunds; every other row's sum is the target."""
    s = settlement_of(spark, sf_dir)
    w = tiers.Window.partitionBy("scope", "settled_on")
    rows = s.withColumn("pos", F.row_number().over(w.orderBy("row_seq")) - 1)
    made = rows.groupBy("scope", "settled_on").agg(F.sort_array(F.collect_list(F.struct("pos", "net_paise"))).alias("r"))
    made = made.select(F.concat_ws("_", "scope", "settled_on").alias("pool_id"), F.transform("r", lambda x: x["net_paise"]).alias("amounts"), F.aggregate("r", F.lit(0).cast("long"), lambda a, x: a + F.when(x["pos"] % 2 == 0, x["net_paise"]).otherwise(0)).alias("target"))
    return score.spurious_match_rate(made)


# -- the cascade ---------------------------------------------------------------------------------------------------------

@query(RESULTS + " SELECT scope, txn_id, tier, row_ids, delta_paise, confidence, reason, exception_type, candidates_considered FROM results_v", RV)
def reconcile_results(spark, sf_dir):
    return plain(reconciled(spark, sf_dir).results)


def _reconcile(spark, sf_dir):
    return plain(reconcile(settlement_of(spark, sf_dir), bank_of(spark, sf_dir)).results)


QUERIES["reconcile"], ORACLES["reconcile"] = _reconcile, ORACLES["reconcile_results"]


@query(RESULTS + " SELECT scope, txn_id, CASE WHEN scenario = 18 THEN 'tier5_exception' ELSE tier END AS tier, CASE WHEN scenario = 18 THEN 'ambiguous_candidates' ELSE exception_type END AS exception_type, CASE WHEN scenario = 18 THEN '' ELSE row_ids END AS row_ids FROM results_v", RV)
def deterministic_run(spark, sf_dir):
    return plain(reconciled(spark, sf_dir, False).results).select("scope", "txn_id", "tier", "exception_type", "row_ids")


@query(RESULTS + " SELECT s.scope, s.row_id, s.net_paise FROM settlement_v s WHERE NOT EXISTS (SELECT 1 FROM results_v r, unnest(string_split(r.row_ids, '|')) AS m(row_id) WHERE r.scope = s.scope AND m.row_id = s.row_id)", RV)
def unclaimed_rows(spark, sf_dir):
    return explain.unclaimed_rows(settlement_of(spark, sf_dir), reconciled(spark, sf_dir).claims).select("scope", "row_id", "net_paise")


@query(RESULTS + " SELECT r.scope, m.row_id, r.txn_id, r.tier FROM results_v r, unnest(string_split(r.row_ids, '|')) AS m(row_id) WHERE r.row_ids <> ''", RV)
def claim_rows(spark, sf_dir):
    return reconciled(spark, sf_dir).claims.select("scope", "row_id", "txn_id", "tier")


@query(RESULTS + " SELECT tier, count(*) AS n FROM results_v GROUP BY tier", RV)
def tier_counts(spark, sf_dir):
    return classify.tier_counts(reconciled(spark, sf_dir).results)


@query(RESULTS + f""" SELECT count(*) AS bank_lines, count(*) FILTER (WHERE row_ids <> '') AS matched, count(*) FILTER (WHERE row_ids = '') AS exceptions, count(*) FILTER (WHERE tier IN ('tier1_exact', 'tier2_fuzzy', 'tier3_subset_sum')) AS deterministic_resolved,
    count(*) FILTER (WHERE tier = 'tier4_adjudicated') AS adjudicated, (SELECT count(*) FROM settlement_v) AS settlement_rows, CAST(sum(credit_paise) AS BIGINT) AS total_credits_paise, CAST(0 AS BIGINT) AS quarantined, {inr('CAST(sum(credit_paise) AS BIGINT)')} AS total_credits FROM results_v""", RV)
def run_summary(spark, sf_dir):
    return score.run_summary(reconciled(spark, sf_dir).results, settlement_of(spark, sf_dir), bank_of(spark, sf_dir))


# -- choice and exceptions -----------------------------------------------------------------------------------------------------

RANKED = """, k AS (SELECT *, abs(delta) + 100 * abs(lag) AS cost, row_number() OVER w AS place, lead(abs(delta) + 100 * abs(lag)) OVER w AS next_cost, count(*) OVER (PARTITION BY scope, txn_id) AS n_candidates FROM candidates_v
    WINDOW w AS (PARTITION BY scope, txn_id ORDER BY abs(delta), abs(lag), n_rows DESC, cand_no))"""
RANK_SQL = RANKED + f""" SELECT scope, txn_id, CASE WHEN n_candidates = 1 OR (next_cost > 0 AND cost < 0.75 * next_cost) THEN cand_no END AS cand_no, CASE WHEN n_candidates = 1 THEN 0.8e0 WHEN next_cost > 0 AND cost < 0.75 * next_cost THEN 0.72e0 ELSE 0e0 END AS confidence,
    CASE WHEN n_candidates = 1 THEN '{REASONS['sole']}' WHEN next_cost > 0 AND cost < 0.75 * next_cost THEN '{REASONS['closer']}' ELSE '{REASONS['equal']}' END AS reason, n_candidates FROM k WHERE place = 1"""


@query(RANK_SQL, ("candidates",))
def rank_candidates(spark, sf_dir):
    return adjudicate.rank_candidates(view(spark, sf_dir, "candidates_v"))


@query(", z AS (SELECT * FROM (" + "SELECT *, count(*) OVER (PARTITION BY scope, txn_id) AS n FROM candidates_v) WHERE n = 1) SELECT scope, txn_id, cand_no FROM z", ("candidates",))
def sole_candidate(spark, sf_dir):
    ranked = adjudicate.rank_candidates(view(spark, sf_dir, "candidates_v"))
    return ranked.filter("n_candidates = 1").select("scope", "txn_id", "cand_no")


RAW = """CASE o_orderkey % 7 WHEN 0 THEN '{"candidate_id":"cand_00001","confidence":0.9,"reason":"close"}' WHEN 1 THEN '{"candidate_id":"cand_99999","confidence":0.9}' WHEN 2 THEN '{"candidate_id":7,"confidence":0.9}' WHEN 3 THEN '{"candidate_id":"cand_00001","confidence":5.0}'
    WHEN 4 THEN '{"candidate_id":"cand_00001","confidence":"very","reason":""}' WHEN 5 THEN '{"candidate_id": broken' ELSE '```json{"candidate_id":null,"confidence":0.25,"reason":"equal"}```' END"""


@query(f"""SELECT concat('ord_', o_orderkey) AS txn_id, CASE WHEN m IN (0, 3, 4) THEN 'cand_00001' END AS chosen, CASE m WHEN 0 THEN 0.9e0 WHEN 3 THEN 1e0 WHEN 6 THEN 0.25e0 ELSE 0e0 END AS confidence,
    CASE m WHEN 0 THEN 'close' WHEN 1 THEN 'model named an unknown candidate (''cand_99999''); treated as unresolved' WHEN 2 THEN 'model returned a non-string candidate id' WHEN 5 THEN 'unparseable reply' WHEN 6 THEN 'equal' ELSE 'no reason given' END AS reason, m IN (1, 2, 5) AS degraded
FROM (SELECT o_orderkey, o_orderkey % 7 AS m FROM orders)""")
def validate_replies(spark, sf_dir):
    replies = table(spark, sf_dir, "orders").select(F.concat(F.lit("ord_"), "o_orderkey").alias("txn_id"), F.expr(RAW).alias("raw"))
    return adjudicate.validate_replies(replies, F.array(F.lit("cand_00001"), F.lit("cand_00002"))).drop("raw")


@query(RANKED + """ SELECT DISTINCT scope, txn_id, CASE WHEN CAST(substr(txn_id, 5) AS BIGINT) % 3 <> 0 AND n_candidates >= CAST(substr(txn_id, 5) AS BIGINT) % 3 THEN CAST(substr(txn_id, 5) AS BIGINT) % 3 END AS cand_no,
    CASE WHEN CAST(substr(txn_id, 5) AS BIGINT) % 3 <> 0 AND n_candidates >= CAST(substr(txn_id, 5) AS BIGINT) % 3 THEN 0.6e0 ELSE 0e0 END AS confidence, 'outside' AS reason, n_candidates FROM k""", ("candidates",))
def decisions_from_replies(spark, sf_dir):
    cands = view(spark, sf_dir, "candidates_v")
    replies = cands.select("scope", "txn_id").distinct().withColumn("chosen", F.format_string("cand_%05d", F.substring("txn_id", 5, 12).cast("long") % 3)).withColumn("confidence", F.lit(0.6)).withColumn("reason", F.lit("outside"))
    return adjudicate.decisions_from_replies(cands, replies)


@query(""" SELECT c.scope, c.txn_id, count(*) AS n, min(b.narration) AS narration, min(b.credit_paise) AS amount_paise, min('cand_' || lpad(CAST(cand_no AS VARCHAR), 5, '0')) AS first_id, CAST(sum(abs(delta)) AS BIGINT) AS deltas
FROM (SELECT scope, txn_id, txn_seq % 4 AS cand_no, txn_seq AS delta FROM bank_v UNION ALL SELECT scope, txn_id, 4 + txn_seq % 3, -txn_seq FROM bank_v WHERE txn_seq % 2 = 0) c JOIN bank_v b ON b.scope = c.scope AND b.txn_id = c.txn_id GROUP BY c.scope, c.txn_id""", ("bank",))
def adjudication_requests(spark, sf_dir):
    bank = bank_of(spark, sf_dir)
    one = bank.select("scope", "txn_id", (F.col("txn_seq") % 4).alias("cand_no"), F.col("txn_seq").cast("long").alias("delta"), F.lit(0).alias("lag"), F.lit(1).cast("long").alias("n_rows"))
    two = bank.filter("txn_seq % 2 = 0").select("scope", "txn_id", (4 + F.col("txn_seq") % 3).alias("cand_no"), (-F.col("txn_seq")).cast("long").alias("delta"), F.lit(0).alias("lag"), F.lit(1).cast("long").alias("n_rows"))
    asked = adjudicate.adjudication_requests(one.unionByName(two), bank)
    back = F.from_json("request", "bank_credit struct<narration:string,amount_paise:long>, candidates array<struct<candidate_id:string,delta_paise:long>>")
    return asked.withColumn("r", back).select(
        "scope", "txn_id", F.size("r.candidates").cast("long").alias("n"), "r.bank_credit.narration", "r.bank_credit.amount_paise", F.array_min("r.candidates.candidate_id").alias("first_id"),
        F.aggregate("r.candidates.delta_paise", F.lit(0).cast("long"), lambda a, x: a + F.abs(x)).alias("deltas"),
    )


@query(f""" SELECT scope, txn_id, kind AS exception_type, CASE WHEN kind = 'ambiguous_candidates' THEN concat(pending, ' candidates, none separable on the evidence') WHEN kind = 'chargeback_debit' THEN '{REASONS['chargeback_debit']}' WHEN kind = 'orphan_credit' THEN '{REASONS['orphan_credit']}'
    WHEN kind = 'arithmetic_unsafe' THEN '{REASONS['arithmetic_unsafe']}' WHEN kind = 'no_candidate' THEN '{REASONS['no_candidate']}' ELSE '{REASONS['missing_in_bank']}' END AS reason, CAST(pending AS BIGINT) AS candidates_considered
FROM (SELECT scope, txn_id, CASE WHEN txn_seq % 7 = 0 THEN 2 ELSE 0 END AS pending, CASE WHEN credit_paise <= 0 THEN 'chargeback_debit' WHEN txn_seq % 7 = 0 THEN 'ambiguous_candidates' WHEN NOT contains(narration, 'RAZORPAY') THEN 'orphan_credit' WHEN txn_seq % 5 = 0 THEN 'arithmetic_unsafe'
    WHEN txn_seq % 3 = 0 THEN 'no_candidate' ELSE 'missing_in_bank' END AS kind FROM bank_v)""", ("bank",))
def classify_exceptions(spark, sf_dir):
    lines = bank_of(spark, sf_dir).select("scope", "txn_id", "narration", (F.col("credit_paise") > 0).alias("is_credit"), F.when(F.col("txn_seq") % 7 == 0, 2).otherwise(0).alias("n_pending"), (F.col("txn_seq") % 5 == 0).alias("declined"), (F.col("txn_seq") % 3 == 0).alias("rows_left"))
    return classify.classify_exceptions(lines).select("scope", "txn_id", "exception_type", "reason", "candidates_considered")


@query(RESULTS + " SELECT r.exception_type, count(*) AS n, min(a.action) AS action FROM results_v r JOIN action_v a ON a.exception_type = r.exception_type GROUP BY r.exception_type", RV)
def exception_queue(spark, sf_dir):
    return classify.exception_queue(reconciled(spark, sf_dir).results)


@query(RESULTS + """ SELECT count(*) AS bank_lines, count(*) FILTER (WHERE tier IN ('tier1_exact', 'tier2_fuzzy', 'tier3_subset_sum')) AS resolved_without_ai, round(100e0 * count(*) FILTER (WHERE tier IN ('tier1_exact', 'tier2_fuzzy', 'tier3_subset_sum')) / count(*), 1) AS resolved_without_ai_pct,
    count(*) FILTER (WHERE scenario = 18) AS escalated, count(*) FILTER (WHERE scenario = 18) * 200 AS tokens, round(count(*) FILTER (WHERE scenario = 18) * 200 / 1000 * 0.65e0, 4) AS estimated_cost_inr,
    round(CAST(count(*) FILTER (WHERE scenario = 18) * 200 AS DOUBLE) / (SELECT count(*) FROM settlement_v) * 0.65e0, 4) AS cost_per_1k_rows_inr FROM results_v""", RV)
def ai_budget(spark, sf_dir):
    run = reconciled(spark, sf_dir)
    return score.ai_budget(run.results, run.escalated, settlement_of(spark, sf_dir).count(), tokens_per_call=200)


# -- fee drift -------------------------------------------------------------------------------------------------------------

DRIFT = """, f AS (SELECT scope, row_id, method, gross_paise, fee_paise + tax_paise AS charged_paise, gross_paise * 200 // 10000 + (gross_paise * 200 // 10000) * 1800 // 10000 AS expected_paise, fee_paise * 10000 // gross_paise AS effective_bps FROM settlement_v WHERE kind = 'payment' AND gross_paise > 0),
flag AS (SELECT *, charged_paise - expected_paise AS excess_paise FROM f WHERE effective_bps > 204 AND charged_paise > expected_paise)"""


@query(DRIFT + " SELECT * FROM flag", ("settlement",))
def fee_drift(spark, sf_dir):
    return drift.detect_fee_drift(settlement_of(spark, sf_dir))


@query(DRIFT + " SELECT (SELECT count(*) FROM f) AS rows_checked, count(*) AS flagged, CAST(coalesce(sum(excess_paise), 0) AS BIGINT) AS total_excess_paise FROM flag", ("settlement",))
def fee_drift_summary(spark, sf_dir):
    return drift.drift_summary(settlement_of(spark, sf_dir))


@query(DRIFT + " SELECT method, CAST(sum(excess_paise) AS BIGINT) AS excess_paise FROM flag GROUP BY method", ("settlement",))
def fee_drift_by_method(spark, sf_dir):
    return drift.drift_by_method(drift.detect_fee_drift(settlement_of(spark, sf_dir)))


@query(DRIFT + " SELECT * FROM flag ORDER BY excess_paise DESC, row_id LIMIT 20", ("settlement",))
def fee_drift_top20(spark, sf_dir):
    return drift.top_drift(drift.detect_fee_drift(settlement_of(spark, sf_dir)))


# -- explanations -------------------------------------------------------------------------------------------------------------

@query(RESULTS + f""", e AS (SELECT r.scope, r.txn_id, r.tier, r.reason, r.credit_paise, s.* EXCLUDE (scope) FROM results_v r, unnest(string_split(r.row_ids, '|')) AS m(row_id) JOIN settlement_v s ON s.scope = r.scope AND s.row_id = m.row_id WHERE r.row_ids <> ''),
g AS (SELECT scope, txn_id, tier, reason, credit_paise, count(*) FILTER (WHERE kind = 'payment') AS payments, CAST(coalesce(sum(gross_paise) FILTER (WHERE kind = 'payment'), 0) AS BIGINT) AS gross_paise, CAST(-coalesce(sum(fee_paise) FILTER (WHERE kind = 'payment'), 0) AS BIGINT) AS platform_fee_paise,
    CAST(-coalesce(sum(tax_paise) FILTER (WHERE kind = 'payment'), 0) AS BIGINT) AS gst_on_fee_paise, count(*) FILTER (WHERE kind = 'refund') AS refunds, CAST(-coalesce(sum(gross_paise) FILTER (WHERE kind = 'refund'), 0) AS BIGINT) AS refund_paise,
    count(*) FILTER (WHERE kind = 'adjustment') AS adjustments, CAST(coalesce(sum(net_paise) FILTER (WHERE kind = 'adjustment'), 0) AS BIGINT) AS adjustment_paise, CAST(sum(net_paise) AS BIGINT) AS computed_net_paise FROM e GROUP BY ALL)
SELECT *, credit_paise - computed_net_paise AS residual_paise, concat({inr('credit_paise')}, ' = ', payments, ' payments (', {inr('gross_paise')}, ') - platform fee (', {inr('-platform_fee_paise')}, ') - GST on fee (', {inr('-gst_on_fee_paise')}, ')',
    CASE WHEN refunds > 0 THEN concat(' - ', refunds, ' refunds (', {inr('-refund_paise')}, ')') ELSE '' END, CASE WHEN adjustments > 0 THEN concat(' + adjustments (', {inr('adjustment_paise')}, ')') ELSE '' END) AS narrative FROM g""", RV)
def explain_matched(spark, sf_dir):
    run = reconciled(spark, sf_dir)
    return explain.explain_matched(run.results, settlement_of(spark, sf_dir), bank_of(spark, sf_dir))


@query(RESULTS + """, free AS (SELECT s.* FROM settlement_v s WHERE NOT EXISTS (SELECT 1 FROM results_v r, unnest(string_split(r.row_ids, '|')) AS m(row_id) WHERE r.scope = s.scope AND m.row_id = s.row_id))
SELECT r.scope, r.txn_id, r.reason, r.exception_type, a.action AS suggested_action, r.credit_paise - r.debit_paise AS bank_credit_paise, r.narration, r.candidates_considered,
    (SELECT count(*) FROM free f WHERE f.scope = r.scope AND abs(f.settled_on - r.value_date) <= 3) AS unclaimed_rows_near_this_date, (SELECT CAST(coalesce(sum(net_paise), 0) AS BIGINT) FROM free f WHERE f.scope = r.scope AND abs(f.settled_on - r.value_date) <= 3) AS unclaimed_net_paise,
    (SELECT count(*) FROM free f WHERE f.scope = r.scope) AS total_unclaimed_rows FROM results_v r JOIN action_v a ON a.exception_type = r.exception_type WHERE r.row_ids = ''""", RV)
def explain_unmatched(spark, sf_dir):
    run = reconciled(spark, sf_dir)
    return explain.explain_unmatched(run.results, bank_of(spark, sf_dir), settlement_of(spark, sf_dir), run.claims)


LINES_SQL = f"""SELECT r.scope, r.txn_seq, r.txn_id, r.value_date, r.narration, r.credit_paise - r.debit_paise AS amount_paise, {inr('(r.credit_paise - r.debit_paise)')} AS amount, r.tier, r.row_ids <> '' AS matched, CAST(CASE WHEN r.row_ids = '' THEN 0 ELSE len(string_split(r.row_ids, '|')) END AS BIGINT) AS n_rows,
    r.delta_paise, r.confidence, r.reason, r.exception_type, coalesce(a.action, '') AS action FROM results_v r LEFT JOIN action_v a ON a.exception_type = r.exception_type"""


@query(RESULTS + " " + LINES_SQL, RV)
def result_lines(spark, sf_dir):
    return explain.result_lines(reconciled(spark, sf_dir).results, bank_of(spark, sf_dir))


@query(RESULTS + """ SELECT f.which, count(*) AS n FROM (VALUES ('all'), ('matched'), ('exceptions'), ('tier2_fuzzy'), ('orphan_credit')) AS f(which) JOIN results_v r
    ON f.which = 'all' OR (f.which = 'matched' AND row_ids <> '') OR (f.which = 'exceptions' AND row_ids = '') OR f.which = r.tier OR f.which = r.exception_type GROUP BY f.which""", RV)
def line_filter(spark, sf_dir):
    results, out = reconciled(spark, sf_dir).results, None
    for which in ("all", "matched", "exceptions", "tier2_fuzzy", "orphan_credit"):
        one = classify.line_filter(results, which).agg(F.count(F.lit(1)).alias("n")).select(F.lit(which).alias("which"), "n")
        out = one if out is None else out.unionByName(one)
    return out


# -- scoring ----------------------------------------------------------------------------------------------------------------

# Labels with faults: every 11th line expects nothing, every 13th has no label, every 17th expects one row less.
FAULTY = RESULTS + """, label AS (SELECT r.scope, r.txn_id, r.txn_seq, r.tier, r.row_ids, r.exception_type, r.reason, CASE WHEN r.txn_seq % 13 = 0 THEN 'unlabelled' ELSE t.scenario END AS scenario, CASE WHEN r.txn_seq % 13 = 0 THEN NULL ELSE t.expect_exception END AS expect_exception,
    CASE WHEN r.txn_seq % 13 = 0 OR r.txn_seq % 11 = 0 OR t.row_ids = '' THEN [] WHEN r.txn_seq % 17 = 0 THEN string_split(t.row_ids, '|')[2:] ELSE string_split(t.row_ids, '|') END AS expected, CASE WHEN r.row_ids = '' THEN [] ELSE string_split(r.row_ids, '|') END AS got FROM results_v r JOIN truth_v t ON t.scope = r.scope AND t.txn_id = r.txn_id),
judged AS (SELECT *, CASE WHEN row_ids <> '' AND len(expected) > 0 AND list_sort(expected) = list_sort(got) THEN 'correct' WHEN row_ids <> '' THEN 'wrong' WHEN len(expected) > 0 THEN 'missed' ELSE 'correct_exception' END AS verdict FROM label),
cards AS (SELECT scope, count(*) AS bank_lines, count(*) FILTER (WHERE row_ids <> '') AS matched, count(*) FILTER (WHERE verdict = 'correct') AS correct_matches, count(*) FILTER (WHERE verdict = 'wrong') AS wrong_matches, count(*) FILTER (WHERE verdict = 'missed') AS missed_matches, count(*) FILTER (WHERE row_ids = '') AS exceptions,
    count(*) FILTER (WHERE verdict = 'correct_exception') AS correct_exceptions, count(*) FILTER (WHERE verdict = 'correct_exception' AND expect_exception IS NOT NULL) AS typed_total, count(*) FILTER (WHERE verdict = 'correct_exception' AND expect_exception = exception_type) AS typed_correct, count(*) FILTER (WHERE tier IN ('tier1_exact', 'tier2_fuzzy', 'tier3_subset_sum')) AS deterministic
    FROM judged GROUP BY scope)"""
RATE_SQL = """coalesce(CAST(matched AS DOUBLE) / nullif(bank_lines, 0), 0) AS auto_match_rate, coalesce(CAST(correct_matches AS DOUBLE) / nullif(matched, 0), 0) AS precision, coalesce(CAST(wrong_matches AS DOUBLE) / nullif(matched, 0), 0) AS false_match_rate, coalesce(CAST(correct_matches AS DOUBLE) / nullif(correct_matches + wrong_matches + missed_matches, 0), 0) AS recall,
    coalesce(CAST(correct_exceptions AS DOUBLE) / nullif(exceptions, 0), 0) AS exception_precision, coalesce(CAST(typed_correct AS DOUBLE) / nullif(typed_total, 0), 0) AS exception_type_accuracy, coalesce(CAST(deterministic AS DOUBLE) / nullif(bank_lines, 0), 0) AS deterministic_share"""
_counts = ("bank_lines", "matched", "correct_matches", "wrong_matches", "missed_matches", "exceptions", "correct_exceptions", "typed_total", "typed_correct", "deterministic")
TOTAL = ", total AS (SELECT " + ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in _counts) + " FROM cards)"


def judged(spark, sf_dir, faulty=True):
    run, truth = reconciled(spark, sf_dir), truth_of(spark, sf_dir)
    if faulty:
        truth = truth.join(bank_of(spark, sf_dir).select("scope", "txn_id", "txn_seq"), ["scope", "txn_id"]).filter("txn_seq % 13 <> 0")
        e = F.col("expected_row_ids")
        cut = F.when((F.col("txn_seq") % 17 == 0) & (F.size(e) > 0), F.slice(e, F.lit(2), F.greatest(F.size(e) - 1, F.lit(0)))).otherwise(e)
        truth = truth.withColumn("expected_row_ids", F.when(F.col("txn_seq") % 11 == 0, F.array().cast("array<string>")).otherwise(cut)).drop("txn_seq")
    return score.verdicts(run.results, truth)


@query(FAULTY + TOTAL + f" SELECT *, {RATE_SQL} FROM total", RV)
def scorecard(spark, sf_dir):
    return score.scorecard(judged(spark, sf_dir))


@query(FAULTY + f" SELECT *, {RATE_SQL} FROM cards", RV)
def scorecards(spark, sf_dir):
    return score.scorecards(judged(spark, sf_dir))


@query(FAULTY + f", q AS (SELECT *, {RATE_SQL} FROM cards) SELECT " + ", ".join(f"{f}({r}) AS {n}_{r}" for r in score.RATES for n, f in (("min", "min"), ("mean", "avg"), ("max", "max"))) + ", CAST(sum(wrong_matches) AS BIGINT) AS total_wrong, CAST(sum(matched) AS BIGINT) AS total_matched FROM q", RV)
def sweep(spark, sf_dir):
    return score.sweep(judged(spark, sf_dir))


@query(FAULTY + " SELECT scenario, count(*) AS total, count(*) FILTER (WHERE verdict IN ('correct', 'correct_exception')) AS correct, count(*) FILTER (WHERE verdict = 'wrong') AS wrong, count(*) FILTER (WHERE verdict = 'missed') AS missed, CAST(count(*) FILTER (WHERE verdict IN ('correct', 'correct_exception')) AS DOUBLE) / count(*) AS accuracy FROM judged GROUP BY scenario", RV)
def scenario_scores(spark, sf_dir):
    return score.scenario_scores(judged(spark, sf_dir))


@query(FAULTY + " SELECT scope, txn_id, scenario, tier, CAST(len(expected) AS INTEGER) AS expected_rows, CAST(len(got) AS INTEGER) AS matched_rows, CAST(len(list_intersect(got, expected)) AS INTEGER) AS overlap, reason FROM judged WHERE verdict = 'wrong' ORDER BY scope, txn_seq LIMIT 12", RV)
def wrong_examples(spark, sf_dir):
    return score.wrong_examples(judged(spark, sf_dir), bank_of(spark, sf_dir))


# -- audit ------------------------------------------------------------------------------------------------------------------

CHAIN = """, chain AS (WITH RECURSIVE c AS (SELECT chain_id, seq, kind, subject, payload, recorded_at, repeat('0', 64) AS prev_hash, sha256(concat_ws(chr(31), repeat('0', 64), recorded_at, kind, subject, payload)) AS hash FROM entries_v WHERE seq = 1
    UNION ALL SELECT e.chain_id, e.seq, e.kind, e.subject, e.payload, e.recorded_at, c.hash, sha256(concat_ws(chr(31), c.hash, e.recorded_at, e.kind, e.subject, e.payload)) FROM c JOIN entries_v e ON e.chain_id = c.chain_id AND e.seq = c.seq + 1) SELECT * FROM c)"""


def chained(spark, sf_dir):
    return audit.chain_append(view(spark, sf_dir, "entries_v").withColumn("seq", F.col("seq").cast("long")))


@query(CHAIN + " SELECT chain_id, seq, subject, prev_hash, hash FROM chain", ("entries",))
def chain_append(spark, sf_dir):
    return chained(spark, sf_dir).select("chain_id", "seq", "subject", "prev_hash", "hash")


@query(CHAIN + " SELECT chain_id, max(seq) AS entries, arg_max(hash, seq) AS tip FROM chain GROUP BY chain_id", ("entries",))
def chain_tips(spark, sf_dir):
    return audit.chain_tips(chained(spark, sf_dir))


@query(CHAIN + ", bad AS (SELECT *, CASE WHEN seq % 50 = 7 THEN '{}' ELSE payload END AS p2 FROM chain) SELECT chain_id, seq, sha256(concat_ws(chr(31), prev_hash, recorded_at, kind, subject, p2)) AS expected, hash AS found FROM bad WHERE hash <> sha256(concat_ws(chr(31), prev_hash, recorded_at, kind, subject, p2))", ("entries",))
def verify_chain(spark, sf_dir):
    tampered = chained(spark, sf_dir).withColumn("payload", F.when(F.col("seq") % 50 == 7, "{}").otherwise(F.col("payload")))
    return audit.verify_chain(tampered)


PAYLOAD = """concat('{"candidates_considered":', candidates_considered, ',"confidence":', confidence, ',"delta_paise":', delta_paise, ',"exception_type":', CASE WHEN exception_type IS NULL THEN 'null' ELSE concat('"', exception_type, '"') END,
    ',"reason":"', reason, '","rows":', CASE WHEN row_ids = '' THEN '[]' ELSE concat('["', replace(row_ids, '|', '","'), '"]') END, ',"tier":"', tier, '"}')"""


@query(RESULTS + f" SELECT scope, CASE WHEN row_ids = '' THEN 'exception' ELSE 'match' END AS kind, txn_id AS subject, row_number() OVER (PARTITION BY scope ORDER BY txn_seq) AS seq, {PAYLOAD} AS payload FROM results_v", RV)
def audit_records(spark, sf_dir):
    return audit.numbered(audit.audit_records(reconciled(spark, sf_dir).results, bank_of(spark, sf_dir))).select("scope", "kind", "subject", "seq", "payload")


@query(RESULTS + " SELECT scope, txn_id, tier, row_ids, delta_paise, confidence, reason, exception_type, candidates_considered FROM results_v", RV)
def rehydrate(spark, sf_dir):
    return plain(audit.rehydrate(audit.audit_records(reconciled(spark, sf_dir).results, bank_of(spark, sf_dir))))


@query(" SELECT chain_id, seq, subject FROM entries_v WHERE chain_id < 2 ORDER BY seq, chain_id LIMIT 40", ("entries",))
def read_audit(spark, sf_dir):
    path = fresh_path(spark, "audit")
    tables.append_audit(view(spark, sf_dir, "entries_v").filter("chain_id < 2").withColumn("run_id", F.lit("r1")), path)
    tables.append_audit(view(spark, sf_dir, "entries_v").filter("chain_id >= 2").withColumn("run_id", F.lit("r2")), path)
    return tables.read_audit(spark, path, "r1", 40).select("chain_id", "seq", "subject")


@query()
def fingerprint(spark, sf_dir):
    return audit.fingerprint(spark, [f"{sf_dir}/{t}.parquet" for t in ("lineitem", "orders", "absent")], "{}")


@query(" SELECT concat('run_', chain_id) AS run_id, sha256(concat('c', chain_id)) AS fingerprint FROM (SELECT DISTINCT chain_id FROM entries_v) WHERE chain_id % 3 = 0", ("entries",))
def existing_run(spark, sf_dir):
    chains = view(spark, sf_dir, "entries_v").select("chain_id").distinct()
    made = F.sha2(F.concat(F.lit("c"), "chain_id").cast("binary"), 256)
    runs = chains.select(F.concat(F.lit("run_"), "chain_id").alias("run_id"), made.alias("fingerprint"))
    return audit.existing_run(runs, chains.filter("chain_id % 3 = 0").select(made.alias("fingerprint")))


# -- files --------------------------------------------------------------------------------------------------------------------

def _written_dir(spark, sf_dir):
    """The views as CSV files, compressed: as plain text they are several times the size of the tables."""
    path = fresh_path(spark, "input")
    s, b = settlement_of(spark, sf_dir), bank_of(spark, sf_dir)
    files.write_settlement_csv(s, f"{path}/settlement_report.csv", codec="gzip")
    files.write_bank_csv(b, f"{path}/bank_statement.csv", codec="gzip")
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("order_id"), F.to_date("o_orderdate").alias("placed_on"), F.expr("cast(round(o_totalprice * 100) as bigint)").alias("gross_paise"), F.concat(F.lit("cust_"), "o_custkey").alias("customer_id"))
    files.write_orders_csv(orders, f"{path}/orders.csv", codec="gzip")
    return path


@query("SELECT scope, row_id, kind, order_id, gross_paise, fee_paise, tax_paise, net_paise, settled_on, settlement_id, method, utr FROM settlement_v".replace("scope, ", "", 1), ("settlement",))
def read_settlement_csv(spark, sf_dir):
    return files.read_settlement(spark, f"{_written_dir(spark, sf_dir)}/settlement_report.csv")[0].drop("row_seq")


@query("SELECT txn_id, value_date, narration, credit_paise, debit_paise FROM bank_v", ("bank",))
def read_bank_csv(spark, sf_dir):
    return files.read_bank(spark, f"{_written_dir(spark, sf_dir)}/bank_statement.csv")[0].drop("txn_seq")


@query("SELECT CAST(o_orderkey AS VARCHAR) AS order_id, CAST(o_orderdate AS DATE) AS placed_on, CAST(round(o_totalprice * 100) AS BIGINT) AS gross_paise, concat('cust_', o_custkey) AS customer_id FROM orders")
def read_orders_csv(spark, sf_dir):
    return files.read_orders(spark, f"{_written_dir(spark, sf_dir)}/orders.csv")[0]


@query("SELECT 'settlement_report' AS source, count(*) AS rows FROM settlement_v UNION ALL SELECT 'bank_statement', count(*) FROM bank_v UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'quarantine', 0", ("bank",))
def load_directory(spark, sf_dir):
    return files.parse_totals(files.load_directory(spark, _written_dir(spark, sf_dir)))


SPOILT = "CASE o_orderkey % 8 WHEN 0 THEN concat('p', o_orderkey, ',payment,,not-a-number,0,0,2026-01-01,,,') WHEN 1 THEN concat('p', o_orderkey, ',payment,,1.00,0,0,31-02-2026,,,') WHEN 2 THEN 'only,two' WHEN 3 THEN ',,,,,,,,,' WHEN 4 THEN concat('p', o_orderkey, ',Payment,,1.00,0,0,2026-01-01,,,') WHEN 5 THEN concat('p', o_orderkey, ',payment,,,0,0,2026-01-01,,,') WHEN 6 THEN 'same,payment,,1.00,0,0,2026-01-01,,,' ELSE concat('p', o_orderkey, ',payment,,1.00,0,0,2026-01-01,,,') END"


@query("""SELECT 'settlement_report' AS source, reason, count(*) AS n FROM (SELECT CASE o_orderkey % 8 WHEN 0 THEN 'unparseable amount in gross:' WHEN 1 THEN 'unparseable date:' WHEN 2 THEN 'wrong column count' WHEN 3 THEN 'wrong column count' WHEN 4 THEN 'is not a valid kind' WHEN 5 THEN 'unparseable amount:'
    WHEN 6 THEN 'duplicate row_id' END AS reason, row_number() OVER (PARTITION BY o_orderkey % 8 ORDER BY o_orderkey) AS k, o_orderkey % 8 AS m FROM orders) WHERE reason IS NOT NULL AND (m <> 6 OR k > 1) GROUP BY reason""")
def quarantine_by_reason(spark, sf_dir):
    path = fresh_path(spark, "spoilt")
    lines = table(spark, sf_dir, "orders").select(F.expr(SPOILT).alias("value"))
    return files.quarantine_by_reason(files.read_settlement(spark, _spoilt_file(lines, files.SETTLEMENT, path))[1])


def _spoilt_file(lines: DataFrame, header: list[str], path: str) -> str:
    """Records as CSV files, each with the header as its first line."""
    lines.select(F.col("value").alias(",".join(header))).write.option("header", True).option("quote", "").option("escape", "").option("sep", "\u0001").csv(path)
    return path


SPOILT_BANK = "CASE o_orderkey % 7 WHEN 0 THEN ' ,2026-01-01,text,1.00,' WHEN 1 THEN concat('b', o_orderkey, ',2026-01-01,text,abc,') WHEN 2 THEN concat('b', o_orderkey, ',2026-01-01,text,,x1') WHEN 3 THEN concat('b', o_orderkey, ',2026-01-01,text,1.00,2.00') WHEN 4 THEN concat('b', o_orderkey, ',2026-13-45,text,1.00,') WHEN 5 THEN concat('b', o_orderkey, ',,text,1.00,') ELSE concat('b', o_orderkey, ',2026-01-01,text,1.00,') END"
SPOILT_ORDERS = "CASE o_orderkey % 5 WHEN 0 THEN concat(o_orderkey, ',31-02-2026,1.00,c') WHEN 1 THEN concat(o_orderkey, ',2026-01-01,1.0.0,c') WHEN 2 THEN concat(o_orderkey, ',,1.00,c') WHEN 3 THEN concat(o_orderkey, ',2026-01-01') ELSE concat(o_orderkey, ',2026-01-01,1.00,c') END"


@query("""SELECT 'bank_statement' AS source, reason, count(*) AS n FROM (SELECT CASE o_orderkey % 7 WHEN 0 THEN 'missing txn_id' WHEN 1 THEN 'unparseable amount in credit:' WHEN 2 THEN 'unparseable amount in debit:' WHEN 3 THEN 'row has both credit and debit' WHEN 4 THEN 'unparseable date:' WHEN 5 THEN 'empty date' END AS reason FROM orders) WHERE reason IS NOT NULL GROUP BY reason
UNION ALL SELECT 'orders', reason, count(*) FROM (SELECT CASE o_orderkey % 5 WHEN 0 THEN 'unparseable date:' WHEN 1 THEN 'unparseable amount in gross:' WHEN 2 THEN 'empty date' WHEN 3 THEN 'wrong column count' END AS reason FROM orders) WHERE reason IS NOT NULL GROUP BY reason""")
def quarantine_bank_orders(spark, sf_dir):
    path, orders = fresh_path(spark, "spoilt"), table(spark, sf_dir, "orders")
    bank = files.read_bank(spark, _spoilt_file(orders.select(F.expr(SPOILT_BANK).alias("value")), files.BANK, f"{path}/bank"))[1]
    bad = files.read_orders(spark, _spoilt_file(orders.select(F.expr(SPOILT_ORDERS).alias("value")), files.ORDERS, f"{path}/orders"))[1]
    return files.quarantine_by_reason(bank.unionByName(bad))


@query("""SELECT 'orders' AS source, raw, reason FROM (SELECT CASE o_orderkey % 5 WHEN 0 THEN concat(o_orderkey, ',31-02-2026,1.00,c') WHEN 1 THEN concat(o_orderkey, ',2026-01-01,1.0.0,c') WHEN 2 THEN concat(o_orderkey, ',,1.00,c') WHEN 3 THEN concat(o_orderkey, ',2026-01-01') END AS raw,
    CASE o_orderkey % 5 WHEN 0 THEN concat('unparseable date: ', chr(39), '31-02-2026', chr(39)) WHEN 1 THEN concat('unparseable amount in gross: ', chr(39), '1.0.0', chr(39)) WHEN 2 THEN 'empty date' WHEN 3 THEN 'wrong column count' END AS reason FROM orders) WHERE reason IS NOT NULL""")
def write_quarantine(spark, sf_dir):
    path = fresh_path(spark, "quarantine")
    lines = table(spark, sf_dir, "orders").select(F.expr(SPOILT_ORDERS).alias("value"))
    tables.write_quarantine(files.read_orders(spark, _spoilt_file(lines, files.ORDERS, f"{path}/in"))[1], f"{path}/out")
    return spark.read.parquet(f"{path}/out").select("source", "raw", "reason")


LABELS = 1000


@query("SELECT txn_id, scenario, row_ids, expect_exception FROM truth_v", RV)
def read_truth_json(spark, sf_dir):
    path = fresh_path(spark, "truth")
    entry = F.struct("txn_id", "scenario", "expected_row_ids", "expect_exception", F.lit("").alias("note"))
    # A document holds some of the labels: about LABELS of them, whatever the size of the table.
    truth = truth_of(spark, sf_dir)
    parts = truth.count() // LABELS + 1
    truth.groupBy(F.pmod(F.xxhash64("scope", "txn_id"), F.lit(parts)).alias("part")).agg(F.collect_list(entry).alias("entries")).write.partitionBy("part").json(path)
    return files.read_truth(spark, f"{path}/*").select("txn_id", "scenario", F.array_join("expected_row_ids", "|").alias("row_ids"), "expect_exception")


@query(DRIFT + " SELECT scope, row_id, excess_paise FROM flag", ("settlement",))
def write_drift(spark, sf_dir):
    path = fresh_path(spark, "drift")
    tables.write_drift(drift.detect_fee_drift(settlement_of(spark, sf_dir)), path)
    return spark.read.parquet(path).select(F.col("scope").cast("long").alias("scope"), "row_id", "excess_paise")


@query(RESULTS + " SELECT tier, count(*) AS n, CAST(sum(delta_paise) AS BIGINT) AS delta FROM results_v GROUP BY tier", RV)
def write_results(spark, sf_dir):
    path = fresh_path(spark, "results")
    tables.write_results(reconciled(spark, sf_dir).results, bank_of(spark, sf_dir), path)
    return spark.read.parquet(path).groupBy("tier").agg(F.count(F.lit(1)).alias("n"), F.sum("delta_paise").alias("delta"))


@query(DRIFT + " SELECT row_id FROM flag", ("settlement",))
def read_truth_drift(spark, sf_dir):
    path = fresh_path(spark, "truth")
    flagged = drift.detect_fee_drift(settlement_of(spark, sf_dir))
    parts = flagged.count() // LABELS + 1
    made = flagged.groupBy(F.pmod(F.xxhash64("row_id"), F.lit(parts)).alias("part")).agg(F.collect_list("row_id").alias("fee_drift_row_ids"))
    made.write.partitionBy("part").json(path)
    return files.read_truth_drift(spark, f"{path}/*")


@query(RESULTS + """ SELECT 'r1' AS run_id, 'f1' AS fingerprint, 'started' AS started_at, 'finished' AS finished_at, count(*) AS bank_lines, count(*) FILTER (WHERE row_ids <> '') AS matched, count(*) FILTER (WHERE row_ids = '') AS exceptions FROM results_v""", RV)
def finished_runs(spark, sf_dir):
    """A run is started, started again with the same inputs (the earlier one is returned), and finished."""
    path, run = fresh_path(spark, "runs"), reconciled(spark, sf_dir)
    first = tables.start_run(spark, path, "r1", "f1", "{}", "started")
    again = tables.start_run(spark, path, "r2", "f1", "{}", "later")
    if (first, again) != ("r1", "r1"):
        raise RuntimeError("a run with the same fingerprint was started twice")
    summary = score.run_summary(run.results, settlement_of(spark, sf_dir), bank_of(spark, sf_dir))
    tables.finish_run(path, "r1", summary, "finished")
    return tables.runs(spark, path).select("run_id", "fingerprint", "started_at", "finished_at", "bank_lines", "matched", "exceptions")


@query(RESULTS + " SELECT scope, txn_id, row_number() OVER (PARTITION BY scope ORDER BY txn_seq) AS position, tier FROM results_v", RV)
def result_positions(spark, sf_dir):
    path = fresh_path(spark, "results")
    tables.write_results(reconciled(spark, sf_dir).results, bank_of(spark, sf_dir), path)
    return spark.read.parquet(path).select(F.col("scope").cast("long").alias("scope"), "txn_id", "position", "tier")


@query(RESULTS + """, quarantine_v AS (SELECT scope, count(*) AS bad FROM settlement_v WHERE row_seq % 11 = 0 GROUP BY scope)
SELECT r.scope, r.position, r.txn_id, r.tier, r.delta_paise, r.reason, coalesce(q.bad, 0) + r.position AS seq FROM (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY txn_seq) AS position FROM results_v) r LEFT JOIN quarantine_v q ON q.scope = r.scope""", RV)
def directory_run(spark, sf_dir):
    """The views as a directory of files, every eleventh row twice: parsed, reconciled and logged; a second call finds the run and writes nothing."""
    path, store = fresh_path(spark, "input"), fresh_path(spark, "store")
    s = settlement_of(spark, sf_dir)
    twice = s.unionByName(s.filter("row_seq % 11 = 0").withColumn("row_seq", F.col("row_seq") + 1_000_000_000_000))
    files.write_settlement_csv(twice.orderBy("row_seq", "scope"), f"{path}/settlement_report.csv", scoped=True)
    files.write_bank_csv(bank_of(spark, sf_dir).orderBy("txn_seq", "scope"), f"{path}/bank_statement.csv", scoped=True)
    runs = [reconcile_directory(spark, path, store, run, at) for run, at in (("first", "2026-01-01"), ("second", "2026-01-02"))]
    if runs != [("first", True), ("first", False)]:
        raise RuntimeError(f"the same files were run twice: {runs}")
    lines = read_store(spark, store, "results").select("scope", "position", "txn_id", "tier", "delta_paise", "reason")
    log = read_store(spark, store, "audit").filter("kind <> 'quarantine'").select("scope", F.col("subject").alias("txn_id"), "seq")
    return lines.join(log, ["scope", "txn_id"])
