"""The cascade: passes of three tiers over all lines until nothing changes, then choice, then typed exceptions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerweave.config import ADJUDICATED, ARITHMETIC, CONFIDENCE, EXACT, FUZZY, REASONS, ReconcileConfig
from ledgerweave.functions.scalar import reason_text
from ledgerweave.operators import adjudicate as choose
from ledgerweave.operators import arithmetic, classify, tiers
from ledgerweave.operators.index import CLAIMS, settlement_groups, split_lines, utr_map
from ledgerweave.storage import counted, cut

MATCH = "scope long, txn_id string, tier string, delta_paise long, confidence double, reason string, candidates_considered long"
TAKEN = "scope long, row_id string, seq long, txn_id string, settlement_id string, settled_on date, net_paise long, one long, plus long"
WHOLE = "scope long, txn_id string, txn_seq long, settlement_id string, delta long, tier string, round int"


@dataclass
class Reconciliation:
    """results: one row for each bank line. claims: one for each matched settlement row. escalated: lines that were offered to the policy."""

    results: DataFrame
    claims: DataFrame
    escalated: DataFrame


def _union(parts: list[DataFrame], spark, schema: str) -> DataFrame:
    out = parts[0] if parts else spark.createDataFrame([], schema)
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _without(df: DataFrame, other: DataFrame | None, key: list[str]) -> DataFrame:
    return df if other is None else df.join(other.select(*key), key, "left_anti")


def reconcile(settlement: DataFrame, bank: DataFrame, config: ReconcileConfig = ReconcileConfig(), policy: choose.Policy = choose.rank_candidates) -> Reconciliation:
    """settlement: scope, row_id, row_seq, net_paise, settled_on, settlement_id, utr. bank: scope, txn_id, txn_seq,
    value_date, narration, credit_paise, debit_paise. row_id and txn_id are unique in a scope.

    Turns over the three tiers go on until one claims nothing. The first looks at all lines; later ones only derive
    edges again for batches that changed in the turn before, and only judge lines again that can see a row that did.
    """
    spark = settlement.sparkSession
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long").alias("candidates_considered")
    # One write; rows without a batch lie apart, so that they are found by their folder.
    settlement = settlement.select("scope", "row_id", "row_seq", "net_paise", "settled_on", "settlement_id", "utr", F.col("settlement_id").isNull().alias("is_loose"))
    settlement = cut(settlement, "settlement", "is_loose")
    loose = settlement.filter("is_loose").select("scope", "row_id", "row_seq", "net_paise", "settled_on")
    bank = cut(bank.select("scope", "txn_id", "txn_seq", "value_date", "narration", "credit_paise", "debit_paise"), "bank")
    lines, other = split_lines(bank)
    line, batch, row = ["scope", "txn_id"], ["scope", "settlement_id"], ["scope", "row_id"]
    groups = cut(settlement_groups(settlement.filter("not is_loose")), "batches")
    named = tiers.named_in_window(lines, utr_map(settlement.filter("not is_loose")), groups.select(*batch, "group_day"), config.date_window_days)
    named = cut(named.select(*line, "txn_seq", "credit_paise", "utr_pos", "settlement_id", "lag"), "named")
    open_, pools = lines, arithmetic.pool_totals(loose)
    edges: dict[str, DataFrame] = {}
    won, drawn, matches, declined = [], [], [], []  # whole batches, single rows, matches, lines whose pools were too large
    taken_none = spark.createDataFrame([], TAKEN)
    found = rows = changed = fresh = None  # changed: batches; fresh: rows, both since the turn before
    turn = 0

    def batch_pass(tier: str) -> tuple[DataFrame, bool]:
        """Claims of whole batches in one pass, and whether there are any; edges of open lines are kept for the next."""
        derive = (lambda n, l, g: tiers.exact_edges(n, g)) if tier == EXACT else (lambda n, l, g: tiers.fuzzy_edges(l, g, config, few_groups=turn > 1))  # noqa: E731, E741
        if turn == 1:
            mine = derive(named.join(open_.select(*line), line, "left_semi"), open_, groups)
        else:
            again = groups.join(changed, batch, "left_semi")
            seen = named.join(changed, batch, "left_semi").join(open_.select(*line), line, "left_semi")
            mine = edges[tier].join(changed, batch, "left_anti").join(open_.select(*line), line, "left_semi").unionByName(derive(seen, open_, again))
        done, any_won = tiers.claimed(mine)
        edges[tier] = done.filter("not wins").drop("wins")
        return done.filter("wins").selectExpr(*line, "txn_seq", "settlement_id", "delta", f"'{tier}' AS tier", f"{turn} AS round"), any_won

    while True:
        turn += 1
        claimed = []
        for tier in (EXACT, FUZZY):
            now, any_won = batch_pass(tier)
            if any_won:
                claimed.append(now)
                open_, groups = open_.join(now, line, "left_anti"), groups.join(now, batch, "left_anti")
                edges[EXACT] = edges[EXACT].join(now, line, "left_anti").join(now, batch, "left_anti")
                edges[tier] = edges[tier].join(now, batch, "left_anti")
                changed = now.select(*batch) if changed is None else changed.unionByName(now.select(*batch))
        now = _union(claimed, spark, WHOLE)
        if claimed:
            open_ = cut(open_, "open")
        mine = named.join(open_.select(*line), line, "left_semi").join(groups.select(*batch), batch, "left_semi")
        if turn == 1:
            rows = settlement.filter("not is_loose").join(mine.select(*batch).distinct(), batch, "left_semi")
            rows, asked, n_asked = cut(rows.select("scope", "settlement_id", "row_id", "net_paise"), "part-rows"), open_, 1
        else:
            asked = arithmetic.who_sees(fresh, open_, mine, config.date_window_days, later=False)
            if claimed:  # a line that names a batch which is claimed as a whole sees less, too
                asked = asked.unionByName(open_.join(named.join(now, batch, "left_semi").select(*line), line, "left_semi")).distinct()
                found = found.join(open_.select(*line), line, "left_semi")
            asked, n_asked = counted(asked, "asked")
        n_won = 0
        if n_asked:
            before = _union(drawn, spark, "") if drawn else None
            found, taken, n_won = arithmetic.arithmetic_pass(asked, found, open_, mine, groups, rows, pools, loose, before, config)
            declined.append(found.filter("declined").select(*line))
        if not claimed and not n_won:
            break
        won.append(now)
        drawn.append(taken if n_won else taken_none)
        reason = F.when(F.col("tier") == EXACT, REASONS["exact"]).otherwise(REASONS["fuzzy"])
        sure = F.when(F.col("tier") == EXACT, CONFIDENCE[EXACT]).otherwise(CONFIDENCE[FUZZY])
        if claimed:
            matches.append(now.select(*line, "tier", F.col("delta").alias("delta_paise"), sure.alias("confidence"), reason_text(reason, F.lit(0.0), F.col("delta")).alias("reason"), one))
        fresh, changed = drawn[-1], now.select(*batch).unionByName(drawn[-1].filter("settlement_id is not null").select(*batch)).distinct()
        if n_won:
            made = found.filter("wins")
            matches.append(made.select(*line, F.lit(ARITHMETIC).alias("tier"), zero.alias("delta_paise"), F.lit(CONFIDENCE[ARITHMETIC]).alias("confidence"), reason_text(F.col("strategy"), F.col("risk"), zero).alias("reason"), one))
            open_ = cut(open_.join(made, line, "left_anti"), "open")
            edges, found = {t: e.join(made, line, "left_anti") for t, e in edges.items()}, found.filter("not wins")
            off = taken.groupBy("scope", "settlement_id", "settled_on").agg(F.expr("sum(one) AS t_n"), F.expr("sum(net_paise) AS t_net"), F.expr("sum(plus) AS t_plus"))
            less = lambda c: f"{c} - coalesce(t_{c}, 0) AS {c}"
            groups = groups.join(off.filter("settlement_id is not null").drop("settled_on"), batch, "left").selectExpr(*batch, "group_day", less("n"), less("net")).filter("n > 0")
            pools = pools.join(off.filter("settlement_id is null").drop("settlement_id"), ["scope", "settled_on"], "left").selectExpr("scope", "settled_on", *map(less, ("n", "net", "plus"))).filter("n > 0")
            pools = cut(pools, "pools")
        groups = cut(groups, "groups")

    # Nothing moved in the last turn, so its candidates hold as they are.
    before = None if not drawn else _union(drawn, spark, "")
    whole = edges[EXACT].withColumn("of", F.lit(0)).unionByName(edges[FUZZY].withColumn("of", F.lit(1)))
    whole = whole.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))))
    batch_rows = _without(settlement.join(whole.select(*batch).distinct(), batch, "left_semi"), before, row).groupBy(*batch)
    batch_rows = batch_rows.agg(F.sort_array(F.collect_list("row_id")).alias("row_ids"))
    name = F.concat_ws("|", F.col("of").cast("string"), "settlement_id", F.col("copy").cast("string")).alias("name")
    whole = whole.join(batch_rows, batch).select(*line, "txn_seq", name, "row_ids", "delta", "lag")
    ways = found.filter("strategy is not null").withColumn("name", F.concat_ws("|", F.lit("2"), "strategy", F.to_json(F.struct("settlement_id", "days", "members", "low", "high"))))
    ways = ways.withColumn("way", F.row_number().over(choose.Window.partitionBy(*line).orderBy("name")))
    gone = None if before is None else before.withColumn("seq", F.lit(-1).cast("long"))
    single = arithmetic.rows_of(ways, rows, loose, gone).groupBy(*line, "txn_seq", "name", "way", "lag").agg(F.sort_array(F.collect_list("row_id")).alias("row_ids"))
    single = single.select(*line, "txn_seq", F.concat("name", F.lit("|"), "way").alias("name"), "row_ids", zero.alias("delta"), "lag")
    number = F.row_number().over(choose.Window.partitionBy(*line).orderBy("name")).alias("cand_no")
    candidates = whole.unionByName(single).select(*line, "txn_seq", number, "row_ids", "delta", "lag", F.size("row_ids").cast("long").alias("n_rows"))
    candidates = cut(candidates, "candidates")
    pending_n = candidates.groupBy(*line).agg(F.count(F.lit(1)).alias("n_pending"))

    whole_claims = [_without(settlement.select(*batch, "row_id").join(w.select(*batch, "txn_id", "tier", "round"), batch), before, row) for w in won[:1]]
    for k, w in enumerate(won[1:], start=1):
        whole_claims.append(_without(settlement.select(*batch, "row_id").join(w.select(*batch, "txn_id", "tier", "round"), batch), _union(drawn[:k], spark, ""), row))
    claims = [c.select(*row, "txn_id", "tier", "round") for c in whole_claims]
    claims += [t.select(*row, "txn_id", F.lit(ARITHMETIC).alias("tier"), F.lit(k + 1).alias("round")) for k, t in enumerate(drawn)]
    escalated = candidates.limit(0).select(*line, "cand_no")
    if config.adjudicate:
        decided, picked = choose.adjudicate(candidates, policy)
        escalated = decided.select(*line, "cand_no")
        chosen = decided.filter("row_ids is not null").select(
            *line, F.lit(ADJUDICATED).alias("tier"), F.col("delta").alias("delta_paise"), "confidence", "reason", F.col("n_candidates").cast("long").alias("candidates_considered")
        )
        matches.append(chosen)
        open_ = open_.join(chosen, line, "left_anti")
        claims.append(picked.select(*row, "txn_id", F.lit(ADJUDICATED).alias("tier"), F.lit(turn).alias("round")))

    all_claims = cut(_union(claims, spark, CLAIMS), "claims")
    matched = _union(matches, spark, MATCH)
    members = all_claims.groupBy(*line).agg(F.sort_array(F.collect_list("row_id")).alias("row_ids"))
    matched = matched.join(members, line).withColumn("exception_type", F.lit(None).cast("string")).select(*classify.RESULT)
    held = settlement.groupBy("scope").agg(F.count(F.lit(1)).alias("n")).join(all_claims.groupBy("scope").agg(F.count(F.lit(1)).alias("gone")), "scope", "left")
    left = held.filter("n > coalesce(gone, 0)").select("scope", F.lit(True).alias("rows_left"))
    unsure = _union(declined, spark, "scope long, txn_id string").distinct().withColumn("declined", F.lit(True))
    rest = open_.withColumn("is_credit", F.lit(True)).unionByName(other.withColumn("is_credit", F.lit(False)))
    rest = rest.join(pending_n, line, "left").join(unsure, line, "left").join(left, "scope", "left")
    rest = rest.select(*line, "is_credit", "narration", *(F.coalesce(c, F.lit(d)).alias(c) for c, d in (("n_pending", 0), ("declined", False), ("rows_left", False))))
    results = matched.unionByName(classify.classify_exceptions(rest, config.gateway_tokens))
    return Reconciliation(cut(results, "results"), all_claims, escalated)


def deterministic_only(settlement: DataFrame, bank: DataFrame, config: ReconcileConfig = ReconcileConfig()) -> Reconciliation:
    """The cascade without any choice between candidates."""
    from dataclasses import replace

    return reconcile(settlement, bank, replace(config, adjudicate=False))
