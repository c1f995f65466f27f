"""The third tier: arithmetic on named batches, then on day pools, for all lines at once and yet in statement order.

All lines are first judged on what is free when the pass begins. Those with exactly one way to their credit take
its rows; lines after them that can see one of these rows (their named batch, a pool in their window) are judged
again on what is then left, and so on until no row changes hands. What a line sees depends on earlier lines only, so
the outcome is that of going through the lines one by one; the number of rounds is the length of the longest
chain of lines that change each other's outcome, over all scopes at the same time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ledgerweave.config import ReconcileConfig
from ledgerweave.storage import counted, cut

from .anchored import MEMBERS, anchored_candidates, less_taken, unseen
from .index import day_pools_in_window
from .pools import MASK_RISK, MASK_ROWS, near_pools, nearest_first, with_rows_of

LINE = ["scope", "txn_id"]
#: Candidates, and a row without strategy for each line that is declined.
FOUND = [*LINE, "txn_seq", "strategy", "settlement_id", "low", "high", "days", "members", "lag", "risk", "n_rows", "wins", "declined"]


def pool_totals(loose: DataFrame) -> DataFrame:
    """scope, settled_on, n, net, plus of rows without a batch."""
    return loose.groupBy("scope", "settled_on").agg(F.expr("count(1) AS n"), F.expr("sum(net_paise) AS net"), F.expr("sum(greatest(net_paise, 0)) AS plus"))


def judged(lines: DataFrame, named: DataFrame, groups: DataFrame, rows: DataFrame, pools: DataFrame, loose: DataFrame, config: ReconcileConfig, guess: DataFrame | None, gone: DataFrame | None) -> DataFrame:
    """FOUND of the lines, each with what earlier lines take by guess off what it sees."""
    mine = named.join(lines.select(*LINE), LINE, "left_semi")
    anchored = cut(anchored_candidates(mine, groups, rows, config, guess, gone), "anchored")
    rest = lines.join(anchored.filter("strategy is not null").select(*LINE), LINE, "left_anti")
    with_rows = with_rows_of(loose, lambda found: unseen(found, gone))
    near = day_pools_in_window(rest.select(*LINE, "txn_seq", "credit_paise", "value_date"), pools, config.date_window_days)
    near = less_taken(near, [*LINE, "settled_on"], ["scope", "settled_on"], {"n": "one", "net": "net_paise", "plus": "plus"}, guess).filter("n > 0")
    near = cut(near_pools(near.withColumnRenamed("settled_on", "day"), with_rows, config), "near-pools")
    shape = lambda strategy, batch, days, members, lag, risk, n, declined: [
        *LINE, "txn_seq", f"{strategy} AS strategy", f"{batch} AS settlement_id", f"{'low' if batch == 'settlement_id' else 'CAST(null AS STRING)'} AS low",
        f"{'high' if batch == 'settlement_id' else 'CAST(null AS STRING)'} AS high", f"{days} AS days", f"{members} AS members", f"{lag} AS lag", f"{risk} AS risk", f"{n} AS n_rows", f"{declined} AS declined",
    ]
    first = anchored.selectExpr(*shape("strategy", "settlement_id", "CAST(null AS array<date>)", "members", "lag", "risk", "n_rows", "declined"))
    whole = near.filter("place = 1 and size(hits) > 0").selectExpr("*", "explode(hits) AS mask")
    no_batch, no_rows = "CAST(null AS STRING)", f"CAST(null AS {MEMBERS})"
    whole = whole.selectExpr(*shape("'whole settle-date groups'", no_batch, "transform(mask, d -> m[d].day)", no_rows, "-array_max(mask)", MASK_RISK, MASK_ROWS, "false"))
    one_day = nearest_first(near, with_rows, config).filter("strategy is not null or declined")
    one_day = one_day.selectExpr(*shape("strategy", no_batch, "array(day)", "members", "lag", "risk", "CAST(size(members) AS BIGINT)", "declined"))
    both = first.unionByName(whole).unionByName(one_day)
    return both.selectExpr("*", "strategy is not null AND count(strategy) OVER (PARTITION BY scope, txn_id) = 1 AS wins").select(*FOUND)


def rows_of(found: DataFrame, rows: DataFrame, loose: DataFrame, gone: DataFrame | None) -> DataFrame:
    """found and the rows of its candidates: row_id, net_paise, of (settlement_id) or day."""
    base = [c for c in found.columns if c not in ("members", "low", "high", "days")]
    listed = found.filter("members is not null").selectExpr(*base, "days[0] AS day", "inline(members)")
    found = found.filter("members is null and strategy is not null")
    batch = found.filter("settlement_id is not null").join(rows.select("scope", "settlement_id", "row_id", "net_paise"), ["scope", "settlement_id"])
    batch = batch.filter("(low is null or row_id >= low) and (high is null or row_id <= high)").selectExpr(*base, "CAST(null AS DATE) AS day", "row_id", "net_paise")
    pool = found.filter("settlement_id is null").selectExpr(*base, "explode(days) AS day").join(loose.selectExpr("scope", "settled_on AS day", "row_id", "net_paise"), ["scope", "day"])
    return listed.unionByName(unseen(batch.unionByName(pool.select(*base, "day", "row_id", "net_paise")), gone))


def taken_by(found: DataFrame, rows: DataFrame, loose: DataFrame, gone: DataFrame | None) -> DataFrame:
    """A row that a winning line takes: scope, row_id, seq (the line's), txn_id, settlement_id, settled_on, net_paise, one, plus."""
    won = rows_of(found.filter("wins"), rows, loose, gone)
    return won.selectExpr("scope", "row_id", "txn_seq AS seq", "txn_id", "settlement_id", "day AS settled_on", "net_paise", "1L AS one", "greatest(net_paise, 0) AS plus")


def who_sees(changed: DataFrame, lines: DataFrame, named: DataFrame, window: int, later: bool) -> DataFrame:
    """lines that can see one of the changed rows (as of taken_by), and stand after (later) or before its taker."""
    edge, beyond = ("min", "txn_seq > seq") if later else ("max", "txn_seq < seq")
    touched = changed.groupBy("scope", "settlement_id", "settled_on").agg(F.expr(f"{edge}(seq) AS seq"))
    by_batch = named.join(touched.filter("settlement_id is not null").select("scope", "settlement_id", "seq"), ["scope", "settlement_id"]).filter(beyond)
    spread = touched.filter("settlement_id is null").selectExpr("scope", "seq", f"explode(sequence(date_sub(settled_on, {window}), date_add(settled_on, {window}))) AS value_date")
    by_day = lines.join(spread.groupBy("scope", "value_date").agg(F.expr(f"{edge}(seq) AS seq")), ["scope", "value_date"]).filter(beyond)
    return lines.join(by_batch.select(*LINE).unionByName(by_day.select(*LINE)), LINE, "left_semi")


def arithmetic_pass(asked: DataFrame, before: DataFrame | None, lines: DataFrame, named: DataFrame, groups: DataFrame, rows: DataFrame, pools: DataFrame, loose: DataFrame, drawn: DataFrame | None, config: ReconcileConfig) -> tuple[DataFrame, DataFrame, int]:
    """One pass in statement order over open lines: FOUND of all of them, the rows that the winners take (taken_by), and how many win.

    asked: the lines to judge; the others keep their candidates of the pass before. named, groups, rows: named
    batches in the window, their totals and rows; pools, loose: the same of rows without a batch; drawn: rows taken in earlier passes.
    """
    none = drawn if drawn is None else drawn.withColumn("seq", F.lit(-1).cast("long"))
    wins, key = F.expr("count_if(wins) AS wins"), ["scope", "row_id", "seq"]
    seen, found = Observation(), judged(asked, named, groups, rows, pools, loose, config, None, none)
    if before is not None:
        found = before.join(asked.select(*LINE), LINE, "left_anti").unionByName(found)
    found = cut(found.observe(seen, wins), "found")
    guess = changed = cut(taken_by(found, rows, loose, none), "taken") if seen.get["wins"] else taken_by(found, rows, loose, none)
    while seen.get["wins"]:
        again, n = counted(who_sees(changed, lines, named, config.date_window_days, later=True), "again")
        if not n:
            break
        gone = guess if none is None else guess.unionByName(none)
        redone = judged(again, named, groups, rows, pools, loose, config, guess, gone)
        seen = Observation()
        found = cut(found.join(again.select(*LINE), LINE, "left_anti").unionByName(redone).observe(seen, wins), "found")
        new = cut(taken_by(found, rows, loose, gone), "taken")
        changed = new.join(guess.select(*key), key, "left_anti").unionByName(guess.join(new.select(*key), key, "left_anti"))
        guess = new
    return found, guess, seen.get["wins"]
