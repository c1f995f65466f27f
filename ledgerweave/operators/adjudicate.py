"""Choosing between candidates: the offline policy, closed lists for an outside decider, and checks of its replies."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ledgerweave.config import REASONS
from ledgerweave.storage import cut

#: A candidate must cost less than this share of the next one's cost.
DOMINANCE = 0.75
KEY = ["scope", "txn_id"]


def rank_candidates(candidates: DataFrame) -> DataFrame:
    """scope, txn_id, cand_no (null: abstained), confidence, reason, n_candidates; one row a line.

    candidates: scope, txn_id, cand_no, delta, lag, n_rows. Ordered by |delta|, |lag|, most rows, number.
    """
    order = Window.partitionBy(*KEY).orderBy(F.abs("delta"), F.abs("lag"), F.desc("n_rows"), "cand_no")
    cost = F.abs("delta") + 100 * F.abs("lag")
    ranked = candidates.select(
        *KEY, "cand_no", cost.alias("cost"), F.lead(cost).over(order).alias("next_cost"), F.row_number().over(order).alias("place"),
        F.count(F.lit(1)).over(Window.partitionBy(*KEY)).alias("n_candidates"),
    ).filter("place = 1")
    sole = F.col("n_candidates") == 1
    closer = (F.col("next_cost") > 0) & (F.col("cost") < DOMINANCE * F.col("next_cost"))
    return ranked.select(
        *KEY, F.when(sole | closer, F.col("cand_no")).alias("cand_no"),
        F.when(sole, 0.80).when(closer, 0.72).otherwise(0.0).alias("confidence"),
        F.when(sole, REASONS["sole"]).when(closer, REASONS["closer"]).otherwise(REASONS["equal"]).alias("reason"), "n_candidates",
    )


Policy = Callable[[DataFrame], DataFrame]


def adjudicate(candidates: DataFrame, policy: Policy = rank_candidates) -> tuple[DataFrame, DataFrame]:
    """Decisions of a policy in statement order, and the rows they claim.

    candidates: a written table scope, txn_id, txn_seq, cand_no, row_ids, delta, lag, n_rows; none of the rows is claimed yet.
    A chosen candidate's rows spoil the candidates of later lines that hold one of them; a line whose candidates
    are all spoilt gets no decision. All lines are decided at once, then those again whose spoilt candidates change
    by the decisions of earlier lines, until none do. A line that only shares rows with others costs no round: the
    number of rounds is the length of the longest chain of lines that change each other's decision.
    """
    shape = candidates.select(*KEY, "cand_no", "row_ids", "delta")
    rows = candidates.select(*KEY, "txn_seq", "cand_no", F.explode("row_ids").alias("row_id"))

    def decide(live: DataFrame) -> DataFrame:
        chosen = policy(live).join(shape, [*KEY, "cand_no"], "left")
        return chosen.select(*KEY, "cand_no", "confidence", "reason", "n_candidates", "row_ids", "delta")

    decided, spoilt = cut(decide(candidates), "decisions"), candidates.select(*KEY, "cand_no").limit(0)
    while True:
        taken = rows.join(decided.filter("row_ids is not null").select(*KEY, "cand_no"), [*KEY, "cand_no"], "left_semi").groupBy("scope", "row_id").agg(F.min("txn_seq").alias("taker"))
        now = rows.join(taken, ["scope", "row_id"]).filter("taker < txn_seq").select(*KEY, "cand_no", F.lit(True).alias("now")).distinct()
        seen = Observation()
        both = now.join(spoilt.select(*KEY, "cand_no", F.lit(True).alias("was")), [*KEY, "cand_no"], "full")
        both = cut(both.observe(seen, F.count_if(F.col("now").isNull() | F.col("was").isNull()).alias("n")), "spoilt")
        if not seen.get["n"]:
            break
        again, spoilt = both.filter("now is null or was is null").select(*KEY).distinct(), both.filter("now").select(*KEY, "cand_no")
        live = candidates.join(again, KEY, "left_semi").join(spoilt, [*KEY, "cand_no"], "left_anti")
        decided = cut(decided.join(again, KEY, "left_anti").unionByName(decide(live)), "decisions")
    return decided, decided.filter("row_ids is not null").select("scope", "txn_id", F.explode("row_ids").alias("row_id"))


def adjudication_requests(candidates: DataFrame, bank: DataFrame) -> DataFrame:
    """scope, txn_id, request: the closed list of each line as JSON for an outside decider."""
    one = F.struct("cand_no", F.format_string("cand_%05d", "cand_no").alias("candidate_id"), F.col("n_rows").alias("row_count"), F.col("delta").alias("delta_paise"), F.col("lag").alias("date_lag_days"))
    listed = candidates.groupBy(*KEY).agg(F.sort_array(F.collect_list(one)).alias("candidates"))
    view = F.transform("candidates", lambda c: c.dropFields("cand_no"))
    credit = F.struct("txn_id", F.col("value_date").cast("string").alias("value_date"), "narration", F.col("credit_paise").alias("amount_paise"))
    joined = listed.join(bank, KEY)
    return joined.select(*KEY, F.to_json(F.struct(credit.alias("bank_credit"), view.alias("candidates"))).alias("request"))


def validate_replies(replies: DataFrame, allowed: Column) -> DataFrame:
    """replies (with `raw`, the reply's text) and chosen, confidence, reason, degraded. allowed: array of valid ids.

    Code fences are cut off. Broken JSON, an id that is no string and an id that isn't on the list abstain and
    count as degraded. A confidence that is no number is 0; others are cut to 0..1. Reasons are cut at 400.
    """
    bare = F.trim(F.regexp_replace(F.regexp_replace(F.trim("raw"), r"^```(json)?", ""), r"```$", ""))
    v = F.try_parse_json(bare)
    field = lambda name, kind: F.try_variant_get(v, f"$.{name}", kind)
    id_kind = F.schema_of_variant(F.variant_get(v, "$.candidate_id", "variant"))
    chosen = field("candidate_id", "string")
    broken = v.isNull()
    null_id = F.coalesce(id_kind == "VOID", F.lit(True))
    wrong_kind = ~null_id & (id_kind != "STRING")
    unknown = ~null_id & ~wrong_kind & ~F.array_contains(allowed, chosen)
    good = ~broken & ~wrong_kind & ~unknown
    confidence = F.coalesce(F.expr("try_cast(c_text as double)"), F.lit(0.0))
    out = replies.withColumn("c_text", field("confidence", "string"))
    return out.select(
        *replies.columns, F.when(good, chosen).alias("chosen"), F.when(good, F.greatest(F.lit(0.0), F.least(F.lit(1.0), confidence))).otherwise(0.0).alias("confidence"),
        F.when(broken, "unparseable reply").when(wrong_kind, "model returned a non-string candidate id")
        .when(unknown, F.concat(F.lit("model named an unknown candidate ('"), chosen, F.lit("'); treated as unresolved")))
        .otherwise(F.coalesce(F.nullif(F.substring(field("reason", "string"), 1, 400), F.lit("")), F.lit("no reason given"))).alias("reason"),
        (~good).alias("degraded"),
    )


def decisions_from_replies(candidates: DataFrame, replies: DataFrame) -> DataFrame:
    """A policy's decisions from validated replies (scope, txn_id, chosen, confidence, reason): only listed ids count."""
    n = Window.partitionBy(*KEY)
    listed = candidates.select(*KEY, "cand_no", F.format_string("cand_%05d", "cand_no").alias("chosen"), F.count(F.lit(1)).over(n).alias("n_candidates"))
    lines = listed.select(*KEY, "n_candidates").distinct()
    hit = replies.join(listed.drop("n_candidates"), [*KEY, "chosen"], "left")
    return lines.join(hit, KEY, "left").select(
        *KEY, "cand_no", F.when(F.col("cand_no").isNotNull(), F.col("confidence")).otherwise(0.0).alias("confidence"), F.coalesce("reason", F.lit("no reply")).alias("reason"), "n_candidates"
    )
