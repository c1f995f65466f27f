"""A directory of input files, from parsing to the finished run."""

from __future__ import annotations

import json
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerweave.config import ReconcileConfig
from ledgerweave.operators import adjudicate, audit, drift, score
from ledgerweave.operators.explain import result_lines
from ledgerweave.operators.order import positions
from ledgerweave.sources import files, tables
from ledgerweave.storage import cut

from .reconcile import reconcile


def reconcile_directory(
    spark: SparkSession, path: str, store: str, run_id: str, started_at: str, scope: int = 0, config: ReconcileConfig = ReconcileConfig(), policy: adjudicate.Policy = adjudicate.rank_candidates
) -> tuple[str, bool]:
    """The id of the run that holds the results of these files under these settings, and whether it was made now.

    The files' contents and the settings give a fingerprint. If a finished run has it, nothing is written. Otherwise the
    tables of `store` (results, quarantine, drift, claims, audit) get the run's part, and the run is finished last.
    A run that was lost on its way is taken up under its first id, and replaces its parts; readers only see finished runs.
    """
    settings = json.dumps({**asdict(config), "scope": scope}, sort_keys=True)
    mark = audit.fingerprint(spark, [f"{path}/{name}" for name in files.FILES], settings).first()[0]
    run = tables.start_run(spark, f"{store}/runs", run_id, mark, settings, started_at)
    done = tables.finished(spark, f"{store}/runs")
    if done is not None and not done.filter(F.col("run_id") == run).isEmpty():
        return run, False
    parsed = files.load_directory(spark, path, scope)
    settlement, bank, quarantine = cut(parsed.settlement, "parsed"), cut(parsed.bank, "parsed"), cut(parsed.quarantine, "quarantine")
    out = reconcile(settlement, bank, config, policy)
    records = audit.numbered(audit.audit_records(out.results, bank, quarantine)).select("scope", "seq", "kind", "subject", "payload", F.lit(started_at).alias("recorded_at"))
    tables.write_part(positions(result_lines(out.results, bank), "scope", ["txn_seq"]), f"{store}/results", run)
    tables.write_part(quarantine.withColumn("raw", F.substring("raw", 1, 120)), f"{store}/quarantine", run)
    tables.write_part(out.claims, f"{store}/claims", run)
    tables.write_part(drift.detect_fee_drift(settlement), f"{store}/drift", run)
    tables.write_part(audit.chain_append(records, "scope"), f"{store}/audit", run)
    tables.finish_run(f"{store}/runs", run, score.run_summary(out.results, settlement, bank, quarantine), started_at)
    return run, True


def read(spark: SparkSession, store: str, table: str) -> DataFrame:
    """A table of the store, of finished runs only."""
    return tables.of_finished(spark, f"{store}/{table}", f"{store}/runs")
