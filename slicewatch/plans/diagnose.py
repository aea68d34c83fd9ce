"""Steps 1-4: health series → events → root cause → linked transactions.

Lineage is cut (reliable checkpoint into the shared checkpoint folder) at the health series and
at the event tables: both are small next to the raw attempts, both are read several times
(detection, root cause, linkage, audit), and a lost executor then recomputes from them, not
from the raw scan. The attempts are cut too: their text fields are parsed once, and the rollup and the
transactions read typed columns. The repeated transaction ids are counted once, for the quarantine
and for the transactions that stay.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from slicewatch.operators.events import detect_events
from slicewatch.operators.linkage import link, with_after_recovery_probability
from slicewatch.operators.root_cause import root_cause
from slicewatch.operators.rollup import health_rollup
from slicewatch.params import Params
from slicewatch.session import cut_lineage
from slicewatch.sources.payments import (
    attempt_columns, attempts, duplicate_transaction_ids, read_table, refused_transactions, transactions_from_attempts,
    unique_transactions, with_keys)

# context of the matched event carried onto each linked transaction
RC_CARRY = ("root_cause_statement", "classification", "best_peer", "best_peer_rate")

@dataclass
class Diagnosis:
    health: DataFrame
    events: DataFrame      # one row per event, with root cause columns
    linked: DataFrame      # every transaction, with event_id / degradation_linked / context
    refused: DataFrame | None = None    # what was left out before linkage, with reason and count


def health_from_attempts(att: DataFrame, p: Params, cut: bool = True) -> DataFrame:
    h = health_rollup(att, p.grain_hours)
    return cut_lineage(h, "health") if cut else h


def health_from_tables(spark: SparkSession, sf_dir: str, p: Params, cut: bool = True) -> DataFrame:
    return health_from_attempts(attempts(spark, sf_dir), p, cut=cut)


def diagnose(health: DataFrame, txns: DataFrame, p: Params = Params(), cut: bool = True) -> Diagnosis:
    events = detect_events(health, p, cut=cut)
    rc = root_cause(events, health, p, cut=cut)
    if cut:
        rc = cut_lineage(rc, "events")
    refused = None
    if p.unique_transactions:
        repeated = cut_lineage(duplicate_transaction_ids(txns), "repeated") if cut else None
        refused = refused_transactions(txns, repeated)
        if cut:
            refused = cut_lineage(refused, "refused")
        txns = unique_transactions(txns, repeated)
    linked = link(txns, rc, p, carry=RC_CARRY + ("window_end",))
    linked = with_after_recovery_probability(linked.withColumnRenamed("window_end", "event_window_end"))
    if cut:
        linked = cut_lineage(linked, "transactions")
    return Diagnosis(health, rc, linked, refused)


def diagnose_tables(spark: SparkSession, sf_dir: str, p: Params | None = None, cut: bool = True) -> Diagnosis:
    p = p or Params()
    att = attempt_columns(read_table(spark, sf_dir, "events"))
    # written before the rows without a key go: a filter on the parsed text would parse it once more
    att = with_keys(cut_lineage(att, "attempts") if cut else att)
    health = health_from_attempts(att, p, cut=cut)
    return diagnose(health, transactions_from_attempts(att), p, cut=cut)
