"""Payment attempts and failed transactions.

``attempts_from_events`` maps the driver's ``events`` table onto payment attempts with pure column
formulas (so any SQL engine can reproduce them):

    payment_method  = 'm' || (user_id % 4)
    bank_gateway    = 'g' || (props.k % 6)
    ok              = event_type <> 'error'
    latency_ms      = value
Failed attempts become recovery candidates (``transactions_from_attempts``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slicewatch.params import CUSTOMER_TIERS, FAILURE_TYPES, OUTAGE_FAILURE_TYPES
from slicewatch.sources import schemas

N_METHODS = 4
N_GATEWAYS = 6


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def attempt_columns(events: DataFrame) -> DataFrame:
    """The columns of an attempt for every event, also those without a key (``with_keys`` drops them)."""
    k = F.get_json_object("props", "$.k").try_cast("bigint")
    return events.select(
        F.col("event_id").alias("attempt_id"),
        F.col("ts"),
        F.col("user_id"),
        F.concat(F.lit("m"), (F.col("user_id") % N_METHODS).cast("string")).alias("payment_method"),
        F.concat(F.lit("g"), (k % N_GATEWAYS).cast("string")).alias("bank_gateway"),
        (F.col("event_type") != F.lit("error")).alias("ok"),
        F.col("value").alias("latency_ms"),
    )


def with_keys(att: DataFrame) -> DataFrame:
    """pandas group-bys drop null keys; do the same explicitly."""
    return att.where(F.col("payment_method").isNotNull() & F.col("bank_gateway").isNotNull() & F.col("ts").isNotNull())


def attempts_from_events(events: DataFrame) -> DataFrame:
    return with_keys(attempt_columns(events))


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attempts_from_events(read_table(spark, sf_dir, "events"))


def transactions_from_attempts(att: DataFrame) -> DataFrame:
    """Failed attempts as recovery candidates (linkage-independent columns only)."""
    tiers = F.array(*[F.lit(t) for t in CUSTOMER_TIERS])
    ftypes = F.array(*[F.lit(t) for t in FAILURE_TYPES])
    aid = F.col("attempt_id")
    failure = F.element_at(ftypes, (F.floor(aid / 4) % len(FAILURE_TYPES) + 1).cast("int"))
    return att.where(~F.col("ok")).select(
        aid.cast("string").alias("transaction_id"),
        "payment_method",
        "bank_gateway",
        "ts",
        F.col("latency_ms").alias("amount"),
        F.concat(F.lit("cust_"), F.col("user_id").cast("string")).alias("customer_id"),
        F.element_at(tiers, (F.floor(F.col("user_id") / 4) % len(CUSTOMER_TIERS) + 1).cast("int")).alias("customer_history"),
        (aid % 4).cast("int").alias("retry_count_so_far"),
        failure.alias("failure_type"),
        # seed label: the generator marks outage failures as degradation-linked
        failure.isin(*OUTAGE_FAILURE_TYPES).alias("seed_linked"),
        (((aid * 37) % 90 + 2) / F.lit(100.0)).alias("ground_truth_recovery_probability"),
    )


def unique_transactions(txns: DataFrame, repeated: DataFrame | None = None) -> DataFrame:
    """``transaction_id`` is a primary key. A repeated id keeps one row, the smallest by
    (ts, then the remaining columns), so the choice does not depend on file or partition order. The ids
    are counted first (a thin hash aggregate); only rows of repeated ids are rewritten, so a table with
    unique ids is not shuffled at full width. What is refused: ``refused_transactions``. ``repeated`` is the stored
    table of ``duplicate_transaction_ids``: the ids are not counted again, and without repeated ids nothing is joined."""
    rest = ["ts"] + [c for c in txns.columns if c not in ("transaction_id", "ts")]
    if repeated is not None and not repeated.limit(1).count():
        return txns.where(F.col("transaction_id").isNotNull())
    repeated = (duplicate_transaction_ids(txns) if repeated is None else repeated).select("transaction_id")
    first = (txns.join(repeated, "transaction_id", "left_semi").groupBy("transaction_id").agg(F.min(F.struct(*rest)).alias("_r"))
             .select("transaction_id", *[F.col("_r")[c].alias(c) for c in rest]).select(*txns.columns))
    keyed = txns.where(F.col("transaction_id").isNotNull())
    return keyed.join(repeated, "transaction_id", "left_anti").select(*txns.columns).unionByName(first)


#: Columns of the quarantine.
REFUSED = "transaction_id string, reason string, n long"


def refused_transactions(txns: DataFrame, repeated: DataFrame | None = None) -> DataFrame:
    """B13 quarantine: what ``unique_transactions`` leaves out, as ``transaction_id, reason, n`` (rows refused).
    ``repeated`` as there."""
    repeated = duplicate_transaction_ids(txns) if repeated is None else repeated
    again = repeated.select("transaction_id", F.lit("repeated id").alias("reason"), (F.col("n") - 1).alias("n"))
    none = txns.where(F.col("transaction_id").isNull()).groupBy("transaction_id").agg(F.count(F.lit(1)).alias("n"))
    return again.unionByName(none.select("transaction_id", F.lit("no id").alias("reason"), "n"))


def duplicate_transaction_ids(txns: DataFrame) -> DataFrame:
    """B13 check: ids that occur more than once, with their count."""
    keyed = txns.where(F.col("transaction_id").isNotNull())
    return keyed.groupBy("transaction_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transactions_from_attempts(attempts(spark, sf_dir))


#: Other header names of a column, and columns that a file may lack.
ALIASES = {"ts": ("ts", "timestamp")}
OPTIONAL = ("degradation_linked", "ground_truth_recoverable")


def _read_by_name(spark: SparkSession, path: str, fmt: str, schema: T.StructType) -> DataFrame:
    """Columns found by header name, whatever their order, and typed leniently (B9): text that does not
    parse and NaN become null. A missing column is an error."""
    raw = spark.read.option("header", True).csv(path) if fmt == "csv" else spark.read.format(fmt).load(path)
    out = []
    for f in schema.fields:
        name = next((n for n in ALIASES.get(f.name, (f.name,)) if n in raw.columns), None)
        if name is None:
            if f.name in OPTIONAL:
                continue
            raise ValueError(f"{path}: no column {f.name} in {raw.columns}")
        typed = F.col(f"`{name}`").try_cast(f.dataType)
        out.append((F.when(~F.isnan(typed), typed) if isinstance(f.dataType, T.DoubleType) else typed).alias(f.name))
    return raw.select(*out)


def read_health(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """A1: pre-aggregated health series (CSV with header, or parquet)."""
    raw = _read_by_name(spark, path, fmt, schemas.HEALTH)
    return raw.where(F.col("payment_method").isNotNull() & F.col("bank_gateway").isNotNull())


def read_transactions(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """A2: transactions (CSV with header, or parquet)."""
    return _read_by_name(spark, path, fmt, schemas.TRANSACTIONS)
