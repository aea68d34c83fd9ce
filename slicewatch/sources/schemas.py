"""Explicit schemas (no inference at scale)."""

from pyspark.sql import types as T

HEALTH = T.StructType([
    T.StructField("ts", T.TimestampNTZType()),
    T.StructField("payment_method", T.StringType()),
    T.StructField("bank_gateway", T.StringType()),
    T.StructField("success_rate", T.DoubleType()),
    T.StructField("avg_latency_ms", T.DoubleType()),
    T.StructField("transaction_volume", T.LongType()),
])

TRANSACTIONS = T.StructType([
    T.StructField("transaction_id", T.StringType()),
    T.StructField("payment_method", T.StringType()),
    T.StructField("bank_gateway", T.StringType()),
    T.StructField("ts", T.TimestampNTZType()),
    T.StructField("amount", T.DoubleType()),
    T.StructField("customer_id", T.StringType()),
    T.StructField("customer_history", T.StringType()),
    T.StructField("retry_count_so_far", T.IntegerType()),
    T.StructField("failure_type", T.StringType()),
    T.StructField("degradation_linked", T.BooleanType()),
    T.StructField("ground_truth_recoverable", T.BooleanType()),
    T.StructField("ground_truth_recovery_probability", T.DoubleType()),
    T.StructField("ground_truth_recovery_probability_after_recovery", T.DoubleType()),
])

# Raw decisions arrive as JSON text; every field is read as text and typed by the validator.
RAW_DECISION_FIELDS = ("transaction_id", "decision", "reasoning", "confidence", "delay_hours", "discount_pct")
