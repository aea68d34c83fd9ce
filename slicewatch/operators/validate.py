"""Type-check raw decision JSON and route bad or repeated rows.

Raw decisions are parsed once into a VARIANT; the JSON type of every field is inspected so the
checks follow the decision schema's lax coercions (numeric text and booleans are numbers, whole
floats are ints, text fields must be JSON strings). The result carries ``is_valid`` and
``invalid_reason`` — nothing is raised, every row is kept for the audit trail.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slicewatch.params import ALLOWED_DECISIONS
from slicewatch.session import cut_lineage


FIELDS = ("transaction_id", "decision", "reasoning", "confidence", "delay_hours", "discount_pct")


def _kind(x: Column, t: Column) -> Column:
    """JSON type of a field value ``x`` whose variant type name is ``t``."""
    return (
        F.when(x.isNull(), "missing")
        .when(F.is_variant_null(x), "null")
        .when(t == "STRING", "string")
        .when(t == "BOOLEAN", "boolean")
        .when(t.isin("BIGINT", "INT", "SMALLINT", "TINYINT", "DOUBLE", "FLOAT") | t.startswith("DECIMAL"), "number")
        .otherwise("other")
    )


def _number(x: Column, kind: Column) -> Column:
    """Field as DOUBLE under lax coercion: numbers, booleans and numeric text."""
    return (
        F.when(kind == "number", F.try_variant_get(x, "$", "double"))
        .when(kind == "boolean", F.when(F.try_variant_get(x, "$", "boolean"), 1.0).otherwise(0.0))
        .when(kind == "string", F.try_variant_get(x, "$", "string").try_cast("double"))
    )


def parse_decisions(raw: DataFrame, raw_col: str = "raw") -> DataFrame:
    """Raw JSON decisions → typed columns + ``is_valid`` / ``invalid_reason``.

    Keeps the request's ``transaction_id`` (I5); a null ``raw`` (scorer failure) becomes the
    fallback decision ``escalate`` with confidence 0 (I4) and is valid.

    Staged projections: the text is parsed once, each field is extracted once, then typed. Each
    stage is referenced many times by the next, so Catalyst keeps the stages apart instead of
    inlining the parse into every check.
    """
    keep = [c for c in raw.columns if c != raw_col]
    parsed = raw.withColumn("_v", F.try_parse_json(F.col(raw_col)))
    fields = parsed.select(
        *keep, raw_col,
        F.schema_of_variant(F.col("_v")).alias("_vt"),
        *[F.try_variant_get(F.col("_v"), f"$.{f}", "variant").alias(f"_x_{f}") for f in FIELDS],
    )
    typed = fields.select(
        *keep, raw_col, "_vt",
        *[F.col(f"_x_{f}") for f in FIELDS],
        *[_kind(F.col(f"_x_{f}"), F.schema_of_variant(F.col(f"_x_{f}"))).alias(f"_k_{f}") for f in FIELDS],
    )
    k = {f: F.col(f"_k_{f}") for f in FIELDS}
    x = {f: F.col(f"_x_{f}") for f in FIELDS}
    values = typed.select(
        *keep, raw_col, "_vt", *k.values(),
        *[F.try_variant_get(x[f], "$", "string").alias(f"_t_{f}") for f in ("decision", "reasoning")],
        *[_number(x[f], k[f]).alias(f"_n_{f}") for f in ("confidence", "delay_hours", "discount_pct")],
    )
    conf, delay, disc = F.col("_n_confidence"), F.col("_n_delay_hours"), F.col("_n_discount_pct")

    def int_problem(name: str, val: Column, kind: Column) -> Column:
        bad_type = ~kind.isin("missing", "null", "number", "boolean", "string")
        not_whole = val.isNull() | F.isnan(val) | (val % 1 != 0)
        return (F.when(bad_type | (~kind.isin("missing", "null") & not_whole), F.lit(f"{name} is not an integer"))
                .when(F.abs(val) > 2147483647, F.lit(f"{name} is out of range")))

    problems = F.concat_ws(
        "; ",
        F.when(F.col("_vt").isNull() | (F.col("_vt").startswith("OBJECT") == F.lit(False)),
               F.lit("not a JSON object")),
        *[F.when(k[f] != "string", F.lit(f"{f} must be a string")) for f in ("transaction_id", "decision", "reasoning")],
        F.when(k["confidence"].isin("missing", "null"), F.lit("confidence is required"))
        .when(conf.isNull() | F.isnan(conf) | (conf < 0) | (conf > 1), F.lit("confidence must be within [0, 1]")),
        int_problem("delay_hours", delay, k["delay_hours"]),
        int_problem("discount_pct", disc, k["discount_pct"]),
        F.when((k["decision"] == "string") & ~F.col("_t_decision").isin(*ALLOWED_DECISIONS),
               F.lit("decision is not an allowed value")),
    )
    fallback = F.col(raw_col).isNull()
    out = values.select(
        *keep,
        F.col(raw_col),
        F.when(fallback, "escalate").otherwise(F.col("_t_decision")).alias("decision"),
        F.when(fallback, F.lit("scoring failed; handed to a person")).otherwise(F.col("_t_reasoning")).alias("reasoning"),
        F.when(fallback, 0.0).otherwise(conf).alias("confidence"),
        # a non-whole value is reported as invalid and not carried (no silent truncation)
        F.when(~fallback & (delay % 1 == 0), delay).try_cast("int").alias("delay_hours"),
        F.when(~fallback & (disc % 1 == 0), disc).try_cast("int").alias("discount_pct"),
        F.when(fallback, F.lit(None).cast("string")).otherwise(F.nullif(problems, F.lit(""))).alias("invalid_reason"),
    )
    return out.withColumn("is_valid", F.col("invalid_reason").isNull())


def mark_done(d: DataFrame, prior_outcomes: DataFrame | None) -> DataFrame:
    """``_done`` = the (transaction_id, policy) pair already holds a stored outcome (else null), on whatever
    day it was stored. ``prior_outcomes`` may be whole outcomes or the pairs that ``store.prior_outcomes`` found."""
    keys = ["transaction_id", "policy"]
    if prior_outcomes is None:
        return d.withColumn("_done", F.lit(None).cast("boolean"))
    done = prior_outcomes.select(*keys).distinct().withColumn("_done", F.lit(True))
    return d.join(done, keys, "left")


def route(decisions: DataFrame, txns: DataFrame, prior_outcomes: DataFrame | None = None,
          order_col: str = "seq") -> DataFrame:
    """I7 + C3 + C7: one ``status`` per decision row, in the order unknown → invalid → duplicate.

    ``status`` ∈ {execute, skipped_unknown_transaction, skipped_invalid_decision_schema,
    skipped_duplicate}. A (transaction, policy) already holding an outcome in ``prior_outcomes``
    is a duplicate (anti-join); inside one batch exactly one executable row per key executes, the first
    by ``order_col`` (nulls last, ties by content), and all other rows of the key are duplicates. Rows
    with a null id or policy are kept.
    """
    known = txns.withColumn("_known", F.lit(True))
    d = decisions.join(known, "transaction_id", "left")
    d = mark_done(d, prior_outcomes)
    # one total order per key: the order column (nulls last), then the decision's content, then a row
    # number that only tells verbatim repeats apart. Written once: the parse and the join run once, and
    # row numbers are the same for the minimum and for the rows.
    content = F.xxhash64(*[F.col(c) for c in ("decision", "reasoning", "confidence", "delay_hours", "discount_pct")])
    d = cut_lineage(d.withColumn("_row", F.monotonically_increasing_id()).withColumn("_content", content), "routed")
    ok = F.coalesce(F.col("_known"), F.lit(False)) & F.coalesce(F.col("is_valid"), F.lit(False))
    # first executable row per (transaction, policy): a partial aggregate (skew-safe for a hot id, one
    # row per key shuffled per task) joined back on the row number, instead of a window over the key
    place = F.struct(F.col(order_col).isNull().alias("late"), F.col(order_col).alias("at"), "_content", "_row")
    firsts = (d.where(ok).groupBy("transaction_id", "policy").agg(F.min(place).alias("_min"))
              .select(F.col("_min._row").alias("_row"), F.lit(True).alias("_first")))
    d = d.join(firsts, "_row", "left").withColumn("_first", F.coalesce("_first", F.lit(False)))
    status = (
        F.when(~F.coalesce(F.col("_known"), F.lit(False)), "skipped_unknown_transaction")
        .when(~F.coalesce(F.col("is_valid"), F.lit(False)), "skipped_invalid_decision_schema")
        .when(F.coalesce(F.col("_done"), F.lit(False)) | ~F.col("_first"), "skipped_duplicate")
        .otherwise("execute")
    )
    return d.withColumn("status", status).drop("_known", "_done", "_first", "_row", "_content")
