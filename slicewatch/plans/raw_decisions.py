"""Raw decision JSON derived from the transactions, for exercising validation and routing.

Each transaction gets one JSON decision text; its shape varies with ``id % 16`` over sixteen
cases (string/boolean numbers, whole floats, missing or null fields, bad enum, out-of-range
confidence, non-JSON text, extra keys). Two of the cases are emitted twice — once repeated
verbatim (an in-batch duplicate) and once under an id no transaction has (unknown id).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slicewatch.functions.timeutil import epoch_micros


def _q(x) -> F.Column:
    return F.concat(F.lit('"'), x, F.lit('"'))


def raw_decisions(linked: DataFrame, policy: str = "agent") -> DataFrame:
    tid = F.col("transaction_id")
    k = (tid.try_cast("bigint") % 16).cast("int")
    dec = F.when(F.col("retry_count_so_far") >= 3, "give_up").otherwise("retry_now")
    dec = F.when(k == 3, F.lit("retry_later")).otherwise(dec)
    fields = {
        "transaction_id": F.when(k == 8, tid).otherwise(_q(tid)),
        "decision": _q(dec),
        "reasoning": F.when(k == 11, F.lit("null")).when(k == 14, F.lit('""'))
                      .otherwise(_q(F.concat(F.lit("reason "), tid))),
        "confidence": F.when(k == 0, F.lit('"0.8"')).when(k == 4, F.lit("1.0001")).when(k == 9, F.lit("true"))
                       .otherwise(F.lit("0.9")),
        "delay_hours": F.when(k == 5, F.lit("4.0")).when(k == 6, F.lit('"4"')).when(k == 7, F.lit("4.5"))
                        .when(k == 12, F.lit('"4.5"')).otherwise(F.lit("null")),
        "discount_pct": F.when(k == 13, F.lit("true")).otherwise(F.lit("null")),
    }
    omit = {"reasoning": k == 1, "confidence": k == 2}
    parts = []
    for name, val in fields.items():
        piece = F.concat(F.lit(f'"{name}": '), val)
        parts.append(F.when(omit[name], F.lit(None)).otherwise(piece) if name in omit else piece)
    parts.append(F.when(k == 10, F.lit('"note": "extra"')))
    raw = F.when(k == 15, F.lit("not json")).otherwise(F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}")))
    # copies: 0 = the decision; 1 = verbatim repeat (k = 0); 2 = unknown request id (k = 5)
    copies = F.when(k == 0, F.array(F.lit(0), F.lit(1))).when(k == 5, F.array(F.lit(0), F.lit(2))).otherwise(F.array(F.lit(0)))
    base = linked.select(tid.alias("tid"), epoch_micros("ts").alias("t_us"), raw.alias("raw"),
                         F.explode(copies).alias("copy"))
    return base.select(
        (F.col("t_us") * 4 + F.col("copy")).alias("seq"),
        F.when(F.col("copy") == 2, F.concat(F.lit("x"), F.col("tid"))).otherwise(F.col("tid")).alias("transaction_id"),
        F.lit(policy).alias("policy"),
        "raw",
    )
