"""I8: stopping rules as pure column expressions.

Order: escalation trigger, then retry cap, then cool-down; the discount cap applies on its own.
``allowed`` means the action was not changed (a raised delay or a capped discount still counts
as allowed). Delay survives only for ``retry_delayed``, discount only for ``send_discount``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slicewatch.params import RETRY_DECISIONS, Params

# Reason formats written to actions_taken.block_reason.
ESCALATION_REASON = "escalation_trigger: retry_count_so_far={count} >= {threshold} and failure_type='{failure}'"
MAX_RETRIES_REASON = "max_retries_exceeded: retry_count_so_far={count} >= {cap}"
COOLDOWN_REASON = "cooldown_enforced: delay_hours raised to minimum {cooldown}"
DISCOUNT_REASON = "discount_capped: {pct}% -> {cap}%"


def _fmt(template: str, **cols) -> F.Column:
    """Build ``template`` with ``{name}`` slots filled from columns or literals."""
    parts, rest = [], template
    while "{" in rest:
        pre, _, tail = rest.partition("{")
        name, _, rest = tail.partition("}")
        parts += [F.lit(pre), cols[name].cast("string")]
    parts.append(F.lit(rest))
    return F.concat(*parts)


def enforce(df: DataFrame, p: Params = Params()) -> DataFrame:
    """Adds allowed_action, allowed, block_reason, final_delay_hours, final_discount_pct."""
    req = F.col("decision")
    rc = F.col("retry_count_so_far")
    is_retry = req.isin(*RETRY_DECISIONS)
    trigger = is_retry & (rc >= F.lit(p.escalation_retry_threshold)) & (F.col("failure_type") == F.lit(p.escalation_failure_type))
    cap = is_retry & (rc >= F.lit(p.max_retries))
    delay = F.col("delay_hours")
    cool = (req == "retry_delayed") & (delay.isNull() | (delay < F.lit(p.cooldown_hours)))
    pct = F.col("discount_pct")
    disc_over = (req == "send_discount") & (pct > F.lit(p.max_discount_pct))

    action = F.when(trigger, "escalate").when(cap, "give_up").otherwise(req)
    first_reason = (
        F.when(trigger, _fmt(ESCALATION_REASON, count=rc, threshold=F.lit(p.escalation_retry_threshold),
                             failure=F.lit(p.escalation_failure_type)))
        .when(cap, _fmt(MAX_RETRIES_REASON, count=rc, cap=F.lit(p.max_retries)))
        .when(cool, _fmt(COOLDOWN_REASON, cooldown=F.lit(p.cooldown_hours)))
    )
    disc_reason = F.when(disc_over, _fmt(DISCOUNT_REASON, pct=pct, cap=F.lit(p.max_discount_pct)))
    new_delay = F.when(cool & ~trigger & ~cap, F.lit(p.cooldown_hours)).otherwise(delay)
    new_pct = (F.when(req != "send_discount", pct)
               .when(pct.isNull(), F.lit(p.max_discount_pct))
               .when(disc_over, F.lit(p.max_discount_pct))
               .otherwise(pct))
    return df.withColumns({
        "allowed_action": action,
        "allowed": action == req,
        "block_reason": F.nullif(F.concat_ws("; ", first_reason, disc_reason), F.lit("")),
        "final_delay_hours": F.when(action == "retry_delayed", new_delay).cast("int"),
        "final_discount_pct": F.when(action == "send_discount", new_pct).cast("int"),
    })
