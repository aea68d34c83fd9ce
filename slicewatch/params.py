"""Tunable constants of the detection → diagnosis → recovery chain.

Defaults are the fixed values the results must agree with (see README §Constants).
"""

from __future__ import annotations

from dataclasses import dataclass, replace

# Decision vocabulary, failure types and customer tiers.
ALLOWED_DECISIONS = (
    "retry_now",
    "retry_delayed",
    "send_discount",
    "send_reminder",
    "reroute_gateway",
    "escalate",
    "give_up",
)
RETRY_DECISIONS = ("retry_now", "retry_delayed")
OUTAGE_FAILURE_TYPES = ("gateway_timeout", "gateway_error", "processor_declined")
ORDINARY_FAILURE_TYPES = (
    "card_expired",
    "insufficient_funds",
    "cart_abandonment",
    "invoice_overdue",
    "bank_decline",
    "otp_timeout",
    "customer_cancelled",
)
FAILURE_TYPES = OUTAGE_FAILURE_TYPES + ORDINARY_FAILURE_TYPES
CUSTOMER_TIERS = ("new", "repeat", "high_value", "at_risk")
SEVERITIES = ("critical", "high", "medium", "low")
CLASSIFICATIONS = (
    "gateway_specific_issue",
    "payment_method_wide_issue",
    "gateway_wide_issue",
    "platform_wide_incident",
)


@dataclass(frozen=True)
class Params:
    # health series grain (hours per cell) and trailing baseline
    grain_hours: int = 1
    baseline_rows: int = 48
    baseline_min_periods: int = 6
    # breach rule
    min_drop: float = 0.15
    z_threshold: float = 3.0
    std_fill: float = 0.02
    std_floor: float = 0.005
    min_run_rows: int = 3
    strict_gaps: bool = False          # True: a missing cell (gap > one grain) also ends a run
    # severity cut-offs on the unrounded mean drop
    severity_critical: float = 0.25
    severity_high: float = 0.15
    severity_medium: float = 0.08
    # root cause
    healthy_threshold: float = 0.90
    # stopping rules
    max_retries: int = 3
    cooldown_hours: int = 4
    max_discount_pct: int = 15
    escalation_retry_threshold: int = 2
    escalation_failure_type: str = "bank_decline"
    # outcome model
    action_cost: float = 2.0
    discount_uplift: float = 0.20
    reminder_uplift: float = 0.15
    escalate_uplift: float = 0.30
    delayed_uplift: float = 0.10
    reroute_uplift: float = 0.10
    probability_cap: float = 0.97
    draw_seed: str = "2026"
    # physical knobs: time bucket (hours) used as the equi-key of range joins;
    # None = the grain. Rows of the small side above which no broadcast is requested.
    # transaction_id is a primary key: repeated ids keep one row before linkage
    unique_transactions: bool = True
    bucket_hours: int | None = None
    # hours per time chunk of the chunked baseline / island plan (None = one window per slice);
    # set it when single slices are long or hot, so their rows spread over many tasks
    time_chunk_hours: int | None = None
    broadcast_max_rows: int = 1_000_000
    broadcast_max_bytes: int = 64 << 20

    def with_(self, **kw) -> "Params":
        return replace(self, **kw)

    @property
    def grain_seconds(self) -> int:
        return int(self.grain_hours) * 3600

    @property
    def bucket_seconds(self) -> int:
        return int(self.bucket_hours or self.grain_hours) * 3600
