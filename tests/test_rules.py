"""Stopping rules, table-driven (the six reference cases plus rule-order cases)."""

from __future__ import annotations

from slicewatch.operators.rules import enforce

CASES = [
    # decision, discount, delay, count, failure → action, allowed, reason prefix, delay, discount
    ("send_discount", 40, None, 0, "cart_abandonment", "send_discount", True, "discount_capped", None, 15),
    ("retry_now", None, None, 3, "otp_timeout", "give_up", False, "max_retries_exceeded", None, None),
    ("retry_now", None, None, 2, "bank_decline", "escalate", False, "escalation_trigger", None, None),
    ("retry_delayed", None, 6, 2, "bank_decline", "escalate", False, "escalation_trigger", None, None),
    ("retry_delayed", None, 6, 0, "insufficient_funds", "retry_delayed", True, None, 6, None),
    ("retry_delayed", None, 1, 0, "insufficient_funds", "retry_delayed", True, "cooldown_enforced", 4, None),
    ("send_discount", None, None, 0, "cart_abandonment", "send_discount", True, None, None, 15),
    ("reroute_gateway", None, None, 3, "otp_timeout", "reroute_gateway", True, None, None, None),
    ("give_up", None, None, 3, "bank_decline", "give_up", True, None, None, None),
    ("retry_now", None, None, 3, "bank_decline", "escalate", False, "escalation_trigger", None, None),
    ("retry_delayed", None, None, 1, "otp_timeout", "retry_delayed", True, "cooldown_enforced", 4, None),
    ("send_discount", 0, None, 0, "cart_abandonment", "send_discount", True, None, None, 0),
]


def test_stopping_rule_table(spark):
    df = spark.createDataFrame(
        [(i, c[0], c[1], c[2], c[3], c[4]) for i, c in enumerate(CASES)],
        "i int, decision string, discount_pct int, delay_hours int, retry_count_so_far int, failure_type string")
    got = {r.i: r for r in enforce(df).collect()}
    for i, c in enumerate(CASES):
        r = got[i]
        assert r.allowed_action == c[5], (i, r)
        assert r.allowed == c[6], (i, r)
        if c[7] is None:
            assert r.block_reason is None, (i, r)
        else:
            assert r.block_reason.startswith(c[7]), (i, r)
        assert r.final_delay_hours == c[8], (i, r)
        assert r.final_discount_pct == c[9], (i, r)


def test_reason_texts(spark):
    df = spark.createDataFrame([("send_discount", 40, None, 0, "x"), ("retry_now", None, None, 2, "bank_decline")],
                               "decision string, discount_pct int, delay_hours int, retry_count_so_far int, failure_type string")
    reasons = sorted(r.block_reason for r in enforce(df).collect())
    assert reasons == ["discount_capped: 40% -> 15%",
                       "escalation_trigger: retry_count_so_far=2 >= 2 and failure_type='bank_decline'"]
