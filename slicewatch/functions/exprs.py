"""Scalar rules as column expressions: severity, classification, statement text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from slicewatch.functions.numeric import whole_percent
from slicewatch.params import Params


def c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def severity_expr(drop, p: Params = Params()) -> Column:
    d = c(drop)
    return (
        F.when(d >= F.lit(p.severity_critical), "critical")
        .when(d >= F.lit(p.severity_high), "high")
        .when(d >= F.lit(p.severity_medium), "medium")
        .otherwise("low")
    )


def classification_expr(isolated, gateways_stable, methods_stable) -> Column:
    iso, gs, ms = c(isolated), c(gateways_stable), c(methods_stable)
    return (
        F.when(iso, "gateway_specific_issue")
        .when(~gs & ms, "payment_method_wide_issue")
        .when(gs & ~ms, "gateway_wide_issue")
        .otherwise("platform_wide_incident")
    )


def time_range_text(start, end) -> Column:
    """'HH:mm-HH:mm on MMM dd' of the event window."""
    return F.concat(
        F.date_format(c(start), "HH:mm"), F.lit("-"), F.date_format(c(end), "HH:mm"),
        F.lit(" on "), F.date_format(c(start), "MMM dd"),
    )


def statement_expr(classification, method, gateway, baseline_rate, current_rate, start, end,
                   best_peer, best_peer_rate, global_rate) -> Column:
    """Plain-language root-cause statement carrying the facts of the diagnosis."""
    m, g = c(method), c(gateway)
    base, cur = whole_percent(baseline_rate), whole_percent(current_rate)
    when_txt = time_range_text(start, end)
    peer_note = F.when(
        c(best_peer).isNotNull(),
        F.concat(F.lit(" Healthiest other "), m, F.lit(" gateway in that window: "), c(best_peer),
                 F.lit(" at "), whole_percent(best_peer_rate), F.lit("%.")),
    ).otherwise(F.lit(""))
    specific = F.concat(
        m, F.lit(" on "), g, F.lit(" fell from "), base, F.lit("% to "), cur, F.lit("% during "), when_txt,
        F.lit(" while its peers held up: a "), g, F.lit("-specific fault, not a "), m, F.lit("-wide one."), peer_note,
    )
    method_wide = F.concat(
        m, F.lit(" degraded on several gateways during "), when_txt, F.lit(" ("), g, F.lit(": "), base,
        F.lit("% to "), cur, F.lit("%): a "), m, F.lit("-wide fault, not one gateway."),
    )
    gateway_wide = F.concat(
        g, F.lit(" degraded for several payment methods during "), when_txt, F.lit(" ("), m, F.lit(": "), base,
        F.lit("% to "), cur, F.lit("%): a "), g, F.lit("-wide fault reaching every method routed through it."),
    )
    platform = F.concat(
        m, F.lit(" on "), g, F.lit(" fell from "), base, F.lit("% to "), cur, F.lit("% during "), when_txt,
        F.lit(" together with the rest of the platform (other slices averaged "),
        F.coalesce(whole_percent(global_rate), F.lit("n/a")), F.lit("%): a platform-wide incident."),
    )
    cl = c(classification)
    return (
        F.when(cl == "gateway_specific_issue", specific)
        .when(cl == "payment_method_wide_issue", method_wide)
        .when(cl == "gateway_wide_issue", gateway_wide)
        .otherwise(platform)
    )
