"""Oracle SQL (DuckDB dialect) for every registered query, with the registered settings.

Each statement recomputes its answer from the raw views (``events`` …) with plain SQL: grain 1 h,
healthy threshold 0.60. The CTE chain mirrors the stages of the library, but
the range joins are written as plain range predicates / correlated subqueries, i.e. brute force.
"""

from __future__ import annotations

from slicewatch.params import CUSTOMER_TIERS, FAILURE_TYPES, OUTAGE_FAILURE_TYPES

G = 1          # grain hours
THR = 0.60     # healthy threshold of the registered queries


def _lst(vals) -> str:
    return "[" + ", ".join(f"'{v}'" for v in vals) + "]"


def _in(vals) -> str:
    return "(" + ", ".join(f"'{v}'" for v in vals) + ")"


def r(x: str, d: int) -> str:
    """printf writes the digits of the exact binary value, half to even."""
    return f"CAST(printf('%.{d}f', CAST({x} AS DOUBLE)) AS DOUBLE)"


def clip(x: str) -> str:
    return f"least(greatest({x}, 0.0::DOUBLE), 0.97::DOUBLE)"


def pct(x: str) -> str:
    return f"CAST(CAST(round_even(({x}) * 100.0::DOUBLE, 0) AS BIGINT) AS VARCHAR)"


CTES = {}

CTES["att"] = """
att0 AS (
  SELECT event_id AS attempt_id, ts, user_id,
         'm' || CAST(user_id % 4 AS VARCHAR) AS payment_method,
         'g' || CAST(TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) % 6 AS VARCHAR) AS bank_gateway,
         event_type <> 'error' AS ok,
         value AS latency_ms
  FROM events),
att AS (SELECT * FROM att0 WHERE payment_method IS NOT NULL AND bank_gateway IS NOT NULL AND ts IS NOT NULL)"""

CTES["health"] = f"""
health AS (
  SELECT time_bucket(INTERVAL '{G} hours', ts) AS ts, payment_method, bank_gateway,
    CASE WHEN count(ok) > 0 THEN CAST(sum(CAST(ok AS INTEGER)) AS DOUBLE) / CAST(count(ok) AS DOUBLE) END AS success_rate,
    CASE WHEN count(latency_ms) > 0 THEN CAST(sum(CAST(latency_ms AS DECIMAL(30,6))) AS DOUBLE) / CAST(count(latency_ms) AS DOUBLE) END AS avg_latency_ms,
    count(*) AS transaction_volume
  FROM att GROUP BY 1, 2, 3)"""

CTES["enriched"] = """
base AS (
  SELECT *,
    count(success_rate) OVER w AS n_b,
    CAST(sum(CAST(success_rate AS DECIMAL(12,10))) OVER w AS DOUBLE) AS s_b,
    CAST(sum(CAST(success_rate AS DECIMAL(12,10)) * CAST(success_rate AS DECIMAL(12,10))) OVER w AS DOUBLE) AS ss_b,
    count(avg_latency_ms) OVER w AS n_l,
    CAST(sum(CAST(avg_latency_ms AS DECIMAL(30,12))) OVER w AS DOUBLE) AS s_l
  FROM health
  WINDOW w AS (PARTITION BY payment_method, bank_gateway ORDER BY ts ROWS BETWEEN 48 PRECEDING AND 1 PRECEDING)),
enriched AS (
  SELECT payment_method, bank_gateway, ts, success_rate, avg_latency_ms, transaction_volume,
    CASE WHEN n_b >= 6 THEN s_b / n_b END AS rolling_baseline_success_rate,
    CASE WHEN n_b >= 6 THEN sqrt(greatest((ss_b - s_b * s_b / n_b) / (n_b - 1), 0.0::DOUBLE)) END AS rolling_baseline_std,
    CASE WHEN n_l >= 6 THEN s_l / n_l END AS rolling_baseline_latency
  FROM base)"""

CTES["flagged"] = """
flagged AS (
  SELECT *,
    rolling_baseline_success_rate - success_rate AS drop_pct_points,
    (rolling_baseline_success_rate - success_rate) / greatest(coalesce(rolling_baseline_std, 0.02::DOUBLE), 0.005::DOUBLE) AS z_score,
    coalesce(rolling_baseline_success_rate IS NOT NULL AND (
      (rolling_baseline_success_rate - success_rate) >= 0.15::DOUBLE OR
      (rolling_baseline_success_rate - success_rate) / greatest(coalesce(rolling_baseline_std, 0.02::DOUBLE), 0.005::DOUBLE) >= 3.0::DOUBLE), false) AS breach
  FROM enriched)"""

CTES["dev"] = f"""
isl AS (
  SELECT *, sum(CASE WHEN breach THEN 0 ELSE 1 END) OVER (
    PARTITION BY payment_method, bank_gateway ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island
  FROM flagged),
runs AS (
  SELECT payment_method, bank_gateway, island, count(*) AS n_rows, min(ts) AS window_start, max(ts) AS last_ts,
    CAST(sum(CAST(rolling_baseline_success_rate AS DECIMAL(30,12))) AS DOUBLE) AS s_base,
    CAST(sum(CAST(success_rate AS DECIMAL(30,12))) AS DOUBLE) AS s_rate,
    CAST(sum(CAST(z_score AS DECIMAL(30,12))) AS DOUBLE) AS s_z
  FROM isl WHERE breach GROUP BY 1, 2, 3 HAVING count(*) >= 3),
ev0 AS (
  SELECT payment_method, bank_gateway, window_start, last_ts + INTERVAL {G} HOUR AS window_end,
    {r('s_base / n_rows', 4)} AS baseline_rate,
    {r('s_rate / n_rows', 4)} AS current_rate,
    CASE WHEN s_base / n_rows - s_rate / n_rows >= 0.25::DOUBLE THEN 'critical'
         WHEN s_base / n_rows - s_rate / n_rows >= 0.15::DOUBLE THEN 'high'
         WHEN s_base / n_rows - s_rate / n_rows >= 0.08::DOUBLE THEN 'medium' ELSE 'low' END AS severity,
    {r('s_z / n_rows', 2)} AS z_score,
    n_rows
  FROM runs),
dev AS (
  SELECT CAST(row_number() OVER (ORDER BY payment_method, bank_gateway, window_start) AS BIGINT) AS event_id, *
  FROM ev0)"""

CTES["peers"] = f"""
wrows AS (
  SELECT e.event_id, e.payment_method AS e_method, e.bank_gateway AS e_gateway, h.*
  FROM dev e JOIN health h ON h.ts >= e.window_start AND h.ts < e.window_end),
peers0 AS (
  SELECT event_id, e_method, e_gateway, payment_method, bank_gateway, count(*) AS n_rows,
    count(success_rate) AS n_rate, sum(CAST(success_rate AS DECIMAL(12,10))) AS s_rate
  FROM wrows WHERE NOT (payment_method = e_method AND bank_gateway = e_gateway)
  GROUP BY 1, 2, 3, 4, 5),
peers AS (
  SELECT *,
    {r('CASE WHEN n_rate > 0 THEN CAST(s_rate AS DOUBLE) / CAST(n_rate AS DOUBLE) END', 4)} AS rate,
    payment_method = e_method AS is_peer_gateway,
    bank_gateway = e_gateway AS is_peer_method
  FROM peers0)"""

CTES["rc"] = f"""
best AS (
  SELECT event_id, bank_gateway AS best_peer, rate AS best_peer_rate FROM (
    SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY rate DESC, bank_gateway) AS rn
    FROM peers WHERE is_peer_gateway AND rate IS NOT NULL) WHERE rn = 1),
agg AS (
  SELECT event_id,
    bool_and(CASE WHEN is_peer_gateway THEN coalesce(rate >= {THR}::DOUBLE, false) END) AS gw_ok,
    bool_and(CASE WHEN is_peer_method THEN coalesce(rate >= {THR}::DOUBLE, false) END) AS m_ok,
    count(CASE WHEN is_peer_gateway THEN 1 END) AS n_peer_gateways,
    count(CASE WHEN is_peer_method THEN 1 END) AS n_peer_methods,
    sum(n_rows) AS global_rows, sum(n_rate) AS global_n, sum(s_rate) AS global_s
  FROM peers GROUP BY 1),
rc0 AS (
  SELECT d.*,
    coalesce(a.gw_ok, true) AS other_gateways_stable,
    coalesce(a.m_ok, true) AS other_methods_stable,
    CASE WHEN a.global_n > 0 THEN CAST(a.global_s AS DOUBLE) / CAST(a.global_n AS DOUBLE) END AS global_other_rate,
    coalesce(a.global_rows, 0) AS global_rows,
    coalesce(a.n_peer_gateways, 0) AS n_peer_gateways,
    coalesce(a.n_peer_methods, 0) AS n_peer_methods,
    b.best_peer, b.best_peer_rate
  FROM dev d LEFT JOIN agg a USING (event_id) LEFT JOIN best b USING (event_id)),
rc1 AS (
  SELECT *,
    other_gateways_stable AND other_methods_stable AND (global_rows = 0 OR coalesce(global_other_rate >= {THR}::DOUBLE, false)) AS is_isolated
  FROM rc0),
rc2 AS (
  SELECT *,
    CASE WHEN is_isolated THEN 'gateway_specific_issue'
         WHEN NOT other_gateways_stable AND other_methods_stable THEN 'payment_method_wide_issue'
         WHEN other_gateways_stable AND NOT other_methods_stable THEN 'gateway_wide_issue'
         ELSE 'platform_wide_incident' END AS classification,
    strftime(window_start, '%H:%M') || '-' || strftime(window_end, '%H:%M') || ' on ' || strftime(window_start, '%b %d') AS when_txt,
    {pct('baseline_rate')} AS base_pct, {pct('current_rate')} AS cur_pct
  FROM rc1),
rc AS (
  SELECT *,
    CASE classification
      WHEN 'gateway_specific_issue' THEN
        payment_method || ' on ' || bank_gateway || ' fell from ' || base_pct || '% to ' || cur_pct || '% during ' || when_txt ||
        ' while its peers held up: a ' || bank_gateway || '-specific fault, not a ' || payment_method || '-wide one.' ||
        CASE WHEN best_peer IS NOT NULL THEN ' Healthiest other ' || payment_method || ' gateway in that window: ' ||
             best_peer || ' at ' || {pct('best_peer_rate')} || '%.' ELSE '' END
      WHEN 'payment_method_wide_issue' THEN
        payment_method || ' degraded on several gateways during ' || when_txt || ' (' || bank_gateway || ': ' || base_pct ||
        '% to ' || cur_pct || '%): a ' || payment_method || '-wide fault, not one gateway.'
      WHEN 'gateway_wide_issue' THEN
        bank_gateway || ' degraded for several payment methods during ' || when_txt || ' (' || payment_method || ': ' ||
        base_pct || '% to ' || cur_pct || '%): a ' || bank_gateway || '-wide fault reaching every method routed through it.'
      ELSE
        payment_method || ' on ' || bank_gateway || ' fell from ' || base_pct || '% to ' || cur_pct || '% during ' || when_txt ||
        ' together with the rest of the platform (other slices averaged ' || coalesce({pct('global_other_rate')}, 'n/a') ||
        '%): a platform-wide incident.'
    END AS root_cause_statement,
    {r('global_other_rate', 4)} AS global_other_slices_avg_rate
  FROM rc2)"""

CTES["txn"] = f"""
txn AS (
  SELECT CAST(attempt_id AS VARCHAR) AS transaction_id, payment_method, bank_gateway, ts, latency_ms AS amount,
    'cust_' || CAST(user_id AS VARCHAR) AS customer_id,
    {_lst(CUSTOMER_TIERS)}[CAST((user_id // 4) % 4 AS BIGINT) + 1] AS customer_history,
    CAST(attempt_id % 4 AS INTEGER) AS retry_count_so_far,
    {_lst(FAILURE_TYPES)}[CAST((attempt_id // 4) % 10 AS BIGINT) + 1] AS failure_type,
    CAST((attempt_id * 37) % 90 + 2 AS DOUBLE) / 100.0::DOUBLE AS ground_truth_recovery_probability
  FROM att WHERE NOT ok),
txn2 AS (SELECT *, failure_type IN {_in(OUTAGE_FAILURE_TYPES)} AS seed_linked FROM txn)"""

CTES["lnk"] = """
lnk0 AS (
  SELECT t.*, (SELECT min(e.event_id) FROM dev e
               WHERE e.payment_method = t.payment_method AND e.bank_gateway = t.bank_gateway
                 AND t.ts >= e.window_start AND t.ts < e.window_end) AS event_id
  FROM txn2 t),
lnk AS (
  SELECT l.*, l.event_id IS NOT NULL AS degradation_linked,
    CASE WHEN l.event_id IS NOT NULL THEN greatest(l.ground_truth_recovery_probability, 0.82::DOUBLE)
         ELSE l.ground_truth_recovery_probability END AS ground_truth_recovery_probability_after_recovery,
    rc.root_cause_statement, rc.classification, rc.best_peer, rc.best_peer_rate, rc.window_end AS event_window_end,
    epoch_us(l.ts) AS seq
  FROM lnk0 l LEFT JOIN rc ON l.event_id = rc.event_id)"""

_CAPPED = "retry_count_so_far >= 3"
_LINKED = "coalesce(degradation_linked, false)"
_HEALTHY = f"coalesce(best_peer_rate >= {THR}::DOUBLE, false)"
_HOURS_LEFT = "CAST(ceil((epoch_us(event_window_end) - epoch_us(ts)) / 3600000000.0::DOUBLE) AS INTEGER)"

CTES["dec"] = f"""
dec_base AS (
  SELECT l.*, 'baseline' AS policy,
    CASE WHEN {_CAPPED} THEN 'give_up' ELSE 'retry_now' END AS decision,
    CASE WHEN {_CAPPED} THEN 'Retry cap of 3 reached; nothing left to try.'
         ELSE 'Baseline: retry at once on any failure, whatever the gateway health.' END AS reasoning,
    1.0::DOUBLE AS confidence, CAST(NULL AS INTEGER) AS delay_hours, CAST(NULL AS INTEGER) AS discount_pct
  FROM lnk l),
dec_agent AS (
  SELECT l.*, 'agent' AS policy,
    CASE WHEN {_CAPPED} AND customer_history IN ('high_value', 'at_risk') THEN 'escalate'
         WHEN {_CAPPED} THEN 'give_up'
         WHEN {_LINKED} AND {_HEALTHY} THEN 'reroute_gateway'
         WHEN {_LINKED} THEN 'retry_delayed'
         WHEN failure_type = 'card_expired' THEN 'send_reminder'
         WHEN failure_type = 'insufficient_funds' THEN 'retry_delayed'
         WHEN failure_type = 'cart_abandonment' THEN 'send_discount'
         WHEN failure_type = 'invoice_overdue' THEN CASE WHEN customer_history = 'high_value' THEN 'escalate' ELSE 'send_reminder' END
         WHEN failure_type = 'bank_decline' THEN CASE WHEN retry_count_so_far >= 2 THEN 'escalate' ELSE 'retry_delayed' END
         WHEN failure_type = 'customer_cancelled' THEN 'give_up'
         ELSE 'retry_now' END AS decision,
    concat_ws('; ',
      CASE WHEN {_CAPPED} THEN 'retry count ' || CAST(retry_count_so_far AS VARCHAR) || ' is at the cap' END,
      CASE WHEN NOT ({_CAPPED}) AND {_LINKED} THEN 'inside a detected degradation window' END,
      CASE WHEN NOT ({_CAPPED}) AND {_LINKED} AND {_HEALTHY} THEN 'healthy peer gateway ' || best_peer END,
      CASE WHEN NOT ({_CAPPED}) AND {_LINKED} AND NOT {_HEALTHY} THEN 'no healthy peer; wait for recovery' END,
      CASE WHEN NOT {_LINKED} THEN 'failure ' || failure_type || ', customer ' || customer_history || ', retries ' || CAST(retry_count_so_far AS VARCHAR) END
    ) AS reasoning,
    CASE WHEN {_CAPPED} THEN 0.9::DOUBLE WHEN {_LINKED} THEN 0.85::DOUBLE ELSE 0.75::DOUBLE END AS confidence,
    CAST(CASE WHEN {_CAPPED} THEN NULL
         WHEN {_LINKED} AND NOT {_HEALTHY} THEN greatest(4, coalesce({_HOURS_LEFT}, 4))
         WHEN NOT {_LINKED} AND failure_type = 'insufficient_funds' THEN 24
         WHEN NOT {_LINKED} AND failure_type = 'bank_decline' THEN 4 END AS INTEGER) AS delay_hours,
    CAST(CASE WHEN NOT ({_CAPPED}) AND NOT {_LINKED} AND failure_type = 'cart_abandonment' THEN 10 END AS INTEGER) AS discount_pct
  FROM lnk l)"""


def _rules(src: str) -> str:
    """Stopping rules (I8) over a decision relation ``src`` → enforced columns."""
    is_retry = "decision IN ('retry_now', 'retry_delayed')"
    trig = f"({is_retry} AND retry_count_so_far >= 2 AND failure_type = 'bank_decline')"
    cap = f"({is_retry} AND retry_count_so_far >= 3)"
    cool = "(decision = 'retry_delayed' AND (delay_hours IS NULL OR delay_hours < 4))"
    over = "(decision = 'send_discount' AND discount_pct > 15)"
    action = f"CASE WHEN {trig} THEN 'escalate' WHEN {cap} THEN 'give_up' ELSE decision END"
    return f"""
    SELECT s.*,
      {action} AS allowed_action,
      ({action}) = decision AS allowed,
      nullif(concat_ws('; ',
        CASE WHEN {trig} THEN 'escalation_trigger: retry_count_so_far=' || CAST(retry_count_so_far AS VARCHAR) || ' >= 2 and failure_type=''bank_decline'''
             WHEN {cap} THEN 'max_retries_exceeded: retry_count_so_far=' || CAST(retry_count_so_far AS VARCHAR) || ' >= 3'
             WHEN {cool} THEN 'cooldown_enforced: delay_hours raised to minimum 4' END,
        CASE WHEN {over} THEN 'discount_capped: ' || CAST(discount_pct AS VARCHAR) || '% -> 15%' END), '') AS block_reason,
      CAST(CASE WHEN ({action}) = 'retry_delayed' THEN
        CASE WHEN {cool} AND NOT {trig} AND NOT {cap} THEN 4 ELSE delay_hours END END AS INTEGER) AS final_delay_hours,
      CAST(CASE WHEN ({action}) = 'send_discount' THEN
        CASE WHEN decision <> 'send_discount' THEN discount_pct WHEN discount_pct IS NULL THEN 15
             WHEN {over} THEN 15 ELSE discount_pct END END AS INTEGER) AS final_discount_pct
    FROM {src} s"""


def _outcome(src: str) -> str:
    now = "coalesce(ground_truth_recovery_probability, 0.0::DOUBLE)"
    after = f"coalesce(ground_truth_recovery_probability_after_recovery, {now})"
    linked = "coalesce(degradation_linked, false)"
    prob = f"""CASE allowed_action
        WHEN 'give_up' THEN 0.0::DOUBLE
        WHEN 'retry_now' THEN {now}
        WHEN 'retry_delayed' THEN CASE WHEN {linked} THEN {after} ELSE {clip(now + ' + 0.1::DOUBLE')} END
        WHEN 'reroute_gateway' THEN CASE WHEN {linked} THEN {after} ELSE {clip(now + ' + 0.1::DOUBLE')} END
        WHEN 'send_discount' THEN {clip(now + ' + 0.2::DOUBLE * (coalesce(final_discount_pct, 0) / 15.0::DOUBLE)')}
        WHEN 'send_reminder' THEN {clip(now + ' + 0.15::DOUBLE')}
        WHEN 'escalate' THEN {clip(now + ' + 0.3::DOUBLE')}
        ELSE {now} END"""
    return f"""
    o1 AS (SELECT s.*, {prob} AS probability_used,
             CAST(CAST('0x' || substr(md5(concat_ws('|', transaction_id, policy, '2026')), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296.0::DOUBLE AS u,
             CAST(round(amount * 100.0::DOUBLE) AS BIGINT) AS amount_paise,
             CASE WHEN allowed_action = 'give_up' THEN 0 ELSE 200 END AS cost_paise
           FROM {src} s),
    o2 AS (SELECT *, allowed_action <> 'give_up' AND u < probability_used AS success FROM o1),
    o3 AS (SELECT *, CASE WHEN success THEN amount_paise ELSE 0 END AS recovered_paise FROM o2),
    o4 AS (SELECT *, CAST(CASE WHEN success AND allowed_action = 'send_discount'
                  THEN floor((recovered_paise * CAST(coalesce(final_discount_pct, 0) AS BIGINT) + 50) / 100.0::DOUBLE) ELSE 0 END AS BIGINT) AS discount_paise FROM o3),
    o5 AS (SELECT *, recovered_paise - discount_paise - cost_paise AS net_paise,
             recovered_paise / 100.0::DOUBLE AS amount_recovered, discount_paise / 100.0::DOUBLE AS discount_cost,
             cost_paise / 100.0::DOUBLE AS action_cost,
             (recovered_paise - discount_paise - cost_paise) / 100.0::DOUBLE AS net_recovered FROM o4)"""


CTES["wide"] = f"""
dec_all AS (SELECT *, 0 AS batch_seq FROM dec_base UNION ALL BY NAME SELECT *, 1 AS batch_seq FROM dec_agent),
enf AS ({_rules('dec_all')}),
{_outcome('enf')},
wide AS (SELECT *, 'execute' AS status FROM o5)"""

CTES["tables"] = """
d_tab AS (SELECT policy || ':' || transaction_id AS decision_id, transaction_id, policy, decision, reasoning, confidence,
                 delay_hours, discount_pct, coalesce(degradation_linked, false) AS degradation_linked, event_id, batch_seq, seq
          FROM wide WHERE status = 'execute'),
a_tab AS (SELECT policy || ':' || transaction_id AS action_id, policy || ':' || transaction_id AS decision_id, transaction_id,
                 policy, allowed_action AS action_type, allowed, block_reason FROM wide WHERE status = 'execute'),
o_tab AS (SELECT policy || ':' || transaction_id AS outcome_id, policy || ':' || transaction_id AS action_id, transaction_id, policy,
                 success, amount_recovered, discount_cost, action_cost, net_recovered,
                 recovered_paise, discount_paise, cost_paise, net_paise FROM wide WHERE status = 'execute')"""

CTES["metrics"] = f"""
mbase AS (
  SELECT o.*, a.action_type AS allowed_action, d.decision, d.degradation_linked
  FROM o_tab o JOIN a_tab a USING (action_id) JOIN d_tab d ON a.decision_id = d.decision_id),
mseg AS (
  SELECT policy, 'overall' AS segment, * EXCLUDE (policy) FROM mbase
  UNION ALL SELECT policy, CASE WHEN degradation_linked THEN 'degradation_linked' ELSE 'non_degradation_linked' END, * EXCLUDE (policy) FROM mbase),
magg AS (
  SELECT policy, segment, count(*) AS total_transactions, count_if(success) AS successes,
    sum(CASE WHEN success THEN recovered_paise ELSE 0 END) AS gross_p, sum(net_paise) AS net_p,
    sum(discount_paise + cost_paise) AS cost_p, count_if(allowed_action = 'escalate') AS escalation_count
  FROM mseg GROUP BY 1, 2),
skel AS (SELECT * FROM (VALUES ('agent'), ('baseline')) p(policy),
         (VALUES ('overall'), ('degradation_linked'), ('non_degradation_linked')) s(segment)),
metrics AS (
  SELECT k.policy, k.segment,
    CAST(coalesce(total_transactions, 0) AS BIGINT) AS total_transactions,
    CAST(coalesce(successes, 0) AS BIGINT) AS successes,
    CASE WHEN coalesce(total_transactions, 0) > 0 THEN {r('coalesce(successes, 0) * 100.0::DOUBLE / total_transactions', 2)} ELSE 0.0::DOUBLE END AS recovery_rate_pct,
    coalesce(gross_p, 0) / 100.0::DOUBLE AS total_revenue_recovered_rs,
    coalesce(net_p, 0) / 100.0::DOUBLE AS net_revenue_recovered_rs,
    coalesce(cost_p, 0) / 100.0::DOUBLE AS total_cost_rs,
    CASE WHEN coalesce(gross_p, 0) > 0 THEN {r('coalesce(cost_p, 0) * 100.0::DOUBLE / gross_p', 2)} ELSE 0.0::DOUBLE END AS cost_to_recover_per_100,
    CAST(coalesce(escalation_count, 0) AS BIGINT) AS escalation_count
  FROM skel k LEFT JOIN magg m USING (policy, segment))"""

CTES["audit"] = """
audit_exec AS (
  SELECT policy, stage FROM wide, (VALUES ('decision'), ('rule_check'), ('action'), ('outcome')) s(stage) WHERE status = 'execute'
  UNION ALL SELECT policy, 'escalation' FROM wide WHERE status = 'execute' AND allowed_action = 'escalate'
  UNION ALL SELECT policy, 'action' FROM wide WHERE status <> 'execute'
  UNION ALL SELECT CAST(NULL AS VARCHAR), 'pipeline' FROM dev)"""


def _with(*names: str) -> str:
    order = ["att", "health", "enriched", "flagged", "dev", "peers", "rc", "txn", "lnk", "dec", "wide", "tables",
             "metrics", "audit"]
    need = set(names)
    deps = {"health": {"att"}, "enriched": {"health"}, "flagged": {"enriched"}, "dev": {"flagged"},
            "peers": {"dev"}, "rc": {"peers"}, "txn": {"att"}, "lnk": {"txn", "rc"}, "dec": {"lnk"},
            "wide": {"dec"}, "tables": {"wide"}, "metrics": {"tables"}, "audit": {"wide", "dev"}}
    changed = True
    while changed:
        changed = False
        for n in list(need):
            for d in deps.get(n, ()):
                if d not in need:
                    need.add(d)
                    changed = True
    return "WITH " + ",".join(CTES[n] for n in order if n in need) + "\n"


EV_COLS = "event_id, payment_method, bank_gateway, window_start, window_end, baseline_rate, current_rate, severity, z_score, n_rows"
DEC_COLS = "transaction_id, policy, decision, reasoning, confidence, delay_hours, discount_pct"

SQL: dict[str, str] = {}
SQL["hourly_rollup"] = _with("health") + "SELECT * FROM health"
SQL["rolling_baseline"] = _with("enriched") + "SELECT * FROM enriched"
SQL["breach_flags"] = _with("flagged") + (
    "SELECT payment_method, bank_gateway, ts, success_rate, rolling_baseline_success_rate, drop_pct_points, z_score, breach FROM flagged")
SQL["degradation_events"] = _with("dev") + f"SELECT {EV_COLS} FROM dev"
SQL["event_list"] = _with("dev") + f"SELECT {EV_COLS} FROM dev ORDER BY window_start, event_id"
SQL["severity_counts"] = _with("dev") + "SELECT severity, count(*) AS n_events FROM dev GROUP BY 1"
SQL["baseline_coverage"] = _with("enriched") + """SELECT payment_method, bank_gateway, count(*) AS n_rows,
  count(rolling_baseline_success_rate) AS n_with_baseline, min(ts) AS first_ts, max(ts) AS last_ts,
  min(success_rate) AS min_success_rate FROM enriched GROUP BY 1, 2"""
SQL["window_summary"] = _with("dev") + """SELECT e.event_id,
  CASE WHEN count(h.success_rate) > 0 THEN CAST(sum(CAST(h.success_rate AS DECIMAL(12,10))) AS DOUBLE) / CAST(count(h.success_rate) AS DOUBLE) END AS success_rate,
  CASE WHEN count(h.avg_latency_ms) > 0 THEN CAST(sum(CAST(h.avg_latency_ms AS DECIMAL(30,6))) AS DOUBLE) / CAST(count(h.avg_latency_ms) AS DOUBLE) END AS avg_latency_ms,
  CAST(coalesce(sum(h.transaction_volume), 0) AS BIGINT) AS transaction_volume
FROM dev e LEFT JOIN health h ON h.payment_method = e.payment_method AND h.bank_gateway = e.bank_gateway
  AND h.ts >= e.window_start AND h.ts < e.window_end
GROUP BY e.event_id"""
SQL["peer_gateway_rates"] = _with("peers") + "SELECT event_id, bank_gateway AS peer, n_rows, rate FROM peers WHERE is_peer_gateway"
SQL["peer_method_rates"] = _with("peers") + "SELECT event_id, payment_method AS peer, n_rows, rate FROM peers WHERE is_peer_method"
SQL["root_cause_class"] = _with("rc") + """SELECT event_id, classification, is_isolated, other_gateways_stable,
  other_methods_stable, global_other_slices_avg_rate, n_peer_gateways, n_peer_methods FROM rc"""
SQL["root_cause_statement"] = _with("rc") + "SELECT event_id, classification, root_cause_statement FROM rc"
SQL["peer_maps"] = _with("peers") + """SELECT event_id, 'gateway' AS kind, bank_gateway AS peer, rate FROM peers WHERE is_peer_gateway
UNION ALL SELECT event_id, 'method', payment_method, rate FROM peers WHERE is_peer_method"""
SQL["best_peer"] = _with("rc") + "SELECT event_id, best_peer, best_peer_rate FROM rc"
SQL["linked_transactions"] = _with("lnk") + """SELECT transaction_id, payment_method, bank_gateway, ts, event_id,
  degradation_linked, ground_truth_recovery_probability_after_recovery FROM lnk"""
SQL["linkage_summary"] = _with("lnk") + """SELECT (SELECT count(*) FROM dev) AS events_detected, count(*) AS transactions_total,
  count_if(degradation_linked) AS transactions_linked, count_if(degradation_linked = seed_linked) AS label_agreement FROM lnk"""
SQL["gt_probability_by_link"] = _with("lnk") + """SELECT degradation_linked, count(*) AS n,
  CAST(sum(CAST(ground_truth_recovery_probability AS DECIMAL(30,12))) AS DOUBLE) / CAST(count(ground_truth_recovery_probability) AS DOUBLE) AS mean_p_now,
  CAST(sum(CAST(ground_truth_recovery_probability_after_recovery AS DECIMAL(30,12))) AS DOUBLE) / CAST(count(ground_truth_recovery_probability_after_recovery) AS DOUBLE) AS mean_p_after
FROM lnk GROUP BY 1"""
SQL["baseline_decisions"] = _with("dec") + f"SELECT {DEC_COLS} FROM dec_base"
SQL["rule_decisions"] = _with("dec") + f"SELECT {DEC_COLS} FROM dec_agent"
SQL["stopping_rules"] = _with("dec") + f"""SELECT transaction_id, decision, retry_count_so_far, failure_type, allowed_action,
  allowed, block_reason, final_delay_hours, final_discount_pct FROM ({_rules('dec_agent')})"""
SQL["outcome_expected"] = _with("dec") + f"""SELECT transaction_id, policy, allowed_action, probability_used,
  probability_used * amount AS expected_recovered, action_cost FROM (
  WITH enf_a AS ({_rules('dec_agent')}), {_outcome('enf_a')} SELECT * FROM o5)"""
SQL["outcome_drawn"] = _with("wide") + """SELECT transaction_id, policy, allowed_action, probability_used, u, success,
  amount_recovered, discount_cost, action_cost, net_recovered FROM wide"""
SQL["policy_metrics"] = _with("metrics") + "SELECT * FROM metrics"
SQL["policy_comparison"] = _with("metrics") + f"""SELECT
  CASE WHEN has_run THEN {r('a_net - b_net', 2)} END AS net_revenue_delta_rs,
  CASE WHEN has_run THEN {r('a_rate - b_rate', 2)} END AS recovery_rate_delta_pct_points,
  CASE WHEN has_run THEN {r('a_lrate - b_lrate', 2)} END AS degradation_linked_recovery_rate_delta_pct_points,
  CASE WHEN has_run THEN {r('a_lnet - b_lnet', 2)} END AS degradation_linked_net_revenue_delta_rs
FROM (SELECT
  max(CASE WHEN policy = 'agent' AND segment = 'overall' THEN net_revenue_recovered_rs END) AS a_net,
  max(CASE WHEN policy = 'baseline' AND segment = 'overall' THEN net_revenue_recovered_rs END) AS b_net,
  max(CASE WHEN policy = 'agent' AND segment = 'overall' THEN recovery_rate_pct END) AS a_rate,
  max(CASE WHEN policy = 'baseline' AND segment = 'overall' THEN recovery_rate_pct END) AS b_rate,
  max(CASE WHEN policy = 'agent' AND segment = 'degradation_linked' THEN recovery_rate_pct END) AS a_lrate,
  max(CASE WHEN policy = 'baseline' AND segment = 'degradation_linked' THEN recovery_rate_pct END) AS b_lrate,
  max(CASE WHEN policy = 'agent' AND segment = 'degradation_linked' THEN net_revenue_recovered_rs END) AS a_lnet,
  max(CASE WHEN policy = 'baseline' AND segment = 'degradation_linked' THEN net_revenue_recovered_rs END) AS b_lnet,
  coalesce(max(CASE WHEN policy = 'agent' AND segment = 'overall' THEN total_transactions END), 0) > 0 AND
  coalesce(max(CASE WHEN policy = 'baseline' AND segment = 'overall' THEN total_transactions END), 0) > 0 AS has_run
FROM metrics)"""
SQL["idempotent_rerun"] = _with("wide") + """SELECT policy, 'skipped_duplicate' AS status, count(*) AS n FROM wide GROUP BY 1"""
SQL["audit_fanout"] = _with("audit") + "SELECT policy, stage, count(*) AS n_rows FROM audit_exec GROUP BY 1, 2"
SQL["audit_filter"] = _with("wide") + """SELECT CAST(batch_seq AS BIGINT) AS batch_seq, CAST(seq AS BIGINT) AS seq, transaction_id,
  3 AS ordinal, policy, 'escalation' AS stage,
  json_object('reason', coalesce(block_reason, 'agent_decision'), 'failure_type', failure_type, 'amount', amount)::VARCHAR AS detail
FROM wide WHERE status = 'execute' AND allowed_action = 'escalate' AND policy = 'agent'
ORDER BY batch_seq DESC, seq DESC, transaction_id DESC"""
SQL["escalation_records"] = _with("wide") + """SELECT transaction_id, policy, coalesce(block_reason, 'agent_decision') AS reason,
  failure_type, amount FROM wide WHERE status = 'execute' AND allowed_action = 'escalate'"""
SQL["audit_export"] = SQL["escalation_records"]
SQL["scored_decisions"] = _with("lnk") + """SELECT transaction_id, i % 97 = 0 OR i % 5 <> 4 AS is_valid,
  CASE WHEN i % 97 = 0 OR i % 5 <> 4 THEN 'execute' ELSE 'skipped_invalid_decision_schema' END AS status,
  CASE WHEN i % 97 = 0 OR i % 5 = 2 THEN 'escalate' ELSE 'retry_delayed' END AS decision,
  CASE WHEN i % 97 = 0 OR i % 5 = 2 THEN 'scoring failed; handed to a person' ELSE 'answer to ' || i END AS reasoning,
  CASE WHEN i % 97 = 0 OR i % 5 = 2 THEN 0.0::DOUBLE ELSE 0.5::DOUBLE END AS confidence,
  CASE WHEN i % 97 <> 0 AND i % 5 NOT IN (2, 4) THEN CAST(i % 7 AS INTEGER) END AS delay_hours
FROM (SELECT transaction_id, CAST(transaction_id AS BIGINT) AS i FROM lnk)"""
SQL["decision_feed"] = _with("tables") + """SELECT decision_id, transaction_id, policy, decision, ts, amount, action_type, allowed,
  block_reason, success, net_recovered, NOT coalesce(allowed, true) AND block_reason IS NOT NULL AS overridden
FROM d_tab d JOIN lnk t USING (transaction_id) LEFT JOIN a_tab a USING (decision_id, transaction_id, policy)
  LEFT JOIN o_tab o USING (action_id, transaction_id, policy)
WHERE d.policy = 'agent'
ORDER BY ts DESC, transaction_id DESC, policy DESC LIMIT 25 OFFSET 25"""
SQL["feed_total"] = _with("tables") + """SELECT count(*) AS total, CAST(greatest(1, ceil(count(*) / 25.0)) AS BIGINT) AS pages
FROM d_tab WHERE policy = 'agent' AND degradation_linked"""
SQL["escalation_queue"] = _with("tables") + """SELECT d.decision_id, d.transaction_id, d.policy, d.reasoning, d.confidence,
  t.amount, t.failure_type, t.customer_history, t.payment_method, t.bank_gateway, t.retry_count_so_far, a.block_reason
FROM d_tab d JOIN lnk t ON d.transaction_id = t.transaction_id JOIN a_tab a ON a.decision_id = d.decision_id
WHERE a.action_type = 'escalate' AND d.policy = 'agent' ORDER BY t.amount DESC, d.transaction_id"""
SQL["slice_catalog"] = _with("health") + """SELECT * FROM (
  SELECT DISTINCT 'payment_method' AS kind, payment_method AS name FROM health
  UNION ALL SELECT DISTINCT 'bank_gateway', bank_gateway FROM health) ORDER BY 1, 2"""
SQL["timeseries_page"] = _with("health") + """SELECT * FROM health WHERE payment_method = 'm1'
ORDER BY ts, payment_method, bank_gateway"""
SQL["health_pivot"] = _with("health") + "SELECT ts, " + ", ".join(
    f"max(CASE WHEN bank_gateway = 'g{i}' THEN success_rate END) AS g{i}" for i in range(6)
) + " FROM health WHERE payment_method = 'm0' GROUP BY ts"
SQL["sample_per_group"] = _with("lnk") + """SELECT transaction_id, degradation_linked, ts, rn FROM (
  SELECT *, row_number() OVER (PARTITION BY degradation_linked ORDER BY ts, transaction_id) AS rn FROM lnk)
WHERE rn <= CASE WHEN degradation_linked THEN 3 ELSE 2 END"""
SQL["policy_union"] = _with("wide") + "SELECT policy, decision, count(*) AS n FROM wide GROUP BY 1, 2"
SQL["prompt_text"] = _with("lnk") + """SELECT transaction_id,
  'Pick one recovery step for this failed payment and answer in the decision schema.' || chr(10) ||
  json_object('id', transaction_id, 'slice', payment_method || '/' || bank_gateway,
    'failed_at', strftime(ts, '%Y-%m-%dT%H:%M:%S'), 'amount', printf('%.2f', amount), 'tier', customer_history,
    'retries', retry_count_so_far, 'failure', failure_type, 'in_outage', coalesce(degradation_linked, false),
    'outage', CASE WHEN degradation_linked THEN root_cause_statement END)::VARCHAR AS prompt
FROM lnk"""
SQL["unit_checks"] = _with("lnk") + f"""SELECT transaction_id,
  {r('amount / 3.0::DOUBLE', 2)} AS third_amount_2dp,
  {r('ground_truth_recovery_probability * 1.37::DOUBLE', 4)} AS scaled_p_4dp,
  {clip('ground_truth_recovery_probability + 0.3::DOUBLE')} AS clipped_p,
  coalesce(event_id, 0) AS event_id_or_zero
FROM lnk"""

_LABELS = """labels AS (
  SELECT payment_method, bank_gateway,
    TIMESTAMP '2024-01-03 06:00:00' + to_days(CAST(substr(payment_method, 2) AS INTEGER) * 6 + CAST(substr(bank_gateway, 2) AS INTEGER)) AS label_start,
    TIMESTAMP '2024-01-03 06:00:00' + to_days(CAST(substr(payment_method, 2) AS INTEGER) * 6 + CAST(substr(bank_gateway, 2) AS INTEGER)) + INTERVAL 168 HOUR AS label_end
  FROM (SELECT DISTINCT payment_method, bank_gateway FROM health)),
pairs AS (
  SELECT l.payment_method, l.bank_gateway, l.label_start, e.event_id, e.window_start,
    row_number() OVER (PARTITION BY l.payment_method, l.bank_gateway, l.label_start
                       ORDER BY abs(epoch(e.window_start) - epoch(l.label_start)), e.event_id) AS rn
  FROM labels l JOIN dev e ON e.payment_method = l.payment_method AND e.bank_gateway = l.bank_gateway
    AND e.window_start < l.label_end AND e.window_end > l.label_start),
bt AS (
  SELECT l.*, p.event_id AS matched_event_id, p.window_start AS matched_start, p.event_id IS NOT NULL AS hit
  FROM labels l LEFT JOIN (SELECT * FROM pairs WHERE rn = 1) p USING (payment_method, bank_gateway, label_start))"""
SQL["detection_backtest"] = _with("dev") .rstrip() + ",\n" + _LABELS + "\nSELECT * FROM bt"
SQL["backtest_summary"] = _with("dev").rstrip() + ",\n" + _LABELS + """
SELECT labels, hits, labels - hits AS missed, events, events_on_labels,
  CASE WHEN labels > 0 THEN hits / labels END AS recall,
  CASE WHEN events > 0 THEN events_on_labels / events END AS precision
FROM (SELECT count(*) AS labels, count_if(hit) AS hits FROM bt),
     (SELECT count(*) AS events FROM dev),
     (SELECT count(DISTINCT event_id) AS events_on_labels FROM pairs)"""


def _kind(f: str) -> str:
    t = f"json_type(j, '$.{f}')"
    return (f"CASE WHEN {t} IS NULL THEN 'missing' WHEN {t} = 'NULL' THEN 'null' WHEN {t} = 'VARCHAR' THEN 'string' "
            f"WHEN {t} = 'BOOLEAN' THEN 'boolean' WHEN {t} IN ('BIGINT', 'UBIGINT', 'DOUBLE') THEN 'number' ELSE 'other' END")


def _num(f: str) -> str:
    return (f"CASE WHEN k_{f} IN ('number', 'string') THEN TRY_CAST(json_extract_string(j, '$.{f}') AS DOUBLE) "
            f"WHEN k_{f} = 'boolean' THEN CASE WHEN json_extract_string(j, '$.{f}') = 'true' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END END")


def _int_problem(f: str) -> str:
    bad_type = f"k_{f} NOT IN ('missing', 'null', 'number', 'boolean', 'string')"
    not_whole = f"(n_{f} IS NULL OR isnan(n_{f}) OR n_{f} <> floor(n_{f}))"
    return f"CASE WHEN {bad_type} OR (k_{f} NOT IN ('missing', 'null') AND {not_whole}) THEN '{f} is not an integer' END"


_ALLOWED = "('retry_now', 'retry_delayed', 'send_discount', 'send_reminder', 'reroute_gateway', 'escalate', 'give_up')"
_FIELDS = ("transaction_id", "decision", "reasoning", "confidence", "delay_hours", "discount_pct")

CTES["rawd"] = """
rawd0 AS (SELECT transaction_id AS tid, epoch_us(ts) AS t_us, CAST(TRY_CAST(transaction_id AS BIGINT) % 16 AS INTEGER) AS k,
                 retry_count_so_far FROM lnk),
rawd1 AS (
  SELECT tid, t_us, k,
    CASE WHEN k = 15 THEN 'not json' ELSE '{' || concat_ws(', ',
      '"transaction_id": ' || CASE WHEN k = 8 THEN tid ELSE '"' || tid || '"' END,
      '"decision": "' || CASE WHEN k = 3 THEN 'retry_later' WHEN retry_count_so_far >= 3 THEN 'give_up' ELSE 'retry_now' END || '"',
      CASE WHEN k = 1 THEN NULL ELSE '"reasoning": ' || CASE WHEN k = 11 THEN 'null' WHEN k = 14 THEN '""' ELSE '"reason ' || tid || '"' END END,
      CASE WHEN k = 2 THEN NULL ELSE '"confidence": ' || CASE WHEN k = 0 THEN '"0.8"' WHEN k = 4 THEN '1.0001' WHEN k = 9 THEN 'true' ELSE '0.9' END END,
      '"delay_hours": ' || CASE k WHEN 5 THEN '4.0' WHEN 6 THEN '"4"' WHEN 7 THEN '4.5' WHEN 12 THEN '"4.5"' ELSE 'null' END,
      '"discount_pct": ' || CASE WHEN k = 13 THEN 'true' ELSE 'null' END,
      CASE WHEN k = 10 THEN '"note": "extra"' END) || '}' END AS raw
  FROM rawd0),
rawd AS (
  SELECT t_us * 4 + c AS seq, CASE WHEN c = 2 THEN 'x' || tid ELSE tid END AS transaction_id, 'agent' AS policy, raw
  FROM rawd1, (SELECT unnest([0, 1, 2]) AS c) cs
  WHERE c = 0 OR (c = 1 AND k = 0) OR (c = 2 AND k = 5))"""

CTES["parsed"] = f"""
pj AS (SELECT *, coalesce(json_valid(raw), false) AS okjson FROM rawd),
pj2 AS (SELECT *, CASE WHEN okjson THEN raw ELSE '{{}}' END AS j FROM pj),
pk AS (SELECT *, {", ".join(f"{_kind(f)} AS k_{f}" for f in _FIELDS)} FROM pj2),
pn AS (SELECT *, {", ".join(f"{_num(f)} AS n_{f}" for f in ("confidence", "delay_hours", "discount_pct"))},
         json_extract_string(j, '$.decision') AS t_decision FROM pk),
parsed AS (
  SELECT seq, transaction_id, policy, raw,
    CASE WHEN raw IS NULL THEN 'escalate' ELSE t_decision END AS decision,
    n_confidence AS confidence,
    CAST(CASE WHEN n_delay_hours = floor(n_delay_hours) THEN n_delay_hours END AS INTEGER) AS delay_hours,
    CAST(CASE WHEN n_discount_pct = floor(n_discount_pct) THEN n_discount_pct END AS INTEGER) AS discount_pct,
    nullif(concat_ws('; ',
      CASE WHEN NOT okjson OR json_type(j) <> 'OBJECT' THEN 'not a JSON object' END,
      {", ".join(f"CASE WHEN k_{f} <> 'string' THEN '{f} must be a string' END" for f in ("transaction_id", "decision", "reasoning"))},
      CASE WHEN k_confidence IN ('missing', 'null') THEN 'confidence is required'
           WHEN n_confidence IS NULL OR isnan(n_confidence) OR n_confidence < 0 OR n_confidence > 1 THEN 'confidence must be within [0, 1]' END,
      {_int_problem("delay_hours")},
      {_int_problem("discount_pct")},
      CASE WHEN k_decision = 'string' AND t_decision NOT IN {_ALLOWED} THEN 'decision is not an allowed value' END
    ), '') AS invalid_reason
  FROM pn),
routed AS (
  SELECT p.*, p.invalid_reason IS NULL AS is_valid, t.transaction_id IS NOT NULL AS known,
    row_number() OVER (PARTITION BY p.transaction_id, p.policy
                       ORDER BY CASE WHEN t.transaction_id IS NOT NULL AND p.invalid_reason IS NULL THEN 0 ELSE 1 END, p.seq) AS rn
  FROM parsed p LEFT JOIN lnk t ON p.transaction_id = t.transaction_id)"""

SQL["decision_validation"] = _with("lnk").rstrip() + "," + CTES["rawd"] + "," + CTES["parsed"] + """
SELECT seq, transaction_id, is_valid, invalid_reason,
  CASE WHEN NOT known THEN 'skipped_unknown_transaction' WHEN NOT is_valid THEN 'skipped_invalid_decision_schema'
       WHEN rn > 1 THEN 'skipped_duplicate' ELSE 'execute' END AS status,
  decision, confidence, delay_hours, discount_pct
FROM routed"""

# Closed cells and those the end of the input closes
SQL["stream_rollup"] = SQL["hourly_rollup"]
# S3: same rows as the batch linkage
SQL["stream_linkage"] = SQL["linked_transactions"]
# Same outcomes as the batch run
SQL["stream_decisions"] = _with("wide") + """SELECT transaction_id, policy, success, amount_recovered, discount_cost,
  action_cost, net_recovered FROM wide"""

# Every event of the batch detection, the runs open at the end included
SQL["stream_events"] = _with("dev") + f"SELECT {EV_COLS.replace('event_id, ', '')} FROM dev"


# Second source: order lines (grain 24 h)
OL_G = 24
_OL_HEALTH = f"""
health AS (
  SELECT time_bucket(INTERVAL '{OL_G} hours', CAST(o.o_orderdate AS TIMESTAMP), TIMESTAMP '1970-01-01') AS ts,
    o.o_orderpriority AS payment_method, c.c_mktsegment AS bank_gateway,
    CASE WHEN count(l.l_returnflag) > 0 THEN CAST(sum(CAST(l.l_returnflag <> 'R' AS INTEGER)) AS DOUBLE)
         / CAST(count(l.l_returnflag) AS DOUBLE) END AS success_rate,
    CASE WHEN count(l.l_extendedprice) > 0 THEN CAST(sum(CAST(l.l_extendedprice AS DECIMAL(30,6))) AS DOUBLE)
         / CAST(count(l.l_extendedprice) AS DOUBLE) END AS avg_latency_ms,
    count(*) AS transaction_volume
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey
  WHERE o.o_orderpriority IS NOT NULL AND c.c_mktsegment IS NOT NULL AND o.o_orderdate IS NOT NULL
  GROUP BY 1, 2, 3)"""
_OL_DEV = CTES["dev"].replace(f"INTERVAL {G} HOUR", f"INTERVAL {OL_G} HOUR")
assert _OL_DEV != CTES["dev"]
_OL_WITH = "WITH " + ",".join([_OL_HEALTH, CTES["enriched"], CTES["flagged"], _OL_DEV, CTES["peers"], CTES["rc"]]) + "\n"
SQL["order_line_health"] = _OL_WITH + "SELECT * FROM health"
SQL["order_line_events"] = _OL_WITH + f"SELECT {EV_COLS} FROM dev"
SQL["order_line_root_cause"] = _OL_WITH + """SELECT event_id, classification, is_isolated, global_other_slices_avg_rate,
  n_peer_gateways, n_peer_methods, best_peer, best_peer_rate, root_cause_statement FROM rc"""


# J3 and I15
SQL["recovery_chart"] = _with("metrics") + """SELECT segment,
  max(CASE WHEN policy = 'agent' THEN net_revenue_recovered_rs END) AS agent_net_rs,
  max(CASE WHEN policy = 'agent' THEN recovery_rate_pct END) AS agent_rate_pct,
  max(CASE WHEN policy = 'baseline' THEN net_revenue_recovered_rs END) AS baseline_net_rs,
  max(CASE WHEN policy = 'baseline' THEN recovery_rate_pct END) AS baseline_rate_pct
FROM metrics GROUP BY segment"""
SQL["batch_results"] = _with("wide") + """SELECT transaction_id, policy, coalesce(degradation_linked, false) AS degradation_linked,
  decision, status, allowed_action, success, net_recovered FROM wide"""

# Round trips give back what went in
SQL["csv_round_trip"] = _with("health") + "SELECT * FROM health"
SQL["rebuild_store"] = SQL["csv_round_trip"]
SQL["reload_decisions"] = SQL["rule_decisions"]
# every decision twice and once without an id: unknown and invalid rows count twice, one row per key executes
SQL["routing_repeats"] = "WITH s AS (" + SQL["decision_validation"] + """),
c AS (SELECT count(*) AS total, count(*) FILTER (status = 'skipped_unknown_transaction') AS u,
        count(*) FILTER (status = 'skipped_invalid_decision_schema') AS i, count(*) FILTER (status = 'execute') AS e,
        count(*) FILTER (status = 'skipped_duplicate') AS d FROM s)
SELECT 'skipped_unknown_transaction' AS status, 2 * u + total AS n FROM c
UNION ALL SELECT 'skipped_invalid_decision_schema', 2 * i FROM c
UNION ALL SELECT 'execute', e FROM c
UNION ALL SELECT 'skipped_duplicate', e + 2 * d FROM c"""

# A3: the lines as text; a field too many makes a line bad, text that is no number names its column
SQL["raw_round_trip"] = _with("lnk") + '''SELECT transaction_id || ',"' || payment_method || ', ""card""",' || strftime(ts, '%Y-%m-%d %H:%M:%S') || ',' ||
    CASE i % 10 WHEN 4 THEN 'n/a' WHEN 5 THEN 'NaN' ELSE CAST(CAST(amount AS DECIMAL(30,6)) AS VARCHAR) END || ',' || retry_count_so_far
    || CASE WHEN i % 10 = 3 THEN ',more' ELSE '' END AS raw,
  CASE i % 10 WHEN 3 THEN 'ragged' WHEN 4 THEN 'amount' ELSE '' END AS problems,
  CASE WHEN i % 10 NOT IN (3, 4) THEN payment_method || ', "card"' END AS payment_method,
  CASE WHEN i % 10 NOT IN (3, 4, 5) THEN CAST(CAST(amount AS DECIMAL(30,6)) AS DOUBLE) END AS amount
FROM (SELECT *, CAST(transaction_id AS BIGINT) AS i FROM lnk)'''
SQL["csv_transactions"] = _with("lnk") + """, one AS (SELECT * FROM dev ORDER BY window_start - window_end, event_id LIMIT 1)
SELECT t.transaction_id, t.ts, t.amount, t.failure_type, o.event_id, o.event_id IS NOT NULL AS degradation_linked,
  t.degradation_linked AS seed_linked
FROM lnk t LEFT JOIN one o ON t.payment_method = o.payment_method AND t.bank_gateway = o.bank_gateway
  AND t.ts >= o.window_start AND t.ts < o.window_end"""
SQL["event_list_top"] = _with("dev") + f"""SELECT {EV_COLS} FROM dev WHERE payment_method = 'm1' ORDER BY window_start, event_id LIMIT 10"""
SQL["long_window_linkage"] = _with("lnk") + """, long AS (
  SELECT payment_method, bank_gateway, 1000000 - event_id AS event_id,
    window_start - INTERVAL '10 minutes' * (event_id % 7) AS lo, window_end + INTERVAL '37 hours' * (event_id % 300) AS hi FROM dev)
SELECT t.transaction_id, min(e.event_id) AS event_id, min(e.event_id) IS NOT NULL AS degradation_linked
FROM lnk t LEFT JOIN long e ON t.payment_method = e.payment_method AND t.bank_gateway = e.bank_gateway AND t.ts >= e.lo AND t.ts < e.hi
GROUP BY t.transaction_id"""
SQL["incremental_rollup"] = SQL["hourly_rollup"]
SQL["append_merge"] = SQL["csv_round_trip"]
SQL["rebuild_atomic"] = _with("dev") + """SELECT h.*, moment, (SELECT count(*) FROM dev) AS events_stored
FROM health h, (VALUES ('during'), ('after')) AS m(moment)"""
SQL["refused_transactions"] = _with("lnk") + """SELECT transaction_id, 'repeated id' AS reason, 2 AS n FROM lnk
WHERE CAST(transaction_id AS BIGINT) % 10 = 0
UNION ALL SELECT NULL, 'no id', count(*) FROM lnk WHERE CAST(transaction_id AS BIGINT) % 11 = 0 HAVING count(*) > 0"""
SQL["stored_run"] = _with("wide") + """SELECT policy || ':' || transaction_id AS decision_id, policy || ':' || transaction_id AS action_id,
  policy || ':' || transaction_id AS outcome_id, transaction_id, policy, decision, confidence, delay_hours, discount_pct,
  coalesce(degradation_linked, false) AS degradation_linked, event_id, allowed_action AS action_type, allowed, block_reason, success, net_recovered
FROM wide WHERE status = 'execute'"""
SQL["redelivered_outcomes"] = _with("wide") + """SELECT transaction_id, policy, 1 AS outcomes, net_recovered,
  CASE WHEN CAST(transaction_id AS BIGINT) % 4 <> 0 THEN 1 ELSE 0 END AS of_first_run FROM wide"""
SQL["stream_late_linkage"] = SQL["linked_transactions"]
# I11 with observed successes: the money follows from the amount, the discount and the action
SQL["outcome_observed"] = _with("wide") + """, seen AS (
  SELECT w.*, allowed_action <> 'give_up' AND EXISTS (SELECT 1 FROM att a WHERE a.ok AND 'cust_' || a.user_id = w.customer_id
    AND a.ts > w.ts AND a.ts <= w.ts + INTERVAL '24 hours') AS won FROM wide w WHERE policy = 'agent'),
money AS (
  SELECT *, CASE WHEN won THEN CAST(round(amount * 100.0::DOUBLE) AS BIGINT) ELSE 0 END AS rec,
    CASE WHEN allowed_action = 'give_up' THEN 0 ELSE 200 END AS cost FROM seen),
cut AS (
  SELECT *, CASE WHEN won AND allowed_action = 'send_discount' THEN (rec * coalesce(final_discount_pct, 0) + 50) // 100 ELSE 0 END AS disc FROM money)
SELECT transaction_id, allowed_action, won AS success, rec / 100.0::DOUBLE AS amount_recovered, disc / 100.0::DOUBLE AS discount_cost,
  cost / 100.0::DOUBLE AS action_cost, (rec - disc - cost) / 100.0::DOUBLE AS net_recovered FROM cut"""
