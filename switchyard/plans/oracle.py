"""DuckDB oracle SQL for every registered query with a relational definition.

Written independently of the Spark operators (plain SQL over the same parquet
views) so that the driver's side-by-side comparison checks the operators, not
a copy of them.  Fixture views come first as CTE text.
"""

from __future__ import annotations

# ---------------------------------------------------------------- fixtures
LI_SUMMARY = """
li AS (
  SELECT l_orderkey, min(l_shipdate) AS first_ship, max(l_shipdate) AS last_ship,
         min(l_suppkey) AS min_supp, count(DISTINCT l_suppkey) AS n_supp,
         count(*) AS n_lines, count(*) FILTER (WHERE l_returnflag = 'R') AS n_returned
  FROM lineitem GROUP BY l_orderkey)"""

GEO = """
geo AS (
  SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey)"""

RAW = LI_SUMMARY + "," + GEO + """,
raw AS (
  SELECT o_orderkey AS ticket_id, o_orderdate AS created_at, li.first_ship AS first_response_at,
         CASE WHEN o_orderstatus <> 'P' THEN li.last_ship END AS resolved_at,
         CASE WHEN o_orderstatus = 'P' THEN 'pending' ELSE 'closed' END AS status,
         o_orderpriority AS channel, o_custkey AS customer_id, c_mktsegment AS category,
         geo.r_name AS assigned_team, li.min_supp AS agent_id,
         CASE WHEN o_orderstatus <> 'F' THEN li.n_supp - 1 END AS transfers,
         CASE WHEN li.n_returned > 0 THEN 1 + (7 * li.n_returned + li.n_lines) % 5 END AS csat_score,
         CASE WHEN o_orderstatus = 'F' THEN 'legacy' ELSE 'helpdesk' END AS source_system
  FROM orders JOIN customer ON o_custkey = c_custkey
  JOIN geo ON c_nationkey = geo.n_nationkey
  LEFT JOIN li ON li.l_orderkey = o_orderkey)"""

AGENTS = """,
agents AS (
  SELECT s_suppkey AS agent_id, g.n_name AS site, g.r_name AS team,
         CASE WHEN g.r_name = 'MIDDLE EAST' THEN 2 ELSE 1 END AS tier
  FROM supplier JOIN geo g ON s_nationkey = g.n_nationkey)"""

PREP = RAW + AGENTS + """,
prep0 AS (
  SELECT raw.*, created_at AS created_dt, first_response_at AS first_response_dt,
         resolved_at AS resolved_dt_raw,
         CASE WHEN source_system = 'legacy' THEN resolved_at + INTERVAL 330 MINUTE
              ELSE resolved_at END AS resolved_dt,
         strftime(created_at, '%Y-%m') AS month,
         agents.team AS resolved_team, agents.tier
  FROM raw LEFT JOIN agents ON raw.agent_id = agents.agent_id
  WHERE created_at >= TIMESTAMP '1996-01-01' AND created_at < TIMESTAMP '2000-07-01'),
prep AS (
  SELECT *,
    CASE WHEN assigned_team = resolved_team THEN false ELSE true END AS rerouted,
    date_diff('microsecond', created_dt, first_response_dt) / 60000000.0 AS response_minutes,
    date_diff('microsecond', created_dt, resolved_dt) / 60000000.0 AS resolution_minutes,
    CASE channel WHEN '1-URGENT' THEN 43200 WHEN '2-HIGH' THEN 86400
                 WHEN '4-NOT SPECIFIED' THEN 259200 WHEN '5-LOW' THEN 525600 END AS sla_target_minutes,
    CASE resolved_team WHEN 'ASIA' THEN 'BUILDING' WHEN 'EUROPE' THEN 'MACHINERY'
                       WHEN 'AFRICA' THEN 'HOUSEHOLD' WHEN 'AMERICA' THEN 'FURNITURE'
                       ELSE category END AS training_category
  FROM prep0),
fact AS (
  SELECT *, coalesce(response_minutes > sla_target_minutes, false) AS sla_breach FROM prep)"""


def with_(*ctes: str) -> str:
    return "WITH " + ",".join(c.strip().lstrip(",") for c in ctes) + "\n"


FACT = with_(PREP)

Q: dict[str, str] = {}

Q["routing_matrix"] = FACT + """
SELECT assigned_team, resolved_team, count(*)::BIGINT AS n FROM fact
WHERE assigned_team IS NOT NULL AND resolved_team IS NOT NULL
GROUP BY 1, 2"""


def oracle_sql() -> dict[str, str]:
    return dict(Q)

# ------------------------------------------------------------ ticket side
Q["scan_prepared"] = FACT + """
SELECT ticket_id, created_dt, month, channel, category, assigned_team, resolved_team, agent_id,
       source_system, status, transfers, csat_score, rerouted, sla_breach, training_category
FROM fact"""

Q["typed_scan"] = with_(RAW) + """
SELECT ticket_id, created_at AS created_dt, first_response_at AS first_response_dt,
       resolved_at AS resolved_dt_raw, CAST(transfers AS INTEGER) AS transfers,
       CAST(csat_score AS INTEGER) AS csat_score, channel
FROM raw"""

Q["rejected_cells"] = """
SELECT l_orderkey, l_linenumber, 'l_quantity' AS cell, CAST(l_quantity AS VARCHAR) AS value, 'not a whole number' AS reason
FROM lineitem WHERE l_quantity <> floor(l_quantity)
UNION ALL
SELECT l_orderkey, l_linenumber, 'l_discount', CAST(l_discount AS VARCHAR), 'not a whole number' FROM lineitem WHERE l_discount <> floor(l_discount)
UNION ALL
SELECT l_orderkey, l_linenumber, 'l_tax', CAST(l_tax AS VARCHAR), 'not a whole number' FROM lineitem WHERE l_tax <> floor(l_tax)"""

Q["dq_orphan_keys"] = """
SELECT CAST(l_suppkey AS VARCHAR) AS key, count(*)::BIGINT AS n_rows
FROM lineitem
WHERE l_suppkey IS NOT NULL AND l_suppkey NOT IN (SELECT s_suppkey FROM supplier)
GROUP BY 1"""

Q["dq_bad_domain"] = """
SELECT o_orderpriority AS value, count(*)::BIGINT AS n_rows FROM orders
WHERE o_orderpriority IS NOT NULL
  AND o_orderpriority NOT IN ('1-URGENT', '2-HIGH', '4-NOT SPECIFIED', '5-LOW')
GROUP BY 1"""

Q["dq_duplicate_keys"] = """
SELECT l_orderkey, l_linenumber, count(*)::BIGINT AS n_rows FROM lineitem
GROUP BY 1, 2 HAVING count(*) > 1"""

Q["dq_dim_unique"] = with_(GEO) + """, hist AS (
  SELECT s_suppkey AS agent_id FROM supplier JOIN geo g1 ON s_nationkey = g1.n_nationkey
  UNION ALL
  SELECT s_suppkey FROM supplier JOIN geo g2 ON (s_nationkey + 5) % 25 = g2.n_nationkey)
SELECT agent_id, count(*)::BIGINT AS n_rows FROM hist GROUP BY 1 HAVING count(*) > 1"""

Q["dq_input_violations"] = with_(RAW) + """, hist AS (
  SELECT s_suppkey AS agent_id FROM supplier JOIN geo g1 ON s_nationkey = g1.n_nationkey
  UNION ALL
  SELECT s_suppkey FROM supplier JOIN geo g2 ON (s_nationkey + 5) % 25 = g2.n_nationkey)
SELECT 'unknown_agent' AS "check", CAST(agent_id AS VARCHAR) AS value, count(*)::BIGINT AS n_rows FROM raw
WHERE agent_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM hist h WHERE h.agent_id = raw.agent_id) GROUP BY 2
UNION ALL
SELECT 'bad_channel', channel, count(*) FROM raw
WHERE channel NOT IN ('1-URGENT', '2-HIGH', '4-NOT SPECIFIED', '5-LOW') GROUP BY 2
UNION ALL
SELECT 'repeated_ticket', CAST(ticket_id AS VARCHAR), count(*) FROM raw GROUP BY 2 HAVING count(*) > 1
UNION ALL
SELECT 'repeated_agent', CAST(agent_id AS VARCHAR), count(*) FROM hist GROUP BY 2 HAVING count(*) > 1"""

Q["dq_scope_exclusions"] = with_(RAW) + """
SELECT count(*)::BIGINT AS n_rows,
       count(*) FILTER (WHERE created_at < TIMESTAMP '1996-01-01')::BIGINT AS n_before_window,
       count(*) FILTER (WHERE created_at >= TIMESTAMP '2000-07-01')::BIGINT AS n_after_window,
       count(*) FILTER (WHERE created_at IS NULL)::BIGINT AS n_unparsed,
       count(*) FILTER (WHERE created_at >= TIMESTAMP '1996-01-01'
                          AND created_at < TIMESTAMP '2000-07-01')::BIGINT AS n_in_window
FROM raw"""

Q["dq_negative_duration"] = with_(RAW) + """
SELECT 'tickets_resolved_before_created_raw' AS measure,
       count(*) FILTER (WHERE resolved_at < created_at)::BIGINT AS n FROM raw
UNION ALL
SELECT 'tickets_resolved_before_created_repaired',
       count(*) FILTER (WHERE (CASE WHEN source_system = 'legacy' THEN resolved_at + INTERVAL 330 MINUTE
                                    ELSE resolved_at END) < created_at)::BIGINT FROM raw
UNION ALL
SELECT 'lines_shipped_before_order', count(*) FILTER (WHERE l_shipdate < o_orderdate)::BIGINT
FROM lineitem JOIN orders ON l_orderkey = o_orderkey"""

Q["dq_null_profile"] = FACT + """, g AS (
  SELECT source_system, count(*) AS n_rows, count(*) FILTER (WHERE transfers IS NULL) AS n_null,
         sum(coalesce(transfers, 0)) AS total_filled
  FROM fact GROUP BY 1)
SELECT source_system, n_rows::BIGINT AS n_rows, n_null::BIGINT AS n_null, total_filled::BIGINT AS total_filled,
       round(n_null / n_rows, 6) AS null_share,
       round(sum(total_filled) OVER () / sum(n_rows) OVER (), 6) AS diluted_rate,
       round(sum(CASE WHEN source_system = 'helpdesk' THEN total_filled END) OVER ()
             / sum(CASE WHEN source_system = 'helpdesk' THEN n_rows END) OVER (), 6) AS current_rate
FROM g"""

Q["dq_post_conditions"] = FACT + """
SELECT count(*) FILTER (WHERE NOT (created_dt >= TIMESTAMP '1996-01-01'
                                   AND created_dt < TIMESTAMP '2000-07-01'))::BIGINT AS outside_window,
       (count(*) - count(DISTINCT ticket_id))::BIGINT AS duplicate_ids,
       count(*) FILTER (WHERE agent_id IS NOT NULL AND resolved_team IS NULL)::BIGINT AS owner_missing,
       count(*) FILTER (WHERE sla_target_minutes IS NOT NULL
                          AND sla_target_minutes NOT IN (43200, 86400, 259200, 525600))::BIGINT AS bad_sla_target,
       count(*) FILTER (WHERE (resolved_team = 'ASIA' AND training_category IS DISTINCT FROM 'BUILDING')
                           OR (resolved_team = 'EUROPE' AND training_category IS DISTINCT FROM 'MACHINERY')
                           OR (resolved_team = 'AFRICA' AND training_category IS DISTINCT FROM 'HOUSEHOLD')
                           OR (resolved_team = 'AMERICA' AND training_category IS DISTINCT FROM 'FURNITURE'))::BIGINT AS bad_owner_label,
       count(*) FILTER (WHERE date_diff('minute', resolved_dt_raw, resolved_dt)
                              <> CASE WHEN source_system = 'legacy' THEN 330 ELSE 0 END)::BIGINT AS bad_repaired_clock
FROM fact"""

Q["legacy_time_fix"] = FACT + """
SELECT ticket_id, source_system, resolved_dt_raw, resolved_dt FROM fact"""

Q["window_filter"] = with_(RAW) + """
SELECT ticket_id, created_at AS created_dt FROM raw
WHERE created_at >= TIMESTAMP '1996-01-01' AND created_at < TIMESTAMP '2000-07-01'"""

Q["monthly_by_category"] = FACT + """
SELECT month, category, count(*)::BIGINT AS n FROM fact
WHERE month IS NOT NULL AND category IS NOT NULL GROUP BY 1, 2"""

Q["monthly_by_category_wide"] = FACT + """
SELECT month,
  count(*) FILTER (WHERE category = 'AUTOMOBILE')::BIGINT AS "AUTOMOBILE",
  count(*) FILTER (WHERE category = 'BUILDING')::BIGINT AS "BUILDING",
  count(*) FILTER (WHERE category = 'FURNITURE')::BIGINT AS "FURNITURE",
  count(*) FILTER (WHERE category = 'HOUSEHOLD')::BIGINT AS "HOUSEHOLD",
  count(*) FILTER (WHERE category = 'MACHINERY')::BIGINT AS "MACHINERY"
FROM fact WHERE month IS NOT NULL AND category IS NOT NULL GROUP BY month"""

Q["monthly_by_team"] = FACT + """
SELECT month, assigned_team, count(*)::BIGINT AS n FROM fact
WHERE month IS NOT NULL AND assigned_team IS NOT NULL GROUP BY 1, 2"""

Q["routing_matrix_wide"] = FACT + """
SELECT assigned_team,
  count(*) FILTER (WHERE resolved_team = 'AFRICA')::BIGINT AS "AFRICA",
  count(*) FILTER (WHERE resolved_team = 'AMERICA')::BIGINT AS "AMERICA",
  count(*) FILTER (WHERE resolved_team = 'ASIA')::BIGINT AS "ASIA",
  count(*) FILTER (WHERE resolved_team = 'EUROPE')::BIGINT AS "EUROPE",
  count(*) FILTER (WHERE resolved_team = 'MIDDLE EAST')::BIGINT AS "MIDDLE EAST"
FROM fact WHERE assigned_team IS NOT NULL AND resolved_team IS NOT NULL GROUP BY assigned_team"""

Q["team_share"] = FACT + """, c AS (
  SELECT assigned_team, count(*) AS n FROM fact GROUP BY 1),
tiers AS (SELECT team, max(tier) AS tier FROM agents GROUP BY 1)
SELECT assigned_team, n::BIGINT AS n, tier, round(n / sum(n) OVER (), 6) AS share,
       CASE WHEN coalesce(tier, 1) <> 2 THEN
         CAST(rank() OVER (PARTITION BY coalesce(tier, 1) <> 2 ORDER BY n DESC) AS INTEGER) END AS share_rank
FROM c LEFT JOIN tiers ON c.assigned_team = tiers.team"""

Q["window_summary"] = FACT + """
SELECT count(*)::BIGINT AS total_in_scope_tickets,
       count(*) FILTER (WHERE source_system = 'helpdesk')::BIGINT AS current_helpdesk_tickets,
       CAST(min(created_dt) AS DATE) AS window_first_date,
       CAST(max(created_dt) AS DATE) AS window_last_date,
       count(DISTINCT month)::BIGINT AS n_months
FROM fact"""

Q["owner_lookup"] = with_(RAW) + """, agents AS (
  SELECT s_suppkey AS agent_id, n_name AS site, r_name AS team,
         CASE WHEN r_name = 'MIDDLE EAST' THEN 2 ELSE 1 END AS tier,
         CASE s_suppkey % 3 WHEN 0 THEN 'Morning' WHEN 1 THEN 'Day' ELSE 'Night' END AS shift
  FROM supplier JOIN geo ON s_nationkey = n_nationkey)
SELECT ticket_id, raw.agent_id, team AS resolved_team, tier, site, shift
FROM raw LEFT JOIN agents USING (agent_id)
WHERE created_at >= TIMESTAMP '1996-01-01' AND created_at < TIMESTAMP '2000-07-01'"""

Q["owner_lookup_asof"] = with_(RAW) + """, hist AS (
  SELECT s_suppkey AS agent_id, g1.r_name AS team, NULL::DATE AS from_date, DATE '1998-01-01' AS to_date
  FROM supplier JOIN geo g1 ON s_nationkey = g1.n_nationkey
  UNION ALL
  SELECT s_suppkey, g2.r_name, DATE '1998-01-01', NULL::DATE
  FROM supplier JOIN geo g2 ON (s_nationkey + 5) % 25 = g2.n_nationkey),
j AS (
  SELECT raw.*, hist.team AS resolved_team FROM raw LEFT JOIN hist
    ON raw.agent_id = hist.agent_id
   AND (hist.from_date IS NULL OR raw.created_at >= hist.from_date)
   AND (hist.to_date IS NULL OR raw.created_at < hist.to_date)
  WHERE created_at >= TIMESTAMP '1996-01-01' AND created_at < TIMESTAMP '2000-07-01')
SELECT ticket_id, agent_id, created_at AS created_dt, resolved_team,
       CASE WHEN assigned_team = resolved_team THEN false ELSE true END AS rerouted,
       CASE resolved_team WHEN 'ASIA' THEN 'BUILDING' WHEN 'EUROPE' THEN 'MACHINERY'
                          WHEN 'AFRICA' THEN 'HOUSEHOLD' WHEN 'AMERICA' THEN 'FURNITURE'
                          ELSE category END AS training_category
FROM j"""

Q["fallback_lookup"] = """
WITH fb AS (SELECT l_partkey, l_suppkey, min(l_orderkey) AS fallback_key FROM lineitem GROUP BY 1, 2),
li AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
         CASE WHEN l_orderkey % 10 <> 0 THEN l_orderkey END AS order_id FROM lineitem),
k AS (
  SELECT li.*, coalesce(order_id, fb.fallback_key) AS lookup_key,
         CASE WHEN order_id IS NOT NULL THEN 'primary'
              WHEN fb.fallback_key IS NOT NULL THEN 'fallback' ELSE 'unmatched' END AS match_path
  FROM li LEFT JOIN fb USING (l_partkey, l_suppkey))
SELECT l_orderkey, l_linenumber, lookup_key, match_path, o_custkey, o_orderdate
FROM k LEFT JOIN orders ON o_orderkey = lookup_key"""

Q["reroute_flag"] = FACT + """
SELECT ticket_id, assigned_team, resolved_team, rerouted FROM fact"""

Q["response_minutes"] = FACT + """
SELECT ticket_id, round(response_minutes, 6) AS response_minutes FROM fact"""

Q["resolution_minutes"] = FACT + """
SELECT ticket_id, source_system,
       round(date_diff('microsecond', created_dt, resolved_dt_raw) / 60000000.0, 6) AS resolution_minutes_raw,
       round(resolution_minutes, 6) AS resolution_minutes FROM fact"""

Q["sla_breach"] = FACT + """
SELECT ticket_id, channel, sla_target_minutes, sla_breach FROM fact"""

Q["corrected_label"] = FACT + """
SELECT ticket_id, category, resolved_team, training_category FROM fact"""

Q["recommend_team"] = FACT + """
SELECT ticket_id, category, channel,
  coalesce(CASE category WHEN 'BUILDING' THEN 'ASIA' WHEN 'MACHINERY' THEN 'EUROPE'
                         WHEN 'HOUSEHOLD' THEN 'AFRICA' WHEN 'FURNITURE' THEN 'AMERICA' END,
           CASE channel WHEN '1-URGENT' THEN 'Frontline A' WHEN '2-HIGH' THEN 'Frontline A'
                        WHEN '5-LOW' THEN 'Frontline B' WHEN '4-NOT SPECIFIED' THEN 'Frontline C' END,
           'Human review') AS recommended_team
FROM fact"""

Q["handoff_rate"] = FACT + """, a AS (
  SELECT count(*) AS n, sum(coalesce(transfers, 0)) AS h,
         avg(CASE WHEN coalesce(transfers, 0) > 0 THEN 1 ELSE 0 END) AS share
  FROM fact WHERE source_system = 'helpdesk')
SELECT n::BIGINT AS current_tickets, h::BIGINT AS recorded_handoffs, round(h / n, 6) AS handoff_rate,
       round(share, 6) AS share_with_handoff, 0.134 AS target_handoff_rate FROM a"""

Q["reroute_rate"] = FACT + """
SELECT count(*) FILTER (WHERE rerouted)::BIGINT AS rerouted_tickets,
       round(avg(CASE WHEN rerouted THEN 1 ELSE 0 END), 6) AS reroute_rate FROM fact"""

Q["queue_leakage"] = FACT + """, a AS (
  SELECT count(*) FILTER (WHERE assigned_team = 'AFRICA') AS first_assigned,
         count(*) FILTER (WHERE assigned_team = 'AFRICA' AND resolved_team = 'AMERICA') AS leaked_all,
         count(*) FILTER (WHERE assigned_team = 'AFRICA' AND resolved_team = 'AMERICA'
                            AND status IN ('resolved', 'closed')) AS leaked_closed
  FROM fact)
SELECT 'AFRICA' AS first_team, 'AMERICA' AS resolving_team, first_assigned::BIGINT AS first_assigned,
       leaked_all::BIGINT AS leaked_all, leaked_closed::BIGINT AS leaked_closed,
       (leaked_all - leaked_closed)::BIGINT AS leaked_open,
       round(leaked_closed / first_assigned, 6) AS leakage_rate_closed,
       round(leaked_all / first_assigned, 6) AS leakage_rate_all
FROM a"""

Q["queue_leakage_all_pairs"] = FACT + """, firsts AS (
  SELECT assigned_team, count(*) AS first_assigned FROM fact WHERE assigned_team IS NOT NULL GROUP BY 1),
pairs AS (
  SELECT assigned_team, resolved_team, count(*) AS leaked_all,
         count(*) FILTER (WHERE status IN ('resolved', 'closed')) AS leaked_closed
  FROM fact WHERE assigned_team IS NOT NULL AND resolved_team IS NOT NULL
    AND resolved_team <> assigned_team GROUP BY 1, 2)
SELECT assigned_team, resolved_team, first_assigned::BIGINT AS first_assigned,
       leaked_all::BIGINT AS leaked_all, leaked_closed::BIGINT AS leaked_closed,
       (leaked_all - leaked_closed)::BIGINT AS leaked_open,
       round(leaked_closed / first_assigned, 6) AS leakage_rate_closed,
       round(leaked_all / first_assigned, 6) AS leakage_rate_all
FROM pairs JOIN firsts USING (assigned_team)"""

Q["csat_split"] = FACT + """, pool AS (
  SELECT csat_score, coalesce(transfers, 0) AS t FROM fact
  WHERE source_system = 'helpdesk' AND csat_score IS NOT NULL),
a AS (
  SELECT avg(csat_score) FILTER (WHERE t = 0) AS m0, avg(csat_score) FILTER (WHERE t > 0) AS m1,
         count(*) FILTER (WHERE t = 0) AS c0, count(*) FILTER (WHERE t > 0) AS c1 FROM pool)
SELECT round(m0, 6) AS avg_csat_no_transfer, round(m1, 6) AS avg_csat_with_transfer,
       round(m0 - m1, 6) AS csat_delta, c0::BIGINT AS csat_sample_no_transfer,
       c1::BIGINT AS csat_sample_with_transfer FROM a"""

Q["cost_model"] = FACT + """, a AS (
  SELECT count(*) AS n, sum(coalesce(transfers, 0)) AS h FROM fact WHERE source_system = 'helpdesk')
SELECT h::BIGINT AS recorded_handoffs, 305.0 AS cost_per_transfer,
       round(h * 305.0, 6) AS observed_transfer_cost,
       round(h / n * 33800.0 * 305.0, 6) AS annualized_transfer_waste,
       round(h / n * 33800.0 * 305.0 * 0.2, 6) AS pilot_savings_target,
       900000.0 AS proposed_headcount_cost,
       round(h / n * 33800.0 * 305.0 * 0.2 + 900000.0, 6) AS total_pilot_value_opportunity
FROM a"""

Q["sla_summary"] = FACT + """
SELECT count(*) FILTER (WHERE sla_breach)::BIGINT AS sla_breach_count,
       round(avg(CASE WHEN sla_breach THEN 1 ELSE 0 END), 6) AS sla_breach_rate,
       round(avg(CASE WHEN sla_breach THEN 1 ELSE 0 END) * 11830000.0, 6) AS annualized_sla_credit
FROM fact"""

Q["kpi_long"] = FACT + """, a AS (
  SELECT count(*) AS n,
         count(*) FILTER (WHERE source_system = 'helpdesk') AS cur,
         sum(coalesce(transfers, 0)) FILTER (WHERE source_system = 'helpdesk') AS h,
         count(*) FILTER (WHERE rerouted) AS rr,
         count(*) FILTER (WHERE assigned_team = 'AFRICA') AS fa,
         count(*) FILTER (WHERE assigned_team = 'AFRICA' AND resolved_team = 'AMERICA') AS la,
         avg(csat_score) FILTER (WHERE source_system = 'helpdesk' AND coalesce(transfers, 0) = 0) AS c0,
         avg(csat_score) FILTER (WHERE source_system = 'helpdesk' AND coalesce(transfers, 0) > 0) AS c1,
         count(*) FILTER (WHERE sla_breach) AS b
  FROM fact)
SELECT * FROM (
  SELECT 'window_summary' AS section, 'total_in_scope_tickets' AS metric, CAST(n AS DOUBLE) AS value FROM a
  UNION ALL SELECT 'window_summary', 'current_helpdesk_tickets', cur FROM a
  UNION ALL SELECT 'operational_friction', 'recorded_handoffs', h FROM a
  UNION ALL SELECT 'operational_friction', 'recorded_handoff_rate', round(h / cur, 6) FROM a
  UNION ALL SELECT 'operational_friction', 'rerouted_tickets', rr FROM a
  UNION ALL SELECT 'operational_friction', 'reroute_rate', round(rr / n, 6) FROM a
  UNION ALL SELECT 'queue_analysis', 'first_assigned', fa FROM a
  UNION ALL SELECT 'queue_analysis', 'leaked_all', la FROM a
  UNION ALL SELECT 'queue_analysis', 'leakage_rate_all', round(la / fa, 6) FROM a
  UNION ALL SELECT 'customer_experience', 'csat_no_transfer', round(c0, 6) FROM a
  UNION ALL SELECT 'customer_experience', 'csat_with_transfer', round(c1, 6) FROM a
  UNION ALL SELECT 'customer_experience', 'csat_delta', round(c0 - c1, 6) FROM a
  UNION ALL SELECT 'financial_impact', 'observed_transfer_cost', h * 305.0 FROM a
  UNION ALL SELECT 'financial_impact', 'annualized_transfer_waste', round(h / cur * 33800.0 * 305.0, 6) FROM a
  UNION ALL SELECT 'service_levels', 'sla_breach_count', b FROM a
  UNION ALL SELECT 'service_levels', 'sla_breach_rate', round(b / n, 6) FROM a)"""

Q["pilot_scorecard"] = FACT + """, x AS (
  SELECT *, CASE WHEN substr(md5(CAST(ticket_id AS VARCHAR)), 1, 1) < '8' THEN 'control'
                 ELSE 'treated' END AS arm FROM fact),
a AS (
  SELECT arm, count(*) AS n,
         count(*) FILTER (WHERE source_system = 'helpdesk') AS cur,
         sum(coalesce(transfers, 0)) FILTER (WHERE source_system = 'helpdesk') AS h,
         count(*) FILTER (WHERE assigned_team = 'AFRICA' AND resolved_team = 'AMERICA') AS fr,
         count(*) FILTER (WHERE sla_breach) AS b,
         avg(csat_score) FILTER (WHERE source_system = 'helpdesk' AND coalesce(transfers, 0) > 0) AS ch,
         avg(csat_score) FILTER (WHERE source_system = 'helpdesk' AND coalesce(transfers, 0) = 0) AS cf
  FROM x GROUP BY arm)
SELECT arm, n::BIGINT AS n_tickets, round(100 * h / cur, 6) AS handoffs_per_100,
       round(100 * fr / n, 6) AS focus_reroutes_per_100, round(100 * b / n, 6) AS sla_breaches_per_100,
       round(100 * h / cur * 305.0, 6) AS transfer_cost_per_100,
       round(ch, 6) AS csat_handoff, round(cf, 6) AS csat_first_contact,
       (100 * h / cur) / 100 <= 0.134 AS meets_handoff_target
FROM a"""

# ------------------------------------------------ messages and predictions
CLEAN = r"regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g')"

MSGS = f"""
msgs AS (
  SELECT doc_id AS id, {CLEAN} AS text, lang AS label, source FROM documents)"""

POOL = MSGS + """,
pool AS (SELECT * FROM msgs WHERE id NOT IN (SELECT doc_id FROM labels))"""


def split_ctes(src: str, seed_expr: str, part: str) -> str:
    """Exact stratified 20% split of ``src`` grouped by ``part`` (a column list
    prefix such as 'seed, ' or '')."""
    over = f"PARTITION BY {part.rstrip(', ')}" if part else ""
    return f""",
counts AS (SELECT {part}label, count(*) AS n_class FROM {src} GROUP BY {part}label),
c1 AS (SELECT *, sum(n_class) OVER ({over}) AS n_total FROM counts),
c2 AS (SELECT *, (n_total + 4) // 5 AS n_test_total FROM c1),
c3 AS (SELECT *, n_total - n_test_total AS n_train_total FROM c2),
c4 AS (SELECT *, (n_train_total * n_class) // n_total AS base,
              (n_train_total * n_class) % n_total AS rem FROM c3),
c5 AS (SELECT *, n_train_total - sum(base) OVER ({over}) AS short FROM c4),
sizes AS (
  SELECT {part}label, n_class,
         n_class - base - CASE WHEN row_number() OVER ({over} ORDER BY rem DESC, label) <= short
                               THEN 1 ELSE 0 END AS n_test FROM c5),
ranked AS (
  SELECT {src}.*, row_number() OVER (PARTITION BY {part}label
                    ORDER BY md5({seed_expr} || ':' || CAST(id AS VARCHAR)), id) AS class_rank
  FROM {src}),
split AS (
  SELECT ranked.*, n_test, class_rank <= n_test AS is_test FROM ranked JOIN sizes USING ({part}label))"""


HOLDOUT = with_(POOL + split_ctes("pool", "'42'", ""))
REPEATED = with_(POOL + """,
pool_s AS (SELECT pool.*, s.seed FROM pool, (SELECT unnest([7, 19, 42, 73, 101]) AS seed) s)"""
                 + split_ctes("pool_s", "CAST(seed AS VARCHAR)", "seed, "))

PRED_CTE = """
w AS (
  SELECT doc_id AS id, lang AS truth, CASE WHEN doc_id % 7 = 0 THEN 'en' ELSE lang END AS raw_tag,
         'de' AS class, 0 AS ci FROM documents
  UNION ALL SELECT doc_id, lang, CASE WHEN doc_id % 7 = 0 THEN 'en' ELSE lang END, 'en', 1 FROM documents
  UNION ALL SELECT doc_id, lang, CASE WHEN doc_id % 7 = 0 THEN 'en' ELSE lang END, 'es', 2 FROM documents
  UNION ALL SELECT doc_id, lang, CASE WHEN doc_id % 7 = 0 THEN 'en' ELSE lang END, 'fr', 3 FROM documents),
w2 AS (
  SELECT *, CAST(1 + (id * 31 + ci * 17) % 23
                 + CASE WHEN class = truth AND id % 5 <> 0 THEN 60 ELSE 0 END AS DOUBLE) AS wt FROM w),
probs AS (SELECT id, class, wt / sum(wt) OVER (PARTITION BY id) AS p, truth, raw_tag FROM w2),
best AS (
  SELECT id, class AS pred, p AS confidence, truth, raw_tag FROM (
    SELECT *, row_number() OVER (PARTITION BY id ORDER BY p DESC, class) AS rn FROM probs) WHERE rn = 1)"""

PRED = with_(PRED_CTE)

Q["clean_text"] = with_(MSGS) + """
SELECT id, CAST(length(text) AS INTEGER) AS n_chars, md5(text) AS text_md5 FROM msgs"""

Q["train_pool"] = with_(POOL) + "SELECT id, label FROM pool"

Q["stratified_sample"] = FACT + """
SELECT ticket_id, category, sample_rank FROM (
  SELECT ticket_id, category, CAST(row_number() OVER (PARTITION BY category
           ORDER BY md5('42:' || CAST(ticket_id AS VARCHAR)), ticket_id) AS INTEGER) AS sample_rank
  FROM fact) WHERE sample_rank <= 10"""

Q["stratified_holdout"] = HOLDOUT + "SELECT id, label, class_rank, is_test FROM split"

Q["repeated_holdout"] = REPEATED + "SELECT seed, id, label, class_rank, is_test FROM split"

Q["calibration_folds"] = HOLDOUT + """
SELECT id, label, CAST((class_rank - n_test - 1) % 2 AS INTEGER) AS fold FROM split WHERE NOT is_test"""

Q["split_leakage"] = HOLDOUT + """, tr AS (SELECT DISTINCT md5(text) AS h FROM split WHERE NOT is_test),
te AS (SELECT md5(text) AS h, h IN (SELECT h FROM tr) AS leak FROM split WHERE is_test)
SELECT count(*)::BIGINT AS n_test, count(*) FILTER (WHERE leak)::BIGINT AS n_test_text_in_train,
       count(DISTINCT CASE WHEN leak THEN h END)::BIGINT AS n_distinct_leaked_texts,
       round(count(*) FILTER (WHERE leak) / count(*), 6) AS leak_share
FROM te"""

Q["class_weights"] = HOLDOUT + """, c AS (SELECT label, count(*) AS n_class FROM split WHERE NOT is_test GROUP BY 1)
SELECT label, n_class::BIGINT AS n_class,
       round(sum(n_class) OVER () / (count(*) OVER () * n_class), 6) AS weight FROM c"""

Q["predict_argmax"] = PRED + "SELECT id, pred, round(confidence, 6) AS confidence FROM best"

Q["top_k_classes"] = PRED + """
SELECT id, CAST(rk AS INTEGER) AS rank, class, round(p, 6) AS p FROM (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY p DESC, class) AS rk FROM probs) WHERE rk <= 5"""

Q["confidence_split"] = PRED + """, a AS (
  SELECT count(*) AS n, count(*) FILTER (WHERE confidence >= 0.7) AS n_auto,
         avg(CASE WHEN pred = truth THEN 1 ELSE 0 END) FILTER (WHERE confidence >= 0.7) AS acc_auto,
         avg(CASE WHEN pred = truth THEN 1 ELSE 0 END) FILTER (WHERE confidence < 0.7) AS acc_review
  FROM best)
SELECT 0.7 AS confidence_threshold, n::BIGINT AS n, n_auto::BIGINT AS n_auto,
       round(n_auto / n, 6) AS auto_routed_share, round(acc_auto, 6) AS auto_routed_accuracy,
       round((n - n_auto) / n, 6) AS human_review_share,
       round(acc_review, 6) AS low_confidence_accuracy_if_forced FROM a"""

Q["accuracy"] = PRED + """
SELECT count(*)::BIGINT AS n, round(avg(CASE WHEN pred = truth THEN 1 ELSE 0 END), 6) AS accuracy,
       round(1 - avg(CASE WHEN pred = truth THEN 1 ELSE 0 END), 6) AS error_rate FROM best"""

Q["raw_tag_agreement"] = PRED + """
SELECT count(*)::BIGINT AS n, round(avg(CASE WHEN pred = raw_tag THEN 1 ELSE 0 END), 6) AS agreement
FROM best"""

Q["brier"] = PRED + """, r AS (
  SELECT id, sum((p - CASE WHEN class = truth THEN 1.0 ELSE 0.0 END) ^ 2)
             + 1 - max(CASE WHEN class = truth THEN 1.0 ELSE 0.0 END) AS sq
  FROM probs GROUP BY id)
SELECT count(*)::BIGINT AS n, round(avg(sq), 6) AS brier_score FROM r"""

Q["classification_report"] = PRED + """,
t AS (SELECT truth AS label, count(*) AS support FROM best GROUP BY 1),
p AS (SELECT pred AS label, count(*) AS n_pred FROM best GROUP BY 1),
tp AS (SELECT truth AS label, count(*) AS tp FROM best WHERE pred = truth GROUP BY 1),
per AS (
  SELECT coalesce(t.label, p.label) AS label, coalesce(support, 0) AS support,
         coalesce(n_pred, 0) AS n_pred, coalesce(tp, 0) AS tp
  FROM t FULL OUTER JOIN p ON t.label = p.label LEFT JOIN tp ON tp.label = coalesce(t.label, p.label)),
m AS (
  SELECT label, support,
         CASE WHEN n_pred = 0 THEN 0.0 ELSE tp / n_pred END AS precision,
         CASE WHEN support = 0 THEN 0.0 ELSE tp / support END AS recall FROM per),
f AS (
  SELECT *, CASE WHEN precision + recall = 0 THEN 0.0
                 ELSE 2 * precision * recall / (precision + recall) END AS f1 FROM m)
SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1,
       support::BIGINT AS support FROM f
UNION ALL
SELECT 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6),
       sum(support)::BIGINT FROM f
UNION ALL
SELECT 'weighted avg', round(sum(precision * support) / sum(support), 6),
       round(sum(recall * support) / sum(support), 6), round(sum(f1 * support) / sum(support), 6),
       sum(support)::BIGINT FROM f"""

Q["audit_accuracy"] = PRED + """, audit AS (
  SELECT l.doc_id AS id, CASE WHEN l.doc_id % 7 = 0 THEN 'en' ELSE d.lang END AS tag,
         d.lang AS manual_category
  FROM labels l JOIN documents d ON l.doc_id = d.doc_id),
j AS (SELECT audit.*, best.pred FROM audit LEFT JOIN best USING (id)),
a AS (
  SELECT count(*) AS n, count(*) FILTER (WHERE pred = manual_category) AS mc,
         count(*) FILTER (WHERE tag = manual_category) AS sc,
         count(*) FILTER (WHERE pred IS NULL) AS np FROM j)
SELECT n::BIGINT AS n, mc::BIGINT AS production_model_correct,
       round(mc / n, 6) AS production_model_accuracy, sc::BIGINT AS source_tag_correct,
       round(sc / n, 6) AS source_tag_accuracy, round(1 - mc / n, 6) AS production_model_error_rate,
       np::BIGINT AS n_without_prediction FROM a"""

Q["repeated_run_summary"] = REPEATED.rstrip() + "," + PRED_CTE + """,
runs AS (
  SELECT seed, count(*) AS n_test, avg(CASE WHEN pred = best.truth THEN 1 ELSE 0 END) AS acc
  FROM split JOIN best USING (id) WHERE is_test GROUP BY seed)
SELECT seed, n_test::BIGINT AS n_test, round(acc, 6) AS accuracy, round(1 - acc, 6) AS error_rate,
       count(*) OVER ()::BIGINT AS n_runs, round(avg(acc) OVER (), 6) AS mean_accuracy,
       round(stddev_samp(acc) OVER (), 6) AS std_accuracy, round(min(acc) OVER (), 6) AS min_accuracy,
       round(max(acc) OVER (), 6) AS max_accuracy,
       round(max(acc) OVER () - min(acc) OVER (), 6) AS range_accuracy
FROM runs"""

ROUTED = with_(MSGS + "," + PRED_CTE + """,
m AS (
  SELECT id, ['1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW'][
           CAST(regexp_extract(source, '(\\d+)$', 1) AS INTEGER) % 5 + 1] AS channel
  FROM msgs WHERE length(text) > 0),
routed AS (
  SELECT m.id, channel, pred, confidence, truth, confidence >= 0.7 AS auto_routed,
         CASE WHEN confidence < 0.7 THEN 'Human review'
              ELSE coalesce(CASE pred WHEN 'de' THEN 'German desk' WHEN 'es' THEN 'Spanish desk'
                                      WHEN 'fr' THEN 'French desk' END,
                            CASE channel WHEN '1-URGENT' THEN 'Frontline A' WHEN '2-HIGH' THEN 'Frontline A'
                                         WHEN '5-LOW' THEN 'Frontline B'
                                         WHEN '4-NOT SPECIFIED' THEN 'Frontline C' END,
                            'Human review') END AS route
  FROM m JOIN best USING (id))""")

Q["triage_route"] = ROUTED + """
SELECT id, channel, pred, round(confidence, 6) AS confidence, route, auto_routed FROM routed"""

Q["triage_value"] = ROUTED + """, a AS (
  SELECT count(*) AS n, count(*) FILTER (WHERE auto_routed) AS n_auto,
         avg(CASE WHEN pred = truth THEN 1 ELSE 0 END) AS acc,
         avg(CASE WHEN pred = truth THEN 1 ELSE 0 END) FILTER (WHERE auto_routed) AS acc_auto FROM routed)
SELECT n::BIGINT AS n, round(n_auto / n, 6) AS auto_routed_share,
       round((1 - acc) * 305.0, 6) AS transfer_cost_per_ticket_no_triage,
       round(n_auto / n * (1 - coalesce(acc_auto, 1.0)) * 305.0, 6) AS transfer_cost_per_ticket_with_triage,
       round(((1 - acc) * 305.0 - n_auto / n * (1 - coalesce(acc_auto, 1.0)) * 305.0) * 33800.0, 6)
         AS annual_transfer_cost_avoided
FROM a"""

# ------------------------------------------------------------ text features
WORDS = "regexp_extract_all(strip_accents(lower(text)), '[\\p{L}\\p{N}_]{2,}')"
CHARTEXT = "regexp_replace(lower(text), '\\s\\s+', ' ', 'g')"


def _word_terms(src: str, bigrams: bool) -> str:
    uni = f"SELECT id, unnest(toks) AS term FROM (SELECT id, {WORDS} AS toks FROM {src})"
    if not bigrams:
        return uni
    bi = (f"SELECT id, unnest(list_transform(range(1, len(toks)), lambda i: toks[i] || ' ' || toks[i + 1])) AS term "
          f"FROM (SELECT id, {WORDS} AS toks FROM {src})")
    return uni + " UNION ALL " + bi


def _char_terms(src: str) -> str:
    parts = []
    for n in (3, 4, 5):
        parts.append(f"SELECT id, unnest(list_transform(range(1, length(t) - {n} + 2), "
                     f"lambda i: substr(t, i, {n}))) AS term FROM (SELECT id, {CHARTEXT} AS t FROM {src})")
    return " UNION ALL ".join(parts)


def _tf(terms_sql: str) -> str:
    return f"SELECT id, term, count(*) AS tf FROM ({terms_sql}) GROUP BY id, term"


SUMMARY = """
SELECT id, sum(tf)::BIGINT AS n_terms, count(*)::BIGINT AS n_distinct, sum(tf * tf)::BIGINT AS sum_tf_sq
FROM tf GROUP BY id"""

Q["word_tokens"] = with_(MSGS) + f", tf AS ({_tf(_word_terms('msgs', False))})" + SUMMARY
Q["word_ngrams"] = with_(MSGS) + f", tf AS ({_tf(_word_terms('msgs', True))})" + SUMMARY
Q["char_ngrams"] = with_(MSGS) + f", tf AS ({_tf(_char_terms('msgs'))})" + SUMMARY


def _vocab_ctes() -> str:
    """Term counts of every message once per block; the training counts are
    the rows of training ids (no second pass over the text)."""
    return HOLDOUT.rstrip() + f""",
train AS (SELECT id, text FROM split WHERE NOT is_test),
ntrain AS (SELECT count(*) AS n FROM train),
wtf_all AS ({_tf(_word_terms('msgs', True))}),
ctf_all AS ({_tf(_char_terms('msgs'))}),
wtf AS (SELECT * FROM wtf_all WHERE id IN (SELECT id FROM train)),
ctf AS (SELECT * FROM ctf_all WHERE id IN (SELECT id FROM train)),
wst AS (SELECT term, count(*) AS df, sum(tf) AS total_tf FROM wtf GROUP BY term),
cst AS (SELECT term, count(*) AS df, sum(tf) AS total_tf FROM ctf GROUP BY term),
wvoc AS (
  SELECT 'word' AS block, term, df, total_tf, ln((1 + n) / (1 + df)) + 1 AS idf
  FROM wst, ntrain WHERE df >= 2 AND df <= 0.98 * n),
cvoc AS (
  SELECT 'char' AS block, term, df, total_tf, ln((1 + n) / (1 + df)) + 1 AS idf
  FROM cst, ntrain WHERE df >= 2 ORDER BY total_tf DESC, term LIMIT 30000)
"""


Q["vocabulary"] = _vocab_ctes() + """
SELECT block, term, df::BIGINT AS df, total_tf::BIGINT AS total_tf, round(idf, 6) AS idf FROM wvoc
UNION ALL
SELECT block, term, df::BIGINT, total_tf::BIGINT, round(idf, 6) FROM cvoc"""


def _features_cte(blocks) -> str:
    parts = []
    for b in blocks:
        tf_all = "wtf_all" if b == "word" else "ctf_all"
        voc = "wvoc" if b == "word" else "cvoc"
        parts.append(f"""
{b}_w AS (
  SELECT id, '{b}' AS block, tf.term, (1 + ln(tf)) * idf AS w
  FROM {tf_all} tf JOIN {voc} USING (term)),
{b}_f AS (SELECT id, block, term, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS weight FROM {b}_w)""")
    union = " UNION ALL ".join(f"SELECT * FROM {b}_f" for b in blocks)
    return "," + ",".join(parts) + f",\nfeats AS ({union})\n"


def _features(blocks) -> str:
    return _features_cte(blocks) + """
SELECT id, count(*) FILTER (WHERE block = 'word')::BIGINT AS nnz_word,
       count(*) FILTER (WHERE block = 'char')::BIGINT AS nnz_char,
       round(sum(weight * weight), 6) AS sq_norm, round(max(weight), 6) AS max_weight
FROM feats GROUP BY id"""


Q["tfidf_word"] = _vocab_ctes() + _features(["word"])
Q["tfidf_char"] = _vocab_ctes() + _features(["char"])
Q["feature_union"] = _vocab_ctes() + _features(["word", "char"])


# ------------------------------------------------------------ classification
CENTROID = _vocab_ctes() + _features_cte(["word", "char"]) + """,
lab AS (SELECT id, label AS class FROM split WHERE NOT is_test),
ncls AS (SELECT class, count(*) AS n_class FROM lab GROUP BY class),
wts AS (
  SELECT class, block, term, sum(weight) / any_value(n_class) AS w
  FROM feats JOIN lab USING (id) JOIN ncls USING (class) GROUP BY class, block, term),
bias AS (SELECT class, -0.5 * sum(w * w) AS b FROM wts GROUP BY class),
dots AS (
  SELECT id, class, sum(weight * w) AS dot FROM feats JOIN wts USING (block, term) GROUP BY id, class),
scores AS (
  SELECT m.id, c.class, coalesce(dot, 0) + coalesce(b, 0) AS score
  FROM msgs m JOIN ncls c ON true LEFT JOIN dots d ON d.id = m.id AND d.class = c.class
  LEFT JOIN bias ON bias.class = c.class)
"""

Q["centroid_weights"] = CENTROID + """
SELECT class, block, count(*)::BIGINT AS n_terms, round(sum(w), 6) AS sum_w, round(sum(w * w), 6) AS sum_w_sq,
       round(any_value(b), 6) AS intercept
FROM wts JOIN bias USING (class) GROUP BY class, block"""

Q["linear_score_join"] = CENTROID + "SELECT id, class, round(score, 6) AS score FROM scores"

Q["calibrate_apply"] = CENTROID + """,
ci AS (SELECT class, CAST(row_number() OVER (ORDER BY class) - 1 AS INTEGER) AS i FROM ncls),
params AS (
  SELECT 0 AS fold, class, -6.0 - 0.5 * i AS a, 0.5 + 0.1 * i AS b FROM ci
  UNION ALL SELECT 1, class, -4.0 - 0.5 * i, 0.25 + 0.1 * i FROM ci),
q AS (
  SELECT id, fold, class, 1.0 / (1.0 + exp(a * score + b)) AS q FROM scores JOIN params USING (class)),
qn AS (SELECT id, fold, class, coalesce(q / sum(q) OVER (PARTITION BY id, fold), 0.0) AS qn FROM q)
SELECT id, class, round(avg(qn), 6) AS p FROM qn GROUP BY id, class"""

Q["sample_category_count"] = FACT + """, s AS (
  SELECT ticket_id, category, row_number() OVER (PARTITION BY category
           ORDER BY md5('42:' || CAST(ticket_id AS VARCHAR)), ticket_id) AS rk
  FROM fact)
SELECT count(*)::BIGINT AS n_sampled, count(DISTINCT category)::BIGINT AS n_categories
FROM s WHERE rk <= 10"""
