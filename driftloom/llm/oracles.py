"""DuckDB SQL that gives the same rows as queries of this package."""

from driftloom.plans.common import hash_sql

_SPACE = r"[\s\p{Z}\x{1c}-\x{1f}\x{85}]"
_NON_SPACE = r"[^\s\p{Z}\x{1c}-\x{1f}\x{85}]"
_TOKENS = rf"len(regexp_extract_all(coalesce(text, ''), '[\p{{L}}\p{{N}}]+|{_NON_SPACE}'))"


def _trim(column: str) -> str:
    return f"lower(regexp_replace({column}, '^{_SPACE}+|{_SPACE}+$', '', 'g'))"


_ELIGIBLE = f"""
WITH RECURSIVE eligible AS (
  SELECT 'outcome' AS target_field, conversation_id AS id, min({_trim('outcome')}) AS category
  FROM conversations WHERE outcome IS NOT NULL AND conversation_id IS NOT NULL GROUP BY ALL
  UNION ALL
  SELECT 'churn_status', CAST(customer_id AS VARCHAR), min(CAST(churn_status AS VARCHAR))
  FROM telco_main WHERE churn_status IS NOT NULL AND customer_id IS NOT NULL GROUP BY ALL
), counted AS (
  SELECT t.target_field, t.category, t.target_share, t.min_rows, t.sample_frac,
    (SELECT count(*) FROM eligible e WHERE e.target_field = t.target_field AND e.category = {_trim('t.category')}) AS available,
    (SELECT count(*) FROM eligible e WHERE e.target_field = t.target_field) AS total
  FROM sample_targets t
)"""

# quotas: shares between floor and cap, clipped side by side until all fit, then by largest remainder
_QUOTAS = """, base AS (
  SELECT target_field, category, target_share, available, total, coalesce(target_share, 0.0) AS share, least(coalesce(min_rows, 0), available) AS low, available AS cap,
    greatest(CAST(coalesce(min_rows, 0) AS DOUBLE), coalesce(target_share, 0.0) * coalesce(sample_frac, 0.0) * total) AS wanted,
    greatest(least(CAST(round_even(max(coalesce(sample_frac, 0.0)) OVER f * total, 0) AS BIGINT), sum(available) OVER f), sum(least(coalesce(min_rows, 0), available)) OVER f) AS size
  FROM counted WINDOW f AS (PARTITION BY target_field)
), step AS (
  SELECT 0 AS i, target_field, category, share, low, cap, size, CAST(NULL AS DOUBLE) AS fixed, CAST(NULL AS DOUBLE) AS ideal, false AS done FROM base
  UNION ALL
  SELECT i + 1, target_field, category, share, low, cap, size, clipped, ideal, NOT bool_or(clipped IS NOT NULL AND fixed IS NULL) OVER f
  FROM (SELECT *, CASE WHEN fixed IS NOT NULL THEN fixed WHEN up AND ideal > cap THEN cap WHEN NOT up AND ideal < low THEN low END AS clipped
    FROM (SELECT *, sum(greatest(ideal - cap, 0)) OVER f >= sum(greatest(low - ideal, 0)) OVER f AS up
      FROM (SELECT * EXCLUDE (ideal), CASE WHEN fixed IS NULL THEN CASE WHEN weight > 0 THEN rest * share / weight ELSE rest / free END END AS ideal
        FROM (SELECT *, size - coalesce(sum(fixed) OVER f, 0) AS rest, sum(CASE WHEN fixed IS NULL THEN share ELSE 0 END) OVER f AS weight, sum(CAST(fixed IS NULL AS INT)) OVER f AS free
          FROM step WHERE NOT done WINDOW f AS (PARTITION BY target_field)))
      WINDOW f AS (PARTITION BY target_field)))
  WINDOW f AS (PARTITION BY target_field)
), quotas AS (
  SELECT target_field, category, whole + CAST(fixed IS NULL AND whole < cap AND row_number() OVER (PARTITION BY target_field ORDER BY fixed IS NOT NULL, floor(ideal) - ideal, category) <= size - sum(whole) OVER (PARTITION BY target_field) AS BIGINT) AS quota
  FROM (SELECT *, CAST(floor(coalesce(fixed, ideal)) AS BIGINT) AS whole FROM step WHERE done)
), sample AS (
  SELECT target_field, e.category, id, q.category AS named FROM eligible e JOIN quotas q USING (target_field) WHERE e.category = """ + _trim("q.category") + f"""
  QUALIFY row_number() OVER (PARTITION BY target_field, e.category ORDER BY {hash_sql('id')}, id) <= any_value(quota) OVER (PARTITION BY target_field, e.category)
)"""

_ROLES = f"""
m AS (
  SELECT msg_id, dialogue_id, sent_at, text, coalesce(regexp_matches(text, '{_NON_SPACE}'), false) AS said, f.participant AS role
  FROM turns LEFT JOIN sender_forms f ON {_trim('sender')} = f.sender_form WHERE dialogue_id IS NOT NULL
), d AS (
  SELECT dialogue_id,
    bool_or(said AND (role IS NULL OR sent_at IS NULL)) AS broken,
    bool_or(said AND coalesce(role IN ('agent', 'customer'), false)) AS spoken,
    min(sent_at) FILTER (said AND role = 'customer') AS first_customer,
    max(sent_at) FILTER (said AND role = 'agent') AS last_agent
  FROM m GROUP BY dialogue_id
)"""

_MIX = f"""
WITH t AS (SELECT doc_id, source, {_TOKENS} AS n FROM documents), total AS (SELECT sum(n) AS n FROM t),
plan AS (
  SELECT m.source, target_share, coalesce((SELECT sum(n) FROM t WHERE t.source = m.source), 0) AS have, target_share * budget_frac * total.n AS need, budget_frac * total.n AS budget, max_repeats FROM mix_targets m, total
), granted AS (SELECT *, CAST(least(ceil(need), max_repeats * have) AS BIGINT) AS granted FROM plan),
drawn AS (
  SELECT doc_id, source, n, repeat_no, granted, repeat_no * have + coalesce(sum(n) OVER (PARTITION BY source, repeat_no ORDER BY {hash_sql("doc_id || ':' || repeat_no", 7)}, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM (SELECT *, unnest(range(CAST(ceil(granted / have) AS BIGINT))) AS repeat_no FROM t JOIN granted USING (source) WHERE n > 0 AND granted > 0)
), chosen AS (SELECT *, start // 2048 AS nth FROM drawn WHERE start < granted),
blocks AS (SELECT source, ceil(granted / 2048) AS b FROM granted WHERE granted > 0), number AS (SELECT CAST(sum(b) AS BIGINT) AS n, count(*) AS k FROM blocks),
bounds AS (SELECT source, sum(b / n) OVER (ORDER BY source) AS upper, row_number() OVER (ORDER BY source DESC) = 1 AS final FROM blocks, number),
points AS (SELECT slot, fmod((slot + 1) * 0.6180339887498949::DOUBLE, 1.0) AS point FROM (SELECT unnest(range(n + 2 * k * (CAST(floor(log2(n)) AS BIGINT) + 2))) AS slot FROM number)),
slots AS (SELECT slot, source, row_number() OVER (PARTITION BY source ORDER BY slot) - 1 AS nth FROM (SELECT slot, arg_min(source, upper) AS source FROM points, bounds WHERE point < upper OR final GROUP BY slot))"""

SQL = {
    "p3_report": _ELIGIBLE + _QUOTAS + """
SELECT target_field, category, target_share, available, round(wanted, 6) AS wanted, quota, sampled, round(coalesce(sampled / nullif(sum(sampled) OVER (PARTITION BY target_field), 0), 0), 6) AS sampled_share, sampled < wanted AND available < wanted AS short
FROM (SELECT b.*, quota, (SELECT count(*) FROM sample s WHERE s.target_field = b.target_field AND s.named = b.category) AS sampled FROM base b JOIN quotas USING (target_field, category))""",
    "p3_sample": _ELIGIBLE + _QUOTAS + " SELECT target_field, category, id FROM sample",
    # the silence that ends a session: the cut of least error in the histogram of log gaps
    "p5_conversations": f"""
WITH {_ROLES}, u AS (SELECT dialogue_id, sent_at, role, text, min(msg_id) AS msg_id FROM m WHERE said AND role IS NOT NULL AND sent_at IS NOT NULL GROUP BY ALL),
g AS (SELECT *, row_number() OVER w AS position, epoch_us(sent_at) - lag(epoch_us(sent_at)) OVER w AS gap FROM u WINDOW w AS (PARTITION BY dialogue_id ORDER BY sent_at, msg_id)),
h AS (SELECT CAST(floor(log2(gap) * 4) AS INT) AS b, count(*) AS c FROM g WHERE gap > 0 GROUP BY 1),
s AS (SELECT b, lead(b) OVER w AS next, sum(c) OVER w AS n1, sum(b * c) OVER w AS s1, sum(b * b * c) OVER w AS q1, sum(c) OVER () AS n, sum(b * c) OVER () AS s, sum(b * b * c) OVER () AS q FROM h WINDOW w AS (ORDER BY b)),
e AS (SELECT b, next, (n1 / n) * (ln(q1 / n1 - pow(s1 / n1, 2) + 1 / 12) - 2 * ln(n1 / n)) + ((n - n1) / n) * (ln((q - q1) / (n - n1) - pow((s - s1) / (n - n1), 2) + 1 / 12) - 2 * ln((n - n1) / n)) AS cost,
  ln(q / n - pow(s / n, 2) + 1 / 12) AS whole FROM s WHERE next IS NOT NULL),
cut AS (SELECT coalesce((SELECT CASE WHEN cost < whole THEN CAST(floor(pow(2, (b + 1 + next) / 2 / 4)) AS BIGINT) END FROM e ORDER BY cost, b LIMIT 1), 4611686018427387904) AS most),
n AS (SELECT *, 1 + CAST(sum(CAST(coalesce(gap > most, false) AS INT)) OVER (PARTITION BY dialogue_id ORDER BY position) AS BIGINT) AS session_no FROM g, cut)
SELECT dialogue_id, position, session_no, coalesce(max(sent_at) FILTER (role = 'agent') OVER w > min(sent_at) FILTER (role = 'customer') OVER w, false) AS session_replied, role, sent_at, text, msg_id
FROM n JOIN d USING (dialogue_id) WHERE NOT broken AND spoken AND coalesce(last_agent > first_customer, false) WINDOW w AS (PARTITION BY dialogue_id, session_no)""",
    "p7_mix": _MIX + """
SELECT coalesce(slot, 4611686018427387904 + nth) AS slot, source, doc_id, CAST(repeat_no AS INT) AS repeat_no, n AS tokens FROM chosen LEFT JOIN slots USING (source, nth)""",
    "p7_report": _MIX + """
SELECT source, target_share, CAST(have AS BIGINT) AS tokens, round(need, 3) AS needed, used >= need AS reached, CAST(used AS BIGINT) AS used_tokens, k AS used_documents, round(coalesce(used / nullif(sum(used) OVER (), 0), 0), 6) AS actual_share, round(coalesce(used / nullif(budget, 0), 0), 6) AS budget_share
FROM (SELECT *, coalesce((SELECT sum(n) FROM chosen c WHERE c.source = g.source), 0) AS used, (SELECT count(*) FROM chosen c WHERE c.source = g.source) AS k FROM granted g)""",
    "p3_found": _ELIGIBLE + """
SELECT target_field, category FROM counted WHERE available < greatest(min_rows, target_share * sample_frac * total)""",
    "p5_found": f"""
WITH {_ROLES}
SELECT dialogue_id, CASE WHEN broken THEN 'broken' WHEN NOT spoken THEN 'empty' ELSE 'no_reply' END AS defect
FROM d WHERE broken OR NOT spoken OR NOT coalesce(last_agent > first_customer, false)""",
    "p6_found": f"""
SELECT limit_name, doc_id FROM documents, pack_limits WHERE {_TOKENS} > capacity_tokens""",
    "p6_totals": f"""
SELECT limit_name, CAST(capacity_tokens AS BIGINT) AS capacity, CAST(sum(n) AS BIGINT) AS tokens, count(*) AS documents, count(*) FILTER (n > capacity_tokens) AS split, 0 AS overfull, CAST(ceil(sum(n) / capacity_tokens) AS BIGINT) AS least_containers, true AS close
FROM (SELECT {_TOKENS} AS n FROM documents), pack_limits GROUP BY limit_name, capacity_tokens""",
    "p7_found": f"""
WITH t AS (SELECT source, {_TOKENS} AS n FROM documents)
SELECT m.source FROM mix_targets m
WHERE m.max_repeats * coalesce((SELECT sum(n) FROM t WHERE t.source = m.source), 0) < m.target_share * m.budget_frac * (SELECT sum(n) FROM t)""",
}
