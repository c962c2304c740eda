"""The catalog's answers in plain SQL over the given tables, written from the definitions."""

from __future__ import annotations

# --- the given tables as telemetry ----------------------------------------------------------
BASE = """base AS (
  SELECT event_id, ts, user_id, event_type, value, props,
         CAST(json_extract(props, '$.k') AS INTEGER) AS k,
         'tenant-' || (user_id % 4) AS tenant_id,
         'trace-' || user_id || '-' || date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS trace_id,
         'span-' || event_id AS span_id,
         'svc-' || event_type AS service,
         CASE WHEN CAST(json_extract(props, '$.k') AS INTEGER) % 7 = 0 THEN ''
              ELSE 'svc-' || (CAST(json_extract(props, '$.k') AS INTEGER) % 5) END AS peer,
         CASE WHEN CAST(json_extract(props, '$.k') AS INTEGER) % 10 = 0 THEN 'log' ELSE 'trace' END AS signal_type
  FROM events),
ev AS (
  SELECT *, trace_id || ':' || span_id AS eid,
         tenant_id || ':' || trace_id || ':' || span_id AS event_key,
         event_type = 'error' AS is_error, round(value * 3, 2) >= 1000 AS is_slow
  FROM base)"""
SPANS = BASE + """,
first_copy AS (
  SELECT *, coalesce(lag(span_id) OVER (PARTITION BY user_id, trace_id ORDER BY ts, event_id), '') AS parent_span_id,
         date_trunc('milliseconds', ts) AS ingested_at
  FROM ev),
spans AS (
  SELECT * FROM first_copy
  UNION ALL
  SELECT * REPLACE (ingested_at + INTERVAL 1 HOUR AS ingested_at) FROM first_copy WHERE event_id % 20 = 0),
cur AS (
  SELECT * FROM spans
  QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY ingested_at DESC) = 1)"""
WINDOWED = SPANS + """,
recent AS (
  SELECT * FROM cur WHERE ingested_at >= (SELECT max(ingested_at) FROM spans) - INTERVAL 24 HOUR),
tenants AS (SELECT unnest(['tenant-0', 'tenant-1', 'tenant-2', 'tenant-3', 'tenant-idle']) AS tenant_id),
usage AS (
  SELECT t.tenant_id, CAST(24 AS BIGINT) AS window_hours,
         count(*) FILTER (signal_type = 'trace') AS span_count,
         count(*) FILTER (signal_type = 'trace' AND is_error) AS error_count,
         count(DISTINCT trace_id) FILTER (signal_type = 'trace') AS trace_count,
         count(*) FILTER (signal_type = 'log') AS log_count
  FROM tenants t LEFT JOIN recent r ON r.tenant_id = t.tenant_id
  GROUP BY t.tenant_id)"""


def ms(expr: str) -> str:
    return f"strftime({expr}, '%Y-%m-%d %H:%M:%S.') || lpad(CAST(date_part('millisecond', {expr}) % 1000 AS VARCHAR), 3, '0')"


# FNV-1a over ASCII ids.
def fnv(expr: str) -> str:
    return (f"list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split({expr}, ''), "
            "lambda c: ascii(c)::BIGINT)), lambda h, b: (xor(h, b) * 16777619) % 4294967296)")


DECIDED = BASE + f""",
flags AS (
  SELECT tenant_id, trace_id, bool_or(is_error) AS has_error, bool_or(is_slow) AS has_slow,
         count(*) AS span_count, max(ts) AS last_ts
  FROM ev GROUP BY ALL),
reasons AS (
  SELECT *, CASE WHEN has_error THEN 'retained_error' WHEN has_slow THEN 'retained_slow'
                 WHEN {fnv('trace_id')} % 10 = 0 THEN 'retained_healthy_sample'
                 ELSE 'dropped_healthy_sample' END AS reason
  FROM flags),
decided AS (SELECT *, reason <> 'dropped_healthy_sample' AS retained FROM reasons)"""
AS_OF = "TIMESTAMP '2024-02-01 00:00:00'"
AS_OF_MS = "'2024-02-01 00:00:00.000'"


def traces(source: str, where: str = "TRUE") -> str:
    """Trace table of events: one generation per event, decided where one failed."""
    return f"""
  SELECT tenant_id, trace_id, min(ts) AS first_seen, max(ts) AS last_seen,
         count(*) + 1 AS generation, CAST(count(*) AS INTEGER) AS span_count,
         CASE WHEN bool_or(is_error) THEN 'retained_error' END AS decision,
         CASE WHEN bool_or(is_error) THEN max(ts) END AS decided_at
  FROM {source} WHERE {where} GROUP BY ALL"""


TRACES = BASE + ", traces AS (" + traces("ev") + ")"
NOON = BASE + ", early AS (SELECT * FROM ev WHERE hour(ts) < 12), late AS (SELECT * FROM ev WHERE hour(ts) >= 12)"
OUTBOX = BASE + """,
outbox AS (
  SELECT event_key, tenant_id, event_id, event_type, signal_type, peer, ts AS created_at, CASE WHEN event_id % 3 <> 0 THEN 1 ELSE 0 END AS attempts,
         CASE WHEN event_id % 3 <> 0 THEN ts + INTERVAL 1 SECOND END AS published_at
  FROM ev)"""
LEDGER = BASE + """,
ledger AS (
  SELECT event_key, tenant_id, event_id, ts,
         CASE WHEN event_id % 11 = 0 THEN 'loss_evidenced' WHEN event_id % 7 = 0 THEN 'pending' ELSE 'persisted' END AS status,
         CAST(event_id % 3 + 1 AS INTEGER) AS attempts,
         CASE WHEN event_id % 11 = 0 THEN 'sink_failed' END AS last_error_class
  FROM ev WHERE event_id % 2 = 0 OR event_id % 7 = 0 OR event_id % 11 = 0)"""
EMAIL = r"(?i)\b[A-Z0-9._%+\-]+@[A-Z0-9.\-]+\.[A-Z]{2,}\b"


def masked(expr: str, *patterns: str) -> str:
    out = f"regexp_replace({expr}, '{EMAIL}', '[REDACTED_EMAIL]', 'g')"
    for pattern in patterns:
        out = f"regexp_replace({out}, '{pattern}', '[REDACTED_PATTERN]', 'g')"
    return out


TEXT_RULES = ('token = "[0-9a-f]{40}"', "src-?[0-9]+")
# Rules of the active policy version per tenant number, in expression order.
TENANT_RULES = {0: ("[0-9]{4,}", "svc-[01]"), 1: ("svc-3",), 2: ("er{1,2}or",), 3: ()}
VERSIONS = "CASE {} WHEN 0 THEN 't0-v2' WHEN 1 THEN 't1-v1' WHEN 2 THEN 't2-v1' ELSE 'deploy-1' END"


def by_tenant(number: str, expr: str, first: tuple[str, ...]) -> str:
    arms = " ".join(f"WHEN {n} THEN {masked(expr, *first, *rules)}"
                    for n, rules in TENANT_RULES.items())
    return f"CASE {number} {arms} END"


REQUESTS = BASE + """,
broken AS (
  SELECT *, 'req-' || event_id AS request_id,
         event_id % 67 = 0 AS bad_key,
         event_id % 59 = 0 OR event_id % 61 = 0 AS not_strict,
         event_id % 50 = 0 OR event_id % 53 = 0 AS not_valid
  FROM ev)"""
BATCHES = BASE + """,
blocks AS (
  SELECT *, event_id // 101 AS block, CASE WHEN event_id // 101 % 10 = 3 THEN 'big-' || (event_id // 101)
    ELSE 'few-' || (event_id // 101) || '-' || (event_id % 101 // 5) END AS request FROM ev),
whole AS (SELECT request, block, count(*) AS n, bool_or(event_id % 50 = 0) AS spoilt FROM blocks GROUP BY ALL),
sent AS (
  SELECT CASE WHEN again THEN 'again-' ELSE '' END || request AS request_id, n, again,
         CASE WHEN block % 5 <> 4 THEN 'tenant-' || (block % 5) END AS tenant_id,
         CASE WHEN block % 7 = 5 OR block % 11 = 6 THEN 404 WHEN block % 5 = 4 THEN 401
              WHEN n > 100 OR spoilt THEN 400 WHEN block % 5 = 3 THEN 503 ELSE 202 END AS code
  FROM whole, (VALUES (FALSE), (TRUE)) AS copies(again) WHERE NOT again OR block % 4 = 0)"""
LOGS = """turns AS (
  SELECT conv_id, turn, upper(role) AS severity, text, 'conv-' || conv_id AS trace_id,
         'log-' || conv_id || '-' || turn AS request_id, conv_id % 4 AS tenant,
         'log-' || left(sha256('conv-' || conv_id || '::' || turn || ':1'), 16) AS event_id
  FROM conversations)"""
HTTP = BASE + """,
http AS (
  SELECT ts, CASE WHEN k % 2 = 0 THEN 'gateway' ELSE 'query' END AS service,
         CASE event_type WHEN 'click' THEN 'ingest' WHEN 'view' THEN 'trace' WHEN 'purchase' THEN 'metrics'
              WHEN 'signup' THEN 'audit' ELSE 'dependencies' END AS route,
         CASE WHEN event_type = 'error' THEN 503 ELSE 200 END AS code, value AS latency_ms
  FROM ev)"""
RETENTION = """,
days AS (SELECT * FROM (VALUES ('tenant-0', 7), ('tenant-1', 14), ('tenant-2', 30), ('tenant-3', 30)) d(tenant_id, n)),
cut AS (SELECT tenant_id, TIMESTAMP '2024-02-01 00:00:00' - to_days(n) AS cutoff FROM days)"""
POLICIES = """pol AS (
  SELECT 'tenant-u' || user_id AS tenant_id, 'v' || (k % 5) AS version, ts,
         CASE WHEN k % 37 = 0 THEN '(' WHEN k % 41 = 1 THEN '((a{10}){10}){11}' WHEN k % 41 = 2 THEN '(?U)x{2,}[^\\p{Any}]?' ELSE event_type || '-[0-9]{' || (k % 3 + 1) || '}\\b' END AS expression
  FROM (SELECT *, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events)),
newest AS (
  SELECT tenant_id, version FROM pol
  QUALIFY row_number() OVER (PARTITION BY tenant_id ORDER BY ts DESC, version DESC) = 1),
active AS (
  SELECT p.tenant_id, p.version AS policy_version,
         list_sort(list(DISTINCT p.expression)) AS expressions, bool_and(p.expression NOT IN ('(', '((a{10}){10}){11}')) AS policy_ok
  FROM pol p JOIN newest n ON n.tenant_id = p.tenant_id AND n.version = p.version GROUP BY ALL)"""


def taken(quiet: str, cap: int) -> str:
    """The rows of REQUESTS that open traces take in: up to the first quiet time, and up to the eviction of a trace.

    A trace is evicted by the first opening at which it is not among the tenant's newest ``cap`` open traces.
    """
    return f"""good AS (SELECT * FROM broken WHERE NOT bad_key AND NOT not_strict AND NOT not_valid),
  gaps AS (SELECT *, coalesce(ts >= lag(ts) OVER (PARTITION BY tenant_id, trace_id ORDER BY ts, request_id) + INTERVAL {quiet}, FALSE) AS gap FROM good),
  parts AS (SELECT *, count(*) FILTER (gap) OVER (PARTITION BY tenant_id, trace_id ORDER BY ts, request_id) AS part FROM gaps),
  lives AS (SELECT tenant_id, trace_id, min(ts) AS a, max(ts) + INTERVAL {quiet} AS b FROM parts WHERE part = 0 GROUP BY ALL),
  places AS (
    SELECT k.tenant_id, k.trace_id, j.a AS moment,
           row_number() OVER (PARTITION BY j.tenant_id, j.trace_id ORDER BY k.a DESC, k.trace_id DESC) AS place
    FROM lives j JOIN lives k ON k.tenant_id = j.tenant_id AND k.b > j.a AND (k.a < j.a OR k.a = j.a AND k.trace_id <= j.trace_id)),
  evicted AS (SELECT tenant_id, trace_id, min(moment) AS moment FROM places WHERE place > {cap} GROUP BY ALL),
  taken AS (
    SELECT p.*, e.moment FROM parts p LEFT JOIN evicted e ON p.tenant_id = e.tenant_id AND p.trace_id = e.trace_id
    WHERE part = 0 AND (e.moment IS NULL OR ts <= e.moment))"""


def tail(quiet: str, cap: int) -> str:
    """Decisions up to the newest arrival."""
    return f"""WITH {REQUESTS}, {taken(quiet, cap)},
  t AS (SELECT tenant_id, trace_id, bool_or(is_error) AS has_error, count(*) AS n, max(ts) AS last_ts, max(moment) AS moment FROM taken GROUP BY ALL),
  d AS (SELECT *, CASE WHEN moment IS NOT NULL THEN 'evicted_pressure' WHEN has_error THEN 'retained_error'
      WHEN {fnv('trace_id')} % 10 = 0 THEN 'retained_healthy_sample' ELSE 'dropped_healthy_sample' END AS reason FROM t
    WHERE moment IS NOT NULL OR last_ts <= (SELECT max(ts) FROM broken) - INTERVAL {quiet})
  SELECT tenant_id, trace_id, reason, reason IN ('retained_error', 'retained_healthy_sample') AS retained, CAST(n AS INTEGER) AS span_count FROM d"""


def census(name: str, select: str) -> str:
    return f"SELECT '{name}' AS table_name, tenant_id, count(*) AS row_count FROM ({select}) GROUP BY tenant_id"


AUDIT = "SELECT tenant_id, event_id AS id, ts FROM ev WHERE event_type = 'signup'"
STATE = {"spans": "SELECT tenant_id FROM spans", "tail_outbox": "SELECT tenant_id FROM ev",
         "tail_event_keys": "SELECT tenant_id FROM ev",
         "tail_decisions": "SELECT DISTINCT tenant_id, trace_id FROM ev",
         "tail_traces": "SELECT DISTINCT tenant_id, trace_id FROM ev",
         "tail_buffers": "SELECT tenant_id FROM ev"}


def purge(name: str, select: str) -> str:
    """``select`` yields tenant_id, seen_at, eligible."""
    return f"""SELECT '{name}' AS table_name, s.tenant_id,
  count(*) FILTER (NOT (eligible AND seen_at < cutoff)) AS kept, count(*) FILTER (eligible AND seen_at < cutoff) AS purged
  FROM ({select}) s JOIN cut USING (tenant_id) GROUP BY s.tenant_id"""


def leaks(name: str, table: str, fields: str) -> str:
    parts = []
    for i, marker in enumerate(("@example", 'token = "', "src", "no such marker"), 1):
        parts.append(f"""SELECT '{name}' AS table_name, {i} AS marker_no, count(*) AS inspected,
  count(*) FILTER (contains({fields}, '{marker}')) AS matches,
  count(*) > 0 AND count(*) FILTER (contains({fields}, '{marker}')) = 0 AS passed FROM {table}""")
    return " UNION ALL ".join(parts)


# Go's shortest form from DuckDB's shortest digits, for 1e-4 <= x.
def short_double(expr: str) -> str:
    return f"regexp_replace(CAST({expr} AS VARCHAR), '\\.0$', '')"


ORACLES: dict[str, str] = {
    "usage_metrics": f"WITH {WINDOWED} SELECT * FROM usage",
    "usage_metrics_tenant": f"WITH {WINDOWED} SELECT * FROM usage WHERE tenant_id = 'tenant-2'",
    "error_rate": f"""WITH {WINDOWED} SELECT tenant_id, span_count, error_count,
  CASE WHEN span_count > 0 THEN round(error_count / span_count * 100, 2) ELSE 0.0 END AS error_rate FROM usage""",
    "service_dependencies": f"""WITH {WINDOWED} SELECT tenant_id, service AS source, peer AS target, count(*) AS edge_count
  FROM recent WHERE signal_type = 'trace' AND peer <> '' GROUP BY ALL""",
    "dedupe_latest": f"""WITH {SPANS} SELECT tenant_id, event_key, signal_type, trace_id, {ms('ingested_at')} AS ingested_at FROM cur""",
    "last_hours": f"""WITH {SPANS} SELECT tenant_id, signal_type, count(*) AS rows_in_window FROM spans
  WHERE ingested_at >= (SELECT max(ingested_at) FROM spans) - INTERVAL 24 HOUR GROUP BY ALL""",
    "trace_lookup": f"""WITH {SPANS} SELECT event_key, eid AS event_id, signal_type, trace_id, span_id, parent_span_id,
  event_type AS name, service, 'v1' AS policy_version,
  CASE WHEN k % 3 = 0 THEN 'attributes.customer.email' ELSE '' END AS redacted_paths, {ms('ingested_at')} AS ingested_at
  FROM cur WHERE tenant_id = 'tenant-1' AND trace_id = 'trace-5-19737'""",
    "trace_lookup_many": f"""WITH {SPANS} SELECT tenant_id, trace_id, event_key, event_type AS name, {ms('ingested_at')} AS ingested_at
  FROM cur WHERE trace_id IN (SELECT trace_id FROM ev WHERE is_error)""",
    "trace_timeline": f"""WITH {SPANS} SELECT tenant_id, trace_id, event_key, {ms('ingested_at')} AS ingested_at,
  CASE WHEN signal_type = 'log' THEN 'Log record' ELSE event_type END AS title, span_id AS span_label,
  CASE WHEN signal_type = 'log' THEN 'Trace-linked sanitized log'
       WHEN parent_span_id <> '' THEN 'Causal parent: ' || parent_span_id ELSE 'Trace root' END AS relation,
  'v1' AS policy_version, CASE WHEN k % 3 = 0 THEN 'attributes.customer.email' ELSE 'none' END AS redacted_fields FROM cur""",
    "audit_timeline": f"""WITH {BASE} SELECT event_id AS id, 'user_signup' AS action, CAST(k AS VARCHAR) AS k, {ms('ts')} AS created_at
  FROM ev WHERE tenant_id = 'tenant-1' AND event_type = 'signup' ORDER BY event_id DESC LIMIT 100""",
    "sampling_decisions": f"""WITH {DECIDED} SELECT tenant_id, trace_id, reason, retained, span_count, {ms('last_ts')} AS created_at
  FROM decided QUALIFY row_number() OVER (PARTITION BY tenant_id ORDER BY last_ts DESC, trace_id DESC) <= 100""",
    "append_audit": f"""WITH {BASE}, old AS ({AUDIT}),
  top AS (SELECT tenant_id, max(id) AS last FROM old GROUP BY tenant_id),
  news AS (SELECT 'tenant-' || (conv_id % 4) AS tenant_id, role,
    'turn:' || lpad(CAST(conv_id AS VARCHAR), 9, '0') || ':' || lpad(CAST(turn AS VARCHAR), 4, '0') AS action FROM conversations)
  SELECT event_id AS id, tenant_id, 'user_signup' AS action, CAST(k AS VARCHAR) AS k, {ms('ts')} AS created_at FROM ev WHERE event_type = 'signup'
  UNION ALL
  SELECT coalesce(last, 0) + row_number() OVER (PARTITION BY n.tenant_id ORDER BY action), n.tenant_id, action, role, {AS_OF_MS}
  FROM news n LEFT JOIN top ON top.tenant_id = n.tenant_id""",

    "sanitize_documents": f"SELECT doc_id, {masked('text', *TEXT_RULES)} AS text FROM documents",
    "sanitize_conversations": f"""WITH {LOGS} SELECT request_id, 'tenant-' || tenant || ':' || event_id AS event_key,
  {by_tenant('tenant', 'severity', TEXT_RULES)} AS severity, {by_tenant('tenant', 'text', TEXT_RULES)} AS body,
  {VERSIONS.format('tenant')} AS policy_version FROM turns WHERE strlen(text) <= 4096""",
    "redaction_receipts": f"""WITH {REQUESTS}, ok AS (
    SELECT *, user_id % 4 AS tenant, 'user' || user_id || '@example.test' AS note,
      {short_double('value')} AS val, CASE WHEN is_error THEN '503' ELSE '200' END AS status
    FROM broken WHERE NOT bad_key AND NOT not_strict AND NOT not_valid),
  attrs AS (SELECT request_id, tenant, unnest([
      {{'k': 'http.status_code', 'v': status}}, {{'k': 'note', 'v': note}}, {{'k': 'peer.service', 'v': peer}},
      {{'k': 'service.name', 'v': service}}, {{'k': 'telemetry.source', 'v': 'otlp_http_json'}}, {{'k': 'value', 'v': val}}]) AS a FROM ok),
  done AS (SELECT request_id, tenant, a.k AS k, a.v <> {by_tenant('tenant', 'a.v', ('@example',))} AS hit FROM attrs)
  SELECT request_id, {VERSIONS.format('tenant')} AS policy_version,
    coalesce(string_agg('attributes.' || k, ',' ORDER BY k) FILTER (hit), '') AS redacted_paths FROM done GROUP BY request_id, tenant""",
    "sanitize_attributes": f"""WITH m AS (SELECT doc_id, lang, {masked('text', *TEXT_RULES)} AS t, text, source,
    {masked('source', *TEXT_RULES)} AS s FROM documents),
  n AS (SELECT *, 1 + CAST(t <> text AS INTEGER) + CAST(s <> source AS INTEGER) AS redacted FROM m)
  SELECT doc_id, 'docs-1' AS policy_version, redacted, 'doc.text' AS attr_key, t AS attr_value FROM n
  UNION ALL SELECT doc_id, 'docs-1', redacted, source || '_Secret', '[REDACTED]' FROM n
  UNION ALL SELECT doc_id, 'docs-1', redacted, 'source', s FROM n""",
    "sensitive_keys": """WITH names AS (
    SELECT event_type AS attr_key FROM events
    UNION ALL SELECT event_type || (['_API_KEY', '.Cookie', '.passwd', '_Tokenizer', '.http_Authorization', '.name'])[CAST(json_extract(props, '$.k') AS INTEGER) % 6 + 1] FROM events)
  SELECT attr_key, count(*) AS occurrences,
    contains(attr_key, '_API_KEY') OR contains(attr_key, '.Cookie') OR contains(attr_key, '_Tokenizer') OR contains(attr_key, 'Authorization') AS sensitive
  FROM names GROUP BY attr_key""",
    "active_policies": f"WITH {POLICIES} SELECT tenant_id, policy_version, array_to_string(expressions, ' ') AS expressions, policy_ok FROM active",
    "attach_policy": f"""WITH {POLICIES} SELECT event_id, coalesce(policy_version, 'deploy-1') AS policy_version,
  CAST(1 + CASE WHEN policy_ok THEN len(expressions) ELSE 0 END AS INTEGER) AS patterns, coalesce(policy_ok, TRUE) AS policy_ok
  FROM events e LEFT JOIN active a ON a.tenant_id = 'tenant-u' || (user_id + event_id % 2)""",
    "resolve_tenants": f"WITH {REQUESTS} SELECT request_id, CASE WHEN NOT bad_key THEN tenant_id END AS tenant_id FROM broken",
    "register_tenant_keys": f"""WITH n AS (SELECT DISTINCT 'tenant-' || (user_id % 10) AS t FROM events),
  old AS (SELECT unnest(['tenant-0', 'tenant-1', 'tenant-2', 'tenant-3', 'tenant-idle']) AS t)
  SELECT 'tenant' AS kind, t AS tenant_id, '' AS key_hash, '2024-01-01 00:00:00.000' AS created_at FROM old
  UNION ALL SELECT 'tenant', t, '', {AS_OF_MS} FROM n WHERE t NOT IN (SELECT t FROM old)
  UNION ALL SELECT 'key', t, sha256('key-' || t), '2024-01-01 00:00:00.000' FROM old WHERE t <> 'tenant-idle'
  UNION ALL SELECT 'key', 'tenant-0', sha256('key-old'), '2024-01-01 00:00:00.000'
  UNION ALL SELECT 'key', t, sha256('key-' || t), {AS_OF_MS} FROM n WHERE t NOT IN (SELECT t FROM old)""",

    "parse_otlp_traces": f"""WITH {BASE} SELECT 'req-' || event_id AS request_id, 1 AS ordinal, eid AS event_id, event_type AS name, a.k AS attr_key, a.v AS attr_value
  FROM (SELECT *, unnest([
      {{'k': 'http.status_code', 'v': CASE WHEN is_error THEN '503' ELSE '200' END}}, {{'k': 'note', 'v': 'user' || user_id || '@example.test'}},
      {{'k': 'peer.service', 'v': peer}}, {{'k': 'service.name', 'v': service}}, {{'k': 'telemetry.source', 'v': 'otlp_http_json'}},
      {{'k': 'value', 'v': {short_double('value')}}}]) AS a FROM ev)""",
    "parse_otlp_logs": f"""WITH {LOGS} SELECT request_id, 1 AS ordinal, trace_id, a.k AS attr_key, a.v AS attr_value
  FROM (SELECT *, unnest([{{'k': 'log.severity', 'v': severity}}, {{'k': 'log.body', 'v': text}},
    {{'k': 'telemetry.source', 'v': 'otlp_http_json'}}]) AS a FROM turns)""",
    "parse_events": """SELECT CAST(event_id AS VARCHAR) AS request_id, 'event-' || event_id AS event_id, '' AS signal,
  'trace-' || user_id AS trace_id, event_type AS name, props, 'trace-' || user_id AS tail_trace_id FROM events""",
    "log_event_ids": f"WITH {LOGS} SELECT request_id, event_id FROM turns",
    "strict_json": f"WITH {REQUESTS} SELECT request_id, NOT not_strict AS strict_ok FROM broken",
    "request_outcome": f"""WITH {REQUESTS} SELECT request_id, CASE WHEN NOT bad_key THEN tenant_id END AS tenant_id,
  CASE WHEN bad_key THEN 401 WHEN not_strict OR not_valid THEN 400 ELSE 202 END AS code FROM broken""",
    "request_outcome_batches": f"""WITH {BATCHES} SELECT request_id, tenant_id, code FROM sent""",
    "staged_batches": f"""WITH {BATCHES} SELECT tenant_id, request_id, n AS staged, 1 AS first_pos, CAST(n AS INTEGER) AS last_pos
  FROM sent WHERE code = 202 AND NOT again""",
    "log_batch_ids": """SELECT request_id, ordinal, 'log-' || left(sha256(request_id || '::' || turn || ':' || ordinal), 16) AS event_id
  FROM (SELECT 'conv-' || conv_id AS request_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS ordinal FROM conversations)""",
    "event_validity": """SELECT doc_id,
  doc_id % 140 BETWEEN 1 AND 128 AND strlen(text) <= 4096 AND doc_id % 4 <> 3
    AND (doc_id % 4 = 0 OR doc_id % 9 <> 0) AS valid,
  strlen(text) <= 1048576 AS body_ok FROM documents""",
    "single_tenant_check": f"""WITH {BASE} SELECT 'r-' || (event_id // 3) AS request_id, count(DISTINCT tenant_id) = 1 AS single_tenant
  FROM ev GROUP BY event_id // 3""",

    "fnv_sample": f"""WITH {BASE}, ids AS (SELECT DISTINCT trace_id FROM ev)
  SELECT trace_id, {fnv('trace_id')} AS hash, {fnv('trace_id')} % 10 = 0 AS sampled FROM ids""",
    "sample_traces": f"""WITH {BASE}, ids AS (SELECT DISTINCT trace_id FROM ev)
  SELECT trace_id FROM ids WHERE {fnv('trace_id')} % 10 = 0 ORDER BY trace_id LIMIT 100""",
    "trace_flags": f"WITH {DECIDED} SELECT tenant_id, trace_id, has_error, has_slow, span_count FROM flags",
    "decide_traces": f"WITH {DECIDED} SELECT tenant_id, trace_id, reason, retained, span_count FROM decided",
    "decision_counts": f"WITH {DECIDED} SELECT reason, retained, count(*) AS decisions FROM decided GROUP BY ALL",

    "new_event_keys": f"WITH {NOON} SELECT tenant_id, event_key, 'req-' || event_id AS request_id FROM late",
    "late_events": f"""WITH {NOON} SELECT tenant_id, trace_id, event_key FROM late
  WHERE trace_id IN (SELECT trace_id FROM early WHERE is_error)""",
    "span_limit": f"""WITH RECURSIVE {BASE},
  asked AS (SELECT trace_id, event_type, trace_id || '/' || event_type AS request_id, count(*) AS n, min(ts) AS first_at FROM ev GROUP BY ALL),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY first_at, request_id) AS i FROM asked),
  walk AS (
    SELECT trace_id, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS used, '' AS request_id, TRUE AS fits FROM ranked WHERE i = 1
    UNION ALL
    SELECT r.trace_id, r.i, CASE WHEN w.used + r.n <= 3 THEN w.used + r.n ELSE w.used END, r.request_id, w.used + r.n <= 3
    FROM walk w JOIN ranked r ON r.trace_id = w.trace_id AND r.i = w.i + 1)
  SELECT request_id FROM walk WHERE NOT fits""",
    "stage": f"""WITH RECURSIVE {NOON},
  held AS (SELECT trace_id, count(*) AS n, bool_or(is_error) AS closed FROM early GROUP BY trace_id),
  asked AS (SELECT l.*, coalesce(h.n, 0) AS held, coalesce(h.closed, FALSE) AS closed,
      row_number() OVER (PARTITION BY l.trace_id ORDER BY ts, 'req-' || event_id) AS i FROM late l LEFT JOIN held h USING (trace_id))
  SELECT 'req-' || event_id AS request_id,
    CASE WHEN closed THEN 'late' WHEN held + i > 4 THEN 'span_limit' ELSE 'staged' END AS result FROM asked""",
    "trace_state": f"WITH {TRACES} SELECT tenant_id, trace_id, {ms('first_seen')} AS first_seen, {ms('last_seen')} AS last_seen, generation, span_count FROM traces",
    "upsert_traces": f"WITH {TRACES} SELECT tenant_id, trace_id, {ms('first_seen')} AS first_seen, {ms('last_seen')} AS last_seen, generation, span_count FROM traces",
    "open_trace_counts": f"WITH {TRACES} SELECT tenant_id, count(*) FILTER (decided_at IS NULL) AS open_traces FROM traces GROUP BY tenant_id",
    "buffer_counts": f"WITH {BASE} SELECT tenant_id, trace_id, count(*) AS buffered FROM ev GROUP BY ALL",
    "evict_pressure": f"""WITH {TRACES} SELECT tenant_id, trace_id, 'evicted_pressure' AS reason, FALSE AS retained, span_count, {AS_OF_MS} AS created_at
  FROM traces WHERE decided_at IS NULL
  QUALIFY row_number() OVER (PARTITION BY tenant_id ORDER BY first_seen DESC, trace_id DESC) > 50""",
    "evict_span_limit": f"""WITH {TRACES} SELECT tenant_id, trace_id, 'evicted_span_limit' AS reason, FALSE AS retained, span_count, {AS_OF_MS} AS created_at
  FROM traces WHERE decided_at IS NULL AND span_count > 3""",
    "ready_traces": f"""WITH {TRACES} SELECT tenant_id, trace_id, generation, {ms('last_seen')} AS last_seen FROM traces
  WHERE decided_at IS NULL AND last_seen <= (SELECT max(last_seen) FROM traces) - INTERVAL 6 HOUR""",
    "ready_traces_claim": f"""WITH {TRACES} SELECT tenant_id, trace_id, generation, {ms('last_seen')} AS last_seen FROM traces
  WHERE decided_at IS NULL AND last_seen <= {AS_OF} - INTERVAL 2 SECOND ORDER BY traces.last_seen, tenant_id, trace_id LIMIT 32""",
    "load_trace": f"""WITH {TRACES} SELECT e.tenant_id, e.trace_id, e.event_key, t.generation, {ms('e.ts')} AS received_at
  FROM ev e JOIN traces t ON t.tenant_id = e.tenant_id AND t.trace_id = e.trace_id WHERE t.decided_at IS NULL""",
    "apply_decisions": f"""WITH {DECIDED}, traces AS ({traces('ev')})
  SELECT t.tenant_id, t.trace_id, t.generation, CAST(t.span_count AS INTEGER) AS span_count,
    CASE WHEN t.decided_at IS NULL AND t.generation = 3 THEN d.reason ELSE t.decision END AS decision,
    CASE WHEN t.decided_at IS NULL AND t.generation = 3 THEN {AS_OF_MS} ELSE {ms('t.decided_at')} END AS decided_at
  FROM traces t JOIN decided d ON d.tenant_id = t.tenant_id AND d.trace_id = t.trace_id""",
    "purge_buffers": f"""WITH {DECIDED} SELECT tenant_id, trace_id, event_key FROM ev
  WHERE trace_id IN (SELECT trace_id FROM decided WHERE NOT retained)""",
    "enqueue_retained": f"""WITH {DECIDED} SELECT event_key, tenant_id, 0 AS attempts, {AS_OF_MS} AS created_at FROM ev
  WHERE trace_id IN (SELECT trace_id FROM decided WHERE retained) AND event_id % 3 <> 0""",

    "pending_outbox": f"""WITH {OUTBOX} SELECT event_key, tenant_id, attempts + 1 AS attempts, {ms('created_at')} AS created_at
  FROM outbox WHERE published_at IS NULL ORDER BY outbox.created_at, event_key LIMIT 32""",
    "publish_outbox": f"""WITH {OUTBOX} SELECT event_key, 1 AS attempts,
  CASE WHEN published_at IS NULL THEN {AS_OF_MS} ELSE {ms('published_at')} END AS published_at FROM outbox""",
    "topic_round_trip": f"WITH {BASE} SELECT tenant_id, event_key, signal_type AS signal, event_type AS name, peer FROM ev",
    "claim_deliveries": f"""WITH {LEDGER} SELECT e.event_key, e.tenant_id, coalesce(l.status, 'pending') AS status,
  CAST(CASE WHEN l.status IS NULL THEN 1 WHEN l.status = 'pending' THEN l.attempts + 1 ELSE l.attempts END AS INTEGER) AS attempts,
  l.last_error_class, CASE WHEN l.status IS NULL THEN {AS_OF_MS} ELSE {ms('e.ts')} END AS created_at,
  CASE WHEN coalesce(l.status, 'pending') = 'pending' THEN {AS_OF_MS} ELSE {ms('e.ts')} END AS updated_at,
  coalesce(l.status, 'pending') = 'pending' AS claimed
  FROM ev e LEFT JOIN ledger l ON l.event_id = e.event_id""",
    "mark_persisted": f"""WITH {LEDGER} SELECT e.event_key, e.tenant_id,
  CASE WHEN coalesce(l.status, 'pending') = 'pending' THEN 'persisted' ELSE l.status END AS status,
  CAST(CASE WHEN l.status IS NULL THEN 1 WHEN l.status = 'pending' THEN l.attempts + 1 ELSE l.attempts END AS INTEGER) AS attempts,
  CASE WHEN l.status <> 'pending' THEN l.last_error_class END AS last_error_class,
  CASE WHEN l.status IS NULL THEN {AS_OF_MS} ELSE {ms('e.ts')} END AS created_at,
  CASE WHEN coalesce(l.status, 'pending') = 'pending' THEN {AS_OF_MS} ELSE {ms('e.ts')} END AS updated_at
  FROM ev e LEFT JOIN ledger l ON l.event_id = e.event_id""",
    "record_loss": f"""WITH {LEDGER} SELECT event_key, tenant_id,
  CASE status WHEN 'pending' THEN 'loss_evidenced' ELSE status END AS status, attempts,
  CASE status WHEN 'pending' THEN 'retries_exhausted' ELSE last_error_class END AS last_error_class,
  {ms('ts')} AS created_at, CASE status WHEN 'pending' THEN {AS_OF_MS} ELSE {ms('ts')} END AS updated_at FROM ledger""",
    "persist": f"""WITH {BASE} SELECT tenant_id, event_key, signal_type, service AS service_name, is_error AS usage_error,
  {AS_OF_MS} AS ingested_at, 'persisted' AS status, 1 AS attempts FROM ev""",
    "span_table": f"""WITH {SPANS} SELECT tenant_id, event_key, parent_span_id, round(value * 3, 2) AS duration_ms, {ms('ingested_at')} AS ingested_at FROM cur""",

    "retention_policies": """SELECT 'tenant-c' || c_custkey AS tenant_id,
  CAST(CASE WHEN c_nationkey % 3 = 0 THEN 30 WHEN c_custkey * 7 % 4000 BETWEEN 1 AND 3650 THEN c_custkey * 7 % 4000 END AS INTEGER) AS retention_days
  FROM customer""",
    "apply_retention": f"""WITH {SPANS}{RETENTION}, traces AS ({traces('ev')}), """ + " , ".join(
        f"r_{name} AS ({purge(name, select)})" for name, select in {
            "spans": "SELECT tenant_id, ingested_at AS seen_at, TRUE AS eligible FROM spans",
            "tail_outbox": "SELECT tenant_id, ts AS seen_at, event_id % 3 <> 0 AS eligible FROM ev",
            "tail_event_keys": "SELECT tenant_id, ts AS seen_at, TRUE AS eligible FROM ev",
            "tail_decisions": "SELECT tenant_id, max(ts) AS seen_at, TRUE AS eligible FROM ev GROUP BY tenant_id, trace_id",
            "tail_traces": "SELECT tenant_id, coalesce(decided_at, first_seen) AS seen_at, decided_at IS NOT NULL AS eligible FROM traces",
        }.items()) + " SELECT * FROM r_spans UNION ALL SELECT * FROM r_tail_outbox UNION ALL SELECT * FROM r_tail_event_keys"
    " UNION ALL SELECT * FROM r_tail_decisions UNION ALL SELECT * FROM r_tail_traces",
    "expire_spans": f"""WITH {SPANS}{RETENTION} SELECT s.tenant_id, event_key, {ms('ingested_at')} AS ingested_at
  FROM spans s JOIN cut ON cut.tenant_id = s.tenant_id WHERE ingested_at >= cutoff""",
    "delete_tenant": f"WITH {SPANS}, ledger AS (SELECT * FROM ev WHERE event_id % 2 = 0 OR event_id % 7 = 0 OR event_id % 11 = 0) "
    + " UNION ALL ".join(census(n, s + " WHERE tenant_id <> 'tenant-1'") for n, s in STATE.items())
    + " UNION ALL " + census("delivery_ledger", "SELECT tenant_id FROM ledger")
    + " UNION ALL " + census("audit_events", "SELECT tenant_id FROM ev WHERE event_type = 'signup' UNION ALL SELECT 'tenant-1'"),
    "tail_row_census": f"WITH {SPANS} " + " UNION ALL ".join(
        census(n, STATE[n]) for n in ("tail_traces", "tail_buffers", "tail_decisions", "tail_outbox", "tail_event_keys")),

    "http_outcomes": f"WITH {HTTP} SELECT service, route, code, count(*) AS requests FROM http GROUP BY ALL",
    "request_rate": f"""WITH {HTTP}, m AS (SELECT date_trunc('minute', ts) AS w, service, count(*) AS requests,
    count(*) FILTER (code >= 500) AS bad FROM http GROUP BY ALL)
  SELECT {ms('w')} AS window_start, service, requests, round(requests / 60.0::DOUBLE, 6) AS rate, round(bad / 60.0::DOUBLE, 6) AS error_rate_5xx FROM m""",
    "latency_percentiles": f"""WITH {HTTP}, p AS (SELECT unnest([50, 95, 99]) AS percentile),
  r AS (SELECT service, route, latency_ms, row_number() OVER (PARTITION BY service, route ORDER BY latency_ms) - 1 AS i,
    count(*) OVER (PARTITION BY service, route) AS n FROM http)
  SELECT service, route, percentile, n AS samples, latency_ms AS value FROM r JOIN p ON i = (n - 1) * percentile // 100""",
    "run_summary": f"""WITH {HTTP}, s AS (SELECT service, count(*) AS sent, count(*) FILTER (code = 200) AS accepted,
    count(*) FILTER (code <> 200) AS failed, date_diff('microsecond', min(ts), max(ts)) / 1000.0::DOUBLE AS ms FROM http GROUP BY service)
  SELECT service, sent, accepted, failed, round(ms, 6) AS elapsed_millis, round(accepted / (ms / 1000), 6) AS achieved_per_second FROM s""",
    "leak_scan": f"""WITH masked AS (SELECT doc_id, {masked('text', *TEXT_RULES)} AS text FROM documents) """
    + leaks("documents", "documents", "text || '|' || lang || '|' || source") + " UNION ALL "
    + leaks("conversations", "conversations", "text || '|' || role") + " UNION ALL "
    + leaks("masked_documents", "masked", "text"),
    "bench_gates": """WITH u AS (SELECT user_id, count(*) AS n, max(value) AS worst, count(*) FILTER (event_type = 'error') AS bad FROM events GROUP BY user_id),
  f AS (SELECT *, user_id % 7 <> 0 AS finite, user_id % 6 <> 0 AS looked FROM u)
  SELECT user_id AS run_id, g.no AS gate_no, g.name AS gate, g.ok AS passed FROM (SELECT user_id, unnest([
    {'no': 1, 'name': 'finite_numbers', 'ok': finite AND looked},
    {'no': 2, 'name': 'target', 'ok': 4900 + n * 2 >= 5000},
    {'no': 3, 'name': 'duration', 'ok': TRUE},
    {'no': 4, 'name': 'timestamps', 'ok': user_id % 5 <> 0},
    {'no': 5, 'name': 'trace_samples', 'ok': user_id % 4 <> 0},
    {'no': 6, 'name': 'no_failures', 'ok': bad % 2 = 0},
    {'no': 7, 'name': 'elapsed', 'ok': 599950 + n >= 600000},
    {'no': 8, 'name': 'throughput', 'ok': NOT finite OR 4940 + n >= 5000},
    {'no': 9, 'name': 'lookup_p95', 'ok': looked AND worst * 10 <= 3000}]) AS g FROM f)""",
    "error_class": """SELECT CASE WHEN event_type = 'error' THEN 'postgres_40001' WHEN event_id % 4 = 0 THEN 'claim_tail_traces_failure'
    WHEN event_id % 4 = 1 THEN 'record_tail_decision_failure' WHEN event_id % 4 = 2 THEN 'mark_tail_outbox_failure' ELSE 'tail_failure' END AS error_class,
  count(*) AS failures FROM events GROUP BY ALL""",
    "scalar_functions": """WITH v AS (SELECT *, value * 100000 AS big, CAST(value * 100000 AS VARCHAR) AS t FROM events),
  p AS (SELECT *, regexp_replace(t, '\\.0$', '') AS plain, length(split_part(t, '.', 1)) - 1 AS power,
    rtrim(replace(regexp_replace(t, '\\.0$', ''), '.', ''), '0') AS digits FROM v)
  SELECT event_id,
    CASE WHEN big < 1000000 THEN plain ELSE left(digits, 1) || CASE WHEN length(digits) > 1 THEN '.' || substr(digits, 2) ELSE '' END
      || 'e+' || lpad(CAST(power AS VARCHAR), 2, '0') END AS shortest,
    CAST(value / 1000000 AS VARCHAR) AS small, CAST(event_id AS INTEGER) AS int32,
    CASE WHEN event_type <> 'view' THEN value END AS number, event_type <> 'click' AS trace_id_ok,
    'a|' || event_type AS parts, props AS bag, '{"k":"' || CAST(json_extract(props, '$.k') AS VARCHAR) || '"}' AS bag_again FROM p""",
    "observe_stream": f"""WITH {BASE}, o AS (
    SELECT *, coalesce(sum(CAST(is_error OR is_slow AS INTEGER)) OVER (PARTITION BY trace_id ORDER BY ts, 'req-' || event_id
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS episode FROM ev)
  SELECT tenant_id, trace_id, CASE WHEN bool_or(is_error) THEN 'retained_error' ELSE 'retained_slow' END AS reason,
    TRUE AS retained, CAST(count(*) AS INTEGER) AS span_count
  FROM o GROUP BY tenant_id, trace_id, episode HAVING bool_or(is_error OR is_slow)""",
    "trace_stream": f"""WITH {DECIDED} SELECT tenant_id, trace_id, reason, retained, CAST(span_count AS INTEGER) AS span_count
  FROM decided WHERE epoch_ms(last_ts) + 3600000 <= (SELECT epoch_ms(max(ts)) FROM ev)""",
    "trace_stream_retained": f"""WITH {BASE},
  n AS (SELECT *, 'req-' || event_id AS request_id, row_number() OVER (PARTITION BY tenant_id, trace_id ORDER BY ts, 'req-' || event_id) AS i FROM ev),
  t AS (SELECT tenant_id, trace_id, bool_or(is_error) AS e, bool_or(is_slow) AS s, max(ts) AS last_ts FROM n WHERE i <= 3 GROUP BY ALL),
  d AS (SELECT *, CASE WHEN e THEN 'retained_error' WHEN s THEN 'retained_slow' WHEN {fnv('trace_id')} % 10 = 0 THEN 'retained_healthy_sample' END AS reason
    FROM t WHERE epoch_ms(last_ts) + 3600000 <= (SELECT epoch_ms(max(ts)) FROM ev))
  SELECT n.tenant_id, n.trace_id, 'retained' AS kind, event_key, NULL AS request_id, reason FROM n JOIN d ON n.tenant_id = d.tenant_id AND n.trace_id = d.trace_id
  WHERE i <= 3 AND reason IS NOT NULL
  UNION ALL SELECT tenant_id, trace_id, 'refused', NULL, request_id, 'span_limit' FROM n WHERE i > 3""",
    "request_rate_stream": f"""WITH {HTTP}, m AS (SELECT date_trunc('minute', ts) AS w, service, count(*) AS requests,
    count(*) FILTER (code >= 500) AS bad FROM http GROUP BY ALL)
  SELECT {ms('w')} AS window_start, service, requests, round(requests / 60.0::DOUBLE, 6) AS rate, round(bad / 60.0::DOUBLE, 6) AS error_rate_5xx FROM m""",
    "tail_stream": tail("2 SECOND", 1000),
    "tail_pressure": tail("6 HOUR", 16),
    "tail_in_slices": tail("6 HOUR", 16),
    "tail_stream_outcomes": f"""WITH {REQUESTS}, {taken("2 SECOND", 1000)}
  SELECT request_id, CASE WHEN NOT bad_key THEN tenant_id END AS tenant_id, CASE WHEN bad_key THEN 401 WHEN not_strict OR not_valid THEN 400
    WHEN request_id IN (SELECT request_id FROM taken) THEN 202 ELSE 503 END AS code FROM broken""",
    "persist_stream": f"""WITH {BASE} SELECT tenant_id, event_key, signal_type, event_type AS name, {AS_OF_MS} AS ingested_at FROM ev""",
}
