"""SQL counterparts of the registered queries, written apart from the operators.

They run on the plain tables and state each result directly: quantiles by the engine's
own function, trees by recursion, alert ticks by joining every tick with its look-back.
"""

from __future__ import annotations

EPOCH_US = 1_704_067_200_000_000
HOUR_US = 3_600_000_000

SPANS = f"""
arriving AS (
  SELECT CAST(l_orderkey AS VARCHAR) AS trace_id,
         CAST(l_linenumber AS VARCHAR) AS span_id,
         CASE WHEN l_linenumber - 1 - (l_suppkey % 2) >= 1
              THEN CAST(l_linenumber - 1 - (l_suppkey % 2) AS VARCHAR) END AS parent_span_id,
         CASE WHEN l_quantity > 1 THEN
           (CASE l_returnflag WHEN 'A' THEN 'auth' WHEN 'N' THEN 'orders' ELSE 'billing' END)
           || (CASE l_linestatus WHEN 'O' THEN '-api' ELSE '-db' END) END AS service,
         CASE WHEN l_tax < 0.03 THEN 'GET /items' WHEN l_tax < 0.06 THEN 'POST /cart'
              ELSE 'GET /checkout' END AS name,
         l_linenumber - 1 AS kind,
         {EPOCH_US} + l_orderkey * 60000000 + (l_linenumber - 1) * 20000 + (l_partkey % 1000) * 10 AS start_us,
         CAST(floor(l_extendedprice) AS BIGINT) AS dur_us,
         CASE WHEN l_discount >= 0.1 THEN 2 WHEN l_tax >= 0.05 THEN 1 ELSE 0 END AS status_code,
         CASE WHEN l_quantity > 25 THEN 'POST' ELSE 'GET' END AS method,
         l_partkey AS part,
         l_shipdate AS ingested_at,
         row_number() OVER (PARTITION BY l_orderkey, l_linenumber
           ORDER BY l_shipdate, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax,
                    l_returnflag, l_linestatus) AS rn
  FROM lineitem),
spans AS (
  SELECT *, start_us + dur_us AS end_us, dur_us / 1000.0::DOUBLE AS duration_ms,
         '{{"part": ' || part || ', "http.method": "' || method || '"}}' AS attrs_json
  FROM arriving WHERE rn = 1),
span_now AS (SELECT max(start_us) AS now_us FROM arriving),
seen AS (
  SELECT * FROM spans WHERE start_us >= {EPOCH_US})
"""

LOGS = f"""
logs AS (
  SELECT {EPOCH_US} + conv_id * 60000000 + turn * 1000000 AS us, CAST(conv_id AS VARCHAR) AS trace_id,
         CAST(turn AS VARCHAR) AS span_id, role AS service,
         CASE WHEN turn % 5 = 4 THEN 17 ELSE 9 END AS severity_number, text AS body,
         '{{"turn": ' || turn || ', "origin": "chat"}}' AS attrs_json, true AS chat
  FROM conversations
  UNION ALL
  SELECT {EPOCH_US} + doc_id * 30000000, NULL, NULL, source, CASE WHEN lang = 'en' THEN 9 ELSE 13 END, text,
         '{{"lang": "' || lang || '", "n_chars": ' || n_chars || '}}', false
  FROM documents)
"""

BOUNDS = [1.0, 5.0, 10.0, 25.0, 50.0, 100.0, 250.0]
CELLS = len(BOUNDS) + 1


def _cell_count(i: int) -> str:
    low = f"value > {BOUNDS[i - 1]}" if i else "true"
    high = f"value <= {BOUNDS[i]}" if i < len(BOUNDS) else "true"
    return f"count(*) FILTER (WHERE {low} AND {high})"


METRICS = f"""
ev AS (
  SELECT epoch_us(ts) AS us, event_id, event_type, value, user_id,
         regexp_extract(props, '"k": ([0-9]+)', 1) AS k
  FROM events),
ev_now AS (SELECT max(us) AS now_us FROM ev),
hourly AS (
  SELECT us - us % {HOUR_US} AS us, event_type, sum(value) AS total, count(*) AS n,
         [{", ".join(_cell_count(i) for i in range(CELLS))}] AS counts
  FROM ev GROUP BY 1, 2),
base_points AS (
  SELECT us, event_type AS service, 'event.value' AS name, 'gauge' AS kind, 'ms' AS unit, value,
         CAST(NULL AS BIGINT) AS cnt, CAST(NULL AS BOOLEAN) AS is_monotonic, CAST(NULL AS BIGINT[]) AS counts,
         CASE WHEN event_type IN ('error', 'purchase') THEN CAST(event_id AS VARCHAR) END AS ex_trace,
         '{{"k": ' || k || ', "type": "' || event_type || '"}}' AS attrs_json, k, event_type AS type
  FROM ev
  UNION ALL
  SELECT us, event_type, 'event.total', 'sum', '1', CAST(event_id % 1000 AS DOUBLE), NULL, true, NULL, NULL,
         '{{"type": "' || event_type || '"}}', NULL, event_type
  FROM ev
  UNION ALL
  SELECT us, event_type, 'event.size', 'histogram', 'By', total, n, NULL, counts, NULL,
         '{{"type": "' || event_type || '"}}', NULL, event_type
  FROM hourly),
points AS (SELECT *, md5(coalesce(service, '') || '|' || attrs_json) AS series_key FROM base_points)
"""


def _rollup(name: str, width_us: int, where: str = "true") -> str:
    cells = ", ".join(f"CAST(sum(counts[{i + 1}]) AS BIGINT)" for i in range(CELLS))
    return f"""
{name} AS (
  SELECT us - us % {width_us} AS b, name, series_key, attrs_json, service, min(kind) AS kind, min(unit) AS unit,
         bool_or(is_monotonic) AS is_monotonic,
         CAST(sum(coalesce(cnt, 1)) AS BIGINT) AS cnt, sum(value) AS total, min(value) AS lo, max(value) AS hi,
         CASE WHEN min(kind) = 'histogram' THEN [{cells}] END AS counts
  FROM points WHERE {where} GROUP BY 1, 2, 3, 4, 5)
"""


# Output width of a read from the epoch to now, and the rollups inside that window.
WIDE = f"""
{_rollup("rolls", 300_000_000)},
wide AS (
  SELECT r.*, r.b - r.b % w.width_us AS t_us
  FROM rolls r, (SELECT now_us, 300000000 * CAST(greatest(1, ceil(floor((now_us - {EPOCH_US}) / 1e6) / 300 / 1000))
                 AS BIGINT) AS width_us FROM ev_now) w
  WHERE r.b BETWEEN {EPOCH_US} AND w.now_us)
"""

_TEXT_BOUNDS = "'" + ",".join(str(b) for b in BOUNDS) + "'"


def _with(*parts: str) -> str:
    return "WITH RECURSIVE " + ",".join(part.strip() for part in parts) + "\n"


def _summary(span_filter: str = "true", having: str = "true", trace_filter: str = "true") -> str:
    return (
        _with(SPANS)
        + f"""
SELECT trace_id, service, root_name, make_timestamp(s) AS start_time, make_timestamp(e) AS end_time,
       round((e - s) / 1000.0::DOUBLE, 9) AS duration_ms, span_count, error_count
FROM (SELECT trace_id, max(service) AS service, first(name ORDER BY start_us, span_id) AS root_name,
             min(start_us) AS s, max(end_us) AS e, count(*) AS span_count,
             count(*) FILTER (WHERE status_code = 2) AS error_count
      FROM seen WHERE {span_filter} GROUP BY trace_id)
WHERE {having} AND {trace_filter}
"""
    )


TREE = """
tree AS (
  SELECT c.trace_id, c.span_id, p.span_id AS parent, c.start_us, c.end_us, c.name, c.service, c.status_code
  FROM spans c LEFT JOIN spans p ON p.trace_id = c.trace_id AND p.span_id = c.parent_span_id),
walk AS (
  SELECT trace_id, span_id, parent, start_us, end_us, 0 AS depth,
         lpad(CAST(start_us AS VARCHAR), 20, '0') || '.' || span_id AS path
  FROM tree WHERE parent IS NULL
  UNION ALL
  SELECT c.trace_id, c.span_id, c.parent, c.start_us, c.end_us, w.depth + 1,
         w.path || '/' || lpad(CAST(c.start_us AS VARCHAR), 20, '0') || '.' || c.span_id
  FROM tree c JOIN walk w ON c.trace_id = w.trace_id AND c.parent = w.span_id),
ordered AS (
  SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY path) - 1 AS position FROM walk),
reach AS (
  SELECT a.trace_id, a.span_id, max(d.end_us) AS subtree_end
  FROM walk a JOIN walk d ON d.trace_id = a.trace_id AND (d.path = a.path OR starts_with(d.path, a.path || '/'))
  GROUP BY 1, 2),
chosen AS (
  SELECT trace_id, span_id FROM (
    SELECT w.trace_id, w.span_id, row_number() OVER (PARTITION BY w.trace_id, w.parent
             ORDER BY r.subtree_end DESC, w.start_us, w.span_id) AS rk
    FROM walk w JOIN reach r USING (trace_id, span_id) WHERE w.parent IS NOT NULL)
  WHERE rk = 1),
route AS (
  SELECT trace_id, span_id FROM walk WHERE parent IS NULL
  UNION ALL
  SELECT w.trace_id, w.span_id FROM route p JOIN walk w ON w.trace_id = p.trace_id AND w.parent = p.span_id
  JOIN chosen c ON c.trace_id = w.trace_id AND c.span_id = w.span_id)
"""


def _quantile(q: float) -> str:
    """Interpolated quantile of a counts list over the fixed bounds, by its rank's cell."""
    bounds = "[" + ", ".join(f"{b}::DOUBLE" for b in BOUNDS) + "]"
    total = "list_sum(counts)"
    running = "list_transform(counts, lambda c, i: list_sum(counts[1:i]))"
    hit = f"list_position(list_transform({running}, lambda c: c >= {q} * {total}), true)"
    return f"""
CASE WHEN {total} = 0 THEN NULL
     WHEN {hit} = {CELLS} THEN {bounds}[{CELLS - 1}]
     WHEN counts[{hit}] = 0 THEN {bounds}[{hit}]
     ELSE round((CASE WHEN {hit} = 1 THEN 0::DOUBLE ELSE {bounds}[{hit} - 1] END)
       + ({bounds}[{hit}] - (CASE WHEN {hit} = 1 THEN 0::DOUBLE ELSE {bounds}[{hit} - 1] END))
         * ({q} * {total} - (list_sum(counts[1:{hit}]) - counts[{hit}])) / counts[{hit}], 9) END"""


QUANTILES = ", ".join(f"{_quantile(q)} AS {n}" for n, q in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99)))
SUMMED_CELLS = "[" + ", ".join(f"CAST(sum(counts[{i + 1}]) AS BIGINT)" for i in range(CELLS)) + "]"
HIST = f"""
dist AS (SELECT name, t_us, {SUMMED_CELLS} AS counts FROM wide WHERE kind = 'histogram' GROUP BY 1, 2),
quants AS (SELECT *, {QUANTILES} FROM dist)
"""
HIST_SERIES = f"""
sdist AS (SELECT name, attrs_json, t_us, {SUMMED_CELLS} AS counts FROM wide WHERE kind = 'histogram' GROUP BY 1, 2, 3)
"""

FACET = """
levels AS (
  SELECT name, attrs_json, t_us, sum(total) / sum(cnt) AS mean, max(hi) AS level FROM wide GROUP BY 1, 2, 3),
sizes AS (
  SELECT *, row_number() OVER (PARTITION BY name ORDER BY n_points DESC, attrs_json) AS series_rank
  FROM (SELECT name, attrs_json, count(*) AS n_points FROM levels GROUP BY 1, 2)),
rates AS (
  SELECT *, lag(level) OVER w AS before, lag(t_us) OVER w AS before_us FROM levels
  WINDOW w AS (PARTITION BY name, attrs_json ORDER BY t_us)),
lines AS (
  SELECT r.name, r.attrs_json, s.series_rank, r.t_us,
         CASE WHEN r.name <> 'event.total' THEN r.mean
              WHEN r.before IS NULL THEN NULL
              WHEN r.level >= r.before THEN (r.level - r.before) / ((r.t_us - r.before_us) / 1e6)
              ELSE 0 END AS v
  FROM rates r JOIN sizes s USING (name, attrs_json))
"""


def _lines(where: str) -> str:
    return (
        _with(METRICS, WIDE, FACET)
        + f"""SELECT name, attrs_json, CAST(series_rank AS INTEGER) AS series_rank, make_timestamp(t_us) AS t,
round(v, 9) AS v FROM lines WHERE {where}"""
    )


RULES = """
rules(rule_id, rule, metric, svc, cmp, threshold, agg, window_s, enabled, match_type, exclude_type, rated, dwell) AS (
  VALUES
  (1, 'mean value high', 'event.value', NULL, 'gt', 24.0::DOUBLE, 'avg', 21600, true, NULL, NULL, false, 0),
  (2, 'error peak', 'event.value', NULL, 'gt', 60.0, 'max', 86400, true, 'error', NULL, false, 7200),
  (3, 'floor low', 'event.value', NULL, 'lt', 0.05, 'min', 21600, true, NULL, 'view', false, 0),
  (4, 'clicks quiet', 'event.value', 'click', 'lt', 300.0, 'sum', 21600, true, NULL, NULL, false, 3600),
  (5, 'newest value', 'event.value', NULL, 'gt', 20.0, 'last', 3600, true, NULL, NULL, false, 0),
  (6, 'event rate', 'event.total', NULL, 'gt', 0.004, 'avg', 86400, true, NULL, NULL, true, 0),
  (7, 'purchases rising', 'event.total', 'purchase', 'gt', 80.0, 'increase', 21600, true, NULL, NULL, false, 0),
  (8, 'total level', 'event.total', NULL, 'gt', 900.0, 'max', 21600, true, NULL, NULL, false, 3600),
  (9, 'switched off', 'event.value', NULL, 'gt', 0.0, 'max', 3600, false, NULL, NULL, false, 0))
"""
_AGG = """CASE agg WHEN 'max' THEN max(v) WHEN 'min' THEN min(v) WHEN 'sum' THEN sum(v) WHEN 'increase' THEN sum(v)
  WHEN 'last' THEN arg_max(v, us) ELSE avg(v) END"""


def _evaluation(name: str, ticks: str, upper: str) -> str:
    """Every (rule, tick) over its own look-back, differences taken inside that look-back."""
    return f"""
{name}_pts AS (
  SELECT r.*, t.tick, t.at_us, p.series_key, p.attrs_json, p.us, p.value,
         p.value - lag(p.value) OVER w AS dv, p.us - lag(p.us) OVER w AS du
  FROM rules r JOIN {ticks} t ON r.enabled
  JOIN points p ON p.name = r.metric AND p.us >= t.at_us - r.window_s * 1000000::BIGINT AND {upper}
   AND (r.svc IS NULL OR p.service = r.svc) AND (r.match_type IS NULL OR p.type = r.match_type)
   AND (r.exclude_type IS NULL OR p.type <> r.exclude_type)
  WINDOW w AS (PARTITION BY r.rule_id, t.tick, p.series_key ORDER BY p.us, p.value)),
{name}_v AS (
  SELECT * FROM (
    SELECT *, CASE WHEN agg = 'increase' THEN greatest(coalesce(dv, 0), 0)
                   WHEN rated THEN CASE WHEN du IS NULL THEN NULL WHEN du > 0 AND dv >= 0 THEN dv / (du / 1e6)
                                        ELSE 0 END
                   ELSE value END AS v FROM {name}_pts)
  WHERE v IS NOT NULL)
"""


TICKS = (
    f"""
grid AS (
  SELECT i AS tick, {EPOCH_US} + i * {HOUR_US} AS at_us
  FROM range(0, CAST((SELECT (now_us - {EPOCH_US}) // {HOUR_US} FROM ev_now) AS BIGINT) + 1) g(i)),
"""
    + _evaluation("tk", "grid", "p.us <= t.at_us")
    + f""",
tick_values AS (
  SELECT rule_id, cmp, threshold, dwell, tick, at_us, {_AGG} AS value
  FROM tk_v GROUP BY rule_id, agg, cmp, threshold, dwell, tick, at_us),
hits AS (
  SELECT *, tick - row_number() OVER (PARTITION BY rule_id ORDER BY tick) AS run FROM tick_values
  WHERE (cmp = 'gt' AND value > threshold) OR (cmp = 'lt' AND value < threshold)),
aged AS (SELECT *, min(tick) OVER (PARTITION BY rule_id, run) AS first_tick FROM hits),
runs AS (
  SELECT rule_id, min(at_us) AS fired, max(at_us) AS last_hit, arg_min(value, tick) AS first_value,
         min(at_us) FILTER (WHERE (tick - first_tick) * 3600 >= dwell) AS active,
         arg_min(value, tick) FILTER (WHERE (tick - first_tick) * 3600 >= dwell) AS active_value
  FROM aged GROUP BY rule_id, run),
alert_events AS (
  SELECT rule_id, coalesce(active_value, first_value) AS value, fired, active,
         CASE WHEN last_hit < (SELECT max(at_us) FROM grid) THEN last_hit + {HOUR_US} END AS resolved
  FROM runs WHERE active IS NOT NULL OR last_hit = (SELECT max(at_us) FROM grid))
"""
)

NOW_EVAL = (
    """
single AS (SELECT 0 AS tick, now_us AS at_us FROM ev_now),
"""
    + _evaluation("nw", "single", "true")
    + f""",
series_values AS (
  SELECT rule_id, cmp, series_key, attrs_json, {_AGG} AS series_value
  FROM nw_v GROUP BY rule_id, agg, cmp, series_key, attrs_json),
rule_values AS (SELECT rule_id, {_AGG} AS value FROM nw_v GROUP BY rule_id, agg),
culprit AS (
  SELECT rule_id, attrs_json FROM (
    SELECT *, row_number() OVER (PARTITION BY rule_id
      ORDER BY CASE WHEN cmp = 'lt' THEN series_value ELSE -series_value END, series_key) AS rk FROM series_values)
  WHERE rk = 1),
evaluated AS (
  SELECT r.*, v.value, c.attrs_json AS culprit,
         coalesce((cmp = 'gt' AND value > threshold) OR (cmp = 'lt' AND value < threshold), false) AS breached
  FROM rules r LEFT JOIN rule_values v USING (rule_id) LEFT JOIN culprit c USING (rule_id) WHERE r.enabled),
open_events AS (SELECT * FROM alert_events WHERE resolved IS NULL),
stepped AS (
  SELECT e.*, o.value AS event_value, o.fired, o.active, n.now_us,
    CASE WHEN e.breached AND o.fired IS NULL AND e.dwell = 0 THEN 'fire'
         WHEN e.breached AND o.fired IS NULL THEN 'pend'
         WHEN e.breached AND o.active IS NULL AND n.now_us - o.fired >= e.dwell * 1000000::BIGINT THEN 'activate'
         WHEN e.breached THEN 'keep'
         WHEN o.active IS NOT NULL THEN 'resolve'
         WHEN o.fired IS NOT NULL THEN 'drop' ELSE 'none' END AS action
  FROM evaluated e LEFT JOIN open_events o USING (rule_id), ev_now n)
"""
)
META = "CASE metric WHEN 'event.value' THEN 'gauge' ELSE 'sum' END AS kind, CASE metric WHEN 'event.value' THEN 'ms' ELSE '1' END AS unit"
ALERTS = _with(METRICS, RULES, TICKS)

STORED = """
stored AS (SELECT s_suppkey AS rule_id, 'balance-' || (s_suppkey * 20) AS name, s_acctbal AS threshold,
                  TIMESTAMP '2024-01-01' AS created_at FROM supplier),
declared AS (SELECT 'balance-' || c_custkey AS name, c_mktsegment AS service, c_acctbal AS threshold FROM customer)
"""

_ROLL_COLUMNS = """make_timestamp(b) AS bucket, name, series_key, attrs_json, service, kind, unit, is_monotonic,
  cnt AS "count", round(total, 9) AS sum, round(lo, 9) AS min, round(hi, 9) AS max, round(total / cnt, 9) AS avg"""
_ROLL_ARRAYS = f""", CASE WHEN kind = 'histogram' THEN {_TEXT_BOUNDS} END AS bucket_bounds,
  array_to_string(counts, ',') AS bucket_counts"""

_RETENTION = (
    _with(SPANS, LOGS, METRICS, _rollup("rolls", 300_000_000))
    + f"""SELECT 'spans' AS table_name, count(*) AS kept FROM spans, ev_now WHERE start_us >= now_us - 23 * 24 * {HOUR_US}
UNION ALL SELECT 'logs', count(*) FROM logs
UNION ALL SELECT 'metrics', count(*) FROM points, ev_now WHERE us >= now_us - 6 * {HOUR_US}
UNION ALL SELECT 'metric_series_rollups', count(*) FROM rolls, ev_now WHERE b >= now_us - 7 * 24 * {HOUR_US}"""
)

ORACLES: dict[str, str] = {
    "red_by_service": _with(SPANS)
    + """SELECT service, count(*) AS spans, count(*) FILTER (WHERE status_code = 2) AS errors,
round(count(*) FILTER (WHERE status_code = 2) / count(*)::DOUBLE, 9) AS error_rate,
round(quantile_cont(duration_ms, 0.5), 9) AS p50_ms, round(quantile_cont(duration_ms, 0.95), 9) AS p95_ms,
round(quantile_cont(duration_ms, 0.99), 9) AS p99_ms
FROM seen WHERE service IS NOT NULL GROUP BY service""",
    "trace_summary": _summary(),
    "trace_summary_errors": _summary(having="error_count > 0"),
    "trace_summary_slow": _summary(having="e - s >= 120000"),
    "trace_summary_attr": _summary(trace_filter="trace_id IN (SELECT trace_id FROM spans WHERE method = 'POST')"),
    "trace_summary_name": _summary(having="root_name ILIKE '%cart%'"),
    "trace_summary_service": _summary(span_filter="service = 'orders-api'"),
    "trace_search": _summary() + " ORDER BY start_time DESC, trace_id LIMIT 100",
    "trace_spans": _with(SPANS)
    + """SELECT trace_id, span_id, parent_span_id, service, name, kind, make_timestamp(start_us) AS start_time,
make_timestamp(end_us) AS end_time, round(duration_ms, 9) AS duration_ms, status_code, attrs_json, ingested_at
FROM spans WHERE trace_id = (SELECT trace_id FROM arriving ORDER BY start_us DESC, trace_id DESC LIMIT 1)""",
    "span_dedupe": _with(SPANS)
    + """SELECT trace_id, span_id, parent_span_id, service, name, kind, make_timestamp(start_us) AS start_time,
make_timestamp(end_us) AS end_time, round(duration_ms, 9) AS duration_ms, status_code, attrs_json, ingested_at
FROM spans""",
    "service_nodes": _with(SPANS)
    + f"""SELECT DISTINCT service FROM spans, span_now
WHERE service IS NOT NULL AND start_us > {EPOCH_US}""",
    "service_list": _with(SPANS) + "SELECT DISTINCT service FROM seen WHERE service IS NOT NULL",
    "service_edges": _with(SPANS)
    + f"""SELECT p.service AS source, c.service AS target, count(*) AS calls
FROM spans c JOIN spans p ON c.parent_span_id = p.span_id AND c.trace_id = p.trace_id, span_now
WHERE c.start_us > {EPOCH_US} AND p.service <> c.service GROUP BY 1, 2""",
    "span_labels": _with(SPANS)
    + """SELECT coalesce(['unspecified', 'internal', 'server', 'client', 'producer', 'consumer'][kind + 1],
CAST(kind AS VARCHAR)) AS kind,
CASE status_code WHEN 2 THEN 'error' WHEN 1 THEN 'ok' ELSE 'unset' END AS status, count(*) AS spans
FROM spans GROUP BY 1, 2""",
    "trace_links": _with(SPANS, TREE) + "SELECT trace_id, span_id, parent FROM tree",
    "trace_tree_order": _with(SPANS, TREE)
    + "SELECT trace_id, span_id, CAST(depth AS BIGINT) AS depth, position FROM ordered",
    "trace_critical_path": _with(SPANS, TREE)
    + """SELECT t.trace_id, bool_or(t.end_us < t.start_us) AS skewed, count(p.span_id) AS path_spans,
round(sum(CASE WHEN t.parent IS NULL THEN r.subtree_end - t.start_us ELSE 0 END) / 1000.0::DOUBLE, 9) AS critical_ms
FROM walk t JOIN reach r USING (trace_id, span_id) LEFT JOIN route p USING (trace_id, span_id) GROUP BY 1""",
    "trace_error_spans": _with(SPANS, TREE)
    + """SELECT trace_id, span_id, name, service, CAST(depth AS BIGINT) AS depth, position
FROM ordered JOIN (SELECT trace_id, span_id, name, service FROM spans WHERE status_code = 2) USING (trace_id, span_id)""",
    "trace_ancestors": _with(
        SPANS,
        TREE,
        """up AS (
  SELECT trace_id, span_id, parent, true AS matched FROM tree WHERE name ILIKE '%checkout%' AND status_code = 2
  UNION ALL
  SELECT t.trace_id, t.span_id, t.parent, false FROM up u JOIN tree t
    ON t.trace_id = u.trace_id AND t.span_id = u.parent)""",
    )
    + "SELECT trace_id, span_id, bool_or(matched) AS matched FROM up GROUP BY 1, 2",
    "trace_geometry": _with(SPANS)
    + """SELECT s.trace_id, s.span_id, round((start_us - t0) / total::DOUBLE * 100, 9) AS left_pct,
round(greatest((end_us - start_us) / total::DOUBLE * 100, 0.4::DOUBLE), 9) AS width_pct,
round(total / 1000.0::DOUBLE, 9) AS trace_ms
FROM spans s JOIN (SELECT trace_id, min(start_us) AS t0, greatest(max(end_us) - min(start_us), 1) AS total
                   FROM spans GROUP BY 1) w USING (trace_id)""",
    "log_search": _with(LOGS)
    + """SELECT make_timestamp(us) AS time, trace_id, span_id, service, severity_number, body, attrs_json
FROM logs WHERE body ILIKE '%tion_%'
ORDER BY us DESC, trace_id NULLS FIRST, span_id NULLS FIRST, body LIMIT 200""",
    "log_text_filter": _with(LOGS)
    + """SELECT make_timestamp(us) AS time, service, severity_number, body, attrs_json
FROM logs WHERE body ILIKE '%the%'""",
    "log_attr_filter": _with(LOGS)
    + "SELECT make_timestamp(us) AS time, trace_id, span_id, body FROM logs WHERE chat AND service = 'assistant'",
    "log_severity": _with(LOGS)
    + """SELECT service, CASE WHEN severity_number >= 17 THEN 'error' WHEN severity_number >= 13 THEN 'warn'
WHEN severity_number >= 9 THEN 'info' ELSE 'debug' END AS severity, count(*) AS records FROM logs GROUP BY 1, 2""",
    "log_span_correlation": _with(SPANS, LOGS)
    + """SELECT s.trace_id, s.span_id, s.name, s.service, count(*) AS logs,
count(*) FILTER (WHERE severity_number >= 17) AS errors
FROM spans s JOIN logs l ON l.trace_id = s.trace_id AND l.span_id = s.span_id GROUP BY 1, 2, 3, 4""",
    "log_rows_of_spans": _with(SPANS, LOGS)
    + """SELECT make_timestamp(us) AS time, l.trace_id, l.span_id, body, s.name AS span_name, s.service AS span_service
FROM spans s JOIN logs l ON l.trace_id = s.trace_id AND l.span_id = s.span_id""",
    "metric_rollup_numbers": _with(METRICS, _rollup("r", 300_000_000, "kind <> 'histogram'"))
    + f"SELECT {_ROLL_COLUMNS} FROM r",
    "metric_rollup_hist": _with(METRICS, _rollup("r", 86_400_000_000, "kind = 'histogram'"))
    + f"SELECT {_ROLL_COLUMNS}{_ROLL_ARRAYS} FROM r",
    "rollup_merge": _with(METRICS, _rollup("r", 86_400_000_000)) + f"SELECT {_ROLL_COLUMNS}{_ROLL_ARRAYS} FROM r",
    "metric_series": _with(METRICS, WIDE)
    + "SELECT name, make_timestamp(t_us) AS t, round(sum(total) / sum(cnt), 9) AS v FROM wide GROUP BY 1, 2",
    "metric_series_service": _with(METRICS, WIDE)
    + """SELECT name, make_timestamp(t_us) AS t, round(sum(total) / sum(cnt), 9) AS v FROM wide
WHERE name = 'event.value' AND service = 'click' GROUP BY 1, 2""",
    "metric_grouped": _with(METRICS)
    + f"""SELECT name, k AS label, make_timestamp(us - us % 300000000) AS t, round(avg(value), 9) AS v
FROM points, ev_now WHERE name = 'event.value' GROUP BY 1, 2, 3""",
    "metric_dims": _with(METRICS)
    + f"""SELECT DISTINCT name, unnest(CASE WHEN name = 'event.value' THEN ['k', 'type'] ELSE ['type'] END) AS key
FROM points""",
    "metric_exemplars": _with(METRICS)
    + f"""SELECT name, make_timestamp(us) AS t, round(value, 9) AS v, ex_trace AS trace_id, '1' AS span_id
FROM points, ev_now WHERE ex_trace IS NOT NULL""",
    "exemplar_spans": _with(METRICS, SPANS)
    + f"""SELECT e.trace_id, e.span_id, e.name, e.t, e.v, s.name AS span_name, s.duration_ms, s.status_code
FROM (SELECT name, make_timestamp(us) AS t, round(value, 9) AS v, ex_trace AS trace_id, '1' AS span_id
      FROM points, ev_now WHERE ex_trace IS NOT NULL) e
LEFT JOIN spans s ON s.trace_id = e.trace_id AND s.span_id = e.span_id""",
    "metric_meta": _with(METRICS)
    + """SELECT name, arg_max(kind, us) AS kind, bool_or(is_monotonic) AS is_monotonic, arg_max(unit, us) AS unit
FROM points GROUP BY name""",
    "metric_facts_stream": _with(METRICS)
    + """SELECT name, arg_max(kind, us) AS kind, bool_or(is_monotonic) AS is_monotonic, arg_max(unit, us) AS unit,
coalesce(arg_max(kind = 'sum' AND coalesce(is_monotonic, false), us), false) AS counter,
make_timestamp(max(us)) AS last_time, make_timestamp(max(us)) AS last_valued
FROM points GROUP BY name""",
    "sql_functions": _with(METRICS)
    + """SELECT make_timestamp(us - us % 86400000000) AS day, series_key, min(counts[1] + 1) AS least_first,
count(*) AS hours FROM points WHERE name = 'event.size' GROUP BY 1, 2""",
    "spans_in_window": _with(SPANS, METRICS)
    + f"""SELECT service, count(*) AS spans, make_timestamp(max(end_us)) AS last_end FROM spans, ev_now
WHERE start_us BETWEEN {EPOCH_US} AND now_us GROUP BY 1""",
    "metric_facet_gauge": _lines("name = 'event.value'"),
    "metric_facet_rate": _lines("name = 'event.total'"),
    "metric_facet_chart": _lines("name = 'event.value' AND series_rank <= 12"),
    "metric_facet_summary": _with(METRICS, WIDE, FACET)
    + """SELECT name, CASE name WHEN 'event.value' THEN 'gauge' WHEN 'event.total' THEN 'sum' ELSE 'histogram' END AS kind,
name = 'event.total' AS rated, CASE name WHEN 'event.value' THEN 'ms' WHEN 'event.total' THEN '1' ELSE 'By' END AS unit,
count(*) AS series_total, greatest(count(*) - 12, 0) AS truncated FROM sizes GROUP BY name""",
    "metric_latest": _with(METRICS, WIDE, FACET)
    + """SELECT name, attrs_json, round(arg_max(v, t_us) FILTER (WHERE v IS NOT NULL), 9) AS v
FROM lines GROUP BY 1, 2""",
    "series_labels": _with(METRICS)
    + """SELECT DISTINCT name, attrs_json,
CASE WHEN name = 'event.value' THEN 'k=' || k || ' · type=' || type ELSE 'type=' || type END AS label FROM points""",
    "metric_histogram": _with(METRICS, WIDE, HIST)
    + f"""SELECT name, make_timestamp(t_us) AS t, 'By' AS unit, {_TEXT_BOUNDS} AS bucket_bounds,
array_to_string(counts, ',') AS bucket_counts, p50, p95, p99 FROM quants""",
    "hist_heatmap": _with(METRICS, WIDE, HIST)
    + """SELECT name, make_timestamp(t_us) AS t, CAST(i - 1 AS INTEGER) AS row, n,
round(CASE WHEN n > 0 THEN ln(n + 1) / ln(greatest(max(n) OVER (), 1) + 1) ELSE 0 END, 9) AS intensity
FROM (SELECT name, t_us, unnest(counts) AS n, generate_subscripts(counts, 1) AS i FROM dist)""",
    "hist_percentile_lines": _with(METRICS, WIDE, HIST)
    + """SELECT name, make_timestamp(t_us) AS t, label, v FROM (
SELECT name, t_us, 'p50' AS label, p50 AS v FROM quants UNION ALL SELECT name, t_us, 'p95', p95 FROM quants
UNION ALL SELECT name, t_us, 'p99', p99 FROM quants)""",
    "metric_hist_facet": _with(METRICS, WIDE, HIST_SERIES)
    + f"""SELECT d.name, d.attrs_json, CAST(s.series_rank AS INTEGER) AS series_rank, make_timestamp(t_us) AS t, {QUANTILES}
FROM sdist d JOIN (SELECT attrs_json, row_number() OVER (ORDER BY count(*) DESC, attrs_json) AS series_rank
                   FROM sdist GROUP BY attrs_json) s USING (attrs_json)""",
    "metric_hist_dist": _with(METRICS, WIDE, HIST_SERIES)
    + """SELECT name, attrs_json, count(*) AS n_points, array_to_string(arg_max(counts, t_us), ',') AS dist
FROM sdist GROUP BY 1, 2""",
    "metric_catalog": _with(
        METRICS,
        """ranked AS (
  SELECT *, row_number() OVER (PARTITION BY name ORDER BY us DESC, series_key, value) AS rk FROM points)""",
    )
    + """SELECT name, arg_min(service, rk) AS service, arg_min(kind, rk) AS kind, arg_min(unit, rk) AS unit,
make_timestamp(max(us)) AS last_time, round(arg_min(value, rk), 9) AS last_value,
string_agg(CAST(round(value, 9) AS VARCHAR), ',' ORDER BY rk) AS spark,
string_agg(CAST(CAST(cnt AS DOUBLE) AS VARCHAR), ',' ORDER BY rk) AS count_spark,
array_to_string(arg_min(counts, rk), ',') AS dist,
(SELECT count(DISTINCT attrs_json) FROM points p WHERE p.name = ranked.name) AS series_count
FROM ranked WHERE rk <= 30 GROUP BY name""",
    "catalog_counter_glyph": _with(
        METRICS,
        """ranked AS (
  SELECT *, row_number() OVER (PARTITION BY name ORDER BY us DESC, series_key, value) AS rk FROM points),
steps AS (
  SELECT name, rk, value - lead(value) OVER (PARTITION BY name ORDER BY rk) AS step FROM ranked WHERE rk <= 30)""",
    )
    + """SELECT name, string_agg(CAST(round(greatest(step, 0), 9) AS VARCHAR), ',' ORDER BY rk DESC) AS steps
FROM steps WHERE step IS NOT NULL GROUP BY name""",
    "alert_eval": _with(METRICS, RULES, TICKS, NOW_EVAL)
    + """SELECT CAST(rule_id AS BIGINT) AS rule_id, round(value, 9) AS value, breached,
CASE WHEN breached THEN culprit END AS attributes FROM evaluated""",
    "alert_series": _with(METRICS, RULES, TICKS, NOW_EVAL)
    + """SELECT CAST(rule_id AS BIGINT) AS rule_id, series_key, attrs_json, round(series_value, 9) AS series_value
FROM series_values""",
    "alert_ticks": ALERTS
    + """SELECT CAST(rule_id AS BIGINT) AS rule_id, tick, make_timestamp(at_us) AS at, round(value, 9) AS value
FROM tick_values""",
    "alert_backtest": ALERTS
    + """SELECT CAST(rule_id AS BIGINT) AS rule_id, round(value, 9) AS value, make_timestamp(fired) AS fired_at,
make_timestamp(active) AS active_at, make_timestamp(resolved) AS resolved_at FROM alert_events""",
    "alert_list": ALERTS
    + f"""SELECT CAST(rule_id AS BIGINT) AS rule_id, rule AS name, metric, svc AS service, cmp AS comparator,
round(threshold, 9) AS threshold, agg, window_s AS window_secs, enabled,
make_timestamp({EPOCH_US} + rule_id * 1000000) AS created_at,
rule_id IN (SELECT rule_id FROM alert_events WHERE resolved IS NULL AND active IS NOT NULL) AS firing, {META}
FROM rules""",
    "alert_events_feed": ALERTS
    + f"""SELECT CAST(rule_id AS BIGINT) AS rule_id, rule AS rule_name, metric, round(value, 9) AS value,
make_timestamp(fired) AS fired_at, make_timestamp(resolved) AS resolved_at, {META}
FROM alert_events JOIN rules USING (rule_id) WHERE active IS NOT NULL """,
    "alert_history": ALERTS
    + f"""SELECT CAST(rule_id AS BIGINT) AS rule_id,
count(*) FILTER (WHERE fired >= now_us - 7 * 24 * {HOUR_US}) AS recent_fires,
make_timestamp(min(fired) FILTER (WHERE resolved IS NULL)) AS open_since
FROM alert_events, ev_now WHERE active IS NOT NULL GROUP BY 1""",
    "alert_firing_count": ALERTS
    + """SELECT count(DISTINCT rule_id) AS firing FROM alert_events JOIN rules USING (rule_id)
WHERE resolved IS NULL AND active IS NOT NULL AND enabled""",
    "alert_step_events": _with(METRICS, RULES, TICKS, NOW_EVAL)
    + """SELECT CAST(rule_id AS BIGINT) AS rule_id,
round(CASE WHEN action IN ('fire', 'pend', 'activate') THEN value ELSE event_value END, 9) AS value,
make_timestamp(coalesce(fired, now_us)) AS fired_at,
make_timestamp(CASE WHEN action IN ('fire', 'activate') THEN now_us ELSE active END) AS active_at,
make_timestamp(CASE WHEN action = 'resolve' THEN now_us END) AS resolved_at
FROM stepped WHERE action IN ('fire', 'pend', 'activate', 'keep', 'resolve')""",
    "alert_step_transitions": _with(METRICS, RULES, TICKS, NOW_EVAL)
    + """SELECT CAST(rule_id AS BIGINT) AS rule_id, rule, metric, svc AS service,
CASE WHEN action = 'resolve' THEN 'resolved' ELSE 'firing' END AS state, round(value, 9) AS value,
round(threshold, 9) AS threshold, cmp AS comparator, CASE WHEN action <> 'resolve' THEN culprit END AS attributes
FROM stepped WHERE action IN ('fire', 'activate', 'resolve')""",
    "rules_reconcile": _with(STORED)
    + """SELECT coalesce(s.rule_id, (SELECT max(rule_id) FROM stored)
  + row_number() OVER (PARTITION BY s.rule_id IS NULL ORDER BY md5(d.name), d.name)) AS rule_id, d.name, d.service,
round(d.threshold, 9) AS threshold, coalesce(s.created_at, TIMESTAMP '2024-01-02') AS created_at
FROM declared d LEFT JOIN stored s USING (name)""",
    "rules_removed": _with(STORED)
    + """SELECT name, rule_id, round(threshold, 9) AS threshold, created_at FROM stored
WHERE name NOT IN (SELECT name FROM declared)""",
    "span_ingest_stream": _with(SPANS)
    + "SELECT trace_id, count(*) AS spans, count(DISTINCT span_id) AS distinct_spans FROM spans GROUP BY 1",
    "log_ingest_stream": _with(LOGS)
    + """SELECT service, severity_number, count(*) AS records, make_timestamp(min(us)) AS oldest,
make_timestamp(max(us)) AS newest FROM logs GROUP BY 1, 2""",
    "metric_ingest_stream": _with(METRICS, _rollup("r", 86_400_000_000))
    + f"SELECT {_ROLL_COLUMNS}{_ROLL_ARRAYS} FROM r",
    "retention_sweep": _RETENTION,
    "retention_prune": _RETENTION,
    "table_health": _with(SPANS, LOGS, METRICS, _rollup("rolls", 300_000_000))
    + """SELECT 'table.rows' AS name, 'spans' AS "table", count(*)::DOUBLE AS value FROM spans
UNION ALL SELECT 'table.rows', 'logs', count(*)::DOUBLE FROM logs
UNION ALL SELECT 'table.rows', 'metrics', count(*)::DOUBLE FROM points
UNION ALL SELECT 'table.rows', 'metric_series_rollups', count(*)::DOUBLE FROM rolls
UNION ALL SELECT 'retention.oldest_raw_metric_age_seconds', 'metrics',
  round((any_value(now_us) - min(us)) / 1e6, 9) FROM points, ev_now
UNION ALL SELECT 'rollup.lag_seconds', 'metric_series_rollups',
  round((any_value(now_us) - max(b)) / 1e6, 9) FROM rolls, ev_now""",
    "otlp_metrics": _with(METRICS)
    + """SELECT make_timestamp(us) AS time, service, name, kind, round(value, 9) AS value, unit, exemplar_trace_id,
attrs_json, md5(service || '|' || attrs_json) AS series_key FROM (
SELECT us, event_type AS service, 'event.value' AS name, 'gauge' AS kind, value, 'ms' AS unit,
lower(lpad(printf('%x', event_id), 32, '0')) AS exemplar_trace_id,
'{"k": ' || k || ', "user": "' || user_id || '", "service.name": "' || event_type || '"}' AS attrs_json FROM ev)""",
    "otlp_traces": _with(SPANS)
    + """SELECT lower(lpad(printf('%x', CAST(trace_id AS BIGINT)), 32, '0')) AS trace_id, lpad(span_id, 16, '0') AS span_id,
parent_span_id, coalesce(service, 'fallback') AS service, name, kind, make_timestamp(start_us) AS start_time,
make_timestamp(start_us + dur_us) AS end_time, round(dur_us / 1000.0::DOUBLE, 9) AS duration_ms, status_code,
'{"part": ' || part || ', "k8s.deployment.name": "' || coalesce(service, '') || '"}' AS attrs_json FROM arriving""",
    "otlp_logs": _with(LOGS)
    + """SELECT make_timestamp(us) AS time, trace_id, service, severity_number, body,
'{"service.name": "' || service || '"}' AS attrs_json FROM logs""",
}

ORACLES["span_copies_stream"] = ORACLES["span_ingest_stream"]

ORACLES["otlp_nested"] = f"""
WITH docs AS (
  SELECT doc_id, coalesce(n_chars, 0) AS n, coalesce(lang, '') AS lang,
         '[' || n_chars + 1 || CASE WHEN doc_id % 3 > 0 THEN ', ' || n_chars + 2 ELSE '' END
             || CASE WHEN doc_id % 3 > 1 THEN ', ' || n_chars + 3 ELSE '' END || ']' AS listed
  FROM documents)
SELECT make_timestamp({EPOCH_US} + doc_id * 1000000) AS time, 'none' AS service, CAST(n AS VARCHAR) AS body,
       '{{"raw": "' || lower(hex(encode(CAST(n AS VARCHAR)))) || '", '
       || CASE WHEN doc_id % 2 = 0 THEN '"deep": {{"lang": "' || lang || '", "tags": ' || listed || '}}, ' ELSE '' END
       || '"even": ' || CASE WHEN doc_id % 2 = 0 THEN 'true' ELSE 'false' END
       || ', "half": ' || CAST(n / 2 + 0.25::DOUBLE AS VARCHAR)
       || CASE WHEN doc_id % 2 = 0 THEN ', "list": ' || listed ELSE '' END || '}}' AS attrs_json,
       2 * count(*) AS records
FROM docs GROUP BY ALL"""

ORACLES["otlp_metrics_all"] = (
    _with(METRICS)
    + f"""SELECT make_timestamp(us) AS time, service, 'seen' AS name, 'sum' AS kind, CAST(cnt AS DOUBLE) AS value,
CAST(NULL AS BIGINT) AS count, '1' AS unit, true AS is_monotonic, CAST(NULL AS VARCHAR) AS bucket_bounds,
CAST(NULL AS VARCHAR) AS bucket_counts, '{{"type": "' || type || '", "service.name": "' || service || '"}}' AS attrs_json
FROM points WHERE name = 'event.size'
UNION ALL
SELECT make_timestamp(us), service, 'sizes', 'histogram', round(value, 9), cnt, '1', NULL, {_TEXT_BOUNDS},
array_to_string(counts, ','), '{{"type": "' || type || '", "service.name": "' || service || '"}}'
FROM points WHERE name = 'event.size'"""
)

ORACLES["otlp_rejects"] = """
SELECT reason, missing, count(*) AS records
FROM (SELECT CASE WHEN l_partkey % 11 = 0 THEN 'decode' WHEN l_tax >= 0.06 THEN 'insert' ELSE 'stored' END AS reason,
             CASE WHEN l_partkey % 11 <> 0 AND l_tax >= 0.06 THEN 'name' ELSE '' END AS missing
      FROM lineitem)
GROUP BY ALL"""

ORACLES["otlp_sniffed"] = (
    _with(LOGS)
    + """SELECT service, severity_number, count(*) AS records, CAST(sum(length(body)) AS BIGINT) AS chars,
make_timestamp(max(us)) AS newest FROM logs GROUP BY 1, 2"""
)

ORACLES["rule_problems"] = """
SELECT * FROM (
  SELECT c_name AS name,
         CASE WHEN c_custkey % 5 = 0 THEN 'name and metric are required'
              WHEN c_custkey % 7 = 0 THEN 'comparator must be gt or lt'
              WHEN c_custkey % 11 = 0 THEN 'threshold is required'
              WHEN c_custkey % 13 = 0 THEN 'unknown aggregate'
              WHEN c_custkey % 17 = 0 THEN 'window_secs must be at least 1'
              WHEN c_custkey % 19 = 0 THEN 'for_secs must be at least 1' END AS problem
  FROM customer) WHERE problem IS NOT NULL"""

ORACLES["rules_normal"] = """
SELECT c_name AS name, CASE WHEN c_custkey % 2 <> 0 THEN c_mktsegment END AS service, round(c_acctbal, 9) AS threshold,
       CASE WHEN c_custkey % 3 = 0 THEN 'max' ELSE 'avg' END AS agg,
       CASE WHEN c_custkey % 4 = 0 THEN 60 ELSE 300 END AS window_secs, c_custkey % 5 <> 0 AS enabled,
       CASE WHEN c_custkey % 2 = 0 THEN '"' || c_mktsegment || '"' END AS segment,
       CASE WHEN c_custkey % 2 = 0 THEN CAST(c_custkey AS VARCHAR) END AS n, c_custkey % 2 = 0 AS has_match
FROM customer"""

ORACLES["rule_names"] = """
SELECT max(s_suppkey) AS rule_id, 'r' || s_suppkey % 7 AS name, round(arg_max(s_acctbal, s_suppkey), 9) AS threshold
FROM supplier GROUP BY s_suppkey % 7"""

ORACLES["alert_urgency"] = f"SELECT rule_id, name, firing FROM ({ORACLES['alert_list']})"

ORACLES["alert_notifications"] = f"""
SELECT rule_id, rule, metric, service, state, comparator, value, threshold, attributes IS NOT NULL AS has_attributes
FROM ({ORACLES["alert_step_transitions"]})"""

ORACLES["results_json"] = ORACLES["service_edges"]

ORACLES["sweep_stall"] = f"""
WITH sweeps AS (
  SELECT o_orderdate AS done, bool_or(o_orderstatus <> 'F') AS fine, max(o_orderkey) AS n FROM orders GROUP BY 1),
newest AS (SELECT max(done) AS last_success, arg_max(n, done) AS last_rows FROM sweeps WHERE fine)
SELECT last_success, last_rows, {EPOCH_US} // 1000000 - epoch_us(last_success) // 1000000 AS age_secs,
       {EPOCH_US} // 1000000 - epoch_us(last_success) // 1000000 > 86400 AS stalled
FROM newest"""

_FINE_GRID = """
grid AS (
  SELECT i AS tick, (SELECT now_us FROM ev_now) - 172800000000 + i * 30000000 AS at_us FROM range(0, 5761) g(i)),
"""

ORACLES["alert_ticks_fine"] = (
    _with(METRICS, RULES, _FINE_GRID + _evaluation("tk", "grid", "p.us <= t.at_us"))
    + f"""SELECT CAST(rule_id AS BIGINT) AS rule_id, tick, make_timestamp(at_us) AS at, round({_AGG}, 9) AS value
FROM tk_v GROUP BY rule_id, agg, cmp, threshold, dwell, tick, at_us"""
)
