"""DuckDB SQL for the rows of each query."""

from __future__ import annotations

DAY_CAP = 43_200_000

_THREADS = """
threads AS (
  SELECT o.o_orderkey, CAST(o.o_orderkey AS VARCHAR) AS id, 'Order ' || o.o_orderkey AS title, o.o_orderdate AS created_at,
         o.o_orderdate + to_milliseconds((o.o_orderkey % 37) * 1800000) AS updated_at, 'C:\\' || r_name || '\\' || n_name AS workspace_path, n_name AS workspace_name,
         replace(replace(replace(to_base64(encode(lower('C:\\' || r_name || '\\' || n_name))), '=', ''), '+', '-'), '/', '_') AS workspace_id,
         'c:/' || r_name || '/' || n_name || '/' AS raw_path, c_mktsegment AS model_provider, o_orderpriority AS model, coalesce(u.t, 0) AS total_tokens, o_orderstatus = 'F' AS archived
  FROM orders o JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  LEFT JOIN (SELECT l_orderkey, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS t FROM lineitem GROUP BY 1) u ON u.l_orderkey = o.o_orderkey)"""

_LOGS = """
logs AS (
  SELECT CASE WHEN l_orderkey % 3 = 0 THEN 'gone-' ELSE '' END || l_orderkey AS log_id, CAST(sum(CAST(l_quantity AS BIGINT) * 10) AS BIGINT) AS input, CAST(sum(l_linenumber) AS BIGINT) AS output,
         CAST(sum(CASE WHEN l_returnflag = 'R' THEN CAST(l_quantity AS BIGINT) * 4 ELSE 0 END) AS BIGINT) AS cached
  FROM lineitem GROUP BY 1)"""

_SHIPPED = """
ship AS (SELECT l_orderkey, l_shipdate AS t, epoch_ms(l_shipdate) - lag(epoch_ms(l_shipdate)) OVER (PARTITION BY l_orderkey ORDER BY l_shipdate) AS gap FROM lineitem),
sessions AS (SELECT l_orderkey, min(t) AS a, max(t) AS b, coalesce(sum(least(greatest(gap, 0), 1800000)) FILTER (WHERE gap IS NOT NULL), 0) AS active FROM ship GROUP BY 1),
named AS (SELECT CASE WHEN l_orderkey % 5 < 2 THEN '' ELSE 'gone-' END || l_orderkey AS session_id, a, b, active FROM sessions)"""

_RUNS = f"""{_THREADS}, {_LOGS}, {_SHIPPED},
timed AS (SELECT t.*, coalesce(a, created_at) AS start_time, coalesce(b, updated_at) AS end_time, coalesce(active, 0) AS active FROM threads t LEFT JOIN named ON session_id = id),
runs AS (
  SELECT t.*, CAST(CASE WHEN active > 0 THEN active ELSE least(greatest(epoch_ms(end_time) - epoch_ms(start_time), 0), {DAY_CAP}) END AS BIGINT) AS duration_ms,
         CASE WHEN active > 0 THEN 'jsonl-events' ELSE 'thread-span' END AS duration_method,
         input, output, cached, CASE WHEN input IS NULL THEN 'Breakdown unavailable for this run.' END AS reason
  FROM timed t LEFT JOIN logs ON log_id = id)"""

_RATE = "CASE WHEN {i} > 0 THEN round(CAST(coalesce({c}, 0) AS DOUBLE) / {i}, 6) END"
_SUMS = f"""CAST(coalesce(sum(input), 0) AS BIGINT) AS input, CAST(coalesce(sum(output), 0) AS BIGINT) AS output, CAST(coalesce(sum(cached), 0) AS BIGINT) AS cached,
  CAST(0 AS BIGINT) AS reasoning, {_RATE.format(i="sum(input)", c="sum(cached)")} AS cache_hit_rate, max(reason) AS unavailable_reason"""


def _buckets(weekly: bool) -> str:
    key = "strftime(date_trunc('week', start_time), '%Y-%m-%d')" if weekly else "strftime(start_time, '%Y-%m-%d')"
    label = "'Week of ' || substr(k.key, 6)" if weekly else "substr(k.key, 6)"
    return f"""{_RUNS},
keyed AS (SELECT *, {key} AS key FROM runs),
tops AS (SELECT key, workspace_name, row_number() OVER (PARTITION BY key ORDER BY sum(total_tokens) + sum(duration_ms) DESC, workspace_name) AS n FROM keyed GROUP BY key, workspace_name),
buckets AS (
  SELECT k.key, {label} AS label, min(start_time) AS start, max(start_time) AS "end", count(*) AS runs, CAST(sum(total_tokens) AS BIGINT) AS tokens, CAST(sum(duration_ms) AS BIGINT) AS agent_time_ms,
         count(DISTINCT k.workspace_name) AS active_projects, max(t.workspace_name) AS top_workspace, {_SUMS}
  FROM keyed k JOIN tops t ON t.key = k.key AND t.n = 1 GROUP BY k.key)"""


def _tokens(x: str) -> str:
    def tenths(unit: int, letter: str) -> str:
        t = f"CAST(floor({x} / {unit}.0 * 10 + 0.5) AS BIGINT)"
        return f"({t} // 10) || '.' || ({t} % 10) || '{letter}'"

    return f"CASE WHEN {x} >= 1000000 THEN {tenths(1_000_000, 'M')} WHEN {x} >= 1000 THEN {tenths(1000, 'K')} ELSE format('{{:,}}', CAST(floor({x} + 0.5) AS BIGINT)) END"


def _duration(ms: str) -> str:
    m = f"CAST(floor({ms} / 60000.0 + 0.5) AS BIGINT)"
    return f"CASE WHEN {m} < 60 THEN ({m} % 60) || 'm' WHEN {m} % 60 = 0 THEN ({m} // 60) || 'h' ELSE ({m} // 60) || 'h ' || ({m} % 60) || 'm' END"


_MS = "(epoch_us(ts) // 1000)"
_ACTIVE = f"""gaps AS (SELECT user_id, ts, least(greatest({_MS} - lag({_MS}) OVER (PARTITION BY user_id ORDER BY ts), 0), 10800000) AS gap, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS before FROM events)"""
_SESSIONS = "s AS (SELECT CAST(user_id AS VARCHAR) AS id, 's' || (event_id % 700) AS stem, event_type = 'purchase' AS archived, event_id FROM events)"
_BODY_SUMS = "CAST(sum(input) AS BIGINT) AS input, CAST(sum(output) AS BIGINT) AS output, CAST(sum(cached) AS BIGINT) AS cached, CAST(sum(reasoning) AS BIGINT) AS reasoning, count(*) AS rows"
_PAGES = "p AS (SELECT page_id, 'C:\\' || regexp_replace(replace(regexp_replace(url, '^https?://', ''), '/', '\\'), '\\\\+$', '') AS path FROM pages)"
_NATION_3 = "workspace_path = 'C:\\EUROPE\\NATION_3'"


def _preset(name: str, where: str) -> str:
    return ", ".join(
        f"CAST(coalesce(sum(CASE WHEN {where} THEN {c} END), 0) AS BIGINT) AS {name}_{n}" for n, c in (("tokens", "CAST(floor(value) AS BIGINT)"), ("agent_time_ms", "CAST(floor(value * 1000) AS BIGINT)"), ("runs", "1"))
    )


def _profile() -> str:
    ends = {"orders": "o_orderdate", "lineitem": "l_shipdate", "events": "ts"}
    rows = []
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "pages", "documents", "embeddings", "benchmark", "labels", "conversations"):
        e = [f"strftime({f}({ends[t]}), '%Y-%m-%d %H:%M:%S')" if t in ends else "CAST(NULL AS VARCHAR)" for f in ("min", "max")]
        columns = f"(SELECT string_agg(column_name, ',') FROM (DESCRIBE {t}))"
        rows.append(f"SELECT '{t}' AS source, true AS found, count(*) AS rows, CAST((SELECT count(*) FROM (DESCRIBE {t})) AS INTEGER) AS n_columns, {columns} AS columns, {e[0]} AS earliest, {e[1]} AS latest FROM {t}")
    rows.append("SELECT 'threads', false, CAST(0 AS BIGINT), CAST(0 AS INTEGER), '', CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR)")
    return " UNION ALL ".join(rows)


_RANGE = f"""WITH {_RUNS}, r AS (SELECT * FROM runs WHERE start_time >= DATE '1996-02-20' AND start_time < DATE '1997-03-06'),
a AS (SELECT count(*) AS runs, CAST(sum(total_tokens) AS BIGINT) AS tokens, CAST(sum(duration_ms) AS BIGINT) AS agent_time_ms, count(DISTINCT CAST(start_time AS DATE)) AS active_days, {_SUMS} FROM r)
SELECT *, CAST(380 AS INTEGER) AS calendar_days, round(CAST(tokens AS DOUBLE) / runs, 4) AS tokens_per_run, round(tokens / 380.0, 4) AS tokens_per_day, round(CAST(agent_time_ms AS DOUBLE) / runs, 4) AS time_per_run_ms,
  round(CAST(agent_time_ms AS DOUBLE) / active_days, 4) AS time_per_active_day_ms, round(agent_time_ms / 380.0, 4) AS time_per_day_ms, round(runs / 380.0, 4) AS runs_per_day FROM a"""

_FILES = """lines AS (SELECT user_id % 40 AS b, event_id, user_id, event_type, value, ts, epoch_us(ts) // 1000 AS ms, event_id % 7 AS kind, CAST(floor(value) AS BIGINT) AS t_in, event_id % 90 AS t_out, event_id % 50 AS t_c, event_id % 100 AS l_in FROM events),
used AS (SELECT *, kind >= 3 AND l_in > 0 AND l_in > t_in + t_out AS by_last, kind >= 3 AND (t_in > 0 OR t_out > 0 OR t_c > 0) AS by_total FROM lines),
counts AS (SELECT *, CASE WHEN by_last THEN l_in WHEN by_total THEN t_in END AS input, CASE WHEN by_last THEN NULL WHEN by_total THEN t_out END AS output, CASE WHEN by_last THEN NULL WHEN by_total THEN t_c END AS cached, by_last OR by_total AS counted FROM used)"""
_CODES = "'parse_warning' AS code, 'warning' AS severity"
_BROKEN = f"""f AS (SELECT printf('s%02d', b) AS file, count(*) FILTER (WHERE kind = 1) AS n FROM lines GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY file) AS k FROM f WHERE n > 0)
SELECT {_CODES}, 'jsonl lines could not be parsed' AS message, CAST(n AS VARCHAR) AS args, file AS source FROM r WHERE k <= 20
UNION ALL SELECT {_CODES}, 'more files with warnings', CAST(count(*) - 20 AS VARCHAR), '' FROM r HAVING count(*) > 20
UNION ALL SELECT 'missing_source', 'warning', 'columns are missing', 'created_at,updated_at,cwd', 'threads'"""

_NUMBERS = """numbers AS (SELECT workspace_id, row_number() OVER (ORDER BY age, id, workspace_id) AS number FROM (
  SELECT workspace_id, -epoch_us(start_time) AS age, id, row_number() OVER (PARTITION BY workspace_id ORDER BY start_time DESC, id) AS n FROM runs) WHERE n = 1)"""

ORACLE_SQL = {
    "session_active_time": f"WITH {_ACTIVE} SELECT user_id, min(ts) AS start_time, max(ts) AS end_time, count(*) AS events, CAST(coalesce(sum(CASE WHEN before IS NOT NULL THEN gap END), 0) AS BIGINT) AS active_ms FROM gaps GROUP BY 1",
    "session_last_meta": "SELECT user_id, max_by(event_type, (ts, event_id)) FILTER (WHERE value > 50) AS model FROM events GROUP BY 1",
    "session_best_breakdown": "SELECT user_id, max_by(event_id, (CAST(floor(value) AS BIGINT), ts, event_id)) FILTER (WHERE event_type <> 'view') AS best_event FROM events GROUP BY 1",
    "session_dedup_by_id": f"WITH {_SESSIONS} SELECT id, event_id, archived FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY archived DESC, event_id) AS n FROM s) WHERE n = 1",
    "session_dedup_by_stem": f"WITH {_SESSIONS} SELECT stem, event_id, archived FROM (SELECT *, row_number() OVER (PARTITION BY stem ORDER BY archived DESC, event_id DESC) AS n FROM s) WHERE n = 1",
    "runs_two_key_lookup": f"WITH {_RUNS} SELECT id, start_time, end_time, duration_ms, duration_method, total_tokens FROM runs",
    "run_breakdown_coalesce": f"WITH {_RUNS} SELECT id, input, output, cached, CAST(NULL AS BIGINT) AS reasoning, {_RATE.format(i='input', c='cached')} AS cache_hit_rate, reason AS unavailable_reason FROM runs",
    "epoch_fallback": "SELECT event_id, make_timestamp(CASE WHEN event_id % 3 = 0 AND event_id > 0 THEN event_id * 1000003 * 1000 WHEN event_id % 3 < 2 AND event_id > 0 THEN event_id * 1000 * 1000000 ELSE 0 END) AS created_at FROM events",
    "schema_drift_defaults": """SELECT CAST(o_orderkey AS VARCHAR) AS id, 'Untitled run' AS title, CASE WHEN o_orderstatus <> 'O' THEN o_orderpriority ELSE 'unknown' END AS model, 'unknown' AS model_provider, '(unknown)' AS cwd,
  '(unknown)' AS workspace_path, 'Unknown workspace' AS workspace_name, 'KHVua25vd24p' AS workspace_id, CAST(0 AS BIGINT) AS tokens_used, false AS archived, TIMESTAMP '1970-01-01 00:00:00' AS created_at FROM orders""",
    "daily_usage": f"WITH {_buckets(False)} SELECT * FROM buckets",
    "weekly_usage": f"WITH {_buckets(True)} SELECT * FROM buckets",
    "preset_totals": f"""SELECT event_type AS workspace_id, {_preset("today", "ts >= DATE '2024-01-30' AND ts < DATE '2024-01-31'")}, {_preset("last7", "ts >= DATE '2024-01-24' AND ts < DATE '2024-01-31'")},
  {_preset("last30", "ts >= DATE '2024-01-01' AND ts < DATE '2024-01-31'")}, {_preset("last90", "ts >= DATE '2023-11-02' AND ts < DATE '2024-01-31'")}, {_preset("all", "true")} FROM events GROUP BY 1""",
    "range_summary_custom": _RANGE,
    "chart_points": f"""WITH {_RUNS}, r AS (SELECT strftime(start_time, '%Y-%m-%d') AS key, CAST(sum(total_tokens) AS BIGINT) AS tokens, sum(duration_ms) AS ms FROM runs GROUP BY 1),
d AS (SELECT strftime(DATE '1996-02-20' + CAST(i AS INTEGER), '%Y-%m-%d') AS key FROM range(380) t(i))
SELECT d.key AS key, coalesce(tokens, 0) AS tokens, coalesce(floor(ms / 36000.0 + 0.5) / 100, 0.0) AS hours FROM d LEFT JOIN r ON r.key = d.key""",
    "visible_runs": f"WITH {_RUNS} SELECT model, count(*) AS runs, CAST(sum(total_tokens) AS BIGINT) AS tokens FROM runs WHERE NOT starts_with(workspace_path, 'C:\\ASIA\\') GROUP BY 1",
    "top_workspaces": f"""WITH {_RUNS}, w AS (SELECT workspace_id, workspace_name, count(*) AS runs, CAST(sum(total_tokens) AS BIGINT) AS all_time_tokens, CAST(sum(duration_ms) AS BIGINT) AS all_time_agent_time_ms FROM runs GROUP BY 1, 2)
SELECT workspace_name, runs, all_time_tokens, all_time_agent_time_ms FROM w ORDER BY all_time_tokens + all_time_agent_time_ms DESC, workspace_id LIMIT 8""",
    "orphan_sessions": f"""WITH {_THREADS} SELECT CAST(l_orderkey AS VARCHAR) AS id, min(l_shipdate) AS start_time, max(l_shipdate) AS end_time FROM lineitem
WHERE l_orderkey NOT IN (SELECT o_orderkey FROM threads WHERE NOT archived) GROUP BY l_orderkey""",
    "peak_bucket_time": f"WITH {_buckets(False)} SELECT key, agent_time_ms FROM buckets ORDER BY agent_time_ms DESC, key LIMIT 1",
    "peak_bucket_tokens": f"WITH {_buckets(True)} SELECT key, tokens FROM buckets ORDER BY tokens DESC, key LIMIT 1",
    "longest_streak": """WITH d AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS day FROM events), i AS (SELECT user_id, day - CAST(row_number() OVER (PARTITION BY user_id ORDER BY day) AS INTEGER) AS island FROM d)
SELECT user_id, max(n) AS longest_streak_days FROM (SELECT user_id, island, count(*) AS n FROM i GROUP BY 1, 2) GROUP BY 1""",
    "all_time_bounds": f'WITH {_RUNS} SELECT min(least(start_time, end_time)) AS "first", max(greatest(start_time, end_time)) AS "last" FROM runs',
    "workspace_summary": f"""WITH {_RUNS} SELECT workspace_id, workspace_name, workspace_path, min(raw_path) AS raw_path, count(*) FILTER (WHERE NOT archived) AS runs, CAST(coalesce(sum(total_tokens) FILTER (WHERE NOT archived), 0) AS BIGINT) AS all_time_tokens,
  CAST(coalesce(sum(duration_ms) FILTER (WHERE NOT archived), 0) AS BIGINT) AS all_time_agent_time_ms, count(DISTINCT CAST(start_time AS DATE)) FILTER (WHERE NOT archived) AS active_days, max(start_time) FILTER (WHERE NOT archived) AS last_activity
FROM runs WHERE NOT starts_with(workspace_path, 'C:\\ASIA\\') GROUP BY 1, 2, 3""",
    "model_usage": f"WITH {_RUNS} SELECT workspace_name, model, CAST(sum(total_tokens) AS BIGINT) AS tokens, count(*) AS runs FROM runs GROUP BY 1, 2",
    "recent_runs": f"WITH {_RUNS} SELECT id, workspace_name, start_time, total_tokens FROM runs ORDER BY start_time DESC, id LIMIT 250",
    "recent_sessions": f"WITH {_RUNS} SELECT id, workspace_name, start_time, total_tokens FROM runs WHERE {_NATION_3} ORDER BY start_time DESC, id LIMIT 10",
    "cache_hit_rate": f"WITH {_RUNS} SELECT workspace_name, {_SUMS} FROM runs GROUP BY 1",
    "path_normalize": f"WITH {_PAGES} SELECT page_id, path FROM p",
    "workspace_id": f"WITH {_PAGES} SELECT page_id, replace(replace(replace(to_base64(encode(lower(path))), '=', ''), '+', '-'), '/', '_') AS workspace_id FROM p",
    "display_name": f"WITH {_PAGES} SELECT page_id, list_last(string_split(path, '\\')) AS name FROM p",
    "alias_rewrite": f"""WITH {_THREADS} SELECT CASE WHEN workspace_path = 'C:\\ASIA\\NATION_2' THEN 'E:\\east\\two' WHEN workspace_path = 'C:\\AMERICA\\NATION_1' THEN 'C:\\america\\nation_1' ELSE workspace_path END AS workspace_path,
  CASE WHEN workspace_path = 'C:\\ASIA\\NATION_2' THEN 'two' WHEN workspace_path = 'C:\\AMERICA\\NATION_1' THEN 'nation_1' ELSE workspace_name END AS workspace_name, count(*) AS threads FROM threads GROUP BY 1, 2""",
    "alias_table": f"""WITH {_THREADS} SELECT CASE WHEN regexp_full_match(workspace_path, 'C:.ASIA.NATION_[0-9]+') AND CAST(regexp_extract(workspace_path, '[0-9]+$') AS INTEGER) < 40 THEN 'E:\\last\\' || regexp_extract(workspace_path, '[0-9]+$') ELSE workspace_path END AS workspace_path, count(*) AS threads FROM threads GROUP BY 1""",
    "ignored_table": f"""WITH {_THREADS}, g AS (SELECT CASE WHEN r_regionkey % 2 = 0 THEN 'C:\\' || r_name ELSE 'C:\\AMERICA\\NATION_1' END AS p FROM region)
SELECT workspace_path, EXISTS (SELECT 1 FROM g WHERE lower(workspace_path) = lower(p) OR starts_with(lower(workspace_path), lower(p) || '\\')) AS hidden, count(*) AS threads FROM threads GROUP BY 1, 2""",
    "hidden_workspaces": f"""WITH {_THREADS} SELECT workspace_path, starts_with(workspace_path, 'C:\\AFRICA\\') OR starts_with(workspace_path, 'C:\\ASIA\\') OR workspace_path = 'C:\\AMERICA\\NATION_1' AS hidden, count(*) AS threads FROM threads GROUP BY 1, 2""",
    "anonymize_runs": f"""WITH {_RUNS}, {_NUMBERS} SELECT id, title, substr(sha256(r.workspace_id), 1, 16) AS workspace_id, 'Workspace ' || number AS workspace_name, 'Workspace ' || number AS workspace_path, CAST(NULL AS VARCHAR) AS rollout_path
FROM runs r JOIN numbers n ON n.workspace_id = r.workspace_id""",
    "anonymize_workspaces": f"""WITH {_RUNS}, {_NUMBERS} SELECT substr(sha256(r.workspace_id), 1, 16) AS workspace_id, 'Workspace ' || number AS workspace_name, 'Workspace ' || number AS workspace_path, 'Workspace ' || number AS raw_path, count(*) AS runs
FROM runs r JOIN numbers n ON n.workspace_id = r.workspace_id GROUP BY r.workspace_id, number""",
    "anonymize_buckets": f"WITH {_buckets(True)} SELECT key, label, runs, 'Workspace' AS top_workspace FROM buckets",
    "log_text_tokens": f"""WITH b AS (SELECT user_id, event_id % 7 + event_id % 1000 AS input, event_id % 90 AS output, event_id % 50 AS cached, 0 AS reasoning FROM events WHERE event_id % 4 <> 0)
SELECT CAST(user_id AS VARCHAR) AS thread_id, {_BODY_SUMS} FROM b WHERE input + output + cached > 0 GROUP BY 1""",
    "log_json_tokens": f"""WITH b AS (SELECT user_id, event_id % 1000 AS input, event_id % 90 AS output, event_id % 50 AS cached, event_id % 11 AS reasoning FROM events)
SELECT CAST(user_id AS VARCHAR) AS thread_id, {_BODY_SUMS} FROM b WHERE input + output + cached + reasoning > 0 GROUP BY 1""",
    "log_recursive_tokens": f"""WITH b AS (SELECT user_id, event_id % 50 AS input, event_id % 90 AS output, event_id % 50 AS cached, event_id % 11 AS reasoning FROM events)
SELECT CAST(user_id AS VARCHAR) AS thread_id, {_BODY_SUMS} FROM b WHERE input + output + cached + reasoning > 0 GROUP BY 1""",
    "format_metrics": f"""WITH {_RUNS}, a AS (SELECT workspace_name, CAST(sum(total_tokens) AS BIGINT) AS t, CAST(sum(duration_ms) AS BIGINT) AS ms, count(*) AS n FROM runs GROUP BY 1)
SELECT workspace_name, {_tokens("t")} AS tokens, {_duration("ms")} AS agent_time, format('{{:,}}', t) AS exact_tokens, (n % 1000 // 10) || CASE WHEN n % 10 = 0 THEN '' ELSE '.' || (n % 10) END || '%' AS share FROM a""",
    "metric_cards": f"""WITH {_RUNS}, r AS (SELECT * FROM runs WHERE start_time >= DATE '2001-05-04' AND start_time < DATE '2001-08-02'),
a AS (SELECT CAST(count(*) AS DOUBLE) AS n, CAST(coalesce(sum(total_tokens), 0) AS DOUBLE) AS t, CAST(coalesce(sum(duration_ms), 0) AS DOUBLE) AS ms, count(DISTINCT CAST(start_time AS DATE)) AS days, sum(input) AS i, sum(cached) AS c FROM r),
b AS (SELECT CAST(sum(total_tokens) AS DOUBLE) AS alltime, CAST(sum(duration_ms) AS DOUBLE) AS ams FROM runs),
p AS (SELECT *, CAST(floor(greatest(0, c / i) * 100 * 10 + 0.5) AS BIGINT) AS pc FROM a, b)
SELECT 'selected-time' AS id, {_duration("ms")} AS value FROM p UNION ALL SELECT 'runs', format('{{:,}}', CAST(n AS BIGINT)) FROM p UNION ALL SELECT 'avg-day-time', {_duration("(ms / 90)")} FROM p
UNION ALL SELECT 'active-days', format('{{:,}}', days) FROM p UNION ALL SELECT 'all-time', {_duration("ams")} FROM p UNION ALL SELECT 'selected-tokens', {_tokens("t")} FROM p
UNION ALL SELECT 'avg-day-tokens', {_tokens("(t / 90)")} FROM p UNION ALL SELECT 'token-cache-hit-rate', (pc // 10) || CASE WHEN pc % 10 = 0 THEN '' ELSE '.' || (pc % 10) END || '%' FROM p
UNION ALL SELECT 'avg-tokens', {_tokens("(t / n)")} FROM p UNION ALL SELECT 'all-tokens', {_tokens("alltime")} FROM p""",
    "project_detail": f"WITH {_RUNS} SELECT model, CAST(sum(total_tokens) AS BIGINT) AS tokens, count(*) AS runs FROM runs WHERE {_NATION_3} GROUP BY 1",
    "source_profile": _profile(),
    "parse_warnings_capped": """WITH f AS (SELECT printf('f%05d', event_id % 250) AS file, count(*) AS n FROM events WHERE event_id % 5 = 0 OR event_id % 11 = 0 GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY file) AS k FROM f)
SELECT 'parse_warning' AS code, 'warning' AS severity, 'jsonl lines could not be parsed' AS message, CAST(n AS VARCHAR) AS n, file AS source FROM r WHERE k <= 20
UNION ALL SELECT 'parse_warning', 'warning', 'more files with warnings', CAST(count(*) - 20 AS VARCHAR), '' FROM r HAVING count(*) > 20""",
    "daily_csv_roundtrip": f"WITH {_buckets(False)} SELECT key AS date, CAST(runs AS VARCHAR) AS runs, CAST(tokens AS VARCHAR) AS tokens, CAST(agent_time_ms // 60000 AS VARCHAR) AS agent_time_minutes, CAST(active_projects AS VARCHAR) AS active_projects, top_workspace FROM buckets",
    "runs_csv_roundtrip": f"""WITH {_RUNS}, {_NUMBERS} SELECT id, title, 'Workspace ' || number AS workspace, 'Workspace ' || number AS workspace_path, strftime(start_time, '%Y-%m-%dT%H:%M:%S.000Z') AS start_time, strftime(end_time, '%Y-%m-%dT%H:%M:%S.000Z') AS end_time,
  CAST(duration_ms // 60000 AS VARCHAR) AS duration_minutes, model, CAST(total_tokens AS VARCHAR) AS tokens, CASE WHEN archived THEN 'true' ELSE 'false' END AS archived, '' AS rollout_path FROM runs r JOIN numbers n ON n.workspace_id = r.workspace_id""",
    "summary_json": f"WITH {_RUNS} SELECT count(*) AS runs, CAST(sum(total_tokens) AS BIGINT) AS tokens, CAST(sum(duration_ms) AS BIGINT) AS agent_time_ms, count(DISTINCT CAST(start_time AS DATE)) AS active_days, CAST(count(DISTINCT date_trunc('week', start_time)) AS INTEGER) AS weeks FROM runs",
    "materialized_runs": f"WITH {_RUNS} SELECT CAST(start_time AS DATE) AS start_date, count(*) AS runs, CAST(sum(total_tokens) AS BIGINT) AS tokens FROM runs GROUP BY 1",
    "session_jsonl": f"""WITH {_FILES},
g AS (SELECT b, ts, least(greatest(ms - lag(ms) OVER (PARTITION BY b ORDER BY ts), 0), 10800000) AS gap FROM lines WHERE kind NOT IN (1, 2)),
t AS (SELECT b, min(ts) AS start_time, max(ts) AS end_time, CAST(coalesce(sum(gap), 0) AS BIGINT) AS active_ms FROM g GROUP BY 1),
m AS (SELECT b, max_by('u' || user_id, event_id) FILTER (WHERE kind = 0) AS id, max_by('/w/' || event_type, event_id) FILTER (WHERE kind = 0) AS cwd, max_by(event_type, event_id) FILTER (WHERE kind = 0 AND value > 50) AS model,
  max_by(struct_pack(input, output, cached), (coalesce(input, 0) + coalesce(output, 0), event_id)) FILTER (WHERE counted) AS best, count(*) FILTER (WHERE kind = 1) AS parse_warnings FROM counts GROUP BY 1)
SELECT printf('s%02d', m.b) AS stem, coalesce(id, printf('s%02d', m.b)) AS id, m.b % 4 = 0 AS archived, cwd, model, start_time, end_time, coalesce(active_ms, 0) AS active_ms, best.input AS input, best.output AS output, best.cached AS cached, CAST(NULL AS BIGINT) AS reasoning, parse_warnings
FROM m LEFT JOIN t ON t.b = m.b""",
    "session_jsonl_live": f"WITH {_FILES} SELECT printf('s%02d', b) AS stem, count(*) AS lines, count(*) FILTER (WHERE kind = 1) AS broken, count(*) FILTER (WHERE counted) AS counts FROM counts WHERE b % 4 <> 0 AND kind <> 2 GROUP BY 1",
    "session_file_count": "SELECT count(DISTINCT user_id % 40) AS files FROM events",
    "stream_session_lines": f"WITH {_FILES} SELECT printf('s%02d', b) AS stem, count(*) AS lines, count(*) FILTER (WHERE kind = 1) AS broken, count(*) FILTER (WHERE kind <> 1) AS times FROM lines WHERE kind <> 2 GROUP BY 1",
    "usage_warnings": f"""WITH {_FILES}, {_BROKEN} UNION ALL SELECT 'privacy', 'info', 'conversation text is not read', '', '' UNION ALL SELECT 'no_log_tokens', 'info', 'no log row has tokens', '', ''""",
    "actionable_warnings": f"WITH {_FILES}, {_BROKEN}",
    "exports": f"""WITH {_buckets(True)}, e AS (
  SELECT 'daily-csv' AS kind, count(*) AS rows, CAST(sum(tokens) AS BIGINT) AS tokens, count(DISTINCT top_workspace) AS names, 1 AS hidden FROM buckets
  UNION ALL SELECT 'summary-json', count(*), CAST(sum(tokens) AS BIGINT), count(DISTINCT top_workspace), 1 FROM buckets
  UNION ALL SELECT 'runs-csv', count(*), CAST(sum(total_tokens) AS BIGINT), count(DISTINCT workspace_name), count(DISTINCT workspace_id) FROM runs)
SELECT kind, true AS full_paths, rows, tokens, names FROM e UNION ALL SELECT kind, false, rows, tokens, hidden FROM e""",
    "project_tables": f"""WITH {_RUNS}, own AS (SELECT * FROM runs WHERE {_NATION_3}), r AS (SELECT * FROM own WHERE start_time >= DATE '1996-02-20' AND start_time < DATE '1997-03-06')
SELECT 'workspace' AS part, workspace_name AS key, CAST(sum(total_tokens) AS DOUBLE) AS value FROM own GROUP BY 2
UNION ALL SELECT 'average', 'tokens_per_day', round(sum(total_tokens) / 380.0, 4) FROM r
UNION ALL SELECT 'bucket', strftime(date_trunc('week', start_time), '%Y-%m-%d'), CAST(sum(total_tokens) AS DOUBLE) FROM r GROUP BY 2
UNION ALL (SELECT 'recent', id, CAST(total_tokens AS DOUBLE) FROM r ORDER BY start_time DESC, id LIMIT 10)""",
    "snapshot_tables": f"""WITH {_RUNS}, r AS (SELECT * FROM runs WHERE start_time >= DATE '1996-02-20' AND start_time < DATE '1997-03-06'),
d AS (SELECT DISTINCT CAST(start_time AS DATE) AS day FROM r), i AS (SELECT day - CAST(row_number() OVER (ORDER BY day) AS INTEGER) AS island FROM d)
SELECT 'totals' AS part, 'all' AS key, CAST(sum(total_tokens) AS BIGINT) AS value FROM runs
UNION ALL SELECT 'streak', 'days', max(n) FROM (SELECT island, count(*) AS n FROM i GROUP BY 1)
UNION ALL (SELECT 'peak', strftime(date_trunc('week', start_time), '%Y-%m-%d') AS k, CAST(sum(total_tokens) AS BIGINT) AS v FROM r GROUP BY 2 ORDER BY v DESC, k LIMIT 1)
UNION ALL (SELECT 'run', id, total_tokens FROM r ORDER BY start_time DESC, id LIMIT 250)""",
    "stream_active_time": f"WITH {_ACTIVE} SELECT user_id, count(*) AS events, CAST(coalesce(sum(CASE WHEN before IS NOT NULL THEN gap END), 0) AS BIGINT) AS active_ms FROM gaps GROUP BY 1",
    "stream_buckets": "SELECT strftime(ts, '%Y-%m-%d') AS key, count(*) AS events, CAST(sum(CAST(floor(value) AS BIGINT)) AS BIGINT) AS tokens FROM events GROUP BY 1",
    "stream_week_buckets": "SELECT strftime(date_trunc('week', ts), '%Y-%m-%d') AS key, count(*) AS events, CAST(sum(CAST(floor(value) AS BIGINT)) AS BIGINT) AS tokens FROM events GROUP BY 1",
}

_MOST = "9223372036854775807"
_SPAN = "start_time >= DATE '1996-02-20' AND start_time < DATE '1997-03-06'"


def _held(x: str) -> str:
    return f"CAST(least(sum(CAST({x} AS HUGEINT)), {_MOST}) AS BIGINT)"


def _streak(days: str, by: str) -> str:
    """Longest streak of a table of days (by, day)."""
    return f"SELECT {by}, max(n) AS longest_streak_days FROM (SELECT {by}, island, count(*) AS n FROM (SELECT {by}, day - CAST(row_number() OVER (PARTITION BY {by} ORDER BY day) AS INTEGER) AS island FROM {days}) GROUP BY 1, 2) GROUP BY 1"


ORACLE_SQL |= {
    "snapshot_versions": f"""WITH {_RUNS}, v AS (SELECT 1 AS version, * FROM runs WHERE NOT archived UNION ALL SELECT 2, * FROM runs)
SELECT CAST(version AS BIGINT) AS version, 'runs' AS part, count(*) AS rows, CAST(sum(total_tokens) AS BIGINT) AS tokens FROM v GROUP BY 1
UNION ALL SELECT version, 'workspaces', (SELECT count(DISTINCT workspace_id) FROM threads), CAST(sum(total_tokens) AS BIGINT) FROM v GROUP BY 1
UNION ALL SELECT x, 'warnings', (SELECT count(*) FROM ({ORACLE_SQL["usage_warnings"]})), NULL FROM (VALUES (1), (2)) t(x)""",
    "cached_snapshot": ORACLE_SQL["snapshot_tables"] + " UNION ALL SELECT 'workspace', workspace_name, CAST(sum(total_tokens) AS BIGINT) FROM runs GROUP BY 2",
    "persisted_range": _RANGE,
    "incremental_refresh": ORACLE_SQL["session_jsonl"],
    "refreshed_runs": f"""WITH s AS ({ORACLE_SQL["session_jsonl"]}),
u AS (SELECT 'u' || user_id AS id, printf('s%02d', user_id % 40) AS stem, user_id % 2 = 0 AS logged, date_trunc('millisecond', min(ts)) AS a, date_trunc('millisecond', max(ts)) AS b, CAST(sum(CAST(floor(value) AS BIGINT)) AS BIGINT) AS t, CAST(sum(event_id % 7) AS BIGINT) AS i, CAST(sum(event_id % 5) AS BIGINT) AS o FROM events WHERE user_id % 13 <> 6 GROUP BY user_id),
k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY archived DESC, stem) AS n FROM s),
j AS (SELECT u.*, k.id IS NOT NULL AS named, CASE WHEN k.id IS NOT NULL THEN struct_pack(k.start_time, k.end_time, k.active_ms, k.input, k.output, k.cached) WHEN s.stem IS NOT NULL THEN struct_pack(s.start_time, s.end_time, s.active_ms, s.input, s.output, s.cached) END AS f
  FROM u LEFT JOIN k ON k.id = u.id AND k.n = 1 LEFT JOIN s ON s.stem = u.stem),
r AS (SELECT id, coalesce(f.start_time, a) AS start_time, coalesce(f.end_time, b) AS end_time, coalesce(f.active_ms, 0) AS active, t, coalesce(f.input, CASE WHEN logged THEN i END) AS input, coalesce(f.output, CASE WHEN logged THEN o END) AS output, coalesce(f.cached, CASE WHEN logged THEN 0 END) AS cached FROM j)
SELECT id, start_time, end_time, CAST(CASE WHEN active > 0 THEN active ELSE least(greatest(epoch_ms(end_time) - epoch_ms(start_time), 0), {DAY_CAP}) END AS BIGINT) AS duration_ms, CASE WHEN active > 0 THEN 'jsonl-events' ELSE 'thread-span' END AS duration_method,
  t AS total_tokens, input, output, cached, CAST(NULL AS BIGINT) AS reasoning, {_RATE.format(i="input", c="cached")} AS cache_hit_rate, CASE WHEN coalesce(input, output, cached) IS NULL THEN 'Breakdown unavailable for this run.' END AS unavailable_reason FROM r""",
    "session_odd_lines": f"""WITH e AS (SELECT user_id % 50 AS b, user_id, event_id AS n, event_id % 6 AS k, date_trunc('second', ts) AS s, CAST(CAST(ts AS DATE) AS TIMESTAMP) AS day FROM events),
t AS (SELECT b, CASE WHEN k = 1 THEN day WHEN k IN (0, 2) OR (k = 3 AND n % 5 = 0) THEN s END AS t FROM e),
g AS (SELECT b, t, least(greatest(epoch_ms(t) - lag(epoch_ms(t)) OVER (PARTITION BY b ORDER BY t), 0), 10800000) AS gap FROM t WHERE t IS NOT NULL),
a AS (SELECT b, min(t) AS start_time, max(t) AS end_time, CAST(coalesce(sum(gap), 0) AS BIGINT) AS active_ms FROM g GROUP BY 1),
c AS (SELECT b, n, CASE WHEN k = 1 THEN n % 100 WHEN k = 4 THEN n % 90 WHEN k = 3 AND n % 5 = 0 THEN {_MOST} END AS i, CASE WHEN k = 3 AND n % 5 = 0 THEN {_MOST} END AS o FROM e),
m AS (SELECT b, max_by(struct_pack(i, o), (CAST(i AS DOUBLE) + CAST(coalesce(o, 0) AS DOUBLE), n)) FILTER (WHERE i > 0) AS best FROM c GROUP BY 1),
d AS (SELECT b, max_by('u' || user_id, n) FILTER (WHERE k = 0) AS id FROM e GROUP BY 1)
SELECT 'u' || d.b AS stem, coalesce(id, 'u' || d.b) AS id, start_time, end_time, coalesce(active_ms, 0) AS active_ms, CAST(best.i AS BIGINT) AS input, CAST(best.o AS BIGINT) AS output, CAST(0 AS BIGINT) AS parse_warnings FROM d JOIN m ON m.b = d.b LEFT JOIN a ON a.b = d.b""",
    "usage_reports": f"""WITH s AS ({ORACLE_SQL["session_jsonl"]}),
u AS (SELECT 'u' || user_id AS id, user_id, printf('s%02d', user_id % 40) AS stem, date_trunc('millisecond', min(ts)) AS a, date_trunc('millisecond', max(ts)) AS b, CAST(sum(CAST(floor(value) AS BIGINT)) AS BIGINT) AS t FROM events GROUP BY user_id),
k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY archived DESC, stem) AS n FROM s),
r AS (SELECT u.*, CASE WHEN coalesce(CASE WHEN k.id IS NOT NULL THEN k.active_ms ELSE s.active_ms END, 0) > 0 THEN CASE WHEN k.id IS NOT NULL THEN k.active_ms ELSE s.active_ms END
  ELSE greatest(0, least(epoch_ms(coalesce(CASE WHEN k.id IS NOT NULL THEN k.end_time ELSE s.end_time END, b)) - epoch_ms(coalesce(CASE WHEN k.id IS NOT NULL THEN k.start_time ELSE s.start_time END, a)), 259200000)) END AS ms
  FROM u LEFT JOIN k ON k.id = u.id AND k.n = 1 LEFT JOIN s ON s.stem = u.stem),
f AS (SELECT count(*) FILTER (WHERE parse_warnings > 0) AS n FROM s)
SELECT 'totals' AS part, 'tokens' AS key, CAST(sum(t) AS BIGINT) AS value FROM u UNION ALL SELECT 'before', 'tokens', CAST(sum(t) AS BIGINT) FROM u WHERE user_id % 13 <> 5
UNION ALL SELECT 'workspace', CAST(user_id % 5 AS VARCHAR), CAST(sum(t) AS BIGINT) FROM u GROUP BY 2 UNION ALL SELECT 'summary', 'agent_time_ms', CAST(sum(ms) AS BIGINT) FROM r
UNION ALL SELECT 'warnings', 'parse_warning', least(n, 20) + CASE WHEN n > 20 THEN 1 ELSE 0 END FROM f WHERE n > 0 UNION ALL SELECT 'warnings', 'privacy', 1 UNION ALL SELECT 'warnings', 'missing_source', 1
UNION ALL SELECT 'files', 'archived', count(*) FROM s WHERE archived""",
    "observed_profile": f"SELECT * FROM ({_profile()}) WHERE source IN ('region', 'nation', 'customer', 'orders', 'lineitem')",
    "recent_runs_by_workspace": f"WITH {_RUNS} SELECT id, workspace_name, start_time, total_tokens FROM (SELECT *, row_number() OVER (PARTITION BY workspace_id ORDER BY start_time DESC, id) AS n FROM runs) WHERE n <= 10",
    "day_bitmaps": "SELECT user_id, strftime(ts, '%Y-%m') AS start_month, CAST(bit_or(CAST(1 AS BIGINT) << CAST(day(ts) - 1 AS INTEGER)) AS BIGINT) AS days FROM events GROUP BY 1, 2",
    "bitmap_summary": f"""WITH d AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS day FROM events), k AS ({_streak("d", "user_id")})
SELECT k.user_id AS user_id, longest_streak_days, count(DISTINCT date_trunc('week', day)) AS active_weeks, count(*) AS days_by_week, count(*) FILTER (WHERE day >= DATE '2024-01-10' AND day < DATE '2024-02-04') AS active_days
FROM k JOIN d ON d.user_id = k.user_id GROUP BY 1, 2""",
    "bitmap_range": f"""WITH {_RUNS}, d AS (SELECT DISTINCT 1 AS one, CAST(start_time AS DATE) AS day FROM runs), k AS ({_streak("d", "one")})
SELECT 'custom' AS range, (SELECT count(DISTINCT CAST(start_time AS DATE)) FROM runs WHERE {_SPAN}) AS active_days, longest_streak_days FROM k UNION ALL SELECT 'all', (SELECT count(*) FROM d), longest_streak_days FROM k""",
    "alias_rule_table": f"""WITH {_THREADS} SELECT CASE WHEN n_nationkey % 3 = 0 THEN 'E:\\late' ELSE 'D:\\MOVED\\' || workspace_name || '\\50' END AS workspace_path, count(*) AS threads FROM threads JOIN nation ON n_name = workspace_name GROUP BY 1""",
    "log_large_numbers": f"""WITH b AS (SELECT user_id % 40 AS u, CASE WHEN n % 24 IN (0, 1, 2) THEN {_MOST} WHEN n % 24 IN (3, 4) THEN 0 WHEN n % 3 = 0 THEN 2 ELSE n % 1000 END AS input,
  CASE n % 24 WHEN 1 THEN 3 WHEN 3 THEN {_MOST} ELSE CASE WHEN n % 24 > 4 AND n % 3 = 0 THEN 1 ELSE 0 END END AS output, CASE n % 24 WHEN 2 THEN {_MOST} ELSE 0 END AS cached, CASE n % 24 WHEN 4 THEN {_MOST} ELSE 0 END AS reasoning FROM (SELECT user_id, event_id AS n FROM events))
SELECT CAST(u AS VARCHAR) AS thread_id, {_held("input")} AS input, {_held("output")} AS output, {_held("cached")} AS cached, {_held("reasoning")} AS reasoning, count(*) AS rows FROM b WHERE input > 0 OR output > 0 OR cached > 0 OR reasoning > 0 GROUP BY 1""",
}
