"""SQL counterparts of the registered queries, over the same tables."""

from __future__ import annotations

from millrace.queries.tables import HORIZON_MS

ORACLES: dict[str, str] = {}

_ORIGIN = "TIMESTAMP '2024-01-01 00:00:00'"

_LINES = f"""
lines AS (
  SELECT '/var/log/app/' || event_type || '.log' AS path, event_id AS "offset", ts,
    epoch_us(ts) - epoch_us({_ORIGIN}) AS arrival_us,
    '[' || strftime(ts, '%Y-%m-%d %H:%M:%S') || '] '
    || CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'purchase' THEN 'WARN'
                       WHEN 'view' THEN 'DEBUG' ELSE 'INFO' END
    || ' - user_' || CAST(user_id AS VARCHAR) || ' ' || event_type
    || ' took ' || CAST(CAST(floor(value * 10) AS BIGINT) AS VARCHAR) || 'ms EVT-'
    || lpad(CAST(event_id % 10000 AS VARCHAR), 4, '0')
    || CASE user_id % 10 WHEN 0 THEN ' [test]' WHEN 1 THEN ' [dev]' ELSE '' END AS line
  FROM events)"""

_ROUTES = """
routes(route_id, path, freq, size, every) AS (VALUES
  (0::BIGINT, '/var/log/app/error.log', 600000::BIGINT, 7::BIGINT, 21600000::BIGINT),
  (1, '/var/log/app/error.log', 300000, 20, 3600000),
  (2, '/var/log/app/click.log', 600000, 50, 7200000),
  (3, '/var/log/app/view.log', 900000, 12, 43200000),
  (4, '/var/log/app/purchase.log', 60000, 5, 1800000),
  (5, '/var/log/app/idle.log', 1000, 100, 30000),
  (6, '/var/log/app/purchase.log', 3600000, 100, 86400000))"""

_ALLOWED = r"""CASE route_id
    WHEN 0 THEN regexp_matches(line, 'ERROR')
    WHEN 1 THEN regexp_matches(line, 'EVT-[0-9]{4}')
    WHEN 4 THEN regexp_matches(line, 'took [1-9]\d{3,}ms') OR regexp_matches(line, 'WARN')
    WHEN 6 THEN regexp_matches(line, 'WARN')
    ELSE TRUE END"""

_DENIED = r"""CASE route_id
    WHEN 1 THEN regexp_matches(line, '\[test\]') OR regexp_matches(line, 'error.*dev')
    WHEN 3 THEN regexp_matches(line, 'EVT-1\d{3}')
    WHEN 4 THEN regexp_matches(line, 'DEBUG')
    WHEN 6 THEN regexp_matches(line, '\[dev\]')
    ELSE FALSE END"""

_ROUTED = f"""
fanned AS (SELECT * FROM lines JOIN routes USING (path)),
routed AS (SELECT * FROM fanned WHERE ({_ALLOWED}) AND NOT ({_DENIED}))"""

_TICKED = """
ticked AS MATERIALIZED (
  SELECT *, ((arrival_us + freq * 1000 - 1) // (freq * 1000)) * freq AS tick
  FROM routed WHERE arrival_us > 0),
ticks AS MATERIALIZED (
  SELECT route_id, tick, n, row_number() OVER (PARTITION BY route_id ORDER BY tick) AS rn
  FROM (SELECT route_id, tick, count(*) AS n FROM ticked GROUP BY ALL))"""

# The buffer, one non-empty tick at a time: an overdue flush before the tick,
# then the tick's own flush; whatever is overdue at the horizon goes last.
_FLUSHES = f"""
steps AS (
  SELECT route_id, 0::BIGINT AS rn, 0::BIGINT AS buf, 0::BIGINT AS prev,
    NULL::BIGINT AS due_at, NULL::BIGINT AS due_n,
    NULL::BIGINT AS own_at, NULL::BIGINT AS own_n, NULL::BOOLEAN AS own_full
  FROM routes
  UNION ALL
  SELECT route_id, rn,
    CASE WHEN b >= size OR t - p >= every THEN 0 ELSE b END,
    CASE WHEN b >= size OR t - p >= every THEN t ELSE p END,
    CASE WHEN late THEN due END, CASE WHEN late THEN buf END,
    CASE WHEN b >= size OR t - p >= every THEN t END,
    CASE WHEN b >= size OR t - p >= every THEN b END,
    b >= size
  FROM (
    SELECT *, CASE WHEN late THEN n ELSE buf + n END AS b, CASE WHEN late THEN due ELSE prev END AS p
    FROM (
      SELECT s.route_id, k.rn, k.tick AS t, k.n, s.buf, s.prev, r.size, r.every,
        ((s.prev + r.every + r.freq - 1) // r.freq) * r.freq AS due,
        s.buf > 0 AND ((s.prev + r.every + r.freq - 1) // r.freq) * r.freq < k.tick AS late
      FROM steps s JOIN routes r USING (route_id)
      JOIN ticks k ON k.route_id = s.route_id AND k.rn = s.rn + 1))),
fired AS MATERIALIZED (
  SELECT route_id, due_at AS flush_at, due_n AS n_entries, 'time elapsed' AS reason
  FROM steps WHERE due_at IS NOT NULL
  UNION ALL
  SELECT route_id, own_at, own_n, CASE WHEN own_full THEN 'buffer full' ELSE 'time elapsed' END
  FROM steps WHERE own_at IS NOT NULL
  UNION ALL
  SELECT route_id, ((prev + every + freq - 1) // freq) * freq, buf, 'time elapsed'
  FROM (SELECT *, max(rn) OVER (PARTITION BY route_id) AS top FROM steps) JOIN routes USING (route_id)
  WHERE rn = top AND buf > 0),
flushes AS (
  SELECT route_id, row_number() OVER (PARTITION BY route_id ORDER BY flush_at) AS batch_id,
    flush_at, n_entries, reason
  FROM fired WHERE flush_at <= {HORIZON_MS})"""

_ASSIGNED = """
assigned AS (
  SELECT t.*, f.batch_id, f.flush_at, f.n_entries, f.reason
  FROM ticked t ASOF LEFT JOIN flushes f ON t.route_id = f.route_id AND t.tick <= f.flush_at),
entries AS (
  SELECT *, row_number() OVER (PARTITION BY route_id, batch_id ORDER BY "offset") - 1 AS pos,
    make_timestamp(epoch_us(TIMESTAMP '2024-01-01 00:00:00') + flush_at * 1000 + batch_id * 500) AS ship_ts
  FROM assigned WHERE batch_id IS NOT NULL)"""

_RFC3339 = """strftime(ship_ts, '%Y-%m-%dT%H:%M:%S')
  || CASE WHEN epoch_us(ship_ts) % 1000000 = 0 THEN ''
          WHEN epoch_us(ship_ts) % 1000 = 0 THEN printf('.%03d', (epoch_us(ship_ts) % 1000000) // 1000)
          ELSE printf('.%06d', epoch_us(ship_ts) % 1000000) END || '+00:00'"""


def _event_query(select: str, *parts: str) -> str:
    return f"WITH {','.join([_LINES, *parts])} {select}"


def _route_query(select: str) -> str:
    return _event_query(select, _ROUTES, _ROUTED)


def _tick_query(select: str) -> str:
    return _event_query(select, _ROUTES, _ROUTED, _TICKED)


def _batch_query(select: str, *parts: str) -> str:
    ctes = [_LINES, _ROUTES, _ROUTED, _TICKED, _FLUSHES, _ASSIGNED, *parts]
    return f"WITH RECURSIVE {','.join(ctes)} {select}"


# -- scans --------------------------------------------------------------------

# Text between line feeds; what follows the last one is a line unless empty.
_DOC_LINES = """
pieces AS (
  SELECT doc_id, unnest(range(len(parts))) AS line_no, unnest(parts) AS piece, len(parts) AS n
  FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents)),
doc_lines AS (
  SELECT doc_id, line_no,
    CASE WHEN line_no < n - 1 AND right(piece, 1) = chr(13) THEN left(piece, length(piece) - 1)
         ELSE piece END AS line
  FROM pieces WHERE line_no < n - 1 OR piece <> '')"""

ORACLES["frame_lines"] = f"WITH {_DOC_LINES} SELECT doc_id, line_no, line FROM doc_lines"

_PATH_LINES = _event_query("SELECT path, line FROM lines")
ORACLES["scan_text_files"] = _PATH_LINES
ORACLES["scan_tail_files"] = _PATH_LINES
ORACLES["scan_tail_ranges"] = _PATH_LINES
ORACLES["stream_tail"] = _PATH_LINES

ORACLES["utf8_quarantine"] = f"""
WITH {_DOC_LINES}
SELECT doc_id, line_no, doc_id % 7 = 0 AND line_no = 0 AS quarantined,
  CAST(strlen(line) + CASE WHEN doc_id % 7 = 0 AND line_no = 0 THEN 1 ELSE 0 END AS BIGINT) AS n_bytes
FROM doc_lines"""

_FILES = """
files AS (
  SELECT source || '/' || doc_id AS path, doc_id + 1000 AS inode, strlen(text)::BIGINT AS size,
    least(strlen(split_part(text, chr(10), 1)) + 1, strlen(text))::BIGINT AS head,
    doc_id % 6 AS state, text
  FROM documents),
listing AS (SELECT path, inode, size FROM files WHERE state <> 5),
cursor AS (
  SELECT path, CASE WHEN state = 4 THEN inode + 1 ELSE inode END AS old_inode,
    CASE state WHEN 1 THEN head WHEN 3 THEN size + 10 ELSE size END AS old_position
  FROM files WHERE state <> 0),
compared AS (
  SELECT path, inode, size, old_inode, old_position,
    CASE WHEN size IS NULL THEN 'missing' WHEN old_position IS NULL THEN 'new'
         WHEN inode <> old_inode THEN 'rotated' WHEN size < old_position THEN 'truncated'
         WHEN size > old_position THEN 'append' ELSE 'idle' END AS action
  FROM listing FULL OUTER JOIN cursor USING (path))"""


def _plan(whole: str) -> str:
    return f"""SELECT path, action,
  CASE WHEN action = 'append' THEN old_position WHEN action IN ({whole}) THEN 0 END AS start_pos,
  CASE WHEN action = 'append' OR action IN ({whole}) THEN size END AS end_pos,
  coalesce(inode, old_inode) AS new_inode, coalesce(size, old_position) AS new_position
FROM compared"""


ORACLES["scan_plan"] = f"WITH {_FILES} {_plan(chr(39) + 'truncated' + chr(39))}"
ORACLES["scan_plan_backfill"] = (
    f"WITH {_FILES} " + _plan("'truncated', 'new', 'rotated'")
)
ORACLES["advance_cursor"] = f"""WITH {_FILES}
SELECT path, coalesce(inode, old_inode) AS inode, coalesce(size, old_position) AS position FROM compared"""

ORACLES["resume_lines"] = f"""
WITH {_FILES},
fresh AS (
  SELECT path, CASE action WHEN 'truncated' THEN text
    ELSE substr(text, length(split_part(text, chr(10), 1)) + 2) END AS text
  FROM compared JOIN files USING (path) WHERE action IN ('truncated', 'append')),
pieces AS (
  SELECT path, unnest(range(len(parts))) AS line_no, unnest(parts) AS piece, len(parts) AS n
  FROM (SELECT path, string_split(text, chr(10)) AS parts FROM fresh))
SELECT path, line_no,
  CASE WHEN line_no < n - 1 AND right(piece, 1) = chr(13) THEN left(piece, length(piece) - 1)
       ELSE piece END AS line
FROM pieces WHERE line_no < n - 1 OR piece <> ''"""

# -- selection ----------------------------------------------------------------


def _selection(condition: str) -> str:
    return _event_query(f'SELECT path, "offset", line FROM lines WHERE {condition}')


_LEVELS = "(regexp_matches(line, 'ERROR') OR regexp_matches(line, 'WARN'))"

ORACLES["match_on"] = _selection(_LEVELS)
ORACLES["exclude_on"] = _selection(
    "NOT (regexp_matches(line, 'DEBUG') OR regexp_matches(line, 'TRACE'))"
)
ORACLES["match_and_exclude"] = _selection(
    _LEVELS + r" AND NOT (regexp_matches(line, '\[test\]') OR regexp_matches(line, '\[dev\]'))"
)
ORACLES["passthrough"] = _selection("TRUE")
ORACLES["regex_timestamp_anchor"] = _selection(
    r"(regexp_matches(line, '^\[20\d\d-\d\d-\d\d ') OR regexp_matches(line, 'EVT-[0-9]{4}'))"
    " AND NOT (regexp_matches(line, 'EVT-1001') OR regexp_matches(line, 'error.*test'))"
)
ORACLES["regex_counted_class"] = _selection(r"regexp_matches(line, 'took [1-9]\d{3,}ms')")
ORACLES["regex_dialect"] = f"""
WITH {_DOC_LINES} SELECT doc_id, line_no, line FROM doc_lines
WHERE (regexp_matches(line, '(?P<first>[[:upper:]]{{2,}})\\s+\\d+$')
       OR regexp_matches(line, '(?i)\\b(error|license|password)\\b'))
  AND NOT (regexp_matches(line, '[[:punct:]]{{3}}') OR regexp_matches(line, '^$'))"""
ORACLES["ship_accounting"] = _event_query(
    rf"""SELECT path, count(*) FILTER (WHERE keep) AS kept, count(*) FILTER (WHERE NOT keep) AS dropped
FROM (SELECT path, {_LEVELS} AND NOT regexp_matches(line, '\[test\]') AS keep FROM lines) GROUP BY path"""
)
ORACLES["entry_projection"] = _route_query('SELECT route_id, "offset", path, line FROM routed')

# -- routing ------------------------------------------------------------------

ORACLES["route_fanout"] = _route_query('SELECT route_id, path, "offset" FROM fanned')
ORACLES["route_rules"] = _route_query('SELECT route_id, path, "offset", line FROM routed')
ORACLES["allow_semi_join"] = _route_query(
    f'SELECT route_id, "offset", line FROM fanned WHERE {_ALLOWED}'
)
ORACLES["deny_anti_join"] = _route_query(
    f'SELECT route_id, "offset", line FROM fanned WHERE NOT ({_DENIED})'
)

# -- batching -----------------------------------------------------------------

ORACLES["tick_counts"] = _tick_query("SELECT route_id, tick, n FROM ticks")
ORACLES["flush_schedule"] = _batch_query(
    "SELECT route_id, batch_id, flush_at, n_entries, reason FROM flushes"
)
_ENDLESS = f"""{_ROUTES.replace("routes(", "given(", 1)},
routes AS (
  SELECT route_id, path, freq, size,
    CASE WHEN route_id % 2 = 1 THEN {2**62} ELSE every END AS every FROM given)"""
ORACLES["flush_schedule_unbounded"] = (
    f"WITH RECURSIVE {','.join([_LINES, _ENDLESS, _ROUTED, _TICKED, _FLUSHES])} "
    "SELECT route_id, batch_id, flush_at, n_entries, reason FROM flushes"
)
ORACLES["flush_log"] = _batch_query(
    """SELECT route_id, reason, count(*) AS n_flushes, CAST(sum(n_entries) AS BIGINT) AS n_entries,
  max(n_entries) AS largest FROM flushes GROUP BY route_id, reason"""
)
ORACLES["batch_assignment"] = _batch_query(
    'SELECT route_id, "offset", tick, batch_id, flush_at, n_entries, reason FROM assigned'
)
ORACLES["pending_lines"] = _batch_query(
    'SELECT route_id, "offset", line FROM assigned WHERE batch_id IS NULL'
)
ORACLES["batch_entries"] = _batch_query("SELECT route_id, batch_id, pos, path, line FROM entries")
ORACLES["burst_parts"] = _route_query(
    """
SELECT route_id, 1::BIGINT AS batch_id, part, flush_at, reason, count(*) AS n_entries,
  arg_min(line, "offset") AS first_line, arg_max(line, "offset") AS last_line
FROM (
  SELECT route_id, line, "offset",
    CASE WHEN n <= 500 THEN 0 ELSE before // 401 END AS part,
    CASE WHEN n >= size THEN freq ELSE greatest(freq, ((every + freq - 1) // freq) * freq) END AS flush_at,
    CASE WHEN n >= size THEN 'buffer full' ELSE 'time elapsed' END AS reason
  FROM (
    SELECT *, count(*) OVER (PARTITION BY route_id) AS n,
      count(*) OVER (PARTITION BY route_id ORDER BY "offset" // 100
        RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before
    FROM routed))
GROUP BY ALL"""
)

# -- encoders -----------------------------------------------------------------

_GROUPED = "FROM entries GROUP BY route_id, batch_id"
_PAYLOAD = """to_json(list({'path': path, 'line': line} ORDER BY "offset"))"""
_BULK = f"""to_json({{'index': {{'_index': idx}}}}) || chr(10)
  || to_json({{'@timestamp': {_RFC3339}, 'path': path, 'message': line}}) || chr(10)"""
_SYSLOG = """'<134>' || strftime(ship_ts, '%b %d %H:%M:%S') || ' {host} shipper: [' || path || '] ' || line"""

ORACLES["http_payload"] = _batch_query(
    f"SELECT route_id, batch_id, count(*) AS n_entries, CAST({_PAYLOAD} AS VARCHAR) AS payload {_GROUPED}"
)
ORACLES["ship_batches"] = _batch_query(
    f"""SELECT route_id, batch_id, any_value(flush_at) AS flush_at, any_value(reason) AS reason,
  count(*) AS n_entries, CAST({_PAYLOAD} AS VARCHAR) AS payload {_GROUPED}"""
)
ORACLES["bulk_body"] = _batch_query(
    f"""SELECT route_id, batch_id, string_agg({_BULK.replace("idx", "'logs-app'")}, '' ORDER BY "offset") AS body
{_GROUPED}"""
)
ORACLES["bulk_url"] = """
SELECT c_custkey, regexp_replace('http://' || c_name || repeat('/', c_nationkey % 4), '/+$', '') || '/_bulk' AS url
FROM customer"""
ORACLES["syslog_messages"] = _event_query(
    f"""SELECT "offset", {_SYSLOG.format(host="web-1").replace("ship_ts", "ts")} AS message FROM lines"""
)
ORACLES["syslog_tcp_frames"] = _batch_query(
    f"""SELECT route_id, batch_id,
  string_agg({_SYSLOG.format(host="web-1")} || chr(10), '' ORDER BY "offset") AS frame {_GROUPED}"""
)
ORACLES["syslog_udp_datagrams"] = _batch_query(
    f"SELECT route_id, batch_id, pos AS seq, {_SYSLOG.format(host='unknown')} AS payload FROM entries"
)
ORACLES["jsonl_records"] = _event_query(
    """SELECT "offset", CAST(to_json({'path': path, 'line': line}) AS VARCHAR) AS record FROM lines"""
)
ORACLES["auth_header"] = """
SELECT c_custkey, CASE c_custkey % 3
  WHEN 0 THEN 'Bearer ' || c_mktsegment
  WHEN 1 THEN 'Basic ' || base64(encode(c_name || ':' || c_name || '-' || c_mktsegment || '-' || repeat(c_name, 4)))
  END AS header
FROM customer"""
ORACLES["payload_roundtrip"] = _batch_query(
    "SELECT route_id, batch_id, pos + 1 AS i, path, line FROM entries"
)
ORACLES["decode_bodies"] = """
WITH bodies AS (SELECT event_id, event_id % 7 AS kind, props FROM events)
SELECT event_id, 1::BIGINT AS i, 'unknown' AS path, props AS line, NULL::VARCHAR AS error FROM bodies WHERE kind = 0
UNION ALL SELECT event_id, 1, props, props, NULL FROM bodies WHERE kind = 1
UNION ALL SELECT event_id, unnest([1, 2]), props, '', NULL FROM bodies WHERE kind = 2
UNION ALL SELECT event_id, NULL, NULL, NULL, 'Empty request body' FROM bodies WHERE kind = 3
UNION ALL SELECT event_id, NULL, NULL, NULL, 'Invalid JSON' FROM bodies WHERE kind = 4
UNION ALL SELECT event_id, 1, 'unknown', '', NULL FROM bodies WHERE kind = 6"""

# -- routes -------------------------------------------------------------------

_SUPPLIED = """
supplied AS (
  SELECT s_suppkey AS route_id, s_name, s_nationkey, s_suppkey % 16 AS k,
    CASE WHEN k IN (0, 1, 2, 3, 11, 12, 13, 15) THEN 'http' WHEN k IN (4, 5, 6) THEN 'syslog'
         WHEN k IN (7, 8) THEN 'elasticsearch' WHEN k IN (9, 10) THEN 'file' ELSE 'unknown' END AS kind
  FROM supplier)"""

ORACLES["normalize_routes"] = f"""
WITH {_SUPPLIED}
SELECT route_id, '/var/log/' || s_name || '.log' AS path,
  CAST(CASE k WHEN 13 THEN 0 ELSE 500 END AS BIGINT) AS polling_frequency_ms,
  CAST(CASE WHEN k % 2 = 0 THEN s_nationkey + 1 ELSE 100 END AS BIGINT) AS buffer_size,
  CAST(CASE WHEN k % 3 = 0 THEN 15000 ELSE 30000 END AS BIGINT) AS flush_interval_ms,
  CASE k WHEN 8 THEN 'ERROR|WARN' WHEN 11 THEN 'ERROR|[invalid' ELSE '' END AS match_on,
  CASE k WHEN 8 THEN 'DEBUG' WHEN 12 THEN '(?=x)' ELSE '' END AS exclude_on,
  k IN (2, 3) AS require_auth,
  CAST(CASE WHEN kind = 'syslog' THEN CASE k WHEN 6 THEN 1514 ELSE 514 END END AS INTEGER) AS port,
  CASE WHEN kind = 'syslog' THEN CASE k WHEN 4 THEN 'icmp' WHEN 6 THEN 'TCP' ELSE 'udp' END END AS protocol
FROM supplied"""

ORACLES["validate_routes"] = f"""
WITH {_SUPPLIED},
judged AS (
  SELECT route_id, k, CASE k
    WHEN 1 THEN 'HTTP destination requires an endpoint'
    WHEN 2 THEN 'HTTP destination requires auth, but no API key or basic auth was provided'
    WHEN 4 THEN 'Invalid syslog protocol: icmp (use ''udp'' or ''tcp'')'
    WHEN 5 THEN 'Syslog destination requires ''host'' field'
    WHEN 7 THEN 'Elasticsearch destination requires ''index'' field'
    WHEN 10 THEN 'File destination requires ''path'' field'
    WHEN 11 THEN 'Invalid match_on regex ''[invalid'': unclosed character class'
    WHEN 12 THEN 'Invalid exclude_on regex ''(?=x)'': look-around is not supported'
    WHEN 13 THEN 'polling_frequency_ms must be at least 1'
    WHEN 14 THEN 'Unknown destination type: unknown' END AS error
  FROM supplied)
SELECT route_id, error IS NULL AS valid, error,
  CASE k WHEN 3 THEN 'empty api_key hides the basic credentials' END AS warning
FROM judged"""

ORACLES["route_flags"] = f"""
WITH {_SUPPLIED}
SELECT route_id, k IN (0, 3) AS has_auth, k NOT IN (8, 11, 12) AS is_passthrough FROM supplied"""

ORACLES["request_header_rows"] = f"""
WITH {_SUPPLIED}
SELECT route_id, 'Content-Type' AS name,
  CASE kind WHEN 'http' THEN 'application/json' ELSE 'application/x-ndjson' END AS value
FROM supplied WHERE kind IN ('http', 'elasticsearch')
UNION ALL
SELECT route_id, 'Authorization', CASE k WHEN 0 THEN 'Bearer key' ELSE 'Bearer ' END
FROM supplied WHERE k IN (0, 2, 3)"""

# -- delivery -----------------------------------------------------------------

_DESTINATIONS = """
dests(route_id, type, url) AS (VALUES
  (0, 'http', 'http://collector:8000/ingest'),
  (1, 'elasticsearch', 'http://search:9200/_bulk'),
  (2, 'syslog', 'tcp://audit.local:514'),
  (3, 'syslog', 'udp://audit.local:514'),
  (4, 'file', '/backup/purchase.jsonl'),
  (5, 'http', 'http://collector:8000/idle'),
  (6, 'http', 'http://collector:8000/orders'))"""

ORACLES["dispatch"] = _batch_query(
    f"""SELECT route_id || '-' || batch_id || '-0' AS request_id, any_value(type) AS type, any_value(url) AS url,
  CASE WHEN any_value(type) = 'file' OR any_value(url) LIKE 'udp:%' THEN count(*) ELSE 1 END AS n_payloads,
  CASE WHEN any_value(type) = 'http' THEN CAST({_PAYLOAD} AS VARCHAR)
       WHEN any_value(type) = 'elasticsearch'
         THEN string_agg({_BULK.replace("idx", "'logs-errors'")}, '' ORDER BY "offset")
       WHEN any_value(type) = 'file'
         THEN string_agg(CAST(to_json({{'path': path, 'line': line}}) AS VARCHAR), chr(10) ORDER BY "offset")
       ELSE string_agg({_SYSLOG.format(host="web-1")}, chr(10) ORDER BY "offset")
         || CASE WHEN any_value(url) LIKE 'tcp:%' THEN chr(10) ELSE '' END END AS payload
FROM entries JOIN dests USING (route_id) GROUP BY route_id, batch_id""",
    _DESTINATIONS,
)

ORACLES["http_requests"] = _batch_query(
    f"""SELECT route_id || '-' || batch_id || '-0' AS request_id, any_value(url) AS url,
  CASE any_value(type) WHEN 'http' THEN 'application/json' ELSE 'application/x-ndjson' END AS content_type,
  CASE route_id WHEN 0 THEN 'Bearer k-123' WHEN 6 THEN 'Basic '
    || base64(encode('shop:a rather long password, long enough to be wrapped by base64')) END AS authorization,
  CASE any_value(type) WHEN 'http' THEN CAST({_PAYLOAD} AS VARCHAR)
    ELSE string_agg({_BULK.replace("idx", "'logs-errors'")}, '' ORDER BY "offset") END AS body
FROM entries JOIN dests USING (route_id) WHERE type IN ('http', 'elasticsearch') GROUP BY route_id, batch_id""",
    _DESTINATIONS,
)

_OUTCOMES = (
    """SELECT request_id, n_entries, error IS NULL AS ok,
  CAST(CASE WHEN type = 'syslog' THEN CASE WHEN error IS NULL THEN 200 END
            WHEN batch_id % 5 = 0 THEN 500
            WHEN error IS NOT NULL THEN 200 ELSE 201 END AS INTEGER) AS status, error
FROM (
  SELECT route_id || '-' || batch_id || '-0' AS request_id, n_entries, batch_id, type,
    CASE WHEN type = 'syslog' THEN CASE WHEN batch_id % 4 = 0 THEN 'ConnectionRefusedError: refused' END
         WHEN batch_id % 5 = 0 AND type = 'http' THEN 'HTTP 500 from ' || url || ': down'
         WHEN batch_id % 5 = 0 THEN 'Elasticsearch HTTP 500: down'
         WHEN type = 'elasticsearch' AND batch_id % 7 = 0
           THEN 'Elasticsearch bulk request contained errors' END AS error
  FROM flushes JOIN dests USING (route_id) WHERE type <> 'file')"""
)
ORACLES["delivery_outcomes"] = _batch_query(_OUTCOMES, _DESTINATIONS)

ORACLES["bulk_response_check"] = """
SELECT event_id, error IS NULL AS ok, error
FROM (
  SELECT event_id, CASE
    WHEN user_id % 10 = 3 THEN 'Elasticsearch HTTP 503: ' || CASE event_id % 8
      WHEN 0 THEN '{}' WHEN 1 THEN '{"errors":false}' WHEN 2 THEN '{"errors":"true"}' WHEN 3 THEN 'nope'
      WHEN 4 THEN '{"took":3,"errors":true}' WHEN 5 THEN '{"errors":null}' ELSE props END
    WHEN event_id % 8 = 3 THEN 'Elasticsearch response is not valid JSON'
    WHEN event_id % 8 = 4 THEN 'Elasticsearch bulk request contained errors' END AS error
  FROM events)"""

ORACLES["file_sink"] = _event_query(
    rf"""SELECT path, line FROM lines
WHERE {_LEVELS} AND NOT (regexp_matches(line, '\[test\]') OR regexp_matches(line, '\[dev\]'))"""
)

# -- whole jobs ---------------------------------------------------------------


def _job_query(select: str, *parts: str) -> str:
    """Batches of the lines that are valid UTF-8."""
    lines = _LINES.rstrip().removesuffix(")") + " WHERE event_id % 11 <> 3)"
    ctes = [lines, _ROUTES, _ROUTED, _TICKED, _FLUSHES, _ASSIGNED, *parts]
    return f"WITH RECURSIVE {','.join(ctes)} {select}"


ORACLES["ship_table_outcomes"] = _job_query(_OUTCOMES, _DESTINATIONS)
ORACLES["ship_table_files"] = _job_query("SELECT path, line FROM entries WHERE route_id = 4")
ORACLES["file_targets"] = _batch_query("SELECT route_id, path, line FROM entries")
ORACLES["ship_table_quarantine"] = _event_query(
    """SELECT path, "offset", CAST(strlen(line) + 1 AS BIGINT) AS n_bytes FROM lines
WHERE "offset" % 11 = 3"""
)

# -- streams ------------------------------------------------------------------

ORACLES["stream_dual_trigger"] = _route_query(
    """SELECT route_id, count(*) AS n_lines, count(*) AS n_labelled,
  count(DISTINCT line) AS n_distinct, CAST(sum(strlen(line)) AS BIGINT) AS n_bytes,
  true AS several, true AS gapless, true AS reasons_right
FROM routed GROUP BY route_id"""
)

# The same buffer with a tenth of the horizon as every route's poll period.
_STREAM_ROUTES = f"""{_ROUTES.replace("routes(", "given(", 1)},
routes AS (
  SELECT route_id, path, {HORIZON_MS // 10}::BIGINT AS freq,
    (150 * (1 + route_id % 4))::BIGINT AS size, 600000000::BIGINT AS every FROM given)"""
# What is there before the first poll comes with it, and polls go on until all lines have come.
_STREAM_TICKED = _TICKED.replace("arrival_us + freq", "greatest(arrival_us, 1) + freq").replace(
    " WHERE arrival_us > 0", ""
)
_STREAM_FLUSHES = _FLUSHES.replace(
    f"flush_at <= {HORIZON_MS}",
    f"flush_at <= greatest({HORIZON_MS}, (SELECT max(tick) FROM ticks))",
)
_STREAM_CTES = ",".join(
    [_LINES, _STREAM_ROUTES, _ROUTED, _STREAM_TICKED, _STREAM_FLUSHES, _ASSIGNED]
)
ORACLES["stream_table_buffer"] = f"""WITH RECURSIVE {_STREAM_CTES}
SELECT route_id, batch_id, any_value(flush_at) AS flush_at, any_value(reason) AS reason,
  count(*) AS n_entries, md5(string_agg(line, chr(10) ORDER BY tick, "offset")) AS lines_md5
FROM entries GROUP BY route_id, batch_id"""
ORACLES["stream_pending_lines"] = f"""WITH RECURSIVE {_STREAM_CTES}
SELECT route_id, "offset", line FROM assigned WHERE batch_id IS NULL"""
ORACLES["stream_flush_log"] = f"""WITH RECURSIVE {_STREAM_CTES}
SELECT route_id, reason, count(*) AS n_flushes, CAST(sum(n_entries) AS BIGINT) AS n_entries,
  max(n_entries) AS largest FROM flushes GROUP BY route_id, reason"""
