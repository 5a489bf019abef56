"""The same results in DuckDB's SQL, written apart from the Spark code: the chain is a recursive query here."""

from __future__ import annotations

from ..functions.crypto import EMPTY_SHA, EVENT_FIELDS, FIXTURE_KEY, pads
from ..operators import policy


def policy_headers() -> list[str]:
    """Header names of each kind, as a request may bring them."""
    return ["Content-Language", "expires", "Cookie", "X-Source", "x-my-Tag", "X-Other", "Sec-Fetch-Mode", ":path", "X-Robots-Tag", "CF-Ray", "pragma", "last-modified"]


_INNER, _OUTER = (p.hex() for p in pads(FIXTURE_KEY))
_NONE = "0" * 64


def _frame(label: str, value: str) -> str:
    return f"'{label}' || chr(0) || strlen({value}) || chr(0) || {value} || chr(0)"


def _mac(values: list[str]) -> str:
    message = " || ".join(_frame(n, v) for n, v in zip(EVENT_FIELDS, values, strict=True))
    return f"sha256(unhex('{_OUTER}') || unhex(sha256(unhex('{_INNER}') || encode({message}))))"


def _meta(content_type: str, headers: list[tuple[str, str]]) -> str:
    parts = [_frame("content-type", content_type)] + [f"{_frame('header-name', n)} || {_frame('header-value', v)}" for n, v in headers]
    return f"sha256(encode({' || '.join(parts)}))"


_DISK = "(3 * strlen({0}) - 2 * length(regexp_replace({0}, '[^\\x21-\\x7E]|[%./\\\\:*?\"<>|]', '', 'g')))"

#: Ops of the events table, lives, blocks and accepted ops.
_OPS = """
ops AS (SELECT event_id AS op_id, 'home/u/' || user_id AS world, strftime(ts, '%Y-%m-%dT%H:%M:%S.') || substr(strftime(ts, '%f'), 1, 3) || 'Z' AS timestamp,
  CASE WHEN event_type IN ('signup', 'purchase') THEN 'replace' WHEN event_type IN ('view', 'click') THEN 'append' ELSE 'delete' END AS verb,
  event_type AS kind, coalesce(props, '') AS body FROM events),
lives AS (SELECT *, coalesce(sum(CASE WHEN verb = 'delete' THEN 1 ELSE 0 END) OVER (PARTITION BY world ORDER BY op_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS tries FROM ops),
blocks AS (SELECT *, sum(CASE WHEN verb = 'replace' THEN 1 ELSE 0 END) OVER (PARTITION BY world, tries ORDER BY op_id)::BIGINT AS blk FROM lives),
judged_ops AS (SELECT *, verb = 'replace' OR blk > 0 AS ok FROM blocks),
counted AS (SELECT *, coalesce(sum(CASE WHEN verb = 'delete' AND ok THEN 1 ELSE 0 END) OVER (PARTITION BY world ORDER BY op_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS g FROM judged_ops),
accepted AS (SELECT *, substr(sha256(world || ':' || g), 1, 32) AS generation FROM counted),
bodies AS (SELECT op_id, world, g, generation, timestamp, CASE verb WHEN 'replace' THEN 'put' ELSE 'append' END AS event_type,
  string_agg(body, '') OVER (PARTITION BY world, g, blk ORDER BY op_id) AS full_body,
  first_value(kind) OVER (PARTITION BY world, g, blk ORDER BY op_id) AS kind,
  row_number() OVER (PARTITION BY world, g ORDER BY op_id) + 1 AS seq
  FROM accepted WHERE ok AND verb <> 'delete'),
last_op AS (SELECT world, max_by(g, op_id) AS g, max_by(verb, op_id) AS verb FROM accepted WHERE ok GROUP BY world),
live AS (SELECT world, substr(sha256(world || ':' || g), 1, 32) AS generation, g FROM last_op WHERE verb <> 'delete'),
stage AS (SELECT b.world, b.generation, max_by(b.full_body, b.seq) AS body, max_by(b.kind, b.seq) AS kind FROM bodies b JOIN live USING (world, generation) GROUP BY b.world, b.generation)
"""
#: The events with their hashes.
_ROWS = f"""
plain AS (
  SELECT op_id, world, generation, seq, timestamp, event_type, world AS target, sha256(full_body) AS body_sha256, strlen(full_body)::BIGINT AS size, 'application/json' AS content_type,
    {_meta("'application/json'", [("'x-kind'", "kind")])} AS meta_sha256 FROM bodies
  UNION ALL
  SELECT op_id, world, generation, 1, timestamp, 'format', world, '{EMPTY_SHA}', 0, '', {_meta("''", [("'format-version'", "'2'")])} FROM bodies WHERE seq = 2)
"""


def _chain(rows: str, name: str) -> str:
    c = lambda t: [f"{t}.world", f"{t}.timestamp", f"{t}.event_type", f"{t}.target", f"{t}.generation", f"{t}.body_sha256", f"{t}.size::VARCHAR", f"{t}.content_type", f"{t}.meta_sha256"]
    return f"""
{name} AS (
  SELECT r.*, '' AS prev_hmac, {_mac(["''", *c("r")])} AS hmac FROM {rows} r WHERE r.seq = 1
  UNION ALL
  SELECT r.*, c.hmac, {_mac(["c.hmac", *c("r")])} FROM {rows} r JOIN {name} c ON r.world = c.world AND r.generation = c.generation AND r.seq = c.seq + 1)
"""


_CHAIN = f"WITH RECURSIVE {_OPS}, {_ROWS}, {_chain('plain', 'chain')}"
_LIVE = f"{_CHAIN}, live_events AS (SELECT c.* FROM chain c JOIN live USING (world, generation))"
_STATE = f"WITH {_OPS}"
_KEPT = """
, numbered AS (SELECT *, row_number() OVER (PARTITION BY world, generation ORDER BY seq DESC) AS n FROM live_events WHERE event_type <> 'format'),
floors AS (SELECT world, generation, min(seq) AS floor FROM numbered WHERE n <= 3 GROUP BY ALL),
stored AS (SELECT world, generation, body_sha256, max(size) AS body_size, max(seq) AS last FROM numbered GROUP BY ALL),
kept AS (SELECT s.* FROM stored s JOIN floors USING (world, generation) WHERE s.last >= floor),
gone AS (SELECT s.* FROM stored s JOIN floors USING (world, generation) WHERE s.last < floor)
"""
_COLS = "world, generation, seq, timestamp, event_type, target, body_sha256, size, content_type, meta_sha256, hmac, prev_hmac"

_subject = [("'subject-body-sha256'", "h.body_sha256"), ("'subject-generation'", "h.generation"), ("'subject-hmac'", "'hmac-' || h.hmac"), ("'subject-seq'", "h.seq::VARCHAR"), ("'subject-world'", "h.world")]
_subject = [(n, f"({v})") for n, v in _subject]
_LEDGER = f"""{_CHAIN},
heads AS (SELECT world, generation, max_by(struct_pack(seq := seq, sha := body_sha256, hmac := hmac), seq) AS x FROM chain WHERE event_type <> 'format' GROUP BY ALL),
h AS (SELECT a.op_id, a.timestamp, a.world, a.generation, heads.x.seq AS seq, heads.x.sha AS body_sha256, heads.x.hmac AS hmac, row_number() OVER (ORDER BY a.op_id) AS n
  FROM accepted a JOIN heads USING (world, generation) WHERE a.verb = 'delete' AND a.ok),
ledger_plain AS (
  SELECT op_id, 'var/log/deletes' AS world, substr(sha256('var/log/deletes:0'), 1, 32) AS generation, 1::BIGINT AS seq, timestamp, 'format' AS event_type, 'var/log/deletes' AS target, '{EMPTY_SHA}' AS body_sha256, 0::BIGINT AS size, '' AS content_type, {_meta("''", [("'format-version'", "'2'")])} AS meta_sha256 FROM h WHERE n = 1
  UNION ALL
  SELECT op_id, 'var/log/deletes', substr(sha256('var/log/deletes:0'), 1, 32), 2 * n + k, timestamp, CASE k WHEN 0 THEN 'delete_intent' ELSE 'delete_commit' END, world, body_sha256, 0, '', {_meta("''", _subject)} FROM h, (VALUES (0), (1)) v(k)),
{_chain('ledger_plain', 'ledger')}"""
_FEED = f"""{_LEDGER},
changes AS (
  SELECT op_id, CASE WHEN event_type = 'format' THEN 0 ELSE 1 END AS part, world, CASE event_type WHEN 'put' THEN 'replace' ELSE event_type END AS verb, 'hmac-' || hmac AS etag, world || '@' || generation || '=' || seq AS cursor, size, seq FROM chain
  UNION ALL
  SELECT op_id, CASE event_type WHEN 'format' THEN 0 WHEN 'delete_intent' THEN 1 ELSE 3 END, world, CASE WHEN event_type = 'format' THEN 'format' ELSE 'delete' END, 'hmac-' || hmac, world || '@' || generation || '=' || seq, size, seq FROM ledger
  UNION ALL
  SELECT op_id, 2, target, 'delete', '', NULL, NULL, NULL FROM ledger WHERE event_type = 'delete_intent'),
delivered AS (SELECT row_number() OVER (ORDER BY op_id, part, seq) AS delivery_id, * FROM changes)"""

_WORLDS = """
w AS (SELECT 'home/u/' || user_id AS world FROM events UNION SELECT 'lib/src/' || source FROM documents UNION SELECT 'tmp/chat/' || conv_id FROM conversations UNION SELECT 'var/orders/' || o_custkey FROM orders)
"""
_CANDIDATES = """
WITH shapes AS (SELECT page_id AS id, unnest([
  'home/' || url, 'lib/' || replace(split_part(url, '://', -1), '/', '_'), 'var/log/' || page_id, 'tmp/%2E./' || page_id, 'foo/' || page_id, 'home/a\\' || page_id,
  'etc/é ü/' || page_id, 'home/' || chr(133) || page_id, 'var/log', '']) AS world, unnest(range(10)) AS shape FROM pages)
"""
_APPROVE = "(regexp_matches(world, '^(lib|etc|boot|usr|var/log)(/|$)'))"
_MEMORY = "regexp_matches(world, '^(tmp|dev|sys)/')"
_CHAT = "SELECT 'tmp/chat/' || conv_id AS world, string_agg(coalesce(text, ''), '' ORDER BY turn) AS body FROM conversations GROUP BY conv_id HAVING bool_or(turn = 0)"

_SPOILT = f"""{_CHAIN}, spoilt AS (SELECT * REPLACE (
    CASE WHEN t AND m = 0 THEN size + 1 ELSE size END AS size, CASE WHEN t AND m = 1 THEN '{_NONE}' ELSE hmac END AS hmac, CASE WHEN t AND m = 2 THEN '' ELSE prev_hmac END AS prev_hmac,
    CASE WHEN t AND m = 3 THEN 'home/x' ELSE target END AS target, CASE WHEN t AND m = 4 THEN 'rename' ELSE event_type END AS event_type,
    CASE WHEN t AND m = 5 THEN '2024-01-01 00:00:00.000Z' ELSE timestamp END AS timestamp, CASE WHEN t AND m = 6 THEN 'text/html' ELSE content_type END AS content_type)
  FROM (SELECT *, seq = 3 AS t, CAST(split_part(world, '/', -1) AS BIGINT) % 8 AS m FROM chain)),
real AS (SELECT s.*, b.kind, coalesce(lag(s.hmac) OVER w, '') AS linked, row_number() OVER w - 1 AS idx FROM spoilt s LEFT JOIN bodies b ON s.world = b.world AND s.generation = b.generation AND s.seq = b.seq WINDOW w AS (PARTITION BY s.world, s.generation ORDER BY s.seq)),
hashed AS (SELECT *, CASE WHEN seq = 1 THEN {_meta("content_type", [("'format-version'", "'2'")])} ELSE {_meta("content_type", [("'x-kind'", "kind")])} END AS real_meta,
  {_mac(["linked", "world", "timestamp", "event_type", "target", "generation", "body_sha256", "size::VARCHAR", "content_type", "meta_sha256"])} AS real_hmac FROM real),
checked AS (SELECT *, CASE
    WHEN event_type NOT IN ('put', 'append', 'format') THEN ['known-event-type', 'event-type-' || event_type]
    WHEN target <> world THEN ['target-' || world, 'target-' || target]
    WHEN prev_hmac <> linked THEN ['hmac-' || linked, 'hmac-' || prev_hmac]
    WHEN meta_sha256 <> real_meta THEN ['meta-sha256-' || real_meta, 'meta-sha256-' || meta_sha256]
    WHEN NOT regexp_full_match(timestamp, '\\d{{4}}-\\d\\d-\\d\\dT\\d\\d:\\d\\d:\\d\\d\\.\\d{{3}}Z') THEN ['timestamp-sqlite-utc-ms', 'timestamp-' || timestamp]
    WHEN hmac <> real_hmac THEN ['hmac-' || real_hmac, 'hmac-' || hmac] END AS broken FROM hashed)"""

#: What is in use after each op: of each chain the current body and the distinct ones of its last three body events.
_USED = f"""{_STATE}, shas AS (SELECT op_id, world, generation, seq, strlen(full_body) AS n, sha256(full_body) AS sha FROM bodies),
last_three AS (SELECT DISTINCT b.op_id, b.world, b.generation, b.seq, b.n AS now, x.sha, x.n FROM shas b JOIN shas x ON x.world = b.world AND x.generation = b.generation AND x.seq BETWEEN b.seq - 2 AND b.seq),
held AS (SELECT op_id, world, generation, seq, max(now) + sum(n) AS held FROM last_three GROUP BY ALL),
grows AS (SELECT op_id, world, held - coalesce(lag(held) OVER (PARTITION BY world, generation ORDER BY seq), 0) AS grown FROM held
  UNION ALL SELECT a.op_id, a.world, -max_by(h.held, h.seq) FROM accepted a JOIN held h USING (world, generation) WHERE a.verb = 'delete' AND a.ok GROUP BY ALL),
used AS (SELECT op_id, world, grown::BIGINT AS grown, sum(grown) OVER (ORDER BY op_id)::BIGINT AS used FROM grows)"""

#: The ledger in usage reports, from the number of deletes alone.
_LEDGER_USE = "(SELECT 'var/log/deletes' AS world, 0 AS total, 0 AS current, 0 AS retained, (1 + 2 * count(*))::BIGINT AS events FROM accepted WHERE verb = 'delete' AND ok HAVING count(*) > 0)"
_quoted = lambda names: ", ".join(f"'{n}'" for n in names)
_HEADERS, _NEVER, _DEFAULT = _quoted(policy_headers()), _quoted(policy.NEVER), _quoted(policy.DEFAULT)

ORACLES = {
    "world_validity": f"""{_CANDIDATES} SELECT id, shape::INTEGER AS shape, CASE
      WHEN world = '' THEN 'world path is empty' WHEN {_DISK.format('world')} > 200 THEN 'world path is too long'
      WHEN world IN ('home', 'tmp', 'dev', 'sys', 'etc', 'lib', 'boot', 'usr', 'var', 'proc', 'var/log') OR starts_with(world, 'proc/') THEN 'world path is a reserved namespace root'
      WHEN contains(world, '\\') THEN 'world path contains backslash' WHEN regexp_matches(world, '\\p{{Cc}}') THEN 'world path contains control bytes'
      WHEN list_contains(string_split(world, '/'), '') THEN 'world path has empty segment'
      WHEN regexp_matches(world, '(?i)(^|/)(\\.|%2e){{1,2}}(/|$)') THEN 'world path contains dot or encoded-dot segment'
      WHEN NOT regexp_matches(world, '^(home|tmp|dev|sys|etc|lib|boot|usr|var)/') THEN 'world path is outside the namespaces' END AS reason FROM shapes""",
    "world_disk_name_len": None,
    "world_namespace_class": f"WITH {_WORLDS} SELECT world, split_part(world, '/', 1) AS namespace, CASE WHEN {_MEMORY} THEN 'memory' ELSE 'durable' END AS storage, {_APPROVE} AS needs_approve FROM w",
    "write_gate_matrix": f"""WITH {_WORLDS}, t AS (SELECT world, tier FROM (SELECT world FROM w UNION ALL VALUES ('var/log/deletes'), ('var/log/other'), ('etc/x')) x(world), (VALUES ('anon'), ('read'), ('write'), ('approve')) y(tier))
      SELECT world, tier, CASE WHEN tier = 'approve' OR (tier = 'write' AND NOT {_APPROVE}) THEN CASE WHEN world = 'var/log/deletes' THEN 'append_only' ELSE 'ok' END WHEN {_APPROVE} THEN 'auth_write_approve' ELSE 'auth_write' END AS write_status,
        CASE WHEN tier <> 'approve' THEN 'auth_delete' WHEN world = 'var/log/deletes' THEN 'append_only' ELSE 'ok' END AS delete_status FROM t""",
    "list_worlds": f"{_STATE} SELECT world FROM live UNION SELECT 'tmp/chat/' || conv_id FROM conversations WHERE turn = 0 UNION SELECT 'var/log/deletes' FROM accepted WHERE verb = 'delete' AND ok",
    "prefix_list": "SELECT DISTINCT 'var/orders/' || o_custkey AS world FROM orders WHERE starts_with(o_custkey::VARCHAR, '1')",
    "prefix_list_bounded": """SELECT world FROM (SELECT *, count(*) OVER () AS n FROM (SELECT DISTINCT 'lib/src/' || source AS world FROM documents WHERE starts_with(source, 'src1'))) WHERE n <= 50
      UNION ALL SELECT world FROM (SELECT *, count(*) OVER () AS n FROM (SELECT DISTINCT 'var/orders/' || o_custkey AS world FROM orders)) WHERE n <= 50""",
    "body_sha256": "SELECT doc_id, sha256(text) AS body_sha256, strlen(text) AS size FROM documents",
    "meta_sha256": f"SELECT doc_id, {_meta(chr(39) + 'text/plain; charset=utf-8' + chr(39), [(chr(39) + 'x-lang' + chr(39), 'lang'), (chr(39) + 'x-source' + chr(39), 'source')])} AS meta_sha256 FROM documents",
    "event_hmac_single": f"SELECT doc_id, {_mac([chr(39) * 2, 'source', chr(39) + '2024-01-01T00:00:00.000Z' + chr(39), chr(39) + 'put' + chr(39), 'source', 'lang', 'sha256(text)', 'strlen(text)::VARCHAR', 'text', 'lang'])} AS hmac FROM documents",
    "etag_memory": f"SELECT world, 'sha256-' || sha256(body) AS etag FROM ({_CHAT})",
    "op_accept": f"{_STATE} SELECT op_id, world, verb, CASE WHEN ok THEN 'ok' ELSE 'not_found' END AS status FROM accepted",
    "op_incarnation": f"{_STATE} SELECT op_id, world, g, blk, generation FROM accepted",
    "append_body_fold": f"{_STATE} SELECT op_id, world, seq, event_type, sha256(full_body) AS body_sha256, strlen(full_body) AS size FROM bodies",
    "stage_current": f"{_STATE} SELECT world, generation, body, 'application/json' AS content_type, kind FROM stage",
    "head_metadata": f"{_LIVE} SELECT s.world, strlen(s.body) AS length, 'application/json' AS content_type, 'hmac-' || max_by(e.hmac, e.seq) AS etag FROM stage s JOIN live_events e USING (world, generation) GROUP BY ALL",
    "byte_range": """WITH s AS (SELECT 'lib/src/' || source AS world, encode(max_by(coalesce(text, ''), doc_id)) AS body FROM documents GROUP BY source),
      t AS (SELECT *, octet_length(body) AS n FROM s, (VALUES ('bytes=0-4', 0, 4), ('bytes=5-', 5, NULL), ('bytes=-3', -3, NULL), ('bytes=0-1,3-4', NULL, NULL), ('bytes=9999999-', 9999999, NULL), ('bytes=4-2', NULL, NULL), ('bytes=-0', NULL, NULL), ('lines=1-2', NULL, NULL)) v(spec, a, b)),
      u AS (SELECT *, CASE WHEN spec = 'bytes=0-1,3-4' THEN 200 WHEN a IS NULL OR n = 0 OR a >= n THEN 416 ELSE 206 END AS status, CASE WHEN a < 0 THEN greatest(n + a, 0) ELSE a END AS f, least(coalesce(b, n - 1), n - 1) AS l FROM t)
      SELECT world, spec, status::BIGINT AS status, CASE WHEN status = 206 THEN f END::BIGINT AS first, CASE WHEN status = 206 THEN l END::BIGINT AS last,
        CASE status WHEN 200 THEN sha256(body) WHEN 206 THEN sha256(array_slice(body, f::BIGINT + 1, l::BIGINT + 1)) END AS part_sha256 FROM u""",
    "chain_build": f"{_CHAIN} SELECT {_COLS} FROM chain",
    "chain_verify_ok": f"{_CHAIN} SELECT world, generation, count(*) AS events, min_by(hmac, seq) AS genesis, max_by(hmac, seq) AS latest, NULL::BIGINT AS break_at, NULL::VARCHAR AS expected, NULL::VARCHAR AS actual FROM chain GROUP BY world, generation",
    "chain_verify_tampered": f"""{_SPOILT} SELECT world, generation, count(*) AS events, min(idx) FILTER (broken IS NOT NULL) AS break_at,
      min_by(broken[1], idx) FILTER (broken IS NOT NULL) AS expected, min_by(broken[2], idx) FILTER (broken IS NOT NULL) AS actual FROM checked GROUP BY world, generation""",
    "chain_tail_verify": f"{_SPOILT} SELECT world, generation, seq, prev_hmac = linked AND hmac = real_hmac AS ok FROM hashed QUALIFY row_number() OVER (PARTITION BY world, generation ORDER BY seq DESC) = 1",
    "chain_head": f"{_LIVE} SELECT world, generation, count(*) AS seq, 'hmac-' || max_by(hmac, seq) AS hmac FROM live_events GROUP BY world, generation",
    "chain_head_broken": f"{_SPOILT} SELECT world, generation, count(*) AS seq, 'hmac-' || max_by(hmac, seq) AS hmac FROM checked GROUP BY world, generation HAVING count(broken) = 0",
    "chain_stamp": f"{_LIVE} SELECT world, generation, 3::BIGINT AS requested, max(top) AS observed, 'hmac-' || max(hmac) FILTER (seq = 3) AS hmac FROM (SELECT *, count(*) OVER (PARTITION BY world, generation) AS top FROM live_events) GROUP BY world, generation HAVING max(top) >= 3",
    "chain_stamp_missing": f"{_LIVE} SELECT world, generation, 6::BIGINT AS requested, count(*) AS observed FROM live_events GROUP BY world, generation HAVING count(*) < 6",
    "live_body_check": f"{_STATE} SELECT world, generation, NOT ends_with(world, '7') AS ok FROM stage",
    "dereference_mixed": f"""{_LIVE} {_KEPT}, coords AS (SELECT CASE WHEN k = 2 THEN 'home/u/none' ELSE world END AS world, CASE WHEN k = 3 THEN repeat('f', 32) ELSE generation END AS generation,
        CASE WHEN k = 1 THEN seq + 1000 ELSE seq END AS seq, CASE WHEN k = 4 THEN '{_NONE}' ELSE body_sha256 END AS body_sha256, k, event_type AS kind, size AS n, body_sha256 AS real_sha, world AS w, generation AS g FROM (SELECT *, seq % 7 AS k FROM live_events)),
      judged AS (SELECT c.*, CASE WHEN k = 2 THEN 'unproven_coordinate' WHEN k = 3 THEN 'generation_mismatch' WHEN k = 1 THEN 'missing_row' WHEN kind = 'format' THEN 'non_body_event' WHEN k = 4 THEN 'body_hash_mismatch'
        WHEN EXISTS (SELECT 1 FROM kept WHERE kept.world = c.w AND kept.generation = c.g AND kept.body_sha256 = c.real_sha) THEN 'body' ELSE 'expired' END AS outcome FROM coords c)
      SELECT world, generation, seq, body_sha256, outcome, CASE outcome WHEN 'body' THEN 200 WHEN 'expired' THEN 410 WHEN 'generation_mismatch' THEN 409 WHEN 'body_hash_mismatch' THEN 409 ELSE 404 END::BIGINT AS status, CASE WHEN outcome = 'body' THEN n END AS size FROM judged""",
    "latest_body_head": f"{_LIVE} SELECT world, generation, seq, body_sha256, 'hmac-' || hmac AS hmac FROM live_events WHERE event_type <> 'format' QUALIFY row_number() OVER (PARTITION BY world, generation ORDER BY seq DESC) = 1",
    "expired_rows": f"{_LIVE} {_KEPT} SELECT n.world, n.generation, n.seq, n.body_sha256 FROM numbered n SEMI JOIN gone USING (world, generation, body_sha256)",
    "cas_dedup": "SELECT DISTINCT 'lib/src/' || source AS world, sha256(coalesce(text, '')) AS body_sha256, strlen(coalesce(text, ''))::BIGINT AS body_size FROM documents",
    "retention_floor": f"{_LIVE} {_KEPT} SELECT world, generation, floor FROM floors",
    "retention_prune": f"{_LIVE} {_KEPT} SELECT world, generation, body_sha256, body_size FROM kept",
    "pruned_bytes": f"{_LIVE} {_KEPT} SELECT world, count(*) AS bodies, sum(body_size)::BIGINT AS bytes FROM gone GROUP BY world",
    "unreferenced_cas": f"{_STATE} SELECT DISTINCT world, generation, sha256(world) AS body_sha256 FROM bodies SEMI JOIN live USING (world, generation)",
    "du": f"""{_LIVE} {_KEPT}, e AS (SELECT world, count(*) AS events FROM live_events GROUP BY world), k AS (SELECT world, sum(body_size)::BIGINT AS retained FROM kept GROUP BY world)
      SELECT world, strlen(body) + coalesce(retained, 0) AS total, strlen(body) AS current, coalesce(retained, 0) AS retained, events FROM stage LEFT JOIN e USING (world) LEFT JOIN k USING (world)
      UNION ALL SELECT * FROM {_LEDGER_USE} UNION ALL SELECT world, strlen(body), strlen(body), 0, 0 FROM ({_CHAT})""",
    "df": f"""{_LIVE} {_KEPT}, c AS (SELECT (SELECT coalesce(sum(strlen(body)), 0) FROM stage)::BIGINT AS current, (SELECT coalesce(sum(body_size), 0) FROM kept)::BIGINT AS retained,
        ((SELECT count(*) FROM live_events) + (SELECT coalesce(sum(events), 0) FROM {_LEDGER_USE}))::BIGINT AS events, (SELECT count(*) FROM ({_CHAT})) AS chats,
        (SELECT coalesce(sum(192 + strlen(world) + strlen(body) + strlen('text/plain') + strlen('x-kind') + strlen('chat')), 0) FROM ({_CHAT}))::BIGINT AS memory_used)
      SELECT ((SELECT count(*) FROM stage) + chats)::BIGINT AS worlds, current + retained AS used, current, retained, events, 1000000000::BIGINT AS quota, greatest(1000000000 - current - retained, 0)::BIGINT AS free,
        memory_used, 268435456::BIGINT AS memory_quota, greatest(268435456 - memory_used, 0)::BIGINT AS memory_free FROM c""",
    "du_lines": f"""{_LIVE} {_KEPT}, e AS (SELECT world, count(*) AS events FROM live_events GROUP BY world), k AS (SELECT world, sum(body_size)::BIGINT AS retained FROM kept GROUP BY world)
      SELECT world || chr(9) || (strlen(body) + coalesce(retained, 0)) || chr(9) || strlen(body) || chr(9) || coalesce(retained, 0) || chr(9) || events || chr(10) AS line FROM stage LEFT JOIN e USING (world) LEFT JOIN k USING (world)""",
    "metadata_guard": "SELECT conv_id, turn, CASE WHEN regexp_matches(coalesce(text, ''), '[\\x00\\r\\n]') OR regexp_matches(coalesce(role, ''), '[\\x00\\r\\n]') OR turn % 3 = 1 THEN 'invalid_metadata' ELSE 'ok' END AS status FROM conversations",
    "header_policy": f"""WITH h AS (SELECT doc_id, source, unnest([{_HEADERS}]) AS given FROM documents), l AS (SELECT *, lower(given) AS name FROM h)
      SELECT doc_id, given, CASE WHEN NOT regexp_matches(name, '^(sec-|access-control-request-|want-|:|x-b3-|x-amzn-|cf-|x-timeline-)') AND NOT list_contains([{_NEVER}], name) AND name <> 'expires'
        AND (list_contains([{_DEFAULT}], name) OR name = 'x-source' OR starts_with(name, 'x-my-')) THEN name || '=' || source ELSE '' END AS stored FROM l""",
    "canonical_path": "SELECT page_id, shape::INTEGER AS shape, CASE WHEN list_contains(['home', 'tmp', 'dev', 'sys', 'etc', 'lib', 'boot', 'usr', 'var', 'proc'], split_part(ltrim(given, '/'), '/', 1)) THEN ltrim(given, '/') ELSE 'home/' || ltrim(given, '/') END AS world FROM (SELECT page_id, unnest(['/' || split_part(url, '://', -1), '//tmp/' || page_id, 'proc/' || page_id, '/home/tmp/' || page_id, 'homely/' || page_id]) AS given, unnest(range(5)) AS shape FROM pages)",
    "read_gate": "SELECT tier, has_read_token, CASE WHEN has_read_token AND tier = 'anon' THEN 'auth_read' ELSE 'ok' END AS status, CASE WHEN has_read_token AND tier = 'anon' THEN 401 ELSE 200 END::BIGINT AS http FROM (VALUES ('anon'), ('read'), ('write'), ('approve')) t(tier), (VALUES (true), (false)) r(has_read_token)",
    "read_not_modified": f"""WITH c AS (SELECT world, 'sha256-' || sha256(body) AS etag FROM ({_CHAT})) SELECT world, shape::INTEGER AS shape, CASE WHEN shape IN (0, 1, 2, 3) THEN 304 ELSE 200 END::BIGINT AS http FROM c, range(8) r(shape)""",
    "op_http_status": f"{_STATE} SELECT op_id, CASE WHEN ok THEN 200 ELSE 404 END::BIGINT AS http FROM accepted",
    "memory_charge": f"SELECT world, 192 + strlen(world) + strlen(body) + strlen('text/plain') + strlen('x-kind') + strlen('chat') AS charged, strlen(body) AS body_bytes FROM ({_CHAT})",
    "quota_running": f"""{_STATE}, g AS (SELECT op_id, world, strlen(full_body) - coalesce(lag(strlen(full_body)) OVER (PARTITION BY world, g ORDER BY seq), 0)
        + CASE WHEN row_number() OVER (PARTITION BY world, g, sha256(full_body) ORDER BY seq) = 1 THEN strlen(full_body) ELSE 0 END AS grown FROM bodies)
      SELECT op_id, world, grown::BIGINT AS grown, sum(grown) OVER (ORDER BY op_id)::BIGINT AS used FROM g""",
    "storage_used": f"{_USED} SELECT * FROM used",
    "quota_decisions": f"""{_USED}, first AS (SELECT min(op_id) AS first FROM used WHERE grown > 0 AND used > 900)
      SELECT op_id, world, grown, CASE WHEN op_id = first THEN used - grown ELSE used END AS used, CASE WHEN op_id = first THEN 'quota_exceeded' ELSE 'ok' END AS status FROM used, first WHERE first IS NULL OR op_id <= first""",
    "world_limits": """WITH RECURSIVE o AS (SELECT event_id AS op_id, 'home/u/' || user_id AS world, CASE WHEN event_type IN ('signup', 'purchase') THEN 'replace' WHEN event_type IN ('view', 'click') THEN 'append' ELSE 'delete' END AS verb,
        strlen(coalesce(props, '')) AS n, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events),
      f AS (SELECT op_id, world, k, CASE WHEN verb <> 'replace' THEN 'not_found' WHEN n > 60 THEN 'too_large' ELSE 'ok' END AS status, CASE WHEN verb = 'replace' AND n <= 60 THEN n END AS held FROM o WHERE k = 1
        UNION ALL
        SELECT o.op_id, o.world, o.k, CASE WHEN verb = 'replace' THEN CASE WHEN n > 60 THEN 'too_large' ELSE 'ok' END WHEN held IS NULL THEN 'not_found' WHEN verb = 'append' AND held + n > 60 THEN 'too_large' ELSE 'ok' END,
          CASE verb WHEN 'replace' THEN CASE WHEN n > 60 THEN held ELSE n END WHEN 'append' THEN CASE WHEN held + n > 60 THEN held ELSE held + n END END
        FROM f JOIN o ON o.world = f.world AND o.k = f.k + 1)
      SELECT op_id, world, status FROM f""",
    "append_or_create": f"""{_STATE}, c AS (SELECT *, lag(verb) OVER (PARTITION BY world ORDER BY op_id) AS prior FROM ops)
      SELECT 2 * op_id + 1 AS op_id, world, verb, CASE WHEN verb = 'delete' AND coalesce(prior, 'delete') = 'delete' THEN 'not_found' ELSE 'ok' END AS status FROM c
      UNION ALL SELECT 2 * op_id, world, 'replace', 'ok' FROM c WHERE verb = 'append' AND coalesce(prior, 'delete') = 'delete'""",
    "verify_complete": f"""{_LIVE} {_KEPT}, r AS (SELECT world, generation, count(*) AS events, min_by(hmac, seq) AS genesis, max_by(hmac, seq) AS latest, max_by(body_sha256, seq) AS sha FROM live_events GROUP BY ALL),
      j AS (SELECT r.*, floor, s.body, CASE right(world, 1) WHEN '5' THEN 5 WHEN '3' THEN 3 WHEN '7' THEN 7 END AS k FROM r JOIN floors USING (world, generation) JOIN stage s USING (world, generation))
      SELECT world, generation, events, genesis, latest, CASE WHEN k = 7 THEN events - 1 WHEN k IS NOT NULL THEN events END AS break_at,
        CASE k WHEN 5 THEN 'body-bearing event at first_retained_seq ' || (floor + 1000) WHEN 3 THEN 'all CAS bodies referenced by retained events' WHEN 7 THEN 'live-body-sha256-' || sha END AS expected,
        CASE k WHEN 5 THEN 'missing-retention-floor-event' WHEN 3 THEN 'unreferenced-cas-body' WHEN 7 THEN 'live-body-sha256-' || sha256(body || 'x') END AS actual FROM j
      UNION ALL SELECT 'home/none', '{"0" * 32}', 0, NULL, NULL, 0, 'at-least-one-event', 'no-events'""",
    "verify_since": f"""{_CHAIN}, m AS (SELECT world, generation, hmac AS real, CASE WHEN right(world, 1) = '1' THEN '{_NONE}' ELSE hmac END AS seen, CASE WHEN right(world, 1) = '2' THEN 1003 ELSE 3 END AS mark FROM chain WHERE seq = 3),
      r AS (SELECT c.world, c.generation, any_value(seen) AS seen, any_value(real) AS real, count(*) FILTER (mark IS NULL OR seq > mark) AS events, max_by(hmac, seq) FILTER (mark IS NULL OR seq > mark) AS newest FROM chain c LEFT JOIN m USING (world, generation) GROUP BY ALL)
      SELECT world, generation, events, coalesce(newest, seen) AS latest, CASE WHEN k > 0 THEN 0 END::BIGINT AS break_at, CASE WHEN k > 0 THEN 'hmac-' || seen END AS expected, CASE k WHEN 1 THEN 'hmac-' || real WHEN 2 THEN 'no-events' END AS actual
      FROM (SELECT *, CASE WHEN seen IS NULL THEN 0 WHEN right(world, 1) = '1' THEN 1 WHEN right(world, 1) = '2' THEN 2 ELSE 0 END AS k FROM r)""",
    "delete_ledger": f"{_LEDGER} SELECT {_COLS} FROM ledger",
    "delete_subject_proof": f"{_LEDGER} SELECT op_id, world, generation, seq, 'hmac-' || hmac AS subject_hmac, true AS valid FROM h",
    "recreate_generation": f"{_STATE} SELECT world, generation, dense_rank() OVER (PARTITION BY world ORDER BY g) AS life, min(op_id) AS first_op, count(*) AS events FROM bodies GROUP BY world, generation, g",
    "change_feed": f"{_FEED} SELECT delivery_id, op_id, world, verb, etag, cursor, size FROM delivered",
    "pattern_match": f"""{_STATE}, c AS (SELECT world, CASE event_type WHEN 'put' THEN 'replace' ELSE 'append' END AS verb FROM bodies UNION ALL SELECT world, 'format' FROM bodies WHERE seq = 2)
      SELECT pattern, verb, count(*) AS n FROM c, (VALUES ('*', '%'), ('home/u/1*', 'home/u/1%'), ('/home/u/10', 'home/u/10'), ('home/u/', 'home/u/')) p(pattern, l) WHERE world LIKE l GROUP BY ALL""",
    "replay_after": f"""{_LIVE}, n AS (SELECT *, count(*) OVER (PARTITION BY world, generation) AS k FROM live_events WHERE seq > 2)
      SELECT world, generation, 'replay' AS status, seq, event_type, 'hmac-' || hmac AS etag FROM n WHERE k <= 20 UNION ALL SELECT DISTINCT world, generation, 'ring_miss', NULL, NULL, NULL FROM n WHERE k > 20""",
    "resume_wildcard": f"""{_FEED}, t AS (SELECT max(delivery_id) AS top FROM delivered)
      SELECT cursor, CASE WHEN delivery_id > top - 512 THEN 'replay' ELSE 'ring_miss' END AS outcome, CASE WHEN delivery_id > top - 512 THEN top - delivery_id END AS replayed FROM delivered, t WHERE cursor IS NOT NULL AND delivery_id % 50 = 0""",
    "resume_outcome": f"""{_STATE}, t AS (SELECT world, generation, max(seq) AS top FROM bodies JOIN live USING (world, generation) GROUP BY ALL),
      r AS (SELECT t.*, kind, CASE kind WHEN 'other_world' THEN 'home/u/other' ELSE world END AS exact, world || '@' || CASE kind WHEN 'old_generation' THEN repeat('a', 32) ELSE generation END || '=' || mark AS cursor, mark,
        CASE WHEN kind = 'other_world' THEN 'ring_miss' WHEN kind = 'old_generation' THEN 'incarnation' WHEN mark > top THEN 'truncation' WHEN top - mark > 5 THEN 'ring_miss' ELSE 'replay' END AS outcome
        FROM t, (VALUES ('good', 2), ('old_generation', 2), ('no_marker', 9999), ('other_world', 2), ('from_start', 1)) v(kind, mark))
      SELECT kind, exact, cursor, outcome, CASE WHEN outcome = 'replay' THEN top - mark END AS replayed FROM r""",
    "ring_window": f"{_FEED} SELECT delivery_id, world, verb FROM delivered WHERE delivery_id > (SELECT max(delivery_id) FROM delivered) - 512",
    "sse_frame": f"""{_LIVE}, f AS (SELECT world, seq, 'event: ' || CASE event_type WHEN 'put' THEN 'put' WHEN 'append' THEN 'post' ELSE 'format' END || chr(10) || 'data: path: /' || world || chr(10) ||
        'data: method: ' || CASE event_type WHEN 'put' THEN 'PUT' WHEN 'append' THEN 'POST' ELSE 'FORMAT' END || chr(10) || 'data: etag: hmac-' || hmac || chr(10) ||
        CASE WHEN event_type <> 'format' THEN 'data: timeline-world: ' || world || chr(10) || 'data: timeline-generation: ' || generation || chr(10) || 'data: timeline-seq: ' || seq || chr(10) || 'data: timeline-body-sha256: ' || body_sha256 || chr(10) ELSE '' END ||
        'data: event-type: ' || event_type || chr(10) || 'data: target: /' || target || chr(10) || 'data: body-sha256: ' || body_sha256 || chr(10) || 'data: size: ' || size || chr(10) ||
        CASE WHEN content_type <> '' THEN 'data: content-type: ' || content_type || chr(10) ELSE '' END || 'id: ' || world || '@' || generation || '=' || seq || chr(10) || chr(10) AS frame FROM live_events)
      SELECT world, seq, sha256(frame) AS frame_sha256, length(frame) AS frame_chars FROM f""",
    "cursor_parse": """SELECT o_orderkey AS op_id, shape::INTEGER AS shape, status FROM orders, (VALUES (0, 'ok'), (1, 'non-canonical'), (2, 'seq-non-positive'), (3, 'seq-not-integer'), (4, 'missing-seq-delimiter'), (5, 'missing-generation-delimiter'),
      (6, 'invalid-world'), (7, 'memory-world'), (8, 'generation-wrong-length'), (9, 'generation-not-lower-hex'), (10, 'non-canonical'), (11, 'seq-out-of-range'), (12, 'ok')) v(shape, status)""",
    "stream_chain_equals_batch": None,
    "if_match_outcomes": None,
}
_ENCODED = "CASE WHEN regexp_full_match(c, '[\\x21-\\x7E]') AND NOT contains('%./\\:*?\"<>|', c) THEN c ELSE regexp_replace(hex(encode(c)), '(..)', '%\\1', 'g') END"
ORACLES["world_disk_name_len"] = f"""{_CANDIDATES}, parts AS (SELECT id, shape, world, unnest(string_split(world, '')) AS c, generate_subscripts(string_split(world, ''), 1) AS k FROM shapes WHERE world <> '')
  SELECT id, shape::INTEGER AS shape, any_value({_DISK.format('world')})::INTEGER AS disk_len, string_agg({_ENCODED}, '' ORDER BY k) AS disk_name FROM parts GROUP BY id, shape
  UNION ALL SELECT id, shape::INTEGER, 0, '' FROM shapes WHERE world = ''"""
ORACLES = {k: v for k, v in ORACLES.items() if v}
