"""DuckDB SQL for the queries, written apart from them."""

from __future__ import annotations

from ..functions.frames import TAGS
from ..operators.metrics import COUNTERS, GAUGES
from ..sources.samples import EVENT_COUNTERS
from .queries import BUILD_EVERY, CHECKPOINT, RATE, RATE_WINDOW_MS, RETAIN_BYTES, RETENTION_AGE_MS, RETENTION_NOW_MS

E_LOG = """e AS (SELECT event_id, ts, event_type AS topic, (user_id % 4)::INT AS "partition", row_number() OVER (PARTITION BY event_type, user_id % 4 ORDER BY ts, event_id) - 1 AS "offset",
  props AS payload, octet_length(encode(props)) + 12 AS record_size FROM events),
el AS (SELECT *, "offset" // 100 * 100 AS segment_base FROM e)"""
D_LOG = """d AS (SELECT lang AS topic, (doc_id % 4)::INT AS "partition", row_number() OVER (PARTITION BY lang, doc_id % 4 ORDER BY doc_id) - 1 AS "offset", text AS payload, octet_length(encode(text)) + 12 AS record_size FROM documents)"""
L_LOG = """l AS (SELECT l_returnflag AS topic, 0 AS "partition", row_number() OVER (PARTITION BY l_returnflag ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) - 1 AS "offset", l_suppkey, l_orderkey FROM lineitem),
lc AS (SELECT 'g' || (l_suppkey % 5) AS "group", topic, "partition", arg_max(l_orderkey % (11000 + 1000 * (l_suppkey % 5)), "offset") AS committed FROM l GROUP BY ALL),
lag AS (SELECT "group", topic, "partition", committed, n AS high_watermark, greatest(n - committed, 0) AS lag, greatest(n - committed, 0) > 10000 AS slow FROM lc JOIN (SELECT topic, count(*) AS n FROM l GROUP BY topic) USING (topic))"""
COMMITS = """c AS (SELECT 'g' || (user_id % 5) AS "group", event_type AS topic, (user_id % 4)::INT AS "partition", event_id % 50 AS "offset", event_id AS commit_seq FROM events),
cc AS (SELECT "group", topic, "partition", arg_max("offset", commit_seq) AS "offset" FROM c GROUP BY ALL)"""
PER_SEGMENT = """SELECT topic, "partition", segment_base, max("offset") AS max_offset, count(*) AS record_count, sum(record_size)::BIGINT AS size_bytes"""
SEGMENTS = f"""{E_LOG},
s AS (SELECT *, segment_base < max(segment_base) OVER (PARTITION BY topic, "partition") AS sealed FROM ({PER_SEGMENT}, epoch_us(max(ts)) // 1000 AS created_ms FROM el GROUP BY ALL))"""
KV = """kv AS (SELECT *, o AS "offset", o // 100 * 100 AS segment_base FROM (SELECT 'users' AS topic, (user_id % 4)::INT AS "partition", row_number() OVER (PARTITION BY user_id % 4 ORDER BY event_id) - 1 AS o, user_id::VARCHAR AS key,
  CASE WHEN event_type <> 'error' THEN props END AS value, event_id AS ingest_seq FROM events))"""
ELIGIBLE = f"""{KV},
ks AS (SELECT *, segment_base < max(segment_base) OVER (PARTITION BY topic, "partition") AS sealed FROM (SELECT topic, "partition", segment_base, max("offset") AS max_offset FROM kv GROUP BY ALL)),
ok AS (SELECT * FROM (SELECT *, max((max_offset >= 2000)::INT) OVER (PARTITION BY topic, "partition" ORDER BY segment_base) AS held FROM ks WHERE sealed AND NOT ("partition" = 1 AND segment_base <= {CHECKPOINT})) WHERE held = 0)"""
RESULT = f"""{ELIGIBLE},
ck AS (SELECT topic, "partition", key, count(*) AS n, max("offset") AS last FROM kv JOIN ok USING (topic, "partition", segment_base) GROUP BY ALL),
res AS (SELECT topic, "partition", (SELECT count(*) FROM ok WHERE ok."partition" = ck."partition") AS segments_rewritten, sum(n)::BIGINT AS records_in, count(*) AS records_kept, max(last) AS highest_compacted, (sum(n) - count(*))::BIGINT AS records_dropped FROM ck GROUP BY ALL)"""
LATENCIES = """ring AS (SELECT event_type AS kind, floor(value)::BIGINT AS nanos, row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) AS r FROM events),
v AS (SELECT kind, coalesce(list_sort(list(nanos) FILTER (nanos > 0)), []) AS v FROM ring WHERE r <= 1024 GROUP BY kind),
p AS (SELECT kind, len(v)::BIGINT AS n, coalesce(v[greatest(len(v) * 50 // 100, 1)], 0) AS p50, coalesce(v[greatest(len(v) * 95 // 100, 1)], 0) AS p95, coalesce(v[greatest(len(v) * 99 // 100, 1)], 0) AS p99 FROM v)"""
REQUESTS = """RECURSIVE r AS (SELECT user_id AS client, event_id AS seq, epoch_us(ts) // 1000 AS t, floor(value)::BIGINT AS bytes, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events)"""
RATED = f"""{REQUESTS},
f AS (SELECT client, seq, bytes, n, t AS start, CASE WHEN bytes <= {RATE} THEN bytes ELSE 0 END AS used, bytes <= {RATE} AS allowed FROM r WHERE n = 1
  UNION ALL SELECT r.client, r.seq, r.bytes, r.n, CASE WHEN r.t - start >= {RATE_WINDOW_MS} THEN r.t ELSE start END,
    CASE WHEN r.t - start >= {RATE_WINDOW_MS} THEN 0 ELSE used END + CASE WHEN CASE WHEN r.t - start >= {RATE_WINDOW_MS} THEN 0 ELSE used END + r.bytes <= {RATE} THEN r.bytes ELSE 0 END,
    CASE WHEN r.t - start >= {RATE_WINDOW_MS} THEN 0 ELSE used END + r.bytes <= {RATE} FROM f JOIN r ON r.client = f.client AND r.n = f.n + 1)"""
INDEX = f"""{E_LOG},
ix AS (SELECT topic, "partition", segment_base, "offset", position FROM (SELECT *, (sum(record_size) OVER w - record_size)::BIGINT AS position, row_number() OVER w - 1 AS n FROM el WINDOW w AS (PARTITION BY topic, "partition", segment_base ORDER BY "offset")) WHERE n % {BUILD_EVERY} = 0)"""
TARGETS = """t AS (SELECT event_id, event_type AS topic, (user_id % 4)::INT AS "partition", event_id % 700 - 20 AS target FROM events)"""
HEALTH = f"""{INDEX},
s AS ({PER_SEGMENT} FROM el GROUP BY ALL),
h AS (SELECT topic, "partition", segment_base, record_count, (record_count + {BUILD_EVERY - 1}) // {BUILD_EVERY} AS entries, CASE WHEN segment_base = 100 THEN 'missing' WHEN segment_base = 200 THEN 'invalid_size' WHEN segment_base = 300 AND max_offset >= 325 THEN 'invalid_entries' ELSE 'healthy' END AS status FROM s)"""
NATIONS = """topics AS (SELECT n_name AS name, (n_nationkey % 4 + 1)::INT AS partition_count FROM nation)"""


def _budget(rows: str, start: int, budget: int) -> str:
    return f"""SELECT * FROM (SELECT *, row_number() OVER w AS n, sum(record_size) OVER w AS total FROM {rows} WHERE "offset" >= {start} WINDOW w AS (PARTITION BY topic, "partition" ORDER BY "offset")) WHERE {budget} > 0 AND (n = 1 OR total <= {budget})"""


def _summary(rows: str, start: int, budget: int) -> str:
    """The answer to one request of each partition."""
    return f"""WITH {E_LOG},
    x AS (SELECT * FROM el WHERE {rows}), b AS (SELECT topic, "partition", min(segment_base) AS log_start, max("offset") + 1 AS log_end FROM x GROUP BY ALL),
    g AS (SELECT topic, "partition", count(*) AS n, sum(record_size)::BIGINT AS size, max("offset") AS last FROM ({_budget("x", start, budget)}) GROUP BY ALL),
    st AS (SELECT *, CASE WHEN {start} < log_start THEN 'out_of_range' WHEN {start} >= log_end THEN 'at_end' ELSE 'ok' END AS status FROM b)
    SELECT topic, "partition", {start}::BIGINT AS start, status, CASE WHEN status = 'ok' THEN coalesce(n, 0) ELSE 0 END AS n_records, CASE WHEN status = 'ok' THEN coalesce(size, 0) ELSE 0 END AS n_bytes,
      CASE WHEN status = 'ok' THEN coalesce(last + 1, {start}) ELSE {start} END::BIGINT AS next_offset, log_start FROM st LEFT JOIN g USING (topic, "partition")"""


def _group_fetch() -> str:
    return f"""{E_LOG}, {COMMITS},
    q AS (SELECT "group" || '/' || topic || '/' || "partition" AS request_id, topic, "partition", "offset" AS start FROM cc),
    got AS (SELECT request_id, "offset", payload, record_size FROM (SELECT request_id, e.*, row_number() OVER w AS n, sum(record_size) OVER w AS total FROM q JOIN e USING (topic, "partition") WHERE e."offset" >= start WINDOW w AS (PARTITION BY request_id ORDER BY e."offset")) WHERE n = 1 OR total <= 200)"""


def _counter_values() -> str:
    names = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in EVENT_COUNTERS.items())
    known = ", ".join(f"({i}, '{n}', '{'gauge' if n in GAUGES else 'counter'}', '{h}')" for i, (n, h) in enumerate(COUNTERS.items()))
    return f"""known(section, name, kind, help) AS (VALUES {known}), ev AS (SELECT CASE event_type {names} END AS name, floor(value)::BIGINT AS delta FROM events),
    vals AS (SELECT section, name, kind, help, coalesce(sum(delta), 0)::BIGINT AS value FROM known LEFT JOIN ev USING (name) GROUP BY ALL)"""


def _prometheus() -> str:
    quantiles = ", ".join(f"({len(COUNTERS) + 3 * i + j}, '{kind}', '{name}', '{title}', '{q}', '{word}')" for i, (kind, name, title) in enumerate((("view", "fetch", "Fetch"), ("click", "produce", "Produce"))) for j, (q, word) in enumerate((("p50", "50th"), ("p95", "95th"), ("p99", "99th"))))
    last = len(COUNTERS) + 6
    return f"""WITH {_counter_values()}, {E_LOG}, {COMMITS}, {LATENCIES},
    q(section, kind, name, title, q, word) AS (VALUES {quantiles}),
    marks AS (SELECT topic, "partition", count(*) AS n FROM e GROUP BY ALL),
    lines AS (SELECT section, '# HELP ' || name || ' ' || help || chr(10) || '# TYPE ' || name || ' ' || kind || chr(10) || name || ' ' || value AS line FROM vals
    UNION ALL SELECT section, '# HELP ' || m || ' ' || title || ' latency ' || word || ' percentile (ns)' || chr(10) || '# TYPE ' || m || ' gauge' || chr(10) || m || ' ' || v FROM (SELECT section, title, word, name || '_latency_ns_' || q AS m, CASE q WHEN 'p50' THEN p50 WHEN 'p95' THEN p95 ELSE p99 END AS v FROM q JOIN p USING (kind))
    UNION ALL SELECT {last}, '# HELP consumer_lag Consumer lag per partition and group' || chr(10) || '# TYPE consumer_lag gauge'
    UNION ALL SELECT {last + 1}, 'consumer_lag{{topic="' || topic || '",partition="' || "partition" || '",group="' || "group" || '"}} ' || greatest(n - "offset", 0) FROM cc JOIN marks USING (topic, "partition"))
    SELECT section::INT AS section, line FROM lines"""


def _request_rows() -> str:
    verbs = ", ".join(f"'{v}'" for v in sorted(TAGS))
    return f"""q AS (SELECT *, ([{verbs}])[(conv_id + turn) % {len(TAGS)} + 1] AS verb FROM conversations)"""


_LOCATED = "verb IN ('produce', 'fetch', 'commit', 'committed', 'describe_partition')"
_BARE = "verb IN ('list_topics', 'metrics', 'ping')"

SQL: dict[str, str] = {
    "produce_offsets": f'WITH {E_LOG} SELECT event_id, topic, "partition", "offset", record_size FROM e',
    "produce_ack": f'WITH {E_LOG} SELECT topic, "partition", min("offset") AS base_offset, count(*) AS record_count FROM e GROUP BY ALL',
    "produce_rejects": """WITH b AS (SELECT doc_id // 10 AS request_id, doc_id AS seq, CASE WHEN doc_id % 70 < 10 THEN 'nowhere' ELSE lang END AS topic, doc_id // 10 % 5 AS p, octet_length(encode(text)) > 10000 AS large FROM documents),
      x AS (SELECT *, topic = 'nowhere' OR p > 3 AS unknown, max(large::INT) OVER (PARTITION BY request_id ORDER BY seq) AS failed FROM b)
      SELECT request_id, count(*) FILTER (NOT unknown AND failed = 0) AS stored, count(*) FILTER (unknown OR failed = 1) AS refused, max(CASE WHEN unknown THEN 10 WHEN failed = 1 THEN 500 END)::INT AS code FROM x GROUP BY request_id""",
    "engine_produce_acks": """WITH o AS (SELECT doc_id // 10 AS request_id, lang AS topic, (doc_id // 10 % 4)::INT AS p, row_number() OVER (PARTITION BY lang, doc_id // 10 % 4 ORDER BY doc_id) - 1 AS o FROM documents WHERE lang IS NOT NULL)
      SELECT request_id, topic, p AS "partition", min(o) AS base_offset, count(*) AS record_count, NULL::INT AS code FROM o GROUP BY ALL""",
    "engine_compacted_log": """WITH o AS (SELECT (doc_id % 3)::INT AS p, concat_ws('/', lang, source) AS key, doc_id::VARCHAR AS value, row_number() OVER (PARTITION BY doc_id % 3 ORDER BY doc_id) - 1 AS o FROM documents),
      b AS (SELECT *, o // 64 * 64 AS base, max(o // 64 * 64) OVER (PARTITION BY p) AS top FROM o),
      k AS (SELECT * FROM b WHERE base < top QUALIFY row_number() OVER (PARTITION BY p, key ORDER BY o DESC) = 1)
      SELECT 'kept' AS topic, p AS "partition", min(o) OVER (PARTITION BY p) AS segment_base, o AS "offset", key, value FROM k
      UNION ALL SELECT 'kept', p, base, o, key, value FROM b WHERE base = top""",
    "oversize_rejects": f'WITH {D_LOG} SELECT topic, "partition", "offset", record_size FROM d WHERE record_size > 10012',
    "fetch_budget": f'WITH {E_LOG} SELECT topic, "partition", "offset", payload FROM ({_budget("e", 5, 300)})',
    "fetch_budget_docs": f'WITH {D_LOG} SELECT topic, "partition", "offset", record_size, sha256(payload) AS payload_sha256 FROM ({_budget("d", 2, 20000)})',
    "fetch_first_record_exempt": f'WITH {D_LOG} SELECT topic, "partition", "offset", record_size FROM ({_budget("d", 0, 1)})',
    "fetch_zero_budget": _summary("true", 5, 0),
    "fetch_past_end": _summary("true", 1_000_000_000, 300),
    "fetch_below_start": _summary("segment_base > 0", 5, 300),
    "fetch_across_gap": _summary("segment_base <> 100", 90, 600),
    "fetch_unknown_topic": f"""WITH {E_LOG}, b AS (SELECT "partition", count(*) AS log_end FROM e WHERE topic = 'click' GROUP BY ALL),
      q AS (SELECT n_nationkey::BIGINT AS request_id, CASE WHEN n_nationkey % 2 = 0 THEN 'click' ELSE n_name END AS topic, (n_nationkey % 7)::INT AS "partition" FROM nation),
      g AS (SELECT "partition", count(*) AS n, sum(record_size)::BIGINT AS size, max("offset") AS last FROM ({_budget("e", 1, 100)}) WHERE topic = 'click' GROUP BY ALL),
      x AS (SELECT q.*, topic = 'click' AND "partition" < 4 AS ok FROM q)
      SELECT request_id, topic, x."partition", 1::BIGINT AS start, CASE WHEN ok THEN 'ok' ELSE 'unknown_partition' END AS status, CASE WHEN NOT ok THEN 10 END AS code, CASE WHEN ok THEN n ELSE 0 END AS n_records, CASE WHEN ok THEN size ELSE 0 END AS n_bytes,
        CASE WHEN ok THEN last + 1 ELSE 1 END::BIGINT AS next_offset, CASE WHEN ok THEN 0::BIGINT END AS log_start FROM x LEFT JOIN g ON x."partition" = g."partition" AND ok""",
    "group_fetch": f'WITH {_group_fetch()} SELECT request_id, "offset", payload FROM got',
    "group_fetch_summary": f"""WITH {_group_fetch()}, ends AS (SELECT topic, "partition", count(*) AS log_end FROM e GROUP BY ALL),
      a AS (SELECT request_id, count(*) AS n, sum(record_size)::BIGINT AS size, max("offset") AS last FROM got GROUP BY ALL)
      SELECT request_id, start, CASE WHEN start >= log_end THEN 'at_end' ELSE 'ok' END AS status, coalesce(n, 0) AS n_records, coalesce(size, 0) AS n_bytes, coalesce(last + 1, start) AS next_offset FROM q JOIN ends USING (topic, "partition") LEFT JOIN a USING (request_id)
      UNION ALL SELECT 'g9/' || topic || '/' || "partition", NULL, 'no_commit', 0, 0, 0 FROM cc WHERE "group" = 'g0'""",
    "committed_offsets": f"WITH {COMMITS} SELECT * FROM cc",
    "commit_lookup": f"""WITH {COMMITS}, q AS (SELECT 'g' || (c_custkey % 9) AS "group", 'view' AS topic, (c_custkey % 6)::INT AS "partition", c_custkey FROM customer)
      SELECT "group", topic, "partition", c_custkey, "offset" AS committed FROM q LEFT JOIN cc USING ("group", topic, "partition")""",
    "consumer_lag": f"WITH {L_LOG} SELECT * FROM lag",
    "slow_consumers": f"WITH {L_LOG} SELECT * EXCLUDE (slow) FROM lag WHERE slow",
    "consumer_checks": """SELECT user_id AS client, count(*) AS n_checks, count(*) FILTER (event_id % 11000 - event_id % 700 > 10000) AS n_slow, arg_max(event_id % 11000 - event_id % 700 > 10000, event_id) AS slow_now FROM events GROUP BY user_id""",
    "segment_stats": f"WITH {SEGMENTS} SELECT *, max_offset + 1 AS next_offset FROM s",
    "log_start_offsets": f'WITH {E_LOG} SELECT topic, "partition", min(segment_base) AS log_start, max("offset") + 1 AS next_offset, count(*) AS record_count, sum(record_size)::BIGINT AS size_bytes FROM el WHERE segment_base > 0 GROUP BY ALL',
    "offset_gaps": f"""WITH {E_LOG}, o AS (SELECT topic, "partition", "offset", lead("offset") OVER (PARTITION BY topic, "partition" ORDER BY "offset") AS n FROM el WHERE segment_base % 300 <> 100)
      SELECT topic, "partition", "offset" + 1 AS gap_start, n AS gap_end, n - "offset" - 1 AS missing FROM o WHERE n > "offset" + 1""",
    "traffic": f'WITH {D_LOG} SELECT topic, "partition", count(*) AS messages, sum(record_size - 12)::BIGINT AS bytes FROM d GROUP BY ALL',
    "index_build": f"WITH {INDEX} SELECT * FROM ix",
    "index_floor_lookup": f'WITH {INDEX}, {TARGETS} SELECT event_id, t.topic, t."partition", target, position FROM t ASOF LEFT JOIN ix ON t.topic = ix.topic AND t."partition" = ix."partition" AND t.target >= ix."offset"',
    "segment_lookup": f"""WITH {E_LOG}, {TARGETS}, s AS ({PER_SEGMENT} FROM el WHERE segment_base <> 100 GROUP BY ALL)
      SELECT event_id, t.topic, t."partition", target, segment_base FROM t LEFT JOIN s ON t.topic = s.topic AND t."partition" = s."partition" AND target BETWEEN segment_base AND max_offset""",
    "index_corruption_status": f"""WITH {HEALTH} SELECT topic, "partition", segment_base, CASE WHEN status = 'missing' THEN 0 ELSE entries END AS n_entries, status,
      CASE status WHEN 'invalid_size' THEN entries * 16 + 3 WHEN 'invalid_entries' THEN 1 END AS detail FROM h""",
    "index_rebuild": f"WITH {INDEX} SELECT * FROM ix",
    "index_rebuild_report": f"""WITH {HEALTH} SELECT topic, "partition", segment_base, status = 'missing' AS was_missing, record_count AS scanned, entries FROM h WHERE status <> 'healthy'""",
    "retention_time": f'WITH {SEGMENTS} SELECT topic, "partition", segment_base, size_bytes FROM s WHERE sealed AND created_ms < {RETENTION_NOW_MS - RETENTION_AGE_MS} AND max_offset < 250',
    "retention_skip": """SELECT n_nationkey::BIGINT AS "partition", (n_nationkey * 10000)::BIGINT AS last_retention_run_ms, n_nationkey > 0 AND greatest(200000 - n_nationkey * 10000, 0) < 60000 AS skip FROM nation""",
    "compaction_eligible": f'WITH {ELIGIBLE} SELECT topic, "partition", segment_base, max_offset FROM ok',
    "compaction_latest": f'WITH {KV} SELECT topic, "partition", key, max("offset") AS "offset", (SELECT value FROM kv b WHERE b."partition" = a."partition" AND b."offset" = max(a."offset")) AS value, count(*) AS n_records FROM kv a GROUP BY topic, "partition", key',
    "compaction_tombstones": f'WITH {KV} SELECT topic, "partition", key, "offset" FROM (SELECT *, row_number() OVER (PARTITION BY "partition", key ORDER BY "offset" DESC) AS n FROM kv) WHERE n = 1 AND value IS NULL',
    "compaction_dropped": f"WITH {RESULT} SELECT * FROM res",
    "compacted_log": f"""WITH {ELIGIBLE}, o AS (SELECT kv.*, ok.segment_base IS NOT NULL AS old FROM kv LEFT JOIN ok USING (topic, "partition", segment_base)),
      k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY "partition", key, old ORDER BY "offset" DESC) AS n FROM o) WHERE n = 1 AND old)
      SELECT topic, "partition", segment_base, "offset", key, value FROM o WHERE NOT old UNION ALL SELECT topic, "partition", min("offset") OVER (PARTITION BY "partition"), "offset", key, value FROM k""",
    "checkpoint_advance": f"""WITH {RESULT}, old(topic, "partition", last) AS (VALUES ('users', 0, 5), ('users', 1, {CHECKPOINT}), ('users', 3, 10000000), ('others', 0, 7))
      SELECT topic, "partition", greatest(last, highest_compacted)::BIGINT AS last_compacted_offset, CASE WHEN highest_compacted < last THEN 'checkpoint would go back' END AS error FROM old FULL JOIN res USING (topic, "partition")""",
    "checkpoint_load": """WITH n AS (SELECT n_nationkey::BIGINT AS p, CASE WHEN n_nationkey % 3 > 0 THEN n_nationkey * 10 - 50 END::BIGINT AS o, CASE WHEN n_nationkey % 5 > 0 THEN n_nationkey * 1000 END::BIGINT AS r FROM nation)
      SELECT p AS "partition", CASE WHEN o >= 0 THEN o END AS last_compacted_offset, CASE WHEN o < 0 THEN 0 ELSE coalesce(r, 0) END AS last_retention_run_ms, coalesce(o < 0, false) AS corrupt FROM n""",
    "rate_limit": f"WITH {RATED} SELECT client, seq, bytes, allowed FROM f",
    "throttle_counts": f"WITH {RATED} SELECT client, count(*) AS n_requests, count(*) FILTER (NOT allowed) AS n_throttled, coalesce(sum(bytes) FILTER (allowed), 0)::BIGINT AS bytes_allowed FROM f GROUP BY client",
    "stream_rate_limit": f"WITH {RATED} SELECT client, seq, allowed FROM f",
    "inflight_limit": f"""WITH {REQUESTS},
      f AS (SELECT client, seq, n, t + bytes * 600000 AS a, 0::BIGINT AS b, true AS allowed FROM r WHERE n = 1
        UNION ALL SELECT r.client, r.seq, r.n, CASE WHEN a <= b AND a <= r.t THEN r.t + bytes * 600000 ELSE a END, CASE WHEN b < a AND b <= r.t THEN r.t + bytes * 600000 ELSE b END, least(a, b) <= r.t FROM f JOIN r ON r.client = f.client AND r.n = f.n + 1)
      SELECT client, seq, allowed FROM f""",
    "latency_percentiles": f"WITH {LATENCIES} SELECT * FROM p",
    "metric_counters": f"WITH {_counter_values()} SELECT name, kind, value FROM vals",
    "metric_snapshot": f"WITH {_counter_values()} SELECT " + ", ".join(f"(sum(value) FILTER (name = '{n}'))::BIGINT AS {n}" for n in COUNTERS) + " FROM vals",
    "lag_snapshot": f'WITH {COMMITS} SELECT topic, "partition", "group", 100 - "offset" AS lag FROM cc',
    "prometheus_export": _prometheus(),
    "topics_list": f"WITH {NATIONS} SELECT * FROM topics ORDER BY name",
    "topic_describe": f'WITH {E_LOG} SELECT topic, 4 AS partition_count, sum(n)::BIGINT AS high_watermark, sum(n)::BIGINT AS record_count, sum(b)::BIGINT AS size_bytes FROM (SELECT topic, "partition", count(*) AS n, sum(record_size) AS b FROM e GROUP BY ALL) GROUP BY topic',
    "partition_describe": f"""WITH {E_LOG}, {NATIONS}, parts AS (SELECT name AS topic, unnest(range(partition_count))::INT AS "partition" FROM (FROM topics UNION ALL SELECT DISTINCT topic, 4 FROM e))
      SELECT topic, "partition", 0::BIGINT AS log_start, coalesce(max("offset") + 1, 0) AS high_watermark, count("offset") AS record_count, coalesce(sum(record_size), 0)::BIGINT AS size_bytes FROM parts LEFT JOIN e USING (topic, "partition") GROUP BY ALL""",
    "partition_checks": """SELECT s_suppkey AS request_id, CASE WHEN s_suppkey % 3 > 0 THEN 'NATION_6' ELSE 'ATLANTIS' END AS topic, (s_suppkey % 6)::INT AS "partition", CASE WHEN s_suppkey % 3 = 0 OR s_suppkey % 6 >= (SELECT n_nationkey % 4 + 1 FROM nation WHERE n_name = 'NATION_6') THEN 14 END AS code FROM supplier""",
    "create_topic_conflicts": """WITH q AS (SELECT c_custkey AS seq, 'topic' || (c_custkey % 90) AS name, (c_custkey % 5)::INT AS partition_count FROM customer)
      SELECT *, CASE WHEN partition_count = 0 THEN 12 WHEN name IN (SELECT 'topic' || n_nationkey FROM nation) OR EXISTS (SELECT 1 FROM q b WHERE b.name = q.name AND b.seq < q.seq AND b.partition_count > 0) THEN 11 END AS code FROM q""",
    "create_topic_conflicts_all": """WITH q AS (SELECT c_custkey AS seq, 'topic' || (c_custkey % 90) AS name, (c_custkey % 5)::INT AS partition_count FROM customer),
      f AS (SELECT name, min(seq) FILTER (partition_count > 0) AS first FROM q GROUP BY name)
      SELECT seq, name, partition_count, CASE WHEN partition_count = 0 THEN 12 WHEN name IN (SELECT 'topic' || n_nationkey FROM nation) OR seq > first THEN 11 END AS code FROM q JOIN f USING (name)""",
    "record_encode": f"""WITH {E_LOG} SELECT event_id, lower(printf('%08x', record_size - 12) || printf('%016x', "offset") || hex(encode(payload))) AS record FROM e""",
    "record_decode": f'WITH {E_LOG} SELECT topic, "partition", "offset", payload FROM e',
    "stream_consume": f'WITH {E_LOG} SELECT topic, "partition", "offset", payload FROM e',
    "index_decode": f"WITH {INDEX} SELECT * FROM ix",
    "key_value_codec": f"WITH {KV} SELECT ingest_seq, (octet_length(encode(key)) + coalesce(octet_length(encode(value)), 0) + 8)::INT AS n_bytes, key, value, printf('%020d', ingest_seq) || '.log' AS file FROM kv",
    "request_decode": f"""WITH {_request_rows()} SELECT conv_id, turn, verb, CASE WHEN verb IN ('fetch', 'commit', 'committed') THEN 'g' || (conv_id % 7) END AS "group", CASE WHEN NOT ({_BARE}) THEN role END AS topic, CASE WHEN {_LOCATED} THEN conv_id % 4 END AS "partition",
      CASE WHEN verb IN ('fetch', 'commit') THEN conv_id * 4000000000 END AS "offset", CASE WHEN verb = 'fetch' THEN 1048576::BIGINT END AS max_bytes, CASE WHEN verb = 'create_topic' THEN turn + 1 END AS partition_count,
      CASE WHEN verb = 'produce' THEN 2 ELSE -1 END AS n_records, CASE WHEN verb = 'produce' THEN text END AS first_record, NULL::VARCHAR AS error FROM q""",
    "request_decode_errors": f"""WITH {_request_rows()} SELECT conv_id, turn, CASE WHEN {_BARE} THEN 'empty frame' ELSE 'frame ends early or isn''t valid' END AS error, CASE WHEN {_BARE} THEN 1 ELSE 2 END AS code FROM q""",
    "fetch_response_codec": """SELECT conv_id, 'fetch' AS kind, count(*) AS record_count, conv_id * 7 AS next_offset, sha256(string_agg(text, '|' ORDER BY turn, role, encode(text))) AS texts_sha256 FROM conversations GROUP BY conv_id""",
}


def _by_size(mark: int, what: str) -> str:
    return f"""WITH {SEGMENTS}, w AS (SELECT *, sum(size_bytes) OVER (PARTITION BY topic, "partition") - coalesce(sum(size_bytes) OVER (PARTITION BY topic, "partition" ORDER BY segment_base ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS remaining,
      max((max_offset >= {mark})::INT) OVER (PARTITION BY topic, "partition" ORDER BY segment_base) AS held FROM s WHERE sealed),
    gone AS (SELECT * FROM w WHERE held = 0 AND remaining > {RETAIN_BYTES}) {what}"""


SQL |= {
    "retention_size": _by_size(350, 'SELECT topic, "partition", segment_base, size_bytes FROM gone'),
    "retention_size_held": _by_size(250, 'SELECT topic, "partition", segment_base, size_bytes FROM gone'),
    "retention_summary": _by_size(350, "SELECT count(*) AS segments_deleted, coalesce(sum(size_bytes), 0)::BIGINT AS bytes_reclaimed FROM gone"),
    "retained_log": _by_size(350, 'SELECT topic, "partition", min(segment_base) AS log_start, max(max_offset) + 1 AS next_offset, sum(record_count)::BIGINT AS record_count, sum(size_bytes)::BIGINT AS size_bytes FROM s ANTI JOIN gone USING (topic, "partition", segment_base) GROUP BY ALL'),
}
