"""The registered queries' results stated in DuckDB's SQL."""

from __future__ import annotations

LOG = """
log AS (
  SELECT event_id AS seq, epoch_us(ts) // 1000 AS ts,
    CASE WHEN event_type = 'error' THEN 'DELETE' ELSE 'PUT' END AS op,
    'user:' || lpad(CAST(user_id AS VARCHAR), 6, '0') || ':' || lpad(json_extract_string(props, '$.k'), 3, '0') AS key,
    CASE WHEN event_type = 'error' THEN '' ELSE event_type || '|' || CAST(value AS VARCHAR) END AS value,
    event_type = 'error' AS deleted, event_id // 2048 AS gen, user_id, event_type, value AS amount
  FROM events
)"""
LAST = """
last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS rn FROM log) t WHERE rn = 1)"""
RUNS = """
runs AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY gen, key ORDER BY seq DESC) AS rn FROM log) t WHERE rn = 1)"""
BYTES = "octet_length(encode(key)) + octet_length(encode(value))"
BATCH = """
lines AS (
  SELECT l_orderkey, 'o:' || l_orderkey || ':' || l_linenumber AS k,
    l_partkey || '|' || l_suppkey || '|' || CAST(l_quantity AS BIGINT) AS v, l_returnflag,
    row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_partkey, l_suppkey, l_extendedprice, 'o:' || l_orderkey || ':' || l_linenumber,
      l_partkey || '|' || l_suppkey || '|' || CAST(l_quantity AS BIGINT)) AS pos
  FROM lineitem
)"""
META = f"""
meta AS (
  SELECT gen + 1 AS file_number, count(*) AS entry_count, min(key) AS first_key, max(key) AS last_key,
    CAST(sum(CAST(deleted AS BIGINT)) AS BIGINT) AS tombstones, CAST(sum({BYTES} + 15) AS BIGINT) AS data_bytes,
    CAST(sum({BYTES} + 49) AS BIGINT) AS memory_bytes, max(seq) AS max_seq
  FROM runs GROUP BY gen
)"""
PROBES = """
probes AS (SELECT DISTINCT 'user:' || lpad(CAST(c_custkey AS VARCHAR), 6, '0') || ':' || lpad(CAST(c_nationkey AS VARCHAR), 3, '0') AS key FROM customer)"""
INDEX = f"""
numbered AS (
  SELECT gen + 1 AS file_number, key, row_number() OVER (PARTITION BY gen ORDER BY key) - 1 AS entry,
    CAST(coalesce(sum({BYTES} + 15) OVER (PARTITION BY gen ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset" FROM runs
), idx AS (SELECT * FROM numbered WHERE entry % 10 = 0)"""
PARAMS = """
sized AS (SELECT file_number, entry_count, CAST(ceil(-greatest(entry_count, 1) * ln(0.01) / (ln(2) * ln(2))) AS BIGINT) AS num_bits FROM meta
), params AS (SELECT *, CAST(greatest(1, round(num_bits / CAST(entry_count AS DOUBLE) * ln(2))) AS BIGINT) AS num_hashes FROM sized)"""
#: Keys of the events are ASCII, whose code units are their characters.
UNITS = "list_transform(generate_series(1, len({key})), lambda i: CAST(unicode(substr({key}, CAST(i AS INTEGER), 1)) AS BIGINT))"
FNV = "list_reduce(list_prepend(CAST(2166136261 AS BIGINT), " + UNITS + "), lambda h, x: (xor(h, x) * 16777619) % 4294967296)"
DJB = "list_reduce(list_prepend(CAST(5381 AS BIGINT), " + UNITS + "), lambda h, x: xor((h * 33) % 4294967296, x))"
FILTERS = f"""
keyed AS (SELECT gen + 1 AS file_number, {FNV.format(key="key")} AS a, {DJB.format(key="key")} AS b FROM runs
), setbits AS (
  SELECT DISTINCT file_number, num_bits, num_hashes, ((a + i * b) % 4294967296) % num_bits AS bit
  FROM (SELECT k.*, num_bits, num_hashes, unnest(generate_series(0, num_hashes - 1)) AS i FROM keyed k JOIN params USING (file_number)) x)"""
REPLICA = "replica AS (SELECT * FROM log WHERE gen < (SELECT max(gen) FROM log))"
REPLICA_LAST = "rlast AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS rn FROM replica) t WHERE rn = 1)"

SQL = {
    "put_overwrite": f"WITH {LOG}, {LAST} SELECT l.key, CAST(count(*) AS BIGINT) AS versions, max(last.seq) AS seq, max(last.op) AS op, max(last.value) AS value FROM log l JOIN last ON l.key = last.key GROUP BY l.key",
    "live_state": f"WITH {LOG}, {LAST} SELECT key, value FROM last WHERE NOT deleted",
    "tombstones": f"WITH {LOG}, {LAST} SELECT key, seq FROM last WHERE deleted",
    "multi_get": f"""WITH {LOG}, {LAST}, probes AS (
        SELECT DISTINCT 'user:' || lpad(CAST(c_custkey AS VARCHAR), 6, '0') || ':' || lpad(CAST(c_nationkey AS VARCHAR), 3, '0') AS key FROM customer)
        SELECT p.key, CASE WHEN l.value IS NULL THEN 404 ELSE 200 END AS status, l.value FROM probes p LEFT JOIN (SELECT * FROM last WHERE NOT deleted) l ON p.key = l.key""",
    "batch_put": f"WITH {BATCH} SELECT k AS key, v AS value FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY l_orderkey DESC, pos DESC) AS rn FROM lines) t WHERE rn = 1",
    "range_scan": f"WITH {LOG}, {LAST} SELECT key, value FROM last WHERE NOT deleted AND key BETWEEN 'user:000010' AND 'user:000099:099'",
    "range_limit": f"WITH {LOG}, {LAST} SELECT key, value FROM last WHERE NOT deleted AND key BETWEEN 'user:000010' AND 'user:000099:099' ORDER BY key LIMIT 25",
    "range_inverted": f"WITH {LOG}, {LAST} SELECT key, value FROM last WHERE NOT deleted AND key BETWEEN 'user:000099' AND 'user:000010'",
    "range_page": f"""WITH {LOG}, {LAST}, ranked AS (
        SELECT key, value, row_number() OVER (ORDER BY key) AS r FROM last WHERE NOT deleted AND key BETWEEN 'user:000010' AND 'user:000099:099')
        SELECT key, value FROM ranked WHERE r BETWEEN 26 AND 50""",
    "validate_put": """SELECT event_id, CASE WHEN reason IS NULL THEN 200 ELSE 400 END AS status, reason FROM (
        SELECT event_id, CASE WHEN user_id % 11 = 0 OR user_id % 7 = 0 THEN 'invalid key' WHEN event_type = 'error' THEN 'invalid value' END AS reason FROM events) t""",
    "validate_batch": f"""WITH {BATCH}, b AS (
        SELECT l_orderkey, count(*) AS n, min(CASE WHEN l_returnflag = 'R' THEN pos - 1 END) AS bad FROM lines GROUP BY l_orderkey)
        SELECT l_orderkey, CASE WHEN bad IS NULL THEN 200 ELSE 400 END AS status, CAST(coalesce(bad, -1) AS BIGINT) AS bad_index,
          CAST(CASE WHEN bad IS NULL THEN n ELSE 0 END AS BIGINT) AS accepted FROM b""",
    "wal_bytes": f"""WITH {LOG}, {BATCH}, sizes AS (
        SELECT op, CASE WHEN op = 'PUT' THEN 6 + {BYTES} ELSE 2 + octet_length(encode(key)) END + 25 AS n FROM log
        UNION ALL SELECT 'BATCH_PUT', 29 + sum(6 + octet_length(encode(k)) + octet_length(encode(v))) FROM lines GROUP BY l_orderkey)
        SELECT op, count(*) AS records, CAST(sum(n) AS BIGINT) AS bytes FROM sizes GROUP BY op""",
    "entry_bytes": f"WITH {LOG}, {RUNS}, {META} SELECT file_number, data_bytes, memory_bytes FROM meta",
    "entry_encoding": f"""WITH {LOG}, {RUNS} SELECT gen, key, sha256(from_hex(printf('%04x', octet_length(encode(key)))) || encode(key) || from_hex(printf('%08x', octet_length(encode(value)))) || encode(value)
        || from_hex(printf('%016x', ts)) || from_hex(CASE WHEN deleted THEN '01' ELSE '00' END)) AS entry_sha256 FROM runs""",
    "flush_runs": f"WITH {LOG}, {RUNS} SELECT gen, key, value, deleted, seq FROM runs",
    "run_meta": f"WITH {LOG}, {RUNS}, {META} SELECT * FROM meta",
    "sparse_index": f"WITH {LOG}, {RUNS}, {INDEX} SELECT * FROM idx",
    "sparse_floor": f"""WITH {LOG}, {RUNS}, {INDEX}, {PROBES}, f AS (
        SELECT p.key, g.file_number, (SELECT max(i.key) FROM idx i WHERE i.file_number = g.file_number AND i.key <= p.key) AS floor_key
        FROM probes p, (SELECT DISTINCT file_number FROM idx) g)
        SELECT f.key, f.file_number, f.floor_key, coalesce(i."offset", 0) AS "offset" FROM f LEFT JOIN idx i ON i.file_number = f.file_number AND i.key = f.floor_key""",
    "bloom_hashes": f"WITH {LOG} SELECT key, {FNV.format(key='key')} AS fnv1a, {DJB.format(key='key')} AS djb2 FROM (SELECT DISTINCT key FROM log) t",
    "bloom_bytes": f"""WITH {LOG}, {RUNS}, {META}, {PARAMS}, {FILTERS}
        SELECT file_number, num_bits, num_hashes, bit // 8 AS byte, CAST(sum(1 << CAST(bit % 8 AS INTEGER)) AS INTEGER) AS value FROM setbits GROUP BY ALL""",
    "bloom_probe": f"""WITH {LOG}, {RUNS}, {META}, {PARAMS}, {FILTERS}, {PROBES}, asked AS (
        SELECT p.key, file_number, ((a + i * b) % 4294967296) % num_bits AS bit
        FROM (SELECT key, a, b, file_number, num_bits, unnest(generate_series(0, num_hashes - 1)) AS i
          FROM (SELECT key, {FNV.format(key="key")} AS a, {DJB.format(key="key")} AS b FROM probes) h, params) p)
        SELECT a.key, a.file_number, bool_and(s.bit IS NOT NULL) AS might_contain FROM asked a LEFT JOIN setbits s ON s.file_number = a.file_number AND s.bit = a.bit GROUP BY a.key, a.file_number""",
    "bloom_params": f"WITH {LOG}, {RUNS}, {META}, {PARAMS} SELECT * FROM params",
    "run_pruning": f"""WITH {LOG}, {RUNS}, {META}, r AS (
        SELECT n_nationkey AS range_id, 'user:' || lpad(CAST(n_nationkey * 8 AS VARCHAR), 6, '0') AS s, 'user:' || lpad(CAST(n_nationkey * 8 + n_regionkey AS VARCHAR), 6, '0') AS e FROM nation)
        SELECT range_id, file_number FROM r JOIN meta ON first_key <= e AND last_key >= s AND s <= e""",
    "merge_runs": f"WITH {LOG}, {LAST} SELECT key, value FROM last WHERE NOT deleted",
    "compaction": f"""WITH {LOG}, {LAST}, {RUNS}, c AS (
        SELECT (SELECT count(DISTINCT gen) FROM runs) AS runs_in, (SELECT count(*) FROM runs) AS entries_read, (SELECT count(*) FROM last WHERE NOT deleted) AS entries_written)
        SELECT *, entries_read - entries_written AS entries_removed FROM c""",
    "wal_tail": f"WITH {LOG} SELECT seq, op, key, value FROM log WHERE gen = (SELECT max(gen) FROM log)",
    "wal_replay": f"WITH {LOG}, {LAST} SELECT key, value FROM last WHERE NOT deleted",
    "flush_by_bytes": f"""WITH RECURSIVE {LOG}, sized AS (
        SELECT seq, key, {BYTES} + 49 AS n, lag(seq) OVER (PARTITION BY key ORDER BY seq) AS before, lag({BYTES} + 49) OVER (PARTITION BY key ORDER BY seq) AS was FROM log
      ), borders AS (
        SELECT CAST(0 AS BIGINT) AS gen, (SELECT min(seq) FROM log) AS start
        UNION ALL
        SELECT gen + 1, (SELECT min(seq) FROM (
            SELECT seq, sum(n - CASE WHEN before >= start THEN was ELSE 0 END) OVER (ORDER BY seq) AS live FROM sized WHERE seq >= start) x WHERE live >= {100 * 1024}) + 1
        FROM borders WHERE start IS NOT NULL
      ), dealt AS (
        SELECT l.* EXCLUDE (gen), b.gen AS gen FROM (SELECT gen, start, lead(start) OVER (ORDER BY gen) AS stop FROM borders WHERE start IS NOT NULL) b
        JOIN log l ON l.seq >= b.start AND (b.stop IS NULL OR l.seq < b.stop)
      ), runs AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY gen, key ORDER BY seq DESC) AS rn FROM dealt) t WHERE rn = 1), {META} SELECT * FROM meta""",
    "store_stats": f"""WITH {LOG}, {RUNS}, {META}, tail AS (SELECT * FROM log WHERE gen = (SELECT max(gen) FROM log)), t AS (
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS rn FROM tail) x WHERE rn = 1)
        SELECT (SELECT count(*) FROM t) AS memtable_entries, (SELECT CAST(sum({BYTES} + 49) AS BIGINT) FROM t) AS memtable_bytes,
          count(*) AS run_count, CAST(sum(entry_count) AS BIGINT) AS run_entries, CAST(sum(data_bytes) AS BIGINT) AS run_bytes, max(max_seq) AS flushed_seq
        FROM meta WHERE file_number <= (SELECT max(gen) FROM log)""",
    "replica_state": f"WITH {LOG}, {REPLICA}, {REPLICA_LAST} SELECT key, value, seq AS source_seq FROM rlast WHERE NOT deleted",
    "replication_status": f"""WITH {LOG}, {REPLICA} SELECT (SELECT max(seq) FROM log) AS primary_seq, (SELECT max(seq) FROM replica) AS replica_seq,
        (SELECT count(*) FROM replica) AS applied, count(*) AS pending, CAST(coalesce((SELECT max(ts) FROM log) - min(ts), 0) AS BIGINT) AS lag_ms, count(*) = 0 AS caught_up
        FROM log WHERE seq > coalesce((SELECT max(seq) FROM replica), -1)""",
    "replication_metrics": f"""WITH {LOG}, {REPLICA}, sizes AS (
        SELECT seq, ts, CASE WHEN op = 'PUT' THEN 6 + {BYTES} ELSE 2 + octet_length(encode(key)) END + 25 AS n, gen < (SELECT max(gen) FROM log) AS done FROM log)
        SELECT count(*) FILTER (done) AS applied, CAST(coalesce(sum(n) FILTER (done), 0) AS BIGINT) AS applied_bytes, count(*) FILTER (NOT done) AS pending,
          CAST(coalesce(sum(n) FILTER (NOT done), 0) AS BIGINT) AS pending_bytes, max(ts) - max(ts) FILTER (done) AS backup_lag_ms FROM sizes""",
    "replica_store": f"""WITH {LOG}, two AS (SELECT *, gen >= 3 AS late FROM log), lasts AS (
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY late, key ORDER BY seq DESC) AS rn FROM two) t WHERE rn = 1 AND NOT deleted)
        SELECT key, value FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY late DESC) AS r FROM lasts) u WHERE r = 1""",
    "replica_diff": f"""WITH {LOG}, {LAST}, {REPLICA}, {REPLICA_LAST}, a AS (SELECT key, value FROM last WHERE NOT deleted), b AS (SELECT key, value FROM rlast WHERE NOT deleted)
        SELECT 'primary' AS side, key, value FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) x
        UNION ALL SELECT 'replica', key, value FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a) y""",
    "binary_log": f"""WITH {LOG}, {BATCH} SELECT seq, op, key, CASE WHEN op = 'PUT' THEN value END AS value, CAST(0 AS BIGINT) AS entries FROM log
        UNION ALL SELECT l_orderkey, 'BATCH_PUT', NULL, NULL, count(*) FROM lines GROUP BY l_orderkey""",
    "store_lifecycle": f"WITH {LOG}, {LAST} SELECT key, value FROM last WHERE NOT deleted",
    "store_manifest": f"""WITH {LOG}, three AS (SELECT *, gen * 3 // ((SELECT max(gen) FROM log) + 1) AS part FROM log), runs AS (
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY part, key ORDER BY seq DESC) AS rn FROM three) t WHERE rn = 1)
        SELECT row_number() OVER (ORDER BY part) AS file_number, count(*) AS entry_count, min(key) AS first_key, max(key) AS last_key, CAST(sum({BYTES} + 15) AS BIGINT) AS data_bytes,
          (SELECT max(seq) FROM log) AS seq FROM runs GROUP BY part""",
    "store_lookup": f"""WITH {LOG}, {LAST}, {PROBES} SELECT p.key, CASE WHEN l.value IS NULL THEN 404 ELSE 200 END AS status, l.value
        FROM probes p LEFT JOIN (SELECT * FROM last WHERE NOT deleted) l ON p.key = l.key""",
    "tcp_put": "SELECT 'nation:' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS key, n_name || '|' || n_regionkey AS value FROM nation",
    "http_requests": """SELECT 'nation:' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS key, CASE WHEN n_regionkey = 0 THEN 404 ELSE 200 END AS status,
        CASE n_regionkey WHEN 0 THEN NULL WHEN 1 THEN 'again' ELSE n_name || '|' || n_regionkey END AS value FROM nation""",
    "stream_ingest": f"WITH {LOG}, {LAST} SELECT key, value FROM last WHERE NOT deleted",
}
