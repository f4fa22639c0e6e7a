"""DuckDB SQL twins of the registered queries.

Written from the operator definitions straight on the tables (no event-log
JSON, no Spark plan): a mismatch means one of the two is wrong. Tables are
the driver's pre-registered views.
"""

from __future__ import annotations

from ..operators.metrics import INDEX_STAT_METRICS
from ..streaming.eventlog_stream import TASK_LOCAL_METRICS

ORACLE: dict[str, str] = {}


def oracle(name: str, sql: str) -> None:
    ORACLE[name] = sql.strip()


def duck_u(seed, tag, *ids: str) -> str:
    """DuckDB twin of ``functions.rng.uniform``."""
    parts = ", ".join([f"'{seed}'", f"'{tag}'", *[f"CAST({i} AS VARCHAR)" for i in ids]])
    return (f"((('0x' || substr(md5(concat_ws(':', {parts})), 1, 13))::BIGINT + 0.5)"
            f" / 4503599627370496.0)")


def duck_payload_hex(seed, id_expr: str, n_expr: str) -> str:
    """Upper-case hex text of ``functions.rng.payload``."""
    return (f"CASE WHEN ({n_expr}) <= 0 THEN '' ELSE upper(substr(array_to_string("
            f"list_transform(range(0, CAST(ceil(({n_expr}) / 16.0) AS BIGINT)), "
            f"lambda k: md5(concat_ws(':', '{seed}', CAST({id_expr} AS VARCHAR), CAST(k AS VARCHAR)))), ''),"
            f" 1, 2 * ({n_expr}))) END")


# ------------------------------------------------------------------ metrics

#: Id of a lineitem row, as ``sources.tablelog.row_id``.
_ROW_ID = ("('0x' || substr(md5(concat_ws(':', CAST(l_orderkey AS VARCHAR), CAST(l_linenumber AS VARCHAR), "
           "CAST(l_partkey AS VARCHAR), CAST(l_suppkey AS VARCHAR), "
           "CAST(CAST(round(l_extendedprice * 100) AS BIGINT) AS VARCHAR))), 1, 13))::BIGINT")

_TASKS_CTE = f"""
WITH o AS (
  SELECT o_orderpriority AS app, o_orderkey, o_orderstatus,
         epoch_ms(o_orderdate) AS start_ms,
         epoch_ms(o_orderdate) + CASE WHEN o_orderkey % 10 = 3 THEN 500 ELSE 0 END AS sub_ms,
         CASE WHEN o_orderkey % 10 = 7 THEN epoch_ms(o_orderdate) + 60000
              WHEN o_orderstatus <> 'P'
              THEN epoch_ms(o_orderdate) + 20000 + CAST(floor(o_totalprice) AS BIGINT) % 1000
         END AS end_ms
  FROM orders),
li AS (SELECT *, {_ROW_ID} AS task_id FROM lineitem),
tt AS (
  SELECT o.app, o.end_ms, o.sub_ms, li.*,
         o.start_ms + li.l_linenumber * 1000 + li.l_suppkey % 100 AS launch_ms
  FROM li JOIN o ON li.l_orderkey = o.o_orderkey
  WHERE NOT (li.l_orderkey % 10 = 3 AND li.l_linenumber % 3 = 0)),
t AS (
  SELECT app, task_id AS taskId, l_orderkey AS stageId, l_linenumber AS taskIndex,
    CAST(l_suppkey % 8 AS VARCHAR) AS executorId,
    'host-' || CAST(l_suppkey % 4 AS VARCHAR) AS host,
    l_returnflag = 'N' AS "local",
    CAST(end_ms - sub_ms AS DOUBLE) AS sojournTime,
    CAST(launch_ms - sub_ms AS DOUBLE) AS waitingTime,
    CAST(CAST(floor(l_quantity * 100) AS BIGINT) + l_partkey % 50 AS DOUBLE) AS serviceTime,
    l_linenumber * 10 + l_suppkey % 7 AS executorDeserializeTime,
    (l_suppkey % 7) * 1000000 + l_partkey AS executorDeserializeCpuTime,
    CAST(floor(l_quantity * 100) AS BIGINT) AS executorRunTime,
    CAST(floor(l_extendedprice * 1000) AS BIGINT) AS executorCpuTime,
    l_partkey + 1000 AS resultSize,
    l_partkey % 13 AS jvmGcTime,
    l_suppkey % 3 AS resultSerializationTime,
    CASE WHEN l_linestatus = 'F' THEN l_partkey * 16 ELSE 0 END AS memoryBytesSpilled,
    CASE WHEN l_linestatus = 'F' THEN l_partkey * 4 ELSE 0 END AS diskBytesSpilled,
    l_partkey * 1024 AS peakExecutionMemory,
    CAST(floor(l_extendedprice) AS BIGINT) AS bytesRead,
    CAST(floor(l_quantity) AS BIGINT) AS recordsRead,
    l_suppkey AS bytesWritten,
    CAST(1 AS BIGINT) AS recordsWritten,
    CAST(l_linenumber AS BIGINT) AS shuffleRemoteBlocksFetched,
    l_suppkey % 5 AS shuffleLocalBlocksFetched,
    l_linenumber + l_suppkey % 5 AS shuffleTotalBlocksFetched,
    CAST(floor(l_discount * 1000) AS BIGINT) AS shuffleFetchWaitTime,
    l_partkey * 10 AS shuffleRemoteBytesRead,
    l_suppkey * 10 AS shuffleLocalBytesRead,
    l_partkey * 10 + l_suppkey * 10 AS shuffleTotalBytesRead,
    CAST(0 AS BIGINT) AS shuffleRemoteBytesReadToDisk,
    CAST(floor(l_quantity) AS BIGINT) AS shuffleRecordsRead,
    l_partkey + l_suppkey AS shuffleBytesWritten,
    CAST(floor(l_tax * 1000000) AS BIGINT) AS shuffleWriteTime,
    CAST(l_linenumber AS BIGINT) AS shuffleRecordsWritten
  FROM tt WHERE end_ms IS NOT NULL)
"""

_STAT_METRICS = INDEX_STAT_METRICS

_stats = ",\n  ".join(
    f"round(avg({m}), 6) AS avg_{m}, round(sqrt(var_samp({m})), 3) AS var_{m}"
    for m in _STAT_METRICS)

oracle("A5_task_index_stats", _TASKS_CTE + f"""
SELECT taskIndex, count(serviceTime) AS "count",
  {_stats}
FROM t GROUP BY taskIndex
""")

oracle("M5_flat_tasks_full", _TASKS_CTE + "SELECT * FROM t")

oracle("M4_flat_tasks", _TASKS_CTE + """
SELECT app, taskId, stageId, host, "local", sojournTime, waitingTime, serviceTime,
  CAST(executorDeserializeTime AS DOUBLE) AS deserializationTime,
  0.0::DOUBLE AS schedulerOverhead, CAST(executorCpuTime AS DOUBLE) AS runtime,
  0.0::DOUBLE AS readTime
FROM t
""")

oracle("U2_pool_stage2", _TASKS_CTE + """,
k AS (SELECT app, o_orderkey AS stage_id,
        row_number() OVER (PARTITION BY app ORDER BY o_orderkey) AS k FROM o)
SELECT t.* FROM t JOIN k ON t.app = k.app AND t.stageId = k.stage_id WHERE k.k = 2
""")

_LISTED = """
WITH listed AS (
  SELECT o_orderpriority AS app, o_orderkey AS job_id, o_orderkey AS stage_id FROM orders
  UNION ALL SELECT o_orderpriority, o_orderkey, o_orderkey + 1099511627776 FROM orders WHERE o_orderkey % 10 = 5
  UNION ALL SELECT o_orderpriority, o_orderkey + 2199023255552, o_orderkey FROM orders WHERE o_orderkey % 10 = 7)
"""

oracle("O2_nth_stage", _LISTED + """
SELECT app, stage_id FROM (
  SELECT app, stage_id, row_number() OVER (PARTITION BY app ORDER BY stage_id) AS k
  FROM (SELECT DISTINCT app, stage_id FROM listed)) WHERE k = 3
""")

oracle("M1_jobs", """
SELECT o_orderpriority AS app, o_orderkey AS job_id, epoch_ms(o_orderdate) AS submission_ms,
  CASE WHEN o_orderkey % 10 = 5 THEN 2 ELSE 1 END AS num_stages,
  CAST(o_orderkey AS VARCHAR) || CASE WHEN o_orderkey % 10 = 5
       THEN ',' || CAST(o_orderkey + 1099511627776 AS VARCHAR) ELSE '' END AS stage_ids,
  CASE WHEN o_orderstatus <> 'P'
       THEN epoch_ms(o_orderdate) + 20000 + CAST(floor(o_totalprice) AS BIGINT) % 1000 END AS end_ms
FROM orders
UNION ALL
SELECT o_orderpriority, o_orderkey + 2199023255552, epoch_ms(o_orderdate) + 25000, 1,
  CAST(o_orderkey AS VARCHAR), epoch_ms(o_orderdate) + 60000
FROM orders WHERE o_orderkey % 10 = 7
""")

oracle("M2_stages", """
SELECT o_orderpriority AS app, o_orderkey AS stage_id, CASE WHEN o_orderkey % 10 = 3 THEN 1 ELSE 0 END AS attempt,
  epoch_ms(o_orderdate) + CASE WHEN o_orderkey % 10 = 3 THEN 500 ELSE 0 END AS submission_ms,
  epoch_ms(o_orderdate) + 19000 AS completion_ms
FROM orders
UNION ALL
SELECT o_orderpriority, o_orderkey + 1099511627776, NULL, NULL, NULL FROM orders WHERE o_orderkey % 10 = 5
""")

oracle("M3_job_stages", _LISTED + "SELECT app, job_id, stage_id FROM listed")

oracle("S1_event_counts", """
SELECT app, event, CAST(sum(n) AS BIGINT) AS n FROM (
  SELECT o_orderpriority AS app, 'SparkListenerJobStart' AS event,
         count(*) + count(*) FILTER (WHERE o_orderkey % 10 = 7) AS n FROM orders GROUP BY 1
  UNION ALL SELECT o_orderpriority, 'SparkListenerStageSubmitted',
         count(*) + count(*) FILTER (WHERE o_orderkey % 10 = 3) FROM orders GROUP BY 1
  UNION ALL SELECT o_orderpriority, 'SparkListenerStageCompleted', count(*) FROM orders GROUP BY 1
  UNION ALL SELECT o_orderpriority, 'SparkListenerJobEnd',
         count(*) FILTER (WHERE o_orderstatus <> 'P') + count(*) FILTER (WHERE o_orderkey % 10 = 7)
         FROM orders GROUP BY 1
  UNION ALL SELECT o_orderpriority, 'SparkListenerTaskEnd', count(*)
            FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1)
GROUP BY app, event HAVING sum(n) > 0
""")


# ------------------------------------------------------------------ generators

oracle("G1_index_partitions", """
SELECT s_suppkey AS id, CAST(((s_suppkey - 1) % 16 + 16) % 16 AS INTEGER) AS part FROM supplier
""")

oracle("G2_zero_partitions", """
SELECT s_suppkey AS id, CAST(((s_suppkey - 1) % 16 + 16) % 16 AS INTEGER) AS part, 17 AS n_bytes,
       md5(repeat('00', 17)) AS payload_md5 FROM supplier
""")

oracle("G3_random_partitions", f"""
SELECT s_suppkey AS id, CAST(((s_suppkey - 1) % 16 + 16) % 16 AS INTEGER) AS part, 40 AS n_bytes,
       {duck_payload_hex(42, 's_suppkey', '40')} AS payload_hex FROM supplier
""")

oracle("G4_sized_partitions", f"""
WITH sizes AS (SELECT n_nationkey AS label, n_nationkey + 3 AS size FROM nation WHERE n_regionkey <= 2),
s AS (SELECT s_suppkey AS id, s_nationkey AS label, coalesce(sizes.size, 1) AS size
      FROM supplier LEFT JOIN sizes ON s_nationkey = sizes.label)
SELECT id, label, size, {duck_payload_hex(42, 'id', 'size')} AS payload_hex FROM s
""")

_G5 = f"""
SELECT o_orderkey AS id, CAST(floor({duck_u(42, 'key', 'o_orderkey')} * 7) AS INTEGER) AS key,
       {duck_payload_hex(42, 'o_orderkey', '8')} AS payload_hex
FROM orders
"""
oracle("G5_keyed_records", _G5)
oracle("G6_union_batches", _G5)


def _duck_process(spec, tag: str, ids: list[str]) -> str:
    import math
    if not spec:
        return "1.0"
    kind = spec[0]
    if kind == "c" and len(spec) == 2:
        return f"(1.0 / {float(spec[1])!r})"
    if kind == "x" and len(spec) == 2:
        return f"(-ln({duck_u(42, tag, *ids)}) / {float(spec[1])!r})"
    if kind == "e" and len(spec) == 3:
        logs = " + ".join(f"ln({duck_u(42, f'{tag}.{j}', *ids)})" for j in range(1, int(spec[1]) + 1))
        return f"(-({logs}) / {float(spec[2])!r})"
    if kind == "w" and len(spec) in (2, 3):
        shape = float(spec[1])
        scale = float(spec[2]) if len(spec) == 3 else 1.0 / math.gamma(1.0 + 1.0 / shape)
        return f"({scale!r} * pow(-ln({duck_u(42, tag, *ids)}), {1.0 / shape!r}))"
    return "1.0"


_G7_SPECS = {
    "const": ("c", 2.0), "expo": ("x", 0.5), "erlang": ("e", 3, 1.5), "weibull": ("w", 2.0),
    "weibull_scaled": ("w", 1.5, 2.0), "default": (), "unknown": ("z", 1.0),
}
oracle("G7_processes", "SELECT o_orderkey AS id, " + ", ".join(
    f"round({_duck_process(spec, name, ['o_orderkey'])}, 6) AS {name}"
    for name, spec in _G7_SPECS.items()) + " FROM orders")

oracle("G8_job_tasks", f"""
SELECT job, CAST(task AS INTEGER) AS task, round({_duck_process(('x', 1.0), 'service', ['job', 'task'])}, 6) AS service
FROM (SELECT o_orderkey AS job, unnest(range(1, 5)) AS task FROM orders)
""")

_PTS = f"""
SELECT o_orderkey AS id, 2.0 * {duck_u(42, 'px', 'o_orderkey')} - 1.0 AS x,
       2.0 * {duck_u(42, 'py', 'o_orderkey')} - 1.0 AS y FROM orders
"""
oracle("G9_square_points", f"SELECT id, round(x, 6) AS x, round(y, 6) AS y FROM ({_PTS})")
oracle("G9_pi_estimate", f"""
SELECT count(*) AS n, sum(CASE WHEN x * x + y * y <= 1.0 THEN 1 ELSE 0 END) AS inside,
       4.0 * sum(CASE WHEN x * x + y * y <= 1.0 THEN 1 ELSE 0 END) / count(*) AS pi_estimate
FROM ({_PTS})
""")


# ------------------------------------------------------------------ byte workloads

# bytes of every document: position i (0-based), unsigned u, signed s; the
# hex text is cut into byte pairs by one regex pass (substr per byte is
# quadratic on long texts)
_DOC_BYTES = """
WITH d AS (SELECT doc_id, lang, hex(encode(text)) AS h, octet_length(encode(text)) AS n FROM documents),
b AS (SELECT doc_id, unnest(range(n)) AS i,
             ('0x' || unnest(regexp_extract_all(h, '[0-9A-F]{2}')))::INTEGER AS u FROM d),
sb AS (SELECT doc_id, i, CASE WHEN u >= 128 THEN u - 256 ELSE u END AS s FROM b)
"""


def _signed_hex_at(h: str, pos: str) -> str:
    return (f"(CASE WHEN ('0x' || substr({h}, 2 * ({pos}) + 1, 2))::INTEGER >= 128 "
            f"THEN ('0x' || substr({h}, 2 * ({pos}) + 1, 2))::INTEGER - 256 "
            f"ELSE ('0x' || substr({h}, 2 * ({pos}) + 1, 2))::INTEGER END)")


oracle("W1_byte_max", _DOC_BYTES + """
SELECT d.doc_id, CAST(coalesce(max(s), -128) AS INTEGER) AS byte_max
FROM d LEFT JOIN sb ON d.doc_id = sb.doc_id GROUP BY d.doc_id
""")

oracle("W2_byte_min", _DOC_BYTES + """
SELECT d.doc_id, CAST(min(s) AS INTEGER) AS byte_min
FROM d LEFT JOIN sb ON d.doc_id = sb.doc_id GROUP BY d.doc_id
""")

_W4_POS = f"CAST(floor({duck_u(42, 'w4', 'doc_id')} * n) AS BIGINT)"
oracle("W4_random_element", f"""
WITH d AS (SELECT doc_id, hex(encode(text)) AS h, octet_length(encode(text)) AS n FROM documents)
SELECT doc_id, CASE WHEN n > 0 THEN CAST({_signed_hex_at('h', _W4_POS)} AS INTEGER) END AS element FROM d
""")

_W5_COIN = duck_u(42, 'w5c', 'w.doc_id', 'w.k')
_W5_POS = f"CAST(floor({duck_u(42, 'w5', 'd.doc_id')} * d.n) AS BIGINT)"
oracle("W5_log_walk_element", f"""
WITH RECURSIVE d AS (
  SELECT doc_id, hex(encode(text)) AS h, octet_length(encode(text)) AS n FROM documents),
w(doc_id, h, n, k, i, x, s) AS (
  SELECT doc_id, h, n, 0, n // 2, n, CAST(0 AS BIGINT) FROM d WHERE n > 0
  UNION ALL
  SELECT w.doc_id, w.h, w.n, w.k + 1, q.i, w.x // 2, w.s + {_signed_hex_at('w.h', 'q.i')}
  FROM w, LATERAL (SELECT least(greatest(CASE WHEN {_W5_COIN} < 0.5 THEN w.i + w.x ELSE w.i - w.x END, 0),
                                w.n - 1) AS i) q
  WHERE w.x > 0)
SELECT d.doc_id, last.s AS walk_sum,
       CASE WHEN d.n > 0 THEN CAST({_signed_hex_at('d.h', _W5_POS)} AS INTEGER) END AS element
FROM d LEFT JOIN (SELECT doc_id, arg_max(s, k) AS s FROM w GROUP BY doc_id) last ON d.doc_id = last.doc_id
""")

def _w6_sql(n_writes: int) -> str:
    return _W6.replace("unnest(range(1, 17))", f"unnest(range(1, {n_writes + 1}))")


_W6 = f"""
WITH RECURSIVE d AS (SELECT doc_id, hex(encode(text)) AS h, octet_length(encode(text)) AS n FROM documents),
wr AS (SELECT doc_id, k,
         CAST(floor({duck_u(42, 'w6p', 'doc_id', 'k')} * n) AS BIGINT) AS pos,
         CAST(floor({duck_u(42, 'w6v', 'doc_id', 'k')} * 256) AS INTEGER) - 128 AS val
       FROM d, unnest(range(1, 17)) AS t(k) WHERE n > 0),
lastw AS (SELECT doc_id, pos, arg_max(val, k) AS val FROM wr GROUP BY doc_id, pos),
b AS (SELECT doc_id, unnest(range(n)) AS i, unnest(regexp_extract_all(h, '[0-9A-F]{{2}}')) AS hx FROM d),
nb AS (SELECT b.doc_id, b.i,
         CASE WHEN lastw.val IS NULL THEN b.hx
              ELSE upper(lpad(to_hex(CAST((lastw.val + 256) % 256 AS INTEGER)), 2, '0')) END AS hx
       FROM b LEFT JOIN lastw ON b.doc_id = lastw.doc_id AND b.i = lastw.pos),
sc AS (SELECT d.doc_id, d.n, coalesce(string_agg(hx, '' ORDER BY i), '') AS h
       FROM d LEFT JOIN nb ON d.doc_id = nb.doc_id GROUP BY d.doc_id, d.n)
"""
oracle("W6_scramble_bytes", _W6 + "SELECT doc_id, CAST(n AS INTEGER) AS n_bytes, md5(h) AS payload_md5 FROM sc")
oracle("W6h_scramble_head", _W6 + f"SELECT doc_id, CASE WHEN n > 0 THEN CAST({_signed_hex_at('h', '0')} AS INTEGER) END AS head FROM sc")

oracle("W8_apply_workload", _DOC_BYTES + """
SELECT d.doc_id, CAST(count(sb.s) FILTER (WHERE sb.s < 0) AS BIGINT) AS n_high
FROM d LEFT JOIN sb ON d.doc_id = sb.doc_id GROUP BY d.doc_id
""")

oracle("W9_apply_workload_by", _DOC_BYTES + f""",
mm AS (SELECT doc_id, max(s) AS mx, min(s) AS mn FROM sb GROUP BY doc_id),
agg AS (SELECT d.doc_id, d.lang, d.h, d.n, mm.mx, mm.mn FROM d LEFT JOIN mm ON d.doc_id = mm.doc_id)
SELECT doc_id, lang, CAST(CASE
    WHEN lang = 'en' THEN coalesce(mx, -128)
    WHEN lang = 'de' THEN mn
    WHEN lang = 'fr' THEN CASE WHEN n > 0 THEN {_signed_hex_at('h', _W4_POS)} END
    ELSE n END AS BIGINT) AS result
FROM agg
""")


# ------------------------------------------------------------------ records

_TIE = ("l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, "
        "l_tax, l_returnflag, l_linestatus, l_shipdate")
_HEXREC = ("(CASE WHEN length(hex({x})) % 2 = 1 THEN '0' || hex({x}) ELSE hex({x}) END)")


def _signed_low_byte(x: str) -> str:
    return f"(CASE WHEN ({x}) % 256 >= 128 THEN ({x}) % 256 - 256 ELSE ({x}) % 256 END)"


def _signed_key4(x: str) -> str:
    """Order key of 4-byte big-endian records compared byte-wise signed."""
    return " + ".join(f"xor(({x} >> {8 * (3 - i)}) & 255, 128) * {256 ** (3 - i)}" for i in range(4))


oracle("W3_pair_sign_sum", f"""
WITH li AS (SELECT l_orderkey, {_signed_low_byte('l_partkey')} AS v,
              row_number() OVER (PARTITION BY l_orderkey ORDER BY {_TIE}) AS pos FROM lineitem)
SELECT a.l_orderkey, CAST(coalesce(sum(sign(a.v - b.v)), 0) AS BIGINT) AS pair_sign_sum
FROM li a LEFT JOIN li b ON a.l_orderkey = b.l_orderkey AND a.pos < b.pos
GROUP BY a.l_orderkey
""")

# a list of the values of each supplier: the sum over pairs of positions
_SUP_ORDER = "l_orderkey, " + _TIE.replace("l_suppkey, ", "")
oracle("W3b_pair_sign_sum_supplier", f"""
WITH li AS (SELECT l_suppkey, {_signed_low_byte('l_partkey')} AS v,
              row_number() OVER (PARTITION BY l_suppkey ORDER BY {_SUP_ORDER}) AS pos FROM lineitem)
SELECT a.l_suppkey, CAST(coalesce(sum(sign(a.v - b.v)), 0) AS BIGINT) AS pair_sign_sum
FROM li a LEFT JOIN li b ON a.l_suppkey = b.l_suppkey AND a.pos < b.pos
GROUP BY a.l_suppkey
""")

oracle("W7_record_lt", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_partkey < l_suppkey AS lt FROM lineitem
""")

oracle("W7s_record_lt_signed", f"""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
       ({_signed_key4('l_partkey')}) < ({_signed_key4('(l_suppkey * 131)')}) AS lt FROM lineitem
""")

oracle("A1_group_records", f"""
SELECT l_orderkey, CAST(l_linenumber // 4 AS BIGINT) AS page, CAST(count(*) AS INTEGER) AS n_records,
       string_agg({_HEXREC.format(x='l_partkey')}, ',' ORDER BY {_TIE}) AS records_hex
FROM lineitem GROUP BY l_orderkey, l_linenumber // 4
""")

oracle("A2_keyed_max_last_byte", f"""
SELECT l_orderkey, CAST({_signed_low_byte('max(l_partkey)')} AS BIGINT) AS max_last_byte
FROM lineitem GROUP BY l_orderkey
""")

oracle("A2s_keyed_max_last_byte_signed", f"""
SELECT l_orderkey, CAST({_signed_low_byte(f"arg_max(l_partkey, {_signed_key4('l_partkey')})")} AS BIGINT)
       AS max_last_byte
FROM lineitem GROUP BY l_orderkey
""")

oracle("O1_sort_records", f"""
SELECT l_orderkey,
       CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, {_TIE}) AS BIGINT) AS pos,
       {_HEXREC.format(x='l_partkey')} AS rec_hex, l_linenumber, l_suppkey
FROM lineitem
""")


# ------------------------------------------------------------------ queueing
# Lindley's recursion as a recursive CTE over n = position in the queue

_Q_JOBS = """
e AS (SELECT user_id, event_id, epoch_us(ts) AS arrival,
             CAST(round(value * 300.0 * 1000000.0) AS BIGINT) AS service,
             row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n
      FROM events)"""

oracle("Q1_arrival_schedule", f"""
WITH ia AS (SELECT user_id, event_id, ts,
                   CAST(round(-ln({duck_u(42, 'ia', 'event_id')}) * 60000000.0) AS BIGINT) AS interarrival
            FROM events)
SELECT user_id, event_id, interarrival,
       CAST(coalesce(sum(interarrival) OVER (PARTITION BY user_id ORDER BY ts, event_id
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS arrival
FROM ia
""")

_Q2 = f"""
WITH RECURSIVE {_Q_JOBS},
r AS (SELECT user_id, n, event_id, arrival, service, arrival + service AS departure FROM e WHERE n = 1
      UNION ALL
      SELECT e.user_id, e.n, e.event_id, e.arrival, e.service,
             greatest(e.arrival, r.departure) + e.service
      FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1)
SELECT user_id, event_id, arrival, service, departure,
       departure - service - arrival AS waiting, departure - arrival AS sojourn FROM r
"""
oracle("Q2_fifo_departures", _Q2)
oracle("Q2w_fifo_departures_window", _Q2)
oracle("Q2b_fifo_departures_blocked", _Q2)
oracle("Q2r_fifo_departures_ranges", """
WITH e AS (SELECT 'all' AS queue, event_id, epoch_us(ts) AS arrival,
                  CAST(floor(value * 1000) AS BIGINT) AS service FROM events),
s AS (SELECT *, sum(service) OVER (ORDER BY arrival, event_id ROWS UNBOUNDED PRECEDING) AS ss FROM e),
d AS (SELECT *, CAST(ss + max(arrival - ss + service) OVER (ORDER BY arrival, event_id ROWS UNBOUNDED PRECEDING)
                AS BIGINT) AS departure FROM s)
SELECT queue, event_id, arrival, service, departure, departure - service - arrival AS waiting,
       departure - arrival AS sojourn FROM d
""")

_Q_TASKS = f"""
t AS (SELECT user_id, event_id, epoch_us(ts) AS arrival, task,
             CAST(round(value * 1000000.0 * (100.0 + 200.0 * {duck_u(42, 't', 'event_id', 'task')})) AS BIGINT) AS service,
             row_number() OVER (PARTITION BY user_id, task ORDER BY ts, event_id) AS n
      FROM events, unnest(range(1, 4)) AS k(task))"""

oracle("Q3_forkjoin_departures", f"""
WITH RECURSIVE {_Q_TASKS},
r AS (SELECT user_id, task, n, event_id, arrival, arrival + service AS departure FROM t WHERE n = 1
      UNION ALL
      SELECT t.user_id, t.task, t.n, t.event_id, t.arrival, greatest(t.arrival, r.departure) + t.service
      FROM r JOIN t ON t.user_id = r.user_id AND t.task = r.task AND t.n = r.n + 1)
SELECT user_id, event_id, max(arrival) AS arrival, max(departure) AS departure,
       max(departure) - max(arrival) AS sojourn
FROM r GROUP BY user_id, event_id
""")

oracle("Q4_barrier_departures", f"""
WITH RECURSIVE {_Q_TASKS},
j AS (SELECT user_id, event_id, max(arrival) AS arrival, max(service) AS service,
             row_number() OVER (PARTITION BY user_id ORDER BY max(arrival), event_id) AS n
      FROM t GROUP BY user_id, event_id),
r AS (SELECT user_id, n, event_id, arrival, service, arrival + service AS departure FROM j WHERE n = 1
      UNION ALL
      SELECT j.user_id, j.n, j.event_id, j.arrival, j.service, greatest(j.arrival, r.departure) + j.service
      FROM r JOIN j ON j.user_id = r.user_id AND j.n = r.n + 1)
SELECT user_id, event_id, arrival, service, departure,
       departure - service - arrival AS waiting, departure - arrival AS sojourn FROM r
""")


# ------------------------------------------------------------------ placement

_PL = f"""
WITH li AS (SELECT *, {_ROW_ID} AS seq FROM lineitem),
bu AS (SELECT l_returnflag AS app, l_linenumber AS rdd_id, CAST(l_orderkey % 2147483647 AS INTEGER) AS part_id,
              CAST(l_suppkey % 8 AS VARCHAR) AS exec_id, 'host-' || CAST(l_suppkey % 4 AS VARCHAR) AS host,
              l_linestatus = 'F' AS d, l_discount < 0.05 AS m, l_discount < 0.05 AND l_tax < 0.04 AS z,
              CASE WHEN l_quantity >= 45 THEN 2 ELSE 1 END AS replicas,
              CASE WHEN l_discount < 0.05 THEN l_partkey * 10 ELSE 0 END AS memsize,
              CASE WHEN l_linestatus = 'F' THEN l_partkey * 3 ELSE 0 END AS disksize, seq FROM li),
last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY app, rdd_id, part_id, exec_id
                                                     ORDER BY seq DESC) AS k FROM bu) WHERE k = 1),
loc AS (SELECT app, rdd_id, part_id, exec_id, host, memsize, disksize,
          (CASE WHEN d THEN 'Disk ' ELSE '' END) || (CASE WHEN m THEN 'Memory ' ELSE '' END)
            || (CASE WHEN z THEN 'Deserialized ' ELSE 'Serialized ' END) || CAST(replicas AS VARCHAR)
            || 'x Replicated' AS storage_level,
          CAST(d AS INTEGER) * 8 + CAST(m AS INTEGER) * 4 + CAST(z AS INTEGER) AS storage_flags, replicas
        FROM last WHERE d OR m)
"""

oracle("P1_block_locations", _PL + "SELECT * FROM loc WHERE rdd_id <> 7")

_P2 = _PL + """,
placed AS (
  SELECT li.l_returnflag AS app, CAST(li.l_linenumber AS BIGINT) AS stage_id, li.seq AS task_id,
         CAST(li.l_orderkey % 2147483647 AS INTEGER) AS part_id, li.l_linenumber AS rdd_id,
         CAST(li.l_partkey % 8 AS VARCHAR) AS exec_executor, loc.exec_id AS storage_executor,
         loc.memsize, loc.disksize
  FROM li LEFT JOIN loc ON loc.app = li.l_returnflag AND loc.rdd_id = li.l_linenumber
                       AND loc.part_id = CAST(li.l_orderkey % 2147483647 AS INTEGER))
"""
oracle("P2_placement", _P2 + "SELECT * FROM placed")

oracle("A3_executor_partitions", _PL + """
SELECT app, exec_id, rdd_id, CAST(part_id // 4096 AS BIGINT) AS page, count(*) AS n_parts,
       string_agg(CAST(part_id AS VARCHAR), ',' ORDER BY part_id) AS part_ids
FROM loc WHERE rdd_id <> 7 GROUP BY app, exec_id, rdd_id, part_id // 4096
""")

ORACLE["A3b_executor_partition_bitmaps"] = ORACLE["A3_executor_partitions"]

oracle("A4_report_by_executor", _P2 + """
SELECT app, exec_executor, count(*) AS n_rows, count(DISTINCT task_id) AS n_tasks,
       sum(CASE WHEN exec_executor = storage_executor THEN 1 ELSE 0 END) AS n_local,
       sum(memsize) AS mem_bytes, sum(disksize) AS disk_bytes
FROM placed GROUP BY app, exec_executor
""")

_MOVED_SAME = """l_returnflag AS app, l_linenumber AS rdd_id,
         CAST(l_orderkey % 1024 AS INTEGER) AS part_id"""
_P2T = f"""
WITH li AS (SELECT *, {_ROW_ID} AS row, l_discount < 0.05 AS m, l_linestatus = 'F' AS d FROM lineitem),
u AS (
  SELECT {_MOVED_SAME}, CAST(l_suppkey % 8 AS VARCHAR) AS ex, row * 8 AS seq,
         CASE WHEN m THEN l_partkey * 10 ELSE 0 END AS memsize, CASE WHEN d THEN l_partkey * 3 ELSE 0 END AS disksize,
         m OR d AS held FROM li
  UNION ALL SELECT {_MOVED_SAME}, CAST(l_suppkey % 8 AS VARCHAR), row * 8 + 1, 0, 0, false FROM li WHERE l_partkey % 3 = 1
  UNION ALL SELECT {_MOVED_SAME}, CAST(l_suppkey % 8 AS VARCHAR), row * 8 + 3, 0, 0, false FROM li WHERE l_partkey % 3 = 0
  UNION ALL SELECT {_MOVED_SAME}, CAST((l_suppkey + 1) % 8 AS VARCHAR), row * 8 + 4, l_partkey, 0, true
  FROM li WHERE l_partkey % 3 = 0),
t AS (
  SELECT {_MOVED_SAME}, CAST(l_linenumber AS BIGINT) AS stage_id, row AS task_id,
         CAST(l_partkey % 8 AS VARCHAR) AS exec_executor, row * 8 + 2 AS seq FROM li),
own AS (SELECT DISTINCT app, rdd_id, part_id, ex FROM u),
asked AS (SELECT t.*, own.ex FROM t JOIN own USING (app, rdd_id, part_id)),
known AS (
  SELECT a.*, u.seq AS stored_at, u.memsize, u.disksize, u.held FROM asked a ASOF JOIN u
  ON a.app = u.app AND a.rdd_id = u.rdd_id AND a.part_id = u.part_id AND a.ex = u.ex AND a.seq > u.seq),
held AS (
  SELECT * FROM known
  WHERE held AND NOT (rdd_id = 7 AND stored_at < 18014398509481991 AND seq > 18014398509481991)),
placed AS (
  SELECT t.app, t.stage_id, t.task_id, t.part_id, t.rdd_id, t.exec_executor, held.ex AS storage_executor,
         held.memsize, held.disksize
  FROM t LEFT JOIN held ON held.app = t.app AND held.stage_id = t.stage_id AND held.task_id = t.task_id)
"""
oracle("P2t_placement_as_of", _P2T + "SELECT * FROM placed")

oracle("A4t_report_by_executor_as_of", _P2T + """
SELECT app, exec_executor, count(*) AS n_rows, count(DISTINCT task_id) AS n_tasks,
       sum(CASE WHEN exec_executor = storage_executor THEN 1 ELSE 0 END) AS n_local,
       sum(memsize) AS mem_bytes, sum(disksize) AS disk_bytes
FROM placed GROUP BY app, exec_executor
""")

oracle("P3_partition_profile", """
SELECT CAST(((s_suppkey - 1) % 16 + 16) % 16 AS INTEGER) AS part, count(*) AS rows, CAST(40 * count(*) AS BIGINT) AS bytes,
       min(s_suppkey) AS min_key, max(s_suppkey) AS max_key
FROM supplier GROUP BY 1
""")

oracle("P3h_partition_profile_hosts", f"""
SELECT count(*) AS rows, CAST(16 * count(*) AS BIGINT) AS bytes,
       min(CAST(floor({duck_u(42, 'key', 'o_orderkey')} * 7) AS INTEGER)) AS min_key,
       max(CAST(floor({duck_u(42, 'key', 'o_orderkey')} * 7) AS INTEGER)) AS max_key, true AS hosts_known
FROM orders
""")

# payload of every part row: PAYLOAD(42, p_partkey, p_size), as bytes
_PART_BYTES = f"""
WITH p AS (SELECT p_partkey, p_brand, p_size, {duck_payload_hex(42, 'p_partkey', 'p_size')} AS h FROM part),
pb AS (SELECT p_partkey, ('0x' || unnest(regexp_extract_all(h, '[0-9A-F]{{2}}')))::INTEGER AS u FROM p),
mx AS (SELECT p.p_partkey, p.p_brand,
              CAST(coalesce(max(CASE WHEN u >= 128 THEN u - 256 ELSE u END), -128) AS BIGINT) AS result
       FROM p LEFT JOIN pb ON p.p_partkey = pb.p_partkey GROUP BY p.p_partkey, p.p_brand)
"""
oracle("E1_plain", _PART_BYTES + "SELECT p_partkey, result FROM mx")
oracle("E3_barrier", _PART_BYTES + "SELECT p_partkey, result FROM mx")
oracle("E3s_barrier_scaled", _PART_BYTES + """,
r AS (SELECT min(result) AS low, max(result) AS high FROM mx)
SELECT p_partkey, result, low, high, (result - low) * 1000 // greatest(high - low, 1) AS scaled FROM mx, r
""")
oracle("E4_persisted", _PART_BYTES + "SELECT p_partkey, result FROM mx")
oracle("E2_staged", _PART_BYTES + """
SELECT p_brand, count(*) AS n, max(result) AS result_max, sum(result) AS result_sum FROM mx GROUP BY p_brand
""")
oracle("A6_slice_count", "SELECT count(*) AS slices FROM part")
oracle("A7_staged_count", "SELECT CAST(CASE WHEN count(*) > 0 THEN 1 ELSE 0 END AS BIGINT) AS staged_count FROM part")


# ------------------------------------------------------------------ streaming

ORACLE["S2_stream_event_counts"] = ORACLE["S1_event_counts"]

_LOCAL = TASK_LOCAL_METRICS
oracle("M6_stream_task_index_stats", """
WITH t AS (
  SELECT l_linenumber AS taskIndex,
    CAST(CAST(floor(l_quantity * 100) AS BIGINT) + l_partkey % 50 AS DOUBLE) AS serviceTime,
    l_partkey % 13 AS jvmGcTime,
    l_linenumber * 10 + l_suppkey % 7 AS executorDeserializeTime,
    CAST(floor(l_quantity * 100) AS BIGINT) AS executorRunTime,
    l_suppkey % 3 AS resultSerializationTime,
    CAST(floor(l_discount * 1000) AS BIGINT) AS shuffleFetchWaitTime,
    CAST(floor(l_tax * 1000000) AS BIGINT) AS shuffleWriteTime,
    (l_suppkey % 7) * 1000000 + l_partkey AS executorDeserializeCpuTime,
    CAST(floor(l_extendedprice * 1000) AS BIGINT) AS executorCpuTime
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT taskIndex, count(serviceTime) AS "count", """ + ",\n  ".join(
    f"round(avg({m}), 6) AS avg_{m}, round(sqrt(var_samp({m})), 3) AS var_{m}" for m in _LOCAL)
    + "\nFROM t GROUP BY taskIndex")

def _by_slot(slots: int) -> str:
    slot = f"((s_suppkey - 1) % {slots} + {slots}) % {slots}"
    size = f"CASE {slot} WHEN 0 THEN 5 WHEN 1 THEN 9 ELSE 2 END"
    return f"""
SELECT s_suppkey AS id, CAST({slot} AS VARCHAR) AS label, {size} AS size,
       {duck_payload_hex(42, 's_suppkey', size)} AS payload_hex FROM supplier
"""


oracle("G4e_sized_by_slot", _by_slot(3))
oracle("G4t_sized_by_thread", _by_slot(5))
oracle("G4h_sized_by_host", f"""
SELECT s_suppkey AS id, 8 AS size, {duck_payload_hex(42, 's_suppkey', '8')} AS payload_hex FROM supplier
""")

# tumbling 365-day windows from the epoch
_W_MS = 365 * 86400 * 1000
_ALL_TASKS = (_TASKS_CTE
              .replace("  WHERE NOT (li.l_orderkey % 10 = 3 AND li.l_linenumber % 3 = 0)),", "),")
              .replace("SELECT o.app, o.end_ms, o.sub_ms, li.*,", """SELECT o.app, j.end_ms,
         o.start_ms + CASE WHEN li.l_orderkey % 10 = 3 AND li.l_linenumber % 3 <> 0 THEN 500 ELSE 0 END AS sub_ms,
         li.*,""")
              .replace("FROM li JOIN o ON li.l_orderkey = o.o_orderkey\n),",
                       "FROM li JOIN o ON li.l_orderkey = o.o_orderkey JOIN j ON j.o_orderkey = o.o_orderkey),")
              .replace("li AS (", """j AS (
  SELECT o_orderkey, epoch_ms(o_orderdate) + 20000 + CAST(floor(o_totalprice) AS BIGINT) % 1000 AS end_ms
  FROM orders WHERE o_orderstatus <> 'P'),
li AS (""", 1).replace("  FROM tt WHERE end_ms IS NOT NULL)", "    , launch_ms\n  FROM tt WHERE end_ms IS NOT NULL)"))
# every task, timed against its own attempt and the end of the job it ran in (a
# job that starts after a task has finished is no partner in the stream)
oracle("M6w_stream_windowed_index_stats", _ALL_TASKS + f""",
tw AS (SELECT *, launch_ms + CAST(serviceTime AS BIGINT) AS finish_ms FROM t),
g AS (SELECT (finish_ms // {_W_MS}) * {_W_MS} AS window_start_ms, * FROM tw)
SELECT window_start_ms, window_start_ms + {_W_MS} AS window_end_ms, taskIndex,
  count(serviceTime) AS "count",
  {_stats}
FROM g GROUP BY window_start_ms, taskIndex
""")

oracle("P2h_hybrid_placement", _P2 + f""",
ph AS (SELECT *, {duck_payload_hex(42, 'task_id', '8')} AS h FROM placed),
pb AS (SELECT task_id, ('0x' || unnest(regexp_extract_all(h, '[0-9A-F]{{2}}')))::INTEGER AS u
       FROM (SELECT DISTINCT task_id, h FROM ph)),
mm AS (SELECT task_id, max(CASE WHEN u >= 128 THEN u - 256 ELSE u END) AS mx,
              min(CASE WHEN u >= 128 THEN u - 256 ELSE u END) AS mn FROM pb GROUP BY task_id)
SELECT ph.app, ph.task_id, ph.part_id, ph.exec_executor, ph.storage_executor, CAST(CASE ph.exec_executor
    WHEN '0' THEN mm.mx WHEN '1' THEN mm.mn
    WHEN '2' THEN {_signed_hex_at('ph.h', f"CAST(floor({duck_u(42, 'w4', 'ph.task_id')} * 8) AS BIGINT)")}
    ELSE 8 END AS BIGINT) AS result
FROM ph JOIN mm ON ph.task_id = mm.task_id
""")

ORACLE["A5i_task_index_stats_incremental"] = ORACLE["A5_task_index_stats"]
ORACLE["A5m_task_index_stats_materialized"] = ORACLE["A5_task_index_stats"]

# W3 over whole documents. Independent of the block-histogram kernel: the
# number of earlier bytes greater than byte j is summed over the 8 bit
# levels (an earlier byte is greater when it agrees on the higher bits and
# has a 1 where byte j has a 0), each level one running window count; then
# sign sum = sum over j of (2 * greater_before - before + equal_before).
oracle("W3_doc_pair_sign_sum", """
WITH d AS (SELECT doc_id, hex(encode(text)) AS h, octet_length(encode(text)) AS n FROM documents),
b AS (SELECT doc_id, unnest(range(n)) AS i,
             ('0x' || unnest(regexp_extract_all(h, '[0-9A-F]{2}')))::INTEGER AS u FROM d),
s AS (SELECT doc_id, i, (CASE WHEN u >= 128 THEN u - 256 ELSE u END) + 128 AS v FROM b),
g AS (SELECT s.doc_id, s.i, (s.v >> lv.bit) & 1 AS bt,
             coalesce(sum((s.v >> lv.bit) & 1) OVER (
               PARTITION BY s.doc_id, lv.bit, s.v >> (lv.bit + 1) ORDER BY s.i
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ones_before
      FROM s, (SELECT unnest(range(8)) AS bit) lv),
gj AS (SELECT doc_id, i, sum(CASE WHEN bt = 0 THEN ones_before ELSE 0 END) AS greater_before
       FROM g GROUP BY doc_id, i),
e AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, v ORDER BY i
                                        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS equal_before
      FROM s)
SELECT d.doc_id, CAST(coalesce(sum(2 * gj.greater_before - gj.i + e.equal_before), 0) AS BIGINT)
       AS pair_sign_sum
FROM d LEFT JOIN gj ON d.doc_id = gj.doc_id
       LEFT JOIN e ON gj.doc_id = e.doc_id AND gj.i = e.i
GROUP BY d.doc_id
""")

# chunked forms: the same values as the one-row forms
ORACLE["W1c_byte_max_chunked"] = ORACLE["W1_byte_max"]
ORACLE["W3c_doc_pair_sign_sum_chunked"] = ORACLE["W3_doc_pair_sign_sum"]

_CHUNKS = "FROM (SELECT s_suppkey, unnest(range(0, 4)) AS c FROM supplier)"
oracle("G2c_zero_partitions_chunked", f"""
SELECT s_suppkey AS id, c AS chunk, CAST(least(32, 100 - 32 * c) AS INTEGER) AS n_bytes,
       md5(repeat('00', CAST(least(32, 100 - 32 * c) AS INTEGER))) AS payload_md5
{_CHUNKS}
""")

oracle("G3c_random_partitions_chunked", f"""
SELECT s_suppkey AS id, c AS chunk,
       substr({duck_payload_hex(42, 's_suppkey', '100')}, 64 * c + 1, 2 * CAST(least(32, 100 - 32 * c) AS INTEGER))
         AS payload_hex
{_CHUNKS}
""")

oracle("M5k_flat_tasks_keep_incomplete",
       _TASKS_CTE.replace("FROM tt WHERE end_ms IS NOT NULL)", "FROM tt)") + "SELECT * FROM t")

oracle("W6m_scramble_many_writes",
       _w6_sql(1000) + "SELECT doc_id, CAST(n AS INTEGER) AS n_bytes, md5(h) AS payload_md5 FROM sc")

# the same tables read back from log files
oracle("M6t_stream_task_table", _TASKS_CTE + f"""
SELECT app, taskId, stageId, taskIndex, {", ".join(_STAT_METRICS)} FROM t
""")
ORACLE["M6s_stream_stateful_index_stats"] = ORACLE["A5_task_index_stats"]
ORACLE["S1f_event_counts_files"] = ORACLE["S1_event_counts"]
ORACLE["M1f_jobs_files"] = ORACLE["M1_jobs"]
ORACLE["M5f_flat_tasks_files"] = ORACLE["M5_flat_tasks_full"]
ORACLE["P1r_block_locations_rolled"] = ORACLE["P1_block_locations"]
ORACLE["A4r_report_by_executor_rolled"] = ORACLE["A4_report_by_executor"]
