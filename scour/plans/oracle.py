"""DuckDB oracle SQL for the registered queries (tables pre-registered as views).

Queries missing here are checked on row count only:
``outliers_approx`` (approximate quartiles by design; ``outliers_ranks`` checks
what they promise), ``verify_checksum`` (DuckDB has no crc32;
``verify_checksum_ok`` checks the verdicts).
"""

from __future__ import annotations

from ..functions.text import DB_URL_PASSWORD, KEY_VALUE_PASSWORD, MASK, WARNING_WORDS
from .queries import (BATCH_SQL, EVENTS_NULLS_SQL, FILTER_CONDITION, LINEITEM_NUMERIC, LOG_SQL,
                      ORACLE_DIR, ORDERS_NULLS_SQL, PERTURBED_SQL, R, REGISTRY_SQL, SECRET_SUFFIX,
                      SKEWED_SQL, STANDARDIZE_COLS)


def _fill_stat(stat_sql: str) -> str:
    return f"""WITH {EVENTS_NULLS_SQL},
stat AS ({stat_sql})
SELECT event_id, round(coalesce(value, (SELECT v FROM stat)), {R}) AS value FROM events_n"""


def _profile() -> str:
    parts = []
    for c in LINEITEM_NUMERIC:
        x = f"CAST({c} AS DOUBLE)"
        parts.append(
            f"SELECT '{c}' AS column_name, count({c}) AS count, round(avg({x}), {R}) AS mean, "
            f"round(stddev_samp({x}), {R}) AS stddev, round(min({x}), {R}) AS min, "
            f"round(quantile_cont({x}, 0.25), {R}) AS p25, round(quantile_cont({x}, 0.5), {R}) AS p50, "
            f"round(quantile_cont({x}, 0.75), {R}) AS p75, round(max({x}), {R}) AS max FROM lineitem")
    return "\nUNION ALL\n".join(parts)


def _iqr(c: str, src: str) -> str:
    return (f"SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM {src}")


def _keep(c: str, q: str) -> str:
    return (f"({c} IS NULL OR ({c} >= {q}.q1 - 1.5 * ({q}.q3 - {q}.q1) "
            f"AND {c} <= {q}.q3 + 1.5 * ({q}.q3 - {q}.q1)))")


def _standardize() -> str:
    stats = ", ".join(f"avg({c}) AS m_{c}, stddev_samp({c}) AS s_{c}" for c in STANDARDIZE_COLS)
    cols = ", ".join(f"round(({c} - m_{c}) / s_{c}, {R}) AS {c}" for c in STANDARDIZE_COLS)
    return f"WITH s AS (SELECT {stats} FROM lineitem)\nSELECT l_orderkey, l_linenumber, {cols} FROM lineitem, s"


def _upsert(mode: str, match_class: bool) -> str:
    cls = ("CASE WHEN {t} IN ('minio', 'clickhouse') THEN {t} ELSE 'db' END" if match_class
           else "{t}")
    rcls, bcls = cls.format(t="r.source_type"), cls.format(t="b.source_type")
    rows = ("r.row_count + b.row_count" if mode == "add" else "b.row_count")
    keep_type = "coalesce(b.source_type, r.source_type)" if match_class else "r.source_type"
    keep_src = "coalesce(b.source_name, r.source_name)" if match_class else "r.source_name"
    return f"""WITH {REGISTRY_SQL},
{BATCH_SQL},
j AS (
  SELECT r.id, coalesce(r.table_name, b.table_name) AS table_name,
         CASE WHEN r.id IS NULL THEN b.source_type ELSE {keep_type} END AS source_type,
         CASE WHEN r.id IS NULL THEN b.source_name ELSE {keep_src} END AS source_name,
         CAST(CASE WHEN r.id IS NOT NULL AND b.table_name IS NOT NULL THEN {rows}
                   WHEN b.table_name IS NOT NULL THEN b.row_count
                   ELSE r.row_count END AS BIGINT) AS row_count
  FROM reg r FULL OUTER JOIN batch b
    ON r.table_name = b.table_name AND {rcls} = {bcls})
SELECT id, table_name, source_type, source_name, row_count FROM j WHERE id IS NOT NULL
UNION ALL
SELECT (SELECT max(id) FROM reg) + row_number() OVER (ORDER BY table_name, source_type) AS id,
       table_name, source_type, source_name, row_count
FROM j WHERE id IS NULL"""


def _coerce() -> str:
    return f"""WITH t AS (
  SELECT event_id,
         CASE event_id % 5 WHEN 0 THEN '' WHEN 1 THEN CAST(user_id AS VARCHAR)
              WHEN 2 THEN CAST(value AS VARCHAR)
              WHEN 3 THEN CASE WHEN user_id % 2 = 0 THEN 'yes' ELSE 'N' END
              ELSE 'abc' END AS raw
  FROM events),
c AS (
  SELECT event_id, raw,
         CASE WHEN regexp_full_match(nullif(raw, ''), '\\s*[+-]?[0-9]+\\s*')
              THEN TRY_CAST(trim(raw) AS BIGINT) END AS as_int,
         TRY_CAST(trim(nullif(raw, '')) AS DOUBLE) AS as_double,
         CASE WHEN lower(trim(nullif(raw, ''))) IN ('true', '1', 'yes', 'y') THEN true
              WHEN lower(trim(nullif(raw, ''))) IN ('false', '0', 'no', 'n') THEN false END AS as_bool
  FROM t)
SELECT event_id, raw, as_int, as_double, as_bool,
       raw IS NOT NULL AND raw <> '' AND as_int IS NULL AS as_int_rejected,
       raw IS NOT NULL AND raw <> '' AND as_double IS NULL AS as_double_rejected,
       raw IS NOT NULL AND raw <> '' AND as_bool IS NULL AS as_bool_rejected
FROM c"""


def _explore() -> str:
    out = []
    for name, text, number in (
            ("count", "CAST(count(event_type) AS VARCHAR)", "count({c})"), ("mean", "NULL", "avg({c})"),
            ("stddev", "NULL", "stddev_samp({c})"), ("min", "min(event_type)", "min({c})"),
            ("25%", "NULL", "quantile_cont({c}, 0.25)"), ("50%", "NULL", "quantile_cont({c}, 0.5)"),
            ("75%", "NULL", "quantile_cont({c}, 0.75)"), ("max", "max(event_type)", "max({c})")):
        out.append(f"SELECT count(*) AS total_rows, '{name}' AS summary, CAST({text} AS VARCHAR) AS event_type, "
                   f"round(CAST({number.format(c='value')} AS DOUBLE), {R}) AS value FROM events_n")
    return f"WITH {EVENTS_NULLS_SQL}\n" + "\nUNION ALL ".join(out)


def _redact() -> str:
    s0, s1, s2, s3 = SECRET_SUFFIX
    out = (f"text || '{s0}' || CAST(doc_id AS VARCHAR) || '{s1}' || CAST(doc_id AS VARCHAR) "
           f"|| '{s2}' || CAST(doc_id AS VARCHAR) || '{s3}' || CAST(doc_id AS VARCHAR)")
    for pattern, kept in ((DB_URL_PASSWORD, "\\3"), (KEY_VALUE_PASSWORD, "")):
        pattern = pattern.removeprefix("(?i)").replace("'", "''")
        out = f"regexp_replace({out}, '{pattern}', '\\1{MASK}{kept}', 'gi')"
    return f"SELECT doc_id, {out} AS text FROM documents"


def _warning() -> str:
    t = "lower(concat_ws(' ', action, details))"
    cond = " OR ".join(f"contains({t}, '{w}')" for w in WARNING_WORDS)
    return f"WITH {LOG_SQL}\nSELECT id, action, ({cond}) AS warning FROM log"


ORACLE: dict[str, str] = {
    "dedup_rows": "SELECT DISTINCT user_id, event_type FROM events",
    "dedup_key_latest": """SELECT event_id, user_id, event_type, ts, value FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn
  FROM events) WHERE rn = 1""",
    "filter_sql": f"""SELECT l_orderkey, l_linenumber, l_quantity, l_discount, l_returnflag
FROM lineitem WHERE {FILTER_CONDITION}""",
    "fill_constant": f"""WITH {ORDERS_NULLS_SQL}
SELECT o_orderkey, o_custkey, coalesce(o_orderstatus, 'UNKNOWN') AS o_orderstatus,
       coalesce(o_orderpriority, 'UNKNOWN') AS o_orderpriority, o_totalprice FROM orders_n""",
    "fill_subset": f"""WITH {ORDERS_NULLS_SQL}
SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority,
       coalesce(o_totalprice, 0.0) AS o_totalprice FROM orders_n""",
    "fill_mean": _fill_stat("SELECT avg(value) AS v FROM events_n"),
    "fill_median": _fill_stat("SELECT quantile_cont(value, 0.5) AS v FROM events_n"),
    "fill_mode": _fill_stat("SELECT value AS v FROM events_n WHERE value IS NOT NULL "
                            "GROUP BY value ORDER BY count(*) DESC, value ASC LIMIT 1"),
    "drop_any": f"""WITH {ORDERS_NULLS_SQL}
SELECT * FROM orders_n WHERE o_orderkey IS NOT NULL AND o_custkey IS NOT NULL
  AND o_orderstatus IS NOT NULL AND o_orderpriority IS NOT NULL AND o_totalprice IS NOT NULL""",
    "drop_subset": f"""WITH {ORDERS_NULLS_SQL}
SELECT * FROM orders_n WHERE o_orderpriority IS NOT NULL""",
    "rename_swap": """SELECT p_partkey, p_name AS p_brand, p_brand AS p_name, p_type, p_size,
       p_retailprice FROM part""",
    "profile": _profile(),
    "outliers_iqr": f"""WITH qa AS ({_iqr('value', 'events')}), qb AS ({_iqr('user_id', 'events')})
SELECT event_id, user_id, value FROM events, qa, qb
WHERE {_keep('value', 'qa')} AND {_keep('user_id', 'qb')}""",
    "outliers_sequential": f"""WITH {SKEWED_SQL},
qa AS ({_iqr('unit', 'skewed')}),
s1 AS (SELECT skewed.* FROM skewed, qa WHERE {_keep('unit', 'qa')}),
qb AS ({_iqr('cube', 's1')}),
s2 AS (SELECT s1.* FROM s1, qb WHERE {_keep('cube', 'qb')})
SELECT l_orderkey, l_linenumber FROM s2""",
    "outliers_ranks": "SELECT count(*) AS n, true AS q1_ok, true AS q3_ok FROM lineitem",
    "standardize": _standardize(),
    "spec_chain": f"""WITH f AS (SELECT DISTINCT * FROM lineitem WHERE l_quantity > 10),
q AS ({_iqr('l_extendedprice', 'f')}),
o AS (SELECT f.* FROM f, q WHERE {_keep('l_extendedprice', 'q')}),
s AS (SELECT avg(l_quantity) AS mq, stddev_samp(l_quantity) AS sq,
             avg(l_extendedprice) AS mp, stddev_samp(l_extendedprice) AS sp FROM o)
SELECT l_orderkey, l_linenumber, round((l_quantity - mq) / sq, {R}) AS l_quantity,
       round((l_extendedprice - mp) / sp, {R}) AS l_extendedprice, l_returnflag FROM o, s""",
    "verify_counts": f"""WITH {PERTURBED_SQL}
SELECT 'row_count' AS check_name, (SELECT count(*) FROM orders) AS source,
       (SELECT count(*) FROM copy) AS target,
       (SELECT count(*) FROM orders) = (SELECT count(*) FROM copy) AS ok""",
    "verify_checksum_ok": f"""WITH {PERTURBED_SQL}
SELECT * FROM (VALUES ('same', 'row_count', true), ('same', 'checksum', true),
  ('changed', 'row_count', (SELECT count(*) FROM copy) = (SELECT count(*) FROM orders)),
  ('changed', 'checksum', NOT EXISTS (SELECT * FROM orders EXCEPT ALL SELECT * FROM copy)),
  ('lossy', 'row_count', NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey % 100 = 0)),
  ('lossy', 'checksum', NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey % 100 = 0))) AS v(copy, check_name, ok)""",
    "status": f"""WITH {PERTURBED_SQL}
SELECT 'same' AS copy, 'success' AS status
UNION ALL SELECT 'changed', CASE WHEN EXISTS (SELECT * FROM orders EXCEPT ALL SELECT * FROM copy) THEN 'failed' ELSE 'success' END
UNION ALL SELECT 'lossy', CASE WHEN EXISTS (SELECT 1 FROM orders WHERE o_orderkey % 100 = 0) THEN 'failed' ELSE 'success' END""",
    "verify_diff": f"""WITH {PERTURBED_SQL}
SELECT 'source_only' AS side, * FROM (SELECT * FROM orders EXCEPT ALL SELECT * FROM copy)
UNION ALL
SELECT 'target_only' AS side, * FROM (SELECT * FROM copy EXCEPT ALL SELECT * FROM orders)""",
    "registry_upsert": _upsert("add", True),
    "registry_set": _upsert("set", False),
    "catalog_search": f"""WITH {REGISTRY_SQL},
assets AS (
  SELECT CAST(NULL AS BIGINT) AS id, parse_filename(file) AS name, 'file' AS type,
         'Local File' AS source, CAST(0 AS BIGINT) AS rows
  FROM glob('{ORACLE_DIR}/*')
  WHERE lower(file) LIKE '%.csv' OR lower(file) LIKE '%.parquet' OR lower(file) LIKE '%.json'
  UNION ALL
  SELECT id, table_name, CASE WHEN source_type = 'minio' THEN 'bucket' ELSE 'table' END,
         source_type, row_count FROM reg)
SELECT * FROM assets WHERE contains(lower(name), 'tion_1')""",
    "asset_remove": f"""WITH {REGISTRY_SQL}
SELECT * FROM reg WHERE id NOT IN (1, 5, 9) AND table_name <> 'nation_3'""",
    "page": """SELECT c_custkey, c_name, c_acctbal FROM customer
ORDER BY c_acctbal DESC, c_custkey ASC LIMIT 50 OFFSET 100""",
    "page_rowid": """WITH p AS (SELECT c_custkey, c_acctbal FROM customer
  ORDER BY c_acctbal DESC, c_custkey ASC LIMIT 50 OFFSET 100)
SELECT c_custkey, c_acctbal,
       CAST(100 + row_number() OVER (ORDER BY c_acctbal DESC, c_custkey ASC) - 1 AS VARCHAR) AS _rowid
FROM p""",
    "update_rows": """WITH ch AS (SELECT c_custkey, 'UPDATED-' || c_mktsegment AS seg FROM customer
  WHERE c_custkey % 10 = 0)
SELECT c.c_custkey, c.c_name, c.c_nationkey, c.c_acctbal,
       CASE WHEN ch.c_custkey IS NOT NULL THEN ch.seg ELSE c.c_mktsegment END AS c_mktsegment
FROM customer c LEFT JOIN ch ON c.c_custkey = ch.c_custkey""",
    "delete_rows": """SELECT * FROM customer c
WHERE NOT EXISTS (SELECT 1 FROM customer k WHERE k.c_custkey % 10 = 0 AND k.c_custkey = c.c_custkey)""",
    "coerce": _coerce(),
    "structure": """SELECT CAST(ordinal_position - 1 AS INTEGER) AS position, column_name AS name,
       CASE data_type WHEN 'BIGINT' THEN 'bigint' WHEN 'VARCHAR' THEN 'string'
                      WHEN 'INTEGER' THEN 'int' WHEN 'DOUBLE' THEN 'double'
                      ELSE lower(data_type) END AS type,
       is_nullable = 'YES' AS nullable
FROM information_schema.columns WHERE table_name = 'part'""",
    "audit_page": f"""WITH {LOG_SQL}
SELECT id, user_id, action, resource, timestamp FROM log WHERE action = 'task_failed'
ORDER BY timestamp DESC, id DESC LIMIT 50 OFFSET 20""",
    "audit_count": f"""WITH {LOG_SQL}
SELECT count(*) AS total FROM log WHERE action = 'purchase' AND resource = 'task_3'""",
    "audit_delete": f"""WITH {LOG_SQL}
SELECT id, action, resource FROM log
WHERE id % 3 <> 0""",
    "audit_warning": _warning(),
    "last_failure": f"""WITH {LOG_SQL},
r AS (SELECT *, row_number() OVER (PARTITION BY resource ORDER BY timestamp DESC, id DESC) AS rn
      FROM log),
f AS (SELECT *, row_number() OVER (PARTITION BY resource ORDER BY rn) AS k FROM r
      WHERE rn <= 10 AND action IN ('task_failed', 'verification_failed'))
SELECT resource, timestamp AS failed_at, action AS failure_action, id AS failure_id, details
FROM f WHERE k = 1""",
    "duplicates": """SELECT source, lang, count(*) AS n FROM documents GROUP BY source, lang
HAVING count(*) > 1""",
    "redact": _redact(),
    "truncate": """SELECT doc_id, CASE WHEN length(text) > 8000
  THEN substring(text, 1, 8000) || chr(10) || '...<truncated>' ELSE text END AS text FROM documents""",
    "deleted_summary": f"""WITH {REGISTRY_SQL}
SELECT count(*) AS n, 'Deleted ' || CAST(count(*) AS VARCHAR) || ' tasks: '
       || coalesce(array_to_string(list_sort(list(table_name)), ', '), '') AS details
FROM reg WHERE source_type = 'minio'""",
    "csv_roundtrip": "SELECT * FROM supplier",
    "parquet_roundtrip": "SELECT * FROM supplier",
    "json_roundtrip": "SELECT * FROM supplier",
    "asset_scan": f"""SELECT parse_filename(filename) AS name, 'file' AS type, size AS size_bytes
FROM read_blob('{ORACLE_DIR}/*')
WHERE lower(filename) LIKE '%.csv' OR lower(filename) LIKE '%.parquet' OR lower(filename) LIKE '%.json'""",
    "object_copy": f"""SELECT parse_filename(file) AS Key, true AS ok FROM glob('{ORACLE_DIR}/*.parquet')""",
    "stream_ingest": """SELECT event_id, user_id, event_type, value FROM events WHERE value >= 1.0""",
    "dedup_key": "SELECT DISTINCT user_id, event_type FROM events",
    "standardize_auto": f"""WITH s AS (
  SELECT avg(p_partkey) AS mk, stddev_samp(p_partkey) AS sk, avg(p_size) AS ms,
         stddev_samp(p_size) AS ss, avg(p_retailprice) AS mr, stddev_samp(p_retailprice) AS sr
  FROM part)
SELECT round((p_partkey - mk) / sk, {R}) AS p_partkey, p_name, p_brand, p_type,
       round((p_size - ms) / ss, {R}) AS p_size, round((p_retailprice - mr) / sr, {R}) AS p_retailprice
FROM part, s""",
    "page_after": """SELECT c_custkey, c_name FROM customer WHERE c_custkey > 700
ORDER BY c_custkey LIMIT 25""",
    "nan_to_null": """SELECT event_id, CASE WHEN event_id % 9 = 0 THEN NULL ELSE value END AS value
FROM events""",
    "name_search": """SELECT p_partkey, p_name, p_brand FROM part
WHERE contains(p_name, 'ring') AND p_brand = 'Brand#2'""",
    "new_only": """SELECT p_partkey, p_name FROM part p
WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_partkey = p.p_partkey AND l.l_quantity > 45)""",
    "verify_append": f"""WITH {PERTURBED_SQL},
n AS (SELECT (SELECT count(*) FROM orders) AS a, (SELECT count(*) FROM copy) AS c,
             (SELECT count(*) FROM orders WHERE o_orderkey % 100 <> 0) AS l)
SELECT 'append_count' AS check_name, a + c AS source, a + c AS target, true AS ok FROM n
UNION ALL SELECT 'append_count', a + 2 * c, a + c + l, c = l FROM n""",
    "verify_messages": """WITH n AS (SELECT (SELECT count(*) FROM orders) AS a,
                  (SELECT count(*) FROM orders WHERE o_orderkey % 100 <> 0) AS b)
SELECT 'row_count' AS check_name,
       'row_count differs: ' || CAST(a AS VARCHAR) || ' in the source, ' || CAST(b AS VARCHAR)
         || ' in the target' AS details
FROM n WHERE a <> b""",
    "copy_verify": """WITH f AS (SELECT unnest(['parquet', 'csv']) AS format),
t AS (SELECT 'supplier' AS copied, (SELECT count(*) FROM supplier) AS n
      UNION ALL SELECT 'documents', (SELECT count(*) FROM documents))
SELECT copied, format, 'row_count' AS check_name, n AS rows, true AS ok FROM t, f
UNION ALL SELECT copied, format, 'checksum', NULL, true FROM t, f""",
    "csv_documents": "SELECT doc_id, md5(text) AS text_md5, lang, n_chars FROM documents",
    "csv_splits": "SELECT doc_id, md5(text) AS text_md5, lang, n_chars FROM documents",
    "file_query": "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY o_orderstatus",
    "export_json": "SELECT c_custkey, c_name, c_nationkey FROM customer",
    "explore": _explore(),
    "total_rows": """SELECT 'orders' AS name, count(*) AS n FROM orders
UNION ALL SELECT 'lineitem', count(*) FROM lineitem UNION ALL SELECT 'events', count(*) FROM events
UNION ALL SELECT 'documents', count(*) FROM documents""",
    "pick_key": """SELECT 'nation' AS name, 'n_nationkey' AS picked, count(*) AS n FROM nation
UNION ALL SELECT 'customer', 'c_custkey', count(*) FROM customer
UNION ALL SELECT 'documents', 'doc_id', count(*) FROM documents""",
    "poll_increment": "SELECT event_id, user_id, event_type, value FROM events",
    "edit_files": """
SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey < low + 200 THEN 0.5 ELSE o_totalprice END AS o_totalprice,
       CASE WHEN o_orderkey < low + 200 THEN 'X' ELSE o_orderstatus END AS o_orderstatus
FROM orders, (SELECT min(o_orderkey) AS low FROM orders) WHERE o_orderkey >= low + 50""",
    "export_json_array": "SELECT c_custkey, c_name, c_nationkey FROM customer",
    "poll_stream": "SELECT event_id, user_id, event_type, value FROM events",
    "stream_dedup_ingest": "SELECT DISTINCT user_id, event_type FROM events",
    "stream_first": """
WITH RECURSIVE e AS (
  SELECT event_id, ts, CASE WHEN user_id % 10 <> 0 THEN user_id END AS user_id, event_type FROM events),
n AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS i FROM e),
k AS (
  SELECT event_id, ts, user_id, event_type, i, ts AS last, true AS kept FROM n WHERE i = 1
  UNION ALL
  SELECT n.event_id, n.ts, n.user_id, n.event_type, n.i,
         CASE WHEN n.ts >= k.last + INTERVAL 36 HOURS THEN n.ts ELSE k.last END, n.ts >= k.last + INTERVAL 36 HOURS
  FROM k JOIN n ON n.user_id IS NOT DISTINCT FROM k.user_id AND n.event_type = k.event_type AND n.i = k.i + 1)
SELECT files, event_id, user_id, event_type FROM k CROSS JOIN (VALUES (1), (3), (7)) AS f(files) WHERE kept""",
    "page_after_ties": """SELECT event_id, user_id FROM events
WHERE user_id > 20 OR (user_id = 20 AND event_id > 0) ORDER BY user_id, event_id LIMIT 500""",
    "page_deep": """SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem
ORDER BY l_extendedprice, l_orderkey, l_linenumber LIMIT 80000 OFFSET 30000""",
    "audit_append": f"""WITH {LOG_SQL},
e AS (SELECT id, action, resource, details FROM log WHERE action = 'task_failed')
SELECT * FROM e UNION ALL SELECT * FROM e""",
    "stream_dedup": "SELECT DISTINCT user_id, event_type FROM events",
    "spec_run": """WITH f AS (SELECT o_orderkey, o_totalprice AS total FROM orders
  WHERE o_orderstatus = 'F' AND o_totalprice IS NOT NULL)
SELECT o_orderkey, total, (SELECT count(*) FROM f) AS rows_written FROM f""",
}
