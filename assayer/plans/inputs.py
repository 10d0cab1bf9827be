"""Inputs the queries share, as SELECTs that Spark and the check engine both read."""

RUNS = """
SELECT event_type AS task_id, CAST(user_id AS STRING) AS agent, event_id, ts AS finished_at,
       value > 10 AS passed, least(1.0, value / 100) AS score,
       CASE WHEN event_type = 'error' THEN NULL ELSE value / 1000 END AS cost_usd,
       value * 0.5 AS duration_s,
       CASE WHEN user_id % 10 = 3 THEN 'timeout' ELSE 'none' END AS error_kind
FROM {events}"""

LEFT_RUNS = RUNS + " WHERE ts < TIMESTAMP '2024-01-16 00:00:00'"
RIGHT_RUNS = RUNS + " WHERE ts >= TIMESTAMP '2024-01-16 00:00:00'"

CHECKS = """
SELECT l_orderkey AS run, l_returnflag = 'R' AS required, l_quantity AS weight,
       l_linestatus = 'O' AS passed, 1 - 10 * l_discount AS score
FROM {lineitem}"""

_PATH = """
CASE doc_id % 6 WHEN 0 THEN 'src/pkg/' WHEN 1 THEN 'tests/' WHEN 2 THEN '.git/objects/'
     WHEN 3 THEN 'docs/' || lang || '/' WHEN 4 THEN '' ELSE 'src/__pycache__/' END ||
CASE doc_id % 5 WHEN 0 THEN 'test_' || CAST(doc_id AS STRING) || '.py' WHEN 1 THEN CAST(doc_id AS STRING) || '.txt'
     WHEN 2 THEN CAST(doc_id AS STRING) || '_test.py' WHEN 3 THEN 'core.' || CAST(doc_id AS STRING)
     ELSE 'mod_' || CAST(doc_id AS STRING) || '.py' END"""

FILES = f"""
SELECT doc_id, source AS tree_id, {_PATH} AS path, text, lang,
       CASE WHEN doc_id % 23 = 0 THEN 'symlink' ELSE 'file' END AS kind, doc_id % 3 = 0 AS executable
FROM {{documents}}"""

BASE_FILES = FILES + " WHERE doc_id % 7 <> 0"

CURRENT_FILES = f"""
SELECT doc_id, source AS tree_id, {_PATH} AS path,
       CASE WHEN doc_id % 5 = 0 THEN text || ' and one more line' ELSE text END AS text, lang,
       CASE WHEN doc_id % 23 = 0 THEN 'symlink' ELSE 'file' END AS kind,
       CASE WHEN doc_id % 13 = 0 THEN doc_id % 3 <> 0 ELSE doc_id % 3 = 0 END AS executable
FROM {{documents}} WHERE doc_id % 11 <> 0 OR doc_id % 7 = 0"""
