"""Deterministic test inputs for queries, as SQL that Spark and DuckDB both read: logs, hits, diffs, files from tables."""

from __future__ import annotations

#: block, pos, line: an application log of 250 lines from the event stream.
LOG_LINES = """
SELECT CAST(floor(event_id / 250) AS BIGINT) AS block, CAST(event_id % 250 AS INT) AS pos,
  CASE WHEN event_id % 61 = 0 THEN '$ run step ' || CAST(event_id AS STRING) || ' &&'
       WHEN event_id % 37 = 0 THEN 'ERROR: worker ' || CAST(user_id AS STRING) || ' crashed at 0x' || CAST(1000 + event_id AS STRING)
       WHEN event_id % 53 = 0 THEN 'FAILED step ' || CAST(event_id % 7 AS STRING)
       WHEN event_id % 29 = 0 THEN 'warning: slow query took ' || CAST(event_id AS STRING) || ' ms in /var/log/app' || CAST(user_id AS STRING) || '/main.log'
       WHEN event_id % 83 = 0 THEN '=== summary ' || CAST(event_id % 5 AS STRING)
       WHEN event_id % 11 = 0 THEN 'tick'
       WHEN event_id % 11 = 1 THEN 'tick'
       ELSE 'INFO user ' || CAST(user_id AS STRING) || ' did ' || event_type END AS line
FROM events"""

#: block, pos, line: search results over files named after event types, with misses between.
HIT_LINES = """
SELECT CAST(floor(event_id / 500) AS BIGINT) AS block, CAST(event_id % 500 AS INT) AS pos,
  CASE WHEN event_id % 41 = 0 THEN '-- section --'
       ELSE 'src/' || event_type || CAST(user_id % 9 AS STRING) || '.py:' || CAST(event_id % 97 AS STRING) || ':'
         || CASE WHEN event_id % 13 = 0 THEN 'raise error here' WHEN event_id % 17 = 0 THEN 'deprecated call'
                 ELSE 'value of worker ' || CAST(user_id AS STRING) END END AS line
FROM events"""

#: block, pos, line: diffs of 20 lines a hunk, 3 hunks a file.
DIFF_LINES = """
SELECT CAST(floor(event_id / 600) AS BIGINT) AS block, CAST(event_id % 600 AS INT) AS pos,
  CASE WHEN event_id % 60 = 0 THEN 'diff --git a/f' || CAST(event_id % 600 AS STRING) || '.py b/f' || CAST(event_id % 600 AS STRING) || '.py'
       WHEN event_id % 60 = 1 THEN '--- a/f' || CAST(event_id % 600 - 1 AS STRING) || '.py'
       WHEN event_id % 60 = 2 THEN '+++ b/' || CASE WHEN event_id % 240 = 2 THEN 'yarn.lock' ELSE 'f' || CAST(event_id % 600 - 2 AS STRING) || '.py' END
       WHEN event_id % 60 IN (3, 22, 41) THEN '@@ -' || CAST(event_id % 600 AS STRING) || ',18 +' || CAST(event_id % 600 AS STRING) || ',18 @@'
       WHEN event_id % 60 IN (9, 10, 30) THEN '-old ' || event_type
       WHEN event_id % 60 IN (11, 31) THEN '+new ' || event_type || CASE WHEN event_id % 7 = 0 THEN ' fix' ELSE '' END
       ELSE ' keep ' || CAST(user_id AS STRING) END AS line
FROM events"""

#: block, pos, line: YAML with comments and blank lines.
YAML_LINES = """
SELECT CAST(floor(p_partkey / 50) AS BIGINT) AS block, CAST(p_partkey % 50 AS INT) AS pos,
  CASE WHEN p_partkey % 5 = 0 THEN '# part ' || CAST(p_partkey AS STRING) WHEN p_partkey % 7 = 0 THEN '' WHEN p_partkey % 9 = 0 THEN '; note'
       WHEN p_partkey % 3 = 0 THEN '  # ' || p_brand ELSE 'key' || CAST(p_partkey AS STRING) || ': ' || p_type END AS line
FROM part"""
