"""Pieces of SQL, for DuckDB, that the checks of the queries are built from."""

from __future__ import annotations

P1 = """p1 AS (SELECT l_linenumber AS valor, CAST(l_shipdate AS DATE) AS d,
  CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS DOUBLE) / count(l_extendedprice) / 100 AS value FROM lineitem GROUP BY 1, 2)"""
P2 = """p2 AS (SELECT s_nationkey AS valor, CAST(l_shipdate AS DATE) AS d,
  CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS DOUBLE) / count(l_extendedprice) / 100 AS value
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2)"""
DENSE = """dense AS (SELECT d, valor, value FROM (SELECT DISTINCT d FROM p1) CROSS JOIN (SELECT DISTINCT valor FROM p1) LEFT JOIN p1 USING (d, valor))"""
FILLED = """filled AS (SELECT d, valor, last_value(value IGNORE NULLS) OVER (PARTITION BY valor ORDER BY d ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS value FROM dense)"""
RET = """full_days AS (SELECT d FROM filled GROUP BY d HAVING count(value) = count(*)),
lagged AS (SELECT d, valor, value / lag(value) OVER (PARTITION BY valor ORDER BY d) AS ratio FROM filled JOIN full_days USING (d)),
ret AS (SELECT dense_rank() OVER (ORDER BY d) - 1 AS t, d, valor AS j, ln(ratio) AS x FROM lagged WHERE ratio IS NOT NULL)"""
BASE = f"WITH RECURSIVE {P1}, {DENSE}, {FILLED}, {RET}"
PNL = BASE + ", pnl AS (SELECT t, any_value(d) AS d, round(sum(x) / count(*), 12) AS r FROM ret GROUP BY t)"
