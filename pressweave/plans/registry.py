"""All queries of the engine by name, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: The adapter views of sources/adapter.py in SQL.
VIEWS = """WITH clusters AS (
  SELECT o_orderkey AS id, c_mktsegment AS category, 6 - CAST(substr(o_orderpriority, 1, 1) AS INT) AS importance, o_orderdate AS last_seen,
         r_name AS country, n_name AS topic, n_nationkey AS place_id, o_orderstatus <> 'P' AS written, o_totalprice AS weight
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
articles AS (
  SELECT l_orderkey * 10 + l_linenumber AS id, l_orderkey AS cluster_id, l_suppkey AS source_id, l_shipdate AS published_at,
         l_returnflag = 'R' AS prominent, CAST(l_quantity * 40 AS BIGINT) AS body_length, l_partkey AS content FROM lineitem),
sources AS (
  SELECT s_suppkey AS id, s_name AS name, n_name AS country, CASE s_suppkey % 3 WHEN 0 THEN 'left' WHEN 1 THEN 'centre' ELSE 'right' END AS bias,
         CASE WHEN s_suppkey % 10 = 0 THEN 'title' ELSE 'full' END AS tier FROM supplier JOIN nation ON s_nationkey = n_nationkey),
full_articles AS (SELECT a.*, s.name, s.bias, s.country AS source_country FROM articles a JOIN sources s ON a.source_id = s.id WHERE s.tier <> 'title'),
counts AS (
  SELECT cluster_id, count(DISTINCT content) AS article_count, count(DISTINCT source_id) AS source_count FROM full_articles GROUP BY cluster_id),
prominence AS (SELECT cluster_id, count(DISTINCT source_id) AS prominence FROM articles WHERE prominent GROUP BY cluster_id),
as_of AS (SELECT max(o_orderdate) AS t FROM orders),
stories AS (
  SELECT c.*, coalesce(n.article_count, 0) AS article_count, coalesce(n.source_count, 0) AS source_count, coalesce(p.prominence, 0) AS prominence,
         CAST(epoch(as_of.t - c.last_seen) AS DOUBLE) / 3600 AS age_hours
  FROM clusters c LEFT JOIN counts n ON c.id = n.cluster_id LEFT JOIN prominence p ON c.id = p.cluster_id CROSS JOIN as_of),
live AS (SELECT * FROM stories WHERE written AND age_hours <= 1440)
"""


def query(sql: str | None = None, views: bool = True):
    """Register a query under its function's name, with its SQL after the views."""

    def wrap(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = (VIEWS if views else "") + sql
        return f

    return wrap
