"""Registry of the queries and the SQL parts that several of them share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from meterline.plans.views import naive_stamps

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; its stamps leave as naive stamps."""

    def register(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return naive_stamps(fn(spark, sf_dir))

        QUERIES[name] = run
        if sql:
            SQL[name] = sql
        return fn

    return register


def rounded(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    """Round columns, so that the order of a sum does not show; no negative zero."""
    return df.withColumns({c: F.round(F.col(f"`{c}`"), digits) + F.lit(0.0) for c in cols})


def steady_mape(c: str = "mape"):
    """A relative error of huge size (an actual value of 0) keeps its leading digits only."""
    value = F.col(c)
    return F.when(value < 1e6, F.round(value, 6)).otherwise(F.round(value / 1e12, 3))


def rnd(expr: str, digits: int = 6) -> str:
    return f"round({expr}, {digits}) + 0.0::DOUBLE"


def sql_mape(expr: str) -> str:
    return f"CASE WHEN {expr} < 1e6 THEN round({expr}, 6) ELSE round({expr} / 1e12, 3) END"


# SQL of the views in plans/views.py.
READINGS = """r AS (
  SELECT event_id,
         CASE WHEN event_type IN ('purchase', 'error') THEN 'production' ELSE 'consumption' END AS etype,
         CAST(user_id % 7 + 1 AS INTEGER) AS site_id, user_id AS sn, ts AS dls, value AS ap,
         TRY_CAST(regexp_extract(props, '"k": *(\\d+)', 1) AS DOUBLE) AS q1, 0.0::DOUBLE AS q4
  FROM events)"""
BINS = READINGS + """, b AS (
  SELECT etype, site_id, time_bucket(INTERVAL '15 minutes', dls) AS ts, round(sum(ap), 6) AS ap
  FROM r GROUP BY 1, 2, 3)"""
GRID = BINS + """, span AS (
  SELECT etype, site_id, unnest(generate_series(min(ts), max(ts), INTERVAL '15 minutes')) AS ts
  FROM b GROUP BY 1, 2
), g AS (
  SELECT s.etype, s.site_id, s.ts, coalesce(b.ap, 0.0::DOUBLE) AS ap
  FROM span s LEFT JOIN b USING (etype, site_id, ts))"""
POSITIONS = GRID + """, p AS (
  SELECT *, row_number() OVER (PARTITION BY etype, site_id ORDER BY ts) - 1 AS pos,
         count(*) OVER (PARTITION BY etype, site_id) AS n
  FROM g)"""
WEATHER = """w10 AS (
  SELECT time_bucket(INTERVAL '10 minutes', ts) AS ts, round(avg(value), 6) AS temp, max(value) AS sun
  FROM events WHERE event_type = 'view' GROUP BY 1
), wb AS (
  SELECT time_bucket(INTERVAL '15 minutes', ts) AS ts,
         arg_min(temp, ts) FILTER (temp IS NOT NULL) AS temp,
         arg_min(sun, ts) FILTER (sun IS NOT NULL) AS sun
  FROM w10 GROUP BY 1
), w15 AS (
  SELECT s.ts, wb.temp, wb.sun
  FROM (SELECT unnest(generate_series(min(ts), max(ts), INTERVAL '15 minutes')) AS ts FROM wb) s
  LEFT JOIN wb USING (ts))"""
FILLED = """gw AS (
  SELECT g.etype, g.site_id, g.ts, g.ap, w15.temp, w15.sun FROM g LEFT JOIN w15 USING (ts)
), gf AS (
  SELECT etype, site_id, ts, ap,
         coalesce(last_value(temp IGNORE NULLS) OVER back, first_value(temp IGNORE NULLS) OVER ahead) AS temp,
         coalesce(last_value(sun IGNORE NULLS) OVER back, first_value(sun IGNORE NULLS) OVER ahead) AS sun
  FROM gw
  WINDOW back AS (PARTITION BY etype, site_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
         ahead AS (PARTITION BY etype, site_id ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"""
SERIES = "(PARTITION BY etype, site_id ORDER BY ts)"
