"""Queries on allocation, shedding and monitoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from meterline.catalog.registry import (
    GRID, POSITIONS, SERIES, query, rnd, rounded, sql_mape, steady_mape,
)
from meterline.functions.clock import shift_steps
from meterline.operators import clean, decide, features, monitoring
from meterline.plans import views


def _recent(spark, sf):
    """Mean of the last day of each site, less something, so that some turn negative."""
    last = clean.last_rows(views.grid(spark, sf))
    return last.groupBy("etype", "site_id").agg(
        F.round(F.round(F.avg("ap"), 6) - F.col("site_id") % 4 * 2, 6).alias("value")
    )


RECENT = f"""{GRID}, k AS (SELECT *, row_number() OVER (PARTITION BY etype, site_id ORDER BY ts DESC) AS k FROM g), v AS (
  SELECT etype, site_id, round(round(avg(ap), 6) - site_id % 4 * 2, 6) AS value FROM k WHERE k <= 96 GROUP BY 1, 2
), al AS (
  SELECT i.site_id, c.value AS cons, p.value AS prod FROM (SELECT DISTINCT site_id FROM v WHERE etype = 'production') i
  LEFT JOIN v p ON p.etype = 'production' AND p.site_id = i.site_id
  LEFT JOIN v c ON c.etype = 'consumption' AND c.site_id = i.site_id AND i.site_id <> 6
), al2 AS (
  SELECT *, CASE WHEN cons IS NULL OR prod IS NULL THEN 'missing_input' WHEN cons < 0 THEN 'infeasible' ELSE 'success' END AS status,
         CASE WHEN cons >= 0 AND prod IS NOT NULL THEN CASE WHEN cons > 0 AND prod > 0 THEN least(cons, prod) ELSE 0 END END AS p FROM al)"""


def _allocated(spark, sf):
    recent = _recent(spark, sf)
    consumption = recent.where("etype = 'consumption' and site_id <> 6")
    return decide.allocate(consumption, recent.where("etype = 'production'"))


@query(
    "allocate",
    f"""WITH {RECENT} SELECT site_id, site_id AS consumption_id, cons, prod, p + 0.0::DOUBLE AS p, coalesce(p > 0, false) AS active, status FROM al2""",
)
def allocate(spark, sf):
    return _allocated(spark, sf).withColumns({"p": F.col("p") + 0.0, "active": F.coalesce("active", F.lit(False))})


@query(
    "allocation_totals",
    f"""WITH {RECENT} SELECT {rnd('coalesce(sum(p), 0)')} AS total_production_optimized,
  CAST(coalesce(sum(CASE WHEN p > 0 THEN 1 WHEN p IS NOT NULL THEN 0 END), 0) AS BIGINT) AS n_sites_active,
  CAST(coalesce(sum(CASE WHEN p > 0 THEN 0 WHEN p IS NOT NULL THEN 1 END), 0) AS BIGINT) AS n_sites_disabled,
  count(*) FILTER (status <> 'success') AS n_errors FROM al2""",
)
def allocation_totals(spark, sf):
    totals = decide.allocation_totals(decide.allocation_report(_allocated(spark, sf)))
    return rounded(totals, "total_production_optimized")


@query(
    "shed_sites",
    f"""WITH {GRID}, t AS (
  SELECT ts, list(site_id ORDER BY site_id) AS ss, list(round(ap * 100) ORDER BY site_id) AS ps FROM g WHERE etype = 'production' GROUP BY 1
), c AS (SELECT ts, floor(sum(round(ap * 100)) / 2) AS cap FROM g WHERE etype = 'consumption' GROUP BY 1
), m AS (SELECT ts, cap, ss, ps, unnest(range(CAST(pow(2, len(ss)) AS BIGINT))) AS mask FROM t JOIN c USING (ts)
), s AS (SELECT *, list_sum([CASE WHEN (mask >> CAST(i AS BIGINT)) & 1 = 1 THEN ps[i + 1] ELSE 0 END for i in range(len(ss))]) AS total FROM m
), k AS (SELECT *, row_number() OVER (PARTITION BY ts ORDER BY total DESC, mask) AS k FROM s WHERE total <= cap)
SELECT ts, cap, list_sum(ps) AS total, total AS kept_sum, list_sum(ps) > cap AS violation,
  array_to_string([ss[i + 1] for i in range(len(ss)) if (mask >> CAST(i AS BIGINT)) & 1 = 1], ',') AS kept,
  array_to_string([ss[i + 1] for i in range(len(ss)) if (mask >> CAST(i AS BIGINT)) & 1 = 0], ',') AS shed
FROM k WHERE k = 1""",
)
def shed_sites(spark, sf):
    cents = views.grid(spark, sf).withColumn("p", F.round(F.col("ap") * 100))
    caps = cents.where("etype = 'consumption'").groupBy("ts").agg(F.floor(F.sum("p") / 2).cast("double").alias("cap"))
    chosen = decide.shed(cents.where("etype = 'production'"), caps, resolution=1)
    text = lambda c: F.array_join(F.transform(c, lambda s: s.cast("string")), ",")
    return chosen.withColumns({"kept": text("kept"), "shed": text("shed")})


LAST = f"""{POSITIONS}, f AS (
  SELECT etype, site_id, ts + INTERVAL 15 MINUTE AS target_ts, CASE WHEN site_id = 2 THEN ap * 1.1 ELSE ap END AS y_pred FROM g WHERE site_id <> 5
), a AS (SELECT etype, site_id, ts, CASE WHEN site_id = 2 THEN lag(ap, 1) OVER {SERIES} ELSE ap END AS ap,
         row_number() OVER (PARTITION BY etype, site_id ORDER BY ts DESC) AS k FROM g WHERE NOT (site_id = 4 AND etype = 'production')),
sites AS (SELECT DISTINCT etype, site_id FROM g UNION ALL SELECT 'production', 8),
pr AS (SELECT * FROM f WHERE NOT (site_id = 3 AND target_ts > TIMESTAMP '2024-01-10')),
j AS (SELECT etype, site_id, ap AS y, y_pred AS p FROM pr JOIN (SELECT etype, site_id, ts AS target_ts, ap FROM a WHERE k <= 96) USING (etype, site_id, target_ts)),
sc AS (SELECT etype, site_id, count(*) AS n, avg(abs(y - p)) AS mae, sqrt(avg((y - p) * (y - p))) AS rmse,
  avg(abs(y - p) / greatest(abs(y), 2.220446049250313e-16)) AS mape FROM j GROUP BY 1, 2)
"""


def _monitored(spark, sf):
    grid = views.grid(spark, sf)
    site = F.col("site_id")
    predictions = grid.where("site_id <> 5").select(
        "etype", "site_id", shift_steps(F.col("ts"), 1).alias("target_ts"),
        F.when(site == 2, F.col("ap") * 1.1).otherwise(F.col("ap")).alias("y_pred"),
    ).where("not (site_id = 3 and target_ts > timestamp'2024-01-10 00:00:00')")
    moved = features.naive(grid.where("site_id = 2")).select("etype", "site_id", "ts", F.col("p").alias("ap"))
    measured = grid.where("site_id <> 2 and not (site_id = 4 and etype = 'production')").unionByName(moved)
    sites = grid.select("etype", "site_id").distinct()
    extra = spark.createDataFrame([("production", 8)], "etype string, site_id int")
    return monitoring.monitor(sites.unionByName(extra), predictions, clean.last_rows(measured))


STATUS = """CASE WHEN NOT EXISTS (SELECT 1 FROM pr WHERE pr.etype = s.etype AND pr.site_id = s.site_id) THEN 'error'
  WHEN NOT EXISTS (SELECT 1 FROM a WHERE a.etype = s.etype AND a.site_id = s.site_id) THEN 'no_data'
  WHEN sc.n IS NULL THEN 'no_overlap' ELSE 'success' END"""


@query(
    "monitor_sites",
    f"""WITH {LAST} SELECT s.etype, s.site_id, {STATUS} AS status, coalesce(sc.n, 0) AS n_comparisons,
  {rnd('sc.mae')} AS mae, {rnd('sc.rmse')} AS rmse, {sql_mape('sc.mape')} AS mape, coalesce(sc.mape * 100 > 20, false) AS degradation_alert
FROM sites s LEFT JOIN sc USING (etype, site_id)""",
)
def monitor_sites(spark, sf):
    report = _monitored(spark, sf).select(
        "etype", "site_id", "status", "n_comparisons", "mae", "rmse", steady_mape().alias("mape"), "degradation_alert"
    )
    return rounded(report, "mae", "rmse")


@query(
    "monitor_summary",
    f"""WITH {LAST}, rep AS (SELECT s.etype, s.site_id, {STATUS} AS status, coalesce(sc.mape * 100 > 20, false) AS alert
  FROM sites s LEFT JOIN sc USING (etype, site_id))
SELECT etype, count(*) AS n_sites_monitored, count(*) FILTER (status = 'success') AS n_sites_with_data,
  count(*) FILTER (alert) AS n_degradation_alerts,
  coalesce(string_agg(CAST(site_id AS VARCHAR), ',' ORDER BY site_id) FILTER (alert), '') AS alerts FROM rep GROUP BY 1""",
)
def monitor_summary(spark, sf):
    summary = monitoring.monitor_summary(_monitored(spark, sf))
    return summary.withColumn(
        "alerts", F.array_join(F.transform("alerts", lambda a: a["site_id"].cast("string")), ",")
    )
