"""Queries on feature selection."""

from __future__ import annotations

from pyspark.sql import functions as F

from meterline.catalog.features import sql_calendar, sql_ewm, sql_rolling
from meterline.catalog.registry import (
    FILLED, GRID, POSITIONS, SERIES, WEATHER, query, rnd, rounded,
)
from meterline.functions.calendar import CALENDAR_COLUMNS
from meterline.operators import features, selection
from meterline.operators.features import STATS_COLUMNS
from meterline.plans import views

CANDIDATES = ["temp", "sun", *CALENDAR_COLUMNS, *STATS_COLUMNS]
WIDE = f"""{POSITIONS}, {WEATHER}, {FILLED}, ew AS ({sql_ewm()}), st AS ({sql_rolling(8, 'gf', ', ' + sql_calendar())}),
al AS (SELECT st.* REPLACE (CAST(site_id AS INTEGER) AS site_id), ew.ewm_mean FROM st JOIN ew USING (etype, site_id, ts)),
lo AS ({' UNION ALL '.join(f"SELECT etype, site_id, ts, '{c}' AS name, CAST({c} AS DOUBLE) AS x, ap AS y FROM al WHERE {c} IS NOT NULL" for c in CANDIDATES)})"""


def _wide(spark, sf):
    rows = features.add_calendar(views.regular_weather(spark, sf))
    waves = [c for c in CALENDAR_COLUMNS if c.endswith(("_sin", "_cos"))]
    return features.add_stats(rounded(rows, *waves))


@query(
    "corr_top20",
    f"""WITH {WIDE}, c AS (
  SELECT etype, site_id, name, abs(corr(x, y)) AS c, count(*) AS n FROM lo GROUP BY 1, 2, 3
  HAVING min(x) < max(x) AND min(y) < max(y) AND count(*) > 2
), k AS (SELECT *, row_number() OVER (PARTITION BY etype, site_id ORDER BY c DESC, name) AS rank FROM c)
SELECT etype, site_id, name, {rnd('c')} AS corr, CAST(rank AS INTEGER) AS rank FROM k WHERE rank <= 20""",
)
def corr_top20(spark, sf):
    return rounded(selection.top_correlated(_wide(spark, sf), CANDIDATES), "corr")


@query(
    "feature_counts",
    f"""WITH {GRID}, {WEATHER}, {FILLED}, u AS (UNPIVOT gf ON ap, temp, sun INTO NAME name VALUE value)
SELECT etype, site_id, name, count(DISTINCT value) AS n_distinct, count(value) AS n_values FROM u GROUP BY 1, 2, 3""",
)
def feature_counts(spark, sf):
    return selection.feature_counts(views.regular_weather(spark, sf), ["ap", "temp", "sun"])


LAGS = [f"ap-{j}" for j in range(4)] + [f"temp-{j}" for j in range(2)] + [f"sun-{j}" for j in range(2)] + [f"hour-{j}" for j in range(2)]


def _lagged(spark, sf):
    rows = views.regular_weather(spark, sf).withColumn("hour", F.hour("ts"))
    wanted = [c for c in LAGS]
    return features.add_lags(rows, 4, columns=["ap", "temp", "sun", "hour"], wanted=wanted, complete=True)


SELECTED = f"""{GRID}, {WEATHER}, {FILLED}, l AS (
  SELECT etype, site_id, ts, {', '.join(f'CAST(lag({c}, {j}) OVER {SERIES} AS DOUBLE) AS "{c}-{j}"' if c != 'hour' else f'CAST(hour(lag(ts, {j}) OVER {SERIES}) AS DOUBLE) AS "hour-{j}"' for c in ('ap', 'temp', 'sun', 'hour') for j in range(4))},
         lead(ap, 1) OVER {SERIES} AS y FROM gf
), w AS (SELECT * FROM l WHERE "ap-3" IS NOT NULL AND y IS NOT NULL),
lo AS ({' UNION ALL '.join(f"""SELECT etype, site_id, '{c}' AS name, "{c}" AS x, "ap-0" AS a, y FROM w""" for c in LAGS)}),
rk AS (SELECT etype, site_id, name, x, a, y,
  rank() OVER (PARTITION BY etype, site_id, name ORDER BY x) + (count(*) OVER (PARTITION BY etype, site_id, name, x) - 1) / 2.0::DOUBLE AS rx,
  rank() OVER (PARTITION BY etype, site_id, name ORDER BY a) + (count(*) OVER (PARTITION BY etype, site_id, name, a) - 1) / 2.0::DOUBLE AS ra FROM lo),
sc AS (SELECT etype, site_id, name, corr(rx, ra) AS rho, corr(x, y) AS r, count(*) AS n FROM rk GROUP BY 1, 2, 3)"""


@query("spearman", f"WITH {SELECTED} SELECT etype, site_id, name, {rnd('rho')} AS rho, n FROM sc WHERE NOT isnan(rho)")
def spearman(spark, sf):
    return rounded(selection.spearman(_lagged(spark, sf), LAGS, "ap-0"), "rho").where("rho is not null")


@query(
    "select_spearman_f",
    f"""WITH {SELECTED}, f AS (
  SELECT *, row_number() OVER (PARTITION BY etype, site_id ORDER BY r * r / (1 - r * r) * (n - 2) DESC, name) AS k FROM sc WHERE NOT isnan(r))
SELECT etype, site_id, name FROM f WHERE k <= 6 AND abs(rho) > 0.1""",
)
def select_spearman_f(spark, sf):
    return selection.select_features(_lagged(spark, sf), LAGS, "ap+1", k=6)
