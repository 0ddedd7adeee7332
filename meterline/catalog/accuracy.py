"""Queries on forecast quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from meterline.catalog.registry import (
    GRID, POSITIONS, SERIES, query, rnd, rounded, sql_mape, steady_mape,
)
from meterline.operators import accuracy, correlation, features, monitoring, splits
from meterline.operators.chunks import at_home, chunk_window, spread, with_position
from meterline.plans import views
from meterline.session import KEY

ERR = "abs(y - p)"
MEASURES = f"""count(*) AS n, {rnd(f'avg({ERR})')} AS mae, {rnd(f'avg({ERR}) / nullif(avg(y), 0)')} AS nmae,
  {sql_mape(f'avg({ERR} / greatest(abs(y), 2.220446049250313e-16))')} AS mape,
  {rnd('avg((y - p) * (y - p))', 4)} AS mse, {rnd('sqrt(avg((y - p) * (y - p)))')} AS rmse,
  {rnd('sqrt(avg((y - p) * (y - p))) / nullif(avg(y), 0)')} AS nrmse,
  CASE WHEN var_pop(y) = 0 THEN CASE WHEN sum((y - p) * (y - p)) = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END
       ELSE {rnd('1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*))')} END AS r2"""


def tidy(df):
    return rounded(df, "mae", "nmae", "rmse", "nrmse", "r2").withColumns(
        {"mse": F.round("mse", 4) + 0.0, "mape": steady_mape()}
    )


@query(
    "naive_forecast_metrics",
    f"""WITH {GRID}, f AS (
  SELECT etype, site_id, l AS lag, ap AS y, CASE l WHEN 1 THEN lag(ap, 1) OVER w ELSE lag(ap, 96) OVER w END AS p
  FROM g, (VALUES (1), (96)) x(l) WINDOW w AS (PARTITION BY etype, site_id, l ORDER BY ts))
SELECT etype, site_id, lag, {MEASURES} FROM f WHERE p IS NOT NULL GROUP BY 1, 2, 3""",
)
def naive_forecast_metrics(spark, sf):
    """How good is the value of one step, or of one day, before, per site."""
    grid = views.grid(spark, sf)
    both = [
        accuracy.metrics(features.naive(grid, lag)).withColumn("lag", F.lit(lag)) for lag in (1, 96)
    ]
    return tidy(both[0].unionByName(both[1]))


@query(
    "error_metrics_all",
    f"""WITH {GRID}, f AS (SELECT etype, site_id, ap AS y, lag(ap, 1) OVER {SERIES} AS p FROM g),
m AS (SELECT *, avg(y) OVER (PARTITION BY etype, site_id) AS my FROM f WHERE p IS NOT NULL)
SELECT etype, site_id, {rnd(f'avg({ERR})')} AS mae,
  CASE WHEN avg({ERR} / (abs(y) + 1e-10)) * 100 < 1e6 THEN round(avg({ERR} / (abs(y) + 1e-10)) * 100, 6) ELSE round(avg({ERR} / (abs(y) + 1e-10)) * 100 / 1e12, 3) END AS mape_percent,
  {rnd(f'avg(2 * {ERR} / (abs(y) + abs(p) + 1e-10)) * 100')} AS smape_percent,
  {rnd(f'avg({ERR} / (abs(y) + abs(p) + 1.0::DOUBLE)) * 100')} AS modified_smape_percent,
  {rnd(f'sum({ERR}) / sum(abs(y) + 1e-10) * 100')} AS wmape_percent,
  {rnd('avg((y - p) * (y - p))', 4)} AS mse, {rnd('sqrt(avg((y - p) * (y - p)))')} AS rmse,
  {rnd('1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*))')} AS r2,
  {rnd('(1 - sum((y - p) * (y - p)) / sum(pow(abs(p - my) + abs(y - my), 2))) * 100')} AS agreement_percent,
  {rnd(f'sum({ERR}) FILTER (y > 0.1) / sum(y) FILTER (y > 0.1) * 100')} AS error_above_percent
FROM m GROUP BY 1, 2""",
)
def error_metrics_all(spark, sf):
    result = accuracy.older_metrics(features.naive(views.grid(spark, sf)))
    return rounded(
        result, "mae", "smape_percent", "modified_smape_percent", "wmape_percent", "rmse", "r2",
        "agreement_percent", "error_above_percent",
    ).withColumns({"mse": F.round("mse", 4) + 0.0, "mape_percent": steady_mape("mape_percent")})


def _fold_errors(spark, sf):
    """Naive forecasts of two targets on the validation rows of five folds."""
    grid = views.grid(spark, sf)
    order = chunk_window(KEY)
    cut = spread(grid, F.floor(F.unix_seconds("ts") / 900), 96, 4)
    rows = at_home(
        cut.select(
            "*", F.lead("ap", 1).over(order).alias("t1"), F.lead("ap", 4).over(order).alias("t4"),
            F.lag("ap", 95).over(order).alias("p1"), F.lag("ap", 92).over(order).alias("p4"),
        )
    )
    folds = splits.kfold(rows, 5).where("part = 'val'")
    pairs = F.array(
        F.struct(F.lit("ap+1").alias("target"), F.col("t1").alias("y_true"), F.col("p1").alias("y_pred")),
        F.struct(F.lit("ap+4").alias("target"), F.col("t4").alias("y_true"), F.col("p4").alias("y_pred")),
    )
    return folds.select("fold", *KEY, "ts", F.inline(pairs)).where("y_true is not null and y_pred is not null")


FOLD_ERRORS = f"""{POSITIONS}, sized AS (
  SELECT *, (CAST(floor(n * 0.8::DOUBLE) AS BIGINT) + CAST(floor(n * 0.1::DOUBLE) AS BIGINT)) // 5 AS size,
         lead(ap, 1) OVER {SERIES} AS t1, lead(ap, 4) OVER {SERIES} AS t4, lag(ap, 95) OVER {SERIES} AS p1, lag(ap, 92) OVER {SERIES} AS p4
  FROM p
), v AS (
  SELECT pos // size - 1 AS fold, * FROM sized WHERE pos // size BETWEEN 1 AND 5
), f AS (
  SELECT fold, etype, site_id, 'ap+1' AS target, t1 AS y, p1 AS p FROM v WHERE t1 IS NOT NULL AND p1 IS NOT NULL
  UNION ALL SELECT fold, etype, site_id, 'ap+4', t4, p4 FROM v WHERE t4 IS NOT NULL AND p4 IS NOT NULL
), c AS (
  SELECT fold, etype, site_id, target, {MEASURES} FROM f
  GROUP BY GROUPING SETS ((fold), (fold, etype, site_id), (fold, target), (fold, etype, site_id, target))
)"""


def _all_marked(df):
    """``all`` and site 0 stand for all sites and targets."""
    return df.fillna({"etype": "all", "site_id": 0, "target": "all"})


ALL_MARKED = "coalesce(etype, 'all') AS etype, coalesce(site_id, 0) AS site_id, coalesce(target, 'all') AS target"


@query(
    "metrics_cube",
    f"WITH {FOLD_ERRORS} SELECT fold, {ALL_MARKED}, n, mae, nmae, mape, mse, rmse, nrmse, r2 FROM c",
)
def metrics_cube(spark, sf):
    return _all_marked(tidy(accuracy.metrics_cube(_fold_errors(spark, sf))))


@query(
    "mean_over_folds",
    f"""WITH {FOLD_ERRORS} SELECT {ALL_MARKED}, count(*) AS n_folds, {', '.join(f'round(avg({m}), 7) + 0.0::DOUBLE AS {m}' for m in ('mae', 'nmae', 'rmse', 'nrmse'))}
FROM c GROUP BY c.etype, c.site_id, c.target""",
)
def mean_over_folds(spark, sf):
    means = accuracy.mean_over_folds(tidy(accuracy.metrics_cube(_fold_errors(spark, sf))))
    return _all_marked(rounded(means.drop("mape", "mse"), "mae", "nmae", "rmse", "nrmse", digits=7))


@query(
    "best_fold",
    f"""WITH {FOLD_ERRORS} SELECT arg_min(fold, mae) AS best_fold, min(mae) AS best_mae FROM c WHERE etype IS NULL AND target IS NULL""",
)
def best_fold(spark, sf):
    return rounded(accuracy.best_fold(accuracy.metrics_cube(_fold_errors(spark, sf))), "best_mae")


def _origins(spark, sf):
    """Every step as an origin with forecasts of four steps: half the last value, half a day before."""
    grid = with_position(views.grid(spark, sf)).drop("n")
    order = chunk_window(KEY, "pos")
    cut = spread(grid, F.col("pos"), 96, 0)
    steps = [F.lag("ap", 96 - k).over(order) * 0.5 + F.lag("ap", 1).over(order) * 0.5 for k in range(4)]
    rows = at_home(cut.select("*", F.array(*steps).alias("pred"))).where("pos >= 96")
    return rows.select(*KEY, "pos", F.col("ap").alias("y"), "pred")


ORIGINS = f"""{POSITIONS}, o AS (
  SELECT etype, site_id, pos, ap AS y, lag(ap, 1) OVER {SERIES} AS l1, {', '.join(f'lag(ap, {96 - k}) OVER {SERIES} AS s{k}' for k in range(4))} FROM p
), e AS (
  {' UNION ALL '.join(f'SELECT etype, site_id, pos + {k} AS step, s{k} * 0.5::DOUBLE + l1 * 0.5::DOUBLE AS p FROM o WHERE pos >= 96' for k in range(4))}
), a AS (
  SELECT etype, site_id, step, avg(p) AS mean, stddev_pop(p) AS std, count(*) AS n,
         quantile_cont(p, 0.75) - quantile_cont(p, 0.25) AS iqr FROM e GROUP BY 1, 2, 3
), j AS (SELECT a.*, o.y AS "true" FROM a JOIN o ON o.etype = a.etype AND o.site_id = a.site_id AND o.pos = a.step WHERE o.pos >= 96)"""


@query(
    "overlap_ensemble",
    f"""WITH {ORIGINS} SELECT etype, site_id, step, "true", {rnd('mean')} AS mean, {rnd('std')} AS std, n, {rnd('iqr')} AS iqr,
  {rnd('mean - 1.5::DOUBLE * iqr')} AS lower_bound, {rnd('mean + 1.5::DOUBLE * iqr')} AS upper_bound FROM j""",
)
def overlap_ensemble(spark, sf):
    merged = accuracy.overlap_ensemble(_origins(spark, sf))
    return rounded(merged, "mean", "std", "iqr", "lower_bound", "upper_bound")


@query(
    "overlap_ensemble_t",
    f"""WITH {ORIGINS}, t(n, q) AS (VALUES (2, 12.706204736174694), (3, 4.302652729749462), (4, 3.182446305284263)),
x AS (SELECT j.*, q * std / sqrt(j.n) AS margin FROM j JOIN t ON t.n = j.n)
SELECT etype, site_id, step, "true", {rnd('mean')} AS mean, {rnd('std')} AS std, n, round(margin, 5) + 0.0::DOUBLE AS margin,
  round(mean - margin, 5) + 0.0::DOUBLE AS lower_bound, round(mean + margin, 5) + 0.0::DOUBLE AS upper_bound FROM x""",
)
def overlap_ensemble_t(spark, sf):
    merged = accuracy.overlap_ensemble(_origins(spark, sf), bounds="t", horizon=4)
    return rounded(rounded(merged, "mean", "std"), "margin", "lower_bound", "upper_bound", digits=5)


@query("site_maximum", f"WITH {GRID} SELECT etype, site_id, max(ap) AS maximum, count(*) AS n FROM g GROUP BY 1, 2")
def site_maximum(spark, sf):
    return accuracy.series_maximum(views.grid(spark, sf))


@query(
    "predictions_long",
    f"""WITH {GRID}, f AS (
  SELECT etype, site_id, ts, lag(ap, 1) OVER {SERIES} AS p1, lag(ap, 92) OVER {SERIES} AS p4, lead(ap, 1) OVER {SERIES} AS y1 FROM g)
SELECT etype, site_id, ts, ts + INTERVAL 15 MINUTE AS target_ts, 1 AS horizon_step, p1 AS y_pred, y1 AS y_true FROM f
UNION ALL SELECT etype, site_id, ts, ts + INTERVAL 60 MINUTE, 4, p4, NULL FROM f""",
)
def predictions_long(spark, sf):
    cut = spread(views.grid(spark, sf), F.floor(F.unix_seconds("ts") / 900), 92, 1)
    order = chunk_window(KEY)
    wide = at_home(
        cut.select(
            *KEY, "ts", "_chunk", "_home", F.lag("ap", 1).over(order).alias("pred_t+1"),
            F.lag("ap", 92).over(order).alias("pred_t+4"), F.lead("ap", 1).over(order).alias("true_ap+1"),
        )
    )
    return monitoring.to_long(wide)


@query(
    "autocorrelation",
    f"""WITH {GRID}, c AS (SELECT etype, site_id, ts, ap - avg(ap) OVER (PARTITION BY etype, site_id) AS x FROM g),
l AS ({' UNION ALL '.join(f'SELECT etype, site_id, {k} AS lag, x * lag(x, {k}) OVER {SERIES} AS z FROM c' if k else 'SELECT etype, site_id, 0 AS lag, x * x AS z FROM c' for k in range(21))}),
s AS (SELECT etype, site_id, lag, sum(z) AS z FROM l GROUP BY 1, 2, 3)
SELECT s.etype, s.site_id, s.lag, {rnd('s.z / t.z')} AS acf FROM s JOIN s t ON t.etype = s.etype AND t.site_id = s.site_id AND t.lag = 0""",
)
def autocorrelation(spark, sf):
    return rounded(correlation.autocorrelation(views.grid(spark, sf)), "acf")


@query("partial_autocorrelation")
def partial_autocorrelation(spark, sf):
    return rounded(correlation.partial_autocorrelation(views.grid(spark, sf)), "pacf")


@query("difference_order")
def difference_order(spark, sf):
    return rounded(correlation.difference_order(views.grid(spark, sf)), "statistic", digits=4)


