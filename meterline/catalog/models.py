"""Queries on neighbours and boosted trees."""

from __future__ import annotations

from pyspark.sql import functions as F

from meterline.catalog.registry import POSITIONS, READINGS, SERIES, query, rnd, rounded
from meterline.operators import features, neighbours, splits, trees
from meterline.operators.accuracy import metrics
from meterline.operators.trees import TreeParams
from meterline.plans import models, views
from meterline.session import KEY, scratch_path, stored
from meterline.sources import tables

NEIGHBOURS = 50


@query(
    "knn_forecast",
    f"""WITH {POSITIONS}, l AS (
  SELECT etype, site_id, ts, {', '.join(f'round(lag(ap, {j}) OVER {SERIES} * 100) AS x{j}' for j in range(4))}, lead(ap, 1) OVER {SERIES} AS y FROM p
), w AS (
  SELECT *, row_number() OVER {SERIES} - 1 AS pos, count(*) OVER (PARTITION BY etype, site_id) AS n FROM l WHERE x3 IS NOT NULL AND y IS NOT NULL
), d AS (
  SELECT t.etype, t.site_id, t.ts, t.y AS "true", n.y,
         sqrt({' + '.join(f'(t.x{j} - n.x{j}) * (t.x{j} - n.x{j})' for j in range(4))}) AS dist
  FROM w t JOIN w n ON t.etype = n.etype AND t.site_id = n.site_id
  WHERE t.pos >= CAST(floor(t.n * 0.9::DOUBLE) AS BIGINT) AND n.pos < CAST(floor(n.n * 0.9::DOUBLE) AS BIGINT)
), k AS (SELECT *, row_number() OVER (PARTITION BY etype, site_id, ts ORDER BY dist, y) AS k FROM d)
SELECT etype, site_id, ts, "true", {rnd('''CASE WHEN min(dist) = 0 THEN avg(y) FILTER (dist = 0) ELSE sum(y / dist) / sum(1 / dist) END''')} AS p
FROM k WHERE k <= {NEIGHBOURS} GROUP BY 1, 2, 3, 4""",
)
def knn_forecast(spark, sf):
    rows = features.add_lags(views.grid(spark, sf), 4, complete=True)
    names = [f"ap-{j}" for j in range(4)]
    rows = rows.withColumns({c: F.round(F.col(f"`{c}`") * 100) for c in names})
    split = splits.ratio_split(rows, ratios=(0.9, 0.0, 0.1), mode="cuts").persist()
    train, test = split.where("split = 'train'"), split.where("split = 'test'")
    found = neighbours.knn(train, test, names, "ap+1", NEIGHBOURS)
    joined = test.select(*KEY, "ts", F.col("`ap+1`").alias("true")).join(found, [*KEY, "ts"])
    return rounded(joined, "p")


def _matrix(spark, sf):
    return stored(views.matrix(spark, sf), "matrix")


@query("tree_train_eval")
def tree_train_eval(spark, sf):
    """Features chosen, parameters tuned, models refitted with the published budget; measures on the last tenth, next to the naive ones."""
    matrix = _matrix(spark, sf)
    root = scratch_path(spark, "training")
    models.save_sites(models.train_sites(matrix, trials=trees.TUNING_TRIALS), root)
    judged = models.evaluate_sites(matrix, models.load_sites(spark, root).models, matrix)
    plain = matrix.select(*KEY, "ts", F.col("`ap+1`").alias("y"), F.col("`ap-96`").alias("p"))
    base = metrics(splits.held_out(plain)).select(*KEY, F.col("mae").alias("naive_day_mae"))
    last = features.naive(views.grid(spark, sf))
    return judged.join(base, list(KEY)).join(metrics(splits.held_out(last)).select(*KEY, F.col("mae").alias("naive_mae")), list(KEY))


@query("tree_importance")
def tree_importance(spark, sf):
    """The 50 most important of all features in a fit of 200 rounds."""
    return models.feature_ranks(models.choose_sites(_matrix(spark, sf)))


@query("tree_tuning")
def tree_tuning(spark, sf):
    """Random search of 30 trials a site, each up to 1,000 rounds with a patience of 20, one record per trial."""
    return trees.tune(models.choose_sites(_matrix(spark, sf))).select(*KEY, "trial", "params.*", F.col("rounds").alias("best_rounds"), "mae", "built", "status", "best")


@query("tree_inference")
def tree_inference(spark, sf):
    """Next step of every site from the rows known at a given time, and its true value.

    The models are written by the training and read back; rows of a removed period train nothing.
    """
    matrix = _matrix(spark, sf)
    periods = spark.sql(
        "select 'production' as etype, 2 as site_id, timestamp'2024-01-05' as start_ts, timestamp'2024-01-08' as end_ts"
    )
    root = scratch_path(spark, "models")
    models.save_sites(models.train_sites(matrix, periods=periods), root)
    return models.infer_sites(matrix, models.load_sites(spark, root).models, now="2024-01-28 10:07:00", delay_days=1)


REALTIME_END = "TIMESTAMP '2024-01-27 10:00:00'"
# 96 steps of the day shift, 3 lags, and 73 rows that the exponential mean reaches back.
REALTIME_START = f"{REALTIME_END} - 172 * INTERVAL 15 MINUTE"


@query(
    "realtime_window",
    f"""WITH {READINGS}, w AS (
  SELECT *, row_number() OVER (PARTITION BY site_id, sn, dls ORDER BY etype) AS k FROM r WHERE dls BETWEEN {REALTIME_START} AND {REALTIME_END}
), bins AS (
  SELECT site_id, sn, time_bucket(INTERVAL '15 minutes', dls) AS ts, sum(ap) AS ap FROM w WHERE k = 1 GROUP BY 1, 2, 3
), steps AS (
  SELECT site_id, sn, unnest(generate_series(min(ts), max(ts), INTERVAL '15 minutes')) AS ts FROM bins GROUP BY 1, 2
), total AS (
  SELECT site_id, ts, sum(coalesce(ap, 0.0::DOUBLE)) AS ap FROM steps LEFT JOIN bins USING (site_id, sn, ts) GROUP BY 1, 2
), grid AS (
  SELECT site_id, unnest(generate_series(min(ts), max(ts), INTERVAL '15 minutes')) AS ts FROM total GROUP BY 1
), lags AS (
  SELECT site_id, ts, {', '.join(f'lag(ap, {96 + j}) OVER s AS l{j}' for j in range(7))}
  FROM grid LEFT JOIN total USING (site_id, ts) WINDOW s AS (PARTITION BY site_id ORDER BY ts)
), known AS (
  SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY ts DESC) AS k FROM lags
  WHERE {' AND '.join(f'l{j} IS NOT NULL' for j in range(7))}
)
SELECT 'consumption' AS etype, site_id, ts, {', '.join(f'{rnd(f"l{j}")} AS "ap-{96 + j}"' for j in range(4))} FROM known WHERE k = 1""",
)
def realtime_window(spark, sf):
    """Newest feature row of every group, read from the operational tables of the last steps only.

    Events are the readings of two databases; all meters of a site make up its consumption.
    """
    made = views.readings(spark, sf).select(
        "event_id", F.concat(F.lit("S"), F.col("site_id").cast("string")).alias("site"), "sn", "dls", "ap", "etype"
    )
    stored = {"a.std_smart": made.where("etype = 'consumption'"), "b.std_smart": made.where("etype = 'production'")}
    rows = tables.extract(lambda name: stored[name].drop("etype"), {"a": ["std_smart"], "b": ["std_smart"]})
    groups = made.select("site", "sn").distinct().select(
        "site", "sn", F.lit("consumption").alias("etype"),
        F.substring("site", 2, 10).cast("int").alias("site_id"),
    )
    recent = models.realtime_matrix(rows, groups, "2024-01-28 10:07:00", n=4, calendar_on=False)
    names = [f"ap-{96 + j}" for j in range(4)]
    return rounded(models.latest(recent).select(*KEY, "ts", *[f"`{c}`" for c in names]), *names)


# A reduced budget: the published one is 1,000 rounds for 96 combinations of input, horizon and flags; see the README for its cost.
GRID = TreeParams(rounds=100, max_depth=5, learning_rate=0.1)


@query("experiment_grid")
def experiment_grid(spark, sf):
    """Naive forecasts, nearest neighbours and trees over horizons and flags, on two expanding folds."""
    plain = {"n": 8, "calendar": False, "stats": False, "weather": False}
    full = {"n": 8, "calendar": True, "stats": True, "weather": True}
    entries = [{"model": "naive", "horizon": h, **plain} for h in (1, 4, 8, 12)]
    entries += [{"model": "trees", "horizon": h, **flags} for h in (1, 4) for flags in (plain, full)]
    entries += [{"model": "knn", "horizon": 1, **plain}]
    return models.compare_models(views.grid(spark, sf), views.weather15(spark, sf), entries, GRID)
