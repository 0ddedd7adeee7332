"""Queries on features, samples, splits and scaling."""

from __future__ import annotations

from pyspark.sql import functions as F

from meterline.catalog.registry import (
    FILLED, GRID, POSITIONS, SERIES, WEATHER, query, rnd, rounded,
)
from meterline.functions.calendar import CALENDAR_COLUMNS
from meterline.operators import features, samples, scaling, splits
from meterline.operators.features import STATS_COLUMNS
from meterline.plans import views
from meterline.session import KEY

N = 8


def sql_rolling(n: int = N, source: str = "g", extra: str = "") -> str:
    frame = f"(PARTITION BY etype, site_id ORDER BY ts ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    whole = lambda f: f"CASE WHEN count(ap) OVER {frame} = {n} THEN {f}(ap) OVER {frame} END"
    return f"""SELECT *, {whole('avg')} AS rolling_mean, {whole('median')} AS rolling_median,
  {whole('stddev_samp')} AS rolling_std, {whole('min')} AS rolling_min, {whole('max')} AS rolling_max,
  ap - lag(ap, 1) OVER {SERIES} AS diff_1, ap - lag(ap, 2) OVER {SERIES} AS diff_2 {extra} FROM {source}"""


def sql_ewm(n: int = N, reach: int = 147, source: str = "p") -> str:
    q = f"(1.0::DOUBLE - 2.0::DOUBLE / {n + 1})"
    return f"""SELECT a.etype, a.site_id, a.ts,
  sum(b.ap * pow({q}, a.pos - b.pos)) / sum(pow({q}, a.pos - b.pos)) AS ewm_mean
FROM {source} a JOIN {source} b
  ON a.etype = b.etype AND a.site_id = b.site_id AND b.pos BETWEEN a.pos - {reach} AND a.pos
GROUP BY 1, 2, 3"""


def sql_calendar() -> str:
    cycle = lambda f, x, n: f"{f}(2 * pi() * {x} / {n})"
    weekday, season = "(isodow(ts) - 1)", "(month(ts) % 12 // 3)"
    holiday = "(ts = TIMESTAMP '2024-01-01 00:00:00')"
    parts = {
        "hour": "hour(ts)", "hour_sin": cycle("sin", "hour(ts)", 24), "hour_cos": cycle("cos", "hour(ts)", 24),
        "dayofweek": weekday, "dayofweek_sin": cycle("sin", weekday, 7), "dayofweek_cos": cycle("cos", weekday, 7),
        "month": "month(ts)", "month_sin": cycle("sin", "month(ts)", 12), "month_cos": cycle("cos", "month(ts)", 12),
        "day": "day(ts)", "year": "year(ts)", "weekofyear": "weekofyear(ts)",
        "weekend": f"CASE WHEN {weekday} > 4 THEN 1 ELSE 0 END",
        "season": season, "season_sin": cycle("sin", season, 4), "season_cos": cycle("cos", season, 4),
        "holiday": f"CASE WHEN {holiday} THEN 1 ELSE 0 END",
        "is_peak_hour": f"CASE WHEN hour(ts) BETWEEN 7 AND 22 AND {weekday} <= 4 AND NOT {holiday} THEN 1 ELSE 0 END",
    }
    return ", ".join(
        f"{rnd(e)} AS {c}" if c.endswith(("_sin", "_cos")) else f"CAST({e} AS INTEGER) AS {c}"
        for c, e in parts.items()
    )


@query(
    "rolling_stats",
    f"""WITH {GRID}, s AS ({sql_rolling()})
SELECT etype, site_id, ts, ap, {', '.join(f'{rnd(c, 5)} AS {c}' for c in STATS_COLUMNS[:-1])} FROM s""",
)
def rolling_stats(spark, sf):
    stats = features.add_stats(views.grid(spark, sf), N).drop("ewm_mean")
    return rounded(stats, *STATS_COLUMNS[:-1], digits=5)


@query(
    "ewm_mean",
    f"WITH {POSITIONS}, e AS ({sql_ewm()}) SELECT etype, site_id, ts, {rnd('ewm_mean + 1.3e-8')} AS ewm_mean FROM e",
)
def ewm_mean(spark, sf):
    stats = features.add_stats(views.grid(spark, sf), N).select(*KEY, "ts", "ewm_mean")
    # The first means are short decimals that may lie halfway between two rounded values.
    return rounded(stats.withColumn("ewm_mean", F.col("ewm_mean") + 1.3e-8), "ewm_mean")


def _lag(c: str, j: int) -> str:
    return f'lag({c}, {j}) OVER {SERIES} AS "{c}-{j}"'


@query(
    "lag_matrix",
    f"""WITH {GRID}, {WEATHER}, {FILLED}
SELECT etype, site_id, ts, {', '.join(_lag('ap', j + 96) for j in range(4))}, {', '.join(_lag('temp', j) for j in range(4))},
  lead(ap, 1) OVER {SERIES} AS "ap+1", lead(ap, 4) OVER {SERIES} AS "ap+4" FROM gf""",
)
def lag_matrix(spark, sf):
    series = views.regular_weather(spark, sf)
    return features.add_lags(
        series, 4, 1, selected=["ap+1", "ap+4", "broken"], columns=["ap", "temp"]
    )


@query("calendar_features", f"WITH {GRID} SELECT etype, site_id, ts, {sql_calendar()} FROM g")
def calendar_features(spark, sf):
    rows = features.add_calendar(views.grid(spark, sf).select(*KEY, "ts"))
    return rounded(rows, *[c for c in CALENDAR_COLUMNS if c.endswith(("_sin", "_cos"))])


MATRIX_COLUMNS = ["ap", "temp", "sun", *CALENDAR_COLUMNS, *STATS_COLUMNS]


def sql_matrix(n: int = N, days: int = 1) -> str:
    """CTEs up to ``mx``: rows of the feature matrix without nulls."""
    lags, names = [], []
    for c in MATRIX_COLUMNS:
        shift = 96 * days if c == "ap" or c in STATS_COLUMNS else 0
        for j in range(n):
            names.append(f"{c}-{j + shift}")
            lags.append(f'lag({c}, {j + shift}) OVER {SERIES} AS "{names[-1]}"')
    there = " AND ".join(f'"{name}" IS NOT NULL' for name in [*names, "ap+1"])
    return f"""{POSITIONS}, {WEATHER}, {FILLED}, ew AS ({sql_ewm(n)}), st AS ({sql_rolling(n, 'gf', ', ' + sql_calendar())}),
al AS (SELECT st.*, ew.ewm_mean FROM st JOIN ew USING (etype, site_id, ts)),
lg AS (SELECT etype, site_id, ts, {', '.join(lags)}, lead(ap, 1) OVER {SERIES} AS "ap+1" FROM al),
mx AS (SELECT * FROM lg WHERE {there})"""


def _matrix_select() -> str:
    out = []
    for c in MATRIX_COLUMNS:
        shift = 96 if c == "ap" or c in STATS_COLUMNS else 0
        for j in range(N):
            name = f'"{c}-{j + shift}"'
            out.append(f"{rnd(name, 5)} AS {name}" if c in STATS_COLUMNS else name)
    return ", ".join(out)


@query("feature_matrix", f"""WITH {sql_matrix()} SELECT etype, site_id, ts, {_matrix_select()}, "ap+1" FROM mx""")
def feature_matrix(spark, sf):
    rows = views.matrix(spark, sf)
    waves = [c for c in rows.columns if c.split("-")[0].endswith(("_sin", "_cos"))]
    stats = [c for c in rows.columns if c.rsplit("-", 1)[0] in STATS_COLUMNS]
    return rounded(rounded(rows, *waves), *stats, digits=5)


@query(
    "feature_subset",
    f"""WITH {sql_matrix()} SELECT etype, site_id, ts, "ap-97", "temp-0", "hour-3", {rnd('"rolling_mean-96"')} AS "rolling_mean-96", "ap+1" FROM mx""",
)
def feature_subset(spark, sf):
    rows = views.matrix(spark, sf, wanted=["ap-97", "temp-0", "hour-3", "rolling_mean-96"])
    return rounded(rows, "rolling_mean-96").select(*KEY, "ts", "`ap-97`", "`temp-0`", "`hour-3`", "`rolling_mean-96`", "`ap+1`")


SEQ, OUT = 4, 2


@query(
    "window_samples",
    f"""WITH {POSITIONS}, w AS (
  SELECT etype, site_id, ts, pos, n,
    {', '.join(f'lag(ap, {96 - i}) OVER {SERIES} AS past_{i}' for i in range(SEQ))},
    {', '.join(f'CAST(hour(lead(ts, {i}) OVER {SERIES}) AS DOUBLE) AS hour_{i}' if i else 'CAST(hour(ts) AS DOUBLE) AS hour_0' for i in range(SEQ))},
    {', '.join(f'lead(ap, {SEQ + 1 + i}) OVER {SERIES} AS y_{i}' for i in range(OUT))}
  FROM p)
SELECT etype, site_id, ts, pos, {', '.join(f'past_{i}' for i in range(SEQ))}, {', '.join(f'hour_{i}' for i in range(SEQ))}, {', '.join(f'y_{i}' for i in range(OUT))}
FROM w WHERE pos >= 96 AND pos + {SEQ + 1 + OUT} <= n AND (pos - 96) % 3 = 0""",
)
def window_samples(spark, sf):
    series = views.grid(spark, sf).withColumn("hour", F.hour("ts"))
    rows = samples.windows(series, SEQ, OUT, ["ap"], ["hour"], lag=1, previous_days=1, step=3)
    return rows.select(
        *KEY, "ts", "pos",
        *[F.col("x_past")[i][0].alias(f"past_{i}") for i in range(SEQ)],
        *[F.col("x_now")[i][0].alias(f"hour_{i}") for i in range(SEQ)],
        *[F.col("y")[i].alias(f"y_{i}") for i in range(OUT)],
    )


def _cut(ratio: float) -> str:
    return f"CAST(floor(n * {ratio}::DOUBLE) AS BIGINT)"


@query(
    "ratio_split",
    f"""WITH {POSITIONS} SELECT etype, site_id, ts,
  CASE WHEN pos < {_cut(.8)} THEN 'train' WHEN pos < {_cut(.8)} + {_cut(.1)} THEN 'val' WHEN pos >= n - {_cut(.1)} THEN 'test' END AS by_size,
  CASE WHEN pos < {_cut(.8)} THEN 'train' WHEN pos < {_cut(.9)} THEN 'val' ELSE 'test' END AS by_cut FROM p""",
)
def ratio_split(spark, sf):
    grid = views.grid(spark, sf).drop("ap")
    by_size = splits.ratio_split(grid).withColumnRenamed("split", "by_size")
    return splits.ratio_split(by_size, mode="cuts").withColumnRenamed("split", "by_cut")


@query(
    "split_bounds",
    f"""WITH {POSITIONS}, s AS (SELECT *, CASE WHEN pos < {_cut(.8)} THEN 'train' WHEN pos < {_cut(.8)} + {_cut(.1)} THEN 'val'
  WHEN pos >= n - {_cut(.1)} THEN 'test' END AS split FROM p)
SELECT etype, site_id, split, min(ts) AS start, max(ts) AS stop, count(*) AS n FROM s WHERE split IS NOT NULL GROUP BY 1, 2, 3""",
)
def split_bounds(spark, sf):
    return splits.split_bounds(splits.ratio_split(views.grid(spark, sf)))


@query("held_out", f"WITH {POSITIONS} SELECT etype, site_id, ts, ap FROM p WHERE pos >= {_cut(.9)}")
def held_out(spark, sf):
    return splits.held_out(views.grid(spark, sf))


K = 5
KFOLD = f"""sized AS (SELECT *, ({_cut(.8)} + {_cut(.1)}) // {K} AS size FROM p), folded AS (
  SELECT s.*, f.fold, CASE WHEN pos < size * (fold + 1) THEN 'train' WHEN pos < size * (fold + 2) THEN 'val' END AS part
  FROM sized s JOIN (SELECT unnest(range({K})) AS fold) f ON true)"""


@query(
    "kfold_split",
    f"""WITH {POSITIONS}, {KFOLD} SELECT etype, site_id, ts, fold, part FROM folded WHERE part IS NOT NULL""",
)
def kfold_split(spark, sf):
    return splits.kfold(views.grid(spark, sf).drop("ap"), K)


@query(
    "kfold_bounds",
    f"""WITH {POSITIONS}, {KFOLD} SELECT etype, site_id, fold, part, min(ts) AS start, max(ts) AS stop, count(*) AS n
FROM folded WHERE part IS NOT NULL GROUP BY 1, 2, 3, 4""",
)
def kfold_bounds(spark, sf):
    return splits.kfold_bounds(views.grid(spark, sf), K)


@query(
    "expanding_folds",
    f"""WITH {POSITIONS} SELECT etype, site_id, ts, fold, CASE WHEN pos < 700 * (fold + 1) THEN 'train' ELSE 'val' END AS part
FROM p JOIN (SELECT unnest(range(100)) AS fold) f ON 700 * (fold + 1) < n AND pos < 700 * (fold + 2)""",
)
def expanding_folds(spark, sf):
    return splits.expanding_folds(views.grid(spark, sf).drop("ap"), 700)


SCALERS = """long AS (UNPIVOT gf ON ap, temp, sun INTO NAME name VALUE value), sc AS (
  SELECT etype, site_id, name, quantile_cont(value, 0.5) AS center,
         CASE WHEN quantile_cont(value, 0.75) = quantile_cont(value, 0.25) THEN 1.0::DOUBLE
              ELSE quantile_cont(value, 0.75) - quantile_cont(value, 0.25) END AS scale,
         avg(value) AS mean, CASE WHEN stddev_pop(value) = 0 THEN 1.0::DOUBLE ELSE stddev_pop(value) END AS std
  FROM long GROUP BY 1, 2, 3)"""


def _scaled_sql(center: str, scale: str) -> str:
    parts = ", ".join(
        f"round((gf.{c} - {c}_s.{center}) / {c}_s.{scale}, 6) + 0.0::DOUBLE AS {c}" for c in ("ap", "temp", "sun")
    )
    joins = " ".join(
        f"JOIN sc {c}_s ON {c}_s.etype = gf.etype AND {c}_s.site_id = gf.site_id AND {c}_s.name = '{c}'"
        for c in ("ap", "temp", "sun")
    )
    return f"WITH {GRID}, {WEATHER}, {FILLED}, {SCALERS} SELECT gf.etype, gf.site_id, gf.ts, {parts} FROM gf {joins}"


COLS = ["ap", "temp", "sun"]


@query("robust_scale", _scaled_sql("center", "scale"))
def robust_scale(spark, sf):
    rows = views.regular_weather(spark, sf)
    scaled = scaling.scale(rows, scaling.robust_parameters(rows, COLS), COLS)
    return rounded(scaled, *COLS).select(*KEY, "ts", *COLS)


@query(
    "unscale",
    f"""WITH {GRID}, sc AS (
  SELECT etype, site_id, quantile_cont(ap, 0.5) AS center,
         CASE WHEN quantile_cont(ap, 0.75) = quantile_cont(ap, 0.25) THEN 1.0::DOUBLE ELSE quantile_cont(ap, 0.75) - quantile_cont(ap, 0.25) END AS scale
  FROM g GROUP BY 1, 2)
SELECT etype, site_id, ts, round(ap, 6) + 0.0::DOUBLE AS ap, {rnd('0.5::DOUBLE * scale + center')} AS p FROM g JOIN sc USING (etype, site_id)""",
)
def unscale(spark, sf):
    rows = views.grid(spark, sf)
    fitted = scaling.robust_parameters(rows, ["ap"])
    scaled = scaling.scale(rows, fitted, ["ap"]).withColumn("p", F.lit(0.5))
    back = scaling.unscale(scaled, fitted, ["ap", "p"], names={"p": "ap"})
    return rounded(back, "ap", "p").select(*KEY, "ts", "ap", "p")


@query("standard_scale", _scaled_sql("mean", "std"))
def standard_scale(spark, sf):
    rows = views.regular_weather(spark, sf)
    scaled = scaling.scale(rows, scaling.standard_parameters(rows, COLS), COLS)
    return rounded(scaled, *COLS).select(*KEY, "ts", *COLS)
