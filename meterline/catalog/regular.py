"""Queries on the regular grid."""

from __future__ import annotations

from pyspark.sql import functions as F

from meterline.catalog.registry import (
    BINS, FILLED, GRID, POSITIONS, READINGS, WEATHER, query, rounded,
)
from meterline.functions.clock import floor_to
from meterline.operators import regular, samples
from meterline.operators.chunks import fill
from meterline.operators.clean import abs_production, drop_all_zero
from meterline.plans import views


@query(
    "resample_15m",
    f"""WITH {READINGS}, b AS (
  SELECT etype, site_id, time_bucket(INTERVAL '15 minutes', dls) AS ts, sum(ap) AS ap, sum(q1) AS q1, sum(q4) AS q4,
         arg_min(sn, dls) AS sn
  FROM r WHERE coalesce(ap <> 0, true) OR coalesce(q1 <> 0, true) OR coalesce(q4 <> 0, true) GROUP BY 1, 2, 3)
SELECT etype, site_id, ts, round(ap, 6) AS ap, round(q1, 6) AS q1, q4, sn FROM b""",
)
def resample_15m(spark, sf):
    rows = views.readings(spark, sf).withColumn("production", F.col("etype") == "production")
    kept = drop_all_zero(abs_production(rows))
    return rounded(regular.bin_sums(kept, firsts=["sn"]), "ap", "q1", "q4")


@query(
    "regular_grid",
    f"""WITH {READINGS}, f AS (
  SELECT etype, site_id, time_bucket(INTERVAL '5 minutes', dls) AS ts, round(sum(ap), 6) AS ap FROM r GROUP BY 1, 2, 3
), span AS (
  SELECT etype, site_id, unnest(generate_series(min(ts), max(ts), INTERVAL '15 minutes')) AS ts FROM f GROUP BY 1, 2)
SELECT s.etype, s.site_id, s.ts, f.ap, coalesce(f.ap, 0.0::DOUBLE) AS filled
FROM span s LEFT JOIN f USING (etype, site_id, ts)""",
)
def regular_grid(spark, sf):
    fives = views.readings(spark, sf).groupBy("etype", "site_id", floor_to(F.col("dls"), 300).alias("ts")).agg(
        F.round(F.sum("ap"), 6).alias("ap")
    )
    grid = regular.regular_grid(fives)
    return regular.holes_to_zero(grid.withColumn("filled", F.col("ap")), ["filled"])


@query(
    "fill_both_ways",
    f"""WITH {BINS}, span AS (
  SELECT etype, site_id, unnest(generate_series(min(ts), max(ts), INTERVAL '15 minutes')) AS ts FROM b GROUP BY 1, 2
), x AS (
  SELECT s.*, CASE WHEN b.ap > 60 THEN b.ap END AS ap FROM span s LEFT JOIN b USING (etype, site_id, ts))
SELECT etype, site_id, ts,
  coalesce(last_value(ap IGNORE NULLS) OVER (PARTITION BY etype, site_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
           first_value(ap IGNORE NULLS) OVER (PARTITION BY etype, site_id ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS ap
FROM x""",
)
def fill_both_ways(spark, sf):
    bins = rounded(regular.bin_sums(views.readings(spark, sf), sums=["ap"]), "ap")
    holes = regular.regular_grid(bins).withColumn("ap", F.when(F.col("ap") > 60, F.col("ap")))
    return fill(holes, ["ap"])


@query("weather_15m", f"WITH {WEATHER} SELECT ts, temp, sun FROM w15")
def weather_15m(spark, sf):
    return views.weather15(spark, sf)


@query(
    "merge_duplicates",
    f"""WITH {READINGS} SELECT etype, site_id, date_trunc('hour', dls) AS ts, round(sum(ap), 6) AS ap FROM r GROUP BY 1, 2, 3""",
)
def merge_duplicates(spark, sf):
    rows = views.readings(spark, sf).withColumn("ts", F.date_trunc("hour", "dls"))
    return rounded(regular.merge_duplicates(rows), "ap")


@query(
    "weather_join",
    f"""WITH {GRID}, {WEATHER}, {FILLED} SELECT etype, site_id, ts, ap, temp, sun FROM gf""",
)
def weather_join(spark, sf):
    return regular.join_weather(views.grid(spark, sf), views.weather15(spark, sf))


@query(
    "weather_lookup",
    f"""WITH {GRID}, {WEATHER}
SELECT etype, site_id, ts, ap, temp, sun FROM g JOIN w15 USING (ts)""",
)
def weather_lookup(spark, sf):
    weather = views.weather15(spark, sf)
    # The lookup is strict, so only stamps inside the span of the weather are asked for.
    series = views.grid(spark, sf).join(weather.select("ts"), "ts", "left_semi").select("etype", "site_id", "ts", "ap")
    return regular.lookup_weather(series, weather)


GROUPS = """members AS (
  SELECT n_nationkey AS meter, CAST(n_regionkey AS INTEGER) AS site_id FROM nation
  UNION ALL SELECT n_nationkey, CAST(9 AS INTEGER) FROM nation WHERE n_nationkey < 3
), m AS (
  SELECT etype, user_id % 30 AS meter, time_bucket(INTERVAL '15 minutes', ts) AS ts, round(sum(value), 6) AS ap
  FROM (SELECT *, CASE WHEN event_type IN ('purchase', 'error') THEN 'production' ELSE 'consumption' END AS etype FROM events)
  WHERE NOT (user_id % 30 = 4 AND ts < TIMESTAMP '2024-01-15') GROUP BY 1, 2, 3
)"""


def _meters(spark, sf):
    events = views.table(spark, sf, "events").where(
        "not (user_id % 30 = 4 and ts < timestamp'2024-01-15 00:00:00')"
    )
    rows = events.select(
        views.etype_of(F.col("event_type")).alias("etype"), (F.col("user_id") % 30).alias("meter"),
        F.col("ts").alias("dls"), F.col("value").alias("ap"),
    )
    bins = rounded(regular.bin_sums(rows, ["etype", "meter"], sums=["ap"]), "ap")
    keyed = bins.select(F.concat_ws("/", "etype", F.col("meter").cast("string")).alias("site_key"), "ts", "ap")
    nation = views.table(spark, sf, "nation")
    pairs = nation.select("n_nationkey", F.col("n_regionkey").alias("site_id")).unionByName(
        nation.where("n_nationkey < 3").select("n_nationkey", F.lit(9).alias("site_id"))
    )
    kinds = F.explode(F.array(F.lit("consumption"), F.lit("production"))).alias("etype")
    members = pairs.select("*", kinds).select(
        "etype", "site_id", F.concat_ws("/", "etype", F.col("n_nationkey").cast("string")).alias("site_key")
    )
    return keyed, members


@query(
    "group_sum",
    f"""WITH {GROUPS}, s AS (
  SELECT etype, meter, unnest(generate_series(min(ts), max(ts), INTERVAL '15 minutes')) AS ts FROM m GROUP BY 1, 2
), f AS (SELECT s.*, coalesce(m.ap, 0.0::DOUBLE) AS ap FROM s LEFT JOIN m USING (etype, meter, ts))
SELECT f.etype, site_id, ts, round(sum(ap), 6) + 0.0::DOUBLE AS ap FROM f JOIN members USING (meter) GROUP BY 1, 2, 3""",
)
def group_sum(spark, sf):
    series, members = _meters(spark, sf)
    return rounded(regular.group_sum(series, members), "ap")


@query(
    "group_sum_zero_grid",
    f"""WITH {GROUPS}, t AS (
  SELECT m.etype, site_id, ts, sum(ap) AS ap FROM m JOIN members USING (meter)
  WHERE NOT (m.etype = 'consumption' AND meter % 5 = 0) GROUP BY 1, 2, 3
), s AS (SELECT etype, site_id, unnest(generate_series(min(ts), max(ts), INTERVAL '15 minutes')) AS ts FROM t GROUP BY 1, 2)
SELECT s.etype, s.site_id, s.ts, round(coalesce(t.ap, 0.0::DOUBLE), 6) + 0.0::DOUBLE AS ap
FROM s LEFT JOIN t USING (etype, site_id, ts)""",
)
def group_sum_zero_grid(spark, sf):
    series, members = _meters(spark, sf)
    left_out = members.select("site_key").where(
        "site_key like 'consumption/%' and cast(split(site_key, '/')[1] as int) % 5 = 0"
    ).distinct()
    return rounded(regular.zero_grid_sum(series, members, left_out), "ap")


@query("every_nth", f"WITH {POSITIONS} SELECT etype, site_id, ts, ap FROM p WHERE pos % 7 = 0")
def every_nth(spark, sf):
    return samples.every_nth(views.grid(spark, sf), 7)


@query(
    "weekly_slices",
    f"""WITH {POSITIONS} SELECT etype, site_id, pos // 672 AS week, min(ts) AS start, max(ts) AS stop, count(*) AS n,
  round(sum(ap), 6) + 0.0::DOUBLE AS total FROM p GROUP BY 1, 2, 3""",
)
def weekly_slices(spark, sf):
    weeks = samples.slices(views.grid(spark, sf)).withColumnRenamed("slice", "week")
    return rounded(
        weeks.groupBy("etype", "site_id", "week").agg(
            F.min("ts").alias("start"), F.max("ts").alias("stop"), F.count(F.lit(1)).alias("n"), F.sum("ap").alias("total")
        ),
        "total",
    )


@query(
    "daily_slices",
    f"""WITH {POSITIONS} SELECT etype, site_id, ts, pos, pos // 96 AS slice, ap FROM p WHERE (pos // 96 + 1) * 96 <= n""",
)
def daily_slices(spark, sf):
    return samples.slices(views.grid(spark, sf), 96, drop_short=True)
