"""Queries on names, tables, pages, profiles and row filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from meterline.catalog.registry import GRID, READINGS, query, rnd, rounded
from meterline.functions.calendar import holiday_dates
from meterline.functions.names import parse_file_name, parse_site_key, site_key
from meterline.operators import clean
from meterline.plans import views
from meterline.sources import pages, profile, readings as reading_files, tables, weather

START, END = "2024-01-05 00:00:00", "2024-01-20 12:00:00"


@query(
    "parse_site_keys",
    """WITH f AS (
  SELECT c_custkey, CASE c_custkey % 8
      WHEN 0 THEN 'std_' || c_mktsegment || '_' || c_custkey || '.csv'
      WHEN 1 THEN 'std_2015_' || c_mktsegment || '_NORTH_C_' || c_custkey || '.csv'
      WHEN 2 THEN 'std_' || c_mktsegment || '_P_' || c_custkey || '.csv'
      WHEN 3 THEN 'std__' || c_mktsegment || '-_' || c_custkey || '.csv'
      WHEN 4 THEN 'std_A.' || c_mktsegment || '~B+_' || c_custkey || '.csv'
      WHEN 5 THEN 'std_2009_' || c_mktsegment || '_' || c_custkey || '.csv'
      WHEN 6 THEN 'std_2021_' || c_mktsegment || '-X_C_' || c_custkey || '.csv'
      ELSE 'std_' || c_custkey || '.csv' END AS file
  FROM customer
), s AS (SELECT *, [x for x in string_split(file, '_') if x <> ''] AS parts FROM f
), m AS (
  SELECT c_custkey, file, parts[-1] AS tail,
         CASE WHEN len(parts) >= 2 AND parts[2] BETWEEN '2010' AND '2021' AND len(parts[2]) = 4
              THEN parts[3:-2] ELSE parts[2:-2] END AS middle
  FROM s
), k AS (
  SELECT *, coalesce(middle[-1] IN ('C', 'P'), false) AS marked FROM m
), n AS (
  SELECT c_custkey, file, left(tail, len(tail) - 4) AS sn,
         array_to_string(CASE WHEN marked THEN middle[1:-2] ELSE middle END, '_') AS raw,
         (marked AND middle[-1] = 'P') AS said
  FROM k
), o AS (
  SELECT c_custkey, file, sn, replace(replace(raw, '-', ''), '+', '') AS site,
         (said OR contains(raw, '-')
          OR (replace(replace(raw, '-', ''), '+', '') = 'BUILDING' AND sn = '0')) AS production
  FROM n
), q AS (
  SELECT *, '/site_' || replace(replace(replace(replace(site, '.', '_'), '-', '_'), '~', '_'), '+', '')
         || '_' || sn || CASE WHEN production THEN '/production' ELSE '/consumption' END AS site_key
  FROM o
)
SELECT c_custkey, file, site, sn, production, site_key,
       replace(replace(replace(site, '.', '_'), '~', '_'), '+', '') AS key_site, sn AS key_sn
FROM q""",
)
def parse_site_keys(spark, sf):
    segment, number = F.col("c_mktsegment"), F.col("c_custkey").cast("string")
    shapes = [
        ("std_", segment, "_"), ("std_2015_", segment, "_NORTH_C_"), ("std_", segment, "_P_"),
        ("std__", segment, "-_"), ("std_A.", segment, "~B+_"), ("std_2009_", segment, "_"),
        ("std_2021_", segment, "-X_C_"), ("std_", F.lit(""), ""),
    ]
    file = F.lit(None).cast("string")
    for i, (head, middle, tail) in enumerate(shapes):
        name = F.concat(F.lit(head), middle, F.lit(tail), number, F.lit(".csv"))
        file = F.when(F.col("c_custkey") % 8 == i, name).otherwise(file)
    named = views.table(spark, sf, "customer").select("c_custkey", file.alias("file"))
    parsed = named.select("*", parse_file_name(F.col("file"), [("BUILDING", "0")]).alias("f"))
    keyed = parsed.select(
        "c_custkey", "file", "f.*", site_key(F.col("f.site"), F.col("f.sn"), F.col("f.production")).alias("site_key")
    )
    back = parse_site_key(F.col("site_key"))
    return keyed.select("*", back["site"].alias("key_site"), back["sn"].alias("key_sn"))


@query(
    "distinct_sites",
    """WITH users AS (
  SELECT DISTINCT CASE WHEN user_id % 25 = 0 THEN '' ELSE 'NATION.' || (user_id % 25) END AS site,
         user_id % 5 AS sn
  FROM events)
SELECT site, sn FROM users
WHERE NOT (site = '' AND sn = 0)
  AND (replace(site, '.', '_'), CAST(sn AS VARCHAR)) IN
      (SELECT n_name, CAST(n_regionkey AS VARCHAR) FROM nation
       UNION ALL SELECT '', CAST(r_regionkey AS VARCHAR) FROM region)""",
)
def distinct_sites(spark, sf):
    user = F.col("user_id")
    rows = views.table(spark, sf, "events").select(
        F.when(user % 25 == 0, "").otherwise(F.concat(F.lit("NATION."), (user % 25).cast("string"))).alias("site"),
        (user % 5).alias("sn"),
    )
    nations = views.table(spark, sf, "nation").select(F.col("n_name").alias("site"), F.col("n_regionkey").alias("sn"))
    empty = views.table(spark, sf, "region").select(F.lit("").alias("site"), F.col("r_regionkey").alias("sn"))
    return clean.listed_sites(rows, nations.unionByName(empty))


@query(
    "range_scan_first_table",
    f"""WITH raw AS (
  SELECT event_id, 'S' || (user_id % 40) AS site, user_id % 3 AS sn, date_trunc('hour', ts) AS dls, value AS ap,
         CASE WHEN event_type IN ('view', 'click') THEN 0 ELSE 1 END AS database_rank,
         CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 WHEN 'purchase' THEN 0 WHEN 'error' THEN 1 ELSE 2 END AS table_rank
  FROM events
  WHERE NOT (user_id % 40 < 20 AND event_type IN ('view', 'purchase'))
), inside AS (
  SELECT *, min(table_rank) OVER (PARTITION BY site, sn, database_rank) AS first_rank
  FROM raw WHERE dls BETWEEN TIMESTAMP '{START}' AND TIMESTAMP '{END}'
), pick AS (
  SELECT *, row_number() OVER (PARTITION BY site, sn, dls ORDER BY database_rank, event_id) AS k
  FROM inside WHERE table_rank = first_rank
)
SELECT site, sn, dls AS ts, event_id, ap, database_rank, table_rank FROM pick WHERE k = 1""",
)
def range_scan_first_table(spark, sf):
    user, kind = F.col("user_id"), F.col("event_type")
    raw = views.table(spark, sf, "events").where(
        ~((user % 40 < 20) & kind.isin("view", "purchase"))
    ).select(
        F.concat(F.lit("S"), (user % 40).cast("string")).alias("site"),
        (user % 3).alias("sn"), F.date_trunc("hour", "ts").alias("dls"),
        "event_id", F.col("value").alias("ap"),
        F.when(kind.isin("view", "click"), 0).otherwise(1).alias("database_rank"),
        F.when(kind.isin("view", "purchase"), 0).when(kind.isin("click", "error"), 1).otherwise(2).alias("table_rank"),
    )
    stamp = lambda t: F.to_timestamp(F.lit(t))
    return tables.range_scan(raw, stamp(START), stamp(END), order=["event_id"])


@query(
    "file_row_guard",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM lineitem
WHERE l_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(*) > 1)""",
)
def file_row_guard(spark, sf):
    rows = views.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    return reading_files.files_with_rows(rows, "l_orderkey")


LINKS = """found AS (
  SELECT page_id, regexp_extract_all(html, '<a[^>]+href="([^"]+)"[^>]*>(.*?)</a>', 1, 'is') AS hrefs,
         regexp_extract_all(html, '<a[^>]+href="([^"]+)"[^>]*>(.*?)</a>', 2, 'is') AS texts
  FROM pages
), each AS (
  SELECT page_id, unnest(range(len(hrefs))) AS i, hrefs, texts FROM found
), links AS (
  SELECT page_id, CAST(i AS INTEGER) AS pos,
         trim(regexp_replace(regexp_replace(texts[i + 1], '<[^>]+>', '', 'g'), '[\\t-\\r\\x1c-\\x1f\\x{85}\\p{Z}]+', ' ', 'g')) AS label,
         CASE WHEN starts_with(hrefs[i + 1], 'http') THEN hrefs[i + 1] ELSE 'https://example.org' || hrefs[i + 1] END AS url
  FROM each
)"""


@query("extract_links", f"WITH {LINKS} SELECT page_id, pos, label, url FROM links WHERE label <> ''")
def extract_links(spark, sf):
    return pages.extract_links(views.table(spark, sf, "pages"), "https://example.org")


@query(
    "links_per_year",
    """WITH texts AS (
  SELECT page_id, url, lower('Profile ' || lang || ' ' || url) AS txt
  FROM (SELECT page_id, url, regexp_extract(html, '<html lang="([a-z]+)"', 1) AS lang FROM pages)
), fit AS (
  SELECT *, unnest(list_distinct(regexp_extract_all(txt, '\\d+'))) AS y
  FROM texts
  WHERE contains(txt, 'profile') AND (contains(txt, '/en') OR contains(txt, '/fr')) AND NOT contains(txt, 'ref=') AND NOT contains(txt, '.org')
), found AS (
  SELECT CAST(y AS INTEGER) AS year, arg_min(url, page_id) AS url FROM fit
  WHERE len(y) <= 4 AND CAST(y AS INTEGER) BETWEEN 100 AND 900 AND left(y, 1) <> '0' GROUP BY 1
)
SELECT coalesce(f.year, x.year) AS year, coalesce(x.url, f.url) AS url
FROM found f FULL JOIN (VALUES (111, 'https://example.org/fixed/111'), (899, 'https://example.org/fixed/899')) x(year, url)
  ON f.year = x.year""",
)
def links_per_year(spark, sf):
    lang = F.regexp_extract("html", '<html lang="([a-z]+)"', 1)
    links = views.table(spark, sf, "pages").select(
        "page_id", F.lit(0).alias("pos"), F.concat(F.lit("Profile "), lang).alias("label"), "url"
    )
    fixed = {y: f"https://example.org/fixed/{y}" for y in (111, 899)}
    return pages.links_per_year(
        links, 100, 900, fixed, must=["profile"], some=["/en", "/fr"], never=["ref=", ".org"]
    )


PROFILE_CELLS = """cells AS (
  SELECT o_orderkey, o_orderpriority AS file,
         CASE WHEN o_orderkey % 5 < CASE o_orderpriority WHEN '1-URGENT' THEN 3 WHEN '5-LOW' THEN 4 ELSE 1 END THEN 'n/a'
              ELSE CAST(date_diff('day', DATE '1899-12-30', CAST(o_orderdate AS DATE)) AS VARCHAR)
                   || '.' || lpad(CAST(o_orderkey % 8 * 125 AS VARCHAR), 3, '0') END AS cet,
         CAST(year(o_orderdate) AS VARCHAR) AS y, CAST(month(o_orderdate) AS VARCHAR) AS m,
         CASE WHEN o_orderkey % 11 = 0 THEN '' ELSE CAST(day(o_orderdate) AS VARCHAR) END AS d,
         CAST(o_custkey % 24 AS VARCHAR) AS h, CAST(o_custkey % 4 * 15 AS VARCHAR) AS mi
  FROM orders
)"""


@query(
    "profile_ts",
    f"""WITH {PROFILE_CELLS}, share AS (
  SELECT file, avg(CASE WHEN TRY_CAST(cet AS DOUBLE) IS NULL THEN 0 ELSE 1 END) AS s FROM cells GROUP BY 1
)
SELECT o_orderkey, c.file,
       CASE WHEN s < 0.5
            THEN CASE WHEN d <> '' THEN make_timestamp(CAST(y AS BIGINT), CAST(m AS BIGINT), CAST(d AS BIGINT), CAST(h AS BIGINT), CAST(mi AS BIGINT), 0.0) END
            ELSE make_timestamp(CAST(round((TRY_CAST(cet AS DOUBLE) - 25569.0) * 86400e6) AS BIGINT)) END AS ts
FROM cells c JOIN share USING (file)""",
)
def profile_ts(spark, sf):
    day, key = F.to_date("o_orderdate"), F.col("o_orderkey")
    bad = (
        F.when(F.col("o_orderpriority") == "1-URGENT", 3).when(F.col("o_orderpriority") == "5-LOW", 4).otherwise(1)
    )
    number = F.concat(
        F.date_diff(day, F.lit("1899-12-30").cast("date")).cast("string"), F.lit("."),
        F.lpad((key % 8 * 125).cast("string"), 3, "0"),
    )
    cells = views.table(spark, sf, "orders").select(
        "o_orderkey", F.col("o_orderpriority").alias("file"),
        F.when(key % 5 < bad, "n/a").otherwise(number).alias("cet"),
        F.year(day).cast("string").alias("year"), F.month(day).cast("string").alias("month"),
        F.when(key % 11 == 0, "").otherwise(F.dayofmonth(day).cast("string")).alias("day"),
        (F.col("o_custkey") % 24).cast("string").alias("h"), (F.col("o_custkey") % 4 * 15).cast("string").alias("min"),
    )
    return profile.profile_times(cells).select("o_orderkey", "file", "ts")


@query(
    "profile_column",
    """WITH cells AS (
  SELECT c_nationkey AS file, c_custkey AS col_pos, c_custkey % 6 AS row_pos,
         CASE WHEN c_nationkey % 4 = 0 AND c_custkey % 50 < 25 THEN ' Target ' WHEN c_nationkey % 4 <= 2 AND c_custkey % 7 = 0 THEN 'SMALL'
              ELSE 'small.' || (c_custkey % 9) END AS col_name,
         CASE WHEN c_nationkey % 4 = 1 THEN CASE WHEN c_mktsegment = 'BUILDING' THEN ' TARGET' ELSE c_mktsegment END ELSE c_name END AS cell
  FROM customer
), cols AS (
  SELECT file, col_pos, trim(col_name) AS col_name, bool_or(row_pos < 4 AND lower(trim(cell)) = 'target') AS labelled
  FROM cells GROUP BY 1, 2, 3
), ranked AS (
  SELECT *, CASE WHEN lower(col_name) = 'target' THEN 1 WHEN labelled THEN 2 WHEN lower(col_name) = 'small' THEN 3
                 WHEN starts_with(lower(col_name), 'small') THEN 4 END AS rule FROM cols
), best AS (
  SELECT *, row_number() OVER (PARTITION BY file ORDER BY rule, col_pos) AS k FROM ranked WHERE rule IS NOT NULL
)
SELECT file, col_pos, col_name, rule FROM best WHERE k = 1""",
)
def profile_column(spark, sf):
    nation, cust = F.col("c_nationkey"), F.col("c_custkey")
    name = (
        F.when((nation % 4 == 0) & (cust % 50 < 25), " Target ")
        .when((nation % 4 <= 2) & (cust % 7 == 0), "SMALL")
        .otherwise(F.concat(F.lit("small."), (cust % 9).cast("string")))
    )
    label = F.when(F.col("c_mktsegment") == "BUILDING", " TARGET").otherwise(F.col("c_mktsegment"))
    cells = views.table(spark, sf, "customer").select(
        nation.alias("file"), cust.alias("col_pos"), (cust % 6).alias("row_pos"), name.alias("col_name"),
        F.when(nation % 4 == 1, label).otherwise(F.col("c_name")).alias("cell"),
    )
    return profile.choose_column(cells, "target", "small")


def _profile_points(spark, sf):
    return views.table(spark, sf, "orders").select(
        "o_orderkey", F.col("o_orderpriority").alias("file"),
        F.when(F.col("o_orderkey") % 13 == 0, None).otherwise(F.col("o_orderdate")).alias("ts"),
        F.when(F.col("o_orderkey") % 17 != 0, F.col("o_totalprice")).alias("value"),
    )


@query(
    "profile_clean",
    """WITH v AS (
  SELECT o_orderpriority || CASE WHEN o_orderkey % 400 = 1 THEN '-short' ELSE '' END AS file, o_orderdate AS ts, arg_min(o_totalprice, o_orderkey) AS value
  FROM orders
  WHERE o_orderkey % 13 <> 0 AND o_orderkey % 17 <> 0 AND year(o_orderdate) BETWEEN 2000 AND 2100
  GROUP BY 1, 2
), sized AS (SELECT *, count(*) OVER (PARTITION BY file) AS points FROM v)
SELECT file, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, value FROM sized WHERE points >= 20""",
)
def profile_clean(spark, sf):
    short = F.when(F.col("o_orderkey") % 400 == 1, "-short").otherwise("")
    points = _profile_points(spark, sf).withColumn("file", F.concat("file", short))
    kept = profile.clean_profile(points, order=["o_orderkey"], least=20, on_short="drop")
    return kept.withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))


@query(
    "profile_to_watts",
    f"""WITH d AS (
  SELECT CAST(year(o_orderdate) AS INTEGER) AS year, o_orderdate AS ts, sum(o_totalprice) AS price FROM orders GROUP BY 1, 2
), s AS (SELECT *, sum(price) OVER (PARTITION BY year) AS total, max(price) OVER (PARTITION BY year) AS top FROM d
), v AS (
  SELECT year, ts, CASE year % 4 WHEN 0 THEN price / total WHEN 1 THEN price / total * 100.0 WHEN 2 THEN price / top * 40.0 ELSE price END AS value FROM s
), t AS (SELECT *, sum(value) OVER (PARTITION BY year) AS s, max(value) OVER (PARTITION BY year) AS m FROM v)
SELECT year, ts, {rnd('''CASE WHEN s BETWEEN 0.8 AND 1.2 THEN 3500.0::DOUBLE * value / 0.25::DOUBLE * 1000.0::DOUBLE
  WHEN s BETWEEN 80 AND 120 THEN 3500.0::DOUBLE * (value / 100.0::DOUBLE) / 0.25::DOUBLE * 1000.0::DOUBLE
  WHEN m < 50 THEN value * 1000.0::DOUBLE ELSE value END''', 4)} AS power_w
FROM t""",
)
def profile_to_watts(spark, sf):
    days = views.table(spark, sf, "orders").groupBy(
        F.year("o_orderdate").alias("year"), F.col("o_orderdate").alias("ts")
    ).agg(F.sum("o_totalprice").alias("price"))
    sizes = days.groupBy("year").agg(F.sum("price").alias("total"), F.max("price").alias("top"))
    share, kind = F.col("price") / F.col("total"), F.col("year") % 4
    value = (
        F.when(kind == 0, share).when(kind == 1, share * 100.0)
        .when(kind == 2, F.col("price") / F.col("top") * 40.0).otherwise(F.col("price"))
    )
    curve = profile.to_watts(days.join(sizes, "year").select("year", "ts", value.alias("value")))
    return rounded(curve.select("year", "ts", "power_w"), "power_w", digits=4)


@query(
    "latest_demand",
    """WITH d AS (
  SELECT o_custkey % 97 AS region, o_orderdate, o_orderkey,
         CASE o_orderkey % 6 WHEN 0 THEN 'n/a' WHEN 1 THEN '-' || CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR)
              ELSE CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) END AS power
  FROM orders
), last AS (SELECT *, row_number() OVER (PARTITION BY region ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM d)
SELECT region, greatest(coalesce(TRY_CAST(power AS DOUBLE), 0.0::DOUBLE), 0.0::DOUBLE) AS power_w FROM last WHERE k = 1""",
)
def latest_demand(spark, sf):
    from meterline.operators.decide import latest_demand as latest

    whole = F.floor("o_totalprice").cast("long").cast("string")
    kind = F.col("o_orderkey") % 6
    rows = views.table(spark, sf, "orders").select(
        (F.col("o_custkey") % 97).alias("region"),
        F.struct("o_orderdate", "o_orderkey").alias("ts"),
        F.when(kind == 0, "n/a").when(kind == 1, F.concat(F.lit("-"), whole)).otherwise(whole).alias("power_w"),
    )
    return latest(rows, ["region"])


@query(
    "weather_station",
    """SELECT e.event_id, e.ts, e.value FROM events e
WHERE e.user_id % 25 IN (SELECT n_nationkey FROM nation WHERE n_name IN ('NATION_3', 'NATION_7'))""",
)
def weather_station(spark, sf):
    observed = views.table(spark, sf, "events").select(
        "event_id", "ts", "value", (F.col("user_id") % 25).cast("int").alias("the_geom")
    )
    # Two places carry the name of the one station looked for.
    stations = views.table(spark, sf, "nation").select(
        F.when(F.col("n_name").isin("NATION_3", "NATION_7"), "STATION").otherwise(F.col("n_name")).alias("name"),
        F.col("n_nationkey").alias("the_geom"),
    )
    return weather.of_station(observed, stations, "STATION").select("event_id", "ts", "value")


@query(
    "sign_and_zero_filter",
    """WITH raw AS (
  SELECT event_id, event_type IN ('purchase', 'error') AS production, 'A.B-' || (user_id % 4) || '~+' AS site,
         CAST(user_id AS VARCHAR) AS sn, ts,
         CASE WHEN event_id % 3 = 0 THEN 0.0::DOUBLE WHEN event_type IN ('purchase', 'error') THEN -value ELSE value END AS ap,
         CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 2 = 0 THEN 0.0::DOUBLE ELSE -value END AS q1, 0.0::DOUBLE AS q4
  FROM events
), turned AS (
  SELECT event_id, replace(replace(replace(replace(site, '.', '_'), '-', '_'), '~', '_'), '+', '') AS site, CAST(sn AS BIGINT) AS sn, ts, production,
         CASE WHEN production THEN abs(ap) ELSE ap END AS ap, CASE WHEN production THEN abs(q1) ELSE q1 END AS q1, q4
  FROM raw
)
SELECT event_id, site, sn, ts, production, ap + 0.0::DOUBLE AS ap, q1 + 0.0::DOUBLE AS q1, q4 FROM turned
WHERE coalesce(ap <> 0, true) OR coalesce(q1 <> 0, true) OR coalesce(q4 <> 0, true)""",
)
def sign_and_zero_filter(spark, sf):
    user, key = F.col("user_id"), F.col("event_id")
    raw = views.table(spark, sf, "events").select(
        "event_id", F.col("event_type").isin("purchase", "error").alias("production"),
        F.concat(F.lit("A.B-"), (user % 4).cast("string"), F.lit("~+")).alias("site"),
        user.cast("string").alias("sn"), F.col("ts").alias("dls"),
        F.when(key % 3 == 0, 0.0).when(F.col("event_type").isin("purchase", "error"), -F.col("value"))
        .otherwise(F.col("value")).alias("ap"),
        F.when(key % 7 == 0, None).when(key % 2 == 0, 0.0).otherwise(-F.col("value")).alias("q1"),
        F.lit(0.0).alias("q4"),
    )
    kept = clean.typed_readings(clean.drop_all_zero(clean.abs_production(raw)))
    return kept.select(
        "event_id", "site", "sn", "ts", "production", (F.col("ap") + 0.0).alias("ap"), (F.col("q1") + 0.0).alias("q1"), "q4"
    )


PERIODS = [
    ("consumption", 1, "2024-01-05", "2024-01-08"), ("consumption", 1, "2024-01-07", "2024-01-10"),
    ("consumption", 2, None, "2024-01-04"), ("production", 3, "2024-01-20", None),
    ("production", 4, "2024-01-29", "2024-02-08"), ("production", 5, None, None),
]


def periods(spark):
    """Removed periods of the sample sites; null is an open end."""
    rows = spark.createDataFrame(PERIODS, "etype string, site_id int, start_day string, end_day string")
    return rows.select(
        "etype", "site_id", F.to_timestamp("start_day").alias("start_ts"), F.to_timestamp("end_day").alias("end_ts")
    )


def _literal(day):
    return "NULL::TIMESTAMP" if day is None else f"TIMESTAMP '{day} 00:00:00'"


PERIOD_ROWS = ", ".join(f"('{e}', {s}, {_literal(a)}, {_literal(b)})" for e, s, a, b in PERIODS)


@query(
    "drop_periods",
    f"""WITH {GRID}, d(etype, site_id, start_ts, end_ts) AS (VALUES {PERIOD_ROWS})
SELECT etype, site_id, ts, ap FROM g
WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.etype = g.etype AND d.site_id = g.site_id
  AND g.ts >= coalesce(d.start_ts, g.ts) AND g.ts <= coalesce(d.end_ts, g.ts))""",
)
def drop_periods(spark, sf):
    return clean.drop_periods(views.grid(spark, sf), periods(spark))


@query(
    "site_deny_list",
    f"""WITH {READINGS} SELECT event_id, etype, site_id, sn, dls, ap FROM r
WHERE NOT (etype = 'consumption' AND site_id IN (1, 4) AND sn % 3 = 0)""",
)
def site_deny_list(spark, sf):
    rows = views.readings(spark, sf).select("event_id", "etype", "site_id", "sn", "dls", "ap")
    denied = (
        views.table(spark, sf, "events").select(F.col("user_id").alias("sn")).distinct()
        .select(F.lit("consumption").alias("etype"), (F.col("sn") % 7 + 1).cast("int").alias("site_id"), "sn")
        .where("site_id in (1, 4) and sn % 3 = 0")
    )
    return clean.not_listed(rows, denied, ["etype", "site_id", "sn"])


@query(
    "min_length_sites",
    f"""WITH {READINGS}, s AS (
  SELECT etype, sn, time_bucket(INTERVAL '15 minutes', dls) AS ts FROM r GROUP BY 1, 2, 3
), c AS (SELECT etype, sn, count(*) AS n FROM s GROUP BY 1, 2)
SELECT s.etype, s.sn, s.ts FROM s JOIN c USING (etype, sn)
WHERE least(n, CAST(floor(n * 0.8::DOUBLE) AS BIGINT), CAST(floor(n * 0.1::DOUBLE) AS BIGINT)) >= 3""",
)
def min_length_sites(spark, sf):
    from meterline.operators.regular import bin_sums

    bins = bin_sums(views.readings(spark, sf), ["etype", "sn"], sums=["ap"]).drop("ap")
    return clean.long_enough(bins, 3, ["etype", "sn"])


@query(
    "delay_cutoff",
    f"""WITH {GRID}, k AS (
  SELECT *, row_number() OVER (PARTITION BY etype, site_id ORDER BY ts DESC) AS k FROM g
  WHERE ts <= time_bucket(INTERVAL '15 minutes', TIMESTAMP '2024-01-21 10:07:33') - INTERVAL 1 DAY)
SELECT etype, site_id, ts, ap FROM k WHERE k = 1""",
)
def delay_cutoff(spark, sf):
    known = clean.known_until(views.grid(spark, sf), "2024-01-21 10:07:33", 1)
    return clean.latest(known)


@query(
    "last_96",
    f"""WITH {READINGS}, b AS (
  SELECT etype, site_id, time_bucket(INTERVAL '15 minutes', dls) AS ts, round(sum(ap), 6) AS ap FROM r GROUP BY 1, 2, 3
), k AS (SELECT *, row_number() OVER (PARTITION BY etype, site_id ORDER BY ts DESC) AS k FROM b)
SELECT etype, site_id, ts, ap FROM k WHERE k <= 96""",
)
def last_96(spark, sf):
    from meterline.operators.regular import bin_sums

    return rounded(clean.last_rows(bin_sums(views.readings(spark, sf), sums=["ap"])), "ap")


@query(
    "holidays",
    """WITH years AS (SELECT DISTINCT CAST(year(o_orderdate) AS INTEGER) AS year FROM orders),
known(easter) AS (VALUES (DATE '1995-04-16'), (DATE '1996-04-07'), (DATE '1997-03-30'), (DATE '1998-04-12'),
  (DATE '1999-04-04'), (DATE '2000-04-23'), (DATE '2001-04-15')),
e AS (SELECT y.year, easter FROM years y JOIN known ON year(easter) = y.year)
SELECT year, CAST(easter AS TIMESTAMP) + to_days(CAST(n AS INTEGER)) AS ts FROM e, (VALUES (1), (39), (50)) x(n)
UNION ALL
SELECT year, CAST(make_date(year, m, d) AS TIMESTAMP) FROM years,
  (VALUES (1, 1), (5, 1), (7, 21), (8, 15), (11, 1), (11, 11), (12, 25)) x(m, d)""",
)
def holidays(spark, sf):
    years = views.table(spark, sf, "orders").select(F.year("o_orderdate").alias("year")).distinct()
    return years.select("year", F.explode(holiday_dates(F.col("year"))).alias("day")).select(
        "year", F.col("day").cast("timestamp").alias("ts")
    )


