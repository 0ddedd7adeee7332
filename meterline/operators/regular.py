"""From raw readings to a regular 15-minute series per key."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from meterline.functions.clock import floor_to
from meterline.operators.chunks import CHUNK_ROWS, fill, neighbours
from meterline.session import KEY, STEP_SECONDS, stored


def bin_sums(
    df: DataFrame,
    key: Sequence[str] = KEY,
    ts: str = "dls",
    sums: Iterable[str] = ("ap", "q1", "q4"),
    firsts: Iterable[str] = (),
) -> DataFrame:
    """Sum of the readings of each 15-minute step; steps without readings are left out.

    Sums are pre-aggregated before the shuffle, so a key with most of the rows costs no more than
    its number of steps.
    """
    sums, firsts = list(sums), list(firsts)
    return df.groupBy(*key, floor_to(F.col(ts)).alias("ts")).agg(
        *[F.sum(c).alias(c) for c in sums],
        *[F.min_by(c, F.when(F.col(c).isNotNull(), F.col(ts))).alias(c) for c in firsts],
    )


def merge_duplicates(
    df: DataFrame, key: Sequence[str] = KEY, ts: str = "ts", sums: Iterable[str] = ("ap",)
) -> DataFrame:
    """One row per stamp; rows with the same stamp add up."""
    return df.groupBy(*key, ts).agg(*[F.sum(c).alias(c) for c in sums])


def regular_grid(
    df: DataFrame,
    key: Sequence[str] = KEY,
    ts: str = "ts",
    step_seconds: int = STEP_SECONDS,
) -> DataFrame:
    """Every step from the first to the last stamp of a key, counted from the first stamp.

    Steps without a row hold nulls; rows between two steps are dropped. The span of a key is laid
    out chunk by chunk, so a long series is generated by many tasks. The rows are never sent to the
    driver for a broadcast: as files, which is what Spark judges them by, they are many times
    smaller than in memory (grids hold mostly zeros).
    """
    key = list(key)
    step = F.lit(step_seconds * 1_000_000)
    spans = df.groupBy(*key).agg(
        F.unix_micros(F.min(ts)).alias("_start"), F.unix_micros(F.max(ts)).alias("_stop")
    )
    steps = F.floor((F.col("_stop") - F.col("_start")) / step)
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    chunks = spans.select(
        *key, "_start", steps.alias("_steps"),
        F.explode(F.sequence(F.lit(0), F.floor(steps / CHUNK_ROWS))).alias("_part"),
    ).repartition(parts, *key, "_part")
    first = F.col("_part") * CHUNK_ROWS
    last = F.least(first + CHUNK_ROWS - 1, F.col("_steps"))
    grid = chunks.select(
        *key, "_start", F.explode(F.sequence(first, last)).alias("_step")
    ).select(*key, F.timestamp_micros(F.col("_start") + F.col("_step") * step).alias(ts))
    return grid.join(df.hint("merge"), [*key, ts], "left").select(*df.columns)


def resample(
    df: DataFrame,
    key: Sequence[str] = KEY,
    ts: str = "dls",
    sums: Iterable[str] = ("ap", "q1", "q4"),
    firsts: Iterable[str] = (),
) -> DataFrame:
    """15-minute sums on a full grid; an empty step is 0. ``firsts`` columns hold one value per
    key (site name, serial): it is taken over to the empty steps."""
    sums, firsts = list(sums), list(firsts)
    # The grid reads the sums twice; written once, the raw readings are scanned once.
    steps = stored(bin_sums(df, key, ts, sums, firsts), "step-sums")
    grid = regular_grid(steps, key).fillna(0.0, sums)
    if firsts:
        grid = fill(grid, firsts, key)
    return grid


def holes_to_zero(df: DataFrame, cols: Iterable[str] = ("ap",)) -> DataFrame:
    return df.fillna(0.0, list(cols))


def first_in_bin(
    df: DataFrame, cols: Iterable[str], key: Sequence[str] = (), ts: str = "ts"
) -> DataFrame:
    """First non-null value of each column in each 15-minute step, on a full grid."""
    firsts = df.groupBy(*key, floor_to(F.col(ts)).alias("ts")).agg(
        *[F.min_by(c, F.when(F.col(c).isNotNull(), F.col(ts))).alias(c) for c in cols]
    )
    return regular_grid(stored(firsts, "step-firsts"), key)


def group_sum(
    series: DataFrame,
    groups: DataFrame,
    strict: bool = True,
    member: str = "site_key",
    group: Sequence[str] = KEY,
) -> DataFrame:
    """Sum of the member series of each group: members are put on their own grid with 0 in the
    holes and added by stamp, a member outside its span counting 0.

    ``groups`` maps ``member`` to the ``group`` columns. Members without a series are left out; with
    ``strict`` a group without any series is an error.
    """
    group = list(group)
    wanted = groups.select(*group, member).distinct()
    rows = stored(
        merge_duplicates(series.join(wanted.select(member).distinct(), member, "left_semi"), [member]),
        "member-sums",
    )
    grid = holes_to_zero(regular_grid(rows, [member]))
    total = grid.join(wanted, member).groupBy(*group, "ts").agg(F.sum("ap").alias("ap"))
    if not strict:
        return total
    checked = wanted.select(*group).distinct().join(total, group, "left")
    name = F.concat_ws("/", *[F.col(c).cast("string") for c in group])
    message = F.concat(F.lit("no source series for group "), name)
    return checked.withColumn(
        "ts", F.when(F.col("ts").isNull(), F.raise_error(message)).otherwise(F.col("ts"))
    )


def zero_grid_sum(
    series: DataFrame,
    groups: DataFrame,
    left_out: DataFrame | None = None,
    member: str = "site_key",
    group: Sequence[str] = KEY,
) -> DataFrame:
    """Older form: each group is laid on one grid over the whole span of its members, 0 where no
    member has a value. ``left_out`` lists members that do not count."""
    group = list(group)
    if left_out is not None:
        groups = groups.join(left_out, [c for c in left_out.columns], "left_anti")
    total = stored(
        series.join(groups.select(*group, member).distinct(), member)
        .groupBy(*group, "ts")
        .agg(F.sum("ap").alias("ap")),
        "group-sums",
    )
    return holes_to_zero(regular_grid(total, group))


def join_weather(
    series: DataFrame,
    weather: DataFrame,
    key: Sequence[str] = KEY,
    how: str = "both",
) -> DataFrame:
    """Weather on the stamps of each series, gaps filled from values inside the span of the series.

    ``series`` and ``weather`` are full grids. The known values next to each stamp are looked up
    once, on the weather, together with the stamps they are from; a series takes a value only if
    that stamp is in its span. So the series is neither sorted nor shuffled by key for the fill. A
    series that shares no stamp with the weather is an error: all its weather columns are null.
    """
    if how not in ("both", "forward"):
        raise ValueError(f"how is 'both' or 'forward', not {how!r}")
    key = list(key)
    cols = [c for c in weather.columns if c != "ts"]
    known = {c: F.when(F.col(c).isNotNull(), F.struct("ts", F.col(c).alias("v"))) for c in cols}
    marked = weather.select("ts", *[v.alias(c) for c, v in known.items()])
    near = neighbours(marked, cols, []).drop(*cols)
    # Stamps outside the weather have its first or last known value next to them.
    edges = marked.agg(
        F.lit(1).alias("_one"),
        F.min("ts").alias("_w_first"), F.max("ts").alias("_w_last"),
        *[F.min(c).alias(f"_first_{c}") for c in cols], *[F.max(c).alias(f"_last_{c}") for c in cols],
    )
    spans = (
        series.groupBy(*key)
        .agg(F.min("ts").alias("_first"), F.max("ts").alias("_last"), F.lit(1).alias("_one"))
        .join(edges, "_one")
    )

    def value(c: str) -> Column:
        before = F.when(F.col("ts") > F.col("_w_last"), F.col(f"_last_{c}")).otherwise(F.col(f"_prev_{c}"))
        after = F.when(F.col("ts") < F.col("_w_first"), F.col(f"_first_{c}")).otherwise(F.col(f"_next_{c}"))
        past = F.when(before["ts"] >= F.col("_first"), before["v"])
        future = F.when(after["ts"] <= F.col("_last"), after["v"])
        return (F.coalesce(past, future) if how == "both" else past).alias(c)

    joined = (
        series.join(near, "ts", "left")
        .join(spans, key)
        .select(*series.columns, *[value(c) for c in cols])
    )
    if how != "both":
        return joined
    missing = F.lit(True)
    for c in cols:
        missing = missing & F.col(c).isNull()
    message = F.lit("weather has no stamp in common with the series")
    return joined.withColumn("ts", F.when(missing, F.raise_error(message)).otherwise(F.col("ts")))


def lookup_weather(series: DataFrame, weather: DataFrame) -> DataFrame:
    """Weather on the stamps of each series; a stamp without weather is an error."""
    cols = [c for c in weather.columns if c != "ts"]
    joined = series.join(weather.withColumn("_found", F.lit(True)), "ts", "left")
    message = F.concat(F.lit("no weather at "), F.col("ts").cast("string"))
    return joined.withColumn(
        "ts", F.when(F.col("_found").isNull(), F.raise_error(message)).otherwise(F.col("ts"))
    ).select(*series.columns, *cols)
