"""Ordered work on long series without putting a series into one task.

A window partitioned by the series key alone sorts a whole series in one task. Here every series
is cut into chunks of consecutive rows. Frames of bounded length get the neighbour rows they need
copied in from the next chunks (``spread``); running results such as positions and fills are done
per chunk and corrected by a summary with one row per chunk.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from meterline.functions.clock import slot
from meterline.session import KEY, stored

CHUNK, HOME = "_chunk", "_home"
CHUNK_ROWS = 1344  # two weeks of 15-minute steps


def chunk_rows(before: int, after: int, rows: int | None = None) -> int:
    """Chunk length that keeps the copied rows a small share."""
    return rows or max(CHUNK_ROWS, 4 * (before + after))


def spread(
    df: DataFrame, order: Column, before: int, after: int, rows: int | None = None
) -> DataFrame:
    """Copy each row to every chunk in which a row may look back or ahead at it.

    ``order`` is an integer without holes inside a series (the slot of a regular grid, or a
    position). Keep the rows of a chunk itself with ``at_home`` once the windows are computed.
    """
    n = chunk_rows(before, after, rows)
    chunk_of = lambda c: F.floor(c / F.lit(n)).cast("long")
    return df.withColumn(HOME, chunk_of(order)).withColumn(
        CHUNK, F.explode(F.sequence(chunk_of(order - after), chunk_of(order + before)))
    )


def chunk_window(key: Sequence[str], ts: str = "ts") -> WindowSpec:
    return Window.partitionBy(*key, CHUNK).orderBy(ts)


def at_home(df: DataFrame) -> DataFrame:
    return df.where(F.col(CHUNK) == F.col(HOME)).drop(CHUNK, HOME)


def with_position(
    df: DataFrame, key: Sequence[str] = KEY, ts: str = "ts", name: str = "pos"
) -> DataFrame:
    """0-based position ``name`` of each row in its series and the series length ``n``.

    Stamps are unique within a series. Rows are numbered per chunk; the rows of the chunks before
    are added from the chunk counts, of which there is one per two weeks and series.
    """
    chunked = df.withColumn(CHUNK, F.floor(slot(F.col(ts)) / CHUNK_ROWS).cast("long"))
    whole = Window.partitionBy(*key)
    earlier = whole.orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    counts = (
        chunked.groupBy(*key, CHUNK)
        .agg(F.count(F.lit(1)).alias("_rows"))
        .select(
            *key, CHUNK,
            F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before"),
            F.sum("_rows").over(whole).alias("n"),
        )
    )
    numbered = chunked.withColumn("_rn", F.row_number().over(chunk_window(key, ts)))
    return (
        numbered.join(counts, [*key, CHUNK])
        .withColumn(name, (F.col("_before") + F.col("_rn") - 1).cast("long"))
        .select(*df.columns, name, "n")
    )


def neighbours(
    df: DataFrame, cols: Sequence[str], key: Sequence[str] = KEY, ts: str = "ts"
) -> DataFrame:
    """Columns ``_prev_<c>`` and ``_next_<c>``: the last value of ``c`` that is not null up to the
    row, and the first one from the row on, however far away.

    Both are found inside the chunk first; the ends of the other chunks, one row per chunk, fill up
    what is missing there.
    """
    chunked = df.withColumn(CHUNK, F.floor(slot(F.col(ts)) / CHUNK_ROWS).cast("long"))
    known = lambda c: F.when(F.col(c).isNotNull(), F.col(ts))
    ends = chunked.groupBy(*key, CHUNK).agg(
        *[F.max_by(c, known(c)).alias(f"_last_{c}") for c in cols],
        *[F.min_by(c, known(c)).alias(f"_first_{c}") for c in cols],
    )
    by_chunk = Window.partitionBy(*key).orderBy(CHUNK)
    past = by_chunk.rowsBetween(Window.unboundedPreceding, -1)
    future = by_chunk.rowsBetween(1, Window.unboundedFollowing)
    carried = ends.select(
        *key, CHUNK,
        *[F.last(f"_last_{c}", ignorenulls=True).over(past).alias(f"_from_{c}") for c in cols],
        *[F.first(f"_first_{c}", ignorenulls=True).over(future).alias(f"_to_{c}") for c in cols],
    )
    here = chunk_window(key, ts)
    upto = here.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    onward = here.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    scanned = chunked.select(
        *df.columns, CHUNK,
        *[F.last(c, ignorenulls=True).over(upto).alias(f"_up_{c}") for c in cols],
        *[F.first(c, ignorenulls=True).over(onward).alias(f"_on_{c}") for c in cols],
    )
    return scanned.join(carried, [*key, CHUNK]).select(
        *df.columns,
        *[F.coalesce(f"_up_{c}", f"_from_{c}").alias(f"_prev_{c}") for c in cols],
        *[F.coalesce(f"_on_{c}", f"_to_{c}").alias(f"_next_{c}") for c in cols],
    )


def fill(
    df: DataFrame,
    cols: Iterable[str],
    key: Sequence[str] = KEY,
    ts: str = "ts",
    how: str = "both",
) -> DataFrame:
    """Fill nulls from the last value before (``forward``), the next after (``backward``), or
    forward first and then backward (``both``), over gaps of any length."""
    if how not in ("both", "forward", "backward"):
        raise ValueError(f"how is 'both', 'forward' or 'backward', not {how!r}")
    cols = list(cols)
    sides = {"forward": ["prev"], "backward": ["next"], "both": ["prev", "next"]}[how]
    filled = {c: F.coalesce(*[F.col(f"_{side}_{c}") for side in sides]) for c in cols}
    return neighbours(df, cols, key, ts).select(
        *[filled[c].alias(c) if c in filled else F.col(c) for c in df.columns]
    )


def ranked_values(
    df: DataFrame, key: Sequence[str], value: str, weight: str | None = None, bucket_rows: int = 250_000
) -> DataFrame:
    """Distinct values per group with their count, the rows ``below`` them and the rows ``total``.

    ``weight`` names a column with the number of rows a row stands for.

    Equal values are merged first and written, as they are read several times. The distinct values
    are range-partitioned by group and value into buckets of about ``bucket_rows``, so that their number
    follows the rows and a large group takes as many as it needs. Buckets are sorted apart from each other
    and the counts of those before are added, so ranks are exact wherever the cuts are.
    """
    key = list(key)
    if not key:
        one = df.withColumn("_all", F.lit(0))
        return ranked_values(one, ["_all"], value, weight, bucket_rows).drop("_all")
    counts = stored(
        df.where(F.col(value).isNotNull())
        .groupBy(*key, value)
        .agg((F.sum(weight) if weight else F.count(F.lit(1))).alias("cnt")),
        "value-counts",
    )
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(least, -(-counts.count() // bucket_rows))
    # Written, for the cuts are drawn from a sample and must not change when a lost task is run again.
    placed = stored(
        counts.repartitionByRange(parts, *key, value).withColumn("_bucket", F.spark_partition_id()),
        "value-buckets",
    )
    whole = Window.partitionBy(*key)
    earlier = whole.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy(*key, "_bucket")
        .agg(F.sum("cnt").alias("_rows"))
        .select(
            *key, "_bucket",
            F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before"),
            F.sum("_rows").over(whole).alias("total"),
        )
    )
    inside = (
        Window.partitionBy(*key, "_bucket")
        .orderBy(value)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    return (
        placed.withColumn("_in", F.coalesce(F.sum("cnt").over(inside), F.lit(0)))
        .join(offsets, [*key, "_bucket"])
        .select(*key, value, "cnt", (F.col("_before") + F.col("_in")).alias("below"), "total")
    )


def exact_quantiles(
    df: DataFrame, key: Sequence[str], value: str, probs: dict[str, float]
) -> DataFrame:
    """Quantiles by linear interpolation between the two nearest ranks, one row per group."""
    ranked = ranked_values(df, key, value)
    low_aggs, out = [], []
    for name, p in probs.items():
        at = F.lit(p) * (F.col("total") - 1)
        holds = lambda pos: (F.col("below") <= pos) & (pos < F.col("below") + F.col("cnt"))
        low_aggs += [
            F.max(F.when(holds(F.floor(at)), F.col(value))).alias(f"_lo_{name}"),
            F.max(F.when(holds(F.ceil(at)), F.col(value))).alias(f"_hi_{name}"),
            F.max(at - F.floor(at)).alias(f"_w_{name}"),
        ]
        lo, hi, w = (F.col(f"_{x}_{name}") for x in ("lo", "hi", "w"))
        out.append((lo + (hi - lo) * w).alias(name))
    return ranked.groupBy(*key).agg(*low_aggs).select(*key, *out)
