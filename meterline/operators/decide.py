"""Allocation of production and choice of sites to shed."""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F


def latest_demand(df: DataFrame, by: Sequence[str] = (), ts: str = "ts", power: str = "power_w") -> DataFrame:
    """Last known synthetic demand, 0 when it is missing, no number, or negative."""
    last = F.max_by(F.col(power).cast("string"), F.col(ts))
    value = last.try_cast("double")
    return df.groupBy(*by).agg(
        F.greatest(F.coalesce(value, F.lit(0.0)), F.lit(0.0)).alias(power)
    )


def allocate(
    consumption: DataFrame,
    production: DataFrame,
    pairing: DataFrame | None = None,
    value: str = "value",
) -> DataFrame:
    """Production of each group under its consumption, by the closed form of the linear programme.

    The goal is the largest sum of ``p`` with ``p <= consumption`` and ``p <= production`` where a
    group is active and ``p = 0`` where it is not; the cap on the sum follows from the caps of the
    groups. So ``p`` is the smaller of the two where both are positive, else 0 and not active. A
    negative consumption leaves no solution. Both inputs hold ``site_id`` and the latest value;
    ``pairing`` (``site_id``, ``consumption_id``) pairs groups of unlike number.
    """
    prod = production.select("site_id", F.col(value).alias("prod"), F.lit(True).alias("_made"))
    if pairing is None:
        pairs = prod.select("site_id", F.col("site_id").alias("consumption_id"))
    else:
        pairs = pairing.select("site_id", "consumption_id")
    cons = consumption.select(
        F.col("site_id").alias("consumption_id"), F.col(value).alias("cons")
    )
    both = pairs.join(prod.drop("_made"), "site_id", "left").join(cons, "consumption_id", "left")
    missing = F.col("cons").isNull() | F.col("prod").isNull()
    solved = ~missing & (F.col("cons") >= 0)
    p = F.when(
        solved,
        F.when((F.col("cons") > 0) & (F.col("prod") > 0), F.least("cons", "prod")).otherwise(0.0),
    )
    status = (
        F.when(missing, "missing_input").when(F.col("cons") < 0, "infeasible").otherwise("success")
    )
    return both.select(
        "site_id", "consumption_id", "cons", "prod",
        p.alias("p"), (p > 0).alias("active"), status.alias("status"),
    )


def allocation_report(allocated: DataFrame, members: DataFrame | None = None) -> DataFrame:
    """One row per group: optimised total, active and disabled counts and the disabled members.

    ``members`` (``site_id``, ``pos``, ``site_key``) names the members; the one forecast of a group
    stands for its first member.
    """
    active = F.col("active").cast("int")
    report = allocated.select(
        "site_id", "status",
        F.col("p").alias("total_production_optimized"),
        active.alias("n_sites_active"), (1 - active).alias("n_sites_disabled"),
        F.col("p").alias("objective_value"),
    )
    if members is None:
        return report
    first = members.groupBy("site_id").agg(F.min_by("site_key", "pos").alias("_key"))
    names = F.when(F.col("n_sites_disabled") == 1, F.array_compact(F.array("_key"))).otherwise(
        F.array().cast("array<string>")
    )
    return report.join(first, "site_id", "left").withColumn("disabled_sites", names).drop("_key")


def allocation_totals(report: DataFrame) -> DataFrame:
    """Totals over all groups of a report."""
    return report.agg(
        F.coalesce(F.sum("total_production_optimized"), F.lit(0.0)).alias("total_production_optimized"),
        F.coalesce(F.sum("n_sites_active"), F.lit(0)).alias("n_sites_active"),
        F.coalesce(F.sum("n_sites_disabled"), F.lit(0)).alias("n_sites_disabled"),
        F.count_if(F.col("status") != "success").alias("n_errors"),
    )


def best_subset(values: list[int], cap: int) -> tuple[int | None, list[int]]:
    """Largest subset sum of whole numbers not above ``cap`` and its places.

    Of subsets with that sum the one whose places, read as bits, are the smallest number. The sums that
    the first i values reach are the bits of one long integer, so the work grows with values times
    range and never with the number of subsets.
    """
    # Negative values make room; bit b stands for the sum b - low.
    low = -sum(v for v in values if v < 0)
    room = cap + low
    if room < 0:
        return None, []
    most = (1 << (min(room, sum(v for v in values if v > 0) + low) + low + 1)) - 1
    reached = [1 << low]
    for v in values:
        bits = reached[-1]
        reached.append((bits | (bits << v if v >= 0 else bits >> -v)) & most)
    allowed = reached[-1] & ((1 << (room + 1)) - 1)
    if not allowed:
        return None, []
    at = allowed.bit_length() - 1
    best, pick = at - low, []
    for i in range(len(values) - 1, -1, -1):
        if not reached[i] >> at & 1:  # not without this value
            pick.append(i)
            at -= values[i]
    return best, pick[::-1]


def shed(
    production: DataFrame,
    caps: DataFrame,
    on: Sequence[str] = ("ts",),
    site: str = "site_id",
    p: str = "p",
    cap: str = "cap",
    resolution: float = 0.01,
) -> DataFrame:
    """Sites to keep so that their production is as large as possible and not above the cap.

    One row per group with ``kept``, ``shed`` (arrays of sites), ``kept_sum`` and ``violation``
    (all sites together are above the cap). Production and cap count in whole steps of
    ``resolution``. Of choices with the same sum the first in binary order is taken, the site with the
    smallest key being the lowest bit; the rule is the same for any number of sites.
    """
    on = list(on)
    rows = production.groupBy(*on).agg(
        F.sort_array(F.collect_list(F.struct(F.col(site).alias("site"), F.col(p).alias("p")))).alias("_all")
    )
    both = caps.select(*on, F.col(cap).alias("cap")).join(rows, on)

    @F.pandas_udf("array<boolean>")
    def search(all_values: pd.Series, limits: pd.Series) -> pd.Series:
        keeps = []
        for values, limit in zip(all_values, limits):
            steps = [round(v / resolution) for v in values]
            best, pick = best_subset(steps, math.floor(limit / resolution + 1e-6))
            picked = set(pick)
            keeps.append(None if best is None else [i in picked for i in range(len(steps))])
        return pd.Series(keeps)

    values = F.transform("_all", lambda s: s["p"].cast("double"))
    chosen = both.withColumn("_keep", search(values, F.col("cap").cast("double")))
    # With no subset under the cap nothing is kept.
    keep = F.coalesce("_keep", F.transform("_all", lambda s: F.lit(False)))
    marked = F.arrays_zip(F.col("_all").alias("s"), keep.alias("k"))
    add = lambda items: F.aggregate(
        F.transform(items, lambda s: s["p"].cast("double")), F.lit(0.0), lambda a, v: a + v)
    kept = F.transform(F.filter("_marked", lambda m: m["k"]), lambda m: m["s"])
    return chosen.withColumn("_marked", marked).select(
        *on, "cap", add("_all").alias("total"),
        F.transform(kept, lambda s: s["site"]).alias("kept"),
        F.transform(F.filter("_marked", lambda m: ~m["k"]), lambda m: m["s"]["site"]).alias("shed"),
        F.when(F.col("_keep").isNotNull(), add(kept)).alias("kept_sum"),
        (add("_all") > F.col("cap")).alias("violation"),
    )
