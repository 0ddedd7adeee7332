"""Readings kept in database tables."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

Reader = Callable[[str], DataFrame]


def jdbc_reader(
    spark: SparkSession,
    url: str,
    properties: Mapping[str, str] | None = None,
    predicates: Sequence[str] | None = None,
) -> Reader:
    """A reader of tables or ``(query) alias`` over JDBC. Filters and columns are pushed down;
    ``predicates`` are conditions that each make a partition of the read."""

    def read(name: str) -> DataFrame:
        extra = {"predicates": list(predicates)} if predicates else {}
        return spark.read.jdbc(url, name, properties=dict(properties or {}), **extra)

    return read


# Columns of the kinds of reading tables.
SMART_COLUMNS = ["site", "sn", "dls", "ap"]
READING_COLUMNS = ["site", "sn", "dls", "ap", "q1", "q4"]
INDEX_COLUMNS = ["Site", "SN", "msT6", "DR6", "S00"]


def columns_of(table: str) -> list[str] | None:
    """Columns read from a table, by its kind; ``None`` stands for all."""
    if "std" not in table:
        return INDEX_COLUMNS if table == "cpt6" else None
    if "smart" in table:
        return SMART_COLUMNS
    return None if "pv" in table else READING_COLUMNS


def extract(reader: Reader, tables: Mapping[str, Sequence[str]]) -> DataFrame:
    """All reading tables of all databases, each row with ``database``, ``table`` and the ranks
    ``database_rank`` and ``table_rank`` in the order given, as ``range_scan`` reads them. Columns a
    table lacks are null."""
    parts = []
    for place, (database, names) in enumerate(tables.items()):
        for rank, name in enumerate(names):
            if "std" not in name:
                continue
            rows = reader(f"{database}.{name}")
            wanted = columns_of(name)
            parts.append(
                (rows.select(*wanted) if wanted else rows).withColumns(
                    {
                        "database": F.lit(database), "table": F.lit(name),
                        "database_rank": F.lit(place), "table_rank": F.lit(rank),
                    }
                )
            )
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def range_scan(
    rows: DataFrame,
    start,
    end,
    sites: DataFrame | None = None,
    order: Sequence[str] = (),
) -> DataFrame:
    """Readings with ``start <= dls <= end``, from the first table of each database that has any
    for a meter, one row per meter and stamp.

    Of rows with the same meter and stamp the one of the lowest ``database_rank`` is kept, then by
    the ``order`` columns. Both choices are aggregates that keep one row per group and task.
    """
    start, end = (v if isinstance(v, Column) else F.lit(v) for v in (start, end))
    inside = rows.where(F.col("dls").between(start, end))
    if sites is not None:
        inside = inside.join(sites.select("site", "sn"), ["site", "sn"], "left_semi")
    home = ["site", "sn", "database_rank"]
    first = inside.groupBy(*home).agg(F.min("table_rank").alias("table_rank"))
    found = inside.join(first, [*home, "table_rank"], "left_semi")
    rest = [c for c in rows.columns if c not in ("site", "sn", "dls")]
    pick = F.min_by(F.struct(*rest), F.struct("database_rank", *order))
    return (
        found.groupBy("site", "sn", "dls")
        .agg(pick.alias("_row"))
        .select("site", "sn", F.col("dls").alias("ts"), *[f"_row.{c}" for c in rest])
    )
