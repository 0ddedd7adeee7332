"""Helpers the operators of this subpackage share."""

from __future__ import annotations

import os
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meterline.session import stored

#: White space that separates words: blank, tab, line feed, vertical tab, form feed, return.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole(text: Column | str) -> Column:
    """The text, a missing one being empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def own(name: str) -> str:
    """A column name that no column of a caller's table has."""
    return f"__{name}_{uuid.uuid4().hex[:8]}"


def findable(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver did, if it isn't installed for them."""
    root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *paths])


def in_batches(rows: DataFrame, run, schema) -> DataFrame:
    """``mapInArrow`` whose workers find this package."""
    findable(rows.sparkSession)
    return rows.mapInArrow(run, schema)


def numbered(df: DataFrame, number: str, name: str) -> DataFrame:
    """The rows with a number each, written to the shared folder, so that the numbers stay as they are.

    The numbers tell rows apart that are equal in every column; after a lost executor they are read
    again and not made anew.
    """
    return stored(df.withColumn(number, F.monotonically_increasing_id()), name)


def bounded_broadcast(df: DataFrame, rows: int, most: int) -> DataFrame:
    """Mark for broadcast if ``rows``, counted before, is at most ``most``; else leave it to the planner."""
    return F.broadcast(df) if rows <= most else df


def sized(df: DataFrame, rows: int, each: int = 250_000) -> DataFrame:
    """The rows in as many partitions as ``rows``, counted before, ask for, so that small tables cost few tasks."""
    return df.coalesce(max(1, -(-rows // each)))
