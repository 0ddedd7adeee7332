"""Session set-up and the shared folder used to cut lineage."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

STEP_SECONDS = 900
STEPS_PER_DAY = 96
KEY = ("etype", "site_id")


def build_session(app: str = "meterline", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    }
    settings.update(conf)
    for name, value in settings.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


def use_utc(spark: SparkSession) -> SparkSession:
    """Naive stamps of the inputs are read as UTC everywhere."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach.

    It is the one the cluster names in ``spark.checkpoint.dir``. Only a local master may go
    without: there driver and executors are one process, so a fresh temporary folder is shared.
    """
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir", None) or spark.conf.get(
        "spark.checkpoint.dir", None
    )
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="meterline-")
        spark.conf.set("spark.checkpoint.dir", folder)
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path of its own under the shared folder, for a table one run writes and reads back."""
    return os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")


def checkpointed(df: DataFrame) -> DataFrame:
    """Write the rows to the shared folder and go on from there."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Paths that the open ``passing_tables`` blocks have to delete.
_PASSING: list[list[str]] = []


@contextmanager
def passing_tables(spark: SparkSession) -> Iterator[None]:
    """Tables that ``stored`` writes inside the block are deleted at its end, but for those it is told to keep."""
    paths: list[str] = []
    _PASSING.append(paths)
    try:
        yield
    finally:
        _PASSING.remove(paths)
        jvm = spark._jvm
        for path in paths:
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def stored(df: DataFrame, name: str = "table", keep: bool = False) -> DataFrame:
    """Write the rows once as a table in the shared folder and read them back from there.

    For a reduced result that several later steps read, so that the raw rows behind it are scanned
    once; a lost executor costs a read and no recomputation. ``keep`` takes the table out of ``passing_tables``.
    """
    path = scratch_path(df.sparkSession, name)
    if _PASSING and not keep:
        _PASSING[-1].append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
