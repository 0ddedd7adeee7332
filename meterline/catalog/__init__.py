"""Registered queries over the driver tables, each with its SQL counterpart where there is one."""

from meterline.catalog import (  # noqa: F401
    ingest, regular, features, accuracy, selection, decide, models, live, sinks,
)
from meterline.catalog.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
