"""Site names, site keys and raw file names."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, functions as F

# Archive years that may follow the table name in a raw file name.
ARCHIVE_YEARS = [str(y) for y in range(2010, 2022)]


def normal_site(name: Column) -> Column:
    """``.``, ``-`` and ``~`` become ``_``; ``+`` goes."""
    return F.translate(name, ".-~+", "___")


def site_key(name: Column, sn: Column, production: Column, prefix: str = "site") -> Column:
    kind = F.when(production, F.lit("production")).otherwise(F.lit("consumption"))
    return F.concat(
        F.lit(f"/{prefix}_"), normal_site(name), F.lit("_"), sn.cast("string"), F.lit("/"), kind
    )


def parse_site_key(key: Column, prefix: str = "site") -> Column:
    """Struct ``(site, sn)`` of a site key; the serial is what follows the last ``_``."""
    pattern = rf"^/*(?:{prefix}_)?([^/]*)_([^_/]*)(?:/.*)?$"
    return F.struct(
        normal_site(F.regexp_extract(key, pattern, 1)).alias("site"),
        F.regexp_extract(key, pattern, 2).alias("sn"),
    )


def parse_file_name(
    file_name: Column, always_production: Iterable[tuple[str, str]] = ()
) -> Column:
    """Struct ``(site, sn, production)`` of a raw file name ``<table>[_<year>]_<site>[_C|_P]_<sn>.csv``.

    A ``-`` left in the site name means production; ``always_production`` lists (site, serial)
    pairs that are production whatever their name says.
    """
    parts = F.filter(F.split(file_name, "_"), lambda p: p != "")
    last = F.element_at(parts, -1)
    sn = F.left(last, F.greatest(F.length(last) - 4, F.lit(0)))
    skip = F.when(F.get(parts, F.lit(1)).isin(ARCHIVE_YEARS), 2).otherwise(1)
    middle = F.slice(parts, skip + 1, F.greatest(F.size(parts) - skip - 1, F.lit(0)))
    kind = F.when(F.size(middle) > 0, F.element_at(middle, -1))
    marked = F.coalesce(kind.isin("C", "P"), F.lit(False))
    words = F.slice(middle, F.lit(1), F.size(middle) - marked.cast("int"))
    raw = F.array_join(words, "_")
    site = F.translate(raw, "-+", "")
    forced = F.lit(False)
    for forced_site, forced_sn in always_production:
        forced = forced | ((site == forced_site) & (sn == forced_sn))
    production = (marked & (kind == "P")) | raw.contains("-") | forced
    return F.struct(
        site.alias("site"), sn.alias("sn"), F.coalesce(production, F.lit(False)).alias("production")
    )
