"""Links of web pages, and the link of each yearly profile."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

# Pattern of a link, of a tag, of a run of blanks.
LINK = r'(?is)<a[^>]+href="([^"]+)"[^>]*>(.*?)</a>'
TAG = r"<[^>]+>"
BLANKS = r"[\t-\r\x1c-\x1f\x85\p{Z}]+"


def extract_links(pages: DataFrame, base: str, html: str = "html", key: Sequence[str] = ("page_id",)) -> DataFrame:
    """Links of each page in page order: ``pos``, ``label``, ``url``.

    Tags in a label are dropped and blanks collapsed; a link without a label is left out; a url that
    does not start with http gets ``base`` in front.
    """
    page = F.col(html)
    href = F.regexp_extract_all(page, F.lit(LINK), F.lit(1))
    text = F.regexp_extract_all(page, F.lit(LINK), F.lit(2))
    links = pages.select(
        *key, F.posexplode(F.arrays_zip(href.alias("href"), text.alias("text"))).alias("pos", "link")
    )
    label = F.trim(F.regexp_replace(F.regexp_replace("link.text", TAG, ""), BLANKS, " "))
    href_col = F.col("link.href")
    url = F.when(href_col.startswith("http"), href_col).otherwise(F.concat(F.lit(base), href_col))
    return links.select(*key, "pos", label.alias("label"), url.alias("url")).where("label != ''")


def _all_of(text: Column, words: Sequence[str]) -> Column:
    ok = F.lit(True)
    for w in words:
        ok = ok & text.contains(w)
    return ok


def _any_of(text: Column, words: Sequence[str]) -> Column:
    hit = F.lit(False)
    for w in words:
        hit = hit | text.contains(w)
    return hit


def links_per_year(
    links: DataFrame,
    start_year: int,
    end_year: int,
    fixed: Mapping[int, str] | None = None,
    must: Sequence[str] = ("rlp",),
    some: Sequence[str] = ("elec",),
    never: Sequence[str] = ("gas", "parameter"),
    order: Sequence[str] = ("page_id", "pos"),
) -> DataFrame:
    """First link of each year: its text and url name the year as a number of its own and all
    ``must`` words, one of the ``some`` words, none of the ``never`` words. Fixed links win.

    The years are read out of the text, so no link is compared with every year.
    """
    raw = F.lower(F.concat_ws(" ", "label", "url"))
    # Text that is no valid escape sequence stays as it is.
    text = F.coalesce(F.try_url_decode(F.replace(raw, F.lit("+"), F.lit("%2B"))), raw)
    fitting = links.withColumn("_text", text).where(
        _all_of(F.col("_text"), must) & _any_of(F.col("_text"), some) & ~_any_of(F.col("_text"), never)
    )
    years = F.array_distinct(F.regexp_extract_all("_text", F.lit(r"(\d+)"), F.lit(1)))
    found = (
        fitting.select("url", *order, F.explode(years).alias("_year"))
        .withColumn("year", F.col("_year").try_cast("int"))
        .where(F.col("year").between(start_year, end_year))
        .where(F.col("_year") == F.col("year").cast("string"))
        .groupBy("year")
        .agg(F.min_by("url", F.struct(*order)).alias("url"))
    )
    pinned = [(y, u) for y, u in (fixed or {}).items() if start_year <= y <= end_year]
    if not pinned:
        return found
    pins = links.sparkSession.createDataFrame(pinned, "year int, fixed string")
    return found.join(pins, "year", "full").select("year", F.coalesce("fixed", "url").alias("url"))
