"""Exact deduplication by progressive refinement: length, then prefix hash, then hash of the whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterline.llm.shared import bounded_broadcast, numbered, own, whole
from meterline.session import stored


def exact_duplicates(
    docs: DataFrame, key: str = "doc_id", text: str = "text", carry: list[str] | None = None,
    normalise=lambda t: t, prefix: int = 256, digest_all: bool = False, broadcast_rows: int = 2_000_000,
) -> DataFrame:
    """The columns ``carry`` (all by default) of every row, with ``keep_id, group_size, kept, text_sha256``.

    Texts are equal if identical after ``normalise``; missing ones count as empty. Of equal texts
    the row with the largest key stays, a missing key being smaller than any; of rows equal in key
    and text exactly one stays. A table without rows gives none. Columns of ``docs`` named like the
    four results are replaced.

    Three steps narrow the rows down: byte lengths that occur twice, then lengths and hashes of the
    first ``prefix`` characters that do, then SHA-256 of the whole text of the rows left. Rows that
    drop out of a step never reach a shuffle; ``text_sha256`` is null for them unless ``digest_all``
    asks for it. The keys a step leaves have a few bytes each; up to ``broadcast_rows`` of them,
    counted first, are broadcast to the scan, beyond that Spark joins by shuffling. Groups
    are summed with map-side combine and joined back, so that a group of any size may be split.
    """
    carry = list(docs.columns if carry is None else carry)
    carry = [c for c in carry if c not in ("keep_id", "group_size", "kept", "text_sha256")]
    size, head, full, number = own("size"), own("head"), own("full"), own("row")
    cleaned: Column = normalise(whole(text))

    sized = docs.withColumn(size, F.octet_length(cleaned))
    sizes = stored(sized.groupBy(size).count().where("count > 1").select(size), "lengths")
    sizes = bounded_broadcast(sizes, sizes.count(), broadcast_rows)

    headed = sized.join(sizes, size, "left_semi").withColumn(head, F.xxhash64(F.substring(cleaned, 1, prefix)))
    heads = stored(
        headed.groupBy(size, head).count().where("count > 1").select(size, head), "prefixes")
    heads = bounded_broadcast(heads, heads.count(), broadcast_rows)

    headed = sized.withColumn(head, F.xxhash64(F.substring(cleaned, 1, prefix)))
    digest = F.sha2(cleaned, 256)
    alone = headed.join(heads, [size, head], "left_anti").select(
        *carry, F.col(key).alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"),
        (digest if digest_all else F.lit(None).cast("string")).alias("text_sha256"))

    keyed = list(dict.fromkeys([*carry, key]))
    left = numbered(
        headed.join(heads, [size, head], "left_semi").select(*keyed, size, digest.alias(full)), number, "survivors")
    best = stored(left.groupBy(size, full).agg(
        F.count("*").alias("group_size"),
        F.max(F.struct(F.col(key).alias("key"), F.col(number).alias("row"))).alias("best")), "groups")
    grouped = left.join(best, [size, full]).select(
        *carry, F.col("best.key").alias("keep_id"), "group_size",
        (F.col(number) == F.col("best.row")).alias("kept"), F.col(full).alias("text_sha256"))
    return alone.unionByName(grouped)
