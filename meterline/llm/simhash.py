"""Near-duplicates by SimHash fingerprints, found with pigeonhole blocks."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterline.llm.components import components
from meterline.llm.shared import in_batches, numbered, own, sized
from meterline.session import stored

BITS = 64
#: Hashes summed at once, so that a text of any length needs bounded memory.
_STRETCH = 65_536


def fingerprint_of(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """The fingerprint of one text: a bit is 1 if set in over half of the hashes of its shingles.

    A-Z are lower-cased; words are what blanks, tabs and line ends separate. Repeated shingles
    count as often as they occur. Fewer words than a shingle has are one shingle, none give zero.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate([[0], ends[:-1]])
    n = max(1, len(words) - shingle + 1)
    last = ends[min(shingle, len(words)) - 1:] - 1
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(BITS, np.int64)
    for at in range(0, n, _STRETCH):
        spans = zip(starts[at:min(at + _STRETCH, n)].tolist(), last[at:at + _STRETCH].tolist(), strict=True)
        hashes = np.array([digest(joined[a:b], seed) for a, b in spans], "<u8")
        ones += np.unpackbits(hashes.view("u1").reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def with_fingerprints(
    docs: DataFrame, text: str = "text", name: str = "fingerprint", keep: list[str] | None = None,
    shingle: int = 3, seed: int = 42,
) -> DataFrame:
    """The columns ``keep`` (all by default) with the fingerprint as a long, bit for bit."""
    keep = [c for c in (docs.columns if keep is None else keep) if c != name]
    source = own("text")
    rows = docs.select(*keep, F.col(text).alias(source))
    schema = T.StructType([*docs.select(*keep).schema.fields, T.StructField(name, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array(
                [fingerprint_of(t.as_py(), shingle, seed) for t in batch.column(len(keep))], "u8").view("i8")
            yield pa.RecordBatch.from_arrays([*batch.columns[:len(keep)], pa.array(prints)], names=[*keep, name])

    return in_batches(rows, run, schema)


def block_keys(fingerprint: Column, distance: int, spare: int) -> list[Column]:
    """One key per choice of ``spare`` blocks out of ``distance + spare``.

    Fingerprints with at most ``distance`` different bits differ in at most as many blocks, so they
    agree in all blocks of at least one choice.
    """
    blocks = distance + spare
    edges = [BITS * i // blocks for i in range(blocks + 1)]
    keys = []
    for chosen in combinations(range(blocks), spare):
        mask = sum(((1 << (edges[i + 1] - edges[i])) - 1) << edges[i] for i in chosen)
        signed = mask - (1 << BITS) if mask >> (BITS - 1) else mask
        keys.append(fingerprint.bitwiseAND(F.lit(signed)))
    return keys


def close_pairs(prints: DataFrame, distance: int = 3, spare: int = 3) -> DataFrame:
    """``a, b`` with a < b: all pairs of the distinct longs ``fingerprint`` at ``distance`` bits or fewer.

    Each fingerprint goes to one block per choice; a block joins with itself, and only verified
    pairs leave the join. ``spare`` blocks have to agree: with 3 of 6 a key has 31 to 33 bits, so that
    chance meetings stay rare for thousands of millions of fingerprints. A pair that meets in several
    blocks leaves the first of them only.
    """
    keys = block_keys(F.col("fingerprint"), distance, spare)
    keyed = prints.select("fingerprint", F.posexplode(F.array(*keys)).alias("choice", "key"))
    left, right = keyed.alias("l"), keyed.alias("r")
    differ = F.col("l.fingerprint").bitwiseXOR(F.col("r.fingerprint"))
    first = F.coalesce(*[
        F.when(k == 0, F.lit(i)) for i, k in enumerate(block_keys(differ, distance, spare))], F.lit(-1))
    return left.join(
        right,
        (F.col("l.choice") == F.col("r.choice")) & (F.col("l.key") == F.col("r.key"))
        & (F.col("l.fingerprint") < F.col("r.fingerprint")) & (F.bit_count(differ) <= distance)
        & (first == F.col("l.choice")),
    ).select(F.col("l.fingerprint").alias("a"), F.col("r.fingerprint").alias("b"))


def fingerprint_links(prints: DataFrame, distance: int = 3, spare: int = 3) -> DataFrame:
    """``a, b``: links that join the rows (longs ``node, fingerprint``) as ``near_duplicates`` does.

    The rows of a fingerprint hang on the first of them; the first rows of fingerprints at
    ``distance`` bits or fewer are linked with each other.
    """
    heads = stored(prints.groupBy("fingerprint").agg(F.min("node").alias("head")), "heads")
    close = stored(close_pairs(heads.select("fingerprint"), distance, spare), "close")
    first = heads.select(F.col("fingerprint").alias("a"), F.col("head").alias("head_a"))
    second = heads.select(F.col("fingerprint").alias("b"), F.col("head").alias("head_b"))
    between = close.join(first, "a").join(second, "b").select(F.col("head_a").alias("a"), F.col("head_b").alias("b"))
    copies = prints.join(heads, "fingerprint").where("node <> head").select(F.col("head").alias("a"), F.col("node").alias("b"))
    return between.unionByName(copies)


def near_duplicates(
    docs: DataFrame, key: str = "doc_id", text: str = "text", carry: list[str] | None = None,
    distance: int = 3, spare: int = 3, shingle: int = 3, seed: int = 42,
) -> DataFrame:
    """The columns ``carry`` (all by default) with ``fingerprint, component_id, kept``.

    ``fingerprint`` has 16 lowercase hex digits. Rows with one fingerprint, and fingerprints at
    ``distance`` bits or fewer, are linked; ``component_id`` is the smallest key reachable, missing
    keys being passed over (null if there is no other). One row of each component is ``kept``:
    one with that key, the first in the stored table if it repeats.

    Rows are first reduced to distinct fingerprints, so that copies of any number cost no pairs.
    Texts that are missing or without words have fingerprint zero, linked like any other. A table
    without rows gives none; columns named like the results are replaced.
    """
    carry = [c for c in (docs.columns if carry is None else carry)
             if c not in ("fingerprint", "component_id", "kept")]
    number, bits = own("row"), own("bits")
    keyed = own("key")
    rows = numbered(
        with_fingerprints(docs.withColumn(keyed, F.col(key)), text, bits, [*carry, keyed], shingle, seed),
        number, "fingerprints")
    # Missing keys order behind all others.
    order = F.struct(F.col(keyed).isNull().alias("missing"), F.col(keyed).alias("key"), F.col(number).alias("row"))
    classes = stored(rows.groupBy(F.col(bits).alias("fingerprint")).agg(F.min(order).alias("best")), "classes")
    pairs = stored(close_pairs(classes.select("fingerprint"), distance, spare), "links")
    n = 2 * pairs.count()
    roots = stored(sized(components(pairs), n), "roots")
    linked = stored(sized(
        roots.join(classes, roots["node"] == classes["fingerprint"]).select("fingerprint", "root", "best"), n), "linked")
    least = stored(sized(linked.groupBy("root").agg(F.min("best").alias("least")), n), "least")
    reached = linked.join(least, "root").select(F.col("fingerprint").alias("node"), "least")
    best = F.coalesce("least", "best")
    found = stored(
        classes.join(reached, classes["fingerprint"] == reached["node"], "left").select(
            F.col("fingerprint").alias(bits), best["key"].alias("component_id"), best["row"].alias("kept_row")), "members")
    # Left, so that every row stays whatever its group; Spark may split the rows of a frequent fingerprint.
    return rows.join(found, bits, "left").select(
        *carry, F.lpad(F.lower(F.hex(bits)), 16, "0").alias("fingerprint"), "component_id",
        (F.col(number) == F.col("kept_row")).alias("kept"))
