"""Near copies by SimHash fingerprints, and by the exact similarity of word shingles for those that fingerprints can't reach."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterline.llm.components import components
from meterline.llm.shared import in_batches, numbered, own, sized
from meterline.llm.simhash import BITS, fingerprint_links, with_fingerprints
from meterline.session import passing_tables, stored

#: Shingles multiplied at once, so that a text of any length needs bounded memory.
_STRETCH = 4_096


def shingles_of(text: str | None, words: int = 5, seed: int = 42) -> np.ndarray:
    """The hashes of all runs of ``words`` words, repeated ones too; words and case as in ``simhash.fingerprint_of``.

    Fewer words are one shingle; no words are the one shingle zero, so that such texts are alike.
    """
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.zeros(1, "u8")
    joined = b" ".join(found)
    ends = np.cumsum([len(w) + 1 for w in found])
    starts = np.concatenate([[0], ends[:-1]])
    n = max(1, len(found) - words + 1)
    last = ends[min(words, len(found)) - 1:] - 1
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], seed) for a, b in zip(starts[:n].tolist(), last[:n].tolist(), strict=True)], "u8")


def _masks(distance: int, spare: int) -> np.ndarray:
    """One mask per choice of ``spare`` blocks out of ``distance + spare``, as in ``simhash.block_keys``."""
    blocks = distance + spare
    edges = [BITS * i // blocks for i in range(blocks + 1)]
    return np.array([sum(((1 << (edges[i + 1] - edges[i])) - 1) << edges[i] for i in chosen)
                     for chosen in combinations(range(blocks), spare)], "u8")


class Buckets:
    """The keys under which a text is looked up: its SimHash blocks and its MinHash bands."""

    def __init__(self, bands: int, each: int, distance: int, spare: int, seed: int):
        self.bands, self.each = bands, each
        self.masks = _masks(distance, spare)
        self.factors = np.random.default_rng(seed).integers(0, 1 << 63, bands * each, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def __call__(self, hashes: np.ndarray) -> list[int]:
        ones = np.zeros(BITS, np.int64)
        least = np.full(len(self.factors), np.iinfo("u8").max, "u8")
        for at in range(0, len(hashes), _STRETCH):
            part = hashes[at:at + _STRETCH]
            ones += np.unpackbits(part.astype("<u8").view("u1").reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
            least = np.minimum(least, (part[:, None] * self.factors[None]).min(0))
        bits = np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0]
        rows = [*np.ascontiguousarray(bits & self.masks), *np.ascontiguousarray(least.reshape(self.bands, self.each))]
        return np.array([xxhash.xxh64_intdigest(r.tobytes(), i) for i, r in enumerate(rows)], "u8").view("i8").tolist()


def _mapped(rows: DataFrame, text: str, name: str, of) -> DataFrame:
    """The other columns of ``rows`` with ``name``, an array of longs made of the text."""
    keep = [c for c in rows.columns if c != text]
    schema = T.StructType([*rows.select(*keep).schema.fields, T.StructField(name, T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [of(t.as_py()) for t in batch.column(len(keep))]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:len(keep)], pa.array(made, pa.list_(pa.int64()))], names=[*keep, name])

    return in_batches(rows.select(*keep, text), run, schema)


#: Longs of a sketch: a bit of it is the parity of the shingles whose hash leads there.
SKETCH = 16


def sketched(hashes: np.ndarray) -> np.ndarray:
    """The sketch of a set of shingles, then the set. Two sketches differ in no more bits than their sets differ in shingles."""
    bits = SKETCH * 64
    place = (hashes * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits.bit_length() + 1)
    parity = np.bincount(place.astype(np.int64), minlength=bits) & 1
    return np.concatenate([np.packbits(parity.astype(bool)).view("i8"), hashes.view("i8")])


def _compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs ``a, b`` with their exact Jaccard ``distance``."""
    both = pairs.join(sets.select(F.col("node").alias("b"), F.col("set").alias("set_b")), "b").join(
        sets.select(F.col("node").alias("a"), F.col("set").alias("set_a")), "a")
    shared, total = F.size(F.array_intersect("set_a", "set_b")), F.size("set_a") + F.size("set_b")
    return both.select("a", "b", (1 - shared / (total - shared)).alias("distance"))


def near_copies(
    docs: DataFrame, key: str = "doc_id", text: str = "text", carry: list[str] | None = None, words: int = 5,
    similarity: float = 0.8, bands: int = 24, each: int = 5, distance: int = 3, spare: int = 3, pivots: int = 1, seed: int = 42,
    shingle: int = 3,
) -> DataFrame:
    """The columns ``carry`` (all by default) with ``component_id, kept``.

    Two texts are linked if their SimHash fingerprints over ``shingle``-word shingles differ in ``distance`` bits or fewer, as in
    ``simhash.near_duplicates``: all such pairs, whatever the similarity.

    Fingerprints can't reach all near copies, so two texts are also linked if their sets of ``words``-word shingles have a Jaccard
    similarity of ``similarity`` or more, which is computed exactly for every candidate. Candidates agree in a SimHash block choice (all pairs up to ``distance``
    bits do) or in a band of ``each`` out of ``bands * each`` MinHash values: a pair at the threshold 0.8 does with
    probability 1 - (1 - 0.8^5)^24 = 0.9999. ``component_id`` is the smallest key reachable by links of either kind, and one
    row of each component is ``kept``, as in ``simhash.near_duplicates``.

    The distance 1 - similarity is a metric, so a bucket needs few comparisons. In each of ``pivots`` rounds one row of each open bucket, the
    first by a hash of the round, is compared with all others of the bucket, and components are made of the links so far; a bucket is open while it
    holds several. Then rows of different components in a bucket are compared with each other, but for those that can't be linked: their
    sketches of 1,024 bits differ in more places than the sets may, or their distances to one of the pivots differ by more than the
    distance of a link. Copies of the same set of shingles are one row. So no pair is left out that could join two components. Missing texts are empty; texts without words are alike. A table
    without rows gives none; columns named like the results are replaced.
    """
    spark = docs.sparkSession
    carry = [c for c in (docs.columns if carry is None else carry) if c not in ("component_id", "kept")]
    number, keyed, body = own("row"), own("key"), own("text")
    rows = numbered(docs.select(*carry, F.col(key).alias(keyed), F.col(text).alias(body)), number, "rows")
    texts = rows.select(F.col(number).alias("node"), F.col(body).alias("text"))
    buckets = Buckets(bands, each, distance, spare, seed)
    with passing_tables(spark):
        prints = stored(with_fingerprints(texts, name="fingerprint", keep=["node"], shingle=shingle, seed=seed), "fingerprints")
        close = stored(fingerprint_links(prints, distance, spare), "close")
        members = stored(_mapped(texts, "text", "keys", lambda t: buckets(shingles_of(t, words, seed))), "buckets")
        keyed_rows = members.select("node", F.explode("keys").alias("key"))
        heads = keyed_rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
        together = stored(keyed_rows.join(heads, "key"), "together")
        # Only texts that share a bucket are read again; rows with the same set of shingles are one class.
        asked = together.select("node").distinct()
        made = stored(_mapped(
            texts.join(asked, "node", "left_semi"), "text", "set", lambda t: sketched(np.unique(shingles_of(t, words, seed)))).select(
                "node", F.slice("set", SKETCH + 1, F.size("set")).alias("set"),
                *[F.get("set", F.lit(i)).alias(f"s{i}") for i in range(SKETCH)]), "sets")
        digests = stored(made.select("node", F.sha2(F.concat_ws(",", "set"), 256).alias("digest")), "digests")
        classes = stored(digests.join(digests.groupBy("digest").agg(F.min("node").alias("class")), "digest").select("node", "class"), "classes")
        sets = made.join(classes.where("node = class"), "node", "left_semi")
        together = stored(together.join(classes, "node").select("key", F.col("class").alias("node")).distinct(), "together")
        links = None
        placed = together.withColumns({"root": F.col("node"), "far": F.array().cast("array<double>")})
        for turn in range(pivots):
            counts = placed.groupBy("key").agg(
                F.min("root").alias("low"), F.max("root").alias("high"),
                F.min_by("node", F.struct(F.xxhash64("node", F.lit(turn)), "node")).alias("pivot")).where("low < high").select("key", "pivot")
            opened = stored(placed.join(counts, "key"), "open")
            pairs = opened.where("node <> pivot").select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b")).distinct()
            found = stored(_compared(pairs, sets), "compared")
            fresh = found.where(F.col("distance") <= 1 - similarity).select("a", "b")
            links = stored(fresh if links is None else links.unionByName(fresh).distinct(), "links")
            roots = stored(sized(components(links), 2 * links.count()), "roots")
            known = opened.withColumns({"a": F.least("node", "pivot"), "b": F.greatest("node", "pivot")}).join(found, ["a", "b"], "left")
            placed = stored(known.join(roots.withColumnRenamed("root", "_root"), "node", "left").select(
                "key", "node", F.coalesce("_root", "node").alias("root"),
                F.concat("far", F.array(F.coalesce("distance", F.lit(0.0)))).alias("far")), "placed")
        open_keys = placed.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("key")
        sketches = sets.select("node", F.size("set").alias("n"), *[f"s{i}" for i in range(SKETCH)])
        left = stored(placed.join(open_keys, "key").join(sketches, "node"), "open")
        right = left.select(
            "key", F.col("node").alias("b"), F.col("root").alias("other"), F.col("far").alias("beyond"), F.col("n").alias("m"),
            *[F.col(f"s{i}").alias(f"t{i}") for i in range(SKETCH)])
        # Sets this similar differ in so many shingles at most.
        apart = sum((F.bit_count(F.col(f"s{i}").bitwiseXOR(F.col(f"t{i}"))) for i in range(SKETCH)), F.lit(0))
        alike = apart <= (F.col("n") + F.col("m")) * ((1 - similarity) / (1 + similarity)) + 1e-6
        near = F.forall(F.zip_with("far", "beyond", lambda x, y: F.abs(x - y)), lambda d: d <= 1 - similarity + 1e-9)
        pairs = left.withColumnRenamed("node", "a").join(right, "key").where(
            (F.col("a") < F.col("b")) & (F.col("root") != F.col("other")) & alike & near).select("a", "b").distinct()
        found = stored(_compared(pairs, sets), "compared")
        same = classes.where("node <> class").select(F.col("class").alias("a"), F.col("node").alias("b"))
        links = stored(links.unionByName(found.where(F.col("distance") <= 1 - similarity).select("a", "b")).unionByName(same).unionByName(close), "links")
        n = 2 * links.count()
        roots = stored(sized(components(links), n), "roots", keep=True)

    # Missing keys order behind all others.
    order = F.struct(F.col(keyed).isNull().alias("missing"), F.col(keyed).alias("key"), F.col(number).alias("row"))
    linked = stored(sized(rows.join(roots, rows[number] == roots["node"]).select("node", "root", order.alias("order")), n), "linked")
    least = stored(sized(linked.groupBy("root").agg(F.min("order").alias("least")), n), "least")
    found = linked.join(least, "root").select(F.col("node").alias(number), "least")
    best = F.coalesce("least", order)
    return rows.join(found, number, "left").select(
        *carry, best["key"].alias("component_id"), (F.col(number) == best["row"]).alias("kept"))
