"""Near-duplicate embeddings by products of int8 tiles with error bounds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterline.llm.components import components
from meterline.llm.shared import in_batches, numbered, own
from meterline.session import stored

#: Room for rounding in products of doubles.
_SLACK = 1e-9
_PREPARED = "dims int, proj double, codes binary, scale double, error double, exact binary"
_EDGES = "row bigint, links bigint, root bigint"


def quantise(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes, scale and error of each unit vector: |unit - scale * codes| <= error."""
    scale = np.abs(unit).max(axis=1, keepdims=True) / 127
    codes = np.rint(unit / scale).astype(np.int8)
    error = np.linalg.norm(unit - codes * scale, axis=1) + _SLACK
    return codes, scale[:, 0], error


def _direction(dims: int) -> np.ndarray:
    u = np.random.default_rng(dims).standard_normal(dims)
    return u / np.linalg.norm(u)


def prepare(vectors: Iterator[pa.RecordBatch], at: int) -> Iterator[pa.RecordBatch]:
    """Append codes, error and projection; all are null for a vector that can link with nothing."""
    names = ["dims", "proj", "codes", "scale", "error", "exact"]
    kinds = [pa.int32(), pa.float64(), pa.binary(), pa.float64(), pa.float64(), pa.binary()]
    for batch in vectors:
        rows: list[tuple] = []
        for value in batch.column(at):
            v = np.array([np.nan if x is None else x for x in value.as_py() or ()], np.float64)
            if not len(v) or not np.isfinite(v).all() or not v.any():
                rows.append((None,) * 6)
                continue
            # Scaled by the largest component first, so that no square runs over or under.
            unit = v / np.abs(v).max()
            unit /= np.linalg.norm(unit)
            codes, scale, error = quantise(unit[None])
            rows.append((len(v), float(unit @ _direction(len(v))), codes.tobytes(), scale[0], error[0], unit.tobytes()))
        columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], k) for k in kinds]
        yield pa.RecordBatch.from_arrays(
            [*(c for i, c in enumerate(batch.columns) if i != at), *columns],
            names=[*(n for i, n in enumerate(batch.schema.names) if i != at), *names])


def links_between(a: pd.DataFrame, b: pd.DataFrame | None, least: float, block: int = 512) -> pd.DataFrame:
    """``row, links, root``: per row with a link, how many there are, and the smallest row its links reach here.

    ``b`` missing: links within ``a``. Codes are multiplied; with errors e and f the product of two unit
    vectors is off by at most f + e * (1 + f), so that pairs below ``least`` by more than this can't
    link. Only the rest is multiplied in doubles.
    """
    dims = int(a["dims"].iloc[0])
    exactly = np.float32 if 127 * 127 * dims < 1 << 24 else np.float64  # integers that stay exact

    def parts(x: pd.DataFrame) -> tuple:
        codes = np.frombuffer(b"".join(x["codes"]), np.int8).reshape(-1, dims).astype(exactly)
        unit = np.frombuffer(b"".join(x["exact"]), np.float64).reshape(-1, dims)
        return x["row"].to_numpy(), codes, x["scale"].to_numpy(), x["error"].to_numpy(), unit

    left = parts(a)
    right = left if b is None else parts(b)
    rows = left[0] if b is None else np.concatenate([left[0], right[0]])
    shift = 0 if b is None else len(left[0])
    links, parent = np.zeros(len(rows), np.int64), np.arange(len(rows))

    def top(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i in range(0, len(left[0]), block):
        for j in range(i if b is None else 0, len(right[0]), block):
            p, q = slice(i, i + block), slice(j, j + block)
            near = (left[1][p] @ right[1][q].T).astype(np.float64) * left[2][p][:, None] * right[2][q][None]
            e, f = left[3][p][:, None], right[3][q][None]
            maybe = near + f + e * (1 + f) >= least - _SLACK
            if b is None and i == j:
                maybe = np.triu(maybe, 1)
            x, y = np.nonzero(maybe)
            for s in range(0, len(x), 65_536):  # bounded memory where all of a tile is alike
                xs, ys = x[s:s + 65_536] + i, y[s:s + 65_536] + j
                real = np.einsum("ij,ij->i", left[4][xs], right[4][ys]) >= least
                xs, ys = xs[real], ys[real] + shift
                links += np.bincount(xs, minlength=len(rows)) + np.bincount(ys, minlength=len(rows))
                for u, v in zip(xs.tolist(), ys.tolist(), strict=True):
                    u, v = top(u), top(v)
                    if u != v:
                        parent[max(u, v)] = min(u, v)
    linked = np.flatnonzero(links)
    roots = np.array([top(i) for i in linked.tolist()], np.int64)
    return pd.DataFrame({"row": rows[linked], "links": links[linked], "root": rows[roots]})


def near_duplicates(
    vectors: DataFrame, key: str = "vec_id", embedding: str = "embedding", group: str = "label",
    least: float = 0.98, tile: int = 1024, slices: int = 1024,
) -> DataFrame:
    """``key, n_links, component_id, kept`` for every row: links are cosines of ``least`` or more within a group.

    ``component_id`` is the smallest key that links reach, the row's own included, ``kept`` tells whether it is the row's.
    Rows whose group is missing, and vectors that are missing, empty, zero or hold a missing or non-finite component, link with
    nothing; vectors of different lengths never link. Rows that repeat are vectors of their own and link
    with each other; a missing key reaches as any other but is never the smallest unless alone. A table
    without rows gives none.

    Vectors of a group are cut along a projection into tiles of about ``tile`` rows, dense slices into several tiles. Tiles
    further apart than two linked vectors can be are not compared; of the others each pair is one
    unit of work, whatever the group's size. A pair of tiles gives counts and a spanning forest,
    one row per vector at most, never a list of all pairs.
    """
    number, kept = own("row"), own("key")
    rows = vectors.select(F.col(key).alias(kept), F.col(group).alias("label"), F.col(embedding).alias("v"))
    schema = T.StructType([*rows.select(kept, "label").schema.fields, *T._parse_datatype_string(_PREPARED).fields])
    prepared = numbered(in_batches(rows, lambda it: prepare(it, 2), schema), number, "vectors")
    usable = prepared.where("label is not null and codes is not null")

    width = 2.0 / slices
    slice_of = F.floor((F.col("proj") + 1) / width)
    counts = usable.groupBy("label", "dims", slice_of.alias("slice")).agg(F.count("*").alias("n"))
    upto = Window.partitionBy("label", "dims").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    counts = stored(counts.withColumn("run", F.floor(F.coalesce(F.sum("n").over(upto), F.lit(0)) / tile)).withColumn(
        "parts", F.ceil(F.sum("n").over(Window.partitionBy("label", "dims", "run")) / tile)), "slices")
    homes = counts.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).groupBy(
        "label", "dims", "run", "part").agg(
        (F.min("slice") * width - 1).alias("low"), ((F.max("slice") + 1) * width - 1).alias("high"))
    # Tiles are named by place, so that two never share a name.
    name = F.struct("run", "part")
    reach = float(np.sqrt(max(0.0, 2 - 2 * least))) + 1e-6
    a, b = homes.select("label", "dims", name.alias("a"), "low", "high").alias("a"), homes.select(
        "label", "dims", name.alias("b"), "low", "high").alias("b")
    pairs = stored(a.join(b, [F.col("a.label") == F.col("b.label"), F.col("a.dims") == F.col("b.dims"), F.col("a.a") <= F.col("b.b"),
                              F.col("b.low") - F.col("a.high") <= reach, F.col("a.low") - F.col("b.high") <= reach])
                   .select("a.label", "a.dims", "a.a", "b.b"), "tile-pairs")
    placed = usable.withColumn("slice", slice_of).join(
        counts.select("label", "dims", "slice", "run", "parts"), ["label", "dims", "slice"])
    placed = placed.select(
        F.col(number).alias("row"), "label", "dims", "codes", "scale", "error", "exact",
        F.struct("run", F.pmod(F.xxhash64(number), "parts").alias("part")).alias("tile"))
    placed = stored(placed, "placed")
    sides = [
        placed.join(
            pairs.where(where).select("label", "dims", F.col(side).alias("tile"), F.struct("a", "b").alias("pair")),
            ["label", "dims", "tile"],
        ).select("label", "dims", "pair", F.lit(side).alias("side"), "row", "codes", "scale", "error", "exact")
        for side, where in (("a", "true"), ("b", "a <> b"))]

    def work(both: pd.DataFrame) -> pd.DataFrame:
        left, right = both[both["side"] == "a"], both[both["side"] == "b"]
        return links_between(left, right if len(right) else None, least)

    found = stored(sides[0].unionByName(sides[1]).groupBy("label", "dims", "pair").applyInPandas(work, _EDGES), "links")
    roots = stored(components(found.where("row <> root").select(F.col("row").alias("a"), F.col("root").alias("b"))), "roots")
    links = found.groupBy("row").agg(F.sum("links").alias("n_links"))
    named = prepared.select(F.col(number).alias("row"), F.col(kept).alias("key"))
    linked = stored(named.join(roots, F.col("row") == F.col("node")).join(links, "row").select("row", "key", "root", "n_links"), "linked")
    least_key = stored(linked.groupBy("root").agg(F.min("key").alias("component_id")), "least")
    alone = named.join(linked.select("row"), "row", "left_anti").select(
        "key", F.lit(0).cast("long").alias("n_links"), F.col("key").alias("component_id"))
    full = linked.join(least_key, "root").select("key", "n_links", "component_id").unionByName(alone)
    return full.select(F.col("key").alias(key), "n_links", "component_id", F.col("key").eqNullSafe(F.col("component_id")).alias("kept"))
