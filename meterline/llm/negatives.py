"""Hard negatives by exact integer scores, added up from subset-sum tables of the anchors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterline.llm.shared import in_batches, numbered
from meterline.session import scratch_path

#: Dimensions that share a byte of each bit plane, and a table of all their subset sums.
GROUP = 8
#: Anchors whose tables lie in the processor's cache at once, and candidates looked up against them.
_ANCHORS, _CANDIDATES = 64, 2_048
_LEAST = np.iinfo("i8").min


def integers(rows: pa.ListArray, scale: float = 256.0) -> np.ndarray:
    """Rows of floor(scale * x) as integers, short rows ending in zeros; Python's own where a long might not hold a score."""
    lengths = np.array(rows.value_lengths())
    width = int(lengths.max(initial=0))
    width += -width % GROUP
    found = np.zeros((len(rows), width))
    found[np.arange(width)[None] < lengths[:, None]] = rows.flatten().to_numpy(zero_copy_only=False)
    found = np.floor(found * scale)
    if np.abs(found).max(initial=0) < 1 << 24:
        return found.astype(np.int64)
    return np.array([[int(v) for v in row] for row in found.tolist()], object)


def planes_of(values: np.ndarray) -> np.ndarray:
    """Bit planes of two's complement, the sign first: plane, group of eight dimensions, row; a byte each."""
    n, width = values.shape
    largest = max((int(abs(v)) for v in (values.min(initial=0), values.max(initial=0))), default=0)
    bits = largest.bit_length() + 1
    made = np.empty((bits, width // GROUP, n), "u1")
    for plane in range(bits):
        one = (values >> (bits - 1 - plane) & 1).astype("u1")
        made[plane] = np.packbits(one.reshape(n, -1, GROUP), axis=2, bitorder="little")[:, :, 0].T
    return made


def tables_of(anchors: np.ndarray) -> np.ndarray:
    """For every group of eight dimensions and every byte the sum of the dimensions whose bit is set, a column per anchor."""
    n, width = anchors.shape
    parts = anchors.T.reshape(width // GROUP, GROUP, n)
    made = np.zeros((width // GROUP, 1 << GROUP, n), anchors.dtype)
    for bit in range(GROUP):
        made[:, 1 << bit:2 << bit] = made[:, :1 << bit] + parts[:, bit, None]
    return made


def scores(planes: np.ndarray, tables: np.ndarray, kind: type) -> np.ndarray:
    """Inner products, candidate by anchor: the planes' looked-up sums, shifted and added, the sign's plane taken away."""
    shape = planes.shape[2], tables.shape[2]
    total = np.zeros(shape, kind)
    here, one = np.empty(shape, tables.dtype), np.empty(shape, tables.dtype)
    for at, plane in enumerate(planes):
        here[:] = 0
        for group, table in zip(plane, tables, strict=True):
            np.take(table, group, axis=0, out=one, mode="clip")
            here += one
        total += total
        total += -here if at == 0 else here
    return total


def _kinds(anchors: np.ndarray, bits: int) -> tuple[type, type]:
    """The narrowest integers for subset sums of the anchors, and for scores with ``bits`` bits."""
    if anchors.dtype == object:
        return object, object
    bound = int(np.abs(anchors).sum(1).max(initial=0))
    return (np.int16 if bound < 1 << 15 else np.int32 if bound < 1 << 31 else np.int64,
            np.int32 if bound << bits < 1 << 31 else np.int64 if bound << bits < 1 << 62 else object)


def blocks(anchors: np.ndarray, candidates: np.ndarray) -> Iterator[tuple[slice, slice, np.ndarray]]:
    """Stretches of candidates and anchors with their scores."""
    width = max(anchors.shape[1], candidates.shape[1])
    anchors, candidates = (np.pad(a, ((0, 0), (0, width - a.shape[1]))) for a in (anchors, candidates))
    for low in range(0, len(candidates), _CANDIDATES):
        some = slice(low, min(low + _CANDIDATES, len(candidates)))
        planes = planes_of(candidates[some])
        for at in range(0, len(anchors), _ANCHORS):
            these = slice(at, min(at + _ANCHORS, len(anchors)))
            narrow, kind = _kinds(anchors[these], len(planes))
            yield some, these, scores(planes, tables_of(anchors[these].astype(narrow)), kind)


def _within(bounds: np.ndarray, kind: np.dtype) -> np.ndarray:
    """Bounds in the type of the scores compared with them, those outside it at its end."""
    return bounds if kind == object else np.clip(bounds, np.iinfo(kind).min, np.iinfo(kind).max).astype(kind)


class Best:
    """The first few of each list by falling score, ties by smaller id, a missing id last."""

    def __init__(self, lists: int, each: int):
        self.each = each
        self.score = np.full((lists, each), _LEAST, object)
        self.id = np.zeros((lists, each), object)
        self.full = np.zeros(lists, np.int64)
        self.floor = np.full(lists, -np.inf, object)

    def least(self, lists: np.ndarray, kind: np.dtype) -> np.ndarray:
        """What a score must reach to be of use to each list."""
        return _within(self.floor[lists], kind)

    def offer(self, lists: np.ndarray, score: np.ndarray, ids: np.ndarray, missing: np.ndarray) -> None:
        order = np.lexsort((ids, missing, -score, lists))
        lists, score, ids, missing = lists[order], score[order], ids[order], missing[order]
        starts = np.flatnonzero(np.concatenate([[True], lists[1:] != lists[:-1]]))
        ends = np.append(starts[1:], len(lists))
        for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
            one, n = int(lists[a]), int(self.full[lists[a]])
            b = min(b, a + self.each)
            mine = [*zip(self.score[one, :n], self.id[one, :n], strict=True),
                    *((int(s), None if m else int(i)) for s, i, m in zip(score[a:b], ids[a:b], missing[a:b], strict=True))]
            mine.sort(key=lambda p: (-p[0], p[1] is None, p[1] or 0))
            mine = mine[:self.each]
            self.full[one] = len(mine)
            self.score[one, :len(mine)] = [p[0] for p in mine]
            self.id[one, :len(mine)] = [p[1] for p in mine]
            if len(mine) == self.each:
                self.floor[one] = mine[-1][0]

    def rows(self) -> Iterator[tuple[int, int | None, int]]:
        for one, n in enumerate(self.full.tolist()):
            for k in range(n):
                yield one, self.id[one, k], self.score[one, k]


def _long(value: int) -> int:
    """A score no long can hold becomes the nearest one."""
    return max(_LEAST, min(int(value), (1 << 63) - 1))


def usable(label: Column, vector: Column) -> Column:
    """Rows with a label and a vector of finite components."""
    return label.isNotNull() & vector.isNotNull() & F.forall(
        vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def _read(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids, which of them are missing, labels and integer vectors of a batch ``id, label, vector``."""
    ids, vectors = batch.column(0), batch.column(2)
    return np.array(ids.fill_null(0)), np.array(ids.is_null()), np.array(batch.column(1)), integers(vectors)


def _positives(anchors, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = anchors.value
        best = Best(len(held["id"]), most)
        for batch in batches:
            ids, missing, labels, vectors = _read(batch)
            for label in np.intersect1d(labels, held["label"]):
                mine, theirs = np.flatnonzero(held["label"] == label), np.flatnonzero(labels == label)
                for some, these, found in blocks(held["vector"][mine], vectors[theirs]):
                    a, c = mine[these], theirs[some]
                    wanted = (found >= best.least(a, found.dtype)[None]) & ((ids[c][:, None] != held["id"][a][None]) | missing[c][:, None])
                    row, column = np.nonzero(wanted)
                    if len(row):
                        best.offer(a[column], found[row, column], ids[c[row]], missing[c[row]])
        rows = [(int(held["number"][a]), i, _long(s)) for a, i, s in best.rows()]
        yield _batch(rows, ("number", "positive_id", "positive_score"))

    return run


def _negatives(anchors, most: int, low: int, high: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = anchors.value
        # One list per anchor and positive; a positive's band is -(-low * score // 100) to high * score // 100.
        owner, score = held["owner"], held["score"]
        bottom = np.array([-(-low * int(s) // 100) for s in score], object)
        top = np.array([high * int(s) // 100 for s in score], object)
        best = Best(len(owner), most)
        turns = np.zeros(len(owner), np.int64)
        for i in range(1, len(owner)):
            turns[i] = turns[i - 1] + 1 if owner[i] == owner[i - 1] else 0
        for batch in batches:
            ids, missing, labels, vectors = _read(batch)
            for some, these, found in blocks(held["vector"], vectors):
                other = labels[some][:, None] != held["label"][these][None]
                for turn in range(int(turns.max(initial=-1)) + 1):
                    lists = np.flatnonzero((turns == turn) & (owner >= these.start) & (owner < these.stop))
                    if not len(lists):
                        continue
                    columns = owner[lists] - these.start
                    part = found if len(columns) == found.shape[1] else found[:, columns]
                    allowed = other if len(columns) == found.shape[1] else other[:, columns]
                    least = _within(np.maximum(bottom[lists], best.floor[lists]), part.dtype)
                    row, column = np.nonzero((part >= least[None]) & (part <= _within(top[lists], part.dtype)[None]) & allowed)
                    if len(row):
                        at = np.arange(some.start, some.stop)[row]
                        best.offer(lists[column], part[row, column], ids[at], missing[at])
        rows = [(int(held["pair"][k]), i, _long(s)) for k, i, s in best.rows()]
        yield _batch(rows, ("pair", "negative_id", "negative_score"))

    return run


def _batch(rows: list[tuple], names: tuple[str, ...]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=list(names))


def _first(df: DataFrame, by: str, score: str, key: str, most: int, place: str) -> DataFrame:
    """The first rows of each ``by`` with their place from 1; the tasks offer a few each."""
    made = df.groupBy(by).agg(F.slice(F.array_sort(F.collect_list(F.struct(
        (-F.col(score).cast("decimal(20,0)")).alias("order"), F.col(key).isNull().alias("missing"), F.col(key), F.col(score)))),
        1, most).alias("first"))
    return made.select(by, F.posexplode("first").alias("at", "one")).select(
        by, (F.col("at") + 1).alias(place), f"one.{key}", f"one.{score}")


def hard_negatives(
    rows: DataFrame, is_anchor: Column, key: str = "vec_id", label: str = "label", vector: str = "embedding",
    positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, each_round: int = 16_384,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    A score is the inner product of the vectors' components, each as floor(256 * x), shorter vectors ending in zeros. An anchor's
    positives are its ``positives`` best other keys of its label, the first of equal scores being the smaller key; a positive's
    hard negatives are the best ``negatives`` rows of other labels whose score is ``low`` to ``high`` percent of the positive's.

    Rows without a label or with a missing or not finite vector or component take no part. A row without a key is no anchor
    and comes behind equal scores; a repeated key is as many rows, none of which is its own positive. Scores are exact whatever the
    components; those beyond a long are given as the nearest long. No anchors, or an empty table, give no rows.

    The anchors are a stated part of the rows and are scored against all rows in rounds of about ``each_round``: the
    round's vectors go to every task, which reads its candidates where they lie, looks all scores up and hands back its best few.
    Nothing else is shuffled, and a round's results are written before the next one starts.
    """
    spark = rows.sparkSession
    taken = rows.select(
        F.col(key).cast("long").alias("id"), F.col(label).cast("long").alias("label"),
        F.col(vector).cast("array<double>").alias("vector"), F.coalesce(is_anchor, F.lit(False)).alias("anchor"),
    ).where(usable(F.col("label"), F.col("vector")))
    candidates = taken.select("id", "label", "vector")
    anchors = numbered(taken.where("anchor and id is not null").drop("anchor"), "number", "anchors")
    rounds = -(-anchors.count() // each_round)
    path = scratch_path(spark, "negatives")
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    for turn in range(rounds):
        mine = anchors.where(F.pmod(F.xxhash64("number"), F.lit(rounds)) == turn)
        got = mine.select("id", "label", "vector", "number").orderBy("number").toArrow().combine_chunks().to_batches()
        if not got:
            continue
        held = dict(zip(("id", "missing", "label", "vector"), _read(got[0]), strict=True)) | {"number": np.array(got[0].column(3))}
        sent = spark.sparkContext.broadcast(held)
        near = _first(
            in_batches(candidates, _positives(sent, positives), "number long, positive_id long, positive_score long"),
            "number", "positive_score", "positive_id", positives, "turn")
        place = {n: i for i, n in enumerate(held["number"].tolist())}
        pairs = sorted((place[r["number"]], r["turn"], r["positive_id"], r["positive_score"]) for r in near.collect())
        lists = spark.sparkContext.broadcast(held | {
            "owner": np.array([p[0] for p in pairs], np.int64), "score": np.array([p[3] for p in pairs], "i8"),
            "pair": np.arange(len(pairs))})
        far = _first(
            in_batches(candidates, _negatives(lists, negatives, low, high), "pair long, negative_id long, negative_score long"),
            "pair", "negative_score", "negative_id", negatives, "rank")
        # A round's pairs, at most ``positives`` times its anchors.
        named = F.broadcast(spark.createDataFrame(
            [(k, int(held["id"][p[0]]), p[2], p[3]) for k, p in enumerate(pairs)],
            "pair long, anchor_id long, positive_id long, positive_score long"))
        far.join(named, "pair").select(
            "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score",
        ).write.parquet(f"{path}/round={turn}")
        sent.unpersist()
        lists.unpersist()
    if not anchors.head(1):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path + "/round=*")
