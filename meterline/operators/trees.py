"""Boosted trees of all groups at once: binned rows, feature choice, tuning, fits and forecasts as tables keyed by group.

A group is a site, or a site and a fold. After the grid it has one row per step, whatever its number of meters, and a row is
binned to one byte per feature before rows meet: ten years of a site with 50 features are 18 MB. So a group is fitted in one task and
groups side by side; the number of Spark jobs does not depend on how many there are.
"""

from __future__ import annotations

import random
from collections.abc import Sequence
from dataclasses import asdict, dataclass, fields, replace
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from meterline.functions.clock import slot
from meterline.operators.chunks import CHUNK_ROWS
from meterline.operators.histograms import Tree, grow, leaves
from meterline.session import KEY, stored

# Budget of the reference runs.
FINAL_ROUNDS = 500
IMPORTANCE_ROUNDS = 200
TUNING_ROUNDS = 1000
TUNING_TRIALS = 30
PATIENCE = 20
TOP_FEATURES = 50
SEED = 42
# Ranges searched.
SEARCH = {
    "max_depth": (3, 10),
    "learning_rate": (0.01, 0.1),
    "subsample": (0.6, 1.0),
    "colsample": (0.6, 1.0),
    "l1": (0.0, 1.0),
    "l2": (0.0, 5.0),
}
#: Rounds of the first rung of the tuning; each rung doubles them and keeps the better half of the trials.
FIRST_RUNG = 32


@dataclass(frozen=True)
class TreeParams:
    rounds: int = FINAL_ROUNDS
    max_depth: int = 6
    learning_rate: float = 0.3
    subsample: float = 1.0
    colsample: float = 1.0
    l1: float = 0.0
    l2: float = 1.0
    min_rows: int = 1
    min_gain: float = 0.0
    seed: int = SEED


PARAMS = "struct<rounds: int, max_depth: int, learning_rate: double, subsample: double, colsample: double, l1: double, l2: double, min_rows: int, min_gain: double, seed: int>"
PACKED = "features array<string>, edges array<array<double>>, targets array<string>, codes array<binary>, labels array<binary>, parts array<binary>"
MODEL = (
    "features array<string>, params " + PARAMS + ", base double, depth int, roots array<int>, feature array<int>, "
    "threshold array<double>, left array<int>, value array<double>, gains array<double>"
)


def params_column(params: TreeParams) -> Column:
    return F.struct(*[F.lit(v).alias(k) for k, v in asdict(params).items()]).cast(PARAMS)


def params_of(value: dict) -> TreeParams:
    return TreeParams(**{f.name: value[f.name] for f in fields(TreeParams)})


def _schema(rows: DataFrame, key: Sequence[str], rest: str) -> str:
    return ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in key) + ", " + rest


def _one(table: pa.Table) -> dict:
    """The only row of a group as Python values."""
    return {name: table.column(name)[0].as_py() for name in table.column_names}


def _table(columns: dict, like: pa.Table, key: Sequence[str], schema: pa.Schema) -> pa.Table:
    """Result rows that repeat the group's key."""
    n = len(next(iter(columns.values())))
    whole = {c: like.column(c).combine_chunks().take(pa.array([0] * n)) for c in key} | columns
    return pa.table({f.name: whole[f.name] for f in schema}, schema=schema)


def _arrow(rows: DataFrame, ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(rows.sparkSession.createDataFrame([], ddl).schema)


def by_task(packed: DataFrame, by: Sequence[str]):
    """The groups, dealt to more tasks than there are groups, so that few of them share one; their bytes say nothing of the work they are."""
    context = packed.sparkSession.sparkContext
    return packed.repartition(min(4 * packed.count() + 1, 64 * context.defaultParallelism), *by).groupBy(*by)


def pack(
    rows: DataFrame, features: Sequence[str], targets: Sequence[str], key: Sequence[str] = KEY, part: str = "split",
    bins: int = 32, ts: str = "ts",
) -> DataFrame:
    """One row per group: features, bin edges, and per chunk of two weeks the bin codes, labels and parts of its rows.

    The edges of a feature are quantiles from a sketch of the group's rows with a part, up to ``bins - 1`` of them; a code counts the
    edges below a value. Chunks are binned apart from each other, feature by feature, so that only bytes are gathered per group.
    """
    used = rows.where(F.col(part).isNotNull())
    share = [i / bins for i in range(1, bins)]
    sketches = [F.percentile_approx(F.col(f"`{f}`").cast("double"), share, 1000).alias(f"_{i}") for i, f in enumerate(features)]
    edges = stored(used.groupBy(*key).agg(*sketches).select(
        *key, F.array(*[F.array_distinct(f"_{i}") for i in range(len(features))]).alias("edges")), "edges")
    chunk = F.floor(slot(F.col(ts)) / CHUNK_ROWS).cast("long").alias("_chunk")
    cut = used.select(
        *key, chunk, F.when(F.col(part) == "val", 1).otherwise(0).alias("_part"),
        *[F.col(f"`{t}`").cast("double").alias(f"_y{i}") for i, t in enumerate(targets)],
        *[F.col(f"`{f}`").cast("double").alias(f"_x{i}") for i, f in enumerate(features)])
    places = edges.join(cut.groupBy(*key, F.col("_chunk").alias("_place")).agg(F.first("_chunk").alias("_chunk")).drop("_place"), list(key))
    ddl = _schema(rows, key, "_chunk long, codes binary, labels binary, parts binary")
    schema, n, m, key_ = _arrow(rows, ddl), len(features), len(targets), list(key)

    def bin_chunk(mine: pa.Table, known: pa.Table) -> pa.Table:
        if not mine.num_rows or not known.num_rows:
            return schema.empty_table()
        cuts = known.column("edges")[0].as_py()
        codes = np.stack([
            np.searchsorted(np.array(cuts[i]), mine.column(f"_x{i}").to_numpy()).astype("u1") for i in range(n)])
        labels = np.stack([mine.column(f"_y{i}").to_numpy() for i in range(m)])
        parts = mine.column("_part").to_numpy().astype("u1")
        return _table({"_chunk": mine.column("_chunk").slice(0, 1), "codes": [codes.tobytes()], "labels": [labels.tobytes()],
                       "parts": [parts.tobytes()]}, mine, key_, schema)

    chunks = cut.groupBy(*key, "_chunk").cogroup(places.groupBy(*key, "_chunk")).applyInArrow(bin_chunk, ddl)
    gathered = chunks.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("_chunk", "codes", "labels", "parts"))).alias("c"))
    names = [F.array(*[F.lit(v) for v in values]).cast("array<string>") for values in (features, targets)]
    return stored(gathered.join(edges, list(key)).select(
        *key, names[0].alias("features"), "edges", names[1].alias("targets"),
        F.col("c.codes").alias("codes"), F.col("c.labels").alias("labels"), F.col("c.parts").alias("parts")), "packed")


class Rows:
    """The rows of a packed group as arrays: codes by feature, labels by target, which rows validate."""

    def __init__(self, packed: dict):
        n, m = len(packed["features"]), len(packed["targets"])
        self.codes = np.concatenate([np.frombuffer(c, "u1").reshape(n, -1) for c in packed["codes"]], 1)
        self.labels = np.concatenate([np.frombuffer(y).reshape(m, -1) for y in packed["labels"]], 1)
        self.val = np.concatenate([np.frombuffer(p, "u1") for p in packed["parts"]]) == 1
        self.bins = 1 + max((len(e) for e in packed["edges"]), default=0)


def boosted(codes: np.ndarray, label: np.ndarray, margin: np.ndarray, params: TreeParams, bins: int, first: int, last: int):
    """The trees of rounds ``first`` to ``last``; ``margin`` moves along. Draws depend on seed and round alone, so that a fit may go on later."""
    n_columns, n_rows = codes.shape
    for turn in range(first, last):
        draw = np.random.default_rng([params.seed, turn])
        columns = np.arange(n_columns)
        if params.colsample < 1:
            columns = np.sort(draw.choice(n_columns, max(1, int(n_columns * params.colsample)), replace=False))
        slope, seen = margin - label, codes
        if params.subsample < 1:
            rows = draw.random(n_rows) < params.subsample
            seen, slope = codes[:, rows], slope[rows]
        tree = grow(seen, slope, columns, bins, params.max_depth, params.learning_rate, params.min_rows, params.min_gain,
                    params.l1, params.l2)
        margin += leaves(tree, codes)
        yield tree


def mean_gains(trees: Sequence[Tree], n: int) -> np.ndarray:
    """The mean gain of the splits on each feature, 0 without any."""
    feature, gain = (np.concatenate([getattr(t, c) for t in trees] or [np.zeros(0)]) for c in ("feature", "gain"))
    inner = feature >= 0
    at = feature[inner].astype(int)
    return np.bincount(at, gain[inner], n) / np.maximum(np.bincount(at, minlength=n), 1)


def choose_features(
    packed: DataFrame, k: int = TOP_FEATURES, params: TreeParams = TreeParams(rounds=IMPORTANCE_ROUNDS), key: Sequence[str] = KEY,
) -> DataFrame:
    """The packed groups with their ``k`` most important features only, by falling ``importance``.

    Importance is the mean gain of a feature's splits in a first fit on the train rows for the first target; equals go by name,
    unused features are left out. Groups without train rows are left out.
    """
    ddl = _schema(packed, key, PACKED + ", importance array<double>")
    schema, key_ = _arrow(packed, ddl), list(key)

    def choose(table: pa.Table) -> pa.Table:
        row = _one(table)
        rows = Rows(row)
        train = ~rows.val
        if not train.any():
            return schema.empty_table()
        codes, label = rows.codes[:, train], rows.labels[0, train]
        margin = np.full(len(label), label.mean())
        gains = mean_gains(list(boosted(codes, label, margin, params, rows.bins, 0, params.rounds)), len(codes))
        order = sorted(np.flatnonzero(gains > 0).tolist(), key=lambda i: (-gains[i], row["features"][i]))[:k]
        return _table({
            "features": [[row["features"][i] for i in order]], "edges": [[row["edges"][i] for i in order]],
            "targets": [row["targets"]], "codes": [[rows.codes[order].tobytes()]], "labels": [[rows.labels.tobytes()]],
            "parts": [[rows.val.astype("u1").tobytes()]], "importance": [[float(gains[i]) for i in order]]}, table, key_, schema)

    return stored(by_task(packed, key).applyInArrow(choose, ddl), "chosen")


def sample_params(trial: int, rounds: int, seed: int = SEED) -> TreeParams:
    """Parameters of a trial, drawn from the search ranges; the same trial gives the same ones."""
    draw = random.Random(seed * 1_000_003 + trial)
    picked = {
        name: draw.randint(lo, hi) if isinstance(lo, int) else draw.uniform(lo, hi)
        for name, (lo, hi) in SEARCH.items()
    }
    return TreeParams(rounds=rounds, seed=seed, **picked)


def best_rounds(errors: Sequence[float], patience: int = PATIENCE) -> tuple[int, float]:
    """Rounds and error at which training stops: ``patience`` rounds without a smaller error."""
    best, at = float("inf"), 0
    for i, error in enumerate(errors):
        if error < best:
            best, at = error, i
        elif i - at >= patience:
            break
    return at + 1, best


STATE = "trial int, params " + PARAMS + ", margin binary, errors array<double>, rounds int, mae double, built int, stopped boolean"


def tune(
    packed: DataFrame, trials: int = TUNING_TRIALS, rounds: int = TUNING_ROUNDS, patience: int = PATIENCE, seed: int = SEED,
    first: int = FIRST_RUNG, key: Sequence[str] = KEY,
) -> DataFrame:
    """Seeded random search for the smallest mean absolute error on the validation rows, one record per group and trial.

    All trials of a group build ``first`` rounds; those that still gain and are in the better half go on from their margins, which
    are stored, to twice the rounds, and so on up to ``rounds``. A trial stops after ``patience`` rounds without gain.
    ``rounds`` and ``mae`` are those of its best round, ``built`` says how many it made, ``status`` is ``stopped``, ``halved`` or
    ``full``; ``best`` marks the trial with the least error, the first of equal ones. Groups without train or validation rows have no records.
    """
    spark, ddl = packed.sparkSession, _schema(packed, key, STATE)
    schema, key_ = _arrow(packed, ddl), list(key)
    by = [*key, "trial"]
    drawn = spark.createDataFrame(
        [(t, tuple(asdict(sample_params(t, rounds, seed)).values())) for t in range(trials)], f"trial int, params {PARAMS}")
    # A few dozen trials.
    now = packed.select(*key).crossJoin(F.broadcast(drawn)).withColumns({
        "margin": F.lit(None).cast("binary"), "errors": F.lit(None).cast("array<double>"), "rounds": F.lit(0), "mae": F.lit(None).cast("double"),
        "built": F.lit(0), "stopped": F.lit(False)})
    done, until = [], min(first, rounds)
    while True:
        upto = until

        def go_on(table: pa.Table) -> pa.Table:
            row = _one(table)
            rows = Rows(row)
            params, val = params_of(row["params"]), rows.val
            if val.all() or not val.any():
                return schema.empty_table()
            label = rows.labels[0]
            train, check = np.flatnonzero(~val), np.flatnonzero(val)
            margin = (np.frombuffer(row["margin"]).copy() if row["margin"] else np.full(len(label), label[train].mean()))
            here, errors, stopped = margin[train], list(row["errors"] or []), False
            codes, there = rows.codes[:, train], rows.codes[:, check]
            for tree in boosted(codes, label[train], here, params, rows.bins, row["built"], upto):
                margin[check] += leaves(tree, there)
                errors.append(float(np.abs(margin[check] - label[check]).mean()))
                used, mae = best_rounds(errors, patience)
                if len(errors) - used >= patience:
                    stopped = True
                    break
            margin[train] = here
            return _table({
                "trial": [row["trial"]], "params": [row["params"]], "margin": [margin.tobytes()], "errors": [errors], "rounds": [used], "mae": [mae],
                "built": [len(errors)], "stopped": [stopped]}, table, key_, schema)

        state = stored(by_task(now.join(packed, list(key)), by).applyInArrow(go_on, ddl), "rung")
        # A few dozen trials per group.
        mine = Window.partitionBy(*key, "stopped")
        place, going = F.row_number().over(mine.orderBy("mae", "trial")), F.count("*").over(mine)
        on = ~F.col("stopped") & (place <= F.ceil(going / 2)) & F.lit(until < rounds)
        status = F.when(F.col("stopped"), "stopped").when(F.lit(until >= rounds), "full").otherwise("halved")
        kept = stored(state.withColumn("_on", on).withColumn("status", F.when(~F.col("_on"), status)).drop("_on"), "rung")
        done.append(kept.where("status is not null").drop("margin", "errors", "stopped"))
        now = kept.where("status is null").drop("status")
        if until >= rounds or not now.head(1):
            break
        until = min(rounds, 2 * until)
    records = done[0]
    for more in done[1:]:
        records = records.unionByName(more)
    least = F.row_number().over(Window.partitionBy(*key).orderBy("mae", "trial"))
    return records.withColumn("best", least == 1)


def best_params(records: DataFrame, rounds: int | None = None, key: Sequence[str] = KEY) -> DataFrame:
    """The parameters of every group's best trial, with its own rounds or ``rounds``."""
    used = F.col("rounds") if rounds is None else F.lit(rounds)
    return records.where("best").select(*key, F.col("params").withField("rounds", used).alias("params"))


def fit(packed: DataFrame, params: TreeParams | DataFrame = TreeParams(), key: Sequence[str] = KEY) -> DataFrame:
    """A model per group and target on all packed rows, train and validation: trees as arrays of nodes, a row each.

    ``params`` are the same for all, or a table ``key, params``; groups it lacks take the defaults.
    """
    ddl = _schema(packed, key, "target string, " + MODEL)
    schema, key_ = _arrow(packed, ddl), list(key)
    if isinstance(params, DataFrame):
        given = packed.join(params, list(key), "left").withColumn("params", F.coalesce("params", params_column(TreeParams())))
    else:
        given = packed.withColumn("params", params_column(params))
    each = given.withColumn("target", F.explode("targets"))

    def train(table: pa.Table) -> pa.Table:
        row = _one(table)
        rows, params = Rows(row), params_of(row["params"])
        label = rows.labels[row["targets"].index(row["target"])]
        base = float(label.mean())
        margin = np.full(len(label), base)
        # The group's own seed, the same in every run.
        own = replace(params, seed=crc32(repr([params.seed, *[row[c] for c in key_]]).encode()))
        trees = list(boosted(rows.codes, label, margin, own, rows.bins, 0, params.rounds))
        starts = np.cumsum([0, *[len(t.feature) for t in trees]])
        feature, cut, value = (np.concatenate([getattr(t, c) for t in trees] or [np.zeros(0)]) for c in ("feature", "cut", "value"))
        left = np.concatenate([t.left + s for t, s in zip(trees, starts, strict=False)] or [np.zeros(0)])
        limits = [row["edges"][f][c] if f >= 0 and c < len(row["edges"][f]) else float("inf")
                  for f, c in zip(feature.astype(int).tolist(), cut.astype(int).tolist(), strict=True)]
        return _table({
            "target": [row["target"]], "features": [row["features"]], "params": [row["params"]], "base": [base],
            "depth": [params.max_depth], "roots": [starts[:-1].astype("i4")], "feature": [feature.astype("i4")],
            "threshold": [limits], "left": [left.astype("i4")], "value": [value.astype("f8")],
            "gains": [mean_gains(trees, len(row["features"]))]}, table, key_, schema)

    return stored(by_task(each, [*key, "target"]).applyInArrow(train, ddl), "models")


def walk(model: dict, x: np.ndarray, at_once: int = 1_024) -> np.ndarray:
    """The forecasts of one model for rows of features: the leaves its trees lead to, added up."""
    feature, threshold, left, value = (np.array(model[c]) for c in ("feature", "threshold", "left", "value"))
    roots, found = np.array(model["roots"], np.int64), np.full(len(x), float(model["base"]))
    for first in range(0, len(x) if len(roots) else 0, at_once):
        some = x[first:first + at_once]
        rows = np.arange(len(some))[:, None]
        node = np.broadcast_to(roots, (len(some), len(roots)))
        for _ in range(model["depth"]):
            split = feature[node]
            right = some[rows, np.maximum(split, 0)] > threshold[node]
            node = np.where(split < 0, node, left[node] + right)
        found[first:first + at_once] += value[node].sum(1)
    return found


def used_features(models: DataFrame) -> list[str]:
    """All features any model reads; a matrix has no more columns than that."""
    return sorted(r[0] for r in models.select(F.explode("features")).distinct().collect())


def predict(
    rows: DataFrame, models: DataFrame, targets: Sequence[str], key: Sequence[str] = KEY, carry: Sequence[str] = (),
    ts: str = "ts", chunks: int = 8,
) -> DataFrame:
    """Key, stamp, ``carry`` and ``pred_t+k`` for every target ``ap+k``, of the rows of the groups that have models.

    Rows meet the models of their group in pieces of ``chunks`` times two weeks, so that a model is not repeated per row and a long
    series is not gathered; one shuffle, whatever the number of groups and targets. A missing target's forecast is null.
    """
    names, key_ = used_features(models), list(key)
    piece = F.floor(slot(F.col(ts)) / (chunks * CHUNK_ROWS)).cast("long").alias("_piece")
    held = [c for c in carry if c not in (*key, ts)]
    given = rows.select(
        *key, ts, *[F.col(f"`{c}`") for c in held], piece, *[F.col(f"`{n}`").cast("double").alias(f"_x{i}") for i, n in enumerate(names)])
    places = given.groupBy(*key, F.col("_piece").alias("_place")).agg(F.first("_piece").alias("_piece")).drop("_place")
    mine = models.where(F.col("target").isin(*targets)).select(
        *key, "target", "features", "base", "depth", "roots", "feature", "threshold", "left", "value").join(places, key_)
    made = [f"pred_t+{t.split('+')[1]}" for t in targets]
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in given.select(*key, ts, *[F.col(f"`{c}`") for c in held]).schema)
    ddl += "".join(f", `{m}` double" for m in made)
    schema, number = _arrow(rows, ddl), {n: i for i, n in enumerate(names)}

    def score(table: pa.Table, known: pa.Table) -> pa.Table:
        if not table.num_rows or not known.num_rows:
            return schema.empty_table()
        found: dict = {m: pa.nulls(table.num_rows, pa.float64()) for m in made}
        for model in known.to_pylist():
            x = np.stack([table.column(f"_x{number[f]}").to_numpy() for f in model["features"]] or [np.zeros(table.num_rows)], 1)
            found[f"pred_t+{model['target'].split('+')[1]}"] = pa.array(walk(model, x))
        whole = {c: table.column(c) for c in (*key_, ts, *held)} | found
        return pa.table({f.name: whole[f.name] for f in schema}).cast(schema)

    return given.groupBy(*key, "_piece").cogroup(mine.groupBy(*key, "_piece")).applyInArrow(score, ddl)


def save_models(models: DataFrame, root: str, key: Sequence[str] = KEY) -> None:
    """Write the models by group and step; a group that is trained again replaces its own."""
    models.withColumn("step", F.split("target", r"\+")[1].cast("int")).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic").partitionBy(*key, "step").parquet(root)


def load_models(spark: SparkSession, root: str, key: Sequence[str] = KEY, like: str = "etype string, site_id int") -> DataFrame:
    """Models that ``save_models`` wrote, for scoring in another session."""
    schema = f"{like}, target string, {MODEL}, step int"
    return spark.read.schema(schema).parquet(root).select(*key, "target", *[c.split()[0] for c in _names(MODEL)])


def _names(ddl: str) -> list[str]:
    """The column parts of a schema text, commas inside brackets left alone."""
    parts, depth = [""], 0
    for sign in ddl:
        depth += (sign == "<") - (sign == ">")
        if sign == "," and not depth:
            parts.append("")
        else:
            parts[-1] += sign
    return [p.strip() for p in parts]
