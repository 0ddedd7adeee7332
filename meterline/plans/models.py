"""Training, evaluation and inference over all site groups."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession, functions as F

from meterline.functions.clock import cutoff, shift_steps
from meterline.operators import trees
from meterline.operators.accuracy import metrics
from meterline.operators.chunks import with_position
from meterline.operators.clean import drop_periods, known_until, latest
from meterline.operators.features import check_columns, ewm_reach, feature_matrix, naive
from meterline.operators.neighbours import knn
from meterline.operators.regular import group_sum, resample
from meterline.operators.splits import held_out, ratio_split
from meterline.operators.trees import FINAL_ROUNDS, IMPORTANCE_ROUNDS, TOP_FEATURES, TUNING_ROUNDS, TUNING_TRIALS, TreeParams
from meterline.session import KEY, STEPS_PER_DAY, stored
from meterline.sources.results import read_report, write_report
from meterline.sources.tables import range_scan


def features_of(df: DataFrame, key: Sequence[str] = KEY) -> list[str]:
    return [c for c in df.columns if c not in (*key, "ts", "split") and not c.startswith("ap+")]


def targets_of(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c.startswith("ap+")]


class Trained(NamedTuple):
    """What a training hands over: models by group and target, features by rank, and one record per tuning trial (None untuned)."""

    models: DataFrame
    features: DataFrame
    trials: DataFrame | None


def feature_ranks(chosen: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """Chosen features of every group by rank, with their importance in the first fit."""
    both = F.arrays_zip(F.col("features").alias("feature"), F.col("importance").alias("importance"))
    return chosen.select(*key, F.element_at("targets", 1).alias("target"), F.posexplode(both).alias("rank", "f")).select(
        *key, "target", (F.col("rank") + 1).alias("rank"), F.col("f.feature").alias("feature"), F.col("f.importance").alias("importance"))


def choose_sites(
    matrix: DataFrame, first: TreeParams = TreeParams(rounds=IMPORTANCE_ROUNDS), top: int = TOP_FEATURES,
    key: Sequence[str] = KEY, periods: DataFrame | None = None,
) -> DataFrame:
    """The packed rows of every site, cut 80/10/10 by position, with the features of the first fit.

    Rows inside ``periods`` (``drop_periods``) are left out after the lags were taken, before the cut.
    """
    if periods is not None:
        matrix = drop_periods(matrix, periods, key)
    split = ratio_split(matrix, key, mode="cuts")
    known = stored(split.where(F.col("split").isin("train", "val")), "known")
    return trees.choose_features(trees.pack(known, features_of(matrix, key), targets_of(matrix), key), top, first, key)


def train_sites(
    matrix: DataFrame,
    first: TreeParams = TreeParams(rounds=IMPORTANCE_ROUNDS),
    final: TreeParams = TreeParams(),
    top: int = TOP_FEATURES,
    trials: int = 0,
    tuning_rounds: int = TUNING_ROUNDS,
    key: Sequence[str] = KEY,
    periods: DataFrame | None = None,
) -> Trained:
    """Choose features on the train rows, tune on the validation rows, refit on both: a model per site and target.

    With ``trials`` the last fit takes each site's best parameters and the rounds of ``final``.
    """
    chosen = choose_sites(matrix, first, top, key, periods)
    records = trees.tune(chosen, trials, tuning_rounds, key=key) if trials else None
    params = final if records is None else trees.best_params(records, final.rounds, key)
    return Trained(trees.fit(chosen, params, key), feature_ranks(chosen, key), records)


def save_sites(trained: Trained, root: str, key: Sequence[str] = KEY) -> None:
    """Write the models by energy type, site and step, and the features and parameters as JSON lines beside them."""
    trees.save_models(trained.models, f"{root}/models", key)
    write_report(trained.features, f"{root}/features")
    write_report(trained.models.select(*key, "target", "params"), f"{root}/params")


def load_sites(spark: SparkSession, root: str) -> Trained:
    """What ``save_sites`` wrote, for scoring in another session. A model that reads a feature its site's list lacks is an error."""
    models = trees.load_models(spark, f"{root}/models")
    features = read_report(spark, f"{root}/features").withColumn("site_id", F.col("site_id").cast("int"))
    listed = features.groupBy(*KEY).agg(F.collect_set("feature").alias("listed"))
    strange = models.join(listed, list(KEY), "left").where(
        F.size(F.array_except("features", F.coalesce("listed", F.array().cast("array<string>")))) > 0).select(*KEY).distinct().limit(5).collect()
    if strange:
        raise ValueError(f"models and feature lists disagree: {[tuple(r) for r in strange]}")
    return Trained(models, features, None)


def model_targets(models: DataFrame) -> list[str]:
    """The targets there are models for, by step."""
    found = [r[0] for r in models.select("target").distinct().collect()]
    return sorted(found, key=lambda t: int(t.split("+")[1]))


def score_sites(matrix: DataFrame, models: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """Forecasts ``pred_t+k`` and true values ``true_ap+k`` of the rows of every site with models."""
    targets = model_targets(models)
    check_columns(matrix, trees.used_features(models))
    scored = trees.predict(matrix, models, targets, key, [t for t in targets if t in matrix.columns])
    true = [(F.col(f"`{t}`") if t in scored.columns else F.lit(None).cast("double")).alias(f"true_{t}") for t in targets]
    return scored.select(*key, "ts", *[F.col(f"`pred_t+{t.split('+')[1]}`") for t in targets], *true)


def evaluate_sites(
    matrix: DataFrame,
    models: DataFrame,
    sites: DataFrame | None = None,
    key: Sequence[str] = KEY,
) -> DataFrame:
    """Measures on the last tenth of each site, one row per site and target; a site without a model
    or without test rows gets a row with the status ``error``."""
    targets = model_targets(models)
    scored = score_sites(held_out(matrix, key), models, key)
    pairs = F.inline(F.array(*[
        F.struct(
            F.lit(t).alias("target"), F.col(f"`true_{t}`").alias("y"), F.col(f"`pred_t+{t.split('+')[1]}`").alias("p")
        ) for t in targets
    ]))
    by = [*key, "target"]
    result = metrics(scored.select(*key, pairs), by).withColumnRenamed("n", "n_rows_test")
    if sites is None:
        return result.withColumn("status", F.lit("success"))
    status = F.when(F.col("n_rows_test").isNull(), "error").otherwise("success")
    wanted = sites.select(*key).distinct().withColumn("target", F.explode(F.array(*[F.lit(t) for t in targets])))
    return wanted.join(result, by, "left").withColumn("status", status)


def infer_sites(
    matrix: DataFrame,
    models: DataFrame,
    next_step_only: bool = True,
    now=None,
    delay_days: int = 1,
    test_only: bool = False,
    key: Sequence[str] = KEY,
) -> DataFrame:
    """The next step from the last row known at ``now``, or all rows, or the last tenth."""
    if next_step_only:
        known = matrix if now is None else known_until(matrix, now, delay_days)
        return score_sites(latest(known, key), models, key)
    return score_sites(held_out(matrix, key) if test_only else matrix, models, key)


def realtime_reach(n: int, previous_days: int) -> int:
    """Steps of readings the last feature row depends on: lags, statistics, exponential mean."""
    return STEPS_PER_DAY * previous_days + n - 1 + max(ewm_reach(n), n)


def realtime_matrix(
    rows: DataFrame,
    groups: DataFrame,
    now,
    weather: DataFrame | None = None,
    n: int = 8,
    previous_days: int = 1,
    order: Sequence[str] = (),
    **options,
) -> DataFrame:
    """Feature rows, without targets, from the operational tables as ``extract`` gives them.

    Only the steps the last row depends on are scanned. ``rows`` holds ``site, sn, dls, ap`` and the
    ranks of database and table; ``groups`` maps ``site, sn`` to ``etype, site_id``. The last step is
    the one ``previous_days`` before ``now``.
    """
    end = cutoff(F.lit(now).cast("timestamp"), previous_days)
    start = shift_steps(end, -realtime_reach(n, previous_days))
    recent = range_scan(rows, start, end, groups.select("site", "sn").distinct(), order)
    meter = F.concat_ws("/", "site", F.col("sn").cast("string")).alias("site_key")
    series = resample(recent.select(meter, "ts", "ap"), ["site_key"], "ts", ["ap"])
    total = group_sum(series, groups.select(*KEY, meter))
    return feature_matrix(total, weather, n, 0, previous_days, **options)


def fold_rows(known: DataFrame, folds: int, key: Sequence[str] = KEY) -> DataFrame:
    """The train rows of every expanding fold: fold f has the first f + 1 of ``folds + 1`` equal blocks of each group."""
    numbered = with_position(known, key)
    size = F.greatest(F.floor(F.col("n") / (folds + 1)), F.lit(1))
    block = F.floor(F.col("pos") / size).cast("long")
    return numbered.withColumn("_block", block).where(F.col("_block") < folds).withColumn(
        "fold", F.explode(F.sequence("_block", F.lit(folds - 1).cast("long")))).drop("pos", "n", "_block")


def compare_models(
    series: DataFrame,
    weather: DataFrame | None,
    grid: Sequence[Mapping],
    params: TreeParams = TreeParams(max_depth=5),
    folds: int = 2,
    k: int = 50,
    key: Sequence[str] = KEY,
) -> DataFrame:
    """Result rows of an experiment grid; each entry names ``model`` (naive, trees, knn), ``n``,
    ``horizon`` and the flags ``calendar``, ``stats``, ``weather``.

    Models are fitted per site on each expanding fold of the first 90 percent and judged on the
    last tenth; the best fold by MAE is kept. Features are computed and binned once per input and flags, for all
    horizons, folds and sites together.
    """
    cases: dict[tuple, list[Mapping]] = {}
    for e in grid:
        cases.setdefault((e["n"], e["calendar"], e["stats"], e["weather"]), []).append(e)
    by = [*key, "fold"]
    results = []

    def labelled(result: DataFrame, model: str, sign: tuple) -> DataFrame:
        labels = {"model": F.lit(model), **{c: F.lit(v) for c, v in zip(("in", "calendar", "stats", "weather"), sign, strict=True)}}
        return result.withColumns(labels).select(
            "model", *key, "in", "out", "calendar", "stats", "weather", "fold", "n", "mae", "nmae")

    def judged(scored: DataFrame, pairs: list[tuple[int, str, str]]) -> DataFrame:
        """Measures per group, fold and horizon of columns ``(horizon, true, forecast)``; the best fold of each."""
        each = F.inline(F.array(*[F.struct(F.lit(h).alias("out"), F.col(f"`{y}`").alias("y"), F.col(f"`{p}`").alias("p")) for h, y, p in pairs]))
        by_fold = metrics(scored.select(*by, each), [*by, "out"])
        best = by_fold.groupBy(*key, "out").agg(F.min_by("fold", F.struct("mae", "fold")).alias("fold"))
        return by_fold.join(best, [*by, "out"])

    for sign, entries in cases.items():
        n, calendar, stats, with_weather = sign
        for h in sorted({e["horizon"] for e in entries if e["model"] == "naive"}):
            result = metrics(held_out(naive(series, h, key), key), key)
            results.append(labelled(result.withColumns({"fold": F.lit(None).cast("long"), "out": F.lit(h)}), "naive", sign))
        fitted = {m: sorted({e["horizon"] for e in entries if e["model"] == m}) for m in ("trees", "knn")}
        steps = sorted({h for found in fitted.values() for h in found})
        if not steps:
            continue
        targets = [f"ap+{h}" for h in steps]
        matrix = feature_matrix(series, weather if with_weather else None, n, max(steps), 1, calendar, stats, targets, key=key)
        features = features_of(matrix, key)
        cut = stored(ratio_split(matrix, key, ratios=(0.9, 0.0, 0.1), mode="cuts"), "cut")
        train = fold_rows(cut.where("split = 'train'"), folds, key)
        test = cut.where("split = 'test'").withColumn("fold", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(folds - 1).cast("long"))))
        if fitted["trees"]:
            mine = [f"ap+{h}" for h in fitted["trees"]]
            models = trees.fit(trees.pack(train, features, mine, by), params, by)
            scored = trees.predict(test, models, mine, by, mine)
            results.append(labelled(judged(scored, [(h, f"ap+{h}", f"pred_t+{h}") for h in fitted["trees"]]), "trees", sign))
        for h in fitted["knn"]:
            target = f"ap+{h}"
            scored = knn(train, test, features, target, k, by).join(test.select(*by, "ts", F.col(f"`{target}`")), [*by, "ts"])
            results.append(labelled(judged(scored, [(h, target, "p")]), "knn", sign))
    whole = results[0]
    for more in results[1:]:
        whole = whole.unionByName(more)
    return whole
