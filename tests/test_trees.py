import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from helpers import frame, series
from meterline.operators import trees
from meterline.operators.features import feature_matrix
from meterline.operators.histograms import grow, leaves
from meterline.operators.trees import TreeParams
from meterline.plans import models
from meterline.sources.tables import extract


@pytest.fixture(scope="module")
def matrix(spark):
    pdf = series(1400, sites=(1, 2))
    hour = pdf["ts"].dt.hour + pdf["ts"].dt.minute / 60
    rng = np.random.default_rng(0)
    pdf["ap"] = 100 + 50 * np.sin(2 * np.pi * hour / 24) * pdf["site_id"] + rng.normal(size=len(pdf)) * 8
    return feature_matrix(frame(spark, pdf), n=2, previous_days=0, stats_on=False, horizon=2).persist()


def test_training_evaluation_and_inference(spark, matrix, path):
    done = models.train_sites(matrix, TreeParams(rounds=3, max_depth=3), TreeParams(rounds=12, max_depth=4, learning_rate=0.2), top=6)
    trained = done.models
    assert {(r.site_id, r.target) for r in trained.collect()} == {(s, t) for s in (1, 2) for t in ("ap+1", "ap+2")}
    assert all(len(r.features) <= 6 and len(r.roots) == 12 for r in trained.collect())
    sites = matrix.select("etype", "site_id").unionByName(spark.createDataFrame([("production", 9)], "etype string, site_id int"))
    judged = models.evaluate_sites(matrix, trained, sites).collect()
    assert {(r.site_id, r.target) for r in judged} == {(s, t) for s in (1, 2, 9) for t in ("ap+1", "ap+2")}
    rows = {r.site_id: r for r in judged if r.target == "ap+1"}
    assert rows[9].status == "error" and rows[1].status == "success"
    test = models.held_out(matrix)
    naive = {r.site_id: r.mae for r in test.groupBy("site_id").agg(F.avg(F.abs(F.col("`ap+1`") - F.col("`ap-0`"))).alias("mae")).collect()}
    assert all(rows[s].mae < naive[s] for s in (1, 2))
    next_step = models.infer_sites(matrix, trained, now="2024-01-10 10:07:00", delay_days=1).collect()
    assert {str(r.ts) for r in next_step} == {"2024-01-09 10:00:00"} and len(next_step) == 2
    assert models.infer_sites(matrix, trained, next_step_only=False, test_only=True).count() == test.count()
    models.save_sites(done, path)
    stored = models.load_sites(spark, path)
    assert sorted(r.features for r in stored.models.collect()) == sorted(r.features for r in trained.collect())
    again = models.infer_sites(matrix, stored.models, now="2024-01-10 10:07:00", delay_days=1).collect()
    assert sorted(again) == sorted(next_step)
    assert done.features.where("rank = 1").count() == 2
    assert stored.features.count() == done.features.count()
    done.features.where("rank > 1 or site_id = 2").write.mode("overwrite").json(f"{path}/features")
    with pytest.raises(ValueError, match="disagree"):
        models.load_sites(spark, path)


def test_removed_periods_train_nothing(spark, matrix):
    gone = spark.sql("select 'consumption' as etype, 1 as site_id, cast(null as timestamp) as start_ts, cast(null as timestamp) as end_ts")
    trained = models.train_sites(matrix, TreeParams(rounds=1, max_depth=2), TreeParams(rounds=1, max_depth=2), top=2, periods=gone)
    assert {r.site_id for r in trained.models.collect()} == {2}


def test_one_tree_is_the_best_of_all_cuts():
    rng = np.random.default_rng(1)
    for l1, l2, least in ((0.0, 1.0, 1), (0.7, 0.0, 5), (1.0, 5.0, 20)):
        codes = rng.integers(0, 9, (7, 400)).astype("u1")
        label = rng.normal(size=400) + (codes[2] > 4) + (codes[5] > 1)
        worth = lambda g, n: max(abs(g) - l1, 0) ** 2 / (n + l2)
        found = max(
            (worth(-label[c <= b].sum(), (c <= b).sum()) + worth(-label[c > b].sum(), (c > b).sum()), -f, -b)
            for f, c in enumerate(codes) for b in range(9) if min((c <= b).sum(), (c > b).sum()) >= least)
        tree = grow(codes, -label, np.arange(7), 9, 1, 1.0, least, 0.0, l1, l2)
        assert (-tree.feature[0], -tree.cut[0]) == found[1:]
        assert np.isclose(tree.gain[0], found[0] - worth(-label.sum(), 400))
        left = codes[tree.feature[0]] <= tree.cut[0]
        value = label[left].sum()
        assert np.isclose(tree.value[1], np.sign(value) * max(abs(value) - l1, 0) / (left.sum() + l2))
        assert np.allclose(leaves(tree, codes), np.where(left, tree.value[1], tree.value[2]))


def test_trees_fit_any_function_of_the_codes():
    codes = np.stack(np.meshgrid(np.arange(16), np.arange(16))).reshape(2, -1).astype("u1")
    label = ((codes[0] // 3) ** 2 + codes[1] // 5).astype(float)
    margin = np.zeros(256)
    made = list(trees.boosted(codes, label, margin, TreeParams(max_depth=5, learning_rate=0.5, l2=0.0), 16, 0, 40))
    assert np.abs(margin - label).max() < 1e-3
    half, whole = np.zeros(256), np.zeros(256)
    params = TreeParams(max_depth=3, subsample=0.7, colsample=0.5)
    first = list(trees.boosted(codes, label, half, params, 16, 0, 5)) + list(trees.boosted(codes, label, half, params, 16, 5, 12))
    second = list(trees.boosted(codes, label, whole, params, 16, 0, 12))
    assert len(made) == 40 and (half == whole).all() and all((a.value == b.value).all() for a, b in zip(first, second, strict=True))


def packed_of(rows, names=("ap-0", "ap-1", "hour-0"), targets=("ap+1",)):
    return trees.pack(models.ratio_split(rows, mode="cuts"), list(names), list(targets))


def test_forecasts_follow_from_the_rows_themselves(spark, matrix):
    names = ["ap-0", "ap-1", "hour-0"]
    made = trees.fit(packed_of(matrix, names), TreeParams(rounds=7, max_depth=4))
    got = trees.predict(matrix, made, ["ap+1", "ap+2"]).toPandas().sort_values(["site_id", "ts"])
    rows = matrix.toPandas().sort_values(["site_id", "ts"])
    assert len(got) == len(rows) and got["pred_t+2"].isna().all()
    for model in made.collect():
        mine = rows[rows.site_id == model.site_id]
        for i in (0, 5, 99, len(mine) - 1):
            x, total = mine.iloc[i][model.features].to_list(), model.base
            for node in model.roots:
                while model.feature[node] >= 0:
                    node = model.left[node] + (x[model.feature[node]] > model.threshold[node])
                total += model.value[node]
            assert np.isclose(total, got[got.site_id == model.site_id].iloc[i]["pred_t+1"])


def test_jobs_do_not_follow_the_sites(spark):
    def jobs(sites):
        rows = feature_matrix(frame(spark, series(300, sites=range(1, sites + 1))), n=2, previous_days=0, stats_on=False, calendar_on=False).persist()
        rows.count()
        spark.sparkContext.setJobGroup(f"sites-{sites}", "count")
        done = models.train_sites(rows, TreeParams(rounds=2, max_depth=2), TreeParams(rounds=2, max_depth=2), top=2)
        found = models.evaluate_sites(rows, done.models)
        assert found.count() == sites
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        rows.unpersist()
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"sites-{sites}"))

    assert abs(jobs(3) - jobs(60)) <= 2  # Spark may broadcast a small table instead of shuffling it


def test_search_is_seeded_and_stops():
    assert trees.sample_params(3, 10) == trees.sample_params(3, 10)
    assert trees.sample_params(3, 10) != trees.sample_params(4, 10)
    for t in range(50):
        p = trees.sample_params(t, 10)
        assert 3 <= p.max_depth <= 10 and 0.01 <= p.learning_rate <= 0.1 and 0.6 <= p.subsample <= 1.0
        assert 0 <= p.l1 <= 1 and 0 <= p.l2 <= 5 and 0.6 <= p.colsample <= 1.0
    assert trees.best_rounds([5, 4, 3, 3.5, 3.2, 1], patience=2) == (3, 3)
    assert trees.best_rounds([5, 4, 3], patience=20) == (3, 3)


def test_tuning(matrix):
    packed = packed_of(matrix)
    records = trees.tune(packed, trials=6, rounds=16, patience=3, first=4).toPandas()
    assert records.groupby("site_id").size().to_dict() == {1: 6, 2: 6} and set(records.status) <= {"stopped", "halved", "full"}
    assert (records.status == "halved").any() and (records.built[records.status == "full"] == 16).all()
    # A trial that went on from its stored margins has the errors of one that was never interrupted.
    straight = trees.tune(packed, trials=6, rounds=16, patience=3, first=16).toPandas()
    both = records.merge(straight, on=["site_id", "trial"])
    ended = both[both.status_x != "halved"]
    assert len(ended) and (ended.mae_x == ended.mae_y).all() and (ended.rounds_x == ended.rounds_y).all()
    for _, mine in records.groupby("site_id"):
        assert mine.best.sum() == 1 and mine.mae[mine.best].iloc[0] == mine.mae.min()
    assert trees.best_params(trees.tune(packed, trials=2, rounds=4), 9).select("params.rounds").distinct().collect()[0][0] == 9


def test_experiment_grid(spark):
    flags = {"n": 3, "horizon": 1, "calendar": False, "stats": False, "weather": False}
    entries = [{"model": m, **flags} for m in ("naive", "trees", "knn")]
    got = models.compare_models(frame(spark, series(600)), None, entries, TreeParams(rounds=2, max_depth=2), folds=2, k=5)
    rows = {r.model: r for r in got.collect()}
    assert set(rows) == {"naive", "trees", "knn"} and rows["naive"].fold is None
    assert all(r.mae > 0 and r.n > 40 for r in rows.values())


def test_short_window_gives_the_same_last_row(spark):
    pdf = series(1500)
    whole = feature_matrix(frame(spark, pdf), n=4).orderBy(F.col("ts").desc()).first()
    reach = models.realtime_reach(4, 1)
    part = feature_matrix(frame(spark, pdf.tail(reach + 2)), n=4).orderBy(F.col("ts").desc()).first()
    assert whole.ts == part.ts
    assert all(np.isclose(whole[c], part[c], atol=1e-9) for c in whole.asDict() if c not in ("etype", "ts"))


def test_realtime_rows_from_tables(spark):
    held = {}
    for site, rank in (("A", 0), ("B", 2)):
        pdf = series(1500, seed=rank).assign(site=site, sn=1)
        held[f"a.std_smart_{site}"] = pdf.rename(columns={"ts": "dls"}).drop(columns=["etype", "site_id"])
    rows = pd.concat(held.values())
    given = extract(lambda name: spark.createDataFrame(held[name]), {"a": ["std_smart_A", "other", "std_smart_B"]})
    groups = spark.createDataFrame([("consumption", 1, "A", 1), ("consumption", 1, "B", 1)], "etype string, site_id int, site string, sn long")
    got = models.realtime_matrix(given, groups, "2024-01-12 10:07:00", n=4, calendar_on=False)
    last = got.orderBy(F.col("ts").desc()).first()
    total = rows.groupby("dls")["ap"].sum().rename_axis("ts").reset_index().assign(etype="consumption", site_id=1)
    want = feature_matrix(frame(spark, total), n=4, horizon=0, calendar_on=False).where("ts = timestamp'2024-01-11 10:00:00'").first()
    assert str(last.ts) == "2024-01-11 10:00:00" and "ap+1" not in got.columns
    assert all(np.isclose(last[c], want[c], atol=1e-9) for c in got.columns[3:])
