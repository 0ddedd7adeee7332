import math

import numpy as np
import pandas as pd
import pytest

from meterline.operators import accuracy


def pairs(spark, y, p, **extra):
    return spark.createDataFrame(pd.DataFrame({"k": 1, "y": np.array(y, float), "p": np.array(p, float), **extra}))


def test_measures(spark):
    y, p = np.array([1.0, 2.0, 4.0, 0.5]), np.array([1.5, 2.0, 3.0, 1.0])
    row = accuracy.metrics(pairs(spark, y, p), ["k"]).first()
    e = np.abs(y - p)
    assert row.n == 4 and math.isclose(row.mae, e.mean()) and math.isclose(row.nmae, e.mean() / y.mean())
    assert math.isclose(row.mape, (e / y).mean()) and math.isclose(row.rmse, math.sqrt((e**2).mean()))
    assert math.isclose(row.r2, 1 - (e**2).sum() / ((y - y.mean()) ** 2).sum())


def test_edges(spark):
    zero = accuracy.metrics(pairs(spark, [0, 2], [1, 2]), ["k"]).first()
    assert math.isclose(zero.mape, 0.5 / 2.220446049250313e-16, rel_tol=1e-9)
    assert accuracy.metrics(pairs(spark, [3, 3], [3, 3]), ["k"]).first().r2 == 1.0
    assert accuracy.metrics(pairs(spark, [3, 3], [3, 4]), ["k"]).first().r2 == 0.0
    assert accuracy.metrics(pairs(spark, [0, 0], [1, 1]), ["k"]).first().nmae is None


def test_mean_over_outputs(spark):
    y = np.array([[1.0, 10.0], [3.0, 20.0], [2.0, 60.0]])
    p = y + np.array([[0.5, 1.0], [-1.0, 2.0], [0.0, -5.0]])
    long = pd.DataFrame(
        {"k": 1, "target": np.tile(["a", "b"], 3), "y": y.ravel(), "p": p.ravel()}
    )
    per = accuracy.metrics(spark.createDataFrame(long), ["k", "target"])
    row = accuracy.mean_over_outputs(per, ["k"]).first()
    e = np.abs(y - p)
    r2 = 1 - (e**2).sum(0) / ((y - y.mean(0)) ** 2).sum(0)
    assert math.isclose(row.mae, e.mean()) and math.isclose(row.rmse, math.sqrt((e**2).mean()))
    assert math.isclose(row.nmae, e.mean() / y.mean()) and math.isclose(row.r2, r2.mean())


def test_older_measures(spark):
    y, p = np.array([0.0, 2.0, 4.0, 0.05]), np.array([1.0, 2.5, 3.0, 0.0])
    row = accuracy.older_metrics(pairs(spark, y, p), ["k"]).first()
    e, eps = np.abs(y - p), 1e-10
    assert math.isclose(row.mape_percent, (e / (abs(y) + eps)).mean() * 100, rel_tol=1e-9)
    assert math.isclose(row.smape_percent, (2 * e / (abs(y) + abs(p) + eps)).mean() * 100)
    assert math.isclose(row.modified_smape_percent, (e / (abs(y) + abs(p) + 1)).mean() * 100)
    assert math.isclose(row.wmape_percent, e.sum() / (abs(y) + eps).sum() * 100)
    reach = (abs(p - y.mean()) + abs(y - y.mean())) ** 2
    assert math.isclose(row.agreement_percent, (1 - (e**2).sum() / reach.sum()) * 100)
    assert math.isclose(row.error_above_percent, e[1:3].sum() / 6 * 100)


def test_older_measure_edges(spark):
    flat = accuracy.older_metrics(pairs(spark, [2, 2], [2, 2]), ["k"]).first()
    assert flat.agreement_percent == 100.0
    low = accuracy.older_metrics(pairs(spark, [0.05, 0.1], [1, 1]), ["k"]).first()
    assert low.error_above_percent is None


def folds(spark):
    rng = np.random.default_rng(5)
    n = 600
    return pd.DataFrame(
        {
            "fold": rng.integers(0, 3, n), "etype": "c", "site_id": rng.integers(1, 4, n),
            "target": rng.choice(["ap+1", "ap+2"], n), "y_true": rng.random(n) * 10, "y_pred": rng.random(n) * 10,
        }
    )


def test_cube_equals_direct_measures(spark):
    pdf = folds(spark)
    cube = accuracy.metrics_cube(spark.createDataFrame(pdf)).toPandas()
    assert len(cube) == 3 * (1 + 3 + 2 + 6)
    for _, row in cube.iterrows():
        mine = pdf[pdf.fold == row.fold]
        mine = mine if pd.isna(row.site_id) else mine[mine.site_id == row.site_id]
        mine = mine if row.target is None or pd.isna(row.target) else mine[mine.target == row.target]
        e = mine.y_true - mine.y_pred
        assert row.n == len(mine) and math.isclose(row.mae, e.abs().mean(), rel_tol=1e-9)
        assert math.isclose(row.r2, 1 - (e**2).sum() / ((mine.y_true - mine.y_true.mean()) ** 2).sum(), rel_tol=1e-9)


def test_best_fold_and_means(spark):
    pdf = folds(spark)
    cube = accuracy.metrics_cube(spark.createDataFrame(pdf))
    by_fold = (pdf.y_true - pdf.y_pred).abs().groupby(pdf.fold).mean()
    assert accuracy.best_fold(cube).first().best_fold == by_fold.idxmin()
    overall = accuracy.mean_over_folds(cube).where("etype is null and target is null").first()
    assert math.isclose(overall.mae, by_fold.mean()) and overall.n_folds == 3


# 97.5 percent points of Student's t.
T_TABLE = {1: 12.7062047, 2: 4.3026527, 3: 3.1824463, 5: 2.5705818, 10: 2.2281389, 30: 2.0422725, 95: 1.9852510}


@pytest.mark.parametrize("df,value", T_TABLE.items())
def test_t_quantile(df, value):
    assert math.isclose(accuracy.t_quantile(df), value, rel_tol=1e-6)


def origins(spark):
    preds = [[1.0, 2.0, 3.0], [3.0, 5.0, 1.0], [2.0, 2.0, 2.0], [9.0, 1.0, 4.0], [7.0, 0.0, 0.0]]
    return spark.createDataFrame([(1, i, float(i), p) for i, p in enumerate(preds)], "k int, pos long, y double, pred array<double>")


def test_overlapping_forecasts(spark):
    got = accuracy.overlap_ensemble(origins(spark), ["k"]).toPandas().sort_values("step")
    assert got["step"].tolist() == [0, 1, 2, 3, 4] and got["n"].tolist() == [1, 2, 3, 3, 3]
    values = [3.0, 5.0, 2.0]
    row = got[got["step"] == 2].iloc[0]
    iqr = np.percentile(values, 75) - np.percentile(values, 25)
    assert math.isclose(row["mean"], np.mean(values)) and math.isclose(row["std"], np.std(values))
    assert math.isclose(row["iqr"], iqr) and math.isclose(row["upper_bound"], np.mean(values) + 1.5 * iqr)


def test_overlapping_forecasts_with_t_bounds(spark):
    got = accuracy.overlap_ensemble(origins(spark), ["k"], bounds="t", horizon=3).toPandas().sort_values("step")
    assert got["step"].tolist() == [1, 2, 3, 4]
    row = got[got["step"] == 1].iloc[0]
    assert math.isclose(row["margin"], T_TABLE[1] * np.std([2.0, 3.0]) / math.sqrt(2), rel_tol=1e-6)
    with pytest.raises(ValueError):
        accuracy.overlap_ensemble(origins(spark), ["k"], bounds="t")
