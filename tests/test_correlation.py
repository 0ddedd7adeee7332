import math

import numpy as np
import pytest

from helpers import frame, series, sorted_pandas
from meterline.operators import correlation, scaling, selection


def shaped(n, kind, seed=0):
    pdf = series(n, seed=seed)
    rng = np.random.default_rng(seed)
    noise = rng.normal(size=n)
    if kind == "ar":
        x = np.zeros(n)
        for t in range(2, n):
            x[t] = 0.6 * x[t - 1] - 0.3 * x[t - 2] + noise[t]
        pdf["ap"] = x + 50
    elif kind == "walk":
        pdf["ap"] = np.cumsum(noise)
    elif kind == "double":
        pdf["ap"] = np.cumsum(np.cumsum(noise))
    return pdf


def test_acf(spark):
    pdf = shaped(2000, "ar")
    got = sorted_pandas(correlation.autocorrelation(frame(spark, pdf), 20), "lag")
    x = pdf["ap"].to_numpy() - pdf["ap"].mean()
    want = [1.0] + [(x[k:] * x[:-k]).sum() / (x * x).sum() for k in range(1, 21)]
    assert np.allclose(got["acf"], want)


def lagged(x, k, start):
    return np.column_stack([np.ones(len(x) - start)] + [x[start - i: len(x) - i] for i in range(1, k + 1)])


def test_pacf_equals_regressions(spark):
    pdf = shaped(3000, "ar")
    got = sorted_pandas(correlation.partial_autocorrelation(frame(spark, pdf), 8), "lag")
    x = pdf["ap"].to_numpy()
    want = [1.0] + [np.linalg.lstsq(lagged(x, k, k), x[k:], rcond=None)[0][-1] for k in range(1, 9)]
    assert np.allclose(got["pacf"], want, atol=1e-8)


def direct_statistic(x, p):
    dx = np.diff(x)
    y = dx[p:]
    cols = [x[p:-1], *[dx[p - i: len(dx) - i] for i in range(1, p + 1)], np.ones(len(y))]
    design = np.column_stack(cols)
    beta = np.linalg.lstsq(design, y, rcond=None)[0]
    residual = y - design @ beta
    sigma = residual @ residual / (len(y) - design.shape[1])
    return beta[0] / math.sqrt(sigma * np.linalg.inv(design.T @ design)[0, 0])


@pytest.mark.parametrize("p", [0, 1, 4])
def test_unit_root_statistic(spark, p):
    pdf = shaped(1800, "ar")
    row = correlation.difference_order(frame(spark, pdf), p=p).first()
    assert math.isclose(row.statistic, direct_statistic(pdf["ap"].to_numpy(), p), rel_tol=1e-6)


@pytest.mark.parametrize("kind,order", [("ar", 0), ("walk", 1), ("double", 2)])
def test_difference_order(spark, kind, order):
    assert correlation.difference_order(frame(spark, shaped(2500, kind, 3))).first().d == order


def test_short_and_stubborn_series_have_a_status(spark):
    short = correlation.difference_order(frame(spark, shaped(2, "ar"))).first()
    assert short.status == "short" and short.d is None
    assert correlation.difference_order(frame(spark, shaped(2500, "double", 3)), max_d=1).first().status == "not_rejected"
    row = correlation.partial_autocorrelation(frame(spark, shaped(10, "ar")), 8).collect()
    assert [(r.status, r.lag) for r in row] == [("short", None)]


def test_lags_grow_with_the_series(spark):
    assert correlation.usual_lags(9000) > 30
    row = correlation.difference_order(frame(spark, shaped(9000, "walk", 3))).first()
    assert row.status == "rejected" and row.d == 1


def wide(n=800):
    pdf = series(n, sites=(1, 2))
    rng = np.random.default_rng(9)
    m = len(pdf)
    pdf["a"] = pdf["ap"] * 2 + rng.normal(size=m) * 10
    pdf["b"] = -np.sqrt(pdf["ap"]) + rng.normal(size=m) * 0.5
    pdf["c"] = rng.integers(0, 3, m).astype(float)
    pdf["flat"] = 1.0
    pdf["d"] = np.where(rng.random(m) < 0.4, 0.0, np.exp(pdf["ap"] / 60))
    return pdf


FEATURES = ["a", "b", "c", "flat", "d"]


def test_top_correlated(spark):
    pdf = wide()
    got = sorted_pandas(selection.top_correlated(frame(spark, pdf), FEATURES, k=3), "site_id", "rank")
    for site, rows in pdf.groupby("site_id"):
        want = rows[["a", "b", "c", "d"]].corrwith(rows["ap"]).abs().sort_values(ascending=False).head(3)
        mine = got[got.site_id == site]
        assert mine["name"].tolist() == want.index.tolist() and np.allclose(mine["corr"], want)


@pytest.mark.parametrize("complete", [False, True])
def test_spearman_equals_pandas(spark, complete):
    pdf = wide()
    got = selection.spearman(frame(spark, pdf), FEATURES, "ap", complete=complete).toPandas()
    for site, rows in pdf.groupby("site_id"):
        ranks = rows[["ap", "a", "b", "c", "d"]].rank()
        for name in ["a", "b", "c", "d"]:
            mine = got[(got.site_id == site) & (got["name"] == name)]["rho"].iloc[0]
            assert math.isclose(mine, ranks[name].corr(ranks["ap"]), rel_tol=1e-9)


def test_f_scores_and_choice(spark):
    pdf = wide()
    pdf["t-1"] = 0.0
    got = selection.f_scores(frame(spark, pdf), FEATURES, "ap").toPandas()
    rows = pdf[pdf.site_id == 1]
    r = rows["a"].corr(rows["ap"])
    mine = got[(got.site_id == 1) & (got["name"] == "a")]["f"].iloc[0]
    assert math.isclose(mine, r * r / (1 - r * r) * (len(rows) - 2), rel_tol=1e-9)
    chosen = selection.select_features(frame(spark, pdf), [*FEATURES, "t-1"], "ap", anchor="ap", k=3).toPandas()
    assert set(chosen[chosen.site_id == 1]["name"]) == {"a", "b", "d", "t-1"}


def test_feature_counts(spark):
    got = selection.feature_counts(frame(spark, wide()), ["c", "flat"]).toPandas()
    assert set(zip(got["name"], got["n_distinct"])) == {("c", 3), ("flat", 1)} and set(got["n_values"]) == {800}


def test_robust_scaling_and_back(spark):
    pdf = wide()
    df = frame(spark, pdf)
    cols = ["a", "flat", "d"]
    fitted = scaling.robust_parameters(df, cols)
    scaled = scaling.scale(df, fitted, cols)
    got = sorted_pandas(scaled, "site_id", "ts")
    for site, rows in pdf.groupby("site_id"):
        q = rows[cols].quantile([0.25, 0.5, 0.75])
        spread = (q.loc[0.75] - q.loc[0.25]).replace(0, 1)
        want = (rows[cols] - q.loc[0.5]) / spread
        assert np.allclose(got[got.site_id == site][cols], want)
    back = sorted_pandas(scaling.unscale(scaled, fitted, cols), "site_id", "ts")
    assert np.allclose(back[cols], pdf[cols])


def test_standard_scaling_and_fit_on_some_rows(spark):
    pdf = wide()
    df = frame(spark, pdf)
    got = sorted_pandas(scaling.scale(df, scaling.standard_parameters(df, ["a"]), ["a"]), "site_id", "ts")
    one = pdf[pdf.site_id == 1]["a"]
    assert np.allclose(got[got.site_id == 1]["a"], (one - one.mean()) / one.std(ddof=0))
    some = scaling.robust_parameters(df, ["a"], where="ap > 40").where("site_id = 1").first()
    assert math.isclose(some.center, pdf[(pdf.site_id == 1) & (pdf.ap > 40)]["a"].median())
