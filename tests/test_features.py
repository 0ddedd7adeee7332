import numpy as np
import pandas as pd
import pytest

from helpers import frame, series, sorted_pandas
from meterline.operators import features
from meterline.operators.features import STATS_COLUMNS


def pandas_stats(s, n):
    roll = s.rolling(n)
    return pd.DataFrame(
        {
            "rolling_mean": roll.mean(), "rolling_median": roll.median(), "rolling_std": roll.std(),
            "rolling_min": roll.min(), "rolling_max": roll.max(), "diff_1": s.diff(1), "diff_2": s.diff(2),
            "ewm_mean": s.ewm(span=n).mean(),
        }
    )


@pytest.mark.parametrize("n", [1, 2, 7, 8, 96])
def test_statistics_equal_pandas(spark, n):
    pdf = series(3200, sites=(1, 2), seed=n)
    got = sorted_pandas(features.add_stats(frame(spark, pdf), n), "site_id", "ts")
    want = pd.concat([pandas_stats(g["ap"], n) for _, g in pdf.groupby("site_id")])
    for c in STATS_COLUMNS:
        assert np.allclose(got[c], want[c], atol=1e-8, equal_nan=True), c


def test_statistics_with_a_null_in_the_middle(spark):
    pdf = series(40)
    pdf.loc[[11, 25, 26], "ap"] = np.nan
    got = sorted_pandas(features.add_stats(frame(spark, pdf), 4), "ts")
    want = pandas_stats(pdf["ap"], 4)
    for c in STATS_COLUMNS:
        assert np.allclose(got[c], want[c], atol=1e-9, equal_nan=True), c


def pandas_matrix(s, n, days, horizon):
    frame_ = pd.concat([s.rename("ap"), pandas_stats(s, n)], axis=1)
    out = {f"{c}-{j + 96 * days}": frame_[c].shift(j + 96 * days) for c in frame_ for j in range(n)}
    out.update({f"ap+{k}": s.shift(-k) for k in range(1, horizon + 1)})
    return pd.DataFrame(out).dropna()


@pytest.mark.parametrize("n,days,horizon", [(4, 0, 1), (4, 1, 4), (4, 7, 2), (2, 8, 1), (8, 32, 1)])
def test_matrix_equals_pandas(spark, n, days, horizon):
    pdf = series(3000 + 96 * days)
    got = sorted_pandas(
        features.feature_matrix(frame(spark, pdf), n=n, horizon=horizon, previous_days=days, calendar_on=False), "ts"
    )
    want = pandas_matrix(pdf.set_index("ts")["ap"], n, days, horizon)
    assert len(got) > 2000 and got["ts"].tolist() == want.index.tolist()
    for c in want:
        assert np.allclose(got[c], want[c], atol=1e-8), c


def test_holes_take_their_rows_away(spark):
    pdf = series(400)
    kept = pdf.drop(index=[150, 151, 300])
    got = sorted_pandas(features.feature_matrix(frame(spark, kept), n=3, previous_days=1, calendar_on=False), "ts")
    s = kept.set_index("ts")["ap"].asfreq("15min")
    want = pandas_matrix(s, 3, 1, 1)
    assert got["ts"].tolist() == want.index.tolist()


def test_wanted_features_keep_the_same_rows(spark):
    df = frame(spark, series(500).drop(index=[200]))
    whole = features.feature_matrix(df, n=3)
    some = features.feature_matrix(df, n=3, wanted=["hour-1", "ap-97"])
    assert some.columns == ["etype", "site_id", "ts", "ap-97", "hour-1", "ap+1"]
    a, b = sorted_pandas(whole, "ts"), sorted_pandas(some, "ts")
    pd.testing.assert_frame_equal(a[b.columns.tolist()], b)


def test_matrix_is_one_shuffle_of_the_grid(spark):
    df = features.feature_matrix(frame(spark, series(500)), n=3, regular=True)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("Sort [") == 1


def test_unknown_features_are_an_error(spark):
    with pytest.raises(ValueError, match="missing 1 features"):
        features.feature_matrix(frame(spark, series(300)), n=3, wanted=["ap-1"])
    with pytest.raises(ValueError, match="missing 1 features"):
        features.check_columns(frame(spark, series(3)), ["ap", "zz"])


def test_malformed_targets_are_left_out():
    assert features.target_steps(selected=["ap+4", "bad", "ap+x"]) == {"ap+4": 4}
    assert features.target_steps(3) == {"ap+1": 1, "ap+2": 2, "ap+3": 3}


def test_history_of_a_feature():
    assert features.history_of(["a", "b"], ["a", "a-0", "a-7", "a-8", "b-1"]) == ["a", "a-0", "a-7", "b-1"]


def test_no_feature_sees_a_target(spark):
    pdf = series(400)
    base = sorted_pandas(features.feature_matrix(frame(spark, pdf), n=3, previous_days=0), "ts")
    pdf.loc[350, "ap"] += 1000
    changed = sorted_pandas(features.feature_matrix(frame(spark, pdf), n=3, previous_days=0), "ts")
    before = base["ts"] < pdf["ts"][350]
    names = [c for c in base if not c.startswith("ap+")]
    assert np.allclose(base[before][names[3:]].astype(float), changed[before][names[3:]].astype(float))


def test_naive(spark):
    pdf = series(1500)
    got = sorted_pandas(features.naive(frame(spark, pdf), 96), "ts")
    assert got["p"].tolist() == pdf["ap"][:-96].tolist() and got["y"].tolist() == pdf["ap"][96:].tolist()
