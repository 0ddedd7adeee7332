import pytest
from pyspark.sql import functions as F

from helpers import frame, series, sorted_pandas
from meterline.operators import samples, splits


def blocks(rows, name):
    return rows[rows["split"] == name].index.tolist()


@pytest.mark.parametrize("n", [10, 11, 19, 20, 2900])
def test_ratio_split(spark, n):
    df = frame(spark, series(n))
    a, b, c = int(n * 0.8), int(n * 0.1), int(n * 0.9)
    sizes = sorted_pandas(splits.ratio_split(df), "ts")
    assert blocks(sizes, "train") == list(range(a))
    assert blocks(sizes, "val") == list(range(a, a + b))
    assert blocks(sizes, "test") == list(range(n - b, n))
    cuts = sorted_pandas(splits.ratio_split(df, mode="cuts"), "ts")
    assert blocks(cuts, "val") == list(range(a, c)) and blocks(cuts, "test") == list(range(c, n))
    assert splits.held_out(df).count() == n - c


def test_split_goes_by_position_not_by_time(spark):
    pdf = series(1000).drop(index=range(300, 700)).reset_index(drop=True)
    got = sorted_pandas(splits.ratio_split(frame(spark, pdf)), "ts")
    assert blocks(got, "train") == list(range(480))


def test_kfold(spark):
    n, k = 100, 10
    df = frame(spark, series(n))
    got = sorted_pandas(splits.kfold(df, k), "fold", "ts")
    size = (80 + 10) // k
    for fold in range(k):
        mine = got[got["fold"] == fold]
        pos = {t: i for i, t in enumerate(series(n)["ts"])}
        part = lambda p: [pos[t] for t in mine[mine["part"] == p]["ts"]]
        assert part("train") == list(range(size * (fold + 1)))
        assert part("val") == list(range(size * (fold + 1), size * (fold + 2)))
    assert got[(got["fold"] == 9) & (got["part"] == "val")]["ts"].max() >= series(n)["ts"][90]
    capped = splits.kfold(df, k, cap_at_test=True).agg(F.max("fold"), F.max("ts")).first()
    assert capped[0] == k - 2 and capped[1] < series(n)["ts"][90].to_pydatetime()


def test_kfold_bounds_agree_with_rows(spark):
    df = frame(spark, series(1500, sites=(1, 2)))
    rows = splits.kfold(df, 7).groupBy("etype", "site_id", "fold", "part").agg(
        F.min("ts").alias("start"), F.max("ts").alias("stop"), F.count(F.lit(1)).alias("n")
    )
    bounds = splits.kfold_bounds(df, 7).select(*rows.columns)
    assert rows.exceptAll(bounds).isEmpty() and bounds.exceptAll(rows).isEmpty()


@pytest.mark.parametrize("n,size", [(100, 30), (90, 30), (31, 30), (30, 30)])
def test_expanding_folds(spark, n, size):
    got = sorted_pandas(splits.expanding_folds(frame(spark, series(n)), size), "fold", "ts")
    want, i = [], 0
    while size * (i + 1) < n:
        want.append((size * (i + 1), min(size, n - size * (i + 1))))
        i += 1
    have = [
        ((got[got["fold"] == f]["part"] == "train").sum(), (got[got["fold"] == f]["part"] == "val").sum())
        for f in sorted(got["fold"].unique())
    ]
    assert have == want


def test_every_nth_and_slices(spark):
    pdf = series(1500)
    df = frame(spark, pdf)
    assert sorted_pandas(samples.every_nth(df, 7), "ts")["ts"].tolist() == pdf["ts"][::7].tolist()
    assert samples.slices(df, 96, drop_short=True).count() == 1500 // 96 * 96
    assert samples.slices(df, 672).select("slice").distinct().count() == 3


@pytest.mark.parametrize("days,step,lag", [(0, 1, 0), (1, 3, 2)])
def test_windows(spark, days, step, lag):
    n, seq, out = 1600, 5, 2
    pdf = series(n)
    pdf["z"] = range(n)
    got = sorted_pandas(samples.windows(frame(spark, pdf), seq, out, ["ap"], ["z"], lag, days, step), "pos")
    shift, need = 96 * days, seq + out + lag + 96 * days
    starts = list(range(shift, shift + ((n - need) // step + 1) * step, step))
    assert got["pos"].tolist() == starts
    for i in (0, len(starts) // 2, len(starts) - 1):
        s = starts[i]
        assert [v[0] for v in got["x_past"][i]] == pdf["ap"][s - shift: s - shift + seq].tolist()
        assert [v[0] for v in got["x_now"][i]] == pdf["z"][s: s + seq].tolist()
        assert list(got["y"][i]) == pdf["ap"][s + seq + lag: s + seq + lag + out].tolist()


def test_windows_over_a_removed_period(spark):
    pdf = series(60).drop(index=range(20, 30)).reset_index(drop=True)
    df = frame(spark, pdf)
    assert samples.windows(df, 4, 1).count() == 46
    assert samples.windows(df, 4, 1, gap_safe=True).count() == 46 - 4
