import numpy as np
import pandas as pd
import pytest

from meterline.operators.neighbours import knn

FEATURES = ["ap-0", "ap-1", "ap-2"]


def points(n, seed, site=1, hot=0.0):
    rng = np.random.default_rng(seed)
    x = np.round(rng.gamma(2, 20, (n, 3)), 1)
    x[rng.random(n) < hot] = 0.0
    pdf = pd.DataFrame(x, columns=FEATURES)
    pdf["ap+1"] = np.round(rng.random(n) * 10, 2)
    pdf["etype"], pdf["site_id"] = "c", np.int32(site)
    pdf["ts"] = pd.date_range("2024-01-01", periods=n, freq="15min") + pd.Timedelta(days=seed * 1000)
    return pdf


def brute(train, test, k):
    out = []
    for site, rows in test.groupby("site_id"):
        base = train[train.site_id == site]
        b, y = base[FEATURES].to_numpy(), base["ap+1"].to_numpy()
        for ts, point in zip(rows["ts"], rows[FEATURES].to_numpy()):
            d = np.sqrt(((b - point) ** 2).sum(axis=1))
            pick = np.lexsort((y, d))[:k]
            dist, val = d[pick], y[pick]
            p = val[dist == 0].mean() if (dist == 0).any() else (val / dist).sum() / (1 / dist).sum()
            out.append((site, ts, p))
    return pd.DataFrame(out, columns=["site_id", "ts", "p"]).sort_values(["site_id", "ts"]).reset_index(drop=True)


@pytest.mark.parametrize("block,k,hot", [(64, 10, 0.0), (32, 50, 0.35), (2048, 7, 0.1)])
def test_equals_all_pairs(spark, block, k, hot):
    train = pd.concat([points(700, 1, 1, hot), points(120, 2, 2, hot)])
    test = pd.concat([points(150, 3, 1, hot), points(40, 4, 2, hot)])
    got = knn(
        spark.createDataFrame(train), spark.createDataFrame(test), FEATURES, "ap+1", k, block_rows=block
    ).toPandas().sort_values(["site_id", "ts"]).reset_index(drop=True)
    want = brute(train, test, k)
    assert got["ts"].tolist() == want["ts"].tolist()
    assert np.allclose(got["p"], want["p"])


def test_fewer_rows_than_neighbours(spark):
    train, test = points(20, 1), points(15, 2)
    got = knn(spark.createDataFrame(train), spark.createDataFrame(test), FEATURES, "ap+1", 50, block_rows=8)
    want = brute(train, test, 50)
    have = got.toPandas().sort_values("ts").reset_index(drop=True)
    assert np.allclose(have["p"], want["p"])


def test_weights(spark):
    train = points(4, 1)
    train[FEATURES] = [[0, 0, 0], [3, 0, 0], [0, 4, 0], [100, 0, 0]]
    train["ap+1"] = [10.0, 20.0, 30.0, 99.0]
    test = points(2, 2)
    test[FEATURES] = [[0, 0, 0], [6, 0, 0]]
    got = knn(spark.createDataFrame(train), spark.createDataFrame(test), FEATURES, "ap+1", 2)
    a, b = got.toPandas().sort_values("ts")["p"]
    assert a == 10.0 and np.isclose(b, (20 / 3 + 10 / 6) / (1 / 3 + 1 / 6))
