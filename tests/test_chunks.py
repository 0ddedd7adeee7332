import numpy as np
import pandas as pd
import pytest

from helpers import frame, series, sorted_pandas
from meterline.operators.chunks import exact_quantiles, fill, ranked_values, with_position


def test_positions_over_many_chunks_and_gaps(spark):
    pdf = series(4000, sites=(1, 2))
    pdf = pdf.drop(pdf.index[1000:3500]).reset_index(drop=True)
    got = sorted_pandas(with_position(frame(spark, pdf)), "site_id", "ts")
    want = pdf.groupby("site_id").cumcount()
    assert got["pos"].tolist() == want.tolist()
    assert got["n"].tolist() == pdf.groupby("site_id")["ts"].transform("size").tolist()


@pytest.mark.parametrize("how", ["both", "forward", "backward"])
def test_fill_over_gaps_longer_than_a_chunk(spark, how):
    pdf = series(5000, sites=(1, 2))
    holes = np.ones(len(pdf), bool)
    holes[[700, 701, 4200, 5500]] = False
    pdf.loc[holes, "ap"] = np.nan
    got = sorted_pandas(fill(frame(spark, pdf), ["ap"], how=how), "site_id", "ts")
    by = pdf.groupby("site_id")["ap"]
    want = {
        "forward": by.ffill(), "backward": by.bfill(), "both": by.transform(lambda s: s.ffill().bfill()),
    }[how]
    pd.testing.assert_series_equal(got["ap"], want, check_names=False)


def test_quantiles_with_a_value_that_holds_a_third_of_the_rows(spark):
    rng = np.random.default_rng(1)
    values = np.where(rng.random(9001) < 1 / 3, 0.0, np.round(rng.lognormal(3, 2, 9001), 2))
    df = spark.createDataFrame(pd.DataFrame({"k": 1, "v": values}))
    row = exact_quantiles(df, ["k"], "v", {"a": 0.25, "b": 0.5, "c": 0.75, "d": 0.999}).first()
    assert np.allclose([row.a, row.b, row.c, row.d], np.quantile(values, [0.25, 0.5, 0.75, 0.999]), atol=1e-9)


def test_quantiles_of_one_row_and_of_equal_values(spark):
    df = spark.createDataFrame([("a", 3.0), ("b", 5.0), ("b", 5.0)], "k string, v double")
    got = {r.k: (r.lo, r.mid) for r in exact_quantiles(df, ["k"], "v", {"lo": 0.25, "mid": 0.5}).collect()}
    assert got == {"a": (3.0, 3.0), "b": (5.0, 5.0)}


def test_ranks_without_a_key(spark):
    df = spark.createDataFrame([(v,) for v in [4.0, 1.0, 4.0, 9.0]], "v double")
    got = {r.v: (r.cnt, r.below, r.total) for r in ranked_values(df, [], "v").collect()}
    assert got == {1.0: (1, 0, 4), 4.0: (2, 1, 4), 9.0: (1, 3, 4)}


def test_positions_do_not_window_over_a_whole_series(spark):
    plan = with_position(frame(spark, series(200)))._jdf.queryExecution().optimizedPlan().toString()
    numbered = [line for line in plan.splitlines() if "row_number()" in line]
    assert numbered and all("_chunk" in line for line in numbered)
