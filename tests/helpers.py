"""Small series for the tests."""

from __future__ import annotations

import numpy as np
import pandas as pd


def series(n, sites=(1,), start="2024-01-01", seed=0, etype="consumption"):
    """Random series of ``n`` 15-minute steps per site, as pandas."""
    rng = np.random.default_rng(seed)
    parts = [
        pd.DataFrame(
            {
                "etype": etype, "site_id": np.int32(s),
                "ts": pd.date_range(start, periods=n, freq="15min"),
                "ap": np.round(rng.gamma(2.0, 20.0, n), 2),
            }
        )
        for s in sites
    ]
    return pd.concat(parts, ignore_index=True)


def frame(spark, pdf):
    """As a Spark frame, NaN becoming null."""
    return spark.createDataFrame(pdf).replace(float("nan"), None)


def sorted_pandas(df, *by):
    return df.toPandas().sort_values(list(by)).reset_index(drop=True)
