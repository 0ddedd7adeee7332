"""Hard negatives against plain inner products."""

import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from meterline.llm import negatives as N

SCHEMA = "vec_id long, embedding array<float>, label int, rank string, anchor string"


def brute(rows):
    whole = [(i, label, [math.floor(256 * x) for x in v]) for i, v, label in rows
             if label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    found = []
    for anchor, label, v in whole:
        if anchor is None or anchor % 50:
            continue
        ranked = sorted(((-sum(a * b for a, b in zip(v, w, strict=False)), i is None, i or 0, other) for i, other, w in whole))
        positives = [(i if not missing else None, -s) for s, missing, i, other in ranked if other == label and (missing or i != anchor)][:5]
        for positive, score in positives:
            mine = [(i if not missing else None, -s) for s, missing, i, other in ranked
                    if other != label and 50 * score <= -100 * s <= 95 * score][:3]
            found += [(anchor, positive, k, i, score, s) for k, (i, s) in enumerate(mine, 1)]
    return sorted(found, key=repr)


def got(spark, rows, **options):
    table = spark.createDataFrame([(*r, "extra", "extra") for r in rows], SCHEMA).repartition(3)
    return sorted((tuple(r) for r in N.hard_negatives(table, F.col("vec_id") % 50 == 0, **options).collect()), key=repr)


def test_scores_are_exact():
    rng = np.random.default_rng(3)
    for size, width in ((0.1, 64), (4.0, 13), (3e4, 7), (1e18, 9)):
        values = [rng.normal(0, size, width).tolist() for _ in range(70)]
        whole = N.integers(pa.array(values, pa.list_(pa.float64())))
        exact = whole.astype(object) @ whole.astype(object).T
        for some, these, found in N.blocks(whole, whole):
            assert (found == exact[some, these]).all()


@pytest.mark.parametrize("each_round", [16_384, 7])
def test_against_brute_force(spark, each_round):
    rng = np.random.default_rng(4)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(0, 0.3, 12)], int(rng.integers(3))) for i in range(900)]
    rows += [(50, rows[50][1], rows[50][2])] + rows[100:130] + [
        (None, rows[0][1], 0), (None, rows[1][1], 1), (950, None, 1), (1000, [1.0, None], 1), (1050, [float("nan")], 1),
        (1100, [float("inf")], 0), (1150, [1.0], None), (1200, [], 1), (1250, [0.5, 0.25], 1), (1300, [2.0] * 20, 2)]
    assert got(spark, rows, each_round=each_round) == brute(rows)


def test_ties_and_empty(spark):
    rows = [(i, [1.0, 0.0], i % 2) for i in range(60)] + [(i, [0.75, 0.0], 1 - i % 2) for i in range(60, 90)]
    assert got(spark, rows) == brute(rows) and len(got(spark, rows)) > 0
    assert got(spark, rows[1:50]) == [] and got(spark, []) == []
