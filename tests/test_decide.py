import itertools
import math

import numpy as np
import pytest

from meterline.operators import decide

# Last forecasts of the groups and the stored optimum.
CONSUMPTION = [78775.328125, 18236.072265625, 12855.1435546875, 39859.67578125, 19383.263671875, 34481.7109375, 679.9627685546875]
PRODUCTION = [11645.83203125, -950.043212890625, 1295.77197265625, 493.9922790527344, 547.234619140625, 16477.8125]
OPTIMUM = 30460.64340209961


def groups(spark, values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values, start=1)], "site_id int, value double")


def test_stored_optimum(spark):
    allocated = decide.allocate(groups(spark, CONSUMPTION), groups(spark, PRODUCTION))
    names = spark.createDataFrame([(i, 0, f"g{i}") for i in range(1, 7)], "site_id int, pos int, site_key string")
    report = decide.allocation_report(allocated, names)
    rows = {r.site_id: r for r in report.collect()}
    assert math.isclose(sum(r.total_production_optimized for r in rows.values()), OPTIMUM, rel_tol=1e-12)
    assert [i for i, r in rows.items() if r.n_sites_disabled] == [2] and rows[2].disabled_sites == ["g2"]
    totals = decide.allocation_totals(report).first()
    assert (totals.n_sites_active, totals.n_sites_disabled, totals.n_errors) == (5, 1, 0)


def test_edges(spark):
    cons, prod = groups(spark, [-1.0, 0.0, 5.0, 5.0]), groups(spark, [3.0, 3.0, 0.0, 9.0, 4.0])
    rows = {r.site_id: (r.status, r.p, r.active) for r in decide.allocate(cons, prod).collect()}
    assert rows == {
        1: ("infeasible", None, None), 2: ("success", 0.0, False), 3: ("success", 0.0, False),
        4: ("success", 5.0, True), 5: ("missing_input", None, None),
    }


def test_pairing(spark):
    pairing = spark.createDataFrame([(1, 7), (2, 99)], "site_id int, consumption_id int")
    rows = {r.site_id: r.p for r in decide.allocate(groups(spark, CONSUMPTION), groups(spark, PRODUCTION), pairing).collect()}
    assert rows == {1: CONSUMPTION[6], 2: None}


@pytest.mark.parametrize("rows,want", [([("2024-01-01", "5.5"), ("2024-01-02", "7")], 7.0), ([("2024-01-01", "5.5"), ("2024-01-02", "n/a")], 0.0),
                                       ([("2024-01-01", "-3")], 0.0), ([], 0.0)])
def test_latest_demand(spark, rows, want):
    df = spark.createDataFrame(rows, "ts string, power_w string")
    assert decide.latest_demand(df).first().power_w == want


def shed_row(spark, values, cap):
    prod = spark.createDataFrame([("t", i, float(v)) for i, v in enumerate(values)], "ts string, site_id int, p double")
    caps = spark.createDataFrame([("t", float(cap))], "ts string, cap double")
    return decide.shed(prod, caps).first()


def test_shed(spark):
    row = shed_row(spark, [5, 3, 8, 2, 7, 1], 13)
    assert row.kept_sum == 13.0 and row.kept == [0, 2] and row.shed == [1, 3, 4, 5] and row.violation
    free = shed_row(spark, [5, 3], 13)
    assert free.kept == [0, 1] and free.shed == [] and not free.violation
    none = shed_row(spark, [5, 3], -1)
    assert none.kept_sum is None and none.kept == [] and none.shed == [0, 1]


@pytest.mark.parametrize("n", [4, 10, 12, 13, 16])
def test_shed_equals_all_subsets(spark, n):
    rng = np.random.default_rng(n)
    values = rng.integers(-5, 60, n).astype(float)
    cap = float(rng.integers(0, int(abs(values).sum())))
    row = shed_row(spark, values, cap)
    best = max(
        (sum(c) for k in range(n + 1) for c in itertools.combinations(values, k) if sum(c) <= cap), default=None
    )
    assert row.kept_sum == best and sum(values[i] for i in row.kept) == best


def test_many_sites():
    total, pick = decide.best_subset(list(range(1, 61)), 917)
    assert total == 917 and sum(p + 1 for p in pick) == 917
    assert decide.best_subset([4], -1) == (None, [])
    assert decide.best_subset([4, -3], 1) == (1, [0, 1])


@pytest.mark.parametrize("n", [4, 12, 13, 40])
def test_ties_go_to_the_smallest_mask_whatever_the_number_of_sites(spark, n):
    row = shed_row(spark, [1, 1, 1, 1] + [0] * (n - 4), 2)
    assert row.kept == [0, 1] and row.shed == list(range(2, n)) and row.kept_sum == 2.0