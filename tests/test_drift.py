"""Drift experiment and exact quantiles: empty sides, rows without days, ties, one value."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from verdara.operators import certify as C
from verdara.operators import guarantee as G

SCHEMA = "atom long, risk double, wrong int, day date"
START = dt.date(2024, 1, 1)


def side(spark, n, shift, dated=True, first=0):
    rows = [(first + i, ((i * 37) % 100) / 100, int((i * 53) % 100 < shift * ((i * 37) % 100)), START + dt.timedelta(days=first // 10 + i // 10) if dated else None) for i in range(n)]
    return spark.createDataFrame(rows, SCHEMA)


def four(spark, pre, post, **how):
    rows = {r["strategy"]: r for r in C.drift_strategies(pre, post, "2024-02-01", 0.2, months=1, splits=60, **how).collect()}
    assert sorted(rows) == ["recency_weighted", "sliding_window", "static", "triggered"]
    return rows


def test_trigger_follows_the_violation_rate(spark):
    pre, post = side(spark, 310, 0.2), side(spark, 310, 0.9, first=310)
    bad = four(spark, pre, post)
    assert bad["static"]["violation_rate"] > 0.9 and bad["triggered"]["recalibrated"]
    assert bad["triggered"]["threshold"] == bad["sliding_window"]["threshold"] and bad["triggered"]["n_calibration"] == bad["sliding_window"]["n_calibration"] < 310
    good = four(spark, pre, side(spark, 310, 0.1, first=310))
    assert good["static"]["violation_rate"] == 0 and not good["triggered"]["recalibrated"]
    assert good["triggered"]["threshold"] == good["static"]["threshold"] and good["static"]["status"] == "computed"
    assert C.best_strategy(spark.createDataFrame(list(good.values())), 0.1).first()["best"] == "static"


def test_sides_without_rows_or_days(spark):
    some, none = side(spark, 200, 0.3), side(spark, 0, 0.3)
    for pre, post in ((none, some), (some, none), (none, none)):
        rows = four(spark, pre, post)
        assert all(r["status"] == "not_certifiable" and r["violation_rate"] is None and not (r["recalibrated"] and r["strategy"] == "triggered") for r in rows.values())
    undated = four(spark, side(spark, 201, 0.3, dated=False), some)
    assert undated["sliding_window"]["n_calibration"] == 101 and undated["static"]["n_calibration"] == 201
    old = four(spark, side(spark, 200, 0.3).withColumn("day", F.lit("2020-01-01").cast("date")), some)
    assert old["sliding_window"]["n_calibration"] == 200


@pytest.mark.parametrize("buckets", [1, 7, 4096])
def test_quantiles_equal_the_sorted_list(spark, buckets):
    rng = np.random.default_rng(2)
    groups = {"a": rng.random(500).round(2), "b": np.full(40, 3.0), "c": np.array([5.0]), "d": rng.standard_normal(333) * 1e6, "e": np.array([0.0, 1e-9, 1.0])}
    rows = [(g, float(v)) for g, values in groups.items() for v in values] + [("a", None), ("z", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    shares = [0.0, 0.1, 0.25, 0.5, 0.8, 1.0]
    made = {(r["g"], r["share"]): r["q"] for r in G.quantiles(df, ["g"], "v", shares, buckets).collect()}
    assert made == {(g, s): pytest.approx(float(np.quantile(v, s)), rel=1e-12, abs=1e-12) for g, v in groups.items() for s in shares}
    assert [r["q"] for r in G.quantiles(df, [], "v", [0.5], buckets).collect()] == [pytest.approx(float(np.median(np.concatenate(list(groups.values())))))]
    assert G.quantiles(df.limit(0), ["g"], "v", [0.5], buckets).count() == 0


def test_triggering_share_of_halves_meets_enumeration(spark):
    import itertools

    rows, wrong, accepted, eps = range(10), {0, 1, 2}, {0, 1, 2, 3, 4, 5}, 0.5
    halves = list(itertools.combinations(rows, 5))
    rate = np.mean([len(wrong & set(h)) > eps * len(accepted & set(h)) for h in halves])
    made = spark.createDataFrame([(3, 6, 10, eps, 4000)], "k int, n int, t int, eps double, s int").select(C.half_violations("k", "n", "t", "eps", "s").alias("p")).first()["p"]
    assert made == pytest.approx(rate, abs=0.03)
