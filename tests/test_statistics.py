"""Tails, quantiles and draws against exact sums and enumeration."""

import itertools
import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from verdara.functions import stats
from verdara.operators import evaluate as E
from verdara.operators import guarantee as G


def exact_tail(k, n, p):
    return float(sum(math.comb(n, j) * Fraction(p) ** j * (1 - Fraction(p)) ** (n - j) for j in range(k + 1)))


@pytest.mark.parametrize("n,p", [(1, 0.5), (7, 0.25), (40, 0.03125), (300, 0.125), (300, 0.875), (2000, 0.5)])
def test_tail_equals_the_sum(n, p):
    k = np.unique(np.linspace(0, n - 1, 25).astype(int))
    made = stats.tail(k, np.full(len(k), n), np.full(len(k), p))
    assert max(abs(a - exact_tail(int(b), n, p)) for a, b in zip(made, k)) < 1e-12


def test_tail_of_many_trials_and_at_the_ends():
    n = 10**11
    value = stats.tail(np.array([n // 20, n // 20 - 68_920]), np.array([n, n]), np.array(0.05))
    assert value == pytest.approx([0.5, 0.158655], abs=1e-4)  # one standard deviation below the mean: 68,920
    assert stats.tail(np.array([0, -1, 5, 3, 3, 3]), np.array([0, 4, 5, 4, 4, 4]), np.array([0.1, 0.1, 0.1, 0.0, 1.0, 0.5])) == pytest.approx([1, 0, 1, 1, 0, 0.9375])
    big = 100_000
    j = np.arange(5_101)
    lg = np.vectorize(math.lgamma)
    total = np.exp(math.lgamma(big + 1) - lg(j + 1) - lg(big - j + 1) + j * math.log(0.05) + (big - j) * math.log(0.95)).sum()
    assert stats.tail(np.array([5_100]), np.array([big]), np.array([0.05]))[0] == pytest.approx(total, abs=1e-9)


def test_quantiles_invert_the_sums():
    u = (np.arange(500) + 0.5) / 500
    for n, p in ((1, 0.3), (30, 0.3), (200, 0.02)):
        cdf = np.cumsum([math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(n + 1)])
        assert (stats.binomial_quantile(u, np.full(500, n), np.full(500, p)) == np.searchsorted(cdf, u)).all()
    for total, marked, drawn in ((50, 20, 25), (9, 9, 4), (12, 5, 0), (12, 5, 12), (300, 290, 150)):
        cdf = np.cumsum([math.comb(marked, i) * math.comb(total - marked, drawn - i) / math.comb(total, drawn) if 0 <= drawn - i <= total - marked else 0 for i in range(marked + 1)])
        want = np.minimum(np.searchsorted(cdf, u * (1 - 1e-12)), marked)
        assert (stats.hypergeometric_quantile(u, np.full(500, total), marked, np.full(500, drawn)) == want).all()


def test_clopper_pearson(spark):
    rows = spark.createDataFrame([(0, 10), (10, 10), (3, 20), (5, 0), (-1, 4), (7, 4), (1, 1)], "k long, n long")
    made = [r["ci"] for r in rows.select(stats.clopper_pearson("k", "n", F.lit(0.05)).alias("ci")).collect()]
    assert (made[0]["low"], made[0]["high"]) == (0, pytest.approx(1 - 0.025**0.1)) and (made[1]["low"], made[1]["high"]) == (pytest.approx(0.025**0.1), 1)
    low, high = made[2]
    assert 1 - exact_tail(2, 20, low) == pytest.approx(0.025, abs=1e-9) and exact_tail(3, 20, high) == pytest.approx(0.025, abs=1e-9)
    assert all(m["low"] is None and m["high"] is None for m in made[3:6]) and made[6]["low"] == pytest.approx(0.025)


def test_draws_of_any_key(spark):
    keys = spark.range(20_000).select(G.draw(F.col("id"), F.lit(3)).alias("u"), G.draw(F.col("id") + 1_000_003, F.lit(3)).alias("v"), G.draw(F.col("id").cast("int"), F.lit(3)).alias("w"), G.draw(F.concat(F.lit("k"), "id"), F.lit(3)).alias("x")).toPandas()
    assert (keys["u"] == keys["w"]).all() and keys.min().min() > 0 and keys.max().max() < 1
    assert np.abs(np.corrcoef(keys[["u", "v", "x"]].T)[np.triu_indices(3, 1)]).max() < 0.03
    assert np.abs(np.histogram(keys["u"], 10, (0, 1))[0] - 2000).max() < 200
    assert keys["u"][7] == stats.uniform(["7:3"])[0]


def halves(rows, eps, delta, n_start, steps):
    """The share of all halves whose threshold has too many wrong on the other half."""
    n, bad, valid = len(rows), 0, 0
    for half in itertools.combinations(range(n), n // 2):
        here, there = [rows[i] for i in half], [r for i, r in enumerate(rows) if i not in half]
        limit = None
        for s in range(steps + 1):
            k = [w for x, w in here if x <= s / steps + 1e-9]
            if len(k) >= n_start:
                if exact_tail(sum(k), len(k), eps) > delta:
                    break
                limit = s
        later = [w for x, w in there if limit is not None and x <= limit / steps + 1e-9]
        if later:
            valid, bad = valid + 1, bad + (sum(later) > eps * len(later))
    return bad / valid, valid / math.comb(n, n // 2)


def test_simulated_violations_meet_the_exact_rate(spark):
    rows = [(i / 12, int(i in (3, 7, 9, 11))) for i in range(12)]
    df = spark.createDataFrame(rows, "risk double, wrong int").unionByName(spark.createDataFrame([(None, 1), (0.5, None)], "risk double, wrong int"))
    made = G.violation(df, 0.4, 0.5, splits=6000, n_start=2, steps=12).first()
    rate, valid = halves(rows, 0.4, 0.5, 2, 12)
    assert 0.05 < rate < 0.95
    assert made["violation_rate"] == pytest.approx(rate, abs=4 * math.sqrt(rate * (1 - rate) / 6000)) and made["certified"] / 6000 == pytest.approx(valid, abs=0.02)
    empty = G.violation(df.limit(0), 0.4, 0.5, splits=10).first()
    assert (empty["certified"], empty["abstained"], empty["violation_rate"]) == (0, 10, None)


def test_paired_bootstrap(spark):
    rng = np.random.default_rng(5)
    a, b = rng.integers(0, 2, 400), rng.random(400).round(1)
    df = spark.createDataFrame([(int(x), float(y)) for x, y in zip(a, b)] + [(None, 0.5)], "a int, b double")
    made = E.paired_bootstrap(df, F.col("a"), F.col("b"), resamples=4000).first()
    d = a - b
    spread = d.std() / 20
    assert made["mean_diff"] == pytest.approx(d.mean()) and made["n"] == 400
    assert made["ci_low"] == pytest.approx(d.mean() - 1.96 * spread, abs=0.15 * spread) and made["ci_high"] == pytest.approx(d.mean() + 1.96 * spread, abs=0.15 * spread)
    none = E.paired_bootstrap(df.limit(0), F.col("a"), F.col("b"), resamples=20).first()
    assert (none["mean_diff"], none["ci_low"], none["n"]) == (None, None, 0)


def test_interval_covers_the_mean(spark):
    rng = np.random.default_rng(8)
    hits = 0
    for _ in range(12):
        df = spark.createDataFrame([(int(x),) for x in rng.random(300) < 0.3], "a int")
        r = E.paired_bootstrap(df, F.col("a"), F.lit(0), resamples=500).first()
        hits += r["ci_low"] <= 0.3 <= r["ci_high"]
    assert hits >= 9


def test_first_fraction_is_exact(spark):
    rows = [(g, i, ((i * 37 + g) % 101) / 101 + 1e-4) for g in range(3) for i in range(40 * g + 5)] + [(9, i, 0.5) for i in range(30)]
    df = spark.createDataFrame(rows, "g long, i long, u double")
    for buckets in (1, 4, 4096):
        made = {tuple(r) for r in G.first_fraction(df, ["g"], "u", F.floor(F.col("n_group") * 0.2), "i", buckets).select("g", "i").collect()}
        want = {(g, i) for g in (0, 1, 2, 9) for _, i in sorted((u, i) for h, i, u in rows if h == g)[: sum(h == g for h, _, _ in rows) // 5]}
        assert made == want


def test_weighted_sample(spark):
    rows = spark.range(3000).selectExpr("id", "id % 2 AS g", "CASE WHEN id % 6 < 2 THEN 3.0 ELSE 1.0 END AS w").unionByName(spark.createDataFrame([(9000, 0, 0.0), (9001, 0, None)], "id long, g long, w double"))
    drawn = [r for seed in range(3) for r in G.weighted_sample(rows, ["g"], "w", "id", seed).collect()]
    sizes = {g: sum(r["g"] == g for r in drawn) / 3 for g in (0, 1)}
    w = [3.0] * 500 + [1.0] * 1000
    assert sizes == {0: math.floor(sum(w) ** 2 / sum(x * x for x in w)), 1: math.floor(sum(w) ** 2 / sum(x * x for x in w))}
    heavy, light = (sum(r["w"] == x for r in drawn) / 3 / n for x, n in ((3.0, 1000), (1.0, 2000)))
    # Without replacement: shares 1 - exp(-3 t) and 1 - exp(-t), with t such that the sizes add up
    t = next(x / 1000 for x in range(1, 5000) if 500 * (1 - math.exp(-3 * x / 1000)) + 1000 * (1 - math.exp(-x / 1000)) >= sizes[0])
    assert heavy == pytest.approx(1 - math.exp(-3 * t), abs=0.03) and light == pytest.approx(1 - math.exp(-t), abs=0.03)
