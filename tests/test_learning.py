"""Logistic fits of many models at once, ablation, model choice and calibration against plain loops."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from verdara.operators import learning as L


def single_fit(x, y, w, c=1.0):
    """One penalised logistic regression by gradient and curvature over all rows."""
    x = np.column_stack([np.ones(len(y)), x])
    beta, penalty = np.zeros(x.shape[1]), np.diag([0.0] + [1.0] * (x.shape[1] - 1))
    for _ in range(100):
        p = 1 / (1 + np.exp(-x @ beta))
        beta = beta + np.linalg.solve(c * (x * (w * p * (1 - p))[:, None]).T @ x + penalty, c * x.T @ (w * (y - p)) - penalty @ beta)
    return beta


@pytest.fixture(scope="module")
def sample(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(900, 3))
    y = (rng.random(900) < 1 / (1 + np.exp(-(2 * x[:, 0] - x[:, 1] - 0.7)))).astype(int)
    rows = [(float(a), float(b), float(c), int(t), i) for i, ((a, b, c), t) in enumerate(zip(x, y))] + [(1.0, 1.0, 1.0, None, 900), (float("nan"), 0.0, 0.0, 1, 901), (None, 0.0, 0.0, 0, 902)]
    return x, y, spark.createDataFrame(rows, "a double, b double, c double, wrong int, id int").repartition(5)


@pytest.mark.parametrize("evenly", [True, False])
def test_models_fitted_together_equal_single_ones(sample, evenly):
    x, y, rows = sample
    w = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum()))) if evenly else np.ones(len(y))
    fits = L.logistic_fits(rows, ["a", "b", "c"], "wrong", {"none": [], "a": ["a"], "bc": ["b", "c"]}, evenly=evenly)
    for name, kept in (("none", [0, 1, 2]), ("a", [1, 2]), ("bc", [0])):
        expected = np.zeros(4)
        expected[[0, *(i + 1 for i in kept)]] = single_fit(x[:, kept], y, w)
        assert list(fits[name].values()) == pytest.approx(expected.tolist(), abs=1e-6)


def test_separable_rows_and_one_label(spark):
    rows = spark.createDataFrame([(float(i), int(i > 5)) for i in range(11)], "a double, wrong int")
    fit = L.logistic_fits(rows, ["a"], "wrong", {"all": []}, c=1e6)["all"]
    assert fit["a"] > 0 and -fit[""] / fit["a"] == pytest.approx(5.5, abs=0.1)
    for part in (rows.where("wrong = 1"), rows.limit(0)):
        with pytest.raises(ValueError):
            L.logistic_fits(part, ["a"], "wrong", {"all": []})


def test_area_counts_pairs(spark):
    rng = np.random.default_rng(1)
    rows = [(int(rng.random() < 0.3), float(np.round(rng.random(), 2)), "xy"[i % 2]) for i in range(400)] + [(1, 0.5, "z"), (None, 0.1, "x")]
    made = {r["g"]: r["auroc"] for r in L.area(spark.createDataFrame(rows, "wrong int, s double, g string"), ["g"], "wrong", "s").collect()}
    for g in "xy":
        pos, neg = ([s for t, s, k in rows if k == g and t == v] for v in (1, 0))
        assert made[g] == pytest.approx(np.mean([(p > n) + (p == n) / 2 for p in pos for n in neg]))
    assert made["z"] is None and L.area(spark.createDataFrame(rows, "wrong int, s double, g string").limit(0), ["g"], "wrong", "s").count() == 0


def test_ablation_finds_the_signal(sample):
    *_, rows = sample
    sound = rows.where("a IS NOT NULL AND NOT isnan(a)")
    made = {r["dropped"]: r for r in L.ablation(sound.where("id % 3 > 0"), sound.where("id % 3 = 0"), ["a", "b", "c"], "wrong", {x: [x] for x in "abc"}).collect()}
    assert set(made) == {"none", "a", "b", "c"} and made["none"]["lost"] == 0
    assert made["a"]["lost"] > made["b"]["lost"] > abs(made["c"]["lost"]) and made["none"]["n"] == 300


def test_the_better_model_is_kept(sample, spark):
    *_, rows = sample
    sound = rows.where("a IS NOT NULL AND NOT isnan(a) AND wrong IS NOT NULL")
    even = sound.withColumn("wrong", (F.abs("a") > 0.7).cast("int"))  # no line separates these
    for part, best in ((sound, "logistic"), (even, "trees")):
        name, model, found = L.train_best(part.where("id % 3 > 0"), part.where("id % 3 = 0"), ["a", "b", "c"], "wrong", n_trees=5)
        assert name == best == max(found, key=found.get)
        assert L.scored(model, part).where("raw_risk BETWEEN 0 AND 1").count() == part.count()


def test_platt_is_a_rising_curve(spark):
    rng = np.random.default_rng(2)
    raw = rng.random(2000)
    rows = spark.createDataFrame([(float(r), int(rng.random() < r * r)) for r in raw], "raw_risk double, wrong int")
    made = L.platt(rows, rows, "wrong").orderBy("raw_risk").collect()
    risks = [r["risk"] for r in made]
    assert risks == sorted(risks) and np.mean(risks) == pytest.approx(np.mean([r["wrong"] for r in made]), abs=0.005)
