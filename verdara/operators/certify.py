"""Certification of thresholds per stratum, and drift: grids, pairs, merging, windows, triggers, strategies."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from verdara.functions.stats import binomial_tail
from verdara.functions import stats
from verdara.operators.guarantee import accepted_from, cumulative, ltt, min_accepted, quantiles, recency_weight

LEAST_SIDE = 5


def hb_pvalue(k: str, n: str, eps: float) -> Column:
    """Hoeffding-Bentkus p-value; 1 without rows."""
    return F.when(F.col(n) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.lit(math.e) * binomial_tail(k, n, F.lit(eps))))


def quantile_grid(rows: DataFrame, by: list[str], steps: int = 20, risk: str = "risk") -> DataFrame:
    """``by, lam``: distinct quantiles of the risk, within 0 and 1; the grid adapts to where the rows are."""
    shares = [i / steps for i in range(steps + 1)]
    lam = F.round(F.least(F.greatest("q", F.lit(0.0)), F.lit(1.0)), 6).alias("lam")
    return quantiles(rows, by, risk, shares).select(*by, lam).distinct()


def strata(rows: DataFrame, by: list[str]) -> DataFrame:
    """Size and empirical risk of each stratum, and the share of delta it gets when all are certified at once."""
    sizes = rows.groupBy(*by).agg(F.count("*").alias("n"), F.avg("wrong").alias("risk"))
    return sizes.withColumn("n_strata", F.count("*").over(Window.partitionBy()))  # one row a stratum


def bonferroni(delta: float) -> Column:
    return F.lit(delta) / F.col("n_strata")


def merge_targets(sizes: dict[str, int], least: int) -> dict[str, str]:
    """The stratum each stratum's rows go to: itself if large enough, else the narrowest wildcard that becomes so, else ``*|*``.

    Strata are visited by name and what has been merged counts for later ones, so this runs on the
    counts (one a stratum) on the driver.
    """
    held, target = dict(sizes), {}
    for name in sorted(sizes):
        if sizes[name] >= least:
            target[name] = name
            continue
        wider = f"*|{name.split('|')[1]}"
        goal = wider if wider != name and held.get(wider, 0) + sizes[name] >= least else "*|*"
        held[goal] = held.get(goal, 0) + sizes[name]
        target[name] = goal
    return target


def merged_strata(rows: DataFrame, least: int) -> DataFrame:
    """``rows(stratum, ...)`` with ``merged``; the map of strata, a fixed small set, is joined back."""
    sizes = {r["stratum"]: r["n"] for r in rows.groupBy("stratum").agg(F.count("*").alias("n")).collect()}
    target = rows.sparkSession.createDataFrame(sorted(merge_targets(sizes, least).items()), "stratum string, merged string")
    return rows.join(F.broadcast(target), "stratum")


def threshold_pairs(rows: DataFrame, by: list[str], eps: float, delta: float, budget: float = 0.8, n_start: int = 50) -> DataFrame:
    """Certified acceptance limit and, from a quantile of the risk, the limit above which no judge is asked; the second stays above the first."""
    limits = ltt(rows, by, eps, delta, n_start)
    above = quantiles(rows, by, "risk", [budget]).drop("share")
    clamped = F.when(F.col("accept_below") >= F.col("q"), F.least(F.lit(1.0), F.col("accept_below") + 1e-6)).otherwise(F.col("q"))
    return limits.join(above, by).select(*by, "accept_below", clamped.alias("abstain_above"))


def certify(calibration: DataFrame, test: DataFrame, by: list[str], eps: float, delta: float, n_start: int = 50) -> DataFrame:
    """A row per stratum: size, both limits, whether certified and why not, and risk and coverage on the untouched test rows."""
    sizes = strata(calibration, by).select(*by, "n", F.col("risk").alias("calibration_risk"))
    limits = sizes.join(threshold_pairs(calibration, by, eps, delta, n_start=n_start), by)
    joined = test.select(*by, "risk", "wrong").join(F.broadcast(limits.select(*by, "accept_below")), by)  # one row a stratum
    taken = F.col("risk") <= F.col("accept_below")
    seen = joined.groupBy(*by).agg(F.count("*").alias("n_test"), F.try_divide(F.sum(F.when(taken, F.col("wrong"))), F.count_if(taken)).alias("test_risk"), F.try_divide(F.count_if(taken), F.count("*")).alias("test_coverage"))
    status = F.when(F.col("accept_below").isNotNull(), "certified").when(F.col("n") < min_accepted(eps, delta), "too_few_rows").otherwise("not_certifiable")
    return limits.join(seen, by, "left").withColumn("status", status)


def sliding_window(rows: DataFrame, day: str, reference: Column, months: int) -> DataFrame:
    """Rows of the last months (30 days each) before the reference; rows without a day stay."""
    return rows.where(F.col(day).isNull() | (F.col(day) >= F.date_sub(reference, 30 * months)))


def drift_window(rows: DataFrame, day: str, cut: str, months: int, order: str) -> DataFrame:
    """The window of the drift experiment: the last months (30 days each) before the cut; where no row has a day,
    the second half of the rows by ``order``; where the window is empty, all rows. Everything is decided inside the plan."""
    known = F.col(day) >= F.date_sub(F.lit(cut).cast("date"), 30 * months)
    held = rows.agg(F.count(day).alias("_dated"), F.count_if(known).alias("_inside"))  # one row
    rank = quantiles(rows.withColumn("_o", F.col(order).cast("double")), [], "_o", [0.5]).select(F.col("q").alias("_middle"))
    fits = F.when(F.col("_dated") == 0, F.col(order) >= F.coalesce("_middle", F.col(order))).when(F.col("_inside") == 0, True).otherwise(known)
    return rows.join(F.broadcast(held)).join(F.broadcast(rank), F.lit(True), "left").where(fits).select(*rows.columns)


def triggered(strata_: DataFrame, events: DataFrame, since: str) -> DataFrame:
    """Strata for which an event since a day is of their regulator or of all; events are counted per regulator first."""
    recent = events.where(F.col("day") >= F.lit(since).cast("date")).select("regulator").distinct()  # the regulators, a fixed set
    return strata_.join(F.broadcast(recent.withColumnRenamed("regulator", "of")), (F.col("of") == F.col("regulator")) | (F.col("of") == "*"), "left_semi")


def ks_test(rows: DataFrame, by: list[str], recent: Column, value: str, digits: int = 2) -> DataFrame:
    """Two-sample distance of values rounded to ``digits``, and its asymptotic p-value; (0, 1) with under five rows on a side."""
    hist = rows.groupBy(*by, F.round(value, digits).alias("v")).agg(F.count_if(~recent).alias("a"), F.count_if(recent).alias("b"))
    w, whole = Window.partitionBy(*by).orderBy("v"), Window.partitionBy(*by)
    run = hist.withColumns({"na": F.sum("a").over(whole), "nb": F.sum("b").over(whole)})
    run = run.withColumn("gap", F.abs(F.try_divide(F.sum("a").over(w), F.col("na")) - F.try_divide(F.sum("b").over(w), F.col("nb"))))
    few = (F.col("n_a") < LEAST_SIDE) | (F.col("n_b") < LEAST_SIDE)
    made = run.groupBy(*by).agg(F.max("na").alias("n_a"), F.max("nb").alias("n_b"), F.max("gap").alias("gap"))
    x = F.col("n_a") * F.col("n_b") / (F.col("n_a") + F.col("n_b")) * F.col("gap") * F.col("gap")
    tail = 2 * F.aggregate(F.sequence(F.lit(1), F.lit(100)), F.lit(0.0), lambda t, j: t + F.when(j % 2 == 1, 1.0).otherwise(-1.0) * F.exp(-2.0 * j * j * x))
    p = F.when(x < 0.02, 1.0).otherwise(F.least(F.greatest(tail, F.lit(0.0)), F.lit(1.0)))
    return made.select(*by, "n_a", "n_b", F.when(few, 0.0).otherwise(F.col("gap")).alias("ks"), F.when(few, 1.0).otherwise(p).alias("p"))


def tuned_weighted(rows: DataFrame, by: list[str], eps: float, weight: str = "w", steps: int = 200) -> DataFrame:
    """The largest threshold of the grid at which the weighted share of wrong rows is at most ``eps``."""
    cells = rows.groupBy(*by, accepted_from(F.col("risk"), steps).alias("step")).agg(F.sum(weight).alias("n"), F.sum(F.col(weight) * F.col("wrong")).alias("k"))
    w = Window.partitionBy(*by).orderBy("step")
    run = cells.withColumns({"n": F.sum("n").over(w), "k": F.sum("k").over(w), "next": F.lead("step").over(w)})
    met = run.where((F.col("n") > 0) & (F.col("k") <= eps * F.col("n")))
    last = F.coalesce(F.col("next") - 1, F.lit(steps))  # the sums hold up to the step before the next cell
    return rows.select(*by).distinct().join(met.groupBy(*by).agg((F.max(last) / steps).alias("threshold")), by, "left")


@F.pandas_udf(DoubleType())
def half_violations(k: pd.Series, n: pd.Series, total: pd.Series, eps: pd.Series, splits: pd.Series) -> pd.Series:
    """Share of random halves of ``total`` rows whose accepted ones, k wrong among n in all, have more than ``eps`` wrong."""
    out = []
    for wrong, accepted, size, bound, times in zip(k, n, total, eps, splits, strict=True):
        ids = range(int(times))
        left = np.full(len(ids), int(size), np.int64)
        half = left - left // 2
        x = stats.hypergeometric_quantile(stats.uniform([f"wrong:{i}" for i in ids]), left, int(wrong), half)
        y = stats.hypergeometric_quantile(stats.uniform([f"right:{i}" for i in ids]), left - int(wrong), int(accepted - wrong), half - x)
        out.append(float(np.mean((x + y > 0) & (x > bound * (x + y)))))
    return pd.Series(out, dtype=float)


def drift_strategies(pre: DataFrame, post: DataFrame, cut: str, eps: float, delta: float = 0.1, months: int = 6, half_life: float = 180.0, order: str = "atom", points: int = 200, splits: int = 200, least: int = 150) -> DataFrame:
    """Four ways to set a threshold before a change, judged by the rows after it; ``pre`` and ``post`` hold ``risk, wrong, day`` and ``order``.

    All earlier rows (static), a sliding window, recency weights, and the window only if the static threshold is violated in more
    than ``delta`` of random halves of the later rows (triggered). A threshold is the largest of ``points`` evenly spaced ones at which
    the (weighted) share of wrong rows is at most ``eps``, 0 if none is. There are always four rows: without earlier or later rows
    the figures are NULL. ``error`` is 1 where nothing is accepted; sides under ``least`` rows aren't certifiable.
    """
    spark, steps = pre.sparkSession, points - 1
    weight = F.greatest(F.coalesce(recency_weight(F.col("day"), F.lit(cut).cast("date"), half_life), F.lit(1.0)), F.lit(1e-6))
    parts = {"static": pre.withColumn("w", F.lit(1.0)), "sliding_window": drift_window(pre, "day", cut, months, order).withColumn("w", F.lit(1.0)), "recency_weighted": pre.withColumn("w", weight)}
    rows = None
    for name, part in parts.items():
        part = part.select(F.lit(name).alias("strategy"), "risk", "wrong", "w")
        rows = part if rows is None else rows.unionByName(part)
    sizes = rows.groupBy("strategy").agg(F.count("*").alias("n_calibration"))
    chosen = sizes.join(tuned_weighted(rows, ["strategy"], eps, steps=steps), "strategy", "left").withColumn("step", F.round(F.coalesce("threshold", F.lit(0.0)) * steps).cast("int"))
    later = cumulative(post.withColumn("one", F.lit(1)), ["one"], steps).select("step", "n", "k")
    totals = post.agg(F.count("*").alias("n_test")).join(pre.agg(F.count("*").alias("n_pre")))  # one row each
    judged = chosen.join(later, "step", "left").join(F.broadcast(totals)).withColumn("violation_rate", half_violations(F.coalesce("k", F.lit(0)), F.coalesce("n", F.lit(0)), "n_test", F.lit(eps), F.lit(splits)))
    one = lambda name: judged.where(F.col("strategy") == name)
    broken = one("static").select((F.col("violation_rate") > delta).alias("broken"))  # one row
    wide = judged.join(F.broadcast(broken), F.lit(True))
    source = F.when(F.col("broken"), "sliding_window").otherwise("static")
    moved = wide.where(F.col("strategy") == source).withColumn("strategy", F.lit("triggered"))
    four = wide.unionByName(moved).withColumn("recalibrated", (F.col("strategy") != "triggered") | F.col("broken"))
    names = spark.createDataFrame([(n,) for n in (*parts, "triggered")], "strategy string")
    some = F.col("n_test") > 0
    status = F.when((F.col("n_pre") >= least) & (F.col("n_test") >= least), "computed").otherwise("not_certifiable")
    error = F.when(some, F.coalesce(F.try_divide("k", "n"), F.lit(1.0)))
    return names.join(four, "strategy", "left").select("strategy", (F.col("step") / steps).alias("threshold"), "n_calibration", F.coalesce("n", F.when(some, F.lit(0))).alias("accepted"), F.try_divide(F.coalesce("n", F.lit(0)), "n_test").alias("coverage"), error.alias("error"), F.when(some, F.col("violation_rate")).alias("violation_rate"), F.coalesce("recalibrated", F.lit(False)).alias("recalibrated"), F.coalesce(status, F.lit("not_certifiable")).alias("status"))


def best_strategy(table: DataFrame, delta: float) -> DataFrame:
    """The strategy of least error among those violated in at most ``delta`` of the halves; the first in the order of the table's names on ties."""
    place = F.array_position(F.array(*map(F.lit, ("static", "sliding_window", "recency_weighted", "triggered"))), F.col("strategy"))
    return table.where(F.col("violation_rate") <= delta).agg(F.min_by("strategy", F.struct("error", place)).alias("best"))
