"""Certified thresholds: grids, sequential testing, clustered tests, weights, drift statistics, simulation.

Rows are first counted by the grid step at which they become accepted, so later work depends on
the grid and the number of strata, not on the number of rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verdara.functions import stats
from verdara.functions.stats import binomial_tail


def accepted_from(risk: Column, steps: int) -> Column:
    """Least i with risk <= i / steps."""
    return F.ceil(risk * steps - 1e-9).cast("int")


def cumulative(rows: DataFrame, by: list[str], steps: int, risk: str = "risk", wrong: str = "wrong") -> DataFrame:
    """``by, step, lam, n, k`` for every step of the grid: accepted rows and wrong ones among them."""
    counts = rows.groupBy(*by, accepted_from(F.col(risk), steps).alias("step")).agg(F.count("*").alias("n"), F.sum(wrong).alias("k"))
    keys = rows.select(*by).distinct() if by else rows.sparkSession.range(1).select()
    grid = keys.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(steps))))
    w = Window.partitionBy(*by).orderBy("step")
    full = grid.join(counts, [*by, "step"], "left")
    return full.select(*by, "step", (F.col("step") / steps).alias("lam"), F.sum(F.coalesce("n", F.lit(0))).over(w).alias("n"), F.sum(F.coalesce("k", F.lit(0))).over(w).alias("k"))


def min_accepted(eps: float, delta: float) -> int:
    return math.ceil(math.log(delta) / math.log(1 - eps))


def ltt(rows: DataFrame, by: list[str], eps: float, delta: float, n_start: int = 50, steps: int = 200) -> DataFrame:
    """Fixed-sequence test along the grid: the largest threshold before the first failure; NULL if none is certified."""
    tested = cumulative(rows, by, steps).where(F.col("n") >= n_start).withColumn("p", binomial_tail("k", "n", F.lit(eps)))
    failed = F.max((F.col("p") > delta).cast("int")).over(Window.partitionBy(*by).orderBy("step"))
    passed = tested.withColumn("failed", failed).groupBy(*by).agg(F.max(F.when(F.col("failed") == 0, F.col("lam"))).alias("accept_below"))
    return rows.select(*by).distinct().join(passed, by, "left")


def cluster_p(rows: DataFrame, eps: float, steps: int = 20, cluster: str = "question") -> DataFrame:
    """Per step: clusters with accepted rows, mean excess of wrong ones, and its Hoeffding-type p-value."""
    per = cumulative(rows, [cluster], steps).where("n > 0").withColumn("z", F.col("k") - eps * F.col("n"))
    made = per.groupBy("step", "lam").agg(F.count("*").alias("m"), F.avg("z").alias("zbar"))
    p = F.least(F.lit(1.0), F.lit(math.e) * F.exp(-2 * F.col("m") * F.col("zbar") * F.col("zbar")))
    return made.withColumn("p", F.when(F.col("zbar") < 0, p).otherwise(1.0))


def recency_weight(day: Column, reference: Column, half_life_days: float) -> Column:
    """exp(-ln 2 * age / half life); an unknown day has age 0."""
    return F.exp(-math.log(2) * F.greatest(F.coalesce(F.datediff(reference, day), F.lit(0)), F.lit(0)) / half_life_days)


def effective_size(weight: str) -> Column:
    return F.pow(F.sum(weight), 2) / F.sum(F.col(weight) * F.col(weight))


def histograms(rows: DataFrame, recent: Column, value: Column) -> DataFrame:
    """Counts of each distinct value on both sides of a split."""
    return rows.groupBy(value.alias("v")).agg(F.count_if(~recent).alias("a"), F.count_if(recent).alias("b"))


def ks_statistic(hist: DataFrame) -> DataFrame:
    """Largest distance of the two distribution functions, from a histogram whose values are rounded to ten-thousandths of their range."""
    ends = hist.agg(F.min("v").alias("low"), F.max("v").alias("high"))  # one row
    place = F.round((F.col("v") - F.col("low")) / F.greatest(F.col("high") - F.col("low"), F.lit(1e-300)) * 10_000)
    hist = hist.join(F.broadcast(ends)).groupBy(place.alias("v")).agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    w, everything = Window.orderBy("v"), Window.partitionBy()
    run = hist.withColumn("fa", F.sum("a").over(w) / F.sum("a").over(everything)).withColumn("fb", F.sum("b").over(w) / F.sum("b").over(everything))
    return run.agg(F.sum("a").alias("n_a"), F.sum("b").alias("n_b"), F.max(F.abs(F.col("fa") - F.col("fb"))).alias("ks"))


def mmd(hist: DataFrame, gamma: float) -> DataFrame:
    """Squared maximum mean discrepancy under a Gaussian kernel, at least 0.

    Values are rounded to hundredths of the unit interval, so the kernel sum has a fixed number of terms whatever the number of rows.
    """
    hist = hist.groupBy(F.round(F.least(F.greatest("v", F.lit(0.0)), F.lit(1.0)), 2).alias("v")).agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    one = hist.agg(F.sum("a").alias("na"), F.sum("b").alias("nb"), F.collect_list(F.struct("v", "a", "b")).alias("cells"))
    left = one.select("na", "nb", "cells", F.explode("cells").alias("x"))
    pair = left.select("na", "nb", "x", F.explode("cells").alias("y"))
    kernel = F.exp(-gamma * F.pow(F.col("x.v") - F.col("y.v"), 2))
    term = F.col("x.a") * F.col("y.a") / (F.col("na") * F.col("na")) + F.col("x.b") * F.col("y.b") / (F.col("nb") * F.col("nb")) - 2 * F.col("x.a") * F.col("y.b") / (F.col("na") * F.col("nb"))
    return pair.agg(F.greatest(F.sum(kernel * term), F.lit(0.0)).alias("mmd2"))


def draw(key: Column, replicate: Column) -> Column:
    """A fixed pseudo-random number in (0, 1) of a key of any type and a replicate, from md5, so that any SQL engine repeats it."""
    digest = F.md5(F.concat_ws(":", key.cast("string"), replicate.cast("string")).cast("binary"))
    return (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") + 0.5) / 4294967296.0


def first_fraction(rows: DataFrame, by: list[str], key: str, wanted: Column, tie: str, buckets: int = 4096) -> DataFrame:
    """Of each group exactly the ``wanted`` rows of least ``key`` in (0, 1), ties by ``tie``; nothing is ordered but one bucket a group.

    Rows are counted by bucket of the key; buckets below the one in which the wanted number is reached are taken whole, and
    only the rows of that bucket are ranked. ``wanted`` may use the group's columns and its size ``n_group``.
    """
    placed = rows.withColumn("_bucket", F.least(F.floor(F.col(key) * buckets), F.lit(buckets - 1)).cast("int"))
    counts = placed.groupBy(*by, "_bucket").agg(F.count("*").alias("_n"))
    w = Window.partitionBy(*by).orderBy("_bucket")  # at most ``buckets`` rows a group
    upto = counts.withColumns({"_upto": F.sum("_n").over(w), "n_group": F.sum("_n").over(Window.partitionBy(*by))})
    upto = upto.withColumn("_wanted", F.least(wanted.cast("long"), F.col("n_group")))
    cut = upto.where(F.col("_upto") - F.col("_n") < F.col("_wanted")).select(*by, "_bucket", "n_group", (F.col("_wanted") - F.col("_upto") + F.col("_n")).alias("_left"), (F.col("_upto") <= F.col("_wanted")).alias("_whole"))
    joined = placed.join(cut, [*by, "_bucket"])
    ranked = joined.where("NOT _whole").withColumn("_place", F.row_number().over(Window.partitionBy(*by).orderBy(key, tie)))
    kept = joined.where("_whole").unionByName(ranked.where("_place <= _left").drop("_place"))
    return kept.drop("_bucket", "_left", "_whole")


def quantiles(rows: DataFrame, by: list[str], value: str, shares: list[float], buckets: int = 4096) -> DataFrame:
    """``by, share, q``: exact quantiles with linear interpolation, in memory that doesn't depend on the rows.

    Values are counted in ``buckets`` cells between the ends of their group; only the cells in which a wanted rank falls are
    looked at again, by distinct value. Nulls are left out; a group without values gives no row.
    """
    keys = [*by, "_all"]
    rows = rows.where(F.col(value).isNotNull()).select(*by, F.lit(1).alias("_all"), F.col(value).cast("double").alias("_v"))
    ends = rows.groupBy(*keys).agg(F.min("_v").alias("_low"), F.max("_v").alias("_high"), F.count("*").alias("_n"))
    cell = F.when(F.col("_high") > F.col("_low"), F.least(F.floor((F.col("_v") - F.col("_low")) / (F.col("_high") - F.col("_low")) * buckets), F.lit(buckets - 1))).otherwise(0)
    placed = rows.join(ends, keys).select(*keys, "_v", cell.cast("int").alias("_cell"))
    counts = placed.groupBy(*keys, "_cell").agg(F.count("*").alias("_c"))
    upto = counts.withColumn("_upto", F.sum("_c").over(Window.partitionBy(*keys).orderBy("_cell")))  # at most ``buckets`` rows a group
    place = F.col("share") * (F.col("_n") - 1)
    wanted = ends.withColumn("share", F.explode(F.array(*map(F.lit, shares)))).select(*keys, "share", (place - F.floor(place)).alias("_part"), F.explode(F.array_distinct(F.array(F.floor(place), F.ceil(place)))).alias("_rank"))
    found = wanted.join(upto, keys).where((F.col("_rank") < F.col("_upto")) & (F.col("_rank") >= F.col("_upto") - F.col("_c")))
    found = found.select(*keys, "share", "_part", "_rank", "_cell", (F.col("_rank") - F.col("_upto") + F.col("_c")).alias("_inside"))
    near = placed.join(found.select(*keys, "_cell").distinct(), [*keys, "_cell"]).groupBy(*keys, "_cell", "_v").agg(F.count("*").alias("_c"))
    near = near.withColumn("_upto", F.sum("_c").over(Window.partitionBy(*keys, "_cell").orderBy("_v")))
    picked = found.join(near, [*keys, "_cell"]).where((F.col("_inside") < F.col("_upto")) & (F.col("_inside") >= F.col("_upto") - F.col("_c")))
    low, high = F.min_by("_v", "_rank"), F.max_by("_v", "_rank")
    return picked.groupBy(*by, "share").agg((low + F.max("_part") * (high - low)).alias("q"))


def weighted_sample(rows: DataFrame, by: list[str], weight: str, tie: str, seed: int = 0) -> DataFrame:
    """Of each group as many rows as its effective size, drawn without replacement in proportion to the weights.

    Each row's exponential key -ln(u) / w is squeezed into (0, 1); the rows of least keys are the sample. Rows without a positive weight are never drawn.
    """
    sound = rows.where(F.col(weight) > 0)
    sizes = sound.groupBy(*by).agg(F.floor(effective_size(weight) + 1e-9).alias("n_eff"), F.avg(weight).alias("_mean"))
    keyed = sound.join(sizes, by).withColumn("_key", 1 - F.exp(F.log(draw(F.col(tie), F.lit(seed))) * F.col("_mean") / F.col(weight)))
    return first_fraction(keyed, [*by, "n_eff"], "_key", F.col("n_eff"), tie).drop("_key", "_mean")


def violation(rows: DataFrame, eps: float, delta: float, splits: int = 1000, n_start: int = 50, steps: int = 100) -> DataFrame:
    """How often a threshold certified on a random half has more than ``eps`` wrong on the other half, over ``splits`` halves.

    Rows are counted once by step and wrongness, at most ``2 * (steps + 1)`` cells; each split draws how many of a cell's rows
    fall into its half, one hypergeometric number after the other, so no row is copied and the halves are exact.
    Splits without a threshold, or whose other half accepts nothing, abstain. An empty table abstains always.
    """
    spark = rows.sparkSession
    step = F.least(F.greatest(accepted_from(F.col("risk"), steps), F.lit(0)), F.lit(steps + 1))
    counted = rows.where("risk IS NOT NULL AND wrong IS NOT NULL").groupBy(step.alias("step"), F.col("wrong").cast("int").alias("wrong")).agg(F.count("*").alias("n"))
    cells = sorted(map(tuple, counted.collect()))
    total = sum(n for *_, n in cells)

    def simulate(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            ids = part["id"].tolist()
            left, half = np.full(len(ids), total, np.int64), np.full(len(ids), max(1, total // 2) if total else 0, np.int64)
            counts = np.zeros((2, 2, len(ids), steps + 2), np.int64)  # side, wrong, split, step
            for at, wrong, n in cells:
                x = stats.hypergeometric_quantile(stats.uniform([f"{at * 2 + wrong}:{i}" for i in ids]), left, n, half)
                counts[0, wrong, :, at] += x
                counts[1, wrong, :, at] += n - x
                left, half = left - n, half - x
            k, n = np.cumsum(counts[:, 1, :, : steps + 1], 2), np.cumsum(counts.sum(1)[:, :, : steps + 1], 2)
            tested = n[0] >= n_start
            failed = np.logical_or.accumulate(tested & (stats.tail(k[0].ravel(), n[0].ravel(), np.array(eps)).reshape(k[0].shape) > delta), 1)
            passed = tested & ~failed
            last = np.where(passed.any(1), steps - np.argmax(passed[:, ::-1], 1), -1)
            seen, wrong = (m[1][np.arange(len(ids)), np.maximum(last, 0)] for m in (n, k))
            yield pd.DataFrame({"step": last, "n": np.where(last < 0, 0, seen), "k": wrong})

    each = spark.range(splits).mapInPandas(simulate, "step long, n long, k long").where("n > 0")
    rate = F.try_divide(F.count_if(F.col("k") > eps * F.col("n")), F.count("*"))
    made = each.agg(F.count("*").alias("certified"), F.count_if(F.col("k") > eps * F.col("n")).alias("violations"), rate.alias("violation_rate"), F.avg(F.col("step") / steps).alias("mean_threshold"))
    return made.withColumns({"splits": F.lit(splits).cast("long"), "abstained": F.lit(splits) - F.col("certified")})
