"""Evaluation: risk-coverage, threshold tuning, agreement, paired tests, extraction quality."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verdara.functions import stats
from verdara.operators.guarantee import cumulative


def risk_coverage(rows: DataFrame, by: list[str], steps: int = 100) -> DataFrame:
    """Coverage and selective risk at each step of the grid that accepts anything."""
    total = Window.partitionBy(*by)
    curve = cumulative(rows, by, steps).withColumn("all", F.max("n").over(total)).where("n > 0")
    return curve.select(*by, "step", "lam", F.round(F.col("n") / F.col("all"), 6).alias("coverage"), F.round(F.col("k") / F.col("n"), 6).alias("risk"))


def aurc(curve: DataFrame, by: list[str]) -> DataFrame:
    """Area under the risk-coverage curve by trapezoids."""
    w = Window.partitionBy(*by).orderBy("step")
    width = F.col("coverage") - F.lag("coverage").over(w)
    parts = curve.withColumn("part", width * (F.col("risk") + F.lag("risk").over(w)) / 2)
    return parts.groupBy(*by).agg(F.coalesce(F.sum("part"), F.lit(0.0)).alias("aurc"))


def tuned(rows: DataFrame, by: list[str], eps: float, steps: int = 200) -> DataFrame:
    """The largest threshold of the grid whose accepted rows have at most ``eps`` wrong; not a certificate."""
    met = cumulative(rows, by, steps).where((F.col("n") > 0) & (F.col("k") <= eps * F.col("n")))
    return rows.select(*by).distinct().join(met.groupBy(*by).agg(F.max("lam").alias("threshold")), by, "left")


def wrong_at_coverage(rows: DataFrame, by: list[str], shares: tuple[float, ...]) -> DataFrame:
    """Wrong share among the lowest-risk share of rows; rows of equal risk count in proportion.

    Works on counts per distinct risk, so there is no total sort of the rows.
    """
    hist = rows.groupBy(*by, "risk").agg(F.count("*").alias("n"), F.sum("wrong").alias("k"))
    w = Window.partitionBy(*by).orderBy("risk")
    run = hist.withColumn("upto", F.sum("n").over(w)).withColumn("all", F.sum("n").over(Window.partitionBy(*by)))
    run = run.withColumn("share", F.explode(F.array(*map(F.lit, shares)))).withColumn("want", F.greatest(F.bround(F.col("share") * F.col("all")), F.lit(1)))
    taken = F.greatest(F.least(F.col("n"), F.col("want") - (F.col("upto") - F.col("n"))), F.lit(0))
    return run.groupBy(*by, "share").agg((F.sum(taken * F.col("k") / F.col("n")) / F.max("want")).alias("wrong_share"))


def rates(by: list[str], rows: DataFrame, accept: Column) -> DataFrame:
    """Hallucination rate among accepted (NULL if none) and coverage."""
    return rows.groupBy(*by).agg(F.try_divide(F.sum(F.when(accept, F.col("wrong"))), F.count_if(accept)).alias("hallucination"), (F.count_if(accept) / F.count("*")).alias("coverage"))


def confusion(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Cells and margins of the agreement table of two raters."""
    return pairs.groupingSets([[a, b], [a], [b], []], a, b).agg(F.count("*").alias("n"), F.grouping_id().alias("level"))


def kappa(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Agreement, expected agreement and Cohen's kappa of two raters."""
    cells = pairs.groupBy(F.col(a).alias("x"), F.col(b).alias("y")).agg(F.count("*").alias("n"))
    values = cells.select(F.explode(F.array("x", "y")).alias("v")).distinct()
    rows = cells.groupBy(F.col("x").alias("v")).agg(F.sum("n").alias("r"))
    columns = cells.groupBy(F.col("y").alias("v")).agg(F.sum("n").alias("c"))
    chance = values.join(rows, "v", "left").join(columns, "v", "left").agg(F.sum(F.coalesce(F.col("r") * F.col("c"), F.lit(0))).alias("rc"))
    totals = cells.agg(F.sum("n").alias("n"), F.sum(F.when(F.col("x") == F.col("y"), F.col("n")).otherwise(0)).alias("same"))
    observed, expected = F.col("same") / F.col("n"), F.col("rc") / (F.col("n") * F.col("n"))
    return totals.join(F.broadcast(chance)).select("n", observed.alias("observed"), expected.alias("expected"), F.when(expected < 1, (observed - expected) / (1 - expected)).otherwise(1.0).alias("kappa"))


def mcnemar(pairs: DataFrame, a: Column, b: Column) -> DataFrame:
    """Discordant counts and the continuity-corrected statistic."""
    counts = pairs.agg(F.count_if(a & ~b).alias("only_a"), F.count_if(~a & b).alias("only_b"))
    n = F.col("only_a") + F.col("only_b")
    return counts.withColumn("statistic", F.when(n > 0, F.pow(F.greatest(F.abs(F.col("only_a") - F.col("only_b")) - 1, F.lit(0)), 2) / n).otherwise(0.0))


def paired_bootstrap(rows: DataFrame, a: Column, b: Column, resamples: int = 10_000, alpha: float = 0.05, digits: int = 4) -> DataFrame:
    """Mean of the paired differences a - b, its interval between two of the sorted means of resamples, and the number of pairs.

    Differences are counted once, rounded to ``digits``; each resample draws the count of every distinct difference, one binomial
    number after the other, which is the multinomial law of drawing all pairs anew. The cost depends on the distinct differences,
    not on the pairs. Pairs with a null are left out; without pairs all is NULL.
    """
    spark = rows.sparkSession
    counted = rows.select((a - b).cast("double").alias("d")).where("d IS NOT NULL").groupBy(F.round("d", digits).alias("d")).agg(F.count("*").alias("n"))
    cells = sorted(map(tuple, counted.collect()))
    total = sum(n for _, n in cells)

    def resample(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            ids = part["id"].tolist()
            left, rest, mean = np.full(len(ids), total, np.int64), total, np.zeros(len(ids))
            for at, (d, n) in enumerate(cells):
                x = left if n == rest else stats.binomial_quantile(stats.uniform([f"{at}:{i}" for i in ids]), left, np.full(len(ids), n / rest))
                mean += d * x
                left, rest = left - x, rest - n
            yield pd.DataFrame({"mean": mean / max(total, 1)})

    means = spark.range(resamples).mapInPandas(resample, "mean double").agg(F.array_sort(F.collect_list("mean")).alias("m"))  # ``resamples`` numbers
    at = lambda share: F.get("m", F.lit(int(share * (resamples - 1))))
    mean = sum(d * n for d, n in cells) / total if total else None
    some = F.lit(total > 0)
    return means.select(F.lit(mean).cast("double").alias("mean_diff"), F.when(some, at(alpha / 2)).alias("ci_low"), F.when(some, at(1 - alpha / 2)).alias("ci_high"), F.lit(total).cast("long").alias("n"))


def seed_summary(values: DataFrame, by: list[str], value: str) -> DataFrame:
    half = 1.96 * F.stddev_samp(value) / F.sqrt(F.count("*"))
    return values.groupBy(*by).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), (F.avg(value) - half).alias("low"), (F.avg(value) + half).alias("high"))


def extraction_quality(predicted: DataFrame, gold: DataFrame) -> DataFrame:
    """Recall, precision and F1 per kind of distinct lower-cased values of ``item, kind, value``."""
    norm = lambda d: d.select("item", "kind", F.lower(F.trim("value")).alias("value")).distinct()
    both = norm(predicted).withColumn("p", F.lit(1)).join(norm(gold).withColumn("g", F.lit(1)), ["item", "kind", "value"], "full")
    counts = both.groupBy("kind").agg(F.count("p").alias("p"), F.count("g").alias("g"), F.count_if(F.col("p").isNotNull() & F.col("g").isNotNull()).alias("hit"))
    recall, precision = F.coalesce(F.try_divide("hit", "g"), F.lit(0.0)), F.coalesce(F.try_divide("hit", "p"), F.lit(0.0))
    return counts.select("kind", recall.alias("recall"), precision.alias("precision"), F.coalesce(F.try_divide(2 * F.col("hit"), F.col("p") + F.col("g")), F.lit(0.0)).alias("f1"))
