"""Risk models: feature rows, grouped folds, logistic regression or boosted trees, the better of both, ablation of signals, calibration."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verdara.operators.guarantee import draw

# Fixed one-hot values.
KINDS = ("RATE", "THRESHOLD", "DATE", "SECTION", "ENTITY", "APPLICABILITY")
REGULATORS = ("SEBI", "RBI", "INCOMETAX", "MF", "OTHER")
SIGNALS = ("s_ver", "s_nli", "s_ent", "s_ret", "s_div", "s_mech")


def features(rows: DataFrame, signals: tuple[str, ...] = SIGNALS) -> tuple[DataFrame, list[str]]:
    """Signals with missing flags, one-hot kinds and regulators; missing and NaN become 0 with the flag set."""
    columns: dict[str, Column] = {}
    for s in signals:
        clean = F.when(~F.isnan(s), F.col(s))
        columns[s] = F.coalesce(clean, F.lit(0.0))
        columns[f"{s}_skipped"] = clean.isNull().cast("double")
    for k in KINDS:
        columns[f"type_{k}"] = (F.col("kind") == k).cast("double")
    known = F.when(F.col("regulator").isin(*REGULATORS), F.col("regulator")).otherwise("OTHER")
    for r in REGULATORS:
        columns[f"reg_{r}"] = (known == r).cast("double")
    rest = [c for c in rows.columns if c not in columns]
    return rows.select(*rest, *(c.alias(n) for n, c in columns.items())), list(columns)


def fold_of(group: Column, k: int) -> Column:
    """Whole groups to one of k folds."""
    return F.floor(draw(group, F.lit(77)) * k).cast("int")


def balanced(rows: DataFrame, label: str) -> DataFrame:
    share = rows.agg(F.avg(label)).first()[0] or 0.5
    return rows.withColumn("_weight", F.when(F.col(label) == 1, 0.5 / max(share, 1e-9)).otherwise(0.5 / max(1 - share, 1e-9)))


def train(rows: DataFrame, columns: list[str], label: str, trees: bool = False, n_trees: int = 300) -> PipelineModel:
    model = GBTClassifier(labelCol=label, featuresCol="_x", weightCol="_weight", maxIter=n_trees, maxDepth=4, stepSize=0.05, seed=1) if trees else LogisticRegression(labelCol=label, featuresCol="_x", weightCol="_weight", regParam=0.01)
    return Pipeline(stages=[VectorAssembler(inputCols=columns, outputCol="_x"), model]).fit(balanced(rows, label))


def scored(model: PipelineModel, rows: DataFrame) -> DataFrame:
    made = model.transform(rows.withColumn("_weight", F.lit(1.0)))
    return made.withColumn("raw_risk", vector_to_array("probability")[1]).drop("_x", "_weight", "rawPrediction", "probability", "prediction")


def train_best(rows: DataFrame, held: DataFrame, columns: list[str], label: str, n_trees: int = 300) -> tuple[str, PipelineModel, dict[str, float]]:
    """Logistic regression and boosted trees, both fitted; the name and model of greater AUROC on held rows, and both figures."""
    models = {"logistic": train(rows, columns, label), "trees": train(rows, columns, label, True, n_trees)}
    found = {name: area(scored(model, held), [], label, "raw_risk").first()["auroc"] for name, model in models.items()}
    best = max(models, key=lambda name: (found[name] is not None, found[name] or 0.0))
    return best, models[best], found


def area(rows: DataFrame, by: list[str], label: str, score: str, digits: int = 4) -> DataFrame:
    """``by, n, auroc`` of scores rounded to ``digits``, ties counted half; NULL without rows of both labels.

    Rows are counted by rounded score first, so what is put in order doesn't grow with them.
    """
    keys = [*by, "_all"]
    hist = rows.where(F.col(label).isNotNull()).groupBy(*by, F.lit(1).alias("_all"), F.round(score, digits).alias("_s")).agg(F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg"))
    below = F.sum("neg").over(Window.partitionBy(*keys).orderBy("_s")) - F.col("neg") / 2
    made = hist.withColumn("_below", below).groupBy(*keys).agg((F.sum("pos") + F.sum("neg")).alias("n"), F.try_divide(F.sum(F.col("pos") * F.col("_below")), F.sum("pos") * F.sum("neg")).alias("auroc"))
    return made.drop("_all")


def logistic_fits(rows: DataFrame, columns: list[str], label: str, drops: dict[str, list[str]], c: float = 1.0, evenly: bool = True, most: int = 50, tolerance: float = 1e-8) -> dict[str, dict[str, float]]:
    """Coefficients (``""``: the intercept) of one logistic regression for each entry of ``drops``, which names columns left out.

    All models go through the rows together: in a pass each task adds up every model's gradient, curvature and loss, sums of a
    fixed size whatever the rows, and the driver takes one Newton step for each. ``c`` weighs the rows against half the squared
    coefficients, the intercept apart; ``evenly`` gives both labels equal weight in sum. A model whose loss has grown goes back
    half a step. Rows without a label, and rows of NULL or NaN features, take no part; with rows of one label or none there is an error.
    """
    kept = rows.select(F.col(label).cast("double").alias("_y"), *(F.col(x).cast("double").alias(f"_x{i}") for i, x in enumerate(columns))).where("_y IS NOT NULL")
    for i in range(len(columns)):
        kept = kept.where(F.col(f"_x{i}").isNotNull() & ~F.isnan(f"_x{i}"))
    sizes = {r["_y"]: r["count"] for r in kept.groupBy("_y").count().collect()}
    if set(sizes) != {0.0, 1.0}:
        raise ValueError("a logistic regression needs rows of both labels")
    weights = [sum(sizes.values()) / (2 * sizes[y]) if evenly else 1.0 for y in (0.0, 1.0)]
    names, d = list(drops), len(columns) + 1
    free = np.array([[True] + [x not in drops[name] for x in columns] for name in names])

    def sums(beta: np.ndarray) -> list[np.ndarray]:
        def add(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = np.zeros((len(beta), 1 + d + d * d))
            for part in parts:
                y = part["_y"].to_numpy()
                x = np.column_stack([np.ones(len(y)), part.drop(columns="_y").to_numpy()])
                w = np.where(y == 1, weights[1], weights[0])
                for m, z in enumerate(beta @ x.T):
                    p = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
                    total[m, 0] += np.sum(w * (np.logaddexp(0, z) - y * z))
                    total[m, 1 : 1 + d] += x.T @ (w * (y - p))
                    total[m, 1 + d :] += ((x * (w * p * (1 - p))[:, None]).T @ x).ravel()
            yield pd.DataFrame({"model": range(len(beta)), "v": list(total)})

        added = kept.mapInPandas(add, "model int, v array<double>").groupBy("model").agg(Summarizer.sum(array_to_vector("v")).alias("v"))
        found = {r["model"]: r["v"].toArray() for r in added.collect()}  # a row a model
        return [found[m] for m in range(len(beta))]

    beta, good, loss = np.zeros(free.shape), np.zeros(free.shape), np.full(len(names), np.inf)
    for _ in range(most):
        moved = 0.0
        for m, v in enumerate(sums(beta)):
            now = c * v[0] + np.sum(beta[m, 1:] ** 2) / 2
            if now > loss[m] + 1e-9 * abs(loss[m]):
                beta[m] = (beta[m] + good[m]) / 2
                moved = max(moved, np.abs(beta[m] - good[m]).max())
                continue
            good[m], loss[m] = beta[m], now
            penalty = np.diag([0.0] + [1.0] * (d - 1))
            slope, curve = c * v[1 : 1 + d] - penalty @ beta[m], c * v[1 + d :].reshape(d, d) + penalty + 1e-12 * np.eye(d)
            f = free[m]
            step = np.zeros(d)
            step[f] = np.linalg.solve(curve[np.ix_(f, f)], slope[f])
            beta[m] = beta[m] + step
            moved = max(moved, np.abs(step).max())
        if moved < tolerance:
            break
    return {name: dict(zip(["", *columns], map(float, beta[m]), strict=True)) for m, name in enumerate(names)}


def logistic_score(fit: dict[str, float]) -> Column:
    z = F.lit(fit[""])
    for column, value in fit.items():
        if column and value:
            z = z + F.lit(value) * F.col(column)
    return 1 / (1 + F.exp(-z))


def ablation(rows: DataFrame, held: DataFrame, columns: list[str], label: str, drops: dict[str, list[str]]) -> DataFrame:
    """``dropped, n, auroc, lost``: area on held rows of a model fitted without some columns, and what that loses against ``none``, fitted with all.

    One pass of the held rows scores all models. Areas are NULL where the held rows have one label only.
    """
    fits = logistic_fits(rows, columns, label, {"none": [], **drops})
    each = F.array(*(F.struct(F.lit(name).alias("dropped"), logistic_score(fit).alias("score")) for name, fit in fits.items()))
    made = area(held.select(label, F.explode(each).alias("m")).select(label, "m.*"), ["dropped"], label, "score")
    whole = F.max(F.when(F.col("dropped") == "none", F.col("auroc"))).over(Window.partitionBy())  # one row a model
    return made.withColumn("lost", whole - F.col("auroc"))


def platt(held: DataFrame, rows: DataFrame, label: str) -> DataFrame:
    """Adds ``risk``: a logistic curve of the raw risk, fitted on rows the model has not seen; rounded to 4 digits."""
    fit = logistic_fits(held, ["raw_risk"], label, {"all": []}, evenly=False)["all"]
    return rows.withColumn("risk", F.round(logistic_score(fit), 4))


def calibrate(held: DataFrame, rows: DataFrame, label: str) -> DataFrame:
    """Adds ``risk``: isotonic in the raw risk, fitted on rows the model has not seen; rounded to 4 digits."""
    model = IsotonicRegression(labelCol=label, featuresCol="raw_risk").fit(held)
    return model.transform(rows).withColumn("risk", F.round(F.least(F.greatest("prediction", F.lit(0.0)), F.lit(1.0)), 4)).drop("prediction")


def quality(rows: DataFrame, label: str, score: str) -> dict[str, float]:
    """AUROC and Brier score."""
    row = rows.agg(F.avg(F.pow(F.col(score) - F.col(label), 2)).alias("brier")).first()
    return {"auroc": BinaryClassificationEvaluator(labelCol=label, rawPredictionCol=score).evaluate(rows), "brier": row["brier"]}


def cross_validated(rows: DataFrame, columns: list[str], label: str, group: Column, k: int = 3, trees: bool = False) -> DataFrame:
    """Every row with its out-of-fold raw risk; a group is never on both sides."""
    rows = rows.withColumn("_fold", fold_of(group, k))
    parts = [scored(train(rows.where(F.col("_fold") != i), columns, label, trees), rows.where(F.col("_fold") == i)) for i in range(k)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.drop("_fold")
