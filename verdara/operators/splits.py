"""Calibration and test splits, leakage, resuming."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verdara.operators.guarantee import draw


def split_of(group: Column, seed: int = 0, calibration: float = 0.5, held: float = 0.2) -> Column:
    """Whole groups to calibration, test, or the part of calibration held for the aggregator's validation."""
    u, v = draw(group, F.lit(seed)), draw(group, F.lit(seed + 1))
    return F.when(u >= calibration, "test").when(v < held, "agg_val").otherwise("calibration")


def parted(rows: DataFrame, key: str, tie: str, cuts: list[Column], by: tuple[str, ...] = (), buckets: int = 4096, into: str = "part") -> DataFrame:
    """``rows`` with the column ``into``: how many of the ascending ``cuts`` lie at or below a row's rank by ``key`` in (0, 1), ties by ``tie``, from 0.

    ``cuts`` are counts and may use the group's size ``n_group``. Ranks are exact without a sort of the groups: rows are counted
    by bucket of the key, and only buckets that a cut goes through are ranked inside.
    """
    by, names = ["_all", *by], [f"_cut{i}" for i in range(len(cuts))]
    placed = rows.withColumn("_all", F.lit(1)).withColumn("_bucket", F.least(F.floor(F.col(key) * buckets), F.lit(buckets - 1)).cast("int"))
    counts = placed.groupBy(*by, "_bucket").agg(F.count("*").alias("_n"))
    whole, upto = Window.partitionBy(*by), Window.partitionBy(*by).orderBy("_bucket")  # at most ``buckets`` rows a group
    known = counts.withColumns({"n_group": F.sum("_n").over(whole), "_before": F.sum("_n").over(upto) - F.col("_n")}).withColumns(dict(zip(names, cuts, strict=True)))
    through = F.exists(F.array(*names), lambda c: (c > F.col("_before")) & (c < F.col("_before") + F.col("_n")))
    known = known.select(*by, "_bucket", "_before", *names, through.alias("_through"))
    joined = placed.join(known, [*by, "_bucket"])
    inner = joined.where("_through").withColumn("_rank", F.col("_before") + F.row_number().over(Window.partitionBy(*by, "_bucket").orderBy(key, tie)) - 1)
    ranked = joined.where("NOT _through").withColumn("_rank", F.col("_before")).unionByName(inner)
    part = sum(((F.col("_rank") >= F.col(c)).cast("int") for c in names), F.lit(0))
    return ranked.select(*rows.columns, part.alias(into))


def split_exactly(rows: DataFrame, key: str, unit: str | None = None, seed: int = 0, train: float = 0.5, calibration: float = 0.25, held: float = 0.2) -> DataFrame:
    """``rows`` with ``split``: exact shares of rows, or with ``unit`` of whole units (families, documents), to agg_train, calibration and test.

    Then exactly the share ``held`` of agg_train's rows becomes agg_val. With three units or more no split is empty. A null unit is a unit of its own;
    ``key`` tells rows apart, equal keys get places by chance. Counts are rounded half to even.
    """
    n = F.col("n_group")
    first, second = F.bround(n * train), F.bround(n * calibration)
    of = rows if unit is None else rows.select(F.col(unit).alias("_unit")).distinct()
    name = key if unit is None else "_unit"
    if unit is not None:
        first = F.least(F.greatest(first, F.lit(1)), n - 2)
        second = F.least(F.greatest(second, F.lit(1)), n - first - 1)
    drawn = parted(of.withColumn("_u", draw(F.col(name), F.lit(seed))), "_u", name, [first, first + second], into="_part")
    named = drawn.withColumn("_split", F.element_at(F.array(F.lit("agg_train"), F.lit("calibration"), F.lit("test")), F.col("_part") + 1)).drop("_u", "_part")
    made = named if unit is None else rows.join(named, rows[unit].eqNullSafe(named["_unit"])).drop("_unit")
    train_rows = parted(made.where("_split = 'agg_train'").withColumn("_u", draw(F.col(key), F.lit(seed + 1))), "_u", key, [F.greatest(F.bround(n * held), F.lit(1))], into="_part")
    carved = train_rows.withColumn("_split", F.when(F.col("_part") == 0, "agg_val").otherwise("agg_train")).drop("_u", "_part")
    return carved.unionByName(made.where("_split <> 'agg_train'")).withColumnRenamed("_split", "split")


def temporal_split(day: Column, cut: Column) -> Column:
    """Rows without a date are of the earlier period."""
    return F.when(day.isNull() | (day < cut), "pre").otherwise("post")


def leakage(rows: DataFrame, doc: str, split: str = "split") -> DataFrame:
    """Documents in more than one split, validation rows apart."""
    counted = F.collect_set(F.when(F.col(split) != "agg_val", F.col(split)))
    return rows.groupBy(doc).agg(F.array_sort(counted).alias("splits")).where(F.size("splits") > 1)


def leak_ban(chunks: DataFrame, held: DataFrame, doc: str) -> DataFrame:
    """Chunks of documents that no held-out question uses."""
    return chunks.join(held.select(doc).distinct(), doc, "left_anti")


def pending(todo: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Items not yet completed; an item with status ERROR is not completed."""
    return todo.join(done.where("status <> 'ERROR'").select(key).distinct(), key, "left_anti")
