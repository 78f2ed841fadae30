"""Exact splits: sizes, whole units, no row lost, ties and small tables."""

import collections

import pytest
from pyspark.sql import functions as F

from verdara.operators import splits as S


@pytest.mark.parametrize("buckets", [1, 5, 4096])
def test_parts_follow_the_ranks(spark, buckets):
    rows = [(g, i, ((i * 41 + 7 * g) % 97) / 97 + 1e-3) for g in (0, 1) for i in range(97 + 40 * g)] + [(2, i, 0.25) for i in range(30)]
    df = spark.createDataFrame(rows, "g long, i long, u double")
    made = S.parted(df, "u", "i", [F.bround(F.col("n_group") * 0.3), F.bround(F.col("n_group") * 0.9)], ("g",), buckets)
    assert made.columns == ["g", "i", "u", "part"] and made.count() == len(rows)
    got = {(r["g"], r["i"]): r["part"] for r in made.collect()}
    for g in (0, 1, 2):
        order = [i for _, i in sorted((u, i) for h, i, u in rows if h == g)]
        n = len(order)
        assert [got[g, i] for i in order] == [(k >= round(n * 0.3)) + (k >= round(n * 0.9)) for k in range(n)]


def test_splits_of_rows_and_units(spark):
    df = spark.createDataFrame([(i, f"f{i % 23}" if i % 10 else None, "x") for i in range(1000)], "id long, family string, part string")
    random = S.split_exactly(df, "id")
    assert random.columns == ["id", "family", "part", "split"]
    assert {r["split"]: r["count"] for r in random.groupBy("split").count().collect()} == {"agg_train": 400, "agg_val": 100, "calibration": 250, "test": 250}
    rows = S.split_exactly(df, "id", "family", seed=4).collect()
    assert sorted(r["id"] for r in rows) == list(range(1000))
    of = collections.defaultdict(set)
    for r in rows:
        of[r["family"]].add(r["split"].replace("agg_val", "agg_train"))
    assert all(len(x) == 1 for x in of.values())
    assert collections.Counter(next(iter(x)) for x in of.values()) == {"agg_train": 12, "calibration": 6, "test": 6}
    sizes = collections.Counter(r["split"] for r in rows)
    assert sizes["agg_val"] == round(0.2 * (sizes["agg_val"] + sizes["agg_train"]))


def test_splits_of_few_rows(spark):
    df = spark.createDataFrame([(i, i) for i in range(3)], "id long, family long")
    assert sorted(r["split"] for r in S.split_exactly(df, "id", "family").collect()) == ["agg_val", "calibration", "test"]
    assert S.split_exactly(df.limit(0), "id").count() == 0
