"""Stateful streams: equal results for any arrival order and cut into batches, late rows, state of the batch operators."""

import datetime as dt
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from verdara.operators import certify
from verdara.plans.streams import drained
from verdara.streaming import monitor

START = dt.datetime(2024, 1, 1)
SCHEMA = "stratum string, regulator string, kind string, ts timestamp, risk double, wrong int"


def atoms(days=12, a_day=40, seed=3):
    rng = random.Random(seed)
    rows = []
    for d in range(days):
        for _ in range(a_day):
            regulator, kind = rng.choice(("RBI", "SEBI")), rng.choice(("RATE", "DATE"))
            risk = round(min(1.0, rng.random() ** 2 + (0.5 if d > 7 and regulator == "RBI" else 0.0)), 4)
            rows.append((f"{regulator}|{kind}", regulator, kind, START + dt.timedelta(days=d, seconds=rng.randrange(86_400)), risk, int(rng.random() < risk)))
    return rows + [("RBI|RATE", "RBI", "RATE", START, None, 1)]


def stream(spark, folder, rows, files, schema=SCHEMA, time=3):
    """The rows as so many files, one a batch; the last holds a later row, so that the watermark closes all days before."""
    os.makedirs(folder)
    parts = [rows[i::files] for i in range(files)]
    last = list(rows[0])
    last[time] = START + dt.timedelta(days=300)
    for i, part in enumerate([*parts, [tuple(last)]]):
        made = spark.createDataFrame(part, schema).toPandas()
        made.to_parquet(f"{folder}/{i:03}.parquet", coerce_timestamps="us", allow_truncated_timestamps=True)
        os.utime(f"{folder}/{i:03}.parquet", (1_700_000_000 + i, 1_700_000_000 + i))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def collected(spark, df, mode="append"):
    return sorted(map(tuple, drained(spark, df, mode).collect()), key=str)


@pytest.fixture(scope="module")
def orders():
    rows = atoms()
    mixed = list(rows)
    random.Random(9).shuffle(mixed)
    return rows, mixed


def test_drift_for_any_arrival_order(spark, tmp_path, orders):
    amended = [("SEBI|DATE", START + dt.timedelta(days=6, hours=5))]
    results = []
    for name, rows, files in (("a", orders[0], 1), ("b", orders[1], 4)):
        woken = stream(spark, tmp_path / f"{name}e", amended, 1, "stratum string, ts timestamp", 1)
        results.append(collected(spark, monitor.drift_monitor(stream(spark, tmp_path / name, rows, files), woken, baseline=50, recent=20, late="30 days")))
    assert results[0] == results[1] and results[0]
    by = {}
    for stratum, day, n_a, n_b, ks, p, mmd2, triggered, drift in results[0]:
        by.setdefault(stratum, []).append((day, triggered, drift))
        assert n_a >= 50 and n_b >= 20 and drift == (p < 0.05 or mmd2 > 0.01 or triggered)
    shifted = [day for day, _, drift in by["RBI|RATE"] if drift]
    assert shifted and min(shifted) >= dt.date(2024, 1, 9)
    assert [t for _, t, _ in by["SEBI|DATE"]].count(True) == 1


def test_statistics():
    rng = np.random.default_rng(1)
    a, b = rng.random(40).round(2), (rng.random(30) ** 2).round(2)
    count = lambda x: np.bincount((x * 100).round().astype(int), minlength=monitor.CELLS)
    kernel = lambda x, y: np.exp(-(((x[:, None] - y) ** 2))).mean()
    assert monitor.discrepancy(count(a), count(b), 1.0) == pytest.approx(kernel(a, a) - 2 * kernel(a, b) + kernel(b, b))
    assert monitor.discrepancy(count(a), count(a), 1.0) == 0 and monitor.discrepancy(count(a), count(a) * 0, 1.0) == 0
    assert monitor.kolmogorov(4, 100, 1.0) == 1 and monitor.kolmogorov(100, 100, 0.0) == 1 and monitor.kolmogorov(100, 100, 0.5) < 1e-10
    # Kolmogorov's distribution at sqrt(n_a n_b / (n_a + n_b)) * gap = 1.3581 is 0.95
    assert monitor.kolmogorov(10**8, 10**8, 1.3581015 / (10**8 / 2) ** 0.5) == pytest.approx(0.05, abs=1e-5)


def test_sliding_calibration_equals_batch(spark, tmp_path, orders):
    made = collected(spark, monitor.sliding_calibration(stream(spark, tmp_path / "a", orders[1], 3), days=4, eps=0.3, late="30 days"))
    want = []
    for stratum in sorted({r[0] for r in orders[0]}):
        for day in sorted({r[3].date() for r in orders[0] if r[0] == stratum and r[4] is not None}):
            rows = [(r[4], r[5]) for r in orders[0] if r[0] == stratum and r[4] is not None and 0 <= (day - r[3].date()).days < 4]
            fits = [s for s in range(201) if (k := [w for x, w in rows if x <= s / 200 + 1e-9]) and sum(k) <= 0.3 * len(k)]
            want.append((stratum, day, len(rows), max(fits) / 200 if fits else None))
    assert made == sorted(want, key=str)


def test_amended_strata_equal_the_batch_trigger(spark, tmp_path, orders):
    events = [("SEBI", START + dt.timedelta(days=9, hours=1)), ("SEBI", START + dt.timedelta(days=9, hours=7)), ("*", START + dt.timedelta(days=2))]
    results = []
    for name, rows, files, told in (("a", orders[0], 1, events), ("b", orders[1], 4, events[::-1])):
        amendments = stream(spark, tmp_path / f"{name}e", told, 2 if name == "b" else 1, "regulator string, ts timestamp", 1)
        results.append(collected(spark, monitor.amended_strata(stream(spark, tmp_path / name, rows, files), amendments, ["RBI", "SEBI"], horizon=3, late="30 days")))
    assert results[0] == results[1]
    batch = spark.createDataFrame(orders[0], SCHEMA)
    told = spark.createDataFrame(events, "regulator string, ts timestamp").withColumn("day", F.to_date("ts"))
    for since in ("2024-01-01", "2024-01-05", "2024-02-01"):
        strata = certify.triggered(batch.select("regulator", "kind").distinct(), told, since)
        kept = {(r, k) for r, k, _, _, amended, _ in results[0] if str(amended) >= since}
        assert kept == {tuple(r) for r in strata.collect()}
    counts = {(r[1], r[2], r[3].date()): 0 for r in orders[0]}
    for r in orders[0]:
        counts[r[1], r[2], r[3].date()] += 1
    for regulator, kind, day, n, amended, n_amendments in results[0]:
        assert n == counts[regulator, kind, day] and 0 <= (amended - day).days <= 3
        assert n_amendments == sum(e[1].date() == amended and e[0] in (regulator, "*") for e in events)


def test_rows_behind_the_watermark_are_left_out(spark, tmp_path):
    rows = [("a|b", "a", "b", START + dt.timedelta(days=d), 0.5, 0) for d in range(4)]
    later = [("a|b", "a", "b", START + dt.timedelta(days=d), 0.5, 0) for d in (40, 60, 61)]  # a batch after the one that closes the days
    late = [*rows, *later, ("a|b", "a", "b", START + dt.timedelta(days=1), 0.1, 0)]
    made = collected(spark, monitor.sliding_calibration(stream(spark, tmp_path / "a", late, len(late)), days=9, late="2 days"))
    assert [r[2] for r in made] == [1, 2, 3, 4, 1, 1, 2]
