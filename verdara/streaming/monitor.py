"""Structured Streaming: acceptance windows with late data, drift monitor, sliding calibration, joined amendments.

The stateful operators work on days that the watermark has closed: a windowed aggregate counts each day's
rows by cell, and only its final counts go on to the state of a stratum. So results don't depend on the order in which rows
arrive within the watermark, nor on how the stream is cut into batches; rows later than that are left out.
Rows without a time are in no day, and rows without a risk in no cell; strata without rows give no row.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle, TimerValues
from pyspark.sql.types import StructType

from verdara.operators.guarantee import accepted_from

#: Cells of a risk histogram: risks rounded to hundredths.
CELLS = 101


def acceptance_windows(atoms: DataFrame, accept: float, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """Counts and accepted rows per kind and tumbling window of ``atoms(ts timestamp, kind, risk)``; batch or stream."""
    rows = atoms.withWatermark("ts", late)
    made = rows.groupBy(F.window("ts", width), "kind").agg(F.count("*").alias("n"), F.count_if(F.col("risk") <= accept).alias("n_accepted"))
    return made.select(F.col("window.start").alias("start"), "kind", "n", "n_accepted")


def sessions(atoms: DataFrame, gap: str = "6 hours", late: str = "2 days") -> DataFrame:
    """Rows of one question without a pause of ``gap`` make a session."""
    made = atoms.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "question").agg(F.count("*").alias("n"))
    return made.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "question", "n")


def closed_days(rows: DataFrame, by: list[str], cell: Column, **sums: Column) -> DataFrame:
    """``window, by, cell, n, sums`` of every day and cell of watermarked rows, once the watermark has passed the day."""
    keyed = rows.withColumn("cell", cell)
    return keyed.groupBy(F.window("ts", "1 day"), *by, "cell").agg(F.count("*").alias("n"), *(F.sum(c).alias(name) for name, c in sums.items()))


def kolmogorov(n_a: int, n_b: int, gap: float) -> float:
    """Asymptotic p-value of the two-sample distance; 1 with under five rows on a side."""
    if min(n_a, n_b) < 5:
        return 1.0
    x = n_a * n_b / (n_a + n_b) * gap * gap
    if x < 0.02:
        return 1.0
    j = np.arange(1, 101)
    return float(np.clip(2 * np.sum(np.where(j % 2 == 1, 1.0, -1.0) * np.exp(-2.0 * j * j * x)), 0, 1))


def discrepancy(a: np.ndarray, b: np.ndarray, gamma: float) -> float:
    """Squared maximum mean discrepancy of two histograms over the cells, at least 0; 0 with an empty side."""
    if not a.sum() or not b.sum():
        return 0.0
    v = np.arange(len(a)) / (len(a) - 1)
    gap = a / a.sum() - b / b.sum()
    return float(max(0.0, gap @ np.exp(-gamma * (v[:, None] - v) ** 2) @ gap))


def _days(rows: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.Timestamp, pd.DataFrame]]:
    """The closed days of one call in their order; a day is closed once, so later calls hold later days."""
    held = [part for part in rows if len(part)]
    if held:
        yield from pd.concat(held).groupby("day", sort=True)


class DriftProcessor(StatefulProcessor):
    """Per stratum: the reference histogram, the recent one, and whether an amendment waits."""

    def __init__(self, baseline: int, recent: int, p_limit: float, mmd_limit: float, gamma: float) -> None:
        self.baseline, self.recent, self.p_limit, self.mmd_limit, self.gamma = baseline, recent, p_limit, mmd_limit, gamma

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.histograms = handle.getValueState("histograms", "reference array<bigint>, recent array<bigint>, waiting boolean")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        reference, recent, waiting = np.zeros(CELLS, np.int64), np.zeros(CELLS, np.int64), False
        if self.histograms.exists():
            held = self.histograms.get()
            reference, recent, waiting = np.array(held[0], np.int64), np.array(held[1], np.int64), bool(held[2])
        out = []
        for day, part in _days(rows):
            plain = part[part["cell"] >= 0]
            counts = np.bincount(plain["cell"], plain["n"], CELLS).astype(np.int64)
            waiting = waiting or bool((part["cell"] < 0).any())
            if reference.sum() < self.baseline:
                reference += counts
                continue
            recent += counts
            n_a, n_b = int(reference.sum()), int(recent.sum())
            if n_b < self.recent:
                continue
            gap = float(np.abs(np.cumsum(reference) / n_a - np.cumsum(recent) / n_b).max())
            p, mmd2 = kolmogorov(n_a, n_b, gap), discrepancy(reference, recent, self.gamma)
            drift = p < self.p_limit or mmd2 > self.mmd_limit or waiting
            out.append((key[0], day.date(), n_a, n_b, gap if min(n_a, n_b) >= 5 else 0.0, p, mmd2, waiting, drift))
            if drift:  # recalibration is asked for, the recent rows start anew
                recent, waiting = np.zeros(CELLS, np.int64), False
        self.histograms.update((reference.tolist(), recent.tolist(), waiting))
        yield pd.DataFrame(out, columns=["stratum", "day", "n_reference", "n_recent", "ks", "p", "mmd2", "triggered", "drift"])

    def close(self) -> None:
        pass


def drift_monitor(atoms: DataFrame, amendments: DataFrame | None = None, baseline: int = 100, recent: int = 30, p_limit: float = 0.05, mmd_limit: float = 0.01, gamma: float = 1.0, late: str = "2 days") -> DataFrame:
    """A row per stratum and closed day with at least ``recent`` rows since the last alarm.

    ``atoms(stratum, ts, risk)``; ``amendments(stratum, ts)`` name strata whose rules changed. The days up to the one that brings
    a stratum to ``baseline`` rows are its reference. Drift is a Kolmogorov-Smirnov p-value below ``p_limit``, a discrepancy
    above ``mmd_limit``, or an amendment since the last alarm; an alarm empties the recent rows. State per stratum is two histograms.
    """
    rows = atoms.withWatermark("ts", late).select("stratum", "ts", "risk")
    if amendments is not None:  # each side has its watermark, so that the slower one decides which days are closed
        rows = rows.unionByName(amendments.withWatermark("ts", late).select("stratum", "ts", F.lit(-1.0).alias("risk")))
    cell = F.when(F.col("risk") < 0, -1).otherwise(F.round(F.least("risk", F.lit(1.0)) * (CELLS - 1)).cast("int"))
    days = closed_days(rows.where("risk IS NOT NULL"), ["stratum"], cell).select("stratum", F.col("window.start").alias("day"), "cell", "n")
    shape = StructType.fromDDL("stratum string, day date, n_reference bigint, n_recent bigint, ks double, p double, mmd2 double, triggered boolean, drift boolean")
    return days.groupBy("stratum").transformWithStateInPandas(DriftProcessor(baseline, recent, p_limit, mmd_limit, gamma), shape, "Append", "None")


class CalibrationProcessor(StatefulProcessor):
    """Per stratum: the per-step counts of the days in the window, as a list of days."""

    def __init__(self, days: int, eps: float, steps: int) -> None:
        self.days, self.eps, self.steps = days, eps, steps

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.window = handle.getListState("window", "day date, n array<bigint>, k array<bigint>")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        held = [(day, np.array(n, np.int64), np.array(k, np.int64)) for day, n, k in (self.window.get() if self.window.exists() else ())]
        total, wrong = (sum((h[i] for h in held), np.zeros(self.steps + 1, np.int64)) for i in (1, 2))
        out = []
        for at, part in _days(rows):
            day = at.date()
            n, k = (np.bincount(part["cell"], part[c], self.steps + 1).astype(np.int64) for c in ("n", "wrong"))
            held.append((day, n, k))
            total, wrong = total + n, wrong + k
            while (day - held[0][0]).days >= self.days:
                _, n, k = held.pop(0)
                total, wrong = total - n, wrong - k
            accepted, errors = np.cumsum(total), np.cumsum(wrong)
            fits = np.flatnonzero((accepted > 0) & (errors <= self.eps * accepted))
            out.append((key[0], day, int(accepted[-1]), float(fits[-1] / self.steps) if len(fits) else math.nan))
        self.window.put([(day, n.tolist(), k.tolist()) for day, n, k in held])
        yield pd.DataFrame(out, columns=["stratum", "day", "n", "threshold"])

    def close(self) -> None:
        pass


def sliding_calibration(atoms: DataFrame, days: int = 180, eps: float = 0.05, steps: int = 200, late: str = "2 days") -> DataFrame:
    """For every closed day the threshold of the window of ``days`` days that ends with it; NULL where none fits.

    ``atoms(stratum, ts, risk, wrong)``. The threshold is the largest step at which the share of wrong rows among those accepted is at
    most ``eps``. State per stratum is the per-step counts of the days in the window: a day enters and another leaves, rows aren't kept.
    """
    cell = F.least(F.greatest(accepted_from(F.col("risk"), steps), F.lit(0)), F.lit(steps))
    rows = atoms.withWatermark("ts", late).where("risk IS NOT NULL AND wrong IS NOT NULL")
    counted = closed_days(rows, ["stratum"], cell, wrong=F.col("wrong"))
    made = counted.select("stratum", F.col("window.start").alias("day"), "cell", "n", "wrong")
    shape = StructType.fromDDL("stratum string, day date, n bigint, threshold double")
    out = made.groupBy("stratum").transformWithStateInPandas(CalibrationProcessor(days, eps, steps), shape, "Append", "None")
    return out.withColumn("threshold", F.when(~F.isnan("threshold"), F.col("threshold")))


def amended_strata(atoms: DataFrame, amendments: DataFrame, regulators: list[str], horizon: int = 30, late: str = "2 days") -> DataFrame:
    """Strata whose atoms of a day are followed, within ``horizon`` days, by amendments of their regulator or of all (``*``).

    ``atoms(regulator, kind, ts)`` and ``amendments(regulator, ts)`` are streams; both are counted by day before the join, so a
    frequent stratum is one row a day. Watermarks on both sides and the bound on days let the join drop its state.
    ``regulators`` is the fixed set that ``*`` stands for. A row per stratum, its day and the day of amendments.
    """
    each = F.explode(F.when(F.col("regulator") == "*", F.array(*map(F.lit, regulators))).otherwise(F.array("regulator")))
    events = amendments.withWatermark("ts", late).select("ts", each.alias("of"))
    left = atoms.withWatermark("ts", late).groupBy(F.window("ts", "1 day"), "regulator", "kind").agg(F.count("*").alias("n"))
    left = left.select("regulator", "kind", "n", F.window_time("window").alias("atom_time"))
    right = events.groupBy(F.window("ts", "1 day"), "of").agg(F.count("*").alias("n_amendments")).select("of", "n_amendments", F.window_time("window").alias("amended_time"))
    near = F.expr(f"of = regulator AND amended_time >= atom_time AND amended_time <= atom_time + INTERVAL {horizon} DAYS")
    made = left.join(right, near)
    return made.select("regulator", "kind", F.to_date("atom_time").alias("day"), "n", F.to_date("amended_time").alias("amended"), "n_amendments")
