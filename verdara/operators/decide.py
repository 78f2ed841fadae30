"""Signals, fallback risk, threshold routing and answer-level decisions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed weights of the fallback risk; the two marked signals are inverted.
WEIGHTS = {"s_ver": 0.30, "s_nli": 0.25, "s_ent": 0.15, "s_ret": 0.10, "s_div": 0.10, "s_mech": 0.10}
INVERTED = ("s_ret", "s_div")


def s_ver(status: Column) -> Column:
    return F.when(status == "MATCH", 0.0).when(status == "MISMATCH", 1.0).when(status == "NOT_FOUND", 0.6).otherwise(0.5)


def mean_entropy(logprobs: Column, start: Column, stop: Column, most: float = 5.0) -> Column:
    """Mean negative log-probability of a token span, each clipped; NULL for an empty span."""
    span = F.slice(logprobs, F.greatest(start, F.lit(0)) + 1, F.greatest(stop - start, F.lit(0)))
    total = F.aggregate(span, F.lit(0.0), lambda t, x: t + F.least(-x, F.lit(most)))
    return F.try_divide(total, F.size(span))


def divergence(p: Column, q: Column) -> Column:
    """KL divergence of two log-probability lists over p, per five nats, at most 1."""
    kl = F.aggregate(F.zip_with(p, q, lambda a, b: F.exp(a) * (a - b)), F.lit(0.0), lambda t, x: t + F.coalesce(x, F.lit(0.0)))
    return F.least(F.greatest(kl / 5, F.lit(0.0)), F.lit(1.0))


def min_max(score: Column, by) -> Column:
    low, high = F.min(score).over(by), F.max(score).over(by)
    return F.when(high > low, (score - low) / (high - low)).otherwise(F.lit(0.5))


def fallback_risk(signals: dict[str, Column] | None = None) -> Column:
    """Weighted mean of the signals that are present; NULL if none is. NaN counts as missing."""
    signals = signals or {n: F.col(n) for n in WEIGHTS}
    clean = {n: F.when(~F.isnan(c), c) for n, c in signals.items()}
    value = {n: 1 - c if n in INVERTED else c for n, c in clean.items()}
    top = reduce(lambda a, b: a + b, (F.coalesce(WEIGHTS[n] * value[n], F.lit(0.0)) for n in signals))
    bottom = reduce(lambda a, b: a + b, (F.when(clean[n].isNotNull(), WEIGHTS[n]).otherwise(0.0) for n in signals))
    return F.try_divide(top, bottom)


def stratum(regulator: Column, kind: Column) -> Column:
    part = lambda c: F.coalesce(F.nullif(F.upper(F.trim(c)), F.lit("")), F.lit("*"))
    return F.concat_ws("|", part(regulator), part(kind))


def with_thresholds(atoms: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Thresholds of the narrowest stratum present: regulator and kind, any regulator, any at all.

    The strata are a small fixed set (regulators times kinds), so they are broadcast.
    """
    limits = thresholds.select("stratum", F.struct("accept_below", "abstain_above", "stratum").alias("t"))
    out = atoms
    for i, key in enumerate((stratum(F.col("regulator"), F.col("kind")), stratum(F.lit("*"), F.col("kind")), F.lit("*|*"))):
        out = out.withColumn(f"_k{i}", key).join(F.broadcast(limits.select(F.col("stratum").alias(f"_k{i}"), F.col("t").alias(f"_t{i}"))), f"_k{i}", "left")
    found = F.coalesce("_t0", "_t1", "_t2")
    out = out.withColumn("accept_below", found["accept_below"]).withColumn("abstain_above", found["abstain_above"]).withColumn("stratum_used", found["stratum"])
    return out.drop(*(f"_{x}{i}" for x in "kt" for i in range(3)))


def route(risk: Column, accept: Column, abstain: Column) -> Column:
    """Accept up to the threshold, abstain from the upper one, uncertain between; no threshold abstains; NaN is uncertain."""
    return F.when(accept.isNull() | risk.isNull(), "ABSTAINED").when(F.isnan(risk), "UNCERTAIN").when(risk <= accept, "ACCEPTED").when(risk >= abstain, "ABSTAINED").otherwise("UNCERTAIN")


def badge(risk: Column) -> Column:
    """Up to 0.25 low, up to 0.60 medium; risks outside the unit interval count as its ends."""
    r = F.least(F.greatest(risk, F.lit(0.0)), F.lit(1.0))
    return F.when(r <= 0.25, "LOW").when(r <= 0.60, "MEDIUM").otherwise("HIGH")


# Fixed marks and labels of statuses.
STATUS_MARKS = {"SUPPORTED": "✅", "VERIFIED": "✅", "UNCERTAIN": "⚠️", "ABSTAINED": "🚫", "NOT_VERIFIED": "❌"}
ANSWER_LABELS = {"FULLY_SUPPORTED": ("Fully Verified", "✅"), "PARTIALLY_VERIFIED": ("Partially Verified", "⚠️"), "ABSTAINED": ("Cannot Be Verified", "🚫")}
OTHER_MARK = "ℹ️"


def status_badge(status: Column) -> Column:
    """Label (upper case, trimmed; empty for NULL) and mark of an atom's status; a neutral mark for others."""
    label = F.upper(F.trim(F.coalesce(status, F.lit(""))))
    mark = F.lit(OTHER_MARK)
    for name, sign in STATUS_MARKS.items():
        mark = F.when(label == name, sign).otherwise(mark)
    return F.struct(label.alias("label"), mark.alias("mark"))


def answer_badge(status: Column) -> Column:
    """Label and mark of an answer's status; another status is its own label."""
    label, mark = status, F.lit(OTHER_MARK)
    for name, (text, sign) in ANSWER_LABELS.items():
        label, mark = F.when(status == name, text).otherwise(label), F.when(status == name, sign).otherwise(mark)
    return F.struct(label.alias("label"), mark.alias("mark"))


def span_divergence(p: Column, q: Column, start: Column, stop: Column, characters: int = 4) -> Column:
    """Divergence over the tokens of a character span, ``characters`` to a token and at least one; NULL if the lists don't both cover
    the same tokens of it, or there is no span. Log-probabilities that underflow to 0 add nothing."""
    first = F.floor(start / characters).cast("int")
    n = F.greatest(first + 1, F.floor(stop / characters).cast("int")) - first
    cut = lambda x: F.slice(x, first + 1, n)
    some = (start >= 0) & (F.size(cut(p)) > 0) & (F.size(cut(p)) == F.size(cut(q)))
    kl = F.aggregate(F.zip_with(cut(p), cut(q), lambda a, b: F.when((F.exp(a) > 0) & (F.exp(b) > 0), F.exp(a) * (a - b)).otherwise(0.0)), F.lit(0.0), lambda t, x: t + F.coalesce(x, F.lit(0.0)))
    return F.when(some, F.least(F.greatest(kl / 5, F.lit(0.0)), F.lit(1.0)))


def chosen_divergence(p: Column, q: Column, start: Column, stop: Column, cosine: Column) -> Column:
    """The signal of an atom: by log-probabilities of its span where both lists cover it, else one minus the cosine of claim and the
    answer without context, to four digits; NULL where neither is known."""
    return F.coalesce(span_divergence(p, q, start, stop), F.round(1 - cosine, 4))


def combine(decided: DataFrame, answer: str = "question") -> DataFrame:
    """Counts, coverage and status of each answer from ``question, status``."""
    n = F.count("*")
    count = lambda s: F.count_if(F.col("status") == s)
    accepted, uncertain, abstained = count("ACCEPTED"), count("UNCERTAIN"), count("ABSTAINED")
    status = F.when(accepted == n, "FULLY_SUPPORTED").when(accepted == 0, "ABSTAINED").otherwise("PARTIALLY_SUPPORTED")
    return decided.groupBy(answer).agg(n.alias("n_total"), accepted.alias("n_accepted"), uncertain.alias("n_uncertain"), abstained.alias("n_abstained"), (accepted / n).alias("coverage"), status.alias("answer_status"))
