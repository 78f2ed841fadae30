"""Versioned facts: the version in force at a date, the hard temporal filter, and temporal entropy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FOREVER = "9999-12-31"


def with_ends(versions: DataFrame, section: str = "section", start: str = "effective_from") -> DataFrame:
    """Adds ``effective_to``, the day before the next version of the section starts."""
    nxt = F.lead(start).over(Window.partitionBy(section).orderBy(start, "version"))
    return versions.withColumn("effective_to", F.date_sub(nxt, 1))


def in_force(questions: DataFrame, versions: DataFrame) -> DataFrame:
    """As-of join: the latest version of ``questions.section`` with from <= ``as_of`` <= to.

    Joined on the section by shuffle; of the versions that apply the latest is kept by an aggregate, so
    a section with very many questions needs no window over all of them.
    """
    applies = (F.col("as_of") >= F.col("effective_from")) & (F.col("as_of") <= F.coalesce("effective_to", F.lit(FOREVER).cast("date")))
    latest = F.max(F.struct("effective_from", "version"))
    return questions.join(versions, "section").where(applies).groupBy("question", "section", "as_of").agg(latest.alias("m")).select("question", "section", "as_of", F.col("m.version").alias("version"), F.col("m.effective_from").alias("effective_from"))


def current(as_of: Column, start: Column, end: Column) -> Column:
    """Hard filter: started and not expired; NULL bounds pass; both bounds inclusive."""
    return (start.isNull() | (start <= as_of)) & (end.isNull() | (end >= as_of))


def recency(as_of: Column, issued: Column, half_life_days: float = 365.0) -> Column:
    """0 without a query date, 0.5 without an issue date, else 1 - exp(-age / half life)."""
    age = F.greatest(F.datediff(as_of, issued), F.lit(0))
    return F.when(as_of.isNull(), F.lit(0.0)).when(issued.isNull(), F.lit(0.5)).otherwise(1 - F.exp(-age / half_life_days))


def ambiguity(start: Column, end: Column, year: float = 365.0) -> Column:
    """0 while a version has no end, 0.5 with an end but no start, else a year over the days in force, 1 at most."""
    days = F.greatest(F.datediff(end, start), F.lit(1))
    return F.when(end.isNull(), F.lit(0.0)).when(start.isNull(), F.lit(0.5)).otherwise(F.least(F.lit(1.0), year / days))


def entropy(recent: Column, ambiguous: Column) -> Column:
    return F.round(0.6 * F.round(recent, 4) + 0.4 * F.round(ambiguous, 4), 4)


def amendment_events(versions: DataFrame) -> DataFrame:
    """Dates at which an existing section got a further version."""
    rank = F.row_number().over(Window.partitionBy("section").orderBy("effective_from", "version"))
    return versions.withColumn("n", rank).where("n > 1").groupBy("effective_from").agg(F.count("*").alias("n_sections"))


def superseded_sections(versions: DataFrame, as_of: Column) -> DataFrame:
    """``section, active``: the version of each section in force at one date."""
    applies = (F.col("effective_from") <= as_of) & (F.coalesce("effective_to", F.lit(FOREVER).cast("date")) >= as_of)
    return versions.where(applies).groupBy("section").agg(F.max(F.struct("effective_from", "version"))["version"].alias("active"))


def temporal_filter(chunks: DataFrame, versions: DataFrame, as_of: Column) -> DataFrame:
    """The hard filter over ``chunks(section, version, effective_from, effective_to, ...)``.

    Out go chunks of another version than the one in force (a section without one passes), and those
    not yet effective or expired at the date.
    """
    joined = chunks.join(superseded_sections(versions, as_of), "section", "left")
    kept = F.col("active").isNull() | (F.col("active") == F.col("version"))
    return joined.where(kept & current(as_of, F.col("effective_from"), F.col("effective_to"))).drop("active")
