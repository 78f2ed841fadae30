"""Views of the given tables that stand in for questions, atoms, versions and evidence.

Atoms come from ``events``: the user is the question, the event type the kind of atom, the value its
risk. Versions come from ``orders``: a customer is a section, each of its orders a version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdara.operators.temporal import with_ends


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_atoms(events: DataFrame) -> DataFrame:
    kind = F.when(F.col("event_type") == "view", "RATE").when(F.col("event_type") == "click", "THRESHOLD").when(F.col("event_type") == "signup", "DATE").when(F.col("event_type") == "purchase", "SECTION").otherwise("ENTITY")
    regulator = F.when(F.col("user_id") % 3 == 0, "RBI").when(F.col("user_id") % 3 == 1, "SEBI").otherwise("IRDAI")
    risk = F.floor(F.least("value", F.lit(200.0)) * 50 + 0.5) / 10000
    rows = events.select(F.col("event_id").alias("atom"), F.col("user_id").alias("question"), kind.alias("kind"), regulator.alias("regulator"), risk.alias("risk"), F.to_date("ts").alias("day"), F.col("value"), "ts")
    return rows.withColumn("wrong", (F.col("atom") * 7919 % 1000 < 1000 * F.col("risk") * F.col("risk")).cast("int"))


def atoms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_atoms(table(spark, sf_dir, "events")).drop("ts")


REGULATORS = ["RBI", "SEBI", "IRDAI"]


def as_amendments(orders: DataFrame) -> DataFrame:
    """Large orders as amendments of the month of the atoms: ``regulator, ts``; some are of all regulators."""
    regulator = F.when(F.col("o_custkey") % 7 == 0, "*").when(F.col("o_custkey") % 7 < 3, "RBI").when(F.col("o_custkey") % 7 < 6, "SEBI").otherwise("IRDAI")
    ts = F.expr("timestamp '2024-01-01 12:00:00' + make_dt_interval(datediff(o_orderdate, date '1995-01-01') % 30)")
    return orders.where("o_totalprice > 498500").select(regulator.alias("regulator"), ts.alias("ts"))


AMENDMENTS = """
amendments AS (
  SELECT CASE WHEN o_custkey % 7 = 0 THEN '*' WHEN o_custkey % 7 < 3 THEN 'RBI' WHEN o_custkey % 7 < 6 THEN 'SEBI' ELSE 'IRDAI' END AS regulator,
    TIMESTAMP '2024-01-01 12:00:00' + to_days(CAST(date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) % 30 AS INTEGER)) AS ts
  FROM orders WHERE o_totalprice > 498500)
"""


ATOMS = """
atoms AS (
  SELECT *, CAST(atom * 7919 % 1000 < 1000 * risk * risk AS INTEGER) AS wrong FROM (
    SELECT event_id AS atom, user_id AS question,
      CASE event_type WHEN 'view' THEN 'RATE' WHEN 'click' THEN 'THRESHOLD' WHEN 'signup' THEN 'DATE' WHEN 'purchase' THEN 'SECTION' ELSE 'ENTITY' END AS kind,
      CASE user_id % 3 WHEN 0 THEN 'RBI' WHEN 1 THEN 'SEBI' ELSE 'IRDAI' END AS regulator,
      floor(least(value, 200.0) * 50 + 0.5) / 10000 AS risk, CAST(ts AS DATE) AS day, value, ts
    FROM events))
"""


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("section"), F.col("o_orderkey").alias("version"), F.to_date("o_orderdate").alias("effective_from"))
    return with_ends(rows)


VERSIONS = """
versions AS (
  SELECT o_custkey AS section, o_orderkey AS version, CAST(o_orderdate AS DATE) AS effective_from,
    CAST(lead(CAST(o_orderdate AS DATE)) OVER (PARTITION BY o_custkey ORDER BY CAST(o_orderdate AS DATE), o_orderkey) - INTERVAL 1 DAY AS DATE) AS effective_to
  FROM orders)
"""

TOKENS = r"list_filter(list_transform(regexp_extract_all(lower(text), '[a-z0-9\-\./%\(\)]+'), lambda t: regexp_replace(t, '\.+$', '')), lambda t: length(t) > 1)"
