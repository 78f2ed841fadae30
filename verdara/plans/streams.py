"""Streaming queries: the events table as a stream, run to its end, with the result as a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from verdara.operators.decide import stratum
from verdara.operators.retrieval import scratch
from verdara.plans.data import AMENDMENTS, ATOMS, REGULATORS, as_amendments, as_atoms, atoms, table
from verdara.streaming import monitor

KINDS = ["RATE", "THRESHOLD", "DATE", "SECTION", "ENTITY"]


def drained(spark: SparkSession, stream: DataFrame, mode: str) -> DataFrame:
    """Run a stream over what there is now and return what its sink holds: files in the shared folder.

    State is kept by RocksDB, which the stateful processors need; the session's own setting is put back.
    """
    path, setting = scratch(spark, "streams"), "spark.sql.streaming.stateStore.providerClass"

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/out/batch={number}")  # the same batch overwrites itself: exactly once

    before = spark.conf.get(setting)
    spark.conf.set(setting, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        query = stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.set(setting, before)
    return spark.read.schema(stream.schema).option("recursiveFileLookup", "true").parquet(f"{path}/out")


def _source(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    schema = table(spark, sf_dir, name).schema
    return spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/{name}.parquet*")


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The atoms of ``plans.data`` as a stream."""
    return as_atoms(_source(spark, sf_dir, "events")).withColumn("ts", F.col("ts").cast("timestamp"))


def _amendments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_amendments(_source(spark, sf_dir, "orders"))


def stream_acceptance(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = monitor.acceptance_windows(_stream(spark, sf_dir), 0.35)
    out = drained(spark, made, "update").groupBy("start", "kind").agg(F.max("n").alias("n"), F.max("n_accepted").alias("n_accepted"))
    return out.select(F.to_date("start").alias("day"), "kind", "n", "n_accepted")


def event_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("question"))
    return monitor.sessions(rows).groupBy("question").agg(F.count("*").alias("n_sessions"), F.sum("n").alias("n_events"), F.max("n").alias("longest"))


def _stratum() -> Column:
    return stratum(F.col("regulator"), F.col("kind")).alias("stratum")


def drift_monitor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drift of the risks of each stratum by event time; amendments of a regulator wake all its strata."""
    rows = _stream(spark, sf_dir).select(_stratum(), "ts", "risk")
    kinds = F.explode(F.array(*map(F.lit, KINDS))).alias("kind")
    of = F.explode(F.when(F.col("regulator") == "*", F.array(*map(F.lit, REGULATORS))).otherwise(F.array("regulator"))).alias("regulator")
    woken = _amendments(spark, sf_dir).select("ts", of).select("ts", "regulator", kinds).select(_stratum(), "ts")
    made = drained(spark, monitor.drift_monitor(rows, woken), "append")
    return made.withColumns({c: F.round(c, 6) for c in ("ks", "p", "mmd2")})


def stream_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thresholds of windows of ten days, one for every day."""
    rows = _stream(spark, sf_dir).select(_stratum(), "ts", "risk", "wrong")
    return drained(spark, monitor.sliding_calibration(rows, days=10, eps=0.02), "append")


def stream_amended(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strata with amendments within five days after their atoms."""
    made = monitor.amended_strata(_stream(spark, sf_dir).select("regulator", "kind", "ts"), _amendments(spark, sf_dir), REGULATORS, horizon=5)
    return drained(spark, made, "append")


def daily_acceptance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return atoms(spark, sf_dir).groupBy("day", "regulator").agg(F.count("*").alias("n"), F.count_if(F.col("risk") <= 0.35).alias("n_accepted"))


QUERIES = {f.__name__: f for f in (stream_acceptance, event_sessions, drift_monitor, stream_calibration, stream_amended, daily_acceptance)}

_STRATUM = "regulator || '|' || kind"
_ALL = "CASE WHEN regulator = '*' THEN ['RBI', 'SEBI', 'IRDAI'] ELSE [regulator] END"
_PLUS = "list_transform(list_zip({a}, {b}), lambda x: x[1] + x[2])"
_ZEROS = "list_transform(range(0, 101), lambda i: 0::BIGINT)"
#: One day after the other, as the stream folds them: r is the state of each stratum after its day i.
_DRIFT = f"""WITH RECURSIVE {ATOMS}, {AMENDMENTS}, wm AS (SELECT least((SELECT max(ts) FROM atoms), (SELECT max(ts) FROM amendments)) - INTERVAL 2 DAY AS w),
h AS (SELECT {_STRATUM} AS stratum, day, CAST(round(least(risk, 1) * 100) AS INTEGER) AS cell, count(*) AS n FROM atoms GROUP BY ALL
  UNION ALL SELECT regulator || '|' || kind, day, -1, 1 FROM (SELECT unnest({_ALL}) AS regulator, CAST(ts AS DATE) AS day FROM amendments), (SELECT DISTINCT kind FROM atoms)),
d AS (SELECT stratum, day, bool_or(cell < 0) AS woken, list_transform(range(0, 101), lambda i: CAST(coalesce(map_extract(m, i)[1], 0) AS BIGINT)) AS counts, row_number() OVER (PARTITION BY stratum ORDER BY day) AS i
  FROM (SELECT stratum, day, cell, n, map_from_entries(list((cell, n)) FILTER (cell >= 0) OVER (PARTITION BY stratum, day)) AS m FROM h, wm WHERE day + INTERVAL 1 DAY <= w) GROUP BY stratum, day, m),
r AS (SELECT DISTINCT stratum, 0::BIGINT AS i, {_ZEROS} AS ref, {_ZEROS} AS rec, false AS waiting, NULL::DATE AS day, NULL::BIGINT AS na, NULL::BIGINT AS nb, NULL::DOUBLE AS ks, NULL::DOUBLE AS p, NULL::DOUBLE AS mmd2, false AS triggered, false AS drift, false AS tested FROM d
  UNION ALL SELECT stratum, i, ref, CASE WHEN tested AND drift THEN {_ZEROS} ELSE rec END, waiting AND NOT (tested AND drift), day, na, nb, ks, p, mmd2, waiting, drift, tested FROM
   (SELECT *, p < 0.05 OR mmd2 > 0.01 OR waiting AS drift FROM
    (SELECT *, CASE WHEN na < 5 OR nb < 5 OR x < 0.02 THEN 1 ELSE least(greatest(2 * list_sum(list_transform(range(1, 101), lambda j: CASE WHEN j % 2 = 1 THEN 1 ELSE -1 END * exp(-2.0::DOUBLE * j * j * x))), 0), 1) END AS p,
       greatest(0, list_sum(list_transform(range(0, 101), lambda i: g[i + 1] * list_sum(list_transform(range(0, 101), lambda j: g[j + 1] * exp(-pow((i - j) / 100.0::DOUBLE, 2))))))) AS mmd2 FROM
     (SELECT *, na * nb / (na + nb)::DOUBLE * ks * ks AS x FROM
      (SELECT *, list_max(list_transform(range(1, 102), lambda i: abs(list_sum(g[1:i])))) AS ks FROM
       (SELECT *, list_transform(list_zip(ref, rec), lambda x: x[1] / na::DOUBLE - x[2] / nb::DOUBLE) AS g, NOT filling AND nb >= 30 AS tested FROM
        (SELECT *, CAST(list_sum(ref) AS BIGINT) AS na, CAST(list_sum(rec) AS BIGINT) AS nb FROM
         (SELECT r.stratum, d.i, d.day, r.waiting OR d.woken AS waiting, list_sum(r.ref) < 100 AS filling,
            CASE WHEN list_sum(r.ref) < 100 THEN {_PLUS.format(a='r.ref', b='d.counts')} ELSE r.ref END AS ref, CASE WHEN list_sum(r.ref) < 100 THEN r.rec ELSE {_PLUS.format(a='r.rec', b='d.counts')} END AS rec
          FROM r JOIN d ON d.stratum = r.stratum AND d.i = r.i + 1)))))))
)
SELECT stratum, day, na AS n_reference, nb AS n_recent, round(ks, 6) AS ks, round(p, 6) AS p, round(mmd2, 6) AS mmd2, triggered, drift FROM r WHERE tested"""

ORACLES = {
    "stream_acceptance": f"WITH {ATOMS} SELECT day, kind, count(*) AS n, count(*) FILTER (risk <= 0.35) AS n_accepted FROM atoms GROUP BY day, kind",
    "event_sessions": """WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events),
s AS (SELECT user_id, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM g), c AS (SELECT user_id, session, count(*) AS n FROM s GROUP BY ALL)
SELECT user_id AS question, count(*) AS n_sessions, CAST(sum(n) AS BIGINT) AS n_events, max(n) AS longest FROM c GROUP BY user_id""",
    "daily_acceptance": f"WITH {ATOMS} SELECT day, regulator, count(*) AS n, count(*) FILTER (risk <= 0.35) AS n_accepted FROM atoms GROUP BY day, regulator",
    "drift_monitor": _DRIFT,
    "stream_calibration": f"""WITH {ATOMS}, c AS (SELECT {_STRATUM} AS stratum, day, least(greatest(CAST(ceil(risk * 200 - 1e-9) AS INTEGER), 0), 200) AS step, count(*) AS n, sum(wrong) AS k FROM atoms
  WHERE day + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 2 DAY FROM atoms) GROUP BY ALL),
w AS (SELECT e.stratum, e.day, step, sum(n) AS n, sum(k) AS k FROM (SELECT DISTINCT stratum, day FROM c) e JOIN c ON c.stratum = e.stratum AND c.day <= e.day AND c.day > e.day - INTERVAL 10 DAY GROUP BY ALL),
u AS (SELECT stratum, day, step, sum(n) OVER v AS n, sum(k) OVER v AS k, lead(step) OVER v AS after FROM w WINDOW v AS (PARTITION BY stratum, day ORDER BY step))
SELECT stratum, day, CAST(max(n) AS BIGINT) AS n, max(coalesce(after - 1, 200)) FILTER (k <= 0.02::DOUBLE * n) / 200.0::DOUBLE AS threshold FROM u GROUP BY stratum, day""",
    "stream_amended": f"""WITH {ATOMS}, {AMENDMENTS}, wm AS (SELECT least((SELECT max(ts) FROM atoms), (SELECT max(ts) FROM amendments)) - INTERVAL 2 DAY AS w),
a AS (SELECT regulator, kind, day, count(*) AS n FROM atoms, wm WHERE day + INTERVAL 1 DAY <= w GROUP BY ALL),
e AS (SELECT regulator, amended, count(*) AS n_amendments FROM (SELECT unnest({_ALL}) AS regulator, CAST(ts AS DATE) AS amended FROM amendments), wm WHERE amended + INTERVAL 1 DAY <= w GROUP BY ALL)
SELECT regulator, kind, day, n, amended, n_amendments FROM a JOIN e USING (regulator) WHERE amended BETWEEN day AND day + INTERVAL 5 DAY""",
}
