"""Certification and drift queries over atoms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdara.operators import certify as C
from verdara.operators import guarantee as G
from verdara.operators.decide import stratum
from verdara.plans.data import ATOMS, atoms, table
from verdara.plans.evaluation import _TAIL, _cum
from verdara.plans.evaluation import ORACLES as EVALUATED
from verdara.plans.facts import draw_sql

CUT, LATER = "2024-01-16", "2024-01-08"
BY = ["regulator", "kind"]
EPS = 0.2


def hb_pvalues(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = G.cumulative(atoms(spark, sf_dir), ["kind"], 20)
    return made.select("kind", "step", F.round(C.hb_pvalue("k", "n", 0.05), 6).alias("p"))


def quantile_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.quantile_grid(atoms(spark, sf_dir), ["regulator"])


def stratum_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = C.strata(atoms(spark, sf_dir), BY)
    return made.select(*BY, "n", F.round("risk", 6).alias("risk"), "n_strata", F.round(C.bonferroni(0.1), 8).alias("delta"))


def _named(spark: SparkSession, sf_dir: str) -> DataFrame:
    return atoms(spark, sf_dir).withColumn("stratum", stratum(F.col("regulator"), F.col("kind")))


def merged_strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strata of under a fifteenth of all atoms go to the widest one."""
    rows = _named(spark, sf_dir)
    return C.merged_strata(rows, -(-rows.count() // 15)).groupBy("merged").agg(F.count("*").alias("n"), F.sum("wrong").alias("wrong"))


def threshold_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = C.threshold_pairs(atoms(spark, sf_dir), BY, 0.05, 0.1)
    return made.select(*BY, "accept_below", F.round("abstain_above", 6).alias("abstain_above"))


def certified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calibrated on even atoms, judged on odd ones."""
    rows = atoms(spark, sf_dir)
    made = C.certify(rows.where("atom % 2 = 0"), rows.where("atom % 2 = 1"), BY, 0.05, 0.1)
    return made.select(*BY, "n", "accept_below", "status", "n_test", F.round("test_risk", 6).alias("test_risk"), F.round("test_coverage", 6).alias("test_coverage"))


def _undated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return atoms(spark, sf_dir).withColumn("day", F.when(F.col("atom") % 11 != 0, F.col("day")))


def sliding_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Atoms of the last month before 20 February 2024; those without a day stay."""
    return C.sliding_window(_undated(spark, sf_dir), "day", F.lit("2024-02-20").cast("date"), 1).groupBy("kind").agg(F.count("*").alias("n"), F.min("day").alias("first_day"))


def event_trigger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strata whose regulator has a large order since 1 July 1998 as an event."""
    regulator = F.when(F.col("o_custkey") % 5 == 0, "RBI").when(F.col("o_custkey") % 5 == 1, "SEBI").otherwise("OTHER")
    events = table(spark, sf_dir, "orders").where("o_totalprice > 100000").select(regulator.alias("regulator"), F.to_date("o_orderdate").alias("day"))
    return C.triggered(C.strata(atoms(spark, sf_dir), BY).select(*BY, "n"), events, "1998-07-01")


def ks_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = C.ks_test(atoms(spark, sf_dir), BY, F.col("day") >= F.lit(CUT).cast("date"), "risk")
    return made.select(*BY, "n_a", "n_b", F.round("ks", 6).alias("ks"), F.round("p", 6).alias("p"))


def weighted_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = atoms(spark, sf_dir).withColumn("w", (F.col("atom") % 4 + 1).cast("double"))
    return C.tuned_weighted(rows, BY, 0.05)


def resampled_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Certified on a sample of the effective size of each stratum, drawn by recency weights."""
    weight = G.recency_weight(F.col("day"), F.lit("2024-02-01").cast("date"), 20.0)
    drawn = G.weighted_sample(atoms(spark, sf_dir).withColumn("w", weight), BY, "w", "atom")
    sizes = drawn.groupBy(*BY).agg(F.max("n_eff").alias("n_eff"), F.count("*").alias("n"), F.sum("atom").alias("atoms"))
    return sizes.join(G.ltt(drawn, BY, 0.05, 0.1), BY)


def _strategies(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = atoms(spark, sf_dir)
    cut = F.lit(CUT).cast("date")
    return C.drift_strategies(rows.where(F.col("day") < cut), rows.where(F.col("day") >= cut), CUT, EPS, months=1, half_life=90.0)


def four_strategies(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = _strategies(spark, sf_dir)
    return made.withColumns({c: F.round(c, 6) for c in ("threshold", "coverage", "error", "violation_rate")})


def best_strategy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.best_strategy(_strategies(spark, sf_dir), 0.6)


QUERIES = {f.__name__: f for f in (hb_pvalues, quantile_grid, stratum_sizes, merged_strata, threshold_pairs, certified, sliding_calibration, event_trigger, ks_test, weighted_threshold, resampled_thresholds, four_strategies, best_strategy)}

_EVEN = f"WITH {ATOMS}, even AS (SELECT * FROM atoms WHERE atom % 2 = 0), {_cum('regulator, kind', 200, 'even')}, t AS (SELECT *, {_TAIL.format(eps='0.05::DOUBLE')} AS p FROM cum WHERE n >= 50), f AS (SELECT *, max(CAST(p > 0.1 AS INTEGER)) OVER (PARTITION BY regulator, kind ORDER BY step) AS failed FROM t)"
_TUNED = """cells AS (SELECT strategy, CAST(ceil(risk * 200 - 1e-9) AS INTEGER) AS step, sum(w) AS n, sum(w * wrong) AS k FROM tagged GROUP BY ALL),
run AS (SELECT strategy, step, sum(n) OVER v AS n, sum(k) OVER v AS k, lead(step) OVER v AS after FROM cells WINDOW v AS (PARTITION BY strategy ORDER BY step)),
best AS (SELECT strategy, max(coalesce(after - 1, 200)) AS step FROM run WHERE n > 0 AND k <= 0.05::DOUBLE * n GROUP BY strategy)"""
_KS = """h AS (SELECT {by}round(risk, 2) AS v, count(*) FILTER ({side} = 0) AS a, count(*) FILTER ({side} = 1) AS b FROM atoms GROUP BY ALL),
c AS (SELECT {by}sum(a) OVER p AS na, sum(b) OVER p AS nb, abs(sum(a) OVER o / (sum(a) OVER p)::DOUBLE - sum(b) OVER o / (sum(b) OVER p)::DOUBLE) AS gap FROM h WINDOW p AS ({part}), o AS ({part} ORDER BY v)),
m AS (SELECT {by}max(na) AS na, max(nb) AS nb, max(gap) AS gap FROM c {group}),
x AS (SELECT *, na * nb / (na + nb) * gap * gap AS x FROM m),
ks AS (SELECT {by}CAST(na AS BIGINT) AS n_a, CAST(nb AS BIGINT) AS n_b, CASE WHEN na < 5 OR nb < 5 THEN 0 ELSE gap END AS ks,
  CASE WHEN na < 5 OR nb < 5 OR x < 0.02 THEN 1 ELSE least(greatest(2 * list_sum(list_transform(range(1, 101), lambda j: CASE WHEN j % 2 = 1 THEN 1 ELSE -1 END * exp(-2.0::DOUBLE * j * j * x))), 0), 1) END AS p FROM x)"""
_SIDE = f"CAST(day >= DATE '{CUT}' AS INTEGER)"

def _half(u: str, marked: str, t: str, d: str) -> str:
    """Marked ones among ``d`` drawn of ``t``: the least number whose distribution function reaches u."""
    f = lambda x: f"CASE WHEN ({x}) < 2 THEN 0 ELSE lgamma(({x}) + 1) END"
    log = " ".join(f"{sign} {f(x)}" for sign, x in (("", marked), ("-", "j"), ("-", f"{marked} - j"), ("+", f"{t} - {marked}"), ("-", f"{d} - j"), ("-", f"{t} - {marked} - {d} + j"), ("-", t), ("+", d), ("+", f"{t} - {d}")))
    low, high = f"greatest(0, {d} - ({t} - {marked}))", f"least({marked}, {d})"
    return f"CAST(least({low} + list_reduce(list_transform(range({low}, {high} + 1), lambda j: [exp({log}), 0]), lambda a, b: [a[1] + b[1], a[2] + CASE WHEN a[1] + b[1] < {u} THEN 1 ELSE 0 END], [0.0::DOUBLE, 0])[2], {high}) AS BIGINT)"


_FOUR = f"""WITH {ATOMS}, pre AS (SELECT * FROM atoms WHERE day < DATE '{CUT}'), post AS (SELECT * FROM atoms WHERE day >= DATE '{CUT}'),
late AS (SELECT * FROM pre WHERE day >= DATE '{CUT}' - INTERVAL 30 DAY), win AS (SELECT * FROM late UNION ALL SELECT * FROM pre WHERE NOT EXISTS (FROM late)),
tagged AS (SELECT 'static' AS strategy, risk, wrong, 1.0::DOUBLE AS w FROM pre UNION ALL SELECT 'sliding_window', risk, wrong, 1.0 FROM win
  UNION ALL SELECT 'recency_weighted', risk, wrong, greatest(exp(-ln(2) * greatest(date_diff('day', day, DATE '{CUT}'), 0) / 90.0::DOUBLE), 1e-6) FROM pre),
{_TUNED.replace('* 200', '* 199').replace(', 200)', ', 199)').replace('0.05', str(EPS))},
c AS (SELECT s.strategy, s.n AS n_calibration, coalesce(step, 0) AS step FROM (SELECT strategy, count(*) AS n FROM tagged GROUP BY 1) s LEFT JOIN best USING (strategy)),
j AS (SELECT strategy, n_calibration, step, count(risk) AS n, CAST(coalesce(sum(wrong), 0) AS BIGINT) AS k, (SELECT count(*) FROM post) AS t FROM c LEFT JOIN post ON CAST(ceil(risk * 199 - 1e-9) AS INTEGER) <= step GROUP BY ALL),
h AS (SELECT *, {_half('u', 'k', 't', 'd')} AS x FROM (SELECT DISTINCT n, k, t, t - t // 2 AS d, i, {draw_sql("'wrong'", 'i')} AS u, {draw_sql("'right'", 'i')} AS v FROM j, (SELECT unnest(range(0, 200)) AS i))),
y AS (SELECT n, k, x, {_half('v', '(n - k)', '(t - k)', '(d - x)')} AS y FROM h),
v AS (SELECT n, k, avg(CAST(x + y > 0 AND x > {EPS}::DOUBLE * (x + y) AS INTEGER)) AS rate FROM y GROUP BY n, k),
judged AS (SELECT *, (SELECT v2.rate > 0.1 FROM j j2 JOIN v v2 USING (n, k) WHERE j2.strategy = 'static') AS broken FROM j JOIN v USING (n, k)),
four AS (SELECT *, true AS again FROM judged UNION ALL SELECT * REPLACE ('triggered' AS strategy), broken FROM judged WHERE strategy = CASE WHEN broken THEN 'sliding_window' ELSE 'static' END)"""

ORACLES = {
    "hb_pvalues": f"WITH {ATOMS}, {_cum('kind', 20)} SELECT kind, CAST(step AS INTEGER) AS step, round(CASE WHEN n = 0 THEN 1 ELSE least(1, exp(1) * {_TAIL.format(eps='0.05::DOUBLE')}) END, 6) AS p FROM cum",
    "quantile_grid": f"WITH {ATOMS} SELECT DISTINCT regulator, round(least(greatest(unnest(quantile_cont(risk, [x / 20.0::DOUBLE FOR x IN range(0, 21)])), 0), 1), 6) AS lam FROM atoms GROUP BY regulator",
    "stratum_sizes": f"WITH {ATOMS} SELECT regulator, kind, count(*) AS n, round(avg(wrong), 6) AS risk, count(*) OVER () AS n_strata, round(0.1 / count(*) OVER ()::DOUBLE, 8) AS delta FROM atoms GROUP BY regulator, kind",
    "merged_strata": f"WITH {ATOMS}, s AS (SELECT regulator || '|' || kind AS stratum, count(*) AS n, sum(wrong) AS wrong FROM atoms GROUP BY 1) SELECT CASE WHEN n >= ceil((SELECT count(*) FROM atoms) / 15.0) THEN stratum ELSE '*|*' END AS merged, CAST(sum(n) AS BIGINT) AS n, CAST(sum(wrong) AS BIGINT) AS wrong FROM s GROUP BY 1",
    "threshold_pairs": f"""WITH l AS ({EVALUATED['ltt_threshold']}), q AS (WITH {ATOMS} SELECT regulator, kind, quantile_cont(risk, 0.8) AS q FROM atoms GROUP BY ALL)
SELECT regulator, kind, accept_below, round(CASE WHEN accept_below >= q THEN least(1, accept_below + 1e-6) ELSE q END, 6) AS abstain_above FROM l JOIN q USING (regulator, kind)""",
    "certified": f"""{_EVEN}, l AS (SELECT e.regulator, e.kind, e.n, a.accept_below FROM (SELECT regulator, kind, count(*) AS n FROM even GROUP BY ALL) e LEFT JOIN (SELECT regulator, kind, max(lam) FILTER (failed = 0) AS accept_below FROM f GROUP BY ALL) a USING (regulator, kind))
SELECT regulator, kind, n, accept_below, CASE WHEN accept_below IS NOT NULL THEN 'certified' WHEN n < ceil(ln(0.1) / ln(0.95)) THEN 'too_few_rows' ELSE 'not_certifiable' END AS status,
  count(atom) AS n_test, round(avg(wrong) FILTER (risk <= accept_below), 6) AS test_risk, round(count(*) FILTER (risk <= accept_below) / count(atom)::DOUBLE, 6) AS test_coverage
FROM l LEFT JOIN (SELECT * FROM atoms WHERE atom % 2 = 1) USING (regulator, kind) GROUP BY ALL""",
    "sliding_calibration": f"WITH {ATOMS}, u AS (SELECT kind, CASE WHEN atom % 11 <> 0 THEN day END AS day FROM atoms) SELECT kind, count(*) AS n, min(day) AS first_day FROM u WHERE day IS NULL OR day >= DATE '2024-02-20' - INTERVAL 30 DAY GROUP BY kind",
    "event_trigger": f"""WITH {ATOMS}, e AS (SELECT DISTINCT CASE o_custkey % 5 WHEN 0 THEN 'RBI' WHEN 1 THEN 'SEBI' ELSE 'OTHER' END AS regulator FROM orders WHERE o_totalprice > 100000 AND CAST(o_orderdate AS DATE) >= DATE '1998-07-01')
SELECT regulator, kind, count(*) AS n FROM atoms WHERE regulator IN (SELECT regulator FROM e) GROUP BY ALL""",
    "ks_test": f"WITH {ATOMS}, {_KS.format(by='regulator, kind, ', side=_SIDE, part='PARTITION BY regulator, kind', group='GROUP BY regulator, kind')} SELECT regulator, kind, n_a, n_b, round(ks, 6) AS ks, round(p, 6) AS p FROM ks",
    "weighted_threshold": f"WITH {ATOMS}, tagged AS (SELECT regulator || '|' || kind AS strategy, risk, wrong, (atom % 4 + 1)::DOUBLE AS w FROM atoms), {_TUNED} SELECT DISTINCT a.regulator, a.kind, step / 200.0::DOUBLE AS threshold FROM atoms a LEFT JOIN best ON strategy = a.regulator || '|' || a.kind",
    "resampled_thresholds": f"""WITH {ATOMS}, w AS (SELECT *, exp(-ln(2.0::DOUBLE) * greatest(date_diff('day', day, DATE '2024-02-01'), 0) / 20.0) AS w FROM atoms),
e AS (SELECT regulator, kind, CAST(floor(pow(sum(w), 2) / sum(w * w) + 1e-9) AS BIGINT) AS n_eff, avg(w) AS mean FROM w GROUP BY ALL),
s AS (SELECT w.*, n_eff FROM w JOIN e USING (regulator, kind) QUALIFY row_number() OVER (PARTITION BY regulator, kind ORDER BY 1 - exp(ln({draw_sql('atom', '0')}) * mean / w), atom) <= n_eff),
{_cum('regulator, kind', 200, 's')}, t AS (SELECT *, {_TAIL.format(eps='0.05::DOUBLE')} AS p FROM cum WHERE n >= 50), f AS (SELECT *, max(CAST(p > 0.1 AS INTEGER)) OVER (PARTITION BY regulator, kind ORDER BY step) AS failed FROM t)
SELECT regulator, kind, z.n_eff, z.n, z.atoms, accept_below FROM (SELECT regulator, kind, max(n_eff) AS n_eff, count(*) AS n, CAST(sum(atom) AS BIGINT) AS atoms FROM s GROUP BY ALL) z
LEFT JOIN (SELECT regulator, kind, max(lam) FILTER (failed = 0) AS accept_below FROM f GROUP BY ALL) USING (regulator, kind)""",
    "four_strategies": f"""{_FOUR} SELECT strategy, round(step / 199.0::DOUBLE, 6) AS threshold, n_calibration, n AS accepted, round(n / t::DOUBLE, 6) AS coverage, round(CASE WHEN n > 0 THEN k / n::DOUBLE ELSE 1 END, 6) AS error,
  round(rate, 6) AS violation_rate, again AS recalibrated, CASE WHEN t >= 150 AND (SELECT count(*) FROM pre) >= 150 THEN 'computed' ELSE 'not_certifiable' END AS status FROM four""",
    "best_strategy": f"{_FOUR} SELECT arg_min(strategy, (CASE WHEN n > 0 THEN k / n::DOUBLE ELSE 1 END, list_position(['static', 'sliding_window', 'recency_weighted', 'triggered'], strategy))) AS best FROM four WHERE rate <= 0.6",
}
