"""Certification, evaluation and drift queries over atoms and labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdara.operators import evaluate as E
from verdara.operators import guarantee as G
from verdara.plans.data import ATOMS, atoms, table
from verdara.plans.facts import draw_sql

EPS, DELTA = 0.05, 0.10
HALF = "2024-01-16"


def risk_coverage_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.risk_coverage(atoms(spark, sf_dir), ["kind"])


def aurc(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = E.aurc(E.risk_coverage(atoms(spark, sf_dir), ["regulator", "kind"]), ["regulator", "kind"])
    return made.withColumn("aurc", F.round("aurc", 5))


def tune_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.tuned(atoms(spark, sf_dir), ["regulator", "kind"], EPS)


def hallucination_at_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = E.wrong_at_coverage(atoms(spark, sf_dir), ["regulator"], (0.4, 0.6, 0.8))
    return made.withColumn("wrong_share", F.round("wrong_share", 6))


def ltt_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.ltt(atoms(spark, sf_dir), ["regulator", "kind"], EPS, DELTA)


def cluster_pvalue(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = G.cluster_p(atoms(spark, sf_dir), EPS)
    return made.select("step", "lam", "m", F.round("zbar", 6).alias("zbar"), F.round("p", 6).alias("p"))


def acceptance_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = E.rates(["kind"], atoms(spark, sf_dir), F.col("risk") <= 0.35)
    return made.select("kind", F.round("hallucination", 6).alias("hallucination"), F.round("coverage", 6).alias("coverage"))


def ess_recency_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = atoms(spark, sf_dir).withColumn("w", G.recency_weight(F.col("day"), F.lit("2024-01-31").cast("date"), 14.0))
    return rows.groupBy("kind").agg(F.round(G.effective_size("w"), 4).alias("n_eff"), F.round(F.sum(F.col("w") * F.col("wrong")) / F.sum("w"), 6).alias("weighted_risk"))


def _sides(spark: SparkSession, sf_dir: str, value):
    return G.histograms(atoms(spark, sf_dir), F.col("day") >= F.lit(HALF).cast("date"), value)


def mmd_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.mmd(_sides(spark, sf_dir, F.round("risk", 2)), 5.0).select(F.round("mmd2", 8).alias("mmd2"))


def ks_stat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.ks_statistic(_sides(spark, sf_dir, F.col("risk"))).withColumn("ks", F.round("ks", 6))


def drift_strategies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Threshold tuned on all or only the recent half of the earlier period, then its error on the later period."""
    rows = atoms(spark, sf_dir)
    pre, post = rows.where(F.col("day") < F.lit(HALF).cast("date")), rows.where(F.col("day") >= F.lit(HALF).cast("date"))
    tagged = pre.withColumn("strategy", F.lit("static")).unionByName(pre.where(F.col("day") >= F.lit("2024-01-08").cast("date")).withColumn("strategy", F.lit("sliding_window")))
    chosen = E.tuned(tagged, ["strategy"], 0.05)
    out = chosen.join(post.select("risk", "wrong"), F.col("risk") <= F.col("threshold"), "left").groupBy("strategy", "threshold").agg(F.count("risk").alias("accepted"), F.round(F.avg("wrong"), 6).alias("error"))
    return out


def kappa(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = E.kappa(table(spark, sf_dir, "labels"), "quality", "toxic")
    return made.select("n", *(F.round(c, 6).alias(c) for c in ("observed", "expected", "kappa")))


def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.confusion(table(spark, sf_dir, "labels"), "quality", "toxic").select("quality", "toxic", "n", F.col("level").cast("int").alias("level"))


def mcnemar(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = E.mcnemar(table(spark, sf_dir, "labels"), F.col("quality") == 1, F.col("toxic") == 0)
    return made.withColumn("statistic", F.round("statistic", 6))


def mcnemar_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The statistic's p-value, which needs a Python function."""
    from verdara.functions.stats import erfc

    return mcnemar(spark, sf_dir).withColumn("p", F.round(erfc(F.sqrt(F.col("statistic") / 2)), 6))


def simulate_violation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over 1,000 random halves."""
    made = G.violation(atoms(spark, sf_dir), 0.10, DELTA)
    return made.withColumns({c: F.round(c, 6) for c in ("violation_rate", "mean_threshold")})


def _rounded(made: DataFrame) -> DataFrame:
    return made.withColumns({c: F.round(c, 8) for c in ("mean_diff", "ci_low", "ci_high")})


def bootstrap_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of wrong atoms with its interval over 10,000 resamples."""
    return _rounded(E.paired_bootstrap(atoms(spark, sf_dir), F.col("wrong"), F.lit(0)))


def paired_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Right decisions at a limit of 0.35 against those at 0.5: accepted and right, or not accepted and wrong."""
    right = lambda limit: ((F.col("risk") <= limit) == (F.col("wrong") == 0)).cast("int")
    return _rounded(E.paired_bootstrap(atoms(spark, sf_dir), right(0.35), right(0.5)))


def clopper_pearson(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact intervals of the share of wrong atoms, by question."""
    from verdara.functions.stats import clopper_pearson as interval

    counts = atoms(spark, sf_dir).groupBy("question").agg(F.sum("wrong").alias("k"), F.count("*").alias("n"))
    made = counts.withColumn("ci", interval("k", "n", F.lit(0.05)))
    return made.select("question", "k", "n", F.round("ci.low", 6).alias("low"), F.round("ci.high", 6).alias("high"))


def seed_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = E.seed_summary(atoms(spark, sf_dir), ["kind"], "risk")
    return made.select("kind", "n", *(F.round(c, 6).alias(c) for c in ("mean", "low", "high")))


def extraction_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order statuses as gold values, guessed by the order's key."""
    orders = table(spark, sf_dir, "orders")
    gold = orders.select(F.col("o_orderkey").alias("item"), F.col("o_orderpriority").alias("kind"), F.col("o_orderstatus").alias("value"))
    guess = orders.select(F.col("o_orderkey").alias("item"), F.col("o_orderpriority").alias("kind"), F.when(F.col("o_orderkey") % 3 == 0, "f").when(F.col("o_orderkey") % 3 == 1, " O ").alias("value")).where("value IS NOT NULL")
    made = E.extraction_quality(guess, gold)
    return made.select("kind", *(F.round(c, 6).alias(c) for c in ("recall", "precision", "f1")))


QUERIES = {
    f.__name__: f
    for f in (risk_coverage_curve, aurc, tune_threshold, hallucination_at_coverage, ltt_threshold, cluster_pvalue, acceptance_rates, ess_recency_weights, mmd_drift, ks_stat, drift_strategies, kappa, confusion_matrix, mcnemar, mcnemar_p, simulate_violation, bootstrap_mean, paired_bootstrap, clopper_pearson, seed_summary, extraction_f1)
}


def _cum(by: str, steps: int, source: str = "atoms") -> str:
    keys = f"{by}, " if by else ""
    return f"""
counts AS (SELECT {keys}CAST(ceil(risk * {steps} - 1e-9) AS INTEGER) AS step, count(*) AS n, sum(wrong) AS k FROM {source} GROUP BY ALL),
grid AS (SELECT * FROM (SELECT DISTINCT {by} FROM {source}), (SELECT unnest(range(0, {steps + 1})) AS step)),
cum AS (SELECT {', '.join('grid.' + c.strip() for c in by.split(','))}, grid.step, grid.step / {steps}.0::DOUBLE AS lam,
  CAST(sum(coalesce(n, 0)) OVER w AS BIGINT) AS n, CAST(sum(coalesce(k, 0)) OVER w AS BIGINT) AS k
  FROM grid LEFT JOIN counts ON {' AND '.join(f'grid.{c.strip()} = counts.{c.strip()}' for c in by.split(','))} AND grid.step = counts.step
  WINDOW w AS (PARTITION BY {', '.join('grid.' + c.strip() for c in by.split(','))} ORDER BY grid.step))
"""


_TAIL = "CASE WHEN n = 0 OR k >= n THEN 1 ELSE least(1, list_sum(list_transform(range(0, k + 1), lambda j: exp(lgamma(n + 1) - CASE WHEN j = 0 THEN 0 ELSE lgamma(j + 1) END - lgamma(n - j + 1) + j * ln({eps}) + (n - j) * ln(1 - {eps}))))) END"
_SUM = "list_sum(list_transform(range(0, {top}), lambda j: exp(CASE WHEN n < 2 THEN 0 ELSE lgamma(n + 1) END - CASE WHEN j = 0 THEN 0 ELSE lgamma(j + 1) END - CASE WHEN j = n THEN 0 ELSE lgamma(n - j + 1) END + j * ln(middle) + (n - j) * ln(1 - middle))))"


def _bootstrap_sql(difference: str) -> str:
    """For up to three distinct differences: the counts of the first and the second in each resample, from the distribution function of a binomial number; the rest is the last's."""
    log = "exp(" + " ".join(f"{sign} CASE WHEN {x} < 2 THEN 0 ELSE lgamma({x} + 1) END" for sign, x in (("", "t"), ("-", "j"), ("-", "(t - j)"))) + " + j * ln(p) + (t - j) * ln(1 - p))"
    return f"""WITH {ATOMS}, cells AS (SELECT *, row_number() OVER (ORDER BY d) - 1 AS i, sum(c) OVER (ORDER BY d DESC) AS rest FROM (SELECT {difference} AS d, count(*) AS c FROM atoms GROUP BY 1)),
a AS (SELECT sum(d * c) / sum(c)::DOUBLE AS mean, CAST(sum(c) AS BIGINT) AS n FROM cells),
p0 AS (SELECT c / rest::DOUBLE AS p, c < rest AS more FROM cells WHERE i = 0), p1 AS (SELECT c / rest::DOUBLE AS p, c < rest AS more FROM cells WHERE i = 1),
c0 AS (SELECT j, sum({log}) OVER (ORDER BY j) AS cdf FROM (SELECT n AS t, unnest(range(0, n + 1)) AS j FROM a), p0 WHERE more),
u AS (SELECT id, {draw_sql('0', 'id')} AS u0, {draw_sql('1', 'id')} AS u1 FROM (SELECT unnest(range(0, 10000)) AS id)),
x0 AS (SELECT u.*, n - coalesce(j, n) AS t, coalesce(j, n) AS x0 FROM (SELECT u.*, n FROM u, a) u ASOF LEFT JOIN c0 ON u.u0 <= c0.cdf),
c1 AS (SELECT t, j, sum({log}) OVER (PARTITION BY t ORDER BY j) AS cdf FROM (SELECT t, unnest(range(0, t + 1)) AS j FROM (SELECT DISTINCT t FROM x0)), p1 WHERE more),
x1 AS (SELECT x0.*, coalesce(j, x0.t) AS x1 FROM x0 ASOF LEFT JOIN c1 ON x0.t = c1.t AND x0.u1 <= c1.cdf),
m AS (SELECT s / n AS mean, row_number() OVER (ORDER BY s) - 1 AS place FROM (SELECT x0 * d0 + x1 * coalesce(d1, 0) + (t - x1) * coalesce(d2, 0) AS s FROM x1,
  (SELECT max(d) FILTER (i = 0) AS d0, max(d) FILTER (i = 1) AS d1, max(d) FILTER (i = 2) AS d2 FROM cells)), a)
SELECT round(a.mean, 8) AS mean_diff, round((SELECT mean FROM m WHERE place = 249), 8) AS ci_low, round((SELECT mean FROM m WHERE place = 9749), 8) AS ci_high, n FROM a"""


_CURVE = "curve AS (SELECT {by}, step, lam, round(n / max(n) OVER (PARTITION BY {by}), 6) AS coverage, round(k / n, 6) AS risk FROM cum QUALIFY n > 0)"
_SIDES = f"CAST(day >= DATE '{HALF}' AS INTEGER)"

ORACLES = {
    "risk_coverage_curve": f"WITH {ATOMS}, {_cum('kind', 100)}, {_CURVE.format(by='kind')} SELECT kind, CAST(step AS INTEGER) AS step, lam, coverage, risk FROM curve",
    "aurc": f"""WITH {ATOMS}, {_cum('regulator, kind', 100)}, {_CURVE.format(by='regulator, kind')},
l AS (SELECT *, lag(coverage) OVER w AS c0, lag(risk) OVER w AS r0 FROM curve WINDOW w AS (PARTITION BY regulator, kind ORDER BY step))
SELECT regulator, kind, round(coalesce(sum((coverage - c0) * (risk + r0) / 2), 0), 5) AS aurc FROM l GROUP BY regulator, kind""",
    "tune_threshold": f"WITH {ATOMS}, {_cum('regulator, kind', 200)} SELECT regulator, kind, max(lam) FILTER (n > 0 AND k <= 0.05::DOUBLE * n) AS threshold FROM cum GROUP BY regulator, kind",
    "hallucination_at_coverage": f"""WITH {ATOMS}, h AS (SELECT regulator, risk, count(*) AS n, sum(wrong) AS k FROM atoms GROUP BY regulator, risk),
r AS (SELECT *, sum(n) OVER (PARTITION BY regulator ORDER BY risk) AS upto, sum(n) OVER (PARTITION BY regulator) AS total FROM h),
s AS (SELECT *, greatest(round_even(share * total, 0), 1) AS want FROM r, (SELECT unnest([0.4::DOUBLE, 0.6, 0.8]) AS share))
SELECT regulator, share, round(sum(greatest(least(n, want - (upto - n)), 0) * k / n) / max(want), 6) AS wrong_share FROM s GROUP BY regulator, share""",
    "ltt_threshold": f"""WITH {ATOMS}, {_cum('regulator, kind', 200)}, t AS (SELECT *, {_TAIL.format(eps='0.05::DOUBLE')} AS p FROM cum WHERE n >= 50),
f AS (SELECT *, max(CAST(p > 0.1 AS INTEGER)) OVER (PARTITION BY regulator, kind ORDER BY step) AS failed FROM t)
SELECT a.regulator, a.kind, max(lam) FILTER (failed = 0) AS accept_below FROM (SELECT DISTINCT regulator, kind FROM atoms) a LEFT JOIN f USING (regulator, kind) GROUP BY a.regulator, a.kind""",
    "cluster_pvalue": f"""WITH {ATOMS}, {_cum('question', 20)}, z AS (SELECT step, lam, count(*) AS m, avg(k - 0.05::DOUBLE * n) AS zbar FROM cum WHERE n > 0 GROUP BY step, lam)
SELECT CAST(step AS INTEGER) AS step, lam, m, round(zbar, 6) AS zbar, round(CASE WHEN zbar < 0 THEN least(1, exp(1) * exp(-2 * m * zbar * zbar)) ELSE 1 END, 6) AS p FROM z""",
    "acceptance_rates": f"WITH {ATOMS} SELECT kind, round(avg(wrong) FILTER (risk <= 0.35), 6) AS hallucination, round(count(*) FILTER (risk <= 0.35) / count(*), 6) AS coverage FROM atoms GROUP BY kind",
    "ess_recency_weights": f"WITH {ATOMS}, w AS (SELECT *, exp(-ln(2) * greatest(date_diff('day', day, DATE '2024-01-31'), 0) / 14.0::DOUBLE) AS w FROM atoms) SELECT kind, round(pow(sum(w), 2) / sum(w * w), 4) AS n_eff, round(sum(w * wrong) / sum(w), 6) AS weighted_risk FROM w GROUP BY kind",
    "mmd_drift": f"""WITH {ATOMS}, h AS (SELECT round(risk, 2) AS v, count(*) FILTER ({_SIDES} = 0) AS a, count(*) FILTER ({_SIDES} = 1) AS b FROM atoms GROUP BY 1), n AS (SELECT sum(a)::DOUBLE AS na, sum(b)::DOUBLE AS nb FROM h)
SELECT round(greatest(sum(exp(-5.0::DOUBLE * pow(x.v - y.v, 2)) * (x.a * y.a / (na * na) + x.b * y.b / (nb * nb) - 2 * x.a * y.b / (na * nb))), 0), 8) AS mmd2 FROM h x, h y, n""",
    "ks_stat": f"""WITH {ATOMS}, h AS (SELECT risk AS v, count(*) FILTER ({_SIDES} = 0) AS a, count(*) FILTER ({_SIDES} = 1) AS b FROM atoms GROUP BY 1),
c AS (SELECT a, b, sum(a) OVER (ORDER BY v) / sum(a) OVER ()::DOUBLE AS fa, sum(b) OVER (ORDER BY v) / sum(b) OVER ()::DOUBLE AS fb FROM h)
SELECT CAST(sum(a) AS BIGINT) AS n_a, CAST(sum(b) AS BIGINT) AS n_b, round(max(abs(fa - fb)), 6) AS ks FROM c""",
    "drift_strategies": f"""WITH {ATOMS}, tagged AS (SELECT *, 'static' AS strategy FROM atoms WHERE day < DATE '{HALF}' UNION ALL SELECT *, 'sliding_window' FROM atoms WHERE day < DATE '{HALF}' AND day >= DATE '2024-01-08'), {_cum('strategy', 200, 'tagged')},
c AS (SELECT strategy, max(lam) FILTER (n > 0 AND k <= 0.05::DOUBLE * n) AS threshold FROM cum GROUP BY strategy)
SELECT strategy, threshold, count(risk) AS accepted, round(avg(wrong), 6) AS error FROM c LEFT JOIN (SELECT risk, wrong FROM atoms WHERE day >= DATE '{HALF}') ON risk <= threshold GROUP BY strategy, threshold""",
    "kappa": """WITH t AS (SELECT count(*)::DOUBLE AS n, avg(CAST(quality = toxic AS INTEGER)) AS po FROM labels), e AS (SELECT sum((SELECT count(*) FROM labels WHERE quality = v) * (SELECT count(*) FROM labels WHERE toxic = v))::DOUBLE AS rc FROM (VALUES (0), (1)) x(v))
SELECT CAST(n AS BIGINT) AS n, round(po, 6) AS observed, round(rc / (n * n), 6) AS expected, round((po - rc / (n * n)) / (1 - rc / (n * n)), 6) AS kappa FROM t, e""",
    "confusion_matrix": "SELECT quality, toxic, count(*) AS n, CAST(grouping(quality, toxic) AS INTEGER) AS level FROM labels GROUP BY GROUPING SETS ((quality, toxic), (quality), (toxic), ())",
    "mcnemar": """WITH c AS (SELECT count(*) FILTER (quality = 1 AND NOT toxic = 0) AS only_a, count(*) FILTER (NOT quality = 1 AND toxic = 0) AS only_b FROM labels)
SELECT only_a, only_b, round(CASE WHEN only_a + only_b > 0 THEN pow(greatest(abs(only_a - only_b) - 1, 0), 2) / (only_a + only_b) ELSE 0 END, 6) AS statistic FROM c""",
    "bootstrap_mean": _bootstrap_sql("wrong"),
    "paired_bootstrap": _bootstrap_sql("CAST((risk <= 0.35) = (wrong = 0) AS INTEGER) - CAST((risk <= 0.5) = (wrong = 0) AS INTEGER)"),
    # Ends by halving: 45 steps, each with the whole sum of the tail.
    "clopper_pearson": f"""WITH RECURSIVE {ATOMS}, c AS (SELECT question, CAST(sum(wrong) AS BIGINT) AS k, count(*) AS n FROM atoms GROUP BY question),
s AS (SELECT DISTINCT k, n, upper_ FROM c, (SELECT unnest([false, true]) AS upper_)),
r AS (SELECT k, n, upper_, 0 AS i, 0.0::DOUBLE AS low, 1.0::DOUBLE AS high FROM s
  UNION ALL SELECT k, n, upper_, i + 1, CASE WHEN moved THEN middle ELSE low END, CASE WHEN moved THEN high ELSE middle END FROM (
    SELECT *, CASE WHEN upper_ THEN {{up}} > 0.025 ELSE 1 - {{down}} < 0.025 END AS moved FROM (SELECT *, (low + high) / 2 AS middle FROM r WHERE i < 45)))
SELECT question, k, n, round(CASE WHEN k = 0 THEN 0 ELSE a.high END, 6) AS low, round(CASE WHEN k = n THEN 1 ELSE b.high END, 6) AS high
FROM c JOIN (SELECT k, n, high FROM r WHERE i = 45 AND NOT upper_) a USING (k, n) JOIN (SELECT k, n, high FROM r WHERE i = 45 AND upper_) b USING (k, n)""".format(up=_SUM.format(top="k + 1"), down=_SUM.format(top="k")),
    "seed_summary": f"WITH {ATOMS} SELECT kind, count(*) AS n, round(avg(risk), 6) AS mean, round(avg(risk) - 1.96 * stddev_samp(risk) / sqrt(count(*)), 6) AS low, round(avg(risk) + 1.96 * stddev_samp(risk) / sqrt(count(*)), 6) AS high FROM atoms GROUP BY kind",
    "extraction_f1": """WITH g AS (SELECT o_orderkey, o_orderpriority AS kind, lower(o_orderstatus) AS v, CASE o_orderkey % 3 WHEN 0 THEN 'f' WHEN 1 THEN 'o' END AS p FROM orders),
c AS (SELECT kind, count(p) AS p, count(v) AS g, count(*) FILTER (p = v) AS hit FROM g GROUP BY kind)
SELECT kind, round(hit / g, 6) AS recall, round(coalesce(hit / nullif(p, 0), 0), 6) AS precision, round(2 * hit / (p + g), 6) AS f1 FROM c""",
}
#: Cell after cell, each split draws how many rows of the cell fall into its half.
#: The complementary error function as Simpson's sum of its integrand over ten units.
ORACLES["mcnemar_p"] = f"""WITH m AS ({ORACLES['mcnemar']}), z AS (SELECT *, sqrt(statistic / 2) AS z FROM m)
SELECT only_a, only_b, statistic, round(2 / sqrt(pi()) * 0.005 / 3 * list_sum(list_transform(range(0, 2001), lambda i: CASE WHEN i IN (0, 2000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * exp(-pow(z + i * 0.005::DOUBLE, 2)))), 6) AS p FROM z"""
ORACLES["simulate_violation"] = f"""WITH RECURSIVE {ATOMS},
cells AS (SELECT *, row_number() OVER (ORDER BY step, wrong) AS i FROM (SELECT CAST(ceil(risk * 100 - 1e-9) AS INTEGER) AS step, wrong, count(*) AS c FROM atoms GROUP BY ALL)),
lf AS (SELECT list_transform(range(0, (SELECT count(*) + 2 FROM atoms)), lambda x: CASE WHEN x < 2 THEN 0.0::DOUBLE ELSE lgamma(x + 1) END) AS f),
r AS (SELECT s AS split, 0::BIGINT AS i, n AS t, n // 2 AS d, 0::BIGINT AS x, 0::BIGINT AS c FROM (SELECT unnest(range(0, 1000)) AS s), (SELECT count(*) AS n FROM atoms)
  UNION ALL SELECT split, i, t - c, d - x, x, c FROM (SELECT split, i, t, d, c, CAST(least(lo + list_reduce(list_transform(range(lo, hi + 1),
      lambda j: [exp(f[c + 1] - f[j + 1] - f[c - j + 1] + f[t - c + 1] - f[d - j + 1] - f[t - c - d + j + 1] - f[t + 1] + f[d + 1] + f[t - d + 1]), 0]),
      lambda a, b: [a[1] + b[1], a[2] + CASE WHEN a[1] + b[1] < u THEN 1 ELSE 0 END], [0.0::DOUBLE, 0])[2], hi) AS BIGINT) AS x FROM
    (SELECT split, k.i, t, d, k.c, f, greatest(0, d - (t - k.c)) AS lo, least(k.c, d) AS hi, {draw_sql('step * 2 + wrong', 'split')} AS u FROM r JOIN cells k ON k.i = r.i + 1, lf))),
drawn AS (SELECT split, step, wrong, x, r.c - x AS y FROM r JOIN cells USING (i)),
per AS (SELECT q.split, g AS step, sum(sum(coalesce(x, 0))) OVER w AS n, sum(sum(coalesce(x * wrong, 0))) OVER w AS k, sum(sum(coalesce(y, 0))) OVER w AS n2, sum(sum(coalesce(y * wrong, 0))) OVER w AS k2
  FROM (SELECT split, g FROM (SELECT unnest(range(0, 1000)) AS split), (SELECT unnest(range(0, 101)) AS g)) q LEFT JOIN drawn ON drawn.split = q.split AND drawn.step = g GROUP BY q.split, g WINDOW w AS (PARTITION BY q.split ORDER BY g)),
p AS (SELECT k, n, {_TAIL.format(eps='0.1::DOUBLE')} AS p FROM (SELECT DISTINCT CAST(k AS BIGINT) AS k, CAST(n AS BIGINT) AS n FROM per WHERE n >= 50)),
f AS (SELECT per.*, max(CAST(p > 0.1 AS INTEGER)) OVER (PARTITION BY split ORDER BY step) AS failed FROM per JOIN p USING (k, n)),
l AS (SELECT split, max(step) AS step, arg_max(n2, step) AS n2, arg_max(k2, step) AS k2 FROM f WHERE failed = 0 GROUP BY split),
v AS (SELECT * FROM l WHERE n2 > 0)
SELECT count(*) AS certified, count(*) FILTER (k2 > 0.1::DOUBLE * n2) AS violations, round(count(*) FILTER (k2 > 0.1::DOUBLE * n2) / nullif(count(*), 0)::DOUBLE, 6) AS violation_rate, round(avg(step / 100.0::DOUBLE), 6) AS mean_threshold,
  CAST(1000 AS BIGINT) AS splits, 1000 - count(*) AS abstained FROM v"""
