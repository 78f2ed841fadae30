"""Normal forms, versioned facts, verification, routing and splits over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from verdara.functions import normalize as N
from verdara.operators import decide as D
from verdara.operators import splits as S
from verdara.operators import temporal as TM
from verdara.operators import verify as V
from verdara.plans.data import ATOMS, VERSIONS, atoms, table, versions


def norm_amount(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amounts written in lakh, crore and plain rupees, read back."""
    size = F.col("p_size").cast("string")
    unit = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("Rs. "), size, F.lit(" lakh"))).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("₹"), size, F.lit(".5 crore"))).otherwise(F.concat(F.lit("INR "), size, F.lit(",00,000/-")))
    return table(spark, sf_dir, "part").select("p_partkey", N.amount(F.concat(F.lit("a penalty of "), unit)).alias("amount"))


def _percent(column):
    return F.round(F.col(column) * 100, 0).cast("int").cast("string")


def norm_percent(spark: SparkSession, sf_dir: str) -> DataFrame:
    form = F.when(F.col("l_linenumber") % 3 == 0, F.concat(_percent("l_discount"), F.lit("%"))).when(F.col("l_linenumber") % 3 == 1, F.concat(_percent("l_discount"), F.lit(" per cent"))).otherwise(F.concat(_percent("l_discount"), F.lit(".25percent p.a.")))
    return table(spark, sf_dir, "lineitem").groupBy(form.alias("text")).agg(F.count("*").alias("n")).select("text", "n", N.percent(F.concat(F.lit("The rate is "), F.col("text"))).alias("percent"))


def norm_basis_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    form = F.concat(F.col("p_size").cast("string"), F.when(F.col("p_partkey") % 2 == 0, " bps").otherwise(" basis points"))
    return table(spark, sf_dir, "part").select("p_partkey", F.round(N.basis_points(form), 6).alias("percent"), N.is_basis_points(form).alias("is_bps"))


def norm_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.to_date("o_orderdate")
    form = F.element_at(F.array(F.date_format(day, "yyyy-MM-dd"), F.date_format(day, "dd/MM/yyyy"), F.date_format(day, "d MMMM yyyy"), F.date_format(day, "dd.MM.yyyy"), F.concat(F.date_format(day, "d"), F.lit("th day of "), F.date_format(day, "MMMM, yyyy"))), (F.col("o_orderkey") % 5 + 1).cast("int"))
    return table(spark, sf_dir, "orders").select("o_orderkey", N.date(form).alias("day"))


def norm_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size").cast("string")
    text = F.concat(F.lit("as under Section  "), size, F.lit("A(2) of the Act and regulation 7"))
    many = F.concat(F.lit("under Sections "), size, F.lit("C, 80D and "), size, F.lit("-IA"))
    return table(spark, sf_dir, "part").select("p_partkey", N.section(text).alias("section"), F.array_join(N.section_list(many), ",").alias("sections"))


def _claims(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Atoms: the discount of every first line as a rate; evidence: the discounts of all lines of the order."""
    lines = table(spark, sf_dir, "lineitem").withColumn("rate", F.round(F.col("l_discount") * 100, 0).cast("int"))
    evidence = lines.select(F.col("l_orderkey").alias("question"), F.concat(F.lit("a discount of "), F.col("rate").cast("string"), F.lit(" per cent applies")).alias("text"))
    asked = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("atom"), F.col("o_orderkey").alias("question"), F.when(F.col("o_orderkey") % 5 == 0, "ENTITY").otherwise("RATE").alias("kind"), (F.col("o_orderkey") % 11).cast("double").alias("value"))
    return asked, evidence


def v1_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.v1(*_claims(spark, sf_dir))


def version_in_force(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order in force of each customer at the ship date of every line of its orders."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("section"))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.to_date("l_shipdate").alias("as_of"))
    asked = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("section", "as_of").agg(F.min(F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("question"))
    return TM.in_force(asked, versions(spark, sf_dir))


def temporal_filter_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions current on 1 July 1998, by rising temporal entropy within a section."""
    as_of = F.lit("1998-07-01").cast("date")
    rows = versions(spark, sf_dir).where(TM.current(as_of, F.col("effective_from"), F.col("effective_to")))
    score = TM.entropy(TM.recency(as_of, F.col("effective_from")), TM.ambiguity(F.col("effective_from"), F.col("effective_to")))
    rank = F.row_number().over(Window.partitionBy("section").orderBy("entropy", "version")).cast("long")
    return rows.withColumn("entropy", score).withColumn("rank", rank).select("section", "version", "entropy", "rank")


def amendment_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return TM.amendment_events(versions(spark, sf_dir))


def _limits(spark: SparkSession) -> DataFrame:
    rows = [("RBI|RATE", 0.2, 0.6), ("SEBI|RATE", 0.25, 0.7), ("*|RATE", 0.15, 0.5), ("*|DATE", 0.3, 0.8), ("RBI|SECTION", None, 0.9), ("*|*", 0.1, 0.4)]
    return spark.createDataFrame(rows, "stratum string, accept_below double, abstain_above double")


def _routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = D.with_thresholds(atoms(spark, sf_dir), _limits(spark))
    return rows.withColumn("status", D.route(F.col("risk"), F.col("accept_below"), F.col("abstain_above")))


def stratum_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _routed(spark, sf_dir).select("atom", "stratum_used", "status", D.badge(F.col("risk")).alias("badge"))


def answer_combine(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = D.combine(_routed(spark, sf_dir))
    return made.withColumn("coverage", F.round("coverage", 6))


def fallback_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signals from the value, some missing by id, weighted over those present."""
    part = lambda k: F.when(F.col("atom") % k != 0, F.col("risk"))
    signals = {"s_ver": part(2), "s_nli": part(3), "s_ent": part(5), "s_ret": part(7), "s_div": part(11), "s_mech": F.lit(None).cast("double")}
    return atoms(spark, sf_dir).select("atom", F.round(D.fallback_risk(signals), 6).alias("risk"))


def retrieval_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Min-max normalised value of each atom within its question."""
    return atoms(spark, sf_dir).select("atom", "question", F.round(D.min_max(F.col("value"), Window.partitionBy("question")), 6).alias("s_ret"))


def entropy_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean clipped surprisal of the lines of an order after the first, and the divergence of discounts from taxes."""
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", (-F.col("l_quantity") / 8).alias("p"), (-F.col("l_discount") * 10 - 1).alias("a"), (-F.col("l_tax") * 10 - 1).alias("b")))).alias("t"))
    return rows.select("l_orderkey", F.round(D.mean_entropy(F.col("t.p"), F.lit(1), F.size("t")), 6).alias("s_ent"), F.round(D.divergence(F.col("t.a"), F.col("t.b")), 6).alias("s_div"))


def chosen_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of an order as tokens of two answers; some orders without a span, some with a shorter second list."""
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", (-F.col("l_discount") * 10 - 1).alias("a"), (-F.col("l_tax") * 10 - 1).alias("b")))).alias("t"))
    key = F.col("l_orderkey")
    short = F.when(key % 5 == 0, F.slice("t.b", 1, 1)).otherwise(F.col("t.b"))
    made = D.chosen_divergence(F.col("t.a"), short, F.when(key % 7 > 0, key % 12), key % 12 + key % 9, F.when(key % 3 > 0, key % 100 / 100.0))
    return rows.select("l_orderkey", F.round(made, 6).alias("s_div"))


def status_badges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Badges of routed atoms' statuses, and labels of answers', counted."""
    one = _routed(spark, sf_dir).select(D.status_badge(F.col("status")).alias("b"))
    many = answer_combine(spark, sf_dir).select(D.answer_badge(F.col("answer_status")).alias("b"))
    return one.unionByName(many).groupBy("b.label", "b.mark").agg(F.count("*").alias("n"))


def resume_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without a usable label; toxic ones count as failed."""
    done = table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("toxic") == 1, "ERROR").otherwise("DONE").alias("status"))
    return S.pending(table(spark, sf_dir, "documents").select("doc_id"), done, "doc_id")


def splits_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_orderkey", S.split_of(F.col("o_custkey")).alias("split"), S.temporal_split(F.to_date("o_orderdate"), F.lit("1998-01-01").cast("date")).alias("period"))
    return rows.groupBy("split", "period").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("keys"))


def _split_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("split").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("keys"))


def splits_random(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half, a quarter and a quarter of the orders, and exactly a fifth of the half held out."""
    return _split_counts(S.split_exactly(table(spark, sf_dir, "orders"), "o_orderkey"))


def splits_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same shares of customers, each with all its orders."""
    return _split_counts(S.split_exactly(table(spark, sf_dir, "orders"), "o_orderkey", "o_custkey"))


def leakage_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers whose orders a split by order would put on several sides."""
    rows = table(spark, sf_dir, "orders").select("o_custkey", S.split_of(F.col("o_orderkey")).alias("split"))
    return S.leakage(rows, "o_custkey").select("o_custkey", F.array_join("splits", ",").alias("splits"))


def leak_ban(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = table(spark, sf_dir, "orders").where(S.split_of(F.col("o_custkey")) == "test").select(F.col("o_orderkey").alias("l_orderkey"))
    kept = S.leak_ban(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity"), held, "l_orderkey")
    return kept.groupBy("l_orderkey").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("quantity"))


def dedupe_atoms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First turn of each distinct message and role of a conversation."""
    rows = table(spark, sf_dir, "conversations").where("text IS NOT NULL AND text <> ''")
    return rows.groupBy("conv_id", "role", F.md5("text").alias("text_md5")).agg(F.min("turn").alias("turn"))


QUERIES = {
    f.__name__: f
    for f in (norm_amount, norm_percent, norm_basis_points, norm_date, norm_section, v1_status, version_in_force, temporal_filter_rank, amendment_events, stratum_route, answer_combine, fallback_risk, retrieval_signal, entropy_signal, chosen_divergence, status_badges, resume_pending, splits_document, splits_random, splits_family, leakage_report, leak_ban, dedupe_atoms)
}

_ROUTED = f"""{ATOMS},
limits(stratum, accept_below, abstain_above) AS (VALUES ('RBI|RATE', 0.2, 0.6), ('SEBI|RATE', 0.25, 0.7), ('*|RATE', 0.15, 0.5), ('*|DATE', 0.3, 0.8), ('RBI|SECTION', NULL, 0.9), ('*|*', 0.1, 0.4)),
routed AS (SELECT a.*, t.stratum AS stratum_used, CASE WHEN t.accept_below IS NULL THEN 'ABSTAINED' WHEN risk <= t.accept_below THEN 'ACCEPTED' WHEN risk >= t.abstain_above THEN 'ABSTAINED' ELSE 'UNCERTAIN' END AS status
  FROM atoms a LEFT JOIN limits x ON x.stratum = regulator || '|' || kind LEFT JOIN limits y ON y.stratum = '*|' || kind
  JOIN limits t ON t.stratum = coalesce(x.stratum, y.stratum, '*|*'))
"""


def draw_sql(key: str, replicate: str) -> str:
    return f"((('0x' || substr(md5(concat_ws(':', {key}, {replicate})), 1, 8))::BIGINT + 0.5) / 4294967296.0::DOUBLE)"


def _exact_sql(units: str, first: str, second: str, column: str) -> str:
    return f"""WITH u AS ({units}), s AS (SELECT o_orderkey, CASE WHEN place < {first} THEN 'agg_train' WHEN place < {first} + {second} THEN 'calibration' ELSE 'test' END AS split FROM orders JOIN u ON {column} = unit),
t AS (SELECT *, CASE WHEN split = 'agg_train' THEN row_number() OVER (PARTITION BY split ORDER BY {draw_sql('o_orderkey', '1')}, o_orderkey) - 1 END AS place, count(*) OVER (PARTITION BY split) AS n FROM s)
SELECT CASE WHEN split = 'agg_train' AND place < greatest(round_even(n * 0.2, 0), 1) THEN 'agg_val' ELSE split END AS split, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM t GROUP BY 1"""


def split_sql(group: str) -> str:
    return f"CASE WHEN {draw_sql(group, '0')} >= 0.5 THEN 'test' WHEN {draw_sql(group, '1')} < 0.2 THEN 'agg_val' ELSE 'calibration' END"


ORACLES = {
    "norm_amount": "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_size * 100000.0 WHEN 1 THEN (p_size + 0.5) * 10000000.0 ELSE p_size * 100000.0 END::DOUBLE AS amount FROM part",
    "norm_percent": """SELECT text, count(*) AS n, any_value(p)::DOUBLE AS percent FROM (SELECT CASE l_linenumber % 3 WHEN 0 THEN r || '%' WHEN 1 THEN r || ' per cent' ELSE r || '.25percent p.a.' END AS text, CASE WHEN l_linenumber % 3 = 2 THEN r + 0.25 ELSE r END AS p
  FROM (SELECT l_linenumber, CAST(round(l_discount * 100, 0) AS INTEGER) AS r FROM lineitem)) GROUP BY text""",
    "norm_basis_points": "SELECT p_partkey, round(p_size / 100.0::DOUBLE, 6) AS percent, true AS is_bps FROM part",
    "norm_date": "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day FROM orders",
    "norm_section": "SELECT p_partkey, 'section' || p_size || 'a(2)' AS section, p_size || 'C,80D,' || p_size || '-IA' AS sections FROM part",
    "v1_status": """SELECT o_orderkey AS atom, CASE WHEN o_orderkey % 5 = 0 THEN 'NA' WHEN count(l_orderkey) = 0 THEN 'NOT_FOUND' WHEN bool_or(CAST(round(l_discount * 100, 0) AS INTEGER) = o_orderkey % 11) THEN 'MATCH' ELSE 'MISMATCH' END AS v1_status
  FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey""",
    "version_in_force": f"""WITH {VERSIONS}, asked AS (SELECT o_custkey AS section, CAST(l_shipdate AS DATE) AS as_of, min(l_orderkey * 10 + l_linenumber) AS question FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL)
SELECT question, section, as_of, version, effective_from FROM asked JOIN versions USING (section) WHERE as_of >= effective_from AND as_of <= coalesce(effective_to, DATE '9999-12-31')
QUALIFY row_number() OVER (PARTITION BY question, section, as_of ORDER BY effective_from DESC, version DESC) = 1""",
    "temporal_filter_rank": f"""WITH {VERSIONS}, s AS (SELECT section, version, round(0.6 * round(1 - exp(-greatest(date_diff('day', effective_from, DATE '1998-07-01'), 0) / 365.0::DOUBLE), 4) + 0.4 * CASE WHEN effective_to IS NULL THEN 0.0 ELSE round(least(1.0, 365.0::DOUBLE / greatest(date_diff('day', effective_from, effective_to), 1)), 4) END, 4)::DOUBLE AS entropy
  FROM versions WHERE effective_from <= DATE '1998-07-01' AND (effective_to IS NULL OR effective_to >= DATE '1998-07-01'))
SELECT section, version, entropy, row_number() OVER (PARTITION BY section ORDER BY entropy, version) AS rank FROM s""",
    "amendment_events": f"WITH {VERSIONS} SELECT effective_from, count(*) AS n_sections FROM (SELECT *, row_number() OVER (PARTITION BY section ORDER BY effective_from, version) AS n FROM versions) WHERE n > 1 GROUP BY effective_from",
    "stratum_route": f"WITH {_ROUTED} SELECT atom, stratum_used, status, CASE WHEN risk <= 0.25 THEN 'LOW' WHEN risk <= 0.6 THEN 'MEDIUM' ELSE 'HIGH' END AS badge FROM routed",
    "answer_combine": f"""WITH {_ROUTED} SELECT question, count(*) AS n_total, count(*) FILTER (status = 'ACCEPTED') AS n_accepted, count(*) FILTER (status = 'UNCERTAIN') AS n_uncertain, count(*) FILTER (status = 'ABSTAINED') AS n_abstained,
  round(count(*) FILTER (status = 'ACCEPTED') / count(*)::DOUBLE, 6) AS coverage, CASE WHEN bool_and(status = 'ACCEPTED') THEN 'FULLY_SUPPORTED' WHEN NOT bool_or(status = 'ACCEPTED') THEN 'ABSTAINED' ELSE 'PARTIALLY_SUPPORTED' END AS answer_status FROM routed GROUP BY question""",
    "fallback_risk": f"""WITH {ATOMS}, w AS (SELECT atom, risk, CASE WHEN atom % 2 <> 0 THEN 0.30 ELSE 0 END AS a, CASE WHEN atom % 3 <> 0 THEN 0.25 ELSE 0 END AS b, CASE WHEN atom % 5 <> 0 THEN 0.15 ELSE 0 END AS c, CASE WHEN atom % 7 <> 0 THEN 0.10 ELSE 0 END AS d, CASE WHEN atom % 11 <> 0 THEN 0.10 ELSE 0 END AS e FROM atoms)
SELECT atom, CASE WHEN a + b + c + d + e > 0 THEN round(((a + b + c)::DOUBLE * risk + (d + e)::DOUBLE * (1 - risk)) / (a + b + c + d + e)::DOUBLE, 6) END AS risk FROM w""",
    "retrieval_signal": f"WITH {ATOMS}, m AS (SELECT *, min(value) OVER (PARTITION BY question) AS lo, max(value) OVER (PARTITION BY question) AS hi FROM atoms) SELECT atom, question, round(CASE WHEN hi > lo THEN (value - lo) / (hi - lo) ELSE 0.5 END, 6) AS s_ret FROM m",
    "entropy_signal": """WITH t AS (SELECT l_orderkey, -l_quantity / 8 AS p, -l_discount * 10 - 1 AS a, -l_tax * 10 - 1 AS b, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, -l_quantity / 8, -l_discount * 10 - 1, -l_tax * 10 - 1) AS i FROM lineitem)
SELECT l_orderkey, round(avg(least(-p, 5.0)) FILTER (i > 1), 6) AS s_ent, round(least(greatest(sum(exp(a) * (a - b)) / 5, 0), 1), 6) AS s_div FROM t GROUP BY l_orderkey""",
    "resume_pending": "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic <> 1)",
    "splits_document": f"SELECT {split_sql('o_custkey')} AS split, CASE WHEN CAST(o_orderdate AS DATE) < DATE '1998-01-01' THEN 'pre' ELSE 'post' END AS period, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM orders GROUP BY ALL",
    "splits_random": _exact_sql("SELECT o_orderkey AS unit, row_number() OVER (ORDER BY " + draw_sql("o_orderkey", "0") + ", o_orderkey) - 1 AS place, count(*) OVER () AS n FROM orders", "round_even(n * 0.5, 0)", "round_even(n * 0.25, 0)", "o_orderkey"),
    "splits_family": _exact_sql("SELECT unit, row_number() OVER (ORDER BY " + draw_sql("unit", "0") + ", unit) - 1 AS place, count(*) OVER () AS n FROM (SELECT DISTINCT o_custkey AS unit FROM orders)", "least(greatest(round_even(n * 0.5, 0), 1), n - 2)", "greatest(round_even(n * 0.25, 0), 1)", "o_custkey"),
    "leakage_report": f"SELECT o_custkey, string_agg(split, ',' ORDER BY split) AS splits FROM (SELECT DISTINCT o_custkey, {split_sql('o_orderkey')} AS split FROM orders) WHERE split <> 'agg_val' GROUP BY o_custkey HAVING count(*) > 1",
    "leak_ban": f"SELECT l_orderkey, count(*) AS n, sum(l_quantity) AS quantity FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE {split_sql('o_custkey')} = 'test') GROUP BY l_orderkey",
    "dedupe_atoms": "SELECT conv_id, role, md5(text) AS text_md5, min(turn) AS turn FROM conversations WHERE text <> '' GROUP BY conv_id, role, md5(text)",
}

_TOKENS = "SELECT l_orderkey, list(-l_discount * 10 - 1 ORDER BY l_linenumber, -l_discount, -l_tax) AS a, list(-l_tax * 10 - 1 ORDER BY l_linenumber, -l_discount, -l_tax) AS b FROM lineitem GROUP BY l_orderkey"
ORACLES["chosen_divergence"] = f"""WITH t AS (SELECT l_orderkey, a, CASE WHEN l_orderkey % 5 = 0 THEN b[1:1] ELSE b END AS b, CASE WHEN l_orderkey % 7 > 0 THEN l_orderkey % 12 // 4 END AS s, (l_orderkey % 12 + l_orderkey % 9) // 4 AS e FROM ({_TOKENS})),
c AS (SELECT l_orderkey, a[s + 1:greatest(s + 1, e)] AS p, b[s + 1:greatest(s + 1, e)] AS q, s FROM t)
SELECT l_orderkey, round(CASE WHEN s IS NOT NULL AND len(p) > 0 AND len(p) = len(q) THEN least(greatest(list_sum(list_transform(list_zip(p, q), lambda x: exp(x[1]) * (x[1] - x[2]))) / 5, 0), 1) WHEN l_orderkey % 3 > 0 THEN round(1 - l_orderkey % 100 / 100.0::DOUBLE, 4) END, 6) AS s_div FROM c"""
ORACLES["status_badges"] = f"""WITH r AS ({ORACLES['stratum_route']}), c AS ({ORACLES['answer_combine']})
SELECT status AS label, CASE status WHEN 'UNCERTAIN' THEN '⚠️' WHEN 'ABSTAINED' THEN '🚫' ELSE 'ℹ️' END AS mark, count(*) AS n FROM r GROUP BY ALL
UNION ALL SELECT CASE answer_status WHEN 'FULLY_SUPPORTED' THEN 'Fully Verified' WHEN 'ABSTAINED' THEN 'Cannot Be Verified' ELSE answer_status END, CASE answer_status WHEN 'FULLY_SUPPORTED' THEN '✅' WHEN 'ABSTAINED' THEN '🚫' ELSE 'ℹ️' END, count(*) FROM c GROUP BY ALL"""
