"""Answer-text and risk-model queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdara.operators import answers as A
from verdara.operators import learning as L
from verdara.plans.data import ATOMS, atoms, table


def typed_atoms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Atoms of sentences written from parts: a rate, a period and a section each."""
    size = F.col("p_size").cast("string")
    text = F.concat(F.lit("Pay "), size, F.lit(".5 per cent within "), size, F.lit(" days under Section "), size, F.lit("(2) from 12/03/2024"))
    return A.find_atoms(table(spark, sf_dir, "part").select("p_partkey", text.alias("text")), "p_partkey", "text").withColumnRenamed("answer", "p_partkey")


def comparison_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.element_at(F.array(*map(F.lit, ("At least", "<=", "more than", "about", "upto", "is", "between", "?"))), (F.col("event_id") % 8 + 1).cast("int"))
    return table(spark, sf_dir, "events").groupBy(A.comparison(words).alias("comparison")).agg(F.count("*").alias("n"))


def judge_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fenced, plain, invalid and broken replies."""
    good = F.concat(F.lit('{"verdict": "verified", "rationale": " seen ", "evidence_quote": "q'), F.col("event_id").cast("string"), F.lit('"}'))
    raw = F.element_at(F.array(F.concat(F.lit("```json\n"), good, F.lit("\n```")), good, F.lit('{"verdict": "maybe"}'), F.lit("no json")), (F.col("event_id") % 4 + 1).cast("int"))
    reply = A.judge_reply(raw)
    return table(spark, sf_dir, "events").select("event_id", reply["verdict"].alias("verdict"), reply["rationale"].alias("rationale"), reply["quote"].alias("quote"))


def prelabels(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.element_at(F.array(*map(F.lit, ("MATCH", "MISMATCH", "NOT_FOUND", "NA"))), (F.col("atom") % 4 + 1).cast("int"))
    label = A.prelabel(status, F.when(F.col("atom") % 5 == 0, 0.95), F.col("risk"))
    return atoms(spark, sf_dir).groupBy(label.alias("label"), "kind").agg(F.count("*").alias("n"))


def judge_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.within_budget(atoms(spark, sf_dir).select("question", "atom"), "question", "atom").groupBy("question").agg(F.count_if("judged").alias("judged"), F.count_if(~F.col("judged")).alias("left_out"))


def judged_atoms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts of the uncertain atoms: every third reply holds none, every seventh is missing, and a question has 20 calls."""
    rows = atoms(spark, sf_dir).where("risk > 0.1")
    verdict = F.when(F.col("atom") % 2 == 0, "verified").otherwise("NOT_VERIFIED")
    raw = F.when(F.col("atom") % 3 == 0, "can't say").otherwise(F.concat(F.lit('{"verdict": "'), verdict, F.lit('", "evidence_quote": "e'), F.col("atom").cast("string"), F.lit('"}')))
    return A.judged_rows(rows.select("question", "atom"), rows.where("atom % 7 > 0").select("atom", raw.alias("raw")), "question", "atom")


def ordered_atoms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of an order as atoms of an answer, placed by part, every fourth without a place."""
    start = F.when(F.col("l_partkey") % 4 > 0, F.col("l_partkey"))
    listed = F.array_sort(F.collect_list(F.struct(F.col("l_linenumber").alias("no"), start.alias("start"))))
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(listed.alias("atoms"))
    return rows.select("l_orderkey", F.array_join(F.transform(A.in_text_order(F.col("atoms")), lambda a: a["no"].cast("string")), ",").alias("atoms"))


def rewritten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sentence of three values with two of them marked, and the trimmed form."""
    k = F.col("p_partkey").cast("string")
    text = F.concat(F.lit("The rate is r"), k, F.lit(". The limit is long-t"), k, F.lit(". It starts on d"), k, F.lit("."))
    bad = F.array(F.struct(F.concat(F.lit("r"), k).alias("text"), F.lit("REJECTED").alias("status")), F.struct(F.concat(F.lit("long-t"), k).alias("text"), F.lit("ABSTAINED").alias("status")))
    from verdara.functions.text import sentences

    rows = table(spark, sf_dir, "part").select("p_partkey", text.alias("text"), bad.alias("bad"))
    return rows.select("p_partkey", A.flagged(F.col("text"), F.col("bad")).alias("flagged"), A.trimmed(sentences(F.col("text")), F.col("bad")).alias("trimmed"))


def _signals(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[str]]:
    """Feature rows of the atoms: signals that are the risk, each missing by the id."""
    rows = atoms(spark, sf_dir).withColumn("wrong", F.col("wrong").cast("double"))
    signal = lambda k: F.when(F.col("atom") % k != 0, F.col("risk"))
    rows = rows.withColumns({"s_ver": signal(2), "s_nli": signal(3), "s_ent": signal(5), "s_ret": signal(7), "s_div": signal(11), "s_mech": F.lit(None).cast("double")}).withColumnRenamed("risk", "true_risk")
    return L.features(rows)


def signal_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Area under the curve without each signal, fitted on three quarters of the questions and judged on the rest."""
    made, columns = _signals(spark, sf_dir)
    fold = L.fold_of(F.col("question"), 4)
    return L.ablation(made.where(fold > 0), made.where(fold == 0), columns, "wrong", {s: [s] for s in L.SIGNALS})


def trained_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Out-of-fold calibrated risk quality of a logistic model: AUROC and Brier score."""
    made, columns = _signals(spark, sf_dir)
    out = L.cross_validated(made, columns, "wrong", F.col("question"))
    half = L.fold_of(F.col("question"), 2)
    final = L.calibrate(out.where(half == 0), out.where(half == 1), "wrong")
    found = L.quality(final, "wrong", "risk")
    return final.groupBy("kind").agg(F.count("*").alias("n"), F.avg("risk").alias("mean_risk"), F.avg("wrong").alias("wrong_share")).withColumns({k: F.lit(v) for k, v in found.items()})


QUERIES = {f.__name__: f for f in (typed_atoms, comparison_words, judge_replies, prelabels, judge_budget, judged_atoms, ordered_atoms, rewritten, trained_risk, signal_ablation)}

ORACLES = {
    "typed_atoms": """WITH t AS (SELECT p_partkey, 'Pay ' || p_size || '.5 per cent within ' || p_size || ' days under Section ' || p_size || '(2) from 12/03/2024' AS text, p_size FROM part),
a AS (SELECT p_partkey, text AS body, unnest(['RATE', 'THRESHOLD', 'SECTION', 'DATE']) AS kind, unnest([p_size || '.5 per cent', p_size || ' days', 'Section ' || p_size, '12/03/2024']) AS text FROM t)
SELECT p_partkey, kind, text, CAST(strpos(body, CASE WHEN kind = 'THRESHOLD' THEN 'within ' || text ELSE text END) - 1 + CASE WHEN kind = 'THRESHOLD' THEN 7 ELSE 0 END AS INTEGER) AS start,
  CAST(strpos(body, CASE WHEN kind = 'THRESHOLD' THEN 'within ' || text ELSE text END) - 1 + CASE WHEN kind = 'THRESHOLD' THEN 7 ELSE 0 END + length(text) AS INTEGER) AS stop FROM a""",
    "comparison_words": "SELECT CASE event_id % 8 WHEN 0 THEN 'gte' WHEN 1 THEN 'lte' WHEN 2 THEN 'gt' WHEN 3 THEN 'approximately' WHEN 4 THEN 'up_to' WHEN 5 THEN 'eq' WHEN 6 THEN 'between' ELSE 'unknown' END AS comparison, count(*) AS n FROM events GROUP BY 1",
    "judge_replies": "SELECT event_id, CASE WHEN event_id % 4 < 2 THEN 'VERIFIED' END AS verdict, CASE WHEN event_id % 4 < 2 THEN 'seen' END AS rationale, CASE WHEN event_id % 4 < 2 THEN 'q' || event_id END AS quote FROM events",
    "prelabels": f"""WITH {ATOMS} SELECT CASE WHEN atom % 4 = 1 OR risk >= 0.7 THEN 'unsupported' WHEN risk <= 0.3 AND (atom % 4 = 0 OR atom % 5 = 0) THEN 'supported' ELSE 'uncertain' END AS label, kind, count(*) AS n FROM atoms GROUP BY 1, 2""",
    "judge_budget": f"WITH {ATOMS} SELECT question, least(count(*), 20) AS judged, greatest(count(*) - 20, 0) AS left_out FROM atoms GROUP BY question",
    "judged_atoms": f"""WITH {ATOMS}, u AS (SELECT *, row_number() OVER (PARTITION BY question ORDER BY atom) <= 20 AS called FROM atoms WHERE risk > 0.1), v AS (SELECT *, called AND atom % 7 > 0 AND atom % 3 > 0 AS good FROM u)
SELECT atom, CASE WHEN good AND atom % 2 = 0 THEN 'VERIFIED' ELSE 'NOT_VERIFIED' END AS verdict, CASE WHEN good THEN '' WHEN NOT called THEN 'the question''s calls are used up' WHEN atom % 7 = 0 THEN 'no reply' ELSE 'no verdict in the reply' END AS rationale, CASE WHEN good THEN 'e' || atom ELSE 'none' END AS quote, called FROM v""",
    "ordered_atoms": "SELECT l_orderkey, string_agg(l_linenumber::VARCHAR, ',' ORDER BY l_partkey % 4 = 0, CASE WHEN l_partkey % 4 > 0 THEN l_partkey ELSE 0 END, l_linenumber, CASE WHEN l_partkey % 4 > 0 THEN l_partkey END NULLS FIRST) AS atoms FROM lineitem GROUP BY l_orderkey",
    "rewritten": "SELECT p_partkey, 'The rate is [REJECTED: r' || p_partkey || ']. The limit is [⚠ UNVERIFIED: long-t' || p_partkey || ']. It starts on d' || p_partkey || '.' AS flagged, 'It starts on d' || p_partkey || '.' AS trimmed FROM part",
}
