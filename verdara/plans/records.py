"""Records written from the given tables and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdara.operators import retrieval as R
from verdara.operators import splits as S
from verdara.plans.data import ATOMS, atoms, table, versions
from verdara.sources import records as W


def jsonl_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calibration rows as JSON lines, some without their fields, with defaults when read."""
    path = R.scratch(spark, "jsonl")
    rows = atoms(spark, sf_dir).select(F.when(F.col("atom") % 3 != 0, F.col("risk")).alias("risk"), F.when(F.col("atom") % 5 != 0, F.col("wrong")).alias("label"), "regulator", F.col("kind").alias("atom_type"), F.lit("x").alias("unknown_key"))
    W.write_jsonl(rows, path)
    return W.calibration(spark, path).groupBy("regulator", "atom_type", "date").agg(F.count("*").alias("n"), F.round(F.sum("risk"), 4).alias("risk"), F.sum("label").alias("label"))


def bad_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of which every seventh is no JSON."""
    path = R.scratch(spark, "jsonl")
    line = F.when(F.col("atom") % 7 == 0, F.lit("{broken")).otherwise(F.to_json(F.struct("risk", "regulator")))
    atoms(spark, sf_dir).select(line).write.text(path)
    return W.bad_lines(spark, path, "calibration")


def path_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What paths of made-up names tell, by part."""
    k = F.col("p_partkey").cast("string")
    issuer = F.when(F.col("p_partkey") % 2 == 0, "SEBI").otherwise("rbi")
    kind = F.element_at(F.array(*map(F.lit, ("Master_Direction", "circular", "notes"))), (F.col("p_partkey") % 3 + 1).cast("int"))
    path = F.concat(F.lit("/data/"), issuer, F.lit("/"), kind, F.lit("/2021/Fees__and-limits_"), k, F.lit(".pdf"))
    return table(spark, sf_dir, "part").select("p_partkey", *W.describe_path(path))


def side_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order's file joined with the last index row of its name."""
    files = table(spark, sf_dir, "orders").select(F.concat(F.lit("/a/b/"), F.col("o_orderkey").cast("string"), F.lit(".pdf")).alias("path"))
    index = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("c/"), F.col("l_orderkey").cast("string"), F.lit(".pdf")).alias("file"), F.col("l_partkey").alias("part"), (F.col("l_linenumber") * 1000000 + F.col("l_partkey")).alias("at"))
    return W.with_index(files, index, "at").select("base", F.col("index.part").alias("part"))


def upserted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by key, replaced by their line of the largest number and price."""
    old = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.lit(0.0).alias("price"), F.lit(0).cast("double").alias("at"))
    new = table(spark, sf_dir, "lineitem").where("l_orderkey % 2 = 0").select(F.col("l_orderkey").alias("key"), F.col("l_extendedprice").cast("double").alias("price"), (F.col("l_linenumber") * 1e9 + F.col("l_extendedprice")).alias("at"))
    return W.upsert(old, new, "key", "at").select("key", "price")


def saved_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The version graph as a table, saved and loaded; nothing saved is an empty graph."""
    path, none = R.scratch(spark, "versions"), R.scratch(spark, "none")
    W.save_table(versions(spark, sf_dir), path, "version")
    both = W.load_table(spark, path, "version").unionByName(W.load_table(spark, none, "version"))
    return both.groupBy("section").agg(F.count("*").alias("n"), F.min("effective_from").alias("first"), F.count("effective_to").alias("ended"))


def saved_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = R.scratch(spark, "thresholds")
    made = atoms(spark, sf_dir).groupBy(F.concat_ws("|", "regulator", "kind").alias("stratum")).agg(F.min("risk").alias("accept_below"), F.max("risk").alias("abstain_above"), F.count("*").alias("n"))
    W.save_table(made, path, "thresholds")
    return W.load_table(spark, path, "thresholds")


def csv_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = R.scratch(spark, "labels")
    W.write_labels(table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic"), path)
    return W.read_labels(spark, path, "doc_id long, quality int, toxic int").select(F.col("doc_id").alias("id"), "quality", "toxic")


def resumed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs of a checkpoint: failed and missing documents are left."""
    path = R.scratch(spark, "checkpoint")
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("key"), F.lit(None).cast("string").alias("payload"), "doc_id")
    W.append_checkpoint(rows.where("doc_id % 3 = 0").withColumn("status", F.when(F.col("doc_id") % 2 == 0, "ERROR").otherwise("DONE")), path)
    W.append_checkpoint(rows.where("doc_id % 12 = 0").withColumn("status", F.lit("DONE")), path)
    return S.pending(rows.select("key"), W.read_jsonl(spark, path, "checkpoint"), "key")


QUERIES = {f.__name__: f for f in (jsonl_records, bad_lines, path_metadata, side_index, upserted, saved_versions, saved_thresholds, csv_labels, resumed)}

ORACLES = {
    "jsonl_records": f"WITH {ATOMS} SELECT regulator, kind AS atom_type, '2000-01-01' AS date, count(*) AS n, round(sum(CASE WHEN atom % 3 <> 0 THEN risk ELSE 0.5 END), 4) AS risk, CAST(sum(CASE WHEN atom % 5 <> 0 THEN wrong ELSE 0 END) AS BIGINT) AS label FROM atoms GROUP BY ALL",
    "bad_lines": f"WITH {ATOMS} SELECT count(*) AS lines, count(*) FILTER (atom % 7 = 0) AS bad FROM atoms",
    "path_metadata": "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'SEBI' ELSE 'RBI' END AS issuer, CASE p_partkey % 3 WHEN 0 THEN 'master direction' WHEN 1 THEN 'circular' ELSE 'other' END AS category, CAST(2021 AS INTEGER) AS year, 'Fees and limits ' || p_partkey AS doc_title, CASE WHEN p_partkey % 2 = 0 THEN 'SEBI' ELSE 'RBI' END || '_Fees_and_limits_' || p_partkey AS doc_id FROM part",
    "side_index": "SELECT o_orderkey || '.pdf' AS base, arg_max(l_partkey, l_linenumber * 1000000 + l_partkey) AS part FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey",
    "upserted": """WITH n AS (SELECT l_orderkey AS key, arg_max(l_extendedprice::DOUBLE, l_linenumber * 1e9 + l_extendedprice) AS price FROM lineitem WHERE l_orderkey % 2 = 0 GROUP BY 1)
SELECT key, price FROM n UNION ALL SELECT o_orderkey, 0.0 FROM orders WHERE o_orderkey NOT IN (SELECT key FROM n)""",
    "saved_versions": "SELECT CAST(o_custkey AS VARCHAR) AS section, count(*) AS n, min(CAST(o_orderdate AS DATE)) AS first, count(*) - 1 AS ended FROM orders GROUP BY o_custkey",
    "saved_thresholds": f"WITH {ATOMS} SELECT regulator || '|' || kind AS stratum, min(risk) AS accept_below, max(risk) AS abstain_above FROM atoms GROUP BY 1",
    "csv_labels": "SELECT doc_id AS id, CAST(quality AS INTEGER) AS quality, CAST(toxic AS INTEGER) AS toxic FROM labels",
    "resumed": "SELECT CAST(doc_id AS VARCHAR) AS key FROM documents WHERE NOT (doc_id % 3 = 0 AND doc_id % 2 = 1 OR doc_id % 12 = 0)",
}
