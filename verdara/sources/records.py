"""Record schemas, and readers and writers for their files. All paths are opened by Spark alone."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed record layouts, as DDL.
SCHEMAS = {
    "chunk": "chunk_id string, text string, regulator string, issue_date string, source_url string, effective_from string, effective_to string, superseded_by string, metadata map<string,string>, schema_version string",
    "answer": "query string, answer_text string, citations array<string>, token_logprobs array<double>, model_id string, metadata map<string,string>, schema_version string",
    "atom": "atom_id string, type string, text string, subject string, operator string, value string, unit string, condition string, effective_period string, source_span string, claim string, cited_chunk string, span struct<start:int,end:int>, metadata map<string,string>, schema_version string",
    "decision": "atom_id string, status string, risk double, reason string",
    "thresholds": "stratum string, accept_below double, abstain_above double",
    "version": "section string, version string, effective_from date, effective_to date, supersedes array<string>, amends array<string>",
    "question": "question_id string, family string, text string, source_chunk_id string, doc_id string, temporal_tag boolean, amendment_date string",
    "annotation": "atom_id string, annotator string, label string, note string",
    "split": "question_id string, split string",
    "temporal_tag": "question_id string, temporal boolean, drift_type string, amendment_date string, superseded_by string",
    "calibration": "risk double, label int, regulator string, atom_type string, date string",
    "checkpoint": "key string, status string, payload string",
}
CATEGORIES = ("master direction", "master circular", "circular", "notification", "regulation", "guideline", "act")


def read_jsonl(spark: SparkSession, path: str, record: str, strict: bool = True) -> DataFrame:
    """One record per line; unknown keys are dropped. Strict reading fails on a bad line, else it is left out (``bad_lines`` counts them)."""
    if strict:
        return spark.read.schema(SCHEMAS[record]).option("mode", "FAILFAST").json(path)
    return _permissive(spark, path, record).where("_bad IS NULL").drop("_bad")


def _permissive(spark: SparkSession, path: str, record: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[record] + ", _bad string").option("columnNameOfCorruptRecord", "_bad").json(path)


def bad_lines(spark: SparkSession, path: str, record: str) -> DataFrame:
    """Number of lines read and of those that are no record."""
    rows = _permissive(spark, path, record)
    first = rows.schema.names[0]
    # A record column takes part too, as Spark does not answer for the corrupt column alone; it is null on a bad line.
    bad = F.col("_bad").isNotNull() & F.col(first).isNull()
    return rows.agg(F.count("*").alias("lines"), F.count_if(bad).alias("bad"))


def save_table(rows: DataFrame, path: str, record: str) -> None:
    """A table of a record type, columns by its schema; replaces what is there."""
    columns = rows.sparkSession.createDataFrame([], SCHEMAS[record]).schema
    rows.select(*(F.col(f.name).cast(f.dataType) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in columns)).write.mode("overwrite").parquet(path)


def load_table(spark: SparkSession, path: str, record: str) -> DataFrame:
    """The table; an empty one if nothing was saved."""
    try:
        return spark.read.schema(SCHEMAS[record]).parquet(path)
    except AnalysisException as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        return spark.createDataFrame([], SCHEMAS[record])


def write_labels(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).csv(path)


def read_labels(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(path)


def write_jsonl(rows: DataFrame, path: str, mode: str = "errorifexists") -> None:
    rows.write.mode(mode).json(path)


def calibration(spark: SparkSession, path: str) -> DataFrame:
    """Calibration rows with the defaults of missing fields."""
    rows = read_jsonl(spark, path, "calibration", strict=False)
    return rows.select(F.coalesce("risk", F.lit(0.5)).alias("risk"), F.coalesce("label", F.lit(0)).alias("label"), "regulator", "atom_type", F.coalesce("date", F.lit("2000-01-01")).alias("date"))


def scan_documents(spark: SparkSession, root: str, pattern: str = "*.pdf") -> DataFrame:
    """Files below ``root`` with what their paths tell; contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(root).select("path", "modificationTime", "length")
    return files.select("*", *describe_path(F.col("path")))


def describe_path(path: Column) -> list[Column]:
    """Issuer, category, year, title and id of a document's path."""
    lower, name = F.lower(path), F.regexp_extract(path, r"([^/]+)\.[^./]+$", 1)
    category = F.lit("other")
    for c in reversed(CATEGORIES):
        category = F.when(F.regexp_replace(lower, "[_-]", " ").contains(c), c).otherwise(category)
    issuer = F.when(lower.contains("sebi"), "SEBI").otherwise("RBI")
    title = F.trim(F.regexp_replace(name, r"[_\-\s]+", " "))
    return [
        issuer.alias("issuer"),
        category.alias("category"),
        F.nullif(F.regexp_extract(path, r"(?<!\d)((?:19|20)\d{2})(?!\d)", 1), F.lit("")).try_cast("int").alias("year"),
        title.alias("doc_title"),
        F.concat_ws("_", issuer, F.regexp_replace(title, " ", "_")).alias("doc_id"),
    ]


def with_index(files: DataFrame, index: DataFrame, order: str) -> DataFrame:
    """Side index rows joined by file name; of several rows for a file the last by ``order`` wins."""
    last = index.groupBy(F.regexp_extract("file", r"([^/]+)$", 1).alias("base")).agg(F.max_by(F.struct(*index.columns), order).alias("index"))
    return files.withColumn("base", F.regexp_extract("path", r"([^/]+)$", 1)).join(last, "base", "left")


def append_checkpoint(rows: DataFrame, path: str) -> None:
    """Append completed or failed items; ``splits.pending`` tells what is left."""
    rows.select("key", "status", "payload").write.mode("append").json(path)


def upsert(existing: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """Rows by key; a new row replaces an existing one, and of new rows with a key the last by ``order`` stays."""
    last = new.groupBy(key).agg(F.max_by(F.struct(*(c for c in new.columns if c != key)), order).alias("_last")).select(key, "_last.*")
    return existing.join(last.select(key), key, "left_anti").unionByName(last)
