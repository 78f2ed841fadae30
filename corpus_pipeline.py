"""A training-corpus pipeline: language, near duplicates, benchmark passages, personal data, tokens.

Every stage takes ``(spark, docs, sf_dir)`` with the columns of ``documents`` and returns a
DataFrame; each result is written as Parquet and read back as the next stage's ``docs``. All but
the last stage return the columns of ``documents``, further columns included. Null texts and texts
without a letter end at the first stage; repeated rows leave the second stage once; a null id is its
own group there, is never contaminated and passes; ties go to the least id; very long texts are
processed whole; an empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdara.llm import bpe, decontaminate, langid, ngram_join, pii
from verdara.llm.common import cut


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents in which no language can be told (null texts, texts without a letter)."""
    made = langid.predict(docs, langid.fit(langid.learnable(docs)), [F.struct(*docs.columns).alias("doc")])
    return made.where("lang_pred <> 'und'").select("doc.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document, the one of least id, of each group linked by 5-word shingles at Jaccard 0.8."""
    return ngram_join.representatives(docs, n=5, percent=80)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a passage of a benchmark item."""
    found = decontaminate.contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return docs.join(cut(found.select("doc_id").distinct()), "doc_id", "left_anti").select(*docs.columns)


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data by pseudonyms; ``n_chars`` follows the new text."""
    rest = [F.struct(*(c for c in docs.columns if c != "text")).alias("rest")]
    made = pii.pseudonymise(docs, rest, pii.key_of(spark))
    columns = {"text": F.col("text"), "n_chars": F.coalesce(F.length("text").cast("long"), F.col("rest.n_chars"))}
    return made.select(*(columns.get(c, F.col(f"rest.`{c}`")).alias(c) for c in docs.columns))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the text decoded from them."""
    import public_tokenizers

    return bpe.digests(bpe.encode_decode(docs, public_tokenizers.path("byte_bpe_50k.json")))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language ID", identify_language),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("PII", hide_personal_data),
    ("BPE encoding and decoding", encode),
]

#: Linear classifiers, transitive similarity, permutations and BPE are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
