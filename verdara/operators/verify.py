"""Deterministic verification of atoms against evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdara.functions import normalize as N
from verdara.functions.text import DAY

MATCH, MISMATCH, NOT_FOUND, NA = "MATCH", "MISMATCH", "NOT_FOUND", "NA"
PRIORITY = {MATCH: 3, MISMATCH: 2, NOT_FOUND: 1, NA: 0}


KINDS = ("RATE", "THRESHOLD", "DATE", "SECTION")


def found_values(kind: str, text: Column) -> Column:
    """Values of a kind in a text, in normal form: per cent, rupees, ISO days, section references."""
    text = F.coalesce(text, F.lit(""))
    if kind == "RATE":
        values = F.transform(F.regexp_extract_all(text, F.lit(N.PERCENT), F.lit(0)), N.percent)
    elif kind == "THRESHOLD":
        values = F.transform(F.regexp_extract_all(F.lower(text), F.lit(N.AMOUNT), F.lit(0)), N.amount)
    elif kind == "DATE":
        values = F.transform(F.regexp_extract_all(text, F.lit(rf"\b(?:[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}|{DAY})\b"), F.lit(0)), lambda t: N.date(t).cast("string"))
    else:
        values = F.transform(F.regexp_extract_all(text, F.lit(N.SECTION), F.lit(0)), N.section)
    return F.array_distinct(F.filter(values, lambda v: v.isNotNull()))


def kinds_of(atoms: DataFrame) -> tuple[str, ...]:
    """The kinds, of those that are looked up in texts, that some atom has."""
    asked = {r["kind"] for r in atoms.select("kind").where(F.col("kind").isin(*KINDS)).distinct().collect()}
    return tuple(k for k in KINDS if k in asked)


def read_values(evidence: DataFrame, text: str = "text", kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """``evidence`` with the values of the kinds that are asked for, each text read once, before any atom meets it."""
    return evidence.select(*(c for c in evidence.columns if c != text), *(found_values(k, F.col(text)).alias(f"_{k}") for k in kinds))


def check(kind: Column, value: Column, text_value: Column, kinds: tuple[str, ...] = KINDS) -> Column:
    """Status of an atom against the values that ``read_values`` has found for the same kinds: numbers for rates and thresholds, texts for the others."""
    out = F.when(kind == "COMPUTED", NOT_FOUND).otherwise(NA)
    for name in kinds:
        found = F.coalesce(F.col(f"_{name}"), F.array())
        same = F.exists(found, lambda v: N.numerically_equal(v, value)) if name in ("RATE", "THRESHOLD") else F.array_contains(found, text_value)
        known = value.isNull() if name in ("RATE", "THRESHOLD") else text_value.isNull()
        status = F.when(known | (F.size(found) == 0), NOT_FOUND).when(same, MATCH).otherwise(MISMATCH)
        out = F.when(kind == name, status).otherwise(out)
    return out


def best_status(statuses: Column) -> Column:
    """Aggregate over chunks: MATCH before MISMATCH before NOT_FOUND before NA."""
    rank = F.lit(0)
    for name, value in PRIORITY.items():
        rank = F.when(statuses == name, value).otherwise(rank)
    return F.element_at(F.array(*(F.lit(n) for n, _ in sorted(PRIORITY.items(), key=lambda x: x[1]))), F.max(rank) + 1)


def v1(atoms: DataFrame, evidence: DataFrame) -> DataFrame:
    """``atom, v1_status`` from ``atoms(atom, question, kind, value[, text_value])`` and ``evidence(question, text)``."""
    if "text_value" not in atoms.columns:
        atoms = atoms.withColumn("text_value", F.lit(None).cast("string"))
    kinds = kinds_of(atoms)
    pairs = atoms.join(read_values(evidence, kinds=kinds), "question", "left")
    made = pairs.select("atom", check(F.col("kind"), F.col("value"), F.col("text_value"), kinds).alias("status"))  # once, before it is compared
    return made.groupBy("atom").agg(best_status(F.col("status")).alias("v1_status"))


def v1_cited(atoms: DataFrame, evidence: DataFrame) -> DataFrame:
    """``atom, v1_status, cited_status``: as ``v1``, with the status of the cited chunk apart; other chunks decide only where it is no match."""
    kinds = kinds_of(atoms)
    pairs = atoms.join(read_values(evidence, kinds=kinds), "question", "left").withColumn("status", check(F.col("kind"), F.col("value"), F.col("text_value"), kinds))
    here = F.col("chunk") == F.col("cited")
    cited = F.max(F.when(here, F.col("status")))  # one chunk a name
    return pairs.groupBy("atom").agg(cited.alias("cited_status"), best_status(F.col("status")).alias("all_status")).select("atom", F.when(F.col("cited_status") == MATCH, MATCH).otherwise(F.col("all_status")).alias("v1_status"), "cited_status")


def cascade(checked: DataFrame, entailed: str = "v2_entail_prob") -> DataFrame:
    """One row per atom with both verdicts: the second one is kept whatever the first says; a missing one is marked."""
    return checked.withColumn("v2_missing", F.col(entailed).isNull().cast("int")).withColumn("s_nli", F.when(F.col(entailed).isNotNull() & ~F.isnan(entailed), F.round(1 - F.col(entailed), 4)))


def hypothesis(claim: Column, text: Column) -> Column:
    """The sentence that is verified: the claim, else the atom's text."""
    return F.coalesce(F.nullif(F.trim(claim), F.lit("")), text)


def best_evidence(claims: DataFrame, chunks: DataFrame) -> DataFrame:
    """The chunk of each claim's question with the largest token overlap; ties to the first chunk."""
    overlap = F.size(F.array_intersect("claim_tokens", "chunk_tokens"))
    pairs = claims.join(chunks, "question").select("claim", "chunk", overlap.alias("overlap"))
    return pairs.groupBy("claim").agg(F.max(F.struct("overlap", (-F.col("chunk")).alias("o")))["overlap"].alias("overlap"), F.min_by("chunk", F.struct(-F.col("overlap"), F.col("chunk"))).alias("chunk"))
