"""Evidence frames of questions, all signals of an atom, systems compared, training pairs and question records."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verdara.functions.normalize import PERCENT, SECTION_WORDS, date
from verdara.operators.decide import WEIGHTS, badge, mean_entropy
from verdara.operators.evaluate import tuned, wrong_at_coverage
from verdara.operators.guarantee import draw
from verdara.operators.retrieval import ranking_quality

# ---- retrieval frames


def with_chunks(ranked: DataFrame, chunks: DataFrame, filters: dict[str, str] | None = None) -> DataFrame:
    """Ranked ``query, doc, rank`` with the chunks' columns; missing chunks are dropped, the metadata filter holds for every retriever."""
    for name, value in (filters or {}).items():
        chunks = chunks.where(F.col(name) == value)
    return ranked.join(chunks, "doc")


def reranked(rows: DataFrame, first: Column, score: Column, wide: int = 30, narrow: int = 6, by: str = "query", tie: str = "doc") -> DataFrame:
    """The ``wide`` best rows by one order, of these the ``narrow`` best by score; ``rank`` from 1."""
    order = lambda *c: F.row_number().over(Window.partitionBy(by).orderBy(*c))
    taken = rows.withColumn("_first", order(first.asc(), tie)).where(F.col("_first") <= wide)
    return taken.withColumn("rank", order(score.desc(), "_first").cast("long")).where(F.col("rank") <= narrow).drop("_first")


def side_by_side(**lists: DataFrame) -> DataFrame:
    """``channel, query, rank, doc`` of several ranked lists."""
    parts = [rows.select(F.lit(name).alias("channel"), "query", "rank", "doc") for name, rows in lists.items()]
    return reduce(DataFrame.unionByName, parts)


def gold_report(ranked: DataFrame, ks: tuple[int, ...] = (6, 10)) -> DataFrame:
    """Means over questions at each k; a status tells where there is no gold."""
    out = []
    for k in ks:
        per = ranking_quality(ranked, k)
        means = [F.avg(c).alias(c) for c in ("recall", "precision", "mrr", "ndcg")]
        out.append(per.agg(F.count("*").alias("n"), *means).select(F.lit(k).alias("k"), "n", "recall", "precision", "mrr", "ndcg", F.when(F.col("n") == 0, "not_available").otherwise("ok").alias("status")))
    return reduce(DataFrame.unionByName, out)


def legacy_report(ranked: DataFrame, relevant: Column, answers: DataFrame, k: int) -> DataFrame:
    """Hit rate, mean precision and reciprocal rank over questions, share of answers with a citation and mean number of claims."""
    per = ranked.where(F.col("rank") <= k).groupBy("query").agg(F.count_if(relevant).alias("hits"), F.min(F.when(relevant, F.col("rank"))).alias("first"))
    found = answers.join(per, "query", "left").select("n_claims", "n_citations", F.coalesce("hits", F.lit(0)).alias("hits"), "first")
    return found.agg(F.count("*").alias("n"), F.avg((F.col("hits") > 0).cast("int")).alias("hit_rate"), F.avg(F.col("hits") / k).alias("precision"), F.avg(F.coalesce(1 / F.col("first"), F.lit(0.0))).alias("mrr"), F.avg((F.col("n_citations") > 0).cast("int")).alias("citation_rate"), F.avg("n_claims").alias("claims"))


def joined_in_order(part: Column, rank: Column, between: str = "\n\n", most: int | None = None) -> Column:
    """Aggregate: texts of a group in the order of their rank, cut at ``most`` characters where the receiver has a limit."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(rank.alias("r"), part.alias("t")))), lambda x: x["t"]), between)
    return text if most is None else F.substring(text, 1, most)


def distinct_in_order(part: Column, rank: Column) -> Column:
    """Aggregate: distinct texts of a group by their first rank."""
    return F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct(rank.alias("r"), part.alias("t")))), lambda x: x["t"]))


# ---- signals


def max_entropy(logprobs: Column, start: Column, stop: Column, most: float = 5.0) -> Column:
    span = F.slice(logprobs, F.greatest(start, F.lit(0)) + 1, F.greatest(stop - start, F.lit(0)))
    return F.array_max(F.transform(span, lambda x: F.least(-x, F.lit(most))))


def token_span(start: Column, stop: Column) -> Column:
    """Token places of a span of characters, four characters a token, at least one token."""
    first = F.floor(start / 4).cast("int")
    return F.struct(first.alias("start"), F.greatest(F.floor(stop / 4).cast("int"), first + 1).alias("stop"))


def retrieval_strength(cited: Column, chunks: Column, scores: Column | None = None) -> Column:
    """Min-max of the cited chunk's rerank score; without scores 1 - place / n; not retrieved 0; nothing retrieved 0.5."""
    n = F.size(chunks)
    place = F.array_position(chunks, cited) - 1
    by_rank = F.when(n == 0, 0.5).when(cited.isNull() | (place < 0), 0.0).otherwise(F.round(1 - place / n, 4))
    if scores is None:
        return by_rank
    values = F.map_values(scores)
    low, high = F.array_min(values), F.array_max(values)
    raw = F.coalesce(F.element_at(scores, cited), low)
    by_score = F.when(high == low, F.when(cited.isNotNull(), 1.0).otherwise(0.0)).otherwise(F.round((raw - low) / (high - low), 4))
    return F.when(F.coalesce(F.size(scores), F.lit(0)) > 0, by_score).otherwise(by_rank)


def cosine(a: Column, b: Column) -> Column:
    """NULL for vectors of no or different length, 0 if one is zero."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda t, v: t + v)
    norm = F.sqrt(dot(a, a) * dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0), F.when(norm > 0, dot(a, b) / norm).otherwise(0.0))


def semantic_divergence(a: Column, b: Column) -> Column:
    return F.least(F.greatest(1 - cosine(a, b), F.lit(0.0)), F.lit(1.0))


def all_signals(rows: DataFrame, signals: dict[str, Column]) -> DataFrame:
    """Each signal of an atom, with a mark where it is missing; NaN is missing."""
    clean = {n: F.when(~F.isnan(c), c) for n, c in signals.items()}
    return rows.withColumns(clean | {f"{n}_skipped": c.isNull().cast("int") for n, c in clean.items()})


# ---- systems


SYSTEMS = ("regguard", "plain_rag", "selfcheck", "nli_only", "llm_judge_all", "conformal_no_mondrian")


def system_risks(rows: DataFrame) -> DataFrame:
    """``system, risk, ...``: each system's own risk of every atom, from ``risk`` and the raw signals; the last one is their plain mean."""
    signals = [F.col(n) for n in WEIGHTS]
    present = reduce(lambda a, b: a + b, (s.isNotNull().cast("int") for s in signals))
    mean = F.when(present > 0, reduce(lambda a, b: a + b, (F.coalesce(s, F.lit(0.0)) for s in signals)) / present).otherwise(1.0)
    risk = dict(zip(SYSTEMS, (F.col("risk"), F.lit(0.0), F.col("s_ent"), F.col("s_nli"), F.col("s_ver"), mean), strict=True))
    pairs = F.explode(F.array(*(F.struct(F.lit(n).alias("system"), c.alias("system_risk")) for n, c in risk.items())))
    return rows.select("*", pairs.alias("_s")).select(*rows.columns, "_s.*").where("system_risk IS NOT NULL")


def system_table(rows: DataFrame, calibration: Column, eps: float) -> DataFrame:
    """Each system tuned on the calibration rows; error and coverage on the others, and the error at fixed coverages."""
    risks = system_risks(rows).withColumn("_c", calibration).select("system", F.col("system_risk").alias("risk"), "wrong", "_c")
    limits = tuned(risks.where("_c"), ["system"], eps)
    taken = F.col("risk") <= F.col("threshold")
    test = risks.where("NOT _c").join(F.broadcast(limits), "system")  # one row a system
    made = test.groupBy("system", "threshold").agg(F.try_divide(F.sum(F.when(taken, F.col("wrong"))), F.count_if(taken)).alias("hallucination"), (F.count_if(taken) / F.count("*")).alias("coverage"))
    fixed = wrong_at_coverage(risks.where("NOT _c"), ["system"], (0.4, 0.6, 0.8)).groupBy("system").pivot("share", [0.4, 0.6, 0.8]).agg(F.first("wrong_share"))
    return made.join(fixed.toDF("system", "at_40", "at_60", "at_80"), "system")


def stage_latency(rows: DataFrame, stages: Column) -> DataFrame:
    """Mean seconds of each stage of a map; a stage a question does not have is left out of its mean."""
    return rows.select(F.explode(stages).alias("stage", "seconds")).where("seconds IS NOT NULL").groupBy("stage").agg(F.count("*").alias("n"), F.avg("seconds").alias("seconds"))


def shares(rows: DataFrame, by: str) -> DataFrame:
    """Counts of each label and their per cent of all."""
    counts = rows.groupBy(by).agg(F.count("*").alias("n"))
    return counts.withColumn("percent", F.round(100 * F.col("n") / F.sum("n").over(Window.partitionBy()), 2))  # one row a label


def gate(facts: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """A row per rule over one row of facts: whether it holds."""
    return facts.select(F.explode(F.array(*(F.struct(F.lit(n).alias("rule"), F.coalesce(c, F.lit(False)).alias("holds")) for n, c in rules.items()))).alias("r")).select("r.*")


def release_gate(run: DataFrame, systems: DataFrame, ablation: DataFrame, seeds: DataFrame, drift: DataFrame, leaks: DataFrame, found: DataFrame, extracted: DataFrame, least: int = 150, delta: float = 0.1, least_seeds: int = 5, full: str = "regguard") -> DataFrame:
    """``rule, failing, holds``: everything that must hold before results are shown, with the number of rows that break it.

    ``run(n_atoms, violation_rate, simulated, commit, config, model)`` is one row; ``systems(system, hallucination, coverage, aurc, threshold)``
    and ``ablation`` of the same first columns, whose row ``full`` must be that of the systems; ``seeds(metric, seeds, low, high)``;
    ``drift(strategy, threshold, n_pre, n_post)``; ``leaks`` holds a row for each unit on several sides; ``found`` and ``extracted`` have a
    ``recall`` where they were computed. An empty table breaks the rule that asks for it, and those on its rows hold.
    """
    off = lambda c: c.cast("long")
    lack = lambda name: off(F.coalesce(F.col(name), F.lit(0)) == 0)
    one = ("hallucination", "coverage", "aurc")
    pick = lambda table, mark: table.where(F.col("system") == full).agg(F.count("*").alias(f"{mark}n"), *(F.first(c).alias(mark + c) for c in one))
    r = run.agg(F.count("*").alias("r_n"), *(F.first(c).alias(f"r_{c}") for c in ("n_atoms", "violation_rate", "simulated", "commit", "config", "model")))
    facts = [
        r,
        systems.agg(F.count("*").alias("s_n"), F.count("aurc").alias("s_aurc"), F.countDistinct(F.round("aurc", 6)).alias("s_distinct"), F.count_if(F.col("threshold").isNull()).alias("s_loose"), F.count_if(F.col("coverage") == 0).alias("s_empty")),
        ablation.agg(F.count("*").alias("a_n")),
        pick(systems, "m_"),
        pick(ablation, "f_"),
        seeds.agg(F.count("*").alias("d_n"), F.min("seeds").alias("d_seeds"), F.count_if(F.col("low").isNull() | F.col("high").isNull()).alias("d_open")),
        drift.agg(F.count("*").alias("w_n"), F.min("n_pre").alias("w_pre"), F.min("n_post").alias("w_post"), F.countDistinct("threshold").alias("w_distinct")),
        leaks.agg(F.count("*").alias("leaks")),
        found.agg(F.count("recall").alias("found")),
        extracted.agg(F.count("recall").alias("extracted")),
    ]
    wide = reduce(lambda a, b: a.join(F.broadcast(b)), facts)  # one row each
    rules = {
        "a run is recorded": lack("r_n"),
        "the run is no simulation": off(F.coalesce("r_simulated", F.lit(False))),
        "the commit is recorded": off(F.coalesce("r_commit", F.lit("unknown")).isin("", "unknown")),
        "the configuration is recorded": off(F.coalesce("r_config", F.lit("")) == ""),
        "the risk model is there": off(~F.coalesce("r_model", F.lit(False))),
        f"at least {least} atoms": off(F.coalesce("r_n_atoms", F.lit(0)) < least),
        "no unit is on several sides": F.col("leaks"),
        "the systems were compared": lack("s_n"),
        "areas of systems differ": F.greatest(F.col("s_aurc") - F.col("s_distinct"), off(F.col("s_aurc") < 2)),
        "every system has a threshold": F.col("s_loose"),
        "every system accepts something": F.col("s_empty"),
        "signals were dropped and fitted anew": lack("a_n"),
        "the full row is that of the systems": reduce(lambda a, b: a + b, (off(~F.col(f"m_{c}").eqNullSafe(F.col(f"f_{c}"))) for c in one)),
        f"violation rate is at most {delta}": off(F.coalesce(F.isnan("r_violation_rate") | (F.col("r_violation_rate") > delta), F.lit(True))),
        "seeds were compared": lack("d_n"),
        f"at least {least_seeds} seeds": off(F.col("d_seeds") < least_seeds),
        "every figure has an interval": F.col("d_open"),
        "drift was measured": lack("w_n"),
        f"at least {least} rows before the change": off(F.col("w_pre") < least),
        f"at least {least} rows after the change": off(F.col("w_post") < least),
        "strategies choose different thresholds": off((F.col("w_n") > 0) & (F.col("w_distinct") < 2)),
        "retrieval was measured": lack("found"),
        "extraction was measured": lack("extracted"),
    }
    made = wide.select(F.explode(F.array(*(F.struct(F.lit(n).alias("rule"), F.coalesce(c, F.lit(0).cast("long")).alias("failing")) for n, c in rules.items()))).alias("r")).select("r.*")
    return made.withColumn("holds", F.col("failing") == 0)


def required(rows: DataFrame, column: str, least: int) -> DataFrame:
    """The rows, or an error if one has no label or there are fewer than ``least``."""
    seen = rows.agg(F.count("*").alias("n"), F.count(column).alias("labelled")).first()
    if seen["labelled"] < seen["n"]:
        raise ValueError(f"{seen['n'] - seen['labelled']} rows without {column}")
    if seen["n"] < least:
        raise ValueError(f"{seen['n']} rows, at least {least} needed")
    return rows


# ---- training pairs and questions


def _hashed(key: Column, n: int) -> Column:
    """A choice of n by the key's md5, which any SQL engine repeats."""
    return F.conv(F.substring(F.md5(key.cast("string")), 1, 8), 16, 10).cast("long") % n


def perturbed(kind: Column, text: Column, key: Column) -> Column:
    """The text with its first rate, amount, section number or date made wrong, by a draw of the key; NULL if there is none.

    Rates and amounts move by 10 to 50 per cent up or down, never below 0; section numbers by 1 or 2, never below 1; dates by
    one to three years. What would stay as it was moves up by 1. The unit, and the form of a date, stay.
    """
    up = F.when(draw(key, F.lit("side")) < 0.5, 1).otherwise(-1)
    share, by = draw(key, F.lit("share")), draw(key, F.lit("by"))

    bound = lambda value, body: F.transform(F.array(value), body)[0]  # noqa: E731 - a value used more than once, computed once

    def first(form: str, change) -> Column:
        def replaced(x: Column) -> Column:
            before = F.substring(text, F.lit(1), x["at"] - 1 + F.instr(x["whole"], x["found"]) - 1)
            return F.concat(before, change(x["found"]), F.substring(text, F.length(before) + F.length(x["found"]) + 1, F.length(text)))

        parts = F.struct(F.regexp_extract(text, form, 1).alias("found"), F.regexp_extract(text, form, 0).alias("whole"), F.regexp_instr(text, F.lit(form)).alias("at"))
        return bound(parts, lambda x: F.when(x["found"] != "", replaced(x)))

    def unlike(value: Column, moved) -> Column:
        """A changed value; one above where the change left it as it was."""
        return bound(value, lambda v: F.coalesce(F.nullif(moved(v), v), v + 1))

    def number(found: Column) -> Column:
        moved = unlike(F.regexp_replace(found, ",", "").cast("double"), lambda v: F.round(v * (1 + up * (0.1 + 0.4 * share)), 2))
        return F.regexp_replace(F.format_string("%.2f", moved), r"(\.00|0)$", "")

    def section_number(found: Column) -> Column:
        return unlike(found.cast("long"), lambda v: F.greatest(v + up * F.when(by < 0.5, 1).otherwise(2), F.lit(1).cast("long"))).cast("string")

    def moved_day(found: Column) -> Column:
        moved = F.date_add(date(found), (up * (365 + F.floor(by * 731))).cast("int"))
        form = F.when(found.rlike("^[0-9]{4}"), "yyyy-MM-dd").when(found.contains("/"), "dd/MM/yyyy").otherwise("dd-MM-yyyy")
        return F.call_function("date_format", moved, form)

    words = "|".join(w.replace(" ", r"\s+") for w in SECTION_WORDS)
    rate, amount = first(PERCENT, number), first(r"([0-9][0-9,]*(?:\.[0-9]+)?)", number)
    section, day = first(rf"(?i)\b(?:{words})s?\s*([0-9]+)", section_number), first(r"\b([0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}[/-][0-9]{1,2}[/-][0-9]{4})\b", moved_day)
    return F.when(kind == "RATE", rate).when(kind == "THRESHOLD", amount).when(kind == "SECTION", section).when(kind == "DATE", day)


def nli_pairs(atoms: DataFrame) -> DataFrame:
    """Premise, hypothesis and label from ``atom, kind, claim, chunk_text, other_text``: true, made wrong, and with another chunk."""
    wrong = perturbed(F.col("kind"), F.col("claim"), F.col("atom"))
    pair = lambda premise, said, label: F.struct(premise.alias("premise"), said.alias("hypothesis"), F.lit(label).alias("label"))
    three = F.array(pair(F.col("chunk_text"), F.col("claim"), "entailment"), pair(F.col("chunk_text"), wrong, "contradiction"), pair(F.col("other_text"), F.col("claim"), "neutral"))
    return atoms.select("atom", F.explode(three).alias("p")).select("atom", "p.*").where("premise IS NOT NULL AND hypothesis IS NOT NULL")


def with_other(rows: DataFrame, key: str, text: str, buckets: int) -> DataFrame:
    """Each row with the text of another row, the next one by hash in its bucket (the first for the last); NULL if it is alone.

    Buckets are a count of the caller's, so that no window holds all rows.
    """
    bucket = _hashed(F.col(key), buckets)
    w = Window.partitionBy("_b").orderBy(F.md5(F.col(key).cast("string")), key)
    found = F.coalesce(F.lead(text).over(w), F.when(F.count("*").over(Window.partitionBy("_b")) > 1, F.first(text).over(w)))
    return rows.withColumn("_b", bucket).withColumn("other_text", found).drop("_b")


def templated(rows: DataFrame, key: str, subject: str, templates: tuple[str, ...]) -> DataFrame:
    """A question for each row: a template chosen by the key's hash, ``{}`` filled with the subject; equal texts once, by least key."""
    forms = F.element_at(F.array(*map(F.lit, templates)), (_hashed(F.col(key), len(templates)) + 1).cast("int"))
    made = rows.select(F.col(key), F.replace(forms, F.lit("{}"), F.col(subject)).alias("question"))
    return made.groupBy("question").agg(F.min(key).alias(key))


def amendment_pairs(versions: DataFrame) -> DataFrame:
    """Each version of a section with the next one: the text before and after an amendment."""
    w = Window.partitionBy("section").orderBy("effective_from", "version")
    return versions.select("section", F.col("version").alias("before"), F.lead("version").over(w).alias("after")).where("after IS NOT NULL")


def temporal_tags(questions: DataFrame, versions: DataFrame, since: Column) -> DataFrame:
    """``question, temporal, drift_type``: by family, by mark, or by a later version of the source's section since a day."""
    later = versions.where(F.col("effective_to").isNotNull() & (F.col("effective_from") >= since)).select("section").distinct().withColumn("_later", F.lit(True))
    value = (F.col("family") == "TEMPORAL") | F.coalesce("marked", F.lit(False))
    kind = F.when(value, "value").when(F.col("_later"), "supersession")
    return questions.join(later, "section", "left").select("question", kind.isNotNull().alias("temporal"), kind.alias("drift_type"))


# ---- records shown to a reader


def atom_row(risk: Column) -> Column:
    return F.struct(F.round(risk, 4).alias("risk"), badge(risk).alias("badge"))


def source_row(text: Column, characters: int = 300) -> Column:
    """Preview for a list of sources; the text itself stays whole."""
    return F.when(F.length(text) > characters, F.concat(F.substring(text, 1, characters), F.lit("..."))).otherwise(text)


def cache_key(*parts: Column) -> Column:
    return F.sha2(F.to_json(F.struct(*(p.alias(f"p{i}") for i, p in enumerate(parts)))), 256)
