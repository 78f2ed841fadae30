"""Queries over evidence frames, signals, systems, training pairs, answers and records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from verdara.functions import normalize as N
from verdara.functions import text as T
from verdara.operators import answers as A
from verdara.operators import certify as C
from verdara.operators import chunking, evaluate
from verdara.operators import decide as D
from verdara.operators import evidence as E
from verdara.operators import temporal as TM
from verdara.operators import verify as V
from verdara.plans import certification, evaluation, facts
from verdara.plans.data import ATOMS, TOKENS, VERSIONS, atoms, table, versions

TEXT = lambda c: F.col(c).cast("string")


def temporal_superseded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions as chunks without an end of their own, on 1 July 1998."""
    every = versions(spark, sf_dir)
    chunks = every.select("section", "version", "effective_from", F.when(F.col("version") % 9 == 0, F.lit("1998-01-01").cast("date")).alias("effective_to"))
    return TM.temporal_filter(chunks, every, F.lit("1998-07-01").cast("date")).select("section", "version", "effective_from")


def document_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Circulars written from orders, read back."""
    day, key = F.to_date("o_orderdate"), TEXT("o_orderkey")
    text = F.concat(F.lit("Circular dated "), F.date_format(day, "dd/MM/yyyy"), F.lit(", with effect from: "), F.date_format(day, "d MMM yyyy"), F.lit(", in supersession of the Master Circulars RBI/"), key, F.lit("-A. It amends guideline SEBI."), key, F.lit(" and supersedes direction D-"), key, F.lit("."))
    m = T.document_metadata(F.when(F.col("o_orderkey") % 7 == 0, F.lit("no dates here")).otherwise(text))
    return table(spark, sf_dir, "orders").select("o_orderkey", m["issue_date"].alias("issue_date"), m["effective_date"].alias("effective_date"), F.array_join(m["supersedes"], ",").alias("supersedes"), F.array_join(m["amends"], ",").alias("amends"))


def headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every form, headings or not."""
    size = TEXT("p_size")
    line = F.element_at(F.array(F.concat(F.lit("Part of the "), size), F.concat(size, F.lit(".2 Scope")), F.concat(F.lit("paragraph "), size), F.lit("CHAPTER IV - Duties"), F.concat(F.lit("Regulation "), size, F.lit("A")), F.concat(F.lit("see section "), size)), (F.col("p_partkey") % 6 + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", T.is_heading(line).alias("heading"))


def v1_cited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Atoms of all kinds on an order, against one chunk a line; the first line is cited."""
    lines = table(spark, sf_dir, "lineitem")
    day = F.to_date("l_shipdate")
    said = F.concat(F.lit("From "), F.date_format(day, "d MMMM yyyy"), F.lit(" under section "), TEXT("l_linenumber"), F.lit("(2) a fee of "), F.round(F.col("l_discount") * 100).cast("int").cast("string"), F.lit(" per cent applies"))
    chunks = lines.groupBy("l_orderkey", "l_linenumber").agg(F.min_by(said, F.struct("l_partkey", "l_suppkey", "l_quantity", "l_shipdate", "l_discount")).alias("text"))
    chunks = chunks.select(F.col("l_orderkey").alias("question"), F.col("l_linenumber").alias("chunk"), "text")
    key = F.col("o_orderkey")
    kind = F.element_at(F.array(*map(F.lit, ("RATE", "SECTION", "COMPUTED", "ENTITY"))), (key % 4 + 1).cast("int"))
    asked = table(spark, sf_dir, "orders").select(key.alias("atom"), key.alias("question"), kind.alias("kind"), (key % 11).cast("double").alias("value"), F.concat(F.lit("section"), (key % 9).cast("string"), F.lit("(2)")).alias("text_value"), F.lit(1).alias("cited"))
    return V.v1_cited(asked, chunks)


def v1_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order dates, written in words, against the ship dates of the lines."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("question"), F.concat(F.lit("shipped on "), F.date_format(F.to_date("l_shipdate"), "d MMMM yyyy"), F.lit(".")).alias("text"))
    asked = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("atom"), F.col("o_orderkey").alias("question"), F.lit("DATE").alias("kind"), F.lit(None).cast("double").alias("value"), N.date(F.date_format(F.date_add(F.to_date("o_orderdate"), (F.col("o_orderkey") % 60).cast("int")), "dd/MM/yyyy")).cast("string").alias("text_value"))
    return V.v1(asked, lines)


def best_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The turn of a conversation that shares most tokens with its first turn."""
    rows = table(spark, sf_dir, "conversations").where("text IS NOT NULL").select(F.col("conv_id").alias("question"), F.col("turn").alias("chunk"), F.array_distinct(T.tokens(F.col("text"))).alias("chunk_tokens"))
    first = rows.groupBy("question").agg(F.min("chunk").alias("chunk")).join(rows, ["question", "chunk"]).groupBy("question").agg(F.max("chunk_tokens").alias("claim_tokens"))
    start = rows.groupBy("question").agg(F.min("chunk").alias("start"))
    others = rows.join(start, "question").where("chunk > start").groupBy("question", "chunk").agg(F.max("chunk_tokens").alias("chunk_tokens"))
    return V.best_evidence(first.select("question", F.col("question").alias("claim"), "claim_tokens"), others)


def cascade_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.element_at(F.array(*map(F.lit, ("MATCH", "MISMATCH", "NOT_FOUND", "NA"))), (F.col("atom") % 4 + 1).cast("int"))
    made = V.cascade(atoms(spark, sf_dir).select("atom", status.alias("v1_status"), F.when(F.col("atom") % 3 != 0, F.col("risk")).alias("v2_entail_prob"), V.hypothesis(F.when(F.col("atom") % 2 == 0, F.lit(" ")).otherwise("claim"), F.lit("text")).alias("sentence")))
    return made.select("atom", "sentence", D.s_ver(F.col("v1_status")).alias("s_ver"), "v2_missing", "s_nli")


def signal_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Retrieval strength by rank and by score, entropy, divergence and what is missing, on lists made from an atom's numbers."""
    key = F.col("atom")
    n = (key % 5).cast("int")
    chunks = F.when(n == 0, F.array().cast("array<bigint>")).otherwise(F.sequence(F.lit(1).cast("bigint"), n.cast("bigint")))
    cited = F.when(key % 7 != 0, key % 6 + 1)
    scores = F.when(key % 2 == 0, F.map_from_arrays(chunks, F.transform(chunks, lambda c: (c * 37 % 11).cast("double"))))
    logprobs = F.array(*(-(key % m) / F.lit(3.0) for m in (5, 7, 23)))
    vectors = [F.array((key % a).cast("double"), (key % b).cast("double")) for a, b in ((3, 4), (5, 2))]
    span = E.token_span((key % 8).cast("int"), (key % 13).cast("int"))
    signals = {"s_ret": E.retrieval_strength(cited, chunks, scores), "s_ent": F.round(D.mean_entropy(logprobs, F.lit(1), F.lit(3)), 6), "s_max": F.round(E.max_entropy(logprobs, F.lit(0), F.lit(3)), 6), "s_div": F.round(E.semantic_divergence(*vectors), 6), "s_mech": F.when(key % 3 == 0, F.lit(float("nan"))).otherwise(0.5)}
    made = E.all_signals(atoms(spark, sf_dir).select("atom", span["start"].alias("first"), span["stop"].alias("last")), signals)
    return made.select("atom", "first", "last", "s_ret", "s_ent", "s_max", "s_div", "s_mech", "s_mech_skipped")


def _with_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = lambda k: F.when(F.col("atom") % k != 0, F.col("risk"))
    return atoms(spark, sf_dir).withColumns({"s_ver": part(2), "s_nli": part(3), "s_ent": part(5), "s_ret": part(7), "s_div": part(11), "s_mech": F.lit(None).cast("double")})


def system_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = E.system_table(_with_signals(spark, sf_dir), F.col("atom") % 2 == 0, 0.05)
    return made.select("system", "threshold", *(F.round(c, 6).alias(c) for c in ("hallucination", "coverage", "at_40", "at_60", "at_80")))


def stage_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    stages = F.map_from_arrays(F.array(F.lit("retrieve"), F.lit("verify"), F.lit("judge")), F.array(F.col("l_quantity"), F.col("l_discount"), F.when(F.col("l_linenumber") > 1, F.col("l_tax"))))
    return E.stage_latency(table(spark, sf_dir, "lineitem"), stages).select("stage", "n", F.round("seconds", 6).alias("seconds"))


def annotation_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.shares(table(spark, sf_dir, "labels"), "quality")


def annotator_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two annotators of the same documents, joined by document, with the band of their kappa."""
    one, two = (table(spark, sf_dir, "labels").select("doc_id", F.col(c).alias(c)) for c in ("quality", "toxic"))
    pairs = one.join(two, "doc_id").select("quality", (1 - F.col("toxic")).alias("clean"))
    made = evaluate.kappa(pairs, "quality", "clean")
    return made.select("n", F.round("kappa", 6).alias("kappa"), A.kappa_band(F.col("kappa")).alias("band"))


def metrics_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error, coverage, judged share, area under the risk-coverage curve, and how often random halves have over 5 per cent wrong, in one row."""
    rows = atoms(spark, sf_dir).withColumn("whole", F.lit(1))
    accept, judged = F.col("risk") <= 0.35, (F.col("risk") > 0.35) & (F.col("risk") < 0.7)
    one = rows.groupBy("whole").agg(F.count("*").alias("n"), F.try_divide(F.sum(F.when(accept, F.col("wrong"))), F.count_if(accept)).alias("hallucination"), (F.count_if(accept) / F.count("*")).alias("coverage"), (F.count_if(judged) / F.count("*")).alias("judge_rate"), F.coalesce(F.sum(F.when(accept, F.col("wrong"))), F.lit(0)).alias("k"), F.count_if(accept).alias("a"))
    one = one.withColumn("violation_rate", C.half_violations("k", "a", "n", F.lit(0.05), F.lit(200)))
    area = evaluate.aurc(evaluate.risk_coverage(rows, ["whole"]), ["whole"])
    return one.join(F.broadcast(area), "whole").select("n", *(F.round(c, 5).alias(c) for c in ("hallucination", "coverage", "judge_rate", "aurc", "violation_rate")))


def publishable(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = {"at least 150 atoms": F.col("n") >= 150, "some accepted": F.col("coverage") > 0, "errors known": F.col("hallucination").isNotNull(), "errors within 2 %": F.col("hallucination") <= 0.02, "area is no constant": F.col("aurc") != 0.9}
    return E.gate(metrics_report(spark, sf_dir), rules)


def release_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every condition of a release over the reports on the atoms; orders stand in for documents that splits share."""
    rows = _with_signals(spark, sf_dir)
    risks = E.system_risks(rows.where("atom % 2 = 1")).select("system", F.col("system_risk").alias("risk"), "wrong")
    areas = evaluate.aurc(evaluate.risk_coverage(risks, ["system"]), ["system"]).select("system", F.round("aurc", 5).alias("aurc"))
    systems = system_table(spark, sf_dir).select("system", "hallucination", "coverage", "threshold").join(areas, "system", "left")
    run = metrics_report(spark, sf_dir).select(F.col("n").alias("n_atoms"), "violation_rate", F.lit(False).alias("simulated"), F.lit(None).cast("string").alias("commit"), F.lit("eps 0.05").alias("config"), F.lit(True).alias("model"))
    seeds = evaluation.seed_summary(spark, sf_dir).select(F.col("kind").alias("metric"), F.col("n").alias("seeds"), "low", "high")
    sides = atoms(spark, sf_dir).agg(F.count_if(F.col("day") < certification.CUT).alias("n_pre"), F.count_if(F.col("day") >= certification.CUT).alias("n_post"))
    drift = certification.four_strategies(spark, sf_dir).select("strategy", "threshold").join(F.broadcast(sides))  # one row of counts
    return E.release_gate(run, systems, systems.where("system IN ('regguard', 'nli_only')"), seeds, drift, facts.leakage_report(spark, sf_dir), gold_report(spark, sf_dir), evaluation.extraction_f1(spark, sf_dir))


def _ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of an order by price: the question's ranked list; relevant if returned."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("query"), F.col("l_linenumber").alias("doc")).agg(F.max("l_extendedprice").alias("score"), F.max("l_returnflag").alias("flag"), F.max("l_suppkey").alias("l_suppkey"), F.max("l_quantity").alias("quantity"))
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "doc")).cast("long")
    return lines.withColumn("rank", rank).withColumn("relevant", F.col("flag") == "R")


def chunk_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranked suppliers joined with their rows, of one nation only."""
    suppliers = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("doc"), TEXT("s_nationkey").alias("nation"))
    ranked = _ranked(spark, sf_dir).select("query", F.col("l_suppkey").alias("doc"), "rank")
    return E.with_chunks(ranked, suppliers, {"nation": "7"}).select("query", "doc", "rank", "nation")


def two_stage_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four dearest lines of an order, of these the two of largest quantity."""
    rows = _ranked(spark, sf_dir)
    return E.reranked(rows, F.col("rank"), F.col("quantity"), 4, 2).select("query", "doc", "rank", "quantity")


def channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _ranked(spark, sf_dir)
    other = rows.select("query", "doc", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("quantity"), "doc")).cast("long").alias("rank"))
    return E.side_by_side(price=rows.where("rank <= 3"), quantity=other.where("rank <= 3"))


def gold_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _ranked(spark, sf_dir)
    sized = rows.withColumn("n_relevant", F.count_if("relevant").over(Window.partitionBy("query")))
    made = E.gold_report(sized, (2, 6))
    return made.select("k", "n", "status", *(F.round(c, 6).alias(c) for c in ("recall", "precision", "mrr", "ndcg")))


def legacy_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    answers = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("query"), (F.col("o_orderkey") % 6).alias("n_claims"), (F.col("o_orderkey") % 3).alias("n_citations"))
    made = E.legacy_report(_ranked(spark, sf_dir), F.col("relevant"), answers, 3)
    return made.select("n", *(F.round(c, 6).alias(c) for c in ("hit_rate", "precision", "mrr", "citation_rate", "claims")))


def prompt_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of a conversation as evidence in order, cut at the judge's 8,000 characters, with citations and a preview."""
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id", "turn").agg(F.max("text").alias("text"), F.max("role").alias("role"))
    cited = T.citation(F.col("role"), F.lit(2024), F.lit(None).cast("string"))
    made = rows.groupBy("conv_id").agg(E.joined_in_order(F.col("text"), F.col("turn"), most=8000).alias("e"), E.distinct_in_order(cited, F.col("turn")).alias("c"))
    return made.select("conv_id", F.md5("e").alias("evidence_md5"), F.array_join("c", "; ").alias("citations"), F.md5(E.source_row(F.col("e"))).alias("preview_md5"), E.cache_key(F.col("conv_id")).alias("cache_key"))


def span_of_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    span = A.find_span(F.col("p_name"), F.element_at(F.split("p_name", " "), 2))
    missing = A.find_span(F.col("p_name"), F.lit("no such words"))
    return table(spark, sf_dir, "part").select("p_partkey", span["start"].alias("start"), span["stop"].alias("stop"), missing["start"].alias("missing"))


def reply_atoms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fenced lists, objects, and broken replies; then valid ones, and those a form alone has found."""
    k = TEXT("p_partkey")
    one = F.concat(F.lit('{"type": "rate", "text": " '), k, F.lit(' %"}'))
    raw = F.element_at(F.array(F.concat(F.lit("```json\n["), one, F.lit(", "), one, F.lit("]\n```")), F.concat(F.lit('here: {"atoms": ['), one, F.lit(', {"type": "poem", "text": "x"}]}')), F.concat(F.lit('{"items": ['), one, F.lit("]}")), F.lit("no json [")), (F.col("p_partkey") % 4 + 1).cast("int"))
    model = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("answer"), F.posexplode(A.lenient_atoms(raw)).alias("start", "a")).select("answer", "a.type", "a.text", "start")
    model = A.valid_atoms(model, ("RATE", "DATE"), "start").select("answer", "type", "text", "start")
    forms = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("answer"), F.lit("THRESHOLD").alias("type"), F.when(F.col("p_partkey") % 8 == 0, F.concat(k, F.lit(" %"))).otherwise("5 days").alias("text"), F.lit(9).alias("start"))
    return A.merged_atoms(model, forms)


def rewrite_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All four modes on an answer with an outdated or rejected value."""
    k = TEXT("p_partkey")
    text = F.concat(F.lit("The rate is r"), k, F.lit(". It starts on d"), k, F.lit("."))
    status = F.element_at(F.array(*map(F.lit, ("OUTDATED", "REJECTED", "UNCERTAIN"))), (F.col("p_partkey") % 3 + 1).cast("int"))
    listed = F.array(F.struct(F.concat(F.lit("r"), k).alias("text"), status.alias("status")), F.struct(F.concat(F.lit("d"), k).alias("text"), F.lit("ACCEPTED").alias("status")))
    whole = F.when(F.col("p_partkey") % 5 == 0, "ABSTAINED").when(F.col("p_partkey") % 5 == 1, "FULLY_SUPPORTED").otherwise("PARTIALLY_SUPPORTED")
    rows = table(spark, sf_dir, "part")
    parts = [rows.select("p_partkey", F.lit(m).alias("asked"), A.rewrite(text, T.sentences(text), listed, whole, m).alias("r")) for m in ("flag", "trim", "stub_on_abstain", "none")]
    made = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    return made.select("p_partkey", "asked", "r.mode", "r.note", "r.text")


def computed_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    constants = F.map_from_arrays(F.array(F.lit("size"), F.lit("key")), F.array(TEXT("p_size"), TEXT("p_partkey")))
    return table(spark, sf_dir, "part").select("p_partkey", A.computed_note(F.lit("size * key"), constants, (F.col("p_size") * F.col("p_partkey")).cast("string")).alias("note"))


def extractive_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = F.array(F.concat(F.lit("A > B\nThe size of the part is "), TEXT("p_size"), F.lit(" units. Short. The key of the part is "), TEXT("p_partkey"), F.lit(" here.")), F.lit("Nothing."), F.lit("A last sentence that is long enough. And one more of them, too."), F.lit("A fourth chunk that is never read."))
    return table(spark, sf_dir, "part").select("p_partkey", T.extractive_answer(chunks).alias("answer"), T.not_in_evidence(F.when(F.col("p_partkey") % 2 == 0, "Not found in evidence.").otherwise("found")).alias("nothing"))


def hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = TEXT("p_size")
    h = T.question_hints(F.concat(F.lit("  Pay "), size, F.lit(" per cent   under Section "), size, F.lit("(1) by 12/03/2024 or later ")))
    return table(spark, sf_dir, "part").select("p_partkey", h["percent"].alias("percent"), h["section"].alias("section"), h["day"].alias("day"), h["topic"].alias("topic"))


def assessment_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    year = (F.col("p_size") + 1970).cast("string")
    same = N.dates_equal(F.concat(F.lit("1 April "), year), F.concat(F.lit("AY "), year))
    return table(spark, sf_dir, "part").select("p_partkey", N.fy_from_ay(F.concat(F.lit("AY "), year)).alias("fy"), same.alias("same"), N.dates_equal(year, F.lit("x")).alias("unknown"))


def wrong_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training pairs of claims on parts, with the next part's text as the unrelated one."""
    k, size = TEXT("p_partkey"), TEXT("p_size")
    kind = F.element_at(F.array(*map(F.lit, ("RATE", "THRESHOLD", "SECTION", "DATE", "ENTITY"))), (F.col("p_partkey") % 5 + 1).cast("int"))
    day = F.date_format(F.date_add(F.lit("2020-02-01").cast("date"), F.col("p_size")), "dd/MM/yyyy")
    claim = F.concat(F.lit("pay "), size, F.lit(" % in "), k, F.lit(" days, section "), size, F.lit(" from "), day)
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("atom"), kind.alias("kind"), claim.alias("claim"), F.concat(F.lit("part "), k).alias("chunk_text"))
    made = E.nli_pairs(E.with_other(rows, "atom", "chunk_text", 8))
    return made.select("atom", "label", "hypothesis", "premise")


def template_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select("p_partkey", F.element_at(F.split("p_name", " "), 1).alias("word"))
    return E.templated(rows, "p_partkey", "word", ("What is the limit on {}?", "Who may use {}?", "When does {} start?"))


def amendment_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.amendment_pairs(versions(spark, sf_dir))


def temporal_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("question"), F.col("c_custkey").alias("section"), F.when(F.col("c_custkey") % 10 == 0, "TEMPORAL").otherwise("RATE").alias("family"), F.when(F.col("c_custkey") % 7 == 0, True).alias("marked"))
    return E.temporal_tags(asked, versions(spark, sf_dir), F.lit("1997-06-01").cast("date"))


def atom_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = E.atom_row(F.col("risk") * 2 - 0.3)
    return atoms(spark, sf_dir).select("atom", r["risk"].alias("risk"), r["badge"].alias("badge"))


def chunk_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").withColumn("none", F.lit(None).cast("string"))
    return rows.select("p_partkey", chunking.breadcrumb("p_name", "p_type", "none").alias("breadcrumb"), chunking.chunk_id("p_partkey", "p_type").alias("chunk_id"))


def text_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaned text and claims of sentences written from parts."""
    size = TEXT("p_size")
    raw = F.concat(F.lit("  Pay  Rs. "), size, F.lit(" for pay-\nment in hours.\n\n\n\nEnd "))
    listed = F.concat(F.lit("Answer. DISCRETE_CLAIMS:\n- first "), size, F.lit("\n2) second\n\n* third"))
    plain = F.concat(F.lit("A long enough sentence "), size, F.lit(". Short one. Another long enough sentence here"))
    return table(spark, sf_dir, "part").select("p_partkey", T.clean(raw).alias("cleaned"), F.array_join(T.claims(listed), "|").alias("listed"), F.array_join(T.claims(plain), "|").alias("plain"), F.array_join(T.word_tokens(F.concat(F.lit("A 5% rate-cut, x "), size, F.lit("0 days"))), "|").alias("words"))


QUERIES = {
    f.__name__: f
    for f in (temporal_superseded, document_metadata, headings, v1_cited, v1_dates, best_evidence, cascade_rows, signal_frame, system_table, stage_latency, annotation_shares, annotator_agreement, metrics_report, publishable, release_gate, chunk_lookup, two_stage_rank, channels, gold_report, legacy_report, prompt_evidence, span_of_value, reply_atoms, rewrite_modes, computed_notes, extractive_answers, hints, assessment_years, wrong_claims, template_questions, amendment_pairs, temporal_tags, atom_rows, chunk_names, text_forms)
}


def _pick(key: str, n: int) -> str:
    return f"(('0x' || substr(md5(CAST({key} AS VARCHAR)), 1, 8))::BIGINT % {n})"


_RANKED = """l AS (SELECT l_orderkey AS query, l_linenumber AS doc, max(l_extendedprice) AS score, max(l_returnflag) AS flag, max(l_suppkey) AS l_suppkey, max(l_quantity) AS quantity FROM lineitem GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank, flag = 'R' AS relevant FROM l)"""
_METRICS = f"""WITH {ATOMS}, c AS (SELECT CAST(ceil(risk * 100 - 1e-9) AS INTEGER) AS step, count(*) AS n, sum(wrong) AS k FROM atoms GROUP BY 1),
g AS (SELECT s.step, sum(coalesce(n, 0)) OVER (ORDER BY s.step) AS n, sum(coalesce(k, 0)) OVER (ORDER BY s.step) AS k FROM (SELECT unnest(range(0, 101)) AS step) s LEFT JOIN c USING (step)),
q AS (SELECT count(*) AS t, count(*) - count(*) // 2 AS d, CAST(sum(wrong) FILTER (risk <= 0.35) AS BIGINT) AS k, count(*) FILTER (risk <= 0.35) AS n FROM atoms),
z AS (SELECT *, {certification._half('u', 'k', 't', 'd')} AS x FROM (SELECT q.*, {facts.draw_sql("'wrong'", 'i')} AS u, {facts.draw_sql("'right'", 'i')} AS v FROM q, (SELECT unnest(range(0, 200)) AS i))),
y AS (SELECT x, {certification._half('v', '(n - k)', '(t - k)', '(d - x)')} AS y FROM z),
v AS (SELECT step, round(n / max(n) OVER (), 6) AS coverage, round(k / n, 6) AS risk FROM g QUALIFY n > 0),
a AS (SELECT *, lag(coverage) OVER (ORDER BY step) AS c0, lag(risk) OVER (ORDER BY step) AS r0 FROM v),
m AS (SELECT count(*) AS n, round(avg(wrong) FILTER (risk <= 0.35), 5) AS hallucination, round(count(*) FILTER (risk <= 0.35) / count(*), 5) AS coverage, round(count(*) FILTER (risk > 0.35 AND risk < 0.7) / count(*), 5) AS judge_rate, (SELECT round(sum((coverage - c0) * (risk + r0) / 2), 5) FROM a) AS aurc, (SELECT round(avg(CAST(x + y > 0 AND x > 0.05::DOUBLE * (x + y) AS INTEGER)), 5) FROM y) AS violation_rate FROM atoms)"""
_SYS = f"""WITH {ATOMS}, g AS (SELECT *, CASE WHEN atom % 2 <> 0 THEN risk END AS s_ver, CASE WHEN atom % 3 <> 0 THEN risk END AS s_nli, CASE WHEN atom % 5 <> 0 THEN risk END AS s_ent, CASE WHEN atom % 7 <> 0 THEN risk END AS s_ret, CASE WHEN atom % 11 <> 0 THEN risk END AS s_div FROM atoms),
s AS (SELECT atom, wrong, unnest(['regguard', 'plain_rag', 'selfcheck', 'nli_only', 'llm_judge_all', 'conformal_no_mondrian']) AS system, unnest([risk, 0.0, s_ent, s_nli, s_ver, coalesce(list_avg([x FOR x IN [s_ver, s_nli, s_ent, s_ret, s_div] IF x IS NOT NULL]), 1.0)]) AS risk FROM g),
r AS (SELECT * FROM s WHERE risk IS NOT NULL),
cells AS (SELECT system, x.step, count(*) FILTER (risk <= x.step / 200.0::DOUBLE + 1e-11) AS n, sum(wrong) FILTER (risk <= x.step / 200.0::DOUBLE + 1e-11) AS k FROM r, (SELECT unnest(range(0, 201)) AS step) x WHERE atom % 2 = 0 GROUP BY ALL),
t AS (SELECT system, max(step / 200.0::DOUBLE) FILTER (n > 0 AND k <= 0.05::DOUBLE * n) AS threshold FROM cells GROUP BY system),
h AS (SELECT system, risk, count(*) AS n, sum(wrong) AS k FROM r WHERE atom % 2 = 1 GROUP BY ALL), u AS (SELECT *, sum(n) OVER (PARTITION BY system ORDER BY risk) AS upto, sum(n) OVER (PARTITION BY system) AS total FROM h),
w AS (SELECT *, greatest(round_even(share * total, 0), 1) AS want FROM u, (SELECT unnest([0.4::DOUBLE, 0.6, 0.8]) AS share)),
f AS (SELECT system, share, sum(greatest(least(n, want - (upto - n)), 0) * k / n) / max(want) AS e FROM w GROUP BY ALL)"""

ORACLES = {
    "temporal_superseded": f"""WITH {VERSIONS}, act AS (SELECT section, arg_max(version, effective_from + CAST(version AS INTEGER) * INTERVAL 0 DAY) AS a0, max(effective_from) AS f FROM versions WHERE effective_from <= DATE '1998-07-01' AND coalesce(effective_to, DATE '9999-12-31') >= DATE '1998-07-01' GROUP BY section),
active AS (SELECT v.section, max(v.version) AS active FROM versions v JOIN act ON v.section = act.section AND v.effective_from = act.f WHERE coalesce(v.effective_to, DATE '9999-12-31') >= DATE '1998-07-01' GROUP BY v.section)
SELECT v.section, v.version, v.effective_from FROM versions v LEFT JOIN active a USING (section) WHERE (a.active IS NULL OR a.active = v.version) AND v.effective_from <= DATE '1998-07-01' AND v.version % 9 <> 0""",
    "document_metadata": "SELECT o_orderkey, CASE WHEN o_orderkey % 7 <> 0 THEN CAST(o_orderdate AS DATE) END AS issue_date, CASE WHEN o_orderkey % 7 <> 0 THEN CAST(o_orderdate AS DATE) END AS effective_date, CASE WHEN o_orderkey % 7 <> 0 THEN 'RBI/' || o_orderkey || '-A,D-' || o_orderkey ELSE '' END AS supersedes, CASE WHEN o_orderkey % 7 <> 0 THEN 'SEBI.' || o_orderkey ELSE '' END AS amends FROM orders",
    "headings": "SELECT p_partkey, p_partkey % 6 BETWEEN 1 AND 4 AS heading FROM part",
    "v1_cited": """WITH c AS (SELECT l_orderkey, l_linenumber, arg_min(CAST(round(l_discount * 100) AS INTEGER), lpad(CAST(l_partkey AS VARCHAR), 12, '0') || lpad(CAST(l_suppkey AS VARCHAR), 12, '0') || lpad(CAST(CAST(l_quantity AS INTEGER) AS VARCHAR), 12, '0') || CAST(l_shipdate AS VARCHAR) || CAST(round(l_discount * 100) + 100 AS VARCHAR)) AS rate FROM lineitem GROUP BY ALL),
p AS (SELECT o_orderkey AS atom, l_linenumber AS chunk, CASE o_orderkey % 4 WHEN 2 THEN 'NOT_FOUND' WHEN 3 THEN 'NA' ELSE CASE WHEN l_linenumber IS NULL THEN 'NOT_FOUND' WHEN o_orderkey % 4 = 0 AND rate = o_orderkey % 11 OR o_orderkey % 4 = 1 AND l_linenumber = o_orderkey % 9 THEN 'MATCH' ELSE 'MISMATCH' END END AS s FROM orders LEFT JOIN c ON l_orderkey = o_orderkey)
SELECT atom, CASE max(CASE s WHEN 'MATCH' THEN 3 WHEN 'MISMATCH' THEN 2 WHEN 'NOT_FOUND' THEN 1 ELSE 0 END) WHEN 3 THEN 'MATCH' WHEN 2 THEN 'MISMATCH' WHEN 1 THEN 'NOT_FOUND' ELSE 'NA' END AS v1_status, max(s) FILTER (chunk = 1) AS cited_status FROM p GROUP BY atom""",
    "v1_dates": "SELECT o_orderkey AS atom, CASE WHEN count(l_orderkey) = 0 THEN 'NOT_FOUND' WHEN bool_or(CAST(l_shipdate AS DATE) = CAST(o_orderdate AS DATE) + CAST(o_orderkey % 60 AS INTEGER)) THEN 'MATCH' ELSE 'MISMATCH' END AS v1_status FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey",
    "best_evidence": f"""WITH r AS (SELECT conv_id, turn, list_distinct({TOKENS}) AS t FROM conversations WHERE text IS NOT NULL), s AS (SELECT conv_id, min(turn) AS a FROM r GROUP BY 1),
o AS (SELECT r.conv_id AS claim, r.turn AS chunk, CAST(len(list_intersect(r.t, f.t)) AS INTEGER) AS overlap FROM r JOIN s USING (conv_id) JOIN r f ON f.conv_id = s.conv_id AND f.turn = s.a WHERE r.turn > s.a)
SELECT claim, max(overlap) AS overlap, arg_min(chunk, -overlap * 100000 + chunk) AS chunk FROM o GROUP BY claim""",
    "cascade_rows": f"WITH {ATOMS} SELECT atom, CASE WHEN atom % 2 = 0 THEN 'text' ELSE 'claim' END AS sentence, CASE atom % 4 WHEN 0 THEN 0.0 WHEN 1 THEN 1.0 WHEN 2 THEN 0.6 ELSE 0.5 END::DOUBLE AS s_ver, CAST(atom % 3 = 0 AS INTEGER) AS v2_missing, CASE WHEN atom % 3 <> 0 THEN round(1 - risk, 4) END AS s_nli FROM atoms",
    "signal_frame": f"""WITH {ATOMS}, b AS (SELECT atom, atom % 5 AS n, CASE WHEN atom % 7 <> 0 THEN atom % 6 + 1 END AS cited, [atom % 5, atom % 7, atom % 23] AS l, (atom % 3)::DOUBLE AS a1, (atom % 4)::DOUBLE AS a2, (atom % 5)::DOUBLE AS b1, (atom % 2)::DOUBLE AS b2 FROM atoms),
c AS (SELECT *, [(x * 37 % 11)::DOUBLE FOR x IN range(1, n + 1)] AS sc, sqrt((a1 * a1 + a2 * a2) * (b1 * b1 + b2 * b2)) AS norm FROM b)
SELECT atom, CAST(atom % 8 // 4 AS INTEGER) AS first, CAST(greatest(atom % 13 // 4, atom % 8 // 4 + 1) AS INTEGER) AS last,
  CASE WHEN atom % 2 = 0 AND n > 0 THEN CASE WHEN list_min(sc) = list_max(sc) THEN CASE WHEN cited IS NOT NULL THEN 1.0 ELSE 0.0 END ELSE round((coalesce(CASE WHEN cited <= n THEN sc[cited] END, list_min(sc)) - list_min(sc)) / (list_max(sc) - list_min(sc)), 4) END
    WHEN n = 0 THEN 0.5 WHEN cited IS NULL OR cited > n THEN 0.0 ELSE round(1 - (cited - 1) / n::DOUBLE, 4) END::DOUBLE AS s_ret,
  round((least(l[2] / 3.0::DOUBLE, 5) + least(l[3] / 3.0::DOUBLE, 5)) / 2, 6) AS s_ent, round(least(list_max(l) / 3.0::DOUBLE, 5), 6) AS s_max,
  round(least(greatest(1 - CASE WHEN norm > 0 THEN (a1 * b1 + a2 * b2) / norm ELSE 0 END, 0), 1), 6) AS s_div, CASE WHEN atom % 3 <> 0 THEN 0.5::DOUBLE END AS s_mech, CAST(atom % 3 = 0 AS INTEGER) AS s_mech_skipped FROM c""",
    "system_table": f"""{_SYS} SELECT r.system, threshold, round(avg(wrong) FILTER (risk <= threshold), 6) AS hallucination, round(count(*) FILTER (risk <= threshold) / count(*), 6) AS coverage,
  round((SELECT e FROM f WHERE f.system = r.system AND share = 0.4), 6) AS at_40, round((SELECT e FROM f WHERE f.system = r.system AND share = 0.6), 6) AS at_60, round((SELECT e FROM f WHERE f.system = r.system AND share = 0.8), 6) AS at_80
FROM r JOIN t USING (system) WHERE atom % 2 = 1 GROUP BY r.system, threshold""",
    "stage_latency": "SELECT 'retrieve' AS stage, count(l_quantity) AS n, round(avg(l_quantity), 6) AS seconds FROM lineitem UNION ALL SELECT 'verify', count(l_discount), round(avg(l_discount), 6) FROM lineitem UNION ALL SELECT 'judge', count(l_tax), round(avg(l_tax), 6) FROM lineitem WHERE l_linenumber > 1",
    "annotation_shares": "SELECT quality, count(*) AS n, round(100 * count(*) / sum(count(*)) OVER (), 2) AS percent FROM labels GROUP BY quality",
    "annotator_agreement": """WITH p AS (SELECT a.quality AS x, 1 - b.toxic AS y FROM labels a JOIN labels b USING (doc_id)), o AS (SELECT count(*)::DOUBLE AS n, avg(CAST(x = y AS INTEGER)) AS po, avg(x) * avg(y) + (1 - avg(x)) * (1 - avg(y)) AS pe FROM p), k AS (SELECT n, (po - pe) / (1 - pe) AS k FROM o)
SELECT CAST(n AS BIGINT) AS n, round(k, 6) AS kappa, CASE WHEN k < 0 THEN 'poor (below chance)' WHEN k < 0.2 THEN 'slight' WHEN k < 0.4 THEN 'fair' WHEN k < 0.6 THEN 'moderate' WHEN k < 0.8 THEN 'substantial' ELSE 'almost perfect' END AS band FROM k""",
    "metrics_report": f"{_METRICS} SELECT * FROM m",
    "publishable": f"{_METRICS} SELECT unnest(['at least 150 atoms', 'some accepted', 'errors known', 'errors within 2 %', 'area is no constant']) AS rule, unnest([n >= 150, coverage > 0, hallucination IS NOT NULL, hallucination <= 0.02, aurc <> 0.9]) AS holds FROM m",
    "chunk_lookup": f"WITH {_RANKED} SELECT query, l_suppkey AS doc, rank, CAST(s_nationkey AS VARCHAR) AS nation FROM ranked JOIN supplier ON s_suppkey = l_suppkey WHERE s_nationkey = 7",
    "two_stage_rank": f"WITH {_RANKED} SELECT query, doc, row_number() OVER (PARTITION BY query ORDER BY quantity DESC, f) AS rank, quantity FROM (SELECT query, doc, quantity, row_number() OVER (PARTITION BY query ORDER BY rank, doc) AS f FROM ranked QUALIFY f <= 4) QUALIFY rank <= 2",
    "channels": f"WITH {_RANKED} SELECT 'price' AS channel, query, rank, doc FROM ranked WHERE rank <= 3 UNION ALL SELECT 'quantity', query, r, doc FROM (SELECT query, doc, row_number() OVER (PARTITION BY query ORDER BY quantity DESC, doc) AS r FROM ranked) WHERE r <= 3",
    "gold_report": f"""WITH {_RANKED}, z AS (SELECT *, count(*) FILTER (relevant) OVER (PARTITION BY query) AS nr FROM ranked),
q AS (SELECT k, query, any_value(nr) AS nr, count(*) FILTER (relevant) AS hits, min(rank) FILTER (relevant) AS f, coalesce(sum(1 / log2(rank + 1)) FILTER (relevant), 0) AS dcg FROM z, (SELECT unnest([2, 6]) AS k) WHERE rank <= k GROUP BY ALL)
SELECT k, count(*) AS n, 'ok' AS status, round(avg(hits / nullif(nr, 0)), 6) AS recall, round(avg(hits / k), 6) AS precision, round(avg(coalesce(1.0 / f, 0)), 6) AS mrr, round(avg(CASE WHEN nr > 0 THEN dcg / list_sum([1 / log2(i + 1) FOR i IN range(1, CAST(least(nr, k) AS BIGINT) + 1)]) ELSE 0 END), 6) AS ndcg FROM q GROUP BY k""",
    "legacy_report": f"""WITH {_RANKED}, q AS (SELECT query, count(*) FILTER (relevant) AS hits, min(rank) FILTER (relevant) AS f FROM ranked WHERE rank <= 3 GROUP BY query), a AS (SELECT o_orderkey % 6 AS c, o_orderkey % 3 AS t, coalesce(hits, 0) AS hits, f FROM orders LEFT JOIN q ON query = o_orderkey)
SELECT count(*) AS n, round(avg(CAST(hits > 0 AS INTEGER)), 6) AS hit_rate, round(avg(hits / 3), 6) AS precision, round(avg(coalesce(1.0 / f, 0)), 6) AS mrr, round(avg(CAST(t > 0 AS INTEGER)), 6) AS citation_rate, round(avg(c), 6) AS claims FROM a""",
    "prompt_evidence": """WITH r AS (SELECT conv_id, turn, max(text) AS text, max(role) AS role FROM conversations GROUP BY ALL), e AS (SELECT conv_id, substr(coalesce(string_agg(text, chr(10) || chr(10) ORDER BY turn), ''), 1, 8000) AS e FROM r GROUP BY conv_id),
c AS (SELECT conv_id, string_agg('[' || role || ' (2024), General]', '; ' ORDER BY t) AS citations FROM (SELECT conv_id, role, min(turn) AS t FROM r GROUP BY ALL) GROUP BY conv_id)
SELECT conv_id, md5(e) AS evidence_md5, citations, md5(CASE WHEN length(e) > 300 THEN substr(e, 1, 300) || '...' ELSE e END) AS preview_md5, sha256('{"p0":' || conv_id || '}') AS cache_key FROM e JOIN c USING (conv_id)""",
    "span_of_value": "SELECT p_partkey, CAST(strpos(p_name, string_split(p_name, ' ')[2]) - 1 AS INTEGER) AS start, CAST(strpos(p_name, string_split(p_name, ' ')[2]) - 1 + length(string_split(p_name, ' ')[2]) AS INTEGER) AS stop, NULL AS missing FROM part",
    "reply_atoms": """SELECT p_partkey AS answer, 'RATE' AS type, p_partkey || ' %' AS text, CAST(0 AS INTEGER) AS start FROM part WHERE p_partkey % 4 <> 3
UNION ALL SELECT p_partkey, 'THRESHOLD', '5 days', 9 FROM part WHERE p_partkey % 8 <> 0""",
    "rewrite_modes": """WITH p AS (SELECT p_partkey, unnest(['flag', 'trim', 'stub_on_abstain', 'none']) AS asked, ['OUTDATED', 'REJECTED', 'UNCERTAIN'][p_partkey % 3 + 1] AS s, 'The rate is r' || p_partkey || '. It starts on d' || p_partkey || '.' AS t FROM part),
n AS (SELECT *, CASE s WHEN 'REJECTED' THEN '⚠ Note: This answer contains claims that were rejected.' WHEN 'OUTDATED' THEN '⚠ Note: This answer may reference superseded regulatory text.' ELSE '⚠ Note: This answer contains claims that could not be fully verified.' END AS nt FROM p)
SELECT p_partkey, asked, CASE WHEN p_partkey % 5 = 1 THEN 'none' WHEN p_partkey % 5 = 0 OR asked = 'stub_on_abstain' THEN 'stub' ELSE asked END AS mode,
  CASE WHEN p_partkey % 5 = 1 THEN '' WHEN p_partkey % 5 = 0 OR asked = 'stub_on_abstain' THEN '⚠ This answer could not be verified.' ELSE nt END AS note,
  CASE WHEN p_partkey % 5 = 1 THEN t WHEN p_partkey % 5 = 0 THEN 'This answer cannot be provided.' WHEN asked = 'stub_on_abstain' THEN '⚠ This answer could not be verified.' || chr(10) || chr(10) || 'This answer cannot be provided.'
    ELSE nt || chr(10) || chr(10) || CASE asked WHEN 'flag' THEN 'The rate is [' || CASE s WHEN 'UNCERTAIN' THEN '⚠ UNVERIFIED' ELSE s END || ': r' || p_partkey || ']. It starts on d' || p_partkey || '.' WHEN 'trim' THEN 'It starts on d' || p_partkey || '.' ELSE t END END AS text FROM n""",
    "computed_notes": "SELECT p_partkey, 'formula: size * key; constants: key=' || p_partkey || ', size=' || p_size || '; result: ' || p_size * p_partkey AS note FROM part",
    "extractive_answers": "SELECT p_partkey, 'The size of the part is ' || p_size || ' units. The key of the part is ' || p_partkey || ' here. A last sentence that is long enough. And one more of them, too.' AS answer, p_partkey % 2 = 0 AS nothing FROM part",
    "hints": "SELECT p_partkey, p_size || ' per cent' AS percent, 'Section ' || p_size || '(1)' AS section, '12/03/2024' AS day, 'Pay ' || p_size || ' per cent under Section' AS topic FROM part",
    "assessment_years": "SELECT p_partkey, 'FY ' || (p_size + 1969) || '-' || lpad(CAST((p_size + 1970) % 100 AS VARCHAR), 2, '0') AS fy, true AS same, CAST(NULL AS BOOLEAN) AS unknown FROM part",
    "wrong_claims": f"""WITH p AS (SELECT p_partkey AS atom, p_size AS z, DATE '2020-02-01' + CAST(p_size AS INTEGER) AS day, 'part ' || p_partkey AS chunk, {_pick('p_partkey', 8)} AS b, md5(CAST(p_partkey AS VARCHAR)) AS h,
  CASE WHEN {facts.draw_sql('p_partkey', "'side'")} < 0.5 THEN 1 ELSE -1 END AS up, {facts.draw_sql('p_partkey', "'share'")} AS share, {facts.draw_sql('p_partkey', "'by'")} AS by_ FROM part),
o AS (SELECT *, 'pay ' || z || ' % in ' || atom || ' days, section ' AS head, strftime(day, '%d/%m/%Y') AS d, coalesce(lead(chunk) OVER (PARTITION BY b ORDER BY h, atom), CASE WHEN count(*) OVER (PARTITION BY b) > 1 THEN first_value(chunk) OVER (PARTITION BY b ORDER BY h, atom) END) AS other,
  round(z * (1 + up * (0.1::DOUBLE + 0.4::DOUBLE * share)), 2) AS r, greatest(z + up * CASE WHEN by_ < 0.5 THEN 1 ELSE 2 END, 1) AS s FROM p),
w AS (SELECT *, head || z || ' from ' || d AS claim, regexp_replace(printf('%.2f', CASE WHEN r = z THEN z + 1.0 ELSE r END), '(\\.00|0)$', '') AS wr, CASE WHEN s = z THEN z + 1 ELSE s END AS ws, strftime(day + CAST(up * (365 + floor(by_ * 731)) AS INTEGER), '%d/%m/%Y') AS wd FROM o)
SELECT atom, 'entailment' AS label, claim AS hypothesis, chunk AS premise FROM w UNION ALL SELECT atom, 'neutral', claim, other FROM w WHERE other IS NOT NULL
UNION ALL SELECT atom, 'contradiction', CASE atom % 5 WHEN 2 THEN head || ws || ' from ' || d WHEN 3 THEN head || z || ' from ' || wd ELSE 'pay ' || wr || ' % in ' || atom || ' days, section ' || z || ' from ' || d END, chunk FROM w WHERE atom % 5 <> 4""",
    "template_questions": f"WITH p AS (SELECT p_partkey, replace(['What is the limit on {{}}?', 'Who may use {{}}?', 'When does {{}} start?'][{_pick('p_partkey', 3)} + 1], '{{}}', string_split(p_name, ' ')[1]) AS question FROM part) SELECT question, min(p_partkey) AS p_partkey FROM p GROUP BY question",
    "amendment_pairs": f"WITH {VERSIONS} SELECT section, version AS before, lead(version) OVER (PARTITION BY section ORDER BY effective_from, version) AS after FROM versions QUALIFY after IS NOT NULL",
    "temporal_tags": f"""WITH {VERSIONS}, l AS (SELECT DISTINCT section FROM versions WHERE effective_to IS NOT NULL AND effective_from >= DATE '1997-06-01'), t AS (SELECT c_custkey AS question, CASE WHEN c_custkey % 10 = 0 OR c_custkey % 7 = 0 THEN 'value' WHEN c_custkey IN (SELECT section FROM l) THEN 'supersession' END AS drift_type FROM customer)
SELECT question, drift_type IS NOT NULL AS temporal, drift_type FROM t""",
    "atom_rows": f"WITH {ATOMS}, r AS (SELECT atom, risk * 2 - 0.3::DOUBLE AS r FROM atoms) SELECT atom, round(r, 4) AS risk, CASE WHEN r <= 0.25 THEN 'LOW' WHEN r <= 0.6 THEN 'MEDIUM' ELSE 'HIGH' END AS badge FROM r",
    "chunk_names": r"SELECT p_partkey, p_name || ' > ' || p_type || ' > General' AS breadcrumb, regexp_replace(p_partkey || '_' || p_type, '\s+', '_', 'g') AS chunk_id FROM part",
    "text_forms": "SELECT p_partkey, 'Pay ₹ ' || p_size || ' for payment in hours.' || chr(10) || chr(10) || 'End' AS cleaned, 'first ' || p_size || '|second|third' AS listed, 'A long enough sentence ' || p_size || '|Another long enough sentence here' AS plain, 'rate-cut|' || p_size || '0|days' AS words FROM part",
}

_AREAS = f"""{_SYS}, c AS (SELECT system, CAST(ceil(risk * 100 - 1e-9) AS INTEGER) AS step, count(*) AS n, sum(wrong) AS k FROM r WHERE atom % 2 = 1 GROUP BY ALL),
g2 AS (SELECT s.system, s.step, sum(coalesce(n, 0)) OVER o AS n, sum(coalesce(k, 0)) OVER o AS k FROM (SELECT system, unnest(range(0, 101)) AS step FROM (SELECT DISTINCT system FROM r)) s LEFT JOIN c USING (system, step) WINDOW o AS (PARTITION BY s.system ORDER BY s.step)),
v AS (SELECT system, step, round(n / max(n) OVER (PARTITION BY system), 6) AS coverage, round(k / n, 6) AS risk FROM g2 QUALIFY n > 0),
a AS (SELECT *, lag(coverage) OVER (PARTITION BY system ORDER BY step) AS c0, lag(risk) OVER (PARTITION BY system ORDER BY step) AS r0 FROM v)
SELECT system, round(sum((coverage - c0) * (risk + r0) / 2), 5) AS aurc FROM a GROUP BY system"""

ORACLES["release_gate"] = f"""WITH m AS ({ORACLES['metrics_report']}), s AS (SELECT * FROM ({ORACLES['system_table']}) LEFT JOIN ({_AREAS}) USING (system)), d AS ({certification.ORACLES['four_strategies']}),
sides AS (WITH {ATOMS} SELECT count(*) FILTER (day < DATE '{certification.CUT}') AS pre, count(*) FILTER (day >= DATE '{certification.CUT}') AS post FROM atoms),
rules(rule, failing) AS (
  SELECT unnest(['a run is recorded', 'the run is no simulation', 'the configuration is recorded', 'the risk model is there', 'the systems were compared', 'signals were dropped and fitted anew', 'the full row is that of the systems', 'seeds were compared', 'every figure has an interval', 'drift was measured', 'retrieval was measured', 'extraction was measured']), 0
  UNION ALL SELECT 'the commit is recorded', 1 UNION ALL SELECT 'at least 150 atoms', CAST(n < 150 AS BIGINT) FROM m UNION ALL SELECT 'no unit is on several sides', count(*) FROM ({facts.ORACLES['leakage_report']})
  UNION ALL SELECT 'areas of systems differ', greatest(count(aurc) - count(DISTINCT aurc), CAST(count(aurc) < 2 AS BIGINT)) FROM s UNION ALL SELECT 'every system has a threshold', count(*) FILTER (threshold IS NULL) FROM s
  UNION ALL SELECT 'every system accepts something', count(*) FILTER (coverage = 0) FROM s UNION ALL SELECT 'violation rate is at most 0.1', CAST(coalesce(violation_rate > 0.1, true) AS BIGINT) FROM m
  UNION ALL SELECT 'at least 5 seeds', CAST(min(n) < 5 AS BIGINT) FROM ({evaluation.ORACLES['seed_summary']}) UNION ALL SELECT 'at least 150 rows before the change', CAST(pre < 150 AS BIGINT) FROM sides
  UNION ALL SELECT 'at least 150 rows after the change', CAST(post < 150 AS BIGINT) FROM sides UNION ALL SELECT 'strategies choose different thresholds', CAST(count(DISTINCT threshold) < 2 AS BIGINT) FROM d)
SELECT rule, CAST(failing AS BIGINT) AS failing, failing = 0 AS holds FROM rules"""
