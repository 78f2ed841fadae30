"""Operators against small hand-made cases."""

import datetime

import pytest
from pyspark.sql import functions as F

from verdara.operators import chunking, evaluate, guarantee, retrieval, splits, temporal, verify
from verdara.operators import answers as A
from verdara.operators import certify as C
from verdara.operators import evidence as E
from verdara.operators import retrieval as R

day = datetime.date.fromisoformat


def test_rrf_order(spark):
    lists = [spark.createDataFrame([("q", c, i + 1) for i, c in enumerate(x)], "query string, doc string, rank int") for x in ("ABC", "CAD")]
    assert [r["doc"] for r in retrieval.rrf(*lists).orderBy(F.desc("score")).collect()] == ["A", "C", "B", "D"]


def test_version_in_force(spark):
    versions = spark.createDataFrame([(42, 1, day("2023-01-01")), (42, 2, day("2023-06-01")), (42, 3, day("2024-01-01"))], "section int, version int, effective_from date")
    asked = spark.createDataFrame([(1, 42, day("2023-03-01")), (2, 42, day("2023-07-01")), (3, 42, day("2024-05-01")), (4, 42, day("2022-01-01"))], "question int, section int, as_of date")
    found = {r["question"]: r["version"] for r in temporal.in_force(asked, temporal.with_ends(versions)).collect()}
    assert found == {1: 1, 2: 2, 3: 3}


def test_v1(spark):
    atoms = spark.createDataFrame([(1, 1, "RATE", 5.0), (2, 1, "RATE", 6.0), (3, 2, "RATE", 5.0), (4, 1, "ENTITY", None), (5, 1, "COMPUTED", 1.0), (6, 3, "THRESHOLD", 500000.0)], "atom int, question int, kind string, value double")
    evidence = spark.createDataFrame([(1, "the rate is 5 per cent"), (1, "or 7%"), (2, "no figure"), (3, "up to Rs. 5 lakh")], "question int, text string")
    assert {r["atom"]: r["v1_status"] for r in verify.v1(atoms, evidence).collect()} == {1: "MATCH", 2: "MISMATCH", 3: "NOT_FOUND", 4: "NA", 5: "NOT_FOUND", 6: "MATCH"}


def test_ltt_is_fixed_sequence(spark):
    good = [(i, "a", i / 1000, 0) for i in range(300)] + [(300 + i, "a", 0.5, 1) for i in range(50)]
    rows = spark.createDataFrame(good + [(1000 + i, "b", 0.1, 1) for i in range(100)], "atom int, kind string, risk double, wrong int")
    found = {r["kind"]: r["accept_below"] for r in guarantee.ltt(rows, ["kind"], 0.05, 0.1).collect()}
    assert 0.29 <= found["a"] < 0.5 and found["b"] is None


def test_kappa_and_mcnemar(spark):
    pairs = spark.createDataFrame([(1, 1)] * 20 + [(0, 0)] * 15 + [(1, 0)] * 5 + [(0, 1)] * 10, "a int, b int")
    row = evaluate.kappa(pairs, "a", "b").first()
    assert row["observed"] == pytest.approx(0.7) and row["kappa"] == pytest.approx((0.7 - 0.5) / 0.5)
    assert evaluate.mcnemar(pairs, F.col("a") == 1, F.col("b") == 1).first()["statistic"] == pytest.approx(16 / 15)


def test_coverage_is_monotone(spark):
    rows = spark.range(500).select(F.col("id").alias("atom"), (F.col("id") % 97 / 97).alias("risk"), (F.col("id") % 3 == 0).cast("int").alias("wrong"), F.lit("x").alias("kind"))
    curve = [r["coverage"] for r in evaluate.risk_coverage(rows, ["kind"]).orderBy("step").collect()]
    assert curve == sorted(curve) and curve[-1] == 1


def chunked_by_loop(pages, words, overlap):
    """The chunker line by line: pages of one document as texts."""
    out, chapter, section, number = [], "General", "Main Provisions", 0
    for page, text in pages:
        held = []
        for line in filter(None, map(str.strip, (text or "").split("\n"))):
            head = [*line.lower().split(), "", ""]
            chapter = line[:80] if head[0] in ("chapter", "part") and head[1][:1] in set("0123456789ivxlcdm") else chapter
            opens = head[0] in ("section", "paragraph") and head[1][:1].isdigit() or head[0][:1].isdigit() and not head[0].strip("0123456789.") and head[1][:1].isalpha()
            section = line[:100] if opens else section
            held.append(line)
            if sum(len(x.split()) for x in held) >= words:
                number += 1
                out.append((page, number, chapter, section, len(held), "\n".join(held)))
                held = held[len(held) - overlap :] if len(held) > overlap else []
        if held:
            number += 1
            out.append((page, number, chapter, section, len(held), "\n".join(held)))
    return out


def test_word_chunks_equal_a_loop(spark):
    import random

    rng = random.Random(3)
    heads = ["Chapter IV - Duties", "part of it", "Part 2", "3.1 Scope", "Section 5", "Regulation 9", "paragraph 7 " + "x" * 120, "", "  ", "3.1"]
    docs = {d: [(p, "\n".join(rng.choice(heads) if rng.random() < 0.3 else " " + "w " * rng.randint(1, 9) for _ in range(rng.randint(0, 40)))) for p in range(rng.randint(1, 5))] for d in range(30)}
    docs[30], docs[31], docs[32] = [(0, None), (1, ""), (2, "one")], [(0, "word " * 5000)], [(0, "\n".join(["w w w w w w w"] * 3000))]
    rows = spark.createDataFrame([(d, p, t, 1) for d, pages in docs.items() for p, t in pages for _ in range(1 + (d == 5))], "doc_id long, page_no int, text string, page int")
    for words, overlap in ((20, 3), (20, 1), (7, 0)):
        made = chunking.word_chunks(rows, words, overlap).collect()
        found = sorted((r["doc"], r["page"], r["chunk_no"], r["chapter"], r["section"], r["n_lines"], r["text"]) for r in made)
        assert found == [(d, *x) for d, pages in docs.items() for x in chunked_by_loop(pages, words, overlap)]
    assert chunking.word_chunks(rows.limit(0)).count() == 0


def test_dense_top_k(spark):
    vectors = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.9, 0.1]), (2, [0.0, 1.0]), (3, None)], "vec_id long, embedding array<float>")
    found = retrieval.dense_top_k(vectors, vectors.where("vec_id = 0"), 2).orderBy("rank").collect()
    assert [r["doc"] for r in found] == [1, 2]


def test_splits(spark):
    rows = spark.range(1000).withColumn("split", splits.split_of(F.col("id")))
    counts = {r["split"]: r["count"] for r in rows.groupBy("split").count().collect()}
    assert set(counts) == {"calibration", "test", "agg_val"} and 350 < counts["test"] < 650
    todo, done = spark.createDataFrame([(1,), (2,), (3,)], "k int"), spark.createDataFrame([(1, "DONE"), (2, "ERROR")], "k int, status string")
    assert sorted(r["k"] for r in splits.pending(todo, done, "k").collect()) == [2, 3]


def test_atoms_settle_overlaps(spark):
    text = "Pay 12.5 % p.a. or 2:1 on ₹5,00,000 or ₹ 2.5 crore within 30 days under Section 52(4) and para 3 from 12/03/2024, 5 March 2023, FY 2023-24; rule 5 % holds"
    rows = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "5\u00015 days")], "a long, t string")
    made = [tuple(r) for r in A.find_atoms(rows, "a", "t").where("answer = 1").orderBy("start").collect()]
    assert [(k, t) for _, k, t, _, _ in made] == [("RATE", "12.5 % p.a."), ("RATE", "2:1"), ("THRESHOLD", "₹5,00,000"), ("THRESHOLD", "₹ 2.5 crore"), ("THRESHOLD", "30 days"), ("SECTION", "Section 52"), ("SECTION", "para 3"), ("DATE", "12/03/2024"), ("DATE", "5 March 2023"), ("DATE", "FY 2023-24"), ("RATE", "5 %")]
    assert all(text[start:stop].strip() == t for _, _, t, start, stop in made)
    assert A.find_atoms(rows, "a", "t").where("answer IN (2, 3)").count() == 0


def test_merging_of_strata():
    sizes = {"RBI|RATE": 100, "SEBI|RATE": 10, "IRDAI|RATE": 30, "*|RATE": 35, "SEBI|DATE": 5}
    assert C.merge_targets(sizes, 50) == {"RBI|RATE": "RBI|RATE", "*|RATE": "*|*", "IRDAI|RATE": "*|RATE", "SEBI|RATE": "*|RATE", "SEBI|DATE": "*|*"}


def test_guards(spark):
    rows = spark.createDataFrame([(1, 0), (2, None)], "a int, label int")
    for part, least in ((rows, 1), (rows.where("a = 1"), 5)):
        with pytest.raises(ValueError):
            E.required(part, "label", least)
    assert E.required(rows.where("a = 1"), "label", 1).count() == 1


def test_dense_search_without_queries_or_of_mixed_lengths(spark):
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.1]), (3, [1.0]), (4, []), (5, None)], "vec_id long, embedding array<double>")
    assert R.dense_top_k(vectors, vectors.limit(0), 3).count() == 0
    assert [tuple(r)[:2] for r in R.dense_top_k(vectors, vectors.where("vec_id = 1"), 3).collect()] == [(1, 2)]


def test_made_wrong_claims_differ(spark):
    texts = {"RATE": ["at 5%", "at 0 per cent", "0.01 % p.a."], "THRESHOLD": ["₹ 5,00,000 lakh", "0 days", "2.50"], "SECTION": ["Section 1(2)", "master  directions 9", "article 52", "section"], "DATE": ["on 12/03/2024", "2024-02-29 on", "1-1-2020.", "99/99/2024"], "ENTITY": ["5"]}
    rows = spark.createDataFrame([(k, t, i) for k, ts in texts.items() for t in ts for i in range(40)] + [("RATE", None, 1), ("RATE", "", 2)], "kind string, t string, i int")
    made = rows.withColumn("w", E.perturbed(F.col("kind"), F.col("t"), F.col("i"))).collect()
    none = {"section", "99/99/2024", "5", "", None}
    assert all((r["w"] is None) == (r["t"] in none) and r["w"] != r["t"] or r["t"] is None for r in made)
    rates = {float(r["w"][3:-1]) for r in made if r["t"] == "at 5%"}
    assert min(rates) >= 2.5 and max(rates) <= 7.5 and all(abs(x - 5) >= 0.5 for x in rates) and len(rates) > 20
    assert {r["w"] for r in made if r["t"] == "article 52"} == {f"article {n}" for n in (50, 51, 53, 54)}
    assert all(r["w"].endswith(" lakh") and "," not in r["w"] for r in made if r["t"] == "₹ 5,00,000 lakh")


def gate_tables(spark, **other):
    tables = {
        "run": ([(200, 0.05, False, "abc", "x", True)], "n_atoms long, violation_rate double, simulated boolean, commit string, config string, model boolean"),
        "systems": ([("regguard", 0.1, 0.5, 0.2, 0.3), ("nli_only", 0.2, 0.4, 0.3, 0.1)], "system string, hallucination double, coverage double, aurc double, threshold double"),
        "ablation": ([("regguard", 0.1, 0.5, 0.2), ("-s_nli", 0.3, 0.3, 0.4)], "system string, hallucination double, coverage double, aurc double"),
        "seeds": ([("aurc", 5, 0.1, 0.2)], "metric string, seeds int, low double, high double"),
        "drift": ([("static", 0.3, 150, 150), ("triggered", 0.2, 150, 150)], "strategy string, threshold double, n_pre long, n_post long"),
        "leaks": ([], "unit long"),
        "found": ([(0.5,)], "recall double"),
        "extracted": ([(0.5,)], "recall double"),
    }
    return [spark.createDataFrame(other.get(name, rows), kind) for name, (rows, kind) in tables.items()]


@pytest.mark.parametrize("change, broken", [
    ({}, set()),
    ({"run": [(149, None, True, "unknown", "", False)]}, {"the run is no simulation", "the commit is recorded", "the configuration is recorded", "the risk model is there", "at least 150 atoms", "violation rate is at most 0.1"}),
    ({"run": [(150, float("nan"), False, "a", "x", True)], "leaks": [(1,), (2,)]}, {"violation rate is at most 0.1", "no unit is on several sides"}),
    ({"systems": [("regguard", 0.1, 0.5, 0.2, None), ("nli_only", None, 0.0, 0.2, 0.1)]}, {"areas of systems differ", "every system has a threshold", "every system accepts something"}),
    ({"ablation": [("regguard", 0.1, 0.6, None)]}, {"the full row is that of the systems"}),
    ({"seeds": [("aurc", 4, None, 0.2)], "drift": [("static", 0.2, 149, 10), ("triggered", 0.2, 149, 10)]}, {"at least 5 seeds", "every figure has an interval", "at least 150 rows before the change", "at least 150 rows after the change", "strategies choose different thresholds"}),
    ({"systems": [], "ablation": [], "seeds": [], "drift": [], "found": [], "extracted": [(None,)]}, {"the systems were compared", "areas of systems differ", "signals were dropped and fitted anew", "seeds were compared", "drift was measured", "retrieval was measured", "extraction was measured"}),
    ({"run": []}, {"a run is recorded", "the commit is recorded", "the configuration is recorded", "the risk model is there", "at least 150 atoms", "violation rate is at most 0.1"}),
])
def test_release_gate(spark, change, broken):
    made = E.release_gate(*gate_tables(spark, **change)).collect()
    assert {r["rule"] for r in made if not r["holds"]} == broken and len(made) == 23
    assert all(r["holds"] == (r["failing"] == 0) for r in made)


def test_values_are_read_for_the_kinds_asked(spark):
    """Patterns of kinds that no atom has cost nothing; statuses stay the same."""
    from verdara.functions import normalize as N
    from verdara.operators import verify as V

    atoms = spark.createDataFrame([(1, 1, "RATE", 5.0), (2, 1, "ENTITY", None), (3, 2, "RATE", 5.0), (4, 3, "RATE", 5.0), (5, 1, "COMPUTED", None), (6, 1, None, 1.0)], "atom int, question int, kind string, value double")
    evidence = spark.createDataFrame([(1, "5 per cent of Rs 4 lakh on 5 March 2023 under section 5"), (1, "7 %"), (2, "Rs 5 lakh"), (4, None)], "question int, text string")
    made = V.v1(atoms, evidence)
    assert {tuple(r) for r in made.collect()} == {(1, "MATCH"), (2, "NA"), (3, "NOT_FOUND"), (4, "NOT_FOUND"), (5, "NOT_FOUND"), (6, "NA")}
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "cent" in plan and "lakh" not in plan and "section" not in plan
    assert {r[0] for r in V.v1(atoms.where("kind = 'ENTITY'"), evidence).select("v1_status").collect()} == {"NA"}
    amount = N.amount(F.col("text"))
    assert str(amount).count("crores?") <= 2
    assert [r[0] for r in spark.createDataFrame([("Rs 4 lakh",), ("2.5 Crores",), ("7 days",), ("none",), (None,)], "text string").select(amount).collect()] == [4e5, 2.5e7, 7.0, None, None]


def test_word_chunks_read_a_page_once(spark):
    """Pages are cut once, though both the chunks and what is carried between pages need them."""
    read = spark.sparkContext.accumulator(0)

    def each(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    pages = spark.createDataFrame([(d, p, "Section 5\nword word") for d in range(5) for p in range(4)], "doc_id long, page_no int, text string")
    made = chunking.word_chunks(pages.mapInArrow(each, pages.schema), 100, 1)
    assert made.count() == 20 and read.value == 20
