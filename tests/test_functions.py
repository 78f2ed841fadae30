"""Golden cases of normal forms, text expressions and statistics."""

import datetime
import math

import pytest
from pyspark.sql import functions as F

from verdara.functions import normalize as N
from verdara.functions import text as T
from verdara.functions.stats import binomial_tail, erfc, upper_bound
from verdara.operators import decide as D
from verdara.operators import guarantee as G


def one(spark, expression, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expression(F.col("x"))).first()[0]


@pytest.mark.parametrize(
    "text, value",
    [("Rs 5 lakh", 5e5), ("Rs. 10 lakhs", 1e6), ("₹1.5 crore", 1.5e7), ("5,00,000", 5e5), ("Rs 50 thousand", 5e4), ("no amount here", None), ("Rs.5,00,000/-", 5e5), ("INR 500000", 5e5), ("5 lakh rupees", 5e5), ("`500000", 5e5), (None, None)],
)
def test_amount(spark, text, value):
    assert one(spark, N.amount, text) == value


@pytest.mark.parametrize("text, value", [("5%", 5), ("5 per cent", 5), ("7.5percent", 7.5), ("10% p.a.", 10), ("8 per cent per annum", 8), ("five rupees", None), ("0%", 0)])
def test_percent(spark, text, value):
    assert one(spark, N.percent, text) == value


@pytest.mark.parametrize("text, value", [("25 bps", 0.25), ("25 basis points", 0.25), ("100 bps", 1.0), ("25", None)])
def test_basis_points(spark, text, value):
    assert one(spark, N.basis_points, text) == value


@pytest.mark.parametrize(
    "text, value",
    [("12/03/2024", "2024-03-12"), ("01-04-2023", "2023-04-01"), ("5 Jan 2022", "2022-01-05"), ("FY 2023-24", "2023-04-01"), ("AY 2024-25", "2024-04-01"), ("1st day of April, 2026", "2026-04-01"), ("31.12.2023", "2023-12-31"), ("not a date", None), ("31/02/2024", None), ("2024-02-29", "2024-02-29")],
)
def test_date(spark, text, value):
    assert one(spark, N.date, text) == (datetime.date.fromisoformat(value) if value else None)


@pytest.mark.parametrize("text, value", [("Section 80C(2)", "section80c(2)"), ("Regulation 52(4)(a)", "regulation52(4)(a)"), ("nothing", None), ("under u/s 80C", "u/s80c"), ("Sec. 194-IA", "sec.194-ia"), ("Articles 14", "articles14"), ("para 3(b)", "para3(b)"), ("Schedule 2", "schedule2"), ("see the Circular 12", "circular12"), ("Master  Directions 7", "masterdirections7"), ("subsection 4", None), ("paragraphs 9A", "paragraphs9a"), ("", None), (None, None)])
def test_section(spark, text, value):
    assert one(spark, N.section, text) == value


@pytest.mark.parametrize("text, value", [("Sections 80C, 80D and 80G", ["80C", "80D", "80G"]), ("section 194-IA", ["194-IA"]), ("u/s 80C", ["80C"]), ("Section 10(1)", ["10(1)"]), ("Section 5 within 10 days", ["5"]), ("see articles 14 AND 19(1)(a), 21 for all", ["14", "19(1)(a)", "21"]), ("no reference, 5", []), (None, None)])
def test_section_list(spark, text, value):
    assert one(spark, N.section_list, text) == value


def test_tokens_keep_marks(spark):
    found = one(spark, T.tokens, "Under Regulation 52(4), the rate is 5.50%.")
    assert "52(4)" in found and "5.50%" in found


def test_text_expressions(spark):
    assert one(spark, T.without_page_numbers, "Page 3 of 9\nbody\n17") == "body"
    assert one(spark, T.sentences, "One. Two!\nThree") == ["One.", "Two!", "Three"]
    assert one(spark, T.citations, "a [RBI_1.2] b [x-y] [RBI_1.2]") == ["RBI_1.2", "x-y"]
    assert one(spark, T.claims, "x DISCRETE_CLAIMS:\n- one\n2. two\n") == ["one", "two"]
    assert one(spark, lambda c: T.clean(T.nfkc(c)), "regu-\nlation  at Rs. 5 in hours") == "regulation at ₹ 5 in hours"


def test_tails(spark):
    exact = sum(math.comb(120, j) * 0.05**j * 0.95 ** (120 - j) for j in range(4))
    row = spark.range(1).select(binomial_tail(F.lit(3), F.lit(120), F.lit(0.05)), binomial_tail(F.lit(0), F.lit(0), F.lit(0.05)), upper_bound(F.lit(0), F.lit(10), F.lit(0.05)), erfc(F.lit(1.0))).first()
    assert row[0] == pytest.approx(exact) and row[1] == 1 and row[2] == pytest.approx(1 - 0.05**0.1) and row[3] == pytest.approx(math.erfc(1))


def test_min_accepted():
    assert G.min_accepted(0.05, 0.10) == 45


def test_routing_is_total(spark):
    rows = spark.createDataFrame([(0.1, 0.2, 0.6), (0.4, 0.2, 0.6), (0.9, 0.2, 0.6), (0.1, None, 0.6), (float("nan"), 0.2, 0.6), (None, 0.2, 0.6)], "r double, a double, b double")
    assert [r[0] for r in rows.select(D.route(F.col("r"), F.col("a"), F.col("b"))).collect()] == ["ACCEPTED", "UNCERTAIN", "ABSTAINED", "ABSTAINED", "UNCERTAIN", "ABSTAINED"]


def test_fallback_risk_renormalises(spark):
    rows = spark.createDataFrame([(0.5, None, None, 1.0, None, None), (None,) * 6], "s_ver double, s_nli double, s_ent double, s_ret double, s_div double, s_mech double")
    made = [r[0] for r in rows.select(D.fallback_risk()).collect()]
    assert made[0] == pytest.approx(0.30 * 0.5 / 0.40) and made[1] is None


def test_ambiguity_of_versions(spark):
    from verdara.operators import temporal

    rows = spark.createDataFrame([("2020-01-01", None), (None, "2020-01-01"), ("2020-01-01", "2020-03-01"), ("2020-01-01", "2022-01-01"), ("2020-01-01", "2020-01-01"), (None, None)], "a string, b string")
    made = [r[0] for r in rows.select(temporal.ambiguity(F.col("a").cast("date"), F.col("b").cast("date"))).collect()]
    assert made == [0, 0.5, 1, pytest.approx(365 / 731), 1, 0]


ATOM_CASES = [
    ("a rate of 7.25% applies", [("RATE", "7.25%")]),
    ("interest at 9 per cent per annum", [("RATE", "9 per cent per annum")]),
    ("12percent p.a. on arrears", [("RATE", "12percent p.a.")]),
    ("up by 5 percentage points", [("RATE", "5 percent")]),
    ("a ratio of 3 : 1.5 holds", [("RATE", "3 : 1.5")]),
    ("version 1.2.3% odd", [("RATE", "2.3%")]),
    ("fees of ₹ 1,25,000.50 are due", [("THRESHOLD", "₹ 1,25,000.50")]),
    ("capital of ₹500 crore", [("THRESHOLD", "₹500 crore")]),
    ("net worth ₹ 2 cr. or more", [("THRESHOLD", "₹ 2 cr.")]),
    ("₹ 2 crew members", [("THRESHOLD", "₹ 2")]),
    ("within 45 days or 6 months", [("THRESHOLD", "45 days"), ("THRESHOLD", "6 months")]),
    ("after 1.5 years", [("THRESHOLD", "5 years")]),
    ("12 daytime hours", []),
    ("see Section 11(2)(b) now", [("SECTION", "Section 11")]),
    ("Regulation 52/A-1", [("SECTION", "Regulation 52/A")]),
    ("Master  Direction 7 and circular 2023/14", [("SECTION", "Master  Direction 7"), ("SECTION", "circular 2023/14")]),
    ("subsection 4, section 4A", []),
    ("on 1-4-24 and 15/08/2023", [("DATE", "1-4-24"), ("DATE", "15/08/2023")]),
    ("by 31 March 2025 or 3 Sep 2024", [("DATE", "31 March 2025"), ("DATE", "3 Sep 2024")]),
    ("in FY 2023–24", [("DATE", "FY 2023–24")]),
    ("31 Marching 2025 and 115/08/2023", []),
    ("é12/03/2024 and 𝄞 9% hold", [("RATE", "9%")]),
]


def test_atoms_of_varied_sentences(spark):
    from verdara.operators import answers

    rows = spark.createDataFrame([(i, text) for i, (text, _) in enumerate(ATOM_CASES)], "a long, t string")
    made = answers.find_atoms(rows, "a", "t").orderBy("answer", "start").collect()
    for i, (text, expected) in enumerate(ATOM_CASES):
        found = [(r["kind"], r["text"]) for r in made if r["answer"] == i]
        assert found == expected, text
        assert all(text[r["start"] : r["stop"]] == r["text"] for r in made if r["answer"] == i)


HEADING_CASES = {
    "Chapter IV": "chapter", "PART 2 - Scope": "chapter", "part ii.": "chapter", "  chapter\t12: Duties": "chapter", "Part of it": None, "Chapter": None, "chapter 3A": None, "chapter mix": "chapter", "chapter mixed": None,
    "Partial 3": None, "chapter mdc": "chapter", "Section 5": "section", "REGULATION 52(4) Disclosure": "section", "paragraph 3.": "section", "section five": None, "Section": None, "3 Scope": "section",
    "3.2.1 scope of it": "section", "3.2": None, "3. (a)": None, "3) scope": None, "see section 4": None, "": None, "1.. of": "section", "-3 scope": None,
}


def test_headings_of_varied_lines(spark):
    rows = spark.createDataFrame([(t, k) for t, k in HEADING_CASES.items()], "line string, kind string")
    made = rows.select("line", "kind", F.when(T.is_chapter(F.col("line")), "chapter").when(T.is_section(F.col("line")), "section").alias("found")).collect()
    assert [(r["line"], r["found"]) for r in made] == [(r["line"], r["kind"]) for r in made]


METADATA_CASES = [
    ("Circular dated 12/03/2024.", ("2024-03-12", None, [], [])),
    ("Dated : 5 March 2023, effective from 1-4-2023", ("2023-03-05", "2023-04-01", [], [])),
    ("Date of issue 31 Dec 2022; w.e.f. 01/01/23", ("2022-12-31", "2023-01-01", [], [])),
    ("issued on Monday, dated 7/8/2021", ("2021-08-07", None, [], [])),
    ("with effect from: 30 June 2020 (revised)", (None, "2020-06-30", [], [])),
    ("W.E.F 2 Feb 2019", (None, "2019-02-02", [], [])),
    ("dated 2024-03-12", (None, None, [], [])),
    ("undated", (None, None, [], [])),
    ("dated", (None, None, [], [])),
    ("dated 99/99/2024 then dated 1/2/2024", ("2024-02-01", None, [], [])),
    ("supersedes circular RBI/12.", (None, None, ["RBI/12"], [])),
    ("in supersession of the Master Directions DNBR-5/2016, and", (None, None, ["DNBR-5/2016"], [])),
    ("In  supersession\nof guidelines A.1 it supersedes the direction B-2", (None, None, ["A.1", "B-2"], [])),
    ("supersedes all earlier circulars", (None, None, [], [])),
    ("supersedes circular", (None, None, [], [])),
    ("amends the circular SEBI/HO/1", (None, None, [], ["SEBI/HO/1"])),
    ("amends master guideline G7; amends circulars C8.", (None, None, [], ["G7", "C8"])),
    ("amends it", (None, None, [], [])),
    ("", (None, None, [], [])),
    (None, (None, None, None, None)),
    ("The circular dated 3-Jan-2020", (None, None, [], [])),
]


def test_metadata_of_varied_texts(spark):
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(METADATA_CASES)], "i int, t string")
    made = {r["i"]: r["m"] for r in rows.select("i", T.document_metadata(F.col("t")).alias("m")).collect()}
    for i, (text, expected) in enumerate(METADATA_CASES):
        m = made[i]
        assert (m["issue_date"] and str(m["issue_date"]), m["effective_date"] and str(m["effective_date"]), m["supersedes"], m["amends"]) == expected, text


def test_sections_equal(spark):
    rows = spark.createDataFrame([("Section 80 C", "section80C", True), ("section 5", "rule 5", False), (None, "section 5", None)], "a string, b string, e boolean")
    assert all(r["m"] == r["e"] for r in rows.select("e", N.sections_equal(F.col("a"), F.col("b")).alias("m")).collect())


def test_badges(spark):
    rows = spark.createDataFrame([(-1.0, "LOW"), (0.25, "LOW"), (0.2501, "MEDIUM"), (0.6, "MEDIUM"), (0.61, "HIGH"), (3.0, "HIGH")], "r double, b string")
    assert all(x["m"] == x["b"] for x in rows.select("b", D.badge(F.col("r")).alias("m")).collect())
    names = spark.createDataFrame([(" verified ",), ("ABSTAINED",), ("odd",), (None,)], "s string")
    assert [tuple(x["m"]) for x in names.select(D.status_badge(F.col("s")).alias("m")).collect()] == [("VERIFIED", "✅"), ("ABSTAINED", "🚫"), ("ODD", "ℹ️"), ("", "ℹ️")]
    assert [tuple(x["m"]) for x in names.select(D.answer_badge(F.col("s")).alias("m")).collect()][1:] == [("Cannot Be Verified", "🚫"), ("odd", "ℹ️"), (None, "ℹ️")]


@pytest.mark.parametrize("p, q, start, stop, cosine, expected", [
    ([-1.0, -0.5, -2.0], [-2.0, -1.0, -3.0], 4, 8, 0.3, math.exp(-0.5) * 0.5 / 5),
    ([-1.0, -0.5, -2.0], [-2.0, -1.0, -3.0], 0, 2, 0.3, math.exp(-1) / 5),
    ([-1.0, -0.5], [-2.0], 4, 8, 0.3, 0.7),
    ([-1.0], [-2.0], 40, 48, 0.25, 0.75),
    ([-2.0], [-1.0], 0, 4, 0.25, 0.0),
    ([-1.0], [-1000.0], 0, 4, 0.25, 0.0),
    ([-1.0], [-2.0], None, None, 0.12341, 0.8766),
    (None, [-2.0], 0, 4, None, None),
])
def test_chosen_divergence(spark, p, q, start, stop, cosine, expected):
    rows = spark.createDataFrame([(p, q, start, stop, cosine)], "p array<double>, q array<double>, a int, b int, c double")
    made = rows.select(D.chosen_divergence(*map(F.col, "pqabc"))).first()[0]
    assert made == (expected if expected is None else pytest.approx(expected, abs=1e-4))
