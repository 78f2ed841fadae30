"""Answer texts: typed atoms, comparison words, judge replies, labels and rewriting."""

from __future__ import annotations

import calendar

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed words for each comparison.
COMPARISONS = {
    "eq": ("eq", "=", "equal", "equals", "is"),
    "lt": ("lt", "<", "less than", "below"),
    "lte": ("lte", "<=", "at most", "not more than"),
    "gt": ("gt", ">", "greater than", "more than"),
    "gte": ("gte", ">=", "at least", "minimum"),
    "up_to": ("up to", "upto", "up_to"),
    "exceeding": ("exceeding", "above", "over"),
    "between": ("between",),
    "approximately": ("approximately", "around", "about"),
}
# Words that atoms are made of, each with the letter it has in a text's shape.
SHAPE_WORDS = {
    "percent": "R",
    "per": "E",
    "cent": "C",
    "annum": "N",
    "p": "P",
    "a": "A",
    "lakh": "U",
    "crore": "U",
    "thousand": "U",
    "cr": "V",
    "day": "T",
    "days": "T",
    "week": "T",
    "weeks": "T",
    "month": "T",
    "months": "T",
    "year": "T",
    "years": "T",
    "section": "S",
    "regulation": "S",
    "rule": "S",
    "clause": "S",
    "article": "S",
    "schedule": "S",
    "para": "S",
    "paragraph": "S",
    "circular": "S",
    "master": "G",
    "direction": "D",
    "fy": "F",
} | {name.lower(): "M" for name in [*calendar.month_name, *calendar.month_abbr] if name}
SHAPE_MARKS = "%.:,₹/()-–"


def atom_shapes() -> dict[str, str]:
    """What each kind looks like in a shape (see ``shape``); of overlapping finds the earlier kind stays."""
    decimal = r"\d(?:\.\d)?"
    return {
        "RATE": rf"{decimal} ?(?:(?:%|R|E ?C)(?: ?(?:P\.A\.|E ?N))?|: ?{decimal})",
        "THRESHOLD": rf"₹ ?(?:\d?,)*{decimal}(?: ?(?:U|V\.?)(?!\w))?|\b\d ?T\b",
        "SECTION": r"\b(?:S|G ?D) ?\d(?:/\w+|\(\w+\))*\b",
        "DATE": r"\b(?:[12] M 4|[12][/-][12][/-][24]|F ?4[–-][234])\b",
    }


def lexed(text: Column) -> Column:
    """A text as runs of digits, of letters, of white space, and single marks; joined they give the text.
    "percentage" and "centum" are cut after the word that they begin with."""
    return F.regexp_extract_all(text, F.lit(r"(?is)[0-9]+|percent|cent|[\p{L}_]+|\s+|."), F.lit(0))


def shape(tokens: Column) -> Column:
    """One character a token: how many digits (5: five or more), a known word's letter, ``x`` for other words, one blank
    for white space, a known mark itself, ``~`` for others. So a word boundary of the text is one of the shape."""
    words = F.create_map(*(F.lit(x) for pair in SHAPE_WORDS.items() for x in pair))

    def letter(t: Column) -> Column:
        number = F.least(F.length(t), F.lit(5)).cast("string")
        mark = F.when(F.instr(F.lit(SHAPE_MARKS), t) > 0, t).otherwise("~")
        return F.when(t.rlike("^[0-9]"), number).when(t.rlike(r"^[\p{L}_]"), F.coalesce(words[F.lower(t)], F.lit("x"))).when(t.rlike(r"^\s"), " ").otherwise(mark)

    return F.array_join(F.transform(tokens, letter), "")


KAPPA_BANDS = ((0.0, "poor (below chance)"), (0.20, "slight"), (0.40, "fair"), (0.60, "moderate"), (0.80, "substantial"))


def comparison(words: Column) -> Column:
    text, out = F.lower(F.trim(words)), F.lit("unknown")
    for name, forms in COMPARISONS.items():
        out = F.when(text.isin(*forms), name).otherwise(out)
    return out


#: Marks around finds in a shape, and what covers a find for later kinds.
OPEN, CLOSE, COVER = "<", ">", "#"


def find_atoms(answers: DataFrame, answer: str, text: str) -> DataFrame:
    """``answer, kind, text, start, stop`` of every typed atom of a text; offsets in code points.

    A text becomes tokens and their shape, one character a token. Each kind's finds are marked in the shape,
    which then falls into plain and found pieces; a piece's length counts tokens, whose lengths give the offsets.
    What a kind has found is covered before the next kind looks. Null and empty texts have no atoms.
    """
    rows = answers.select(F.col(answer).cast("long").alias("answer"), lexed(F.col(text).cast("string")).alias("_tokens"))
    rows = rows.withColumn("_left", shape(F.col("_tokens")))
    for kind, form in atom_shapes().items():
        pieces = F.split(F.regexp_replace("_left", form, f"{OPEN}$0{CLOSE}"), f"[{OPEN}{CLOSE}]")
        rows = rows.withColumn(f"_{kind}", pieces).withColumn("_left", F.array_join(F.transform(f"_{kind}", lambda p, i: F.when(i % 2 == 1, F.repeat(F.lit(COVER), F.length(p))).otherwise(p)), ""))

    def finds(kind: str) -> Column:
        """Every second piece is a find; the tokens before it are those of the pieces before it."""
        before = lambda i: F.length(F.array_join(F.slice(F.col(f"_{kind}"), F.lit(1), i), ""))
        placed = F.transform(f"_{kind}", lambda p, i: F.struct(F.lit(kind).alias("kind"), before(i).alias("first"), F.length(p).alias("n"), (i % 2 == 1).alias("hit")))
        return F.filter(placed, lambda x: x["hit"])

    joined = lambda first, n: F.array_join(F.slice(F.col("_tokens"), first, n), "")
    found = rows.select("answer", "_tokens", F.explode(F.concat(*map(finds, atom_shapes()))).alias("a"))
    found = found.select("answer", "a.kind", joined(F.col("a.first") + 1, F.col("a.n")).alias("text"), F.length(joined(F.lit(1), F.col("a.first"))).alias("start"))
    return found.withColumn("stop", F.col("start") + F.length("text"))


def find_span(text: Column, part: Column) -> Column:
    """Start and stop of the first occurrence, NULL if there is none."""
    at = F.nullif(F.instr(text, part), F.lit(0)) - 1
    return F.when((part != "") & at.isNotNull(), F.struct(at.alias("start"), (at + F.length(part)).alias("stop")))


def lenient_atoms(raw: Column) -> Column:
    """Atoms of a model's reply: fences and words around the JSON are dropped; a list, or an object with ``atoms`` or ``items``."""
    kind = "array<struct<type:string,text:string>>"
    listed = F.regexp_extract(raw, r"(?s)(\[.*\])", 1)
    held = F.from_json(F.regexp_extract(raw, r"(?s)(\{.*\})", 1), f"atoms {kind}, items {kind}")
    found = F.coalesce(held["atoms"], held["items"], F.from_json(listed, kind))
    good = F.filter(found, lambda a: a["type"].isNotNull() & (F.trim(F.coalesce(a["text"], F.lit(""))) != ""))
    return F.coalesce(F.transform(good, lambda a: F.struct(F.upper(F.trim(a["type"])).alias("type"), F.trim(a["text"]).alias("text"))), F.array().cast(kind))


def valid_atoms(atoms: DataFrame, known: tuple[str, ...], order: str) -> DataFrame:
    """Atoms of a known type with a text; of equal type and text in an answer the first by ``order``."""
    good = atoms.where(F.col("type").isin(*known) & (F.trim("text") != ""))
    rest = [c for c in atoms.columns if c not in ("answer", "type", "text")]
    return good.groupBy("answer", "type", "text").agg(F.min_by(F.struct(*rest), order).alias("_first")).select("answer", "type", "text", "_first.*")


def merged_atoms(model: DataFrame, forms: DataFrame) -> DataFrame:
    """Atoms of the model, and those found by form whose text the model does not have; both ``answer, type, text, start``."""
    return model.unionByName(forms.join(model.select("answer", "text").distinct(), ["answer", "text"], "left_anti"))


def computed_note(formula: Column, constants: Column, result: Column) -> Column:
    """What is told of a computed atom: its formula, its constants by name, its result."""
    parts = F.array_join(F.transform(F.array_sort(F.map_entries(constants)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ", ")
    return F.concat_ws("; ", F.concat(F.lit("formula: "), formula), F.concat(F.lit("constants: "), F.nullif(parts, F.lit(""))), F.concat(F.lit("result: "), result))


# Fixed notes before and instead of an answer.
NOTES = {
    "REJECTED": "⚠ Note: This answer contains claims that were rejected.",
    "OUTDATED": "⚠ Note: This answer may reference superseded regulatory text.",
    "PARTIAL": "⚠ Note: This answer contains claims that could not be fully verified.",
    "ABSTAIN": "⚠ This answer could not be verified.",
    "STUB": "This answer cannot be provided.",
}
BAD = ("ABSTAINED", "NOT_VERIFIED", "UNCERTAIN", "REJECTED", "OUTDATED")


def rewrite(text: Column, parts: Column, atoms: Column, status: Column, mode: str) -> Column:
    """Text, mode and note of an answer by its atoms (structs of text and status); ``parts`` are its sentences.

    Rejected atoms decide on the note before outdated ones; an answer whose atoms are all bad is
    replaced; a trimmed answer without a sentence left is replaced too.
    """
    bad = F.filter(atoms, lambda a: a["status"].isin(*BAD))
    has = lambda s: F.exists(bad, lambda a: a["status"] == s)
    note = F.when(has("REJECTED"), NOTES["REJECTED"]).when(has("OUTDATED"), NOTES["OUTDATED"]).otherwise(NOTES["PARTIAL"])
    made = lambda body, how, said: F.struct(body.alias("text"), F.lit(how).alias("mode"), said.alias("note"))
    noted = lambda body, said: F.concat(said, F.lit("\n\n"), body)
    stub, abstain = F.lit(NOTES["STUB"]), F.lit(NOTES["ABSTAIN"])
    if mode == "flag":
        out = made(noted(flagged(text, bad), note), "flag", note)
    elif mode == "trim":
        left = trimmed(parts, bad)
        out = F.when(F.trim(left) == "", made(noted(stub, note), "stub", note)).otherwise(made(noted(left, note), "trim", note))
    elif mode == "stub_on_abstain":
        out = made(noted(stub, abstain), "stub", abstain)
    else:
        out = made(noted(text, note), "none", note)
    all_bad = (F.size(bad) > 0) & (F.size(bad) == F.size(atoms))
    return F.when(status == "FULLY_SUPPORTED", made(text, "none", F.lit(""))).when((status == "ABSTAINED") | all_bad, made(stub, "stub", abstain)).otherwise(out)


def judge_reply(raw: Column) -> Column:
    """Verdict, rationale and quote of a reply that may be fenced; NULL without a valid verdict."""
    body = F.regexp_extract(raw, r"(?s)(\{.*\})", 1)
    found = F.from_json(body, "verdict string, rationale string, evidence_quote string")
    verdict = F.upper(F.trim(found["verdict"]))
    return F.when(verdict.isin("VERIFIED", "NOT_VERIFIED"), F.struct(verdict.alias("verdict"), F.trim(F.coalesce(found["rationale"], F.lit(""))).alias("rationale"), F.trim(F.coalesce(found["evidence_quote"], F.lit("none"))).alias("quote")))


def prelabel(status: Column, entailed: Column, risk: Column, reject: float = 0.7, support: float = 0.3) -> Column:
    sure = risk <= support
    return F.when((status == "MISMATCH") | (risk >= reject), "unsupported").when(sure & ((status == "MATCH") | (entailed >= 0.9)), "supported").otherwise("uncertain")


def kappa_band(kappa: Column) -> Column:
    out = F.lit("almost perfect")
    for limit, name in reversed(KAPPA_BANDS):
        out = F.when(kappa < limit, name).otherwise(out)
    return out


def within_budget(atoms: DataFrame, by: str, order: str, most: int = 20) -> DataFrame:
    """Marks the first ``most`` atoms of each question; the rest is not sent to a judge."""
    from pyspark.sql import Window

    return atoms.withColumn("judged", F.row_number().over(Window.partitionBy(by).orderBy(order)) <= most)


def judged_rows(atoms: DataFrame, replies: DataFrame, by: str, order: str, most: int = 20) -> DataFrame:
    """``atom, verdict, rationale, quote, called`` of uncertain atoms from ``replies(atom, raw)``: one row an atom.

    Beyond the first ``most`` of a question (by ``order``) no call is made; such atoms, and those whose reply is missing or holds no
    verdict, are NOT_VERIFIED. Of several replies of an atom the least by text counts.
    """
    first = replies.groupBy("atom").agg(F.min("raw").alias("raw"))
    rows = within_budget(atoms, by, order, most).join(first, "atom", "left").withColumn("_j", F.when(F.col("judged"), judge_reply(F.col("raw"))))
    why = F.when(~F.col("judged"), "the question's calls are used up").when(F.col("raw").isNull(), "no reply").otherwise("no verdict in the reply")
    return rows.select("atom", F.coalesce("_j.verdict", F.lit("NOT_VERIFIED")).alias("verdict"), F.coalesce("_j.rationale", why).alias("rationale"), F.coalesce("_j.quote", F.lit("none")).alias("quote"), F.col("judged").alias("called"))


def in_text_order(atoms: Column) -> Column:
    """Atoms (structs with ``start``) by their place in the text; those without one last, each group as it was."""
    placed = F.transform(atoms, lambda a, i: F.struct(a["start"].isNull().alias("open"), F.coalesce(a["start"].cast("long"), F.lit(0).cast("long")).alias("start"), i.alias("i"), a.alias("a")))
    before = lambda x, y, *keys: F.when(x[keys[0]] < y[keys[0]], -1).when(x[keys[0]] > y[keys[0]], 1).otherwise(before(x, y, *keys[1:]) if keys[1:] else 0)
    return F.transform(F.array_sort(placed, lambda x, y: before(x, y, "open", "start", "i")), lambda x: x["a"])


def flagged(text: Column, atoms: Column) -> Column:
    """Text with the first occurrence of each bad atom marked, longest first; atoms are structs of text and status."""
    ordered = F.array_sort(atoms, lambda a, b: F.when(F.length(a["text"]) != F.length(b["text"]), F.length(b["text"]) - F.length(a["text"])).when(a["text"] < b["text"], -1).when(a["text"] > b["text"], 1).otherwise(0))

    def mark(done: Column, atom: Column) -> Column:
        tag = F.when(atom["status"].isin("OUTDATED", "REJECTED"), atom["status"]).otherwise("⚠ UNVERIFIED")
        at = F.instr(done, atom["text"])
        marked = F.concat(F.substring(done, F.lit(1), at - 1), F.lit("["), tag, F.lit(": "), atom["text"], F.lit("]"), F.substring(done, at + F.length(atom["text"]), F.length(done)))
        return F.when((at > 0) & (atom["text"] != ""), marked).otherwise(done)

    return F.aggregate(ordered, text, mark)


def trimmed(sentences: Column, atoms: Column) -> Column:
    """Sentences without a bad atom, joined by a blank."""
    return F.array_join(F.filter(sentences, lambda s: ~F.exists(atoms, lambda a: s.contains(a["text"]))), " ")
