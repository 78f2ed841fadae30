"""Text expressions: tokens, lines, sentences, claims, citations. All run in the JVM except NFKC."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from verdara.functions.normalize import PERCENT, date
from verdara.functions.normalize import SECTION as SECTION_REFERENCE

# Fixed patterns of the corpus conventions.
TOKEN = r"[a-z0-9\-\.\/\%\(\)]+"
WORD_TOKEN = r"\b[A-Za-z0-9\-\.\/\%]+\b"
PAGE_NUMBER = r"(?i)^(page\s+\d+(\s+of\s+\d+)?|\d+)$"
DAY = r"(?:[0-9]{1,2}[-/][0-9]{1,2}[-/][0-9]{2,4}|[0-9]{1,2}\s+[A-Za-z]{3,9}\s+[0-9]{4})"
CITATION = r"\[([A-Za-z0-9_\.\-]+)\]"


def tokens(text: Column) -> Column:
    """Lower-cased tokens that keep section marks and percentages, without closing punctuation, longer than one character."""
    found = F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))
    return F.filter(F.transform(found, lambda t: F.rtrim(t, F.lit("."))), lambda t: F.length(t) > 1)


def word_tokens(text: Column) -> Column:
    """Tokens between word boundaries, longer than one character, lower-cased."""
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit(WORD_TOKEN), F.lit(0)), lambda t: F.length(t) > 1)


def lines(text: Column) -> Column:
    return F.split(text, "\n")


def without_page_numbers(text: Column) -> Column:
    """Text without the lines that hold only a page number."""
    return F.array_join(F.filter(lines(text), lambda s: ~F.trim(s).rlike(PAGE_NUMBER)), "\n")


def clean(text: Column) -> Column:
    """Joined hyphenations, one rupee sign, single blanks, trimmed. Apply ``nfkc`` before where the source needs it."""
    text = F.regexp_replace(text, r"([A-Za-z])-\n([a-z])", "$1$2")
    text = F.regexp_replace(text, r"(?i)\b(rs\.?|inr)\s*(?=[0-9])", "₹ ")
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"[ \t]+", " "), r"\n{3,}", "\n\n"))


@F.pandas_udf(StringType())
def nfkc(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for part in parts:
        yield part.str.normalize("NFKC")


# Fixed words that open a heading.
CHAPTER_WORDS = ("part", "chapter")
SECTION_WORDS = ("section", "regulation", "paragraph")


def _first_words(line: Column) -> tuple[Column, Column]:
    words = F.split(F.regexp_replace(F.lower(line), r"^\s+", ""), r"\s+", 3)
    return words[0], F.coalesce(F.get(words, F.lit(1)), F.lit(""))


def is_chapter(line: Column, whole: bool = True) -> Column:
    """A chapter's word, then an arabic or roman number; not ``whole``: then a word that begins like one."""
    first, second = _first_words(line)
    if not whole:
        return first.isin(*CHAPTER_WORDS) & (second != "") & (F.instr(F.lit("0123456789ivxlcdm"), second.substr(1, 1)) > 0)
    number = F.regexp_extract(second, r"^\w*", 0)
    return first.isin(*CHAPTER_WORDS) & (number != "") & ((F.translate(number, "0123456789", "") == "") | (F.translate(number, "ivxlcdm", "") == ""))


def is_section(line: Column, opening: tuple[str, ...] = SECTION_WORDS) -> Column:
    """A section's word before a number, or a dotted number before a word."""
    first, second = _first_words(line)
    numbered = first.substr(1, 1).between("0", "9") & (F.translate(first, "0123456789.", "") == "")
    return (first.isin(*opening) & second.substr(1, 1).between("0", "9")) | (numbered & second.substr(1, 1).between("a", "z"))


def is_heading(line: Column) -> Column:
    return is_chapter(line) | is_section(line)


def sentences(text: Column) -> Column:
    """Sentences with their closing mark, blanks around them dropped, empty ones too."""
    return F.filter(F.transform(F.split(text, r"(?<=[.!?])\s+|\n+"), lambda s: F.trim(s)), lambda s: s != "")


def claims(text: Column, most: int = 5, longer_than: int = 15) -> Column:
    """Listed claims after ``DISCRETE_CLAIMS:``, else the first sentences of some length."""
    listed = F.transform(F.split(F.split(text, "DISCRETE_CLAIMS:").getItem(1), "\n"), lambda s: F.trim(F.regexp_replace(s, r"^\s*([-*•]|\d+[.)])\s*", "")))
    plain = F.slice(F.filter(F.transform(F.split(text, r"[.!?]\s+"), lambda s: F.trim(s)), lambda s: F.length(s) > longer_than), 1, most)
    return F.when(text.contains("DISCRETE_CLAIMS:"), F.filter(listed, lambda s: s != "")).otherwise(plain)


def citations(text: Column) -> Column:
    """Distinct cited chunk ids, sorted."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(CITATION), F.lit(1))))


def first_words(text: Column, n: int) -> Column:
    return F.array_join(F.slice(F.split(F.trim(F.regexp_replace(text, r"\s+", " ")), " "), 1, n), " ")


# Fixed words before the dates and documents that a text names.
ISSUED = ("dated", "date of issue", "issued on")
EFFECTIVE = ("effective from", "with effect from", "w.e.f.", "w.e.f")
SUPERSEDING = ("in supersession of", "supersedes")
AMENDING = ("amends",)
KINDS_OF_DOCUMENT = ("circular", "circulars", "direction", "directions", "guideline", "guidelines")


def _after(text: Column, cues: tuple[str, ...]) -> Column:
    """What follows each occurrence of a cue, up to the next one, with single blanks."""
    pieces = F.split(F.regexp_replace(text, r"\s+", " "), "(?i)" + "|".join(map(re.escape, cues)))
    return F.slice(pieces, 2, 1 << 30)


def _leading_date(part: Column) -> Column:
    """The date that a text begins with, as one word (12/03/2024) or three (12 March 2024); NULL if there is none."""
    words = F.split(F.regexp_replace(part, r"^[\s:]+", ""), " ", 4)
    word = lambda i: F.regexp_replace(F.coalesce(F.get(words, F.lit(i)), F.lit("")), r"[^A-Za-z0-9]+$", "")
    whole = F.size(F.split(word(0), "[-/]")) == 3
    text = F.when(whole, word(0)).otherwise(F.concat_ws(" ", word(0), F.get(words, F.lit(1)), word(2)))
    return F.when(text.rlike("^[0-9]{1,2}[^0-9,]"), date(text))


def _leading_document(part: Column) -> Column:
    """The identifier after an optional article, an optional "master" and the kind of a document; NULL if there is none."""
    words = F.filter(F.split(part, " "), lambda w: w != "")
    opens = lambda rest, word: F.lower(F.coalesce(F.get(rest, F.lit(0)), F.lit(""))) == word
    for word in ("the", "master"):
        words = F.when(opens(words, word), F.slice(words, 2, 1 << 30)).otherwise(words)
    name = F.regexp_extract(F.coalesce(F.get(words, F.lit(1)), F.lit("")), r"^[A-Za-z0-9./-]+", 0)
    return F.when(F.lower(F.coalesce(F.get(words, F.lit(0)), F.lit(""))).isin(*KINDS_OF_DOCUMENT), F.nullif(F.rtrim(name, F.lit(".")), F.lit("")))


def document_metadata(text: Column) -> Column:
    """Issue date, effective date, and the documents that a text supersedes or amends.

    Each is read from the words right after a cue; of several dates the first counts. NULL or empty lists where none is named.
    """
    day = lambda cues: F.get(F.filter(F.transform(_after(text, cues), _leading_date), lambda d: d.isNotNull()), F.lit(0))
    named = lambda cues: F.filter(F.transform(_after(text, cues), _leading_document), lambda d: d.isNotNull())
    return F.struct(day(ISSUED).alias("issue_date"), day(EFFECTIVE).alias("effective_date"), named(SUPERSEDING).alias("supersedes"), named(AMENDING).alias("amends"))


def question_hints(text: Column) -> Column:
    """First percentage, section and date of a text, and its topic: the first six words of its first 300 characters."""
    first = lambda form: F.nullif(F.regexp_extract(text, form, 0), F.lit(""))
    return F.struct(first(PERCENT).alias("percent"), first(SECTION_REFERENCE).alias("section"), first(DAY).alias("day"), first_words(F.substring(F.trim(F.regexp_replace(text, r"\s+", " ")), 1, 300), 6).alias("topic"))


def citation(title: Column, year: Column, section: Column) -> Column:
    return F.format_string("[%s (%s), %s]", title, year.cast("string"), F.coalesce(section, F.lit("General")))


def not_in_evidence(text: Column) -> Column:
    """The answer says that the evidence does not hold it."""
    return F.lower(text).contains("not found in evidence")


def extractive_answer(chunks: Column, sentences_each: int = 2, longer_than: int = 20, most: int = 4) -> Column:
    """Answer out of the first three chunks: their first sentences of some length, without breadcrumb lines."""

    def best(chunk: Column) -> Column:
        body = F.array_join(F.filter(lines(chunk), lambda s: ~s.contains(" > ")), " ")
        return F.slice(F.filter(sentences(body), lambda s: F.length(s) > longer_than), 1, sentences_each)

    return F.array_join(F.slice(F.flatten(F.transform(F.slice(chunks, 1, 3), best)), 1, most), " ")
