"""Normal forms of amounts, percentages, dates and section references, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed units of Indian financial text.
UNITS = {"thousand": 1e3, "thousands": 1e3, "lakh": 1e5, "lakhs": 1e5, "lac": 1e5, "lacs": 1e5, "million": 1e6, "millions": 1e6, "crore": 1e7, "crores": 1e7, "cr": 1e7, "billion": 1e9, "billions": 1e9}
AMOUNT = r"([0-9][0-9,]*(?:\.[0-9]+)?)\s*(thousands?|lakhs?|lacs?|millions?|crores?|cr|billions?)?\b"
PERCENT = r"(?i)([0-9]+(?:\.[0-9]+)?)\s*(?:%|per\s*cent|percent)"
BASIS = r"(?i)([0-9]+(?:\.[0-9]+)?)\s*(?:bps|basis\s+points?)\b"
# Fixed words before a section's number; each but the abbreviations may stand in the plural.
SECTION_WORDS = ("section", "regulation", "clause", "rule", "article", "para", "paragraph", "schedule", "circular", "master direction")
SECTION_SHORT = ("sec.", "u/s")
SECTION_NUMBER = r"[0-9]+[A-Za-z]*(?:-[A-Za-z0-9]+)?(?:\([0-9A-Za-z]+\))*"
SECTION = rf"(?i)\b(?:{'|'.join(w.replace(' ', r'\s+') + 's?' for w in SECTION_WORDS)}|{'|'.join(w.replace('.', r'\.') for w in SECTION_SHORT)})\s+{SECTION_NUMBER}"


def _number(text: Column) -> Column:
    return F.regexp_replace(text, ",", "").try_cast("double")


def amount(text: Column) -> Column:
    """Rupees; a number without a unit counts as it is; NULL without a number."""
    flat = F.lower(F.regexp_replace(F.regexp_replace(text, "`", "₹"), r"/-", ""))
    # A map is looked up once; a chain of comparisons would match the pattern once for every unit.
    units = F.create_map(*(F.lit(x) for pair in UNITS.items() for x in pair))
    scale = F.coalesce(F.try_element_at(units, F.regexp_extract(flat, AMOUNT, 2)), F.lit(1.0))
    return _number(F.nullif(F.regexp_extract(flat, AMOUNT, 1), F.lit(""))) * scale


def percent(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, PERCENT, 1), F.lit("")).try_cast("double")


def basis_points(text: Column) -> Column:
    """In per cent."""
    return F.nullif(F.regexp_extract(text, BASIS, 1), F.lit("")).try_cast("double") / 100


def is_basis_points(text: Column) -> Column:
    return text.rlike(BASIS)


def date(text: Column) -> Column:
    """ISO, ordinal, month-name, dotted, slashed (day first, then swapped) and financial or assessment year dates."""
    t = F.trim(text)
    plain = F.regexp_replace(F.regexp_replace(t, r"(?i)(\d)(st|nd|rd|th)\b", "$1"), r"(?i)\s+day\s+of|,", "")
    day_first = F.regexp_replace(t, r"[.\-]", "/")

    def parsed(value: Column, form: str, pattern: str) -> Column:
        return F.when(value.rlike(pattern), F.to_date(F.try_to_timestamp(value, F.lit(form))))

    year = F.nullif(F.regexp_extract(t, r"(?i)\b(?:FY|AY)\s*(\d{4})", 1), F.lit("")).try_cast("int")
    numeric = r"^\d{1,2}/\d{1,2}/\d{4}$"
    return F.coalesce(
        parsed(t, "yyyy-MM-dd", r"^\d{4}-\d{2}-\d{2}$"),
        parsed(plain, "d MMMM yyyy", r"^\d{1,2}\s+[A-Za-z]{4,}\s+\d{4}$"),
        parsed(plain, "d MMM yyyy", r"^\d{1,2}\s+[A-Za-z]{3}\s+\d{4}$"),
        parsed(day_first, "d/M/yyyy", numeric),
        parsed(day_first, "M/d/yyyy", numeric),
        parsed(day_first, "d/M/yy", r"^\d{1,2}/\d{1,2}/\d{2}$"),
        F.when(year.isNotNull(), F.make_date(year, F.lit(4), F.lit(1))),
    )


def section(text: Column) -> Column:
    """The first reference, lower-cased, without blanks."""
    return F.nullif(F.lower(F.regexp_replace(F.regexp_extract(text, SECTION, 0), r"\s+", "")), F.lit(""))


def section_list(text: Column) -> Column:
    """The numbers of the first reference of a text: its own, and each that a comma or "and" in the rest joins to it.

    Empty without a reference; numbers that nothing joins ("Section 5 within 10 days") are none.
    """
    found = F.regexp_extract(text, SECTION, 0)
    rest = F.substring(text, F.instr(text, found) + F.length(found), F.length(text))
    number = lambda part: F.regexp_extract(F.ltrim(part), rf"^{SECTION_NUMBER}", 0)
    joined = F.filter(F.transform(F.slice(F.split(rest, r"(?i),|\s+and\s"), 2, 1 << 30), number), lambda n: n != "")
    own = F.array(F.regexp_extract(found, rf"\s({SECTION_NUMBER})$", 1))
    return F.when(found == "", F.array().cast("array<string>")).otherwise(F.concat(own, joined))


def sections_equal(a: Column, b: Column) -> Column:
    """Whether two references are written alike but for case and blanks; NULL if either is."""
    form = lambda text: F.lower(F.regexp_replace(text, r"\s+", ""))
    return form(a) == form(b)


def numerically_equal(a: Column, b: Column, tolerance: float = 1e-6) -> Column:
    """Within a relative tolerance; two zeros are equal; NULL if either is."""
    top = F.greatest(F.abs(a), F.abs(b))
    return F.when(a.isNull() | b.isNull(), F.lit(None).cast("boolean")).otherwise(F.abs(a - b) <= tolerance * top)


def fy_from_ay(year: Column) -> Column:
    """The financial year before an assessment year: ``AY 2024-25`` is of ``FY 2023-24``."""
    first = F.nullif(F.regexp_extract(year, r"([0-9]{4})", 1), F.lit("")).try_cast("int")
    return F.when(first.isNotNull(), F.format_string("FY %d-%02d", first - 1, F.pmod(first, F.lit(100))))


def dates_equal(a: Column, b: Column) -> Column:
    """Three-valued: NULL if either text holds no date."""
    return date(a) == date(b)
