"""Format-preserving pseudonyms for personal data, by a keyed Feistel network.

Candidates are found by one pattern and then validated: payment cards by their check digit, IBANs
by their remainder, social security numbers by their number plan, IPv4 addresses by their octets,
dates by the calendar, e-mail addresses and ten-digit North American phone numbers by their syntax
(phone numbers within the number plan stay in it, and those outside it stay outside). A validated
value is permuted within its own format (same length, punctuation, letter case and check digits)
by a Feistel network over the format's domain, walking until the result is valid again. The
permutation depends on the secret key (``spark.verdara.pii.key``) and the kind alone, so equal values have equal pseudonyms in every
document and different values stay different; a date keeps its identity across notations (day and month are
written with two digits; day first, unless only month first is a date).

Defined cases: a null text stays null and an empty one empty, with no finding; values that fail
validation are left alone; where two kinds fit, the first of the pattern is taken; very long texts
are processed whole; repeated rows are treated alike; other columns are passed through unread, under a
struct if their names clash with ``text`` or ``n_found``.
"""

from __future__ import annotations

import hashlib
import re
import secrets
import string
from collections.abc import Callable, Iterator
from datetime import date, timedelta

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from verdara.llm.common import chunks

ROUNDS = 8
#: Name of the session setting with the key.
KEY_SETTING = "spark.verdara.pii.key"
_drawn: list[bytes] = []


def key_of(spark: SparkSession) -> bytes:
    """The session's key; without one, a random key of this application, so that nobody can invert its pseudonyms."""
    given = spark.conf.get(KEY_SETTING, None)
    if given:
        return given.encode()
    if not _drawn:
        _drawn.append(secrets.token_bytes(32))
    return _drawn[0]


FOUND = re.compile(
    r"""
    (?P<email>(?<![\w.+-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@(?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?\.)+[A-Za-z]{2,24}(?![\w-]))
  | (?P<iban>(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,3})?(?![A-Za-z0-9]))
  | (?P<day>(?<![\w./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}|[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4})(?![\w/-]|\.[0-9]))
  | (?P<ip>(?<![\w.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?!\w|\.[0-9]))
  | (?P<ssn>(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-]))
  | (?P<phone>(?<![\w+-])(?:\+?1[ .-]?)?(?:\([0-9]{3}\)[ ]?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![\w-]))
  | (?P<card>(?<![\w-])[0-9](?:[ -]?[0-9]){12,18}(?![\w-]))
    """,
    re.VERBOSE | re.ASCII,
)
#: A text without one of these has nothing to find.
HINT = re.compile(r"[0-9@]")

EPOCH, DAYS = date(1900, 1, 1), 73_049  # up to the end of 2099; dates of other years stay outside these
ALL_DAYS = date.max.toordinal()


class Feistel:
    """Keyed permutation of range(n) for any n, by alternating rounds over two near-equal halves and cycle walking."""

    def __init__(self, key: bytes) -> None:
        self.key = key

    def _round(self, kind: str, n: int, i: int, half: int) -> int:
        return int.from_bytes(hashlib.blake2b(f"{kind}|{n}|{i}|{half}".encode(), key=self.key, digest_size=16).digest(), "big")

    def once(self, kind: str, n: int, value: int) -> int:
        width = max(2, 1 << (n - 1).bit_length() // 2 + (n - 1).bit_length() % 2)
        while True:  # over width * width >= n; leaves n at most a few times
            left, right = divmod(value, width)
            for i in range(ROUNDS):
                left, right = right, (left + self._round(kind, n, i, right)) % width
            value = left * width + right
            if value < n:
                return value

    def walk(self, kind: str, n: int, value: int, valid: Callable[[int], bool]) -> int:
        """The next valid value on the cycle of a valid value: a permutation of the valid ones."""
        value = self.once(kind, n, value)
        while not valid(value):
            value = self.once(kind, n, value)
        return value


def luhn(digits: str) -> int:
    """Check digit that completes ``digits``."""
    total = sum(sum(divmod(int(d) * (2 - i % 2), 10)) for i, d in enumerate(reversed(digits)))
    return -total % 10


def refill(shape: str, characters: str) -> str:
    """``shape`` with its letters and digits replaced in turn."""
    it = iter(characters)
    return "".join(next(it) if c.isalnum() else c for c in shape)


class Pseudonymiser:
    """Finds, validates and permutes the values of a text; keeps a bounded table of values already seen."""

    def __init__(self, key: bytes, kinds: frozenset[str] | None = None) -> None:
        self.net = Feistel(hashlib.blake2b(key, digest_size=32).digest())
        self.kinds = kinds
        self.seen: dict[tuple[str, str], str | None] = {}

    def card(self, raw: str) -> str | None:
        digits = re.sub(r"\D", "", raw)
        n = len(digits)
        if not 13 <= n <= 19 or len(set(digits)) == 1 or digits[0] == "0" or luhn(digits[:-1]) != int(digits[-1]):
            return None
        body = f"{self.net.once('card', 10 ** (n - 2), int(digits[1:-1])):0{n - 2}d}"
        return refill(raw, digits[0] + body + str(luhn(digits[0] + body)))

    def iban(self, raw: str) -> str | None:
        flat = raw.replace(" ", "")
        number = lambda s: int("".join(str(int(c, 36)) for c in s))
        if not 15 <= len(flat) <= 34 or number(flat[4:] + flat[:4]) % 97 != 1:
            return None
        body = self.mixed("iban" + flat[:2], flat[4:])
        return refill(raw, f"{flat[:2]}{98 - number(body + flat[:2] + '00') % 97:02d}{body}")

    def mixed(self, kind: str, text: str) -> str:
        """Letters to letters of the same case, digits to digits, everything else in place."""
        sets = [string.digits if c.isdigit() else string.ascii_lowercase if c.islower() else string.ascii_uppercase for c in text if c.isalnum()]
        value = n = 0
        n = 1
        for alphabet, c in zip(sets, (c for c in text if c.isalnum()), strict=True):
            value, n = value * len(alphabet) + alphabet.index(c), n * len(alphabet)
        value = self.net.once(kind, n, value)
        out = []
        for alphabet in reversed(sets):
            value, k = divmod(value, len(alphabet))
            out.append(alphabet[k])
        return refill(text, "".join(reversed(out)))

    def email(self, raw: str) -> str | None:
        local, _, domain = raw.partition("@")
        if ".." in local or local.endswith("."):
            return None
        name, dot, top = domain.rpartition(".")
        return f"{self.mixed('local', local)}@{self.mixed('domain', name)}{dot}{top}"

    def ip(self, raw: str) -> str | None:
        octets = raw.split(".")
        if any(int(o) > 255 or str(int(o)) != o for o in octets):
            return None
        value = 0
        for o in octets:
            value = value * 256 + int(o)
        value = self.net.once("ip", 1 << 32, value)
        return ".".join(str(value >> s & 255) for s in (24, 16, 8, 0))

    def ssn(self, raw: str) -> str | None:
        def valid(v: int) -> bool:
            area, group, serial = v // 1_000_000, v // 10_000 % 100, v % 10_000
            return area not in (0, 666) and area < 900 and group > 0 and serial > 0

        value = int(raw.replace("-", ""))
        return refill(raw, f"{self.net.walk('ssn', 10**9, value, valid):09d}") if valid(value) else None

    def phone(self, raw: str) -> str | None:
        digits = re.sub(r"\D", "", raw)
        planned = lambda v: v // 10**9 >= 2 and v // 10**6 % 10 >= 2
        value = int(digits[-10:])
        kept = planned(value)  # numbers of the plan stay in it, all others outside it
        return refill(raw, digits[:-10] + f"{self.net.walk('phone', 10**10, value, lambda v: planned(v) == kept):010d}")

    def day(self, raw: str) -> str | None:
        a, b, c = map(int, re.split(r"\D", raw))
        iso = raw[4] == "-"
        month_first = not iso and b > 12
        try:
            value = (date(a, b, c) if iso else date(c, a, b) if month_first else date(c, b, a)).toordinal()
        except ValueError:
            return None
        usual = lambda v: 0 <= v - EPOCH.toordinal() < DAYS
        if usual(value):
            moved = EPOCH + timedelta(self.net.once("day", DAYS, value - EPOCH.toordinal()))
        else:
            moved = date.fromordinal(1 + self.net.walk("day", ALL_DAYS, value - 1, lambda v: not usual(v + 1)))
        if iso:
            return moved.isoformat()
        parts = (moved.month, moved.day) if month_first else (moved.day, moved.month)
        return f"{parts[0]:02d}{raw[-5]}{parts[1]:02d}{raw[-5]}{moved.year:04d}"

    def replace(self, text: str | None) -> tuple[str | None, int]:
        """The text with its valid values replaced, and their number."""
        if not text or not HINT.search(text):
            return text, 0
        count = 0

        def one(m: re.Match) -> str:
            nonlocal count
            kind, raw = m.lastgroup, m.group()
            if self.kinds is not None and kind not in self.kinds:
                return raw
            if (kind, raw) not in self.seen:
                if len(self.seen) > 100_000:
                    self.seen.clear()
                self.seen[kind, raw] = getattr(self, kind)(raw)
            made = self.seen[kind, raw]
            count += made is not None
            return raw if made is None else made

        return FOUND.sub(one, text), count


def pseudonymise(docs: DataFrame, columns: list[str | Column], key: bytes, kinds: frozenset[str] | None = None) -> DataFrame:
    """``columns`` of every row, with ``text`` (pseudonymised) and ``n_found`` appended."""
    rows = docs.select(F.struct(*columns).alias("row"), F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker = Pseudonymiser(key, kinds)
        for batch in batches:
            for part in chunks(batch):
                texts, counts = zip(*map(worker.replace, part.column(1).to_pylist()), strict=True)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string()), pa.array(counts, pa.int64())], ["row", "text", "n_found"])

    made = rows.mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}, text string, n_found long")
    clash = {"text", "n_found"}.intersection(rows.schema["row"].dataType.names)
    return made.select("row" if clash else "row.*", "text", "n_found")


def op3_pii(spark, sf_dir: str) -> DataFrame:
    """doc_id, number of values replaced, and the whole pseudonymised text."""
    return pseudonymise(spark.read.parquet(f"{sf_dir}/documents.parquet"), ["doc_id"], key_of(spark))
