"""Amounts, dates and references in token texts, as Column expressions."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The patterns that say what an amount, a date and a reference look like.
AMOUNT = (
    r"^[+-]?\s*(?:INR|Rs\.?|₹|USD|\$|EUR|€)?\s*"
    r"(?:\d{1,3}(?:,\d{2})*(?:,\d{3})?(?:\.\d{1,4})?|\d{1,3}(?:,\d{3})*(?:\.\d{1,4})?|\d+\.\d{1,4}|\d{4,})"
    r"\s*(?:CR|DR|Cr|Dr|cr|dr)?$"
)
CREDIT_SIGN = r"(?i)\b(?:cr|credit)\b"
DEBIT_SIGN = r"(?i)\b(?:dr|debit)\b"
MONTH = r"(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)"
DATES = (
    r"\b\d{2}[/-]\d{2}[/-]\d{4}\b",
    r"\b\d{4}[/-]\d{2}[/-]\d{2}\b",
    r"\b\d{2}[/-]\d{2}[/-]\d{2}\b",
    rf"(?i)\b\d{{1,2}}\s+{MONTH}[a-z]*[\s,]*\d{{2,4}}\b",
    rf"(?i)\b{MONTH}[a-z]*[\s,]+\d{{1,2}},?\s*\d{{2,4}}\b",
    rf"(?i)\b\d{{1,2}}\s+{MONTH}[a-z]*\b",
    rf"(?i)\b\d{{1,2}}{MONTH}[a-z]*\b",
    rf"(?i)\b\d{{1,2}}\s*{MONTH}\b",
    r"\b\d{8}\b",
)
REFERENCES = (r"\b[A-Z]{3,6}\d{10,22}\b", r"(?i)\bUTR\s*:?\s*[\w\d]{10,22}\b", r"\b\d{16,22}\b", r"\b[A-Z0-9]{12,24}\b")
NUMBERS = r"(?:[+-]?\s*)?(?:\d{1,3}(?:,\d{2})*(?:,\d{3})?|\d{1,3}(?:,\d{3})*|\d+)(?:\.\d{1,4})?"
NOISE = (
    r"(?i)^\s*(?:ref\.?\s*no\.?|summary\s+of|transactions?\s*$|important\s+points?|date\s*$|description\s*$|withdrawal\s*$|deposit\s*$|balance\s*$"
    r"|on\s+\w+.*to\s+\d{1,2}\s|primary\s+account|https?://|kotak-mahindra|\.avif\s*\()"
)
NOISE_WORDS = ("TRANSACTIONS", "DATE", "DESCRIPTION", "WITHDRAWAL", "DEPOSIT", "BALANCE")


#: White space: ASCII's, the separators 1C to 1F, and Unicode's.
SPACES = "".join(map(chr, (*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
#: Whether text may match the date patterns up to a number, in their order, by tests that cost little.
MAYBE_DATE = (
    (3, lambda t: (t.contains("/") | t.contains("-")) & t.rlike(r"\d\d[/-]\d\d")),
    (8, lambda t: t.rlike(r"[A-Za-z]{3}") & t.rlike(r"\d") & t.rlike(f"(?i){MONTH}")),
    (9, lambda t: t.rlike(r"\d{8}")),
)


def _dates() -> list[tuple[Callable[[Column], Column], tuple[str, ...]]]:
    ends = [0, *[n for n, _ in MAYBE_DATE]]
    return [(test, DATES[a:b]) for (_, test), a, b in zip(MAYBE_DATE, ends[:-1], ends[1:], strict=True)]


def stripped(text: Column) -> Column:
    """Without white space, Unicode's included, at both ends."""
    return F.btrim(text, F.lit(SPACES))


def is_amount(text: Column) -> Column:
    return amount_shaped(stripped(text))


def amount_shaped(t: Column) -> Column:
    """is_amount() of a text without white space at its ends."""
    return t.rlike(AMOUNT)


def is_date(text: Column) -> Column:
    return date_shaped(stripped(text))


def date_shaped(t: Column) -> Column:
    """is_date() of a text without white space at its ends."""
    found = reduce(lambda a, b: a | b, [maybe(t) & reduce(lambda a, b: a | b, [t.rlike(p) for p in patterns]) for maybe, patterns in _dates()])
    return found & ~t.rlike(r"^\d{7,}$")


def parse_amount(text: Column) -> Column:
    """struct(value, sign); null where the text is no amount or has no value."""
    t = stripped(text)
    value = number(t)
    sign = F.when(t.startswith("-"), "debit").when(t.rlike(CREDIT_SIGN), "credit").when(t.rlike(DEBIT_SIGN), "debit").otherwise("unknown")
    return F.when(t.rlike(AMOUNT) & value.isNotNull(), F.struct(value.alias("value"), sign.alias("sign")))


def clean_amount(text: Column) -> Column:
    """The value alone; its sign is lost."""
    t = stripped(text)
    return F.when(amount_shaped(t), number(t))


def number(t: Column) -> Column:
    """The value of an amount's text without white space at its ends; null if it has none."""
    return F.regexp_replace(t, r"[^\d.]", "").try_cast("double")


def _first_of(text: Column, patterns: tuple[str, ...]) -> Column:
    return F.coalesce(*[F.regexp_substr(text, F.lit(p)) for p in patterns])


def extract_date(text: Column) -> Column:
    """What the first pattern that matches anywhere finds; null if none does."""
    return stripped(F.coalesce(*[F.when(maybe(text), _first_of(text, patterns)) for maybe, patterns in _dates()]))


def extract_reference(text: Column) -> Column:
    return F.when(maybe_reference(text), stripped(_first_of(text, REFERENCES)))


def maybe_reference(text: Column) -> Column:
    """Whether text may match a reference's pattern: each takes ten word characters in a row at least."""
    return text.rlike(r"\w{10}")


def is_reference(text: Column) -> Column:
    t = stripped(text)
    return maybe_reference(t) & reduce(lambda a, b: a | b, [t.rlike(p) for p in REFERENCES])


def extract_amounts(text: Column) -> Column:
    """All numbers of 0.01 and more, left to right, without signs."""
    found = F.regexp_extract_all(text, F.lit(f"({NUMBERS})"), F.lit(1))
    values = F.transform(found, lambda x: F.regexp_replace(x, r"[^\d.]", "").try_cast("double"))
    return F.filter(values, lambda v: v >= 0.01)


def all_digits(text: Column) -> Column:
    """Eight digits or more and nothing else, spaces aside."""
    return F.replace(text, F.lit(" "), F.lit("")).rlike(r"^\d{8,}$")


def is_noise(full_text: Column, has_numeric: Column) -> Column:
    """Whether a row's text is a heading, a footer or a bare account number."""
    t = stripped(full_text)
    upper = F.upper(t)
    return (t == "") | t.rlike(NOISE) | upper.isin(*NOISE_WORDS) | (upper.contains("DESCRIPTION") & upper.contains("DATE") & ~has_numeric) | all_digits(t)
