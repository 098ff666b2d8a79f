"""Text column expressions: name, unit and value keys, drug texts, wording and numbers in a text."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..sources import dictionary as d

# --- Fixed values: words that do not tell one test from another; "fasting" does only for glucose -------------
QUALIFIERS = ["serum", "plasma", "direct", "calculated", "blood", "whole"]
GLUCOSE_WORDS = ["glucose", "sugar"]
# --- Fixed values: comparators a printed value may start with: signs, and words with a space behind them --------
_LESS, _MORE = r"(?i:less\s+than|below|upto|up\s+to)", r"(?i:more\s+than|greater\s+than|above)"
COMPARATOR = rf"^(?:(?:<=|≤|=<|>=|≥|=>|<|>)\s*|(?:{_LESS}|{_MORE})\s+)"
SIGN = rf"^(<=|≤|=<|>=|≥|=>|<|>|{_LESS}(?=\s)|{_MORE}(?=\s))"
SIGNS = {"<=": ["<=", "≤", "=<"], ">=": [">=", "≥", "=>"], "<": ["<", "l", "b", "u"], ">": [">", "m", "g", "a"]}
NUMBER = r"^[+]?([1-9]\d{0,2}(,\d{3})+|[1-9]\d?(,\d{2})+,\d{3}|\d+)(\.\d+)?$|^[+]?\.\d+$"


def collapse(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def name_key(c: Column) -> Column:
    """Printed name for comparison: case and spacing do not matter."""
    return F.lower(collapse(c))


def unit_key(c: Column) -> Column:
    """Unit for comparison: no spaces, no dots, either micro sign as "u"."""
    return F.lower(F.translate(F.regexp_replace(c, r"[\s.]+", ""), "µμ", "uu"))


def loose_words(name: Column) -> Column:
    """Words of a test name without punctuation, serum prefix and qualifiers."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(name), r"^\s*sr?(\.\s*|\s+)(?=[a-z])", ""), r"[^0-9a-z ]+", " ")
    tokens = F.filter(F.split(plain, " +"), lambda w: w != "")
    glucose = F.arrays_overlap(tokens, F.array(*map(F.lit, GLUCOSE_WORDS)))
    return F.filter(tokens, lambda w: ~w.isin(QUALIFIERS) & ((w != "fasting") | glucose))


def word_set_key(words: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(words)), " ")


def joined_key(words: Column) -> Column:
    return F.array_join(words, "")


def _stripped_value(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", ""), r"\*+$", ""))


def value_comparator(text: Column) -> Column:
    sign = F.regexp_extract(_stripped_value(text), SIGN, 1)
    first = F.when(sign.rlike("^(?i)[a-z]"), F.lower(F.substring(sign, 1, 1))).otherwise(sign)
    return F.element_at(F.create_map(*[F.lit(x) for symbol, forms in SIGNS.items() for form in forms for x in (form, symbol)]), first)


def value_number(text: Column) -> Column:
    """The printed number, or null: digit grouping counts only in its Western and Indian forms."""
    rest = F.trim(F.regexp_replace(_stripped_value(text), COMPARATOR, ""))
    number = F.regexp_extract(rest, NUMBER, 0)                                # empty where the text is no number
    return F.nullif(F.translate(number, ",+", ""), F.lit("")).try_cast("double")


def drug_first_word(text: Column) -> Column:
    """First word of a prescription that is not a form, strength or frequency."""
    words = F.filter(F.split(name_key(text), r"[\s.,/+()-]+"), lambda w: (w != "") & ~w.rlike(d.DRUG_NOISE))
    return F.try_element_at(words, F.lit(1))


def condition_key(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), r"[-\s]+", " "))


def numbers_in(text: Column) -> Column:
    """Numbers not glued to a letter, digit or point on their left ("R7" is a name)."""
    return F.regexp_extract_all(text, F.lit(d.NUMBER_PATTERN), 0)


def without_phrases(text: Column, phrases: list[str]) -> Column:
    """Text with the allowed phrases blanked out, longest first."""
    kept = sorted((p for p in phrases if p), key=len, reverse=True)
    return F.regexp_replace(text, "(?i)" + "|".join(re.escape(p) for p in kept), " ") if kept else text


def matches(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit("(?iU)" + pattern), 0)


def brand_pattern() -> str:
    return r"\b(" + "|".join(r"\s*".join(map(re.escape, b.split(" "))) for b in d.LAB_BRANDS) + r")\b"


def month_year(date: Column) -> Column:
    return F.date_format(date, "MMM yyyy")


def short_number(v: Column, digits: int = 4) -> Column:
    """A number to ``digits`` significant figures without trailing zeros."""
    out = F.round(v, 0)
    for power in range(digits - 1, -13, -1):
        out = F.when(F.abs(v) >= 10.0 ** power, out).otherwise(F.round(v, digits - power))
    text = F.regexp_replace(out.cast("decimal(38,16)").cast("string"), "0+$", "")
    return F.regexp_replace(text, r"\.$", "")


def on_day(value: Column, unit: str, date: Column) -> Column:
    """ "8.9% on 12 Jun 2023" """
    gap = "" if unit in ("", "%") else " "
    return F.concat(short_number(value), F.lit(gap + unit + " on "), F.date_format(date, "dd MMM yyyy"))


def filled(template: str, **values: Column) -> Column:
    """A text with the value of a column at each of its ``{places}``; null where one of them is null."""
    parts = re.split(r"\{(\w+)\}", template)
    return F.concat(*[values[part].cast("string") if i % 2 else F.lit(part) for i, part in enumerate(parts) if part])
