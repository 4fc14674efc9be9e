"""Column functions for numbers, percentages, dates and types in English financial sentences.

Patterns with word boundaries are meant for ASCII text; other alphabets differ between regex engines.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as a number, a percentage and a date.
NUMBER = r"[$€£]?(\d[\d,]*\.?\d*)\s*([BbMmKk])?"
RAW_NUMBER = r"[$€£]?\d+[.,]?\d*[BbMmKk]?"
PERCENT_SIGN = r"(\d+\.?\d*)\s*%"
PERCENT_WORD = r"(?i)(\d+\.?\d*)\s*percent"
YEAR = r"\b(19|20)\d{2}\b"
QUARTER = r"Q[1-4]\s*\d{4}"
FISCAL = r"(?i)fiscal\s*year?\s*(\d{4})"
SENTENCE_END = r"(?<=[.!?])\s+"
DATE_HINT = r"(?i)\d{4}|Q\d|january|february|march|april|may|june|july|august|september|october|november|december"
CONFIDENCE = r"(?i)confidence[:\s]*([0-9.]+)"
JSON_ARRAY = r"(?s)\[.*\]"


def some(column: Column) -> Column:
    """Null for the empty string, which Spark's regexp_extract gives for no match."""
    return F.when(column != "", column)


def strip(column: Column) -> Column:
    return F.trim(column, F.lit(" \t\n\x0b\f\r"))


def scaled(digits: Column, suffix: Column) -> Column:
    """A double from digits with commas and a suffix B, M or K."""
    place = F.position(suffix, F.lit(".BMKbmk"))  # 1 for the empty suffix
    return F.replace(digits, F.lit(",")).try_cast("double") * F.get(F.lit([1.0, 1e9, 1e6, 1e3, 1e9, 1e6, 1e3]), place - 1)


def primary_number(text: Column) -> Column:
    """The first number of a text, scaled; null if there is none."""
    return scaled(some(F.regexp_extract(text, NUMBER, 1)), F.regexp_extract(text, NUMBER, 2))


def numbers(text: Column) -> Column:
    """All numbers of a text, scaled, in order."""
    pairs = F.arrays_zip(F.regexp_extract_all(text, F.lit(NUMBER), F.lit(1)).alias("d"), F.regexp_extract_all(text, F.lit(NUMBER), F.lit(2)).alias("s"))
    return F.filter(F.transform(pairs, lambda p: scaled(p["d"], p["s"])), lambda x: x.isNotNull())


def raw_numbers(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(RAW_NUMBER), F.lit(0))


def percentage(text: Column) -> Column:
    first = some(F.regexp_extract(text, PERCENT_SIGN, 1)).try_cast("double")
    return F.coalesce(first, some(F.regexp_extract(text, PERCENT_WORD, 1)).try_cast("double")) / 100


def date_text(text: Column) -> Column:
    """A year, a quarter or FY and a year; null if there is none."""
    fiscal = some(F.regexp_extract(text, FISCAL, 1))
    return F.coalesce(some(F.regexp_extract(text, YEAR, 0)), some(F.regexp_extract(text, QUARTER, 0)), F.concat(F.lit("FY"), fiscal))


def confidence(text: Column) -> Column:
    """A stated confidence clamped to [0, 1]; 0.5 if there is none or it isn't a number."""
    value = some(F.regexp_extract(text, CONFIDENCE, 1)).try_cast("double")
    return F.when(value.isNull(), 0.5).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), value)))


def json_array(text: Column) -> Column:
    return some(F.regexp_extract(text, JSON_ARRAY, 0))


def contains_any(text: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(text, F.lit(w))
    return out


# The cascade of claim types, first hit wins.
COMPUTATIONAL = ["=", "equals", "calculated as", "computed as"]
COMPARATIVE = ["increased", "decreased", "grew", "declined", "vs", "compared to", "higher than", "lower than", "%", "percent"]
REGULATORY = ["sec", "gaap", "ifrs", "regulation", "rule", "compliance", "regulatory"]
TEMPORAL = r"\d{4}|fiscal year|quarter"


def claim_type(text: Column, low: Column | None = None) -> Column:
    """The type of a claim. low: its lower-case text, where a column holds it already."""
    low = F.lower(text) if low is None else low
    return (
        F.when(contains_any(low, COMPUTATIONAL), "computational")
        .when(contains_any(low, COMPARATIVE), "comparative")
        .when(contains_any(low, REGULATORY), "regulatory")
        .when(F.regexp_like(low, F.lit(TEMPORAL)), "temporal")
        .when(F.regexp_like(low, F.lit(r"\d")), "numerical")
        .otherwise("entity")
    )


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays of doubles; null if either is zero."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))
