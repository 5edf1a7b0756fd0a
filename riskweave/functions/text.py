"""Column functions over codes, titles and disclosure text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def stock_code(text: Column) -> Column:
    """The first run of exactly six digits; empty if there is none."""
    return F.regexp_extract(text, r"(?<!\d)(\d{6})(?!\d)", 1)


def market(code: Column) -> Column:
    """Exchange of a six-digit code; null if its prefix is not known."""
    return F.when(code.rlike("^(4|8|92)"), "BJ").when(code.rlike("^(6|9)"), "SH").when(code.rlike("^(0|2|3)"), "SZ")


def company_code(text: Column) -> Column:
    """Digits padded to six, with the exchange as suffix."""
    digits = F.lpad(F.regexp_replace(text, r"\D", ""), 6, "0")
    return F.concat_ws(".", digits, F.when(digits.rlike("^[69]"), "SH").when(digits.rlike("^[48]"), "BJ").otherwise("SZ"))


def report_period(text: Column) -> Column:
    """YYYYMMDD as a number from whatever has eight digits; 0 if there are fewer."""
    digits = F.substring(F.regexp_replace(text.cast("string"), r"\D", ""), 1, 8)
    return F.when(F.length(digits) == 8, digits.cast("int")).otherwise(0)


def clean_title(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"<[^>]*>", ""), r"\s+", " "))


def event_key(announcement_id: Column, label: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", announcement_id, label), 256), 1, 20)


def occurrences(text: Column, word: str) -> Column:
    """How often a word stands in a text, without overlaps."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(word)))) / len(word)).cast("long")


def lexicon_score(text: Column, positive: list[str], negative: list[str]) -> Column:
    """(positive - negative) / (positive + negative) counts; null without any."""
    total = lambda words: reduce(lambda a, b: a + b, [occurrences(text, w) for w in words])
    p, n = total(positive), total(negative)
    return F.when(p + n > 0, (p - n) / (p + n))


def first_of(text: Column, rules: list[tuple[str, str]], default: str | None = None) -> Column:
    """The name of the first (name, pattern) whose pattern is found."""
    out = reduce(lambda c, r: c.when(text.rlike(r[1]), r[0]), rules[1:], F.when(text.rlike(rules[0][1]), rules[0][0]))
    return out.otherwise(F.lit(default)) if default is not None else out


def severity(value: Column) -> Column:
    """Words and numbers as 1 to 5; 2 for what is not known."""
    word = F.lower(F.trim(value))
    number = word.try_cast("double")
    named = F.when(word.isin("critical", "high"), 5).when(word == "medium", 3).when(word == "low", 2).otherwise(2)
    return F.when(number.isNotNull(), F.greatest(F.lit(1), F.least(F.lit(5), number.cast("int")))).otherwise(named)


def evidence_ids(text: Column) -> Column:
    """Ids of cited evidence, also beside letters of other scripts."""
    return F.regexp_extract_all(text, F.lit(r"(?<![A-Za-z0-9_])((?:fin|sem)_\d{3})(?![A-Za-z0-9_])"), 1)


def json_object(text: Column, schema: str) -> Column:
    """The outermost {...} of a text, parsed; null if it is no JSON."""
    return F.from_json(F.regexp_extract(text, r"(?s)(\{.*\})", 1), schema)
