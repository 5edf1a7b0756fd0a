"""Column functions over numbers, dates and vectors. Null stands for a missing value everywhere; a flag of a missing value is 0."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TINY = 1e-12


def safe_div(a: Column, b: Column) -> Column:
    """a / b; null where b is within 1e-12 of zero."""
    return F.when(F.abs(b) > TINY, a / b)


def ratio(a: Column, b: Column, digits: int = 4) -> Column:
    """a / b rounded; null for a null or zero b."""
    return F.round(F.try_divide(a, b), digits)


def flag(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False)).cast("int")


def total_assets(profit: Column, roa: Column, market_cap: Column, pb: Column, debt: Column) -> Column:
    """profit / roa where roa (in percent) is not near zero; else market value over pb and the equity share."""
    by_value = safe_div(safe_div(market_cap, pb), 1 - debt / 100)
    return F.when((F.abs(roa) > 0.01) & profit.isNotNull(), safe_div(profit, roa / 100)).otherwise(by_value)


def clip(x: Column, low: Column, high: Column) -> Column:
    return F.when(x.isNotNull(), F.least(F.greatest(x, low), high))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null for vectors of other lengths or of length zero."""
    return F.when(F.size(a) == F.size(b), safe_div(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))))


def unit_vector(v: Column) -> Column:
    norm = F.sqrt(dot(v, v))
    return F.transform(v, lambda x: F.when(norm > TINY, x / norm).otherwise(x.cast("double")))


def bigrams(text: Column) -> Column:
    """Pairs of neighbouring characters without white space."""
    bare = F.regexp_replace(text, r"\s+", "")
    chars = F.split(bare, "")
    rest = F.greatest(F.length(bare) - 1, F.lit(0))
    pairs = F.zip_with(F.slice(chars, F.lit(1), rest), F.slice(chars, F.lit(2), rest), lambda a, b: F.concat(a, b))
    return F.when(rest > 0, pairs).otherwise(F.array().cast("array<string>"))


def bigram_bucket(gram: Column, buckets: int = 65536) -> Column:
    return (F.conv(F.substring(F.md5(gram), 1, 8), 16, 10).cast("long") % buckets).cast("int")


def risk_level(p: Column) -> Column:
    return F.when(p >= 0.6, "高").when(p >= 0.3, "中").otherwise("低")
