"""Inquiry history, labels that look forward, and as-of joins. Events have secucode, kind (letter or reply), date, type and event_id."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

WINDOWS = {"12m": 365, "24m": 730, "60m": 1825}
#: Kinds of letters and the features that count them, and the family's features in their order.
TYPES = {"annual_report": "f6_annual_report_inquiry_count", "attention": "f6_attention_letter_count", "restructuring": "f6_restructuring_inquiry_count"}
F6_FEATURES = [
    "f6_inquiry_count_12m", "f6_inquiry_count_24m", "f6_inquiry_count_60m", "f6_annual_report_inquiry_count", "f6_attention_letter_count",
    "f6_restructuring_inquiry_count", "f6_first_inquiry_interval_days", "f6_last_inquiry_interval_days", "f6_avg_inquiry_interval_days",
    "f6_inquiry_interval_cv", "f6_unreplied_count", "f6_severity_score",
]


def history(companies: DataFrame, events: DataFrame, as_of: str) -> DataFrame:
    """The family's features of each company's letters up to a day; zeros without any. companies: secucode."""
    day = F.lit(as_of).cast("date")
    past = events.where(F.col("date") <= day)
    letter = F.col("kind") == "letter"
    before = F.lag("date").over(Window.partitionBy("secucode", "kind").orderBy("date", "event_id"))
    rows = past.withColumn("gap", F.when(letter, F.datediff("date", before)).cast("double"))
    found = rows.groupBy("secucode").agg(
        *[F.count_if(letter & (F.col("date") >= F.date_sub(day, n))).alias(f"f6_inquiry_count_{name}") for name, n in WINDOWS.items()],
        *[F.count_if(letter & (F.col("type") == t)).alias(name) for t, name in TYPES.items()],
        F.datediff(day, F.min(F.when(letter, F.col("date")))).alias("f6_first_inquiry_interval_days"),
        F.datediff(day, F.max(F.when(letter, F.col("date")))).alias("f6_last_inquiry_interval_days"),
        F.avg("gap").alias("f6_avg_inquiry_interval_days"),
        F.when(F.avg("gap") > 0, F.stddev_pop("gap") / F.avg("gap")).alias("f6_inquiry_interval_cv"),
        F.greatest(F.count_if(letter) - F.count_if(~letter), F.lit(0)).alias("f6_unreplied_count"),
        F.count_if(letter).alias("letters"),
    )
    found = found.withColumn("f6_severity_score", F.least(F.lit(1.0), F.round(F.col("letters") * 0.1, 4))).where("letters > 0").drop("letters")
    return companies.select("secucode").distinct().join(found.select("secucode", *F6_FEATURES), "secucode", "left").fillna(0)


def type_distribution(events: DataFrame) -> DataFrame:
    """How many letters there are of each type, and their share."""
    counts = events.where("kind = 'letter'").groupBy("type").agg(F.count("*").alias("letters"))
    every = counts.agg(F.sum("letters").alias("every"))
    return counts.join(F.broadcast(every)).select("type", "letters", (F.col("letters") / F.col("every")).alias("share"))  # `every` has one row


def _next(key: str, order: list) -> Window:
    """A frame of what comes after a row: rows run backwards, so that it grows by one row at a time."""
    return Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)


def forward_labels(points: DataFrame, events: DataFrame, days: tuple[int, ...] = (30, 60, 90)) -> DataFrame:
    """points (secucode, t) with target_{n}d: 1 if a letter falls in (t, t + n]. Only the next letter counts, so points and letters are
    put in one order per company and each point has the last letter before it as time runs backwards: one shuffle, no pairs."""
    letters = events.where("kind = 'letter'").select("secucode", F.col("date").alias("t"), F.col("date").alias("letter"))
    marked = points.withColumn("letter", F.lit(None).cast("date")).unionByName(letters, allowMissingColumns=True)
    # On the same day the letter comes after the point, as a letter of that day is not ahead of it.
    ahead = _next("secucode", [F.desc("t"), F.col("letter").isNotNull()])
    rows = marked.withColumn("next", F.last("letter", ignorenulls=True).over(ahead)).where(F.col("letter").isNull())
    return rows.withColumns({f"target_{n}d": F.coalesce(F.datediff("next", "t") <= n, F.lit(False)).cast("int") for n in days}).drop("letter", "next")


def first_replies(events: DataFrame) -> DataFrame:
    """Letters with the first reply on their day or after it, else the company's earliest reply."""
    letters = events.where("kind = 'letter'").select("secucode", "event_id", "date")
    replies = events.where("kind = 'reply'").select("secucode", F.col("date").alias("reply"))
    earliest = replies.groupBy("secucode").agg(F.min("reply").alias("earliest"))
    both = letters.withColumn("reply", F.lit(None).cast("date")).unionByName(replies.select("secucode", F.lit(None).cast("long").alias("event_id"), F.col("reply").alias("date"), "reply"))
    ahead = _next("secucode", [F.desc("date"), F.col("reply").isNull()])
    found = both.withColumn("after", F.last("reply", ignorenulls=True).over(ahead)).where(F.col("event_id").isNotNull())
    return found.join(earliest, "secucode", "left").select("secucode", "event_id", F.col("date").alias("letter_date"), F.coalesce("after", "earliest").alias("reply_date"))


def as_of_latest(rows: DataFrame, key: str, order: str, as_of) -> DataFrame:
    """The latest row of each key that is not after as_of."""
    best = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))
    return rows.where(F.col(order) <= F.lit(as_of)).withColumn("__n", best).where("__n = 1").drop("__n")


def as_of_join(points: DataFrame, rows: DataFrame, key: str, at: str, order: str) -> DataFrame:
    """points with the latest row of their key whose `order` is not after the point's own `at` (nulls without one).

    Points and rows are put in one order per key, and each point takes the last row before it: one shuffle, no pairs. `order` keeps its
    name; other columns of rows must have names of their own."""
    taken = [c for c in rows.columns if c != key]
    seen = F.struct(*taken)
    kind = rows.select(seen.alias("s")).schema["s"].dataType
    marked = rows.select(F.col(key), F.col(order).alias("__at"), seen.alias("__row"))
    both = points.withColumns({"__at": F.col(at), "__row": F.lit(None).cast(kind)}).unionByName(marked, allowMissingColumns=True)
    so_far = Window.partitionBy(key).orderBy("__at", F.col("__row").isNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = both.withColumn("__last", F.last("__row", ignorenulls=True).over(so_far)).where(F.col("__row").isNull())
    return found.select(*points.columns, *[F.col(f"__last.{c}").alias(c) for c in taken])


def assemble(skeleton: DataFrame, families: list[DataFrame], keys: list[str]) -> DataFrame:
    """skeleton left-joined with feature families; columns that it has already are taken from the left."""
    out = skeleton
    for family in families:
        out = out.join(family.select(*keys, *[c for c in family.columns if c not in out.columns]), keys, "left")
    return out


def merge_files(parts: list[DataFrame], keys: list[str]) -> DataFrame:
    """Files of one family side by side, rows of any of them."""
    out = parts[0]
    for part in parts[1:]:
        out = out.join(part, keys, "full_outer")
    return out


def keep_last(rows: DataFrame, keys: list[str], position: str) -> DataFrame:
    """Of rows with equal keys the one with the largest position."""
    best = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(position)))
    return rows.withColumn("__n", best).where("__n = 1").drop("__n")


def keep_first(rows: DataFrame, keys: list[str], position: str) -> DataFrame:
    """Of rows with equal keys the one with the smallest position."""
    best = F.row_number().over(Window.partitionBy(*keys).orderBy(position))
    return rows.withColumn("__n", best).where("__n = 1").drop("__n")
