"""Sentiment of news and posts, and ownership concentration: the families F4 and F5."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskweave.functions.numeric import safe_div
from riskweave.functions.text import lexicon_score


#: The families' features in their order.
F4_FEATURES = [
    "sent_news_count_5d", "sent_news_count_10d", "sent_news_count_30d", "sent_news_title_count_30d", "sent_news_daily_peak_30d",
    "sent_sentiment_mean_30d", "sent_sentiment_volatility_30d", "sent_negative_news_count_30d", "sent_negative_ratio_30d", "sent_negative_peak_30d",
    "sent_post_count_5d", "sent_post_count_30d", "sent_comment_count_30d", "sent_read_count_30d", "sent_post_daily_peak_30d",
    "sent_guba_sentiment_mean_30d", "sent_guba_sentiment_volatility_30d", "sent_guba_positive_ratio_30d", "sent_guba_negative_ratio_30d",
]
F5_FEATURES = [
    "gov_top1_holder_ratio", "gov_top10_holder_ratio", "gov_top10_holder_count", "gov_top10_hhi", "gov_top1_top10_ratio", "gov_top1_top2_gap",
    "gov_board_size", "gov_independent_director_count", "gov_independent_director_ratio",
    "gov_big4_auditor", "gov_auditor_change", "gov_audit_firm_change", "gov_nonstandard_audit_opinion",
]


def _dated(items: DataFrame, as_of: str | None) -> DataFrame:
    """items with __end: as_of, or the last day of their company, which is found by an aggregation."""
    if as_of:
        return items.withColumn("__end", F.lit(as_of).cast("date"))
    return items.join(items.groupBy("company").agg(F.max("date").alias("__end")), "company")


def recent(items: DataFrame, days: int, as_of: str | None = None) -> DataFrame:
    """Items not older than so many days before as_of, or before each company's last item."""
    return _dated(items, as_of).where((F.col("date") >= F.date_sub("__end", days)) & (F.col("date") <= F.col("__end"))).drop("__end")


def _daily(items: DataFrame, positive: list[str], negative: list[str], as_of: str | None, more: dict | None = None) -> DataFrame:
    """By company and day of the last 30 days: age, items, titled ones, scored ones, good and bad ones, sums of scores and squares."""
    rows = _dated(items, as_of).withColumns({"age": F.datediff("__end", "date"), "score": lexicon_score(F.col("title"), positive, negative)})
    return rows.where(F.col("age").between(0, 30)).groupBy("company", "date", "age").agg(
        F.count("*").alias("n"),
        F.count_if(F.length("title") > 0).alias("titled"),
        F.count("score").alias("scored"),
        F.count_if(F.col("score") > 0).alias("good"),
        F.count_if(F.col("score") < 0).alias("bad"),
        F.sum("score").alias("sum"),
        F.sum(F.col("score") * F.col("score")).alias("squares"),
        *[x.alias(name) for name, x in (more or {}).items()],
    )


def _share(c: str):
    return safe_div(F.sum(c).cast("double"), F.sum("scored").cast("double"))


def _spread():
    return F.sqrt(F.greatest(_share("squares") - _share("sum") * _share("sum"), F.lit(0.0)))


def _within(days: int):
    return F.coalesce(F.sum(F.when(F.col("age") <= days, F.col("n"))), F.lit(0))


def news_features(items: DataFrame, positive: list[str], negative: list[str], as_of: str | None = None) -> DataFrame:
    """Counts, busiest day, mean and deviation of scores, and negative shares of each company's last 30 days. Unscored items count as
    items only."""
    return _daily(items, positive, negative, as_of).groupBy("company").agg(
        *[_within(n).alias(f"sent_news_count_{n}d") for n in (5, 10, 30)],
        F.sum("titled").alias("sent_news_title_count_30d"),
        F.max("n").alias("sent_news_daily_peak_30d"),
        _share("sum").alias("sent_sentiment_mean_30d"),
        _spread().alias("sent_sentiment_volatility_30d"),
        F.when(F.sum("scored") > 0, F.sum("bad")).alias("sent_negative_news_count_30d"),
        _share("bad").alias("sent_negative_ratio_30d"),
        F.when(F.sum("bad") > 0, F.max(F.col("bad") / F.col("n"))).alias("sent_negative_peak_30d"),
    )


def post_features(posts: DataFrame, positive: list[str], negative: list[str], as_of: str | None = None) -> DataFrame:
    """Heat and mood of forum posts (company, date, title, read_count, comment_count) in the last 30 days. Shares are of scored posts only."""
    more = {"comments": F.sum("comment_count"), "reads": F.sum("read_count")}
    return _daily(posts, positive, negative, as_of, more).groupBy("company").agg(
        *[_within(n).alias(f"sent_post_count_{n}d") for n in (5, 30)],
        F.coalesce(F.sum("comments"), F.lit(0)).alias("sent_comment_count_30d"),
        F.coalesce(F.sum("reads"), F.lit(0)).alias("sent_read_count_30d"),
        F.max("n").alias("sent_post_daily_peak_30d"),
        _share("sum").alias("sent_guba_sentiment_mean_30d"),
        _spread().alias("sent_guba_sentiment_volatility_30d"),
        _share("good").alias("sent_guba_positive_ratio_30d"),
        _share("bad").alias("sent_guba_negative_ratio_30d"),
    )


def f4_all(news: DataFrame, posts: DataFrame, positive: list[str], negative: list[str], as_of: str | None = None) -> DataFrame:
    """company and the family's 19 features, for companies with news or posts; null where a company has none of a kind."""
    both = news_features(news, positive, negative, as_of).join(post_features(posts, positive, negative, as_of), "company", "full_outer")
    return both.select("company", *F4_FEATURES)


def f5_all(holdings: DataFrame, audits: DataFrame) -> DataFrame:
    """company and the family's 13 features. audits: company and the features of audit reports. The board and signing auditors are not known."""
    both = concentration(holdings).join(audits, "company", "full_outer")
    return both.select("company", *[c if c in both.columns else F.lit(None).cast("double").alias(c) for c in F5_FEATURES])


def concentration(holdings: DataFrame, most: int = 10) -> DataFrame:
    """Ownership of the largest holders of each company: shares of the first, of all, their squares, and gaps."""
    own = Window.partitionBy("company")
    order = own.orderBy(F.desc("shares"), "holder")
    rows = holdings.withColumns({"ratio": F.col("shares") / F.sum("shares").over(own), "rank": F.row_number().over(order)}).where(F.col("rank") <= most)
    first, second = (F.max(F.when(F.col("rank") == k, F.col("ratio"))) for k in (1, 2))
    total = F.sum("ratio")
    return rows.groupBy("company").agg(
        first.alias("gov_top1_holder_ratio"),
        total.alias("gov_top10_holder_ratio"),
        F.sum(F.col("ratio") * F.col("ratio")).alias("gov_top10_hhi"),
        safe_div(first, total).alias("gov_top1_top10_ratio"),
        (first - second).alias("gov_top1_top2_gap"),
        F.count("*").alias("gov_top10_holder_count"),
    )
