"""Audit features from annual reports, and the state of documents whose pages are recognised."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskweave.functions import disclosure


def audit_features(reports: DataFrame) -> DataFrame:
    """By company: opinion, whether one of the four large firms audits, and whether the firm changed since the report before.

    reports: company, year, path, text; several texts a year are tried for the best (a ticked box, then an auditor's name, then Chinese).
    Texts are read where they lie; only the findings are shuffled.
    """
    text = F.col("text")
    worth = F.when(F.contains(text, F.lit("非标准审计意见提示")), 100).otherwise(0) + F.when(F.contains(text, F.lit("会计师事务所")), 10).otherwise(0)
    worth = worth + F.when(text.rlike("[一-鿿]"), 1).otherwise(0)
    read = reports.where(F.length("text") > 0).select("company", "year", "path", worth.alias("worth"), disclosure.audit_opinion(text).alias("opinion"), disclosure.audit_firm(text).alias("firm"))
    best = read.groupBy("company", "year").agg(F.min_by(F.struct("opinion", "firm"), F.struct(-F.col("worth"), "path")).alias("found"))
    years = Window.partitionBy("company").orderBy("year")
    firm, earlier = F.col("found.firm"), F.lag("found.firm").over(years)
    rows = best.withColumns({"earlier": earlier, "__n": F.row_number().over(Window.partitionBy("company").orderBy(F.desc("year")))}).where("__n = 1")
    return rows.select(
        "company",
        "year",
        F.col("found.opinion").cast("double").alias("gov_nonstandard_audit_opinion"),
        F.when(firm != "", firm.rlike(disclosure.BIG_FOUR).cast("double")).alias("gov_big4_auditor"),
        F.when((firm != "") & (F.col("earlier") != ""), (firm != F.col("earlier")).cast("double")).alias("gov_audit_firm_change"),
    )


def page_summary(pages: DataFrame, least_chars: int = 20) -> DataFrame:
    """By document: pages, those that need recognition (fewer meaningful characters than that), how these ended, and a status.

    pages: document, page, text, action (null, skipped, succeeded or failed).
    """
    needs = F.coalesce(disclosure.meaningful_chars(F.col("text")), F.lit(0)) < least_chars
    ended = lambda s: F.count_if(needs & (F.col("action") == s))
    sums = pages.groupBy("document").agg(
        F.count("*").alias("pages"), F.count_if(needs).alias("candidates"), *[ended(s).alias(s) for s in ("skipped", "succeeded", "failed")]
    )
    return sums.withColumn("status", disclosure.ocr_status(*[F.col(c) for c in ("candidates", "skipped", "succeeded", "failed")]))
