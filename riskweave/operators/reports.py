"""Reports of all companies at once, as JSON and as Markdown, and one line per company for a batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _lines(items: Column, line, empty: str) -> Column:
    return F.when(F.size(items) > 0, F.array_join(F.transform(items, line), "\n")).otherwise(empty)


def _stars(severity: Column, of: int = 5) -> Column:
    return F.concat(F.repeat(F.lit("●"), severity), F.repeat(F.lit("○"), F.lit(of) - severity))


def company_reports(findings: DataFrame, scores: DataFrame, cases: DataFrame | None = None, as_of: str = "") -> DataFrame:
    """company_code, report_json and report_md.

    findings: company_code, anomaly_list array<struct<indicator,severity,...>>; scores: company_code, risk_score, risk_level,
    risk_factors array<struct<factor_id,severity,value,...>>; cases, if given: company_code, similar_cases array<struct<case_id,similarity>>.
    A company that one side lacks has an empty section.
    """
    rows = scores.select("company_code", "risk_score", "risk_level", "risk_factors").join(findings.select("company_code", "anomaly_list"), "company_code", "full_outer")
    if cases is not None:
        rows = rows.join(cases.select("company_code", "similar_cases"), "company_code", "left")
    else:
        rows = rows.withColumn("similar_cases", F.array().cast("array<struct<case_id:string,similarity:double>>"))
    anomalies, factors, similar = F.col("anomaly_list"), F.col("risk_factors"), F.col("similar_cases")
    body = F.struct(
        F.col("company_code").alias("company"),
        F.lit(as_of).alias("as_of"),
        F.struct("risk_score", "risk_level").alias("prediction"),
        F.struct(F.coalesce(F.size(anomalies), F.lit(0)).alias("anomaly_count"), anomalies.alias("anomaly_list")).alias("financial"),
        F.struct(factors.alias("top_risk_factors")).alias("attribution"),
        similar.alias("similar_cases"),
    )
    text = F.concat_ws(
        "\n",
        F.concat(F.lit("# 监管问询风险报告 "), F.col("company_code").cast("string")),
        F.lit(f"- 时点：{as_of}"),
        F.concat(F.lit("- 风险等级："), F.coalesce("risk_level", F.lit("—")), F.lit(" ｜ 得分："), F.coalesce(F.col("risk_score").cast("string"), F.lit("—"))),
        F.lit("## 财务异常"),
        _lines(anomalies, lambda a: F.concat(F.lit("- ["), a["indicator"], F.lit("] "), _stars(a["severity"])), "- 无"),
        F.lit("## 风险诱因"),
        _lines(factors, lambda f: F.concat(F.lit("- "), f["severity"], F.lit(" "), f["factor_id"]), "- 无"),
        F.lit("## 相似案例"),
        _lines(similar, lambda c: F.concat(F.lit("- "), c["case_id"].cast("string"), F.lit(" "), F.round(c["similarity"], 4).cast("string")), "- 无"),
    )
    return rows.select("company_code", F.to_json(body).alias("report_json"), text.alias("report_md"))


def batch_summary(findings: DataFrame, scores: DataFrame) -> DataFrame:
    """One row per company: score, levels, how many anomalies and factors, the gravest."""
    a = findings.select("company_code", "n_anomalies", "max_severity", F.col("risk_level").alias("financial_level"))
    s = scores.select("company_code", "report_period", "risk_score", "risk_level", "n_risk_factors")
    return s.join(a, "company_code", "left").fillna(0, ["n_anomalies", "max_severity"])


def batch_line(summary: DataFrame, names: DataFrame, window: str, counted: dict[str, DataFrame], predictions: DataFrame) -> DataFrame:
    """The whole line of each company in a batch: batch_summary with its name, the window, a column for each of `counted` (how many of these rows, by company_code, it has:
    announcements, similar cases, attribution factors, steps of the trace) and the probability; 0 and null without."""
    out = summary.join(names.select("company_code", "name"), "company_code", "left").withColumn("window_name", F.lit(window))
    for name, rows in counted.items():
        out = out.join(rows.groupBy("company_code").agg(F.count("*").alias(name)), "company_code", "left").fillna(0, [name])
    return out.join(predictions.select("company_code", F.col("probability").alias("prediction")), "company_code", "left")
