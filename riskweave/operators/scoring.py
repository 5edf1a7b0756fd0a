"""Risk scores by a rule table, model metrics, bands, and evidence bound to factors."""

from __future__ import annotations

import operator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskweave.functions.numeric import safe_div
from riskweave.functions.text import evidence_ids
from riskweave.functions.wording import FEATURE_LABELS
from riskweave.operators.ranking import running, value_ranks

#: (feature, family, severity, operator, threshold). Fixed values.
RULES = [
    ("f2_loss_flag", "F2", "高", "==", 1.0), ("f2_high_debt_flag", "F2", "中", "==", 1.0), ("f2_roe", "F2", "高", "<", 0.0),
    ("f2_profit_ocf_diverge", "F2", "高", "==", 1.0), ("f2_neg_accruals_flag", "F2", "中", "==", 1.0), ("f2_beneish_m", "F2", "高", ">", -2.22),
    ("f2_benford_flag", "F2", "中", "==", 1.0), ("f2_p_score", "F2", "中", "<=", 2.0),
    ("mkt_risk_warning_flag_30d", "F3", "高", "==", 1.0), ("mkt_risk_warning_count_30d", "F3", "中", ">", 0.0), ("mkt_return_20d", "F3", "中", "<", -0.2),
    ("sent_negative_ratio_30d", "F4", "中", ">", 0.5), ("sent_sentiment_mean_30d", "F4", "中", "<", 0.0),
    ("sent_negative_news_count_30d", "F4", "中", ">=", 3.0), ("sent_guba_negative_ratio_30d", "F4", "低", ">", 0.5),
    ("gov_nonstandard_audit_opinion", "F5", "高", "==", 1.0), ("gov_audit_firm_change", "F5", "中", "==", 1.0),
    ("gov_auditor_change", "F5", "中", "==", 1.0), ("gov_top1_holder_ratio", "F5", "低", ">", 0.5),
    ("f6_inquiry_count_12m", "F6", "高", ">", 0.0), ("f6_unreplied_count", "F6", "高", ">", 0.0),
    ("f6_attention_letter_count", "F6", "中", ">", 0.0), ("f6_severity_score", "F6", "中", ">=", 0.5),
]
WEIGHTS = {"高": 3, "中": 2, "低": 1}
#: Shares of the ranking, right-closed, and their bands. Fixed values.
BANDS = ((0.05, "A"), (0.15, "B"), (0.30, "C"), (0.50, "D"), (0.70, "E"), (1.0, "F"))

_COMPARE = {"==": operator.eq, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}


def _of(family: str):
    return lambda h: h["family"] == family


def risk_score(features: DataFrame, rules=RULES) -> DataFrame:
    """features with the rules that hold (risk_factors: gravest first, then by family and name), how many, how many by family
    (family_counts), the score, its level and a summary line. A rule whose feature is null does not hold; `missing_rules` names the rules
    whose feature is no column at all."""
    order = list(WEIGHTS)
    hits, missing = [], []
    for name, family, severity, op, threshold in rules:
        if name not in features.columns:
            missing.append(name)
            continue
        value = F.col(name).cast("double")
        one = F.struct(F.lit(order.index(severity)).alias("order"), F.lit(family).alias("family"), F.lit(name).alias("factor_id"), F.lit(severity).alias("severity"), value.alias("value"), F.lit(WEIGHTS[severity]).alias("weight"))
        hits.append(F.when(F.coalesce(_COMPARE[op](value, F.lit(threshold)), F.lit(False)), one))
    held = F.array_sort(F.filter(F.array(*hits), lambda h: h.isNotNull())) if hits else F.array().cast("array<struct<order:int,family:string,factor_id:string,severity:string,value:double,weight:int>>")
    out = features.withColumn("risk_factors", held)
    score = F.aggregate("risk_factors", F.lit(0), lambda s, h: s + h["weight"])
    families = sorted({f for _, f, *_ in rules})
    counted = F.array(*[F.struct(F.lit(f).alias("family"), F.size(F.filter("risk_factors", _of(f))).alias("n")) for f in families])
    counts = F.map_from_entries(F.filter(counted, lambda c: c["n"] > 0))
    # Families by falling number, then by name.
    sorted_ = F.array_sort(F.transform(F.map_entries("family_counts"), lambda e: F.struct((-e["value"]).alias("order"), e["key"].alias("family"))))
    said = F.array_join(F.transform(sorted_, lambda e: F.concat(e["family"], F.lit("("), (-e["order"]).cast("string"), F.lit(")"))), ", ")
    out = out.withColumns({"risk_score": score, "n_risk_factors": F.size("risk_factors"), "family_counts": counts, "missing_rules": F.array(*map(F.lit, missing)).cast("array<string>")})
    out = out.withColumn("risk_level", F.when(F.col("risk_score") >= 12, "高").when(F.col("risk_score") >= 6, "中").otherwise("低"))
    some = F.concat(F.lit("风险等级 "), F.col("risk_level"), F.lit("，触发规则 "), F.col("n_risk_factors").cast("string"), F.lit(" 条："), said)
    return out.withColumn("summary", F.when(F.col("n_risk_factors") > 0, some).otherwise(F.concat(F.lit("风险等级 "), F.col("risk_level"), F.lit("，没有触发规则"))))


def fallback_factors(anomalies: DataFrame, risks: DataFrame, k: int = 5) -> DataFrame:
    """Factors without a model: of each company the k gravest anomalies (in their order) and the k gravest events, named by their label.

    anomalies: company, anomaly_list array<struct<indicator,severity,...>>; risks: company, event_key, label, severity."""
    known = F.create_map(*[F.lit(x) for name, (_, label) in FEATURE_LABELS.items() for x in (name, label)])
    listed = anomalies.select("company", F.posexplode("anomaly_list").alias("pos", "a"))
    grave = Window.partitionBy("company").orderBy(F.desc("a.severity"), "pos")
    first = listed.withColumn("place", F.row_number().over(grave)).where(F.col("place") <= k)
    first = first.select("company", F.lit("financial").alias("source"), "place", F.col("a.indicator").alias("feature"), F.coalesce(F.try_element_at(known, F.col("a.indicator")), F.lit("综合")).alias("label_ref"), F.col("a.severity").alias("severity"))
    worst = Window.partitionBy("company").orderBy(F.desc("severity"), "event_key")
    second = risks.withColumn("place", F.row_number().over(worst)).where(F.col("place") <= k)
    second = second.select("company", F.lit("semantic").alias("source"), "place", F.concat(F.lit("label_"), "label").alias("feature"), F.col("label").alias("label_ref"), "severity")
    return first.unionByName(second)


def _counted(scores: DataFrame, parts: int = 32) -> DataFrame:
    """By distinct score: positives and rows of it (pos, n), and of it and those above (tp, rows; tp_all, rows_all)."""
    by = scores.groupBy("score").agg(F.sum("target").alias("pos"), F.count("*").alias("n"))
    return running(by, {"tp": F.col("pos"), "rows": F.col("n")}, [F.desc("score")], parts)


def ranking_metrics(scores: DataFrame) -> DataFrame:
    """AUC (ties count half) and step-wise average precision of score and target (0 or 1)."""
    c = F.col
    won = F.sum((c("n") - c("pos")) * (c("tp") - c("pos") + c("pos") / F.lit(2.0)))
    precision = F.sum(c("pos") * c("tp") / c("rows"))
    pairs = F.max(c("tp_all") * (c("rows_all") - c("tp_all"))).cast("double")
    return _counted(scores).agg(F.try_divide(won, pairs).alias("auc"), F.try_divide(precision, F.max("tp_all").cast("double")).alias("average_precision"), F.max("tp_all").alias("positives"), F.max("rows_all").alias("rows"))


def rank_correlations(rows: DataFrame, features: list[str], target: str, parts: int = 32) -> DataFrame:
    """feature, n and Spearman's rho (ties get average ranks) against a target of 0 and 1, over the rows that have both.

    All features go in one pass in long form, and no task sorts a whole feature (see value_ranks)."""
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("x")) for f in features]))
    long = rows.select(F.col(target).cast("double").alias("y"), pairs.alias("p")).select("y", "p.*").where("y IS NOT NULL")
    ranked = value_ranks(long, ["feature"], "x", {"pos": F.col("y")}, ["feature"], parts)
    centred = F.col("below") + (F.col("n") + 1) / F.lit(2.0) - (F.col("all") + 1) / F.lit(2.0)
    sums = ranked.withColumn("r", centred).groupBy("feature").agg(
        F.sum("n").alias("n"), F.sum("pos").alias("p"), F.sum(F.col("pos") * F.col("r")).alias("both"), F.sum(F.col("n") * F.col("r") * F.col("r")).alias("squares")
    )
    spread = F.sqrt(F.col("squares") * (F.col("p") - F.col("p") * F.col("p") / F.col("n")))
    return sums.select("feature", "n", safe_div(F.col("both"), spread).alias("rho"))


def strongest(rows: DataFrame, features: list[str], target: str, k: int = 50) -> DataFrame:
    """The k features of the largest absolute rank correlation, ties by name."""
    return rank_correlations(rows, features, target).where("rho IS NOT NULL").orderBy(F.abs("rho").desc(), "feature").limit(k)


def top_share_recall(scores: DataFrame, share: float = 0.1, id_col: str = "id") -> DataFrame:
    """Of all positives, those among the highest scores (that share of the rows, one at least; ties by id)."""
    n = scores.agg(F.count("*").alias("n"), F.sum("target").alias("p")).first()
    k = max(1, int((n["n"] or 0) * share))
    ranked = scores.withColumn("score", F.coalesce(F.col("score").cast("double"), F.lit(float("-inf"))))  # rows without a score come last
    top = running(ranked, {"place": F.lit(1)}, [F.desc("score"), F.asc(id_col)], 32, id_col).where(F.col("place") <= k)
    return top.agg(F.lit(k).cast("long").alias("k"), F.sum("target").alias("hits"), (F.sum("target") / F.lit(max(n["p"] or 0, 1))).alias("recall"))


def best_f1(scores: DataFrame) -> DataFrame:
    """The score from which on calling rows positive gives the largest F1 (the highest such score)."""
    c = F.col
    rows = _counted(scores).select(
        c("score").alias("threshold"),
        F.try_divide(F.lit(2.0) * c("tp"), (c("rows") + c("tp_all")).cast("double")).alias("f1"),
        (c("tp") / c("rows")).alias("precision"),
        F.try_divide(c("tp").cast("double"), c("tp_all").cast("double")).alias("recall"),
    )
    return rows.orderBy(F.desc("f1"), F.desc("threshold")).limit(1)


def risk_bands(scores: DataFrame, id_col: str = "id", parts: int = 32) -> DataFrame:
    """Rank by score (ties by id) and its band by share of all rows."""
    rows = running(scores, {"risk_rank": F.lit(1)}, [F.desc("score"), F.asc(id_col)], parts, id_col)
    band = F.when(F.lit(False), "")
    for share, name in BANDS:
        band = band.when(F.col("risk_rank") <= F.lit(share) * F.col("risk_rank_all"), name)
    return rows.select(id_col, "score", F.col("risk_rank").cast("long").alias("risk_rank"), band.alias("risk_band"))


def ensemble(legs: dict[str, float]) -> Column:
    """Weighted sum of probability columns; a missing leg counts as 0 and is not made up for."""
    return sum(F.coalesce(F.col(c), F.lit(0.0)) * w for c, w in legs.items())


def top_contributions(values: Column, k: int = 5, least: float = 0.05) -> Column:
    """The k largest by absolute value of array<struct<name,value>>, those of `least` and more."""
    kept = F.filter(values, lambda v: F.abs(v["value"]) >= least)
    keyed = F.transform(kept, lambda v: F.struct((-F.abs(v["value"])).alias("order"), v["name"].alias("name"), v["value"].alias("value")))
    return F.transform(F.slice(F.array_sort(keyed), 1, k), lambda v: F.struct(v["name"].alias("name"), v["value"].alias("value")))


def bind_evidence(factors: DataFrame, pool: DataFrame) -> DataFrame:
    """Factors (company, factor_id, indicator, label_ref) with the first evidence (by ordinal) of equal indicator, else of equal label; others go."""
    first = lambda key: pool.where(F.col(key).isNotNull()).groupBy("company", key).agg(F.min_by("evidence_id", "ordinal").alias(f"by_{key}"))
    rows = factors.join(first("indicator"), ["company", "indicator"], "left").join(first("label_ref"), ["company", "label_ref"], "left")
    return rows.withColumn("evidence_id", F.coalesce("by_indicator", "by_label_ref")).where("evidence_id IS NOT NULL").drop("by_indicator", "by_label_ref")


def check_citations(text: Column, pool: Column) -> dict[str, Column]:
    """Ids that a text cites: those in the pool, and those that are made up."""
    cited = F.array_distinct(evidence_ids(text))
    return {"cited": F.array_intersect(cited, pool), "unknown": F.array_except(cited, pool)}
