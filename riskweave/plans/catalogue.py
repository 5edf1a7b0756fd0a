"""Registered queries of the risk engine over the supplied tables, each with DuckDB SQL for the same rows where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.functions import numeric, text
from riskweave.functions.wording import Wording
from riskweave.operators import inquiry, market, panel, retrieval, scoring, sentiment, text_rules
from riskweave.plans.oracles import ORACLE_SQL
from riskweave.sources import tables
from riskweave.sources.caches import cut

FLAGSHIP = "anomaly_rules"
AS_OF = "1998-06-30"
NEWS_AS_OF = "2024-12-31"

#: A dictionary in Latin script for the supplied documents, which have no Chinese text.
RULES = [
    text_rules.Rule("R01", "A03", 4, ("stupid", "idiot"), ("benchmark",)),
    text_rules.Rule("R02", "D05", 5, ("licen[cs]ed? under",)),
    text_rules.Rule("R03", "G07", 3, (" the the ", " of of "), (" with ",)),
    text_rules.Rule("R04", "G07", 4, ("rights reserved",)),
    text_rules.Rule("R05", "E03", 2, (r"[\w.]+@[\w.]+",)),
]
NEGATIONS = ["is", "was", "no"]
#: Contexts in Latin script that make a hit no event.
WORDING = Wording(
    normative=(("hypothetical_clause", r"\b(?:if|would|might)\b"), ("definition_clause", "(?:means|hereinafter)")),
    accounting="(?:the|of).{0,20}(?:account|policy)",
    accounting_labels="A",
    anchors=(("G07", "the|re", "ing|ed"),),
)
TITLE_OVERRIDES = [("o1", "Licens"), ("o2", "reserved")]
TITLE_EXCLUSIONS = [("routine", "^The"), ("forms", r"[|]"), ("shouting", "!!")]
_POSITIVE, _NEGATIVE = ["purchase", "signup"], ["error"]


#: Digits of features whose sums of squares are large.
_COARSE = {f"f2_{n}": 3 for n in ("roe_volatility", "profit_volatility", "revenue_volatility", "ocf_volatility_4q")} | {f"f2_z_{n}": 5 for n in ("roe", "net_margin", "debt_ratio", "revenue_yoy", "profit_yoy", "pe", "pb")}


def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, counts as bigint: what differs by order of summation or by engine does not matter."""
    def one(name: str, kind: str):
        c = F.col(name)
        return (F.round(c, _COARSE.get(name, digits)) if kind == "double" else c.cast("long") if kind in ("int", "bigint") else c).alias(name)

    return df.select(*[one(n, k) for n, k in df.dtypes])


def _panel(spark, d):
    return tables.fin_panel(spark, d)


def _keys(*more):
    return ["company_code", "report_period", *more]


def f2_profitability(spark, d):
    first = panel.F2_FEATURES.index("f2_roe"), panel.F2_FEATURES.index("f2_high_debt_flag") + 1
    names = [n for n in panel.F2_FEATURES[slice(*first)] if n != "f2_roe_industry_rank"]
    return _rounded(panel.direct(_panel(spark, d)).select(*_keys(*names)))


def f2_all(spark, d):
    """The whole family: 67 features of every company and period."""
    return _rounded(panel.f2_all(panel.with_growth(_panel(spark, d))))


def f2_rank_pct(spark, d):
    return _rounded(panel.profitability(_panel(spark, d)).select(*_keys("industry", "f2_roe_industry_rank")))


def f2_growth(spark, d):
    return _rounded(panel.trends(panel.with_growth(_panel(spark, d))).select(*_keys("revenue_yoy_growth", "net_profit_yoy_growth", "f2_roe_qoq", "f2_revenue_qoq", "f2_profit_qoq", "f2_roe_yoy")))


def f2_streak(spark, d):
    return _rounded(panel.trends(_panel(spark, d)).select(*_keys("f2_roe_decline_streak", "f2_profit_decline_streak", "f2_trend_deterioration")))


def f2_rolling(spark, d):
    out = panel.earnings_quality(panel.trends(_panel(spark, d)))
    return _rounded(out.select(*_keys("f2_roe_volatility", "f2_profit_volatility", "f2_revenue_volatility", "f2_ocf_volatility_4q")))


def f2_slope(spark, d):
    return _rounded(panel.earnings_quality(_panel(spark, d)).select(*_keys("f2_accruals_to_assets", "f2_accruals_trend")))


def f2_quality(spark, d):
    names = ("f2_accruals", "f2_accruals_to_revenue", "f2_ocf_to_assets", "f2_profit_ocf_diverge", "f2_accrual_quality_zscore", "f2_neg_accruals_flag", "f2_ocf_to_profit_extreme")
    return _rounded(panel.earnings_quality(_panel(spark, d)).select(*_keys(*names)))


def f2_zscore(spark, d):
    out = panel.industry_deviation(panel.with_growth(_panel(spark, d)))
    return _rounded(out.select(*_keys("f2_z_roe", "f2_z_net_margin", "f2_z_debt_ratio", "f2_z_revenue_yoy", "f2_z_profit_yoy", "f2_z_pe", "f2_z_pb", "f2_industry_outlier_count")))


def f2_benford(spark, d):
    return _rounded(panel.benford(_panel(spark, d)))


def f2_beneish(spark, d):
    return _rounded(panel.beneish(_panel(spark, d)).select(*_keys("f2_gmi", "f2_sgi", "f2_lvgi", "f2_tata", "f2_beneish_m", "f2_dsri", "f2_aqi", "f2_depi", "f2_sgai")))


def f2_piotroski(spark, d):
    flags = ("roa", "cfo", "droa", "accrual", "dlever", "dmargin", "dturnover", "score", "dliquid", "equity")
    return _rounded(panel.piotroski(_panel(spark, d)).select(*_keys(*[f"f2_p_{n}" for n in flags])))


def _latest_anomalies(spark, d):
    base = cut(_panel(spark, d))
    full = panel.with_benford(panel.with_roe_slope(panel.trends(panel.beneish(base))))
    last = panel.latest(full).join(panel.industry_benchmark(base).select("company_code", "roe_zscore"), "company_code")
    return panel.anomalies(last, ["roe_zscore"])


def anomaly_rules(spark, d):
    out = _latest_anomalies(spark, d)
    kinds = F.array_join(F.transform("anomaly_list", lambda a: a["indicator"]), ",")
    return _rounded(out.select(*_keys(kinds.alias("indicators"), "n_anomalies", "max_severity", "risk_level")))


def roe_trend(spark, d):
    return _rounded(panel.roe_slope(_panel(spark, d)))


def industry_benchmark(spark, d):
    return _rounded(panel.industry_benchmark(_panel(spark, d)))


def mkt_returns(spark, d):
    out = market.returns(tables.market_daily(spark, d), tables.market_index(spark, d))
    return _rounded(out.select("company_code", "trade_date", *[f"mkt_{n}" for n in ("return_5d", "return_20d", "return_60d", "volatility_20d", "volatility_60d", "extreme_down_days_20d", "excess_return_20d")]))


def mkt_drawdown(spark, d):
    return _rounded(market.latest_drawdown(tables.market_daily(spark, d)))


def mkt_liquidity(spark, d):
    out = market.liquidity(tables.market_daily(spark, d))
    return _rounded(out.select("company_code", "trade_date", *[f"mkt_{n}" for n in ("volume_ratio_20d", "amount_ratio_20d", "volume_cv_20d", "amount_cv_20d", "abnormal_volume_days_20d", "zero_volume_days_20d", "amihud_illiquidity_20d", "market_cap_qoq")]))


def _f3(spark, d):
    return market.f3_all(cut(tables.market_daily(spark, d)), tables.market_index(spark, d), tables.quotes(spark, d))


def f3_all(spark, d):
    """The whole family: 35 features of each company's last day."""
    return _rounded(_f3(spark, d))


def _companies(spark, d):
    return tables.table(spark, d, "customer").select(F.col("c_custkey").alias("secucode"))


def f6_history(spark, d):
    return _rounded(inquiry.history(_companies(spark, d), tables.inquiry_events(spark, d), AS_OF))


def _points(spark, d):
    day = F.col("o_orderdate").cast("date")
    return tables.table(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("point_id"), F.col("o_custkey").alias("secucode"), day.alias("t"))


def label_forward(spark, d):
    return _rounded(inquiry.forward_labels(_points(spark, d), tables.inquiry_events(spark, d)))


def split_rate(spark, d):
    labels = inquiry.forward_labels(_points(spark, d), tables.inquiry_events(spark, d)).withColumn("split", F.when(F.year("t") < 1997, "train").when(F.year("t") < 1999, "val").otherwise("test"))
    return _rounded(labels.groupBy("split").agg(F.count("*").alias("rows"), *[F.avg(f"target_{n}d").alias(f"rate_{n}d") for n in (30, 60, 90)]))


def asof_latest(spark, d):
    return _rounded(inquiry.as_of_latest(_panel(spark, d), "company_code", "report_period", 19980701).select(*_keys("roe", "total_revenue")))


def asof_join(spark, d):
    """For every point of a company the latest period of its panel that is not after the point's day."""
    points = _points(spark, d).withColumn("at", F.date_format("t", "yyyyMMdd").cast("int")).withColumn("company_code", F.col("secucode"))
    rows = _panel(spark, d).select(*_keys("roe", "total_revenue"))
    found = inquiry.as_of_join(points, rows, "company_code", "at", "report_period")
    return _rounded(found.where("report_period IS NOT NULL").select("point_id", "secucode", "t", "report_period", "roe", "total_revenue"))


def type_distribution(spark, d):
    return _rounded(inquiry.type_distribution(tables.inquiry_events(spark, d)))


def asof_reply(spark, d):
    return _rounded(inquiry.first_replies(tables.inquiry_events(spark, d)))


def dataset_join(spark, d):
    base = _panel(spark, d)
    skeleton = base.where("report_period % 10000 IN (630, 1231)").select(*_keys())
    families = [panel.trends(base).select(*_keys("f2_roe_qoq", "f2_trend_deterioration")), panel.piotroski(base).select(*_keys("f2_p_score", "f2_p_roa"))]
    return _rounded(inquiry.assemble(skeleton, families, _keys()))


def _policed(spark, d):
    docs = tables.announcements(spark, d)
    return docs.withColumn("analysis_status", text_rules.title_policy(F.col("title"), TITLE_OVERRIDES, TITLE_EXCLUSIONS))


def title_policy(spark, d):
    return _rounded(_policed(spark, d).select("announcement_id", "company", "analysis_status"))


def title_decision(spark, d):
    """The decision on each title with its reason and the pattern that was found."""
    found = text_rules.title_decision(F.col("title"), TITLE_OVERRIDES, TITLE_EXCLUSIONS)
    return tables.announcements(spark, d).select("announcement_id", found.alias("f")).select("announcement_id", "f.*")


def newest_documents(spark, d):
    return _rounded(text_rules.newest(_policed(spark, d), 120).select("company", "announcement_id", "date"))


def _hits(spark, d):
    docs = _policed(spark, d).where("analysis_status = 'analyze'").select("announcement_id", "company", "date", "text")
    return text_rules.rule_hits(docs, RULES, NEGATIONS, wording=WORDING)


def rule_hits(spark, d):
    return _rounded(_hits(spark, d))


def event_dedupe(spark, d):
    return _rounded(text_rules.events(_hits(spark, d)).select("event_key", "announcement_id", "label", "rule_id", "severity"))


def _f1(spark, d):
    found = text_rules.events(_hits(spark, d)).withColumn("evidence_valid", F.col("announcement_id") % 9 != 0)
    return text_rules.windowed_counts(_policed(spark, d), found, NEWS_AS_OF)


def f1_windows(spark, d):
    return _rounded(_f1(spark, d))


def theme_distribution(spark, d):
    return _rounded(text_rules.theme_distribution(text_rules.label_counts(text_rules.events(_hits(spark, d)), NEWS_AS_OF)))


def window_comparison(spark, d):
    return _rounded(text_rules.window_comparison(_f1(spark, d)))


def lexicon_sentiment(spark, d):
    return _rounded(sentiment.news_features(tables.news(spark, d), _POSITIVE, _NEGATIVE))


def f4_all(spark, d):
    """The whole family: 19 features of each company's news and posts."""
    return _rounded(_f4(spark, d))


def _f4(spark, d):
    return sentiment.f4_all(tables.news(spark, d), tables.posts(spark, d), _POSITIVE, _NEGATIVE)


def daily_peak(spark, d):
    rows = sentiment.recent(tables.news(spark, d), 7)
    return _rounded(rows.groupBy("company", "date").count().groupBy("company").agg(F.max("count").alias("daily_peak"), F.sum("count").alias("items")))


def holder_concentration(spark, d):
    return _rounded(sentiment.concentration(tables.holders(spark, d)))


def _f5(spark, d):
    from riskweave.plans import disclosures

    return sentiment.f5_all(tables.holders(spark, d), disclosures.audits(spark, d))


def f5_all(spark, d):
    """The whole family: 13 features of ownership and audit."""
    return _rounded(_f5(spark, d))


def _assembled(spark, d):
    """The latest row of every supplier with the features of all families: the market of its nation, the news of its number's last digits,
    the ownership of the part and the letters of the customer of its number."""
    last = panel.latest(panel.f2_all(panel.with_growth(_panel(spark, d))))
    rows = last.withColumns({"nation": F.col("industry"), "company": F.col("company_code"), "secucode": F.col("company_code"), "feed": F.col("company_code") % 20})
    rows = rows.join(_f3(spark, d).withColumnRenamed("company_code", "nation").drop("trade_date"), "nation", "left")
    rows = rows.join(_f4(spark, d).withColumnRenamed("company", "feed"), "feed", "left").join(_f5(spark, d), "company", "left")
    return rows.join(inquiry.history(_companies(spark, d), tables.inquiry_events(spark, d), AS_OF), "secucode", "left").drop("nation", "feed", "company", "secucode")


def feature_assembly(spark, d):
    """All families side by side for each company: 146 features."""
    return _rounded(_assembled(spark, d))


def _scored(spark, d):
    return scoring.risk_score(_assembled(spark, d))


def risk_score(spark, d):
    joined = lambda c: F.array_join(c, ",")
    counts = F.array_sort(F.transform(F.map_entries("family_counts"), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string"))))
    factors = joined(F.transform("risk_factors", lambda h: h["factor_id"])).alias("factors")
    return _rounded(_scored(spark, d).select(*_keys("risk_score", "n_risk_factors", "risk_level", factors, joined(counts).alias("families"), joined("missing_rules").alias("missing_rules"), "summary")))


def fallback_factors(spark, d):
    found = _latest_anomalies(spark, d).select(F.col("company_code").alias("company"), "anomaly_list")
    events = text_rules.events(_hits(spark, d)).select((F.col("announcement_id") % 100 + 1).alias("company"), "event_key", "label", "severity")
    return _rounded(scoring.fallback_factors(found, events))


def _queries(spark, d, held=True):
    """Every case whose id is divisible by 20 as a query. `held`: of its company, on the hundredth day after its own; else of none and without a day."""
    base = tables.cases(spark, d).where("case_id % 20 = 0")
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("case_id") % 365 + 100).cast("int"))
    none = F.lit(None)
    return base.select(
        F.col("case_id").alias("query_id"), F.col("embedding").alias("query"), "focus_point",
        (F.col("company") if held else none.cast("long")).alias("asking"), (day if held else none.cast("date")).alias("as_of"),
    )


def _labels(rows, *names):
    return rows.select(*names, F.array("focus_point", (F.col("focus_point") + 1) % 10).alias("labels"))


def _label_top(spark, d, held, k):
    return retrieval.label_top(_labels(_queries(spark, d, held), "query_id", "asking", "as_of"), _labels(tables.cases(spark, d), "case_id", "company", "publish_date"), k)


def _fused(spark, d, held):
    return retrieval.fuse({"cosine": retrieval.cosine_top(_queries(spark, d, held), tables.cases(spark, d), 50), "labels": _label_top(spark, d, held, 50)})


def cosine_topk(spark, d, held=True):
    return _rounded(retrieval.cosine_top(_queries(spark, d, held), tables.cases(spark, d), 8))


def label_overlap(spark, d, held=True):
    return _rounded(_label_top(spark, d, held, 8))


def rrf_fusion(spark, d, held=True):
    return _rounded(_fused(spark, d, held))


def cosine_topk_every_20th(spark, d):
    return cosine_topk(spark, d, False)


def label_overlap_every_20th(spark, d):
    return label_overlap(spark, d, False)


def rrf_fusion_every_20th(spark, d):
    return rrf_fusion(spark, d, False)


def chunk_topk(spark, d):
    """The eight nearest paragraphs of other companies that were known on the day, with the first 400 characters of their text."""
    text = tables.table(spark, d, "documents").select(F.col("doc_id").alias("case_id"), F.substring("text", 1, 400).alias("excerpt"))
    return _rounded(cosine_topk(spark, d).withColumnRenamed("case_id", "chunk_id").join(text.withColumnRenamed("case_id", "chunk_id"), "chunk_id", "left"))


def leakage_filter(spark, d):
    base = tables.cases(spark, d)
    kept = base.where(retrieval.not_leaking(F.lit(3), F.lit("2024-06-30").cast("date")))
    return _rounded(kept.groupBy("company").agg(F.count("*").alias("cases"), F.max("publish_date").alias("latest")))


def bigram_hit(spark, d):
    """Neighbouring benchmark items, whole."""
    items = tables.table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query_text"))
    others = items.select((F.col("query_id") - 1).alias("query_id"), F.col("query_text").alias("case_text"))
    return _rounded(retrieval.hit_rate(items.join(others, "query_id")))


def bigram_hit_retrieved(spark, d):
    """Hit rate of the fused top five of every 20th case. A case's text is the document of its id, whole; a case without one hits nothing."""
    docs = tables.table(spark, d, "documents")
    text = lambda key, name: docs.select(F.col("doc_id").alias(key), F.col("text").alias(name))
    pairs = _fused(spark, d, True).join(text("query_id", "query_text"), "query_id", "left").join(text("case_id", "case_text"), "case_id", "left")
    return _rounded(retrieval.hit_rate(pairs.fillna("", ["query_text", "case_text"])))


def _scores(spark, d):
    """A score and a target for every labelled document."""
    docs = tables.table(spark, d, "documents").select("doc_id", "n_chars")
    score = F.round(F.log1p(F.col("n_chars").cast("double")), 1)
    return tables.table(spark, d, "labels").join(docs, "doc_id").select(F.col("doc_id").alias("id"), score.alias("score"), F.col("quality").cast("long").alias("target"))


def ranking_metrics(spark, d):
    return _rounded(scoring.ranking_metrics(_scores(spark, d)))


def top_decile_recall(spark, d):
    return _rounded(scoring.top_share_recall(_scores(spark, d)))


def best_threshold(spark, d):
    return _rounded(scoring.best_f1(_scores(spark, d)))


def risk_band(spark, d):
    return _rounded(scoring.risk_bands(_scores(spark, d)))


def evidence_bind(spark, d):
    rows = _latest_anomalies(spark, d).select("company_code", F.posexplode("anomaly_list").alias("pos", "a"))
    pool = rows.select(F.col("company_code").alias("company"), F.concat(F.lit("fin_"), F.lpad((F.col("pos") + 1).cast("string"), 3, "0")).alias("evidence_id"), F.col("pos").alias("ordinal"), F.col("a.indicator").alias("indicator"), F.when(F.col("a.severity") >= 4, "grave").otherwise("light").alias("label_ref"))
    factors = rows.select(F.col("company_code").alias("company"), F.explode(F.array(F.lit("roe"), F.lit("debt_to_assets_ratio"), F.lit("other"))).alias("indicator")).distinct()
    factors = factors.withColumns({"factor_id": F.concat_ws(":", F.col("company").cast("string"), "indicator"), "label_ref": F.when(F.col("indicator") == "other", "grave").otherwise("none")})
    return _rounded(scoring.bind_evidence(factors, pool).select("company", "factor_id", "evidence_id"))


def citation_check(spark, d):
    said = F.concat(F.lit("see fin_"), F.lpad((F.col("case_id") % 4).cast("string"), 3, "0"), F.lit(", sem_001问询fin_002 and fin_0033"))
    pool = F.array(*map(F.lit, ("fin_001", "fin_002", "sem_001")))
    found = scoring.check_citations(said, pool)
    joined = lambda c: F.array_join(F.array_sort(c), ",")
    return _rounded(tables.cases(spark, d).select("case_id", joined(found["cited"]).alias("cited"), joined(found["unknown"]).alias("unknown")))


def company_codes(spark, d):
    raw = F.concat(F.lit("no. "), F.lpad((F.col("c_custkey") * 7919 % 1000000).cast("string"), 6, "0"), F.lit(" x"))
    code = text.stock_code(raw)
    return _rounded(tables.table(spark, d, "customer").select("c_custkey", code.alias("code"), text.market(code).alias("market"), text.company_code(code).alias("company_code")))


def bigram_buckets(spark, d):
    rows = tables.table(spark, d, "benchmark").select("item_id", F.explode(numeric.bigrams(F.col("text"))).alias("gram"))
    return _rounded(rows.groupBy("item_id", numeric.bigram_bucket(F.col("gram")).alias("bucket")).agg(F.count("*").alias("tf")))


def bigram_embedding(spark, d):
    """Weights of each item's hashed bigrams, of length one in all."""
    return _rounded(retrieval.hashed_embedding(tables.table(spark, d, "benchmark"), "item_id", "text"))


def unit_vectors(spark, d):
    rows = tables.cases(spark, d).select("case_id", F.posexplode(numeric.unit_vector(F.col("embedding"))).alias("pos", "x"))
    return _rounded(rows)


def _training_rows(spark, d):
    """Every quarter of every supplier with the financial family's 67 features, whether the customer of its number gets a letter within 30, 60 and 90 days of
    the quarter's end, and the split by year."""
    rows = panel.f2_all(panel.with_growth(_panel(spark, d)))
    rows = rows.withColumns({"secucode": F.col("company_code"), "t": F.to_date(F.col("report_period").cast("string"), "yyyyMMdd"), "point_id": F.concat_ws(":", F.col("company_code").cast("string"), F.col("report_period").cast("string"))})
    labels = inquiry.forward_labels(rows.select("point_id", "secucode", "t"), tables.inquiry_events(spark, d)).select("point_id", *[f"target_{n}d" for n in (30, 60, 90)])
    split = F.when(F.year("t") < 1996, "train").when(F.year("t") < 1997, "val").otherwise("test")
    return rows.join(labels, "point_id").withColumn("split", split)


def model_ensemble(spark, d):
    """For the quarters from 1997 on the probability of a letter in three horizons by models of the years before 1996, with thresholds from 1996, and what
    each prediction rests on. The models are smaller than the defaults (see README)."""
    from riskweave.operators import modeling

    rows = cut(_training_rows(spark, d))
    targets = [f"target_{n}d" for n in (30, 60, 90)]
    models = modeling.train_horizons(rows, panel.F2_FEATURES, targets, "point_id", modeling.Sizes(trees=40, depth=6, rounds=4, screening=2, rate=0.1))
    out = None
    for target, model in models.items():
        found = modeling.explain(modeling.probabilities(rows.where("split = 'test'"), model), model)
        names = F.array_join(F.transform("contributions", lambda c: c["name"]), ",").alias("factors")
        part = found.select("company_code", "report_period", F.lit(target).alias("horizon"), F.col(target).alias("target"), *modeling.LEGS, "probability", "positive", "level", "confidence", names)
        out = part if out is None else out.unionByName(part)
    return out


QUERIES = {
    f.__name__: f
    for f in (
        f2_all, f3_all, f4_all, f5_all, feature_assembly, fallback_factors, title_decision, asof_join, type_distribution, chunk_topk, bigram_embedding, unit_vectors,
        f2_profitability, f2_rank_pct, f2_growth, f2_streak, f2_rolling, f2_slope, f2_quality, f2_zscore, f2_benford, f2_beneish, f2_piotroski,
        anomaly_rules, roe_trend, industry_benchmark, mkt_returns, mkt_drawdown, mkt_liquidity, f6_history, label_forward, split_rate,
        asof_latest, asof_reply, dataset_join, title_policy, newest_documents, rule_hits, event_dedupe, f1_windows, theme_distribution,
        window_comparison, lexicon_sentiment, daily_peak, holder_concentration, risk_score, cosine_topk, label_overlap, rrf_fusion,
        cosine_topk_every_20th, label_overlap_every_20th, rrf_fusion_every_20th,
        leakage_filter, bigram_hit, bigram_hit_retrieved, ranking_metrics, top_decile_recall, best_threshold, risk_band, evidence_bind, citation_check,
        company_codes, bigram_buckets, model_ensemble,
    )
}
