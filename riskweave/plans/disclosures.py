"""Registered queries of the document side: texts are made from the tables' keys, so that SQL can say from the keys what must be read in them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.functions import disclosure
from riskweave.operators import governance, linking, reports, retrieval, scoring, sentiment
from riskweave.plans import catalogue
from riskweave.plans.catalogue import _rounded
from riskweave.plans.oracles import _COS, _COUNTS, _KEYS, _NEWS, _PANEL, _RISK_LIST, _TEXT, _cos, _i, _none, _r, _recent
from riskweave.sources import tables

_DIGITS = "〇一二三四五六七八九"


def _han(n: int) -> str:
    tens, ones = divmod(n, 10)
    return _DIGITS[n] if n < 10 else ("" if tens == 1 else _DIGITS[tens]) + "十" + (_DIGITS[ones] if ones else "")


def _pick(names, i):
    """The i-th of a few names, from 0."""
    return F.element_at(F.array(*map(F.lit, names)), (i + 1).cast("int"))


def filing_dates(spark, d) -> DataFrame:
    k = F.col("o_orderkey")
    month, day = k % 12 + 1, k % 28 + 1
    arabic = F.concat(F.lit("公告编号：2024-"), F.lpad((k % 1000).cast("string"), 3, "0"), F.lit(" 见2023年1月5日公告。2024年"), month, F.lit(" 月"), day, F.lit("日，另见2025-01-02"))
    han = F.concat(F.lit("董事会 二〇二一年"), _pick([_han(i) for i in range(1, 13)], k % 12), F.lit("月"), _pick([_han(i) for i in range(1, 29)], k % 28), F.lit("日"))
    text = F.when(k % 4 == 0, arabic).when(k % 4 == 1, han).when(k % 4 == 2, F.lit("没有日期")).otherwise(F.lit("2024/13/45 及 2021.3.9 与 2023-02-30"))
    found = disclosure.filing_date(text, F.lit(2022))
    letter = disclosure.inquiry_date(F.concat(text, F.lit(" 20 23年"), month, F.lit("月"), F.when(k % 5 == 0, F.lit(40)).otherwise(day), F.lit("日")))
    return tables.table(spark, d, "orders").select(k, found.alias("filed"), letter.alias("asked"))


def inquiry_kinds(spark, d) -> DataFrame:
    k = F.col("o_orderkey")
    texts = ["关于对公司年 报的问询函", "重大资产重组 预案", "关 注函", "半年报问询", "一季报问询", "半年度报告问询函", "许可类重组问询", "其他"]
    text = _pick(texts, k % 8)
    return tables.table(spark, d, "orders").select(k, disclosure.event_type(text).alias("event_type"), disclosure.case_type(text, F.lit("请说明")).alias("case_type"))


def audit_reports(spark, d) -> DataFrame:
    return _rounded(audits(spark, d))


def audits(spark, d) -> DataFrame:
    """Audit features of suppliers from texts for three years, two for each."""
    year, copy = F.explode(F.sequence(F.lit(2021), F.lit(2023))).alias("year"), F.explode(F.array(F.lit(0), F.lit(1))).alias("copy")
    rows = tables.table(spark, d, "supplier").select(F.col("s_suppkey").alias("company"), year).select("company", "year", copy)
    k = F.col("company") + F.col("year")
    firm = _pick(["普华永道中天", "立信", "天健"], F.floor(k / 2) % 3)
    said = _pick(["非标准审计意见提示 □适用 ☑不适用", "非标准审计意见提示 √适用 □不适用", "出具了标准无保留意见", "出具了保留意见", "没有意见"], k % 5)
    text = F.when(F.col("copy") == 0, "annual report").otherwise(F.concat(said, F.lit("，"), firm, F.lit("会计师事务所")))
    return governance.audit_features(rows.withColumns({"path": F.col("copy").cast("string"), "text": text}))


def page_states(spark, d) -> DataFrame:
    line = F.col("l_linenumber")
    pages = tables.table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("document"),
        line.alias("page"),
        F.when(F.col("l_returnflag") == "N", "a page with text enough to be read").otherwise("……").alias("text"),
        F.when(F.col("l_orderkey") % 7 == 0, "skipped").when(line % 3 == 0, "failed").otherwise("succeeded").alias("action"),
    )
    return _rounded(governance.page_summary(pages))


_CONTEXTS = [
    ("G07", "前文。公司收到中国证监会立案调查通知书。后文", ""),
    ("G07", "前文。如发生立案调查事项，另行公告。", "conditional_or_hypothetical_clause"),
    ("G07", "前文。关于立案调查的说明。", "missing_event_anchors"),
    ("C01", "前文。公司会计政策：立案调查。", "accounting_policy_or_table"),
    ("D05", "前文。候选人因立案调查不得任职。", "governance_eligibility_clause"),
    ("E03", "前文。控股股东占用资金，立案调查。", ""),
]


def context_suppression(spark, d) -> DataFrame:
    k = F.col("o_orderkey") % len(_CONTEXTS)
    label, text = _pick([c[0] for c in _CONTEXTS], k), _pick([c[1] for c in _CONTEXTS], k)
    near = disclosure.nearby(text, F.locate("立案调查", text), F.lit(4))
    return tables.table(spark, d, "orders").select("o_orderkey", disclosure.suppression_reason(label, near).alias("reason"), near.alias("context"))


def rule_summary(spark, d) -> DataFrame:
    from riskweave.operators import text_rules

    out = text_rules.rule_summary(catalogue._hits(spark, d))
    return _rounded(out.withColumn("labels", F.array_join("labels", ",")))


def channel_merge(spark, d) -> DataFrame:
    from riskweave.functions.text import event_key
    from riskweave.operators import text_rules

    rules = text_rules.events(catalogue._hits(spark, d)).select("event_key", "announcement_id", "label", "rule_id")
    label = F.when(F.col("announcement_id") % 2 == 0, "G07").otherwise("A03")
    model = tables.announcements(spark, d).where("announcement_id % 3 = 0").select("announcement_id", label.alias("label"))
    model = model.select(event_key(F.col("announcement_id").cast("string"), F.col("label")).alias("event_key"), "announcement_id", "label").distinct()
    return linking.merge_channels(rules, model).select("event_key", "announcement_id", "label", "rule_id", "channel", "agrees")


def forum_features(spark, d) -> DataFrame:
    return _rounded(sentiment.post_features(tables.posts(spark, d), catalogue._POSITIVE, catalogue._NEGATIVE))


def label_keywords(spark, d) -> DataFrame:
    base = spark.createDataFrame([("l0", ["zero"]), ("l1", ["one", "uno"]), ("l2", [])], "label string, keywords array<string>")
    better = spark.createDataFrame([("l1", ["eins"])], "label string, keywords array<string>")
    labels = tables.cases(spark, d).select(F.col("case_id").alias("id"), F.explode(F.array(F.concat(F.lit("l"), (F.col("case_id") % 4).cast("string")), F.when(F.col("case_id") % 5 == 0, "商誉").otherwise(""))).alias("label"))
    return linking.expand_labels(labels, [base, better]).select("id", F.array_join("keywords", ",").alias("keywords"))


def case_links(spark, d, held=True) -> DataFrame:
    queries = catalogue._queries(spark, d, held)
    base = tables.cases(spark, d).select("case_id", F.array(F.concat(F.lit("w"), F.col("focus_point").cast("string")), F.concat(F.lit("v"), (F.col("case_id") % 3).cast("string"))).alias("topics"))
    near = retrieval.cosine_top(queries, tables.cases(spark, d), 50)
    found = near.join(base, "case_id").select(F.col("query_id").alias("id"), "case_id", "topics", F.col("score").alias("similarity"))
    wanted = queries.select(F.col("query_id").alias("id"), F.array(F.concat(F.lit("w"), F.col("focus_point").cast("string")), F.lit("v1"), F.lit("")).alias("keywords"))
    return _rounded(linking.link_cases(wanted, found))


def case_links_every_20th(spark, d) -> DataFrame:
    return case_links(spark, d, False)


def letter_focus(spark, d) -> DataFrame:
    k = F.col("o_orderkey")
    orders = tables.table(spark, d, "orders").select(k.alias("doc_id"), (k % 97).alias("stock_code"), F.col("o_orderdate").cast("date").alias("publish_date"))
    official = orders.where("doc_id % 3 = 0").select("stock_code", "publish_date", F.col("doc_id").alias("pos"), F.concat(F.lit('["p'), F.col("doc_id").cast("string"), F.lit('"]')).alias("points"))
    rules = orders.where("doc_id % 2 = 0").select("doc_id", F.explode(F.array(F.lit(2), F.lit(0), F.lit(1))).alias("pos")).withColumn("category", _pick(["b", "a", "b"], F.col("pos")))
    return linking.focus_points(orders, official, rules).select("doc_id", F.array_join("focus_points", ",").alias("focus_points"))


def mean_vectors(spark, d) -> DataFrame:
    means = linking.mean_vector(tables.cases(spark, d), "focus_point")
    return _rounded(means.select("focus_point", F.posexplode("mean").alias("pos", "mean")))


def spearman_top(spark, d) -> DataFrame:
    rows = catalogue._panel(spark, d).withColumn("y", (F.col("industry") < 12).cast("int"))
    return _rounded(scoring.strongest(rows, ["roe", "debt_to_assets_ratio", "total_revenue", "market_cap", "pe_ratio"], "y", 3))


def batch_summary(spark, d) -> DataFrame:
    found, scores = _found(spark, d)
    return _rounded(reports.batch_summary(found, scores))


def _found(spark, d):
    return catalogue._latest_anomalies(spark, d), catalogue._scored(spark, d)


def company_report(spark, d) -> DataFrame:
    found, scores = _found(spark, d)
    return reports.company_reports(found, scores, as_of=catalogue.AS_OF)


QUERIES = {
    f.__name__: f
    for f in (
        filing_dates, inquiry_kinds, audit_reports, page_states, context_suppression, rule_summary, channel_merge, forum_features, label_keywords,
        case_links, case_links_every_20th, letter_focus, mean_vectors, spearman_top, batch_summary, company_report,
    )
}

_AVERAGE_RANK = "rank() OVER (PARTITION BY f ORDER BY x) + (count(*) OVER (PARTITION BY f, x) - 1) / 2.0"

ORACLE_SQL = {
    "filing_dates": "SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN make_date(2024, o_orderkey % 12 + 1, o_orderkey % 28 + 1) WHEN 1 THEN make_date(2021, o_orderkey % 12 + 1, o_orderkey % 28 + 1) WHEN 2 THEN DATE '2022-01-01' ELSE DATE '2021-03-09' END AS filed, CASE WHEN o_orderkey % 5 <> 0 THEN make_date(2023, o_orderkey % 12 + 1, o_orderkey % 28 + 1) END AS asked FROM orders",
    "inquiry_kinds": "SELECT o_orderkey, ['annual_report', 'restructuring', 'attention', 'annual_report', 'quarterly', 'semi_report', 'restructuring', 'other'][o_orderkey % 8 + 1] AS event_type, ['问询函', '问询函', '问询函', '半年报问询函', '季报问询函', '半年报问询函', '重组问询函', '问询函'][o_orderkey % 8 + 1] AS case_type FROM orders",
    "audit_reports": "WITH k AS (SELECT s_suppkey AS company, s_suppkey + 2023 AS k FROM supplier) SELECT company, 2023::BIGINT AS year, CASE k % 5 WHEN 0 THEN 0.0 WHEN 1 THEN 1.0 WHEN 2 THEN 0.0 WHEN 3 THEN 1.0 END::DOUBLE AS gov_nonstandard_audit_opinion, ((k // 2) % 3 = 0)::INT::DOUBLE AS gov_big4_auditor, ((k // 2) % 3 <> ((k - 1) // 2) % 3)::INT::DOUBLE AS gov_audit_firm_change FROM k",
    "page_states": "WITH n AS (SELECT l_orderkey AS document, count(*) AS pages, count(*) FILTER (l_returnflag <> 'N') AS candidates, count(*) FILTER (l_returnflag <> 'N' AND l_orderkey % 7 = 0) AS skipped, count(*) FILTER (l_returnflag <> 'N' AND l_orderkey % 7 <> 0 AND l_linenumber % 3 <> 0) AS succeeded, count(*) FILTER (l_returnflag <> 'N' AND l_orderkey % 7 <> 0 AND l_linenumber % 3 = 0) AS failed FROM lineitem GROUP BY 1) SELECT *, CASE WHEN candidates = 0 THEN 'not_needed' WHEN skipped > 0 THEN CASE WHEN succeeded > 0 THEN 'partial_truncated' ELSE 'truncated' END WHEN failed > 0 AND succeeded > 0 THEN 'partial_failed' WHEN failed > 0 THEN 'failed' ELSE 'completed' END AS status FROM n",
    "context_suppression": f"SELECT o_orderkey, {[c[2] for c in _CONTEXTS]}[o_orderkey % 6 + 1] AS reason, {[c[1].split('。')[1] + '。' for c in _CONTEXTS]}[o_orderkey % 6 + 1] AS context FROM orders",
    "rule_summary": f"{_TEXT} SELECT announcement_id, label[1] AS theme, count(*) AS hits, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(severity)::BIGINT AS max_severity FROM hits WHERE NOT suppressed GROUP BY ALL",
    "channel_merge": f"{_TEXT}, m AS (SELECT DISTINCT doc_id AS announcement_id, CASE WHEN doc_id % 2 = 0 THEN 'G07' ELSE 'A03' END AS label FROM documents WHERE doc_id % 3 = 0), u AS (SELECT event_key, announcement_id, label, rule_id, 'rule' AS channel FROM evs UNION ALL SELECT substring(sha256(announcement_id::VARCHAR || '|' || label), 1, 20), announcement_id, label, NULL, 'model' FROM m) SELECT event_key, announcement_id, label, rule_id, channel, count(DISTINCT channel) OVER (PARTITION BY event_key) = 2 AS agrees FROM u QUALIFY row_number() OVER (PARTITION BY event_key ORDER BY channel DESC, rule_id NULLS LAST) = 1",
    "forum_features": f"WITH {_NEWS}, {_recent(30)}, dy AS (SELECT company, date, count(*) AS n FROM rc GROUP BY ALL) SELECT company, count(*) FILTER (date >= last - 5) AS sent_post_count_5d, count(*) AS sent_post_count_30d, sum(event_id % 17)::BIGINT AS sent_comment_count_30d, sum(event_id % 101)::BIGINT AS sent_read_count_30d, (SELECT max(n) FROM dy WHERE dy.company = rc.company) AS sent_post_daily_peak_30d, {_r('avg(score)', 'sent_guba_sentiment_mean_30d')}, {_r('stddev_pop(score)', 'sent_guba_sentiment_volatility_30d')}, {_r('avg((score > 0)::INT)', 'sent_guba_positive_ratio_30d')}, {_r('avg((score < 0)::INT)', 'sent_guba_negative_ratio_30d')} FROM rc GROUP BY company",
    "label_keywords": "WITH w AS (SELECT vec_id AS id, [['zero'], ['eins'], [], []][vec_id % 4 + 1] || CASE WHEN vec_id % 5 = 0 THEN ['商誉'] ELSE [] END AS k FROM embeddings) SELECT id, array_to_string(list_sort(k), ',') AS keywords FROM w WHERE len(k) > 0",
    "case_links": f"WITH {_COS}, f AS (SELECT cr.query_id AS id, cr.case_id, (asked = focus_point)::INT + (cr.case_id % 3 = 1)::INT AS hits, score AS similarity FROM cr JOIN ca USING (case_id) JOIN cq USING (query_id) WHERE rank <= 50) SELECT id, case_id, hits::BIGINT AS hits, {_r('similarity', 'similarity')}, (row_number() OVER (PARTITION BY id ORDER BY hits DESC, similarity DESC, case_id))::BIGINT AS place FROM f WHERE hits > 0 QUALIFY place <= 3",
    "letter_focus": "WITH l AS (SELECT o_orderkey AS doc_id, o_orderkey % 97 AS s, o_orderdate::DATE AS t FROM orders), o AS (SELECT s, t, string_agg('p' || doc_id, ',' ORDER BY doc_id) AS p FROM l WHERE doc_id % 3 = 0 GROUP BY ALL) SELECT doc_id, coalesce(p, CASE WHEN doc_id % 2 = 0 THEN 'b,a' ELSE '' END) AS focus_points FROM l LEFT JOIN o USING (s, t)",
    "mean_vectors": f"WITH e AS (SELECT label, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS pos FROM embeddings) SELECT label::BIGINT AS focus_point, {_i('pos', 'pos')}, {_r('avg(x)', 'mean')} FROM e GROUP BY label, pos",
    "spearman_top": f"WITH {_PANEL}, u AS (UNPIVOT (SELECT (industry < 12)::INT AS y, roe, debt_to_assets_ratio, total_revenue, market_cap, pe_ratio FROM p) ON roe, debt_to_assets_ratio, total_revenue, market_cap, pe_ratio INTO NAME f VALUE x), k AS (SELECT f, y, {_AVERAGE_RANK} AS r FROM u) SELECT f AS feature, count(*) AS n, {_r('corr(r, y)', 'rho')} FROM k GROUP BY f ORDER BY abs(corr(r, y)) DESC, f LIMIT 3",
}
ORACLE_SQL["case_links_every_20th"] = ORACLE_SQL["case_links"].replace(_COS, _cos(False))
_KNOWN = catalogue.ORACLE_SQL | ORACLE_SQL
ORACLE_SQL["f4_all"] = f"SELECT * FROM ({_KNOWN['lexicon_sentiment']}) FULL JOIN ({_KNOWN['forum_features']}) USING (company)"
ORACLE_SQL["f5_all"] = f"SELECT * EXCLUDE (year), {_none('gov_board_size', 'gov_independent_director_count', 'gov_independent_director_ratio', 'gov_auditor_change')} FROM ({_KNOWN['holder_concentration']}) FULL JOIN ({_KNOWN['audit_reports']}) USING (company)"
ORACLE_SQL["feature_assembly"] = (
    f"WITH l AS (SELECT *, company_code AS c, company_code % 20 AS feed FROM ({_KNOWN['f2_all']}) QUALIFY row_number() OVER (PARTITION BY company_code ORDER BY report_period DESC) = 1) "
    f"SELECT l.* EXCLUDE (c, feed), m.* EXCLUDE (company_code, trade_date), n.* EXCLUDE (company), g.* EXCLUDE (company), i.* EXCLUDE (secucode) FROM l LEFT JOIN ({_KNOWN['f3_all']}) m ON m.company_code = l.industry "
    f"LEFT JOIN ({ORACLE_SQL['f4_all']}) n ON n.company = feed LEFT JOIN ({ORACLE_SQL['f5_all']}) g ON g.company = c LEFT JOIN ({_KNOWN['f6_history']}) i ON i.secucode = c"
)
ORACLE_SQL["risk_score"] = (
    f"WITH fe AS ({ORACLE_SQL['feature_assembly']}), l AS (SELECT {_KEYS}, {_RISK_LIST} AS f FROM fe), c AS (SELECT *, {_COUNTS} AS by_family, coalesce(list_sum(list_transform(f, lambda x: 3 - x[1]::INT)), 0)::BIGINT AS risk_score FROM l), "
    "v AS (SELECT *, CASE WHEN risk_score >= 12 THEN '高' WHEN risk_score >= 6 THEN '中' ELSE '低' END AS risk_level FROM c) "
    f"SELECT {_KEYS}, risk_score, len(f)::BIGINT AS n_risk_factors, risk_level, array_to_string(list_transform(f, lambda x: x[4:]), ',') AS factors, array_to_string(list_transform(by_family, lambda x: x.f || ':' || (-x.o)), ',') AS families, '' AS missing_rules, "
    "CASE WHEN len(f) > 0 THEN '风险等级 ' || risk_level || '，触发规则 ' || len(f) || ' 条：' || array_to_string(list_transform(list_sort(by_family), lambda x: x.f || '(' || (-x.o) || ')'), ', ') ELSE '风险等级 ' || risk_level || '，没有触发规则' END AS summary FROM v"
)
ORACLE_SQL["batch_summary"] = f"SELECT s.company_code, s.report_period, risk_score, s.risk_level, n_risk_factors, coalesce(n_anomalies, 0)::BIGINT AS n_anomalies, coalesce(max_severity, 0)::BIGINT AS max_severity, a.risk_level AS financial_level FROM ({ORACLE_SQL['risk_score']}) s LEFT JOIN ({_KNOWN['anomaly_rules']}) a USING (company_code)"
