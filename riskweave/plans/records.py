"""Registered queries of the small operators: codes, days, words and rows of the supplied tables, each with DuckDB SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.functions import disclosure, text
from riskweave.functions.wording import FEATURE_LABELS
from riskweave.operators import inquiry, linking, modeling, text_rules
from riskweave.plans import catalogue
from riskweave.plans.catalogue import _rounded
from riskweave.plans.oracles import _ANOMALIES, _DOCS, _NEWS_AS_OF, _PANEL, _TEXT, _r
from riskweave.sources import landing, tables


def clean_titles(spark, d) -> DataFrame:
    return tables.table(spark, d, "pages").select("page_id", text.clean_title(F.col("html")).alias("title"))


def title_lines(spark, d) -> DataFrame:
    found = disclosure.title_in(F.coalesce("text", F.lit("")), F.lit("none"), words="the|un|que|ci|a")
    return tables.table(spark, d, "documents").select("doc_id", found.alias("title"))


def evidence_spans(spark, d) -> DataFrame:
    hits = catalogue._hits(spark, d).select("announcement_id", "rule_id", "start")
    rows = hits.join(tables.announcements(spark, d).select("announcement_id", "text"), "announcement_id")
    return _rounded(rows.select("announcement_id", "rule_id", text_rules.evidence(F.col("text"), F.col("start")).alias("evidence")))


def severities(spark, d) -> DataFrame:
    said = F.when(F.col("event_id") % 3 == 0, F.initcap("event_type")).when(F.col("event_id") % 3 == 1, F.round("value").cast("long").cast("string")).otherwise(F.element_at(F.array(*map(F.lit, (" HIGH", "Medium", "low ", "critical"))), (F.col("event_id") % 4 + 1).cast("int")))
    return _rounded(tables.table(spark, d, "events").select("event_id", text.severity(said).alias("severity")))


def evidence_checks(spark, d) -> DataFrame:
    k = F.col("announcement_id")
    quote = F.when(k % 3 == 0, F.reverse(F.substring("text", 5, 20))).otherwise(F.substring("text", 5, 20))
    label = F.concat(F.when(k % 5 == 0, "A3").otherwise("A03"), F.when(k % 2 == 0, "-CANDIDATE").otherwise(""))
    held = linking.evidence_holds(F.col("text"), quote, label, F.when(k % 7 == 0, "policy").otherwise("actual_event"))
    return tables.announcements(spark, d).select("announcement_id", held.alias("holds"))


def keyword_splits(spark, d) -> DataFrame:
    word = F.regexp_replace("p_type", " ", "、")
    return tables.table(spark, d, "part").select("p_partkey", F.array_join(F.array_sort(disclosure.keyword_parts(word)), ",").alias("parts"))


def json_objects(spark, d) -> DataFrame:
    said = F.when(F.col("event_id") % 10 == 0, F.lit("nothing")).otherwise(F.concat(F.lit("so ```"), "props", F.lit("``` it is")))
    return _rounded(tables.table(spark, d, "events").select("event_id", text.json_object(said, "k long")["k"].alias("k")))


_LABELS = {f"A{i:02}": f"label {i}" for i in range(1, 20)}
_THEMES = {"A": "theme a", "B": "theme b"}


def theme_names(spark, d) -> DataFrame:
    rest = F.when(F.col("p_partkey") % 4 == 0, "-CANDIDATE").otherwise(F.lpad(F.col("p_size").cast("string"), 2, "0"))
    code = F.concat(F.when(F.col("p_size") % 3 == 0, "b").otherwise("A"), rest)
    return tables.table(spark, d, "part").select("p_partkey", landing.theme_name(code, _LABELS, _THEMES).alias("name"))


def epoch_days(spark, d) -> DataFrame:
    moment = F.unix_millis(F.col("ts").cast("timestamp"))
    said = F.when(F.col("event_id") % 3 == 0, moment.cast("string")).when(F.col("event_id") % 3 == 1, F.floor(moment / 1000).cast("string")).otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm"))
    return tables.table(spark, d, "events").select("event_id", disclosure.to_day(said).alias("day"))


def report_periods(spark, d) -> DataFrame:
    k = F.col("o_orderkey") % 4
    said = F.when(k == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).when(k == 1, F.date_format("o_orderdate", "yyyy/MM/dd HH")).when(k == 2, F.date_format("o_orderdate", "yyyyMMdd")).otherwise(F.date_format("o_orderdate", "yyMM"))
    return _rounded(tables.table(spark, d, "orders").select("o_orderkey", text.report_period(said).alias("period")))


def merged_files(spark, d) -> DataFrame:
    base, keys = catalogue._panel(spark, d), ["company_code", "report_period"]
    parts = [base.where("report_period % 10000 > 600").select(*keys, "roe"), base.where("company_code % 2 = 0").select(*keys, "total_revenue")]
    return _rounded(inquiry.merge_files(parts, keys))


def described_factors(spark, d) -> DataFrame:
    rows = catalogue._latest_anomalies(spark, d).select("company_code", F.explode(F.col("anomaly_list.indicator")).alias("factor_id"))
    return _rounded(linking.describe(rows, {k: v for k, (v, _) in FEATURE_LABELS.items() if k != "roe_trend_4q"}).distinct())


def last_rows(spark, d) -> DataFrame:
    rows = tables.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return _rounded(inquiry.keep_last(rows, ["l_orderkey"], "l_linenumber"))


def first_rows(spark, d) -> DataFrame:
    rows = tables.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return _rounded(inquiry.keep_first(rows, ["l_orderkey"], "l_linenumber"))


def varying_features(spark, d) -> DataFrame:
    rows = catalogue._panel(spark, d).withColumns({"same": F.lit(3.0), "none": F.lit(None).cast("double")})
    kept = modeling.varying(rows, ["roe", "same", "none", "total_revenue"])
    return spark.createDataFrame([(f,) for f in kept], "feature string")


def window_days(spark, d) -> DataFrame:
    day = F.lit(catalogue.NEWS_AS_OF).cast("date")
    counts = [F.count_if(text_rules.in_window(F.col("date"), day, 30, w)).alias(n) for n, w in (("days", False), ("wider", True))]
    return _rounded(tables.announcements(spark, d).groupBy("company").agg(*counts))


def data_quality(spark, d) -> DataFrame:
    status = F.when(F.col("announcement_id") % 5 == 0, "not_fetched").when(F.length("text") > 200, "pdf_text_parsed").otherwise("fetched")
    return _rounded(text_rules.data_quality(catalogue._policed(spark, d).withColumn("text_status", status)))


def model_candidates(spark, d) -> DataFrame:
    docs = catalogue._policed(spark, d).where("analysis_status = 'analyze'")
    signals = docs.select("announcement_id", ((F.col("announcement_id") % 100) / F.lit(100.0)).alias("max_score"))
    return _rounded(text_rules.model_candidates(docs.select("announcement_id", "company"), catalogue._hits(spark, d), signals, 0.9))


def company_profiles(spark, d) -> DataFrame:
    rows = catalogue._latest_anomalies(spark, d).select(F.col("company_code").alias("company"), F.posexplode("anomaly_list").alias("ordinal", "a"))
    return _rounded(linking.profile_text(rows.select("company", "ordinal", F.col("a.indicator").alias("label"), F.col("a.severity").cast("string").alias("description"))))


def paragraphs(spark, d) -> DataFrame:
    """Conversations as documents: the texts of their turns, joined in order."""
    turns = tables.table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    return turns.select("conv_id", linking.joined_paragraphs(F.col("turns")).alias("text"))


def alias_keywords(spark, d) -> DataFrame:
    words = spark.createDataFrame([("c1", ["one", "uno"]), ("c2", ["two"]), ("c4", [])], "code string, words array<string>")
    label = F.element_at(F.array(*map(F.lit, ("both", "c1", "c4", "new", ""))), (F.col("case_id") % 5 + 1).cast("int"))
    labels = tables.cases(spark, d).select(F.col("case_id").alias("id"), label.alias("label"))
    return linking.official_keywords(labels, {"both": ["c1", "c2"]}, words).select("id", F.array_join("keywords", ",").alias("keywords"))


def period_parts(spark, d) -> DataFrame:
    """Days, years and quarters of report periods, and the newest three periods of each company."""
    rows = catalogue._panel(spark, d).select(F.col("company_code").cast("string").alias("stock_code"), "report_period", F.to_date(F.col("report_period").cast("string"), "yyyyMMdd").alias("report_date"))
    newest = landing.newest_periods(rows, 3)
    return _rounded(newest.select("stock_code", "report_period", "report_date", F.year("report_date").alias("year"), F.quarter("report_date").alias("quarter")))


QUERIES = {
    f.__name__: f
    for f in (
        clean_titles, title_lines, evidence_spans, severities, evidence_checks, keyword_splits, json_objects, theme_names, epoch_days, report_periods, merged_files,
        described_factors, last_rows, first_rows, varying_features, window_days, data_quality, model_candidates, company_profiles, paragraphs, alias_keywords, period_parts,
    )
}

_MAP = lambda d: "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in d.items()) + "}"
_MARK = "[.!?。！？\\n]"

ORACLE_SQL = {
    "clean_titles": r"SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]*>', '', 'g'), '\s+', ' ', 'g')) AS title FROM pages",
    "title_lines": r"WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_replace(x, '^[\s\x{3000}\x{00a0}]+|[\s\x{3000}\x{00a0}]+$', '', 'g')), lambda x: x <> '')[1:40] AS h FROM documents) SELECT doc_id, coalesce(list_filter(h, lambda x: regexp_matches(x, 'the|un|que|ci|a') AND length(x) BETWEEN 4 AND 80)[1], 'none') AS title FROM l",
    "evidence_spans": f"{_TEXT}, e AS (SELECT announcement_id, rule_id, start, text, length(substring(text, 1, start - 1)) - length(regexp_replace(substring(text, 1, start - 1), '(?s)^.*{_MARK}', '')) + 1 AS b FROM hits JOIN ann USING (announcement_id)), f AS (SELECT *, substring(text, b, 240) AS rest FROM e), g AS (SELECT *, length(regexp_extract(substring(rest, start - b + 1, 240), '^[^.!?。！？\\n]*{_MARK}')) AS n FROM f) SELECT announcement_id, rule_id, trim(CASE WHEN n > 0 THEN substring(rest, 1, start - b + n) ELSE rest END) AS evidence FROM g",
    "severities": "SELECT event_id, (CASE event_id % 3 WHEN 0 THEN 2 WHEN 1 THEN greatest(1, least(5, round(value)::BIGINT)) ELSE [5, 3, 2, 5][event_id % 4 + 1] END)::BIGINT AS severity FROM events",
    "evidence_checks": f"WITH {_DOCS}, q AS (SELECT announcement_id AS k, text, CASE WHEN announcement_id % 3 = 0 THEN reverse(substring(text, 5, 20)) ELSE substring(text, 5, 20) END AS quote FROM ann) SELECT k AS announcement_id, length(quote) > 0 AND contains(text, quote) AND k % 5 <> 0 AND k % 7 <> 0 AS holds FROM q",
    "keyword_splits": "SELECT p_partkey, array_to_string(list_sort(list_distinct([replace(p_type, ' ', '、')] || string_split(p_type, ' '))), ',') AS parts FROM part",
    "json_objects": "SELECT event_id, CASE WHEN event_id % 10 <> 0 THEN (props->>'k')::BIGINT END AS k FROM events",
    "theme_names": f"WITH c AS (SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'B' ELSE 'A' END AS t, lpad(p_size::VARCHAR, 2, '0') AS n, p_partkey % 4 = 0 AS candidate FROM part) SELECT p_partkey, CASE WHEN candidate THEN {_MAP(_THEMES)}[t] || '（待精分类）' ELSE coalesce({_MAP(_LABELS)}[t || n], '未映射主题') END AS name FROM c",
    "epoch_days": "SELECT event_id, ts::DATE AS day FROM events",
    "report_periods": "SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 3 THEN 0 ELSE strftime(o_orderdate, '%Y%m%d')::BIGINT END AS period FROM orders",
    "merged_files": f"WITH {_PANEL}, a AS (SELECT company_code, report_period, {_r('roe', 'roe')} FROM p WHERE report_period % 10000 > 600), b AS (SELECT company_code, report_period, {_r('total_revenue', 'total_revenue')} FROM p WHERE company_code % 2 = 0) SELECT * FROM a FULL JOIN b USING (company_code, report_period)",
    "described_factors": f"{_ANOMALIES} SELECT DISTINCT company_code, x.i AS factor_id, coalesce({_MAP({k: v for k, (v, _) in FEATURE_LABELS.items() if k != 'roe_trend_4q'})}[x.i], x.i) AS description FROM (SELECT company_code, unnest(found) AS x FROM an)",
    "last_rows": "SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_partkey FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC) = 1",
    "first_rows": "SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_partkey FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) = 1",
    "varying_features": f"WITH {_PANEL} SELECT feature FROM (SELECT unnest(['roe', 'total_revenue']) AS feature, unnest([var_pop(roe), var_pop(total_revenue)]) AS v FROM p) WHERE v >= 1e-12",
    "window_days": f"WITH {_DOCS} SELECT company, count(*) FILTER (date_diff('day', date, {_NEWS_AS_OF}) BETWEEN 0 AND 29) AS days, count(*) FILTER (date_diff('day', date, {_NEWS_AS_OF}) BETWEEN 0 AND 30) AS wider FROM ann GROUP BY company",
    "data_quality": f"WITH {_DOCS}, s AS (SELECT company, analysis_status = 'analyze' AS r, announcement_id % 5 <> 0 AS f, announcement_id % 5 <> 0 AND length(text) > 200 AS p FROM ann), c AS (SELECT company, count(*) AS announcements, count(*) FILTER (r) AS eligible, count(*) FILTER (NOT r) AS excluded, count(*) FILTER (r AND f) AS fetched, count(*) FILTER (r AND p) AS parsed FROM s GROUP BY company) SELECT *, eligible - fetched AS not_fetched, fetched - parsed AS not_fulltext, CASE WHEN fetched > 0 THEN round(parsed::DOUBLE / fetched, 4) END AS parsed_ratio, fetched < eligible AS truncated FROM c",
    "model_candidates": f"{_TEXT} SELECT announcement_id, company FROM ann WHERE analysis_status = 'analyze' AND (announcement_id % 100 >= 90 OR announcement_id IN (SELECT announcement_id FROM hits WHERE NOT suppressed))",
    "company_profiles": f"{_ANOMALIES} SELECT company_code AS company, array_to_string(list_transform(found, lambda x: x.i || ':' || x.s), '；') AS profile FROM an WHERE len(found) > 0",
    "paragraphs": "SELECT conv_id, string_agg(t, chr(10) ORDER BY turn) AS text FROM (SELECT conv_id, turn, trim(coalesce(text, '')) AS t FROM conversations) WHERE t <> '' GROUP BY conv_id",
    "alias_keywords": "SELECT vec_id AS id, ['one,two,uno', 'one,uno', 'c4', 'new'][vec_id % 5 + 1] AS keywords FROM embeddings WHERE vec_id % 5 < 4",
    "period_parts": f"WITH {_PANEL}, q AS (SELECT company_code::VARCHAR AS stock_code, report_period, strptime(report_period::VARCHAR, '%Y%m%d')::DATE AS report_date FROM p QUALIFY row_number() OVER (PARTITION BY company_code ORDER BY report_period DESC) <= 3) SELECT *, year(report_date) AS year, quarter(report_date) AS quarter FROM q",
}
