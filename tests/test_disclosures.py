"""Disclosure text, linking, reports, caches and the stream, by small cases."""

import datetime
import json

import pytest
from pyspark.sql import functions as F

from riskweave.functions import disclosure
from riskweave.operators import governance, linking, modeling, reports, scoring, sentiment
from riskweave.sources import caches
from riskweave.streaming import announcements

DAY = datetime.date


def _one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("text", "year", "want"),
    [
        ("公告编号：2024-029 见2023年5月1日公告 2024年3月26日 及2025.1.1", None, DAY(2024, 3, 26)),
        ("二〇二四年十二月二十六日", None, DAY(2024, 12, 26)),
        ("二零二一年三月十日", 2020, DAY(2021, 3, 10)),
        ("2024-3-5 2024/02/31", None, DAY(2024, 3, 5)),
        ("无日期", 2022, DAY(2022, 1, 1)),
        ("公告编号: 2021－1 1999-01-01", None, None),
        ("", None, None),
        (None, None, None),
    ],
)
def test_filing_date(spark, text, year, want):
    assert _one(spark, disclosure.filing_date(F.lit(text).cast("string"), F.lit(year).cast("int"))) == want


@pytest.mark.parametrize(("text", "want"), [("20 24 年 1 月 5 日 回复 2024年2月6日", DAY(2024, 2, 6)), ("2024年1月5日 2024年2月31日", None), ("", None)])
def test_inquiry_date(spark, text, want):
    assert _one(spark, disclosure.inquiry_date(F.lit(text))) == want


@pytest.mark.parametrize(("text", "want"), [("二十六", 26), ("十", 10), ("十九", 19), ("三", 3), ("二〇二四", 2024), ("", None), ("x", None)])
def test_han_number(spark, text, want):
    assert _one(spark, disclosure.han_number(F.lit(text))) == want


@pytest.mark.parametrize(("value", "want"), [("1704067200000", DAY(2024, 1, 1)), ("1704067200", DAY(2024, 1, 1)), ("2024-05-06 10:00:00", DAY(2024, 5, 6)), ("?", None), (None, None)])
def test_to_day(spark, value, want):
    assert _one(spark, disclosure.to_day(F.lit(value).cast("string"))) == want


@pytest.mark.parametrize(
    ("text", "want"),
    [("非标准审计意见提示\n□适用 ☑不适用", 0), ("非标准审计意见提示 ■ 适用 □不适用", 1), ("非标准审计意见提示 适用 不适用", 1), ("标准无保留意见", 0), ("否定意见", 1), ("意见", None), (None, None)],
)
def test_audit_opinion(spark, text, want):
    assert _one(spark, disclosure.audit_opinion(F.lit(text).cast("string"))) == want


def test_titles_and_keywords(spark):
    text = F.lit("证券代码：000004 公告\n\n 一、重要提示 \n  关于收到问询函的公告  \n其他公告")
    assert _one(spark, disclosure.title_in(text, F.lit("f"))) == "关于收到问询函的公告"
    assert _one(spark, disclosure.title_in(F.lit("短"), F.lit("f"))) == "f"
    assert _one(spark, disclosure.keyword_parts(F.lit("收入与成本、毛利"))) == ["收入与成本、毛利", "收入", "成本", "毛利"]
    assert _one(spark, disclosure.meaningful_chars(F.lit("a1 。中！"))) == 3


def test_context_ends_with_its_sentence(spark):
    text = "前文。公司存在  重大风险；后文"
    got = _one(spark, disclosure.nearby(F.lit(text), F.lit(text.index("风险") + 1), F.lit(2)))
    assert got == "公司存在 重大风险；"
    assert _one(spark, disclosure.nearby(F.lit("ab"), F.lit(1), F.lit(2))) == "ab"


def test_audit_features_take_the_best_text_and_the_year_before(spark):
    rows = [("a", 2022, "x", "天健会计师事务所"), ("a", 2023, "x", "English"), ("a", 2023, "y", "安永华明会计师事务所 保留意见"), ("b", 2023, "x", "nothing"), ("c", 2023, "x", None)]
    got = {r["company"]: tuple(r)[1:] for r in governance.audit_features(spark.createDataFrame(rows, "company string, year int, path string, text string")).collect()}
    assert got == {"a": (2023, 1.0, 1.0, 1.0), "b": (2023, None, None, None)}


def test_channels_merge_and_agree(spark):
    schema = "event_key string, rule_id string"
    by_rule = spark.createDataFrame([("k1", "r2"), ("k1", "r1"), ("k2", "r1")], schema)
    by_model = spark.createDataFrame([("k1", None), ("k3", None)], schema)
    got = {r["event_key"]: (r["rule_id"], r["channel"], r["agrees"]) for r in linking.merge_channels(by_rule, by_model).collect()}
    assert got == {"k1": ("r1", "rule", True), "k2": ("r1", "rule", False), "k3": (None, "model", False)}


def test_evidence_of_models_is_checked(spark):
    check = lambda *a: _one(spark, linking.evidence_holds(*[F.lit(x).cast("string") for x in a]))
    assert check("the text", "text", "A03", "actual_event") and check("the text", "text", "A03-CANDIDATE", "actual_event")
    assert not any((check("the text", "other", "A03", "actual_event"), check("the text", "", "A03", "actual_event"), check("t", "t", "A3", "actual_event"), check("t", "t", "A03", "policy"), check(None, "t", "A03", "actual_event")))


def test_rank_correlations_equal_pandas(spark):
    pd = pytest.importorskip("pandas")
    frame = pd.DataFrame({"a": [i * 7 % 50 for i in range(500)], "b": [float(i % 3) if i % 11 else None for i in range(500)], "c": [1.0] * 500, "y": [int(i * 7 % 50 > 30 or i % 13 == 0) for i in range(500)]})
    rows = spark.createDataFrame([tuple(None if x != x else x for x in r) for r in frame.itertuples(index=False)], "a long, b double, c double, y int")
    got = {r["feature"]: r["rho"] for r in scoring.rank_correlations(rows, ["a", "b", "c"], "y", parts=4).collect()}
    for f in "ab":
        both = frame[[f, "y"]].dropna()
        assert got[f] == pytest.approx(both[f].rank().corr(both["y"].rank()))
    assert got["c"] is None and [r["feature"] for r in scoring.strongest(rows, ["a", "b", "c"], "y", 1).collect()] == ["a"]


def test_features_without_weight_go(spark):
    rows = spark.range(300).select((F.col("id") % 10).cast("double").alias("a"), F.lit(2.0).alias("b"), ((F.col("id") % 10) > 4).cast("int").alias("y"))
    assert modeling.important(rows, ["a", "b"], "y", rounds=2) == ["a"]
    assert modeling.uncorrelated(rows, ["a"]) == ["a"]


def test_posts_without_scores(spark):
    rows = [("a", DAY(2024, 1, 30), "good", 1, 2), ("a", DAY(2024, 1, 1), "plain", None, 3), ("b", DAY(2024, 1, 1), "plain", None, None)]
    got = {r["company"]: r for r in sentiment.post_features(spark.createDataFrame(rows, "company string, date date, title string, comment_count long, read_count long"), ["good"], ["bad"]).collect()}
    assert (got["a"]["sent_post_count_30d"], got["a"]["sent_post_count_5d"], got["a"]["sent_comment_count_30d"], got["a"]["sent_guba_sentiment_mean_30d"], got["a"]["sent_guba_sentiment_volatility_30d"]) == (2, 1, 1, 1.0, 0.0)
    assert got["b"]["sent_guba_sentiment_mean_30d"] is None and got["b"]["sent_comment_count_30d"] == 0


def test_reports_of_companies_that_one_side_lacks(spark):
    found = spark.sql("SELECT 1 AS company_code, array(named_struct('indicator', 'roe', 'severity', 4)) AS anomaly_list")
    scores = spark.sql("SELECT 2 AS company_code, 7 AS risk_score, '中' AS risk_level, array(named_struct('factor_id', 'f2_roe', 'severity', '高', 'value', -1D)) AS risk_factors")
    cases = spark.sql("SELECT 2 AS company_code, array(named_struct('case_id', 9, 'similarity', 0.51234D)) AS similar_cases")
    got = {r["company_code"]: r for r in reports.company_reports(found, scores, cases, "2024-06-30").collect()}
    assert "- [roe] ●●●●○" in got[1]["report_md"] and "风险等级：—" in got[1]["report_md"] and got[1]["report_md"].endswith("- 无")
    assert "- 高 f2_roe" in got[2]["report_md"] and "- 9 0.5123" in got[2]["report_md"]
    body = json.loads(got[2]["report_json"])
    assert body["prediction"] == {"risk_score": 7, "risk_level": "中"} and body["financial"]["anomaly_count"] == 0 and body["as_of"] == "2024-06-30"


def test_extractions_are_made_once(spark, tmp_path):
    path, calls = str(tmp_path / "cache"), []

    def extract(rows):
        calls.append(sorted(r["sha"] for r in rows.collect()))
        return rows.withColumn("chars", F.length("sha"))

    items = spark.createDataFrame([(1, "aa"), (2, "aa"), (3, None)], "id int, sha string")
    first = caches.read_through(items.where("sha = 'aa'"), path, "v1", ["sha"], extract)
    assert {r["id"]: r["chars"] for r in first.collect()} == {1: 2, 2: 2}
    both = caches.read_through(items.fillna("b", ["sha"]), path, "v1", ["sha"], extract)
    assert {r["id"]: r["chars"] for r in both.collect()} == {1: 2, 2: 2, 3: 1}
    caches.read_through(items.where("id = 1"), path, "v2", ["sha"], extract)
    assert calls == [["aa"], ["b"], ["aa"]]


def test_vectors_and_traces(spark, tmp_path):
    path = str(tmp_path / "v")
    caches.write_vectors(spark.sql("SELECT 1 AS id, array(1F, 2F) AS embedding"), path, "hash")
    about = spark.read.json(f"{path}/about").first()
    assert (about["model"], about["dim"], about["n"]) == ("hash", 2, 1)
    assert caches.read_vectors(spark, path, 2).count() == 1 and caches.read_vectors(spark, path, 3).count() == 0
    for _ in range(2):
        caches.append_trace(spark.range(1), str(tmp_path / "t"))
    assert spark.read.json(str(tmp_path / "t")).count() == 2


def test_stream_counts_each_event_once(spark, tmp_path):
    lines = [("k1", "a", 5, "2024-01-01T10:00:00"), ("k1", "a", 5, "2024-01-01T11:00:00"), ("k2", "a", 2, "2024-01-01T12:00:00"), ("k3", "b", 4, "2024-01-02T00:00:00"), ("end", "z", 1, "2024-06-01T00:00:00")]
    source = tmp_path / "in"
    source.mkdir()
    (source / "1.json").write_text("\n".join(json.dumps(dict(zip(("event_key", "company", "severity", "published_at"), x, strict=True))) for x in lines))
    counts = announcements.window_counts(announcements.read_events(spark, str(source)), days=2)
    announcements.write_counts(counts, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    rows = lambda df: {(r["company"], str(r["from_time"]), r["events"], r["high_events"]) for r in df.where("company != 'z'").collect()}
    got = rows(spark.read.parquet(str(tmp_path / "out")))
    assert got == rows(announcements.window_counts(spark.read.schema(announcements.EVENTS).json(str(source)), days=2))
    assert ("a", "2024-01-01 00:00:00", 2, 1) in got and ("b", "2024-01-02 00:00:00", 1, 1) in got
