"""Landing files as tables, by small cases."""

import datetime
import json

from pyspark.sql import functions as F

from riskweave.operators import text_rules
from riskweave.sources import caches, landing, tables

DAY = datetime.date


def test_indicators(spark):
    rows = spark.createDataFrame([("000004", "2024-03-31 00:00:00", "1.5", "?", "x"), ("000005", None, None, "-2", "y")], "SECURITY_CODE string, REPORT_DATE string, ROEJQ string, PARENTNETPROFIT string, OTHER string")
    got = [tuple(r) for r in landing.indicators(rows).orderBy("stock_code").collect()]
    assert got == [("000004", DAY(2024, 3, 31), 1.5, None), ("000005", None, None, -2.0)]


def test_quotes(spark):
    fields = [""] * 50
    fields[39], fields[45], fields[46] = "12.5", "3", ""
    lines = spark.createDataFrame([(f'v_sz000004="{"~".join(fields)}";\n',), ("v_pv_none_match;",), ('v_sh600000="1~2";',), (None,)], "value string")
    got = {r["company_code"]: (r["pe_ratio"], r["pb_ratio"], r["market_cap"]) for r in landing.quotes(lines).collect()}
    assert got == {"000004": (12.5, None, 3e8), "600000": (None, None, None)}


def test_klines(spark):
    row = ["2024-01-02", "1", "2.0", "3", "1", "10"]
    bodies = [json.dumps({"data": {"sz000004": {"qfqday": [[*row, {"cash": 1}]], "day": [["2020-01-01", "1", "1", "1", "1", "1"]]}}}), json.dumps({"data": {"sh600000": {"day": [row, ["bad", "1", "?", "1", "1", "5"]]}}}), "no json", None]
    got = {tuple(r) for r in landing.klines(spark.createDataFrame([(b,) for b in bodies], "value string")).collect()}
    day = DAY(2024, 1, 2)
    assert got == {("000004", day, 2.0, 10.0, 2000.0), ("600000", day, 2.0, 10.0, 2000.0), ("600000", None, None, 5.0, None)}


def test_news(spark):
    body = "cb(" + json.dumps({"result": {"cmsArticleWebOld": [{"date": "2024-01-02 10:00", "title": " a(b) ", "content": None}, {"date": "?", "title": "x"}]}}) + ");"
    got = [tuple(r) for r in landing.news(spark.createDataFrame([("c", body), ("d", "cb({})"), ("e", None)], "company string, value string")).collect()]
    assert got == [("c", DAY(2024, 1, 2), "a(b)", "")]


def test_top_holders(spark):
    rows = [("a", "2024-03-31", "1", "old", "9", 0), ("a", "2024-06-30", "1", "x", "50", 1), ("a", "2024-06-30", "1", "y", "40", 2), ("a", "2024-06-30", "11", "z", "1", 3), ("a", "2024-06-30", "2", "n", None, 4)]
    got = [(r["holder_rank"], r["holder_name"], r["ratio"]) for r in landing.top_holders(spark.createDataFrame(rows, "company_code string, END_DATE string, HOLDER_RANK string, HOLDER_NAME string, HOLD_NUM_RATIO string, position int")).collect()]
    assert got == [(1, "y", 0.4)]


def test_rules_of_a_dictionary(spark, tmp_path):
    book = {"global_negation_patterns": ["未发生"], "categories": [{"category_id": "C", "rules": [{"rule_id": "r", "label": "C01", "severity": "high", "keywords": ["减值", "减值(重大)"], "paragraph_exclusion_regexes": ["会计政策"]}, {"rule_id": "none", "label": "A01"}]}]}
    (tmp_path / "d.json").write_text(json.dumps(book))
    rules, negations = landing.read_rules(str(tmp_path / "d.json"))
    docs = spark.createDataFrame([(1, "计提减值(重大)。"), (2, "未发生减值"), (3, "会计政策：减值")], "announcement_id long, text string")
    hits = text_rules.rule_hits(docs, rules, negations)
    got = {r["announcement_id"]: (r["match"], r["severity"], r["suppressed"]) for r in hits.collect()}
    assert got == {1: ("减值(重大)", 5, False), 2: ("减值", 5, True), 3: ("减值", 5, True)}
    assert [tuple(r) for r in text_rules.rule_summary(hits).collect()] == [(1, "C", 1, ["C01"], 5)]


def test_wide_headers_get_the_panels_names(spark):
    heads = ["company_code", "industry", "report_period", "total_market_cap[元]", "pe_ratio(TTM)", "pb_ratio", "total_revenue(合并)", "net_profit(归母)", "net_operating_cash_flow[期]", "roe(%)", "roa(%)", "debt_to_assets(%)", "revenue_yoy(%)", "net_profit_yoy(%)", "gross_roe(%)", "market_cap_old"]
    want = ["company_code", "industry", "report_period", "market_cap", "pe_ratio", "pb_ratio", "total_revenue", "net_profit", "operating_cash_flow", "roe", "roa", "debt_to_assets_ratio", "revenue_yoy_growth", "net_profit_yoy_growth", "gross_roe(%)", "market_cap_old"]
    assert landing.wide_panel(spark.createDataFrame([tuple(range(16))], heads)).columns == want
    assert landing.wide_panel(spark.createDataFrame([(1, 2)], ["roe(%)", "roe"])).columns == ["roe(%)", "roe"]  # a name that is there stays its own


def test_theme_names(spark):
    codes = spark.createDataFrame([("a03 ",), ("C-CANDIDATE",), ("X-CANDIDATE",), ("Z99",), (None,)], "c string")
    got = [r["n"] for r in codes.select(landing.theme_name(F.col("c"), {"A03": "亏损"}, {"C": "减值"}).alias("n")).collect()]
    assert got == ["亏损", "减值（待精分类）", "未映射主题", "未映射主题", "未标注主题"]


def test_feeds_side_by_side(spark, tmp_path):
    rows = spark.createDataFrame([("1", DAY(2024, 1, i + 1)) for i in range(5)] + [("2", None)], "stock_code string, report_date date")
    assert sorted(r["report_date"].day for r in landing.newest_periods(rows, 2).collect()) == [4, 5]
    both = landing.side_by_side([spark.sql("SELECT 1 AS a, 2 AS b"), spark.sql("SELECT 3 AS b, 4 AS c")])
    assert sorted(map(tuple, both.collect()), key=repr) == [(1, 2, None), (None, 3, 4)]
    feed = spark.createDataFrame([("000004", "医药-生物"), ("000004", None), ("000005", None)], "SECURITY_CODE string, EM2016 string")
    assert sorted(map(tuple, landing.profiles(feed).collect())) == [("000004", "医药"), ("000005", None)]


def test_forum_posts(spark):
    body = json.dumps({"re": [{"post_publish_time": "2024-01-02 10:00:00", "post_title": " t ", "post_click_count": 5}, {"post_publish_time": None}]})
    got = [tuple(r) for r in landing.forum_posts(spark.createDataFrame([("c", body), ("d", "<html>403</html>"), ("e", None)], "company string, value string")).collect()]
    assert got == [("c", DAY(2024, 1, 2), "t", "", 5, 0)]


def test_dictionaries(spark, tmp_path):
    (tmp_path / "labels.csv").write_bytes("\ufefflevel,code,name,parent_code,parent_name,type,note\nL2,A03,亏损,A,业绩,core,\n".encode())
    assert landing.label_table(spark, str(tmp_path / "labels.csv")).select("code", "name", "parent_code").first() == ("A03", "亏损", "A")
    (tmp_path / "concerns.json").write_text(json.dumps({"version": "1", "categories": {"x": {"keywords": ["a", "b"], "category_id": "q"}}, "labels": {"A03": {"keywords": ["c"]}}}))
    got = {(r["kind"], r["name"]): r["keywords"] for r in landing.concern_keywords(spark, str(tmp_path / "concerns.json")).collect()}
    assert got == {("categories", "x"): ["a", "b"], ("labels", "A03"): ["c"]}
    assert landing.concern_keywords(spark, str(tmp_path / "none.json")).count() == 0 == landing.classified_points(spark, str(tmp_path / "none.jsonl")).count()
    (tmp_path / "points.jsonl").write_text('{"doc_id": "1", "focus_point": "p", "level_2": "A03"}\n')
    assert landing.classified_points(spark, str(tmp_path / "points.jsonl")).first()["level_2"] == "A03"


def test_letters_and_reports(spark, tmp_path):
    files = spark.createDataFrame([("a", "2023", "问询函", "关注函 2023年5月1日"), ("a", "2023", "问询回复", "2023 年 6 月 2 日"), ("b", "2022", "问询函", "无日期")], "secucode string, year string, type string, text string")
    got = {(r["secucode"], r["kind"]): (r["date"], r["type"]) for r in tables.read_inquiries(spark, str(tmp_path / "none.csv"), files).collect()}
    assert got == {("a", "letter"): (DAY(2023, 5, 1), "attention"), ("a", "reply"): (DAY(2023, 6, 2), ""), ("b", "letter"): (DAY(2022, 6, 30), "other")}
    (tmp_path / "events.csv").write_text("secucode,year,kind,date,type\na,2023,letter,2023-05-01,other\n")
    assert tables.read_inquiries(spark, str(tmp_path / "events.csv"), files).first()["date"] == DAY(2023, 5, 1)
    reports = spark.createDataFrame([("a", "2021", "x"), ("a", "2023", "y"), ("a", "2023", "z"), ("a", "2022", "w")], "company string, year string, path string")
    assert sorted((r["path"], r["place"]) for r in tables.newest_reports(reports).collect()) == [("w", 2), ("y", 1), ("z", 1)]


def test_lines_and_replies(spark, tmp_path):
    lines = [{"doc_id": str(i), "doc_type": "inquiry_reply" if i % 2 else "inquiry_letter", "stock_code": "s", "publish_date": "2023/10/01", "paragraphs": [{"text": " a "}, {"text": ""}, {"text": "b"}]} for i in range(6)]
    (tmp_path / "d.jsonl").write_text("\n".join(map(json.dumps, lines)))
    assert tables.read_lines(spark, str(tmp_path / "d.jsonl"), tables.LETTERS, ["inquiry_letter"], most=2).count() == 2
    rows = tables.replies_by_company(spark, str(tmp_path / "d.jsonl")).collect()
    assert len(rows) == 3 and {(r["publish_date"], r["text"]) for r in rows} == {(DAY(2023, 10, 1), "a\nb")}


def test_written_tables_are_read_again(spark, tmp_path):
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler

    rows = spark.createDataFrame([("000004", 1.5), ("中", None)], "code string, x double")
    caches.write_csv(rows, str(tmp_path / "csv"))
    assert sorted(map(tuple, tables.read_csv(spark, str(tmp_path / "csv"), "code string, x double").collect())) == [("000004", 1.5), ("中", None)]
    model = Pipeline(stages=[VectorAssembler(inputCols=["x"], outputCol="v", handleInvalid="keep")]).fit(rows)
    caches.write_models({"p": model}, rows, rows, str(tmp_path / "run"))
    assert caches.read_models(str(tmp_path / "run"), ["p"])["p"].transform(rows).count() == 2 and spark.read.parquet(str(tmp_path / "run" / "ranks")).count() == 2
    assert caches.read_vectors(spark, str(tmp_path / "nothing")).count() == 0
