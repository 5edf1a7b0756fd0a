"""Registered queries against DuckDB SQL on the smallest tables, and operators where SQL does not reach."""

import datetime
import math
import os

import pytest
from pyspark.sql import functions as F

from riskweave.functions import numeric, text
from riskweave.operators import inquiry, market, modeling, panel, ranking, retrieval, scoring, text_rules
from riskweave.plans import registry
from riskweave.sources import tables

SF = "/root/testdata/sf0.001"
duckdb = pytest.importorskip("duckdb")
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for f in os.listdir(SF):
        connection.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return connection


def _value(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, datetime.datetime):
        return v.date().isoformat()
    return v.isoformat() if isinstance(v, datetime.date) else round(v, 5) + 0.0 if isinstance(v, float) else v


def _rows(names, rows):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted((tuple(_value(r[i]) for i in order) for r in rows), key=repr)


@needs_data
@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_matches_sql(spark, duck, name):
    got = registry.QUERIES[name](spark, SF)
    want = duck.execute(registry.ORACLE_SQL[name])
    names = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(names)
    assert _rows(got.columns, got.collect()) == _rows(names, want.fetchall())


def test_every_query_but_models_has_sql():
    assert set(registry.QUERIES) - set(registry.ORACLE_SQL) == {"model_ensemble", "company_report"} and registry.FLAGSHIP in registry.QUERIES


@needs_data
def test_models_tell_classes_apart(spark):
    base = spark.range(400).select(F.col("id").alias("company_code"), (F.col("id") % 10).cast("double").alias("a"), F.rand(1).alias("b"), F.lit(1.0).alias("c"), ((F.col("id") % 10) > 6).cast("int").alias("y"))
    base = base.withColumn("d", F.col("a") * 2)
    kept = modeling.uncorrelated(base, modeling.varying(base, ["a", "b", "c", "d"]))
    assert kept == ["a", "b"]
    model = modeling.train(base, kept, "y", "company_code", modeling.Sizes(trees=5, rounds=3, rate=0.3))
    out = modeling.explain(modeling.probabilities(base, model), model)
    auc = scoring.ranking_metrics(out.select(F.col("probability").alias("score"), F.col("y").cast("long").alias("target"))).first()["auc"]
    assert auc == pytest.approx(1.0) and out.first()["contributions"][0]["name"] == "a"


def test_missing_values_make_no_flags(spark):
    row = spark.sql("SELECT 1 AS company_code, 20240331 AS report_period, 1 AS industry, CAST(NULL AS DOUBLE) AS net_profit, 0D AS total_revenue, 1D AS operating_cash_flow, CAST(NULL AS DOUBLE) AS roe, NULL AS roa, 1D AS market_cap, NULL AS pb_ratio, 1D AS pe_ratio, NULL AS debt_to_assets_ratio")
    got = panel.profitability(row).first()
    assert got["f2_loss_flag"] == 0 and got["f2_net_margin"] is None and got["f2_roe_industry_rank"] is None


def test_streaks_begin_anew_at_a_gap(spark):
    rows = [(1, i, v) for i, v in enumerate([5.0, 4.0, 3.0, None, 2.0, 1.0])]
    df = spark.createDataFrame(rows, "company_code int, report_period int, x double")
    got = [r["s"] for r in panel._streak(df, "x", "s").orderBy("report_period").collect()]
    assert got == [0, 1, 2, 0, 0, 1]


def test_labels_look_only_forward(spark):
    day = datetime.date
    events = spark.createDataFrame([("a", 1, "letter", day(2024, 1, 31)), ("a", 2, "reply", day(2024, 1, 5))], "secucode string, event_id long, kind string, date date")
    points = spark.createDataFrame([("a", day(2024, 1, 1)), ("a", day(2024, 1, 31)), ("b", day(2024, 1, 1)), ("a", day(2023, 12, 31))], "secucode string, t date")
    got = {(r["secucode"], str(r["t"])): (r["target_30d"], r["target_60d"]) for r in inquiry.forward_labels(points, events).collect()}
    assert got == {("a", "2024-01-01"): (1, 1), ("a", "2024-01-31"): (0, 0), ("b", "2024-01-01"): (0, 0), ("a", "2023-12-31"): (0, 1)}


def test_rules_pass_over_negated_places(spark):
    rules = [text_rules.Rule("r", "L", 4, ("impairment",), ("policy",))]
    docs = spark.createDataFrame([(1, "there is no impairment here"), (2, "no impairment. " + "x" * 30 + " An impairment was found. End"), (3, "nothing"), (4, "our policy on impairment")], "announcement_id long, text string")
    got = {r["announcement_id"]: (r["start"], r["suppressed"], r["reason"]) for r in text_rules.rule_hits(docs, rules, ["no "]).collect()}
    assert got == {1: (13, True, "negated_context"), 2: (50, False, ""), 4: (15, True, "rule_paragraph_exclusion")}
    said = docs.where("announcement_id = 2").select(text_rules.evidence(F.col("text"), F.lit(50)).alias("e")).first()["e"]
    assert said == "x" * 30 + " An impairment was found."


def test_rule_hits_grow_with_the_matches(spark):
    """Sixteen thousand negated matches take about as long as one: no match is looked for anew at each of them."""
    import time

    rules = [text_rules.Rule("r", "L", 4, ("impairment",))]
    docs = spark.createDataFrame([(1, "no impairment " * 16000 + "x" * 20 + "impairment")], "announcement_id long, text string")
    text_rules.rule_hits(docs, rules, ["no "]).collect()
    began = time.time()
    row = text_rules.rule_hits(docs, rules, ["no "]).first()
    assert row["start"] == 14 * 16000 + 21 and not row["suppressed"] and time.time() - began < 10


@pytest.mark.parametrize(
    ("title", "status", "reason"),
    [
        ("公司章程", "excluded_by_title", "governance_rules"),
        ("关于修订《公司章程》的公告", "excluded_by_title", "governance_rules"),
        ("独立董事 候选人声明", "excluded_by_title", "candidate_declaration"),
        ("信息披露管理制度", "excluded_by_title", "general_management_policy"),
        ("关于收到立案告知书的公告", "eligible", "risk_title_override"),
        ("关于独立董事辞职及候选人声明", "eligible", "risk_title_override"),
        ("2024年年度报告", "eligible", ""),
        (None, "eligible", ""),
    ],
)
def test_shipped_title_policy(spark, title, status, reason):
    found = spark.range(1).select(text_rules.title_decision(F.lit(title).cast("string")).alias("d")).first()["d"]
    assert (found["status"], found["reason"]) == (status, reason) and bool(found["pattern"]) == bool(reason)


def test_contexts_of_rules_are_no_events(spark):
    rules = [text_rules.Rule("G07_INVESTIGATION_PENALTY", "G07", 5, ("立案调查",)), text_rules.Rule("C03", "C03", 4, ("商誉减值",))]
    texts = ["候选人因立案调查不得任职。", "如发生立案调查，另行公告。公司收到立案调查通知书。", "公司会计政策规定商誉减值的计量。", "公司本期发现商誉减值一亿元。"]
    docs = spark.createDataFrame(list(enumerate(texts)), "announcement_id long, text string")
    got = {r["announcement_id"]: (r["reason"], r["start"]) for r in text_rules.rule_hits(docs, rules, []).collect()}
    assert got == {0: ("governance_eligibility_clause", 5), 1: ("", texts[1].rindex("立案调查") + 1), 2: ("accounting_policy_or_table", 9), 3: ("", 7)}


def test_as_of_join_takes_the_last_row_before(spark):
    points = spark.createDataFrame([(1, "a", 5), (2, "a", 3), (3, "a", 1), (4, "b", 9), (5, None, 9)], "id int, k string, at int")
    rows = spark.createDataFrame([("a", 3, "x"), ("a", 4, "y"), ("a", 9, "z"), ("c", 1, "w")], "k string, day int, v string")
    got = {r["id"]: (r["day"], r["v"]) for r in inquiry.as_of_join(points, rows, "k", "at", "day").collect()}
    assert got == {1: (4, "y"), 2: (3, "x"), 3: (None, None), 4: (None, None), 5: (None, None)}


def test_quantiles_and_ranks_equal_numpy(spark):
    import numpy as np

    r = np.random.default_rng(3)
    values = [None if i % 17 == 0 else float(round(v, 1)) for i, v in enumerate(r.normal(size=700))]
    df = spark.createDataFrame([(i % 3, v, 1.0 if i < 2 else None) for i, v in enumerate(values)], "g int, a double, b double")
    row = ranking.exact_quantiles(df, ["a", "b"], (0.01, 0.5, 0.99), least=3).first()
    assert row["a"] == pytest.approx(np.quantile([v for v in values if v is not None], [0.01, 0.5, 0.99])) and row["b"] is None
    got = ranking.rank_share(df.withColumn("id", F.monotonically_increasing_id()), ["g"], "a", "share", parts=4)
    pd = pytest.importorskip("pandas")
    frame = got.toPandas()
    assert len(frame) == 700 and np.allclose(frame["share"], frame.groupby("g")["a"].rank(pct=True), equal_nan=True)
    z = ranking.group_z(df.fillna(0.0, ["a"]), ["g"], {"z": F.col("a"), "c": F.lit(1.0)}, {"c": 0.0}).toPandas()
    assert np.allclose(z["z"], pd.Series(z.groupby("g")["a"].transform(lambda x: (x - x.mean()) / x.std()))) and (z["c"] == 0).all()


def test_filled_embedding_counts_empty_buckets(spark):
    rows = spark.createDataFrame([(1, "aaab"), (2, "x"), (3, "")], "id int, t string")
    got = {(r["id"], r["bucket"]): r["weight"] for r in retrieval.hashed_embedding(rows, "id", "t", buckets=8, fill=True).collect()}
    sizes = {i: sorted(w for (k, _), w in got.items() if k == i) for i in (1, 2, 3)}
    two = (1 + math.log1p(2), 1 + math.log1p(1))
    norm = math.sqrt(two[0] ** 2 + two[1] ** 2 + 6)
    assert sizes[1] == pytest.approx(sorted(w / norm for w in two)) and len(sizes[2]) == 1 and sizes[3] == []


def test_families_have_their_features():
    from riskweave.operators import market, sentiment

    assert [len(x) for x in (panel.F2_FEATURES, market.F3_FEATURES, sentiment.F4_FEATURES, sentiment.F5_FEATURES, inquiry.F6_FEATURES)] == [67, 35, 19, 13, 12]


def test_missing_rules_are_named(spark):
    row = scoring.risk_score(spark.sql("SELECT 1 AS company_code, 1 AS f2_loss_flag, 3D AS f6_inquiry_count_12m, CAST(NULL AS DOUBLE) AS f2_roe")).first()
    assert (row["risk_score"], row["risk_level"], row["family_counts"]) == (6, "中", {"F2": 1, "F6": 1}) and len(row["missing_rules"]) == 20
    assert row["summary"] == "风险等级 中，触发规则 2 条：F2(1), F6(1)"
    none = scoring.risk_score(spark.sql("SELECT 1 AS company_code")).first()
    assert none["risk_score"] == 0 and none["family_counts"] == {} and len(none["missing_rules"]) == 23


def test_text_functions(spark):
    row = spark.range(1).select(
        text.stock_code(F.lit("a1234567 000004.SZ")).alias("code"), text.market(F.lit("920001")).alias("market"), text.report_period(F.lit("2024-12-31")).alias("period"),
        text.severity(F.lit("High")).alias("s1"), text.severity(F.lit("9")).alias("s2"), text.severity(F.lit("?")).alias("s3"), text.evidence_ids(F.lit("见fin_001问 xfin_002")).alias("ids"),
        text.json_object(F.lit('so {"a": 1} it is'), "a int").alias("j"), text.lexicon_score(F.lit("good bad good"), ["good"], ["bad"]).alias("lex"),
        numeric.cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(1.0))).alias("cos"), numeric.bigrams(F.lit("a b c")).alias("grams"),
    ).first()
    assert row["code"] == "000004" and row["market"] == "BJ" and row["period"] == 20241231 and (row["s1"], row["s2"], row["s3"]) == (5, 5, 2)
    assert row["ids"] == ["fin_001"] and row["j"]["a"] == 1 and row["lex"] == pytest.approx(1 / 3) and row["cos"] == pytest.approx(0.5**0.5) and row["grams"] == ["ab", "bc"]


def test_files(spark, tmp_path):
    (tmp_path / "f.csv").write_bytes("﻿code,x,y\n000004,1.5,\n000005,bad,2\n".encode())
    rows = tables.read_features(spark, str(tmp_path / "f.csv"), {"code": "string"}, ["x", "y"]).collect()
    assert [(r["code"], r["x"], r["y"]) for r in rows] == [("000004", 1.5, None), ("000005", None, 2.0)]
    folder = tmp_path / "tree" / "2024" / "letter"
    folder.mkdir(parents=True)
    (folder / "a.pdf").write_bytes(b"%PDF")
    found = tables.read_files(spark, str(tmp_path / "tree")).first()
    assert (found["year"], found["type"], found["length"]) == ("2024", "letter", 4)


def test_full_windows_only(spark):
    rows = [(1, datetime.date(2024, 1, 1) + datetime.timedelta(i), 100.0 + i, 10.0, 1e6) for i in range(25)]
    daily = spark.createDataFrame(rows, "company_code int, trade_date date, close double, volume double, amount double")
    got = market.returns(daily, daily.select("trade_date", "close")).orderBy("trade_date").collect()
    assert got[19]["mkt_return_20d"] is None and got[20]["mkt_return_20d"] == pytest.approx(120 / 100 - 1) and got[24]["mkt_excess_return_20d"] == pytest.approx(0)


@needs_data
def test_searches_take_every_twentieth_row(spark):
    n = tables.cases(spark, SF).where("case_id % 20 = 0").count()
    for name in ("cosine_topk", "rrf_fusion", "cosine_topk_every_20th", "label_overlap_every_20th", "rrf_fusion_every_20th"):
        assert registry.QUERIES[name](spark, SF).select("query_id").distinct().count() == n > 5


@needs_data
def test_hit_rate_takes_retrieved_cases(spark):
    n = tables.cases(spark, SF).where("case_id % 20 = 0").count()
    assert registry.QUERIES["bigram_hit_retrieved"](spark, SF).first()["queries"] == n
    row = spark.range(1).select(numeric.bigrams(F.lit("a é\n世b")).alias("g"), numeric.bigrams(F.lit("a")).alias("one"), numeric.bigrams(F.lit("")).alias("none")).first()
    assert row["g"] == ["aé", "é世", "世b"] and row["one"] == row["none"] == []


def test_recall_of_the_top_share_sorts_no_rows_in_one_task(spark):
    rows = [(i, float(i // 40), int(i % 3 == 0)) for i in range(400)]
    none = spark.createDataFrame([(-1, None, 1), *rows[:9]], "id long, score double, target long")
    assert scoring.top_share_recall(none, 0.9).first()["hits"] == sum(r[2] for r in rows[:9])
    got = scoring.top_share_recall(spark.createDataFrame(rows, "id long, score double, target long"), 0.15)
    top = sorted(rows, key=lambda r: (-r[1], r[0]))[:60]
    assert got.first()["k"] == 60 and got.first()["hits"] == sum(r[2] for r in top)
    assert "TakeOrdered" not in got._jdf.queryExecution().executedPlan().toString()
