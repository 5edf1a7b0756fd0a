"""What feeds and services leave behind as files, as tables: quotes, daily prices, indicators, news, holders, and the rules' dictionary."""

from __future__ import annotations

import json
import re
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskweave.functions.disclosure import to_day
from riskweave.operators.text_rules import Rule
from riskweave.sources.caches import exists

# Column names of the indicator feed and the engine's names for them.
INDICATORS = {
    "SECURITY_CODE": "stock_code",
    "SECURITY_NAME_ABBR": "company_name",
    "REPORT_DATE": "report_date",
    "TOTALOPERATEREVE": "total_revenue",
    "PARENTNETPROFIT": "net_profit",
    "NETCASH_OPERATE_PK": "operating_cash_flow",
    "ROEJQ": "roe",
    "ZZCJLL": "roa",
    "ZCFZL": "debt_to_assets_ratio",
    "TOTALOPERATEREVETZ": "revenue_yoy_growth",
    "PARENTNETPROFITTZ": "net_profit_yoy_growth",
    "XSMLL": "gross_margin",
    "XSJLL": "net_margin",
    "LD": "current_ratio",
    "SD": "quick_ratio",
}
# Columns of the profile feed; places from 0 in a quote line, and what a unit there is worth.
QUOTE_FIELDS = {"pe_ratio": (39, 1.0), "pb_ratio": (46, 1.0), "market_cap": (45, 1e8)}
PROFILES = {"SECURITY_CODE": "stock_code", "EM2016": "industry"}
# What headers of wide indicator files have in them, or begin with ("^"), in the order in which they are tried.
WIDE_HEADERS = [
    ("market_cap", "market_cap"),
    ("pe_ratio", "pe_ratio"),
    ("pb_ratio", "pb_ratio"),
    ("total_revenue", "total_revenue"),
    ("^net_profit(", "net_profit"),
    ("operating_cash", "operating_cash_flow"),
    ("^roe(", "roe"),
    ("^roa(", "roa"),
    ("debt_to_assets", "debt_to_assets_ratio"),
    ("revenue_yoy", "revenue_yoy_growth"),
    ("net_profit_yoy", "net_profit_yoy_growth"),
]
# The dictionary's words for severity.
SEVERITIES = {"critical": 5, "high": 5, "medium": 3, "low": 2}


def indicators(rows: DataFrame) -> DataFrame:
    """The columns that are known, renamed; report_date as a date, the rest but names as numbers (null if they are none)."""
    known = {c: INDICATORS[c] for c in rows.columns if c in INDICATORS}
    text = {"stock_code", "company_name", "report_date"}
    number = lambda c, n: F.col(c).cast("string") if n in text else F.col(c).cast("string").try_cast("double")
    return rows.select(*[(to_day(F.col(c)) if n == "report_date" else number(c, n)).alias(n) for c, n in known.items()])


def wide_panel(rows: DataFrame, keys: tuple[str, ...] = ("company_code", "industry", "report_period")) -> DataFrame:
    """A wide indicator file, whose headers also say unit and scope, with the panel's names. The keys and other columns keep theirs; of columns that would get
    one name, or one that is there, the first gets it."""
    def name(header: str) -> str:
        fits = lambda p: header.startswith(p[1:]) if p.startswith("^") else p in header
        return header if header in keys else next((n for p, n in WIDE_HEADERS if fits(p)), header)

    taken, names = set(), []
    for c in rows.columns:
        new = name(c)
        new = c if new in taken or (new != c and new in rows.columns) else new
        taken.add(new)
        names.append(new)
    return rows.toDF(*names)


def newest_periods(rows: DataFrame, most: int = 20) -> DataFrame:
    """Of each company's indicator rows those of its newest report dates."""
    place = F.row_number().over(Window.partitionBy("stock_code").orderBy(F.desc("report_date")))
    return rows.where("report_date IS NOT NULL").withColumn("__n", place).where(F.col("__n") <= most).drop("__n")


def side_by_side(feeds: list[DataFrame]) -> DataFrame:
    """Rows of several feeds as one table, by the names of their columns."""
    out = feeds[0]
    for feed in feeds[1:]:
        out = out.unionByName(feed, allowMissingColumns=True)
    return out


def profiles(rows: DataFrame) -> DataFrame:
    """stock_code and industry (the first part of a path of industries), one row for each code."""
    named = rows.select(F.col("SECURITY_CODE").cast("string").alias("stock_code"), F.split_part(F.col("EM2016"), F.lit("-"), F.lit(1)).alias("industry"))
    return named.groupBy("stock_code").agg(F.max("industry").alias("industry"))


def quotes(lines: DataFrame, value: str = "value") -> DataFrame:
    """v_sz000004="...~...~"; lines as company_code (six digits) and the ratios; lines without a quote are left out."""
    body = F.split(F.regexp_extract(value, r'(?s)="(.*?)"?;?\s*$', 1), "~")
    fields = [(F.get(body, F.lit(at)).try_cast("double") * unit).alias(name) for name, (at, unit) in QUOTE_FIELDS.items()]
    return lines.where(F.contains(F.col(value), F.lit('="'))).select(F.regexp_extract(value, r"(\d{6})=", 1).alias("company_code"), *fields)


def klines(bodies: DataFrame, value: str = "value") -> DataFrame:
    """Daily prices of JSON answers, adjusted ones first. Rows may be longer than six fields. amount is volume (in lots of 100) times close."""
    schema = "data map<string, struct<qfqday: array<array<string>>, day: array<array<string>>>>"
    nodes = bodies.select(F.explode(F.from_json(value, schema)["data"]).alias("code", "node"))
    rows = nodes.select("code", F.explode(F.when(F.size("node.qfqday") > 0, F.col("node.qfqday")).otherwise(F.col("node.day"))).alias("r"))
    out = rows.select(
        F.regexp_extract("code", r"(\d{6})", 1).alias("company_code"),
        F.get("r", F.lit(0)).try_cast("date").alias("trade_date"),
        F.get("r", F.lit(2)).try_cast("double").alias("close"),
        F.get("r", F.lit(5)).try_cast("double").alias("volume"),
    )
    return out.withColumn("amount", F.col("volume") * 100 * F.col("close"))


def news(bodies: DataFrame, company: str = "company", value: str = "value") -> DataFrame:
    """company, date, title, content of JSONP answers; items without a date are left out."""
    schema = "result struct<cmsArticleWebOld: array<struct<date: string, title: string, content: string>>>"
    parsed = F.from_json(F.regexp_extract(value, r"(?s)\((.*)\)", 1), schema)
    items = bodies.select(company, F.explode(parsed["result"]["cmsArticleWebOld"]).alias("i"))
    clean = lambda c: F.trim(F.coalesce(c, F.lit("")))
    return items.select(company, to_day(F.col("i.date")).alias("date"), clean(F.col("i.title")).alias("title"), clean(F.col("i.content")).alias("content")).where("date IS NOT NULL")


def forum_posts(bodies: DataFrame, company: str = "company", value: str = "value") -> DataFrame:
    """company, date, title, content, read_count, comment_count of JSON answers; refused answers (no JSON) and items without a date are left out."""
    schema = "re array<struct<post_publish_time: string, post_title: string, post_content: string, post_click_count: long, post_comment_count: long>>"
    items = bodies.select(company, F.explode(F.from_json(value, schema)["re"]).alias("i"))
    clean = lambda c: F.trim(F.coalesce(c, F.lit("")))
    counts = [F.coalesce(F.col(f"i.post_{c}_count"), F.lit(0)).alias(n) for c, n in (("click", "read_count"), ("comment", "comment_count"))]
    return items.select(company, to_day(F.col("i.post_publish_time")).alias("date"), clean(F.col("i.post_title")).alias("title"), clean(F.col("i.post_content")).alias("content"), *counts).where("date IS NOT NULL")


def label_table(spark: SparkSession, path: str) -> DataFrame:
    """Labels of a CSV file: level, code, name, parent_code, parent_name, type, note."""
    return spark.read.schema("level string, code string, name string, parent_code string, parent_name string, type string, note string").csv(path, header=True, enforceSchema=True)


def concern_keywords(spark: SparkSession, path: str) -> DataFrame:
    """kind ('categories' or 'labels'), name and keywords of a concern dictionary; a missing file has none."""
    schema = "name string, keywords array<string>"
    if not exists(spark, path):
        return spark.createDataFrame([], f"kind string, {schema}")
    entry = "map<string, struct<keywords: array<string>>>"
    rows = spark.read.schema(f"categories {entry}, labels {entry}").json(path, multiLine=True)
    parts = [rows.select(F.lit(k).alias("kind"), F.explode(k).alias("name", "e")).select("kind", "name", F.col("e.keywords").alias("keywords")) for k in ("categories", "labels")]
    return parts[0].unionByName(parts[1])


def classified_points(spark: SparkSession, path: str) -> DataFrame:
    """Classified focus points of JSON lines; a missing file has none."""
    schema = "doc_id string, focus_point string, level_1 string, level_2 string"
    return spark.read.schema(schema).json(path) if exists(spark, path) else spark.createDataFrame([], schema)


def top_holders(rows: DataFrame, most: int = 10) -> DataFrame:
    """Holders of each company's latest day, one per rank (of repeated ones the last by position), ratio from percent to a share.

    rows: company_code, END_DATE, HOLDER_RANK, HOLDER_NAME, HOLD_NUM_RATIO, position."""
    typed = rows.select("company_code", to_day(F.col("END_DATE")).alias("end_date"), F.col("HOLDER_RANK").cast("string").try_cast("int").alias("holder_rank"), F.col("HOLDER_NAME").alias("holder_name"), (F.col("HOLD_NUM_RATIO").cast("string").try_cast("double") / 100).alias("ratio"), "position")
    latest = typed.withColumn("__last", F.max("end_date").over(Window.partitionBy("company_code"))).where((F.col("end_date") == F.col("__last")) & F.col("holder_rank").between(1, most))
    best = F.row_number().over(Window.partitionBy("company_code", "holder_rank").orderBy(F.desc("position")))
    return latest.withColumn("__n", best).where("__n = 1 AND ratio IS NOT NULL").drop("__n", "__last", "position")


def _quoted(word: str) -> str:
    return "".join("\\" + c if c in r"\.[]{}()*+-?^$|&#~" else c for c in word)


def rules_of(dictionary: dict) -> tuple[list[Rule], list[str]]:
    """Rules and negation words of a dictionary. Expressions that cannot be read are left out."""
    rules = []
    for category in dictionary.get("categories", []):
        for r in category.get("rules", []):
            severity = SEVERITIES.get(str(r.get("severity", "")).lower(), 2)
            rules.append(Rule(r["rule_id"], r["label"], severity, tuple(filter(_readable, r.get("regexes", []))), tuple(filter(_readable, r.get("paragraph_exclusion_regexes", []))), tuple(r.get("keywords", []))))
    return [r for r in rules if r.patterns or r.keywords], [_quoted(w) for w in dictionary.get("global_negation_patterns", [])]


def _readable(expression: str) -> bool:
    try:
        re.compile(expression)
    except re.error:
        return False
    return True


def read_rules(path: str) -> tuple[list[Rule], list[str]]:
    """rules_of a JSON file (a few rules, read once where the job is planned)."""
    return rules_of(json.loads(Path(path).read_text(encoding="utf-8")))


def theme_name(code: Column, labels: dict[str, str], themes: dict[str, str]) -> Column:
    """A label's name; of a candidate, its theme's; else that it has none."""
    bare = F.upper(F.trim(F.coalesce(code, F.lit(""))))
    look = lambda names, c: F.try_element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), c) if names else F.lit(None).cast("string")
    candidate = F.when(bare.endswith("-CANDIDATE"), F.concat(look(themes, F.split_part(bare, F.lit("-"), F.lit(1))), F.lit("（待精分类）")))
    return F.when(bare == "", "未标注主题").otherwise(F.coalesce(look(labels, bare), candidate, F.lit("未映射主题")))
