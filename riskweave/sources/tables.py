"""Readers with fixed schemas, and the engine's tables as they are made from the supplied star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskweave.functions.disclosure import event_type, inquiry_date
from riskweave.functions.numeric import safe_div
from riskweave.operators.linking import joined_paragraphs
from riskweave.sources.caches import exists

#: Schemas of landing files.
MARKET = "company_code string, trade_date date, close double, volume double, amount double"
INQUIRIES = "secucode string, year int, kind string, date date, type string"
LETTERS = "doc_id string, doc_type string, stock_code string, publish_date string, title string, paragraphs array<struct<text:string>>"
HOLDERS = "company_code string, end_date date, holder_rank int, holder_name string, ratio double"


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header, with or without a byte-order mark."""
    return spark.read.schema(schema).option("encoding", "UTF-8").csv(path, header=True, enforceSchema=True)


def read_features(spark: SparkSession, path: str, keys: dict[str, str], features: list[str]) -> DataFrame:
    """CSV read as text, keys kept as they are (leading zeros too), features as numbers or null."""
    rows = spark.read.csv(path, header=True, inferSchema=False)
    return rows.select(*[F.col(c).cast(t).alias(c) for c, t in keys.items()], *[F.col(c).try_cast("double").alias(c) for c in features])


def read_lines(spark: SparkSession, path: str, schema: str, types: list[str] | None = None, type_col: str = "doc_type", most: int | None = None) -> DataFrame:
    """JSON lines, of certain types only; of those `most` if given."""
    rows = spark.read.schema(schema).json(path)
    rows = rows.where(F.col(type_col).isin(types)) if types else rows
    return rows if most is None else rows.limit(most)


def replies_by_company(spark: SparkSession, path: str) -> DataFrame:
    """Replies of JSON lines: stock_code, publish_date (as a date, null if it is none), doc_id and text."""
    rows = read_lines(spark, path, LETTERS, ["inquiry_reply"])
    return rows.select("stock_code", F.regexp_replace(F.substring("publish_date", 1, 10), "/", "-").try_cast("date").alias("publish_date"), "doc_id", joined_paragraphs(F.col("paragraphs")).alias("text"))


def read_inquiries(spark: SparkSession, path: str, files: DataFrame | None = None) -> DataFrame:
    """Inquiry events of a CSV file; if there is none, those that `files` (see letters_of) gives."""
    if exists(spark, path) or files is None:
        return spark.read.schema(INQUIRIES).option("encoding", "UTF-8").csv(path, header=True, enforceSchema=True, dateFormat="yyyy-MM-dd")
    return letters_of(files)


def letters_of(files: DataFrame) -> DataFrame:
    """Events of letters' and replies' texts (secucode, year, type of file, text): the day named last, else the middle of the year; replies
    have no type."""
    year, reply = F.col("year").cast("int"), F.contains("type", F.lit("回复"))
    return files.select(
        "secucode", year.alias("year"), F.when(reply, "reply").otherwise("letter").alias("kind"), F.coalesce(inquiry_date(F.col("text"), year), F.make_date(year, F.lit(6), F.lit(30))).alias("date"),
        F.when(reply, "").otherwise(event_type(F.col("text"))).alias("type"),
    )


def newest_reports(files: DataFrame, most: int = 2) -> DataFrame:
    """Files (company, year, path, ...) of each company's newest years, newest first by `place`."""
    place = F.dense_rank().over(Window.partitionBy("company").orderBy(F.desc(F.col("year").cast("int"))))
    return files.withColumn("place", place).where(F.col("place") <= most)


def read_files(spark: SparkSession, folder: str, pattern: str = "*.pdf") -> DataFrame:
    """Files of a {year}/{type}/ tree: path, year, type, length, content."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(folder)
    return rows.select("path", F.regexp_extract("path", r"/(\d{4})/[^/]+/[^/]+$", 1).alias("year"), F.regexp_extract("path", r"/\d{4}/([^/]+)/[^/]+$", 1).alias("type"), "length", "content")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fin_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A financial panel of suppliers and quarters. Money is summed in whole cents, so sums do not depend on their order."""
    lines = table(spark, sf_dir, "lineitem")
    cents = F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")) * 100).cast("long")
    day = F.col("l_shipdate").cast("date")
    ends = F.element_at(F.array(*map(F.lit, (331, 630, 930, 1231))), F.quarter(day))
    money = lambda c: F.sum(c) / F.lit(100.0)
    rows = lines.select(F.col("l_suppkey").alias("company_code"), (F.year(day) * 10000 + ends).alias("report_period"), cents.alias("cents"), "l_returnflag", "l_linestatus", "l_quantity")
    sums = rows.groupBy("company_code", "report_period").agg(
        money("cents").alias("total_revenue"),
        money(F.when(F.col("l_returnflag") == "R", -F.col("cents")).otherwise(F.col("cents"))).alias("net_profit"),
        money(F.when(F.col("l_linestatus") == "O", -F.col("cents")).otherwise(F.col("cents"))).alias("operating_cash_flow"),
        money(F.when(F.col("l_returnflag") != "N", F.col("cents")).otherwise(0)).alias("owed"),
        (F.sum(F.col("l_quantity").cast("long")) * F.lit(1000.0)).alias("market_cap"),
    )
    suppliers = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("company_code"), F.col("s_nationkey").alias("industry"))
    full = sums.join(suppliers, "company_code").withColumns({
        "roe": 100 * safe_div(F.col("net_profit"), F.col("total_revenue")),
        "debt_to_assets_ratio": 100 * safe_div(F.col("owed"), F.col("total_revenue")),
        "pe_ratio": safe_div(F.col("market_cap"), F.col("net_profit")),
        "pb_ratio": safe_div(F.col("market_cap"), F.col("total_revenue")),
    })
    return full.withColumn("roa", F.col("roe") / 2).drop("owed")


def market_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily prices of nations: mean order price as close, orders as volume, their sum as amount."""
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("company_code"))
    orders = table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderdate").cast("date").alias("trade_date"), F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"))
    return orders.join(customers, "o_custkey").groupBy("company_code", "trade_date").agg(
        (F.sum("cents") / F.lit(100.0) / F.count("*")).alias("close"), F.count("*").alias("volume"), (F.sum("cents") / F.lit(100.0)).alias("amount")
    )


def market_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("date").alias("trade_date"), F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"))
    return orders.groupBy("trade_date").agg((F.sum("cents") / F.lit(100.0) / F.count("*")).alias("close"))


def inquiry_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Letters (finished orders) and replies (open ones) of customers."""
    kinds = {"1-URGENT": "attention", "2-HIGH": "annual_report", "3-MEDIUM": "restructuring", "4-NOT SPECIFIED": "semi_report", "5-LOW": "quarterly"}
    named = F.element_at(F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv]), F.col("o_orderpriority"))
    orders = table(spark, sf_dir, "orders").where(F.col("o_orderstatus").isin("F", "O"))
    letter = F.col("o_orderstatus") == "F"
    return orders.select(
        F.col("o_custkey").alias("secucode"),
        F.col("o_orderkey").alias("event_id"),
        F.when(letter, "letter").otherwise("reply").alias("kind"),
        F.col("o_orderdate").cast("date").alias("date"),
        F.when(letter, F.coalesce(named, F.lit("other"))).otherwise("").alias("type"),
    )


def announcements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as announcements of their sources, dated over a year, titled by their first line."""
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 365).cast("int"))
    text = F.coalesce("text", F.lit(""))
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("announcement_id"), F.col("source").alias("company"), day.alias("date"), F.split_part(text, F.lit("\n"), F.lit(1)).alias("title"), text.alias("text")
    )


def news(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        "event_id", (F.col("user_id") % 20).alias("company"), F.col("ts").cast("date").alias("date"), F.col("event_type").alias("title"), "value"
    )


def holders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as holders of parts, by quantity."""
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("company"), F.col("l_suppkey").alias("holder")).agg(F.sum(F.col("l_quantity").cast("long")).alias("shares"))


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """News as posts that are read and commented on."""
    counts = [(F.col("event_id") % 17).alias("comment_count"), (F.col("event_id") % 101).alias("read_count")]
    return news(spark, sf_dir).select("company", "date", "title", *counts)


def quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A snapshot of nations: customers' balances as market value, their number and the number in debt as what it is a multiple of."""
    rows = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("company_code")).agg(
        (F.sum(F.round(F.col("c_acctbal") * 100).cast("long")) / F.lit(100.0)).alias("market_cap"),
        F.count("*").cast("double").alias("n"),
        F.count_if(F.col("c_acctbal") < 0).cast("double").alias("owing"),
    )
    return rows.select("company_code", "market_cap", safe_div(F.col("market_cap"), F.col("n")).alias("pe_ratio"), safe_div(F.col("market_cap"), F.col("owing")).alias("pb_ratio"))


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as cases of companies, dated over a year; one in 13 has no date."""
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("vec_id") % 365).cast("int"))
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("case_id"), F.col("label").alias("focus_point"), "embedding", F.when(F.col("vec_id") % 13 != 0, day).alias("publish_date"), (F.col("vec_id") % 11).alias("company")
    )
