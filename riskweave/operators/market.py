"""Market features over the last trading days of each company, as trailing windows on every day (company_code, trade_date, close, volume, amount)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskweave.functions.numeric import safe_div


#: The family's features in their order. Fifteen need feeds that are not there and are null.
F3_FEATURES = [
    "mkt_market_cap", "mkt_log_market_cap", "mkt_pe_ratio", "mkt_pb_ratio", "mkt_market_cap_qoq", "mkt_pe_change_qoq", "mkt_pb_change_qoq",
    "mkt_cap_industry_zscore", "mkt_pb_industry_zscore",
    "mkt_return_5d", "mkt_return_20d", "mkt_return_60d", "mkt_excess_return_20d", "mkt_volatility_20d", "mkt_volatility_60d", "mkt_max_drawdown_60d",
    "mkt_extreme_down_days_20d",
    "mkt_volume_ratio_20d", "mkt_amount_ratio_20d", "mkt_volume_cv_20d", "mkt_amount_cv_20d", "mkt_abnormal_volume_days_20d", "mkt_zero_volume_days_20d",
    "mkt_amihud_illiquidity_20d",
    "mkt_financing_balance", "mkt_securities_balance", "mkt_margin_total_balance", "mkt_financing_balance_change",
    "mkt_institutional_holding_ratio", "mkt_institutional_holding_change", "mkt_institutional_holder_count",
    "mkt_risk_warning_count_30d", "mkt_risk_warning_count_90d", "mkt_risk_warning_flag_30d", "mkt_days_since_last_risk_warning",
]


def _time():
    return Window.partitionBy("company_code").orderBy("trade_date")


def _last(n: int, skip: int = 0):
    return _time().rowsBetween(-(n - 1), -skip)


def with_return(daily: DataFrame) -> DataFrame:
    return daily.withColumn("ret", safe_div(F.col("close"), F.lag("close").over(_time())) - 1)


def _compound(n: int, ret: str = "ret", window=None) -> Column:
    window = window or _last(n)
    return F.when(F.count(ret).over(window) == n, F.exp(F.sum(F.log1p(ret)).over(window)) - 1)


def returns(daily: DataFrame, index: DataFrame) -> DataFrame:
    """Compound returns over 5, 20 and 60 days, the excess over the index on the same days, and volatility. The index is a series of days,
    not of companies, and is joined on the day."""
    own = with_return(daily)
    base = index.withColumn("company_code", F.lit(0))
    base = with_return(base).withColumn("index_return_20d", _compound(20)).select("trade_date", "index_return_20d")
    full = lambda n, x: F.when(F.count("ret").over(_last(n)) == n, x)
    out = own.withColumns({f"mkt_return_{n}d": _compound(n) for n in (5, 20, 60)} | {f"mkt_volatility_{n}d": full(n, F.stddev_samp("ret").over(_last(n))) for n in (20, 60)})
    out = out.withColumn("mkt_extreme_down_days_20d", full(20, F.count_if(F.col("ret") < -0.05).over(_last(20))))
    return out.join(base, "trade_date", "left").withColumn("mkt_excess_return_20d", F.col("mkt_return_20d") - F.col("index_return_20d")).drop("index_return_20d")


def latest_drawdown(daily: DataFrame, n: int = 60) -> DataFrame:
    """Largest fall from a peak over the last n returns of each company; the peak begins after the first return. Null with fewer."""
    back = Window.partitionBy("company_code").orderBy(F.desc("trade_date"))
    rows = with_return(daily).withColumn("back", F.row_number().over(back)).where(F.col("back") <= n)
    rows = rows.withColumn("wealth", F.exp(F.sum(F.log1p("ret")).over(_time()))).withColumn("peak", F.max("wealth").over(_time()))
    fall = F.min(F.col("wealth") / F.col("peak") - 1)
    return rows.groupBy("company_code").agg(F.when(F.count("ret") == n, fall).alias("mkt_max_drawdown_60d"))


def liquidity(daily: DataFrame) -> DataFrame:
    """Volume against the days before, its variation, days of unusual volume, and illiquidity, over 20 days."""
    own = with_return(daily)
    full = lambda x: F.when(F.count("volume").over(_last(20)) == 20, x)
    volumes = F.collect_list(F.col("volume").cast("double")).over(_last(20))
    spread = {c: (F.avg(c).over(_last(20)), F.stddev_samp(c).over(_last(20))) for c in ("volume", "amount")}
    mean, deviation = spread["volume"]
    out = own.withColumns({"__v": volumes, "__high": mean + 2 * deviation, "__cost": F.when(F.col("amount") > 0, safe_div(F.abs("ret"), F.col("amount") / 1e6))})
    return out.withColumns({
        "mkt_volume_ratio_20d": full(safe_div(F.col("volume").cast("double"), F.avg("volume").over(_last(20, 1)))),
        "mkt_amount_ratio_20d": full(safe_div(F.col("amount"), F.avg("amount").over(_last(20, 1)))),
        "mkt_volume_cv_20d": full(safe_div(deviation, mean)),
        "mkt_amount_cv_20d": full(safe_div(spread["amount"][1], spread["amount"][0])),
        "mkt_abnormal_volume_days_20d": full(F.size(F.filter("__v", lambda v: v > F.col("__high")))),
        "mkt_zero_volume_days_20d": full(F.size(F.filter("__v", lambda v: v == 0))),
        "mkt_amihud_illiquidity_20d": full(F.when(F.count("__cost").over(_last(20)) >= 15, F.avg("__cost").over(_last(20)))),
        "mkt_market_cap_qoq": safe_div(F.col("close"), F.lag("close", 63).over(_time())) - 1,
    }).drop("__v", "__high", "__cost")


def f3_all(daily: DataFrame, index: DataFrame, quotes: DataFrame) -> DataFrame:
    """company_code, trade_date and the family's 35 features on each company's last day. quotes: company_code, market_cap, pe_ratio, pb_ratio."""
    rows = returns(daily, index).join(liquidity(daily).drop(*[c for c in daily.columns if c not in ("company_code", "trade_date")], "ret"), ["company_code", "trade_date"])
    last = rows.withColumn("__n", F.row_number().over(Window.partitionBy("company_code").orderBy(F.desc("trade_date")))).where("__n = 1")
    full = last.join(latest_drawdown(daily), "company_code", "left").join(quotes.select("company_code", "market_cap", "pe_ratio", "pb_ratio"), "company_code", "left")
    cap = F.col("market_cap")
    known = full.withColumns({"mkt_market_cap": cap, "mkt_log_market_cap": F.when(cap >= 0, F.log1p(cap)), "mkt_pe_ratio": F.col("pe_ratio"), "mkt_pb_ratio": F.col("pb_ratio")})
    return known.select("company_code", "trade_date", *[c if c in known.columns else F.lit(None).cast("double").alias(c) for c in F3_FEATURES])
