"""Financial features of a panel: one row for each company and report period (YYYYMMDD as a number).

All companies are computed at once. What looks back in time is a window by company; what compares companies of an industry and period is
an aggregation that is joined back, so no task holds a whole industry; the winsorising bounds are one row. Where rows are looked at several
times they are written to the shared folder first, so that what they come from is read once.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskweave.functions.numeric import clip, flag, ratio, safe_div, total_assets
from riskweave.operators.ranking import exact_quantiles, group_z, rank_share
from riskweave.sources.caches import cut

#: Weights of the manipulation score's live indices, its constant, and the indices that are neutral here. Fixed values.
BENEISH = {"constant": -4.84, "gmi": 0.528, "sgi": 0.892, "tata": 4.679, "lvgi": -0.327, "neutral": 0.92 + 0.404 + 0.115 - 0.172}
BENEISH_SUSPECT = -2.22
#: The 95 % point of a chi-square distribution with 8 degrees of freedom. Fixed value.
BENFORD_CRITICAL = 15.507
_PEERS = ["report_period", "industry"]
#: The family's features in their order.
F2_FEATURES = [
    "f2_roe", "f2_roa", "f2_gross_margin", "f2_net_margin", "f2_debt_ratio", "f2_current_ratio", "f2_interest_coverage", "f2_pe", "f2_pb", "f2_log_market_cap",
    "f2_ocf_to_revenue", "f2_ocf_to_profit", "f2_roe_industry_rank", "f2_loss_flag", "f2_high_debt_flag",
    "f2_accruals", "f2_accruals_to_assets", "f2_accruals_to_revenue", "f2_ocf_to_assets", "f2_profit_ocf_diverge", "f2_accrual_quality_zscore",
    "f2_neg_accruals_flag", "f2_ocf_volatility_4q", "f2_ocf_to_profit_extreme", "f2_accruals_trend",
    "f2_gmi", "f2_sgi", "f2_lvgi", "f2_tata", "f2_beneish_m", "f2_dsri", "f2_aqi", "f2_depi", "f2_sgai",
    "f2_p_roa", "f2_p_cfo", "f2_p_droa", "f2_p_accrual", "f2_p_dlever", "f2_p_dmargin", "f2_p_dturnover", "f2_p_score", "f2_p_dliquid", "f2_p_equity",
    "f2_benford_chi2_revenue", "f2_benford_chi2_profit", "f2_benford_chi2_ocf", "f2_benford_max_dev", "f2_benford_flag",
    "f2_roe_qoq", "f2_revenue_qoq", "f2_profit_qoq", "f2_roe_yoy", "f2_roe_decline_streak", "f2_profit_decline_streak", "f2_roe_volatility",
    "f2_profit_volatility", "f2_revenue_volatility", "f2_trend_deterioration",
    "f2_z_roe", "f2_z_net_margin", "f2_z_debt_ratio", "f2_z_revenue_yoy", "f2_z_profit_yoy", "f2_z_pe", "f2_z_pb", "f2_industry_outlier_count",
]


def _unknown() -> Column:
    """The value of features that need accounts the panel does not have."""
    return F.lit(None).cast("double")


def _time():
    return Window.partitionBy("company_code").orderBy("report_period")


def _last_4():
    return _time().rowsBetween(-3, 0)


def _lag(c: str | Column, n: int = 1) -> Column:
    return F.lag(c, n).over(_time())


def _assets() -> Column:
    return total_assets(*map(F.col, ("net_profit", "roa", "market_cap", "pb_ratio", "debt_to_assets_ratio")))


def with_growth(panel: DataFrame) -> DataFrame:
    """Growth over four periods, in percent."""
    grown = lambda c: 100 * (safe_div(F.col(c), _lag(c, 4)) - 1)
    return panel.withColumns({"revenue_yoy_growth": grown("total_revenue"), "net_profit_yoy_growth": grown("net_profit")})


def direct(panel: DataFrame) -> DataFrame:
    """Margins, solvency and their flags: what one row says by itself. Gross margin, current ratio and interest coverage are not known."""
    c = F.col
    return panel.withColumns({
        "f2_roe": c("roe"), "f2_roa": c("roa"), "f2_gross_margin": _unknown(), "f2_debt_ratio": c("debt_to_assets_ratio"), "f2_current_ratio": _unknown(),
        "f2_interest_coverage": _unknown(), "f2_pe": c("pe_ratio"), "f2_pb": c("pb_ratio"),
        "f2_net_margin": safe_div(c("net_profit"), c("total_revenue")),
        "f2_log_market_cap": F.log(F.greatest(c("market_cap"), F.lit(1.0))),
        "f2_ocf_to_revenue": safe_div(c("operating_cash_flow"), c("total_revenue")),
        "f2_ocf_to_profit": safe_div(c("operating_cash_flow"), c("net_profit")),
        "f2_loss_flag": flag(c("net_profit") < 0),
        "f2_high_debt_flag": flag(c("debt_to_assets_ratio") > 70),
    })


def profitability(panel: DataFrame) -> DataFrame:
    """direct, and the rank of roe in its industry and period."""
    return rank_share(cut(direct(panel)), _PEERS, "roe", "f2_roe_industry_rank")


def accruals(panel: DataFrame) -> DataFrame:
    """Earnings quality but for what compares companies."""
    c = F.col
    profit, cash = c("net_profit"), c("operating_cash_flow")
    by_cash = safe_div(cash, profit)
    out = panel.withColumn("f2_accruals", profit - cash).withColumn("f2_accruals_to_assets", safe_div(c("f2_accruals"), _assets()))
    return out.withColumn("f2_place", F.row_number().over(_time()).cast("double")).withColumns({
        "f2_accruals_to_revenue": safe_div(c("f2_accruals"), c("total_revenue")),
        "f2_ocf_to_assets": safe_div(cash, _assets()),
        "f2_profit_ocf_diverge": flag(((profit > 0) & (cash < 0)) | ((profit < 0) & (cash > 0))),
        "f2_neg_accruals_flag": flag(c("f2_accruals") < 0),
        "f2_ocf_volatility_4q": F.stddev_samp("operating_cash_flow").over(_last_4()),
        "f2_ocf_to_profit_extreme": flag((by_cash > 5) | (by_cash < -1)),
        "f2_accruals_trend": F.when(F.count("f2_accruals_to_assets").over(_last_4()) >= 3, F.regr_slope("f2_accruals_to_assets", "f2_place").over(_last_4())),
    }).drop("f2_place")


def earnings_quality(panel: DataFrame) -> DataFrame:
    """accruals, and their z-score in industry and period (0 where it has none)."""
    return group_z(accruals(panel), _PEERS, {"f2_accrual_quality_zscore": F.col("f2_accruals_to_assets")}, {"f2_accrual_quality_zscore": 0.0})


def beneish(panel: DataFrame) -> DataFrame:
    """Indices winsorised at their 1st and 99th percentiles (exact, over the whole panel) and the manipulation score."""
    c = F.col
    raw = cut(panel.withColumns({
        "f2_gmi": safe_div(_lag("roa"), c("roa")),
        "f2_sgi": safe_div(c("total_revenue"), _lag("total_revenue")),
        "f2_lvgi": safe_div(c("debt_to_assets_ratio"), _lag("debt_to_assets_ratio")),
        "f2_tata": safe_div(c("net_profit") - c("operating_cash_flow"), _assets()),
    }))
    names = ("gmi", "sgi", "tata", "lvgi")
    bounds = exact_quantiles(raw, [f"f2_{n}" for n in names], (0.01, 0.99), least=3).withColumnsRenamed({f"f2_{n}": f"__{n}" for n in names})
    held = lambda n: F.when(c(f"__{n}").isNull(), c(f"f2_{n}")).otherwise(clip(c(f"f2_{n}"), c(f"__{n}")[0], c(f"__{n}")[1]))
    score = F.lit(BENEISH["constant"]) + sum(BENEISH[n] * F.coalesce(held(n), F.lit(0.0 if n == "tata" else 1.0)) for n in names) + BENEISH["neutral"]
    out = raw.join(F.broadcast(bounds)).withColumn("f2_beneish_m", score).drop(*[f"__{n}" for n in names])  # bounds has one row
    return out.withColumns({f"f2_{n}": _unknown() for n in ("dsri", "aqi", "depi", "sgai")})


def piotroski(panel: DataFrame) -> DataFrame:
    c = F.col
    base = panel.withColumns({"__margin": safe_div(c("net_profit"), c("total_revenue")), "__turnover": safe_div(c("total_revenue"), _assets())})
    flags = {
        "f2_p_roa": c("roa") > 0,
        "f2_p_cfo": c("operating_cash_flow") > 0,
        "f2_p_droa": c("roa") > _lag("roa"),
        "f2_p_accrual": c("operating_cash_flow") > c("net_profit"),
        "f2_p_dlever": c("debt_to_assets_ratio") < _lag("debt_to_assets_ratio"),
        "f2_p_dmargin": c("__margin") > _lag("__margin"),
        "f2_p_dturnover": c("__turnover") > _lag("__turnover"),
    }
    out = base.withColumns({n: flag(x) for n, x in flags.items()})
    neutral = {n: F.lit(0.5) for n in ("f2_p_dliquid", "f2_p_equity")}  # not known, and not in the score
    return out.withColumns({"f2_p_score": sum(c(n) for n in flags), **neutral}).drop("__margin", "__turnover")


def _digit(x: Column) -> Column:
    return F.when(x > 0, F.floor(x / F.pow(F.lit(10.0), F.floor(F.log10(x)))).cast("int"))


_BENFORD = {"revenue": "total_revenue", "profit": "net_profit", "ocf": "operating_cash_flow"}


def _chi2(counts: DataFrame) -> DataFrame:
    """Chi-squares of the numbers of first digits in columns {name}{digit}, which go; the largest, and a flag."""

    def chi2(n: str) -> Column:
        total = sum(F.col(f"{n}{d}") for d in range(1, 10))
        parts = [F.pow(F.col(f"{n}{d}") - total * math.log10(1 + 1 / d), 2) / (total * math.log10(1 + 1 / d)) for d in range(1, 10)]
        return F.when(total >= 3, sum(parts))

    out = counts.withColumns({f"f2_benford_chi2_{n}": chi2(n) for n in _BENFORD}).drop(*[f"{n}{d}" for n in _BENFORD for d in range(1, 10)])
    out = out.withColumn("f2_benford_max_dev", F.greatest(*[F.col(f"f2_benford_chi2_{n}") for n in _BENFORD]))
    return out.withColumn("f2_benford_flag", flag(F.col("f2_benford_max_dev") > BENFORD_CRITICAL))


def benford(panel: DataFrame) -> DataFrame:
    """One row per company: chi-square of first digits of revenue, profit and cash flow, the largest, and a flag."""
    digits = panel.select("company_code", *[_digit(F.col(x)).alias(n) for n, x in _BENFORD.items()])
    return _chi2(digits.groupBy("company_code").agg(*[F.count_if(F.col(n) == d).alias(f"{n}{d}") for n in _BENFORD for d in range(1, 10)]))


def with_benford(panel: DataFrame) -> DataFrame:
    """panel with benford's columns on every row, by windows by company: for frames that have such windows anyway."""
    own = Window.partitionBy("company_code")
    digits = panel.withColumns({f"__{n}": _digit(F.col(x)) for n, x in _BENFORD.items()})
    counted = digits.withColumns({f"{n}{d}": F.count_if(F.col(f"__{n}") == d).over(own) for n in _BENFORD for d in range(1, 10)})
    return _chi2(counted).drop(*[f"__{n}" for n in _BENFORD])


def _streak(df: DataFrame, column: str, name: str) -> DataFrame:
    """How many periods in a row the column has fallen; a missing value begins anew."""
    fell = flag(F.col(column) < _lag(column))
    steps = df.withColumn("__fell", fell).withColumn("__run", F.sum(1 - F.col("__fell")).over(_time()))
    run = Window.partitionBy("company_code", "__run").orderBy("report_period")
    return steps.withColumn(name, F.sum("__fell").over(run).cast("int")).drop("__fell", "__run")


def trends(panel: DataFrame) -> DataFrame:
    """Changes, streaks of decline, rolling volatility and the number of signs of deterioration."""
    c = F.col
    filled = F.last("roe", ignorenulls=True).over(_time())
    out = panel.withColumn("__roe", filled).withColumns({
        "f2_roe_qoq": c("roe") - _lag("roe"),
        "f2_revenue_qoq": c("total_revenue") - _lag("total_revenue"),
        "f2_profit_qoq": c("net_profit") - _lag("net_profit"),
        "f2_roe_yoy": safe_div(c("__roe"), _lag("__roe", 4)) - 1,
        "f2_roe_volatility": F.stddev_samp("roe").over(_last_4()),
        "f2_profit_volatility": F.stddev_samp("net_profit").over(_last_4()),
        "f2_revenue_volatility": F.stddev_samp("total_revenue").over(_last_4()),
    }).drop("__roe")
    out = _streak(_streak(out, "roe", "f2_roe_decline_streak"), "net_profit", "f2_profit_decline_streak")
    signs = [c("f2_roe_qoq") < 0, c("f2_revenue_qoq") < 0, c("f2_profit_qoq") < 0, c("f2_roe_decline_streak") >= 2, c("f2_profit_decline_streak") >= 2]
    return out.withColumn("f2_trend_deterioration", sum(map(flag, signs)))


def _deviations() -> dict[str, Column]:
    c = F.col
    return {
        "f2_z_roe": c("roe"), "f2_z_net_margin": safe_div(c("net_profit"), c("total_revenue")), "f2_z_debt_ratio": c("debt_to_assets_ratio"),
        "f2_z_revenue_yoy": c("revenue_yoy_growth"), "f2_z_profit_yoy": c("net_profit_yoy_growth"), "f2_z_pe": c("pe_ratio"), "f2_z_pb": c("pb_ratio"),
    }


def _outliers() -> Column:
    return sum(flag(F.abs(F.col(n)) > 1.96) for n in _deviations())


def industry_deviation(panel: DataFrame) -> DataFrame:
    """z-scores among the companies of an industry in a period, and how many are beyond 1.96. panel needs the growth columns."""
    return group_z(panel, _PEERS, _deviations()).withColumn("f2_industry_outlier_count", _outliers())


def roe_slope(panel: DataFrame) -> DataFrame:
    """One row per company: slope of its last four known values of roe; 0 with fewer than two."""
    return with_roe_slope(panel).groupBy("company_code").agg(F.max("roe_trend_4q").alias("roe_trend_4q"))


def with_roe_slope(panel: DataFrame) -> DataFrame:
    """panel with the slope of its company's last four known values of roe on every row."""
    back = F.count("roe").over(Window.partitionBy("company_code").orderBy(F.desc("report_period")))
    own = Window.partitionBy("company_code")
    rows = panel.withColumn("__back", F.when(F.col("roe").isNotNull() & (back <= 4), -back.cast("double")))
    last = F.when(F.col("__back").isNotNull(), F.col("roe"))
    slope = F.when(F.count("__back").over(own) >= 2, F.round(F.regr_slope(last, F.col("__back")).over(own), 4)).otherwise(0.0)
    return rows.withColumn("roe_trend_4q", F.coalesce(slope, F.lit(0.0))).drop("__back")


def f2_all(panel: DataFrame) -> DataFrame:
    """Keys, the period's date, year and quarter, and the 67 features of the family for every row. panel needs the growth columns."""
    day = F.to_date(F.col("report_period").cast("string"), "yyyyMMdd")
    own = cut(with_benford(trends(piotroski(accruals(beneish(direct(panel)))))))
    peers = {"f2_accrual_quality_zscore": F.col("f2_accruals_to_assets"), **_deviations()}
    compared = rank_share(group_z(own, _PEERS, peers, {"f2_accrual_quality_zscore": 0.0}), _PEERS, "roe", "f2_roe_industry_rank")
    compared = compared.withColumn("f2_industry_outlier_count", _outliers())
    return compared.select("company_code", "industry", "report_period", day.alias("report_date"), F.year(day).alias("year"), F.quarter(day).alias("quarter"), *F2_FEATURES)


def latest(panel: DataFrame, as_of: int | None = None) -> DataFrame:
    """The latest row of each company, not after as_of."""
    rows = panel if as_of is None else panel.where(F.col("report_period") <= as_of)
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy("company_code").orderBy(F.desc("report_period")))).where("__n = 1").drop("__n")


def industry_benchmark(panel: DataFrame, metric: str = "roe", least: int = 3) -> DataFrame:
    """The latest row of each company against its industry: peers of the same period if there are `least` companies, else of all periods."""
    value = F.col(metric)
    stats = lambda: (F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.count(value).alias("n"), F.count_distinct("company_code").alias("companies"))
    same = panel.groupBy("industry", "report_period").agg(F.struct(*stats()).alias("same"))
    every = panel.groupBy("industry").agg(F.struct(*stats()).alias("every"))
    rows = latest(panel).join(same, ["industry", "report_period"], "left").join(every, "industry", "left")
    rows = rows.withColumn("peer", F.when(F.col("same.companies") >= least, F.col("same")).otherwise(F.col("every")))
    z = F.when((F.col("peer.n") >= 2) & (F.col("peer.sd") > 0), F.round((value - F.col("peer.mean")) / F.col("peer.sd"), 3))
    return rows.select("company_code", "industry", "report_period", value, F.col("peer.companies").alias("n_peers"), z.alias(f"{metric}_zscore"))


def _anomaly(condition: Column, kind: str, severity: int, value: Column) -> Column:
    return F.when(F.coalesce(condition, F.lit(False)), F.struct(F.lit(kind).alias("indicator"), F.lit(severity).alias("severity"), value.cast("double").alias("value")))


def anomalies(rows: DataFrame, z_columns: list[str] = ()) -> DataFrame:
    """rows (latest of each company) with anomaly_list, n_anomalies, max_severity and risk_level. Rules whose columns are absent are left out."""
    c, has = F.col, set(rows.columns).issuperset
    cash = ratio(c("operating_cash_flow"), c("net_profit"))
    both = (c("net_profit") < 0) & (c("operating_cash_flow") < 0)
    rules = [F.coalesce(_anomaly(both, "cf_income_ratio", 4, cash), _anomaly(cash < 1.0, "cf_income_ratio", 3, cash)), _anomaly(c("debt_to_assets_ratio") > 70, "debt_to_assets_ratio", 3, c("debt_to_assets_ratio")), _anomaly(c("roe") < 0, "roe", 4, c("roe"))]
    for name, found, severity in (
        ("roe_trend_4q", lambda x: x < -5, 4), ("f2_beneish_m", lambda x: x > BENEISH_SUSPECT, 4), ("f2_benford_flag", lambda x: x == 1, 3), ("f2_trend_deterioration", lambda x: x >= 4, 3),
    ):
        if has([name]):
            rules.append(_anomaly(found(c(name)), name, severity, c(name)))
    rules += [_anomaly(F.abs(c(z)) > 2, z.removesuffix("_zscore"), 2, c(z)) for z in z_columns]
    out = rows.withColumn("anomaly_list", F.filter(F.array(*rules), lambda x: x.isNotNull()))
    n = F.size("anomaly_list")
    return out.withColumns({
        "n_anomalies": n,
        "max_severity": F.coalesce(F.array_max(F.transform("anomaly_list", lambda x: x["severity"])), F.lit(0)),
        "risk_level": F.when(n >= 3, "高").when(n >= 1, "中").otherwise("低"),
    })
