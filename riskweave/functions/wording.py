"""Word lists and patterns of the trade that results depend on. All of this module's tables are fixed values, in the order in which they are tried."""

from __future__ import annotations

from typing import NamedTuple

# Patterns in titles (white space taken out, case ignored) that keep an announcement in, whatever else its title has.
TITLE_OVERRIDES = [
    ("risk_title_override", p)
    for p in (
        r"立案(?:告知书|调查|通知)",
        r"行政处罚(?:决定书|事先告知书)?",
        r"监管措施|纪律处分|警示函|公开谴责|通报批评",
        r"问询函|关注函",
        r"辞职|解聘|免职|无法履职|失联|留置|拘留|逮捕|强制措施",
        r"股份冻结|轮候冻结|强制平仓",
        r"(?:违规|非经营性)资金占用|违规担保|债务逾期|债券违约",
        r"重大诉讼|重大仲裁",
        r"(?:拟|预计|关于)?计提.{0,16}(?:减值|坏账)准备",
        r"业绩预告|退市风险警示|终止上市风险",
    )
]
# Groups of patterns in titles of rules, declarations and policies, which are not read.
TITLE_EXCLUSIONS = [
    ("governance_rules", r"公司章程(?:修订案|（.*?修订.*?）|\(.*?修订.*?\))?$"),
    ("governance_rules", r"(?:修订|修正).{0,8}[《]?公司章程"),
    ("governance_rules", r"(?:股东大[会]|董事会|监事会)议事规则"),
    ("governance_rules", r"独立董事(?:工作|专门会议|年报工作)制度"),
    ("governance_rules", r"董事会.{0,20}委员会.{0,12}(?:工作细则|议事规则)"),
    ("governance_rules", r"(?:董事|监事|高级管理人员|董监高).{0,16}(?:行为规范|管理制度|履职评价办法)"),
    ("governance_rules", r"累积投票(?:制)?实施细则"),
    ("candidate_declaration", r"(?:独立董事)?候选人(?:声明|履历|承诺)"),
    ("candidate_declaration", r"独立董事提名人声明"),
    ("candidate_declaration", r"关于独立董事.{0,20}任职资格.{0,12}(?:声明|意见|审核)"),
    ("general_management_policy", r"(?:对外担保|关联交易|募集资金|信息披露|内幕信息知情人|投资者关系|内部控制|合规)管理制度"),
    ("general_management_policy", r"防范.{0,20}(?:控股股东|关联方).{0,20}资金占用.{0,12}(?:制度|办法)"),
    ("general_management_policy", r"资产减值准备管理制度"),
    ("general_management_policy", r"会计政策(?:和会计估计)?(?:管理办法|制度)$"),
]


class Wording(NamedTuple):
    """Contexts in which a hit is no event: wording of rules and templates, accounting policy (for labels with `accounting_labels` in
    front), and, by label, who must act and what must have been done."""

    normative: tuple[tuple[str, str], ...] = ()
    accounting: str = ""
    accounting_labels: str = "C"
    anchors: tuple[tuple[str, str, str], ...] = ()


# Fixed values.
CHINESE = Wording(
    normative=(
        ("governance_eligibility_clause", r"因涉嫌证券期货违法犯罪.{0,120}被中国证监会立案调查.{0,80}(?:或者被司法机关立案侦查|尚未有明确结论)"),
        ("governance_eligibility_clause", r"(?:候选人|被提名人|董事|监事|高级管理人员|董监高).{0,180}(?:不得|不应|不具备|任职资格)"),
        ("governance_eligibility_clause", r"(?:不得|不应|不具备).{0,180}(?:候选人|被提名人|董事|监事|高级管理人员|董监高)"),
        ("conditional_or_hypothetical_clause", r"(?:存在|发生|出现)下列情形之一|(?:如|若|假如|一旦).{0,100}(?:发生|存在|出现)"),
        ("prohibition_or_duty_clause", r"(?:应当|不得|禁止|严禁|有权).{0,100}(?:立案调查|行政处罚|监管措施|资金占用|违规担保|减值准备)"),
        ("definition_or_template_clause", r"(?:本制度所称|是指|释义|附件模板|填写说明).{0,140}"),
    ),
    accounting=(
        r"(?:会计政策|会计估计|计提方法|计提比例|减值测试方法)"
        r"|(?:存在|出现)减值迹象时.{0,80}(?:应当|需|应)计提"
        r"|(?:减值|坏账)准备.{0,60}按(?:单项|组合|账龄|比例)计提"
        r"|(?:信用|资产)减值损失.{0,40}损失以.{0,8}[—－-].{0,8}号填列"
        r"|项目.{0,30}(?:本期发生额|本期金额).{0,30}(?:上期发生额|上期金额)"
    ),
    anchors=(
        (
            "G07",
            r"公司|本公司|上市公司|控股股东|实际控制人|董事|监事|高级管理人员|董监高",
            r"收到|已被|被.{0,18}(?:立案|调查|处罚)|受到|决定对.{0,20}(?:立案|处罚)|正在接受|正接受",
        ),
        ("E03", r"控股股东|实际控制人|关联方|公司|本公司", r"已|实际|发生|存在|形成|占用|挪用|余额|金额|尚未归还|已归还"),
    ),
)
# Names that are not in the list of labels, and the labels they stand for.
LABEL_ALIASES = {
    "盈利质量": ["D01", "C01"],
    "盈利能力": ["A03"],
    "商誉减值": ["C03"],
    "收入确认": ["B01"],
    "内控": ["F06"],
    "偿债能力": ["D03", "D04"],
    "资金占用": ["E03"],
    "担保": ["D05"],
    "信息披露": ["G04", "G05", "G06"],
    "关联交易": ["E02"],
    "持续经营": ["A06"],
    "财务异常": ["A03", "A01", "C01"],
    "行业对标": ["A01", "C01"],
    "市场异动": ["H01"],
}
# What features are, and the label that each belongs to.
FEATURE_LABELS = {
    "cf_income_ratio": ("经营现金流/净利润（盈利质量）", "盈利质量"),
    "debt_to_assets_ratio": ("资产负债率", "偿债能力"),
    "roe": ("净资产收益率", "盈利能力"),
    "roe_trend_4q": ("ROE 近4期趋势（斜率）", "盈利能力"),
    "revenue_yoy_growth": ("营收同比增速", "收入确认"),
    "net_profit_yoy_growth": ("净利润同比增速", "盈利能力"),
    "anomaly_count": ("财务异常信号数量", "综合"),
    "max_severity": ("最高异常严重度", "综合"),
    "f2_roe": ("净资产收益率", "盈利能力"),
    "f2_roa": ("总资产收益率", "盈利能力"),
    "f2_net_margin": ("净利率", "盈利能力"),
    "f2_debt_ratio": ("资产负债率", "偿债能力"),
    "f2_loss_flag": ("亏损标志", "盈利能力"),
    "f2_high_debt_flag": ("高负债标志（>70%）", "偿债能力"),
    "f2_ocf_to_profit": ("经营现金流/净利润", "盈利质量"),
    "f2_roe_industry_rank": ("ROE 行业百分位", "行业对标"),
    "f2_beneish_m": ("Beneish M-Score（盈余操纵）", "盈利能力"),
    "f2_benford_flag": ("Benford 数字分布异常标志", "财务异常"),
    "f2_benford_max_dev": ("Benford 最大偏离卡方", "财务异常"),
    "f2_trend_deterioration": ("趋势恶化综合指标（0-5）", "盈利能力"),
    "f2_accrual_quality_zscore": ("应计质量 Z-Score", "盈利质量"),
    "f2_profit_ocf_diverge": ("利润-现金流背离标志", "盈利质量"),
    "f2_industry_outlier_count": ("行业离群指标计数（|Z|>1.96）", "行业对标"),
    "f2_z_roe": ("ROE 行业 Z-Score", "行业对标"),
    "f2_z_debt_ratio": ("负债率行业 Z-Score", "行业对标"),
    "mkt_excess_return_20d": ("20日超额收益", "市场异动"),
    "mkt_return_20d": ("20日收益率", "市场异动"),
    "mkt_volatility_20d": ("20日波动率", "市场异动"),
    "mkt_max_drawdown_60d": ("60日最大回撤", "市场异动"),
    "mkt_extreme_down_days_20d": ("20日暴跌（<-5%）天数", "市场异动"),
    "mkt_volume_ratio_20d": ("20日量比（当日/前19日均量）", "市场异动"),
    "mkt_abnormal_volume_days_20d": ("异常放量天数", "市场异动"),
    "mkt_amihud_illiquidity_20d": ("Amihud 非流动性", "市场异动"),
}
