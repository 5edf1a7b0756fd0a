"""The rule dictionary of the trade: what announcements are read for."""

from __future__ import annotations

# Words before a hit that make it none.
NEGATIONS = [
    "不存在",
    "未发现",
    "不涉及",
    "无需",
    "没有发生",
    "未发生",
    "不构成",
    "未受到",
    "未被",
    "并无",
    "无重大",
    "不适用",
    "不要求",
]

# Rules by category, each with its label, severity, keywords, expressions, and expressions around a hit that make it none.
DICTIONARY = {
    "global_negation_patterns": NEGATIONS,
    "categories": [
        {
            "category_id": "A",
            "category_name": "经营业绩与商业模式",
            "rules": [
                {
                    "rule_id": "A03_PERF_LOSS",
                    "label": "A03",
                    "severity": "high",
                    "keywords": ["由盈转亏", "连续亏损", "预计亏损", "业绩大幅下降", "净利润大幅下降", "扣非净利润为负"],
                    "regexes": [r"(?:归属于上市公司股东的)?净利润.{0,18}(?:同比|较上年同期).{0,8}(?:下降|减少|下滑)\s*(?:约)?\d+(?:\.\d+)?%", r"(?:预计|实现|发生).{0,12}(?:亏损|净亏损)[：:，, ]*(?:人民币)?[-－]?\d+(?:\.\d+)?(?:万|亿)?元"],
                },
                {
                    "rule_id": "A06_OPS_DISRUPTION",
                    "label": "A06",
                    "severity": "high",
                    "keywords": ["全面停产", "临时停产", "重大安全事故", "生产经营停滞", "主要银行账户被冻结", "停工", "生产中断"],
                    "regexes": [r"(?:工厂|生产线|主要业务).{0,16}(?:停产|停工|停业).{0,16}(?:超过|持续)\d+(?:天|个月)"],
                },
                {
                    "rule_id": "A06_DELISTING",
                    "label": "A06",
                    "severity": "high",
                    "keywords": ["退市风险警示", "终止上市风险", "可能被终止上市", "暂停上市", "撤销上市"],
                    "regexes": ["股票.{0,16}(?:被实施|将被实施).{0,8}(?:退市风险警示|其他风险警示)"],
                    "paragraph_exclusion_regexes": ["公司年度报告披露后存在退市风险警示或终止上市情形的，应当披露"],
                },
            ],
        },
        {
            "category_id": "C",
            "category_name": "资产质量与减值",
            "rules": [
                {
                    "rule_id": "C01_AR_IMPAIR",
                    "label": "C01",
                    "severity": "medium",
                    "keywords": ["应收账款减值", "坏账准备", "应收款项减值", "账龄分析", "信用减值损失"],
                    "regexes": [r"计提.{0,16}(?:应收|信用).{0,8}减值(?:准备|损失).{0,16}\d+(?:\.\d+)?(?:万|亿)元"],
                },
                {
                    "rule_id": "C02_INV_IMPAIR",
                    "label": "C02",
                    "severity": "medium",
                    "keywords": ["存货跌价", "存货减值", "存货跌价准备", "库龄"],
                    "regexes": [r"计提.{0,16}存货跌价准备.{0,16}\d+(?:\.\d+)?(?:万|亿)元"],
                },
                {
                    "rule_id": "C03_GOODWILL_IMPAIR",
                    "label": "C03",
                    "severity": "medium",
                    "keywords": ["商誉减值", "大额商誉减值", "商誉减值准备", "商誉减值测试"],
                    "regexes": [r"计提.{0,16}商誉.{0,8}减值(?:准备|损失).{0,16}\d+(?:\.\d+)?(?:万|亿)元"],
                },
                {
                    "rule_id": "C04_FA_IMPAIR",
                    "label": "C04",
                    "severity": "medium",
                    "keywords": ["固定资产减值", "在建工程减值", "固定资产减值准备"],
                    "regexes": ["计提.{0,16}(?:固定资产|在建工程).{0,8}减值(?:准备|损失)"],
                },
                {
                    "rule_id": "C05_INTANGIBLE_IMPAIR",
                    "label": "C05",
                    "severity": "medium",
                    "keywords": ["无形资产减值", "研发资产减值", "开发支出减值"],
                    "regexes": ["计提.{0,16}无形资产.{0,8}减值(?:准备|损失)"],
                },
                {
                    "rule_id": "C_IMPAIR_UNSPECIFIED",
                    "label": "C-CANDIDATE",
                    "severity": "medium",
                    "keywords": ["大额资产减值", "重大资产减值", "资产减值损失", "计提减值准备"],
                    "regexes": [r"计提.{0,16}资产.{0,8}减值(?:准备|损失).{0,16}\d+(?:\.\d+)?(?:万|亿)元"],
                },
            ],
        },
        {
            "category_id": "D",
            "category_name": "资金、现金流与偿债",
            "rules": [
                {
                    "rule_id": "D03_LIQUIDITY",
                    "label": "D03",
                    "severity": "high",
                    "keywords": ["流动性紧张", "资金链紧张", "资金链断裂", "偿债压力较大", "现金流紧张"],
                    "regexes": ["经营活动产生的现金流量净额.{0,16}(?:为负|大幅下降|同比下降)"],
                },
                {
                    "rule_id": "D04_DEBT_OVERDUE",
                    "label": "D04",
                    "severity": "high",
                    "keywords": ["债务逾期", "贷款逾期", "债券违约", "未能清偿到期债务", "无法偿还到期债务", "展期"],
                    "regexes": [r"(?:逾期|违约)(?:债务|借款|贷款).{0,20}\d+(?:\.\d+)?(?:万|亿)元"],
                },
                {
                    "rule_id": "D05_ILLEGAL_GUARANTEE",
                    "label": "D05",
                    "severity": "high",
                    "keywords": ["违规担保余额", "未经审议的担保", "违规对外担保", "超额担保"],
                    "regexes": ["(?:公司|本公司).{0,12}(?:存在|发生|形成).{0,8}违规担保", r"违规担保(?:余额|金额|合计).{0,8}\d+(?:\.\d+)?(?:万|亿)?元"],
                    "paragraph_exclusion_regexes": ["^[一二三四五六七八九十]+、违规担保情况[。.]?$", "(?:不得|不要求|防止|禁止|避免).{0,30}违规担保"],
                },
                {
                    "rule_id": "D05_LITIGATION",
                    "label": "D-CANDIDATE",
                    "severity": "medium",
                    "keywords": ["重大诉讼", "重大仲裁", "尚未判决", "尚未裁决", "涉诉金额"],
                    "regexes": [r"(?:诉讼|仲裁)(?:事项|案件)?.{0,24}(?:金额|涉案).{0,8}\d+(?:\.\d+)?(?:万|亿)元"],
                    "paragraph_exclusion_regexes": ["^[一二三四五六七八九十]+、重大诉讼、仲裁事项[。.]?$", "^□.*有重大诉讼.*√.*无重大诉讼"],
                },
            ],
        },
        {
            "category_id": "E",
            "category_name": "交易、关联方与资本运作",
            "rules": [
                {
                    "rule_id": "E03_FUND_OCCUPATION",
                    "label": "E03",
                    "severity": "high",
                    "keywords": ["违规占用资金", "非经营性占用资金余额", "资金占用", "挪用资金", "非经营性往来"],
                    "regexes": ["(?:控股股东|实际控制人|关联方).{0,16}(?:存在|发生).{0,8}(?:非经营性)?(?:占用|挪用).{0,12}(?:公司)?资金", r"非经营性占用资金(?:余额|金额|合计).{0,8}\d+(?:\.\d+)?(?:万|亿)?元"],
                    "paragraph_exclusion_regexes": ["^[一二三四五六七八九十]+、.*非经营性占用资金情况[。.]?$"],
                },
            ],
        },
        {
            "category_id": "F",
            "category_name": "股东、控制权与公司治理",
            "rules": [
                {
                    "rule_id": "F03_PLEDGE_FREEZE",
                    "label": "F03",
                    "severity": "medium",
                    "keywords": ["股份被冻结", "轮候冻结", "高比例质押", "质押比例达到", "司法处置"],
                    "regexes": [r"(?:控股股东|实际控制人).{0,24}(?:质押|冻结).{0,24}\d+(?:\.\d+)?%"],
                    "paragraph_exclusion_regexes": [r"^\d+[、.]公司控股股东或第一大股东.*质押股份数量.*达到\s*80%[。.]?$"],
                },
                {
                    "rule_id": "F06_IC_DEFECT",
                    "label": "F06",
                    "severity": "high",
                    "keywords": ["重大内部控制缺陷", "内控重大缺陷", "内部控制失效"],
                    "regexes": ["内部控制.{0,12}(?:存在|识别出).{0,8}(?:重大|重要)缺陷"],
                    "paragraph_exclusion_regexes": ["^报告期内部控制存在重大缺陷情况的说明[。.]?$"],
                },
            ],
        },
        {
            "category_id": "G",
            "category_name": "审计、披露与监管合规",
            "rules": [
                {
                    "rule_id": "G01_MODIFIED_OPINION",
                    "label": "G01",
                    "severity": "high",
                    "keywords": ["无法表示意见", "否定意见", "带强调事项段的无保留意见", "非标准审计意见"],
                    "regexes": ["(?<!无)保留意见", "审计报告.{0,24}(?:无法表示意见|否定意见|(?<!无)保留意见|强调事项)"],
                },
                {
                    "rule_id": "G07_INVESTIGATION_PENALTY",
                    "label": "G07",
                    "severity": "high",
                    "keywords": ["立案调查", "立案告知书", "行政处罚决定书", "涉嫌信息披露违法违规", "监管措施", "纪律处分"],
                    "regexes": ["(?:公司|本公司|控股股东|实际控制人).{0,16}(?:收到|被|受到).{0,12}(?:立案|调查|行政处罚|监管措施|纪律处分)"],
                    "paragraph_exclusion_regexes": ["^.*登记管理制度执行或涉嫌内幕交易被监管部门采取监管措施及执行处罚的情况[。.]?$"],
                },
            ],
        },
        {
            "category_id": "H",
            "category_name": "市场交易与证券行为",
            "rules": [
                {
                    "rule_id": "H01_ABNORMAL_TRADING",
                    "label": "H01",
                    "severity": "medium",
                    "keywords": ["股票交易异常波动", "股价异常波动", "严重异常波动"],
                    "regexes": [r"连续(?:二|三|四|五|\d+)个交易日.{0,30}(?:涨幅|跌幅|偏离值).{0,12}(?:超过|累计达到)\s*\d+(?:\.\d+)?%"],
                },
            ],
        },
    ],
}
