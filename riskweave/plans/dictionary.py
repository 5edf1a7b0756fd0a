"""The whole rule dictionary of the trade over documents, with SQL that looks for each of its patterns by itself; wide files, counts by day, lines of a batch.

The supplied documents have no Chinese text, so every line of each gets a phrase of the trade, which the line's place and the document's id choose
among words before it, all keywords, and a wording for each expression, with amounts of its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.functions import disclosure
from riskweave.functions.risk_dictionary import DICTIONARY
from riskweave.functions.wording import CHINESE
from riskweave.operators import reports, text_rules
from riskweave.plans import catalogue, disclosures
from riskweave.plans.catalogue import _rounded
from riskweave.plans.oracles import _NEAR, _PANEL, _TEXT, _r
from riskweave.sources import landing, tables
from riskweave.sources.landing import rules_of
from riskweave.streaming import keyed_state

RULES, NEGATIONS = rules_of(DICTIONARY)

#: What stands before a keyword or wording: nothing, who acts, negations, and contexts that make a hit none.
BEFORE = [
    "", "", "公司", "公司已收到", "控股股东存在", "报告期内发生", "截至年末余额涉及", "本期公司决定对其", "不存在", "未发现公司有", "公司未被", "经核查，不涉及", "如公司发生", "一旦出现", "候选人不得因",
    "应当披露", "根据会计政策，", "计提比例与", "本制度所称", "禁止", "一、", "□有重大诉讼√", "上市公司实际控制人正在接受", "独立董事说明：",
]
#: A wording for each expression of the dictionary; # is an amount.
WORDINGS = [
    "净利润较上年同期下降约#%", "预计全年净亏损：人民币-#万元", "工厂因故停产已持续90天", "股票将被实施其他风险警示", "计提本期应收款减值准备合计#万元", "计提部分存货跌价准备#亿元", "计提收购所成商誉的减值损失#亿元",
    "计提闲置固定资产减值准备", "计提专利等无形资产减值损失", "计提其他资产减值准备共#万元", "经营活动产生的现金流量净额本期为负", "逾期借款本金#亿元", "本公司至今存在两笔违规担保", "违规担保余额#亿元", "诉讼事项所涉金额#亿元",
    "关联方在年内发生占用公司资金", "非经营性占用资金合计#万元", "实际控制人所持股份质押#%", "内部控制在年内识别出重要缺陷", "出具保留意见", "审计报告为强调事项", "控股股东于近日收到立案通知", "连续三个交易日收盘价跌幅超过#%",
]
_PHRASES = [w for r in RULES for w in r.keywords] + WORDINGS
_AFTER = ["。", "，本期已发生一笔。", "？", "的情况说明。", ""]


def composed(spark, d) -> DataFrame:
    """announcement_id and text: the documents with a phrase after every line."""
    pick = lambda values, x: F.element_at(F.array(*map(F.lit, values)), (x % len(values) + 1).cast("int"))
    h = lambda i: F.col("doc_id") * 7919 + i.cast("long") * 104729
    amount = lambda i: F.concat((h(i) % 997).cast("string"), F.lit("."), (h(i) % 9).cast("string"))
    phrase = lambda i: F.concat(pick(BEFORE, F.floor(h(i) / 7)), F.replace(pick(_PHRASES, h(i)), F.lit("#"), amount(i)), pick(_AFTER, F.floor(h(i) / 13)))
    lines = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x, i: F.concat(x, phrase(i)))
    return tables.table(spark, d, "documents").select(F.col("doc_id").alias("announcement_id"), F.array_join(lines, "\n").alias("text"))


def dictionary_hits(spark, d) -> DataFrame:
    """Hits of all rules, with the reason of those that are none."""
    return _rounded(text_rules.rule_hits(composed(spark, d), RULES, NEGATIONS))


def dictionary_themes(spark, d) -> DataFrame:
    """By document and theme: how many hits stand, their labels and the gravest severity."""
    out = text_rules.rule_summary(text_rules.rule_hits(composed(spark, d), RULES, NEGATIONS))
    return _rounded(out.withColumn("labels", F.array_join("labels", ",")))


def _sql() -> str:
    text = lambda s: "'" + s.replace("'", "''") + "'"
    several = lambda values: "[" + ", ".join(map(text, values)) + "]"
    quoted = lambda w: "".join("\\" + c if c in r"\.[]{}()*+-?^$|" else c for c in w)
    # RE2 has no look-behind: a match that may begin with the sign is taken and left out.
    plain = lambda p: p.replace("(?<!无)保留意见", "无?保留意见") if p.startswith("(?<!无)") else p.replace("(?<!无)", "")
    patterns = [(n, quoted(w)) for n, r in enumerate(RULES) for w in r.keywords] + [(n, plain(p)) for n, r in enumerate(RULES) for p in r.patterns]
    rules = [(n, text(r.rule_id), text(r.label), r.severity, text("(?i)" + "|".join(f"(?:{x.replace('$', chr(92) + 'n?$')})" for x in r.exclusions)) if r.exclusions else "NULL") for n, r in enumerate(RULES)]
    rows = lambda found: ", ".join("(" + ", ".join(map(str, f)) + ")" for f in found)
    near = [f"WHEN regexp_matches(near, {text('(?i)' + p)}) THEN {text(reason)}" for reason, p in CHINESE.normative]
    anchors = [f"WHEN label = '{label}' AND NOT (regexp_matches(near, {text(a)}) AND regexp_matches(near, {text(b)})) THEN 'missing_event_anchors'" for label, a, b in CHINESE.anchors]
    return rf"""
        WITH ls AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
        ph AS (SELECT {several(BEFORE)} AS before, {several(_PHRASES)} AS phrases, {several(_AFTER)} AS after),
        hs AS (SELECT doc_id, list_transform(ls, lambda x, i: {{'x': x, 'h': doc_id * 7919 + (i - 1) * 104729}}) AS ls FROM ls),
        dt AS MATERIALIZED (SELECT doc_id AS announcement_id, array_to_string(list_transform(ls, lambda l: l.x || before[((l.h // 7) % {len(BEFORE)} + 1)::INT]
               || replace(phrases[(l.h % {len(_PHRASES)} + 1)::INT], '#', (l.h % 997)::VARCHAR || '.' || (l.h % 9)::VARCHAR) || after[((l.h // 13) % {len(_AFTER)} + 1)::INT]), chr(10)) AS text FROM hs, ph),
        ps(rule, pattern) AS (VALUES {rows((n, text('(?i)' + p)) for n, p in patterns)}),
        rs(rule, rule_id, label, severity, excluded) AS (VALUES {rows(rules)}),
        ms AS (SELECT announcement_id, rule, regexp_extract_all(text, pattern) AS ms, string_split_regex(text, pattern) AS gaps FROM dt, ps WHERE regexp_matches(text, pattern)),
        pl AS (SELECT DISTINCT announcement_id, rule, p.start, p.match FROM (
               SELECT announcement_id, rule, unnest(list_transform(range(1, len(ms) + 1), lambda i: {{'start': (1 + coalesce(list_sum(list_transform(gaps[1:i], lambda g: length(g))), 0) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda g: length(g))), 0))::BIGINT, 'match': ms[i]}})) AS p FROM ms) WHERE p.match <> '无保留意见'),
        nr AS (SELECT s.announcement_id, rs.*, s.start, s.match, text, {_NEAR} AS near FROM pl s JOIN dt USING (announcement_id) JOIN rs USING (rule)),
        jd AS (SELECT *, CASE WHEN regexp_matches(substring(text, greatest(start - 16, 1), least(start - 1, 16)), {text('|'.join(NEGATIONS))}) THEN 'negated_context'
               WHEN coalesce(regexp_matches(substring(text, greatest(start - 200, 1), start - greatest(start - 200, 1) + length(match) + 200), excluded), false) THEN 'rule_paragraph_exclusion'
               {' '.join(near)} WHEN label[1] = 'C' AND regexp_matches(near, {text('(?i)' + CHINESE.accounting)}) THEN 'accounting_policy_or_table' {' '.join(anchors)} ELSE '' END AS reason FROM nr),
        hits AS (SELECT announcement_id, rule_id, label, severity::BIGINT AS severity, start, match, reason <> '' AS suppressed, reason FROM jd
               QUALIFY row_number() OVER (PARTITION BY announcement_id, rule ORDER BY reason <> '', start, length(match) DESC) = 1)"""


def wide_headers(spark, d) -> DataFrame:
    """The panel as a wide file has it, with units and scopes in its headers, read back by its headers."""
    wide = {"market_cap": "total_market_cap[unit 1e4]", "pe_ratio": "pe_ratio(TTM)", "pb_ratio": "pb_ratio(MRQ)", "total_revenue": "total_revenue(all)", "net_profit": "net_profit(parent)", "operating_cash_flow": "net_operating_cash(period)", "roe": "roe(diluted, %)", "roa": "roa(%)", "debt_to_assets_ratio": "debt_to_assets(%)"}
    rows = tables.fin_panel(spark, d).withColumnsRenamed(wide)
    return _rounded(landing.wide_panel(rows).select("company_code", "report_period", "industry", *wide))


def event_counts_by_day(spark, d) -> DataFrame:
    """Events of each company in the last 30, 60 and 90 days, on every day on which one comes or leaves a window: what the stream gives."""
    found = text_rules.events(catalogue._hits(spark, d)).select("event_key", "company", "severity", F.col("date").cast("timestamp").alias("published_at"))
    return _rounded(keyed_state.counts_by_day(found))


def batch_line(spark, d) -> DataFrame:
    """A company's line in a batch, all fields."""
    table = lambda name, key, n: tables.table(spark, d, name).select((F.col(key) % n + 1).alias("company_code"))
    found, scores = disclosures._found(spark, d)
    names = tables.table(spark, d, "supplier").select(F.col("s_suppkey").alias("company_code"), F.col("s_name").alias("name"))
    counted = {"announcements": table("documents", "doc_id", 100), "similar_cases": table("embeddings", "vec_id", 90), "attribution_factors": table("benchmark", "item_id", 20), "trace_steps": table("events", "user_id", 50)}
    return _rounded(reports.batch_line(reports.batch_summary(found, scores), names, "90d", counted, scores.select("company_code", (F.col("risk_score") / 100).alias("probability"))))


_HAN = [disclosures._han(i) for i in range(32)]
_HAN_DIGITS = "〇一二三四五六七八九"


def days_named(spark, d) -> DataFrame:
    """How many days an order's text names, and which is its filing day. Texts have three days that come from the order, each in one of five forms, and one
    that no calendar has; the SQL reads them out of the same texts."""
    k, own = F.col("o_orderkey"), F.col("o_orderdate").cast("date")
    later, near = F.date_add(own, (k % 4000).cast("int")), F.date_add(own, (k % 37 - 18).cast("int"))
    han = lambda x: F.element_at(F.array(*map(F.lit, _HAN)), x + 1)

    def written(day, form):
        chinese = F.concat(F.translate(F.year(day).cast("string"), "0123456789", _HAN_DIGITS), F.lit("年"), han(F.month(day)), F.lit("月"), han(F.dayofmonth(day)), F.lit("日"))
        forms = [F.date_format(day, f) for f in ("yyyy年M月d日", "yyyy-MM-dd", "yyyy/M/d", "yyyy . M . d")]
        return F.when(form == 0, forms[0]).when(form == 1, forms[1]).when(form == 2, forms[2]).when(form == 3, forms[3]).otherwise(chinese)

    text = F.concat(F.lit("公告编号："), F.year(later), F.lit("-"), k % 1000, F.lit(" "), written(own, k % 5), F.lit("，"), written(later, F.floor(k / 5) % 5), F.lit("；截至"), written(near, F.floor(k / 25) % 5), F.lit("。2021-02-30"))
    rows = tables.table(spark, d, "orders").select("o_orderkey", text.alias("text"))
    return _rounded(rows.select("o_orderkey", F.size(disclosure.days_in(F.col("text"))).alias("days"), disclosure.filing_date(F.col("text")).alias("filed")))


def _days_sql() -> str:
    form = lambda day, i: f"CASE {i} % 5 WHEN 0 THEN strftime({day}, '%Y年%-m月%-d日') WHEN 1 THEN strftime({day}, '%Y-%m-%d') WHEN 2 THEN strftime({day}, '%Y/%-m/%-d') WHEN 3 THEN strftime({day}, '%Y . %-m . %-d') ELSE translate(year({day})::VARCHAR, '0123456789', '{_HAN_DIGITS}') || '年' || {_HAN}[month({day}) + 1] || '月' || {_HAN}[day({day}) + 1] || '日' END"
    number = lambda x: f"CASE WHEN contains({x}, '十') THEN coalesce(nullif(split_part({x}, '十', 1), ''), '1')::INT * 10 + coalesce(nullif(split_part({x}, '十', 2), ''), '0')::INT ELSE {x}::INT END"
    part = lambda i: number(f"trim(split_part(y, '-', {i}))")
    return rf"""
        WITH o AS (SELECT o_orderkey AS k, o_orderdate::DATE AS own, o_orderdate::DATE + (o_orderkey % 4000)::INT AS later, o_orderdate::DATE + (o_orderkey % 37 - 18)::INT AS near FROM orders),
        t AS (SELECT k, '公告编号：' || year(later) || '-' || (k % 1000) || ' ' || {form('own', 'k')} || '，' || {form('later', '(k // 5)')} || '；截至' || {form('near', '(k // 25)')} || '。2021-02-30' AS text FROM o),
        m AS (SELECT k, regexp_extract(text, '公告编号[:：]\s*(\d{{4}})', 1)::INT AS year, regexp_extract_all(text, '\d{{4}}\s*[年./\-]\s*\d{{1,2}}\s*[月./\-]\s*\d{{1,2}}\s*日?|[{_HAN_DIGITS}]{{4}}年[{_HAN_DIGITS}十]{{1,3}}月[{_HAN_DIGITS}十]{{1,3}}日') AS ms FROM t),
        y AS (SELECT k, year, list_transform(ms, lambda x: regexp_replace(translate(x, '{_HAN_DIGITS}', '0123456789'), '[年月日./ -]+', '-', 'g')) AS ys FROM m),
        d AS (SELECT k, year, list_filter(list_transform(ys, lambda y: try_cast(({part(1)}) || '-' || ({part(2)}) || '-' || ({part(3)}) AS DATE)), lambda x: x IS NOT NULL AND year(x) BETWEEN 2000 AND 2030) AS ds FROM y)
        SELECT k AS o_orderkey, len(ds)::BIGINT AS days, coalesce(list_filter(ds, lambda x: year(x) = year)[-1], ds[-1], make_date(year, 1, 1)) AS filed FROM d"""


_LINE = [("announcements", "documents", "doc_id", 100), ("similar_cases", "embeddings", "vec_id", 90), ("attribution_factors", "benchmark", "item_id", 20), ("trace_steps", "events", "user_id", 50)]
_CHANGES = " UNION ALL ".join(
    f"SELECT company, date + {after} AS day, " + ", ".join(f"{sign(n)} AS e{n}, {sign(n)} * g AS h{n}" for n in (30, 60, 90)) + " FROM mv"
    for after, sign in [(0, lambda n: 1), *[(w, lambda n, w=w: -int(n == w)) for w in (30, 60, 90)]]
)

QUERIES = {f.__name__: f for f in (dictionary_hits, dictionary_themes, wide_headers, event_counts_by_day, batch_line, days_named)}
ORACLE_SQL = {
    "dictionary_hits": f"{_sql()} SELECT * FROM hits",
    "dictionary_themes": f"{_sql()} SELECT announcement_id, label[1] AS theme, count(*) AS hits, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(severity)::BIGINT AS max_severity FROM hits WHERE NOT suppressed GROUP BY ALL",
    "days_named": _days_sql(),
    "wide_headers": f"WITH {_PANEL} SELECT company_code, report_period, industry::BIGINT AS industry, " + ", ".join(_r(c, c) for c in ("market_cap", "pe_ratio", "pb_ratio", "total_revenue", "net_profit", "operating_cash_flow", "roe", "roa", "debt_to_assets_ratio")) + " FROM p",
    "event_counts_by_day": f"{_TEXT}, mv AS (SELECT company, date, (severity >= 4)::BIGINT AS g FROM evs), st AS ({_CHANGES}), dd AS (SELECT company, day, " + ", ".join(f"sum(e{n}) AS e{n}, sum(h{n}) AS h{n}" for n in (30, 60, 90)) + " FROM st GROUP BY ALL) SELECT company, day::DATE AS day, " + ", ".join(f"(sum(e{n}) OVER w)::BIGINT AS events_{n}d, (sum(h{n}) OVER w)::BIGINT AS high_events_{n}d" for n in (30, 60, 90)) + " FROM dd WINDOW w AS (PARTITION BY company ORDER BY day)",
    "batch_line": f"SELECT b.*, s_name AS name, '90d' AS window_name, " + ", ".join(f"(SELECT count(*) FROM {t} WHERE {k} % {n} + 1 = b.company_code)::BIGINT AS {name}" for name, t, k, n in _LINE) + f", {_r('risk_score / 100', 'prediction')} FROM ({disclosures.ORACLE_SQL['batch_summary']}) b LEFT JOIN supplier ON s_suppkey = b.company_code",
}
