"""DuckDB SQL for the registered queries. Derived tables are written out here on their own, so that they check the readers too."""

from __future__ import annotations

_RULES = (
    ("R01", "A03", 4, "(?i)(?:stupid|idiot)", "(?i)(?:benchmark)"),
    ("R02", "D05", 5, "(?i)(?:licen[cs]ed? under)", None),
    ("R03", "G07", 3, "(?i)(?: the the | of of )", "(?i)(?: with )"),
    ("R04", "G07", 4, "(?i)(?:rights reserved)", None),
    ("R05", "E03", 2, r"(?i)(?:[\w.]+@[\w.]+)", None),
)
_NEGATED = "(?i)(?:is|was|no)"
_AS_OF, _NEWS_AS_OF = "DATE '1998-06-30'", "DATE '2024-12-31'"


def _div(a: str, b: str) -> str:
    return f"(CASE WHEN abs({b}) > 1e-12 THEN ({a})::DOUBLE / ({b})::DOUBLE END)"


def _r(x: str, name: str, n: int = 6) -> str:
    return f"round(({x})::DOUBLE, {n}) + 0.0::DOUBLE AS {name}"


def _i(x: str, name: str) -> str:
    return f"({x})::BIGINT AS {name}"


def _none(*names: str) -> str:
    return ", ".join(f"NULL::DOUBLE AS {n}" for n in names)


def _flag(x: str, name: str) -> str:
    return f"coalesce({x}, false)::BIGINT AS {name}"


_ASSETS = f"(CASE WHEN abs(roa) > 0.01 AND net_profit IS NOT NULL THEN {_div('net_profit', 'roa / 100')} ELSE {_div(_div('market_cap', 'pb_ratio'), '1 - debt_to_assets_ratio / 100')} END)"

_PANEL = f"""lines AS (
    SELECT l_suppkey AS company_code, (year(l_shipdate) * 10000 + [331, 630, 930, 1231][quarter(l_shipdate)])::BIGINT AS report_period,
           round(l_extendedprice * (1 - l_discount) * 100)::BIGINT AS cents, l_returnflag AS rf, l_linestatus AS ls, l_quantity AS q FROM lineitem),
sums AS (
    SELECT company_code, report_period, sum(cents)::DOUBLE / 100.0::DOUBLE AS total_revenue,
           sum(CASE WHEN rf = 'R' THEN -cents ELSE cents END)::DOUBLE / 100.0::DOUBLE AS net_profit,
           sum(CASE WHEN ls = 'O' THEN -cents ELSE cents END)::DOUBLE / 100.0::DOUBLE AS operating_cash_flow,
           sum(CASE WHEN rf <> 'N' THEN cents ELSE 0 END)::DOUBLE / 100.0::DOUBLE AS owed, sum(q::BIGINT)::DOUBLE * 1000 AS market_cap
    FROM lines GROUP BY ALL),
p0 AS (
    SELECT company_code, report_period, s_nationkey AS industry, total_revenue, net_profit, operating_cash_flow, market_cap,
           100 * {_div('net_profit', 'total_revenue')} AS roe, 100 * {_div('owed', 'total_revenue')} AS debt_to_assets_ratio,
           {_div('market_cap', 'net_profit')} AS pe_ratio, {_div('market_cap', 'total_revenue')} AS pb_ratio
    FROM sums JOIN supplier ON s_suppkey = company_code),
p AS (SELECT *, roe / 2 AS roa FROM p0)"""

_TIME = "WINDOW t AS (PARTITION BY company_code ORDER BY report_period), l4 AS (PARTITION BY company_code ORDER BY report_period ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)"


def _lag(c: str, n: int = 1) -> str:
    return f"lag({c}, {n}) OVER t"


_GROWN = f"""g AS (SELECT *, 100 * ({_div('total_revenue', _lag('total_revenue', 4))} - 1) AS ry, 100 * ({_div('net_profit', _lag('net_profit', 4))} - 1) AS py FROM p {_TIME})"""

_TREND = f"""d1 AS (
    SELECT *, coalesce(roe < {_lag('roe')}, false)::INT AS fr, coalesce(net_profit < {_lag('net_profit')}, false)::INT AS fp,
           roe - {_lag('roe')} AS qr, total_revenue - {_lag('total_revenue')} AS qv, net_profit - {_lag('net_profit')} AS qp FROM p {_TIME}),
d2 AS (SELECT *, sum(1 - fr) OVER t AS ir, sum(1 - fp) OVER t AS ip FROM d1 {_TIME}),
d3 AS (SELECT *, sum(fr) OVER (PARTITION BY company_code, ir ORDER BY report_period) AS sr, sum(fp) OVER (PARTITION BY company_code, ip ORDER BY report_period) AS sp FROM d2),
trend AS (SELECT *, coalesce(qr < 0, false)::INT + coalesce(qv < 0, false)::INT + coalesce(qp < 0, false)::INT + (sr >= 2)::INT + (sp >= 2)::INT AS worse FROM d3)"""

_INDICES = f"""x0 AS (
    SELECT *, {_div(_lag('roa'), 'roa')} AS gmi, {_div('total_revenue', _lag('total_revenue'))} AS sgi,
           {_div('debt_to_assets_ratio', _lag('debt_to_assets_ratio'))} AS lvgi, {_div('net_profit - operating_cash_flow', _ASSETS)} AS tata FROM p {_TIME}),
b AS (SELECT {', '.join(f'quantile_cont({n}, 0.01) AS {n}_lo, quantile_cont({n}, 0.99) AS {n}_hi' for n in ('gmi', 'sgi', 'tata', 'lvgi'))} FROM x0),
ben AS (SELECT x0.*, -4.84::DOUBLE + {' + '.join(f'{w}::DOUBLE * coalesce(least(greatest({n}, {n}_lo), {n}_hi), {0 if n == "tata" else 1})' for n, w in (('gmi', '0.528'), ('sgi', '0.892'), ('tata', '4.679'), ('lvgi', '(-0.327)')))} + 1.267::DOUBLE AS m FROM x0, b)"""


def _indices() -> str:
    # A missing index stays missing: greatest and least pass over nulls.
    text = _INDICES
    for n in ("gmi", "sgi", "tata", "lvgi"):
        text = text.replace(f"least(greatest({n}, {n}_lo), {n}_hi)", f"CASE WHEN {n} IS NOT NULL THEN least(greatest({n}, {n}_lo), {n}_hi) END")
    return text


_PIO = f"""o1 AS (SELECT *, {_div('net_profit', 'total_revenue')} AS margin, {_div('total_revenue', _ASSETS)} AS turnover FROM p),
pio AS (SELECT *, {', '.join(f'coalesce({x}, false)::BIGINT AS {n}' for n, x in (('f2_p_roa', 'roa > 0'), ('f2_p_cfo', 'operating_cash_flow > 0'), ('f2_p_droa', f'roa > {_lag("roa")}'), ('f2_p_accrual', 'operating_cash_flow > net_profit'), ('f2_p_dlever', f'debt_to_assets_ratio < {_lag("debt_to_assets_ratio")}'), ('f2_p_dmargin', f'margin > {_lag("margin")}'), ('f2_p_dturnover', f'turnover > {_lag("turnover")}')))} FROM o1 {_TIME})"""
_P_FLAGS = "f2_p_roa, f2_p_cfo, f2_p_droa, f2_p_accrual, f2_p_dlever, f2_p_dmargin, f2_p_dturnover"
_P_SCORE = "(" + _P_FLAGS.replace(", ", " + ") + ")"


def _chi2(n: str) -> str:
    total = f"count({n})"
    return f"CASE WHEN {total} >= 3 THEN " + " + ".join(f"pow(count(*) FILTER ({n} = {d}) - {total} * log10(1 + 1.0 / {d}), 2) / ({total} * log10(1 + 1.0 / {d}))" for d in range(1, 10)) + " END"


_BENFORD = f"""dg AS (SELECT company_code, {', '.join(f'CASE WHEN {c} > 0 THEN floor({c} / pow(10, floor(log10({c}))))::INT END AS {n}' for n, c in (('a', 'total_revenue'), ('bb', 'net_profit'), ('c', 'operating_cash_flow')))} FROM p),
bf AS (SELECT company_code, {_chi2('a')} AS xr, {_chi2('bb')} AS xp, {_chi2('c')} AS xo FROM dg GROUP BY company_code),
bfd AS (SELECT *, greatest(xr, xp, xo) AS dev FROM bf)"""

_SLOPE = """rn AS (SELECT company_code, roe, row_number() OVER (PARTITION BY company_code ORDER BY report_period DESC) AS k FROM p WHERE roe IS NOT NULL),
sl AS (SELECT company_code, CASE WHEN count(*) >= 2 THEN round(regr_slope(roe, -k::DOUBLE), 4) ELSE 0.0 END AS roe_trend_4q FROM rn WHERE k <= 4 GROUP BY company_code)"""

_BENCH = """same AS (SELECT industry, report_period, avg(roe) AS m, stddev_samp(roe) AS s, count(roe) AS n, count(DISTINCT company_code) AS k FROM p GROUP BY ALL),
every AS (SELECT industry, avg(roe) AS m, stddev_samp(roe) AS s, count(roe) AS n, count(DISTINCT company_code) AS k FROM p GROUP BY ALL),
lastp AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY company_code ORDER BY report_period DESC) = 1),
bm AS (SELECT l.company_code, l.industry, l.report_period, l.roe, CASE WHEN a.k >= 3 THEN a.k ELSE e.k END AS n_peers,
              CASE WHEN a.k >= 3 THEN CASE WHEN a.n >= 2 AND a.s > 0 THEN round((l.roe - a.m) / a.s, 3) END ELSE CASE WHEN e.n >= 2 AND e.s > 0 THEN round((l.roe - e.m) / e.s, 3) END END AS z
       FROM lastp l LEFT JOIN same a USING (industry, report_period) LEFT JOIN every e USING (industry))"""

_CASH = "CASE WHEN l.net_profit <> 0 THEN round(l.operating_cash_flow / l.net_profit, 4) END"
_ANOMALY = f"""an AS (
    SELECT l.company_code, l.report_period, list_filter([
        CASE WHEN l.net_profit < 0 AND l.operating_cash_flow < 0 THEN {{'i': 'cf_income_ratio', 's': 4}} WHEN ({_CASH}) < 1 THEN {{'i': 'cf_income_ratio', 's': 3}} END,
        CASE WHEN l.debt_to_assets_ratio > 70 THEN {{'i': 'debt_to_assets_ratio', 's': 3}} END, CASE WHEN l.roe < 0 THEN {{'i': 'roe', 's': 4}} END,
        CASE WHEN roe_trend_4q < -5 THEN {{'i': 'roe_trend_4q', 's': 4}} END, CASE WHEN m > -2.22 THEN {{'i': 'f2_beneish_m', 's': 4}} END,
        CASE WHEN dev > 15.507 THEN {{'i': 'f2_benford_flag', 's': 3}} END, CASE WHEN worse >= 4 THEN {{'i': 'f2_trend_deterioration', 's': 3}} END,
        CASE WHEN abs(z) > 2 THEN {{'i': 'roe', 's': 2}} END], lambda x: x IS NOT NULL) AS found
    FROM lastp l JOIN sl USING (company_code) JOIN bfd USING (company_code) JOIN bm USING (company_code)
    JOIN ben ON ben.company_code = l.company_code AND ben.report_period = l.report_period
    JOIN trend ON trend.company_code = l.company_code AND trend.report_period = l.report_period)"""
_ANOMALIES = f"WITH {_PANEL}, {_SLOPE}, {_BENFORD}, {_BENCH}, {_indices()}, {_TREND}, {_ANOMALY}"

_MARKET = f"""od AS (SELECT o_custkey, o_orderdate::DATE AS trade_date, round(o_totalprice * 100)::BIGINT AS cents FROM orders),
m0 AS (SELECT c_nationkey AS company_code, trade_date, sum(cents)::DOUBLE / 100.0::DOUBLE / count(*) AS close, count(*) AS volume, sum(cents)::DOUBLE / 100.0::DOUBLE AS amount FROM od JOIN customer ON c_custkey = o_custkey GROUP BY ALL),
m AS (SELECT *, {_div('close', 'lag(close) OVER t')} - 1 AS ret FROM m0 WINDOW t AS (PARTITION BY company_code ORDER BY trade_date)),
i0 AS (SELECT trade_date, sum(cents)::DOUBLE / 100.0::DOUBLE / count(*) AS close FROM od GROUP BY ALL),
i1 AS (SELECT *, {_div('close', 'lag(close) OVER (ORDER BY trade_date)')} - 1 AS ret FROM i0),
idx AS (SELECT trade_date, CASE WHEN count(ret) OVER w = 20 THEN exp(sum(ln(1 + ret)) OVER w) - 1 END AS base FROM i1 WINDOW w AS (ORDER BY trade_date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))"""


def _days(*sizes: int) -> str:
    return "WINDOW " + ", ".join(f"w{n} AS (PARTITION BY company_code ORDER BY trade_date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)" for n in sizes)


def _compound(n: int) -> str:
    return f"CASE WHEN count(ret) OVER w{n} = {n} THEN exp(sum(ln(1 + ret)) OVER w{n}) - 1 END"


_EVENTS = """ev AS (
    SELECT o_custkey AS secucode, o_orderkey AS event_id, CASE WHEN o_orderstatus = 'F' THEN 'letter' ELSE 'reply' END AS kind, o_orderdate::DATE AS d,
           CASE WHEN o_orderstatus = 'F' THEN CASE o_orderpriority WHEN '1-URGENT' THEN 'attention' WHEN '2-HIGH' THEN 'annual_report' WHEN '3-MEDIUM' THEN 'restructuring'
                WHEN '4-NOT SPECIFIED' THEN 'semi_report' WHEN '5-LOW' THEN 'quarterly' ELSE 'other' END ELSE '' END AS type
    FROM orders WHERE o_orderstatus IN ('F', 'O')),
le AS (SELECT * FROM ev WHERE kind = 'letter'),
pt AS (SELECT o_orderkey AS point_id, o_custkey AS secucode, o_orderdate::DATE AS t FROM orders WHERE o_orderstatus = 'P')"""


def _target(n: int) -> str:
    return f"(EXISTS (SELECT 1 FROM le WHERE le.secucode = pt.secucode AND le.d > pt.t AND le.d <= pt.t + {n}))::BIGINT AS target_{n}d"


_LABELS = f"lb AS (SELECT point_id, secucode, t, {', '.join(map(_target, (30, 60, 90)))} FROM pt)"

_DOCS = r"""an0 AS (SELECT doc_id AS announcement_id, source AS company, DATE '2024-01-01' + (doc_id % 365)::INT AS date, coalesce(text, '') AS text, split_part(coalesce(text, ''), chr(10), 1) AS title FROM documents),
an1 AS (SELECT *, regexp_replace(title, '\s+', '', 'g') AS bare FROM an0),
an2 AS (SELECT *, CASE WHEN regexp_matches(bare, '(?i)Licens') THEN ['eligible', 'o1', 'Licens'] WHEN regexp_matches(bare, '(?i)reserved') THEN ['eligible', 'o2', 'reserved'] WHEN regexp_matches(bare, '(?i)^The') THEN ['excluded_by_title', 'routine', '^The']
                       WHEN regexp_matches(bare, '[|]') THEN ['excluded_by_title', 'forms', '[|]'] WHEN regexp_matches(bare, '!!') THEN ['excluded_by_title', 'shouting', '!!'] ELSE ['eligible', '', ''] END AS decided FROM an1),
ann AS (SELECT *, CASE WHEN decided[1] = 'eligible' THEN 'analyze' ELSE 'excluded_by_title' END AS analysis_status FROM an2)"""


_NEAR = r"trim(regexp_replace(regexp_replace(substring(text, greatest(s.start - 260, 1), s.start - greatest(s.start - 260, 1)), '(?s)^.*[\n。！？；]', '') || s.match || regexp_extract(substring(text, s.start + length(s.match), 260), '^([^\n。！？；]*[\n。！？；]?)', 1), '[\s\x{3000}\x{00a0}]+', ' ', 'g'))"


def _hit(rule_id: str, label: str, severity: int, pattern: str, excluded: str | None) -> str:
    start = "(1 + coalesce(list_sum(list_transform(gaps[1:i], lambda g: length(g))), 0) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda g: length(g))), 0))::BIGINT"
    around = "substring(text, greatest(s.start - 200, 1), s.start - greatest(s.start - 200, 1) + length(s.match) + 200)"
    cases = [f"WHEN regexp_matches(substring(text, greatest(s.start - 16, 1), least(s.start - 1, 16)), '{_NEGATED}') THEN 'negated_context'"]
    if excluded:
        cases.append(f"WHEN regexp_matches({around}, '{excluded}') THEN 'rule_paragraph_exclusion'")
    cases.append(rf"WHEN regexp_matches({_NEAR}, '(?i)\b(?:if|would|might)\b') THEN 'hypothetical_clause' WHEN regexp_matches({_NEAR}, '(?i)(?:means|hereinafter)') THEN 'definition_clause'")
    if label.startswith("A"):
        cases.append(f"WHEN regexp_matches({_NEAR}, '(?i)(?:the|of).{{0,20}}(?:account|policy)') THEN 'accounting_policy_or_table'")
    if label == "G07":
        cases.append(f"WHEN NOT (regexp_matches({_NEAR}, 'the|re') AND regexp_matches({_NEAR}, 'ing|ed')) THEN 'missing_event_anchors'")
    return f"""SELECT announcement_id, company, date, '{rule_id}' AS rule_id, '{label}' AS label, {severity}::BIGINT AS severity, best.start AS start, best.match AS match, best.reason <> '' AS suppressed, best.reason AS reason FROM (
        SELECT *, coalesce(list_filter(judged, lambda x: x.reason = '')[1], judged[1]) AS best FROM (
            SELECT *, list_transform(places, lambda s: {{'start': s.start, 'match': s.match, 'reason': CASE {' '.join(cases)} ELSE '' END}}) AS judged FROM (
                SELECT *, list_transform(range(1, len(ms) + 1), lambda i: {{'start': {start}, 'match': ms[i]}}) AS places FROM (
                    SELECT announcement_id, company, date, text, regexp_extract_all(text, '{pattern}') AS ms, string_split_regex(text, '{pattern}') AS gaps
                    FROM ann WHERE analysis_status = 'analyze' AND regexp_matches(text, '{pattern}')))))"""


_HITS = f"hits AS ({' UNION ALL '.join(_hit(*r) for r in _RULES)})"
_EVENT = """evs AS (SELECT *, substring(sha256(announcement_id::VARCHAR || '|' || label), 1, 20) AS event_key FROM hits WHERE NOT suppressed
    QUALIFY row_number() OVER (PARTITION BY announcement_id, label ORDER BY rule_id, start) = 1)"""
_AGE = f"date_diff('day', date, {_NEWS_AS_OF})"
_F1 = f"""f1 AS (SELECT company, {', '.join(f'coalesce(n{k}, 0)::BIGINT AS f1_announcements_{k}d, coalesce(r{k}, 0)::BIGINT AS f1_analyzed_{k}d, coalesce(e{k}, 0)::BIGINT AS f1_events_{k}d, coalesce(h{k}, 0)::BIGINT AS f1_high_events_{k}d' for k in (30, 60, 90))},
        coalesce(mx, 0)::BIGINT AS f1_max_severity, coalesce(av, 0)::DOUBLE AS f1_avg_severity, coalesce(vr, 1)::DOUBLE AS f1_evidence_valid_ratio
    FROM (SELECT company, {', '.join(f"count(*) FILTER ({_AGE} BETWEEN 0 AND {k - 1}) AS n{k}, count(*) FILTER ({_AGE} BETWEEN 0 AND {k - 1} AND analysis_status = 'analyze') AS r{k}" for k in (30, 60, 90))} FROM ann GROUP BY company)
    LEFT JOIN (SELECT company, {', '.join(f'count(*) FILTER ({_AGE} BETWEEN 0 AND {k - 1} AND valid) AS e{k}, count(*) FILTER ({_AGE} BETWEEN 0 AND {k - 1} AND valid AND severity >= 4) AS h{k}' for k in (30, 60, 90))},
        max(severity) FILTER ({_AGE} BETWEEN 0 AND 89 AND valid) AS mx, round(avg(severity) FILTER ({_AGE} BETWEEN 0 AND 89 AND valid), 4) AS av, round(avg(valid::INT), 4) AS vr FROM (SELECT *, announcement_id % 9 <> 0 AS valid FROM evs) GROUP BY company) USING (company))"""
_TEXT = f"WITH {_DOCS}, {_HITS}, {_EVENT}"

_NEWS = "nw AS (SELECT event_id, user_id % 20 AS company, ts::DATE AS date, event_type AS title, CASE WHEN event_type IN ('purchase', 'signup') THEN 1.0::DOUBLE WHEN event_type = 'error' THEN -1.0::DOUBLE END AS score FROM events)"


def _recent(days: int) -> str:
    return f"rc AS (SELECT * FROM (SELECT *, max(date) OVER (PARTITION BY company) AS last FROM nw) WHERE date >= last - {days})"


def _cos(held: bool = True) -> str:
    may = "case_id <> query_id" + (" AND company <> asking AND (publish_date IS NULL OR publish_date <= as_of)" if held else "")
    return f"""ca AS (SELECT vec_id AS case_id, label AS focus_point, embedding::DOUBLE[] AS e, CASE WHEN vec_id % 13 <> 0 THEN DATE '2024-01-01' + (vec_id % 365)::INT END AS publish_date, vec_id % 11 AS company FROM embeddings),
cq AS (SELECT case_id AS query_id, e AS q, focus_point AS asked, company AS asking, DATE '2024-01-01' + (case_id % 365 + 100)::INT AS as_of FROM ca WHERE case_id % 20 = 0),
cs AS (SELECT query_id, case_id, list_dot_product(q, e) / (sqrt(list_dot_product(q, q)) * sqrt(list_dot_product(e, e))) AS score FROM cq JOIN ca ON {may}),
cr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, case_id) AS rank FROM cs),
ls AS (SELECT query_id, case_id, len(list_intersect([asked, (asked + 1) % 10], [focus_point, (focus_point + 1) % 10])) AS score FROM cq JOIN ca ON {may}),
lr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, case_id) AS rank FROM ls WHERE score > 0)"""


_COS = _cos()

_SCORES = "sc AS (SELECT doc_id AS id, round(ln(1 + n_chars::DOUBLE), 1) AS score, quality AS target FROM labels JOIN documents USING (doc_id))"
_CUM = "cu AS (SELECT *, sum(pos) OVER (ORDER BY score DESC) AS tp, sum(n) OVER (ORDER BY score DESC) AS rows_ FROM (SELECT score, sum(target) AS pos, count(*) AS n FROM sc GROUP BY score))"

#: The rule table: feature, order of severity, condition. Three of the features are never known here.
_RISK = (
    ("f2_loss_flag", 0, "= 1"), ("f2_high_debt_flag", 1, "= 1"), ("f2_roe", 0, "< 0"), ("f2_profit_ocf_diverge", 0, "= 1"), ("f2_neg_accruals_flag", 1, "= 1"),
    ("f2_beneish_m", 0, "> -2.22"), ("f2_benford_flag", 1, "= 1"), ("f2_p_score", 1, "<= 2"), ("mkt_risk_warning_flag_30d", 0, "= 1"), ("mkt_risk_warning_count_30d", 1, "> 0"),
    ("mkt_return_20d", 1, "< -0.2"), ("sent_negative_ratio_30d", 1, "> 0.5"), ("sent_sentiment_mean_30d", 1, "< 0"), ("sent_negative_news_count_30d", 1, ">= 3"),
    ("sent_guba_negative_ratio_30d", 2, "> 0.5"), ("gov_nonstandard_audit_opinion", 0, "= 1"), ("gov_audit_firm_change", 1, "= 1"), ("gov_auditor_change", 1, "= 1"),
    ("gov_top1_holder_ratio", 2, "> 0.5"), ("f6_inquiry_count_12m", 0, "> 0"), ("f6_unreplied_count", 0, "> 0"), ("f6_attention_letter_count", 1, "> 0"), ("f6_severity_score", 1, ">= 0.5"),
)
_FAMILY = {"f2": "F2", "mk": "F3", "se": "F4", "go": "F5", "f6": "F6"}
_RISK_LIST = "list_sort(list_filter([" + ", ".join(f"CASE WHEN {n} {c} THEN '{o}{_FAMILY[n[:2]]}{n}' END" for n, o, c in _RISK) + "], lambda x: x IS NOT NULL))"
_COUNTS = "list_filter([" + ", ".join(f"{{'o': -len(list_filter(f, lambda x: x[2:3] = '{k}')), 'f': '{k}'}}" for k in ("F2", "F3", "F4", "F5", "F6")) + "], lambda x: x.o < 0)"
_KEYS = "company_code, report_period"

ORACLE_SQL = {
    "f2_profitability": f"WITH {_PANEL} SELECT company_code, report_period, {_r('roe', 'f2_roe')}, {_r('roa', 'f2_roa')}, {_none('f2_gross_margin', 'f2_current_ratio', 'f2_interest_coverage')}, {_r('debt_to_assets_ratio', 'f2_debt_ratio')}, {_r('pe_ratio', 'f2_pe')}, {_r('pb_ratio', 'f2_pb')}, {_r(_div('net_profit', 'total_revenue'), 'f2_net_margin')}, {_r('ln(greatest(market_cap, 1))', 'f2_log_market_cap')}, {_r(_div('operating_cash_flow', 'total_revenue'), 'f2_ocf_to_revenue')}, {_r(_div('operating_cash_flow', 'net_profit'), 'f2_ocf_to_profit')}, {_flag('net_profit < 0', 'f2_loss_flag')}, {_flag('debt_to_assets_ratio > 70', 'f2_high_debt_flag')} FROM p",
    "f2_rank_pct": f"WITH {_PANEL} SELECT company_code, report_period, industry::BIGINT AS industry, {_r('(rank() OVER (PARTITION BY report_period, industry ORDER BY roe) + (count(*) OVER (PARTITION BY report_period, industry, roe) - 1) / 2.0) / count(roe) OVER (PARTITION BY report_period, industry)', 'f2_roe_industry_rank')} FROM p",
    "f2_growth": f"WITH {_PANEL}, {_GROWN} SELECT company_code, report_period, {_r('ry', 'revenue_yoy_growth')}, {_r('py', 'net_profit_yoy_growth')}, {_r('roe - ' + _lag('roe'), 'f2_roe_qoq')}, {_r('total_revenue - ' + _lag('total_revenue'), 'f2_revenue_qoq')}, {_r('net_profit - ' + _lag('net_profit'), 'f2_profit_qoq')}, {_r(_div('roe', _lag('roe', 4)) + ' - 1', 'f2_roe_yoy')} FROM g {_TIME}",
    "f2_streak": f"WITH {_PANEL}, {_TREND} SELECT company_code, report_period, {_i('sr', 'f2_roe_decline_streak')}, {_i('sp', 'f2_profit_decline_streak')}, {_i('worse', 'f2_trend_deterioration')} FROM trend",
    "f2_rolling": f"WITH {_PANEL} SELECT company_code, report_period, {', '.join(_r(f'stddev_samp({c}) OVER l4', n, 3) for c, n in (('roe', 'f2_roe_volatility'), ('net_profit', 'f2_profit_volatility'), ('total_revenue', 'f2_revenue_volatility'), ('operating_cash_flow', 'f2_ocf_volatility_4q')))} FROM p {_TIME}",
    "f2_slope": f"WITH {_PANEL}, ac AS (SELECT company_code, report_period, {_div('net_profit - operating_cash_flow', _ASSETS)} AS a, row_number() OVER t AS k FROM p {_TIME}) SELECT company_code, report_period, {_r('a', 'f2_accruals_to_assets')}, {_r('CASE WHEN count(a) OVER l4 >= 3 THEN regr_slope(a, k::DOUBLE) OVER l4 END', 'f2_accruals_trend')} FROM ac {_TIME}",
    "f2_quality": f"WITH {_PANEL}, ac AS (SELECT *, net_profit - operating_cash_flow AS acc, {_div('net_profit - operating_cash_flow', _ASSETS)} AS a FROM p) SELECT company_code, report_period, {_r('acc', 'f2_accruals')}, {_r(_div('acc', 'total_revenue'), 'f2_accruals_to_revenue')}, {_r(_div('operating_cash_flow', _ASSETS), 'f2_ocf_to_assets')}, {_flag('(net_profit > 0 AND operating_cash_flow < 0) OR (net_profit < 0 AND operating_cash_flow > 0)', 'f2_profit_ocf_diverge')}, {_r('CASE WHEN stddev_samp(a) OVER w > 0 THEN (a - avg(a) OVER w) / stddev_samp(a) OVER w ELSE 0.0 END', 'f2_accrual_quality_zscore')}, {_flag('acc < 0', 'f2_neg_accruals_flag')}, {_flag(_div('operating_cash_flow', 'net_profit') + ' > 5 OR ' + _div('operating_cash_flow', 'net_profit') + ' < -1', 'f2_ocf_to_profit_extreme')} FROM ac WINDOW w AS (PARTITION BY report_period, industry)",
    "f2_zscore": f"WITH {_PANEL}, {_GROWN}, zs AS (SELECT company_code, report_period, {', '.join(f'CASE WHEN stddev_samp({c}) OVER w > 0 THEN ({c} - avg({c}) OVER w) / stddev_samp({c}) OVER w END AS {n}' for n, c in (('roe_', 'roe'), ('nm', _div('net_profit', 'total_revenue')), ('dr', 'debt_to_assets_ratio'), ('vy', 'ry'), ('yy', 'py'), ('pe', 'pe_ratio'), ('pb', 'pb_ratio')))} FROM g WINDOW w AS (PARTITION BY report_period, industry)) SELECT company_code, report_period, {_r('roe_', 'f2_z_roe', 5)}, {_r('nm', 'f2_z_net_margin', 5)}, {_r('dr', 'f2_z_debt_ratio', 5)}, {_r('pb', 'f2_z_pb', 5)}, {_r('vy', 'f2_z_revenue_yoy', 5)}, {_r('yy', 'f2_z_profit_yoy', 5)}, {_r('pe', 'f2_z_pe', 5)}, ({' + '.join(f'coalesce(abs({n}) > 1.96, false)::BIGINT' for n in ('roe_', 'nm', 'dr', 'vy', 'yy', 'pe', 'pb'))})::BIGINT AS f2_industry_outlier_count FROM zs",
    "f2_benford": f"WITH {_PANEL}, {_BENFORD} SELECT company_code, {_r('xr', 'f2_benford_chi2_revenue')}, {_r('xp', 'f2_benford_chi2_profit')}, {_r('xo', 'f2_benford_chi2_ocf')}, {_r('dev', 'f2_benford_max_dev')}, {_flag('dev > 15.507', 'f2_benford_flag')} FROM bfd",
    "f2_beneish": f"WITH {_PANEL}, {_indices()} SELECT company_code, report_period, {_r('gmi', 'f2_gmi')}, {_r('sgi', 'f2_sgi')}, {_r('lvgi', 'f2_lvgi')}, {_r('tata', 'f2_tata')}, {_r('m', 'f2_beneish_m')}, {_none('f2_dsri', 'f2_aqi', 'f2_depi', 'f2_sgai')} FROM ben",
    "f2_piotroski": f"WITH {_PANEL}, {_PIO} SELECT company_code, report_period, {_P_FLAGS}, {_P_SCORE}::BIGINT AS f2_p_score, 0.5::DOUBLE AS f2_p_dliquid, 0.5::DOUBLE AS f2_p_equity FROM pio",
    "anomaly_rules": f"{_ANOMALIES} SELECT company_code, report_period, array_to_string(list_transform(found, lambda x: x.i), ',') AS indicators, len(found)::BIGINT AS n_anomalies, coalesce(list_max(list_transform(found, lambda x: x.s)), 0)::BIGINT AS max_severity, CASE WHEN len(found) >= 3 THEN '高' WHEN len(found) >= 1 THEN '中' ELSE '低' END AS risk_level FROM an",
    "roe_trend": f"WITH {_PANEL}, {_SLOPE} SELECT company_code, {_r('coalesce(sl.roe_trend_4q, 0)', 'roe_trend_4q')} FROM (SELECT DISTINCT company_code FROM p) LEFT JOIN sl USING (company_code)",
    "industry_benchmark": f"WITH {_PANEL}, {_BENCH} SELECT company_code, industry::BIGINT AS industry, report_period, {_r('roe', 'roe')}, n_peers::BIGINT AS n_peers, {_r('z', 'roe_zscore')} FROM bm",
    "mkt_returns": f"WITH {_MARKET}, r AS (SELECT company_code, trade_date, {', '.join(f'{_compound(n)} AS r{n}' for n in (5, 20, 60))}, CASE WHEN count(ret) OVER w20 = 20 THEN stddev_samp(ret) OVER w20 END AS v20, CASE WHEN count(ret) OVER w60 = 60 THEN stddev_samp(ret) OVER w60 END AS v60, CASE WHEN count(ret) OVER w20 = 20 THEN count(*) FILTER (ret < -0.05) OVER w20 END AS x20 FROM m {_days(5, 20, 60)}) SELECT company_code::BIGINT AS company_code, trade_date, {_r('r5', 'mkt_return_5d')}, {_r('r20', 'mkt_return_20d')}, {_r('r60', 'mkt_return_60d')}, {_r('v20', 'mkt_volatility_20d')}, {_r('v60', 'mkt_volatility_60d')}, {_i('x20', 'mkt_extreme_down_days_20d')}, {_r('r20 - base', 'mkt_excess_return_20d')} FROM r LEFT JOIN idx USING (trade_date)",
    "mkt_drawdown": f"WITH {_MARKET}, k AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY company_code ORDER BY trade_date DESC) <= 60), wl AS (SELECT *, exp(sum(ln(1 + ret)) OVER t) AS wealth FROM k WINDOW t AS (PARTITION BY company_code ORDER BY trade_date)), pk AS (SELECT *, max(wealth) OVER (PARTITION BY company_code ORDER BY trade_date) AS peak FROM wl) SELECT company_code::BIGINT AS company_code, {_r('CASE WHEN count(ret) = 60 THEN min(wealth / peak - 1) END', 'mkt_max_drawdown_60d')} FROM pk GROUP BY company_code",
    "mkt_liquidity": f"WITH {_MARKET}, c0 AS (SELECT *, {_div('abs(ret)', 'amount / 1e6')} AS cost, avg(volume) OVER w20 + 2 * stddev_samp(volume) OVER w20 AS hi FROM m {_days(20)}), c AS (SELECT *, list(volume::DOUBLE) OVER w20 AS vs FROM c0 {_days(20)}), x AS (SELECT company_code, trade_date, count(volume) OVER w20 = 20 AS whole, volume / avg(volume) OVER b AS vr, amount / avg(amount) OVER b AS ar, stddev_samp(volume) OVER w20 / avg(volume) OVER w20 AS cv, stddev_samp(amount) OVER w20 / avg(amount) OVER w20 AS ca, len(list_filter(vs, lambda v: v > hi)) AS ab, count(*) FILTER (volume = 0) OVER w20 AS z, CASE WHEN count(cost) OVER w20 >= 15 THEN avg(cost) OVER w20 END AS il, {_div('close', 'lag(close, 63) OVER t')} - 1 AS q FROM c {_days(20)}, b AS (PARTITION BY company_code ORDER BY trade_date ROWS BETWEEN 19 PRECEDING AND 1 PRECEDING), t AS (PARTITION BY company_code ORDER BY trade_date)) SELECT company_code::BIGINT AS company_code, trade_date, {_r('CASE WHEN whole THEN vr END', 'mkt_volume_ratio_20d')}, {_r('CASE WHEN whole THEN ar END', 'mkt_amount_ratio_20d')}, {_r('CASE WHEN whole THEN cv END', 'mkt_volume_cv_20d')}, {_r('CASE WHEN whole THEN ca END', 'mkt_amount_cv_20d')}, {_i('CASE WHEN whole THEN ab END', 'mkt_abnormal_volume_days_20d')}, {_i('CASE WHEN whole THEN z END', 'mkt_zero_volume_days_20d')}, {_r('CASE WHEN whole THEN il END', 'mkt_amihud_illiquidity_20d')}, {_r('q', 'mkt_market_cap_qoq')} FROM x",
    "f6_history": f"WITH {_EVENTS}, pa AS (SELECT *, CASE WHEN kind = 'letter' THEN date_diff('day', lag(d) OVER (PARTITION BY secucode, kind ORDER BY d, event_id), d) END AS gap FROM ev WHERE d <= {_AS_OF}), ag AS (SELECT secucode, {', '.join(f'''count(*) FILTER (kind = 'letter' AND d >= {_AS_OF} - {n}) AS f6_inquiry_count_{k}''' for k, n in (('12m', 365), ('24m', 730), ('60m', 1825)))}, {', '.join(f'''count(*) FILTER (kind = 'letter' AND type = '{t}') AS {n}''' for t, n in (('annual_report', 'f6_annual_report_inquiry_count'), ('attention', 'f6_attention_letter_count'), ('restructuring', 'f6_restructuring_inquiry_count')))}, date_diff('day', min(d) FILTER (kind = 'letter'), {_AS_OF}) AS f6_first_inquiry_interval_days, date_diff('day', max(d) FILTER (kind = 'letter'), {_AS_OF}) AS f6_last_inquiry_interval_days, round(avg(gap), 6) AS f6_avg_inquiry_interval_days, round(CASE WHEN avg(gap) > 0 THEN stddev_pop(gap) / avg(gap) END, 6) AS f6_inquiry_interval_cv, greatest(count(*) FILTER (kind = 'letter') - count(*) FILTER (kind = 'reply'), 0) AS f6_unreplied_count, least(1.0::DOUBLE, round(0.1::DOUBLE * count(*) FILTER (kind = 'letter'), 4)) AS f6_severity_score, count(*) FILTER (kind = 'letter') AS letters FROM pa GROUP BY secucode HAVING letters > 0) SELECT c_custkey AS secucode, {', '.join(f'coalesce({c}, 0)::BIGINT AS {c}' for c in ('f6_inquiry_count_12m', 'f6_inquiry_count_24m', 'f6_inquiry_count_60m', 'f6_annual_report_inquiry_count', 'f6_attention_letter_count', 'f6_restructuring_inquiry_count', 'f6_first_inquiry_interval_days', 'f6_last_inquiry_interval_days', 'f6_unreplied_count'))}, {', '.join(f'coalesce({c}, 0)::DOUBLE AS {c}' for c in ('f6_avg_inquiry_interval_days', 'f6_inquiry_interval_cv', 'f6_severity_score'))} FROM customer LEFT JOIN ag ON secucode = c_custkey",
    "label_forward": f"WITH {_EVENTS}, {_LABELS} SELECT * FROM lb",
    "split_rate": f"WITH {_EVENTS}, {_LABELS} SELECT CASE WHEN year(t) < 1997 THEN 'train' WHEN year(t) < 1999 THEN 'val' ELSE 'test' END AS split, count(*) AS rows, {', '.join(_r(f'avg(target_{n}d)', f'rate_{n}d') for n in (30, 60, 90))} FROM lb GROUP BY 1",
    "asof_latest": f"WITH {_PANEL} SELECT company_code, report_period, {_r('roe', 'roe')}, {_r('total_revenue', 'total_revenue')} FROM p WHERE report_period <= 19980701 QUALIFY row_number() OVER (PARTITION BY company_code ORDER BY report_period DESC) = 1",
    "asof_reply": f"WITH {_EVENTS} SELECT secucode, event_id, d AS letter_date, coalesce((SELECT min(r.d) FROM ev r WHERE r.kind = 'reply' AND r.secucode = le.secucode AND r.d >= le.d), (SELECT min(r.d) FROM ev r WHERE r.kind = 'reply' AND r.secucode = le.secucode)) AS reply_date FROM le",
    "dataset_join": f"WITH {_PANEL}, {_TREND}, {_PIO} SELECT company_code, report_period, {_r('qr', 'f2_roe_qoq')}, {_i('worse', 'f2_trend_deterioration')}, {_P_SCORE}::BIGINT AS f2_p_score, f2_p_roa FROM (SELECT company_code, report_period FROM p WHERE report_period % 10000 IN (630, 1231)) LEFT JOIN (SELECT company_code, report_period, qr, worse FROM trend) USING (company_code, report_period) LEFT JOIN (SELECT company_code, report_period, {_P_FLAGS} FROM pio) USING (company_code, report_period)",
    "title_policy": f"WITH {_DOCS} SELECT announcement_id, company, analysis_status FROM ann",
    "newest_documents": f"WITH {_DOCS} SELECT company, announcement_id, date FROM ann WHERE analysis_status <> 'excluded_by_title' QUALIFY row_number() OVER (PARTITION BY company ORDER BY date DESC, announcement_id DESC) <= 120",
    "rule_hits": f"WITH {_DOCS}, {_HITS} SELECT * FROM hits",
    "event_dedupe": f"{_TEXT} SELECT event_key, announcement_id, label, rule_id, severity FROM evs",
    "f1_windows": f"{_TEXT}, {_F1} SELECT * FROM f1",
    "theme_distribution": f"{_TEXT} SELECT company, label, count(*) AS events, round(count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY company), 6) AS share FROM evs WHERE {_AGE} BETWEEN 0 AND 89 GROUP BY company, label",
    "window_comparison": f"{_TEXT}, {_F1} " + " UNION ALL ".join(f"SELECT company, {k}::BIGINT AS days, f1_announcements_{k}d AS announcements, f1_events_{k}d AS events, round(CASE WHEN f1_announcements_{k}d > 0 THEN f1_events_{k}d::DOUBLE / f1_announcements_{k}d ELSE 0 END, 6) AS per_announcement FROM f1" for k in (30, 60, 90)),
    "lexicon_sentiment": f"WITH {_NEWS}, {_recent(30)}, dy AS (SELECT company, date, count(*) AS n, count(*) FILTER (score < 0) AS bad FROM rc GROUP BY ALL) SELECT company, {', '.join(f'count(*) FILTER (date >= last - {n}) AS sent_news_count_{n}d' for n in (5, 10, 30))}, count(*) FILTER (length(title) > 0) AS sent_news_title_count_30d, (SELECT max(n) FROM dy WHERE dy.company = rc.company) AS sent_news_daily_peak_30d, {_r('avg(score)', 'sent_sentiment_mean_30d')}, {_r('stddev_pop(score)', 'sent_sentiment_volatility_30d')}, CASE WHEN count(score) > 0 THEN count(*) FILTER (score < 0) END AS sent_negative_news_count_30d, {_r('avg((score < 0)::INT)', 'sent_negative_ratio_30d')}, {_r('(SELECT max(bad::DOUBLE / n) FROM dy WHERE dy.company = rc.company AND bad > 0)', 'sent_negative_peak_30d')} FROM rc GROUP BY company",
    "daily_peak": f"WITH {_NEWS}, {_recent(7)} SELECT company, max(n)::BIGINT AS daily_peak, sum(n)::BIGINT AS items FROM (SELECT company, date, count(*) AS n FROM rc GROUP BY ALL) GROUP BY company",
    "holder_concentration": f"WITH h AS (SELECT l_partkey AS company, l_suppkey AS holder, sum(l_quantity::BIGINT) AS shares FROM lineitem GROUP BY ALL), r AS (SELECT company, shares::DOUBLE / sum(shares) OVER (PARTITION BY company) AS ratio, row_number() OVER (PARTITION BY company ORDER BY shares DESC, holder) AS k FROM h), t AS (SELECT company, max(ratio) FILTER (k = 1) AS a, max(ratio) FILTER (k = 2) AS b, sum(ratio) AS s, sum(ratio * ratio) AS hh, count(*) AS n FROM r WHERE k <= 10 GROUP BY company) SELECT company, {_r('a', 'gov_top1_holder_ratio')}, {_r('s', 'gov_top10_holder_ratio')}, {_r('hh', 'gov_top10_hhi')}, {_r('a / s', 'gov_top1_top10_ratio')}, {_r('a - b', 'gov_top1_top2_gap')}, n AS gov_top10_holder_count FROM t",
    "cosine_topk": f"WITH {_COS} SELECT query_id, case_id, {_r('score', 'score')}, rank::BIGINT AS rank FROM cr WHERE rank <= 8",
    "label_overlap": f"WITH {_COS} SELECT query_id, case_id, score::BIGINT AS score, rank::BIGINT AS rank FROM lr WHERE rank <= 8",
    "rrf_fusion": f"WITH {_COS}, u AS (SELECT query_id, case_id, rank, 1 AS w FROM cr WHERE rank <= 50 UNION ALL SELECT query_id, case_id, rank, 2 FROM lr WHERE rank <= 50), f AS (SELECT query_id, case_id, sum(1.0::DOUBLE / (60 + rank)) AS rrf, min(rank) FILTER (w = 1) AS own FROM u GROUP BY ALL) SELECT query_id, case_id, {_r('rrf', 'rrf')}, (row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, own NULLS LAST, case_id))::BIGINT AS rank FROM f QUALIFY rank <= 5",
    "leakage_filter": f"WITH {_COS} SELECT company, count(*) AS cases, max(publish_date) AS latest FROM ca WHERE company <> 3 AND (publish_date IS NULL OR publish_date <= DATE '2024-06-30') GROUP BY 1",
    "bigram_hit": r"WITH i AS (SELECT item_id, regexp_replace(text, '\s+', '', 'g') AS t FROM benchmark), g AS (SELECT item_id, list_distinct(list_transform(range(1, length(t)), lambda k: substring(t, k, 2))) AS b FROM i) SELECT count(*) AS queries, round(avg((len(list_intersect(a.b, c.b)) >= 3)::INT), 6) AS hit_rate FROM g a JOIN g c ON c.item_id = a.item_id + 1",
    "ranking_metrics": f"WITH {_SCORES}, {_CUM}, t AS (SELECT sum(pos) AS pp, sum(n) AS nn FROM cu) SELECT {_r('sum((n - pos) * (tp - pos + pos / 2.0)) / max(pp * (nn - pp))', 'auc')}, {_r('sum(pos * tp / rows_) / max(pp)', 'average_precision')}, max(pp)::BIGINT AS positives, max(nn)::BIGINT AS rows FROM cu, t",
    "top_decile_recall": f"WITH {_SCORES}, t AS (SELECT greatest(1, floor(count(*) * 0.1))::BIGINT AS k, sum(target) AS p FROM sc), o AS (SELECT target, row_number() OVER (ORDER BY score DESC, id) AS r FROM sc) SELECT max(k) AS k, sum(target)::BIGINT AS hits, {_r('sum(target) / max(p)', 'recall')} FROM o, t WHERE r <= k",
    "best_threshold": f"WITH {_SCORES}, {_CUM}, t AS (SELECT sum(pos) AS pp FROM cu) SELECT {_r('score', 'threshold')}, {_r('2.0 * tp / (rows_ + pp)', 'f1')}, {_r('tp / rows_', 'precision')}, {_r('tp / pp', 'recall')} FROM cu, t ORDER BY 2.0 * tp / (rows_ + pp) DESC, score DESC LIMIT 1",
    "risk_band": f"WITH {_SCORES}, o AS (SELECT id, score, row_number() OVER (ORDER BY score DESC, id) AS risk_rank, count(*) OVER () AS n FROM sc) SELECT id, {_r('score', 'score')}, risk_rank::BIGINT AS risk_rank, CASE WHEN risk_rank <= 0.05::DOUBLE * n THEN 'A' WHEN risk_rank <= 0.15::DOUBLE * n THEN 'B' WHEN risk_rank <= 0.3::DOUBLE * n THEN 'C' WHEN risk_rank <= 0.5::DOUBLE * n THEN 'D' WHEN risk_rank <= 0.7::DOUBLE * n THEN 'E' ELSE 'F' END AS risk_band FROM o",
    "evidence_bind": f"{_ANOMALIES}, po AS (SELECT company_code, 'fin_' || lpad(k::VARCHAR, 3, '0') AS evidence_id, k, found[k].i AS ind, found[k].s AS sev FROM an, unnest(range(1, len(found) + 1)) AS u(k)), fa AS (SELECT DISTINCT company_code, ind FROM (SELECT company_code FROM po) CROSS JOIN (VALUES ('roe'), ('debt_to_assets_ratio'), ('other')) AS v(ind)), bd AS (SELECT company_code, ind, coalesce((SELECT min_by(evidence_id, k) FROM po WHERE po.company_code = fa.company_code AND po.ind = fa.ind), CASE WHEN ind = 'other' THEN (SELECT min_by(evidence_id, k) FROM po WHERE po.company_code = fa.company_code AND sev >= 4) END) AS evidence_id FROM fa) SELECT company_code AS company, company_code::VARCHAR || ':' || ind AS factor_id, evidence_id FROM bd WHERE evidence_id IS NOT NULL",
    "citation_check": "SELECT vec_id AS case_id, CASE vec_id % 4 WHEN 1 THEN 'fin_001,fin_002,sem_001' ELSE 'fin_002,sem_001' END AS cited, CASE vec_id % 4 WHEN 0 THEN 'fin_000' WHEN 3 THEN 'fin_003' ELSE '' END AS unknown FROM embeddings",
    "company_codes": "WITH c AS (SELECT c_custkey, lpad((c_custkey * 7919 % 1000000)::VARCHAR, 6, '0') AS code FROM customer) SELECT c_custkey, code, CASE WHEN code[1] IN ('4', '8') OR code[1:2] = '92' THEN 'BJ' WHEN code[1] IN ('6', '9') THEN 'SH' WHEN code[1] IN ('0', '2', '3') THEN 'SZ' END AS market, code || '.' || CASE WHEN code[1] IN ('6', '9') THEN 'SH' WHEN code[1] IN ('4', '8') THEN 'BJ' ELSE 'SZ' END AS company_code FROM c",
    "bigram_buckets": r"WITH i AS (SELECT item_id, regexp_replace(text, '\s+', '', 'g') AS t FROM benchmark), g AS (SELECT item_id, unnest(list_transform(range(1, length(t)), lambda k: substring(t, k, 2))) AS gram FROM i) SELECT item_id, (('0x' || substring(md5(gram), 1, 8))::BIGINT % 65536) AS bucket, count(*) AS tf FROM g GROUP BY ALL",
}
#: The searches without a company and a day.
ORACLE_SQL |= {f"{n}_every_20th": ORACLE_SQL[n].replace(_COS, _cos(False)) for n in ("cosine_topk", "label_overlap", "rrf_fusion")}
_F2 = [
    "f2_profitability", "f2_quality", "f2_rolling", "f2_slope", "f2_beneish", "f2_piotroski", "f2_growth", "f2_streak", "f2_zscore",
]
_KNOWN_DAY = "strptime(report_period::VARCHAR, '%Y%m%d')::DATE"
ORACLE_SQL["f2_all"] = (
    f"SELECT * EXCLUDE (revenue_yoy_growth, net_profit_yoy_growth), {_KNOWN_DAY} AS report_date, year({_KNOWN_DAY})::BIGINT AS year, quarter({_KNOWN_DAY})::BIGINT AS quarter "
    f"FROM ({ORACLE_SQL['f2_rank_pct']}) " + " ".join(f"JOIN ({ORACLE_SQL[n]}) USING ({_KEYS})" for n in _F2) + f" JOIN ({ORACLE_SQL['f2_benford']}) USING (company_code)"
)
_QUOTES = f"SELECT c_nationkey::BIGINT AS company_code, sum(round(c_acctbal * 100)::BIGINT)::DOUBLE / 100.0::DOUBLE AS cap, count(*) AS n, count(*) FILTER (c_acctbal < 0) AS owing FROM customer GROUP BY 1"
_F3_NULLS = (
    "mkt_pe_change_qoq", "mkt_pb_change_qoq", "mkt_cap_industry_zscore", "mkt_pb_industry_zscore", "mkt_financing_balance", "mkt_securities_balance", "mkt_margin_total_balance",
    "mkt_financing_balance_change", "mkt_institutional_holding_ratio", "mkt_institutional_holding_change", "mkt_institutional_holder_count", "mkt_risk_warning_count_30d",
    "mkt_risk_warning_count_90d", "mkt_risk_warning_flag_30d", "mkt_days_since_last_risk_warning",
)
ORACLE_SQL["f3_all"] = (
    f"SELECT * EXCLUDE (cap, n, owing), {_r('cap', 'mkt_market_cap')}, {_r('CASE WHEN cap >= 0 THEN ln(1 + cap) END', 'mkt_log_market_cap')}, {_r(_div('cap', 'n'), 'mkt_pe_ratio')}, {_r(_div('cap', 'owing'), 'mkt_pb_ratio')}, {_none(*_F3_NULLS)} "
    f"FROM (SELECT * FROM ({ORACLE_SQL['mkt_returns']}) QUALIFY row_number() OVER (PARTITION BY company_code ORDER BY trade_date DESC) = 1) JOIN ({ORACLE_SQL['mkt_liquidity']}) USING (company_code, trade_date) LEFT JOIN ({ORACLE_SQL['mkt_drawdown']}) USING (company_code) LEFT JOIN ({_QUOTES}) USING (company_code)"
)
ORACLE_SQL["title_decision"] = f"WITH {_DOCS} SELECT announcement_id, decided[1] AS status, decided[2] AS reason, decided[3] AS pattern FROM ann"
ORACLE_SQL["asof_join"] = (
    f"WITH {_PANEL}, {_EVENTS} SELECT point_id, secucode, t, report_period, {_r('roe', 'roe')}, {_r('total_revenue', 'total_revenue')} "
    "FROM pt JOIN p ON company_code = secucode AND report_period <= strftime(t, '%Y%m%d')::BIGINT QUALIFY row_number() OVER (PARTITION BY point_id ORDER BY report_period DESC) = 1"
)
ORACLE_SQL["type_distribution"] = f"WITH {_EVENTS} SELECT type, count(*) AS letters, round(count(*)::DOUBLE / sum(count(*)) OVER (), 6) AS share FROM le GROUP BY type"
ORACLE_SQL["chunk_topk"] = f"SELECT query_id, case_id AS chunk_id, score, rank, substring(text, 1, 400) AS excerpt FROM ({ORACLE_SQL['cosine_topk']}) LEFT JOIN documents ON doc_id = case_id"
ORACLE_SQL["bigram_embedding"] = f"WITH b AS ({ORACLE_SQL['bigram_buckets']}) SELECT item_id, bucket, {_r('(1 + ln(1 + tf)) / sqrt(sum(pow(1 + ln(1 + tf), 2)) OVER (PARTITION BY item_id))', 'weight')} FROM b"
ORACLE_SQL["unit_vectors"] = f"SELECT vec_id AS case_id, pos::BIGINT AS pos, {_r('x / norm', 'x')} FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS pos, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS norm FROM embeddings)"
ORACLE_SQL["fallback_factors"] = (
    f"WITH a AS ({_ANOMALIES} SELECT company_code AS company, unnest(found) AS x, unnest(range(len(found))) AS pos FROM an), "
    "f AS (SELECT company, 'financial' AS source, row_number() OVER (PARTITION BY company ORDER BY x.s DESC, pos) AS place, x.i AS feature, CASE x.i WHEN 'cf_income_ratio' THEN '盈利质量' WHEN 'debt_to_assets_ratio' THEN '偿债能力' WHEN 'f2_benford_flag' THEN '财务异常' ELSE '盈利能力' END AS label_ref, x.s::BIGINT AS severity FROM a), "
    f"e AS ({_TEXT} SELECT announcement_id % 100 + 1 AS company, 'semantic' AS source, row_number() OVER (PARTITION BY announcement_id % 100 + 1 ORDER BY severity DESC, event_key) AS place, 'label_' || label AS feature, label AS label_ref, severity FROM evs) "
    "SELECT * FROM f WHERE place <= 5 UNION ALL SELECT * FROM e WHERE place <= 5"
)
ORACLE_SQL["bigram_hit_retrieved"] = (
    f"WITH fu AS ({ORACLE_SQL['rrf_fusion']}), "
    r"i AS (SELECT doc_id, regexp_replace(text, '\s+', '', 'g') AS t FROM documents WHERE doc_id IN (SELECT query_id FROM fu UNION SELECT case_id FROM fu)), "
    "g AS (SELECT doc_id, list_distinct(list_transform(range(1, length(t)), lambda k: substring(t, k, 2))) AS b FROM i), "
    "h AS (SELECT query_id, max(coalesce(len(list_intersect(a.b, c.b)) >= 3, false)::INT) AS hit FROM fu LEFT JOIN g a ON a.doc_id = query_id LEFT JOIN g c ON c.doc_id = case_id GROUP BY 1) "
    "SELECT count(*) AS queries, round(avg(hit), 6) AS hit_rate FROM h"
)
