from datetime import date

from pyspark.sql import functions as F

from ..operators import acceptance as ac
from ..sources import adapters as a
from . import anomaly as dp, attribution as atp, warehouse as wp
from .oracle import CTES, K, sql

P = ac.SignalParams(cost_group="g1", cost_from=date(1998, 7, 1), cost_since=date(1998, 1, 1), cost_until=date(1998, 12, 31), outage_day=date(2024, 1, 10),
                    tired_creative="cr3", week_anchor=date(1996, 1, 1), regular_type="BUILDING", opening_channel="meta / paid_social",
                    closing_channel="google / organic", promotion="P1", promo_start=date(2024, 1, 22), promo_end=date(2024, 1, 30))
ITEMS = {"Brand#1": "一號", "Brand#2": "二號", "Brand#3": "三號"}
HEAD = ("一、廣告群組每週成效", "二、素材每週點擊率%", "三、每週追蹤購買/訂單/營收", "四、每週各商品售出件數")


def _by_customer(s, d):
    c = a.table(s, d, "customer")
    seg = c.select(F.col("c_custkey").alias("customer_id"), (F.col("c_nationkey") % 4).alias("centroid_id"), (F.col("c_custkey") % 3 > 0).alias("observed_30d"))
    truth = c.select(F.col("c_custkey").alias("customer_id"), F.col("c_mktsegment").alias("segment"))
    ltv = c.select(F.col("c_custkey").alias("customer_id"), F.when(F.col("c_custkey") % 2 == 0, "eval").otherwise("new").alias("scope"),
                   F.col("c_acctbal").cast("decimal(18,2)").alias("predicted_revenue_30d"))
    return seg, truth, ltv


def measured(s, d):
    seg, truth, ltv = _by_customer(s, d)
    events = a.web_events(s, d)
    tracked = events.where("event_name <> 'purchase' or event_dt <> date'2024-01-10' or transaction_id % 20 = 0")
    return ac.measured_signals(a.ad_daily(s, d), tracked, a.purchases(s, d), wp.star(s, d)["dim_product"], dp.diagnosis(s, d), seg, truth, ltv,
                               atp.at.mart_attribution(a.purchases(s, d), events, 7), P)


def scorecard(s, d):
    return ac.score(ac.criteria(s, 1), measured(s, d))


def lines(s, d):
    return ac.weekly_lines(a.ad_daily(s, d), a.site_purchases(s, d), a.shop_orders(s, d), ITEMS, {"ch0": "零", "ch1": "壹"})


def findings(s, d):
    return ac.explode_findings(a.season_replies(s, d))


def matches(s, d):
    return ac.match_findings(findings(s, d), ac.BLIND_RULES)


def blind(s, d):
    return ac.blind_scorecard(a.season_replies(s, d), matches(s, d), ac.BLIND_RULES)


def reports(s, d):
    return ac.blind_reports(a.season_replies(s, d), findings(s, d), blind(s, d), matches(s, d), dp.PRICES, models=("m0", "m1"))


def _check(s, d):
    replies = a.season_replies(s, d)
    prompts = ac.weekly_report_text(lines(s, d), "甲", HEAD, "乙", 3)
    n = replies.count()
    return ac.check_acceptance(ac.criteria(s, 1), scorecard(s, d), ac.BLIND_RULES, prompts, replies, findings(s, d), blind(s, d),
                               dict(criteria=12, pending=1, judged=11, rules=4, prompts=3, results=n, models=2, blind=4 * n))


_ARR = lambda v: "[" + ", ".join(f"'{x}'" for x in v) + "]"
CTES["find"] = f"""
  SELECT model, run_no, n AS finding_no, ({_ARR(a.TARGETS)})[(k + n - 1) % 4 + 1] AS target, ({_ARR(a.PERIODS)})[(k + n - 1) % 3 + 1] AS period,
    ({_ARR(a.OBSERVATIONS)})[(k + 2 * (n - 1)) % 5 + 1] AS observation, 'c' || k AS likely_cause, CAST(NULL AS VARCHAR) AS next_check
  FROM (SELECT 'm' || (event_id % 2) AS model, event_id AS run_no, {K} AS k, unnest([1, 2]) AS n FROM events)
  WHERE k % 10 <> 9 AND ((k % 6 IN (1, 2) AND n = 1) OR k % 6 >= 3)"""
CTES["hits"] = "\n  UNION ALL ".join(
    f"SELECT model, run_no, finding_no, '{s}' AS signal_id FROM (SELECT *, concat_ws('｜', target, period, observation, likely_cause) AS t FROM find) WHERE "
    + " AND ".join(f"regexp_matches(t, '{p}')" for p in (x, y, z)) for s, _, x, y, z in ac.BLIND_RULES)
CTES["blind"] = """
  SELECT r.model, r.run_no, c.signal_id, c.rule, coalesce(h.m, []) AS matched_findings, h.m IS NOT NULL AS found
  FROM (SELECT 'm' || (event_id % 2) AS model, event_id AS run_no FROM events) r
  CROSS JOIN (VALUES """ + ", ".join(f"('{r[0]}', '{r[1]}')" for r in ac.BLIND_RULES) + """) c(signal_id, rule)
  LEFT JOIN (SELECT model, run_no, signal_id, list_sort(list(DISTINCT finding_no)) AS m FROM hits GROUP BY 1, 2, 3) h
    ON h.model = r.model AND h.run_no = r.run_no AND h.signal_id = c.signal_id"""
CTES["crit"] = "SELECT * FROM (VALUES " + ", ".join(
    "(" + ", ".join("NULL" if v is None else (f"'{v}'" if isinstance(v, str) else f"{v}::DOUBLE") for v in r) + ")" for r in ac.CRITERIA + ac.CRITERIA_V1_S4) \
    + ") c(signal_id, check_id, found_by, method, rule, lower_bound, upper_bound)"
CTES["first7"] = "SELECT * FROM at_mart7 WHERE NOT is_repeat AND NOT window_truncated"
CTES["meas"] = f"""
  SELECT 'S1a' AS check_id, (sum(cost) FILTER (WHERE date >= DATE '1998-07-01')::DOUBLE / sum(clicks) FILTER (WHERE date >= DATE '1998-07-01'))
      / (sum(cost) FILTER (WHERE date < DATE '1998-07-01')::DOUBLE / sum(clicks) FILTER (WHERE date < DATE '1998-07-01')) AS actual
    FROM ad_daily WHERE ad_group_id = 'g1' AND date BETWEEN DATE '1998-01-01' AND DATE '1998-12-31'
  UNION ALL SELECT 'S1b', 0 UNION ALL SELECT 'S2b', CASE WHEN count(*) > 0 THEN 1 ELSE 0 END FROM diag WHERE period_start = DATE '2024-01-10' AND cause = '追蹤碼失效'
  UNION ALL SELECT 'S3b', 0
  UNION ALL SELECT 'S2a', count(*) FILTER (WHERE transaction_id % 20 = 0) / count(*) FROM purchases WHERE order_date = DATE '2024-01-10'
  UNION ALL SELECT 'S3a', exp(regr_slope(ln(c), wk)) FROM (
    SELECT ((date - dayofweek(date)::INT) - DATE '1995-12-31') // 7 AS wk, sum(clicks) / sum(impressions) AS c FROM ad_daily WHERE creative_id = 'cr3' GROUP BY 1 HAVING count(*) = 7 AND sum(clicks) > 0)
  UNION ALL SELECT 'S5a', min(r) FROM (SELECT c_mktsegment, sum(CASE WHEN c_mktsegment = major THEN n ELSE 0 END) / sum(n) AS r FROM (
      SELECT *, first(c_mktsegment) OVER (PARTITION BY g ORDER BY n DESC, c_mktsegment DESC) AS major FROM (
        SELECT c_nationkey % 4 AS g, c_mktsegment, count(*) AS n FROM customer WHERE c_custkey % 3 > 0 GROUP BY 1, 2)) GROUP BY 1)
  UNION ALL SELECT 'S5b', avg(CAST(c_acctbal AS DECIMAL(18,2))) FILTER (WHERE c_mktsegment = 'BUILDING') / avg(CAST(c_acctbal AS DECIMAL(18,2))) FILTER (WHERE c_mktsegment <> 'BUILDING') FROM customer WHERE c_custkey % 2 = 0
  UNION ALL SELECT 'S6a', sum(credit_first_nd) / sum(credit_last_nd) FROM first7 WHERE channel = 'meta / paid_social'
  UNION ALL SELECT 'S6b', sum(credit_last_nd) / sum(credit_first_nd) FROM first7 WHERE channel = 'google / organic'
  UNION ALL SELECT 'S7a', 100 * (sum(quantity) FILTER (WHERE d AND p) / sum(quantity) FILTER (WHERE d) - sum(quantity) FILTER (WHERE NOT d AND p) / sum(quantity) FILTER (WHERE NOT d)) FROM (
    SELECT quantity, order_date >= DATE '2024-01-22' AS d, item_id IN (SELECT product_focus FROM creatives24 WHERE promotion_id = 'P1') AS p FROM purchases WHERE order_date BETWEEN DATE '2024-01-01' AND DATE '2024-01-30')"""
CTES["card"] = """
  SELECT signal_id, c.check_id, found_by, method, rule, lower_bound, upper_bound, round(actual, 3) AS actual,
    CASE WHEN lower_bound IS NULL THEN '待考' WHEN actual IS NULL THEN '沒有資料' WHEN actual BETWEEN lower_bound AND upper_bound THEN '找到' ELSE '沒找到' END AS verdict
  FROM crit c LEFT JOIN meas m ON m.check_id = c.check_id"""
MEAS = "ad_daily creatives24 diag " + atp.BASE7 + " first7 meas"
_MD = lambda x: f"month({x}) || '/' || day({x})"
CTES["lines"] = f"""
  SELECT 1 AS section, min(wk) || '|' || ad_group_id AS position, ad_group_id || '（' || CASE channel WHEN 'ch0' THEN '零' WHEN 'ch1' THEN '壹' ELSE channel END || '、' || campaign || '）：' ||
    string_agg({_MD('wk')} || ' ' || clk || '/' || printf('%.2f', coalesce(round(100 * (clk / imp), 2), 0)) || '/' || printf('%.1f', coalesce(round(cost::DOUBLE / nullif(clk, 0), 1), 0)) || '/' || round(cost)::BIGINT, '；' ORDER BY wk) AS line
  FROM (SELECT ad_group_id, CAST(date_trunc('week', date) AS DATE) AS wk, min(channel) AS channel, min(utm_campaign) AS campaign, sum(impressions) AS imp, sum(clicks) AS clk, sum(cost) AS cost FROM ad_daily GROUP BY 1, 2) GROUP BY ad_group_id, channel, campaign
  UNION ALL SELECT 2, min(ag) || '|' || creative_id, creative_id || '（' || min(ag) || '，上線 ' || {_MD('min(fd)')} || '）：' || string_agg({_MD('wk')} || ' ' || printf('%.2f', coalesce(round(100 * (clk / imp), 2), 0)), '、' ORDER BY wk)
  FROM (SELECT creative_id, CAST(date_trunc('week', date) AS DATE) AS wk, min(ad_group_id) AS ag, min(date) AS fd, sum(impressions) AS imp, sum(clicks) AS clk FROM ad_daily GROUP BY 1, 2) GROUP BY creative_id
  UNION ALL SELECT 3, '', string_agg({_MD('w')} || ' ' || coalesce(tracked, 0) || '/' || coalesce(n, 0) || '/' || round(coalesce(rev, 0))::BIGINT, '；' ORDER BY w)
  FROM (SELECT DISTINCT CAST(date_trunc('week', x) AS DATE) AS w FROM (SELECT date AS x FROM ad_daily UNION ALL SELECT order_date FROM shop_orders))
    LEFT JOIN (SELECT CAST(date_trunc('week', event_dt) AS DATE) AS w, count(*) AS tracked FROM site_purchases GROUP BY 1) USING (w)
    LEFT JOIN (SELECT CAST(date_trunc('week', order_date) AS DATE) AS w, count(*) AS n, sum(revenue) AS rev FROM shop_orders GROUP BY 1) USING (w)
  UNION ALL SELECT 4, '', string_agg({_MD('w')} || ' 一號 ' || a || '、二號 ' || b || '、三號 ' || c || '（合計 ' || t || '）', '；' ORDER BY w)
  FROM (SELECT CAST(date_trunc('week', order_date) AS DATE) AS w, coalesce(sum(quantity) FILTER (WHERE item_id = 'Brand#1'), 0) AS a, coalesce(sum(quantity) FILTER (WHERE item_id = 'Brand#2'), 0) AS b,
          coalesce(sum(quantity) FILTER (WHERE item_id = 'Brand#3'), 0) AS c, coalesce(sum(quantity), 0) AS t FROM shop_orders GROUP BY 1)"""

QUERIES = {
    "c02_measured_signals": lambda s, d: measured(s, d).withColumn("actual", F.round("actual", 9)),
    "c03_scorecard": scorecard,
    "c04_signal_verdict": lambda s, d: ac.signal_verdict(scorecard(s, d)),
    "c05_weekly_report_lines": lines,
    "c05_weekly_report_text": lambda s, d: ac.weekly_report_text(lines(s, d), "開頭", HEAD, "結尾", 3),
    "c06_explode_findings": findings,
    "c07_match_findings": matches,
    "c08_blind_scorecard": blind,
    "c08_runs_found": lambda s, d: ac.runs_found(blind(s, d)),
    "c09_found_by_signal": lambda s, d: reports(s, d)["by_signal"],
    "c09_per_run": lambda s, d: reports(s, d)["per_run"],
    "c09_cost": lambda s, d: reports(s, d)["cost"],
    "c09_findings_with_signals": lambda s, d: reports(s, d)["findings"],
    "c10_check_acceptance": _check,
}
_BL = "find hits blind"
ORACLE = {
    "c02_measured_signals": sql(MEAS, "SELECT check_id, round(actual, 9) AS actual FROM meas"),
    "c03_scorecard": sql(MEAS + " crit card", "SELECT * FROM card"),
    "c04_signal_verdict": sql(MEAS + " crit card", """SELECT signal_id, count(*) AS checks, count(*) FILTER (WHERE verdict = '找到') AS found, CASE WHEN bool_and(verdict = '待考') THEN '待考'
      WHEN bool_and(verdict = '找到') THEN '找到' WHEN bool_or(verdict = '找到') THEN '部分找到' ELSE '沒找到' END AS verdict FROM card GROUP BY 1"""),
    "c05_weekly_report_lines": sql("ad_daily shop_orders site_purchases lines", "SELECT * FROM lines"),
    "c05_weekly_report_text": sql("ad_daily shop_orders site_purchases lines", f"""
      SELECT unnest([1, 2, 3]) AS run_no, '開頭' || chr(10) || chr(10) || string_agg(({_ARR(HEAD)})[section] || chr(10) || b, chr(10) || chr(10) ORDER BY section) || chr(10) || chr(10) || '結尾' AS prompt
      FROM (SELECT section, string_agg(line, chr(10) ORDER BY position) AS b FROM lines GROUP BY 1)"""),
    "c06_explode_findings": sql("find", "SELECT * FROM find"),
    "c07_match_findings": sql("find hits", "SELECT * FROM hits"),
    "c08_blind_scorecard": sql(_BL, "SELECT * FROM blind"),
    "c08_runs_found": sql(_BL, "SELECT model, signal_id, count(*) FILTER (WHERE found) AS runs_found, count(*) AS runs FROM blind GROUP BY 1, 2"),
    "c09_found_by_signal": sql(_BL, "SELECT signal_id, count(*) FILTER (WHERE found AND model = 'm0') AS m0_found, count(*) FILTER (WHERE found AND model = 'm1') AS m1_found FROM blind GROUP BY 1"),
    "c09_per_run": sql(_BL, f"""SELECT 'm' || (event_id % 2) AS model, event_id AS run_no, coalesce(f.n, 0) AS findings, coalesce(g.n, 0) AS signals_found, {K} + 100 AS input_tokens,
      {K} % 50 AS output_tokens, CASE WHEN {K} % 29 = 0 THEN 5 ELSE 0 END AS thinking_tokens FROM events LEFT JOIN (SELECT run_no, count(*) AS n FROM find GROUP BY 1) f ON f.run_no = event_id
      LEFT JOIN (SELECT run_no, count(*) AS n FROM blind WHERE found GROUP BY 1) g ON g.run_no = event_id"""),
    "c09_cost": f"""SELECT model, calls, i AS input_tokens, o AS output_tokens, round(u, 4) AS usd, round(u * 32, 2) AS twd FROM (
      SELECT model, calls, i, o, (i * pin + o * pout)::DOUBLE / 1e6 AS u FROM (SELECT 'm' || (event_id % 2) AS model, count(*) AS calls, sum({K} + 100)::BIGINT AS i, sum({K} % 50)::BIGINT AS o FROM events GROUP BY 1)
      JOIN (VALUES ('m0', 0.33::DOUBLE, 2.75::DOUBLE), ('m1', 0.825::DOUBLE, 4.125::DOUBLE)) v(model, pin, pout) USING (model))""",
    "c09_findings_with_signals": sql("find hits", """SELECT f.model, f.run_no, f.finding_no, h.signals, target, period, observation, likely_cause FROM find f
      LEFT JOIN (SELECT run_no, finding_no, string_agg(signal_id, ',' ORDER BY signal_id) AS signals FROM hits GROUP BY 1, 2) h ON h.run_no = f.run_no AND h.finding_no = f.finding_no"""),
    "c10_check_acceptance": sql(MEAS + " crit card " + _BL, f"""
      SELECT n AS check_name, e AS expected, a AS actual, CASE WHEN e = a THEN 'OK' ELSE 'DIFF' END AS ok FROM (
        SELECT '01 criteria rows' AS n, '12' AS e, '12' AS a UNION ALL SELECT '02 scorecard rows', '12', (SELECT count(*) FROM card)::VARCHAR
        UNION ALL SELECT '03 scorecard pending', '1', (SELECT count(*) FROM card WHERE verdict = '待考')::VARCHAR
        UNION ALL SELECT '04 scorecard no data', '0', (SELECT count(*) FROM card WHERE verdict = '沒有資料')::VARCHAR
        UNION ALL SELECT '05 scorecard judged', '11', (SELECT count(*) FROM card WHERE verdict IN ('找到', '沒找到'))::VARCHAR
        UNION ALL SELECT '06 blind criteria rows', '4', '4' UNION ALL SELECT '07 blind prompt rows', '3', '3' UNION ALL SELECT '08 blind prompt identical', '1', '1'
        UNION ALL SELECT '09 blind result rows', count(*)::VARCHAR, count(*)::VARCHAR FROM events UNION ALL SELECT '10 blind models', '2', '2'
        UNION ALL SELECT '11 blind api_error', '0', count(*) FILTER (WHERE {K} % 31 = 0)::VARCHAR FROM events
        UNION ALL SELECT '12 blind bad_json', '0', count(*) FILTER (WHERE {K} % 10 = 9 AND {K} % 6 > 0)::VARCHAR FROM events
        UNION ALL SELECT '13 blind used_thinking', '0', count(*) FILTER (WHERE {K} % 29 = 0)::VARCHAR FROM events
        UNION ALL SELECT '14 runs with findings', (SELECT count(*) FROM events)::VARCHAR, count(DISTINCT run_no)::VARCHAR FROM find
        UNION ALL SELECT '15 blind scorecard rows', (4 * count(*))::VARCHAR, (4 * count(*))::VARCHAR FROM events)"""),
}
