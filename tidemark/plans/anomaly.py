from datetime import date

from pyspark.sql import functions as F

from ..operators import anomaly as an
from ..sources import adapters as a, io
from . import warehouse as wp
from .oracle import CTES, K, sql

MAPPING = {("ch0", "paid"): "ch0", ("ch1", "paid"): "ch1", ("ch2", "paid"): "ch2"}
LO, HI = date(1995, 1, 1), date(2001, 12, 31)
P = f"BETWEEN DATE '{LO}' AND DATE '{HI}'"

CTES["site_purchases"] = """
  SELECT CAST(l_shipdate AS DATE) AS event_dt, l_orderkey AS transaction_id, 'ch' || (l_orderkey % 3) AS channel, sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS value
  FROM lineitem GROUP BY 1, 2"""
# The second computation numbers the weeks (days) of each series and joins every one with those up to four (seven) numbers before it.
_MONDAY = lambda c: f"{c} - (isodow({c}) - 1)::INT"
_BEFORE = lambda n: f"t.n - e.n BETWEEN 1 AND {n}"
CTES["paid"] = f"SELECT *, {_MONDAY('date')} AS monday FROM ad_daily WHERE date {P}"
CTES["takings"] = f"SELECT channel, {_MONDAY('event_dt')} AS monday, sum(value) AS income FROM site_purchases WHERE event_dt {P} GROUP BY 1, 2"
CTES["chweek"] = """
  SELECT *, rank() OVER (PARTITION BY channel ORDER BY monday) AS n FROM (SELECT channel, monday, sum(cost) AS spent FROM paid GROUP BY ALL) LEFT JOIN takings USING (channel, monday)"""
CTES["roas"] = f"""
  SELECT t.channel, t.monday AS wk, any_value(t.income)::DOUBLE / nullif(any_value(t.spent), 0)::DOUBLE AS roas, sum(e.income)::DOUBLE / nullif(sum(e.spent), 0)::DOUBLE AS roas_base
  FROM chweek t LEFT JOIN chweek e ON e.channel = t.channel AND {_BEFORE(4)} GROUP BY t.channel, t.monday"""
CTES["gweek"] = """
  SELECT ad_group_id, monday, min(channel) AS channel, count(DISTINCT date) AS active, sum(impressions) AS shown, sum(clicks) AS hits, sum(cost) AS spent,
    rank() OVER (PARTITION BY ad_group_id ORDER BY monday) AS n FROM paid GROUP BY ad_group_id, monday"""
CTES["gpast"] = f"""
  SELECT t.ad_group_id, t.monday, count(*) AS weeks, sum(e.active) AS active, sum(e.shown) AS shown, sum(e.hits) AS hits, sum(e.spent)::DOUBLE AS spent
  FROM gweek t JOIN gweek e ON e.ad_group_id = t.ad_group_id AND {_BEFORE(4)} GROUP BY 1, 2"""
CTES["adgroups"] = """
  SELECT g.ad_group_id, g.monday AS wk, g.channel, g.active AS days, g.shown AS imp, g.hits AS clk, g.spent AS cost, g.hits / nullif(g.shown, 0) AS ctr, g.spent::DOUBLE / nullif(g.hits, 0) AS cpc,
    p.hits / nullif(p.shown, 0) AS ctr_base, p.spent / nullif(p.hits, 0) AS cpc_base, p.hits / nullif(p.active, 0) AS clk_per_day_base, coalesce(p.weeks, 0) AS base_weeks
  FROM gweek g LEFT JOIN gpast p USING (ad_group_id, monday)"""
CTES["gmoves"] = """
  SELECT * FROM (SELECT *, cpc / cpc_base - 1 AS dearer, ctr / ctr_base - 1 AS livelier FROM adgroups) WHERE base_weeks > 1 AND days > 2 AND (dearer >= 0.3 OR dearer <= -0.3 OR livelier <= -0.2)"""
CTES["gfound"] = """
  SELECT 'adgroup_week' AS level, ad_group_id AS entity, v.channel, v.wk AS period_start, v.wk + 6 AS period_end, round(100 * dearer) + 0.0 AS cpc_chg_pct, round(100 * livelier) + 0.0 AS ctr_chg_pct,
    struct_pack(days := days, imp := imp::BIGINT, clk := clk::BIGINT, cost := round(cost::DOUBLE), ctr_pct := round(ctr * 100, 2), ctr_base_pct := round(ctr_base * 100, 2), cpc := round(cpc, 2),
      cpc_base := round(cpc_base, 2), clk_per_day := round(clk / days, 1), clk_per_day_base := round(clk_per_day_base, 1), channel_roas := round(roas, 2), channel_roas_base := round(roas_base, 2)) AS m
  FROM gmoves v LEFT JOIN roas USING (channel, wk) WHERE v.wk = (SELECT min(x.wk) FROM gmoves x WHERE x.ad_group_id = v.ad_group_id)"""
CTES["born"] = "SELECT creative_id, min(date) AS launch FROM paid GROUP BY 1"
CTES["debut"] = """
  SELECT creative_id, any_value(launch) AS launch, sum(clicks) / nullif(sum(impressions), 0) AS ctr_base, sum(cost)::DOUBLE / nullif(sum(clicks), 0) AS cpc_base
  FROM paid JOIN born USING (creative_id) WHERE date - launch < 14 GROUP BY 1"""
CTES["tired"] = """
  SELECT *, hits / nullif(shown, 0) / ctr_base - 1 AS livelier, spent / nullif(hits, 0) / cpc_base - 1 AS dearer FROM debut JOIN (
    SELECT creative_id, monday, min(channel) AS channel, count(DISTINCT date) AS active, sum(impressions) AS shown, sum(clicks) AS hits, sum(cost)::DOUBLE AS spent FROM paid GROUP BY 1, 2) USING (creative_id)
  WHERE monday - launch >= 14 AND active > 2 AND livelier <= -0.25"""
CTES["cfound"] = """
  SELECT 'creative_week' AS level, creative_id AS entity, channel, monday AS period_start, monday + 6 AS period_end, round(100 * dearer) + 0.0 AS cpc_chg_pct, round(100 * livelier) + 0.0 AS ctr_chg_pct,
    struct_pack(days := active, imp := shown::BIGINT, clk := hits::BIGINT, cost := round(spent), ctr_pct := round(hits / shown * 100, 2), ctr_base_pct := round(ctr_base * 100, 2), cpc := round(spent / nullif(hits, 0), 2),
      cpc_base := round(cpc_base, 2), days_since_launch := monday - launch) AS m
  FROM tired v WHERE monday = (SELECT min(x.monday) FROM tired x WHERE x.creative_id = v.creative_id)"""
CTES["dayrow"] = f"""
  SELECT *, row_number() OVER (ORDER BY d) AS n FROM (SELECT date AS d, sum(cost)::DOUBLE AS cost, sum(clicks) AS clk FROM paid GROUP BY 1)
  LEFT JOIN (SELECT event_dt AS d, count(*) AS tracked, sum(value)::DOUBLE AS tracked_rev FROM site_purchases GROUP BY 1) USING (d)
  LEFT JOIN (SELECT CAST(o_orderdate AS DATE) AS d, count(*) AS orders, sum(CAST(o_totalprice AS DECIMAL(18,2)))::DOUBLE AS order_rev FROM orders GROUP BY 1) USING (d)"""
CTES["siteday"] = f"""
  SELECT t.d, coalesce(any_value(t.tracked), 0) AS tracked, coalesce(any_value(t.tracked_rev), 0) AS tracked_rev, coalesce(any_value(t.orders), 0) AS orders, coalesce(any_value(t.order_rev), 0) AS order_rev,
    any_value(t.cost) AS cost, any_value(t.clk) AS clk, sum(coalesce(e.tracked, 0)) / nullif(count(e.d), 0) AS tracked_base, sum(coalesce(e.orders, 0)) / nullif(count(e.d), 0) AS orders_base,
    sum(e.clk) / nullif(count(e.d), 0) AS clk_base, count(e.d) AS base_days
  FROM dayrow t LEFT JOIN dayrow e ON {_BEFORE(7)} GROUP BY t.d"""
CTES["dfound"] = """
  SELECT 'site_day' AS level, 'all_site' AS entity, NULL::VARCHAR AS channel, d AS period_start, d AS period_end, NULL::DOUBLE AS cpc_chg_pct, NULL::DOUBLE AS ctr_chg_pct,
    struct_pack(tracked := tracked, tracked_base := round(tracked_base, 1), orders := orders, orders_base := round(orders_base, 1), tracked_roas := round(tracked_rev / cost, 2),
      order_roas := round(order_rev / cost, 2), clk := clk::BIGINT, clk_base := round(clk_base)) AS m
  FROM siteday WHERE base_days > 4 AND (tracked <= tracked_base / 2 OR orders <= orders_base / 2)"""
CTES["summary"] = " UNION ALL ".join(
    f"SELECT level || '|' || entity || '|' || period_start AS anomaly_id, level, entity, channel, period_start, period_end, to_json(m) AS j, cpc_chg_pct, ctr_chg_pct FROM {t}"
    for t in ("gfound", "cfound", "dfound"))
CTES["diag"] = f"""
  SELECT *, CASE WHEN ok AND k % 7 < 6 THEN (['{"','".join(a.CAUSES)}'])[k % 7 + 1] WHEN ok THEN '不明' END AS cause,
    CASE WHEN ok THEN CASE WHEN k % 17 = 0 THEN '' ELSE 'e' || k END END AS evidence,
    CASE WHEN ok THEN CASE WHEN k % 19 = 0 THEN 1.5 WHEN k % 23 = 0 THEN NULL ELSE k / 100.0 END END::DOUBLE AS confidence, CASE WHEN ok THEN 'n' || k END AS next_check
  FROM (SELECT event_id, {K} AS k, {K} % 10 <> 9 AS ok, 'site_day|all_site|' || CAST(ts AS DATE) AS anomaly_id, 'all_site' AS entity, CAST(ts AS DATE) AS period_start,
    'm' || (event_id % 2) AS model FROM events)"""
_G = "ad_daily paid site_purchases takings chweek roas gweek gpast adgroups gmoves gfound"
_C, _D = "born debut tired cfound", "dayrow siteday dfound"
ALL = f"{_G} {_C} {_D} summary"


def _roas(s, d, ads=None, site=None):
    return an.channel_week_roas(a.site_purchases(s, d) if site is None else site, a.ad_daily(s, d) if ads is None else ads, MAPPING, LO, HI)


def _adgroup(s, d, ads=None, site=None):
    ads = a.ad_daily(s, d) if ads is None else ads
    return an.flag_adgroup(an.adgroup_week(ads, LO, HI), _roas(s, d, ads, site))


def _creative(s, d, ads=None):
    ads = io.materialize(a.ad_daily(s, d)) if ads is None else ads
    return an.flag_creative(ads, an.creative_launch_baseline(ads, 14, LO, HI), start=LO, end=HI)


def _day(s, d, ads=None, site=None):
    return an.site_day(a.site_purchases(s, d) if site is None else site, a.table(s, d, "orders").select(F.to_date("o_orderdate").alias("order_date"), F.col("o_totalprice").cast("decimal(18,2)").alias("revenue")),
                       a.ad_daily(s, d) if ads is None else ads, LO, HI)


def summary(s, d):
    # the daily advertising fact and the tracked purchases are tables in their own right, read by all three levels
    ads, site = io.materialize(a.ad_daily(s, d)), io.materialize(a.site_purchases(s, d))
    return an.anomaly_summary(_adgroup(s, d, ads, site), _creative(s, d, ads), an.flag_site(_day(s, d, ads, site)))


def diagnosis(s, d):
    return an.parse_diagnosis(a.diagnosis_replies(s, d))


def _parsed_summary(s, d):
    num = lambda k: F.get_json_object("metrics_json", f"$.{k}").cast("double").alias(k)
    return summary(s, d).select("anomaly_id", "level", "entity", "channel", "period_start", "period_end", "cpc_chg_pct", "ctr_chg_pct",
                                *[num(k) for k in ("days", "imp", "clk", "ctr_pct", "cpc", "tracked", "orders_base")])


PRICES = {"m0": (0.33, 2.75), "m1": (0.825, 4.125)}


def _worst(s, d):
    tokens = a.diagnosis_replies(s, d).select(F.get_json_object("statistics", "$.prompt_token_count").cast("bigint").alias("prompt_tokens"))
    return an.worst_case_cost(tokens, PRICES, output_cap=512, overhead=20)


QUERIES = {
    "d01_channel_week_roas": _roas,
    "d02_adgroup_week": lambda s, d: an.adgroup_week(a.ad_daily(s, d), LO, HI),
    "d03_flag_adgroup": lambda s, d: _adgroup(s, d).select("level", "entity", "channel", "period_start", "period_end", "m.*", "cpc_chg_pct", "ctr_chg_pct"),
    "d04_creative_launch_baseline": lambda s, d: an.creative_launch_baseline(a.ad_daily(s, d), 14, LO, HI),
    "d05_flag_creative": lambda s, d: _creative(s, d).select("level", "entity", "channel", "period_start", "period_end", "m.*", "cpc_chg_pct", "ctr_chg_pct"),
    "d06_site_day": _day,
    "d07_flag_site": lambda s, d: an.flag_site(_day(s, d)).select("level", "entity", "period_start", "m.*"),
    "d08_anomaly_summary": _parsed_summary,
    "d09_render_facts": lambda s, d: an.render_facts(summary(s, d)),
    "d10_parse_diagnosis": lambda s, d: diagnosis(s, d).select("event_id", "model", "cause", "evidence", "confidence", "next_check"),
    "d11_check_replies": lambda s, d: an.check_replies(diagnosis(s, d), a.table(s, d, "events").agg((F.count(F.lit(1)) / 2).cast("bigint")).scalar(), a.CAUSES),
    "d12_models_side_by_side": lambda s, d: an.models_side_by_side(diagnosis(s, d), ["m0", "m1"]),
    "d13_promo_share": lambda s, d: an.promo_share_before_after(a.purchases(s, d), wp.star(s, d)["dim_product"], "P1", date(2024, 1, 22), date(2024, 1, 30)),
    "d14_worst_case_cost": _worst,
    "d15_diagnosis_lookup": lambda s, d: an.diagnosis_lookup(
        summary(s, d), diagnosis(s, d).withColumn("anomaly_id", F.concat(F.lit("creative_week|cr"), (F.col("event_id") % 24).cast("string"), F.lit("|1995-01-23"))), "ch1", "m0"),
    "d16_prompt_variants": lambda s, d: an.compare_prompt_variants(a.diagnosis_replies(s, d).where("model = 'm0'"), a.diagnosis_replies(s, d).where("model = 'm1'")),
    "d17_diagnosis_reasons": lambda s, d: an.diagnosis_reasons(diagnosis(s, d), "m0"),
}

_M = lambda t: f"SELECT level, entity, channel, period_start, period_end, unnest(m), cpc_chg_pct, ctr_chg_pct FROM {t}"
_PARTS = (_G, f"ad_daily paid {_C}", f"ad_daily paid site_purchases {_D}")


def _text(template):
    return template.replace("\n", "' || chr(10) || '")


_F = lambda k: f"(j->>'{k}')"
_AG = ", ".join(["entity", "channel", "period_start::VARCHAR", "period_end::VARCHAR", *map(_F, ("days", "clk_per_day", "clk_per_day_base", "ctr_pct", "ctr_base_pct", "cpc", "cpc_base")),
                 "printf('%+.0f', cpc_chg_pct)", "printf('%.0f', (j->>'cost')::DOUBLE)", "coalesce(j->>'channel_roas', '無資料')", "coalesce(j->>'channel_roas_base', '無資料')"])
_CR = ", ".join(["entity", "channel", "period_start::VARCHAR", "period_end::VARCHAR", *map(_F, ("days", "days_since_launch", "imp", "clk", "ctr_pct", "ctr_base_pct")),
                 "printf('%+.0f', ctr_chg_pct)", _F("cpc"), _F("cpc_base"), "printf('%.0f', (j->>'cost')::DOUBLE)"])
_ST = ", ".join(["period_start::VARCHAR", *map(_F, ("tracked", "tracked_base", "orders", "orders_base", "clk", "clk_base", "tracked_roas", "order_roas"))])

ORACLE = {
    "d01_channel_week_roas": sql("ad_daily paid site_purchases takings chweek roas", "SELECT * FROM roas"),
    "d02_adgroup_week": sql("ad_daily paid gweek gpast adgroups", "SELECT * FROM adgroups"),
    "d03_flag_adgroup": sql(_PARTS[0], _M("gfound")),
    "d04_creative_launch_baseline": sql("ad_daily paid born debut", "SELECT * FROM debut"),
    "d05_flag_creative": sql(_PARTS[1], _M("cfound")),
    "d06_site_day": sql("ad_daily paid site_purchases dayrow siteday", "SELECT * FROM siteday"),
    "d07_flag_site": sql(_PARTS[2], "SELECT level, entity, period_start, unnest(m) FROM dfound"),
    "d08_anomaly_summary": sql(ALL, "SELECT anomaly_id, level, entity, channel, period_start, period_end, cpc_chg_pct, ctr_chg_pct, "
                               + ", ".join(f"CAST(j->>'{k}' AS DOUBLE) AS {k}" for k in ("days", "imp", "clk", "ctr_pct", "cpc", "tracked", "orders_base")) + " FROM summary"),
    "d09_render_facts": sql(ALL, f"""SELECT anomaly_id, level, entity, period_start, CASE level
      WHEN 'adgroup_week' THEN printf('{_text(an.FACTS_ADGROUP)}', {_AG})
      WHEN 'creative_week' THEN printf('{_text(an.FACTS_CREATIVE)}', {_CR})
      ELSE printf('{_text(an.FACTS_SITE)}', {_ST}) END AS facts FROM summary"""),
    "d10_parse_diagnosis": sql("diag", "SELECT event_id, model, cause, evidence, confidence, next_check FROM diag"),
    "d11_check_replies": sql("diag", f"""
      SELECT 'models' AS check_name, '2' AS expected, '2' AS actual, 'OK' AS ok
      UNION ALL SELECT model || ' ' || what, CAST(want AS VARCHAR), CAST(have AS VARCHAR), CASE WHEN want = have THEN 'OK' ELSE 'DIFF' END FROM (
        SELECT model, unnest(['rows', 'api_error', 'bad_json', 'bad_cause', 'bad_confidence', 'no_evidence', 'used_thinking']) AS what,
          unnest([(SELECT count(*) // 2 FROM events), 0, 0, 0, 0, 0, 0]) AS want,
          unnest([count(*), count(*) FILTER (WHERE k % 31 = 0), count(*) FILTER (WHERE NOT ok), count(*) FILTER (WHERE cause IS NULL OR cause = '不明'),
            count(*) FILTER (WHERE confidence IS NULL OR confidence NOT BETWEEN 0 AND 1), count(*) FILTER (WHERE evidence IS NULL OR evidence = ''), count(*) FILTER (WHERE k % 29 = 0)]) AS have
        FROM diag GROUP BY model)"""),
    "d12_models_side_by_side": sql("diag", """SELECT entity, period_start, max(CASE WHEN model = 'm0' THEN t END) AS m0, max(CASE WHEN model = 'm1' THEN t END) AS m1,
      sum(k + 100) AS input_tokens, sum(k % 50) AS output_tokens FROM (SELECT *, CASE WHEN cause IS NOT NULL AND confidence IS NOT NULL THEN printf('%s（%.2f）', cause, confidence) END AS t FROM diag) GROUP BY 1, 2"""),
    "d13_promo_share": sql("purchases creatives24", """
      SELECT CASE WHEN order_date >= DATE '2024-01-22' THEN '2_during' ELSE '1_before' END AS period, sum(quantity) AS qty, sum(CASE WHEN promo THEN quantity ELSE 0 END) AS promo_qty,
        round(100.0 * sum(CASE WHEN promo THEN quantity ELSE 0 END) / sum(quantity), 1)::DOUBLE AS promo_qty_share_pct,
        round(100 * (sum(CASE WHEN promo THEN revenue ELSE 0 END)::DOUBLE / sum(revenue)::DOUBLE), 1) AS promo_rev_share_pct
      FROM (SELECT *, item_id IN (SELECT product_focus FROM creatives24 WHERE promotion_id = 'P1') AS promo FROM purchases WHERE order_date BETWEEN DATE '2024-01-01' AND DATE '2024-01-30') GROUP BY 1"""),
    "d14_worst_case_cost": f"""
      WITH b AS (SELECT count(*) AS calls, sum({K} + 120)::BIGINT AS input_tokens, count(*) * 512 AS max_output_tokens FROM events),
        p AS (SELECT b.*, v.*, (input_tokens * pin + max_output_tokens * pout)::DOUBLE / 1e6 AS usd FROM b, (VALUES ('m0', 0.33::DOUBLE, 2.75::DOUBLE), ('m1', 0.825::DOUBLE, 4.125::DOUBLE)) v(model, pin, pout))
      SELECT model, calls, input_tokens, max_output_tokens, round(usd, 4) AS usd, round(usd * 32, 2) AS twd FROM p
      UNION ALL SELECT 'total', sum(calls), sum(input_tokens), sum(max_output_tokens), round(sum(usd), 4), round(sum(usd) * 32, 2) FROM p""",
    "d15_diagnosis_lookup": sql(ALL + " diag", """
      SELECT s.anomaly_id, s.level, s.entity, coalesce(s.channel, 'all_site') AS channel, s.period_start, s.period_end, cpc_chg_pct, ctr_chg_pct, cause, evidence, confidence
      FROM summary s LEFT JOIN (SELECT * REPLACE ('creative_week|cr' || (event_id % 24) || '|1995-01-23' AS anomaly_id) FROM diag WHERE model <> 'm0') d ON d.anomaly_id = s.anomaly_id
      WHERE s.channel = 'ch1' OR s.channel IS NULL"""),
    "d16_prompt_variants": sql("diag", "SELECT CASE model WHEN 'm0' THEN 'A' ELSE 'B' END AS variant, anomaly_id, model, cause, confidence FROM diag"),
    "d17_diagnosis_reasons": sql("diag", "SELECT entity, period_start, cause, evidence, next_check FROM diag WHERE model = 'm0'"),
}
