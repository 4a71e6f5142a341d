from datetime import date

from pyspark.sql import functions as F

from ..operators import costs as co, lookups as lk
from ..sources import adapters as a
from . import anomaly as dp, warehouse as wp
from .oracle import CTES, K, sql

LO, HI = date(1997, 1, 1), date(1997, 6, 30)


def prices(s):
    return co.price_table(s, a.price_rows())


def calls(s, d):
    return co.usage_calls(a.usage_ledger(s, d), prices(s))


def daily(s, d):
    return co.usage_daily(calls(s, d))


def _context(s, d):
    st = wp.star(s, d)
    return co.shared_context_text(st["dim_product"], st["dim_date"], st["dim_creative"], a.ad_daily(s, d), "開頭", LO, HI)


def notes(s, d):
    x = a.table(s, d, "documents")
    i = F.col("doc_id")
    return x.select(F.concat(F.lit("k"), (i % 7).cast("string")).alias("utm_campaign"), F.concat(F.lit("a"), i.cast("string")).alias("author"), F.date_add(F.lit("2024-01-01").cast("date"), i.cast("int")).alias("updated_date"), F.col("text").alias("note"))


def _ttl(s, d):
    return co.breakeven_calls(a.table(s, d, "part").select((F.col("p_size") * 10).alias("ttl_minutes")).distinct())


def _overlaps(s, d):
    """Validity periods built from orders, so that there are many overlapping ones."""
    o = a.table(s, d, "orders")
    start = F.to_date("o_orderdate")
    p = o.select(F.concat(F.lit("m"), (F.col("o_custkey") % 500).cast("string")).alias("model"), F.col("o_orderstatus").alias("endpoint_type"), start.alias("valid_from"), F.date_add(start, (F.col("o_orderkey") % 40).cast("int")).alias("valid_to"))
    return co.overlapping_periods(p)


def _customers(s, d):
    return a.raw_customers(s, d).withColumn("customer_id", F.col("customer_id").cast("bigint"))


def _r(df, *cols):
    return df.withColumns({c: F.round(c, 9) for c in cols})


_C = ("cost_in_twd", "cost_out_twd", "cost_usd", "cost_twd")
CTES["ledger"] = f"""
  SELECT epoch_us(ts) AS logged_us, 'Day ' || (k % 5) AS day, (['ask', 'serve', 'eval'])[event_id % 3 + 1] AS job, 'r' || strftime(ts, '%Y%m%d') AS run_id, 'm' || (k % 4) AS model, (['global', 'non-global'])[event_id % 2 + 1] AS endpoint_type,
    (['low', 'default', 'none'])[k % 3 + 1] AS media_resolution, 'c' || user_id AS item_id, CASE WHEN k % 37 <> 0 THEN 1000 + k END AS prompt_tokens, CASE WHEN k % 29 <> 0 THEN 20 + k % 30 END AS output_tokens, CASE WHEN k % 31 = 0 THEN 'ERROR' ELSE '' END AS status,
    CAST(ts + INTERVAL 8 HOUR AS DATE) AS usage_date FROM (SELECT *, {K} AS k FROM events)"""
_P = "(VALUES " + ", ".join(f"('{m}', '{e}', DATE '{x}', DATE '{y}', {i}::DOUBLE, {o}::DOUBLE)" for m, e, x, y, i, o in a.PRICE_ROWS) + ") p(pm, pe, vf, vt, pin, pout)"
CTES["calls"] = f"""
  SELECT logged_us, usage_date, day, job, run_id, model, endpoint_type, media_resolution, item_id, CASE WHEN status = '' THEN 'ok' ELSE 'failed' END AS call_result, status, coalesce(prompt_tokens, 0) AS prompt_tokens,
    coalesce(output_tokens, 0) AS output_tokens, pm IS NOT NULL AS priced, coalesce(prompt_tokens, 0) * pin / 1e6 * 32 AS cost_in_twd, coalesce(output_tokens, 0) * pout / 1e6 * 32 AS cost_out_twd,
    (coalesce(prompt_tokens, 0) * pin + coalesce(output_tokens, 0) * pout) / 1e6 AS cost_usd, (coalesce(prompt_tokens, 0) * pin + coalesce(output_tokens, 0) * pout) / 1e6 * 32 AS cost_twd
  FROM ledger LEFT JOIN {_P} ON pm = model AND pe = endpoint_type AND usage_date BETWEEN vf AND vt"""
CTES["daily"] = f"""
  SELECT usage_date, day, job, model, endpoint_type, priced, count(*) AS calls, count(*) FILTER (WHERE call_result = 'failed') AS failed_calls, count(*) FILTER (WHERE NOT priced) AS unpriced_calls, sum(prompt_tokens)::BIGINT AS prompt_tokens,
    sum(output_tokens)::BIGINT AS output_tokens, sum(prompt_tokens + output_tokens)::BIGINT AS total_tokens, {', '.join(f'sum({x}) AS {x}' for x in _C)} FROM calls GROUP BY 1, 2, 3, 4, 5, 6"""
CTES["cache"] = f"""
  SELECT (['old', 'new', 'explicit', 'verify_1'])[event_id % 4 + 1] AS scenario, 1 + k % 3 AS round, (['all_site', 'g1', 'cr3'])[k % 3 + 1] AS entity, CASE WHEN k % 47 <> 0 THEN (['{"','".join(a.CAUSES[:3])}'])[k % 3 + 1] END AS cause, 5000 + k AS prompt_tokens,
    CASE WHEN event_id % 4 = 2 THEN 4200 + k WHEN event_id % 4 = 1 AND k % 2 = 0 THEN 2000 ELSE 0 END AS cached_tokens, 50 + k % 20 AS output_tokens, CASE WHEN k % 31 = 0 THEN 'ERROR' ELSE '' END AS status FROM (SELECT *, {K} AS k FROM events)"""
USE = "ledger calls"
DAY = "ledger calls daily"
_HIT = """count(*) AS calls, count(*) FILTER (WHERE cached_tokens > 0) AS hit_calls, sum(prompt_tokens) AS input_tokens, sum(cached_tokens) AS cached_tokens, round(100 * (sum(cached_tokens) / sum(prompt_tokens)), 1) AS cached_pct,
  sum(output_tokens) AS output_tokens, round(((sum(prompt_tokens) - sum(cached_tokens)) * 0.3::DOUBLE + sum(cached_tokens) * 0.03::DOUBLE) / 1e6 * 32, 3) AS input_twd, round(sum(output_tokens) * 2.5::DOUBLE / 1e6 * 32, 3) AS output_twd,
  round((((sum(prompt_tokens) - sum(cached_tokens)) * 0.3::DOUBLE + sum(cached_tokens) * 0.03::DOUBLE) / 1e6 + sum(output_tokens) * 2.5::DOUBLE / 1e6) * 32, 3) AS twd"""
_CK = lambda rows: "SELECT n AS check_name, e AS expected, a AS actual, CASE WHEN e = a THEN 'OK' ELSE 'DIFF' END AS ok FROM (" + " UNION ALL ".join(
    f"SELECT '{n}' AS n, ({e})::VARCHAR AS e, ({x})::VARCHAR AS a" for n, e, x in rows) + ")"
_OV = "SELECT a.model, a.endpoint_type, count(*) AS pairs FROM per a JOIN per b ON a.model = b.model AND a.endpoint_type = b.endpoint_type AND a.rn < b.rn AND a.vf <= b.vt AND b.vf <= a.vt GROUP BY 1, 2"

QUERIES = {
    "h01_shared_context_text": _context,
    "h01_context_questions": lambda s, d: co.context_questions(dp.an.render_facts(dp.summary(s, d)).where("level = 'site_day'")).select("anomaly_id", "question"),
    "h02_cache_hits_by_round": lambda s, d: co.cache_hit_report(a.cache_runs(s, d)),
    "h02_cache_hits_total": lambda s, d: co.cache_hit_report(a.cache_runs(s, d), by_round=False),
    "h03_breakeven_calls": _ttl,
    "h04_check_cache_runs": lambda s, d: co.check_cache_runs(a.cache_runs(s, d), dict(zip(("all_site", "g1", "cr3"), (a.CAUSES[0], a.CAUSES[1], a.CAUSES[0]))), a.CAUSES, 2500),
    "u02_usage_calls": lambda s, d: _r(calls(s, d), *_C),
    "u03_usage_daily": lambda s, d: _r(daily(s, d), *_C),
    "u04_usage_per_article": lambda s, d: co.usage_per_article(daily(s, d)),
    "u04_usage_per_day": lambda s, d: co.usage_per_day(daily(s, d)),
    "u04_usage_per_model": lambda s, d: co.usage_per_model(daily(s, d)),
    "u04_unpriced": lambda s, d: co.unpriced(daily(s, d)),
    "u05_check_usage": lambda s, d: co.check_usage(a.usage_ledger(s, d), prices(s), calls(s, d), daily(s, d)),
    "u05_overlapping_periods": _overlaps,
    "u06_spend_between": lambda s, d: co.spend_between(a.usage_ledger(s, d), "serve", F.lit(date(2024, 1, 5)), F.lit(date(2024, 1, 12)), 0.75, 3.75).withColumn("spent_twd", F.round("spent_twd", 6)),
    "u06_spend_today": lambda s, d: co.spend_today(a.usage_ledger(s, d), "serve", F.lit(date(2024, 1, 12)), 0.75, 3.75).withColumn("spent_twd", F.round("spent_twd", 6)),
    "u07_ad_spend": lambda s, d: lk.ad_spend(a.ad_daily(s, d), LO, HI, "creative"),
    "u07_ad_spend_by_channel": lambda s, d: lk.ad_spend(a.ad_daily(s, d), LO, HI, "channel"),
    "u08_top_customers": lambda s, d: lk.top_customers(a.shop_orders(s, d), _customers(s, d), LO, HI),
    "u09_campaign_notes": lambda s, d: lk.campaign_notes(notes(s, d), "k3"),
}
_SPEND = lambda g, extra: f"""SELECT * EXCLUDE (c) FROM (SELECT {g}, {extra} round(sum(cost))::BIGINT AS cost_twd, sum(impressions) AS impressions, sum(clicks) AS clicks, round(sum(clicks) / sum(impressions), 4) AS ctr,  # noqa: E731
  round(sum(cost)::DOUBLE / sum(clicks)::DOUBLE, 2) AS cpc_twd, count(DISTINCT date) AS days_with_data, count(*) OVER () AS total_groups, count(*) OVER () > 20 AS truncated, 0 AS c
  FROM ad_daily WHERE date BETWEEN DATE '1997-01-01' AND DATE '1997-06-30' GROUP BY 1 ORDER BY cost_twd DESC, 1 LIMIT 20)""".replace("# noqa: E731", "")
_WEEK = """SELECT string_agg(concat_ws('|', ad_group_id, w, d, clk, coalesce(printf('%.2f', round(100 * (clk / imp), 2)), '-'), coalesce(printf('%.1f', round(cost::DOUBLE / nullif(clk, 0)::DOUBLE, 1)), '-')), chr(10) ORDER BY ad_group_id, w) FROM (
  SELECT ad_group_id, CAST(date_trunc('week', date) AS DATE) AS w, count(DISTINCT date) AS d, sum(clicks) AS clk, sum(impressions) AS imp, sum(cost) AS cost FROM ad_daily WHERE date BETWEEN DATE '1997-01-01' AND DATE '1997-06-30' GROUP BY 1, 2)"""
ORACLE = {
    "h01_shared_context_text": sql(wp._FE + " raw_od creatives24 ad_daily", f"""SELECT '開頭' || chr(10) || chr(10) || '【背景一】商品清單（商品|定價元|第一次出現）' || chr(10)
        || (SELECT string_agg(concat_ws('|', item_id, coalesce(unit_price::VARCHAR, '-'), first_seen_date), chr(10) ORDER BY item_id) FROM prod)
        || chr(10) || chr(10) || '【背景二】專案檔期' || chr(10) || (SELECT string_agg(p || '：' || mn || ' 到 ' || mx, chr(10) ORDER BY p) FROM (SELECT promotion_id AS p, min(x) AS mn, max(x) AS mx FROM (SELECT DISTINCT event_dt AS x FROM fct) JOIN creatives24 ON x BETWEEN start_date AND end_date GROUP BY 1))
        || chr(10) || chr(10) || '【背景三】素材清單（素材|通路|廣告群組|受眾|格式|上線日|下檔日|主打商品）' || chr(10) || (SELECT string_agg(concat_ws('|', creative_id, channel, ad_group_id, audience, format, start_date, end_date, product_focus), chr(10) ORDER BY creative_id) FROM creatives24)
        || chr(10) || chr(10) || '【背景四】各廣告群組每週成效（廣告群組|週一日期|有資料天數|點擊|點擊率%|每次點擊花費元）' || chr(10) || ({_WEEK}) AS context""", **wp._FACT, prod=wp._PRODUCT),
    "h01_context_questions": sql(dp.ALL, f"SELECT anomaly_id, '【這次要判斷的異常】' || chr(10) || printf('{dp._text(dp.an.FACTS_SITE)}', {dp._ST}) AS question FROM summary WHERE level = 'site_day'"),
    "h02_cache_hits_by_round": sql("cache", f"SELECT scenario, round, {_HIT} FROM cache WHERE scenario <> 'verify_1' GROUP BY 1, 2"),
    "h02_cache_hits_total": sql("cache", f"SELECT scenario, {_HIT} FROM cache WHERE scenario <> 'verify_1' GROUP BY 1"),
    "h03_breakeven_calls": "SELECT DISTINCT p_size * 10 AS ttl_minutes, round((0.3::DOUBLE + 1.0::DOUBLE * (p_size * 10) / 60) / (0.3::DOUBLE - 0.03::DOUBLE), 1) AS breakeven_calls FROM part",
    "h04_check_cache_runs": sql("cache", f"""
      SELECT check_name, expected, actual::VARCHAR AS actual, CASE WHEN ok THEN 'OK' ELSE 'DIFF' END AS ok FROM (
        SELECT '1 ' || scenario || ' rows' AS check_name, '2500' AS expected, n AS actual, n = 2500 AS ok FROM p UNION ALL SELECT '2 ' || scenario || ' api_error', '0', e, e = 0 FROM p UNION ALL SELECT '3 ' || scenario || ' bad_cause', '0', b, b = 0 FROM p
        UNION ALL SELECT '4 ' || scenario || ' wrong_answer', '0', w, w = 0 FROM p UNION ALL SELECT '5 old hits', '0', h, h = 0 FROM p WHERE scenario = 'old' UNION ALL SELECT '6 explicit hits', '2500', h, h = 2500 FROM p WHERE scenario = 'explicit'
        UNION ALL SELECT '7 explicit min_cached', '>=4096', m, m >= 4096 FROM p WHERE scenario = 'explicit')""", p="""SELECT scenario, count(*) AS n, count(*) FILTER (WHERE status <> '') AS e, count(*) FILTER (WHERE cause IS NULL) AS b, count(*) FILTER (WHERE entity = 'cr3' AND cause IS NOT NULL) AS w, count(*) FILTER (WHERE cached_tokens > 0) AS h, min(cached_tokens) AS m
        FROM cache WHERE scenario <> 'verify_1' GROUP BY 1"""),
    "u02_usage_calls": sql(USE, f"SELECT * REPLACE ({', '.join(f'round({x}, 9) AS {x}' for x in _C)}) FROM calls"),
    "u03_usage_daily": sql(DAY, f"SELECT * REPLACE ({', '.join(f'round({x}, 9) AS {x}' for x in _C)}) FROM daily"),
    "u04_usage_per_article": sql(DAY, "SELECT day, sum(calls) AS calls, sum(failed_calls) AS failed_calls, sum(prompt_tokens) AS prompt_tokens, sum(output_tokens) AS output_tokens, round(sum(cost_twd), 2) AS cost_twd, sum(unpriced_calls) AS unpriced_calls FROM daily GROUP BY 1"),
    "u04_usage_per_day": sql(DAY, "SELECT usage_date, sum(calls) AS calls, sum(total_tokens) AS total_tokens, round(sum(cost_twd), 2) AS cost_twd, sum(unpriced_calls) AS unpriced_calls FROM daily GROUP BY 1"),
    "u04_usage_per_model": sql(DAY, """SELECT model, endpoint_type, sum(calls) AS calls, sum(prompt_tokens) AS prompt_tokens, sum(output_tokens) AS output_tokens, round(sum(cost_twd), 2) AS cost_twd, round(sum(output_tokens) / sum(total_tokens), 3) AS output_share_of_tokens,
      round(sum(cost_out_twd) / sum(cost_twd), 3) AS output_share_of_cost FROM daily GROUP BY 1, 2"""),
    "u04_unpriced": sql(DAY, "SELECT day, job, model, endpoint_type, sum(calls) AS calls, sum(prompt_tokens) AS prompt_tokens, sum(output_tokens) AS output_tokens FROM daily WHERE NOT priced GROUP BY 1, 2, 3, 4"),
    "u05_check_usage": sql(DAY, _CK([
        ("01 usage table has rows", "true", "SELECT count(*) > 0 FROM ledger"), ("02 calls = usage rows", "SELECT count(*) FROM ledger", "SELECT count(*) FROM calls"), ("03 daily calls = usage rows", "SELECT count(*) FROM ledger", "SELECT sum(calls) FROM daily"),
        ("04 daily input tokens", "SELECT sum(prompt_tokens) FROM ledger", "SELECT sum(prompt_tokens) FROM daily"), ("05 daily output tokens", "SELECT sum(output_tokens) FROM ledger", "SELECT sum(output_tokens) FROM daily"), ("06 price periods overlapping", "0", "0"),
        ("07 calls with tokens but no price", "0", "SELECT count(*) FROM calls WHERE NOT priced AND prompt_tokens + output_tokens > 0"), ("08 unknown endpoint", "0", "0"), ("09 negative or null cost on priced calls", "0", "0"), ("10 rows without a day label", "0", "0"),
        ("11 unpriced calls", "SELECT count(*) FROM calls WHERE NOT priced", "SELECT sum(unpriced_calls) FROM daily"), ("12 input + output cost = cost", "true", "true")])),
    "u05_overlapping_periods": sql("", _OV, per="SELECT 'm' || (o_custkey % 500) AS model, o_orderstatus AS endpoint_type, CAST(o_orderdate AS DATE) AS vf, CAST(CAST(o_orderdate AS DATE) + CAST(o_orderkey % 40 AS INT) AS DATE) AS vt, row_number() OVER (ORDER BY o_orderkey) AS rn FROM orders"),
    "u06_spend_between": sql("ledger", "SELECT sum(prompt_tokens)::BIGINT AS prompt_tokens, sum(output_tokens)::BIGINT AS output_tokens, round((sum(prompt_tokens) * 0.75 + sum(output_tokens) * 3.75)::DOUBLE / 1e6 * 32, 6) AS spent_twd FROM ledger WHERE job = 'serve' AND usage_date BETWEEN DATE '2024-01-05' AND DATE '2024-01-12'"),
    "u06_spend_today": sql("ledger", "SELECT sum(prompt_tokens) AS prompt_tokens, sum(output_tokens) AS output_tokens, round((sum(prompt_tokens) * 0.75 + sum(output_tokens) * 3.75)::DOUBLE / 1e6 * 32, 6) AS spent_twd FROM ledger WHERE job = 'serve' AND usage_date = DATE '2024-01-12'"),
    "u07_ad_spend": sql("ad_daily", _SPEND("creative_id AS creative", "min(channel) AS channel,")),
    "u07_ad_spend_by_channel": sql("ad_daily", _SPEND("channel", "")),
    "u08_top_customers": sql("shop_orders", """SELECT customer_id, 'C' || repeat('○', length(c_name) - 1) AS name, substr(lower(c_mktsegment), 1, 1) || '***@example.com' AS email, substr(p, 1, 4) || '-***-' || substr(p, 8, 3) AS phone, 'N' || c_nationkey AS city, orders, revenue_twd
      FROM (SELECT customer_id, count(DISTINCT transaction_id) AS orders, sum(revenue) AS revenue_twd FROM shop_orders WHERE order_date BETWEEN DATE '1997-01-01' AND DATE '1997-06-30' AND customer_id IN (SELECT c_custkey FROM customer) GROUP BY 1 ORDER BY 3 DESC, 1 LIMIT 5)
      JOIN (SELECT *, '09' || lpad(c_custkey::VARCHAR, 8, '0') AS p FROM customer) ON c_custkey = customer_id"""),
    "u09_campaign_notes": "SELECT 'k3' AS campaign, 'a' || doc_id AS author, CAST(DATE '2024-01-01' + CAST(doc_id AS INT) AS DATE) AS updated_date, substr(text, 1, 300) AS note FROM documents WHERE doc_id % 7 = 3",
}
