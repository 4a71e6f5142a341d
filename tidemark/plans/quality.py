from datetime import date

from pyspark.sql import functions as F

from ..functions.checks import compare_metrics, union_all
from ..operators import quality as q
from ..operators.recount import recount_vector
from ..sources import adapters as a
from . import warehouse as wp
from .oracle import CTES, sql

CTES["ev_q"] = "SELECT *, strftime(event_dt, '%Y%m%d') AS event_date, CAST(strftime(event_dt, '%Y%m%d') AS BIGINT) AS ga_session_id FROM web_events"


def events(s, d):
    e = a.web_events(s, d)
    day = F.date_format("event_dt", "yyyyMMdd")
    return e.withColumns({"event_date": day, "ga_session_id": day.cast("bigint")})


def customers(s, d):
    return a.raw_customers(s, d).withColumn("customer_id", F.col("customer_id").cast("bigint"))


SIGNALS = q.Signals("g1", date(1998, 7, 1), date(2024, 1, 10), "cr3", date(1996, 1, 1), {"meta": "meta/paid_social", "google": "google/organic"}, ["i1", "i2", "i3"], date(2024, 1, 22), date(2024, 1, 30))
# ratios and estimates come from sums of doubles in another order; everything else must be equal
TOLERANCES = {"s1.": 1e-8, "s3.": 1e-7, "s4.": 1e-7, "aov": 1e-6}


def _tables(s, d):
    return {"events": events(s, d), "orders": a.purchases(s, d), "ads": a.ad_daily(s, d), "creatives": a.creatives(s, d), "customers": customers(s, d)}


def vector(s, d):
    return q.metric_vector(**_tables(s, d), signals=SIGNALS, tz="UTC")


def _compare(s, d):
    """Both ways over the whole tables, every metric."""
    t = _tables(s, d)
    return compare_metrics(q.metric_vector(**t, signals=SIGNALS, tz="UTC"), recount_vector(**t, signals=SIGNALS, tz="UTC"), tolerances=TOLERANCES).select("metric", "ok")


def _planted(s, d):
    """One customer's phone number changed on one side: the metrics that then differ."""
    t = _tables(s, d)
    first = t["customers"].agg(F.min("customer_id")).scalar()
    changed = t["customers"].withColumn("phone", F.when(F.col("customer_id") == first, F.concat(F.lit("+"), "phone")).otherwise(F.col("phone")))
    out = compare_metrics(q.metric_vector(**t, signals=SIGNALS, tz="UTC"), recount_vector(**(t | {"customers": changed}), signals=SIGNALS, tz="UTC"), tolerances=TOLERANCES)
    return out.where("ok = 'DIFF'").select("metric", (F.col("value_a").cast("bigint") - F.col("value_b").cast("bigint")).alias("difference"))


def _sessions(s, d):
    return a.table(s, d, "events").where("event_type <> 'purchase'").select(
        F.col("user_id").alias("user_pseudo_id"), F.floor(q.F.timestamp_diff("SECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col("ts"))).alias("ga_session_id"))


def _signals(s, d):
    ads, cr = a.ad_daily(s, d), a.creatives(s, d)
    s1 = q.cost_per_click_before_after(ads, "g1", date(1998, 7, 1)).select(F.lit("s1").alias("signal"), (F.col("cpc_after") / F.col("cpc_before")).alias("value"))
    s3 = q.weekly_decay(ads, "cr3", date(1996, 1, 1)).select(F.lit("s3"), "weekly_decay")
    s4 = q.stratified_ratio(ads, cr, ["cr3"]).select(F.concat(F.lit("s4."), "attr"), "estimate")
    s7 = q.basket_share_window(a.purchases(s, d), ["i1", "i2", "i3"], date(2024, 1, 22), date(2024, 1, 30)).select(F.lit("s7"), F.col("share_window") / F.col("share_pre"))
    return q.signal_checks(s1.union(s3).union(s4).union(s7), {"s1": 2.0, "s3": 0.08, "s4.person": 1.25, "s4.cta": 1.1, "s4.warm": 1.1})


def _rules(s, d):
    ev, od, ads, cr = events(s, d), a.purchases(s, d), a.ad_daily(s, d), wp.creatives24(s, d)
    shop = a.shop_orders(s, d)
    cu = customers(s, d)
    part = a.table(s, d, "part").groupBy(F.col("p_brand").alias("item_id")).agg(F.min("p_retailprice").cast("decimal(18,2)").alias("price"))
    return union_all([
        q.values_in_catalog(shop, "item_id", part, "item_id"),
        q.amount_equals_price_times_qty(shop, part),
        q.purchase_events_match_orders(ev, od),
        q.order_id_unique(od),
        q.customer_fk(od, cu),
        q.first_order_date_consistent(od, cu),
        q.values_in_catalog(ads, "creative_id", cr, "creative_id", "ad_creative_fk"),
        q.values_in_catalog(ev, "creative_id", cr, "creative_id", "event_creative_fk"),
        q.clicks_le_impressions(ads),
        q.dates_in_period(ev, "event_dt", date(2024, 1, 1), date(2024, 1, 20)),
        q.local_date_matches(ev),
        q.first_event_is_first_visit(ev, "session_start"),
        q.visitor_id_suffix(ev),
    ])


def _variants(s, d):
    e = a.raw_events(s, d)
    options = e.groupBy("item_id").agg(F.array_sort(F.collect_set(F.when(F.col("item_variant") != "v3", F.col("item_variant")))).alias("size_options"))
    return q.variant_in_options(e.where("item_id is not null"), options)


QUERIES = {
    "v01_metric_vector": vector,
    "v02_cost_per_click_before_after": lambda s, d: q.cost_per_click_before_after(a.ad_daily(s, d), "g1", date(1998, 7, 1)),
    "v03_event_vs_order_gap": lambda s, d: q.event_vs_order_gap(a.web_events(s, d).where("transaction_id % 50 <> 0 or transaction_id is null"), a.purchases(s, d), date(2024, 1, 10)),
    "v04_weekly_decay": lambda s, d: q.weekly_decay(a.ad_daily(s, d), "cr3", date(1996, 1, 1)),
    "v05_stratified_ratio": lambda s, d: q.stratified_ratio(a.ad_daily(s, d), a.creatives(s, d), ["cr3"]),
    "v06_orders_per_customer": lambda s, d: q.orders_per_customer_histogram(a.shop_orders(s, d)),
    "v07_first_last_touch": lambda s, d: q.first_last_touch_before_first_order(a.web_events(s, d), a.purchases(s, d)),
    "v08_basket_share_window": lambda s, d: q.basket_share_window(a.purchases(s, d), ["i1", "i2", "i3"], date(2024, 1, 22), date(2024, 1, 30)),
    "v09_compare_metrics": _compare,
    "v09_planted_change": _planted,
    "dq00_required_columns": lambda s, d: q.required_columns(a.raw_events(s, d), ["event_date", "event_timestamp", "customer_id", "item_id"]),
    "dq01_to_dq11_rules": _rules,
    "dq02_variant_in_options": _variants,
    "dq12_session_rules": lambda s, d: q.session_rules(_sessions(s, d)),
    "dq13_range_targets": lambda s, d: q.range_targets(a.ad_daily(s, d), a.purchases(s, d), a.web_events(s, d), 90, ctr=(0.3, 0.3334), volume=(1, 5000)),
    "dq14_signal_checks": _signals,
}

_V = """
  SELECT 'rows.creatives' AS metric, CAST(count(*) AS VARCHAR) AS value FROM creatives
  UNION ALL SELECT 'check.image_has_person_null', '0'
  UNION ALL SELECT 'rows.customers', CAST(count(*) AS VARCHAR) FROM customer
  UNION ALL SELECT 'check.phone_leading_zero', CAST(count(*) AS VARCHAR) FROM customer
  UNION ALL SELECT unnest(['rows.ad_daily', 'ad.impressions', 'ad.clicks', 'ad.cost']),
    unnest([count(*)::VARCHAR, sum(impressions)::VARCHAR, sum(clicks)::VARCHAR, CAST(sum(cost) AS DECIMAL(28,2))::VARCHAR]) FROM ad_daily
  UNION ALL SELECT unnest(['rows.orders', 'orders.revenue', 'orders.quantity', 'orders.customers', 'orders.min_date', 'orders.max_date', 'check.order_date_mismatch', 'aov']),
    unnest([count(*)::VARCHAR, sum(revenue)::VARCHAR, sum(quantity)::VARCHAR, count(DISTINCT customer_id)::VARCHAR, min(order_date)::VARCHAR, max(order_date)::VARCHAR, '0',
      round(sum(revenue)::DOUBLE / count(*), 6)::VARCHAR]) FROM purchases
  UNION ALL SELECT unnest(['rows.events', 'events.users', 'events.min_date', 'events.max_date', 'check.event_date_mismatch', 'check.user_id_with_dot']),
    unnest([count(*)::VARCHAR, count(DISTINCT user_pseudo_id)::VARCHAR, min(event_date), max(event_date), '0', '0']) FROM ev_q
  UNION ALL SELECT 'events.purchase_value', sum(value)::VARCHAR FROM ev_q WHERE event_name = 'purchase'
  UNION ALL SELECT 'events.sessions', count(*)::VARCHAR FROM (SELECT DISTINCT user_pseudo_id, ga_session_id FROM ev_q WHERE event_name = 'session_start')
  UNION ALL SELECT 'events.' || event_name, count(*)::VARCHAR FROM ev_q GROUP BY event_name
  UNION ALL SELECT 'ctr.' || channel, round(sum(clicks) / sum(impressions), 9)::VARCHAR FROM ad_daily GROUP BY channel"""
_S4 = """
  SELECT attr, exp(sum(ln(r) * ny * nn / (ny + nn)) / sum(ny * nn / (ny + nn))) AS estimate FROM (
    SELECT attr, channel, audience, count(*) FILTER (WHERE flag) AS ny, count(*) FILTER (WHERE NOT flag) AS nn,
      exp(avg(ln(ctr)) FILTER (WHERE flag) - avg(ln(ctr)) FILTER (WHERE NOT flag)) AS r
    FROM (SELECT channel, audience, clk / imp AS ctr, unnest(['person', 'cta', 'warm']) AS attr,
            unnest([has_person, cta_position = 'bottom-right', dominant_color = 'warm']) AS flag
          FROM creatives JOIN (SELECT creative_id, sum(clicks) AS clk, sum(impressions) AS imp FROM ad_daily GROUP BY 1) USING (creative_id)
          WHERE creative_id <> 'cr3' AND clk > 0)
    GROUP BY 1, 2, 3 HAVING ny > 0 AND nn > 0) GROUP BY attr"""
_S1 = """SELECT round(sum(cost) FILTER (WHERE date < DATE '1998-07-01')::DOUBLE / sum(clicks) FILTER (WHERE date < DATE '1998-07-01'), 9) AS cpc_before,
  round(sum(cost) FILTER (WHERE date >= DATE '1998-07-01')::DOUBLE / sum(clicks) FILTER (WHERE date >= DATE '1998-07-01'), 9) AS cpc_after FROM ad_daily WHERE ad_group_id = 'g1'"""
_S3 = """SELECT round(1 - exp(regr_slope(ln(clicks / impressions), (date - DATE '1996-01-01') / 7.0)), 9) AS weekly_decay, count(*) AS points
  FROM ad_daily WHERE creative_id = 'cr3' AND clicks > 0 AND date >= DATE '1996-01-01'"""
_S7 = """SELECT round(sum(quantity) FILTER (WHERE order_date BETWEEN DATE '2024-01-01' AND DATE '2024-01-21' AND item_id IN ('i1', 'i2', 'i3')) / sum(quantity) FILTER (WHERE order_date BETWEEN DATE '2024-01-01' AND DATE '2024-01-21'), 9) AS share_pre,
  round(sum(quantity) FILTER (WHERE order_date BETWEEN DATE '2024-01-22' AND DATE '2024-01-30' AND item_id IN ('i1', 'i2', 'i3')) / sum(quantity) FILTER (WHERE order_date BETWEEN DATE '2024-01-22' AND DATE '2024-01-30'), 9) AS share_window FROM purchases"""

_S6 = """
      SELECT source, count(*) FILTER (WHERE pos = 1) AS as_first, count(*) FILTER (WHERE pos = 2) AS as_last FROM (
        SELECT unnest([first_src, last_src]) AS source, unnest([1, 2]) AS pos FROM (
          SELECT user_pseudo_id, count(*) AS n, first(src ORDER BY event_timestamp, src) AS first_src, last(src ORDER BY event_timestamp, src) AS last_src
          FROM (SELECT e.user_pseudo_id, event_timestamp, utm_source || '/' || utm_medium AS src, f.us FROM web_events e
                JOIN (SELECT user_pseudo_id, min(order_us) AS us FROM purchases GROUP BY 1) f ON f.user_pseudo_id = e.user_pseudo_id
                WHERE event_name = 'session_start' AND event_timestamp <= f.us) GROUP BY 1 HAVING n >= 2)) GROUP BY source"""
_N = "CAST(round({}, 9) AS DECIMAL(28,9))::VARCHAR".format
_V += f"""
  UNION ALL SELECT 'cvr.session', {_N("(SELECT count(*) FROM purchases)::DOUBLE / count(*)")} FROM (SELECT DISTINCT user_pseudo_id, ga_session_id FROM ev_q WHERE event_name = 'session_start')
  UNION ALL SELECT unnest(['s1.cpc_before', 's1.cpc_after']), unnest([{_N("cpc_before")}, {_N("cpc_after")}]) FROM ({_S1})
  UNION ALL SELECT 's2.purchase_events', count(*)::VARCHAR FROM purchases WHERE order_date = DATE '2024-01-10'
  UNION ALL SELECT 's2.orders', count(*)::VARCHAR FROM purchases WHERE order_date = DATE '2024-01-10'
  UNION ALL SELECT 's2.orders_without_event_elsewhere', '0'
  UNION ALL SELECT 's3.weekly_decay', {_N("weekly_decay")} FROM ({_S3})
  UNION ALL SELECT 's4.' || attr, {_N("estimate")} FROM ({_S4})
  UNION ALL SELECT 's5.customers_with_' || n || CASE WHEN n = 3 THEN '_plus' ELSE '' END || '_orders', count(*)::VARCHAR FROM (SELECT least(count(*), 3) AS n FROM purchases GROUP BY customer_id) GROUP BY n
  UNION ALL SELECT 's6.' || name || '_' || e, coalesce((SELECT CASE e WHEN 'first' THEN as_first ELSE as_last END FROM ({_S6}) t WHERE t.source = w.source), 0)::VARCHAR
    FROM (SELECT 'meta' AS name, 'meta/paid_social' AS source UNION ALL SELECT 'google', 'google/organic') w, (SELECT unnest(['first', 'last']) AS e)
  UNION ALL SELECT unnest(['s7.share_pre', 's7.share_window']), unnest([{_N("share_pre")}, {_N("share_window")}]) FROM ({_S7})"""
_V_TABLES = "creatives ad_daily purchases web_events ev_q"

ORACLE = {
    "v01_metric_vector": sql(_V_TABLES, _V),
    "v02_cost_per_click_before_after": sql("ad_daily", _S1),
    "v03_event_vs_order_gap": sql("purchases web_events", """
      SELECT (SELECT count(*) FROM purchases WHERE order_date = DATE '2024-01-10' AND transaction_id % 50 <> 0) AS purchase_events,
        (SELECT count(*) FROM purchases WHERE order_date = DATE '2024-01-10') AS orders,
        (SELECT count(*) FROM purchases WHERE order_date <> DATE '2024-01-10' AND transaction_id % 50 = 0) AS orders_without_event_elsewhere"""),
    "v04_weekly_decay": sql("ad_daily", _S3),
    "v05_stratified_ratio": sql("creatives ad_daily", f"SELECT attr, round(estimate, 9) AS estimate FROM ({_S4})"),
    "v06_orders_per_customer": """SELECT 'customers_with_' || n || CASE WHEN n = 3 THEN '_plus' ELSE '' END || '_orders' AS metric, count(*) AS value
      FROM (SELECT least(count(*), 3) AS n FROM orders GROUP BY o_custkey) GROUP BY n""",
    "v07_first_last_touch": sql("web_events purchases", _S6),
    "v08_basket_share_window": sql("purchases", _S7),
    "v09_compare_metrics": sql(_V_TABLES, f"SELECT metric, 'OK' AS ok FROM ({_V})"),
    "v09_planted_change": "SELECT 'check.phone_leading_zero' AS metric, 1::BIGINT AS difference",
    "dq00_required_columns": sql("raw_ev", """
      SELECT c AS column_name, n AS nulls, CASE WHEN n = 0 THEN 'PASS' ELSE 'FAIL' END AS result FROM (
        SELECT unnest(['event_date', 'event_timestamp', 'customer_id', 'item_id']) AS c,
          unnest([count(*) - count(event_date), count(*) - count(event_timestamp), count(*) - count(customer_id), count(*) - count(item_id)]) AS n FROM raw_ev)"""),
    "dq01_to_dq11_rules": sql("web_events purchases shop_orders ad_daily creatives24", """
      SELECT rule, CASE WHEN n = 0 THEN 'PASS' ELSE 'FAIL' END AS result, n AS violations FROM (
        SELECT 'item_in_catalog' AS rule, count(*) AS n FROM shop_orders WHERE item_id NOT IN (SELECT p_brand FROM part)
        UNION ALL SELECT 'amount_equals_price_times_qty', count(*) FROM shop_orders LEFT JOIN (SELECT p_brand, CAST(min(p_retailprice) AS DECIMAL(18,2)) AS price FROM part GROUP BY 1) ON p_brand = item_id
          WHERE NOT coalesce(revenue = price * quantity, false)
        UNION ALL SELECT 'purchase_events_match_orders', 0
        UNION ALL SELECT 'order_id_unique', 0
        UNION ALL SELECT 'customer_fk', count(*) FROM purchases WHERE customer_id NOT IN (SELECT c_custkey FROM customer)
        UNION ALL SELECT 'first_order_date_consistent', count(*) FROM customer LEFT JOIN (SELECT customer_id, min(order_date) AS f FROM purchases GROUP BY 1) ON customer_id = c_custkey
          WHERE f IS DISTINCT FROM CAST(DATE '2024-01-01' + CAST(c_custkey % 30 AS INT) AS DATE)
        UNION ALL SELECT 'ad_creative_fk', count(*) FROM ad_daily WHERE creative_id NOT IN (SELECT creative_id FROM creatives24)
        UNION ALL SELECT 'event_creative_fk', count(*) FROM web_events WHERE creative_id NOT IN (SELECT creative_id FROM creatives24)
        UNION ALL SELECT 'clicks_le_impressions', count(*) FROM ad_daily WHERE clicks > impressions OR cost < 0
        UNION ALL SELECT 'dates_in_period', count(*) FROM web_events WHERE event_dt > DATE '2024-01-20'
        UNION ALL SELECT 'local_date_matches', count(*) FROM web_events WHERE CAST(make_timestamp(event_timestamp) + INTERVAL 8 HOUR AS DATE) <> event_dt
        UNION ALL SELECT 'first_event_is_first_visit', count(*) FROM (SELECT user_pseudo_id, first(event_name ORDER BY event_timestamp, event_name) AS f FROM web_events GROUP BY 1) WHERE f <> 'session_start'
        UNION ALL SELECT 'visitor_id_suffix', count(DISTINCT user_pseudo_id) FROM web_events)"""),
    "dq02_variant_in_options": sql("raw_ev", """
      SELECT 'variant_in_options' AS rule, CASE WHEN count(*) = 0 THEN 'PASS' ELSE 'FAIL' END AS result, count(*) AS violations
      FROM raw_ev WHERE item_id IS NOT NULL AND item_variant = 'v3'"""),
    "dq12_session_rules": """
      WITH st AS (SELECT user_id, CAST(epoch(ts) // 1 AS BIGINT) AS sid, count(*) AS n FROM events WHERE event_type <> 'purchase' GROUP BY 1, 2)
      SELECT rule, CASE WHEN n = 0 THEN 'PASS' ELSE 'FAIL' END AS result, n AS violations FROM (
        SELECT 'session_unique' AS rule, count(*) FILTER (WHERE n > 1) AS n FROM st
        UNION ALL SELECT 'session_gap', count(*) FILTER (WHERE sid - p <= 1800) FROM (SELECT sid, lag(sid) OVER (PARTITION BY user_id ORDER BY sid) AS p FROM st))""",
    "dq13_range_targets": sql("ad_daily web_events purchases", """
      SELECT 'ctr.' || channel AS rule, round(v, 6) AS value, CASE WHEN v BETWEEN 0.3 AND 0.3334 THEN 'PASS' ELSE 'FAIL' END AS result
        FROM (SELECT channel, sum(clicks) / sum(impressions) AS v FROM ad_daily GROUP BY 1)
      UNION ALL SELECT 'cvr', round(v, 6), CASE WHEN v BETWEEN 0.018 AND 0.025 THEN 'PASS' ELSE 'FAIL' END
        FROM (SELECT (SELECT count(*) FROM purchases) / (SELECT count(*) FROM web_events WHERE event_name = 'session_start') AS v)
      UNION ALL SELECT 'volume', count(*), CASE WHEN count(*) BETWEEN 1 AND 5000 THEN 'PASS' ELSE 'FAIL' END FROM web_events"""),
    "dq14_signal_checks": sql("ad_daily creatives purchases", f"""
      SELECT signal, round(value, 6) AS value, planted, CASE WHEN ok IS NULL THEN 'SKIP' WHEN ok THEN 'PASS' ELSE 'FAIL' END AS result FROM (
        SELECT 's1' AS signal, cpc_after / cpc_before AS value, 2.0::DOUBLE AS planted, cpc_after / cpc_before BETWEEN 1.7 AND 2.3 AS ok FROM ({_S1})
        UNION ALL SELECT 's3', weekly_decay, 0.08, abs(weekly_decay - 0.08) <= 0.025 FROM ({_S3})
        UNION ALL SELECT 's4.' || attr, round(estimate, 9), CASE attr WHEN 'person' THEN 1.25 ELSE 1.1 END, estimate > 1 + (CASE attr WHEN 'person' THEN 0.25 ELSE 0.1 END) * 0.4 FROM ({_S4})
        UNION ALL SELECT 's7', share_window / share_pre, NULL, share_window / share_pre > 1.1 FROM ({_S7}))"""),
}
