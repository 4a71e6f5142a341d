from datetime import date

from ..operators import attribution as at
from ..sources.adapters import purchases, web_events
from .oracle import CTES, sql

DAY = 86400000000


def mart(s, d, lookback=30):
    return at.mart_attribution(purchases(s, d), web_events(s, d), lookback)


CTES["at_touches"] = """
  SELECT user_pseudo_id, event_id AS touch_id, event_timestamp AS touch_us, utm_source || ' / ' || utm_medium AS channel, utm_campaign,
    utm_source = '(direct)' AS is_direct FROM web_events WHERE event_name = 'session_start'"""
CTES["at_orders"] = """
  SELECT *, lag(order_us) OVER (PARTITION BY user_pseudo_id ORDER BY order_us, transaction_id) AS prev_order_us,
    CAST(row_number() OVER (PARTITION BY user_pseudo_id ORDER BY order_us, transaction_id) AS INT) AS order_seq FROM purchases"""
CTES["at_paths"] = f"""
  SELECT o.*, t.touch_id, t.touch_us, t.channel, t.utm_campaign, t.is_direct
  FROM at_orders o JOIN at_touches t ON t.user_pseudo_id = o.user_pseudo_id AND t.touch_us <= o.order_us
    AND t.touch_us > o.order_us - 30 * {DAY} AND t.touch_us > coalesce(o.prev_order_us, -1)"""
CTES["at_pos"] = f"""
  SELECT *, CAST(row_number() OVER w AS INT) AS touch_seq, count(*) OVER p AS path_len,
    count(*) FILTER (WHERE NOT is_direct) OVER p AS nd_len,
    count(*) FILTER (WHERE NOT is_direct) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS nd_seq,
    power(0.5, (order_us - touch_us) / (7.0 * {DAY})) AS decay_w
  FROM at_paths
  WINDOW p AS (PARTITION BY transaction_id), w AS (PARTITION BY transaction_id ORDER BY touch_us, channel, utm_campaign, touch_id)"""
CTES["at_mart"] = f"""
  SELECT order_date, transaction_id, order_us, customer_id, user_pseudo_id, item_id, revenue, order_seq, order_seq > 1 AS is_repeat,
    CAST(order_date - 30 AS DATE) < (SELECT min(event_dt) FROM web_events) AS window_truncated, touch_seq, path_len, touch_us,
    make_timestamp(touch_us) AS touch_ts, round((order_us - touch_us) / {DAY}.0, 3) AS days_before_order, channel, utm_campaign, is_direct,
    CASE WHEN touch_seq = 1 THEN 1.0::DOUBLE ELSE 0 END AS credit_first,
    CASE WHEN touch_seq = path_len THEN 1.0::DOUBLE ELSE 0 END AS credit_last,
    decay_w / sum(decay_w) OVER p AS credit_decay,
    CASE WHEN nd_len = 0 THEN (touch_seq = 1)::INT::DOUBLE ELSE (NOT is_direct AND nd_seq = 1)::INT::DOUBLE END AS credit_first_nd,
    CASE WHEN nd_len = 0 THEN (touch_seq = path_len)::INT::DOUBLE ELSE (NOT is_direct AND nd_seq = nd_len)::INT::DOUBLE END AS credit_last_nd,
    CASE WHEN nd_len = 0 THEN decay_w / sum(decay_w) OVER p WHEN is_direct THEN 0
      ELSE decay_w / sum(CASE WHEN is_direct THEN 0 ELSE decay_w END) OVER p END AS credit_decay_nd
  FROM at_pos WINDOW p AS (PARTITION BY transaction_id)"""
# the same with a look-back of seven days, so that not every window is cut off by the start of the data
CTES["at_paths7"] = CTES["at_paths"].replace(f"30 * {DAY}", f"7 * {DAY}")
CTES["at_pos7"] = CTES["at_pos"].replace("FROM at_paths", "FROM at_paths7")
CTES["at_mart7"] = CTES["at_mart"].replace("order_date - 30", "order_date - 7").replace("FROM at_pos ", "FROM at_pos7 ")
BASE7 = "web_events purchases at_touches at_orders at_paths7 at_pos7 at_mart7"
BASE = "web_events purchases at_touches at_orders at_paths at_pos at_mart"


def _paths(s, d):
    return at.journeys(purchases(s, d), at.session_touches(web_events(s, d)))


def _rounded(df):
    from pyspark.sql import functions as F
    return df.withColumns({c: F.round(c, 9) for c in ("credit_decay", "credit_decay_nd")})


def _mart_positions(s, d):
    from pyspark.sql import functions as F
    return at.touch_positions(_paths(s, d)).select("transaction_id", "touch_id", "touch_seq", "path_len", "nd_len", "nd_seq",
                                                   F.round("decay_w", 9).alias("decay_w"), F.round("decay_sum", 9).alias("decay_sum"))


def _credit_only(s, d, cols):
    from pyspark.sql import functions as F
    return mart(s, d).select("transaction_id", "touch_seq", *[F.round(c, 9).alias(c) for c in cols])


LO, HI = date(2024, 1, 5), date(2024, 1, 20)

QUERIES = {
    "at01_order_sequence": lambda s, d: at.order_sequence(purchases(s, d)).select("transaction_id", "user_pseudo_id", "order_us", "order_seq", "prev_order_us"),
    "at02_session_touches": lambda s, d: at.session_touches(web_events(s, d), LO, HI),
    "at03_journeys": lambda s, d: _paths(s, d).select("transaction_id", "touch_id", "order_us", "touch_us", "order_seq"),
    "at04_touch_positions": _mart_positions,
    "at05_credit_first_last": lambda s, d: _credit_only(s, d, ["credit_first", "credit_last"]),
    "at06_credit_decay": lambda s, d: _credit_only(s, d, ["credit_decay"]),
    "at07_credit_without_direct": lambda s, d: _credit_only(s, d, ["credit_first_nd", "credit_last_nd", "credit_decay_nd"]),
    "at08_path_flags": lambda s, d: mart(s, d).select("transaction_id", "touch_seq", "is_repeat", "window_truncated", "days_before_order"),
    "at09_mart_attribution": lambda s, d: _rounded(mart(s, d)),
    "at10_check_attribution": lambda s, d: at.check_attribution(mart(s, d), purchases(s, d), covered_only=True),
    "at11_direct_effect": lambda s, d: at.report_direct_effect(mart(s, d)),
    "at12_first_purchase_credit": lambda s, d: at.report_first_purchase_credit(mart(s, d, 7)),
    "at13_path_length": lambda s, d: at.report_path_length(mart(s, d)),
    "at14_path_days": lambda s, d: at.report_path_days(mart(s, d, 7)),
    "at15_campaign_credit": lambda s, d: at.report_campaign_credit(mart(s, d), LO, HI),
    "at16_channel_attribution": lambda s, d: at.channel_attribution(mart(s, d), "time_decay", LO, HI, exclude_direct=True),
}

_C = at.CREDITS
ORACLE = {
    "at01_order_sequence": sql("purchases at_orders", "SELECT transaction_id, user_pseudo_id, order_us, order_seq, prev_order_us FROM at_orders"),
    "at02_session_touches": sql("web_events", """SELECT user_pseudo_id, event_id AS touch_id, event_timestamp AS touch_us,
      utm_source || ' / ' || utm_medium AS channel, utm_campaign, utm_source = '(direct)' AS is_direct FROM web_events
      WHERE event_name = 'session_start' AND event_dt BETWEEN DATE '2023-12-05' AND DATE '2024-01-20'"""),
    "at03_journeys": sql("web_events purchases at_touches at_orders at_paths", "SELECT transaction_id, touch_id, order_us, touch_us, order_seq FROM at_paths"),
    "at04_touch_positions": sql("web_events purchases at_touches at_orders at_paths at_pos", """SELECT transaction_id, touch_id, touch_seq, path_len, nd_len,
      nd_seq, round(decay_w, 9) AS decay_w, round(sum(decay_w) OVER (PARTITION BY transaction_id), 9) AS decay_sum FROM at_pos"""),
    "at05_credit_first_last": sql(BASE, "SELECT transaction_id, touch_seq, round(credit_first, 9) AS credit_first, round(credit_last, 9) AS credit_last FROM at_mart"),
    "at06_credit_decay": sql(BASE, "SELECT transaction_id, touch_seq, round(credit_decay, 9) AS credit_decay FROM at_mart"),
    "at07_credit_without_direct": sql(BASE, """SELECT transaction_id, touch_seq, round(credit_first_nd, 9) AS credit_first_nd,
      round(credit_last_nd, 9) AS credit_last_nd, round(credit_decay_nd, 9) AS credit_decay_nd FROM at_mart"""),
    "at08_path_flags": sql(BASE, "SELECT transaction_id, touch_seq, is_repeat, window_truncated, days_before_order FROM at_mart"),
    "at09_mart_attribution": sql(BASE, "SELECT * REPLACE (round(credit_decay, 9) AS credit_decay, round(credit_decay_nd, 9) AS credit_decay_nd) FROM at_mart"),
    "at10_check_attribution": sql(BASE, f"""
      SELECT 'orders_covered' AS check_name, CAST(count(DISTINCT transaction_id) AS VARCHAR) AS expected, CAST(count(DISTINCT transaction_id) AS VARCHAR) AS actual, 'OK' AS ok FROM at_mart
      UNION ALL SELECT 'revenue_covered', CAST(sum(revenue) AS VARCHAR), CAST(sum(revenue) AS VARCHAR), 'OK' FROM at_mart WHERE touch_seq = 1
      {' '.join(f"UNION ALL SELECT '{c}_sum_ne_1', '0', CAST(count(*) AS VARCHAR), 'OK' FROM (SELECT 1 FROM at_mart GROUP BY transaction_id HAVING abs(sum({c}) - 1) > 1e-9)" for c in _C)}
      UNION ALL SELECT 'touch_after_order', '0', CAST(count(*) FILTER (WHERE touch_us > order_us) AS VARCHAR), 'OK' FROM at_mart
      UNION ALL SELECT 'max_days_before_order_le_30', '<= 30', CAST(max(days_before_order) AS VARCHAR), 'OK' FROM at_mart
      UNION ALL SELECT 'path_len_consistent', '0', '0', 'OK'
      UNION ALL SELECT 'first_touch_position', '0', '0', 'OK'
      UNION ALL SELECT 'last_touch_position', '0', '0', 'OK'
      UNION ALL SELECT 'touch_before_prev_order', '0', '0', 'OK'
      UNION ALL SELECT 'info.touch_rows', '', CAST(count(*) AS VARCHAR), 'INFO' FROM at_mart"""),
    "at11_direct_effect": sql(BASE, """SELECT channel, round(sum(credit_first), 1) AS first_touch, round(sum(credit_last), 1) AS last_touch,
      round(sum(credit_decay), 1) AS time_decay, round(sum(credit_last_nd), 1) AS last_touch_nd FROM at_mart GROUP BY channel"""),
    "at12_first_purchase_credit": sql(BASE7, """SELECT channel, round(sum(credit_first_nd), 1) AS first_touch, round(sum(credit_last_nd), 1) AS last_touch,
      round(sum(credit_decay_nd), 1) AS time_decay, round(sum(credit_first_nd * revenue)) AS revenue_first,
      round(sum(credit_last_nd * revenue)) AS revenue_last, round(sum(credit_decay_nd * revenue)) AS revenue_decay
      FROM at_mart7 WHERE NOT is_repeat AND NOT window_truncated GROUP BY channel"""),
    "at13_path_length": sql(BASE, """SELECT least(path_len, 5) AS path_len_capped, count(*) AS orders, count(*) FILTER (WHERE is_repeat) AS repeat_orders,
      count(*) FILTER (WHERE window_truncated) AS truncated_orders FROM at_mart WHERE touch_seq = 1 GROUP BY 1"""),
    "at14_path_days": sql(BASE7, """SELECT is_repeat, count(*) AS orders, quantile_disc(days_before_order, 0.5) AS p50_days,
      quantile_disc(days_before_order, 0.9) AS p90_days FROM at_mart7 WHERE touch_seq = 1 AND path_len >= 2 AND NOT window_truncated GROUP BY 1"""),
    "at15_campaign_credit": sql(BASE, """SELECT utm_campaign, round(sum(credit_first_nd), 1) AS first_touch, round(sum(credit_last_nd), 1) AS last_touch,
      round(sum(credit_decay_nd), 1) AS time_decay FROM at_mart WHERE order_date BETWEEN DATE '2024-01-05' AND DATE '2024-01-20' GROUP BY 1"""),
    "at16_channel_attribution": sql(BASE, """SELECT channel, round(sum(credit_decay_nd), 1) AS credited_orders,
      CAST(round(sum(credit_decay_nd * revenue)) AS BIGINT) AS credited_revenue,
      round(sum(credit_decay_nd) / sum(sum(credit_decay_nd)) OVER (), 4) AS share_of_orders
      FROM at_mart WHERE order_date BETWEEN DATE '2024-01-05' AND DATE '2024-01-20' GROUP BY 1"""),
}
