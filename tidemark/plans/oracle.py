"""Plain SQL of the adapter tables, for the cross-check of every query in a second engine."""

from __future__ import annotations

K = "CAST(regexp_extract(props, '[0-9]+', 0) AS INT)"

CTES = {
    "web_events": f"""
  SELECT event_id, CAST(ts AS DATE) AS event_dt, epoch_us(ts) AS event_timestamp,
    CASE WHEN event_type = 'purchase' THEN 'purchase' ELSE 'session_start' END AS event_name,
    user_id AS user_pseudo_id,
    CASE event_type WHEN 'signup' THEN '(direct)' WHEN 'view' THEN 'google' WHEN 'click' THEN 'meta' WHEN 'error' THEN 'line' END AS utm_source,
    CASE event_type WHEN 'signup' THEN '(none)' WHEN 'view' THEN 'organic' WHEN 'click' THEN 'paid_social' WHEN 'error' THEN 'push' END AS utm_medium,
    CASE WHEN event_type = 'signup' THEN '(direct)' WHEN event_type <> 'purchase' THEN 'c' || ({K} % 5) END AS utm_campaign,
    'cr' || ({K} % 24) AS creative_id, 'i' || ({K} % 20) AS item_id,
    CAST(value AS DECIMAL(18,2)) AS value,
    CASE WHEN event_type = 'purchase' THEN event_id END AS transaction_id, 'synthetic' AS data_source
  FROM events""",
    "purchases": f"""
  SELECT event_id AS transaction_id, CAST(ts AS DATE) AS order_date, epoch_us(ts) AS order_us, user_id AS customer_id,
    user_id AS user_pseudo_id, 'i' || ({K} % 20) AS item_id, CAST(1 + {K} % 3 AS BIGINT) AS quantity,
    CAST(value AS DECIMAL(18,2)) AS revenue, 'synthetic' AS data_source
  FROM events WHERE event_type = 'purchase'""",
    "shop_orders": """
  SELECT o_orderkey AS transaction_id, CAST(o_orderdate AS DATE) AS order_date, epoch_us(o_orderdate) AS order_us,
    o_custkey AS customer_id, o_custkey AS user_pseudo_id, p_brand AS item_id, p_type AS category,
    CAST(l_quantity AS BIGINT) AS quantity, CAST(p_size AS BIGINT) AS unit_price,
    CAST(o_totalprice AS DECIMAL(18,2)) AS revenue, 's' || substr(o_orderpriority, 1, 1) AS utm_source,
    o_orderstatus AS utm_medium, 'k' || (o_orderkey % 7) AS utm_campaign, 'synthetic' AS data_source
  FROM orders
  LEFT JOIN (SELECT * FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey
             ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice, l_quantity) = 1) ON l_orderkey = o_orderkey
  LEFT JOIN part ON p_partkey = l_partkey""",
    "ad_daily": """
  SELECT date, 'cr' || c AS creative_id, 'ch' || (c % 3) AS channel, 'g' || (c % 6) AS ad_group_id, 'k' || (c % 7) AS utm_campaign,
    impressions, clicks, cost, 'synthetic' AS data_source
  FROM (SELECT CAST(l_shipdate AS DATE) AS date, CAST(l_suppkey % 24 AS INT) AS c,
          CAST(sum(l_quantity) AS BIGINT) AS impressions,
          CAST(sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) AS BIGINT) AS clicks,
          CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(l_discount AS DECIMAL(4,2))) AS DECIMAL(18,4)) AS cost
        FROM lineitem GROUP BY 1, 2)""",
    "creatives": """
  SELECT 'cr' || c AS creative_id, 'ch' || (c % 3) AS channel, 'k' || (c % 7) AS utm_campaign, 'P' || (c % 4) AS promotion_id,
    'g' || (c % 6) AS ad_group_id, CASE WHEN c < 12 THEN 'prospecting' ELSE 'retargeting' END AS audience, 'image' AS format,
    CAST(DATE '1996-01-01' + c * 10 AS DATE) AS start_date, CAST(DATE '1996-03-31' + c * 10 AS DATE) AS end_date,
    'Brand#' || (1 + c % 10) AS product_focus, (c // 3) % 2 = 0 AS has_person,
    CASE WHEN (c // 6) % 2 = 0 THEN 'bottom-right' ELSE 'center' END AS cta_position,
    CASE WHEN c % 4 < 2 THEN 'warm' ELSE 'cool' END AS dominant_color,
    CASE WHEN c % 4 IN (0, 3) THEN 'high' ELSE 'low' END AS text_density
  FROM (SELECT DISTINCT CAST(s_suppkey % 24 AS INT) AS c FROM supplier)""",
}


def sql(uses: str, body: str, **more: str) -> str:
    """``WITH`` the named adapter tables (and further ones in ``more``) followed by ``body``."""
    parts = [f"{n} AS ({CTES[n]})" for n in uses.split()] + [f"{n} AS ({q})" for n, q in more.items()]
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + body


def share(name: str, uses: str, query: str) -> None:
    """Register a named query that later oracles may build on."""
    CTES[name] = query
